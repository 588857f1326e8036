import random

import pytest

SYL = {
    "en": "the er on an in ing tion and re at ed nd ha en".split(),
    "fr": "le de eux aux ment ou que eau tre ion la oi ier".split(),
}


def words(rng, lang, n):
    return ["".join(rng.choice(SYL[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, toxic): two languages, copies, near copies, insults."""
    rng = random.Random(1)
    out = []
    for i in range(240):
        lang = "fr" if i % 3 == 0 else "en"
        w = words(rng, lang, rng.randint(20, 90))
        toxic = int(i % 6 == 1)
        if toxic:
            for _ in range(3):
                w.insert(rng.randint(1, len(w)), rng.choice(["idiot", "moron", "scumbag"]))
        out.append((i, " ".join(w), lang, toxic))
    base = out[10][1]
    for k in range(6):  # a family of near copies, and exact ones
        w = base.split()
        w[3 + 5 * (k % 2)] = f"changed{k}"
        out.append((300 + k, " ".join(w) if k < 4 else base.upper(), "en", 0))
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang, _ in corpus], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark, corpus):
    return spark.createDataFrame([(i, 1, x) for i, _, _, x in corpus], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing column names."""
    rng = random.Random(2)
    long = " ".join(words(rng, "en", 30000))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, long, "en"), (5, long + " more", "en"), (6, "one two", "fr"), (6, "one two", "fr"),
        (None, "the and thing ering", None), (None, None, None), (7, "x" * 5000, "en"), (8, "Ünïcode 日本語 😀 �", "xx"), (9, "!!! 123 ???", "en"),
    ]
    full = [(i, t, lang, 0, "c", "k", 1.0, "id") for i, t, lang in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, a int, c string, key string, score double, id string")
