import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from alignforge.llm import langid, sentencepiece_viterbi, toxicity
from alignforge.llm.common import fold
from alignforge.llm.queries import tokenizer_path
from tests.llm.test_decontaminate import found_by_walk
from tests.llm.test_near_dup import brute
from tests.llm.test_text_operators import PlainKneserNey, folded, plain_score, viterbi


def test_stages_against_brute_force(spark, docs, labels, corpus, tmp_path):
    """Each stage in plain Python on what its predecessor kept: dictionaries of letters, windows one by
    one, all pairs of sets, every diagonal, and a Viterbi table; only fitted numbers come from the package."""
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    bench = [(1, " ".join(corpus[20][1].split()[2:18])), (2, "never seen at all in here")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    benchmark.write.parquet(f"{d}/benchmark.parquet")
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, d).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    # language: rejected by the calibrated bounds on a plain model's cross-entropy
    train = docs.where(fold(F.col("doc_id"), 4) != 2)
    model = langid.fit(train)
    texts = {}
    for r in train.collect():
        texts.setdefault(r["lang"], []).append(folded(r["text"]))
    alphabet = len({c for ts in texts.values() for t in ts for c in t}) + 1
    plain = [PlainKneserNey(texts[lang], alphabet) for lang in model.langs]
    for i, t in list(rows.items()):
        x = folded(t)
        ce = [-sum(np.log(m.p(("   " + x)[k : k + 4])) for k in range(len(x))) / len(x) for m in plain]
        j = int(np.argmin(ce))
        z = (ce[j] - model.mean[j]) * len(x) ** 0.5 / model.sd[j]
        if z > model.bound and ce[j] > model.level[j]:
            del rows[i]
    tox = toxicity.fit(docs.where(F.col("doc_id").isin(list(rows))), labels.where(fold(F.col("doc_id"), 5) != 0))
    suspects = {i for i, s in zip(rows, tox.scores(list(rows.values()))) if 0.3 < s < 0.7}
    sampled = suspects | set(list(rows)[::25])  # window by window is slow: all near the bound, and some of the rest
    scores = dict(zip(rows, tox.scores(list(rows.values()))))
    assert all(abs(plain_score(tox, rows[i]) - scores[i]) < 2e-4 for i in sampled)
    rows = {i: t for i, t in rows.items() if scores[i] < 0.5}
    comp = brute(list(rows.items()))
    rows = {i: t for i, t in rows.items() if comp[i][1] == i}
    seen = {i for i, *_ in found_by_walk(list(rows.items()), bench)}
    rows = {i: t for i, t in rows.items() if i not in seen}
    assert 20 not in rows and set(got) == set(rows)
    v = sentencepiece_viterbi.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    for i, t in rows.items():
        assert got[i] == viterbi(v, "▁" + t.replace(" ", "▁"))
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "MinHash near-dedup"


def test_pipeline_without_documents(spark, docs, labels, tmp_path):
    d = str(tmp_path)
    docs.limit(0).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "abc def")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_stages_keep_columns(spark, edge, labels, tmp_path):
    d = str(tmp_path)
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "abc def")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = edge
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, d)
        assert out.columns == edge.columns
    assert corpus_pipeline.tokens(spark, edge, d).count() == edge.count()
