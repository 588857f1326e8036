import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alignforge.llm import decontaminate, langid, pitman_yor, sentencepiece_viterbi, token_binary, toxicity
from alignforge.llm.common import fold, token_hashes
from alignforge.llm.queries import tokenizer_path

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split(t):
    return (t or "").encode().translate(LOW).split()


def test_tokens_follow_bytes():
    import pyarrow as pa

    texts = ["A b\x0bC", None, "", "a\u00a0b  c", "x" * 3_000_000 + " y", "A"]
    h, rows = token_hashes(pa.array(texts))
    assert np.diff(rows).tolist() == [len(split(t)) for t in texts]
    assert h[0] == h[-1] and len(set(h.tolist())) == len({w for t in texts for w in split(t)})


# ------------------------------------------------------------------ language ID
def test_langid(spark, docs, corpus):
    model = langid.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    got = {r["id"]: r for r in langid.predict(docs, model).collect()}
    held = [(i, lang) for i, _, lang, _ in corpus if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, "щука щедра жуёт щи " * 20), (2, None), (3, "12 34 !!"), (4, "zzqxj " * 60)], "doc_id long, text string")
    got = {r["id"]: r for r in langid.predict(odd, model).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[2]["rejected"] and got[3]["rejected"]
    assert got[1]["rejected"] and got[4]["rejected"]
    assert langid.keep_known(docs, model).count() >= 0.98 * docs.count()


class PlainKneserNey:
    """Interpolated Kneser-Ney over strings, as a recursion over dictionaries."""

    def __init__(self, texts, alphabet):
        self.alphabet, self.levels = alphabet, {}
        top = Counter()
        for t in texts:
            padded = "   " + t
            top.update(padded[i : i + 4] for i in range(len(t)))
        for n in (4, 3, 2, 1):
            if n < 4:
                top = Counter(g[1:] for g in top)  # how many symbols come before it
            ones, twos = (sum(c == k for c in top.values()) for k in (1, 2))
            total, kinds = Counter(), Counter()
            for g, c in top.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.levels[n] = (top, total, kinds, ones / (ones + 2 * twos) if ones and twos else 0.5)

    def p(self, gram):
        if not gram:
            return 1 / self.alphabet
        count, total, kinds, d = self.levels[len(gram)]
        ctx = gram[:-1]
        if not total[ctx]:
            return self.p(gram[1:])
        return (max(count[gram] - d, 0) + d * kinds[ctx] * self.p(gram[1:])) / total[ctx]


def folded(text):
    """The symbols of a text: lower-cased letters, every other run one blank, none in front."""
    out = ""
    for c in text or "":
        low = c.lower() if c.isalpha() else " "
        low = low if len(low) == 1 else c
        if not (low == " " and out[-1:] in ("", " ")):
            out += low
    return out


def test_kneser_ney_against_dictionaries(docs, corpus):
    """Every probability, the sum over the alphabet, and every document's language and cross-entropy."""
    train = [(folded(t), lang) for i, t, lang, _ in corpus if zlib.crc32(str(i).encode()) % 4 != 2]
    alphabet = len({c for t, _ in train for c in t}) + 1
    plain = {lang: PlainKneserNey([t for t, x in train if x == lang], alphabet) for lang in ("en", "fr")}
    model = langid.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    assert model.langs == ["en", "fr"]
    letters = sorted({c for t, _ in train for c in t})
    for ctx in ("the", " le", "zzz", "   ", "q u", "éé "):
        cols = [np.full(len(letters) + 1, ord(c), np.uint32) for c in ctx] + [np.array([*map(ord, letters), 99999], np.uint32)]
        got = np.exp(model.log_probs(cols).astype(float))
        for j, lang in enumerate(model.langs):
            want = [plain[lang].p(ctx + c) for c in [*letters, chr(99999)]]
            assert np.allclose(got[:, j], want, rtol=1e-4), (ctx, lang)
        assert np.allclose(got.sum(0), 1, atol=1e-4)
    got = {r["id"]: r for r in langid.predict(docs, model).collect()}
    for i, t, *_ in corpus[::6]:
        x = folded(t)
        ce = {lang: -sum(np.log(m.p(("   " + x)[k : k + 4])) for k in range(len(x))) / len(x) for lang, m in plain.items()}
        best = min(ce, key=ce.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["cross_entropy"] - ce[best]) < 1e-3


def test_langid_held_out(spark):
    """op9 on whole tables: the held-out quarter."""
    import os

    from alignforge.llm.queries import op9_language_id

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").where("lang is not null and length(text) > 80").collect()}
    got = {r["doc_id"]: r["lang_pred"] for r in op9_language_id(spark, d).where("held_out").collect()}
    both = [got[i] == lang for i, lang in truth.items() if i in got]
    assert len(both) > 20 and np.mean(both) > 0.95


def test_langid_edge(spark, edge):
    model = langid.fit(edge)
    assert langid.predict(edge, model).count() == edge.count()
    assert langid.keep_known(edge, model).columns == edge.columns
    nothing = langid.fit(edge.where(F.lit(False)))
    assert {r["lang_pred"] for r in langid.predict(edge, nothing).collect()} == {"und"}


# ------------------------------------------------------------------ toxicity
def test_toxicity(spark, docs, labels, corpus):
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    got = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    y = {i: x for i, _, _, x in corpus}
    pos, neg = [got[i] for i in y if y[i]], [got[i] for i in y if not y[i]]
    assert np.mean([p > n for p in pos for n in neg]) > 0.95
    spelled = model.scores(["the and i-d-i-o-t thing on the m.o.r.o.n and ering on idi0t the", "the and thing ering on the ering and on the ering and"])
    assert spelled[0] > spelled[1]
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns


def plain_score(model, text):
    """A text's score from the model's weights: every window, every gapped subsequence, one by one."""
    x = [int(v) for v in toxicity.encode([text])[0]]
    n = len(x) - toxicity.WINDOW  # the text's own symbols
    pad = x + [toxicity.PAD] * 40
    starts = []
    for p in range(len(x) + toxicity.WINDOW):
        s = 0.0
        for i in range(1, toxicity.SPAN):
            for j in range(i + 1, toxicity.SPAN):
                for k in range(j + 1, toxicity.SPAN):
                    s += toxicity.DECAY ** (k + 1) * float(model.weights[((pad[p] * 32 + pad[p + i]) * 32 + pad[p + j]) * 32 + pad[p + k]])
        starts.append(s)
    value = [sum(starts[p : p + toxicity.WINDOW]) + model.bias for p in range(n)]
    best = sorted((max(value[a : a + toxicity.BLOCK]) for a in range(0, n, toxicity.BLOCK)), reverse=True)
    f = [1.0, best[0], sum(best[:3]) / len(best[:3]), math.log1p(sum(b > 0 for b in best)), math.log1p(sum(b > 1 for b in best)), math.log1p(max(n, 200))]
    f[1], f[2] = (min(max(v, -3), 3) for v in f[1:3])
    return 1 / (1 + math.exp(-min(max(sum(a * b for a, b in zip(f, model.curve)), -30), 30)))


def test_toxicity_against_plain_windows(spark, docs, labels, corpus):
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    got = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, t, *_ in [*corpus[:4], corpus[7], corpus[-1]]:
        assert abs(got[i] - plain_score(model, t)) < 2e-4
    assert abs(model.scores([None])[0] - plain_score(model, "")) < 2e-4


def test_toxicity_held_out(spark):
    """op5 on whole tables: the held-out fifth."""
    import os

    from alignforge.llm.queries import op5_toxicity

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null").collect()}
    rows = [(truth[r["doc_id"]], r["predicted"]) for r in op5_toxicity(spark, d).where("held_out").collect() if r["doc_id"] in truth]
    assert np.mean([p for y, p in rows if y == 0]) < 0.02 and np.mean([p for y, p in rows if y == 1]) > 0.5


def test_toxicity_sample_bound(docs, labels):
    texts, y = toxicity.labelled_sample(docs, labels, "doc_id", "text", "doc_id", "toxic", 1500, 20000, 3000)
    assert all(0 < sum(len(t) for t, v in zip(texts, y) if v == k) <= 3000 for k in (0, 1))


def test_toxicity_edge(edge, labels):
    model = toxicity.fit(edge, labels.limit(0))
    assert toxicity.score(edge, model).where("score between 0 and 1").count() == edge.count()
    one = toxicity.fit(edge, labels.where("toxic = 0"))
    assert toxicity.score(edge, one).where("score < 0.5").count() == edge.count()


def test_string_kernel_by_enumeration():
    """The table form equals summing the weights of the shared gapped subsequences."""
    rng = np.random.default_rng(1)
    w = np.zeros(toxicity.CODES**4, np.float32)
    w[rng.integers(0, len(w), 200_000)] = 1.0
    x = rng.integers(0, 27, 60)
    got = toxicity.local_values(x, w)
    pad = list(x) + [toxicity.PAD] * toxicity.SPAN
    for p in range(len(x)):
        s = 0.0
        for i in range(1, toxicity.SPAN):
            for j in range(i + 1, toxicity.SPAN):
                for k in range(j + 1, toxicity.SPAN):
                    s += toxicity.DECAY ** (k + 1) * w[((pad[p] * 32 + pad[p + i]) * 32 + pad[p + j]) * 32 + pad[p + k]]
        assert abs(s - got[p]) < 1e-4


# ------------------------------------------------------------------ decontamination
def test_decontamination(spark, docs):
    rng = random.Random(5)
    item = [f"bench{rng.randint(0, 999)}" for _ in range(40)]
    changed = item[:]
    for k in range(3, 40, 7):
        changed[k] = "other"
    rows = [(1, "a b c " + " ".join(item) + " d e"), (2, "q " + ", ".join(changed).upper()), (3, " ".join(item[:6])), (4, "nothing of it"), (5, None), (6, "tiny item here")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item)), (8, "tiny item here"), (9, None), (10, "")], "item_id long, text string")
    got = {(r["id"], r["item_id"]): r for r in decontaminate.overlaps(d, b).collect()}
    assert set(got) == {(1, 7), (2, 7), (6, 8)}
    assert got[1, 7]["matched"] == 40 and got[1, 7]["first_token"] == 3 and got[2, 7]["matched"] == 33  # the last substitution costs more than the one token behind it
    blocks = decontaminate.overlaps(d, b, block_items=1)
    assert {(r["id"], r["item_id"]) for r in blocks.collect()} == set(got)
    assert {r["doc_id"] for r in decontaminate.keep_uncontaminated(d, b).collect()} == {3, 4, 5}
    assert decontaminate.overlaps(docs, b.limit(0)).count() == 0


def test_decontamination_edge(edge, spark):
    b = spark.createDataFrame([(1, "one two"), (1, "one two")], "item_id long, text string")
    assert decontaminate.keep_uncontaminated(edge, b).columns == edge.columns
    assert {r["id"] for r in decontaminate.overlaps(edge, b).collect()} == {6}


# ------------------------------------------------------------------ tokens
def viterbi(v, t):
    best, back = [0.0] + [sentencepiece_viterbi.NONE] * len(t), [0] * (len(t) + 1)
    for i in range(1, len(t) + 1):
        for m in range(1, min(i, v.longest) + 1):
            s = v.score.get(t[i - m : i])
            s = v.penalty if s is None and m == 1 else s
            if s is not None and best[i - m] + s > best[i]:
                best[i], back[i] = best[i - m] + s, i - m
    out, e = [], len(t)
    while e:
        out.append((back[e], e))
        e = back[e]
    return [i for a, b in reversed(out) for i in ([v.ids[t[a:b]]] if t[a:b] in v.ids else v.fallback(t[a:b]))]


def test_streaming_viterbi():
    v = sentencepiece_viterbi.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    enc = sentencepiece_viterbi.Encoder(v)
    rng = random.Random(3)
    texts = ["", "a", " a", "  a  b ", "\n\n x", "日本語テキスト😀", "internationalization" * 30] + ["".join(rng.choice("the ingéan\n") for _ in range(200)) for _ in range(10)]
    flat, rows = enc.encode(texts)
    for t, a, b in zip(texts, rows[:-1], rows[1:]):
        marked = "▁" + t.replace(" ", "▁") if t else ""
        want = viterbi(v, marked)
        assert list(flat[a:b]) == want
        s = sentencepiece_viterbi.Stream(v)
        got = [i for k in range(0, len(marked), 7) for i in s.feed(marked[k : k + 7])] + s.finish()
        assert got == want and s.widest <= max(8 * v.longest, 64)
    assert [b.decode() for b in sentencepiece_viterbi.decode_ids(v, flat, rows)] == texts


def test_streams_side_by_side(monkeypatch):
    """Many texts in lockstep, one stream each, and the plain table: the same ids, whatever the window."""
    v = sentencepiece_viterbi.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(8)
    letters = list("aaabeeinorst" + "éß語😀")
    cuts = ["▁" + "".join(rng.choice(letters, rng.integers(0, 400))) for _ in range(60)] + ["", "▁", "a" * 900, "😀" * 150, "ab" * 300]
    want = [sentencepiece_viterbi.stream_encode(v, c) for c in cuts]
    monkeypatch.setattr(sentencepiece_viterbi, "ALONE", 10**6)
    monkeypatch.setattr(sentencepiece_viterbi.Stream, "feed", None)  # lockstep alone
    flat, at = sentencepiece_viterbi.encode_cuts(v, cuts)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    seen = []
    real = sentencepiece_viterbi._meeting
    monkeypatch.setattr(sentencepiece_viterbi, "_meeting", lambda w, rows, i, most: seen.append(w.size) or real(w, rows, i, most))
    sentencepiece_viterbi.encode_cuts(v, cuts)
    assert len(seen) > 20 and max(seen) <= 16 * v.longest  # committed as it goes: the window stays small


def test_sentencepiece_edge(edge):
    path = tokenizer_path("piece_bpe_32k.model")
    got = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(edge, path), path)
    assert got.where(F.crc32("decoded") == F.col("text_crc32")).count() == edge.count()


def test_token_binary(spark, edge, docs, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    texts = ["it's <|endoftext|> x", "don't'stuff 's ''ll a1b2 ÉÀ…. x…y <|ENDOFTEXT|>", "", None, "I'VE 'Re e\u0301t A\u030aB"]
    flat, rows = token_binary.WordEncoder(path).encode(texts)
    t = Tokenizer.from_file(path)
    for x, a, b in zip(texts, rows[:-1], rows[1:]):
        assert list(flat[a:b]) == t.encode(x or "", add_special_tokens=False).ids
    monkeypatch.setattr(token_binary, "SHARD_DOCS", 7)
    for k, df in enumerate((docs, edge)):
        files = token_binary.write(df, f"{tmp_path}/{k}", path)
        listed = {r["name"]: r["bytes"] for r in files.collect()}
        on_disk = {f.name: f.stat().st_size for f in (tmp_path / str(k) / "shards").iterdir() if f.suffix == ".tokens"}
        assert listed == on_disk and len(listed) > 2
        (tmp_path / str(k) / "shards" / "part-000009-000009.tokens").write_bytes(b"left by a lost run")
        got = token_binary.read(spark, f"{tmp_path}/{k}").orderBy("start").collect()
        assert len(got) == df.count()
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        keyed = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or "") for r in df.collect())
        want = Counter(((k[1] if k[0] else None), np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4").tobytes()) for k, x in keyed)
        assert Counter((r["id"], bytes(r["ids"])) for r in got) == want
    token_binary.write(docs.limit(0), f"{tmp_path}/none", path)
    assert token_binary.read(spark, f"{tmp_path}/none").count() == 0
    next((tmp_path / "0" / "shards").glob("part-000000-*.tokens")).unlink()
    with pytest.raises(ValueError, match="missing"):
        token_binary.read(spark, f"{tmp_path}/0")


def test_words_that_collide_in_polynomials(spark, tmp_path):
    """Two words of a thousand letters whose polynomial hashes are equal modulo 2**64 stay apart everywhere."""
    import pyarrow as pa

    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    h, _ = token_hashes(pa.array([one, two]))
    assert h[0] != h[1]
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    flat, rows = token_binary.WordEncoder(path).encode([one, two, one])
    assert [list(flat[a:b]) for a, b in zip(rows[:-1], rows[1:])] == [t.encode(x, add_special_tokens=False).ids for x in (one, two, one)]


def test_cuts_that_share_a_hash(monkeypatch):
    """Cuts with one first hash are told apart by the second."""
    from alignforge.llm import cutcache

    real = cutcache.span_hashes
    monkeypatch.setattr(cutcache, "span_hashes", lambda raw, a, b, seed=0: real(raw, a, b, 1) if seed else np.full(len(a), 7, np.uint64))
    cache = cutcache.CutCache()
    raw = np.frombuffer(b"abcdab", np.uint8)
    new = lambda cuts: (np.frombuffer(b"".join(cuts), np.uint8).astype(np.int32), np.array([len(c) for c in cuts]))
    for _ in range(2):
        flat, at = cache.encode(raw, np.array([0, 2, 4]), np.array([2, 4, 6]), new)
        assert flat.tolist() == list(b"abcdab") and at.tolist() == [0, 2, 4, 6]


@pytest.mark.parametrize("top", [3, 300, 70_000, 20_000_000])
def test_shard_round_trip(top):
    rng = np.random.default_rng(top)
    ids = (rng.zipf(1.3, 5000) % top).astype(np.int64)
    names, n = [5, None, -3], np.array([0, 4000, 1000])
    a, b, c, d = token_binary.read_shard(token_binary.write_shard(names, n, ids, 12))
    assert a == names and (b == n).all() and (c == ids).all() and d == 12


# ------------------------------------------------------------------ language model
def test_pitman_yor(spark, docs, corpus):
    rows = pitman_yor.score(docs, fold(F.col("doc_id"), 10) == 0).collect()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in corpus}
    toks = {i: split(t) + [None] for i, t, *_ in corpus}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = toks[r["id"]]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert r["n_tokens"] == len(ws) and r["train_tokens"] == n and r["n_known"] == sum(c[w] > 0 for w in ws)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["held_out"] == held[r["id"]]
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_pitman_yor_edge(edge):
    got = pitman_yor.score(edge, fold(F.col("doc_id"), 10) == 0)
    assert got.count() == edge.count() and got.where("score is null or isnan(score)").count() == 0
    assert pitman_yor.score(edge.limit(0), F.lit(False)).count() == 0
    assert pitman_yor.score(edge, F.lit(True)).where("score = 0").count() == edge.count()  # only the unknown is left
