"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

One order-4 model per language over lower-cased letters, every run of other characters
being one blank. The n-grams of all languages share one sorted hash array per order; a row
of values holds each language's log probability (its back-off value where it never saw the
n-gram), so a character costs one lookup whatever the number of languages.

Prediction: the language of the lowest cross-entropy per character. Rejection: a document
whose best cross-entropy lies further above what its language's training documents show
(standardised by length) than the calibrated bound, and over half way to what documents of
other languages show in it (so a foreign passage alone never rejects), or that has no letter.

Fit on a bounded sample: about ``per_lang`` documents of each language, taken by a hash of
the id. Defined cases: null text, no letter -> ``und``, score 0, rejected; null lang rows
teach nothing; ties go to the alphabetically first language; with nothing to learn from,
every document is ``und``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, small_batches
from .hashtable import SortedHash

ORDER = 4
_MUL = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93)]
#: characters scored in one numpy pass
PASS = 1 << 19
BLANK = 32
UNKNOWN = "und"


@lru_cache(1)
def _fold_table() -> np.ndarray:
    """Code point -> its lower-case letter, or the blank."""
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of all texts, blanks collapsed, and row offsets; each row starts after a blank."""
    fold = _fold_table()
    texts = [t or "" for t in texts]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    x = fold[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    offs = np.concatenate([[0], np.cumsum(lens)])
    blank = x == BLANK
    prev = np.ones(len(x), bool)
    prev[1:] = blank[:-1]
    prev[offs[:-1][lens > 0]] = True
    keep = ~(blank & prev)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return x[keep], kept[offs]


def gram_hash(cols: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given as one array per position."""
    h = np.full(len(cols[0]), len(cols), U64)
    for k, c in enumerate(cols):
        h += c.astype(U64) * _MUL[k]
    return mix(h)


def contexts(x: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For every symbol: [the three before it ..., itself]; blanks before a row's start."""
    out = [x]
    lens = np.diff(offs)
    pos = np.arange(len(x)) - np.repeat(offs[:-1], lens)
    for k in range(1, ORDER):
        c = np.full(len(x), BLANK, np.uint32)
        c[k:] = x[:-k] if len(x) > k else x[:0]
        c[pos < k] = BLANK
        out.append(c)
    return out[::-1]


class Model:
    """Kneser-Ney tables of all languages; built by :func:`fit`."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: language -> (grams [n, 4] uint32, counts [n])."""
        self.langs = sorted(counts)
        L = len(self.langs)
        alphabet = len({int(c) for g, _ in counts.values() for c in np.unique(g[:, -1])}) + 1
        self.floor = -math.log(alphabet)  # the base: a symbol of any alphabet position, seen or not
        per = [self._lang(*counts[lang], alphabet) for lang in self.langs]
        # a symbol that no language saw: what each sets aside for new ones, spread over the alphabet
        self.unseen = np.array([p["uni"] for p in per], np.float32)
        self.grams, self.backs = [], []
        for n in range(1, ORDER + 1):  # seen n-grams, all languages
            keys = np.unique(np.concatenate([p["h"][n] for p in per])) if per else np.zeros(0, U64)
            reps = np.zeros((len(keys), n), np.uint32)
            for p in per:
                reps[np.searchsorted(keys, p["h"][n])] = p["g"][n]
            vals = np.stack([self._value(p, reps, n) for p in per], 1).astype(np.float32) if L else np.zeros((0, 0), np.float32)
            self.grams.append((SortedHash(keys), vals))
        for n in range(1, ORDER):  # contexts of n symbols: the weight left for the next order down
            keys = np.unique(np.concatenate([p["ch"][n] for p in per])) if per else np.zeros(0, U64)
            vals = np.zeros((len(keys), L), np.float32)
            for i, p in enumerate(per):
                vals[np.searchsorted(keys, p["ch"][n]), i] = p["cw"][n]
            self.backs.append((SortedHash(keys), vals))
        self.mean, self.sd, self.bound = np.zeros(L), np.ones(L), 8.0
        self.level = np.zeros(L)  # cross-entropy half way to other languages' documents

    @staticmethod
    def _lang(g: np.ndarray, c: np.ndarray, alphabet: int) -> dict:
        """One language's counts by order: n-grams, contexts, discounts."""
        out = {"h": {}, "g": {}, "p": {}, "ch": {}, "cw": {}, "uni": None}
        level_g, level_c = g, c.astype(np.float64)
        levels = {}
        for n in range(ORDER, 0, -1):
            if n < ORDER:  # continuation counts: how many symbols come before the n-gram
                _, first, inv = np.unique(gram_hash([level_g[:, k] for k in range(1, n + 1)]), return_index=True, return_inverse=True)
                level_c = np.bincount(inv).astype(np.float64)
                level_g = level_g[first, 1:]
            levels[n] = (level_g, level_c)
        lower = None
        for n in range(1, ORDER + 1):
            gg, cc = levels[n]
            n1, n2 = np.sum(cc == 1), np.sum(cc == 2)
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            if n == 1:
                ctx, total, kinds = np.zeros(len(gg), np.int64), np.array([cc.sum()]), np.array([len(gg)])
                down = np.full(len(gg), 1.0 / alphabet)
                out["uni"] = math.log(d * len(gg) / cc.sum() / alphabet)
            else:
                key, ctx = np.unique(gram_hash([gg[:, k] for k in range(n - 1)]), return_inverse=True)
                total, kinds = np.bincount(ctx, cc), np.bincount(ctx)
                suffix = gram_hash([gg[:, k] for k in range(1, n)])
                at = np.searchsorted(lower[0], suffix)
                down = lower[1][at]
                out["ch"][n - 1], out["cw"][n - 1] = key, np.log(d * kinds / total)
            p = (np.maximum(cc - d, 0) + d * kinds[ctx] * down) / total[ctx]
            h = gram_hash([gg[:, k] for k in range(n)])
            order = np.argsort(h)
            lower = (h[order], p[order])
            out["h"][n], out["g"][n], out["p"][n] = h[order], gg[order], np.log(p[order])
        return out

    @staticmethod
    def _value(p: dict, g: np.ndarray, n: int) -> np.ndarray:
        """log P of n-grams ``g`` in one language, backing off where unseen."""
        if not len(g):
            return np.zeros(0)
        h = gram_hash([g[:, k] for k in range(n)])
        at = np.minimum(np.searchsorted(p["h"][n], h), len(p["h"][n]) - 1)
        seen = p["h"][n][at] == h
        out = np.where(seen, p["p"][n][at], p["uni"])
        miss = np.flatnonzero(~seen)
        if n > 1 and len(miss):
            low = Model._value(p, g[miss, 1:], n - 1)
            ch = gram_hash([g[miss, k] for k in range(n - 1)])
            keys, w = p["ch"][n - 1], p["cw"][n - 1]
            c = np.minimum(np.searchsorted(keys, ch), len(keys) - 1)
            out[miss] = low + np.where(keys[c] == ch, w[c], 0.0)
        return out

    def log_probs(self, cols: list[np.ndarray]) -> np.ndarray:
        """[symbols, languages] log probabilities of each symbol after its three predecessors."""
        n = len(cols[0])
        out = np.zeros((n, len(self.langs)), np.float32)
        todo = np.arange(n)
        for order in range(ORDER, 0, -1):
            here = [c[todo] for c in cols[ORDER - order :]] if order < ORDER else cols
            table, vals = self.grams[order - 1]
            at = table.find(gram_hash(here))
            hit = at >= 0
            if order == ORDER:
                out = vals[at] if len(vals) else out
                out[~hit] = 0
            else:
                out[todo[hit]] += vals[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if order > 1:
                table, vals = self.backs[order - 2]
                at = table.find(gram_hash([c[todo] for c in cols[ORDER - order : ORDER - 1]]))
                seen = at >= 0
                out[todo[seen]] += vals[at[seen]]
        out[todo] += self.unseen
        return out

    def totals(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(log P [rows, languages], symbols per row) over whole texts."""
        x, offs = symbols(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        if len(x) == 0:
            return sums, np.diff(offs)
        cols = contexts(x, offs)
        row = np.repeat(np.arange(len(texts)), np.diff(offs))
        for a in range(0, len(x), PASS):
            b = min(a + PASS, len(x))
            lp = self.log_probs([c[a:b] for c in cols])
            r = row[a:b]
            cut = np.flatnonzero(np.diff(r, prepend=-1))
            sums[r[cut]] += np.add.reduceat(lp, cut, axis=0, dtype=np.float64)
        return sums, np.diff(offs)

    def predict(self, texts: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected, nats per symbol) of each text."""
        sums, n = self.totals(texts)
        letters = np.fromiter((any(map(str.isalpha, t)) if t else False for t in texts), bool, len(texts))
        if not self.langs:
            z = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), z, np.ones(len(texts), bool), z
        m = np.maximum(n, 1)
        ce = -sums / m[:, None]
        best = ce.argmin(1)
        e = ce[np.arange(len(texts)), best]
        # confidence of the choice: a posterior over at most 40 symbols' evidence
        w = np.exp(-(ce - e[:, None]) * np.minimum(m, 40)[:, None])
        sure = 1.0 / w.sum(1)
        z = (e - self.mean[best]) * np.sqrt(m) / self.sd[best]
        # far above what the language's own documents show: the score falls through 0.5 at the bound
        fit = 1.0 / (1.0 + np.exp(np.clip((z - self.bound) * 2.0 / max(self.bound, 1.0), -50, 50)))
        rejected = ~letters | ((z > self.bound) & (e > self.level[best]))
        score = np.where(letters, sure * np.where(rejected, fit, np.maximum(fit, 0.5)), 0.0)
        langs = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        return langs, np.clip(score, 0, 1), rejected, e


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = 1200) -> Model:
    """Models of the languages of ``docs``, from about ``per_lang`` documents of each.

    The sample is taken by a hash of the id against a threshold per language; n-grams are
    counted on the executors, so only the distinct ones of the sample reach the driver.
    """
    docs = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("lang is not null and text is not null")
    small_batches(docs.sparkSession)
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    u = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.coalesce(F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, per_lang / n))])[F.col("lang")], F.lit(0.0))
    sample = docs.where(u < rate)

    def count(batches):
        total: dict = {}
        for b in batches:
            texts, langs = b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), object)
            for lang in set(langs):
                x, offs = symbols([t for t, m in zip(texts, langs) if m == lang])
                if len(x):
                    cols = contexts(x, offs)
                    _, first, c = np.unique(gram_hash(cols), return_index=True, return_counts=True)
                    total.setdefault(lang, []).append((np.stack([k[first] for k in cols], 1), c))
        for lang, parts in total.items():
            g, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            _, first, inv = np.unique(gram_hash(list(g.T)), return_index=True, return_inverse=True)
            c, g = np.bincount(inv, c).astype(np.int64), g[first].astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(c)), *(pa.array(g[:, k]) for k in range(ORDER)), pa.array(c)], ["lang", "a", "b", "c", "d", "n"])

    got = (
        sample.mapInArrow(count, "lang string, a long, b long, c long, d long, n long")
        .groupBy("lang", "a", "b", "c", "d").agg(F.sum("n").alias("n")).toArrow()
    )
    langs = np.array(got["lang"].to_pylist(), object)
    g = np.stack([got[k].to_numpy() for k in "abcd"], 1).astype(np.uint32) if len(langs) else np.zeros((0, 4), np.uint32)
    n = got["n"].to_numpy()
    model = Model({lang: (g[langs == lang], n[langs == lang]) for lang in set(langs)})
    if not model.langs:
        return model
    # calibration: what documents of each language show, standardised by their length
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def show(batches):
        for b in batches:
            m = shared.value
            texts, lang = b.column(1).to_pylist(), b.column(2).to_pylist()
            sums, k = m.totals(texts)
            ok = [i for i in range(len(texts)) if k[i] > 0 and lang[i] in m.langs]
            yield pa.record_batch(
                [pa.array([lang[i] for i in ok], pa.string()), pa.array((-sums[ok] / k[ok][:, None]).tolist() if ok else [], pa.list_(pa.float64())), pa.array(k[ok], pa.int64())],
                ["lang", "e", "n"],
            )

    seen = sample.mapInArrow(show, "lang string, e array<double>, n long").toArrow()
    lang, n = np.array(seen["lang"].to_pylist(), object), seen["n"].to_numpy()
    ce = np.array(seen["e"].to_pylist(), np.float64).reshape(len(lang), len(model.langs))
    z = []
    for i, name in enumerate(model.langs):
        own = lang == name
        e = ce[own, i]
        w = np.minimum(n[own], 2000)
        model.mean[i] = np.median(e)
        model.sd[i] = max(np.median(np.abs(e - model.mean[i]) * np.sqrt(w)) * 1.4826, 0.3)
        z.append((e - model.mean[i]) * np.sqrt(n[own]) / model.sd[i])
        other = float(np.median(ce[~own, i])) if (~own).any() else -model.floor
        model.level[i] = (model.mean[i] + max(other, model.mean[i] + 0.5)) / 2
    # a bound that training documents all but never pass, with half as much again for unseen ones
    model.bound = max(8.0, 1.5 * float(np.quantile(np.concatenate(z), 0.999)))
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected, cross_entropy) for every row, over whole texts."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score, rejected, e = shared.value.predict(b.column(1).to_pylist())
            yield pa.record_batch(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), pa.array(e)],
                ["id", "lang_pred", "score", "rejected", "cross_entropy"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, lang_pred string, score double, rejected boolean, cross_entropy double"
    )


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected documents; every column as it was, no join needed."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            rejected = shared.value.predict(b.column(at).cast(pa.string()).to_pylist())[2]
            yield b.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
