import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from alignforge.llm import decontaminate
from alignforge.llm.common import token_hashes


def avoids_masks(masks, need=10, match=3, substitution=7):
    """Whether some pattern of matches and substitutions is accepted (10 matches, 0.7 identity) and meets no mask.

    A walk over (matches so far, last 10 tokens) that keeps the best 3 * matches - 7 * substitutions.
    """
    n, low = 1 << 10, -(10**9)
    state = np.arange(n)
    free = np.ones(n, bool)
    for m in masks:
        free &= (state & int(m, 2)) != int(m, 2)
    best = np.full((need + 1, n), low)
    best[0, 0] = 0
    now = best.copy()
    while (now > low).any():
        after = np.full_like(now, low)
        for bit, gain in ((0, -substitution), (1, match)):
            to = ((state << 1) | bit) & (n - 1)
            for k in range(need + 1):
                value = np.where((now[k] > low) & free[to], now[k] + gain, low)
                np.maximum.at(after[min(k + bit, need)], to, value)
        if (after[need] >= 0).any():
            return True
        now = np.where(after > best, after, low)
        best = np.maximum(best, after)
    return False


def test_masks_miss_no_accepted_pattern():
    assert avoids_masks(["1101011001", "1110010101", "1011000111", "1111110000", "1001101011"])
    assert not avoids_masks(decontaminate.MASKS)


def test_every_fourth_word_substituted(spark):
    rng = random.Random(3)
    docs, items = [], []
    for n in (20, 40, 200):
        for phase in range(4):
            w = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            items.append((len(items), " ".join(w)))
            w = [f"x{k}" if k % 4 == phase else x for k, x in enumerate(w)]
            docs.append((len(docs), " ".join(["before"] * 7 + w + ["after"] * 7)))
    got = decontaminate.overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {(r["id"], r["item_id"]) for r in got.collect()} == {(i, i) for i in range(len(docs))}
    assert decontaminate.keep_uncontaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).count() == 0


def brute_force(t, b, min_match=10, identity=0.7):
    """Most matches of any stretch of any diagonal that counts, by trying all of them; no seeds."""
    best, need = 0, min(min_match, len(b))
    for diagonal in range(1 - len(b), len(t)):
        lo, hi = max(0, diagonal), min(len(t), diagonal + len(b))
        same = [t[k] == b[k - diagonal] for k in range(lo, hi)]
        if sum(same) < need:
            continue
        for i in range(len(same)):
            for j in range(i + 1, len(same) + 1):
                m = sum(same[i:j])
                if m >= need and m >= identity * (j - i) - 1e-9:
                    best = max(best, m)
    return best


def test_against_diagonals_without_seeds():
    rng = random.Random(5)
    base = {n: [f"w{n}x{k}" for k in range(n)] for n in (1, 4, 9, 10, 11, 13, 15, 30, 45)}
    cases = [(11, [1]), (11, [9]), (13, [1, 11])]
    cases += [(n, [k for k in range(n) if rng.random() < p]) for n in base for p in (0.1, 0.2, 0.3, 0.35, 0.5) for _ in range(8)]
    # a good passage beside others that are just too thin
    cases += [(45, [k for k in range(45) if k >= 11 and k % 5 in (0, 2)])]
    names = list(base)
    seeds = decontaminate.Seeds(np.arange(len(names)), [" ".join(base[n]) for n in names], 10, 0.7)
    caught = 0
    for n, changed in cases:
        t = ["p", "q"] + [f"y{k}" if k in changed else w for k, w in enumerate(base[n])] + ["r"] * rng.randrange(3)
        h, at = token_hashes(pa.array([" ".join(t)]), decontaminate.BETWEEN)
        got = [(item, seeds.overlap(h, item, d)) for _, item, d in zip(*seeds.hits(h, at))]
        got = [(item, o) for item, o in got if o]
        want = brute_force(t, base[n])
        assert {names[i] for i, _ in got} == ({n} if want else set()), (n, changed)
        caught += bool(want)
        for i, (m, a, z) in got:
            assert min(10, n) <= m <= want and m >= 0.7 * (z - a) - 1e-9
            assert m == sum(x == y for x, y in zip(t[a:z], base[n][a - 2 : z - 2]))
    assert 100 < caught < len(cases)


def plain_tokens(text):
    """The token rule by itself: runs of letters, digits and non-ASCII characters, A-Z lowered."""
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def found_by_walk(docs, items):
    """(id, item, most matches, tokens of the item) by walking every diagonal that has enough matches; no seeds, no hashes."""
    out = []
    for i, text in docs:
        t = plain_tokens(text)
        places = {}
        for k, w in enumerate(t):
            places.setdefault(w, []).append(k)
        for j, item in items:
            b = plain_tokens(item)
            on = Counter(k - p for p, w in enumerate(b) for k in places.get(w, ()))
            need, best = min(10, len(b)), 0
            for d, n in on.items():
                if n >= need:
                    same = [t[k] == b[k - d] for k in range(max(0, d), min(len(t), d + len(b)))]
                    sums = np.concatenate([[0], np.cumsum(same)])
                    m = sums[None, :] - sums[:, None]
                    size = np.arange(len(sums))[None, :] - np.arange(len(sums))[:, None]
                    ok = (size > 0) & (m >= need) & (m >= 0.7 * size - 1e-9)
                    best = max(best, int(m[ok].max(initial=0)))
            if best and b:
                out.append((i, j, best, len(b)))
    return sorted(out, key=str)


def test_punctuated_items_and_cases(spark):
    items = [
        (0, "What is the well-known answer?"), (1, "f(x) = x^2 + y!"), (2, "Name the (first) man on the moon; then, the 2nd: who was it?"),
        (3, ""), (4, None), (None, "never"), (5, "..."), (2, "another text under a used number, long enough to be found by its seeds alone"),
    ]
    docs = [
        (1, "before: What is the well-known answer? after"), (2, "F(X) = X^2 + Y"), (3, "so - name the first man on the moon then the second who was it"),
        (4, None), (5, ""), (6, "clean words only"), (None, "What is the well known answer"), (None, "also clean"), (6, "f(x) = x^2 + y!"),
        (7, "another text under a used number long enough to be found by its seeds alone"), (8, "never"),
    ]
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = decontaminate.overlaps(d, b).collect()
    sort = lambda rows: sorted(rows, key=str)
    want = found_by_walk(docs, [x for x in items if x[0] is not None and x[1]])
    assert sort((r["id"], r["item_id"], r["matched"], r["item_tokens"]) for r in got) == sort(want)
    assert {r[:2] for r in want} == {(1, 0), (2, 1), (3, 2), (None, 0), (6, 1), (7, 2)}
    kept = decontaminate.keep_uncontaminated(d, b)
    assert sort((r["doc_id"], r["text"]) for r in kept.collect()) == sort([(4, None), (5, ""), (6, "clean words only"), (None, "also clean"), (8, "never")])
    assert kept.columns == d.columns
    assert decontaminate.overlaps(d.limit(0), b).count() == 0 and decontaminate.overlaps(d, b.limit(0)).count() == 0
    # the same through many blocks
    many = decontaminate.overlaps(d, b, block_items=2).collect()
    assert sort(map(tuple, many)) == sort(map(tuple, got))


def test_query_against_the_walk(spark):
    """op6's result on whole tables, against every diagonal of every pair."""
    from alignforge.llm.queries import op6_decontamination

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(((r["doc_id"], r["item_id"], r["item_tokens"]) for r in op6_decontamination(spark, d).collect()), key=str)
    want = found_by_walk(docs, items)
    assert got == sorted([(i, j, n) for i, j, _, n in want], key=str) and want
