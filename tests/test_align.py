import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alignforge.functions.scoring import Scoring
from alignforge.operators import align as al
from alignforge.operators import pairing as pr
from alignforge.operators.kernel import align_batch
from tests.reference_align import brute

NA, OPEN3 = Scoring.named("na"), Scoring.open_extend("na", 3, 1)
# Hand-made pairs and their results.
GOLDEN = [  # a, b, score, a_begin, a_end, b_begin, b_end
    ("acgt", "acgt", 4, 0, 3, 0, 3), ("ACGT", "ACGT", 4, 0, 3, 0, 3), ("ACGT", "AACGT", 4, 0, 3, 1, 4), ("ACGT", "ACGTT", 4, 0, 3, 0, 3),
    ("TACGT", "ACGT", 4, 1, 4, 0, 3), ("TTACGT", "ACGT", 4, 2, 5, 0, 3), ("ACGTTT", "ACGT", 4, 0, 3, 0, 3), ("TTACGTTT", "ACGT", 4, 2, 5, 0, 3),
    ("AAAATTTTCCCCGGGG", "AAAATTTTCCCCGGGG", 16, 0, 15, 0, 15), ("AAAATTTTACCCGGGG", "AAAATTTTCCCCGGGG", 14, 0, 15, 0, 15),
    ("AAAATTTTACCCCGGGG", "AAAATTTTCCCCGGGG", 15, 0, 16, 0, 15), ("AAAATTTCCCCGGGG", "AAAATTTTCCCCGGGG", 14, 0, 14, 0, 15),
    ("GCTAGCTAGCTAGCTA", "AAAATTTTCCCCGGGG", 1, 3, 3, 0, 0), ("GCTAAAATTTTCCCCGGGG", "AAAATTTTCCCCGGGG", 16, 3, 18, 0, 15),
    ("AAAATTTTCCCCGGGGACT", "AAAATTTTCCCCGGGG", 16, 0, 15, 0, 15),
]
F3 = [
    ("GATTACGCAAGGCCTGCAAATACGCATCCAGTTGCTGGCTCTCTTTTTCCGCCAGCTCTGAGCGTAAGCGCGCTAATTCCTGGCGGTTATTGGCAGACAG",
     "GATTACGCAAGGCCTGCAAATACGCATCCAGTTGCTGGCTCTCTTTTTCCGCCAGCTCTGAGCGTAAGCGCGCTAATTCCTGGCGGGTATTGGGAGCACG", (93, 0, 98, 0, 97), (92, 0, 95, 0, 95)),
    ("TGGTTTCTACACTCGGCGTCACCGGCGGCAACAAGAA",
     "ATATCATCACTCCGATGGACGTTTCGATTATCGGCTGCGTGGGGAATGGCCCAGGTGAGGCGCTGGTTTCTACACTCGGCGTCACCGGCGGGACGAAACA", (29, 0, 33, 63, 96), (28, 0, 27, 63, 90)),
]


def run(a, b, s, outputs=("score", "end", "begin")):
    r = align_batch([x.encode() for x in a], [x.encode() for x in b], s, outputs)
    return list(zip(r["score"], r["a_begin"], r["a_end"], r["b_begin"], r["b_end"]))


def test_golden():
    assert run([g[0] for g in GOLDEN], [g[1] for g in GOLDEN], NA) == [tuple(g[2:]) for g in GOLDEN]


def test_differential():
    assert run([f[0] for f in F3], [f[1] for f in F3], NA) == [f[2] for f in F3]
    assert run([f[0] for f in F3], [f[1] for f in F3], OPEN3) == [f[3] for f in F3]


def test_protein():
    a = ["AAAAAA", "MMMMMM", "MATGGRRGAAAAP", "MATGGRRGAAAAPLLYPGEVCPGMDIRNNLVAVAALLLGAAGHLTRLHELENCSVIEGHL"]
    b = a[:3] + ["MATGGRRGAAAAPLLVAVAALLLGAAGHLYPGEVCPGMDIRNNLTRLHELENCSVIEGHL"]
    assert [r[0] for r in run(a, b, Scoring.open_extend("blosum50", 3, 1))] == [30, 42, 85, 285]


def test_stress():
    assert run(["A" * 150, "A" * 150], ["T" * 150, "A" * 150], NA) == [(0, 0, 0, 0, 0), (150, 0, 149, 0, 149)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ACGTN", max_size=24), st.text("ACGTN", max_size=24)), min_size=1, max_size=12), st.sampled_from([NA, OPEN3]))
def test_against_brute_force(pairs, s):
    got = run([p[0] for p in pairs], [p[1] for p in pairs], s)
    assert got == [brute(a, b, s.score, s.gap_init, s.gap_extend) for a, b in pairs]


def test_long_random_against_brute_force():
    rng = random.Random(3)
    a = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90))) for _ in range(25)]
    b = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90))) for _ in range(25)]
    assert run(a, b, OPEN3) == [brute(x, y, OPEN3.score, OPEN3.gap_init, OPEN3.gap_extend) for x, y in zip(a, b)]


def test_properties():
    rng = random.Random(5)
    s = Scoring.open_extend("blosum62", 3, 1)
    seqs = ["".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(30)) for _ in range(12)]
    x, y = seqs[:6], seqs[6:]
    scores = lambda p, q: [r[0] for r in run(p, q, s)]
    assert scores(x, y) == scores(y, x)
    assert scores(x, y) == scores([v[::-1] for v in x], [v[::-1] for v in y])
    assert scores(x, x) == [sum(s.score(c, c) for c in v) for v in x]
    dear = Scoring.open_extend("blosum62", 8, 2)
    assert all(r[0] <= q for r, q in zip(run(x, y, dear), scores(x, y)))


def test_cigar_scores_again():
    rng = random.Random(7)
    a = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(20)]
    b = [x[:20] + x[23:40] + "G" + x[40:] for x in a]
    r = align_batch([x.encode() for x in a], [x.encode() for x in b], OPEN3, ("score", "end", "begin", "cigar"))
    for i, (x, y) in enumerate(zip(a, b)):
        p, q, total, used, bad = r["a_begin"][i], r["b_begin"][i], 0, 0, 0
        for n, op in re.findall(r"(\d+)([=XIDS])", r["cigar"][i]):
            n = int(n)
            if op == "S":
                used += n
            elif op in "=X":
                assert all((x[p + k] == y[q + k]) == (op == "=") for k in range(n))
                total += sum(OPEN3.score(x[p + k], y[q + k]) for k in range(n))
                p, q, used, bad = p + n, q + n, used + n, bad + n * (op == "X")
            else:
                total += OPEN3.gap_init + n * OPEN3.gap_extend
                bad += n
                p, q, used = (p + n, q, used + n) if op == "I" else (p, q + n, used)
        assert (total, used, bad) == (r["score"][i], len(x), r["mismatches"][i])


def test_second_best():
    a, b = "ACGTACGTAC", "ACGTACGTAC" + "T" * 30 + "ACGTACGT"
    r = align_batch([a.encode()], [b.encode()], OPEN3, ("score", "end", "second"), 15)
    assert (r["score"][0], r["b_end"][0], r["score2"][0], r["b_end2"][0]) == (10, 9, 8, 47)


def test_dataframe_rules(spark):
    df = spark.createDataFrame([(1, "ACGT", "ACGT"), (2, None, "A"), (3, "", "A"), (4, "acgt", "TACG")], "pair_id long, a string, b string")
    got = {r["pair_id"]: r for r in al.align(df, NA, outputs=("score", "end", "begin", "cigar"), min_score=4).collect()}
    assert got[1]["cigar"] == "4=" and got[2]["score"] is None and got[3]["score"] == 0 and got[4]["cigar"] is None and got[4]["score"] == 3
    with pytest.raises(Exception, match="longer than 3"):
        al.align(df, NA, max_length=3).collect()


def test_pairings(spark):
    seqs = spark.createDataFrame([(0, "AAAAAA"), (1, "TTTTTT"), (2, "TTTTAT"), (3, "AAAAAA")], "seq_id long, seq string")
    cmp = spark.createDataFrame([(0, 0, 2), (1, 0, 3), (2, 1, 2), (3, 1, 3)], "cmp_id long, a_id long, b_id long")
    got = al.align(pr.pair_list(seqs, cmp), NA, outputs=("score",)).orderBy("cmp_id").collect()
    assert [r["score"] for r in got] == [1, 6, 4, 0]
    with pytest.raises(ValueError):
        pr.zip_pairs(cmp.select("cmp_id", cmp.a_id.cast("string").alias("a")), cmp.limit(1).select("cmp_id", cmp.b_id.cast("string").alias("b")), "cmp_id")
    from pyspark.sql import functions as F

    assert pr.within_blocks(seqs, F.lit(0)).count() == 6
    assert sorted(r["pair_id"] for r in pr.with_ordinal(seqs, ["seq"]).collect()) == [0, 1, 2, 3]


def test_distance_gate_and_characters(spark):
    """The gate takes end - begin as the distance; positions count characters, not bytes."""
    df = spark.createDataFrame([(1, "ACGT", "ACGT"), (2, "\u00c0ACGT", "ACGT"), (3, "\u4e2dACGT", "ACGT")], "pair_id long, a string, b string")
    how = ("score", "end", "begin", "cigar")
    at = {k: {r["pair_id"]: r for r in al.align(df, NA, outputs=how, max_distance=k).collect()} for k in (2, 3)}
    assert at[3][1]["cigar"] == "4=" and at[2][1]["cigar"] is None
    assert [(at[3][i]["a_begin"], at[3][i]["a_end"]) for i in (2, 3)] == [(1, 4), (1, 4)]


def test_tracebacks_in_little_memory(monkeypatch):
    """Rows computed again give the CIGAR of whole tables."""
    from alignforge.operators import kernel

    rng = random.Random(11)
    a = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 140))) for _ in range(40)]
    b = ["".join(c for c in x if rng.random() > 0.1).replace("AC", "AGC") + "".join(rng.choice("ACGT") for _ in range(20)) for x in a]
    how = ("score", "end", "begin", "cigar")
    got = []
    for cells in (1 << 20, 3000, 0):
        monkeypatch.setattr(kernel, "TABLE_CELLS", cells)
        r = align_batch([x.encode() for x in a], [x.encode() for x in b], OPEN3, how)
        got.append((r["cigar"], r["mismatches"]))
    assert got[0] == got[1] == got[2] and any("D" in c or "I" in c for c in got[0][0] if c)
    monkeypatch.setattr(kernel, "TABLE_CELLS", 1 << 20)
    x = "".join(rng.choice("ACGT") for _ in range(4000))
    r = align_batch([x.encode()], [(x[:1500] + x[1510:]).encode()], OPEN3, how)
    assert r["cigar"] == ["1500=10I2490="] or r["score"][0] == 3990 + OPEN3.gap_init + 10 * OPEN3.gap_extend


def test_tracebacks_go_together(spark, monkeypatch):
    """Pairs of a group are walked back together, as one at a time; pairs of the same letters once; rows leave their task."""
    from alignforge.operators import kernel

    rng = random.Random(13)
    a = ["".join(rng.choice("ARNDWC") for _ in range(rng.randint(0, 50))) for _ in range(60)]
    b = ["".join(rng.choice("WC") + c if rng.random() < 0.1 else c for c in x if rng.random() > 0.15) for x in a]
    a, b = [x.encode() for x in a] + [None, b"", a[1].lower().encode()], [x.encode() for x in b] + [b"A", b"A", b[1].encode()]
    s, how = Scoring.open_extend("blosum62", 3, 1), ("score", "end", "begin", "cigar")
    alone = []
    with monkeypatch.context() as m:
        m.setattr(kernel, "TABLE_CELLS", 0)  # each pair by itself
        alone = align_batch(a, b, s, how)
    walks = []
    monkeypatch.setattr(kernel, "traceback", lambda *x: walks.append(1))
    assert align_batch(a, b, s, how) == alone and not walks
    sizes = []
    monkeypatch.setattr(kernel, "groups", lambda la, lb, f=kernel.groups: sizes.append(len(la)) or f(la, lb))
    got = align_batch([b"ACGT", b"acgt", b"AC?T"] * 50, [b"ACGT"] * 150, NA, ("score", "end"))
    assert sizes == [2] and got["score"] == [4, 4, 2] * 50 and got["a_end"] == [3, 3, 1] * 50
    one = spark.createDataFrame([(i, "ACGT" * (i % 9), "CGTA") for i in range(90)], "pair_id long, a string, b string").coalesce(1)
    assert al.align(one, NA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_blocks_are_cut(spark):
    """Pairs of a large block come once each, through many units."""
    rows = [(i, "x" if i % 3 else "y" if i % 2 else None, f"s{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "seq_id long, k string, seq string")
    from pyspark.sql import functions as F

    want = sorted((i, j) for i, k, _ in rows for j, m, _ in rows if i > j and k == m)
    for most in (512, 7, 1):
        got = pr.within_blocks(df, F.col("k"), most=most).collect()
        assert sorted((r["a_id"], r["b_id"]) for r in got) == want
        assert all(r["a"] == f"s{r['a_id']}" and r["b"] == f"s{r['b_id']}" for r in got)


def test_blocks_are_aligned_in_place(spark):
    """Pairs made beside the kernel are those of the join, with the same results, whatever the pieces."""
    from pyspark.sql import functions as F

    rng = random.Random(17)
    word = lambda: "".join(rng.choice("ACGTacgt?") for _ in range(rng.randint(0, 12)))
    rows = [(i, None if i % 7 == 0 else i % 3, None if i % 11 == 0 else word()) for i in range(70)] + [(None, 1, "ACGT"), (5, 2, "ACGT"), (900, 77, "A")]
    df = spark.createDataFrame(rows, "seq_id long, k int, seq string")
    for key, how, kinds in ((F.col("seq_id"), ("score", "end"), (256, 5, 1)), (F.concat(F.lit("s"), F.col("seq_id")), ("score", "end", "begin", "second", "cigar"), (5,))):
        s = df.withColumn("seq_id", key)
        want = al.align(pr.within_blocks(s, F.col("k")), OPEN3, outputs=how)
        for most in kinds:
            got = al.align_within_blocks(s, F.col("k"), OPEN3, outputs=how, most=most)
            assert got.columns == want.columns and got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_aligner_object(spark):
    q = spark.createDataFrame([(1, "ACGT"), (2, ""), (3, "TTACGTTT")], "id long, seq string")
    one = al.Aligner(NA).set_reference("ACGT")
    assert {r["id"]: r["score"] for r in one.align_to_reference(q).collect()} == {1: 4, 3: 4}
    assert one.set_gap_penalty(5, 2).scoring.gap_init == -3
    one.clear()
    assert one.scoring.name == "bases" and one.reference is None
    with pytest.raises(ValueError):
        one.align_to_reference(q)
    pairs = spark.createDataFrame([(1, "ACGTT", "AACGT"), (2, None, "A"), (3, "", "A"), (4, "AC?T", "ACNT")], "pair_id long, a string, b string")
    got = [sorted(map(tuple, al.Aligner(OPEN3, ("score", "end"), engine=e).align(pairs).collect())) for e in ("arrow", "sql")]
    assert got[0] == got[1]
    with pytest.raises(ValueError):
        al.Aligner(NA, engine="sql").align(pairs)
