import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from alignforge.functions.alphabets import Alphabet
from alignforge.functions.scoring import Scoring, argmax, nucleotide_matches
from alignforge.operators import metrics as mt
from alignforge.operators import packing as pk
from alignforge.plans.cli import parse
from alignforge.plans.config import AlgoConfig, SWConfig, from_json, to_json
from alignforge.sources import sequences as src
from alignforge.sources.fasta_datasource import register
from alignforge.streaming import align_stream as stm


def test_alphabets(spark):
    na = Alphabet("na")
    assert na.encode("ACgt?") == [1, 3, 4, 2, 16] and na.decode([1, 3, 16]) == "AC\0"
    df = spark.createDataFrame([("ACgt?",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(na.encode_column(F.col("s"))).collect()] == [[1, 3, 4, 2, 16], [], None]


def test_matrices():
    m = nucleotide_matches()
    letters = "NATCGURYKMSWBDHV"
    assert m[letters.index("C"), letters.index("Y")] == 1 and m[letters.index("Y"), letters.index("C")] == 0
    assert m[0].all() and m[letters.index("U")].sum() == 2 and m[letters.index("K"), letters.index("B")] == 1
    s = Scoring.named("blosum62")
    assert (s.matrix == s.matrix.T).all() and s.score("W", "W") == 11 and s.score("a", "R") == -1 and s.score("*", "*") == 1
    for name, b, z in (  # the published rows of B and Z
        ("blosum50", "-2 -1 5 6 -3 0 1 -1 0 -4 -4 0 -3 -4 -2 0 0 -5 -3 -3 6 1 -1 -5", "-1 0 0 1 -3 4 5 -2 0 -3 -3 1 -1 -4 -1 0 -1 -2 -2 -3 1 5 -1 -5"),
        ("blosum62", "-2 -1 4 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4 0 -1 -4", "-1 0 0 1 -3 4 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -2 -2 -2 0 4 -1 -4"),
    ):
        m = Scoring.named(name)
        assert (m.matrix == m.matrix.T).all() and [m.matrix[m.letters.index(c)].tolist() for c in "BZ"] == [[int(v) for v in r.split()] for r in (b, z)]
    t = Scoring.from_text("# c\n A C\nA 2 -1\nC -1 3\n")
    assert t.score("C", "C") == 3
    assert argmax(np.array([[1, 3], [3, 0]])) == (0, 1)


def _full(algorithm):
    return pk.fill(algorithm, [{(i, 0): 10, (i, 1): 10} for i in range(20)], [100] * 20, 10, 2, 40)


@pytest.mark.parametrize("algorithm", ["fill_first", "round_robin", "greedy"])
def test_packing_full(algorithm):
    got = _full(algorithm)
    assert sorted(b for b, _ in got) == sorted(list(range(10)) * 2)
    with pytest.raises(pk.OutOfBuckets):
        pk.fill(algorithm, [{(i, 0): 10, (i, 1): 10} for i in range(21)], [100] * 21, 10, 2, 40)


def test_packing_partial_and_dedup():
    seqs = [{0: 6, 1: 6}, {2: 2, 3: 3}]
    assert pk.fill("fill_first", seqs, [36, 6], 10, 2, 40) == [(0, 0), (0, 1)]
    assert pk.fill("round_robin", seqs, [36, 6], 10, 2, 40) == [(0, 0), (1, 0)]
    for a in ("fill_first", "round_robin", "greedy"):
        b = pk._Buckets(1, 5, 100)
        for s in ({0: 4, 1: 4}, {0: 4, 2: 4}, {0: 4, 2: 4}):
            b.add(0, s)
        assert b.bytes == [12]
        assert pk.fill(a, [{0: 4, 1: 4}, {0: 4, 2: 4}, {0: 4, 2: 4}], [16] * 3, 1, 5, 12) is not None
    assert pk.batches([50, 50, 50, 200, 10], 10, 120) == [0, 0, 1, 2, 3]


def test_logs(spark):
    lines = [("r1", 'x ALIGNLOG{"tag":"batch_perf","t":1.0}'), ("r1", 'ALIGNLOG{"tag":"batch_perf","t":4.0}'), ("r1", "noise")]
    log = mt.tagged(spark.createDataFrame(lines, "file string, value string"), "ALIGNLOG", "tag string, t double")
    r = mt.rollup(log, "file", ["t"]).first()
    assert (r["t_median"], r["t_average"], r["t_max"], r["t_min"], r["t_sum"]) == (2.5, 2.5, 4.0, 1.0, 5.0)
    assert mt.Timer.profile(lambda: 3)[0] == 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ACGT\n\nTT\n")
    assert [(r[0], r[1]) for r in src.load(spark, str(tmp_path / "a.txt")).orderBy("seq_id").collect()] == [(0, "ACGT"), (1, ""), (2, "TT")]
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("AA\nCC\n")
    assert src.load(spark, str(tmp_path / "b.txt.gz"), 1).count() == 1
    (tmp_path / "c.fa").write_text("junk\n> 1 \nAC\n G T\n>2\nTT\n")
    rows = [tuple(r) for r in src.read_fasta(spark, str(tmp_path / "c.fa")).orderBy("seq_id").collect()]
    assert [r[1:] for r in rows] == [("> 1", "ACGT"), (">2", "TT")]
    assert src.first_record(spark, str(tmp_path / "c.fa")).first()["sequence"] == "ACGT"
    register(spark)
    got = spark.read.format("fasta").option("path", str(tmp_path / "c.fa")).load().orderBy("seq_id").collect()
    assert [tuple(r) for r in got] == [(0, "> 1", "ACGT"), (1, ">2", "TT")]


def test_ordinals_at_size(spark, tmp_path):
    """Numbers stay whole under default adaptive execution, many partitions and column pruning."""
    from alignforge.operators.pairing import with_ordinal

    n = 400_000
    df = spark.range(n, numPartitions=16).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("pad"))
    got = with_ordinal(df, ["k"], "ordinal")
    assert got.where("ordinal is null or ordinal <> k").count() == 0 and got.count() == n
    spark.range(n).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("v")).coalesce(1).write.text(str(tmp_path / "t.txt"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        got = src.load(spark, str(tmp_path / "t.txt"))
        assert got.rdd.getNumPartitions() > 1
        assert got.where("seq_id is null or seq <> concat('s', seq_id)").count() == 0 and got.count() == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stream(spark, tmp_path):
    pairs = spark.createDataFrame([(i, "ACGT" * 3, "CGTA" * 3) for i in range(20)], "pair_id long, a string, b string")
    pairs.repartition(3).write.parquet(str(tmp_path / "in"))
    job = stm.submit(stm.read_pairs(spark, str(tmp_path / "in"), max_files=1), Scoring.named("na"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert {tuple(r) for r in job.join().select("pair_id", "score").collect()} == {(i, 11) for i in range(20)}


def test_config_and_cli(tmp_path):
    c = from_json(SWConfig, '{"gapInit": -2}')
    assert c.gapInit == -2 and json.loads(to_json(c))["matchValue"] == 1
    assert AlgoConfig(tilesUsed=2, maxBatches=3, bufsize=9).input_words() == 2 * 3 + 24
    (tmp_path / "c.json").write_text('{"matchValue": 5, "maxAB": 7}')
    _, sw, algo, _ = parse(["r", "q", "-c", str(tmp_path / "c.json"), "--maxAB", "9"])
    assert (sw.matchValue, algo.maxAB) == (5, 9)


def test_small_measures(spark):
    times = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.5)], "worker int, s double")
    assert mt.slowest_worker(times, "worker", "s").first()[0] == 3.0
    placed = spark.createDataFrame([(7, 2, 1, 30, 40)], "pair_id long, bucket int, slot int, size_a int, size_b int")
    assert pk.describe(placed).first()["text"] == "cmp 7 -> bucket 2 slot 1 (30 + 40)"
    row = pk.fill_ratios(placed.withColumn("unit", F.lit(1)), "unit", 4, 2, 100).first()
    assert (row["empty"], row["cmps"], row["bytes"], row["cmp_fill"], row["byte_fill"]) == (3, 1, 70, 0.125, 0.175)
    from alignforge.plans.session import _number

    assert [_number(x) for x in ("64m", "67108864b", "10000", "-1", "2gb")] == [64 << 20, 64 << 20, 10000, -1, 2 << 30]
    assert spark.range(1).select(mt.gcups(F.lit(10**9), F.lit(0.0)), mt.gcups(F.lit(10**9), F.lit(2.0))).first() == (None, 0.5)


def test_matrix_container(spark):
    from alignforge.functions.scoring import Matrix

    m = Matrix(2, 3, [1, 5, 2, 5, 0, 4])
    c = m.copy()
    c[1, 2] = 9
    assert m.shape == (2, 3) and m[1, 2] == 4 and m.argmax() == (0, 1) and c.argmax() == (1, 2)
    assert m.flat() == [1, 5, 2, 5, 0, 4] and m.rows() == [[1, 5, 2], [5, 0, 4]] and str(m) == "1 5 2\n5 0 4"
    with pytest.raises(IndexError):
        m[2, 0]
    assert m.frame(spark).agg(F.sum("value")).first()[0] == 17


def test_runs(spark, tmp_path):
    """Command line: batching, packing, copies, records; what does not fit is an error."""
    from alignforge.plans.cli import main
    from alignforge.plans.run import run_comparison

    (tmp_path / "a.txt").write_text("".join(f"{'ACGT' * (3 + i % 5)}\n" for i in range(30)))
    (tmp_path / "b.fa").write_text("".join(f"> {i}\n{'CGTA' * (3 + i % 3)}\n" for i in range(30)))
    for k, fill in enumerate(("fillFirst", "roundRobin", "greedy")):
        out = tmp_path / f"out_{k}"
        assert main([str(tmp_path / "b.fa"), str(tmp_path / "a.txt"), "-o", str(out), "--fillAlgo", fill, "--tilesUsed", "4", "--maxBatches", "3", "--numDevices", "2", "--duplicateDatasets", "true"]) == 0
        done = spark.read.parquet(str(out / "results"))
        assert done.count() == 60 and done.where("score <= 0").count() == 0
        logs = src.read_logs(spark, str(out / "log")).withColumn("file", F.lit("ipu_run_small_set_2_4.log"))
        row = mt.roll_up_folder(logs, "run").first()
        assert (row["dataset"], row["numDevices"], row["duplication"], row["fillAlgo"]) == ("small_set", 2, "dup", fill)
        assert row["final_cmps_processed"] == 60 and row["final_cmps_orig"] == 30 and row["cell_count_sum"] == row["final_cells"]
        assert row["final_batches_processed"] == 2 * row["final_batches_orig"] and row["final_batches_orig"] == 4
    with pytest.raises(Exception, match="longer than"):
        run_comparison(spark, str(tmp_path / "b.fa"), str(tmp_path / "a.txt"), SWConfig(), AlgoConfig(maxAB=8))
    with pytest.raises(Exception, match="fits no bucket"):
        run_comparison(spark, str(tmp_path / "b.fa"), str(tmp_path / "a.txt"), SWConfig(), AlgoConfig(bufsize=21, tilesUsed=4, maxBatches=3))
    got = run_comparison(spark, str(tmp_path / "b.fa"), str(tmp_path / "a.txt"), SWConfig(), AlgoConfig(engine="sql", tilesUsed=4, maxBatches=3))
    assert got["cmps_processed"] == 30 and got["cells"] * 2 == row["final_cells"]


def test_batches_span_blocks(spark, monkeypatch):
    """A run's batches are one fold over all pairs, wherever blocks are cut."""
    from alignforge.plans import run

    rng = np.random.default_rng(4)
    size = rng.integers(0, 60, 400).tolist()
    rows = [(i, "A" * n, "") for i, n in enumerate(size)]
    pairs = spark.createDataFrame(rows, "pair_id long, a string, b string").repartition(5)
    monkeypatch.setattr(run, "BLOCK_PAIRS", 100)
    plan = run.planned(pairs, AlgoConfig(tilesUsed=10, maxBatches=5)).collect()
    assert {r["pair_id"]: int(r["batch"]) for r in plan} == {i: i // 44 for i in range(400)}
    sizes = pairs.select("pair_id", F.length("a").alias("size_a"), F.length("b").alias("size_b"))
    for cmps, data, block in ((45, 500, 100), (45, 500, 7), (1, 500, 9), (0, 1, 50), (400, 3000, 20), (45, 1, 13), (9, 10**6, 3)):
        got = {r["pair_id"]: r["batch"] for r in pk.assign_run_batches(sizes, cmps, data, block).collect()}
        assert [got[i] for i in range(400)] == pk.batches(size, cmps, data), (cmps, data, block)


def test_registry_matches_sql(spark):
    """Each query with SQL gives DuckDB's rows on the smallest tables."""
    import os

    import duckdb

    from alignforge.plans import registry

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem", "events", "documents"):
        p = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")

    def shown(df):
        df = df[sorted(df.columns)]
        return list(df.columns), sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))

    for name, sql in registry.ORACLES.items():
        assert shown(registry.QUERIES[name](spark, d).toPandas()) == shown(con.execute(sql).df()), name
