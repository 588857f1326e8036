"""Registered queries of the alignment engine and their DuckDB SQL.

Sequences come from whole text columns: part names (short, so SQL can align them too) and
documents (long; SQL cannot, and tests hold the kernel against a brute-force version).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignforge.functions import cigar as cg
from alignforge.functions import scoring as sc
from alignforge.functions.alphabets import AA_LETTERS, NA_LETTERS, Alphabet, right_trim, strip_whitespace, translate_bases
from alignforge.functions.scoring import Scoring, simple_similarity
from alignforge.operators import align as al
from alignforge.operators import metrics as mt
from alignforge.operators import packing as pk
from alignforge.operators import pairing as pr
from alignforge.plans import run as rn
from alignforge.plans.config import AlgoConfig, SWConfig
from alignforge.plans.session import shared_dir
from alignforge.sources import sequences as src
from alignforge.streaming import align_stream as stm

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------ SQL pieces
def sql_cells(s: Scoring, match: int = 1, mismatch: int = -1, ambiguity: int = -1) -> list[list[int]]:
    """The matrix for the SQL side, from the published texts and not from the object under test."""
    n = len(s.letters)
    if s.name == "na":
        meets = sc.NA_MEETS.split()
        return [[ambiguity if 0 in (i, j) else match if meets[i][j] == "1" else mismatch for j in range(n)] for i in range(n)]
    low = [[int(v) for v in line.split()] for line in {"blosum50": sc.BLOSUM50, "blosum62": sc.BLOSUM62}[s.name].strip().split("\n")]
    least = min(min(r) for r in low)
    cell = lambda i, j: low[max(i, j)][min(i, j)] if max(i, j) < n - 2 else (1 if i == j else least) if n - 1 in (i, j) else -1
    return [[cell(i, j) for j in range(n)] for i in range(n)]


def sql_matrix(s: Scoring) -> str:
    """The matrix as a flat DuckDB list, row by row."""
    return "[" + ",".join(str(v) for r in sql_cells(s) for v in r) + "]"


def sql_code(char: str, s: Scoring) -> str:
    """1-based place of a character; unknown ones at the scoring's stand-in."""
    rest = s.letters.index(s.unknown) + 1
    return f"(CASE WHEN instr('{s.letters}', upper({char})) > 0 THEN instr('{s.letters}', upper({char})) ELSE {rest} END)"


def sql_align(pairs: str, s: Scoring, begin: bool = True, keys: str = "pair_id") -> str:
    """Local alignment in SQL over ``pairs`` (keys, a, b): a recursive query runs over the rows of B."""
    n, gi, ge = len(s.letters), s.gap_init, s.gap_extend
    mat = sql_matrix(s)
    codes = lambda c: f"list_transform(string_split({c}, ''), lambda c: {sql_code('c', s)})"

    def dp(name: str, source: str) -> str:
        return f"""
{name}_in AS (SELECT {keys}, {codes('a')} a, {codes('b')} b FROM {source} WHERE length(a) > 0 AND length(b) > 0),
{name}_dp AS (
  SELECT {keys}, a, b, 0 i, list_transform(a, lambda x: 0) H, list_transform(a, lambda x: 0) E, 0 best, 0 ae, 0 be FROM {name}_in
  UNION ALL
  SELECT {keys}, a, b, i, H, E, greatest(best, mx),
    CASE WHEN mx > best THEN list_position(H, mx) - 1 ELSE ae END, CASE WHEN mx > best THEN i - 1 ELSE be END
  FROM (SELECT *, list_max(H) mx FROM (
    SELECT {keys}, a, b, i, best, ae, be, E,
      list_transform(T, lambda x, j: greatest(x, {gi} + {ge} * j + list_max(list_prepend(0,
        list_transform(range(1, j), lambda k: T[k] - ({ge}) * k))))) H
    FROM (SELECT *, list_transform(E, lambda e, j: greatest(0, e,
        (CASE WHEN j = 1 THEN 0 ELSE H0[j - 1] END) + {mat}[(a[j] - 1) * {n} + b[i]])) T
      FROM (SELECT {keys}, a, b, i + 1 i, best, ae, be, H H0,
          list_transform(E, lambda e, j: greatest(H[j] + {gi} + {ge}, e + {ge})) E
        FROM {name}_dp WHERE i < len(b)))))),
{name} AS (SELECT {keys}, best score, ae, be FROM {name}_dp WHERE i = len(b))"""

    out = "WITH RECURSIVE " + pairs + "," + dp("fw", "pairs")
    ends = "coalesce(fw.score, 0)::INTEGER score, coalesce(fw.ae, 0)::INTEGER a_end, coalesce(fw.be, 0)::INTEGER b_end"
    if not begin:
        return out + f" SELECT {keys}, {ends} FROM pairs LEFT JOIN fw USING ({keys})"
    back = f"""back_pairs AS (SELECT {keys}, reverse(substr(a, 1, ae + 1)) a, reverse(substr(b, 1, be + 1)) b
      FROM pairs JOIN fw USING ({keys}) WHERE fw.score > 0)"""
    return (
        out + "," + back + "," + dp("bw", "back_pairs")
        + f""" SELECT {keys}, {ends}, coalesce(fw.ae - bw.ae, 0)::INTEGER a_begin, coalesce(fw.be - bw.be, 0)::INTEGER b_begin
    FROM pairs LEFT JOIN fw USING ({keys}) LEFT JOIN bw USING ({keys})"""
    )


def sql_second(pairs: str, s: Scoring, mask: int = 15, keys: str = "pair_id") -> str:
    """Score, ends, and the best score of a B position outside ``mask`` around the best end."""
    text = sql_align(pairs, s, begin=False, keys=keys)
    # the recursion also keeps every row's maximum
    text = text.replace("0 best, 0 ae, 0 be FROM fw_in", "0 best, 0 ae, 0 be, []::INTEGER[] tops FROM fw_in")
    text = text.replace("CASE WHEN mx > best THEN i - 1 ELSE be END", "CASE WHEN mx > best THEN i - 1 ELSE be END, list_append(tops, mx::INTEGER)")
    text = text.replace("i, best, ae, be, E,", "i, best, ae, be, tops, E,").replace("i + 1 i, best, ae, be, H H0", "i + 1 i, best, ae, be, tops, H H0")
    text = text.replace("best score, ae, be FROM fw_dp", "best score, ae, be, tops FROM fw_dp")
    head, tail = text.rsplit(" SELECT ", 1)
    return f"""{head}, away AS (SELECT {keys}, list_transform(tops, lambda t, i: CASE WHEN i - 1 >= be - {mask} AND i - 1 < be + {mask} THEN 0 ELSE t END) o FROM fw)
      SELECT {tail.split(" FROM ")[0]}, (CASE WHEN list_max(o) > 0 THEN list_max(o) ELSE 0 END)::INTEGER score2,
        (CASE WHEN list_max(o) > 0 THEN list_position(o, list_max(o)) - 1 ELSE 0 END)::INTEGER b_end2
      FROM pairs LEFT JOIN fw USING ({keys}) LEFT JOIN away USING ({keys})"""


def sql_cigar(pairs: str, s: Scoring, min_score: int = 0, max_distance: int = 10**6) -> str:
    """Alignment with CIGAR: the tables of the aligned stretch are kept, a second recursion walks back through them."""
    n, gi, ge, mat = len(s.letters), s.gap_init, s.gap_extend, sql_matrix(s)
    head, tail = sql_align(pairs, s).rsplit(" SELECT ", 1)
    codes = lambda c: f"list_transform(string_split({c}, ''), lambda c: {sql_code('c', s)})"
    cell = lambda t, i, j: f"(CASE WHEN {i} >= 0 AND {j} >= 0 THEN {t}[{i} + 1][{j} + 1] ELSE 0 END)"
    return f"""{head}, found AS (SELECT {tail}),
al AS (SELECT pair_id, f.*, length(p.a) la, {codes("substr(p.a, a_begin + 1, a_end - a_begin + 1)")} x, {codes("substr(p.b, b_begin + 1, b_end - b_begin + 1)")} y
  FROM (SELECT * RENAME (pair_id AS pid) FROM found) f JOIN pairs p ON p.pair_id = f.pid
  WHERE score > 0 AND score >= {min_score} AND greatest(a_end - a_begin, b_end - b_begin) <= {max_distance}),
tb AS (
  SELECT pair_id, x, y, 0 i, list_transform(x, lambda v: 0) H, list_transform(x, lambda v: 0) E, []::INTEGER[][] HH, []::INTEGER[][] EE, []::INTEGER[][] FF FROM al
  UNION ALL
  SELECT pair_id, x, y, i, H, E, list_append(HH, H::INTEGER[]), list_append(EE, E::INTEGER[]), list_append(FF, G::INTEGER[]) FROM (
    SELECT *, list_transform(T, lambda v, j: greatest(v, G[j])) H FROM (
      SELECT *, list_transform(T, lambda v, j: {gi} + {ge} * j + list_max(list_prepend(0, list_transform(range(1, j), lambda k: T[k] - ({ge}) * k)))) G FROM (
        SELECT *, list_transform(E, lambda e, j: greatest(0, e, (CASE WHEN j = 1 THEN 0 ELSE H0[j - 1] END) + {mat}[(x[j] - 1) * {n} + y[i]])) T FROM (
          SELECT pair_id, x, y, i + 1 i, H H0, HH, EE, FF, list_transform(E, lambda e, j: greatest(H[j] + {gi} + {ge}, e + {ge})) E FROM tb WHERE i < len(y)))))),
tables AS (SELECT pair_id, x, y, HH, EE, FF FROM tb WHERE i = len(y)),
back AS (
  SELECT pair_id, x, y, HH, EE, FF, len(y) - 1 i, len(x) - 1 j, 'M' st, '' ops FROM tables
  UNION ALL
  SELECT pair_id, x, y, HH, EE, FF, CASE WHEN now = 'I' THEN i ELSE i - 1 END, CASE WHEN now = 'D' THEN j ELSE j - 1 END,
    CASE now WHEN 'M' THEN 'M'
      WHEN 'I' THEN (CASE WHEN {cell("HH", "i", "(j - 1)")} + {gi} + {ge} > (CASE WHEN j > 0 THEN FF[i + 1][j] + {ge} ELSE -1000000 END) THEN 'M' ELSE 'I' END)
      ELSE (CASE WHEN {cell("HH", "(i - 1)", "j")} + {gi} + {ge} > (CASE WHEN i > 0 THEN EE[i][j + 1] + {ge} ELSE -1000000 END) THEN 'M' ELSE 'D' END) END,
    (CASE now WHEN 'M' THEN (CASE WHEN x[j + 1] = y[i + 1] THEN '=' ELSE 'X' END) ELSE now END) || ops
  FROM (SELECT *, CASE WHEN st <> 'M' THEN st
      WHEN {cell("HH", "(i - 1)", "(j - 1)")} + {mat}[(x[j + 1] - 1) * {n} + y[i + 1]] >= greatest(EE[i + 1][j + 1], FF[i + 1][j + 1], 0) THEN 'M'
      WHEN FF[i + 1][j + 1] > EE[i + 1][j + 1] THEN 'I' ELSE 'D' END now
    FROM back WHERE i >= 0 AND j >= 0)),
spelt AS (SELECT pair_id, ops, array_to_string(list_transform(regexp_extract_all(ops, '=+|X+|I+|D+'), lambda r: length(r) || r[1]), '') core FROM back WHERE i < 0 OR j < 0)
SELECT found.*, (CASE WHEN a_begin > 0 THEN a_begin || 'S' ELSE '' END) || core || (CASE WHEN length(pairs.a) - a_end - 1 > 0 THEN (length(pairs.a) - a_end - 1) || 'S' ELSE '' END) cigar,
  coalesce(length(regexp_replace(ops, '=', '', 'g')), 0)::INTEGER mismatches
FROM found JOIN pairs USING (pair_id) LEFT JOIN spelt USING (pair_id)"""


# each part's name with the next part's, the two sides of a positional zip
PART_PAIRS = """pairs AS (SELECT x.p_partkey pair_id, x.p_name a, y.p_name b
  FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"""
NAME_PAIRS = """pairs AS (SELECT n_nationkey * 1000 + r_regionkey pair_id, n_name a, r_name b FROM nation, region)"""


# longer sides: names and types, some of A's own letters inside B
LONG_PAIRS = """pairs AS (SELECT x.p_partkey pair_id, x.p_name || ' ' || x.p_type a, y.p_type || y.p_name || ' ' || x.p_name || ' ' || y.p_type || y.p_name b
  FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"""


def long_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    x = p.select(F.col("p_partkey").alias("pair_id"), F.concat_ws(" ", "p_name", "p_type").alias("a"), F.col("p_name").alias("n"))
    y = p.select((F.col("p_partkey") - 1).alias("pair_id"), F.concat("p_type", "p_name").alias("y"))
    return x.join(y, "pair_id").select("pair_id", "a", F.concat_ws(" ", "y", "n", "y").alias("b"))


def part_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("a"))
    shifted = p.select((F.col("pair_id") - 1).alias("pair_id"), F.col("a").alias("b"))
    both = shifted.select("pair_id").join(p.select("pair_id"), "pair_id")
    return p.join(both, "pair_id", "left_semi"), shifted.join(both, "pair_id", "left_semi")


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pr.zip_pairs(*part_sides(spark, d), check=False)


def document_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents with the next one, nucleotide letters of the text only."""
    doc = read(spark, d, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("s"))
    a = doc.select(F.col("doc_id").alias("pair_id"), F.col("s").alias("a"))
    return a.join(doc.select((F.col("doc_id") - 1).alias("pair_id"), F.col("s").alias("b")), "pair_id")


NA = Scoring.named("na")
NA_OPEN3 = Scoring.open_extend("na", 3, 1)
AA50 = Scoring.open_extend("blosum50", 3, 1)
AA62 = Scoring.open_extend("blosum62", 3, 1)


# ------------------------------------------------------------------ alignment
@query(sql_align(PART_PAIRS, NA))
def align_zip_begin(spark, d):
    return al.align(part_pairs(spark, d), NA)


@query(sql_align(PART_PAIRS, NA, begin=False))
def align_forward_only(spark, d):
    return al.align(part_pairs(spark, d), NA, outputs=("score", "end"))


@query(sql_align(PART_PAIRS, NA_OPEN3))
def align_gap_open3(spark, d):
    return al.align(part_pairs(spark, d), NA_OPEN3)


@query(sql_align(PART_PAIRS, AA50))
def align_aa_blosum50(spark, d):
    return al.align(part_pairs(spark, d), AA50)


@query(sql_align(PART_PAIRS, AA62))
def align_aa_blosum62(spark, d):
    return al.align(part_pairs(spark, d), AA62)


@query(sql_align(PART_PAIRS, AA62, begin=False))
def align_sql_engine(spark, d):
    return al.Aligner(AA62, outputs=("score", "end"), engine="sql").align(part_pairs(spark, d))


@query()
def align_documents(spark, d):
    """Neighbouring documents, whole; dealt by cost."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return al.align(al.cost_balanced(document_pairs(spark, d), n), NA, outputs=("score", "end"), deal=False)


@query(sql_align("""pairs AS (SELECT x.p_partkey pair_id, x.p_name a, y.p_name b FROM part x JOIN part y ON y.p_partkey = x.p_partkey // 2)""", AA62))
def align_pair_list(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_name").alias("seq"))
    cmp = p.select(F.col("seq_id").alias("pair_id"), F.col("seq_id").alias("a_id"), F.floor(F.col("seq_id") / 2).cast("long").alias("b_id"))
    return al.align(pr.pair_list(p, cmp).drop("a_id", "b_id"), AA62)


@query(sql_align("""pairs AS (SELECT x.s_suppkey * 1000000 + y.s_suppkey pair_id, x.s_name a, y.s_name b FROM supplier x
  JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey > y.s_suppkey)""", AA62, begin=False))
def align_all_vs_all(spark, d):
    s = read(spark, d, "supplier").where("s_nationkey is not null")  # as in SQL, a supplier of no nation meets none
    pairs = al.align_within_blocks(s, F.col("s_nationkey"), AA62, "s_suppkey", "s_name", outputs=("score", "end"))
    return pairs.select((F.col("a_id") * 1000000 + F.col("b_id")).alias("pair_id"), "score", "a_end", "b_end")


@query(sql_align("pairs AS (SELECT p_partkey pair_id, p_name a, 'small hot widget gear' b FROM part)", AA62, begin=False))
def align_one_vs_many(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("pair_id"), "p_name")
    return al.align(pr.one_against_many("small hot widget gear", p, "p_name"), AA62, outputs=("score", "end"))


@query(sql_align(NAME_PAIRS, AA50))
def align_product(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    pairs = pr.product(n, r).select((F.col("n_nationkey") * 1000 + F.col("r_regionkey")).alias("pair_id"), F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    return al.align(pairs, AA50)


@query(sql_second(LONG_PAIRS, AA62))
def second_best(spark, d):
    return al.align(long_pairs(spark, d), AA62, outputs=("score", "end", "second"))


@query(sql_cigar(LONG_PAIRS, AA62))
def cigar(spark, d):
    return al.align(long_pairs(spark, d), AA62, outputs=("score", "end", "begin", "cigar"))


@query(sql_cigar(LONG_PAIRS, AA62, 60, 20))
def filtered_cigar(spark, d):
    return al.align(long_pairs(spark, d), AA62, outputs=("score", "end", "begin", "cigar"), min_score=60, max_distance=20)


@query(f"""SELECT count(*) cmps, sum((score >= 100)::INTEGER)::BIGINT AS "over", avg((score > 0)::INTEGER::DOUBLE) positive, sum((score >= 100)::INTEGER) = 0 AND avg((score > 0)::INTEGER) >= 0.5 ok
  FROM ({sql_align(PART_PAIRS, AA62, begin=False)})""")
def plausibility(spark, d):
    return al.plausible(al.align(part_pairs(spark, d), AA62, outputs=("score",)), 100)


@query(sql_align(PART_PAIRS, NA))
def stream_align(spark, d):
    """The part pairs as a stream of files, aligned micro-batch by micro-batch, joined to the end."""
    at = shared_dir(spark)
    part_pairs(spark, d).write.parquet(f"{at}/in")
    return stm.submit(stm.read_pairs(spark, f"{at}/in"), NA, f"{at}/out", f"{at}/state").join()


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1)::BIGINT ordinal FROM lineitem")
def ordinals(spark, d):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return pr.with_ordinal(read(spark, d, "lineitem").select(*key), key, "ordinal")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 seq_id, p_name seq FROM part")
def line_source(spark, d):
    """Part names written as a text file, one a line in key order, and read back by the line source."""
    at = shared_dir(spark)
    read(spark, d, "part").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").select("p_name").write.text(at)
    return src.read_lines(spark, at)


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 seq_id, '>' || p_partkey || ' ' || p_type AS description, regexp_replace(p_name, '\\s', '', 'g') AS sequence FROM part")
def fasta_source(spark, d):
    """Part names written as FASTA files in key order, and read back by the FASTA source."""
    at = shared_dir(spark)
    p = read(spark, d, "part").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey")
    p.select(F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit(" "), "p_type", F.lit("\n"), "p_name").alias("value")).write.text(at)
    return src.read_fasta(spark, at)


@query("SELECT sum(size_a * size_b)::BIGINT cells, count(*) cmps_processed, 2.0::DOUBLE outer_time_s, sum(size_a * size_b) / 2.0::DOUBLE / 1e9 outer_gcups FROM (SELECT length(p_name) size_a, length(p_type) size_b FROM part)")
def final_record(spark, d):
    return mt.final_record(sized(spark, d), 2.0)


@query("""WITH o AS (SELECT o_orderkey, (o_custkey + 1)::DOUBLE ci, (o_custkey + 1 + o_orderkey + 1)::DOUBLE co, o_totalprice cells, (o_orderkey + 5)::DOUBLE bytes, (2 * o_orderkey + 40)::DOUBLE size FROM orders)
SELECT o_orderkey, ci / 1e6 time_inner, co / 1e6 time_outer, 1.5::DOUBLE time_job, cells / (ci / 1e6) / 1e9 gcups_inner, cells / (co / 1e6) / 1e9 gcups_outer, cells / 1.5::DOUBLE / 1e9 gcups_job,
  cells / 2.5::DOUBLE / 1e9 gcups_batch, size transfer_size_total, round(co / 1e6 - ci / 1e6, 9) time_h2d, bytes / size * 100 transfer_ratio,
  round(size / (co / 1e6 - ci / 1e6) / 1e6, 6) transfer_bandwidth, round(size / (co / 1e6 - ci / 1e6) / 1e6 / 10, 6) transfer_bandwidth_per_vertex FROM o""")
def batch_measures(spark, d):
    inner, outer = F.col("o_custkey") + 1, F.col("o_custkey") + 1 + F.col("o_orderkey") + 1
    cols = mt.batch_record(F.col("o_totalprice"), F.col("o_orderkey") + 5, inner, outer, 1e6, F.lit(1.5), 10, F.lit(2.5), 2 * F.col("o_orderkey") + 40)
    out = read(spark, d, "orders").select("o_orderkey", *cols)
    for name, digits in (("time_h2d", 9), ("transfer_bandwidth", 6), ("transfer_bandwidth_per_vertex", 6)):
        out = out.withColumn(name, F.round(name, digits))
    return out


@query("""SELECT sum(length(p_name) * length(p_type))::BIGINT cells, count(*) cmps_processed, count(*) cmps_orig, (ceil(count(*) / 44.0::DOUBLE))::BIGINT batches_processed,
  (ceil(count(*) / 44.0::DOUBLE))::BIGINT batches_orig, 16::BIGINT measures, count(*) bucket_cmps FROM part""")
def run_records(spark, d):
    """A run over two files of part names and types; its log lines, read back."""
    at = shared_dir(spark)
    p = read(spark, d, "part").repartitionByRange(2, "p_partkey").sortWithinPartitions("p_partkey")
    p.select("p_name").write.text(f"{at}/a.txt")
    p.select("p_type").write.text(f"{at}/b.txt")
    rn.run_comparison(spark, f"{at}/b.txt", f"{at}/a.txt", SWConfig(), AlgoConfig(tilesUsed=10, maxBatches=5), out=f"{at}/run")
    logs = src.read_logs(spark, f"{at}/run/log")
    final = mt.tagged(logs, mt.TAG_RUN, "tag string, cells long, cmps_processed long, cmps_orig long, batches_processed long, batches_orig long").where("tag = 'final_log'")
    perf = mt.tagged(logs, mt.TAG_RUN, "tag string, " + ", ".join(f"{m} double" for m in mt.BATCH_METRICS)).where("tag = 'batch_perf'")
    whole = perf.agg(F.sum("cell_count").cast("long").alias("c"), sum((F.count(m) > 0).cast("long") for m in mt.BATCH_METRICS).alias("measures"))
    buckets = mt.tagged(logs, mt.TAG_RUN, "tag string, cmps long").where("tag = 'buckets'").agg(F.sum("cmps").alias("bucket_cmps"))
    return final.join(whole, F.col("c") == F.col("cells")).join(buckets).select(
        "cells", "cmps_processed", "cmps_orig", "batches_processed", "batches_orig", "measures", "bucket_cmps"
    )


# ------------------------------------------------------------------ encoding
def listed(codes):
    """An array as text, so both engines show it alike."""
    return F.array_join(codes.cast("array<string>"), ",")


def _sql_encode(letters: str, col: str) -> str:
    return f"array_to_string(list_transform(string_split({col}, ''), lambda c: CASE WHEN instr('{letters}', upper(c)) > 0 THEN instr('{letters}', upper(c)) - 1 ELSE {len(letters)} END), ',')"


@query(f"SELECT p_partkey, {_sql_encode(NA_LETTERS, 'p_name')} codes FROM part")
def encode_na(spark, d):
    return read(spark, d, "part").select("p_partkey", listed(Alphabet("na").encode_column(F.col("p_name"))).alias("codes"))


@query(f"SELECT p_partkey, {_sql_encode(AA_LETTERS, 'p_name')} codes FROM part")
def encode_aa(spark, d):
    return read(spark, d, "part").select("p_partkey", listed(Alphabet("aa").encode_column(F.col("p_name"))).alias("codes"))


@query(f"""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''),
  lambda c: CASE WHEN instr('{AA_LETTERS}', upper(c)) > 0 THEN upper(c) ELSE '?' END), '') letters FROM part""")
def decode_aa(spark, d):
    a = Alphabet("aa")
    codes = a.encode_column(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", F.translate(a.decode_column(codes), "\0", "?").alias("letters"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(upper(p_name), ''),
  lambda c: CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 WHEN 'U' THEN 0 ELSE 4 END), ',') codes FROM part""")
def base_translate(spark, d):
    return read(spark, d, "part").select("p_partkey", listed(translate_bases(F.col("p_name"))).alias("codes"))


@query(r"SELECT doc_id, regexp_replace(text, '\s', '', 'g') stripped, regexp_replace(text, '\s+$', '') trimmed FROM documents")
def strip_ws(spark, d):
    return read(spark, d, "documents").select("doc_id", strip_whitespace(F.col("text")).alias("stripped"), right_trim(F.col("text")).alias("trimmed"))


def _sql_matrix_rows(s: Scoring, **values) -> str:
    cells = sql_cells(s, **values)
    rows = ",".join(f"('{x}','{y}',{cells[i][j]})" for i, x in enumerate(s.letters) for j, y in enumerate(s.letters))
    return f"SELECT x, y, score::INTEGER score FROM (VALUES {rows}) t(x, y, score)"


@query(_sql_matrix_rows(Scoring.named("na"), match=2, mismatch=-3, ambiguity=-2))
def matrix_na_scaled(spark, d):
    return Scoring.named("na", match=2, mismatch=-3, ambiguity=-2).frame(spark)


@query(_sql_matrix_rows(AA50))
def matrix_blosum50(spark, d):
    return AA50.frame(spark)


@query(_sql_matrix_rows(AA62))
def matrix_blosum62(spark, d):
    return AA62.frame(spark)


@query(f"""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''),
  lambda c: array_to_string(list_slice({sql_matrix(AA62)}, ({sql_code('c', AA62)} - 1) * {len(AA_LETTERS)} + 1, {sql_code('c', AA62)} * {len(AA_LETTERS)}), ',')), ';') profile FROM part""")
def query_profile(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(AA62.profile_column(F.col("p_name")), listed), ";").alias("profile"))


@query("SELECT p_partkey, CASE WHEN substr(p_name, 1, 1) = substr(p_type, 1, 1) THEN 1 ELSE -1 END similarity FROM part")
def simple_char_similarity(spark, d):
    return read(spark, d, "part").select("p_partkey", simple_similarity(F.substring("p_name", 1, 1), F.substring("p_type", 1, 1)).alias("similarity"))


@query("SELECT l_orderkey, l_linenumber, (l_suppkey % 60000) | ((l_partkey % 30000) << 16) packed, l_suppkey % 60000 AS begin_pos, l_partkey % 30000 AS end_pos FROM lineitem")
def pack_unpack_range(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", al.pack_range(F.col("l_suppkey") % 60000, F.col("l_partkey") % 30000).alias("packed"))
    return x.withColumn("r", al.unpack_range(F.col("packed"))).select("l_orderkey", "l_linenumber", "packed", F.col("r.begin").alias("begin_pos"), F.col("r.end").alias("end_pos"))


_SQL_OP = "(CASE l_linenumber % 9 WHEN 0 THEN 'M' WHEN 1 THEN 'I' WHEN 2 THEN 'D' WHEN 3 THEN 'N' WHEN 4 THEN 'S' WHEN 5 THEN 'H' WHEN 6 THEN 'P' WHEN 7 THEN '=' ELSE 'X' END)"


@query(f"SELECT l_orderkey, l_linenumber, (l_partkey << 4) | (l_linenumber % 9) packed, {_SQL_OP} op, l_partkey len FROM lineitem")
def cigar_codec(spark, d):
    op = F.substring(F.lit(cg.OPS), (F.col("l_linenumber") % 9).cast("int") + F.lit(1), F.lit(1))
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cg.pack(F.col("l_partkey"), op).alias("packed"))
    return x.select("*", cg.op_of(F.col("packed")).alias("op"), cg.length_of(F.col("packed")).alias("len"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, concat(l_linenumber, 'S', l_partkey, '=', l_suppkey, 'X', l_linenumber, 'I', l_partkey, 'M', l_suppkey, 'D') cigar FROM lineitem)
SELECT l_orderkey, l_linenumber, cigar, list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[XID]', 1), lambda v: v::BIGINT))::BIGINT mismatches FROM c""")
def cigar_mismatches(spark, d):
    c = F.concat(*[F.concat(F.col(n).cast("string"), F.lit(o)) for n, o in (("l_linenumber", "S"), ("l_partkey", "="), ("l_suppkey", "X"), ("l_linenumber", "I"), ("l_partkey", "M"), ("l_suppkey", "D"))])
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("cigar")).withColumn("mismatches", cg.mismatches(F.col("cigar")))


# ------------------------------------------------------------------ packing
def sized(spark, d) -> DataFrame:
    """Part pairs with sizes, in units of forty: what one device batch packs."""
    p = read(spark, d, "part")
    return p.select(
        F.floor(F.col("p_partkey") / 40).cast("long").alias("unit"), F.col("p_partkey").alias("pair_id"), F.length("p_name").alias("size_a"),
        F.length("p_type").alias("size_b"), F.col("p_name").alias("a_id"), F.col("p_type").alias("b_id"),
    )


SIZED = """sized AS (SELECT p_partkey // 40 AS unit, p_partkey pair_id, length(p_name) size_a, length(p_type) size_b, p_name a_id, p_type b_id,
  row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) rn FROM part)"""
_CAPACITY, _CMPS, _BUCKETS = 42, 4, 20
_SIZES = "unit, pair_id, size_a::INTEGER size_a, size_b::INTEGER size_b"


@query(f"""WITH RECURSIVE {SIZED}, f AS (
  SELECT unit, pair_id, size_a, size_b, rn, 0 batch_id, 1 n, size_a + size_b total FROM sized WHERE rn = 1
  UNION ALL
  SELECT s.unit, s.pair_id, s.size_a, s.size_b, s.rn,
    CASE WHEN n + 1 < 8 AND total + s.size_a + s.size_b < 120 THEN batch_id ELSE batch_id + 1 END,
    CASE WHEN n + 1 < 8 AND total + s.size_a + s.size_b < 120 THEN n + 1 ELSE 1 END,
    CASE WHEN n + 1 < 8 AND total + s.size_a + s.size_b < 120 THEN total ELSE 0 END + s.size_a + s.size_b
  FROM f JOIN sized s ON s.unit = f.unit AND s.rn = f.rn + 1)
SELECT {_SIZES}, batch_id FROM f""")
def batches(spark, d):
    return pk.assign_batches(sized(spark, d), 8, 120, "unit")


@query(f"""WITH RECURSIVE {SIZED}, f AS (
  SELECT unit, pair_id, size_a, size_b, rn, 0 bucket, 0 slot, size_a + size_b total FROM sized WHERE rn = 1
  UNION ALL
  SELECT s.unit, s.pair_id, s.size_a, s.size_b, s.rn,
    CASE WHEN slot + 1 < 5 AND total + s.size_a + s.size_b <= 70 THEN bucket ELSE bucket + 1 END,
    CASE WHEN slot + 1 < 5 AND total + s.size_a + s.size_b <= 70 THEN slot + 1 ELSE 0 END,
    CASE WHEN slot + 1 < 5 AND total + s.size_a + s.size_b <= 70 THEN total ELSE 0 END + s.size_a + s.size_b
  FROM f JOIN sized s ON s.unit = f.unit AND s.rn = f.rn + 1)
SELECT {_SIZES}, bucket, slot FROM f""")
def bucket_fill_first(spark, d):
    return pk.assign_buckets(sized(spark, d), "fill_first", _BUCKETS, 5, 70, "unit")


def _sql_fold(first: str, step: str, order: str = "pair_id", own: str = "0") -> str:
    """A fold over a unit's pairs with lists of each bucket's comparisons and bytes; ``first``: buckets by preference.

    ``own``: bytes of the new pair that the bucket k holds already.
    """
    theirs = own
    for name in ("size_a", "size_b", "a_id", "b_id"):
        theirs = theirs.replace(name, f"o.{name}")
    room = f"c.cmps[k + 1] < {_CMPS} AND c.bytes[k + 1] + o.size_a + o.size_b - ({theirs}) <= {_CAPACITY}"
    return f"""WITH RECURSIVE {SIZED}, o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY {order}) r FROM sized),
f AS (
  SELECT unit, NULL::BIGINT pair_id, NULL::BIGINT size_a, NULL::BIGINT size_b, 0::BIGINT r, -1::BIGINT bucket, -1::BIGINT slot,
    list_transform(range({_BUCKETS}), lambda k: 0::BIGINT) cmps, list_transform(range({_BUCKETS}), lambda k: 0::BIGINT) bytes,
    list_transform(range({6 * _BUCKETS}), lambda k: 0::BIGINT) lanes, list_transform(range({_BUCKETS}), lambda k: []::VARCHAR[]) held
  FROM (SELECT DISTINCT unit FROM sized)
  UNION ALL
  SELECT unit, pair_id, size_a, size_b, r, to_b, cmps[to_b + 1],
    list_transform(cmps, lambda v, k: v + (k = to_b + 1)::BIGINT), list_transform(bytes, lambda v, k: v + (CASE WHEN k = to_b + 1 THEN add ELSE 0 END)),
    list_transform(lanes, lambda v, k: v + (CASE WHEN k = to_b * 6 + cmps[to_b + 1] % 6 + 1 THEN size_a * size_b ELSE 0 END)),
    list_transform(held, lambda v, k: CASE WHEN k = to_b + 1 THEN list_distinct(list_concat(v, [a_id, b_id])) ELSE v END)
  FROM (SELECT *, size_a + size_b - {own.replace("c.held[k + 1]", "held[to_b + 1]")} add FROM (
    SELECT o.unit, o.pair_id, o.size_a, o.size_b, o.r, o.a_id, o.b_id, c.cmps, c.bytes, c.lanes, c.held,
      list_filter({first}, lambda k: {room})[1] to_b
    FROM f c JOIN o ON o.unit = c.unit AND o.r = c.r + 1)))
SELECT {_SIZES}, bucket::INTEGER bucket, slot::INTEGER slot FROM f WHERE r > 0{step}"""


_AFTER = f"list_transform(range({_BUCKETS}), lambda s: (c.bucket + 1 + s) % {_BUCKETS})"
_STAY = f"list_transform(range({_BUCKETS}), lambda s: (greatest(c.bucket, 0) + s) % {_BUCKETS})"
_LIGHT = f"""list_transform(list_sort(list_transform(range({_BUCKETS}), lambda k: {{'least': list_min(c.lanes[k * 6 + 1:k * 6 + 6]), 'load': list_sum(c.lanes[k * 6 + 1:k * 6 + 6]), 'k': k}})), lambda v: v.k)"""
_OWN = "(CASE WHEN list_contains(c.held[k + 1], a_id) THEN size_a ELSE 0 END + CASE WHEN a_id = b_id OR list_contains(c.held[k + 1], b_id) THEN size_b ELSE 0 END)"


@query(_sql_fold(_AFTER, ""))
def bucket_round_robin(spark, d):
    return pk.assign_buckets(sized(spark, d), "round_robin", _BUCKETS, _CMPS, _CAPACITY, "unit")


@query(_sql_fold(_LIGHT, "", "size_a * size_b DESC, pair_id"))
def bucket_greedy(spark, d):
    return pk.assign_buckets(sized(spark, d), "greedy", _BUCKETS, _CMPS, _CAPACITY, "unit")


@query(_sql_fold(_STAY, "", own=_OWN))
def bucket_dedup(spark, d):
    return pk.assign_buckets(sized(spark, d), "fill_first", _BUCKETS, _CMPS, _CAPACITY, "unit", dedup=True).drop("a_id", "b_id")


@query(_sql_fold(_AFTER, "", own=_OWN))
def bucket_round_robin_dedup(spark, d):
    return pk.assign_buckets(sized(spark, d), "round_robin", _BUCKETS, _CMPS, _CAPACITY, "unit", dedup=True).drop("a_id", "b_id")


@query(_sql_fold(_LIGHT, "", "size_a * size_b DESC, pair_id", own=_OWN))
def bucket_greedy_dedup(spark, d):
    return pk.assign_buckets(sized(spark, d), "greedy", _BUCKETS, _CMPS, _CAPACITY, "unit", dedup=True).drop("a_id", "b_id")


@query(f"""WITH {SIZED}, o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY size_a * size_b DESC, pair_id) - 1 r FROM sized)
SELECT {_SIZES}, (CASE WHEN (r // 8) % 2 = 0 THEN r % 8 ELSE 7 - r % 8 END)::INTEGER bucket FROM o""")
def bucket_snake(spark, d):
    return pk.snake(sized(spark, d).drop("a_id", "b_id"), 8, "unit")


_SQL_RR = "rr AS (SELECT *, (rn - 1) % 3 bucket, (rn - 1) // 3 slot FROM sized)"


def _rr(spark, d):
    return pk.assign_buckets(sized(spark, d), "round_robin", 3, 10**5, 10**7, "unit")


@query(f"""WITH {SIZED}, {_SQL_RR}, l AS (SELECT unit, bucket, slot % 6 lane, sum(size_a * size_b) load, count(*) n, sum(size_a + size_b) bytes, max(size_a * size_b) top FROM rr GROUP BY ALL)
SELECT unit, bucket::INTEGER bucket, sum(n)::BIGINT cmps, sum(bytes)::BIGINT bytes, sum(load)::BIGINT sum_load, (CASE WHEN count(*) < 6 THEN 0 ELSE min(load) END)::BIGINT min_load,
  max(load)::BIGINT max_load, max(top)::BIGINT top_pair FROM l GROUP BY ALL""")
def bucket_stats(spark, d):
    return pk.bucket_stats(_rr(spark, d), ["unit", "bucket"])


@query(f"WITH {SIZED}, {_SQL_RR} SELECT cmps, count(*) buckets FROM (SELECT unit, bucket, count(*) cmps FROM rr GROUP BY ALL) GROUP BY cmps")
def bucket_histogram(spark, d):
    return pk.occupancy(_rr(spark, d), ["unit", "bucket"])


@query(f"""WITH {SIZED}, {_SQL_RR}, b AS (SELECT unit, bucket, count(*) n, sum(size_a + size_b) bytes FROM rr GROUP BY ALL), u AS (SELECT DISTINCT unit FROM rr)
SELECT unit, (5 - count(bucket))::BIGINT empty, coalesce(sum(n), 0)::BIGINT cmps, coalesce(sum(bytes), 0)::BIGINT bytes, max(bytes)::BIGINT largest, sum(n) / (5 * 20.0::DOUBLE) cmp_fill, sum(bytes) / (5 * 400.0::DOUBLE) byte_fill
FROM u JOIN b USING (unit) GROUP BY unit""")
def bucket_fill(spark, d):
    return pk.fill_ratios(_rr(spark, d), "unit", 5, 20, 400)


@query("SELECT p_partkey, (ceil(p_size / 50.0::DOUBLE * 4) - 1)::INTEGER size_class FROM part")
def size_class(spark, d):
    return read(spark, d, "part").select("p_partkey", pk.size_class(F.col("p_size"), 50, 4).alias("size_class"))


@query("SELECT o_orderkey, o_orderkey // 7 batch, o_orderkey % 7 slot FROM orders")
def slot_unpack(spark, d):
    return read(spark, d, "orders").select("o_orderkey", pk.unpack_slot(F.col("o_orderkey"), 7).alias("s")).select("o_orderkey", "s.*")


@query(f"""WITH {SIZED}, {_SQL_RR} SELECT {_SIZES}, bucket::INTEGER bucket, slot::INTEGER slot,
  coalesce(sum(size_a + size_b) OVER w, 0)::BIGINT off_a, (coalesce(sum(size_a + size_b) OVER w, 0) + size_a)::BIGINT off_b, (bucket * 500 + slot)::INTEGER result_place
FROM rr WINDOW w AS (PARTITION BY unit, bucket ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def arena_offsets(spark, d):
    return pk.arena_offsets(_rr(spark, d), ["unit", "bucket"], 500)


@query("SELECT o_orderkey % 6 worker, count(*) cmps, sum(o_orderkey)::BIGINT id_sum FROM orders GROUP BY 1")
def stride_workers(spark, d):
    return read(spark, d, "orders").groupBy(pk.stripe(F.col("o_orderkey"), 6).alias("worker")).agg(F.count("*").alias("cmps"), F.sum("o_orderkey").alias("id_sum"))


@query("SELECT p_partkey, copy::INTEGER copy FROM part, range(3) t(copy)")
def duplicate_dataset(spark, d):
    return pr.duplicated(read(spark, d, "part").select("p_partkey"), 3)


# ------------------------------------------------------------------ measures and logs
@query("SELECT sum(length(p_name) * length(p_type))::BIGINT cells, sum(length(p_name) + length(p_type))::BIGINT bytes FROM part")
def cells_total(spark, d):
    return read(spark, d, "part").agg(mt.cells("p_name", "p_type").alias("cells"), mt.data_bytes("p_name", "p_type").alias("bytes"))


@query("SELECT p_brand, sum(length(p_name) * length(p_type)) / 2.0::DOUBLE / 1e9 gcups FROM part GROUP BY 1")
def gcups_fixed_time(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(mt.gcups(mt.cells("p_name", "p_type"), F.lit(2.0)).alias("gcups"))


@query(f"SELECT max(score) max_score, count(*) cmps FROM ({sql_align(PART_PAIRS, AA62, begin=False)})")
def score_summary(spark, d):
    return al.align(part_pairs(spark, d), AA62, outputs=("score",)).agg(F.max("score").alias("max_score"), F.count("*").alias("cmps"))


@query(f"SELECT pair_id, score FROM ({sql_align(PART_PAIRS, AA62, begin=False)}) ORDER BY score DESC, pair_id LIMIT 10")
def top_pairs(spark, d):
    return al.align(part_pairs(spark, d), AA62, outputs=("score",)).orderBy(F.desc("score"), "pair_id").limit(10)


def run_logs(spark, d) -> DataFrame:
    """Events as run logs: one run a user, a batch record an event, with setup and final lines."""
    e = read(spark, d, "events")
    run = F.concat(F.lit("run"), F.col("user_id").cast("string"), F.lit(".log"))
    batch = e.select(run.alias("file"), mt.log_line(mt.TAG_RUN, F.lit("batch_perf").alias("tag"), F.col("value").alias("time_inner"), F.get_json_object("props", "$.k").cast("long").alias("cell_count")).alias("value"))
    users = e.groupBy("user_id").agg(F.count("*").alias("n"))
    setup = users.select(run.alias("file"), mt.log_line(mt.TAG_RUN, F.lit("run_comparison_setup").alias("tag"), (F.col("user_id") % 8).alias("devices")).alias("value"))
    final = users.where("user_id % 3 <> 0").select(run.alias("file"), mt.log_line(mt.TAG_RUN, F.lit("final_log").alias("tag"), F.col("n").alias("batches_processed")).alias("value"))
    noise = users.select(run.alias("file"), F.lit("INFO nothing to see").alias("value"))
    return batch.union(setup).union(final).union(noise)


_LOG = "tag string, time_inner double, cell_count long, devices long, batches_processed long"
_STATS = ", ".join(
    f"{f} {m}_{n}" for m in ("time_inner", "cell_count")
    for n, f in (("median", f"median({m}::DOUBLE)"), ("max", f"max({m})::DOUBLE"), ("min", f"min({m})::DOUBLE"))
)


@query(f"""WITH r AS (SELECT concat('run', user_id, '.log') file, user_id, value time_inner, json_extract(props, '$.k')::BIGINT cell_count FROM events)
SELECT file, {_STATS}, round(avg(time_inner), 6) time_inner_average, round(sum(time_inner), 4) time_inner_sum, avg(cell_count) cell_count_average, sum(cell_count)::DOUBLE cell_count_sum,
  any_value(user_id % 8) devices, count(*) final_batches_processed FROM r WHERE user_id % 3 <> 0 GROUP BY file""")
def log_rollup(spark, d):
    log = mt.tagged(run_logs(spark, d), mt.TAG_RUN, _LOG)
    out = mt.with_setup(log, "file", ["time_inner", "cell_count"], {"devices": F.col("devices")}, ["batches_processed"])
    return out.withColumn("time_inner_average", F.round("time_inner_average", 6)).withColumn("time_inner_sum", F.round("time_inner_sum", 4))


@query("""SELECT s_suppkey, (s_suppkey % 96 + 1)::INTEGER threads, concat('dna_', s_nationkey) dataset, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END numa FROM supplier""")
def cpu_log_parse(spark, d):
    s = read(spark, d, "supplier")
    name = F.format_string("cpu%d_dna_%d_numa%s.log", F.col("s_suppkey") % 96 + 1, F.col("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, "0-1").otherwise("1"))
    return s.select("s_suppkey", *mt.cpu_run_fields(name))


@query("SELECT sum((o_orderstatus = 'F')::INTEGER)::BIGINT failures, count(*) runs FROM orders")
def failure_count(spark, d):
    return read(spark, d, "orders").agg(mt.failures(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("failures"), F.count("*").alias("runs"))


@query("SELECT o_orderkey, (o_custkey << 32) | o_orderkey cycles FROM orders")
def cycle_count(spark, d):
    return read(spark, d, "orders").select("o_orderkey", mt.cycles(F.col("o_orderkey"), F.col("o_custkey")).alias("cycles"))


# ------------------------------------------------------------------ sources
@query(r"""SELECT p_partkey // 40 AS unit, '> ' || p_partkey AS description, regexp_replace(p_name || p_type, '\s', '', 'g') AS sequence FROM part""")
def fasta_parse(spark, d):
    """Part names written as FASTA texts of forty records, then parsed back."""
    p = read(spark, d, "part")
    rec = F.concat(F.lit("> "), F.col("p_partkey").cast("string"), F.lit(" \n"), F.col("p_name"), F.lit("\n"), F.col("p_type"))
    text = p.groupBy(F.floor(F.col("p_partkey") / 40).cast("long").alias("unit")).agg(F.array_join(F.array_sort(F.collect_list(rec)), "\n").alias("t"))
    return text.select("unit", F.explode(src.fasta_records(F.col("t"))).alias("r")).select("unit", "r.*")


@query("SELECT p_partkey seq_id, p_name seq FROM part WHERE p_partkey % 2 = 1")
def even_line_filter(spark, d):
    return src.even_lines(read(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_name").alias("seq")))
