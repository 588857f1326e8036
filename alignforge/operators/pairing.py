"""Pairing operators: which sequences meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alignforge.plans.session import saved


def with_ordinal(df: DataFrame, order_by: list[str], name: str = "pair_id") -> DataFrame:
    """Consecutive numbers from 0 in the order of ``order_by``, without a single-task sort.

    Rows are range-partitioned, sorted and written once with their partition and place in it;
    partitions are counted on the written rows, so the numbers hold however later plans read them.
    """
    keyed = df.repartitionByRange(*[F.col(c) for c in order_by]).sortWithinPartitions(*order_by)
    place = F.monotonically_increasing_id()
    keyed = saved(keyed.withColumn("__part", F.shiftright(place, 33)).withColumn("__place", place.bitwiseAND(F.lit((1 << 33) - 1))))
    return numbered(keyed, ["__part"], "__place", name).drop("__part", "__place")


def numbered(written: DataFrame, run: list[str], place: str, name: str) -> DataFrame:
    """``name`` = rows of all runs before + place in the own run - the run's first place.

    A run is a partition, file block or the like: its rows have consecutive places. Only one row a
    run is sorted and sent to all tasks. ``written`` must be a stored table (it is read twice).
    """
    runs = written.groupBy(*run).agg(F.count("*").alias("__n"), F.min(place).alias("__first"))
    before = Window.orderBy(*run).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).drop("__n", "__first")
    return written.join(F.broadcast(runs), run).withColumn(name, F.col("__start") + F.col(place)).drop("__start").select(
        *[c for c in written.columns], name
    )


def zip_pairs(left: DataFrame, right: DataFrame, key: str = "pair_id", a: str = "a", b: str = "b", check: bool = True) -> DataFrame:
    """A[i] with B[i] by ordinal: an equi-join. Unequal counts raise."""
    if check:
        n, m = left.count(), right.count()
        if n != m:
            raise ValueError(f"sequence sets differ in size: {n} and {m}")
    return left.select(key, F.col(a).alias("a")).join(right.select(key, F.col(b).alias("b")), key)


def pair_list(sequences: DataFrame, comparisons: DataFrame, seq_id: str = "seq_id", seq: str = "seq") -> DataFrame:
    """Explicit (cmp_id, a_id, b_id) over one sequence table: two equi-joins, sequences reused."""
    sa = sequences.select(F.col(seq_id).alias("a_id"), F.col(seq).alias("a"))
    sb = sequences.select(F.col(seq_id).alias("b_id"), F.col(seq).alias("b"))
    return comparisons.join(sa, "a_id").join(sb, "b_id")


def units_of_blocks(sequences: DataFrame, block: Column, seq_id: str = "seq_id", seq: str = "seq", most: int = 512) -> DataFrame:
    """(block, id, seq, mine, p, q): sequences by the units (block, p, q) they meet others in.

    A block of more than ``most`` sequences is cut into pieces by a hash of the id, and every two
    pieces meet in a unit of their own: no task holds a large block, whatever one key's share is.
    """
    s = sequences.select(block.alias("block"), F.col(seq_id).alias("id"), F.col(seq).alias("seq"))
    pieces = s.groupBy(F.col("block").alias("of")).agg(F.ceil(F.count("*") / most).cast("int").alias("n"))
    s = s.join(pieces, F.col("block").eqNullSafe(F.col("of"))).select("block", "id", "seq", "n", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("mine"))
    s = s.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return s.select("block", "id", "seq", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))


def within_blocks(sequences: DataFrame, block: Column, seq_id: str = "seq_id", seq: str = "seq", most: int = 512) -> DataFrame:
    """All pairs i > j inside each block, made in the units of :func:`units_of_blocks`."""
    s = units_of_blocks(sequences, block, seq_id, seq, most)
    x, y = s.alias("x"), s.alias("y")
    # the two sides are of different pieces, or the unit is one piece with itself
    here = F.col("x.block").eqNullSafe(F.col("y.block")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q"))
    apart = (F.col("x.p") == F.col("x.q")) | (F.col("x.mine") != F.col("y.mine"))
    pairs = x.join(y, here & apart & (F.col("x.id") > F.col("y.id")))
    return pairs.select(F.col("x.block").alias("block"), F.col("x.id").alias("a_id"), F.col("x.seq").alias("a"), F.col("y.id").alias("b_id"), F.col("y.seq").alias("b"))


def one_against_many(reference: str, queries: DataFrame, seq: str = "seq") -> DataFrame:
    """One preset B against many A: a constant column, no join. Empty sides are left out."""
    return queries.where(F.length(seq) > 0).select("*", F.lit(reference).alias("b")).withColumnRenamed(seq, "a").where(F.length("b") > 0)


def product(left: DataFrame, right: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """A x B as a pair list; the right side, whose rows and bytes are checked, goes to all tasks."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in right.dtypes), F.lit(0))
    n, size = right.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    if n > max_rows or size > max_bytes:
        raise ValueError(f"right side has over {max_rows} rows or {max_bytes} bytes; pair by blocks instead")
    return left.join(F.broadcast(right), F.lit(True))


def duplicated(pairs: DataFrame, factor: int) -> DataFrame:
    """Each row ``factor`` times, numbered by ``copy``."""
    return pairs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
