"""Sequence sources and sinks: one sequence a line, FASTA, and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alignforge.operators.pairing import numbered
from alignforge.plans.session import saved


def _positioned(df: DataFrame) -> DataFrame:
    """Rows with file name, start of their block in it, and a number that rises along the block."""
    return df.withColumn("file", F.input_file_name()).withColumn("block_start", F.input_file_block_start()).withColumn("m", F.monotonically_increasing_id())


def _in_file_order(rows: DataFrame) -> DataFrame:
    """``rows`` with seq_id: numbers from 0 by file name and place in the file.

    One task reads a block from its start to its end, so counting rows by block gives every row its
    number without a shuffle. The rows are written once: a second scan may deal blocks to tasks anew.
    """
    return numbered(saved(rows), ["file", "block_start"], "m", "seq_id")


def read_lines(spark: SparkSession, path: str | list[str], count: int = 0) -> DataFrame:
    """(seq_id, seq): one sequence a line, as it is, empty lines kept; ``count``: only the first so many (0: all).

    A missing file is Spark's path error. ``.gz`` files and several parts read as they are.
    """
    out = _in_file_order(_positioned(spark.read.text(path))).select("seq_id", F.col("value").alias("seq"))
    return out.where(F.col("seq_id") < count) if count else out


def fasta_record(record: Column) -> Column:
    """struct<description, sequence> of one record's text (with or without its leading >)."""
    text = F.regexp_replace(record, r"^>", "")
    head = F.regexp_replace(F.regexp_extract(text, r"^([^\n]*)", 1), r"\s+$", "")
    body = F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s", "")
    return F.struct(F.concat(F.lit(">"), head).alias("description"), body.alias("sequence"))


def fasta_records(text: Column) -> Column:
    """array<struct<description, sequence>> of a whole FASTA text; what stands before the first > is left out."""
    parts = F.split(F.concat(F.lit("\n"), text), "\n>")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), fasta_record)


def read_fasta(spark: SparkSession, path: str | list[str], count: int = 0) -> DataFrame:
    """(seq_id, description, sequence). Records are split by the reader, so a file is read in parallel."""
    raw = _positioned(spark.read.option("lineSep", "\n>").text(path))
    # the first record of a file keeps its >; text in front of it is no record
    lead = (F.col("block_start") == 0) & (F.col("m") == F.col("lowest")) & ~F.col("value").startswith(">")
    raw = saved(raw)
    lowest = raw.groupBy("file", "block_start").agg(F.min("m").alias("lowest"))
    rows = raw.join(F.broadcast(lowest), ["file", "block_start"]).withColumn("junk", lead)
    out = numbered(rows.where("not junk"), ["file", "block_start"], "m", "seq_id")
    out = out.select("seq_id", fasta_record(F.col("value")).alias("r")).select("seq_id", "r.*")
    return out.where(F.col("seq_id") < count) if count else out


def first_record(spark: SparkSession, path: str) -> DataFrame:
    """The first record of a file; nothing is numbered or shuffled, the scan stops with the first block."""
    head = spark.read.option("lineSep", "\n>").text(path).withColumn("start", F.input_file_block_start()).where("start = 0")
    # text in front of the first > is no record
    head = head.limit(2).withColumn("m", F.monotonically_increasing_id()).where((F.col("m") > 0) | F.col("value").startswith(">"))
    return head.orderBy("m").limit(1).select(F.lit(0).cast("long").alias("seq_id"), fasta_record(F.col("value")).alias("r")).select("seq_id", "r.*")


def load(spark: SparkSession, path: str, count: int = 0) -> DataFrame:
    """(seq_id, seq) by file name: ``.txt`` (also .txt.gz) lines, else FASTA."""
    if path.removesuffix(".gz").endswith(".txt"):
        return read_lines(spark, path, count)
    return read_fasta(spark, path, count).select("seq_id", F.col("sequence").alias("seq"))


def even_lines(lines: DataFrame, seq_id: str = "seq_id") -> DataFrame:
    """Two-line FASTA to plain sequences: every second line."""
    return lines.where(F.pmod(F.col(seq_id), F.lit(2)) == 1)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): lines of a folder of logs, one file a run."""
    return spark.read.text(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def write_results(aligned: DataFrame, path: str, kind: str = "parquet") -> None:
    aligned.write.mode("overwrite").option("header", True).format(kind).save(path)


def write_log(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def merge_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Repetitions' tables as one, each with its head line left out."""
    return spark.read.option("header", True).csv(paths)


def prefixed(table: DataFrame, **fixed) -> DataFrame:
    """A table with constant columns in front."""
    return table.select(*[F.lit(v).alias(k) for k, v in fixed.items()], "*")
