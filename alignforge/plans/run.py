"""A whole run: load, batch, pack, align, and leave results and log records.

Pairs are numbered by position. Batches are one fold on lengths over all pairs, done in blocks of
BLOCK_PAIRS pairs side by side, each from the batch left open before it; buckets are folds within a
batch. A batch is a unit of work: its pairs are dealt together and aligned in one task.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignforge.operators import metrics as mt
from alignforge.operators import packing as pk
from alignforge.operators.align import align, align_sql
from alignforge.operators.pairing import duplicated, zip_pairs
from alignforge.plans.config import FILL, AlgoConfig, RunConfig, SWConfig
from alignforge.plans.session import saved, shared_dir
from alignforge.sources.sequences import load, write_log, write_results

BLOCK_PAIRS = 100_000
#: cycles of a record are seconds at this nominal rate
CLOCK_HZ = 1e9


def checked(pairs: DataFrame, algo: AlgoConfig, check_b: bool = True) -> DataFrame:
    """``pairs`` whose sides fit the configuration; a longer one is an error (B may be let through)."""
    too_long = F.length("a") > algo.maxAB
    if check_b:
        too_long = too_long | (F.length("b") > algo.bufsize)
    message = F.concat(F.lit("pair "), F.col("pair_id").cast("string"), F.lit(" has a sequence longer than the configuration allows"))
    return pairs.withColumn("a", F.when(too_long, F.raise_error(message)).otherwise(F.col("a")))


def planned(pairs: DataFrame, algo: AlgoConfig) -> DataFrame:
    """(batch, bucket, slot, pair_id, size_a, size_b) of every pair."""
    sizes = pairs.select("pair_id", F.length("a").alias("size_a"), F.length("b").alias("size_b"))
    batches = pk.assign_run_batches(sizes, *algo.batch_limits(), BLOCK_PAIRS).withColumn("batch", F.col("batch").cast("string"))
    return pk.assign_buckets(batches, FILL[algo.fillAlgo], algo.tilesUsed, algo.maxBatches, algo.bufsize, "batch")


def run_comparison(
    spark: SparkSession, reference: str, query: str, sw: SWConfig, algo: AlgoConfig, run: RunConfig | None = None, out: str | None = None,
    check_b: bool = True,
) -> dict:
    """Align two files by position: results in ``out``/results, records in ``out``/log; returns the final record."""
    run, out = run or RunConfig(), out or shared_dir(spark)
    a = load(spark, query).select(F.col("seq_id").alias("pair_id"), F.col("seq").alias("a"))
    b = load(spark, reference).select(F.col("seq_id").alias("pair_id"), F.col("seq").alias("b"))
    pairs = saved(checked(zip_pairs(a, b), algo, check_b))
    plan = saved(planned(pairs, algo))
    original = plan.agg(F.count("*"), F.countDistinct("batch")).first()
    work = pairs.join(plan.select("pair_id", "batch", "bucket", "slot"), "pair_id")
    if run.copies() > 1:
        work = duplicated(work, run.copies()).withColumn("batch", F.format_string("%s/%d", "batch", "copy")).drop("copy")
    outputs = ("score", "end", "time") if algo.forwardOnly else ("score", "end", "begin", "time")
    work = work.withColumn("size_a", F.length("a")).withColumn("size_b", F.length("b")).repartition("batch").sortWithinPartitions("batch", "bucket", "slot")
    began = time.perf_counter()
    if algo.engine == "sql":  # no begins, and no seconds of its own: the batch records have none either
        aligned = align_sql(work, sw.scoring()).withColumn("kernel_s", F.lit(0.0)).withColumn("task_s", F.lit(0.0))
    else:
        aligned = align(work, sw.scoring(), outputs=outputs, deal=False)
    write_results(aligned, f"{out}/results")
    seconds = time.perf_counter() - began
    done = spark.read.parquet(f"{out}/results")
    final = final_record(done, seconds, run.copies(), *original)
    config = {"config": asdict(run) | {"sw": asdict(sw), "algo": asdict(algo)}, "ref_path": reference, "query_path": query, "duplicationFactor": run.copies()}
    write_log(records(done, plan, algo, config, final), f"{out}/log")
    return final


def final_record(done: DataFrame, seconds: float, copies: int, pairs: int, batches: int) -> dict:
    r = done.agg(mt.cells_of("size_a", "size_b").alias("cells"), F.count("*").alias("n"), F.countDistinct("batch").alias("b"), F.max("score").alias("m")).first()
    return {
        "tag": "final_log", "cells": r["cells"], "outer_time_s": seconds, "outer_gcups": r["cells"] / seconds / 1e9, "cmps_processed": r["n"],
        "cmps_submitted": pairs * copies, "cmps_orig": pairs, "batches_processed": r["b"], "batches_submitted": batches * copies, "batches_orig": batches,
        "max_score": r["m"],
    }


def batch_records(done: DataFrame, algo: AlgoConfig) -> DataFrame:
    """The measures of every batch."""
    per = done.groupBy("batch").agg(
        mt.cells_of("size_a", "size_b").alias("cell_count"), F.sum(F.col("size_a") + F.col("size_b")).alias("data_count"),
        F.sum("kernel_s").alias("k"), F.sum("task_s").alias("t"),
    )
    cycle = lambda c: (F.col(c) * CLOCK_HZ).cast("long")
    size = F.lit(4 * algo.input_words())
    return per.select(
        "batch", cycle("k").alias("cycle_inner"), cycle("t").alias("cycle_outer"), "cell_count", "data_count",
        *mt.batch_record(F.col("cell_count"), F.col("data_count"), cycle("k"), cycle("t"), CLOCK_HZ, F.col("t"), algo.tilesUsed, F.col("t"), size),
    )


def records(done: DataFrame, plan: DataFrame, algo: AlgoConfig, config: dict, final: dict) -> DataFrame:
    """The run's log lines: setup, a record a batch, bucket statistics, and the final record."""
    spark = done.sparkSession
    one = lambda d: spark.range(1).select(F.lit(mt.TAG_RUN + json.dumps(d)).alias("value"))
    perf = batch_records(done, algo)
    perf = perf.select(mt.log_line(mt.TAG_RUN, F.lit("batch_perf").alias("tag"), *[F.col(c) for c in perf.columns]).alias("value"))
    buckets = pk.bucket_stats(plan, ["batch", "bucket"])
    buckets = buckets.select(mt.log_line(mt.TAG_RUN, F.lit("buckets").alias("tag"), *[F.col(c) for c in buckets.columns]).alias("value"))
    return one({"tag": "run_comparison_setup"} | config).union(perf).union(buckets).union(one(final))
