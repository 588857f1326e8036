"""Workload measures and the roll-up of run logs."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG_RUN, TAG_CPU = "ALIGNLOG", "CPUJSONLOG"
# The measures of a batch record, by the names logs use.
BATCH_METRICS = [
    "cycle_inner", "cycle_outer", "cell_count", "data_count", "time_inner", "time_outer", "time_job", "gcups_inner", "gcups_outer",
    "gcups_job", "gcups_batch", "transfer_size_total", "time_h2d", "transfer_ratio", "transfer_bandwidth", "transfer_bandwidth_per_vertex",
]


def cells(a: str = "a", b: str = "b") -> Column:
    """Sum of |a| * |b|."""
    return F.coalesce(F.sum(F.length(a).cast("long") * F.length(b)), F.lit(0))


def cells_of(size_a: str, size_b: str) -> Column:
    """Sum of the products of two lengths."""
    return F.coalesce(F.sum(F.col(size_a).cast("long") * F.col(size_b)), F.lit(0))


def data_bytes(a: str = "a", b: str = "b") -> Column:
    return F.coalesce(F.sum(F.length(a).cast("long") + F.length(b)), F.lit(0))


def gcups(cell_count: Column, seconds: Column) -> Column:
    """Null where no time has passed."""
    return F.try_divide(cell_count.cast("double"), seconds.cast("double")) / 1e9


def batch_record(
    cell_count: Column, data_count: Column, cycle_inner: Column, cycle_outer: Column, clock_hz: float, time_job: Column, vertices: int,
    time_batch: Column | None = None, transfer_size: Column | None = None,
) -> list[Column]:
    """The measures of one batch beside its counts; ``transfer_size``: bytes of its input buffer (default: its data)."""
    inner, outer = cycle_inner / clock_hz, cycle_outer / clock_hz
    h2d, size = outer - inner, data_count if transfer_size is None else transfer_size
    per = F.try_divide
    rate = per(size.cast("double"), h2d) / 1e6
    return [
        inner.alias("time_inner"), outer.alias("time_outer"), time_job.alias("time_job"), gcups(cell_count, inner).alias("gcups_inner"),
        gcups(cell_count, outer).alias("gcups_outer"), gcups(cell_count, time_job).alias("gcups_job"),
        gcups(cell_count, time_job if time_batch is None else time_batch).alias("gcups_batch"), size.cast("double").alias("transfer_size_total"),
        h2d.alias("time_h2d"), (per(data_count.cast("double"), size) * 100).alias("transfer_ratio"), rate.alias("transfer_bandwidth"),
        (rate / vertices).alias("transfer_bandwidth_per_vertex"),
    ]


def final_record(aligned: DataFrame, seconds: float) -> DataFrame:
    """cells, comparisons, seconds and GCUPS of a finished run over (size_a, size_b)."""
    return aligned.agg(F.sum(F.col("size_a").cast("long") * F.col("size_b")).alias("cells"), F.count("*").alias("cmps_processed")).select(
        "cells", "cmps_processed", F.lit(seconds).alias("outer_time_s"), gcups(F.col("cells"), F.lit(seconds)).alias("outer_gcups")
    )


def tagged(lines: DataFrame, tag: str, schema: str, line: str = "value") -> DataFrame:
    """Lines that hold ``tag``, their JSON (all after it) as columns beside the others."""
    at = F.instr(F.col(line), tag)
    body = F.substring(F.col(line), at + F.lit(len(tag)), F.length(line))
    keep = [c for c in lines.columns if c != line]
    return lines.where(at > 0).select(*keep, F.from_json(F.trim(body), schema).alias("j")).select(*keep, "j.*")


def rollup(records: DataFrame, run: str, metrics: list[str]) -> DataFrame:
    """Per run and metric: median, average, max, min, sum, as columns ``metric_stat``."""
    return records.groupBy(run).agg(*[f(F.col(m).cast("double")).alias(f"{m}_{n}") for m in metrics for n, f in STATS.items()])


STATS = {"median": lambda c: F.percentile(c, 0.5), "average": F.avg, "max": F.max, "min": F.min, "sum": F.sum}


def with_setup(log: DataFrame, run: str, metrics: list[str], setup: dict, final: list[str]) -> DataFrame:
    """Per run of parsed log lines (with their ``tag``): statistics of its batch records, setup fields, ``final_`` columns.

    One pass over the lines: each aggregate sees the lines of its tag only. Runs without a final record go.
    """
    of = lambda tag, c: F.when(F.col("tag") == tag, c)
    one = lambda tag, c: F.first(of(tag, c), ignorenulls=True)
    rolled = log.groupBy(run).agg(
        *[f(of("batch_perf", F.col(m).cast("double"))).alias(f"{m}_{n}") for m in metrics for n, f in STATS.items()],
        *[one("run_comparison_setup", c).alias(name) for name, c in setup.items()],
        *[one("final_log", F.col(c)).alias(f"final_{c}") for c in final],
        F.sum(of("final_log", F.lit(1))).alias("__final"), F.sum(of("run_comparison_setup", F.lit(1))).alias("__setup"), F.sum(of("batch_perf", F.lit(1))).alias("__batches"),
    )
    return rolled.where("__final > 0 and __setup > 0 and __batches > 0").drop("__final", "__setup", "__batches")


def roll_up_folder(logs: DataFrame, kind: str) -> DataFrame:
    """Roll-up of (file, value) log lines by kind of run: ``cpu`` rows as they are, else batch statistics with setup."""
    if kind == "cpu":
        rows = tagged(logs, TAG_CPU, "time_outer_s double, time_inner_s double, gcups_outer double, gcups_inner double, cells double")
        return rows.select("*", *cpu_run_fields(F.col("file")))
    final = "cells long, outer_time_s double, outer_gcups double, cmps_processed long, cmps_submitted long, cmps_orig long, batches_processed long, batches_submitted long, batches_orig long"
    config = "config struct<numDevices int, numThreads int, duplicateDatasets boolean, algo struct<useRemoteBuffer boolean, fillAlgo string>>"
    log = tagged(logs, TAG_RUN, f"tag string, {config}, {final}, " + ", ".join(f"{m} double" for m in BATCH_METRICS))
    fields = run_fields(F.col("file"), F.col("config"))
    return with_setup(log, "file", BATCH_METRICS, fields, [f.split()[0] for f in final.split(", ")])


def run_fields(name: Column, config: Column) -> dict[str, Column]:
    """Data set (the middle of the log's name) and configuration of a run."""
    parts = F.split(name, "_")
    return {
        "dataset": F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 4, F.lit(0))), "_"), "numDevices": config["numDevices"],
        "numThreads": config["numThreads"], "duplication": F.when(config["duplicateDatasets"], "dup").otherwise("nodup"),
        "remote": F.when(config["algo"]["useRemoteBuffer"], "remote").otherwise("stream"), "fillAlgo": config["algo"]["fillAlgo"],
    }


def slowest_worker(times: DataFrame, worker: str, seconds: str) -> DataFrame:
    """A run takes as long as its slowest worker: the most seconds any of them summed up."""
    return times.groupBy(worker).agg(F.sum(seconds).alias("s")).agg(F.max("s").alias("time_inner_s"))


def cpu_run_fields(name: Column) -> list[Column]:
    """threads, dataset and numa nodes of a log name ``<aligner><T>_<dataset>_numa<N>.log`` (0-1: two nodes)."""
    rx = r"[a-z]+(\d+)_(.+)_numa([0-9-]+)\.log$"
    numa = F.regexp_extract(name, rx, 3)
    return [
        F.regexp_extract(name, rx, 1).cast("int").alias("threads"), F.regexp_extract(name, rx, 2).alias("dataset"),
        F.when(numa == "0-1", 2).otherwise(1).alias("numa"),
    ]


def log_line(tag: str, *fields: Column) -> Column:
    """A tagged JSON log line."""
    return F.concat(F.lit(tag), F.to_json(F.struct(*fields)))


def failures(return_code: Column) -> Column:
    return F.sum((return_code != 0).cast("int"))


def cycles(low: Column, high: Column) -> Column:
    """A 64-bit count from two 32-bit halves."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def hexadecimal(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lower(F.hex(v))), " ")


class Timer:
    """tick, tock, and accumulated seconds."""

    def __init__(self):
        self.start = self.end = time.perf_counter()
        self.total = 0.0

    def tick(self) -> None:
        self.start = time.perf_counter()

    def tock(self) -> float:
        self.end = time.perf_counter()
        self.total += self.end - self.start
        return self.end - self.start

    def add(self, seconds: float) -> None:
        self.total += seconds

    @staticmethod
    def profile(fn) -> tuple[object, float]:
        t = Timer()
        t.tick()
        return fn(), t.tock()
