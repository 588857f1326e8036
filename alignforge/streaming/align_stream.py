"""Alignment over Structured Streaming: stateless, so a stream is the batch operator on every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from alignforge.functions.scoring import Scoring
from alignforge.operators.align import align


def read_pairs(spark: SparkSession, path: str, schema: str = "pair_id long, a string, b string", max_files: int = 8) -> DataFrame:
    """Pairs from Parquet files as they come; ``max_files`` a trigger bounds what is under way."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def align_stream(pairs: DataFrame, scoring: Scoring, **how) -> DataFrame:
    return align(pairs, scoring, **how)


def start(aligned: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write aligned rows to Parquet, once each: the checkpoint knows what is done."""
    w = aligned.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


class Job:
    """A submitted run: ``join`` waits for it and gives the results."""

    def __init__(self, query: StreamingQuery, out: str, spark: SparkSession):
        self.query, self.out, self.spark = query, out, spark

    def join(self) -> DataFrame:
        self.query.awaitTermination()
        return self.spark.read.parquet(self.out)


def submit(pairs: DataFrame, scoring: Scoring, out: str, checkpoint: str, **how) -> Job:
    return Job(start(align_stream(pairs, scoring, **how), out, checkpoint), out, pairs.sparkSession)
