"""``spark.read.format("fasta")``: FASTA as a Python data source (one file, one partition)."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from alignforge.plans.session import ship


class FastaDataSource(DataSource):
    """Options: path (a local or mounted file). Prefer ``read_fasta``, which reads any store in parallel."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "seq_id long, description string, sequence string"

    def reader(self, schema) -> "FastaReader":
        return FastaReader(self.options["path"])


class FastaReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        head, body, n = None, [], 0
        with open(partition.value) as f:
            for line in f:
                if line.startswith(">"):
                    if head is not None:
                        yield n, head, "".join(body)
                        n += 1
                    head, body = line.rstrip(), []
                elif head is not None:
                    body.append("".join(line.split()))
        if head is not None:
            yield n, head, "".join(body)


def register(spark) -> None:
    ship(spark)
    spark.dataSource.register(FastaDataSource)
