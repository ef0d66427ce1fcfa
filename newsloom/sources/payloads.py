"""A Python data source that reads folders of saved payloads, one partition per file."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, number: int, path: str) -> None:
        super().__init__(number)
        self.number, self.path = number, path


class _Reader(DataSourceReader):
    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern

    def partitions(self) -> list[InputPartition]:
        return [_File(k, str(p)) for k, p in enumerate(sorted(Path(self.path).glob(self.pattern)))]

    def read(self, partition: _File) -> Iterator[tuple[int, str, str]]:
        yield partition.number, partition.path, Path(partition.path).read_text(errors="replace")


class PayloadSource(DataSource):
    """``spark.read.format("payloads").option("pattern", "*.xml").load(folder)``: (id, path, payload)."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "id long, path string, payload string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("pattern", "*"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PayloadSource)
