"""Several tables of a stream under one commit.

A micro-batch writes its part of every table first and its manifest last; readers take batches with a manifest only, so the parts of a
batch appear together or not at all. A batch that is committed is not written again, one that is not is overwritten.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MANIFEST = "batch_id long, facts map<string,double>"
#: Parts that the keys of a table are filed under; a batch reads the parts of its own keys.
KEY_PARTS = 64


class BatchLog:
    """Tables below ``path`` with one manifest for each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        first = spark.createDataFrame([(-1, {})], MANIFEST)
        first.coalesce(1).write.mode("ignore").json(f"{self.path}/_commits/of=-1")

    def facts(self) -> DataFrame:
        """(batch_id, facts) of the committed batches."""
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/_commits/*").where("batch_id >= 0")

    def is_committed(self, batch_id: int) -> bool:
        return not self.facts().where(F.col("batch_id") == batch_id).isEmpty()

    def commit(self, batch_id: int, tables: Mapping[str, DataFrame], keys: Mapping[str, str] | None = None, **facts: tuple[str, Column]) -> None:
        """Writes ``tables``, then the manifest with ``facts`` (aggregates of a written table). ``keys`` names tables whose key is filed for ``unseen``."""
        if self.is_committed(batch_id):
            return
        written = {}
        for name, rows in tables.items():
            target = f"{self.path}/{name}/batch_id={batch_id}"
            rows.write.mode("overwrite").parquet(target)
            written[name] = self.spark.read.schema(rows.schema).parquet(target)
        for name, key in (keys or {}).items():
            filed = written[name].select(F.xxhash64(key).alias("key_hash"), F.col(key).cast("string").alias("key"), F.lit(batch_id).cast("long").alias("batch"))
            filed.withColumn("key_part", F.pmod("key_hash", F.lit(KEY_PARTS))).repartition("key_part").write.mode("overwrite").partitionBy("key_part").parquet(
                f"{self.path}/{name}__keys/of={batch_id}")
        found = {fact: written[name].agg(what.cast("double").alias("v")).first().v for fact, (name, what) in facts.items()}
        row = self.spark.createDataFrame([(batch_id, {k: v for k, v in found.items() if v is not None})], MANIFEST)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/_commits/of={batch_id}")

    def table(self, name: str) -> DataFrame:
        """The rows of committed batches, with their ``batch_id``."""
        stored = self.spark.read.parquet(f"{self.path}/{name}").withColumn("batch_id", F.col("batch_id").cast("long"))
        return stored.join(self.facts().select("batch_id"), "batch_id", "left_semi")

    def unseen(self, rows: DataFrame, name: str, key: str) -> DataFrame:
        """One row for each key of ``rows`` that no committed batch of the table holds."""
        once = rows.dropDuplicates([key]).withColumns({"_hash": F.xxhash64(key), "_part": F.pmod(F.xxhash64(key), F.lit(KEY_PARTS)).cast("int")})
        if self.facts().isEmpty():
            return once.select(*rows.columns)
        filed = self.spark.read.parquet(f"{self.path}/{name}__keys").join(self.facts().select(F.col("batch_id").alias("batch")), "batch", "left_semi")
        filed = filed.select(F.col("key_part").alias("_part"), F.col("key_hash").alias("_hash"), F.col("key").alias("_key"))
        return once.withColumn("_key", F.col(key).cast("string")).join(filed, ["_part", "_hash", "_key"], "left_anti").select(*rows.columns)


class _Batches(DataSourceStreamReader):
    """Offsets are batch numbers; a trigger takes all batches that were committed since the last one, each of them whole."""

    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def _listed(self, folder: str, pattern: str) -> list[str]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if re.match(r"\w+:", folder) else (fs.LocalFileSystem(), folder)
        return [f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if re.search(pattern, f.path)]

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        found = self._listed(f"{self.path}/_commits", r"/of=-?\d+/part-[^/]*json$")
        return {"batch": max([int(re.search(r"/of=(-?\d+)/", f).group(1)) for f in found], default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        wanted = range(int(start["batch"]) + 1, int(end["batch"]) + 1)
        return [InputPartition(f) for b in wanted for f in sorted(self._listed(f"{self.path}/{self.table}/batch_id={b}", r"/part-[^/]*parquet$"))]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files = fs.FileSystem.from_uri(self.path)[0] if re.match(r"\w+:", self.path) else fs.LocalFileSystem()
        with files.open_input_file(partition.value) as file:
            yield from pq.ParquetFile(file).iter_batches(batch_size=10_000)

    def commit(self, end: dict) -> None:
        pass


class CommittedBatches(DataSource):
    """A stream over the committed batches of one table of a ``BatchLog`` (options ``path``, ``table``, and ``ddl`` for its columns)."""

    @classmethod
    def name(cls) -> str:
        return "committed_batches"

    def schema(self) -> str:
        return self.options["ddl"]

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Batches(self.options["path"].rstrip("/"), self.options["table"])


def batch_stream(log: BatchLog, table: str, ddl: str) -> DataFrame:
    """The rows of committed batches as a stream, in the order of the batches."""
    log.spark.dataSource.register(CommittedBatches)
    return log.spark.readStream.format("committed_batches").option("path", log.path).option("table", table).option("ddl", ddl).load()


def store_flows_and_events(log: BatchLog, events_of: Callable[[DataFrame], DataFrame]) -> Callable:
    """A ``foreachBatch`` writer of closed flows and the events made of them; flows seen before change nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if log.is_committed(batch_id):
            return
        fresh = log.unseen(batch, "flows", "flow_id")
        log.commit(batch_id, {"flows": fresh, "events": events_of(fresh)}, {"flows": "flow_id"}, flows=("flows", F.count("*")), events=("events", F.count("*")))

    return write
