"""Tables that a stream writes batch by batch, each batch once however often it is given.

A batch has a folder of its own in each table, which is written anew when the batch is repeated, and one mark for all
tables when it is done. Readers see marked batches only, so what a stopped batch left behind is never read, and a batch
that has its mark is not worked on again. Batches come in order of their numbers, as Structured Streaming gives them, and
one stream writes a store; so the last mark says everything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = "marks"


def missing(error: AnalysisException) -> bool:
    """Whether the error says that a path isn't there, or has no files."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


@dataclass(frozen=True)
class BatchStore:
    path: str

    def last(self, spark: SparkSession) -> int:
        """The number of the last batch that is done; -1 before the first."""
        try:
            return spark.read.parquet(f"{self.path}/{MARKS}").agg(F.max("batch")).first()[0]
        except AnalysisException as e:
            if not missing(e):
                raise
            return -1

    def write(self, df: DataFrame, table: str, number: int) -> DataFrame:
        """Writes a batch's rows of a table, in place of what an earlier try has left, and reads them again."""
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={number}")
        return self.batch(df.sparkSession, table, number)

    def batch(self, spark: SparkSession, table: str, number: int) -> DataFrame:
        """The rows of one batch; no other is looked at."""
        return spark.read.parquet(f"{self.path}/{table}/batch={number}")

    def done(self, spark: SparkSession, number: int) -> None:
        spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{self.path}/{MARKS}/batch={number}")

    def read(self, spark: SparkSession, table: str, last: int | None = None) -> DataFrame:
        """A table's rows of all batches that are done, with their batch."""
        last = self.last(spark) if last is None else last
        return spark.read.parquet(f"{self.path}/{table}").where(F.col("batch") <= last)

    def once(self, work: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: the work, unless the batch is done, and then its mark."""

        def run(batch: DataFrame, number: int) -> None:
            if number > self.last(batch.sparkSession):
                work(batch, number)
                self.done(batch.sparkSession, number)

        return run


def append_once(store: BatchStore, table: str = "rows") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every batch's rows, once."""
    return store.once(lambda batch, number: store.write(batch, table, number))


@dataclass(frozen=True)
class Upsert:
    """For foreachBatch in update mode: the newest row of each key. A batch joins its rows to the last version and writes the
    next one. Versions take turns in three folders, so that the last one and its reader aren't disturbed."""

    path: str
    key: str

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, store = batch.sparkSession, BatchStore(self.path)

        def work(batch: DataFrame, number: int) -> None:
            rows, last = batch, store.last(spark)
            if last >= 0:
                old = store.batch(spark, "version", last % 3)
                rows = old.join(batch.select(self.key), self.key, "left_anti").unionByName(batch)
            store.write(rows, "version", number % 3)

        store.once(work)(batch, number)

    def read(self, spark: SparkSession) -> DataFrame:
        store = BatchStore(self.path)
        return store.batch(spark, "version", store.last(spark) % 3)


@dataclass(frozen=True)
class FirstOf:
    """For foreachBatch: the first row of each key, whatever the time between repeats. Keys that were seen are stored in
    ranges of `span`; a batch is held against those ranges only that it has keys in, so with numbers that go up the work of
    a batch stays the same, and the stream needs state for repeats within its own delay at most."""

    path: str
    key: str = "loop_num"
    span: int = 1 << 20

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, store = batch.sparkSession, BatchStore(self.path)

        def work(batch: DataFrame, number: int) -> None:
            last = store.last(spark)
            rows = batch.dropDuplicates([self.key]).withColumn("range", F.floor(F.col(self.key) / self.span))
            if last >= 0:
                # the ranges of the batch prune the stored keys before they are read
                ranges = rows.select("range").distinct()
                kinds = f"`{self.key}` {rows.schema[self.key].dataType.simpleString()}, batch long, range long"
                seen = spark.read.schema(kinds).parquet(f"{self.path}/keys").where(F.col("batch") <= last).join(F.broadcast(ranges), "range", "left_semi")
                rows = rows.join(seen.select(self.key), self.key, "left_anti")
            kept = store.write(rows, "rows", number)
            kept.select(self.key, "range").write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/keys/batch={number}")

        store.once(work)(batch, number)

    def read(self, spark: SparkSession) -> DataFrame:
        return BatchStore(self.path).read(spark, "rows").drop("range", "batch")
