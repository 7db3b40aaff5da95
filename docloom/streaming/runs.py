"""Running a stream over what is there now, into a table of the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from docloom.session import shared_dir


def stream(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """A given table as a stream of its files, with the table's own schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{folder}/{name}.parquet*")


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Take in everything available and return what came out; exactly once by the checkpoint."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def drain_batches(df: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    """Take in everything available, micro-batch by micro-batch."""
    at = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex[:12]}"
    df.writeStream.foreachBatch(each).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


class Upserts:
    """An append-only table in which the first row of a key stays: insert-or-ignore for micro-batches."""

    def __init__(self, spark: SparkSession, schema: StructType, keys: list[str], order: str) -> None:
        self.spark, self.schema, self.keys, self.order = spark, schema, keys, order
        self.path = f"{shared_dir(spark)}/upserts-{uuid.uuid4().hex[:12]}"
        self.done: list[int] = []

    def table(self) -> DataFrame:
        if not self.done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/batch={i}" for i in self.done))

    def add(self, batch: DataFrame, number: int) -> None:
        """New keys of a batch; a batch that is delivered again replaces itself."""
        from docloom.operators.store import first_wins

        self.done = [i for i in self.done if i != number]
        fresh = first_wins(batch, self.keys, self.order).select(*[f.name for f in self.schema.fields])
        fresh.join(self.table().select(*self.keys), self.keys, "left_anti").write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        self.done.append(number)
