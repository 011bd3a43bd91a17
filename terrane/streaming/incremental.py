"""Incremental ingestion: pages that land as files, or arrive from a stream, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from terrane.operators.ingest import last_wins


def upsert(stream: DataFrame, target: str, state: str, key: str, seq: list[str]) -> StreamingQuery:
    """Streaming query that writes to `target`/batch=N the last row of each key in batch N (I8).

    A batch costs what it brings, not what has come so far; current() merges the batches. Batches are named by
    their number, so one that is repeated after a failure writes the same folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        last_wins(batch, key, seq).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def follow(spark: SparkSession, landing: str, schema: StructType, target: str, state: str, key: str, seq: list[str]) -> StreamingQuery:
    """upsert() of JSON files that land in a folder."""
    return upsert(spark.readStream.schema(schema).json(landing), target, state, key, seq)


def current(spark: SparkSession, schema: StructType, target: str, key: str, seq: list[str]) -> DataFrame:
    """The last row of each key over all batches; of equal sequences, that of the later batch."""
    wide = StructType([*schema.fields]).add("batch", "long")
    return last_wins(spark.read.schema(wide).parquet(target), key, [*seq, "batch"]).drop("batch")


def compact(spark: SparkSession, schema: StructType, target: str, compacted: str, key: str, seq: list[str]) -> int:
    """Write current() to `compacted`/batch=N, N the last batch it holds: a new target, to which later batches are written.

    Run it between batches; the old folder may go once readers have moved. Returns N, -1 for an empty target.
    """
    wide = StructType([*schema.fields]).add("batch", "long")
    rows = spark.read.schema(wide).parquet(target)
    number = rows.agg(F.max("batch")).first()[0]
    if number is None:
        return -1
    last_wins(rows, key, [*seq, "batch"]).drop("batch").write.mode("overwrite").parquet(f"{compacted}/batch={number}")
    return number
