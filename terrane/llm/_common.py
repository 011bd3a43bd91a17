"""What the operators share: scratch tables, null-safe keys, connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources.scratch import drop_table, table

__all__ = ["NO_ID", "components", "drop_table", "key_of", "load", "lower_ascii", "release", "table", "union_all"]

#: Stands for a null integer id in keys; it sorts before every other id.
NO_ID = -(2**63)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def key_of(col: Column | str) -> Column:
    """An integer id that is never null, for joins and groups."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NO_ID))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone. lower() does just that on ASCII texts, many times faster than translate()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id in edges(a, b): columns id, component_id.

    Alternates large-star and small-star steps until the edges are a forest of stars. Every step is an
    aggregation with map-side combine and an equi-join whose sides are both read from tables, so that the
    adaptive planner can split a hub's rows. The ids may have any type that Spark orders.
    """
    e = table(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        # large star: every larger neighbour points to the least of the neighbourhood
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "large")
        large = table(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        # small star: smaller neighbours and the node itself point to the least
        low = table(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        moved = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = table(moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        for t in (e, least, large, low):
            drop_table(t)
        e = small
        if (now["n"], now["s"]) == state:
            break
        state = (now["n"], now["s"])
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return table(e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionAll(roots), "components")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)
