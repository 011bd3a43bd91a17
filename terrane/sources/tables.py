"""Reading, writing and caching, and the mapping of the driver's tables to the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

AS_OF, CUTOFF = 2001, 1998


def read_json(spark: SparkSession, path: str, schema: StructType, lines: bool = False) -> DataFrame:
    """Whole-file JSON documents, or files of one document a line as write_json() makes them."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Overwrite; the commit protocol makes it atomic (S7, S8). Doubles are rounded to eight places."""
    rounded = [F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*rounded).write.mode("overwrite").json(path)


def cache_key(*parts) -> F.Column:
    """Name of a cached result."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def uncached(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts whose hash is not in the cache."""
    return texts.join(cache.select("hash"), "hash", "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sizes between which a table in few files is dealt out anew: less is one task's work, more is left to the scan.
SPREAD_FROM, SPREAD_TO = 4 << 20, 1 << 30

#: Bytes of a stored table that a task gets where rows are dealt by a key: tasks grow in number, not in size.
SHARE = 8 << 20


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a scan would leave cores idle: fewer files than cores, of a size checked in the plan's statistics."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if SPREAD_FROM <= _size(df) <= SPREAD_TO and len(df.inputFiles()) < cores else df


def shares(stored: DataFrame) -> int:
    """Partitions for rows of a whole stored table that are dealt by a key. A number that is given is not made less by the planner."""
    size = _size(stored)
    return max(-(-size // SHARE), stored.sparkSession.sparkContext.defaultParallelism if size >= SPREAD_FROM else 1)


def texts(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", dealt: bool = False) -> DataFrame:
    """id, text. Dealt by id, what is made of a text meets its like without another exchange."""
    stored = table(spark, sf_dir, name)
    rows = stored.select(F.col(key).alias("id"), "text")
    return rows.repartition(shares(stored), "id") if dealt else spread(rows)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work"), F.year("o_orderdate").alias("year"))


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work, author, pos (from 1), n_authors: distinct parts of an order, by their first line. Dealt by work."""
    stored = table(spark, sf_dir, "lineitem")
    dealt = stored.select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("author"), "l_linenumber").repartition(shares(stored), "work")
    li = dealt.groupBy("work", "author").agg(F.min("l_linenumber").alias("line"))
    w = Window.partitionBy("work")
    return li.select("work", "author", F.row_number().over(w.orderBy("line", "author")).alias("pos"), F.count("*").over(w).alias("n_authors"))


def authorship_shares(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for rows of authorship(), wherever they are dealt by another key."""
    return shares(table(spark, sf_dir, "lineitem"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("author"), F.col("p_name").alias("name"))
