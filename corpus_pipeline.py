"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm._common import NO_ID, load, table
from terrane.llm.line_dedup import drop_shared_lines
from terrane.llm.minhash import mark_near_duplicates
from terrane.llm.mixing import mix_sources
from terrane.llm.packing import pack
from terrane.llm.quality import judge

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The stages after quality rules have no SQL form (near duplicates, seeded choices, tokenizers).
ORACLE_SQL = None


def _named(docs: DataFrame) -> DataFrame:
    """The documents and their key _k: the id, or for rows without one a number far below all ids, made of their values.

    So documents without ids are judged each by itself, and only equal ones are one document.
    """
    own = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text", "lang", "source"), 2)
    return docs.select(*COLUMNS, F.coalesce("doc_id", own).alias("_k"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows with one id go or stay together: all must be kept."""
    named = _named(docs)
    verdict = judge(named.withColumn("doc_id", F.col("_k")))
    gone = verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("_k")).distinct()
    return named.join(table(gone, "rejected"), "_k", "left_anti").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that many share; documents of no other lines go."""
    out = drop_shared_lines(docs.select(*COLUMNS))
    out = out.filter((F.col("n_dropped") == 0) | (F.col("kept_text") != ""))
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (80 percent of shingles), that of the smallest id; of repeated rows, one."""
    named = _named(docs)
    marked = mark_near_duplicates(named.select(F.col("_k").alias("doc_id"), "text"), percent=80)
    gone = marked.filter(~F.col("kept")).select(F.col("doc_id").alias("_k")).distinct()
    left = named.join(table(gone, "copies"), "_k", "left_anti").withColumn("_t", F.xxhash64("text"))
    return left.dropDuplicates(["_k", "_t"]).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    named = _named(docs)
    copies = mix_sources(named.select(F.col("_k").alias("doc_id"), "text", "source")).select(F.col("doc_id").alias("_k"), "copies")
    copies = copies.groupBy("_k").agg(F.max("copies").alias("copies")).filter("copies > 0")
    out = named.join(table(copies, "taken"), "_k")
    return out.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1,024 tokens."""
    return pack(docs.select("doc_id", "text", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again as the next one's input."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
