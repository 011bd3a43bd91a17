"""Sparse lexical vectors: vocabulary, weights, search. Vectors are rows (id, term, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.text import content_tokens, tokens


def token_counts(texts: DataFrame) -> DataFrame:
    """(id, text) -> id, term, n."""
    return texts.select("id", F.explode(content_tokens("text")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


def document_frequency(texts: DataFrame) -> DataFrame:
    """Texts that hold each term."""
    return texts.select(F.explode(F.array_distinct(content_tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(texts: DataFrame, size: int = 384, least: int = 2, share: float = 0.15) -> DataFrame:
    """term, df, idf of the best-ranked terms (X7, X8); ties by code point.

    The number of texts joins as one row, so the plan needs no driver round trip; the cut is a top-k.
    """
    n = texts.agg(F.count("*").alias("n"))
    df = document_frequency(texts).crossJoin(F.broadcast(n)).filter((F.col("df") >= least) & (F.col("df") <= share * F.col("n")))
    rank = F.col("df") * F.pow(F.log(F.col("n") / F.col("df")), 2)
    best = df.orderBy(F.round(rank, 9).desc(), "term").limit(size)
    return best.select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, text) -> id, term, w at length one (X9, X10, X11). vocab has `size` rows at most, so it is broadcast."""
    found = texts.select("id", F.explode(tokens("text")).alias("term")).join(F.broadcast(vocab.select("term", "idf")), "term")
    raw = found.groupBy("id", "term").agg(((1 + F.log(F.count("*"))) * F.first("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.withColumn("w", F.col("w") / length)


def similarities(queries: DataFrame, vecs: DataFrame) -> DataFrame:
    """Dot products of sparse query and document vectors: q, id, score. Few queries: their rows are small, and so broadcast.

    Vectors stay where they are: dealt by id, the products of a text are summed without another exchange.
    """
    q = queries.select(F.col("id").alias("q"), "term", F.col("w").alias("qw"))
    return vecs.join(F.broadcast(q), "term").groupBy("q", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))


def composite(works: DataFrame, vecs: DataFrame, cutoff: int, parts: int | None = None) -> DataFrame:
    """(person, id, year) and work vectors -> person, term, w: recent works count twice, length one.

    A vector is one row until it is with its people, who are dealt to `parts` tasks where that is given: terms are summed
    and lengths taken there.
    """
    weight = F.when(F.coalesce("year", F.lit(0)) >= cutoff, 2.0).otherwise(1.0)
    whole = vecs.groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("vec"))
    of = works.select("person", "id", weight.alias("k")).join(whole, "id").select("person", "k", "vec")
    of = of.repartition(parts, "person") if parts else of
    s = of.select("person", "k", F.inline("vec")).groupBy("person", "term").agg(F.sum(F.col("w") * F.col("k")).alias("w"))
    return s.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("person"))))


def best_first(scores: DataFrame, by: list[str], order: list, k: int = 1) -> DataFrame:
    """The k best rows per key; ties go to the order's later columns, never to chance (V4)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return scores.withColumn("_rank", rank).filter(F.col("_rank") <= k).withColumnRenamed("_rank", "rank")
