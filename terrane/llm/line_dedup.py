"""Line dedup: drop lines that many documents share, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm._common import key_of, load, lower_ascii, table

BLANKS = " \t\n\x0b\x0c\r"
ADDED = ("n_lines", "n_dropped", "kept_text")


def _hash(key: Column) -> Column:
    """96 bits, so that no two keys of a corpus are likely to meet."""
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key, F.lit(17)).alias("h2"))


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with doc_id, text -> the same rows and columns plus n_lines, n_dropped, kept_text.

    A line's key is the line without blanks at both ends and with A-Z lower-cased. Keys of min_chars code
    points or more in min_docs distinct documents or more lose all lines, except those of the largest
    doc_id that holds the key. A null or empty text is one empty line. Rows with one doc_id count as one
    document and are treated alike; rows without doc_id count as one document with the smallest id. An
    empty table gives an empty result. Columns of docs are kept, whatever their names; the three added ones
    replace namesakes.

    The shuffle carries 96-bit hashes and places instead of lines; a text is put together from the runs between
    its dropped places, in time proportional to its lines; the keys over the threshold are written as a table,
    so that the join with it is a broadcast where its size is small and a splittable shuffle join elsewhere.
    """
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in ADDED]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    whole = docs.select(key_of("doc_id").alias("i"), F.xxhash64(text("text")).alias("t"), F.struct(*own).alias("row"))
    lines = whole.select("i", "t", F.posexplode(F.split(lower_ascii(text("row.text")), "\n")).alias("pos", "line"))
    keys = lines.select("i", "t", "pos", F.btrim("line", F.lit(BLANKS)).alias("k")).filter(F.length("k") >= min_chars)
    keys = keys.select("i", "t", "pos", _hash(F.col("k")).alias("h")).select("i", "t", "pos", "h.h1", "h.h2")
    shared = keys.groupBy("h1", "h2").agg(F.count_distinct("i").alias("n"), F.max("i").alias("keep")).filter(F.col("n") >= min_docs)
    shared = table(shared.select("h1", "h2", "keep"), "shared-lines")
    drops = keys.join(shared, ["h1", "h2"]).filter("i != keep").groupBy("i", "t").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    raw = F.split(text("row.text"), "\n")
    # runs of lines between dropped places, put together again
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(raw)))
    run = lambda j: F.slice(raw, F.get(edges, j) + 2, F.get(edges, j + 1) - F.get(edges, j) - 1)
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), run)), "\n")
    out = whole.join(drops, ["i", "t"], "left").select(
        "row", F.size(raw).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), text("row.text")).otherwise(kept).alias("kept_text"),
    )
    return out.select("row.*", *ADDED)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = drop_shared_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT a.doc_id, a.pos, a.line, s.k IS NOT NULL AND a.doc_id <> s.keep AS gone
  FROM keyed a LEFT JOIN shared s ON a.k = s.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
