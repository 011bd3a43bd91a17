"""Embedding near-dedup: collision counting over many one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm._common import components, key_of, load, table

#: Projections whose windows are counted, and the window's half width in units of the largest distance.
PROJECTIONS, WINDOW = 24, 1.5
#: Wanted chance that a pair at the threshold is met in a table, and that it passes the count.
TABLE_RECALL, COUNT_RECALL = 0.999, 0.999
#: Wanted vectors in a bucket, most tables, most rows in a block of a bucket.
BUCKET, TABLES, BLOCK = 512, 96, 1024


def least_count(m: int = PROJECTIONS, window: float = WINDOW, recall: float = COUNT_RECALL) -> int:
    """Largest count that a pair at the threshold distance reaches with chance `recall`.

    The difference of two points on a Gaussian direction is normal with their distance as deviation, so it
    lies in the window with chance erf(window / sqrt 2), in each projection by itself.
    """
    p, tail = math.erf(window / math.sqrt(2)), 0.0
    for count in range(m, -1, -1):
        tail += math.comb(m, count) * p**count * (1 - p) ** (m - count)
        if tail >= recall:
            return count
    return 0


def plan_tables(largest: int, cosine: float) -> tuple[int, int]:
    """Signs per table and number of tables for a label of `largest` vectors."""
    signs = max(0, math.ceil(math.log2(max(1, largest) / BUCKET)))
    same = 1 - math.acos(cosine) / math.pi
    while signs and math.log(1 - TABLE_RECALL) / math.log(1 - same**signs) > TABLES:
        signs -= 1
    return signs, 1 if not signs else math.ceil(math.log(1 - TABLE_RECALL) / math.log(1 - same**signs))


def _kind(vectors: DataFrame) -> str:
    """The components' type: what is read as single precision travels so, and loses nothing."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def _units(vecs: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, in double precision, at length one."""
    x = np.stack([np.frombuffer(v, dtype=kind) for v in vecs]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _named(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, label, vec (the components as bytes, of their own width), of vectors that can link."""
    kind = _kind(vectors)
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("label", T.StringType()), T.StructField("vec", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = [], []
            for i, x in enumerate(batch.column("embedding")):
                x = x.as_py()
                if not x or any(v is None for v in x):
                    continue
                v = np.array(x, dtype=np.float64)
                if not np.isfinite(v).all() or not v.any():
                    continue
                ids.append(i)
                vecs.append((v + 0.0).astype(kind).tobytes())
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(vecs, pa.binary())], names=schema.names)

    wanted = vectors.filter(F.col("label").isNotNull()).select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    # vectors of different length never meet
    return wanted.withColumn("label", F.concat_ws(":", F.size("embedding"), "label")).mapInArrow(run, schema)


def link_vectors(vectors: DataFrame, cosine: float = 0.93, seed: int = 3) -> DataFrame:
    """vectors with vec_id, embedding, label -> vec_id, n_links, component_id.

    Vectors of one label are linked at a cosine (in double precision) of `cosine` or more. Null and zero
    vectors, those with null or non-finite components and those without label are linked with nothing;
    vectors of different lengths never are. Rows that repeat a vec_id count as vectors of their own with one
    id. A null id is reported null. An empty table gives an empty result.

    Equal vectors of a label are one class. Vectors of a label meet in tables, each by the signs of a few
    random projections; the number of signs grows with the largest label, the number of tables follows from
    the wanted recall at the threshold. In a bucket the vectors are sorted along each of 24 further
    projections; a pair's count is the number of projections in which one lies in the window around the
    other, and pairs that reach the calibrated count are verified. A pair counts in the first table in which
    it meets, so no pair leaves its block: only link counts and a spanning forest of each block do. Buckets
    above 1,024 vectors are met block by block. A vector travels once for each table and block, in the width in
    which it was read. Other columns are not read.
    """
    kind = _kind(vectors)
    width = int(kind[-1])
    named = _named(vectors.select(key_of("vec_id").alias("vec_id"), "embedding", "label"))
    named = table(named, "vectors")
    classes = named.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = table(classes, "classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    signs, tables = plan_tables(largest, cosine)
    needed, radius = least_count(), math.sqrt(2 - 2 * cosine) * WINDOW

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, tables), dtype=np.int64)
            vecs = batch.column("vec").to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vecs):
                by_size.setdefault(len(v) // width, []).append(i)
            for size, rows in by_size.items():
                if size not in planes:
                    planes[size] = np.random.Generator(np.random.PCG64([seed, size])).standard_normal((size, signs * tables))
                side = _units([vecs[i] for i in rows], kind) @ planes[size] > 0
                out[rows] = side.reshape(len(rows), tables, signs) @ (1 << np.arange(signs, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("label", "vec", "rep", "n")], lists], names=["label", "vec", "rep", "n", "keys"])

    keyed = table(classes.mapInArrow(keys, "label string, vec binary, rep long, n long, keys array<long>"), "keyed")
    met = keyed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn("key", F.get("keys", F.col("slot")))
    cell = ["label", "slot", "key"]
    sizes = met.groupBy(*cell).agg(F.count("*").alias("many")).filter("many > 1").withColumn("parts", F.ceil(F.col("many") / BLOCK))
    met = met.join(table(sizes.drop("many"), "sizes"), cell).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")))
    # block i meets every block j >= i, itself included
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "parts")

    projections = PROJECTIONS

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _units(list(pdf["vec"]), kind)
        rep, n, own = pdf["rep"].to_numpy(), pdf["n"].to_numpy(), pdf["own"].to_numpy()
        seen, slot = np.stack(pdf["keys"].to_list()), int(pdf["slot"].iloc[0])
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        lines = np.random.Generator(np.random.PCG64([seed, 1, x.shape[1]])).standard_normal((x.shape[1], projections))
        place = x @ lines
        left, right = (np.arange(len(x)),) * 2 if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        links, edges = np.zeros(len(x), dtype=np.int64), []
        root = list(range(len(x)))

        def top(a: int) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        spots = [np.argsort(place[right, p], kind="stable") for p in range(projections)]
        lanes = [place[right[s], p] for p, s in enumerate(spots)]
        for at in range(0, len(left), 128):
            rows = left[at : at + 128]
            count = np.zeros((len(rows), len(right)), dtype=np.int8)
            for p in range(projections):
                # the window of each query is one run of the sorted projection
                lo = np.searchsorted(lanes[p], place[rows, p] - radius)
                hi = np.searchsorted(lanes[p], place[rows, p] + radius, side="right")
                run = np.zeros((len(rows), len(right) + 1), dtype=np.int8)
                every = np.arange(len(rows))
                np.add.at(run, (every, lo), 1)
                np.add.at(run, (every, hi), -1)
                count[:, spots[p]] += np.cumsum(run[:, :-1], axis=1, dtype=np.int8)
            a, b = np.nonzero(count >= needed)
            a, b = rows[a], right[b]
            ok = a < b if i == j else np.ones(len(a), dtype=bool)
            a, b = a[ok], b[ok]
            if slot:
                first = ~(seen[a, :slot] == seen[b, :slot]).any(axis=1)
                a, b = a[first], b[first]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            a, b = a[ok], b[ok]
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            for u, v in zip(a.tolist(), b.tolist(), strict=True):
                u0, v0 = top(u), top(v)
                if u0 != v0:
                    root[max(u0, v0)] = min(u0, v0)
                    edges.append((u, v))
        some = np.flatnonzero(links)
        e = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pd.concat([
            pd.DataFrame({"a": rep[some], "b": rep[some], "la": pdf["label"].iloc[0], "ua": pdf["vec"].to_numpy()[some], "ub": None, "links": links[some]}),
            pd.DataFrame({"a": rep[e[:, 0]], "b": rep[e[:, 1]], "la": pdf["label"].iloc[0], "ua": None, "ub": None, "links": 0}),
        ])[["a", "b", "la", "ua", "links"]]

    found = table(met.groupBy(*cell, "i", "j").applyInPandas(block, "a long, b long, la string, ua binary, links long"), "links")
    counts = found.filter("links > 0").groupBy(F.col("la").alias("label"), F.col("ua").alias("vec")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("a != b").select("a", "b"))
    classes = classes.join(counts, ["label", "vec"], "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    classes = table(classes.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "linked")
    linked = named.join(classes, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = vectors.select(key_of("vec_id").alias("vec_id")).join(table(named.select("vec_id").distinct(), "named"), "vec_id", "left_anti")
    out = linked.unionAll(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    real = lambda c: F.when(F.col(c) != key_of(F.lit(None).cast("long")), F.col(c))
    return out.select(real("vec_id").alias("vec_id"), "n_links", real("component_id").alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op7_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept; links at a cosine of 0.93."""
    return link_vectors(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93::DOUBLE),
reach(id, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM least LEFT JOIN counts ON counts.a = id
"""
