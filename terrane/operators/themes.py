"""Themes: farthest-first seeds, spherical k-means, roll-ups. Vectors are arrays (id, vec)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.text import unit


def theme_count(wanted: int | None = None, least: int = 40, most: int = 80) -> int:
    """K1."""
    return max(least, min(most, wanted or 60))


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Normalised sum of each key's vectors (V3): key, vec."""
    parts = vectors.select(key, F.posexplode("vec").alias("d", "x")).groupBy(key, "d").agg(F.sum("x").alias("x"))
    whole = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vec"))
    return whole.select(key, unit("vec").alias("vec"))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["vec"].to_numpy())


def farthest_first(vectors: DataFrame, k: int) -> list[tuple[int, list[float]]]:
    """k seeds: the least id, then always the one farthest from its nearest seed, ties by id (K2, K3).

    Each step is one distributed pass that keeps the best row only; with fewer candidates than k the first
    seed is repeated.
    """
    cand = vectors.filter(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) > 0.5).select("id", "vec").persist()
    head = cand.orderBy("id").first()
    seeds = [(head["id"], list(head["vec"]))] if head else []
    while seeds and len(seeds) < k:
        have = np.array([v for _, v in seeds])

        def score(frames: Iterator[pd.DataFrame], have: np.ndarray = have) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    near = np.round((1 - _matrix(pdf) @ have.T).min(axis=1), 12)
                    yield pdf.assign(far=near).sort_values(["far", "id"], ascending=[False, True]).head(1)

        best = cand.mapInPandas(score, T.StructType([*cand.schema, T.StructField("far", T.DoubleType())])).orderBy(F.desc("far"), "id").first()
        seeds.append((best["id"], list(best["vec"])) if best["far"] > 0 else seeds[0])
    cand.unpersist()
    return seeds


def spherical_kmeans(vectors: DataFrame, k: int, rounds: int = 12) -> tuple[DataFrame, list[list[float]]]:
    """Assignments (id, cluster, score) and centroids (K4): argmax of the dot product, ties to the lowest cluster.

    At most `rounds` rounds, stopping before the update once nothing moves; empty clusters keep their
    centroid. A round is one map pass: every task adds its vectors up by cluster, so that k sums and a mark of the
    assignments leave it, whatever the number of rows.
    """
    centers = np.array([v for _, v in farthest_first(vectors, k)])
    schema = T.StructType([vectors.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def nearest(pdf: pd.DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.round(_matrix(pdf) @ centers.T, 12)
        best = s.argmax(axis=1)
        return best, s[np.arange(len(s)), best]

    def assigned(centers: np.ndarray) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    best, score = nearest(pdf, centers)
                    yield pd.DataFrame({"id": pdf["id"], "cluster": best.astype("int32"), "score": score})

        return vectors.select("id", "vec").mapInPandas(run, schema)

    def sums(centers: np.ndarray) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, mark = np.zeros_like(centers), np.uint64(0)
            for pdf in frames:
                if len(pdf):
                    best, _ = nearest(pdf, centers)
                    np.add.at(total, best, _matrix(pdf))
                    named = pd.util.hash_pandas_object(pdf.assign(cluster=best)[["id", "cluster"]], index=False).to_numpy()
                    mark ^= np.bitwise_xor.reduce(named)
            c, d = np.indices(total.shape)
            yield pd.DataFrame({"cluster": c.ravel(), "d": d.ravel(), "x": total.ravel(), "mark": np.full(total.size, mark).view(np.int64)})

        return vectors.select("id", "vec").mapInPandas(run, "cluster long, d long, x double, mark long")

    last = state = None
    for _ in range(rounds):
        rows = sums(centers).groupBy("cluster", "d").agg(F.sum("x").alias("x"), F.bit_xor("mark").alias("mark")).collect()
        if not rows or rows[0]["mark"] == state:
            break
        new, state = np.zeros_like(centers), rows[0]["mark"]
        for r in rows:
            new[r["cluster"], r["d"]] = r["x"]
        size = np.linalg.norm(new, axis=1, keepdims=True)
        last, centers = centers, np.where(size > 0, new / np.where(size > 0, size, 1), centers)
    else:
        return assigned(last), centers.tolist()
    return assigned(centers), centers.tolist()


def roll_up(members: DataFrame, authors: DataFrame, works: DataFrame, cutoff: int) -> DataFrame:
    """(theme, work, score) -> theme, publication_count, recent_publications, faculty_count, representative_publications (K5, K6).

    Members below 0 do not count; the five best stand for the theme, ties by work.
    """
    m = members.filter("score >= 0").join(works.select("work", "year"), "work")
    agg = m.groupBy("theme").agg(F.count("*").alias("publication_count"), F.count_if(F.col("year") >= cutoff).alias("recent_publications"))
    people = m.join(authors, "work").groupBy("theme").agg(F.count_distinct("author").alias("faculty_count"))
    from terrane.operators.lexical import best_first

    top = best_first(m, ["theme"], [F.desc("score"), "work"], 5)
    top = top.groupBy("theme").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "work"))), lambda s: s["work"].cast("string")), ",").alias("representative_publications"))
    return agg.join(people, "theme", "left").join(top, "theme").withColumn("faculty_count", F.coalesce("faculty_count", F.lit(0)))
