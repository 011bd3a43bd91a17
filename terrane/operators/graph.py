"""Communities of the co-author graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.sources.scratch import drop_table, table


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(a, b) -> node, component (least node reachable): least labels with pointer jumping, each round a written table."""
    both = table(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "edges")
    labels = table(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")), "labels")
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        new = labels.join(seen, "x").select("x", F.least("l", "m").alias("l"))
        jump = table(new.join(new.select(F.col("x").alias("l"), F.col("l").alias("ll")), "l").select("x", F.col("ll").alias("l")), "labels")
        moved = jump.join(labels.withColumnRenamed("l", "old"), "x").filter("l != old").limit(1).count()
        drop_table(labels)
        labels = jump
        if not moved:
            drop_table(both)
            return labels.select(F.col("x").alias("node"), F.col("l").alias("component"))
    raise RuntimeError("components did not settle")


def propagate(pdf: pd.DataFrame, rounds: int = 40) -> pd.DataFrame:
    """Label propagation within whole components (a, b, n), node by node in order of ids.

    A node takes the label of the largest summed weight around it, ties to the least label; changes hold at
    once; it ends when a round changes nothing.
    """
    around: dict = {}
    for a, b, n in pdf[["a", "b", "n"]].itertuples(index=False):
        around.setdefault(a, []).append((b, n))
        around.setdefault(b, []).append((a, n))
    nodes, label = sorted(around), {v: v for v in around}
    for _ in range(rounds):
        moved = False
        for v in nodes:
            weight: dict = {}
            for u, n in around[v]:
                weight[label[u]] = weight.get(label[u], 0) + n
            best = min(weight, key=lambda k: (-weight[k], k))
            moved, label[v] = moved or best != label[v], best
        if not moved:
            break
    return pd.DataFrame({"node": nodes, "community": [label[v] for v in nodes]})


def communities(edges: DataFrame, batch: int = 1 << 16) -> DataFrame:
    """node, community. Labels never leave a component, so components run side by side.

    A task's call gets a batch of whole components of about `batch` edges; only a larger component makes a larger one.
    """
    edges = table(edges.select("a", "b", "n"), "edges")
    comp = connected(edges).select(F.col("node").alias("a"), "component")
    batches = max(1, edges.count() // batch)
    placed = edges.join(comp, "a").withColumn("batch", F.pmod(F.xxhash64("component"), F.lit(batches)))
    return placed.drop("component").groupBy("batch").applyInPandas(lambda p: propagate(p), "node long, community long")


def group_metrics(members: DataFrame, edges: DataFrame, authorship: DataFrame, works: DataFrame, cutoff: int, least: int = 2, most: int = 80) -> DataFrame:
    """(node, community) -> community, n_members, n_works, cohesion, recency, lead.

    Works with two members count; groups need two of them, one recent. The lead has the most works.
    """
    size = members.groupBy("community").agg(F.count("*").alias("n_members")).filter(F.col("n_members").between(least, most))
    m = members.join(size.select("community"), "community", "left_semi")
    own = authorship.join(m.withColumnRenamed("node", "author"), "author")
    shared = own.groupBy("community", "work").agg(F.count_distinct("author").alias("k")).filter("k >= 2").join(works.select("work", "year"), "work")
    shared = shared.groupBy("community").agg(F.count("*").alias("n_works"), F.avg((F.col("year") >= cutoff).cast("double")).alias("recency"))
    shared = shared.filter("n_works >= 2 and recency > 0")
    x, y = m.select(F.col("node").alias("a"), "community"), m.select(F.col("node").alias("b"), "community")
    inner = edges.join(x, "a").join(y, ["b", "community"]).groupBy("community").agg(F.count("*").alias("links"))
    from terrane.operators.lexical import best_first

    lead = best_first(own.groupBy("community", "author").agg(F.count("*").alias("w")), ["community"], [F.desc("w"), "author"]).select("community", F.col("author").alias("lead"))
    out = size.join(shared, "community").join(inner, "community", "left").join(lead, "community")
    pairs = F.col("n_members") * (F.col("n_members") - 1) / 2
    return out.select("community", "n_members", "n_works", (F.coalesce("links", F.lit(0)) / pairs).alias("cohesion"), "recency", "lead")


def in_corpus_order(members: DataFrame, order: DataFrame) -> DataFrame:
    """(node, community) and order(node, seq) -> community, number (from 1), members: both in corpus order.

    A community stands where its first member does. Numbers come from a window over one row per community.
    """
    placed = members.join(order.select("node", "seq"), "node")
    lists = placed.groupBy("community").agg(F.min("seq").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "node"))), lambda m: m["node"]).alias("members"))
    return lists.select("community", F.row_number().over(Window.orderBy("first")).alias("number"), "members")
