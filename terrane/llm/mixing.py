"""Mixing sources to target weights: subset-sum budget fitting over counts of exact lengths."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.llm._common import key_of, load, table

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of a seeded hash in which documents of one source and length are numbered.
RANGES = 256
#: The dynamic programme's budget; what is above goes by proportion and by greedy fill.
DP_WORDS = 1 << 16
#: Documents of each length that the proportional share leaves to the knapsack, at first and then.
BACK = (4, 64)


def _knapsack(lengths: list[int], left: list[int], budget: int) -> list[int]:
    """How many of each length come nearest to budget from below, at most left[i] of lengths[i].

    Dynamic programming on a bit set of reachable sums, with items of doubling multiplicity, short documents
    first; it stops as soon as the budget itself is reachable.
    """
    reach, mask, steps, take = 1, (1 << (budget + 1)) - 1, [], [0] * len(lengths)
    for i in sorted((i for i in range(len(lengths)) if 0 < lengths[i] <= budget), key=lambda i: lengths[i]):
        some, k = min(left[i], budget // lengths[i]), 1
        while some and not reach >> budget & 1:
            k = min(k, some)
            steps.append((i, k, reach))
            reach |= reach << (k * lengths[i]) & mask
            some -= k
            k *= 2
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            at -= k * lengths[i]
            take[i] += k
    return take


def fit_budget(lengths: list[int], counts: list[int], budget: int, dp_words: int = DP_WORDS) -> list[int]:
    """How many documents of each length to take, each at most once, so that the sum comes near to budget from below.

    A proportional share of every length but BACK documents, then the longest that fit, until the rest is within
    dp_words; the rest by the knapsack over all documents that are left. While that misses the budget, more of
    the share is given back, at last all of it: a budget within dp_words is met as nearly as any choice can.
    """
    words = lambda take: sum(n * k for n, k in zip(lengths, take, strict=True))
    total, best = words(counts), None
    if total <= budget:
        return list(counts)
    for back in (*BACK, max(counts)):
        take = [max(0, c * budget // total - back) for c in counts]
        rest = budget - words(take)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            if lengths[i] and rest > dp_words:
                k = min(counts[i] - take[i], (rest - dp_words) // lengths[i])
                take[i] += k
                rest -= k * lengths[i]
        if rest > dp_words + max(lengths):  # no room for it: the share given back before is the most
            break
        more = _knapsack(lengths, [c - k for c, k in zip(counts, take, strict=True)], rest)
        take = [k + m for k, m in zip(take, more, strict=True)]
        if best is None or words(take) > words(best):
            best = take
        if words(best) == budget:
            break
    return best


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes(source, source_size) -> plus target. Sources by code point, null last, get weights in turn.

    Water-filling in one pass over the source table: with sources ordered by cap / weight, the level is the
    first at which a source is not capped.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1))
    w = w.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_r", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy(F.lit(0))
    line = Window.orderBy("_r", F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("_cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onwards = F.sum("_w").over(line.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("_level", (F.sum("source_size").over(every) * F.lit(float(share)) - before) / onwards)
    w = w.withColumn("_lambda", F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_level"))).over(every)["_level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_lambda") * F.col("_w"), F.col("_cap")))
    return w.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """docs with doc_id, text, source -> doc_id, source, size, source_size, target, copies, taken.

    size counts words (null text: 0). Every source's target is its weighted share of `share` times all
    words, at most `most` (1 to 2) times its own, the excess reshared. A source's documents get 0, 1 or 2
    copies: the whole copies that the budget holds, then a seeded choice by length whose words come nearest
    to the rest. Documents of no words get the whole copies only. Equal rows are separate documents. Null
    sources are one source, null ids sort first. An empty table gives an empty result; reruns agree.

    The choice sees one count per source and length, never documents in a group; documents of one source
    and length are numbered in 256 hash ranges, so no window holds a hot length whole.
    """
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    base = base.withColumn("_h", F.xxhash64(F.lit(seed), key_of("doc_id"))).withColumn("_b", F.shiftrightunsigned("_h", 56).cast("int"))
    base = table(base.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))), "words")
    counts = table(base.groupBy("_s", "size", "_b").agg(F.count("*").alias("n"), F.first("source").alias("source")), "lengths")
    sizes = counts.groupBy("_s").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    targets = targets.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    by_length = counts.groupBy("_s", "size").agg(F.sum("n").alias("n")).join(targets, "_s")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        whole, budget = int(pdf["source_size"].iloc[0]), round(float(pdf["target"].iloc[0]))
        copies, rest = divmod(budget, whole) if whole else (0, 0)
        some = fit_budget(pdf["size"].tolist(), pdf["n"].tolist(), rest) if rest else [0] * len(pdf)
        return pdf.assign(copies=copies, some=some)[["_s", "size", "source_size", "target", "copies", "some"]]

    plan = by_length.groupBy("_s").applyInPandas(choose, "_s string, size long, source_size long, target double, copies long, some long")
    up_to = Window.partitionBy("_s", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("n").over(up_to), F.lit(0))).select("_s", "size", "_b", "_start")
    starts = table(starts.join(plan, ["_s", "size"]), "plan")
    ranked = base.join(starts, ["_s", "size", "_b"])
    rank = F.col("_start") + F.row_number().over(Window.partitionBy("_s", "size", "_b").orderBy("_h", "doc_id"))
    ranked = ranked.withColumn("_rank", rank).withColumn("copies", F.col("copies") + (F.col("_rank") <= F.col("some")).cast("long"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    out = mix_sources(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
