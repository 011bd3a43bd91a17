"""Sharding: minimax contiguous partition of atomic groups, in DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.llm._common import load, table

#: Texts are ordered by a 64-bit hash; its first UNIT_BITS bits name the units that are summed first, 65,536 at
#: most whatever the input. Units beside a cut are then parted by STEP_BITS more bits, until a cut parts groups.
UNIT_BITS, STEP_BITS = 16, 8
#: Units on either side of a cut that are parted at once: under 40 * 2 * AROUND * 256 sums for the driver.
AROUND = 12
#: Units with more than 1/HOT of all rows get SALTS numbering ranges; there are fewer than HOT of them.
HOT, SALTS = 512, 256


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """First index of shards 1..shards-1 in the contiguous partition whose largest sum is least.

    Binary search over the capacity; one check walks the shards greedily, by bisection in the prefix sums. Of the
    cuts that keep the least capacity each is the one nearest to its equal share. Cuts beyond the last element
    mean empty shards.
    """
    ends = [0, *accumulate(sizes)]
    total, n = ends[-1], len(sizes)

    def feasible(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = bisect_right(ends, ends[at] + capacity) - 1
        return at >= n

    low, high = max([-(-total // shards), *sizes], default=0), total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    # the first place of each cut from which the shards behind it can hold the rest
    least = [n]
    for _ in range(shards - 1):
        least.append(bisect_left(ends, ends[least[-1]] - low))
    cuts, at = [], 0
    for shard, first in enumerate(reversed(least[1:]), 1):
        first, last = max(first, at), bisect_right(ends, ends[at] + low) - 1
        share = total * shard / shards
        near = min(max(bisect_left(ends, share), first), last)
        at = near - 1 if near > first and share - ends[near - 1] <= ends[near] - share else near
        cuts.append(at)
    return cuts


def _cut_hashes(base: DataFrame, shards: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Hashes (unsigned) with which shards 1..shards-1 begin, and the rows of each first unit.

    Units beside a cut that hold more than one group are parted further and the cuts found again, until every cut
    lies between groups that are known each: a few passes over the sizes.
    """

    def sums(prefix: Column, where: Column | None, bits: int) -> list[list]:
        rows = base if where is None else base.filter(where)
        got = rows.groupBy(prefix.alias("unit")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), (F.min("_h") == F.max("_h")).alias("one")).collect()
        return [[(r["unit"] % (1 << bits)) << (64 - bits), bits, r["size"], r["n"], r["one"]] for r in got]

    units = sorted(sums(F.shiftrightunsigned("_h", 64 - UNIT_BITS), None, UNIT_BITS))
    rows = [(u[0] >> (64 - UNIT_BITS), u[3]) for u in units]
    while True:
        cuts = minimax_cuts([u[2] for u in units], shards)
        if all(units[i][4] for c in cuts for i in (c - 1, c) if 0 <= i < len(units)):
            return [units[c][0] if c < len(units) else 1 << 64 for c in cuts], rows
        # finer units move the cuts: those around are parted with them
        beside = {i for c in cuts for i in range(max(0, c - AROUND), min(len(units), c + AROUND)) if not units[i][4]}
        finer = []
        for bits in sorted({units[i][1] for i in beside}):
            names = [u - (1 << 64) if u >= 1 << 63 else u for u in (units[i][0] for i in beside if units[i][1] == bits)]
            begin = F.shiftleft(F.shiftrightunsigned("_h", 64 - bits), 64 - bits)
            finer += sums(F.shiftrightunsigned("_h", 64 - bits - STEP_BITS), begin.isin(names), bits + STEP_BITS)
        units = sorted([u for i, u in enumerate(units) if i not in beside] + finer)


def shard_documents(docs: DataFrame, shards: int = 40, row_bytes: int = 16) -> DataFrame:
    """docs with doc_id, text -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law "bytes": the size is the text's UTF-8 bytes (null: none) plus row_bytes; the largest shard is as small as
    cuts in the order of the texts' hashes allow, and each cut is as near to equal shards as that permits. Rows with
    equal texts (nulls among themselves) are a group and are never parted; cuts lie between single groups at any
    size of the input. Beyond 65,536 texts the search for the least capacity knows the groups beside its cuts one by
    one and the others in runs. slot numbers a shard's rows from 0 without gaps, in the order of hash and doc_id;
    repeated rows each take a slot. An empty table gives an empty result; shards may be empty when groups are few.
    Other columns are not read.

    A unit with very many rows (a group of copies) is numbered in salted ranges, so that no window holds it
    whole.
    """
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + row_bytes).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), F.col("text")).alias("_h"),
    ).withColumn("_unit", F.shiftrightunsigned("_h", 64 - UNIT_BITS).cast("int"))
    base = table(base, "sizes")
    firsts, units = _cut_hashes(base, shards)
    most = max(SALTS, sum(n for _, n in units) // HOT)
    hot = [u for u, n in units if n > most]
    # hashes in unsigned order are these in signed order
    ordered, shard = F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), F.lit(0)
    for first in firsts:
        shard = shard + ((ordered >= first - (1 << 63)).cast("int") if first < 1 << 64 else F.lit(0))
    salt = F.when(F.col("_unit").isin(hot), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    placed = base.withColumn("_salt", salt).withColumn("shard", shard)
    counts = placed.groupBy("shard", "_unit", "_salt").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("shard").orderBy("_unit", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    # one row per unit and salt, and one more per cut: under 65,536 + 512 * 256 + 39 of them, whatever the input
    placed = placed.join(F.broadcast(starts), ["shard", "_unit", "_salt"])
    within = F.row_number().over(Window.partitionBy("shard", "_unit", "_salt").orderBy("_h", "doc_id"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_start") + within - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shard_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))
