"""Near-duplicate classes: banded MinHash, odd-sketch screening, exact confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm._common import components, drop_table, key_of, load, release, table, union_all
from terrane.llm._shingles import SMALL, Sketcher, may_reach, odd_sketches, open_sketches, pieces, set_names, shingle_sets, similar_small

#: 20 bands of 4: at similarity 0.85 a pair shares no band with probability 4e-7, at 0.8 with 3e-5.
BANDS, ROWS = 20, 4
#: Members of one block when the rest of a bucket is compared.
BLOCK = 256


def _sketch(items: DataFrame, size: int) -> DataFrame:
    """(id, text) -> id, n_shingles, s1, s2 (name of the set), keys (one per band)."""
    fields = [items.schema["id"], *[T.StructField(c, T.LongType()) for c in ("n_shingles", "s1", "s2")]]
    schema = T.StructType([*fields, T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(BANDS, ROWS)
        for batch in batches:
            ids = batch.column("id")
            for first, last, data, ends in pieces(batch.column("text")):
                sets, offsets = shingle_sets(data, ends, size)
                count = np.diff(offsets)
                full = np.flatnonzero(count)
                named = np.zeros((last - first, 2), dtype=np.int64)
                keys = np.zeros((last - first, BANDS), dtype=np.int64)
                if len(full):
                    own = np.append(offsets[full], offsets[-1])
                    named[full] = set_names(sets, own)
                    keys[full] = sketcher.band_keys(sketcher.samples(sets, own))
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(count.astype(np.int64)), pa.array(named[:, 0]), pa.array(named[:, 1]), key_lists(keys)], names=schema.names)

    return items.select("id", "text").mapInArrow(run, schema)


def key_lists(keys: np.ndarray) -> pa.Array:
    """The band keys of each set, from a matrix, as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))


def full_sets(ids: pa.Array, sets: np.ndarray, offsets: np.ndarray, sketcher: Sketcher) -> pa.RecordBatch:
    """id, set (sorted 64-bit hashes), odd (sizes and bitmap) and keys (one per band) of non-empty sets."""
    raw, at = sets.tobytes(), (8 * offsets).tolist()
    packed = pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
    keys = sketcher.band_keys(sketcher.samples(sets, offsets)) if len(ids) else np.zeros((0, sketcher.bands), np.int64)
    return pa.RecordBatch.from_arrays([ids, packed, pa.array(odd_sketches(sets, offsets), pa.binary()), key_lists(keys)], names=["id", "set", "odd", "keys"])


def sets_schema(kind: T.DataType) -> T.StructType:
    """Of full_sets(), for ids of a type."""
    return T.StructType([T.StructField("id", kind), T.StructField("set", T.BinaryType()), T.StructField("odd", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def _sets(items: DataFrame, size: int) -> DataFrame:
    """(id, text) of texts with words -> full_sets()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(BANDS, ROWS)
        for batch in batches:
            for first, last, data, ends in pieces(batch.column("text")):
                sets, offsets = shingle_sets(data, ends, size)
                full = np.flatnonzero(np.diff(offsets))
                yield full_sets(batch.column("id").slice(first, last - first).take(pa.array(full)), sets, np.append(offsets[full], offsets[-1]), sketcher)

    return items.select("id", "text").mapInArrow(run, sets_schema(items.schema["id"].dataType))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of the full sets."""
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("x"), batch.column("y")
            good = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(both) - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, schema)


def _screen(pairs: DataFrame, odds: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that the odd sketches do not rule out: a, b, z (differing bits)."""
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("z", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, sa, u, x = open_sketches(batch.column("p").to_pylist())
            nb, sb, v, y = open_sketches(batch.column("q").to_pylist())
            z = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
            ok = may_reach(least, z, na, nb, sa, sb)
            for i in np.flatnonzero(ok & (sa < SMALL) & (sb < SMALL)):
                common = len(np.intersect1d(x[i], y[i], assume_unique=True))
                ok[i] = common >= least * (na[i] + nb[i] - common) - 1e-6
            good = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(good), batch.column("b").take(good), pa.array(z).take(good)], names=schema.names)

    x, y = odds.select(F.col("id").alias("a"), F.col("odd").alias("p")), odds.select(F.col("id").alias("b"), F.col("odd").alias("q"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "p", "q").mapInArrow(run, schema)


def _across(members: DataFrame, least: float) -> DataFrame:
    """Pairs of one bucket in different components that the odd sketches do not rule out.

    members(key, id, odd, keys, comp, major): rows of a bucket's largest component are compared with
    the others only, in cells of about BLOCK by BLOCK rows. Nothing is emitted but the pairs that pass, each
    from the first of their common keys.
    """
    minor = members.filter("comp != major")
    left = minor.join(table(minor.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "blocks"), "key")
    left = left.withColumn("i", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    right = members.join(table(members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "blocks"), "key")
    right = right.withColumn("j", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts"))).drop("parts")
    rows, columns = table(left.select("key", "i").distinct(), "cells"), table(right.select("key", "j").distinct(), "cells")
    sides = [left.join(columns, "key").withColumn("side", F.lit(0)), right.join(rows, "key").withColumn("side", F.lit(1))]
    cell = F.xxhash64("key", "i", "j").alias("cell")
    both = table(union_all([x.select(cell, "side", "key", "id", "comp", "odd", "keys", (F.col("comp") == F.col("major")).alias("most")) for x in sides]), "cells")
    # many cells are small: a task's call gets a batch of whole cells
    batches = max(1, both.count() // (8 * BLOCK))
    schema = T.StructType([T.StructField(c, members.schema["id"].dataType) for c in ("a", "b")])

    def run(cells: pa.Table) -> pa.Table:
        cells = cells.combine_chunks()
        cell, side, key = (cells[c].to_numpy() for c in ("cell", "side", "key"))
        most = cells["most"].to_numpy(zero_copy_only=False).astype(bool)
        comp, rank = (np.unique(cells[c].to_numpy(zero_copy_only=False), return_inverse=True)[1] for c in ("comp", "id"))
        keys = cells["keys"].combine_chunks().flatten().to_numpy().reshape(len(cell), -1)
        n, samples, bitmap, hashes = open_sketches(cells["odd"].to_pylist())
        tiny = samples < SMALL
        order = np.lexsort((side, cell))
        starts = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1]]))
        found_a, found_b = [], []
        for own in np.split(order, starts[1:]):
            half = int(np.searchsorted(side[own], 1))
            x, y = own[:half], own[half:]
            for at in range(0, len(x), 64):
                u = x[at : at + 64]
                # members of two lesser components meet twice; the greater id's cell has them
                ok = (comp[u][:, None] != comp[y][None, :]) & (most[y][None, :] | (rank[u][:, None] > rank[y][None, :]))
                if not ok.any():
                    continue
                small_u, small_y = np.flatnonzero(tiny[u]), np.flatnonzero(tiny[y])
                if len(small_u) and len(small_y):
                    ok[np.ix_(small_u, small_y)] &= similar_small(least, [hashes[i] for i in u[small_u]], [hashes[i] for i in y[small_y]])
                if len(small_u) < len(u) or len(small_y) < len(y):
                    z = np.bitwise_count(bitmap[u][:, None, :] ^ bitmap[y][None, :, :]).sum(axis=2, dtype=np.int64)
                    ok &= may_reach(least, z, n[u][:, None], n[y][None, :], samples[u][:, None], samples[y][None, :])
                i, j = np.nonzero(ok)
                if len(i):
                    first = (keys[u[i]] == keys[y[j]]).argmax(axis=1)
                    new = keys[u[i], first] == key[own[0]]
                    i, j = i[new], j[new]
                found_a.append(u[i])
                found_b.append(y[j])
        ids = cells["id"]
        pick = lambda rows: ids.take(pa.array(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)))
        return pa.table({"a": pick(found_a), "b": pick(found_b)})

    pairs = both.groupBy(F.pmod("cell", F.lit(batches))).applyInArrow(run, schema)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicate_classes(items: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """(id, text), ids unique and not null -> id, n_shingles, component_id.

    Items are linked when 100 * intersection >= percent * union of their sets of `size`-word shingles;
    component_id is the smallest id reachable. Items without words are linked with nothing.

    Items with equal sets are one class from the start. Classes meet in the buckets of 20 MinHash bands;
    each member is compared with its bucket's smallest id first (a star, never all pairs), the odd sketches
    screen pairs by the population count of their XOR, and full sets confirm them: the most alike pair of
    each member, then those that still join two components. What is left are buckets whose members lie in
    several components; their pairs across components are screened in blocks and confirmed likewise. So
    every pair in a bucket is confirmed, screened out, or already known to be connected.
    """
    sk = table(_sketch(items, size), "sketches")
    # ids grow with the input: the same join at every size
    by_set = link_classes(sk, lambda ids: _sets(items.join(ids.hint("merge"), "id", "left_semi"), size), percent)
    joined = sk.select("id", "n_shingles", "s1", "s2").join(by_set, ["s1", "s2"], "left")
    return joined.select("id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), "id").alias("component_id"))


def link_classes(sk: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, bands: int = BANDS, at_once: int = BANDS) -> DataFrame:
    """Components of sketched items (id, n_shingles, s1, s2, keys): s1, s2, component_id of the sets that are not alone.

    Two items of one set make a component, and so do two linked sets. sets_of(ids) gives full_sets(); it is
    asked only for sets that share a bucket. Buckets are found for at_once bands at a time: fewer need less disk, and
    read the sketches more often.
    """
    spark, least = sk.sparkSession, percent / 100
    # equal sets have equal keys: columns of integers keep this a hash aggregation
    keys = [f"k{j}" for j in range(bands)]
    full = sk.filter("n_shingles > 0").select("id", "s1", "s2", *[F.col("keys")[j].alias(k) for j, k in enumerate(keys)])
    grouped = full.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), *[F.min(k).alias(k) for k in keys])
    classes = table(grouped, "classes")
    release(spark)
    parts = []
    for low in range(0, bands, at_once):
        banded = classes.select(F.col("rep").alias("id"), F.explode(F.array(*keys[low : low + at_once])).alias("key"))
        buckets = table(banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub != last").select("key", "hub"), "buckets")
        release(spark)
        parts.append(table(banded.join(buckets, "key"), "members"))
        drop_table(buckets)
        release(spark)
    members = union_all(parts)
    ids = table(members.select("id").distinct(), "ids")
    # the sets that stand alone and share no bucket are done; the ids grow with the input: the same join at every size
    shared = ids.select(F.col("id").alias("rep"), F.lit(True).alias("shared"))
    named = classes.select("s1", "s2", "rep", "n").join(shared.hint("merge"), "rep", "left").filter("n > 1 or shared").drop("shared")
    named = table(named, "named")
    drop_table(classes)
    release(spark)
    sets = table(sets_of(ids), "sets")
    release(spark)
    star = members.filter("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    star = table(_screen(star, sets, least), "stars")
    best = star.groupBy("a").agg(F.min(F.struct("z", "b")).alias("m")).select("a", "m.b")
    edges = table(_confirm(best, sets, percent), "links")
    found = components(edges)

    def where(ids: DataFrame, name: str, comp: str) -> DataFrame:
        c = found.select(F.col("id").alias(name), F.col("component_id").alias(comp))
        return ids.join(c, name, "left").withColumn(comp, F.coalesce(comp, name))

    rest = where(where(star.join(best, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").filter("ca != cb").select("a", "b")
    more = table(_confirm(rest, sets, percent), "links")
    found = components(edges.unionAll(more))
    # buckets with members in several components: the pairs across, without those already judged
    placed = table(where(members.select("key", "id"), "id", "comp"), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi")
    mixed = table(placed.join(table(mixed.select("key"), "mixed"), "key"), "mixed")
    if mixed.limit(1).count():
        sizes = mixed.groupBy("key", "comp").agg(F.count("*").alias("n"))
        major = table(sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m")).select("key", F.col("m.comp").alias("major")), "major")
        across = _across(mixed.join(major, "key").join(sets.select("id", "odd", "keys"), "id"), least)
        last = table(_confirm(across.join(star.select("a", "b"), ["a", "b"], "left_anti"), sets, percent), "links")
        if last.limit(1).count():
            found = components(union_all([edges, more, last]))
    joined = named.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    out = table(joined.filter("n > 1 or component_id is not null").select("s1", "s2", F.coalesce("component_id", "rep").alias("component_id")), "by-set")
    for t in (*parts, ids, named, sets, star, placed, mixed):
        drop_table(t)
    release(spark)
    return out


def mark_near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """docs with doc_id, text -> doc_id, n_shingles, component_id, kept.

    A null or empty text has no shingles and is linked with nothing. Rows that repeat a doc_id give a row
    each, by the links of their own text; classes of texts that one doc_id names are one. A null doc_id is reported null and
    sorts before all others. An empty table gives an empty result.
    """
    items = docs.select(key_of("doc_id").alias("id"), "text")
    out = near_duplicate_classes(items, percent, size)
    real = lambda c: F.when(F.col(c) != key_of(F.lit(None).cast("long")), F.col(c))
    return out.select(real("id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; links at 85 percent."""
    return mark_near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept
FROM least LEFT JOIN sizes ON sizes.doc_id = id
"""
