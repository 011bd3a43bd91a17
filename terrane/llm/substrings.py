"""Exact substring dedup: remove bytes covered by strings of fixed length that occur elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm._common import drop_table, key_of, load, release, table, union_all
from terrane.llm._shingles import mix, pieces

#: Length of the grams that choose the sample, and starts that one detailed key stands for.
GRAM, STRIDE = 8, 16
_BYTES = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 31, 256, dtype=np.uint64)


#: Primes under 2**31 and bases of the two sums that name a string.
FIELDS = ((2147483647, 1103515245), (2147483629, 22695477))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _field_powers(n: int, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo the prime."""
    if prime not in _powers or len(_powers[prime][0]) <= n:
        size, out = 1 << max(16, (n + 1).bit_length()), []
        for x in (base, pow(base, -1, prime)):
            p = np.ones(size, dtype=np.uint64)
            have = 1
            while have < size:
                p[have : 2 * have] = p[:have] * np.uint64(pow(x, have, prime)) % np.uint64(prime)
                have *= 2
            out.append(p)
        _powers[prime] = (out[0], out[1])
    return _powers[prime]


def sums(data: np.ndarray) -> list[np.ndarray]:
    """Per field, entry i: the sum over data[:i] of the bytes times the base's powers. Names are taken modulo primes: no family of strings collides, as it does modulo 2**64."""
    out = []
    for prime, base in FIELDS:
        up, _ = _field_powers(len(data), prime, base)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)] % np.uint64(prime), out=total[1:])
        out.append(total)
    return out


def _hash(total: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of the substrings [start, end)."""
    name = np.zeros(len(start), dtype=np.uint64)
    for t, (prime, base) in zip(total, FIELDS, strict=True):
        _, down = _field_powers(len(t), prime, base)
        p = np.uint64(prime)
        name = (name << np.uint64(31)) + (t[end] - t[start]) % p * down[start] % p
    return mix(mix(name) + (end - start).astype(np.uint64))


def _grams(data: np.ndarray) -> np.ndarray:
    """The GRAM bytes from every position on, scrambled."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    return mix(x)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` values."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def samples(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text number, sampled position, first and last start that own it, for a run of texts.

    A start i owns the position of the least gram hash among the length / 2 positions from i on. What a
    start owns depends on the string at it alone, so equal strings of `length` bytes own the same offset:
    the sample is a difference cover that the content, not the position modulo a number, selects. Only
    starts whose string lies in one text count.
    """
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    width = length // 2
    if len(data) < length:
        return none
    grams = _grams(data)
    value = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
    least = (_least(value, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(data) - length + 1)
    of = np.searchsorted(ends, start, side="right") - 1
    start = start[start + length <= ends[of + 1]]
    if not len(start):
        return none
    of, place = np.searchsorted(ends, start, side="right") - 1, least[start]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (of[1:] != of[:-1])]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return of[first], place[first], start[first], start[last]


def _sampled(docs: DataFrame, length: int) -> DataFrame:
    """(i, t, text) -> i, t, p, lo, hi (in the text), near (name of the bytes from p on), wide (of all that the starts see)."""
    names = ["i", "t", "p", "lo", "hi", "near", "wide"]
    schema = T.StructType([T.StructField(c, T.IntegerType() if c in ("p", "lo", "hi") else T.LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, t = batch.column("i").to_numpy(), batch.column("t").to_numpy()
            for first, _, data, ends in pieces(batch.column("text")):
                total = sums(data)
                of, p, lo, hi = samples(data, ends, length)
                near = _hash(total, p, p + length // 2)
                wide = mix(_hash(total, lo, hi + length) + (p - lo).astype(np.uint64))
                base = ends[of]
                cols = [i[first + of], t[first + of], *[(x - base).astype(np.int32) for x in (p, lo, hi)], near.view(np.int64), wide.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return docs.select("i", "t", "text").mapInArrow(run, schema)


def _ranges(texts: DataFrame, length: int) -> DataFrame:
    """(i, t, text, at: [p, lo, hi]) -> the starts of each sample in strides: i, t, p, lo, hi, wide, inner."""
    names = ["i", "t", "p", "lo", "hi", "wide", "inner"]
    schema = T.StructType([T.StructField(c, T.IntegerType() if c in ("p", "lo", "hi") else T.LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data = np.frombuffer(batch.column("text")[r].as_py().encode(), dtype=np.uint8)
                total = sums(data)
                at = batch.column("at")[r].values
                p, lo, hi = (np.asarray(at.field(k), dtype=np.int64) for k in range(3))
                # strides of the distance from the start to p, the same wherever the string occurs
                a, b = (p - hi) // STRIDE, (p - lo) // STRIDE
                n = b - a + 1
                row = np.repeat(np.arange(len(p)), n)
                stride = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[row]
                p, first, last = p[row], np.maximum(lo[row], p[row] - stride * STRIDE - STRIDE + 1), np.minimum(hi[row], p[row] - stride * STRIDE)
                wide = mix(_hash(total, first, last + length) + (p - first).astype(np.uint64))
                near = p - stride * STRIDE
                inner = mix(_hash(total, near, near - STRIDE + 1 + length) + stride.astype(np.uint64))
                same = np.full(len(p), 1, dtype=np.int64)
                cols = [same * batch.column("i")[r].as_py(), same * batch.column("t")[r].as_py(), *[x.astype(np.int32) for x in (p, first, last)], wide.view(np.int64), inner.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return texts.mapInArrow(run, schema)


def _starts(texts: DataFrame, length: int) -> DataFrame:
    """(i, t, text, at: [lo, hi]) -> every start: i, t, lo, name."""
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("t", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("name", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data = np.frombuffer(batch.column("text")[r].as_py().encode(), dtype=np.uint8)
                total = sums(data)
                at = batch.column("at")[r].values
                lo, hi = (np.asarray(at.field(k), dtype=np.int64) for k in (1, 2))
                start = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, hi, strict=True)]))
                same = np.full(len(start), 1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(same * batch.column("i")[r].as_py()), pa.array(same * batch.column("t")[r].as_py()), pa.array(start.astype(np.int32)), pa.array(_hash(total, start, start + length).view(np.int64))], names=schema.names)

    return texts.mapInArrow(run, schema)


def _unsettled(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose `wide` name repeats, and what must be looked at in detail: the others of groups that repeat, with one row of each repeated name among them."""
    wide = table(rows.groupBy(group, "wide").agg(F.count("*").alias("n"), F.min(F.struct("i", "t", "p", "lo", "hi")).alias("one")), "names")
    open_groups = wide.groupBy(group).agg(F.sum("n").alias("all"), F.count_if(F.col("n") == 1).alias("lone")).filter("all > 1 and lone > 0")
    detail = wide.join(table(open_groups.select(group), "open"), group, "left_semi").select("one.*")
    done = rows.join(table(wide.filter("n > 1").select(group, "wide"), "settled"), [group, "wide"], "left_semi")
    return done.select("i", "t", "lo", "hi"), detail


def _with_text(detail: DataFrame, texts: DataFrame) -> DataFrame:
    at = detail.groupBy("i", "t").agg(F.collect_list(F.struct("p", "lo", "hi")).alias("at"))
    return texts.join(table(at, "wanted"), ["i", "t"]).select("i", "t", "text", "at")


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs with doc_id, text -> doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Texts are UTF-8 bytes (null: empty). Every byte covered by a string of `length` bytes that also starts
    anywhere else in the input goes, the same text and repeated rows included; overlaps count, matches never
    cross texts. Texts shorter than `length` stay whole. Rows with one doc_id and one text share a result. A
    null doc_id is reported null. An empty table gives an empty result.

    Every string owns one sampled position (about one in length / 4 is sampled). Sampled positions are
    sorted by the name of the length / 2 bytes after them, which all strings that own them contain; groups
    of one are done. The remaining starts are merged through their samples: all starts of a sample together
    where everything they see repeats, else in strides of 16, else one by one. So only the edges of repeats
    are looked at start by start, and nothing is sorted but names of fixed size. All counts are
    aggregations with map-side combine; no group is gathered but a single text's positions.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(key_of("doc_id").alias("i"), F.xxhash64(text).alias("t"), text.alias("text"))
    found = table(_sampled(texts.filter(F.octet_length("text") >= length), length), "samples")
    near = table(found.groupBy("near").agg(F.count("*").alias("n")).filter("n > 1").select("near"), "near")
    found = table(found.join(near, "near"), "repeated")
    done, detail = _unsettled(found, "near")
    done = [table(done, "covered")]
    release(spark)
    looked = table(_with_text(detail, texts), "texts")
    release(spark)
    strides = table(_ranges(looked, length), "strides")
    inner = table(strides.groupBy("inner").agg(F.count("*").alias("n")).filter("n > 1").select("inner"), "inner")
    more, detail = _unsettled(table(strides.join(inner, "inner"), "repeated"), "inner")
    done.append(table(more, "covered"))
    starts = table(_starts(_with_text(detail, looked.select("i", "t", "text")), length), "starts")
    # the same start may be named for a sample and for the sample's double
    starts = starts.distinct()
    twice = table(starts.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name"), "twice")
    done.append(table(starts.join(twice, "name").select("i", "t", "lo", F.col("lo").alias("hi")), "covered"))
    for x in (found, strides, looked):
        drop_table(x)
    spans = union_all(done).groupBy("i", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("at"))
    joined = texts.join(table(spans, "spans"), ["i", "t"], "left")
    release(spark)
    schema = T.StructType([T.StructField("i", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                kept, removed, spans = [], [], []
                size = []
                for text, at in zip(part.column("text"), part.column("at"), strict=True):
                    data = text.as_py().encode()
                    size.append(len(data))
                    if at.values is None or not len(at.values):
                        kept.append(data)
                        removed.append(0)
                        spans.append(0)
                        continue
                    delta = np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(delta, np.asarray(at.values.field(0), dtype=np.int64), 1)
                    np.add.at(delta, np.asarray(at.values.field(1), dtype=np.int64) + length, -1)
                    gone = np.cumsum(delta)[:-1] > 0
                    kept.append(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes())
                    removed.append(int(gone.sum()))
                    spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                yield pa.RecordBatch.from_arrays([part.column("i"), *[pa.array(c, pa.int64()) for c in (size, removed, spans)], pa.array(kept, pa.binary())], names=schema.names)

    out = joined.select("i", "text", "at").mapInArrow(cut, schema)
    return out.select(F.when(F.col("i") != key_of(F.lit(None).cast("long")), F.col("i")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
