"""Substring dedup by paragraphs: MinHash banding, exact Jaccard, removal by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terrane.llm._common import drop_table, key_of, load, release, table
from terrane.llm._shingles import Sketcher, mix, pieces, powers, prefix_hash, set_names, shingle_sets, string_names, words
from terrane.llm.minhash import full_sets, key_lists, link_classes, sets_schema

#: Five bands of two samples: two paragraphs of similarity 0.8 share none with probability 0.006.
BANDS, ROWS = 5, 2
#: Paragraphs of fewer words are not compared; runs of repeated ones under RUN_WORDS words stay.
LEAST_WORDS, RUN_WORDS = 8, 30
#: Places on either side that a paragraph's end ranks before, and words around a kept paragraph to compare others with.
REACH, CONTEXT = 7, 48


def paragraph_ends(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of all paragraphs, text number and word count of each.

    Every place between two words has a rank: the ends of lines and words that end in a full stop come first,
    then all others, each by the hash of its two words. A paragraph ends at the places that rank first among the
    REACH places on either side. So short sentences are joined, long ones are cut, none but a text's first and
    last has under REACH + 1 words, and a passage is cut alike wherever it stands but for its REACH words next
    to the host's.
    """
    start, end, owner = words(data, ends)
    cuts = [ends]
    if len(start) > 1:
        total, (_, down) = prefix_hash(data), powers(len(data))
        word = mix((total[end] - total[start]) * down[start])
        feeds = np.append(np.flatnonzero(data == 10) + 1, len(data) + 1)
        line = feeds[np.searchsorted(feeds, end[:-1], side="right")]
        lines = line <= start[1:]
        rank = mix(word[:-1] * np.uint64(3) + word[1:]) >> np.uint64(1)
        rank |= (~(lines | (data[end[:-1] - 1] == ord(".")))).astype(np.uint64) << np.uint64(63)
        inside = owner[:-1] == owner[1:]
        first = inside.copy()
        for j in range(1, min(REACH, len(rank) - 1) + 1):
            # places of one text; of equal ones the earlier is first
            near = inside[:-j] & inside[j:] & (owner[: len(rank) - j] == owner[j : len(rank)])
            later = rank[j:] < rank[:-j]
            first[:-j] &= ~(near & later)
            first[j:] &= ~(near & ~later)
        cuts.append(np.where(lines, line, end[:-1])[first])
    at = np.unique(np.concatenate(cuts))
    of = np.searchsorted(ends, at[:-1], side="right") - 1
    count = np.diff(np.searchsorted(start, at)) if len(at) > 1 else np.zeros(0, np.int64)
    return at, of, count


def word_names(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word and 32 bits that name it, A-Z as a-z."""
    start, end, _ = words(data, ends)
    named = string_names(data, start, end, prefix_hash(data))
    return start, end, (named >> np.uint64(32)).astype("<u4")


def _by_text(texts: pa.Array, marked: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, dict[int, tuple]]]:
    """Of runs of whole texts: first row, row after the last, number of paragraphs of each text; of marked rows the
    offsets of paragraphs and the starts, ends and names of words, all in their text."""
    for first, last, data, ends in pieces(texts):
        at, of, _ = paragraph_ends(data, ends)
        edge = np.searchsorted(of, np.arange(last - first + 1))
        rows, use = {}, np.flatnonzero(marked[first:last])
        if len(use):
            start, end, name = word_names(data, ends)
            word = np.searchsorted(start, ends)
            for r in use.tolist():
                a, b, base = word[r], word[r + 1], ends[r]
                rows[first + r] = (at[edge[r] : edge[r + 1] + 1] - base, start[a:b] - base, end[a:b] - base, name[a:b])
        yield first, last, np.diff(edge), rows


def _contexts(texts: DataFrame) -> DataFrame:
    """(i, t, text, ks) -> i, t, k, before, after: the names of CONTEXT words on either side of the paragraphs ks."""
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("t", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType())])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, t, ks = (batch.column(c).to_pylist() for c in ("i", "t", "ks"))
            for _, _, _, found in _by_text(batch.column("text"), np.ones(batch.num_rows, dtype=bool)):
                rows: list[tuple] = []
                for r, (at, start, _, name) in found.items():
                    low = np.searchsorted(start, at)
                    rows += [(i[r], t[r], k, name[max(0, low[k] - CONTEXT) : low[k]].tobytes(), name[low[k + 1] : low[k + 1] + CONTEXT].tobytes()) for k in ks[r]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return texts.select("i", "t", "text", "ks").mapInArrow(run, schema)


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    return int(other[0]) if len(other) else n


def repeated_runs(at: np.ndarray, start: np.ndarray, end: np.ndarray, name: np.ndarray, marks: list[dict], least_words: int, run_words: int) -> list[tuple[int, int, int, set[int]]]:
    """The runs that go from a text with marked paragraphs (k, by, before, after).

    at are the offsets of its paragraphs; start, end and name are its words'. A run is first byte, byte after the
    last, whole paragraphs in it, documents that keep it. It goes on, word by word, as long as the words around a
    marked paragraph are those around the kept one; of several documents that keep a word the least counts.
    """
    low = np.searchsorted(start, at)
    by = {m["k"]: m for m in sorted(marks, key=lambda m: (m["k"], m["by"]), reverse=True)}
    runs: list[list[int]] = []  # first word, word after the last
    least = np.full(len(start), np.iinfo(np.int64).max)  # of the documents that keep a word
    for k in sorted(by):
        m, a, b = by[k], int(low[k]), int(low[k + 1])
        before, after = (np.frombuffer(m[c] or b"", dtype="<u4") for c in ("before", "after"))
        a -= _alike(name[max(0, a - CONTEXT) : a][::-1], before[::-1])
        b += _alike(name[b : b + CONTEXT], after)
        least[a:b] = np.minimum(least[a:b], m["by"])
        # fewer words than are compared between two of a run go with it
        while runs and a - runs[-1][1] < least_words:
            c, d = runs.pop()
            a, b = min(a, c), max(b, d)
        runs.append([a, b])
    out = []
    for a, b in runs:
        if b - a >= run_words:
            first, last = np.searchsorted(low, a), np.searchsorted(low, b, side="right") - 1
            cut_a = int(at[first]) if low[first] == a else int(start[a])
            cut_b = int(at[last]) if low[last] == b else int(end[b - 1])
            keepers = np.unique(least[a:b]).tolist()
            out.append((cut_a, cut_b, int(max(0, last - first)), {x for x in keepers if x < np.iinfo(np.int64).max}))
    return out


def _paragraphs(docs: DataFrame, size: int, least_words: int) -> DataFrame:
    """(i, t, text) -> id, i, t, k (number in the text) and the band keys of every paragraph of least_words words."""
    fields = [(c, T.LongType()) for c in ("id", "i", "t")] + [("k", T.IntegerType())] + [(c, T.LongType()) for c in ("n_shingles", "s1", "s2")]
    schema = T.StructType([*[T.StructField(*f) for f in fields], T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, here, done = Sketcher(BANDS, ROWS), TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            i, t = batch.column("i").to_numpy(), batch.column("t").to_numpy()
            for first, _, data, ends in pieces(batch.column("text")):
                at, of, count = paragraph_ends(data, ends)
                use = np.flatnonzero(count >= least_words)
                if not len(use):
                    continue
                sets, offsets = shingle_sets(data, at, size)
                own = _spread(offsets[use], offsets[use + 1])
                sets, offsets = sets[own], np.concatenate([[0], np.cumsum((offsets[1:] - offsets[:-1])[use])])
                number = use - np.searchsorted(of, of[use])
                ids = here + done + np.arange(len(use))
                done += len(use)
                name = set_names(sets, offsets)
                keys = sketcher.band_keys(sketcher.samples(sets, offsets))
                cols = [ids, i[first + of[use]], t[first + of[use]], number.astype(np.int32), np.diff(offsets).astype(np.int64), name[:, 0], name[:, 1]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], key_lists(keys)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All indexes of the ranges, one after another."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def _sets_of(texts: DataFrame, size: int) -> DataFrame:
    """(text, at: [k, id]) -> full_sets()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(BANDS, ROWS)
        for batch in batches:
            for first, last, data, ends in pieces(batch.column("text")):
                at, of, _ = paragraph_ends(data, ends)
                sets, offsets = shingle_sets(data, at, size)
                wanted = batch.column("at").slice(first, last - first)
                n = np.diff(wanted.offsets.to_numpy())
                k = wanted.flatten().field(0).to_numpy() + np.repeat(np.searchsorted(of, np.arange(last - first)), n)
                own = np.concatenate([[0], np.cumsum(offsets[k + 1] - offsets[k])])
                yield full_sets(wanted.flatten().field(1), sets[_spread(offsets[k], offsets[k + 1])], own, sketcher)

    return texts.select("text", "at").mapInArrow(run, sets_schema(T.LongType()))


def remove_repeated_paragraphs(docs: DataFrame, percent: int = 80, size: int = 5, least_words: int = LEAST_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with doc_id, text -> doc_id, n_paragraphs, n_removed, n_spans, originals, kept_text.

    Paragraphs of least_words words or more are linked at a Jaccard similarity of `percent` or more of their
    word shingles; of each component the one in the least document (then the first in it) stays. The others
    go, with the words around them that also stand around the one that stays, where they make up runs of
    run_words words, gaps of under least_words words between two of a run included; so common short sentences
    stay. n_removed counts the paragraphs that go whole, n_spans counts the runs, originals lists the documents that keep them. Null
    texts are empty; texts without words have no paragraph to compare. Rows with one doc_id and one text
    share a result, different texts of one doc_id are documents of their own. A null doc_id is reported null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(key_of("doc_id").alias("i"), F.xxhash64(text).alias("t"), text.alias("text"))
    sk = table(_paragraphs(texts, size, least_words), "paragraphs")

    def sets_of(ids: DataFrame) -> DataFrame:
        places = sk.select("id", "i", "t", "k").join(ids, "id", "left_semi").groupBy("i", "t").agg(F.collect_list(F.struct("k", "id")).alias("at"))
        return _sets_of(texts.join(table(places, "places").hint("merge"), ["i", "t"]), size)

    linked = link_classes(sk, sets_of, percent, BANDS, at_once=1)
    placed = table(sk.select("s1", "s2", "i", "t", "k").join(linked, ["s1", "s2"]).select("i", "t", "k", "component_id"), "placed")
    drop_table(sk)
    release(spark)
    first = placed.groupBy("component_id").agg(F.min(F.struct("i", "k", "t")).alias("keep"))
    repeated = placed.join(table(first, "first"), "component_id").filter("i != keep.i or t != keep.t or k != keep.k")
    repeated = repeated.select("i", "t", "k", F.col("keep.i").alias("ki"), F.col("keep.t").alias("kt"), F.col("keep.k").alias("kk")).distinct()
    # words around a paragraph matter where a neighbour is not repeated as well, next to the same kept one
    beside = Window.partitionBy("i", "t").orderBy("k", "ki", "kk")
    follows = lambda c, by: (c(F.col("k"), 1).over(beside) == F.col("k") + by) & (c(F.col("ki"), 1).over(beside) == F.col("ki")) & (c(F.col("kk"), 1).over(beside) == F.col("kk") + by)
    inner = F.coalesce(follows(F.lag, -1) & follows(F.lead, 1), F.lit(False))
    repeated = table(repeated.withColumn("inner", inner), "repeated")
    kept = ["ki", "kt", "kk"]
    asked = repeated.filter("not inner").select(*kept).distinct().groupBy(F.col("ki").alias("i"), F.col("kt").alias("t")).agg(F.collect_list("kk").alias("ks"))
    around = _contexts(texts.join(table(asked, "asked").hint("merge"), ["i", "t"])).dropDuplicates(["i", "t", "k"])
    around = table(around.select(F.col("i").alias("ki"), F.col("t").alias("kt"), F.col("k").alias("kk"), "before", "after"), "around")
    release(spark)
    none = F.lit(None).cast("binary")
    edges = repeated.filter("not inner").join(around.hint("merge"), kept).select("i", "t", "k", "ki", "before", "after")
    marks = edges.unionAll(repeated.filter("inner").select("i", "t", "k", "ki", none, none))
    marks = marks.groupBy("i", "t").agg(F.collect_list(F.struct("k", F.col("ki").alias("by"), "before", "after")).alias("at"))
    joined = texts.join(table(marks, "marks").hint("merge"), ["i", "t"], "left")
    release(spark)
    fields = [("i", T.LongType()), *[(c, T.LongType()) for c in ("n_paragraphs", "n_removed", "n_spans")], ("originals", T.ArrayType(T.LongType())), ("kept_text", T.StringType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            text, marks = batch.column("text"), batch.column("at")
            for first, last, count, found in _by_text(text, marks.is_valid().to_numpy(zero_copy_only=False)):
                rows, kept = [(0, 0, [])] * (last - first), text.slice(first, last - first)
                left = {}
                for r, (at, *words_of) in found.items():
                    runs = repeated_runs(at, *words_of, marks[r].as_py(), least_words, run_words)
                    if runs:
                        raw = text[r].as_py().encode()
                        edges = [0, *[x for a, b, _, _ in runs for x in (a, b)], len(raw)]
                        left[r - first] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
                        rows[r - first] = (sum(x[2] for x in runs), len(runs), sorted(set().union(*[x[3] for x in runs])))
                if left:
                    kept = pa.array([left.get(r, x) for r, x in enumerate(kept.to_pylist())], pa.string())
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(first, last - first), pa.array(count.astype(np.int64)), *cols, kept.cast(pa.string())], names=schema.names)

    out = joined.select("i", "text", "at").mapInArrow(cut, schema)
    return out.select(F.when(F.col("i") != key_of(F.lit(None).cast("long")), F.col("i")).alias("doc_id"), *schema.names[1:])


def op8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_removed, n_spans, originals, kept_sha256."""
    out = remove_repeated_paragraphs(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_paragraphs", "n_removed", "n_spans", "originals", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
