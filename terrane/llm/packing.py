"""Packing: deficit round-robin over source queues, windows of fixed proportions, sequences cut from them."""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terrane.llm._common import load, table

SEQUENCE, WINDOW = 1024, 1 << 16
#: Numbers that a task keeps of windows' counts.
HELD = 1 << 20
TOKENIZER = "byte_bpe_50k"


class Encoder:
    """Ids of a byte-level BPE file by its JSON tokenizer, special tokens in a text included.

    The ranks file of the same vocabulary gives the same ids several times faster for texts without an added token's
    string; those with one, and texts that its library refuses, go through the JSON file.
    """

    def __init__(self, name: str = TOKENIZER):
        import public_tokenizers as files
        import tiktoken

        self.json = files.path(f"{name}.json")
        with open(self.json, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        with open(files.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def __call__(self, text: str) -> list[int]:
        if not any(t in text for t in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the library's Rust panics are no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json)
        return self.slow.encode(text, add_special_tokens=False).ids


def tokenize(docs: DataFrame, name: str = TOKENIZER, end_id: int = 0) -> DataFrame:
    """docs with doc_id, text, source -> doc_id, queue, ids (16-bit little-endian), n, part, at.

    at counts the tokens before the document in its queue within the partition `part`. Written as a table,
    these places hold for every later reading.
    """
    queue = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, t) for c, t in (("queue", T.StringType()), ("ids", T.BinaryType()), ("n", T.LongType()), ("part", T.IntegerType()), ("at", T.LongType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, counts = Encoder(name), TaskContext.get().partitionId(), {}
        known: dict[str, bytes] = {}
        held = 0
        for batch in batches:
            texts, queues = batch.column("text"), batch.column("queue").to_pylist()
            for first in range(0, batch.num_rows, 512):
                rows = range(first, min(batch.num_rows, first + 512))
                ids, n, at = [], [], []
                for i in rows:
                    text = texts[i].as_py() or ""
                    got = known.get(text)
                    if got is None:
                        got = np.array([*encode(text), end_id], dtype="<u2").tobytes()
                        held += 2 * len(text) + len(got)
                        if held > 32 << 20:
                            known, held = {}, 0
                        known[text] = got
                    ids.append(got)
                    n.append(len(got) // 2)
                    at.append(counts.get(queues[i], 0))
                    counts[queues[i]] = at[-1] + n[-1]
                own = batch.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("queue"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(at, pa.int64())], names=schema.names)

    return docs.select("doc_id", queue.alias("queue"), "text").mapInArrow(run, schema)


class Rounds:
    """What every queue has sent after a number of tokens in all, in closed form.

    Every window adds its size, shared by weight among the queues that still have tokens, to their deficit
    counters, and each sends its whole part; fractions carry over to the next window, wherever that is made, and a
    queue that runs dry leaves its share to the others. Cut freely, a queue always has a token to send, so between
    two queues' ends each has sent a fixed share of what went out since the last end.
    """

    def __init__(self, tokens: list[int], weights: list[int]):
        self.total = sum(tokens)
        order = sorted(range(len(tokens)), key=lambda q: Fraction(tokens[q], weights[q]))
        self.ends, self.before, self.weight = [], [0], [sum(weights)]  # of phases: first token after, tokens of dry queues, weight of the others
        self.phase = [0] * len(tokens)  # in which each queue runs dry
        for at, q in enumerate(order):
            if at and Fraction(tokens[q], weights[q]) == Fraction(tokens[order[at - 1]], weights[order[at - 1]]):
                self.phase[q] = len(self.ends) - 1
                self.before[-1], self.weight[-1] = self.before[-1] + tokens[q], self.weight[-1] - weights[q]
                continue
            self.phase[q] = len(self.ends)
            self.ends.append(self.before[-1] - (-tokens[q] * self.weight[-1] // weights[q]))
            self.before.append(self.before[-1] + tokens[q])
            self.weight.append(self.weight[-1] - weights[q])
        wide = max(weights, default=0) * self.total >= 1 << 62  # products beyond 64 bits are Python's integers
        self.tokens, self.weights = (np.array(x, dtype=object if wide else np.int64) for x in (tokens, weights))
        self.phase = np.array(self.phase, dtype=np.int64)

    def sent(self, out: int) -> np.ndarray:
        """Tokens that each queue has sent when `out` have been sent in all, but for the fractions."""
        m = bisect_right(self.ends, out)
        if m == len(self.ends):
            return self.tokens
        return np.where(self.phase < m, self.tokens, self.weights * (out - self.before[m]) // self.weight[m])

    def sent_by(self, q: int, out: int) -> int:
        m = bisect_right(self.ends, out)
        return int(self.tokens[q]) if self.phase[q] < m else int(self.weights[q]) * (out - self.before[m]) // self.weight[m]

    def window_of(self, q: int, token: int, window: int) -> int:
        """The window in which a queue sends its token, by its share where all queues end at once, else by bisection."""
        if len(self.ends) == 1:
            w = token * self.total // (int(self.tokens[q]) * window)
            while self.sent_by(q, w * window) > token:
                w -= 1
            while self.sent_by(q, (w + 1) * window) <= token:
                w += 1
            return w
        low, high = 0, -(-self.total // window)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.sent_by(q, mid * window) <= token else (low, mid)
        return low


def pack(docs: DataFrame, sequence: int = SEQUENCE, window: int = WINDOW, name: str = TOKENIZER, weights: Mapping[str | None, int] | None = None) -> DataFrame:
    """docs with doc_id, text, source -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and one end id; a null or empty text is the end id alone. Every source
    is a queue (nulls are one); each window of about `window` tokens takes from all queues in proportion to
    `weights` (one positive integer for every source; without them their tokens, so that all end together), in order
    of their names, deficits carried. A source that runs dry leaves its share to the others. Windows follow one another and are cut into
    sequences of `sequence` tokens; only the last sequence of all is shorter. Repeated rows are packed each;
    an empty table gives an empty result.

    Where a token goes follows from its place in its queue alone, so pieces are found row by row, without a
    shuffle of ids; places come from a small table of token counts per written part and queue. Every source is
    a queue at any number of them: a queue's number is joined, and tasks get eight bytes for each.
    """
    out = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
    coded = table(tokenize(docs, name), "ids")
    counts = table(coded.groupBy("part", "queue").agg(F.sum("n").alias("tokens")), "parts")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("part", "queue", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    queues = sorted((r["queue"], r["tokens"]) for r in counts.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect())
    wanted = {q: t for q, t in queues} if weights is None else {"" if s is None else f"={s}": int(w) for s, w in weights.items()}
    if gone := [q for q, _ in queues if wanted.get(q, 0) < 1]:
        raise ValueError(f"no positive weight for the sources {[q[1:] for q in gone[:5]]}")
    rounds = Rounds([t for _, t in queues], [wanted[q] for q, _ in queues])
    numbers = docs.sparkSession.createDataFrame([(q, i) for i, (q, _) in enumerate(queues)], "queue string, number int")
    places = places.join(table(numbers, "queues"), "queue")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}

        def before(w: int) -> np.ndarray:
            """Entry q: tokens that the queues before q have sent after w windows."""
            if w not in seen:
                if len(seen) * len(rounds.tokens) > HELD:
                    seen.clear()
                seen[w] = np.concatenate([[0], np.cumsum(rounds.sent(min(w * window, rounds.total)))])
            return seen[w]

        def upto(w: int, q: int) -> int:
            return rounds.sent_by(q, w * window)

        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            cols = {c: batch.column(c).to_pylist() for c in ("number", "n", "at", "base")}
            ids_of, names = batch.column("ids"), batch.column("doc_id").to_pylist()
            for i in range(batch.num_rows):
                q, n = cols["number"][i], cols["n"][i]
                first = cols["base"][i] + cols["at"][i]
                raw = ids_of[i].as_buffer()
                ids = np.frombuffer(raw, dtype="<u2").astype("<u4")
                done, w = 0, rounds.window_of(q, first, window)
                while done < n:
                    if upto(w + 1, q) <= first + done:
                        w = rounds.window_of(q, first + done, window)
                    low, high = before(w), before(w + 1)
                    # place in the stream: earlier windows, then this window's share of earlier queues, then the queue's own
                    place = int(low[-1] + high[q] - low[q + 1]) + first + done
                    take = min(n - done, upto(w + 1, q) - first - done, sequence - place % sequence)
                    for col, value in zip(rows, (names[i], done, take, zlib.crc32(ids[done : done + take].tobytes()), n, place // sequence, place % sequence), strict=True):
                        col.append(value)
                    done += take
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field("doc_id").type), *[pa.array(c, pa.int64()) for c in rows[1:]]], names=out.names)

    placed = coded.join(table(places, "places"), ["part", "queue"])
    return placed.select("doc_id", "number", "ids", "n", "at", "base").mapInArrow(run, out)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    return pack(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
