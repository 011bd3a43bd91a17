"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm._common import load, table

#: Signs that stand for Latin letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
CYRILLIC_GREEK = dict(zip("авгеикмнорстухіјѕԁαβεικνορτυχ", "abreukmhopctyxijsdabeikvoptux", strict=True))

#: Labelled rows in the sample that the lexicon is learned from; its size follows from them and from the thresholds.
SAMPLE_ROWS = 20_000
#: An entry needs toxic documents and log odds; prefixes need more of both, as they also meet harmless words.
LEAST_DOCS, LEAST_ODDS, PREFIX_DOCS, PREFIX_ODDS = 6, 2.0, 12, 3.0
PREFIXES = (5, 6, 7)


class _Fold(dict):
    """str.translate table, filled as characters are met: base letters, digits as letters, all else a blank."""

    def __missing__(self, point: int) -> str:
        c = chr(point).lower()
        c = CYRILLIC_GREEK.get(c) or unicodedata.normalize("NFKD", c)
        out = "".join(x for x in c.lower() if x.isalpha()) or " "
        self[point] = out
        return out


_FOLD = _Fold({ord(k): v for k, v in DIGITS.items() if k.isdigit() or k in "@$"})
#: "!" and "|" are letters only between letters; at the end of words they are punctuation.
_INNER = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])")


def fold(text: str | None) -> str:
    """" word word ": lower case, homoglyphs and digit substitutions as plain letters, single signs as blanks."""
    if not text:
        return "  "
    if "!" in text or "|" in text:
        text = _INNER.sub(lambda m: DIGITS[m[0]], text)
    return f" {text.translate(_FOLD)} "


@dataclass
class Lexicon:
    """Weights of words (" word ") and word beginnings (" begi"), phrases that are no offence, and the calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 4.0
    offset: float = -4.0

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for k, w in self.weights.items():
            a.add_word(k, (len(k), w))
        for k in self.exceptions:
            a.add_word(k, (len(k), None))
        if len(a):
            a.make_automaton()
        return a

    def strength(self, a: ahocorasick.Automaton, text: str | None) -> float:
        """Sum of the largest weight at each matched word outside exception phrases, over a root of the length."""
        folded = fold(text)
        if not len(a):
            return 0.0
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in a.iter(folded):
            at = end - n + 1
            if w is None:
                spared.append((at, end))
            else:
                hits[at] = max(w, hits.get(at, w))
        for first, last in spared:
            for at in [at for at in hits if first <= at < last]:
                del hits[at]
        total = sum(hits.values())
        return total / (1.0 + folded.count(" ") / 400.0) ** 0.5 if hits else 0.0

    def score(self, strength: float) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * strength + self.offset, -30, 30))))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """Lexicon from at most sample_rows labelled rows that are not held out, the least by a hash of their id.

    Document frequencies in toxic and other texts give log odds for whole words and for word beginnings; the
    strongest entries form the lexicon. Two-word phrases around its words that no toxic text and several
    others hold are exceptions. A one-variable logistic curve turns strengths into scores. Labels that are
    null or whose document is missing are passed over; without both classes the lexicon is empty.
    """
    wanted = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    wanted = wanted.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = table(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic")), "labelled")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Lexicon()
    bad, good = totals[True], totals[False]

    def counted(emit, schema: str = "k string, toxic boolean") -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    keys = list(emit(fold(text)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic] * len(keys), pa.bool_())], names=["k", "toxic"])

        return sample.mapInArrow(run, schema).groupBy("k").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))

    def entries(folded: str) -> set[str]:
        found = set(folded.split())
        return {f" {w} " for w in found} | {f" {w[:n]}" for w in found for n in PREFIXES if len(w) > n}

    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    whole = F.col("k").endswith(" ")
    strong = counted(entries).withColumn("w", odds).filter(
        (whole & (F.col("bad") >= LEAST_DOCS) & (F.col("w") >= LEAST_ODDS)) | (~whole & (F.col("bad") >= PREFIX_DOCS) & (F.col("w") >= PREFIX_ODDS))
    )
    rows = sorted(strong.collect(), key=lambda r: (-round(r["w"], 9), r["k"]))
    lexicon = Lexicon({r["k"]: round(r["w"], 6) for r in rows})
    if rows:
        known = {k.strip() for k in lexicon.weights if k.endswith(" ")}

        def phrases(folded: str) -> set[str]:
            w = folded.split()
            return {f" {w[i]} {w[i + 1]} " for i in range(len(w) - 1) if w[i] in known or w[i + 1] in known}

        mild = counted(phrases).filter((F.col("bad") == 0) & (F.col("good") >= 3))
        lexicon.exceptions = sorted(r["k"] for r in mild.collect())
    judged = _scored(sample.withColumn("doc_id", F.col("toxic").cast("long")), lexicon).select("doc_id", "strength").collect()
    _calibrate(lexicon, np.array([r["strength"] for r in judged]), np.array([r["doc_id"] for r in judged], dtype=float))
    return lexicon


def _calibrate(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
    """Newton steps for a lightly penalised logistic curve; both classes weigh as much as they are frequent."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    design = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - 1e-3 * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    if w[0] > 0:
        lexicon.slope, lexicon.offset = round(float(w[0]), 9), round(float(w[1]), 9)


def _scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("strength", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            texts = batch.column("text")
            strength = [round(lexicon.strength(a, texts[i].as_py()), 9) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([lexicon.score(s) for s in strength], pa.float64()), pa.array(strength, pa.float64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with doc_id, text -> doc_id, held_out, score (0 to 1), predicted (score >= 0.5), strength.

    The whole text is folded and scanned once. Null and empty texts have strength 0 and the score of a text
    without any match. Every row is scored by itself, repeated ones alike; an empty table gives an empty
    result. Other columns are not read. The lexicon travels to the executors with the function; it grows with the
    sample that it was learned from, not with the documents.
    """
    out = _scored(docs, lexicon)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "strength")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, learn(docs, load(spark, sf_dir, "labels"))).drop("strength")
