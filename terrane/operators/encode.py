"""Text to dense vectors by an encoder that the caller brings, its cache, the lexical fallback, and query expansion."""

from __future__ import annotations

import logging
import re
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.text import TOKEN
from terrane.sources.tables import cache_key, uncached

#: Texts -> one unit vector each. It is made once per task, by a function that travels to the executors.
Encoder = Callable[[list[str]], np.ndarray]
CHUNK_WORDS, BATCH = 180, 64
#: Longest query in characters.
QUERY_CHARS = 20_000
FALLBACK = "tf-idf-384"
LOG = logging.getLogger("terrane.encode")


def encode_texts(texts: list[str | None], encoder: Encoder, size: int = CHUNK_WORDS) -> list[np.ndarray]:
    """Each text's chunks of `size` words, encoded, weighed by their words, summed, at length one."""
    words = [re.split(r"\s+", t or "") for t in texts]
    chunks = [(i, w[at : at + size]) for i, w in enumerate(words) for at in range(0, len(w), size)]
    sums: list = [0.0] * len(texts)
    for at in range(0, len(chunks), BATCH):
        part = chunks[at : at + BATCH]
        for (i, w), v in zip(part, np.asarray(encoder([" ".join(w) for _, w in part]), dtype=np.float64), strict=True):
            sums[i] = sums[i] + v * len(w)
    return [s / (np.linalg.norm(s) or 1.0) for s in sums]


def encode(texts: DataFrame, make: Callable[[], Encoder], size: int = CHUNK_WORDS) -> DataFrame:
    """(id, text) -> id, vec (U1). Texts stream through the task in batches; a null text is empty."""
    schema = T.StructType([texts.schema["id"], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for pdf in frames:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                yield pd.DataFrame({"id": part["id"], "vec": encode_texts([t if isinstance(t, str) else None for t in part["text"]], encoder, size)})

    return texts.select("id", "text").mapInPandas(run, schema)


def encode_cached(texts: DataFrame, make: Callable[[], Encoder], folder: str, model: str, version: str = "1") -> DataFrame:
    """encode(), but every distinct text once: vectors are kept in `folder` as Parquet by model, version and text.

    Only what the folder lacks is encoded and appended; rows with one key hold one vector, so a batch that is
    appended twice does no harm.
    """
    spark = texts.sparkSession
    schema = "hash string, vec array<double>"
    keyed = texts.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", cache_key(F.lit(model), F.lit(version), F.col("text")))
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    missing = uncached(keyed.dropDuplicates(["hash"]), spark.read.schema(schema).parquet(folder))
    encode(missing.select(F.col("hash").alias("id"), "text"), make).withColumnRenamed("id", "hash").write.mode("append").parquet(folder)
    kept = spark.read.schema(schema).parquet(folder).dropDuplicates(["hash"])
    return keyed.select("id", "hash").join(kept, "hash").select("id", "vec")


@dataclass(frozen=True)
class LexicalEncoder:
    """Unit TF-IDF vectors over a fixed vocabulary (X11); zero where no word is known."""

    vocabulary: tuple[str, ...]
    idf: tuple[float, ...]

    def __call__(self, texts: list[str]) -> np.ndarray:
        place, out = {w: i for i, w in enumerate(self.vocabulary)}, np.zeros((len(texts), len(self.vocabulary)))
        for row, text in zip(out, texts, strict=True):
            for word in regex.findall(TOKEN, text.lower()):
                if word in place:
                    row[place[word]] += 1
        weights = np.where(out > 0, (1 + np.log(np.maximum(out, 1))) * np.array(self.idf), 0.0)
        length = np.linalg.norm(weights, axis=1, keepdims=True)
        return weights / np.where(length > 0, length, 1)


def _told(warning: str, cause: Exception) -> str:
    """The warning, which is logged with the kind of fault alone: its message may hold what users wrote."""
    LOG.warning(f"{cause.__class__.__qualname__}: {warning}")
    return warning


@dataclass(frozen=True)
class Embedded:
    """A query's vector and the space it lies in; vectors of two spaces never meet."""

    vector: list[float]
    model: str
    fallback: bool
    warning: str | None = None


def embed_query(text: str, index_model: str, model: str, make: Callable[[], Encoder], lexical: LexicalEncoder) -> Embedded:
    """The query by the index's encoder; by the lexical one, with a warning, if the index has another or it fails."""
    try:
        if index_model != model:
            raise ValueError(f"the index is of {index_model}")
        return Embedded(encode_texts([text], make())[0].tolist(), model, False)
    except Exception as e:  # any fault of a foreign encoder
        return Embedded(lexical([text])[0].tolist(), FALLBACK, True, _told("No neural vectors: matching by words.", e))


def checked_query(text: object, most: int = QUERY_CHARS) -> str:
    """The query, if it is a text that is not blank and not too long."""
    if not isinstance(text, str) or not text.strip() or len(text) > most:
        raise ValueError(f"a query is a text of 1 to {most} characters")
    return text


def _of_kind(rows: list[dict] | None, kind: str) -> Iterator[dict]:
    return filter(lambda row: row.get("type") == kind, rows or [])


def completed_text(payload: dict) -> str:
    """The output texts of a completion, blanks between them; an error if it has not finished or says nothing."""
    if (status := payload.get("status")) != "completed":
        raise ValueError(f"the completion is {status}")
    said = chain.from_iterable(_of_kind(message.get("content"), "output_text") for message in _of_kind(payload.get("output"), "message"))
    if not (text := " ".join(piece["text"] for piece in said).strip()):
        raise ValueError("the completion is empty")
    return text


@dataclass
class Expander:
    """Query expansion by a function that the caller brings (U3); remembers the last `most` successes, never failures."""

    complete: Callable[[str], dict] | None = None
    most: int = 2048
    known: OrderedDict[str, str] = field(default_factory=OrderedDict)

    def __call__(self, text: str) -> tuple[str, str | None]:
        """The expanded text, or the text itself and a warning."""
        if text in self.known:
            self.known.move_to_end(text)
            return self.known[text], None
        try:
            if self.complete is None:
                raise ValueError("no completion is configured")
            out = completed_text(self.complete(text))
        except Exception as e:  # whatever happens out there, the query goes on; its text is not logged
            return text, _told("No expansion: matching the text as it is.", e)
        self.known[text] = out
        while len(self.known) > self.most:
            self.known.popitem(last=False)
        return out, None
