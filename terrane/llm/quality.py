"""Quality rules: fixed rules, then robust multivariate outliers per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm._common import drop_table, load, table
from terrane.llm._shingles import mix, pieces, prefix_hash, string_names, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Every byte its own value, as the counts compare words exactly.
_EXACT = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.random.Generator(np.random.PCG64(6)).integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

FEATURES = 5
#: Share of a group's documents that the estimate rests on, most concentration steps, rows that the estimate one
#: level up counts as: ten for each statistic.
SUPPORT, STEPS, PRIOR = 0.75, 12, 50
#: Change of the logarithm of a determinant under which a start has settled.
SETTLED = 1e-6
#: Least standard deviation of each transformed statistic: what differs by less is no outlier.
FLOORS = (0.7, 0.08, 0.25, 0.15, 0.11)
#: Squared distances beyond the chi-squared quantile 1 - 1e-6 at 5 degrees of freedom are outliers. Each statistic
#: can reach it by itself.
CUTOFF = 35.888
#: The chi-squared quantile at 5 degrees of freedom that SUPPORT of a normal sample lies under, and the
#: factor by which the covariance of that part falls short.
CHI_SUPPORT, CONSISTENCY = 6.6257, 0.75 / 0.5213
#: Bins of the logarithm of the squared distance.
BINS, BIN_STEP, BIN_LOW = 192, 0.0625, -4.0


def _repeats(lines: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True where an equal (owner, value) stands earlier."""
    order = np.lexsort((np.arange(len(lines)), lines, owner))
    same = np.zeros(len(lines), dtype=bool)
    if len(lines) > 1:
        a, b = order[:-1], order[1:]
        same[b] = (lines[a] == lines[b]) & (owner[a] == owner[b])
    return same


def text_counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of COUNTS for each text of a run of UTF-8 texts."""
    n = len(ends) - 1
    out = np.zeros((n, len(COUNTS)), dtype=np.int64)
    start, end, owner = words(data, ends)
    if not len(data):
        return out
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[ends])
    blank = np.isin(data, np.array([9, 10, 11, 12, 13, 32], dtype=np.uint8))
    out[:, 0] = np.bincount(owner, minlength=n)
    out[:, 1] = per(~blank & ((data & 0xC0) != 0x80))
    out[:, 2] = per(_SYMBOL[data])
    if not len(start):
        return out
    total = prefix_hash(data, _EXACT)
    # lines: between feeds and text ends
    feeds = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate([ends[:-1], feeds + 1]))
    first = first[first < len(data)]
    last = np.concatenate([first[1:], [len(data)]])
    last = last - (data[last - 1] == 10)
    solid = np.concatenate([[0], np.cumsum(~blank)])
    real = (last > first) & (solid[np.maximum(last, first)] > solid[first])
    first, last = first[real], last[real]
    named = string_names(data, first, last, total, lower=False)
    of = np.searchsorted(ends, first, side="right") - 1
    out[:, 3] = np.bincount(of[_repeats(named, of)], minlength=n)
    # windows of three words
    if len(start) >= 3:
        word = string_names(data, start, end, total, lower=False)
        three = mix(word[:-2] * _ODD[0] + word[1:-1] * _ODD[1] + word[2:] * _ODD[2])
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        value, own = three[inside], owner[inside]
        order = np.lexsort((value, own))
        v, o = value[order], own[order]
        same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
        twice = np.zeros(len(v), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        hit = np.zeros(len(start), dtype=bool)
        for j in range(3):
            hit[at + j] = True
        out[:, 4] = np.bincount(owner[hit], minlength=n)
    return out


def _counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in (*COUNTS, "n_lines")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, ends in pieces(batch.column("text")):
                got = text_counts(data, ends)
                feeds = np.diff(np.concatenate([[0], np.cumsum(data == 10)])[ends]) + 1
                kept = [batch.column(c).slice(first, last - first) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(got[:, i]) for i in range(len(COUNTS))], pa.array(feeds.astype(np.int64))], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _features() -> list[Column]:
    """Length, word length, symbols per character, repeated lines, repeated words; each made near symmetric."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.log1p(n.cast("double")),
        F.log(chars / F.greatest(n, F.lit(1)) + F.lit(1e-9)),
        F.log1p(100.0 * F.col("n_symbols") / F.greatest(chars, F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
        F.sqrt(F.col("n_repeat_words") / F.greatest(n, F.lit(1))),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance by the columns mu (5) and prec (25, by rows)."""
    d = [F.col(f"x{i}") - F.get("mu", F.lit(i)) for i in range(FEATURES)]
    return sum((d[i] * d[j] * F.get("prec", F.lit(i * FEATURES + j)) for i in range(FEATURES) for j in range(FEATURES)), F.lit(0.0))


def floored(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Precision and log determinant of a covariance whose least variances are raised, in units of the floors.

    So the estimate stays invertible where a statistic hardly varies or a group has few rows.
    """
    unit = 1 / np.array(FLOORS)
    value, vector = np.linalg.eigh(cov * np.outer(unit, unit))
    value = np.maximum(value, 1.0)
    return (vector / value) @ vector.T * np.outer(unit, unit), float(np.log(value).sum())


_MOMENTS = [f"s{i}" for i in range(FEATURES)] + [f"q{i}{j}" for i in range(FEATURES) for j in range(i, FEATURES)]


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(FEATURES)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(FEATURES) for j in range(i, FEATURES)]]


def _mean_cov(n: float, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From a count and _MOMENTS."""
    mean, cov = sums[:FEATURES] / n, np.empty((FEATURES, FEATURES))
    upper = np.triu_indices(FEATURES)
    cov[upper] = sums[FEATURES:] / n
    cov.T[upper] = cov[upper]
    return mean, cov - np.outer(mean, mean)


_ESTIMATE = "key string, start int, n long, mu array<double>, cov array<double>, prec array<double>, logdet double"


def _estimate_row(key: str, start: int, n: int, mean: np.ndarray, cov: np.ndarray) -> dict:
    prec, logdet = floored(cov)
    return {"key": key, "start": start, "n": n, "mu": np.round(mean, 9).tolist(), "cov": np.round(cov.ravel(), 9).tolist(), "prec": np.round(prec.ravel(), 9).tolist(), "logdet": round(logdet, 9)}


def _concentrated(pdf: pd.DataFrame) -> pd.DataFrame:
    """The estimate of the nearest SUPPORT of a group's rows, from the moments of its distance bins: of the last bin the part that is missing."""
    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy(dtype=float)
    want = SUPPORT * n.sum()
    part = np.clip((want - (np.cumsum(n) - n)) / n, 0, 1)
    mean, cov = _mean_cov(want, part @ pdf[_MOMENTS].to_numpy())
    return pd.DataFrame([_estimate_row(pdf["key"].iloc[0], int(pdf["start"].iloc[0]), int(n.sum()), mean, cov * CONSISTENCY)])


def _starts(rows: DataFrame) -> DataFrame:
    """Three starts for each key: medians and quartile spreads; mean and covariance of all rows; medians and the covariance of squashed deviations."""
    mid = rows.groupBy("key").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"m{i}") for i in range(FEATURES)])
    spread = F.array(*[F.greatest((F.col(f"m{i}")[2] - F.col(f"m{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in range(FEATURES)])
    mid = table(mid.select("key", F.array(*[F.col(f"m{i}")[1] for i in range(FEATURES)]).alias("m"), spread.alias("spread")), "middles")
    squashed = rows.join(mid, "key").select("key", "m", "spread", *[F.tanh((F.col(f"x{i}") - F.get("m", F.lit(i))) / F.get("spread", F.lit(i))).alias(f"x{i}") for i in range(FEATURES)])
    plain = rows.groupBy("key").agg(*_moments()).withColumns({"m": F.lit(None).cast("array<double>"), "spread": F.lit(None).cast("array<double>")})
    both = plain.select("key", "m", "spread", "n", *_MOMENTS).unionAll(squashed.groupBy("key").agg(F.first("m").alias("m"), F.first("spread").alias("spread"), *_moments()).select("key", "m", "spread", "n", *_MOMENTS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row, sums in zip(pdf.itertuples(), pdf[_MOMENTS].to_numpy(dtype=float), strict=True):
                mean, cov = _mean_cov(row.n, sums)
                if row.m is None:
                    out.append(_estimate_row(row.key, 1, row.n, mean, cov))
                else:
                    m, spread = np.array(row.m), np.array(row.spread)
                    out.append(_estimate_row(row.key, 0, row.n, m, np.diag(spread**2)))
                    out.append(_estimate_row(row.key, 2, row.n, m, cov * np.outer(spread, spread)))
            yield pd.DataFrame(out, columns=["key", "start", "n", "mu", "cov", "prec", "logdet"])

    return table(both.mapInPandas(run, _ESTIMATE), "estimates")


def least_determinants(rows: DataFrame) -> DataFrame:
    """rows(key, x0..x4) -> key, n, mu, cov: of the nearest SUPPORT of each key's rows around an estimate that they give themselves.

    From every start, concentration steps go on until no determinant changes; the start of the least determinant
    counts. A step is one aggregation with map-side combine for all keys and starts: moments per distance bin (192 at
    most); the nearest share is a run of bins, so no group is ever sorted or collected.
    """
    est = _starts(rows)
    for _ in range(STEPS):
        binned = rows.join(est.select("key", "start", "mu", "prec"), "key").withColumn("bin", F.floor((F.log(F.greatest(_distance(), F.lit(1e-6))) - BIN_LOW) / BIN_STEP))
        binned = binned.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.col("bin"))))
        new = table(binned.groupBy("key", "start", "bin").agg(*_moments()).groupBy("key", "start").applyInPandas(_concentrated, _ESTIMATE), "estimates")
        moved = new.join(est.select("key", "start", F.col("logdet").alias("old")), ["key", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("old")))).first()[0]
        drop_table(est)
        est = new
        if moved is None or moved < SETTLED:
            break
    return est.groupBy("key").agg(F.min_by(F.struct("n", "mu", "cov"), F.struct("logdet", "start")).alias("e")).select("key", "e.*")


def blend(n: int, mean: np.ndarray, cov: np.ndarray, mean0: np.ndarray, cov0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a group's n rows and of PRIOR rows that are spread as one level up."""
    w, apart = n / (n + PRIOR), mean - mean0
    return mean0 + w * apart, w * cov + (1 - w) * cov0 + w * (1 - w) * np.outer(apart, apart)


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs with doc_id, text, lang, source -> doc_id, lang, source, the five counts, base_failed, distance, kept.

    A text with fewer than 50 words, or with more than half its words in repeated windows, fails the base
    rules (null and empty texts do). The others are described by five transformed statistics; each group of
    one lang and source gets a minimum-covariance-determinant estimate of SUPPORT of its rows. Rows with a squared
    Mahalanobis distance above `cutoff` are rejected. Nulls in lang or source are values of their own. Each group's
    estimate is drawn towards that of its language, and a language's towards that of all rows, which count as 50
    rows more: smoothly less the larger the group is, at any size. Equal rows, repeated ids among them, are judged
    alike; other columns are not read. An empty table gives an empty result.
    """
    base = _counted(docs.select("doc_id", "lang", "source", "text"), ["doc_id", "lang", "source"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = base.withColumn("base_failed", failed)
    base = base.withColumns({f"x{i}": x for i, x in enumerate(_features())})
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    levels = [F.lit("[]"), F.to_json(F.array(named("lang"))), F.to_json(F.array(named("lang"), named("source")))]
    base = table(base.withColumn("levels", F.array(*levels)), "counts")
    fit = base.filter("not base_failed").select(F.explode("levels").alias("key"), *[f"x{i}" for i in range(FEATURES)])
    est = table(least_determinants(fit), "least")
    groups = base.filter("not base_failed").select("levels").distinct()
    for k, name in enumerate(("all", "tongue", "own")):
        one = est.select(F.col("key").alias(name), F.struct("n", "mu", "cov").alias(f"e{k}"))
        groups = groups.withColumn(name, F.get("levels", F.lit(k))).join(one, name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square = lambda e: (e["n"], np.array(e["mu"]), np.array(e["cov"]).reshape(FEATURES, FEATURES))
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                _, *now = square(row.e0)
                for e in (row.e1, row.e2):
                    now = blend(*square(e), *now)
                out.append({"own": row.own, "mu": np.round(now[0], 9).tolist(), "prec": np.round(floored(now[1])[0].ravel(), 9).tolist()})
            yield pd.DataFrame(out, columns=["own", "mu", "prec"])

    final = table(groups.select("own", "e0", "e1", "e2").mapInPandas(run, "own string, mu array<double>, prec array<double>"), "estimates")
    out = base.withColumn("own", F.get("levels", F.lit(2))).join(final, "own", "left").withColumn("distance", F.round(_distance(), 6))
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= cutoff))
    return out.select("doc_id", "lang", "source", *COUNTS, "base_failed", "distance", kept.alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept."""
    out = judge(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")
