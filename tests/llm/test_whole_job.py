"""Cases in which operators once did less than the whole job."""

from __future__ import annotations

import random

from terrane.llm import packing, paragraphs, quality


def _prose(rng, n):
    """Sentences of 12 to 18 words."""
    out = []
    while len(out) < n:
        out += ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(12, 18))]
        out[-1] += "."
    return out[:n]


def test_passages_at_random_offsets(spark):
    rng = random.Random(21)
    rows, planted = [], []
    for n in range(51, 81):
        for verse in (False, True):
            passage = _prose(rng, n + 30)[rng.randrange(30) :][:n]
            if verse:
                passage = [w.strip(".") + (",\n" if j % 5 == 4 else "") for j, w in enumerate(passage)]
            key = len(rows)
            for i in (key, key + 1):
                host, at = _prose(rng, 150), rng.randrange(150)
                rows.append((i, " ".join([*host[:at], *passage, *host[at:]])))
            planted.append((key, key + 1, passage, " ".join([*host[:at], *host[at:]]).split()))
    got = {r.doc_id: r for r in paragraphs.remove_repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a].kept_text == rows[a][1] for a, _, _, _ in planted)
    whole = sum(got[b].originals == [a] and got[b].kept_text.split() == host for a, b, _, host in planted)
    assert whole >= 0.9 * len(planted)


def test_every_source_has_its_own_estimate(spark):
    rng = random.Random(22)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    text = lambda long, marks: " ".join(word(long) + ("#" if rng.random() < marks else "") for _ in range(rng.randint(80, 120)))
    # 150 rows of a profile of its own beside eight like sources of 150: all under 200
    rows = [(1000 * s + i, text(5, 0.0), "de", f"s{s}") for s in range(8) for i in range(150)]
    rows += [(9000 + i, text(11, 0.9), "de", "code") for i in range(150)] + [(9999, text(5, 0.0), "de", "code")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[r[0]].kept for r in rows if r[0] != 9999)
    assert got[9999].distance > got[1].distance * 5


def test_pipeline_drops_copies_at_82_percent(spark):
    import corpus_pipeline

    rng = random.Random(23)
    words = [f"w{rng.randrange(10**9)}" for _ in range(104)]
    other = [*words]
    other[30], other[70] = "changed", "too"  # 90 of 110 shingles in common
    rows = [(1, " ".join(words), "en", "a", 0), (2, " ".join(other), "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]


def test_more_than_a_thousand_labels(spark, tmp_path):
    from terrane.plans import queries

    rng, n = random.Random(24), 1005
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], i) for i in range(n)]
    rows = [(i, [x / sum(y * y for y in v) ** 0.5 for x in v], k) for i, v, k in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.label_centroids(spark, str(tmp_path)).select("label").distinct().count() == n
    assert all(r.theme == r.id for r in queries.nearest_theme(spark, str(tmp_path)).collect())


def test_windows_hold_every_source_in_proportion(spark):
    # 300 sources of 40 equal documents, source by source
    n, window = 300, 4096
    docs = spark.createDataFrame([(40 * s + i, "one two three four five six seven", f"s{s:03}") for s in range(n) for i in range(40)], "doc_id long, text string, source string")
    rows = packing.pack(docs.coalesce(1), window=window).collect()
    total = sum(r.length for r in rows)
    half = [0] * n
    for r in rows:
        half[r.doc_id // 40] += max(0, min(r.length, total // 2 - (1024 * r.sequence_id + r.offset)))
    # in half of the stream every source has half of its tokens, up to a window's share
    share = total / n
    assert all(abs(h - share / 2) <= window / n + 1 for h in half)
    at = sorted((1024 * r.sequence_id + r.offset, r.length) for r in rows)
    assert all(a + k == b for (a, k), (b, _) in zip(at, at[1:], strict=False))
