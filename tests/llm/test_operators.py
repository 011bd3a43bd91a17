"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import line_dedup, minhash, mixing, packing, paragraphs, projections, quality, registry, sharding, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", "", ".", "\n"]) for _ in range(k))
    shared = text(120)
    rows = []
    for i in range(n):
        t = text(rng.randint(60, 200))
        if i % 6 == 0:
            t += " " + shared + " " + text(30)
        rows.append((i, t, rng.choice(["en", "de"]), rng.choice(["a", "b", "c"]), len(t)))
    for i in range(n, n + 10):  # near copies
        w = rows[i - n][1].split(" ")
        w[len(w) // 2] = "changed"
        t = " ".join(w)
        rows.append((i, t, "en", "a", len(t)))
    rows += [(n + 10 + i, rows[3][1], "en", None, 0) for i in range(4)]
    rows += [(n + 14, None, None, None, None), (n + 15, "", "en", "a", 0), (n + 16, " \n\t ", "en", "b", 4), (n + 17, "x", "en", "b", 1), (None, "no id here", "en", "c", 10)]
    rows += [(n + 18, "é" * 700, "fr", "c", 700), (n + 19, "a" * 1500, "fr", "c", 1500)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumn("size", F.lit(1)).withColumn("kept", F.lit("x")).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, empty):
    assert line_dedup.drop_shared_lines(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert quality.judge(empty).count() == 0
    assert minhash.mark_near_duplicates(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert paragraphs.remove_repeated_paragraphs(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(empty, toxicity.learn(empty, labels)).count() == 0
    assert projections.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_line_dedup(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(" \t\n\x0b\x0c\r")
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(-1 if i is None else i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    for r in line_dedup.drop_shared_lines(docs).collect():
        lines = (r.text or "").split("\n")
        left = [x for x in lines if not (key(x) in gone and gone[key(x)] != (-1 if r.doc_id is None else r.doc_id))]
        assert (r.n_lines, r.n_dropped, r.kept_text) == (len(lines), len(lines) - len(left), "\n".join(left))


def test_minimax_cuts():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(0, 30) for _ in range(rng.randint(1, 9))]
        k = rng.randint(1, 4)

        def best(s, k):
            return sum(s) if k == 1 else min(max(sum(s[:i]), best(s[i:], k - 1)) for i in range(len(s) + 1))

        cuts = [0, *sharding.minimax_cuts(sizes, k), len(sizes)]
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) == best(sizes, k)


def test_sharding(docs):
    rows = sharding.shard_documents(docs, 5).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    of = collections.defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        of[texts[r.doc_id]].add(r.shard)
    assert len(rows) == len(texts) and all(len(s) == 1 for s in of.values())
    for k in range(5):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_fit_budget():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.sample(range(0, 40), 6))
        counts = [rng.randint(1, 3) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        budget = rng.randint(0, total)
        take = mixing.fit_budget(lengths, counts, budget)
        got = sum(n * k for n, k in zip(lengths, take, strict=True))
        assert all(0 <= k <= c for k, c in zip(take, counts, strict=True)) and budget - 40 < got <= budget


def test_mixing(docs):
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r.doc_id] or "")) and r.taken in (0, r["size"], 2 * r["size"])
        by[r.source].append(r)
    total = sum(r["size"] for r in rows)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(r["size"] for r in by[s]) for s in by}
    want, open_, left = {}, set(order), 1.5 * total
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            want[s] = 2.0 * size[s]
            left -= want[s]
        open_ -= full
    for s, own in by.items():
        assert own[0].source_size == size[s] and own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 40


def test_quality_counts(docs):
    for r in quality.judge(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        t = r.text or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_near_duplicates(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r.text or "").translate(low))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    order = sorted(sets, key=lambda i: -1 if i is None else i)
    root = {i: i for i in order}
    for a in order:
        for b in order:
            if order.index(a) < order.index(b) and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = root[b], root[a]
                root = {k: new if v == old else v for k, v in root.items()}
    for r in minhash.mark_near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id])
        assert r.doc_id is None or r.kept == (r.doc_id == r.component_id)


def test_substrings(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = collections.Counter(b[i : i + 400] for _, b in rows for i in range(len(b) - 399))
    want = {}
    for k, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want[k] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(docs).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_paragraphs(spark, docs):
    rng = random.Random(8)
    text = lambda k: " ".join(" ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(rng.randint(8, 15))) + "." for _ in range(k))
    shared, rows = text(6), []
    for i in range(40):
        host = text(8).split(" ")
        cut = rng.randrange(len(host))
        rows.append((i, " ".join([*host[:cut], shared, *host[cut:]]) if i % 5 == 0 else " ".join(host)))
    rows += [(50, rows[1][1]), (51, None), (52, ""), (None, "no id here")]
    got = {r.doc_id: r for r in paragraphs.remove_repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {r[0] for r in rows}
    removed = {i for i in got if got[i].n_removed}
    assert removed == {5, 10, 15, 20, 25, 30, 35, 50} and all(got[i].originals == [0] for i in removed - {50})
    assert got[50].originals == [1] and got[50].kept_text == ""
    assert all(got[i].kept_text == (t or "") for i, t in rows if i not in removed)
    assert paragraphs.remove_repeated_paragraphs(docs).count() == docs.count()


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    vecs = [*base, *(base[:15] + 0.08 * rng.standard_normal((15, 16))), base[0], base[0]]
    rows = [(i, [float(x) for x in v], int(i % 3 if i < 40 else i % 40 % 3)) for i, v in enumerate(vecs)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [None] * 16, 1), (104, rows[0][1], None), (105, [1.0, 2.0], 0)]
    links, root = collections.Counter(), {r[0]: r[0] for r in rows}
    f32 = lambda v: np.array(v, dtype=np.float32).astype(float)
    for a in rows[:57]:
        for b in rows[:57]:
            x, y = f32(a[1]), f32(b[1])
            if a[0] < b[0] and a[2] == b[2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a[0]] += 1
                links[b[0]] += 1
                old, new = max(root[a[0]], root[b[0]]), min(root[a[0]], root[b[0]])
                root = {k: new if v == old else v for k, v in root.items()}
    got = projections.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {r[0]: (links[r[0]], root[r[0]]) for r in rows}


def test_packing(docs):
    from tokenizers import Tokenizer

    import public_tokenizers as files

    t = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in docs.collect()}
    rows = packing.pack(docs, window=4096).collect()
    for k, own in ids.items():
        pieces = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]] and sum(r.length for r in pieces) == len(own)
        assert all(r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes()) for r in pieces)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for k, parts in by.items():
        parts.sort()
        assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1]]
        assert sum(p[1] for p in parts) == 1024 or k == max(by)


def test_toxicity(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(vocab) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            w[10], w[30] = rng.choice([("Zorgon", "zorg0n"), ("zоrgоn", "zorgon"), ("zorgon", "ZORGON")])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(400, None), (401, ""), (None, "zorgon zorgon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([*labels, (1000, 1), (2, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, lexicon).collect()}
    for i, y in labels:
        assert got[i].predicted == y and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert got[400].score == got[401].score < 0.5 and got[None].predicted == 1
    lexicon.exceptions.append(" zorgon day ")
    assert lexicon.strength(lexicon.automaton(), "zorgon day") == 0 < lexicon.strength(lexicon.automaton(), "zorgon night")


def test_fold():
    assert toxicity.fold("1D10T! іdiоt") == " idiot  idiot "


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, sf)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(corpus(40), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_documents_without_ids(spark):
    import corpus_pipeline as p

    rng = random.Random(9)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(90)) for _ in range(3)]
    rows = [(None, t, "en", "a", 0) for t in [*clean, clean[0], clean[1] + " end", "too short"]] + [(7, clean[2] + " more", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    judged = p.quality_rules(spark, docs, "")
    assert sorted(r.text for r in judged.collect()) == sorted(r[1] for r in rows if r[1] != "too short")
    left = [r.text for r in p.near_dedup(spark, judged, "").collect()]
    assert left.count(clean[0]) == 1 and len({clean[1], rows[4][1]} & set(left)) == 1 and len({clean[2], rows[6][1]} & set(left)) == 1 and len(left) == 3
    assert p.mixing(spark, judged, "").count() > 0


def test_kept_hash(spark):
    text = "short line\nother"
    out = line_dedup.drop_shared_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert hashlib.sha256(out.kept_text.encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
