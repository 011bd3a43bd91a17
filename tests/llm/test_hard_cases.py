"""Very long texts, ties, repeated rows, clashing names, strings made to collide; estimates, links and runs against plain Python."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import _shingles, line_dedup, minhash, mixing, packing, paragraphs, projections, quality, sharding, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, size=5):
    return ["".join(rng.choice("abcdefgh") for _ in range(size)) for _ in range(n)]


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


@pytest.fixture(scope="module")
def hard(spark):
    """A text of 3 MB, the same id on two texts and twice on one, equal texts and sizes, and names that operators might use."""
    rng = random.Random(31)
    vocab = words(rng, 3000, 7)
    long = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40))) for _ in range(17_000))
    some = [" ".join(rng.choice(vocab) for _ in range(80)) for _ in range(6)]
    rows = [(1, long), (2, some[0]), (2, some[1]), (3, some[2]), (3, some[2]), (4, some[3]), (5, some[3]), (6, some[4] + " " + long[1000:1600]), (7, some[5]), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], 0) for i, t in rows], DOCS)
    names = ("_key", "_drop", "row", "gone", "i", "t", "id", "keys", "_h", "shard", "n_removed", "kept", "size", "queue", "distance", "key", "with blank", "with.dot")
    return docs.withColumns({c: F.lit("x") for c in names}), rows


def test_hard_lines(spark, hard):
    docs, rows = hard
    shared = [f"{k} a line that many documents hold, of forty characters" for k in range(4000)]
    more = spark.createDataFrame([(100 + i, "\n".join(shared + [f"own {i}"])) for i in range(5)], "doc_id long, text string")
    out = line_dedup.drop_shared_lines(docs.select("doc_id", "text", "_key", "_drop", "row", "gone", "i", "t", "with blank", "`with.dot`").unionByName(more, allowMissingColumns=True))
    assert out.columns == ["doc_id", "text", "_key", "_drop", "row", "gone", "i", "t", "with blank", "with.dot", "n_lines", "n_dropped", "kept_text"]
    got = out.collect()
    assert len(got) == len(rows) + 5 and all(r["with.dot"] == r._key == "x" for r in got if r.doc_id < 100)
    assert all((r.n_dropped, r.kept_text) == (0, r.text or "") for r in got if r.doc_id < 100)
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in got if r.doc_id >= 100} == {100 + i: (4001, 4000 if i < 4 else 0) for i in range(5)}
    assert {r.doc_id: r.kept_text for r in got if 100 <= r.doc_id < 104} == {100 + i: f"own {i}" for i in range(4)}


def test_hard_substrings(hard):
    docs, rows = hard
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(hashlib.md5(b[k : k + 400]).digest() for b in dict.fromkeys(b for _, b in raw) for k in range(0, len(b) - 399))
    twice = {b for b, n in collections.Counter(b for _, b in raw).items() if n > 1}
    want = collections.Counter()
    for i, b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 399):
            if b in twice or seen[hashlib.md5(b[k : k + 400]).digest()] > 1:
                gone[k : k + 400] = True
        want[i, len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()] += 1
    got = substrings.remove_repeats(docs).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == want and sum(k[2] > 0 for k in want) >= 3


def test_hard_rows_stay_whole(hard):
    docs, rows = hard
    ids = sorted(i for i, _ in rows)
    by_id = lambda out: sorted(r.doc_id for r in out)
    counted = quality.judge(docs).collect()
    assert by_id(counted) == ids
    assert collections.Counter((r.doc_id, r.n_words) for r in counted) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t in rows)
    near = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.mark_near_duplicates(docs).collect()}
    assert near[5, 76] == 4 and near[3, 76] == 3 and near[8, 0] == 8
    mixed = mixing.mix_sources(docs).collect()
    assert by_id(mixed) == ids and all(r.source_size == sum(len(WORD.findall(t or "")) for i, t in rows if "ab"[i % 2] == r.source) for r in mixed)
    cut = sharding.shard_documents(docs, 3).collect()
    assert by_id(cut) == ids and sorted((r.shard, r.slot) for r in cut) == [(k, j) for k in range(3) for j in range(sum(r.shard == k for r in cut))]
    assert by_id(paragraphs.remove_repeated_paragraphs(docs).collect()) == ids
    assert by_id(toxicity.score_toxicity(docs, toxicity.Lexicon({" idiot ": 3.0})).collect()) == ids
    packed = packing.pack(docs).collect()
    assert sum(r.length for r in packed) == sum({(r.doc_id, r.ids_crc32 if r.start == 0 else None, r.sequence_id, r.offset): r.doc_tokens for r in packed if r.start == 0}.values())


def test_strings_made_to_collide(spark):
    one, other = thue_morse(1024), thue_morse(1024, "b", "a")
    data = np.frombuffer(f"{one}\n{other}".encode(), dtype=np.uint8)
    assert quality.text_counts(data, np.array([0, len(data)]))[0].tolist() == [2, 2048, 0, 0, 0]
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.mark_near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    for n in (256, 400, 512, 800, 1024, 4096):
        both = np.frombuffer((thue_morse(n) + thue_morse(n, "b", "a")).encode(), dtype=np.uint8)
        names = substrings._hash(substrings.sums(both), np.array([0, n]), np.array([n, 2 * n]))
        assert names[0] != names[1]
    same = np.frombuffer(b"xyz" * 300 + b"xyz" * 300, dtype=np.uint8)
    names = substrings._hash(substrings.sums(same), np.array([0, 900, 3]), np.array([900, 1800, 902]))
    assert names[0] == names[1] != names[2]
    long = np.frombuffer(("A" * 300 + " " + "a" * 300).encode(), dtype=np.uint8)
    start, end, _ = _shingles.words(long, np.array([0, len(long)]))
    assert len(set(_shingles.string_names(long, start, end, _shingles.prefix_hash(long)).tolist())) == 1


def test_budget_is_met_as_nearly_as_can_be():
    rng = random.Random(3)
    assert sum(map(int.__mul__, (13, 22, 28, 33), mixing.fit_budget([13, 22, 28, 33], [3, 3, 4, 4], 301))) == 301
    for _ in range(500):
        lengths = sorted(rng.sample(range(40), 4))
        counts = [rng.randint(1, 9) for _ in lengths]
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = rng.randint(0, max(sums))
        take = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(take, counts, strict=True))
        assert sum(map(int.__mul__, lengths, take)) == max(s for s in sums if s <= budget)
    # beyond the knapsack's words most goes by proportion, and the rest still fits
    lengths, counts = list(range(7, 400, 3)), [rng.randint(50, 500) for _ in range(131)]
    budget = sum(map(int.__mul__, lengths, counts)) // 3
    take = mixing.fit_budget(lengths, counts, budget, dp_words=5000)
    assert sum(map(int.__mul__, lengths, take)) == budget and all(0 <= k <= c for k, c in zip(take, counts, strict=True))


def plain_estimate(x, rng):
    """Minimum covariance determinant by many random starts and exact halves."""
    h, best = int(np.ceil(quality.SUPPORT * len(x))), None
    for _ in range(60):
        own = rng.choice(len(x), 8, replace=False)
        for _ in range(30):
            mean = x[own].mean(axis=0)
            prec, _ = quality.floored(np.cov(x[own].T, bias=True) * quality.CONSISTENCY)
            near = np.argsort(np.einsum("ij,jk,ik->i", x - mean, prec, x - mean), kind="stable")[:h]
            if set(near) == set(own):
                break
            own = near
        cov = np.cov(x[own].T, bias=True) * quality.CONSISTENCY
        det = quality.floored(cov)[1]
        if best is None or det < best[0]:
            best = (det, x[own].mean(axis=0), cov)
    return best


def test_least_determinant_against_plain(spark):
    rng, rows, x = np.random.default_rng(41), [], {}
    for g, n in enumerate((199, 200, 450)):
        mix = rng.standard_normal((5, 5)) * 1.5
        own = rng.standard_normal((n, 5)) @ mix + 10 * g
        own[: n // 6] = own[: n // 6] * 0.2 + 10 * g + 25  # a cluster of outliers that the mean and covariance of all rows take in
        x[f"g{g}"] = own
        rows += [(f"g{g}", *map(float, v)) for v in own]
    schema = "key string, x0 double, x1 double, x2 double, x3 double, x4 double"
    got = {r.key: r for r in quality.least_determinants(spark.createDataFrame(rows, schema)).collect()}
    for g, own in x.items():
        det, mean, cov = plain_estimate(own, rng)
        mine = np.array(got[g]["cov"]).reshape(5, 5)
        assert got[g].n == len(own) and quality.floored(mine)[1] <= det + 0.35
        far = lambda m, c: np.einsum("ij,jk,ik->i", own - m, quality.floored(c)[0], own - m)  # noqa: E731, B023
        want, have = far(mean, cov), far(np.array(got[g].mu), mine)
        clear = np.abs(np.log(want / quality.CUTOFF)) > 0.3
        assert ((have > quality.CUTOFF) == (want > quality.CUTOFF))[clear].all() and (have[: len(own) // 6] > quality.CUTOFF).all()


def test_verdict_of_groups_over_and_under_200_rows(spark):
    rng = random.Random(42)
    text = lambda n, size=5: " ".join(words(rng, n, size))
    rows = [(1000 * g + i, text(rng.randint(80, 140)), "en", f"s{g}") for g, n in enumerate((199, 200, 320)) for i in range(n)]
    line = text(12)
    odd = [text(100, 14), " ".join(w + "#$" for w in words(rng, 100)), text(90_000), "\n".join([line] * 2 + [text(11) for _ in range(9)])]
    odd.append("\n".join([x for y in words(rng, 60, 25) for x in (y, y)]))  # lines that are nearly all copies, words in no repeated window
    rows += [(9000 + 10 * g + k, t, "en", f"s{g}") for g in range(3) for k, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[r[0]].kept for r in rows if r[0] < 9000)
    assert all(not got[9000 + 10 * g + k].kept and not got[9000 + 10 * g + k].base_failed for g in range(3) for k in (0, 1, 2))
    # each statistic can reach the cut-off by itself, at the most that the base rules leave
    assert min(0.5**0.5 / quality.FLOORS[4], 1 / quality.FLOORS[3]) ** 2 > quality.CUTOFF


@pytest.mark.parametrize("bucket, block", [(512, 1024), (64, 48)])
def test_links_of_one_large_label(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(projections, "BUCKET", bucket)
    monkeypatch.setattr(projections, "BLOCK", block)
    rng = np.random.default_rng(43)
    n, dense = (1900, 1150) if bucket == 512 else (420, 110)
    base = rng.standard_normal((n, 24))
    base[:dense] = base[0] + 0.16 * rng.standard_normal((dense, 24))  # one group over a block's size
    for i in range(dense, n - 200, 5):
        base[i + 1 : i + 4] = base[i] + 0.22 * rng.standard_normal((3, 24))
    x = base.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = np.triu(unit @ unit.T >= 0.93, 1)
    assert projections.plan_tables(n, 0.93)[0] > 0 and linked[dense:, dense:].sum() > 50
    docs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    rows = {r.vec_id: r for r in projections.link_vectors(docs).collect()}
    links = linked.sum(axis=0) + linked.sum(axis=1)
    got = np.array([rows[i].n_links for i in range(n)])
    assert (got <= links).all() and got.sum() >= 0.99 * links.sum()
    root = list(range(n))
    for a, b in zip(*np.nonzero(linked), strict=True):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        if old != new:
            root = [new if r == old else r for r in root]
    assert np.mean([rows[i].component_id == root[i] for i in range(n)]) >= 0.99


def test_paragraph_links_against_all_pairs(spark):
    rng = random.Random(44)
    rows = []
    sentences = [" ".join(words(rng, rng.randint(9, 30))) + "." for _ in range(90)]
    for i in range(60):
        own = [" ".join(words(rng, rng.randint(9, 30))) + "." for _ in range(4)]
        own[1:1] = rng.sample(sentences, 3)
        if i % 3 == 0:  # the first word of a shared sentence changed: most shingles stay
            own[2] = "changed " + own[2].split(" ", 1)[1]
        rows.append((i, "\n".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, text in rows:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        at, _, count = paragraphs.paragraph_ends(data, np.array([0, len(data)]))
        for k in range(len(count)):
            w = text.encode()[at[k] : at[k + 1]].decode().split()
            if len(w) >= paragraphs.LEAST_WORDS:
                sets[i, k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = {k: k for k in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    repeated = {k for k, v in root.items() if v != k}
    # with runs of any length, what goes whole are the repeated paragraphs and those that the words beside them take in
    out = {r.doc_id: r for r in paragraphs.remove_repeated_paragraphs(docs, run_words=1).collect()}
    assert len(repeated) > 40
    found = missed = 0
    for i, text in rows:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        at, _, _ = paragraphs.paragraph_ends(data, np.array([0, len(data)]))
        for k in (k for j, k in sets if j == i):
            stays = text.encode()[at[k] : at[k + 1]].decode().strip() in out[i].kept_text
            if (i, k) in repeated:
                found, missed = found + (not stays), missed + stays
        if not any((i, k) in repeated for k in range(100)):
            assert out[i].kept_text == text and out[i].n_removed == 0
        assert out[i].n_removed >= sum((i, k) in repeated for k in range(100)) - missed
    # five bands of two miss a pair at 0.8 once in 160
    assert missed <= 0.02 * len(repeated) and found >= 0.98 * len(repeated)


def test_two_texts_of_one_id_share_a_passage(spark):
    rng = random.Random(45)
    passage = " ".join(words(rng, 70))
    rows = [(1, passage + " " + " ".join(words(rng, 40))), (1, passage + " " + " ".join(words(rng, 40)))]
    got = paragraphs.remove_repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_spans for r in got) == [0, 1] and sum(r.kept_text in (t for _, t in rows) for r in got) == 1


def test_ids_of_special_tokens(spark):
    from tokenizers import Tokenizer

    import public_tokenizers as files

    t = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    added = [x.content for x in t.get_added_tokens_decoder().values()]
    texts = ["a <|endoftext|> b", "plain", f"{added[0]}{added[0]}x", "<|endof text|>", "<|ENDOFTEXT|>"]
    docs = spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.ids_crc32 for r in packing.pack(docs).collect()}
    assert got == {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()) for i, x in enumerate(texts)}


def test_windows_follow_weights(spark):
    # three sources of 900, 900 and 300 documents at weights 1, 3, 2: the third ends, then the others go on at 1 to 3
    n = {"a": 900, "b": 900, None: 300}
    docs = spark.createDataFrame([(1000 * k + i, "one two three four five six seven", s) for k, (s, m) in enumerate(n.items()) for i in range(m)], "doc_id long, text string, source string")
    rows = packing.pack(docs.repartition(5), window=600, weights={"a": 1, "b": 3, None: 2}).collect()
    each = next(r.doc_tokens for r in rows)
    total, stream = each * 2100, np.full(each * 2100, -1)
    for r in rows:
        at = 1024 * r.sequence_id + r.offset
        assert (stream[at : at + r.length] == -1).all()
        stream[at : at + r.length] = r.doc_id // 1000
    assert (stream >= 0).all()
    # None ends first, after 900 documents, and b after 1,500
    first = stream[: 900 * each // 600 * 600].reshape(-1, 600)
    assert all(np.abs(np.bincount(w, minlength=3) - (100, 300, 200)).max() <= 2 for w in first)
    late = stream[-(-900 * each // 600) * 600 + 600 : 1500 * each - 600]
    late = late[: len(late) // 600 * 600].reshape(-1, 600)
    assert all(np.abs(np.bincount(w, minlength=3) - (150, 450, 0)).max() <= 3 for w in late) and (stream[-600:] == 0).all() and total == len(stream)
    with pytest.raises(ValueError, match="b"):
        packing.pack(docs, weights={"a": 1, None: 2})


def test_cuts_are_as_equal_as_the_least_capacity_allows():
    assert sharding.minimax_cuts([1] * 12, 5) in ([2, 5, 7, 10], [2, 5, 7, 9], [3, 5, 7, 10])
    rng = random.Random(46)
    for _ in range(300):
        sizes, k = [rng.randint(0, 9) for _ in range(rng.randint(1, 9))], rng.randint(1, 4)
        cuts = [0, *sharding.minimax_cuts(sizes, k), len(sizes)]
        assert cuts == sorted(cuts)
        every = [[0, *c, len(sizes)] for c in itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1)]
        most = lambda c: max(sum(sizes[a:b]) for a, b in itertools.pairwise(c))  # noqa: B023, E731
        assert most(cuts) == min(map(most, every))


def test_cuts_part_single_groups(spark, monkeypatch):
    rng = random.Random(47)
    rows = [(i, "x" * rng.randint(0, 300) + str(i // 2)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loads = {}
    for bits in (2, 16):
        monkeypatch.setattr(sharding, "UNIT_BITS", bits)
        got = sharding.shard_documents(docs, 7).collect()
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
        loads[bits] = [sum(r["size"] for r in by[k]) for k in range(7)]
    largest = max(len(t) + 16 for _, t in rows)
    # four units of a hundred texts each are parted as finely as 65,536
    assert max(loads[2]) <= sum(loads[2]) / 7 + 2 * largest and max(loads[2]) - min(loads[2]) <= 4 * largest and max(loads[16]) <= max(loads[2])


def test_lexicon_against_plain_search():
    rng = random.Random(48)
    lexicon = toxicity.Lexicon({" abc ": 2.0, " abcde": 1.5, " bca ": 3.0, " c ": 0.5, " ab": 0.25}, [" abc bca ", " c c "])
    a = lexicon.automaton()
    for _ in range(300):
        text = " ".join(rng.choice(["abc", "abcdef", "bca", "c", "ab", "zz", "ABC", "a8c", "4bc"]) for _ in range(rng.randint(0, 30)))
        folded, hits, spared = toxicity.fold(text), {}, []
        for k, w in lexicon.weights.items():
            for at in range(len(folded)):
                if folded.startswith(k, at):
                    hits[at] = max(w, hits.get(at, w))
        for k in lexicon.exceptions:
            spared += [range(at, at + len(k) - 1) for at in range(len(folded)) if folded.startswith(k, at)]
        total = sum(w for at, w in hits.items() if not any(at in r for r in spared))
        assert lexicon.strength(a, text) == pytest.approx(total / (1 + folded.count(" ") / 400) ** 0.5)


def test_pipeline_against_its_stages(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(49)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    common = "A line that every one of these documents holds somewhere"
    texts = ["\n".join([" ".join(words(rng, rng.randint(30, 50))), common, " ".join(words(rng, rng.randint(30, 50)))]) for _ in range(120)]
    texts += [t.replace(t.split()[40], "changed", 1) for t in texts[:10]] + [texts[20]] * 3 + ["too short", "", None, "same again " * 60]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = [docs]
    for _, stage in p.STAGES:
        steps.append(stage(spark, steps[-1], str(tmp_path)).persist())
    judged, lined, single, mixed, packed = (x.collect() for x in steps[1:])
    assert {r.doc_id for r in judged} == set(range(133))  # clean prose stays, the four others go
    held = collections.Counter(x.strip().translate(low) for r in judged for x in set(r.text.split("\n")))
    last = {k: max(r.doc_id for r in judged if k in r.text.translate(low).split("\n")) for k, n in held.items() if n >= 5 and len(k) >= 40}
    cut = {r.doc_id: "\n".join(x for x in r.text.split("\n") if last.get(x.translate(low), r.doc_id) == r.doc_id) for r in judged}
    assert common.translate(low) in last and {r.doc_id: r.text for r in lined} == cut and all(r.n_chars == len(r.text) for r in lined)
    sets = {i: {tuple(t.translate(low).split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in cut.items()}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    assert {r.doc_id for r in single} == {i for i in root if root[i] == i} and len(single) < 133
    want = {(r.doc_id, r.taken // r["size"]) for r in mixing.mix_sources(steps[3]).collect() if r.taken}
    copies = collections.Counter(r.doc_id for r in mixed)
    assert set(copies.items()) == want and all(n <= 2 for n in copies.values())
    encode = packing.Encoder()
    tokens = {r.doc_id: len(encode(r.text)) + 1 for r in mixed}
    assert sum(r.length for r in packed) == sum(tokens[i] * n for i, n in copies.items()) and {r.doc_id: r.doc_tokens for r in packed} == tokens
    at = sorted((1024 * r.sequence_id + r.offset, r.length) for r in packed)
    assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(at))
    # places depend on the files that a stage wrote, the documents and their tokens do not
    whole = lambda rows: (collections.Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0), sum(r.length for r in rows))
    assert whole(p.run(spark, str(tmp_path)).collect()) == whole(packed)


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
