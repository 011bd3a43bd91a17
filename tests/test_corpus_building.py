"""Paged sources, corpus building, encoders and matching on small exact fixtures."""

import json
import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from terrane.functions import text as X
from terrane.operators import corpus, encode, ingest, matching, people
from terrane.sources.pages import Responses, Retry, page_source

# workers cannot import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SITE = "https://ids.example/"


def work(n, title, authors, year=2000, awards=(), field="Physics", index=None, ours="I1"):
    return {
        "id": f"{SITE}W{n}", "doi": "", "title": title, "publication_year": year, "publication_date": f"{year}-01-02",
        "primary_location": {"landing_page_url": f"https://p.example/{n}", "source": {"display_name": "Venue"}},
        "authorships": [{"author": {"id": f"{SITE}{a}", "display_name": f" {name} "}, "institutions": [{"id": f"{SITE}{ours if a[0] == 'A' else 'I2'}"}]} for a, name in authors],
        "abstract_inverted_index": index, "primary_topic": {"field": {"display_name": field}} if field else None, "awards": list(awards),
    }


WORKS = [
    work(1, "First work on light", [("A1", "Ada Bee"), ("A2", "Cy Dee"), ("B1", "Other Place")], awards=[{"award_id": "G7", "funder_id": f"{SITE}F1", "funder_display_name": "Fund"}, {}]),
    work(2, "Second work", [("A2", "Cy Renamed"), ("A1", "Ada Bee"), ("A2", "Cy Dee")], 2003, field=None, index={"so": [1], "and": [0, 2]}),
    work(3, "  ", [("A1", "Ada Bee")]),
    work(4, "Nobody here", [("B1", "Other Place")]),
    work(1, "First work, corrected", [("A1", "Ada Bee"), ("A3", "Ed Eff")], 2001, awards=[{"id": f"{SITE}G7", "funder_id": f"{SITE}F1", "title": "late"}, {"funder": "Solo"}]),
]


class Site:
    """Pages of two works; the first answer of every page asks to come back."""

    def __init__(self):
        self.asked = []

    def __call__(self, url):
        self.asked.append(url)
        if self.asked.count(url) == 1:
            return 429, {"retry-after": "3"}, ""
        at = 0 if url.endswith("*") else int(url.rsplit("=", 1)[1])
        more = at + 2 < len(WORKS)
        return 200, {}, json.dumps({"results": WORKS[at : at + 2], "meta": {"next_cursor": str(at + 2) if more else None}})


def responses(folder):
    return Responses(str(folder), Site(), Retry(sleep=lambda s: None, pause=(0, 0)))


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    spark.dataSource.register(page_source("landed_pages", lambda scope, cursor: f"x://w?cursor={cursor}", responses(tmp_path_factory.mktemp("pages"))))
    raw = spark.read.format("landed_pages").load()
    return raw.withColumn("w", F.from_json("value", corpus.WORK)).select("page", "w.*")


@pytest.fixture(scope="module")
def works(spark):
    rows = spark.createDataFrame([(i, json.dumps(w)) for i, w in enumerate(WORKS)], "seq int, value string")
    return corpus.accepted(rows.withColumn("w", F.from_json("value", corpus.WORK)).select("seq", "w.*"), "I1", SITE)


def test_pages(landed):
    assert [(r.page, r.id) for r in landed.collect()] == [(i // 2 + 1, w["id"]) for i, w in enumerate(WORKS)]


def test_pages_as_stream(spark, tmp_path):
    spark.dataSource.register(page_source("streamed_pages", lambda scope, cursor: f"x://w?cursor={cursor}", responses(tmp_path / "c"), most=2))
    q = spark.readStream.format("streamed_pages").load().writeStream.format("memory").queryName("streamed").trigger(processingTime="0 seconds").start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.table("streamed").count() >= 4:
                break
        assert sorted(r.page for r in spark.table("streamed").collect()) == [1, 1, 2, 2]
    finally:
        q.stop()


def test_retry_and_cache(tmp_path):
    waits, site = [], Site()
    get = Responses(str(tmp_path / "c"), site, Retry(sleep=waits.append, pause=(1, 1)))
    assert get("x://w?cursor=*") == get("x://w?cursor=*") and len(site.asked) == 2 and waits == [3.0, 1]
    tries = []
    with pytest.raises(RuntimeError):
        Retry(sleep=tries.append).get(lambda u: (503, {}, ""), "x")
    assert len(tries) == 6 and all(2**n <= t <= 2**n + 0.5 for n, t in enumerate(tries))
    with pytest.raises(RuntimeError):
        Retry(sleep=tries.append).get(lambda u: (404, {}, ""), "x")


def test_publications_and_people(works):
    got = {r.work: r for r in corpus.publications(works).collect()}
    assert set(got) == {"W1", "W2"}
    one, two = got["W1"], got["W2"]
    assert (one.title, one.year, one.author_ids, one.place, one.abstract, one.url) == ("First work, corrected", 2001, ["A1", "A3"], 0, None, "https://p.example/1")
    assert (two.author_ids, two.abstract, two.place) == (["A2", "A1"], "and so and", 1)
    folk = {r.author: (r["name"], r.departments) for r in corpus.people(works).collect()}
    assert folk == {"A1": ("Ada Bee", ["Interdisciplinary Research", "Physics"]), "A2": ("Cy Dee", ["Interdisciplinary Research", "Physics"]), "A3": ("Ed Eff", ["Physics"])}
    assert [(r.work, r.author, r.pos) for r in corpus.authorship(works.filter("work = 'W2'")).collect()] == [("W2", "A2", 1), ("W2", "A1", 2)]


def test_department(spark):
    rows = spark.createDataFrame([(i, json.dumps(w)) for i, w in enumerate(WORKS)], "seq int, value string").withColumn("w", F.from_json("value", corpus.WORK)).select("seq", "w.*")
    assert [r.work for r in corpus.accepted(rows, "I1", SITE, corpus.NO_FIELD).collect()] == ["W2"]


def test_projects(works):
    got = {r.project: r for r in corpus.projects(corpus.grants(works, SITE, "the index")).collect()}
    assert set(got) == {"grant-F1-G7", "grant-Solo-W1"}
    a, b = got["grant-F1-G7"], got["grant-Solo-W1"]
    assert (a.title, a.funder, a.person_ids, a.start_date) == ("Research award G7", "Fund", ["A1", "A2", "A3"], "2000-01-02")
    assert a.description == "Grant reported by the index on the publication “First work on light”."
    assert (b.title, b.funder) == ("Research award linked to First work, corrected", "Solo")


def test_coauthor_lists(spark):
    pairs = spark.createDataFrame([(1, 2, 1, 2000, 5), (1, 3, 1, 2001, 4), (1, 4, 2, 1999, 9), (1, 9, 8, 2000, 0)], "a long, b long, n long, latest int, place int")
    folk = spark.createDataFrame([(1,), (2,), (3,), (4,)], "author long")
    got = {r.author: [tuple(c) for c in r.coauthors] for r in corpus.coauthor_lists(pairs, folk, "place").collect()}
    assert got[1] == [(4, 2, 1999), (3, 1, 2001), (2, 1, 2000)] and got[2] == [(1, 1, 2000)] and 9 not in got


def test_evidence_length(spark):
    projects = spark.createDataFrame([("p", [3, 1, 2], "x"), ("q", [1], "x")], "project string, person_ids array<int>, start_date string")
    rows = spark.createDataFrame([("p", 1, "On Eightchr and ninechars"), ("p", 2, "On Eightchr and ninechars"), ("p", 3, "On Eightchr and ninechars"), ("q", 1, "Eightchr")], "project string, author int, text string")
    titles = spark.createDataFrame([(1, "eightchr"), (2, "ninechars"), (3, "absent title")], "author int, title string")
    out = corpus.cleaned_projects(projects, people.evidence(rows, titles).select("project").distinct(), people.evidence(rows, titles, None)).collect()
    # nine characters prove the project, eight are enough for a person of it
    assert [(r.project, r.person_ids, r.start_date, r.end_date) for r in out] == [("p", [1, 2], None, None)]


def test_proof(spark):
    folk = spark.createDataFrame([("Ada Bee", ["W1"])], "name string, publications array<string>")
    titled = lambda t: spark.createDataFrame([(t,)], "title string")
    assert ingest.proof(folk, titled("A real title")).first().proved
    for t in ("Short", "Research paper 12"):
        with pytest.raises(Exception, match="no proof"):
            ingest.proof(folk, titled(t)).collect()


def test_described(spark):
    r = corpus.described(spark.range(1), "pages", "all", at=F.lit("now")).first()
    assert (r.source, r.scope, r.synthetic, r.generated_at) == ("pages", "all", False, "now")


class Lengths:
    """Encodes a text as its number of words and of letters; counts what it is asked."""

    def __call__(self, texts):
        out = np.array([[len(t.split(" ")), len(t)] for t in texts], dtype=float)
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def test_encode_in_chunks(spark):
    texts = [" ".join("w" * (i % 7 + 1) for i in range(n)) for n in (1, 180, 181, 400)] + [None, ""]
    got = {r.id: r.vec for r in encode.encode(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), Lengths).collect()}
    for i, t in enumerate(texts):
        w, total = (t or "").split(" "), np.zeros(2)
        for at in range(0, len(w), 180):
            total += Lengths()([" ".join(w[at : at + 180])])[0] * len(w[at : at + 180])
        assert got[i] == pytest.approx((total / np.linalg.norm(total)).tolist())


def test_encode_cached(spark, tmp_path):
    def broken():
        raise AssertionError("nothing is missing")

    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id int, text string")
    first = sorted(encode.encode_cached(texts, Lengths, f"{tmp_path}/v", "m").collect())
    assert [r.id for r in first] == [1, 2, 3] and spark.read.parquet(f"{tmp_path}/v").count() == 2
    assert first == sorted(encode.encode_cached(texts.filter("id < 9"), lambda: Lengths(), f"{tmp_path}/v", "m").collect())
    assert spark.read.parquet(f"{tmp_path}/v").count() == 2


def test_lexical_encoder():
    assert encode.LexicalEncoder(("climate", "health"), (2.0, 3.0))(["unknown", "health Health"]).tolist() == [[0, 0], [0, 1]]
    w = encode.LexicalEncoder(("climate", "health"), (2.0, 3.0))(["climate health health"])[0]
    assert w[1] / w[0] == pytest.approx(1.5 * (1 + math.log(2)))


def test_query_falls_back():
    lexical = encode.LexicalEncoder(("health",), (2.0,))

    def broken():
        raise OSError("no model")

    for model, make in (("other", Lengths), ("m", broken)):
        got = encode.embed_query("health", model, "m", make, lexical)
        assert (got.vector, got.model, got.fallback) == ([1.0], encode.FALLBACK, True) and got.warning
    assert not encode.embed_query("health", "m", "m", Lengths, lexical).fallback


def test_query_is_checked():
    assert encode.checked_query("x" * 20_000)
    for bad in (None, 3, " \n", "x" * 20_001):
        with pytest.raises(ValueError):
            encode.checked_query(bad)


def test_expander():
    calls = []

    def complete(text):
        calls.append(text)
        if text == "bad" and calls.count("bad") == 1:
            raise OSError
        return {"status": "completed", "output": [{"type": "message", "content": [{"type": "output_text", "text": f" more {text}"}, {"type": "other"}]}]}

    e = encode.Expander(complete, most=2)
    assert e("a") == e("a") == ("more a", None) and calls == ["a"]
    assert e("bad")[0] == "bad" and e("bad") == ("more bad", None)
    e("c")
    assert list(e.known) == ["bad", "c"]
    assert encode.Expander()("idea")[1]
    for payload in ({"status": "failed"}, {"status": "completed", "output": []}):
        with pytest.raises(ValueError):
            encode.completed_text(payload)


@pytest.fixture(scope="module")
def small(spark):
    d = {
        "vectors": spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vec array<double>"),
        "papers": spark.createDataFrame([("P", "a"), ("P", "b"), ("Q", "b")], "author string, work string"),
        "themes": spark.createDataFrame([("t1", "Climate", [1.0, 0.0]), ("t2", "Health", [0.0, 1.0])], "theme string, name string, vec array<double>"),
        "titles": spark.createDataFrame([("a", "Climate Paper"), ("b", "Health Paper")], "work string, title string"),
        "names": spark.createDataFrame([("P", "Person"), ("Q", "Quill"), ("R", "Rest")], "author string, name string"),
    }
    return d


def test_reasons(small):
    for query, title, theme in (([1.0, 0.0], "Climate Paper", "Climate"), ([0.0, 1.0], "Health Paper", "Health")):
        s = matching.rank_themes(matching.dense_scores(small["themes"].withColumnRenamed("theme", "id"), query))
        top = matching.ranked(s.join(small["themes"], "theme").select("theme", "name", "score"), ["theme"], 1).first()
        assert top.name == theme
        papers = matching.closest_papers(small["papers"], matching.dense_scores(small["vectors"], query))
        got = {r.author: r.reason for r in matching.reasons(papers, small["names"], small["titles"], top.name).collect()}
        assert got["P"] == f"Person's publication “{title}” is their closest publication to your query, which lands in the {theme} theme."
        assert got["R"] == matching.NO_EVIDENCE


def test_two_negatives_fit(spark, small):
    folk = spark.createDataFrame([("n", [-1.0, 0.0])], "id string, vec array<double>")
    r = matching.theme_fit(folk, small["themes"].filter("theme = 't1'"), [-1.0, 0.0]).first()
    assert (r.direct, r.fit) == (1.0, 1.0)
    r = matching.theme_fit(folk, small["themes"].filter("theme = 't1'"), [1.0, 0.0]).first()
    assert (r.direct, r.fit) == (0.0, 0.0)


def test_mean_of_representatives(spark, small):
    reps = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "none")], "theme string, id string")
    got = {r.theme: r.score for r in matching.rank_themes(matching.dense_scores(small["vectors"], [1.0, 0.0]), reps).collect()}
    assert got == {"t": 0.5, "u": 0.0}


def test_faculty_groups_students(spark, small):
    scores = spark.createDataFrame([("P", 0.5), ("Q", 0.55), ("R", 0.9)], "id string, score double")
    assert [(r.id, r["rank"]) for r in matching.faculty_matches(scores, small["papers"]).collect()] == [("Q", 1), ("P", 2)]
    got = matching.faculty_matches(scores, small["papers"], spark.createDataFrame([("P",)], "author string")).collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [("P", 0.6), ("Q", 0.55)]
    members = spark.createDataFrame([("g", "P"), ("g", "Q"), ("h", "R")], "group string, author string")
    groups = spark.createDataFrame([("g", "t1"), ("h", "gone")], "group string, theme string")
    assert [(r.group, round(r.score, 6), r.theme_name) for r in matching.group_matches(members, scores, groups, small["themes"]).collect()] == [("h", 0.9, None), ("g", 0.525, "Climate")]
    low = spark.createDataFrame([("x", -0.5), ("y", -0.2)], "id string, score double")
    assert [(r.id, r.score) for r in matching.student_matches(low).collect()] == [("x", 0.0), ("y", 0.0)]
    assert [r.id for r in matching.student_matches(low, 6, clamp=False).collect()] == ["y", "x"]


def test_answer(spark, small):
    scores = spark.createDataFrame([("t1", 0.2), ("t2", 0.4)], "theme string, score double")
    out = matching.matches(small["names"], small["names"], scores, small["themes"], small["names"], 1998)
    assert [(r.theme, r["rank"]) for r in out["themes"].collect()] == [("t2", 1), ("t1", 2)] and "vec" not in out["themes"].columns


def test_groups(spark, small):
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c")], "group string, author string")
    vectors = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.2, 0.9])], "id string, vec array<double>")
    assert matching.group_themes(members, vectors, small["themes"]).first().theme == "t2"
    wrote = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "c")], "work int, author string")
    works = spark.createDataFrame([(1, 2000), (2, 2005), (3, 2001)], "work int, year int")
    assert [(r.work, r["rank"]) for r in matching.group_works(members, wrote, works).collect()] == [(3, 1), (1, 2)]
    groups = spark.createDataFrame([(1, "P", "t1", 0.5, 0.5), (2, "Q", "t2", 1.0, 0.5)], "group int, lead string, theme string, cohesion double, recency double")
    assert [(r.group, r.name, r.place) for r in matching.group_order(groups, small["names"], small["themes"]).orderBy("place").collect()] == [(2, "Quill — Health", 1), (1, "Person — Climate", 2)]


def test_labels(spark):
    keyed = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "w array<int>").select(matching.theme_key("m", "w")).first()[0]
    assert keyed == "m:1,2,3,4,5"
    themes = spark.createDataFrame([("k1", "a / b", "Fine."), ("k2", "Good name", "Research on x."), ("k3", "Stays", "Researchers only.")], "key string, name string, description string")
    ten = [str(i) for i in range(10)]
    labels = spark.createDataFrame([("k1", "New one", "D1.", ten, ten), ("k2", "New two", "D2.", ten, ten)], "key string, name string, description string, titles array<string>, publication_ids array<string>")
    assert {tuple(r) for r in matching.relabelled(themes, labels).collect()} == {("k1", "New one", "D1."), ("k2", "New two", "D2."), ("k3", "Stays", "Researchers only.")}
    with pytest.raises(Exception, match="k2"):
        matching.relabelled(themes, labels.withColumn("titles", F.when(F.col("key") == "k1", F.col("titles")).otherwise(F.array(F.lit("x"))))).collect()
    bare = themes.select("key")
    assert {r.key: (r.name, r.reviewed) for r in matching.labelled(bare, labels, strict=False).collect()} == {"k1": ("New one", True), "k2": ("New two", True), "k3": ("k3", False)}
    with pytest.raises(Exception, match="k3"):
        matching.labelled(bare, labels).collect()
    sentences = spark.createDataFrame([("One two three four", "Researching online life. "), ("One two three four", "No stop")], "n string, d string")
    assert [r[0] for r in sentences.select(X.valid_label("n", "d")).collect()] == [True, False]


def test_lookups(spark, small):
    assert matching.found(small["themes"], "theme", "t2").first().name == "Health" and matching.found(small["themes"], "theme", "t9") is None
    rows = spark.createDataFrame([(i, i % 3) for i in range(20)], "seq int, author int")
    assert [r.seq for r in matching.members_of(rows, spark.createDataFrame([(1,), (1,)], "author int"), "author", "seq", 3).collect()] == [1, 4, 7]
