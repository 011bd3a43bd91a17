"""Operators that SQL does not express, against plain Python; small exact fixtures."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import text as X
from terrane.operators import corpus, graph, ingest, lexical, matching, people, themes
from terrane.sources import scratch
from terrane.sources.tables import read_json
from terrane.streaming.incremental import compact, current, follow


def test_two_term_space(spark):
    vocab = spark.createDataFrame([("climate", 2.0), ("health", 3.0)], "term string, idf double")
    texts = spark.createDataFrame([(1, "health health"), (2, "unknown"), (3, None)], "id int, text string")
    assert [(r.id, r.term, r.w) for r in lexical.vectors(texts, vocab).collect()] == [(1, "health", 1.0)]


def test_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 1.0)], "seq int, score double").withColumn("k", F.lit(0))
    assert lexical.best_first(rows, ["k"], [F.desc("score"), "seq"]).first().seq == 0


def test_rebuild_with_gaps(spark):
    df = spark.createDataFrame([({"a": [0, 3], "b": [1]},), ({},)], "m map<string,array<int>>")
    assert [r[0] for r in df.select(X.rebuilt("m")).collect()] == ["a b  a", None]


def test_rebuild_long_and_repeated(spark):
    words = [f"w{i % 7000}" for i in range(20_000)]
    at: dict = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    df = spark.createDataFrame([(at,), ({"a": [2, -1], "b": [2, 4]},), ({"a": []},)], "m map<string,array<int>>")
    began = time.time()
    assert [r[0] for r in df.select(X.rebuilt("m")).collect()] == [" ".join(words), "  b  b", None]
    assert time.time() - began < 20


def test_names_dates_labels(spark):
    df = spark.createDataFrame([("Li Wei", "2024-99-99"), ("J Smith", "2024-1-1"), ("Δδ Σσ", None)], "n string, d string")
    got = df.select(X.plausible_name("n").alias("p"), X.valid_date("d").alias("d")).collect()
    assert [tuple(r) for r in got] == [(True, "2024-99-99"), (False, None), (True, None)]
    labels = spark.createDataFrame([("One two three four", "Good work."), ("One/two three four five", "Good."), ("One two three four", "Research on x.")], "n string, d string")
    assert [r[0] for r in labels.select(X.valid_label("n", "d")).collect()] == [True, False, False]


def test_components_and_propagation(spark):
    edges = [(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1), (10, 11, 2)]
    df = spark.createDataFrame(edges, "a long, b long, n long")
    assert {(r.node, r.component) for r in graph.connected(df.select("a", "b")).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10)}
    got = {r.node: r.community for r in graph.communities(df).collect()}
    want = graph.propagate(df.toPandas())
    assert got == dict(zip(want["node"], want["community"], strict=True)) and got[10] == got[11] != got[1]


def test_kmeans_against_plain(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    seeds = [0]
    while len(seeds) < 4:
        seeds.append(int(np.argmax(np.round((1 - x @ x[seeds].T).min(axis=1), 12))))
    assert [i for i, _ in themes.farthest_first(df, 4)] == seeds
    c, old = x[seeds], None
    for _ in range(12):
        a = np.argmax(np.round(x @ c.T, 12), axis=1)
        if old is not None and (a == old).all():
            break
        old = a
        c = np.array([x[a == k].sum(axis=0) / np.linalg.norm(x[a == k].sum(axis=0)) if (a == k).any() else c[k] for k in range(4)])
    got = {r.id: r.cluster for r in themes.spherical_kmeans(df, 4)[0].collect()}
    assert [got[i] for i in range(60)] == a.tolist()


def test_robots(spark):
    text = "User-agent: somebody\r\nDisallow: /\r\nUser-Agent: *  # all\r\nDisallow: /shut*/deep\r\nAllow: /shut/op\r\nDisallow:\r\nno rule\r\nUser-agent: TheBot/1\r\nDisallow: /bot\r\nAllow: /bot"
    rules = ingest.robots_rules(spark.createDataFrame([("h", text), ("empty", None)], "host string, text string"), "thebot")
    assert [(r.path, r.allow) for r in rules.orderBy("seq").collect()] == [("/shut*/deep", False), ("/shut/op", True), ("", False), ("/bot", False), ("/bot", True)]
    paths = spark.createDataFrame([("h", "/open"), ("h", "/shut/x"), ("h", "/shut/open"), ("h", "/bot"), ("empty", "/shut"), ("h", "")], "host string, path string")
    got = {(r.host, r.path): r.allowed for r in ingest.robots_allowed(paths, rules).collect()}
    # the longer rule decides, its star included; of equal ones the first
    assert got == {("h", "/open"): True, ("h", "/shut/x"): False, ("h", "/shut/open"): False, ("h", "/bot"): False, ("empty", "/shut"): True, ("h", ""): True}
    many = spark.range(20_000).select(F.lit("h").alias("host"), F.col("id").alias("seq"), F.format_string("/%05d", "id").alias("path"), F.lit(False).alias("allow"))
    asked = spark.createDataFrame([("h", "/19999/x"), ("h", "/x")], "host string, path string")
    assert {r.path: r.allowed for r in ingest.robots_allowed(asked, many).collect()} == {"/19999/x": False, "/x": True}


def test_plausible_after_folding(spark):
    # a ligature is one letter until it is folded; wide letters are letters already
    rows = spark.createDataFrame([(1, "ﬁ Lee"), (2, "Ｊｏ Ｓｍｉｔｈ"), (3, "J Smith"), (4, None), (5, "ﬁ")], "author int, name string")
    assert {r.author: r.plausible for r in people.with_plausible(rows).collect()} == {1: True, 2: True, 3: False, 4: None, 5: False}


def test_person_lists(spark):
    kept = spark.createDataFrame([("a", "w2"), ("a", "w1")], "author string, work string")
    order = spark.createDataFrame([("w1", 9), ("w2", 3)], "work string, seq int")
    listed = spark.createDataFrame([("a", 0, "p9"), ("a", 1, "p2"), ("a", 2, "p1")], "author string, pos int, project string")
    left = spark.createDataFrame([("p1",), ("p2",)], "project string")
    both = spark.createDataFrame([("a",), ("b",)], "author string")
    got = {r.author: (r.publications, r.projects) for r in people.person_lists(both, kept, order, listed, left).collect()}
    assert got == {"a": (["w2", "w1"], ["p2", "p1"]), "b": ([], [])}


def test_newest_paper_explains(spark):
    persons = spark.createDataFrame([("a", "Ada"), ("b", "Bo")], "author string, name string")
    best = spark.createDataFrame([("a", "Light"), ("b", "Sound")], "author string, theme_name string")
    works = spark.createDataFrame([("w1", "Old", 2000, 0), ("w2", "New", 2005, 2), ("w3", "New too", 2005, 1), ("w4", "No year", None, 3)], "work string, title string, year int, seq int")
    by = spark.createDataFrame([("a", "w1"), ("a", "w2"), ("a", "w3"), ("a", "w4"), ("b", "w4")], "author string, work string")
    got = {r.author: r.explanation for r in people.stored_explanations(persons, best, by, works).collect()}
    assert got == {"a": "Ada matches through “New too” and the Light theme.", "b": "Bo matches through “No year” and the Sound theme."}


def test_nothing_in_common_counts_as_zero(spark):
    by = spark.createDataFrame([("a", 2), ("a", 3), ("b", 5), ("b", 4), ("c", 6)], "author string, work long")
    scores = spark.createDataFrame([(0, 3, 0.5), (0, 6, 0.2), (1, 4, 0.1)], "q long, id long, score double")
    q = spark.createDataFrame([(0,), (1,)], "q long")
    got = {(r.q, r.author): (r.work, r.score) for r in matching.closest_papers(by, scores, q).collect()}
    assert got == {(0, "a"): (3, 0.5), (0, "b"): (4, 0.0), (0, "c"): (6, 0.2), (1, "a"): (2, 0.0), (1, "b"): (4, 0.1), (1, "c"): (6, 0.0)}
    one = {r.author: (r.work, r.score) for r in matching.closest_papers(by, scores.filter("q = 1").drop("q")).collect()}
    assert one == {a: v for (k, a), v in got.items() if k == 1}
    students = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    ranks = {(r.q, r["rank"]): (r.id, r.score) for r in matching.student_matches_each(scores, students, q).collect()}
    assert ranks == {(0, 1): (3, 0.5), (0, 2): (6, 0.2), (0, 3): (1, 0.0), (1, 1): (4, 0.1), (1, 2): (1, 0.0), (1, 3): (2, 0.0)}
    reps = spark.createDataFrame([("x", 3), ("x", 4), ("y", 5)], "theme string, id long")
    means = {(r.q, r.theme): r.score for r in matching.rank_themes(scores, reps, q).collect()}
    assert means == {(0, "x"): 0.25, (0, "y"): 0.0, (1, "x"): 0.05, (1, "y"): 0.0}


def test_communities_in_corpus_order(spark):
    members = spark.createDataFrame([(1, 5), (5, 5), (2, 9), (9, 9), (7, 7)], "node long, community long")
    order = spark.createDataFrame([(9, 0), (5, 1), (2, 2), (1, 3), (7, 4)], "node long, seq long")
    got = [(r.number, r.community, r.members) for r in graph.in_corpus_order(members, order).orderBy("number").collect()]
    assert got == [(1, 9, [9, 2]), (2, 5, [5, 1]), (3, 7, [7])]


def test_json_files(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"name": "b", "x": 1 / 3}, {"name": "a", "x": 2.0}], indent=1))
    rows = read_json(spark, f"{tmp_path}/in.json", spark.createDataFrame([], "name string, x double").schema)
    assert sorted(map(tuple, rows.collect())) == [("a", 2.0), ("b", 1 / 3)]
    persons = spark.createDataFrame([(0, "Zoë"), (1, "Änne"), (2, "Bob"), (3, "bab")], "seq int, name string")
    corpus.write_corpus(f"{tmp_path}/out", persons, rows, rows, {"source": "s", "scope": "all"})
    lines = [json.loads(x) for p in sorted((tmp_path / "out/people").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["name"] for x in lines] == ["Änne", "bab", "Bob", "Zoë"]
    back = read_json(spark, f"{tmp_path}/out/publications", rows.schema, lines=True)
    assert sorted(map(tuple, back.collect())) == [("a", 2.0), ("b", 0.33333333)]
    assert spark.read.json(f"{tmp_path}/out/meta").first().scope == "all"


def test_shared_folder(spark):
    kept = scratch.table(spark.range(3), "numbers")
    assert kept.count() == 3 and kept._terrane_path.startswith(scratch.shared_dir(spark))
    scratch.drop_table(kept)

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})  # noqa: N815

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Cluster)


def test_incremental_upsert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], "id long, seq long, v string").schema
    for n, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("id", "seq", "v"), r, strict=True))) for r in rows))
        follow(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state", "id", ["seq"]).awaitTermination()
    assert {r.id: r.v for r in spark.read.parquet(f"{tmp_path}/out/batch=1").collect()} == {1: "c"}
    assert {r.id: r.v for r in current(spark, schema, f"{tmp_path}/out", "id", ["seq"]).collect()} == {1: "c", 2: "b"}
    assert compact(spark, schema, f"{tmp_path}/out", f"{tmp_path}/new", "id", ["seq"]) == 1
    (tmp_path / "in" / "2.json").write_text(json.dumps({"id": 2, "seq": 1, "v": "later"}))
    follow(spark, f"{tmp_path}/in", schema, f"{tmp_path}/new", f"{tmp_path}/state", "id", ["seq"]).awaitTermination()
    assert {r.id: r.v for r in current(spark, schema, f"{tmp_path}/new", "id", ["seq"]).collect()} == {1: "c", 2: "later"}
