"""One query per operator family over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import text as X
from terrane.operators import corpus, encode, graph, ingest, lexical, matching, people, themes
from terrane.sources import tables as S
from terrane.sources.scratch import shared_dir
from terrane.sources.scratch import table as scratch


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return lexical.token_counts(S.texts(spark, d, dealt=True)).select("id", "term", "n", F.round(1 + F.log("n"), 6).alias("tf"))


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(S.texts(spark, d))


def vocabulary_select(spark: SparkSession, d: str) -> DataFrame:
    return lexical.vocabulary(S.texts(spark, d)).select("term", "df", r6("idf"))


def _space(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = S.texts(spark, d, dealt=True)
    vocab = lexical.vocabulary(docs)
    return vocab, lexical.vectors(docs, vocab)


def tfidf_vectors_long(spark: SparkSession, d: str) -> DataFrame:
    return _space(spark, d)[1].select("id", "term", r6("w"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    vocab, vecs = _space(spark, d)
    return lexical.similarities(lexical.vectors(S.texts(spark, d, "benchmark", "item_id"), vocab), vecs)


def text_search_topk(spark: SparkSession, d: str) -> DataFrame:
    vocab, vecs = _space(spark, d)
    q = lexical.vectors(S.texts(spark, d, "benchmark", "item_id").filter("id = 0"), vocab)
    s = lexical.similarities(q, vecs).select("id", r6("score"))
    return s.orderBy(F.desc("score"), "id").limit(12)


def sparse_query_guard(spark: SparkSession, d: str) -> DataFrame:
    vocab, _ = _space(spark, d)
    v = lexical.vectors(S.texts(spark, d, "benchmark", "item_id"), vocab)
    return v.groupBy("id").agg(F.count("*").alias("dims")).filter("dims >= 3")


def word_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = S.texts(spark, d).select("id", F.posexplode(X.chunks("text")).alias("chunk", "t"))
    return c.select("id", "chunk", F.md5("t").alias("digest"))


def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return S.texts(spark, d).filter(F.contains(F.lower("text"), F.lower(F.lit("Idiot")))).select("id")


def lexical_paper_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("q", "id", r6("score"))


def author_composite(spark: SparkSession, d: str) -> DataFrame:
    rows = S.authorship(spark, d).join(S.works(spark, d), "work").select(F.col("author").alias("person"), F.col("work").alias("id"), "year")
    return lexical.composite(rows, _space(spark, d)[1], S.CUTOFF, S.authorship_shares(spark, d)).select("person", "term", r6("w"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "benchmark").select(F.col("item_id").alias("q"))


def theme_ranking_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Sources as themes, their first five documents as representatives, for every passage."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("theme"))
    reps = lexical.best_first(docs, ["theme"], ["id"], 5).select("id", "theme")
    return matching.rank_themes(_scores(spark, d), reps, _passages(spark, d)).select("q", F.col("theme").alias("source"), r6("score"))


def closest_paper_per_person(spark: SparkSession, d: str) -> DataFrame:
    """Sources as people and their documents as works, for every passage."""
    works = S.table(spark, d, "documents").select(F.col("source").alias("author"), F.col("doc_id").alias("work"))
    best = matching.closest_papers(works, _scores(spark, d).withColumn("score", F.round("score", 6)), _passages(spark, d))
    return best.select("q", F.col("author").alias("source"), F.col("work").alias("id"), "score")


def explanation_text(spark: SparkSession, d: str) -> DataFrame:
    best = closest_paper_per_person(spark, d)
    top = lexical.best_first(theme_ranking_lexical(spark, d).withColumnRenamed("source", "theme"), ["q"], [F.desc("score"), "theme"]).select("q", "theme")
    return best.join(top, "q").select("q", "source", F.format_string("Closest work %d; strongest theme %s.", "id", "theme").alias("reason"))


def oversized_filter(spark: SparkSession, d: str) -> DataFrame:
    return people.drop_oversized(S.authorship(spark, d).drop("n_authors"), 4).select("work", "author", "n_authors")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return people.author_stats(S.authorship(spark, d).filter("n_authors <= 50"), S.works(spark, d), S.CUTOFF)


def author_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)


def plausible_name(spark: SparkSession, d: str) -> DataFrame:
    named = S.people(spark, d).unionAll(S.table(spark, d, "customer").select(F.col("c_custkey").alias("author"), F.col("c_name").alias("name")))
    return people.with_plausible(named).select("author", "name", "plausible")


def _retained(spark: SparkSession, d: str) -> DataFrame:
    return people.retained_people(S.people(spark, d), _stats(spark, d))


def retained_people(spark: SparkSession, d: str) -> DataFrame:
    return _retained(spark, d).select("author")


def retained_publications(spark: SparkSession, d: str) -> DataFrame:
    return people.retained_works(S.authorship(spark, d), _retained(spark, d))


def _authorship(spark: SparkSession, d: str) -> DataFrame:
    """Without oversized works: a work of n authors makes n * n pairs, of 50 at most."""
    return people.drop_oversized(S.authorship(spark, d).drop("n_authors"))


def _by_author(spark: SparkSession, d: str) -> DataFrame:
    return _authorship(spark, d).repartition(S.authorship_shares(spark, d), "author")


def _pairs(spark: SparkSession, d: str, authorship: DataFrame | None = None) -> DataFrame:
    rows = _authorship(spark, d) if authorship is None else authorship
    return people.coauthors(rows, S.works(spark, d), 2 * S.authorship_shares(spark, d))


def coauthor_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def activity_signals(spark: SparkSession, d: str) -> DataFrame:
    s = people.signals(S.authorship(spark, d), S.works(spark, d), S.CUTOFF)
    return s.select("*", F.round(people.recency(S.AS_OF), 6).alias("recency"), F.round(people.output(), 6).alias("output"))


def evidence_containment(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of over eight characters.

    A document that holds a passage has the passage's second word as a word, so documents and passages meet on
    words, by ids; texts are fetched for those that meet. Passages of fewer than three words have no inner word
    that is surely whole: they meet every document.
    """
    titles = S.texts(spark, d, "benchmark", "item_id").select(F.lower("text").alias("title")).filter(F.length("title") > 8).distinct()
    words = titles.withColumn("words", X.tokens("title"))
    docs = S.texts(spark, d).withColumnRenamed("id", "project")
    at = docs.select("project", F.explode(F.array_distinct(X.tokens("text"))).alias("word"))
    met = at.join(words.filter(F.size("words") >= 3).select(F.get("words", F.lit(1)).alias("word"), "title"), "word").select("project", "title")
    holds = F.contains(F.lower("text"), F.col("title"))
    long = docs.join(met, "project").filter(holds).select("project")
    short = docs.join(words.filter(F.size("words") < 3).select("title"), holds).select("project")
    return long.unionAll(short).distinct()


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return ingest.last_wins(S.table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def first_wins_attributes(spark: SparkSession, d: str) -> DataFrame:
    e = ingest.first_wins(S.table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"], ["event_type"])
    return e.select("user_id", "event_type", F.array_join("event_type_set", ",").alias("kinds"))


def distinct_ordered_array(spark: SparkSession, d: str) -> DataFrame:
    li = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    return li.select("l_orderkey", F.posexplode(F.array_distinct(F.transform("a", lambda s: s["l_partkey"]))).alias("pos", "l_partkey"))


def inverted_index_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a map word -> positions and back. Texts are dealt by id, so that words meet where they are cut."""
    w = S.texts(spark, d, dealt=True).select("id", F.posexplode(F.split("text", " ")).alias("p", "word"))
    idx = w.groupBy("id", "word").agg(F.collect_list("p").alias("at")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return idx.select("id", F.md5(X.rebuilt("index")).alias("digest"))


def date_validation(spark: SparkSession, d: str) -> DataFrame:
    o = S.table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderstatus") == "O", F.replace(day, F.lit("-"), F.lit("/"))).otherwise(day)
    return o.select("o_orderkey", X.valid_date(text).alias("day"))


def synthetic_people(spark: SparkSession, d: str) -> DataFrame:
    p = ingest.synthetic_corpus(spark)["people"]
    joined = [F.array_join(c, ",").alias(c) for c in ("departments", "publications", "projects")]
    return p.select("id", "name", "title", *joined, F.col("coauthors")[0]["id"].alias("coauthor"))


def synthetic_works(spark: SparkSession, d: str) -> DataFrame:
    return ingest.synthetic_corpus(spark)["publications"].select("id", "title", "abstract", "year", "venue", F.array_join("author_ids", ",").alias("authors"))


def synthetic_projects(spark: SparkSession, d: str) -> DataFrame:
    return ingest.synthetic_corpus(spark)["projects"].select("id", "title", "description", "end_date", "funder", F.array_join("person_ids", ",").alias("people"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", X.as_double("embedding").alias("vec"))


def _centers(spark: SparkSession, d: str) -> DataFrame:
    """One row per label, however many. Written, so that its size is known: Spark broadcasts it only where it is small."""
    return scratch(themes.centroids(_units(spark, d), "label"), "centroids")


def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _centers(spark, d).select("label", F.posexplode("vec").alias("d", "x")).select("label", "d", r6("x"))


def nearest_theme(spark: SparkSession, d: str) -> DataFrame:
    t = _centers(spark, d).withColumnRenamed("label", "theme").withColumnRenamed("vec", "c")
    s = _units(spark, d).crossJoin(t).select("id", "theme", F.round(X.dot("vec", "c"), 6).alias("score"))
    return lexical.best_first(s, ["id"], [F.desc("score"), "theme"]).select("id", "theme", "score")


def theme_ranking_neural(spark: SparkSession, d: str) -> DataFrame:
    c = _centers(spark, d)
    q, t = c.withColumnRenamed("label", "q").withColumnRenamed("vec", "qv"), c.withColumnRenamed("label", "theme")
    return q.crossJoin(t).select("q", "theme", F.round(X.dot("qv", "vec"), 6).alias("score"))


def _fit(spark: SparkSession, d: str) -> DataFrame:
    """Query: the centroid of label 0. id, direct, fit of every person vector."""
    c = _centers(spark, d)
    q = F.broadcast(c.filter("label = 0").select(F.col("vec").alias("q")))
    t = scratch(c.select("label", F.col("vec").alias("t")).crossJoin(q).select("t", X.dot("q", "t").alias("qt")), "themes")
    p = _units(spark, d).crossJoin(q).select("id", "vec", F.greatest(F.lit(0.0), X.dot("vec", "q")).alias("direct"))
    return p.crossJoin(t).groupBy("id", "direct").agg(F.greatest(F.lit(0.0), F.max(F.col("qt") * X.dot("vec", "t"))).alias("fit"))


def theme_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d).select("id", r6("direct"), r6("fit"))


def _faculty(spark: SparkSession, d: str, api: bool = True) -> DataFrame:
    s = people.signals(S.authorship(spark, d), S.works(spark, d), S.CUTOFF)
    return matching.faculty_scores(_fit(spark, d), s, S.AS_OF, lexical=not api).select("id", r6("score"))


def faculty_ranking_api(spark: SparkSession, d: str) -> DataFrame:
    return _faculty(spark, d).orderBy(F.desc("score"), "id").limit(12)


def faculty_ranking_lexical_ui(spark: SparkSession, d: str) -> DataFrame:
    return _faculty(spark, d, api=False).orderBy(F.desc("score"), "id").limit(12)


def optin_boost(spark: SparkSession, d: str) -> DataFrame:
    top = lexical.best_first(faculty_ranking_api(spark, d).withColumn("g", F.lit(0)), ["g"], [F.desc("score"), "id"], 12)
    s = F.when(F.col("rank") == 1, F.least(F.lit(0.99), F.col("score") + 0.1)).otherwise(F.col("score"))
    out = top.select("id", F.round(s, 6).alias("score")).orderBy(F.desc("score"), "id").limit(6)
    return out.select("id", "score", X.percent("score").alias("percent"))


def group_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Brands by the mean score of their parts for label 0; theme 3 has no name."""
    best = matching.group_themes(_groups(spark, d), _units(spark, d), _centers(spark, d).withColumnRenamed("label", "theme"))
    names = _centers(spark, d).filter("label != 3").select(F.col("label").alias("theme"), F.format_string("theme %d", "label").alias("name"))
    out = matching.group_matches(_groups(spark, d), _fit(spark, d).select("id", F.col("direct").alias("score")), best.select("group", "theme"), names)
    return out.select("group", r6("score"), "theme", "theme_name", "rank")


def student_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Documents as students, for every passage."""
    students = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return matching.student_matches_each(_scores(spark, d).withColumn("score", F.round("score", 6)), students, _passages(spark, d))


def theme_rollup(spark: SparkSession, d: str) -> DataFrame:
    near = nearest_theme(spark, d).select("theme", F.col("id").alias("work"), "score")
    return themes.roll_up(near, S.authorship(spark, d).select("work", "author"), S.works(spark, d), S.CUTOFF)


def label_validation(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.get(F.split("text", "\n"), F.lit(0)).alias("line"), "lang")
    return p.select("id", X.valid_label("line", F.concat("line", F.lit("."))).alias("valid"))


def coauthor_edges(spark: SparkSession, d: str) -> DataFrame:
    side = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), "n")
    return _pairs(spark, d).select(F.inline(F.array(side("a", "b"), side("b", "a"))))


def themes_of_person(spark: SparkSession, d: str) -> DataFrame:
    near = nearest_theme(spark, d).select("theme", F.col("id").alias("work"))
    return S.authorship(spark, d).join(near, "work").select("author", "theme").distinct()


def theme_lookup(spark: SparkSession, d: str) -> DataFrame:
    return theme_rollup(spark, d).filter("theme = 3").select("theme", "publication_count", "representative_publications")


def group_members(spark: SparkSession, d: str) -> DataFrame:
    """The first eight authors of every theme."""
    return lexical.best_first(themes_of_person(spark, d), ["theme"], ["author"], 8).select("theme", "author", "rank")


def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.people(spark, d).agg(F.count("*").alias("people")).crossJoin(S.works(spark, d).agg(F.count("*").alias("works")))


def farthest_first_seeds(spark: SparkSession, d: str) -> DataFrame:
    seeds = themes.farthest_first(_units(spark, d), 10)
    return spark.createDataFrame([(i, s) for i, (s, _) in enumerate(seeds)], "seed int, id long")


def spherical_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return themes.spherical_kmeans(_units(spark, d), 10)[0].select("id", "cluster", F.round("score", 6).alias("score"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).filter("n >= 2").select("a", "b", "n")


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected(_edges(spark, d))


def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(_edges(spark, d))


def group_metrics(spark: SparkSession, d: str) -> DataFrame:
    edges = scratch(_edges(spark, d), "edges")
    members = scratch(graph.communities(edges), "members")
    m = graph.group_metrics(members, edges, S.authorship(spark, d), S.works(spark, d), S.CUTOFF)
    return m.select("community", "n_members", "n_works", r6("cohesion"), r6("recency"), "lead")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Brands as groups of their parts."""
    return S.table(spark, d, "part").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("author"))


def faculty_ranking_open(spark: SparkSession, d: str) -> DataFrame:
    """People who are open get 0.1 more: parts of size 1 by override, all others by their flag."""
    over = S.table(spark, d, "part").select(F.col("p_partkey").alias("author"), (F.col("p_size") == 1).alias("is_open"))
    is_open = people.open_people(people.signals(S.authorship(spark, d), S.works(spark, d), S.CUTOFF), over)
    return matching.faculty_matches(_faculty(spark, d), open_people=is_open).select("id", r6("score"), "rank")


def group_ranking_by_theme(spark: SparkSession, d: str) -> DataFrame:
    """Brands by the score of their theme for label 0."""
    scores = theme_ranking_neural(spark, d).filter("q = 0").select("theme", "score")
    best = matching.group_themes(_groups(spark, d), _units(spark, d), _centers(spark, d).withColumnRenamed("label", "theme"))
    return matching.group_matches_by_theme(best.select("group", "theme"), scores)


def group_themes(spark: SparkSession, d: str) -> DataFrame:
    best = matching.group_themes(_groups(spark, d), _units(spark, d), _centers(spark, d).withColumnRenamed("label", "theme"))
    return best.select("group", "theme", r6("score"))


def group_works(spark: SparkSession, d: str) -> DataFrame:
    return matching.group_works(_groups(spark, d), S.authorship(spark, d).select("work", "author"), S.works(spark, d), parts=S.authorship_shares(spark, d))


def student_ranking_ui(spark: SparkSession, d: str) -> DataFrame:
    """The six best texts for passage 0, not clamped."""
    students = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    s = students.join(_scores(spark, d).filter("q = 0").select("id", r6("score")), "id", "left")
    return matching.student_matches(s.withColumn("score", F.coalesce("score", F.lit(0.0))), 6, clamp=False)


def nearest_theme_of_text(spark: SparkSession, d: str) -> DataFrame:
    """The best source of every passage with three known words."""
    t = theme_ranking_lexical(spark, d).join(sparse_query_guard(spark, d).select(F.col("id").alias("q")), "q", "left_semi")
    return lexical.best_first(t, ["q"], [F.desc("score"), "source"]).select("q", "source", "score")


def theme_keys(spark: SparkSession, d: str) -> DataFrame:
    works = F.split("representative_publications", ",")
    return theme_rollup(spark, d).select("theme", matching.theme_key("hashed-64", works).alias("key"))


def coauthor_lists(spark: SparkSession, d: str) -> DataFrame:
    """Everyone's co-authors by shared works. Who does not exist is left out before pairs are made: pairs are of those who stay."""
    parts = S.authorship_shares(spark, d)
    known = _by_author(spark, d).join(S.people(spark, d).select("author"), "author", "left_semi").repartition(parts, "work")
    return corpus.coauthor_ranks(_pairs(spark, d, known), parts=2 * parts)


def evidence_projects(spark: SparkSession, d: str) -> DataFrame:
    """Orders as projects of their authors; those stay whose text, the name of the first part, holds the name of an author."""
    a = S.authorship(spark, d).select(F.col("work").alias("project"), "author", "pos")
    names = S.table(spark, d, "part").select(F.col("p_partkey").alias("author"), F.col("p_name").alias("title"))
    lists = a.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "author"))), lambda s: s["author"]).alias("person_ids"))
    texts = a.filter("pos = 1").join(names, "author").select("project", F.col("title").alias("text"))
    rows = a.select("project", "author").join(texts, "project")
    titles = names.select("author", F.lower("title").alias("title"))
    out = corpus.cleaned_projects(lists, people.evidence(rows, titles).select("project").distinct(), people.evidence(rows, titles, None))
    return out.select("project", F.posexplode("person_ids").alias("pos", "author"))


def encoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document by the lexical encoder, chunk by chunk, as its known dimensions. The vocabulary has 384 rows."""
    docs = S.texts(spark, d)
    vocab = lexical.vocabulary(docs).orderBy("term").collect()
    coder = encode.LexicalEncoder(tuple(r["term"] for r in vocab), tuple(r["idf"] for r in vocab))
    rows = encode.encode(docs, lambda: coder).select("id", F.posexplode("vec").alias("dim", "x"))
    return rows.filter("x != 0").select("id", "dim", r6("x"))


def publication_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as publications: source, text and lang as title, abstract and venue."""
    rows = S.table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("venue"))
    return rows.select("doc_id", F.md5(X.publication_text()).alias("digest"))


def person_texts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as people: brand as department, type and name as works."""
    rows = S.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.array("p_brand").alias("departments"), F.array("p_type", "p_name").alias("texts"))
    return rows.select("p_partkey", X.person_text().alias("text"))


def replaced_names(spark: SparkSession, d: str) -> DataFrame:
    """Replacements one after another: the second meets what the first has made."""
    return S.table(spark, d, "part").select("p_partkey", X.replace_all("p_type", [("ECONOMY", "PROMO"), ("PROMO", "offer"), ("LARGE", "big")]).alias("type"))


def theme_counts(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of a wanted number of themes, here the number of parts of each size."""
    clamped = {n: themes.theme_count(n) for n in range(0, 121)}
    wanted = S.table(spark, d, "part").groupBy("p_size").agg(F.least(F.count("*"), F.lit(120)).alias("wanted"))
    return wanted.select("p_size", "wanted", F.get(F.array(*[F.lit(clamped[n]) for n in range(121)]), F.col("wanted").cast("int")).alias("themes"))


def lead_titles(spark: SparkSession, d: str) -> DataFrame:
    """Orders titled by their priority and number."""
    titles = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("work"), F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("title"))
    return people.lead_titles(_authorship(spark, d), titles)


def retained_works_by_author(spark: SparkSession, d: str) -> DataFrame:
    return people.retained_by_author(_by_author(spark, d), _retained(spark, d))


def person_lists(spark: SparkSession, d: str) -> DataFrame:
    """Retained people's works in the order of their keys, and their orders that still are projects: the urgent ones, by line."""
    kept = people.retained_by_author(_by_author(spark, d), _retained(spark, d))
    lines = S.table(spark, d, "lineitem").select(F.col("l_partkey").alias("author"), F.col("l_orderkey").alias("project"), "l_linenumber")
    parts = S.authorship_shares(spark, d)
    listed = lines.repartition(parts, "project").groupBy("author", "project").agg(F.min("l_linenumber").alias("pos"))
    urgent = S.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("project"))
    order = S.works(spark, d).select("work", F.col("work").alias("seq"))
    lists = people.person_lists(_retained(spark, d), kept, order, listed, urgent, parts)
    return lists.select("author", F.array_join("publications", ",").alias("publications"), F.array_join("projects", ",").alias("projects"))


def stored_explanations(spark: SparkSession, d: str) -> DataFrame:
    """Parts as people, with the theme of the vector of their number and their newest order."""
    best = nearest_theme(spark, d).select(F.col("id").alias("author"), F.concat(F.lit("theme "), F.col("theme").cast("string")).alias("theme_name"))
    works = S.works(spark, d).select("work", F.concat(F.lit("order "), F.col("work").cast("string")).alias("title"), "year", F.col("work").alias("seq"))
    return people.stored_explanations(S.people(spark, d), best, _authorship(spark, d), works)


def groups_of_theme(spark: SparkSession, d: str) -> DataFrame:
    best = matching.group_themes(_groups(spark, d), _units(spark, d), _centers(spark, d).withColumnRenamed("label", "theme"))
    return matching.groups_of_theme(best.select("group", "theme"), 3)


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Prices written as JSON, at eight places, and read again."""
    rows = S.table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 7).alias("price"))
    path = f"{shared_dir(spark)}/terrane/{spark.sparkContext.applicationId}/prices"
    S.write_json(rows, path)
    return S.read_json(spark, path, rows.schema, lines=True)


def robots_paths(spark: SparkSession, d: str) -> DataFrame:
    """The pages' paths under a robots file of their host."""
    at = S.table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"))
    text = "User-agent: other\nAllow: /\n\nuser-agent: * # all\nDisallow: /\nAllow: /e\nDisallow: /en*x\n"
    rules = ingest.robots_rules(at.select("host").distinct().withColumn("text", F.lit(text)), "terrane")
    return at.join(ingest.robots_allowed(at.select("host", "path").distinct(), rules), ["host", "path"]).select("page_id", "allowed")
