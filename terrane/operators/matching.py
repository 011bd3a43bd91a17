"""Query-time ranking and browsing: themes, people, groups and students for one query, in the neural or the lexical space.

Scores are rows (id, score): dot products of the query with vectors of one space, from dense_scores() or
lexical.similarities(). Rankings end in an id, so ties go to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import dot
from terrane.operators.lexical import best_first
from terrane.operators.people import output, recency

#: Weights of fit, direct similarity, recency and output.
WEIGHTS = (0.55, 0.25, 0.12, 0.08)
NO_EVIDENCE = "No publication evidence is available for this query."


def query_column(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dense_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(id, vec) -> id, score (V1)."""
    return vectors.select("id", dot("vec", query_column(query)).alias("score"))


def _every(rows: DataFrame, queries: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """The rows, for each of queries(q) where there are several."""
    return (rows, []) if queries is None else (rows.crossJoin(queries.select("q").distinct()), ["q"])


def rank_themes(scores: DataFrame, reps: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """theme, score: the scores of centroids (R1), or the mean score of each theme's reps(theme, id), nothing counting as 0 (R2).

    With queries(q) and scores(q, id, score): for each query.
    """
    if reps is None:
        return scores.select(F.col("id").alias("theme"), "score")
    rows, by = _every(reps.select("theme", "id"), queries)
    s = rows.join(scores, [*by, "id"], "left")
    return s.groupBy(*by, "theme").agg((F.sum(F.coalesce("score", F.lit(0.0))) / F.count("*")).alias("score"))


def closest_papers(authorship: DataFrame, scores: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """author, work, score: everyone's best work (R3). Works without a score have 0: in the lexical space no word in common.

    With queries(q) and scores(q, id, score) of the lexical space, where none is below 0: for each query. Then only scores
    above 0 are ranked, and who has none gets the first work; no pair without a common word is made.
    """
    own = authorship.select("author", F.col("work").alias("id"))
    if queries is None:
        s = own.join(scores, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return best_first(s, ["author"], [F.desc("score"), "id"]).select("author", F.col("id").alias("work"), "score")
    rows, by = _every(own.groupBy("author").agg(F.min("id").alias("first")), queries)
    best = best_first(own.join(scores.filter("score > 0"), "id"), [*by, "author"], [F.desc("score"), "id"])
    best = rows.join(best.select(*by, "author", "id", "score"), [*by, "author"], "left")
    return best.select(*by, "author", F.coalesce("id", "first").alias("work"), F.coalesce("score", F.lit(0.0)).alias("score"))


def theme_fit(people: DataFrame, themes: DataFrame, query: list[float]) -> DataFrame:
    """(id, vec) -> id, direct, fit (R4, R5): the best product of the query's and the person's score at one theme.

    Two negative scores make a positive product. themes(theme, vec) is a bounded table, 80 rows at most.
    """
    q = query_column(query)
    t = F.broadcast(themes.select(F.col("vec").alias("t"), dot("vec", q).alias("qt")))
    rows = people.crossJoin(t).groupBy("id").agg(F.max(F.col("qt") * dot("vec", "t")).alias("fit"), F.first(dot("vec", q)).alias("direct"))
    return rows.select("id", F.greatest(F.lit(0.0), "direct").alias("direct"), F.greatest(F.lit(0.0), "fit").alias("fit"))


def faculty_scores(fit: DataFrame, signals: DataFrame, as_of: int, lexical: bool = False) -> DataFrame:
    """(id, direct, fit) and signals(author, ...) -> id, score (R6-R9). In the lexical space the fit is the direct score."""
    a, b, c, d = WEIGHTS
    first = F.col("direct") if lexical else F.col("fit")
    score = a * first + b * F.col("direct") + c * recency(as_of) + d * output()
    return fit.join(signals.withColumnRenamed("author", "id"), "id").select("id", score.alias("score"))


def faculty_matches(scores: DataFrame, papers: DataFrame | None = None, open_people: DataFrame | None = None, k: int = 12) -> DataFrame:
    """The k best people: id, score, rank. With papers(author, ...) only those who have one (R12); open people get 0.1 more."""
    if papers is not None:
        scores = scores.join(papers.select(F.col("author").alias("id")).distinct(), "id", "left_semi")
    if open_people is not None:
        is_open = open_people.select(F.col("author").alias("id"), F.lit(0.1).alias("more")).distinct()
        scores = scores.join(is_open, "id", "left").select("id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    return ranked(scores, ["id"], k)


def ranked(scores: DataFrame, ties: list[str], k: int) -> DataFrame:
    """The k best rows, numbered: a top-k first, so that the window holds k rows."""
    best = scores.orderBy(F.desc("score"), *ties).limit(k).withColumn("_g", F.lit(0))
    return best_first(best, ["_g"], [F.desc("score"), *ties], k).drop("_g")


def group_matches(members: DataFrame, scores: DataFrame, groups: DataFrame, themes: DataFrame, k: int = 3) -> DataFrame:
    """group, score, theme, theme_name, rank: the mean score of the members(group, author), theme names where known."""
    mean = members.join(scores.withColumnRenamed("id", "author"), "author").groupBy("group").agg(F.avg("score").alias("score"))
    named = mean.join(groups.select("group", "theme"), "group").join(themes.select("theme", F.col("name").alias("theme_name")), "theme", "left")
    return ranked(named.select("group", "score", "theme", "theme_name"), ["group"], k)


def group_matches_by_theme(groups: DataFrame, theme_scores: DataFrame, k: int = 6) -> DataFrame:
    """group, theme, score, rank: the score of the group's theme."""
    return ranked(groups.select("group", "theme").join(theme_scores, "theme").select("group", "theme", "score"), ["group"], k)


def student_matches(scores: DataFrame, k: int = 3, clamp: bool = True) -> DataFrame:
    """The k best students; below 0 counts as 0 (R15), or not (R16: k = 6, also with a person's vector as the query)."""
    s = F.greatest(F.lit(0.0), "score") if clamp else F.col("score")
    return ranked(scores.select("id", s.alias("score")), ["id"], k)


def student_matches_each(scores: DataFrame, students: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """q, id, score, rank: the k best of students(id) for each of queries(q), below 0 and no score being 0.

    Beside the scores above 0 only 2 k - 1 students can be among the k best: those of the least ids.
    """
    known = best_first(scores.filter("score > 0"), ["q"], [F.desc("score"), "id"], k).select("q", "id", "score")
    spare = students.select("id").orderBy("id").limit(2 * k - 1).crossJoin(queries.select("q").distinct()).join(known, ["q", "id"], "left_anti")
    return best_first(known.unionByName(spare.withColumn("score", F.lit(0.0))), ["q"], [F.desc("score"), "id"], k)


def reasons(papers: DataFrame, names: DataFrame, titles: DataFrame, theme: str | None) -> DataFrame:
    """author, reason for people(author, name): their closest work and the query's theme, or that there is none."""
    rows = names.select("author", "name").join(papers.join(titles.select("work", "title"), "work"), "author", "left")
    told = F.format_string("%s's publication “%s” is their closest publication to your query, which lands in the %s theme.", "name", "title", F.lit(theme))
    return rows.select("author", F.when(F.col("title").isNotNull() & F.lit(theme is not None), told).otherwise(F.lit(NO_EVIDENCE)).alias("reason"))


def matches(faculty: DataFrame, groups: DataFrame, theme_scores: DataFrame, themes: DataFrame, students: DataFrame, cutoff: int) -> dict[str, DataFrame | int]:
    """All parts of an answer: the two best themes go without their centroids."""
    best = ranked(theme_scores.join(themes.drop("vec", "centroid"), "theme"), ["theme"], 2)
    return {"faculty": faculty, "groups": groups, "themes": best, "students": students, "recent_cutoff": cutoff}


def group_themes(members: DataFrame, vectors: DataFrame, themes: DataFrame) -> DataFrame:
    """group, theme, score: the theme of the greatest mean score of the members.

    The mean of products is the product with the mean, so members are summed first; themes(theme, vec) may have any number of rows.
    """
    parts = members.select("group", F.col("author").alias("id")).join(vectors, "id").select("group", F.posexplode("vec").alias("d", "x"))
    mean = parts.groupBy("group", "d").agg(F.avg("x").alias("x"))
    t = themes.select("theme", F.posexplode("vec").alias("d", "c"))
    s = mean.join(t, "d").groupBy("group", "theme").agg(F.sum(F.col("x") * F.col("c")).alias("score"))
    return best_first(s, ["group"], [F.desc(F.round("score", 12)), "theme"]).drop("rank")


def group_works(members: DataFrame, authorship: DataFrame, works: DataFrame, least: int = 2, parts: int | None = None) -> DataFrame:
    """group, work, year, rank: works of two members, the latest first.

    With `parts`, authorship is dealt to as many tasks by author and again by work: counts are made where their rows are.
    """
    deal = lambda rows, key: rows.repartition(parts, key) if parts else rows
    own = deal(deal(authorship, "author").join(members.select("group", "author"), "author"), "work")
    own = own.groupBy("group", "work").agg(F.count_distinct("author").alias("k"))
    return best_first(own.filter(F.col("k") >= least).drop("k").join(works.select("work", "year"), "work"), ["group"], [F.desc_nulls_last("year"), "work"], 2**31 - 1)


def group_order(groups: DataFrame, names: DataFrame, themes: DataFrame) -> DataFrame:
    """group, lead, theme, cohesion, recency -> plus name and place by cohesion times recency (G8, G10). Groups are few: one window."""
    rows = groups.join(names.select(F.col("author").alias("lead"), F.col("name").alias("person")), "lead").join(themes.select("theme", F.col("name").alias("title")), "theme")
    rows = rows.withColumn("name", F.concat_ws(" — ", "person", "title")).drop("person", "title").withColumn("_g", F.lit(0))
    return best_first(rows, ["_g"], [F.desc(F.col("cohesion") * F.col("recency")), "group"], 2**31 - 1).drop("_g").withColumnRenamed("rank", "place")


def theme_key(model: str, works: Column | str, n: int = 5) -> Column:
    """The model and a theme's first works: the key of its label (K7)."""
    works = F.col(works) if isinstance(works, str) else works
    return F.concat(F.lit(f"{model}:"), F.array_join(F.transform(F.slice(works, 1, n), lambda w: w.cast("string")), ","))


def labelled(themes: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """themes(key, ...) with name and description of labels(key, name, description) (K8): an error names a theme that has none.

    Not strict, it gets its key for a name and reviewed = false.
    """
    rows = themes.join(labels.select("key", "name", "description"), "key", "left")
    if strict:
        gone = F.raise_error(F.concat(F.lit("no label for the theme "), F.col("key"))).cast("string")
        return rows.withColumn("name", F.coalesce("name", gone))
    return rows.withColumn("reviewed", F.col("name").isNotNull()).withColumn("name", F.coalesce("name", "key"))


def relabelled(themes: DataFrame, labels: DataFrame, evidence: int = 10) -> DataFrame:
    """themes(key, name, description) whose name holds a slash, or that are "Research on" something, get their label.

    The label must rest on exactly `evidence` titles and works; without one that is an error.
    """
    fit = labels.filter((F.size("titles") == evidence) & (F.size("publication_ids") == evidence)).select("key", F.struct("name", "description").alias("new"))
    stale = F.contains("name", F.lit("/")) | F.col("description").rlike(r"(?i)^Research on\b")
    gone = F.raise_error(F.concat(F.lit("no top works for the theme "), F.col("key"))).cast("string")
    rows = themes.withColumn("_stale", stale).join(fit, "key", "left")
    pick = lambda c: F.when(F.col("_stale"), F.coalesce(F.col("new")[c], gone)).otherwise(F.col(c)).alias(c)
    return rows.select(*[pick(c) if c in ("name", "description") else F.col(c) for c in themes.columns])


def found(rows: DataFrame, key: str, value: object) -> DataFrame | None:
    """The record of a key, or None."""
    hit = rows.filter(F.col(key) == F.lit(value)).limit(1)
    return hit if hit.count() else None


def members_of(rows: DataFrame, ids: DataFrame, key: str, seq: str, k: int = 8) -> DataFrame:
    """The first k rows in corpus order whose key is listed."""
    return rows.join(ids.select(key).distinct(), key, "left_semi").orderBy(seq).limit(k)


def groups_of_theme(groups: DataFrame, theme: object) -> DataFrame:
    """The groups of a theme, in their order."""
    return groups.filter(F.col("theme") == F.lit(theme))
