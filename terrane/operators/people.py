"""Cleaning, authorship, co-authors and activity signals."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terrane.functions.text import plausible_name


def drop_oversized(authorship: DataFrame, most: int = 50) -> DataFrame:
    """(work, author, pos) of works with at most `most` authors, plus n_authors."""
    return authorship.filter(F.col("work").isNotNull()).withColumn("n_authors", F.count("*").over(Window.partitionBy("work"))).filter(F.col("n_authors") <= most)


def author_stats(authorship: DataFrame, works: DataFrame, cutoff: int) -> DataFrame:
    """author, n_works, recent, lead: counts, any work from the cutoff on, ever first or last."""
    rows = authorship.join(works.select("work", "year"), "work")
    lead = (F.col("pos") == 1) | (F.col("pos") == F.col("n_authors"))
    return rows.groupBy("author").agg(
        F.count("*").alias("n_works"), F.bool_or(F.coalesce("year", F.lit(0)) >= cutoff).alias("recent"), F.bool_or(lead).alias("lead")
    )


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def with_plausible(people: DataFrame) -> DataFrame:
    """people(name, ...) plus plausible (C3), judged on the name in compatibility composition (NFKC).

    That changes no ASCII name, so only the others pass through Python.
    """
    plain = F.coalesce(F.length("name") == F.octet_length("name"), F.lit(True))
    rest = people.filter(~plain).withColumn("plausible", plausible_name(_folded("name")))
    return people.filter(plain).withColumn("plausible", plausible_name("name")).unionAll(rest)


def retained_people(people: DataFrame, stats: DataFrame, least: int = 3) -> DataFrame:
    """people(author, name) with a plausible name, enough works, one recent and one led."""
    good = stats.filter((F.col("n_works") >= least) & F.col("recent") & F.col("lead"))
    return with_plausible(people).filter("plausible").drop("plausible").join(good.select("author"), "author", "left_semi")


def retained_works(authorship: DataFrame, people: DataFrame) -> DataFrame:
    """Works with a retained author."""
    return authorship.join(people.select("author"), "author", "left_semi").select("work").distinct()


def retained_by_author(authorship: DataFrame, people: DataFrame) -> DataFrame:
    """author, work of retained people: each of their works is retained by them (C9). The authorship is without oversized works."""
    return authorship.join(people.select("author"), "author", "left_semi").select("author", "work").distinct()


def person_lists(people: DataFrame, retained: DataFrame, order: DataFrame, listed: DataFrame, projects: DataFrame, parts: int | None = None) -> DataFrame:
    """people(author) -> author, publications, projects (C14).

    publications are the retained(author, work) in corpus order(work, seq); projects are the listed(author, pos, project)
    that still exist, in their order. With `parts`, rows are dealt to as many tasks by author before they are listed.
    """
    deal = lambda rows, key: rows.repartition(parts, key) if parts else rows
    in_order = lambda at, what: F.transform(F.array_sort(F.collect_list(F.struct(at, what))), lambda s: s[what])
    works = deal(deal(retained, "work").join(order.select("work", "seq"), "work"), "author").groupBy("author").agg(in_order("seq", "work").alias("publications"))
    own = deal(listed.join(projects.select("project"), "project", "left_semi"), "author").groupBy("author").agg(in_order("pos", "project").alias("projects"))
    rows = people.select("author").join(works, "author", "left").join(own, "author", "left")
    none = lambda c, like: F.coalesce(c, F.array().cast(like.schema[c].dataType)).alias(c)
    return rows.select("author", none("publications", works), none("projects", own))


def lead_titles(authorship: DataFrame, titles: DataFrame) -> DataFrame:
    """author, title (lower case) of works that the author leads."""
    lead = authorship.filter((F.col("pos") == 1) | (F.col("pos") == F.col("n_authors")))
    return lead.join(titles, "work").select("author", F.lower("title").alias("title")).distinct()


def evidence(projects: DataFrame, titles: DataFrame, least: int | None = 8) -> DataFrame:
    """(project, author, text) rows whose lower-cased text holds a title of that author (C11; least=None: C12).

    An equi-join on the author first; containment is a condition on its rows.
    """
    hit = F.contains(F.lower("text"), F.col("title")) & (F.length("title") > least if least is not None else F.lit(True))
    return projects.join(titles, "author").filter(hit).select("project", "author").distinct()


def coauthors(authorship: DataFrame, works: DataFrame, parts: int | None = None) -> DataFrame:
    """Pairs a < b of authors of one work: n, latest.

    A work is one row with its authors until its year is found; pairs are made last, and dealt to `parts` tasks where
    that is given: nearly every pair is another one, so counting them before they are dealt only fills memory.
    """
    lists = authorship.groupBy("work").agg(F.collect_list("author").alias("authors")).join(works.select("work", "year"), "work")
    firsts = lists.select("authors", "year", F.explode("authors").alias("a"))
    pairs = firsts.select("a", F.explode(F.filter("authors", lambda b: F.col("a") < b)).alias("b"), "year")
    pairs = pairs.repartition(parts, "a", "b") if parts else pairs
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max(F.coalesce("year", F.lit(0))).alias("latest"))


def signals(authorship: DataFrame, works: DataFrame, cutoff: int) -> DataFrame:
    """author, recent_output, publication_recency, opted_in."""
    rows = authorship.join(works.select("work", "year"), "work")
    return rows.groupBy("author").agg(F.count_if(F.col("year") >= cutoff).alias("recent_output"), F.max("year").alias("publication_recency"), F.lit(False).alias("opted_in"))


def recency(as_of: int):
    """Share of four years left since the latest work."""
    return F.greatest(F.lit(0.0), 1 - (as_of - F.col("publication_recency")) / 4)


def output():
    """Recent output out of eight works."""
    return F.least(F.lit(1.0), F.col("recent_output") / 8)


def open_people(signals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Authors who are open: the override where there is one, else the stored flag."""
    both = signals.select("author", "opted_in").join(overrides.select("author", "is_open"), "author", "left")
    return both.filter(F.coalesce("is_open", "opted_in", F.lit(False))).select("author")


def stored_explanations(people: DataFrame, themes: DataFrame, authorship: DataFrame, works: DataFrame) -> DataFrame:
    """author, explanation (E2): themes(author, theme_name) are people's best ones; the paper is the newest, the first listed of equal ones.

    works(work, title, year, seq): seq is the order in which papers are listed. A work without a year is the oldest.
    """
    order = F.struct(F.coalesce("year", F.lit(-1)), -F.col("seq"))
    paper = authorship.join(works, "work").groupBy("author").agg(F.max_by("title", order).alias("title"))
    told = F.format_string("%s matches through “%s” and the %s theme.", "name", "title", "theme_name")
    return people.select("author", "name").join(paper, "author").join(themes.select("author", "theme_name"), "author").select("author", told.alias("explanation"))
