"""From landed works to the corpus: publications, people, projects, links (works are rows of WORK plus seq, their order of arrival)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.text import first_filled, rebuilt, short_id, valid_date
from terrane.operators.ingest import affiliated, first_wins, last_wins
from terrane.sources.tables import write_json

#: Schema of one work, as pages hold it.
WORK = """id string, doi string, title string, publication_year int, publication_date string,
  primary_location struct<landing_page_url: string, source: struct<display_name: string>>,
  authorships array<struct<author: struct<id: string, display_name: string>, institutions: array<struct<id: string>>>>,
  abstract_inverted_index map<string, array<int>>, primary_topic struct<field: struct<display_name: string>>,
  awards array<struct<id: string, award_id: string, funder_id: string, funder: string, display_name: string, title: string, funder_display_name: string>>"""

NO_FIELD = "Interdisciplinary Research"


def accepted(works: DataFrame, institution: str, prefix: str, department: str | None = None) -> DataFrame:
    """Works with a title and a named author of the institution, in short ids: work, seq, title, ..., authors, author_ids."""
    of_ours = F.transform(affiliated("authorships", prefix + institution), lambda a: F.struct(short_id(a["author"]["id"], prefix).alias("id"), F.trim(a["author"]["display_name"]).alias("name")))
    authors = F.filter(of_ours, lambda a: (F.coalesce(a["id"], F.lit("")) != "") & (F.coalesce(a["name"], F.lit("")) != ""))
    out = works.select(
        short_id("id", prefix).alias("work"), "seq", F.trim("title").alias("title"), rebuilt("abstract_inverted_index").alias("abstract"),
        F.nullif(F.col("publication_year"), F.lit(0)).alias("year"), F.col("primary_location.source.display_name").alias("venue"),
        first_filled("doi", "primary_location.landing_page_url", "id").alias("url"), valid_date("publication_date").alias("date"),
        first_filled("primary_topic.field.display_name", F.lit(NO_FIELD)).alias("department"), authors.alias("authors"), "awards",
    )
    if department is not None:
        out = out.filter(F.col("department") == department)
    out = out.filter((F.size("authors") > 0) & (F.col("title") != ""))
    return out.withColumn("author_ids", F.array_distinct(F.transform("authors", lambda a: a["id"])))


def publications(works: DataFrame) -> DataFrame:
    """The last arrival of each work, in the place of its first: place (I8)."""
    place = works.groupBy("work").agg(F.min("seq").alias("place"))
    last = last_wins(works, "work", ["seq"]).select("work", "title", "abstract", "year", "venue", "author_ids", "url")
    return last.join(place, "work")


def authorship(works: DataFrame) -> DataFrame:
    """work, author, pos (from 1), n_authors of accepted publications."""
    return works.select("work", F.size("author_ids").cast("long").alias("n_authors"), F.posexplode("author_ids").alias("p", "author")).select("work", "author", (F.col("p") + 1).alias("pos"), "n_authors")


def people(works: DataFrame) -> DataFrame:
    """author, name (of the first arrival), departments (sorted) (I9). Works of a person stay rows: authorship()."""
    rows = works.select("seq", F.posexplode("authors").alias("pos", "a"), F.col("department").alias("departments"))
    got = first_wins(rows.select(F.col("a.id").alias("author"), "seq", "pos", F.col("a.name").alias("name"), "departments"), "author", ["seq", "pos"], ["name"], ["departments"])
    return got.withColumnRenamed("departments_set", "departments")


def grants(works: DataFrame, prefix: str, reporter: str) -> DataFrame:
    """work, author, seq, pos and the project that each award of a work names; awards without ids are passed over."""
    a = works.select("work", "seq", F.col("title").alias("of"), "date", "author_ids", F.posexplode("awards").alias("pos", "w"))
    a = a.withColumn("award", first_filled("w.award_id", "w.id")).withColumn("by", first_filled("w.funder_id", "w.funder")).filter("award is not null or by is not null")
    named = F.when(F.col("award").isNotNull(), F.concat(F.lit("Research award "), short_id("award", prefix))).otherwise(F.concat(F.lit("Research award linked to "), "of"))
    return a.select(
        F.concat_ws("-", F.lit("grant"), short_id(F.coalesce("by", F.lit("unknown")), prefix), short_id(F.coalesce("award", "work"), prefix)).alias("project"),
        "seq", "pos", first_filled("w.display_name", "w.title", named).alias("title"),
        F.concat(F.lit(f"Grant reported by {reporter} on the publication “"), "of", F.lit("”.")).alias("description"),
        F.col("date").alias("start_date"), first_filled("w.funder_display_name", short_id("by", prefix)).alias("funder"), F.explode("author_ids").alias("author"),
    )


def projects(granted: DataFrame) -> DataFrame:
    """project, title, description, start_date, funder of the first mention, person_ids of all."""
    order = F.struct("seq", "pos")
    firsts = [F.min_by(F.struct("title", "description", "start_date", "funder"), order).alias("m"), F.array_sort(F.collect_set("author")).alias("person_ids")]
    return granted.groupBy("project").agg(*firsts).select("project", "m.*", "person_ids")


def coauthor_lists(pairs: DataFrame, people: DataFrame, place: str | None = None) -> DataFrame:
    """Pairs (a, b, n, latest) of people who both exist -> author, coauthors: most shared works first.

    Ties keep the order of `place` (the first shared work's), then of ids.
    """
    for side in ("a", "b"):
        pairs = pairs.join(people.select(F.col("author").alias(side)), side, "left_semi")
    rows = coauthor_ranks(pairs, place)
    return rows.groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "n", "latest"))), lambda s: s.dropFields("pos")).alias("coauthors"))


def coauthor_ranks(pairs: DataFrame, place: str | None = None, parts: int | None = None) -> DataFrame:
    """The same as rows author, pos (from 0), id, n, latest, for pairs of people who are known to exist; dealt to `parts` tasks by author.

    Both sides of a pair are made of one row, so pairs are worked out once.
    """
    side = lambda x, y: F.struct(F.col(x).alias("author"), F.col(y).alias("id"))
    at = F.col(place) if place else F.lit(0)
    rows = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s"), "n", "latest", at.alias("at")).select("s.*", "n", "latest", "at")
    rows = rows.repartition(parts, "author") if parts else rows
    pos = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("n"), "at", "id")) - 1
    return rows.select("author", pos.alias("pos"), "id", "n", "latest")


def cleaned_projects(projects: DataFrame, found: DataFrame, proved: DataFrame) -> DataFrame:
    """Projects that `found` (project, author; C11) holds, with the people of `proved` (C12) in their order and no dates."""
    kept = projects.join(found.select("project"), "project", "left_semi")
    rows = kept.select("project", F.posexplode("person_ids").alias("p", "author")).join(proved.select("project", "author"), ["project", "author"], "left_semi")
    lists = rows.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "author"))), lambda s: s["author"]).alias("person_ids"))
    none = F.lit(None).cast("string")
    return kept.drop("person_ids").join(lists, "project").withColumn("start_date", none).withColumn("end_date", none)


def described(df: DataFrame, source: str, scope: str, synthetic: bool = False, at: Column | None = None) -> DataFrame:
    """The rows with what says where they are from: source, scope, synthetic, generated_at."""
    return df.withColumns({"source": F.lit(source), "scope": F.lit(scope), "synthetic": F.lit(synthetic), "generated_at": F.current_timestamp() if at is None else at})


def by_name(people: DataFrame) -> DataFrame:
    """People in the order of their names as a reader sorts them, then of arrival."""
    return people.orderBy(F.collate("name", "UNICODE"), "seq")


def write_corpus(folder: str, people: DataFrame, publications: DataFrame, projects: DataFrame, meta: dict[str, object]) -> None:
    """The corpus as JSON files in a folder: people by name, publications and projects as they are, and what describes them."""
    spark = people.sparkSession
    write_json(by_name(people), f"{folder}/people")
    write_json(publications, f"{folder}/publications")
    write_json(projects, f"{folder}/projects")
    write_json(described(spark.range(1), **meta).drop("id"), f"{folder}/meta")
