"""Ingestion: upserts, attribute merges, grants, gates, robots rules, the synthetic corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(rows: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """One row per key, that of the greatest sequence (I8)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in seq]))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def first_wins(rows: DataFrame, key: str, seq: list[str], first: list[str], union: list[str]) -> DataFrame:
    """Attributes from the first row of each key, sets over all its rows, sorted."""
    order = F.struct(*seq)
    return rows.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in first], *[F.array_sort(F.collect_set(c)).alias(c + "_set") for c in union])


def affiliated(authorships: str, institution: str):
    """Entries of an authorship array with the institution among theirs (I4)."""
    return F.filter(authorships, lambda a: F.exists(a["institutions"], lambda i: i["id"] == institution))


def proof(people: DataFrame, works: DataFrame) -> DataFrame:
    """One row, or an error unless there are a real name, a real title and a person with a work.

    A real title has eight characters or more and does not call itself a research paper or publication.
    """
    real = F.coalesce(F.bool_or(F.col("name").rlike(r"^[\p{L}][\p{L} .,'’()-]{2,}$")), F.lit(False))
    p = people.agg(real.alias("names"), F.coalesce(F.bool_or(F.size("publications") > 0), F.lit(False)).alias("works"))
    t = works.agg(F.coalesce(F.bool_or((F.length("title") >= 8) & ~F.col("title").rlike("(?i)^research (paper|publication)")), F.lit(False)).alias("titles"))
    ok = F.col("names") & F.col("works") & F.col("titles")
    return p.crossJoin(t).select(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("no proof of real data")).cast("boolean")).alias("proved"))


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, text) of robots files -> host, seq, path, allow: the rules for everyone or for `agent`, in the order of the file.

    A line's comment is cut; the latest user-agent line above a rule says whom it is for.
    """
    raw = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("seq", "line"))
    cut = F.trim(F.regexp_replace("line", "#.*$", ""))
    pair = raw.select("host", "seq", F.split(cut, ":", 2).alias("kv")).filter((F.size("kv") == 2) & (F.col("kv")[0] != ""))
    pair = pair.select("host", "seq", F.lower(F.col("kv")[0]).alias("k"), F.trim(F.col("kv")[1]).alias("v"))
    named = F.when(F.col("k") == "user-agent", (F.col("v") == "*") | F.contains(F.lower("v"), F.lit(agent.lower())))
    above = Window.partitionBy("host").orderBy("seq")
    ours = pair.withColumn("ours", F.last(named, ignorenulls=True).over(above)).filter(F.col("ours") & F.col("k").isin("allow", "disallow"))
    return ours.select("host", "seq", F.col("v").alias("path"), (F.col("k") == "allow").alias("allow"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) and rules of robots_rules() -> host, path, allowed: of the rules that begin the path the longest decides, of equal ones the first; none allows.

    What follows a * in a rule does not count, rules without a path neither. Every beginning of a path is a key of an
    equi-join, so rules may have any number.
    """
    r = rules.filter("path != ''").select("host", F.regexp_replace("path", r"\*.*$", "").alias("begin"), F.struct(F.length("path").alias("n"), (-F.col("seq")).alias("first"), "allow").alias("rule"))
    begins = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    hit = urls.select("host", "path", F.explode(begins).alias("begin")).join(r, ["host", "begin"], "left")
    return hit.groupBy("host", "path").agg(F.coalesce(F.max("rule")["allow"], F.lit(True)).alias("allowed"))


#: Fixed values of the synthetic corpus.
DEPARTMENTS = (
    "Biology", "Chemistry", "Physics", "Psychology", "Computer Science", "Biomedical Engineering", "Earth and Environmental Sciences", "Public Health",
    "Political Science", "Sociology", "History", "English", "Mathematics", "Information Studies", "Architecture",
)
TOPICS = (
    "Climate resilience", "Machine learning", "Public health equity", "Quantum materials", "Civic media", "Neural development", "Water systems",
    "Digital humanities", "Autonomous systems", "Inclusive education", "Urban policy", "Cellular metabolism", "Cybersecurity", "Migration studies", "Renewable energy",
)
FIRST_NAMES = (
    "Avery", "Jordan", "Taylor", "Morgan", "Riley", "Casey", "Cameron", "Quinn", "Parker", "Reese",
    "Skyler", "Drew", "Alex", "Jamie", "Rowan", "Emerson", "Harper", "Dakota", "Hayden", "Finley",
)
LAST_NAMES = (
    "Adams", "Bennett", "Chen", "Diaz", "Evans", "Foster", "Gupta", "Hassan", "Ito", "Johnson",
    "Kim", "Lopez", "Martin", "Nguyen", "Owens", "Patel", "Rivera", "Singh", "Turner", "Williams",
)
ASPECTS = ("methods", "evidence", "systems", "applications")
FUNDERS = ("NSF", "NIH", "Department of Energy")


def _turn(values: tuple[str, ...], i: Column) -> Column:
    """The i-th value, round and round."""
    return F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))


def _person(i: Column, people: int) -> Column:
    return F.concat(F.lit("fallback-person-"), (i % people + 1).cast("string"))


def synthetic_corpus(spark: SparkSession, url: str = "", people: int = 300, each: int = 4) -> dict[str, DataFrame]:
    """people, publications and projects of a modular corpus (S6): every person leads `each` works, every other one a project."""
    i, j = F.col("i"), F.col("j")
    base = spark.range(people).select(F.col("id").alias("i"))
    dept, topic = _turn(DEPARTMENTS, i), _turn(TOPICS, i * 7)
    number = (i + 1).cast("string")
    work = lambda j: F.concat(F.lit("fallback-pub-"), number, F.lit("-"), (j + 1).cast("string"))
    project = F.concat(F.lit("fallback-project-"), number)
    next_one = _person(i + 1, people)
    works = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).select(
        work(j).alias("id"), F.concat(topic, F.lit(": "), _turn(ASPECTS, j), F.lit(" in "), dept).alias("title"),
        F.concat(F.lit("A study of "), F.lower(topic), F.lit(" using contemporary approaches from "), F.lower(dept), F.lit(", with implications for communities and future research.")).alias("abstract"),
        (2023 + j % 4).alias("year"), F.concat(F.lit("Journal of "), dept).alias("venue"), F.array(_person(i, people), _person(i + j + 1, people)).alias("author_ids"), F.lit(url).alias("url"),
    )
    projects = base.filter("i % 2 = 0").select(
        project.alias("id"), F.concat(F.lit("Advancing "), topic, F.lit(" across communities")).alias("title"),
        F.concat(F.lit("A sponsored research program investigating "), F.lower(topic), F.lit(".")).alias("description"), F.lit("2024-01-01").alias("start_date"),
        F.when(i % 4 == 0, "2027-12-31").otherwise("2025-12-31").alias("end_date"), _turn(FUNDERS, i).alias("funder"), F.array(_person(i, people), next_one).alias("person_ids"),
    )
    persons = base.select(
        _person(i, people).alias("id"), F.concat(_turn(FIRST_NAMES, i), F.lit(" "), _turn(LAST_NAMES, i * 3)).alias("name"),
        F.when(i % 5 == 0, "Associate Professor").otherwise("Professor").alias("title"), F.array(dept).alias("departments"), F.lit(url).alias("profile_url"),
        F.transform(F.sequence(F.lit(0), F.lit(each - 1)), work).alias("publications"), F.when(i % 2 == 0, F.array(project)).otherwise(F.array().cast("array<string>")).alias("projects"),
        F.array(F.struct(next_one.alias("id"), F.lit(4).alias("count"), F.lit(2026).alias("latest_year"))).alias("coauthors"), F.lit(True).alias("synthetic"),
    )
    return {"people": persons, "publications": works, "projects": projects}
