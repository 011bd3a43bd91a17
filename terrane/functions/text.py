"""Tokens, chunks, names and vector expressions, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never enter the vocabulary.
STOP_WORDS = (
    "a an and are as at be been by can for from has have in into is it its of on or our that the their this to using via was were with within "
    "study studies research analysis approach based effects effect new role among between toward towards"
).split()

TOKEN = r"([\p{L}\p{N}][\p{L}\p{N}-]{2,})"


def tokens(text: Column | str) -> Column:
    """Lower-case words of three characters or more, stop words included."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def content_tokens(text: Column | str) -> Column:
    """tokens() without stop words."""
    return F.filter(tokens(text), lambda w: ~w.isin(STOP_WORDS))


def chunks(text: Column | str, size: int = 180) -> Column:
    """Runs of `size` words, as texts."""
    w = F.split(text, r"\s+")
    return F.transform(F.sequence(F.lit(1), F.size(w), F.lit(size)), lambda i: F.array_join(F.slice(w, i, size), " "))


def publication_text(title: str = "title", abstract: str = "abstract", venue: str = "venue") -> Column:
    """Title, abstract and venue; what is missing is empty."""
    return F.concat(F.col(title), F.lit(". "), F.coalesce(abstract, F.lit("")), F.lit(" "), F.coalesce(venue, F.lit("")))


def person_text(name: str = "name", departments: str = "departments", texts: str = "texts") -> Column:
    """Name, departments and works."""
    return F.array_join(F.concat(F.array(name), departments, texts), ". ")


def plausible_name(name: Column | str) -> Column:
    """Two words or more with two letters or more each (C3). people.with_plausible() folds compatibility forms first."""
    word = F.regexp_extract_all(name, F.lit(r"(\p{L}[\p{L}\p{M}'’-]*)"), F.lit(1))
    return F.size(F.filter(word, lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2)) >= 2


def valid_date(text: Column | str) -> Column:
    """The text if it looks like a date, else null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)


def short_id(url: Column | str, prefix: str) -> Column:
    """An identifier without its prefix."""
    return F.regexp_replace(url, "^" + prefix.replace(".", r"\."), "")


def first_filled(*cols: Column | str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def rebuilt(index: Column | str) -> Column:
    """Text of a map word -> positions (I1). Gaps are empty words, the last word of a position counts; null without positions.

    Positions are sorted once, and each brings the blanks since the one before: what a lambda names besides its own variables
    is worked out again for every element, so the sorted array is itself a variable.
    """
    entry = lambda e, i: F.transform(F.filter(e["value"], lambda p: p >= 0), lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))
    in_order = F.sort_array(F.flatten(F.transform(F.map_entries(index), entry)))

    def text(s: Column) -> Column:
        blanks = lambda x, i: F.repeat(F.lit(" "), x["p"] - F.coalesce(F.get(s, i - 1)["p"], F.lit(0)))
        word = lambda x, i: F.when(F.get(s, i + 1)["p"] == x["p"], "").otherwise(x["w"])
        return F.when(F.size(s) > 0, F.array_join(F.transform(s, lambda x, i: F.concat(blanks(x, i), word(x, i))), ""))

    return F.transform(F.array(in_order), text)[0]


def replace_all(text: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Replacements one after another."""
    out = F.col(text) if isinstance(text, str) else text
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def valid_label(name: Column | str, description: Column | str) -> Column:
    """Four to eight words without / , ; |, and a full sentence that does not begin with "Research on" (K9)."""
    name, description = (F.col(c) if isinstance(c, str) else c for c in (name, description))
    n = F.size(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""))
    return n.between(4, 8) & ~name.rlike(r"[/,;|]") & ~description.rlike(r"(?i)^Research on\b") & description.rlike(r"[.!?]\s*$")


def as_double(vector: Column | str) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products, from left to right (V1)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def percent(score: Column | str) -> Column:
    """Score as a whole percentage, halves up."""
    return F.floor((F.col(score) if isinstance(score, str) else score) * 100 + 0.5)
