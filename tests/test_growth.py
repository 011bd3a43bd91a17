"""What a task holds does not grow with the tables: rows are dealt to a number of tasks that does."""

import re

import pytest

import __spark_entry__ as entry
from terrane.operators import people
from terrane.sources import tables as S

SF = "/root/testdata/sf0.001"

CASES = [
    ("group_works", "author", "lineitem"),
    ("group_works", "work", "lineitem"),
    ("retained_works_by_author", "author", "lineitem"),
    ("person_lists", "author", "lineitem"),
    ("token_counts", "id", "documents"),
    ("closest_paper_per_person", "id", "documents"),
    ("explanation_text", "id", "documents"),
    ("author_composite", "person", "lineitem"),
    ("coauthor_lists", "author", "lineitem"),
]


@pytest.mark.parametrize(("name", "key", "table"), CASES)
def test_tasks_grow_with_the_table(spark, monkeypatch, name, key, table):
    monkeypatch.setattr(S, "SHARE", 4096)
    n = S.shares(S.table(spark, SF, table))
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(x) for x in re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert n > 4 and n in {x // k for x in dealt for k in (1, 2)}


def test_pairs_are_made_once(spark, monkeypatch):
    made = []
    pairs = people.coauthors
    monkeypatch.setattr(people, "coauthors", lambda *a, **b: made.append(1) or pairs(*a, **b))
    assert entry.queries()["group_metrics"](spark, SF).columns[0] == "community"
    assert len(made) == 1
