"""Search columns against names: the index must give what plain `contains` gives."""

import pytest
from pyspark.sql import functions as F

from paircast.constants import ARTICLES
from paircast.operators import odds

NAMES = ["Los Angeles Lakers", "LA Clippers", "New York Knicks", "aaa", "aaaa", "", None, "The The", "Ünïon", "of Lakes"] + [f"ring {i}" for i in range(40)]
SEARCHES = ["the Lakers", "LA", "york  ring", "aaa", "a", "", None, "The", "zzz", "ïon", "lake", "ring 1", "ring 1", " ", "s L"]


@pytest.fixture(scope="module")
def tables(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id long, name string")
    searches = spark.createDataFrame([(s, 1) for s in SEARCHES], "search string, id int")
    return names, searches


def test_names_with_any_word(tables):
    names, searches = tables
    got = {tuple(r) for r in odds.names_containing(searches, "search", names, "id", "name").collect()}
    want = {
        (s, i)
        for s in SEARCHES if s is not None
        for i, n in enumerate(NAMES) if n is not None
        if any(w in n.lower() for w in s.lower().split() if w not in ARTICLES)
    }
    assert got == want


def test_first_name_with_the_text(tables):
    names, searches = tables
    rows = odds.first_names_containing(searches, "search", names, "id", "name").collect()
    want = {}
    for s in filter(lambda s: s is not None, SEARCHES):
        hits = [i for i, n in enumerate(NAMES) if n is not None and s.lower() in n.lower()]
        if hits:
            want[s] = hits[0]
    assert {r.search: r.id for r in rows} == want and len(rows) == len(want)


def test_empty_tables(tables):
    names, searches = tables
    for few, many in ((searches.limit(0), names), (searches, names.limit(0))):
        assert odds.names_containing(few, "search", many, "id", "name").isEmpty()
        assert odds.first_names_containing(few, "search", many, "id", "name").isEmpty()


def test_no_pair_is_made_of_names_that_hold_no_rare_part(tables):
    names, searches = tables
    plan = odds.names_containing(searches, "search", names, "id", "name")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_search_broadcasts_nothing(spark):
    """Small files of many names must not be collected on the driver."""
    names = spark.createDataFrame([(1, "Small Ring"), (2, "small ring"), (3, "Gear"), (None, "ring")], "id int, name string")
    searches = spark.createDataFrame([("RING",), ("a",)], "search string")
    first = odds.first_names_containing(searches, "search", names, "id", "name")
    both = odds.names_containing(searches, "search", names, "id", "name")
    for df in (first, both):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, first.collect())) == [("RING", 1), ("a", 1)]
    assert sorted(map(tuple, both.collect())) == [("RING", 1), ("RING", 2)]
