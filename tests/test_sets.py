"""Member sets against Python sets."""

from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from densegrid import combine_sets, list_members, member_sets, set_sizes

IDS = st.one_of(st.integers(-70, 70), st.integers(-(1 << 62), 1 << 62), st.none())
ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), IDS), max_size=40)
RULES = {"union": set.union, "intersect": set.intersection, "minus": set.difference}


def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, id bigint")


def as_sets(rows):
    out = defaultdict(set)
    for g, i in rows:
        if i is not None:
            out[g].add(i)
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS, ROWS)
def test_sets_are_python_sets(spark, left, right):
    a, b = (member_sets(frame(spark, rows), ["g"], "id") for rows in (left, right))
    own, other = as_sets(left), as_sets(right)
    listed = [tuple(r) for r in list_members(a, ["g"], "id").collect()]
    assert sorted(listed, key=repr) == sorted(((g, i) for g, ids in own.items() for i in ids), key=repr)
    assert {r["g"]: r["n_members"] for r in set_sizes(a, ["g"]).collect()} == {g: len(ids) for g, ids in own.items()}
    for how, rule in RULES.items():
        found = as_sets(tuple(r) for r in list_members(combine_sets(a, b, ["g"], how), ["g"], "id").collect())
        wanted = {g: rule(own.get(g, set()), other.get(g, set())) for g in {*own, *other}}
        assert found == {g: ids for g, ids in wanted.items() if ids}


def test_one_group_with_most_ids_is_many_small_rows(spark):
    rows = spark.range(100_000).selectExpr("IF(id % 10 = 0, id, 0) AS g", "id").union(spark.range(100_000).selectExpr("0L AS g", "id"))
    sets = member_sets(rows, ["g"], "id")
    assert sets.filter("g = 0").count() == 100_000 // 32
    assert set_sizes(sets, ["g"]).filter("g = 0").first()["n_members"] == 100_000


def test_unknown_operation(spark):
    empty = member_sets(frame(spark, []), ["g"], "id")
    assert empty.count() == 0
    with pytest.raises(ValueError, match="unknown set operation"):
        combine_sets(empty, empty, ["g"], "xor")
