"""Each registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

from orrery.operators import graph
from orrery.plans.catalog import ORACLE_SQL, QUERIES
from orrery.plans.views import notices

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(got.column_names) == sorted(names)
    columns = [got[c].to_pylist() for c in names]
    left = sorted((tuple(plain(c[i]) for c in columns) for i in range(got.num_rows)), key=repr)
    assert left == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_topic_components_are_those_of_a_plain_search(spark, sf_dir):
    edges = graph.topic_edges(notices(spark, sf_dir), 0.5).select("a", "b").collect()
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    sizes = {}
    while near:
        seen, todo = set(), [next(iter(near))]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend(near.pop(n))
        sizes[min(seen)] = len(seen)
    assert {r.component: r.size for r in QUERIES["topic_components"](spark, sf_dir).collect()} == sizes and sizes


def test_every_query_is_compared_with_something():
    """Queries without SQL have tests of their own."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"topic_components", "evidence_pack"}


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
