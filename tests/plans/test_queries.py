"""Every query of the library against its SQL, or for the rest against what must hold of its rows."""

import pytest

from stratiform.plans import catalog
from tests.oracle import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert rows_of_spark(catalog.QUERIES[name](spark, SF)) == rows_of_sql(con, catalog.ORACLE_SQL[name])


def test_the_sql_belongs_to_queries():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_packs_stay_within_the_budget_and_lose_nothing(spark, con):
    rows = catalog.QUERIES["budget_pack"](spark, SF).collect()
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    fill = {}
    for r in rows:
        assert (r.pack < 0) == (r.tokens > 4000)
        if r.pack >= 0:
            fill[r.community_id, r.pack] = fill.get((r.community_id, r.pack), 0) + r.tokens
    assert max(fill.values()) <= 4000


def test_tree_masses(spark):
    rows = catalog.QUERIES["tree_build"](spark, SF).collect()
    assert rows and len({(r.level, r.community_id) for r in rows}) == len(rows)
    assert all(r.token_cost <= 20_000 for r in rows)


def test_refined_leaves_hold_all_items(spark, con):
    rows = catalog.QUERIES["budget_refine"](spark, SF).collect()
    assert {int(r.item_id) for r in rows} == {i for (i,) in con.execute("SELECT vec_id FROM embeddings").fetchall()}
    assert len({r.community_id for r in rows}) > 2
