"""The stored index: exact search against all pairs, recall of calibrated search, reuse, builds that broke off, edges."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.operators import bank, index
from stratiform.plans import catalog
from stratiform.sources.scratch import new_path

SF = "/root/testdata/sf0.1"


def rows_of(found):
    return sorted((r.query_id, r["rank"], r.node_id, round(r.score, 8)) for r in found.collect())


@pytest.fixture(scope="module")
def crowded(spark):
    """Nodes of which a third are one vector, with zero vectors, a missing one and a missing id; queries among them."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 8))
    x[300:600] = x[0]
    x[600:605] = 0
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x"), (None, x[1].tolist(), "x")]
    nodes = spark.createDataFrame(rows, "node_id long, vec array<double>, cell string").repartition(5)
    asked = nodes.where("node_id % 50 = 0 or node_id is null").select(F.col("node_id").alias("query_id"), "vec")
    return nodes, asked


@pytest.mark.parametrize("block", [16, 2048])
def test_exact_search_is_that_of_all_pairs(spark, crowded, block, monkeypatch):
    monkeypatch.setattr(bank, "BLOCK_VECTORS", block)
    nodes, asked = crowded
    stored, built = index.ensured(nodes, new_path(spark, "index"), "m", "p", index.IndexConfig(cells=20, sample=500))
    assert built
    cells = stored.cells.collect()
    assert sum(c.n for c in cells) == 900 and max(c.shares for c in cells) >= 300 // block
    whole = lambda t, i: t.where(F.col(i).isNotNull() & F.col("vec").isNotNull())
    want = rows_of(bank.dense_top_k(whole(asked, "query_id"), whole(nodes, "node_id"), 7))
    assert rows_of(index.searched(stored, asked, 7, probes=1, exact=True)) == want
    assert rows_of(index.searched(stored, asked, 7, probes=20)) == want
    few = rows_of(index.searched(stored, asked, 7, probes=1))
    assert {r[0] for r in few} == {r[0] for r in want} and few != want


def test_more_neighbours_than_nodes(spark, crowded):
    nodes, asked = crowded
    some = nodes.where("node_id < 5")
    stored, _ = index.ensured(some, new_path(spark, "index"), "m", "p")
    got = rows_of(index.searched(stored, asked.where("query_id = 0"), 7, probes=1, exact=True))
    assert [r[1] for r in got] == [1, 2, 3, 4, 5] and {r[2] for r in got} == set(range(5))


def test_recall_of_calibrated_search(spark):
    nodes = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vec"))
    stored, _ = index.ensured(nodes, new_path(spark, "index"), "m", "p")
    probes = index.calibrated(stored, nodes, 10)
    print(probes, stored.cells.count())
    assert 1 < probes < stored.cells.count()
    assert index.calibrated(stored, nodes, 10, recall=0.5) < probes
    rows = catalog.QUERIES["index_recall"](spark, SF).collect()
    assert len(rows) == 40 and all(r.n_exact == 10 for r in rows)
    assert sum(r.n_found for r in rows) / sum(r.n_exact for r in rows) >= 0.9


def test_a_build_that_broke_off_is_done_anew(spark, crowded):
    nodes, asked = crowded
    at = new_path(spark, "index")
    stored, _ = index.ensured(nodes, at, "m", "p")
    want = rows_of(index.searched(stored, asked, 3, probes=2))
    os.remove(stored.path.removeprefix("file://") + "/manifest/_SUCCESS")
    again, built = index.ensured(nodes, at, "m", "p")
    assert built and again.path == stored.path and rows_of(index.searched(again, asked, 3, probes=2)) == want
    assert not index.ensured(nodes.repartition(3), at, "m", "p")[1]
    assert index.ensured(nodes, at, "m", "other")[1]
    changed = nodes.withColumn("vec", F.when(F.col("node_id") == 3, F.transform("vec", lambda x: -x)).otherwise(F.col("vec")))
    assert index.ensured(changed, at, "m", "p")[1]


def test_empty_bank_and_no_queries(spark, crowded):
    nodes, asked = crowded
    none, built = index.ensured(nodes.where("false"), new_path(spark, "index"), "m", "p")
    assert built and none.manifest.first().stored == 0 and index.searched(none, asked, 3).count() == 0
    stored, _ = index.ensured(nodes, new_path(spark, "index"), "m", "p")
    assert index.searched(stored, asked.where("false"), 3, exact=True).count() == 0
