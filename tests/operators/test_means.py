import numpy as np
from pyspark.sql import functions as F

from stratiform.functions import vectors as V
from stratiform.operators import refinement
from stratiform.streaming import propagation


def test_means_spread_and_projection_are_those_of_numpy(spark, monkeypatch):
    monkeypatch.setattr(V, "MOST_SUMS", 3)
    x = np.random.default_rng(5).normal(size=(90, 4))
    rows = spark.createDataFrame([(f"c{i % 7}", v.tolist()) for i, v in enumerate(x)] + [("c0", None), ("none", None)], "c string, vec array<double>").repartition(5)
    got = {r.c: r.vec for r in V.means(rows, "c", "vec").collect()}
    assert sorted(got) == [f"c{i}" for i in range(7)]
    assert all(np.allclose(got[f"c{i}"], x[i::7].mean(axis=0)) for i in range(7))
    basis = [[1.0, 0.0, 2.0, 0.0], [0.0, -1.0, 0.0, 0.5]]
    flat = rows.select("vec", V.projected(F.col("vec"), [1.0, 2.0, 3.0, 4.0], basis).alias("p")).collect()
    assert all(r.p is None if r.vec is None else np.allclose(r.p, np.array(basis) @ (np.array(r.vec) - [1, 2, 3, 4])) for r in flat)
    entries = spark.createDataFrame([(1, 0, 0.5), (1, 3, -0.5), (2, 1, 1.0)], "k long, dim int, value double")
    assert {r.k: r.vector for r in V.dense(entries, "k", 4).collect()} == {1: [0.5, 0.0, 0.0, -0.5], 2: [0.0, 1.0, 0.0, 0.0]}


def test_packs_beyond_a_thousand_keep_their_own_names(spark):
    rows = spark.range(1100).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("item_id"), F.lit("C").alias("community_id"), F.lit(1.0).alias("w"), F.lit(5).cast("long").alias("tokens"))
    assert refinement.packs_of(rows, 5).select("community_id").distinct().count() == 1100


def test_vectors_come_to_length_one_within_the_projection(spark):
    x = [[3.0, 4.0], [0.0, 0.0], None, [0.0, -2.0]]
    items = spark.createDataFrame([(i, 1.0, v) for i, v in enumerate(x)], "item_id long, support_mass double, vec array<float>")
    got = {r.item_id: r.x for r in propagation.projected_arrivals(items, [0.1, 0.2], [[1.0, 1.0]]).collect()}
    assert got[2] is None and np.allclose([got[0][0], got[1][0], got[3][0]], [1.1, -0.3, -1.3])
