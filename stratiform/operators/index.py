"""A stored retrieval index over a bank's vectors: cells around coarse centres, in blocks, reused while the bank stays.

A version lies in a folder named by the fingerprint of model, protocol, settings and all vectors, and counts only once its
manifest is written, the last of its tables: a build that broke off is done anew, one that is whole is read as it is. One
writer at a time may build at a path. Nothing but the centres (``MODEL_BYTES`` at most) reaches the driver.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources import sinks
from ..sources.scratch import exists, kept
from . import bank

#: Size of all centres, which every task gets: bounds the number of cells, 4096 of them at 512 dimensions.
MODEL_BYTES = 1 << 24
#: Scores of vectors by cells that a task holds at once, and so the most (query, cell) pairs in a batch.
SCORES = 1 << 17
#: Blocks of a cell in one file.
FILE_BLOCKS = 16
#: How far a bound may lie under a score before its cell is left out: rankings go by nine digits.
MARGIN = 1e-8


@dataclasses.dataclass(frozen=True)
class IndexConfig:
    """``cells``: the square root of the number of vectors where none is given. Centres are fitted on the ``sample`` vectors
    of least hash under ``seed``, in ``rounds`` rounds; every vector of the bank is assigned and stored."""

    cells: int | None = None
    sample: int = 16_384
    rounds: int = 10
    seed: int = 7


@dataclasses.dataclass(frozen=True)
class Index:
    """``blocks``: cell, share, ids, vecs (unit vectors, float64). ``cells``: cell, centre, n, shares, radius (the widest
    angle between the centre and a vector of the cell)."""

    path: str
    blocks: DataFrame
    cells: DataFrame
    manifest: DataFrame


_BLOCK = "cell int, share int, ids array<long>, vecs binary"
_CELL = "cell int, centre array<double>, n long, shares int, radius double"
_MANIFEST = "nodes long, digest string, model string, protocol string, stored long, cells int"


def _units(vecs: pd.Series) -> np.ndarray:
    x = np.stack(vecs.to_numpy()).astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n <= V.TINY_NORM, 1.0, n)


def _few(batches: Iterator[pd.DataFrame], cells: int) -> Iterator[pd.DataFrame]:
    """Rows few enough at a time that their scores to all cells are ``SCORES`` at most."""
    step = max(1, SCORES // max(1, cells))
    for b in batches:
        for lo in range(0, len(b), step):
            yield b.iloc[lo : lo + step]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, SCORES // len(centres))
    return np.concatenate([np.argmax(x[lo : lo + step] @ centres.T, axis=1) for lo in range(0, len(x), step)])


def fitted_centres(nodes: DataFrame, cells: int, cfg: IndexConfig) -> np.ndarray:
    """At most ``cells`` unit centres by spherical K-means over the sample, in one task."""
    some = nodes.select("node_id", "vec").orderBy(F.xxhash64("node_id", F.lit(cfg.seed)), "node_id").limit(cfg.sample).coalesce(1)

    def fit(batches):
        held = [b.vec for b in batches if len(b)]
        if not held:
            return
        x = np.unique(np.concatenate([_units(v) for v in held]), axis=0)
        rng = np.random.default_rng(cfg.seed)
        centres = x[rng.permutation(len(x))[:cells]]
        for _ in range(cfg.rounds):
            near = _nearest(x, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > V.TINY_NORM, sums / np.where(length > V.TINY_NORM, length, 1.0), centres)
        yield pd.DataFrame({"centre": list(centres)})

    got = some.mapInPandas(fit, "centre array<double>").collect()  # at most MODEL_BYTES
    return np.array([r.centre for r in got])


def _blocked(rows: DataFrame, ident: str, counts: DataFrame) -> DataFrame:
    """Rows (ident, cell, unit) as blocks of some ``BLOCK_VECTORS`` of one cell; a cell of many rows is dealt to as many
    shares as it needs, so none is one task's. ``counts`` has a row a cell: cell, shares."""
    dealt = rows.join(F.broadcast(counts.select("cell", "shares")), "cell").withColumn("share", F.pmod(F.xxhash64(ident), F.col("shares")).cast("int"))
    placed = dealt.repartition("cell", (F.col("share") / FILE_BLOCKS).cast("int")).sortWithinPartitions("cell", "share", ident)

    def run(batches):
        key, ids, vecs = None, [], []

        def block():
            return pd.DataFrame({"cell": [key[0]], "share": [key[1]], "ids": [np.concatenate(ids)], "vecs": [b"".join(vecs)]})

        for b in batches:
            for at, g in b.groupby(["cell", "share"], sort=False):
                if key is not None and at != key:
                    yield block()
                    ids, vecs = [], []
                key = at
                ids.append(g[ident].to_numpy(np.int64))
                vecs.append(b"".join(g.unit))
        if key is not None:
            yield block()

    return placed.select(ident, "cell", "share", "unit").mapInPandas(run, _BLOCK)


def _shares(n: Column) -> Column:
    return F.ceil(n / bank.BLOCK_VECTORS).cast("int")


def _whole(rows: DataFrame, ident: str) -> DataFrame:
    return rows.where(F.col(ident).isNotNull() & F.col("vec").isNotNull()).select(ident, "vec")


def _version(nodes: DataFrame, path: str, model: str, protocol: str, cfg: IndexConfig) -> tuple[str, object]:
    told = nodes.select("node_id", F.sha2(F.concat_ws(",", F.col("vec").cast("array<string>")), 256).alias("sha256"))
    seen = sinks.index_fingerprint(told, model, protocol).first()
    name = "\n".join(map(str, (model, protocol, seen.nodes, seen.digest, *dataclasses.astuple(cfg))))
    return f"{path}/{nodes.sparkSession.range(1).select(F.substring(F.sha2(F.lit(name), 256), 1, 16)).first()[0]}", seen


def opened(spark: SparkSession, at: str) -> Index:
    read = lambda schema, what: spark.read.schema(schema).parquet(f"{at}/{what}")
    return Index(at, read(_BLOCK, "blocks"), read(_CELL, "cells"), read(_MANIFEST, "manifest"))


def ensured(nodes: DataFrame, path: str, model: str, protocol: str, cfg: IndexConfig | None = None) -> tuple[Index, bool]:
    """The index of nodes (node_id long, vec) under ``path``, and whether it was built now.

    It is read if a whole one of the same model, protocol, settings and vectors is there, in any order of rows, and built
    otherwise. Nodes without id or vector cannot be found and are not stored; an empty bank has an index without cells;
    vectors of unequal length fail; other columns are ignored.
    """
    cfg, spark, nodes = cfg or IndexConfig(), nodes.sparkSession, _whole(nodes, "node_id")
    at, seen = _version(nodes, path, model, protocol, cfg)
    if exists(spark, f"{at}/manifest/_SUCCESS"):
        return opened(spark, at), False
    dims = nodes.select(F.max(F.size("vec"))).first()[0] or 1
    wanted = cfg.cells or max(1, math.isqrt(seen.nodes))
    centres = fitted_centres(nodes, max(1, min(wanted, MODEL_BYTES // (8 * dims))), cfg)

    def assign(batches):
        for b in _few(batches, len(centres)):
            x = _units(b.vec)
            s = x @ centres.T
            near = np.argmax(s, axis=1)
            angle = np.arccos(np.clip(s[np.arange(len(x)), near], -1, 1))
            yield pd.DataFrame({"node_id": b.node_id.to_numpy(), "cell": near.astype(np.int32), "unit": [v.tobytes() for v in x], "angle": angle})

    assigned = kept(nodes.mapInPandas(assign, "node_id long, cell int, unit binary, angle double"))
    counts = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).withColumn("shares", _shares(F.col("n")))
    places = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    places.join(counts, "cell").select("cell", "centre", "n", "shares", "radius").coalesce(1).write.mode("overwrite").parquet(f"{at}/cells")
    cells = spark.read.schema(_CELL).parquet(f"{at}/cells")
    _blocked(assigned, "node_id", cells).write.mode("overwrite").partitionBy("cell").parquet(f"{at}/blocks")
    stored = spark.read.schema(_BLOCK).parquet(f"{at}/blocks").agg(F.sum(F.size("ids"))).first()[0] or 0
    if stored != seen.nodes:
        raise ValueError(f"{stored} of {seen.nodes} vectors are in the index")
    about = [(seen.nodes, seen.digest, model, protocol, stored, len(centres))]
    spark.createDataFrame(about, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{at}/manifest")
    return opened(spark, at), True


def calibrated(index: Index, nodes: DataFrame, k: int, recall: float = 0.95, sample: int = 256, seed: int = 11) -> int:
    """The least number of cells a query has to meet so that ``recall`` of the k nearest of ``sample`` nodes, those of least
    hash under ``seed``, lie in them: how many nearer centres the cell of each exact neighbour has is counted, not guessed."""
    asked = kept(_whole(nodes, "node_id").orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(sample).withColumnRenamed("node_id", "query_id"))
    held = index.cells.select("cell", "centre").orderBy("cell").collect()  # at most MODEL_BYTES
    if not held:
        return 1
    numbers, centres = np.array([r.cell for r in held], np.int32), np.array([r.centre for r in held])

    def places(batches):
        for b in batches:
            for lo in range(0, len(b), 64):
                some = b.iloc[lo : lo + 64]
                order = np.argsort(-(_units(some.vec) @ centres.T), axis=1, kind="stable")
                yield pd.DataFrame({"query_id": np.repeat(some.query_id.to_numpy(np.int64), len(held)), "cell": numbers[order].ravel(), "place": np.tile(np.arange(1, len(held) + 1, dtype=np.int32), len(some))})

    found = searched(index, asked, k, probes=8, exact=True).select("query_id", "node_id")
    cell_of = index.blocks.select("cell", F.explode("ids").alias("node_id")).join(F.broadcast(found), "node_id")  # sample times k rows
    met = cell_of.join(asked.mapInPandas(places, "query_id long, cell int, place int"), ["query_id", "cell"])
    return int(met.agg(F.expr(f"percentile_disc({recall}) WITHIN GROUP (ORDER BY place)").alias("p")).first().p or 1)


def searched(index: Index, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
    """query_id, node_id, score, rank: the k nodes of highest cosine to each query (query_id long, vec).

    A query meets the vectors of the ``probes`` cells whose centres are nearest. With ``exact`` it then meets those of every
    cell that could hold a better one than its k-th so far, as the angles between query, centre and the cell's farthest vector
    tell: the result is that of ``bank.dense_top_k``. Queries without id or vector have no rows; ties go to the smaller id.
    """
    held = index.cells.select("cell", "centre", "radius").orderBy("cell").collect()  # at most MODEL_BYTES
    if not held:
        return queries.sparkSession.createDataFrame([], "query_id long, node_id long, score double, rank int")
    numbers, radii, centres = np.array([r.cell for r in held], np.int32), np.array([r.radius for r in held]), np.array([r.centre for r in held])
    queries = kept(_whole(queries, "query_id"))

    def near(s: np.ndarray) -> np.ndarray:
        """Which cells each query meets first."""
        first = np.zeros(s.shape, bool)
        np.put_along_axis(first, np.argsort(-s, axis=1, kind="stable")[:, :probes], True, axis=1)
        return first

    def chosen(batches):
        for b in _few(batches, len(centres)):
            x = _units(b.vec)
            s = x @ centres.T
            meets = near(s)
            if "kth" in b:
                reach = np.cos(np.maximum(0.0, np.arccos(np.clip(s, -1, 1)) - radii))
                meets = ~meets & (reach >= b.kth.to_numpy(np.float64)[:, None] - MARGIN)
            row, column = np.nonzero(meets)
            unit = [v.tobytes() for v in x]
            yield pd.DataFrame({"query_id": b.query_id.to_numpy(np.int64)[row], "cell": numbers[column], "unit": [unit[i] for i in row]})

    def met(asked: DataFrame) -> DataFrame:
        asked = kept(asked.mapInPandas(chosen, "query_id long, cell int, unit binary"))
        counts = asked.groupBy("cell").agg(F.count("*").alias("n")).withColumn("shares", _shares(F.col("n")))
        cells = [r.cell for r in counts.select("cell").collect()]  # as many as there are cells, at most
        q = _blocked(asked, "query_id", counts).select("cell", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
        q = q.join(F.broadcast(index.cells.select("cell", "shares")), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "q_ids", "q_vecs")
        b = index.blocks.where(F.col("cell").isin(cells)).select("cell", "share", F.col("ids").alias("b_ids"), F.col("vecs").alias("b_vecs"))
        return b.join(q.hint("merge"), ["cell", "share"]).drop("cell", "share").mapInPandas(bank.best_of_blocks(k), "query_id long, node_id long, score double")

    first = bank.ranked(met(queries), k)
    if not exact:
        return first
    first = kept(first)
    so_far = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    more = met(queries.join(so_far, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0))))
    return bank.ranked(first.drop("rank").unionByName(more), k)
