"""Vectors held as array<double>: products, norms, bases, hashed bags of words."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .text import BANK_TOKEN

TINY_NORM = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Length one; a vector of next to no length stays as it is."""
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / F.when(n > TINY_NORM, n).otherwise(1.0))), 1)


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def projected(v: Column, mean: list[float], rows: list[list[float]], unit: bool = False) -> Column:
    """(v - mean) on each row of a saved basis, v at length one if ``unit`` says so; a null vector has none.

    Give it a column, not ``normalised`` of one: Spark does not find a Python function again whose argument has lambdas in
    lambdas, since such an expression differs from itself in canonical form, and fails when it comes to the rows.
    """
    m, basis = np.array(mean, np.float64), np.array(rows, np.float64).T

    @F.pandas_udf(ArrayType(DoubleType()))
    def on(vecs: pd.Series) -> pd.Series:
        out, some = pd.Series([None] * len(vecs), dtype=object), np.flatnonzero(vecs.notna())
        if len(some):
            x = np.stack(vecs.to_numpy()[some]).astype(np.float64)
            if unit:
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(n > TINY_NORM, n, 1.0)
            out.iloc[some] = list((x - m) @ basis)
        return out

    return on(v)


def by_dimension(rows: DataFrame, keys: list[str], vec: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean of ``vec`` by ``keys`` and dimension: partial sums meet, vectors do not."""
    w = F.lit(1.0) if weight is None else weight
    flat = rows.select(*keys, w.alias("_w"), F.posexplode(vec).alias("dim", "x"))
    return flat.groupBy(*keys, "dim").agg((F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("mean"))


#: Groups whose sums a task holds at once.
MOST_SUMS = 4096


def means(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, vec): mean vector by key. A task sums its rows of a key, and the sums of tasks meet; no vector is shuffled or taken apart."""
    kind = rows.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def told() -> pd.DataFrame:
            return pd.DataFrame({key: pd.Series(list(held), dtype=object), "sums": [s for s, _ in held.values()], "n": [n for _, n in held.values()]})

        for b in batches:
            b = b[b[vec].notna()]
            if not len(b):
                continue
            code, names = pd.factorize(b[key], use_na_sentinel=False)
            order, n = np.argsort(code, kind="stable"), np.bincount(code)
            sums = np.add.reduceat(np.stack(b[vec].to_numpy()[order]).astype(np.float64), np.cumsum(n) - n, axis=0)
            for name, s, k in zip(names, sums, n.tolist()):
                was = held.get(name)
                held[name] = (s, k) if was is None else (was[0] + s, was[1] + k)
            if len(held) >= MOST_SUMS:
                yield told()
                held.clear()
        if held:
            yield told()

    def met(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: group[key].iloc[:1], vec: [np.sum(np.stack(group.sums.to_numpy()), axis=0) / group.n.sum()]})

    parts = rows.select(key, vec).mapInPandas(partial, f"{key} {kind}, sums array<double>, n long")
    return parts.groupBy(key).applyInPandas(met, f"{key} {kind}, {vec} array<double>")


#: Words whose place a task remembers.
MOST_WORDS = 1 << 19


def hashed_entries(rows: DataFrame, key: str, text: str, dims: int = 384) -> DataFrame:
    """Sparse hashed bag of words, length one: (key, dim, value).

    The first four bytes of a token's SHA-256 choose the dimension, the parity of the fifth the sign.
    Texts without tokens, or whose tokens cancel out, have no entry.

    Words are counted where their text is; what is shuffled is a text's numbers, by its key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token, places = re.compile(BANK_TOKEN.replace(r"\x{4e00}-\x{9fff}", "\u4e00-\u9fff")), {}

        def place(word: str) -> int:
            """Twice the dimension, and one more if the sign is negative."""
            h = hashlib.sha256(word.encode()).digest()
            return 2 * (int.from_bytes(h[:4], "big") % dims) + h[4] % 2

        for b in batches:
            for lo in range(0, len(b), 256):
                at, near, sums = [], [], []
                for i, t in enumerate(b._text.iloc[lo : lo + 256], lo):
                    v: dict[int, int] = {}
                    for word, n in Counter(token.findall(t)).items():
                        p = places.get(word)
                        if p is None:
                            if len(places) >= MOST_WORDS:
                                places.clear()
                            p = places[word] = place(word)
                        v[p >> 1] = v.get(p >> 1, 0) + (-n if p & 1 else n)
                    at += [i] * len(v)
                    near += v
                    sums += v.values()
                yield pd.DataFrame({key: b[key].iloc[at].reset_index(drop=True), "dim": np.array(near, np.int32), "v": np.array(sums, np.int64)})

    texts = rows.select(key, F.lower(text).alias("_text")).where(F.col(key).isNotNull() & F.col("_text").isNotNull())
    words = texts.mapInPandas(run, StructType([texts.schema[key], StructField("dim", IntegerType()), StructField("v", LongType())]))
    summed = words.repartition(key).groupBy(key, "dim").agg(F.sum("v").cast("double").alias("v")).where("v <> 0")
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return summed.select(key, "dim", (F.col("v") / length).alias("value"))


def dense(entries: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, vector) of sparse entries."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def spread(at: pd.Series, values: pd.Series) -> pd.Series:
        out = np.zeros((len(at), dims))
        if len(at):
            out[np.repeat(np.arange(len(at)), at.map(len)), np.concatenate(at.to_numpy())] = np.concatenate(values.to_numpy())
        return pd.Series(list(out))

    held = entries.groupBy(key).agg(F.collect_list(F.struct("dim", "value")).alias("_e"))
    return held.select(key, spread(F.col("_e.dim"), F.col("_e.value")).alias("vector"))
