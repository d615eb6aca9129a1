"""Line dedup by a log-template tree: templates that recur across documents are dropped.

A line's place in the tree is fixed in depth: its token count, then its leading tokens, then the
rest. Tokens that hold a digit are variables; a template must keep literal tokens for at least half of
the line, else it says nothing (rows of numbers would all be alike) and the line counts as it stands,
digits included. The rest is cut into segments; a template leaves one
segment open as a variable field, so lines that differ in one field share it. A line has one
template for each open segment and one with none. A template recurs if two or more documents have it.

Short lines (fewer than ``short`` tokens) meet by chance. Such a line counts as it stands together
with the lines before it (at the text's start, with those after it) that make up ``short`` tokens, or
with the whole of a shorter text: a passage that recurs takes its short lines along. Alone it recurs
if at least ``short_texts`` texts have its template.

A recurring line stays in the document with the smallest id of those that share its template, and is
dropped from all others, copies of whole documents included: of those nothing but blank lines stays.

Only hashes are grouped, with partial minima and maxima, so a line in a third of all documents
costs one row per task. Both joins are merged at every size: what they would broadcast grows with
the input. Defined cases: null stays null and empty stays empty; blank lines are never dropped; rows
with one id are one document (``short_texts`` counts them apart), and rows without an id
are told apart by text and come after all ids (which must be under 2^62); any other columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import scratch

LEADING = 2
SEGMENTS = 4
#: Lines with fewer tokens count as short; texts that must have a short line for it to recur alone.
SHORT, SHORT_TEXTS = 8, 10
#: Fewer tokens never recur alone.
SHORTEST = 3
#: Ranks of rows without an id begin here.
LATE = 1 << 62
_VARIABLE = re.compile(rb"\S*[0-9]\S*")


def templates(line: bytes, short: int = SHORT) -> list[int]:
    """Hashes of the templates of a line: with no open segment, then, if it is not short, with each in turn.

    Templates with too few literal tokens are left out; for the first stands the line itself.
    """
    words = _VARIABLE.sub(b"<*>", line).split()
    n = len(words)
    literal = [w != b"<*>" for w in words]
    if 2 * sum(literal) < n:
        return [xxh64_intdigest(b"=" + b" ".join(line.split()))]
    head = b"%d %s" % (n, b" ".join(words[:LEADING]))
    rest = words[LEADING:]
    out = [xxh64_intdigest(head + b"\n" + b" ".join(rest))]
    if n >= short:
        edges = [len(rest) * i // SEGMENTS for i in range(SEGMENTS + 1)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if 2 * (sum(literal) - sum(literal[LEADING + a : LEADING + b])) >= n:
                out.append(xxh64_intdigest(b"%s\n%d %s <*> %s" % (head, k, b" ".join(rest[:a]), b" ".join(rest[b:]))))
    return out


def units(text: str | None, short: int = SHORT) -> tuple[list[bytes], list[int], list[bytes]]:
    """Lines of a text, their token counts, and what tells each apart: the line, or a short line with
    its passage; blank lines have none."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    sizes = [len(x.split()) for x in lines]
    if not any(0 < n < short for n in sizes):
        return lines, sizes, [x if n else b"" for x, n in zip(lines, sizes)]
    solid = [i for i, n in enumerate(sizes) if n]
    out = [b""] * len(lines)
    for at, i in enumerate(solid):
        if sizes[i] >= short:
            out[i] = lines[i]
            continue
        lo = hi = at
        n = sizes[i]
        while n < short and lo > 0:
            lo -= 1
            n += sizes[solid[lo]]
        while n < short and hi + 1 < len(solid):
            hi += 1
            n += sizes[solid[hi]]
        passage = b"\n".join(b" ".join(lines[k].split()) for k in solid[lo : hi + 1])
        out[i] = b"\0%d\n%s%s" % (at - lo, b"" if n >= short else b"\0", passage)
    return lines, sizes, out


def _ident(id_col: str, text_col: str) -> Column:
    """The id; without one, by the text, a number after all ids (of under 2^62)."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col).bitwiseAND(F.lit(LATE - 1)).bitwiseOR(F.lit(LATE)))


def _signed(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, np.uint64).view(np.int64)


def line_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT, shortest: int = SHORTEST) -> DataFrame:
    """A row per distinct unit of a text: ident, unit (hash), keys; of a short line alone (weak key) and
    whether this is its first in the text (0 or 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ident, unit, keys, alone, first = [], [], [], [], []
            for i, text in zip(b._ident, b._text):
                seen, weak = set(), set()
                for x, n, u in zip(*units(text, short)):
                    if not n or u in seen:
                        continue
                    seen.add(u)
                    ident.append(i)
                    unit.append(h := xxh64_intdigest(u, 42))
                    if n >= short:
                        keys.append(_signed(templates(x, short)))
                        alone.append(0)
                        first.append(-1)
                        continue
                    keys.append(_signed([h]))
                    key = templates(x, short)[0] if n >= shortest else 0
                    alone.append(key)
                    first.append(-1 if n < shortest else int(key not in weak))
                    weak.add(key)
            yield pd.DataFrame({"ident": np.array(ident, np.int64), "unit": _signed(unit), "keys": pd.Series(keys, dtype=object), "alone": _signed(alone), "first": np.array(first, np.int8)})

    return docs.select(_ident(id_col, text_col).alias("_ident"), F.col(text_col).alias("_text")).mapInPandas(run, "ident long, unit long, keys array<long>, alone long, first byte")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT, short_texts: int = SHORT_TEXTS, shortest: int = SHORTEST) -> DataFrame:
    """Per document with lines to drop: ident and the hashes ``drop`` of their units."""
    lines = scratch.materialise(line_templates(docs, id_col, text_col, short, shortest), "lines")
    strong = F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(None).cast("byte").alias("weak")))
    weak = F.when(F.col("first") >= 0, F.array(F.struct(F.col("alone").alias("key"), F.col("first").alias("weak")))).otherwise(F.array().cast("array<struct<key:long,weak:byte>>"))
    keyed = lines.select("ident", "unit", F.inline(F.concat(strong, weak)))
    seen = keyed.groupBy("key").agg(F.min("ident").alias("first"), F.max("ident").alias("last"), F.sum("weak").alias("texts"))
    seen = scratch.materialise(seen.where(F.expr(f"first < last AND coalesce(texts >= {short_texts}, true)")).select("key", "first"), "templates")
    met = keyed.select("ident", "unit", "key").join(seen.hint("merge"), "key").where("ident <> first")
    drop = scratch.materialise(met.groupBy("ident").agg(F.collect_set("unit").alias("drop")), "drops")
    scratch.forget(lines, seen)
    return drop


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, short: int = SHORT, short_texts: int = SHORT_TEXTS, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with recurring lines taken out of the texts; ``count_col``: also say how many."""
    names = docs.columns
    drop = recurring_lines(docs, id_col, text_col, short, short_texts, shortest)

    @F.pandas_udf("text string, dropped long")
    def without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        """Texts without the lines of some units; null where there is nothing to drop."""
        out, n = [], []
        for text, gone in zip(texts, drops):
            if text is None:
                out.append(None)
                n.append(0)
                continue
            gone = set(gone.tolist())
            lines, sizes, apart = units(text, short)
            stay = [x for x, k, u in zip(lines, sizes, apart) if not k or _as_long(xxh64_intdigest(u, 42)) not in gone]
            out.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
            n.append(len(lines) - len(stay))
        return pd.DataFrame({"text": out, "dropped": np.array(n, np.int64)})

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), _ident(id_col, text_col).alias("ident"))
    text = F.col(f"_row.`{text_col}`")
    joined = rows.join(drop.hint("merge"), "ident", "left")
    joined = joined.withColumn("_new", without(F.when(F.col("drop").isNotNull(), text), F.col("drop")))
    out = [F.when(F.col("drop").isNull(), text).otherwise(F.col("_new.text")).alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in names]
    if count_col:
        out.append(F.col("_new.dropped").alias(count_col))
    return joined.select(*out)


def _as_long(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h
