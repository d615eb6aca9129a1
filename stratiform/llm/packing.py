"""Best-fit packing of tokenised texts into sequences of a fixed length, by minimum bin slack.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver. There each bin
starts with the longest length left; a subset-sum over the lengths still available, kept as one
bit set, finds the fullest feasible rest, which is removed. A combination is used as often as its
lengths last, so the number of steps follows the number of distinct lengths, not of pieces. Tasks
then turn a piece's rank among those of its length into its sequence and offset.

Defined cases: a null or empty text is the end id alone; null and repeated ids are carried along,
each row being its own document; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


# ---- the plan: which lengths share a bin -------------------------------------------------------


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, with repeats, whose sum comes closest to ``room`` without passing it.

    ``counts``: how many of each length are left. Bit s of the set says that sum s is reachable;
    the set after each length is kept, and the sum is unwound through those.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in sorted((n for n in counts if n <= room), reverse=True):
        for _ in range(min(counts[size], room // size)):
            grown = (reach | reach << size) & mask
            if grown == reach:
                break
            steps.append((size, reach))
            reach = grown
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for size, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(size)
            total -= size
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of a bin) that use every piece of the histogram exactly once."""
    left, out = {n: c for n, c in histogram.items() if c > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest({n: c for n, c in left.items() if c}, capacity - longest)]
        left[longest] += 1
        need: dict[int, int] = defaultdict(int)
        for n in chosen:
            need[n] += 1
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((times, chosen))
    return out


def _runs(plan: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, copies in a bin, first sequence, first offset) by rank."""
    runs, used, sequence = defaultdict(list), defaultdict(int), 0
    for times, lengths in plan:
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            k = lengths.count(n)
            runs[n].append((used[n], k, sequence, offset))
            used[n] += k * times
            offset += k * n
        sequence += times
    return {n: np.array(r, np.int64) for n, r in runs.items()}


# ---- tasks -------------------------------------------------------------------------------------


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than ``capacity``."""
    head = n_ids % capacity or min(n_ids, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n_ids, capacity))]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, text_col: str = "text") -> DataFrame:
    """A row per piece, with its rank ``nth`` among the pieces of its length in its partition ``part``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ranks, enc, end = TaskContext.get().partitionId(), defaultdict(int), encoder(tokenizer_path), np.array([end_id], "<u4")
        for b in batches:
            rows = []
            for doc, of_text in zip(b._id, enc.encode_many(b._text)):
                ids = np.concatenate([of_text, end])
                for i, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, i, start, n, zlib.crc32(ids[start : start + n]), part, ranks[n]))
                    ranks[n] += 1
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECE.split(", ")])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, PIECE)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, text_col: str = "text") -> DataFrame:
    """Place the pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequence ids run from 0 to the number of sequences, less one; offsets in a sequence are gapless.
    """
    spark = docs.sparkSession
    pieces = scratch.materialise(tokenised_pieces(docs, tokenizer_path, capacity, end_id, text_col), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    per_part = scratch.materialise(per_part, "piece-counts")
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.sparkContext.broadcast(_runs(plan_bins(histogram, capacity)))  # a few rows for each length

    first = per_part.select("length", "part", F.expr("sum(n) OVER (PARTITION BY length ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n").alias("before"))
    ranked = pieces.join(first.hint("merge"), ["length", "part"])  # grows with the number of tasks
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            rank = b["rank"].to_numpy()
            for n, at in b.groupby("length").indices.items():
                r = runs.value[n]
                r = r[np.searchsorted(r[:, 0], rank[at], "right") - 1]
                bins, copy = np.divmod(rank[at] - r[:, 0], r[:, 1])
                sequence[at], offset[at] = r[:, 2] + bins, r[:, 3] + copy * n
            yield b.drop(columns="rank").assign(sequence_id=sequence, offset=offset, doc_id=b.doc_id.astype("Int64"))

    return ranked.mapInPandas(place, PLACED)


def sequences(placed: DataFrame) -> DataFrame:
    """A row per sequence: its pieces in order of offset and its fill."""
    return placed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length"))).alias("pieces"), F.sum("length").alias("fill")
    )
