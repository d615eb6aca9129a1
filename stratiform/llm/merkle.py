"""Document fingerprints: a Merkle tree over the sections, paragraphs and pieces of a text.

A paragraph is a line with its end; a blank one, or one whose hash says so, ends a section, so an
edit moves only the section ends near it. A paragraph is cut into pieces where a hash of the last
``WINDOW`` bytes says so, so pieces behind an edit are found again. A node's hash is that of its
children's hashes; equal roots are equal texts, and edits are located by going down only where
branches differ. A fingerprint is the root, then per section and paragraph the first bytes of the
pieces' hashes; two are alike by the share of pieces that they have in common.

``compare_edits`` needs each text's successor: rows are dealt out by ranges of their id once, each
task reads its range in order and holds two texts; the last text of a range and the first of the
next, two rows a task, meet in a join afterwards.

Defined cases: null and empty texts have no pieces, one root, and are alike; rows of one id follow
each other by their text's hash, equal rows in any order (their results are equal); null ids come
last; a table's only row is its own successor; very long texts are cut a slice at a time; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh3_128_hexdigest

from . import scratch

#: Bytes that decide on a cut; one place in so many is a cut; bounds of a piece; one paragraph in so many ends a section.
WINDOW, EVERY, SHORTEST, LONGEST, SECTION = 8, 48, 16, 256, 8
#: Paragraphs of fewer bytes are cut at one place in so many, into pieces of so many bytes at least.
SHORT, SHORT_EVERY, SHORT_SHORTEST = 128, 12, 4
#: Bytes of a text that are looked at together.
SLICE_BYTES = 1 << 20
#: Hexadecimal digits of a piece in a fingerprint.
DIGITS = 8
_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Node(NamedTuple):
    """A part of a text, its hash, place (bytes of UTF-8, end exclusive) and parts."""

    digest: bytes
    start: int
    end: int
    parts: tuple[Node, ...] = ()


def _places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of runs of ``WINDOW`` bytes whose hash says that a piece may end there, never inside a character; and which of
    them hold in paragraphs of any length."""
    found, wide = [], []
    for at in range(0, len(data), SLICE_BYTES):
        low = max(0, at - WINDOW + 1)
        b = np.frombuffer(data, np.uint8, min(len(data), at + SLICE_BYTES + 1) - low, low)
        n = len(b) - WINDOW + 1
        if n < 1:
            continue
        h = np.zeros(n, np.uint32)
        for k in range(WINDOW):
            h *= np.uint32(0x01000193)
            h += b[k : k + n]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(12)
        ends = np.flatnonzero(h[:-1] % np.uint32(SHORT_EVERY) == 0)
        ends = ends[(b[ends + WINDOW] & 0xC0) != 0x80]
        found.append(ends + WINDOW + low)
        wide.append(h[ends] % np.uint32(EVERY) == 0)
    return (np.concatenate(found), np.concatenate(wide)) if found else (np.zeros(0, np.int64), np.zeros(0, bool))


def _character_end(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _cuts(data: bytes, start: int, end: int, places: list[int], shortest: int) -> list[int]:
    """Ends of the pieces of the paragraph that is ``data[start:end]``, by the hashed ``places`` inside it."""
    cuts = []
    for place in [*places, end]:
        while place - start > LONGEST and (forced := _character_end(data, start + LONGEST)) < end:
            cuts.append(start := forced)
        if place == end or place - start >= shortest:
            cuts.append(start := place)
    return cuts


def tree(text: str | None) -> Node:
    """The Merkle tree of a text: sections, paragraphs, pieces."""
    data = (text or "").encode("utf-8", "surrogatepass")
    places, wide = _places(data)
    sections, paragraphs, start = [], [], 0
    while start < len(data):
        end = data.find(b"\n", start) + 1 or len(data)
        first, last = np.searchsorted(places, (start + WINDOW, end))
        pieces, at, short = [], start, end - start < SHORT
        inside = places[first:last]
        for cut in _cuts(data, start, end, (inside if short else inside[wide[first:last]]).tolist(), SHORT_SHORTEST if short else SHORTEST):
            pieces.append(Node(xxh3_128_digest(data[at:cut]), at, cut))
            at = cut
        digest = xxh3_128_digest(b"".join(p.digest for p in pieces), 1)
        paragraphs.append(Node(digest, start, end, tuple(pieces)))
        if end == len(data) or digest[-1] % SECTION == 0 or data[start:end].isspace():
            sections.append(Node(xxh3_128_digest(b"".join(p.digest for p in paragraphs), 2), paragraphs[0].start, end, tuple(paragraphs)))
            paragraphs = []
        start = end
    return Node(xxh3_128_digest(b"".join(s.digest for s in sections), 3), 0, len(data), tuple(sections))


def fingerprint(text: str | None) -> str:
    """root:pieces, with ``-`` between paragraphs and ``.`` between sections."""
    root = tree(text)
    return root.digest.hex() + ":" + ".".join("-".join("".join(p.digest[: DIGITS // 2].hex() for p in q.parts) for q in s.parts) for s in root.parts)


def _pieces(branch: str) -> list[str]:
    return [p[i : i + DIGITS] for p in branch.replace(".", "-").split("-") for i in range(0, len(p), DIGITS)]


def likeness(a: str, b: str) -> float:
    """Share of pieces that two fingerprints have in common, with repeats: 1 for equal roots, 0 for none. Equal sections are not
    gone into."""
    (a_root, a_rest), (b_root, b_rest) = a.split(":"), b.split(":")
    if a_root == b_root:
        return 1.0
    size = lambda s: len(s.replace(".", "").replace("-", "")) // DIGITS
    of_a, of_b = Counter(a_rest.split(".")), Counter(b_rest.split("."))
    same = of_a & of_b
    shared = sum(size(s) * k for s, k in same.items())
    left, right = (Counter(p for s, k in (x - same).items() for p in _pieces(s) * k) for x in (of_a, of_b))
    shared += sum((left & right).values())
    total = size(a_rest) + size(b_rest)
    return 2 * shared / total if total else 1.0


def changes(a: str | None, b: str | None) -> list[tuple[int, int]]:
    """Spans of ``a`` (bytes of UTF-8) whose pieces ``b`` lacks, neighbours joined: only branches whose hash ``b`` lacks are gone into."""
    left, right = tree(a), tree(b)
    found: list[list[int]] = []

    def walk(node: Node, others: list[Node]) -> None:
        had = Counter(o.digest for o in others)
        if had[node.digest]:
            return
        if not node.parts:
            if node.end > node.start:
                if found and found[-1][1] == node.start:
                    found[-1][1] = node.end
                else:
                    found.append([node.start, node.end])
            return
        below = [p for o in others for p in o.parts]
        known = {p.digest for p in below}
        for part in node.parts:
            if part.digest not in known:
                walk(part, below)

    walk(left, [right])
    return [(s, e) for s, e in found]


# ---- tables ------------------------------------------------------------------------------------


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, level (0 root, 1 section, 2 paragraph, 3 piece), nth (of its level, from 0), start, end (bytes of UTF-8), hash: the trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b._id, b._text):
                level, at = [tree(text)], 0
                while level:
                    rows += [(doc, at, i, n.start, n.end, n.digest.hex()) for i, n in enumerate(level)]
                    level, at = [p for n in level for p in n.parts], at + 1
            out = pd.DataFrame(rows, columns=["doc_id", "level", "nth", "start", "end", "hash"])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).mapInPandas(run, "doc_id long, level int, nth long, start long, end long, hash string")


def locate(pairs: DataFrame) -> DataFrame:
    """doc_id, start, end: the spans of ``text`` (bytes of UTF-8) that ``other`` lacks, for rows (doc_id, text, other)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([(doc, s, e) for doc, text, other in zip(b._id, b._text, b._other) for s, e in changes(text, other)], columns=["doc_id", "start", "end"])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    return pairs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), F.col("other").alias("_other")).mapInPandas(run, "doc_id long, start long, end long")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(doc: int | None, text: str, own: str, following: str, next_own: str) -> tuple:
    changed = edited(text, following)
    of_changed = fingerprint(changed)
    return doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, of_changed, likeness(own, of_changed), likeness(own, next_own)


_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]
_DONE, _HEAD, _TAIL = 0, 1, 2


def _ranges(docs: DataFrame) -> DataFrame:
    """The rows of ``compare_edits`` but those of the last text of each range; besides, each range's first and last text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), None
        edge = lambda kind, doc, text: (doc, len(text), None, None, None, None, None, kind, part, text)
        for b in batches:
            rows = []
            for doc, text in zip(b._id, b._text):
                doc, own = None if pd.isna(doc) else int(doc), fingerprint(text)
                rows.append((*_compared(*held, text, own), _DONE, part, None) if held else edge(_HEAD, doc, text))
                held = doc, text, own
            yield framed(rows)
        if held:
            yield framed([edge(_TAIL, held[0], held[1])])

    def framed(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*_NAMES, "_kind", "_part", "_text"])
        return out.assign(doc_id=out.doc_id.astype("Int64"))

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_nth"))
    order = [F.col("_id").asc_nulls_last(), F.col("_hash")]
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    dealt = rows.repartitionByRange(scratch.tasks(docs), *order, "_nth").sortWithinPartitions(*order)
    return dealt.select("_id", "_text").mapInPandas(run, f"{_COLUMNS}, _kind int, _part int, _text string")


def compare_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text against its edited form and
    the text of the next id (after the last: the first)."""
    spark = docs.sparkSession
    read = scratch.materialise(_ranges(docs), "merkle-ranges", compression="zstd")
    parts = sorted(r._part for r in read.where(F.col("_kind") == _HEAD).select("_part").collect())  # one a task
    onward = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "_part int, _next int")
    tails = read.where(F.col("_kind") == _TAIL).select("doc_id", F.col("_part"), "_text").join(onward, "_part")
    heads = read.where(F.col("_kind") == _HEAD).select(F.col("_part").alias("_next"), F.col("_text").alias("_following"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [_compared(None if pd.isna(doc) else int(doc), text, fingerprint(text), following, fingerprint(following)) for doc, text, following in zip(b.doc_id, b._text, b._following)]
            out = pd.DataFrame(rows, columns=_NAMES)
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    edges = tails.join(heads.hint("merge"), "_next").select("doc_id", "_text", "_following").mapInPandas(run, _COLUMNS)
    return read.where(F.col("_kind") == _DONE).select(*_NAMES).union(edges)
