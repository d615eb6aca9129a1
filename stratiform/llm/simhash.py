"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

A fingerprint bit is set where more than half of the shingle hashes have it. Equal fingerprints are
merged first, so a group of copies counts once. Fingerprints that may link meet in a bucket; a
bucket is sorted by population count and cut into tiles, and numpy exclusive-or and bit counts
compare tile pairs, except those whose population counts differ beyond the radius. A bucket passes
on a spanning forest of its links, never all pairs. A bucket of over ``BUCKET`` fingerprints is cut
into parts that meet two by two in as many tasks.

Buckets. For a small radius they are exact (pigeonhole): of ``radius + 4`` blocks of bits at least
four agree, so each choice of four blocks is a key; two linked fingerprints always meet. At radius 2
the 64 bits make six blocks and a key holds at least 42 bits, so a bucket has 2**22 fingerprints at
most, whatever the input. For the wide radius that a similarity of 0.8 needs, no split of the bits
is selective and all pairs would be quadratic; there a text's keys are ``KEYS`` independent minima
over its shingles, which two texts of similarity s share with probability 1 - (1 - s) ** KEYS
(1 - 3e-6 at 0.8). Fingerprints within the wide radius are candidates only: a link is confirmed by the
exact Jaccard similarity of the two texts' shingle sets, before any forest thins the links, so that a
rejected candidate hides no link. A pair of fingerprints is taken up in the bucket of its first shared
minimum, and only the texts of such pairs are read again and meet there.

Components are smallest labels over links, by rounds of neighbour minima and label halving, each
round written to the shared folder.

Defined cases: null or empty text has fingerprint zero and links like any other; null ids are kept
as rows but label no component (a component of null ids only has a null label); repeated rows and
ids are fine; other columns are ignored by ``components``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import scratch
from .shingles import shingle_hashes

#: Fingerprints of a tile: a tile pair takes 8 bytes * TILE ** 2 at once.
TILE = 1024
#: Fingerprints of a bucket beyond which it is cut into parts that meet two by two.
BUCKET = 1 << 14
#: Minima per text when the radius is wide.
KEYS = 8
_AGREE = 4
#: Rows with which a bucket of several tiles is compared first.
PIVOTS = 32


@dataclass(frozen=True)
class Scheme:
    """What makes two texts near-duplicates: shingle width, fingerprint bits, radius in bits; for a
    wide radius, the similarity of shingle sets that confirms a candidate."""

    width: int
    bits: int = 64
    radius: int = 2
    wide: bool = False
    similarity: float = 0.0


#: Contract of the query: three words, 64 bits, two bits apart.
NARROW = Scheme(3, 64, 2)
#: Similarity of 0.8 on shingles of five words: a Jaccard similarity J is a cosine of 2 J / (1 + J),
#: so J = 0.8 differs in 256 * acos(8 / 9) / pi = 38.8 bits, 5.7 standard deviation; the radius lets
#: all but 1 of 10000 such pairs through to be confirmed.
SIMILAR = Scheme(5, 256, 60, wide=True, similarity=0.8)

# Odd multipliers that derive further hashes from one.
_MIX = tuple((0x9E3779B97F4A7C15 * (2 * i + 1) + 0x632BE59BD9B4E019 * i) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(1, 33))


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    x = h * np.uint64(_MIX[i])
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of ``h`` have each of the 64 bits, lowest first; sums stay in bytes as long as they can."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 255 * 64):
        bits = np.unpackbits(h[lo : lo + 255 * 64].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        for k in range(0, len(bits), 255):
            counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return counts


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    runs = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)


def sketch(text: str | None, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint as little-endian words of 64 bits, and the minima that serve as wide keys.

    A wide scheme compares sets of shingles, so there each shingle counts once.
    """
    return _sketched([shingle_set(text, scheme.width)] if scheme.wide else shingle_hashes(text, scheme.width), scheme)


def _sketched(runs, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    words = scheme.bits // 64
    counts, n = np.zeros((words, 64), np.int64), 0
    low = np.full(KEYS, np.iinfo(np.uint64).max, np.uint64)
    for h in runs:
        if not len(h):
            continue
        n += len(h)
        for w in range(words):
            counts[w] += _bit_counts(h if w == 0 else _mixed(h, w))
        if scheme.wide:
            low = np.minimum(low, [_mixed(h, 16 + k).min() for k in range(KEYS)])
    bits = (2 * counts > n).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel(), low


def block_keys(fp: np.ndarray, radius: int) -> np.ndarray:
    """(len(fp), choices) keys of 64-bit fingerprints such that any two within ``radius`` share one."""
    blocks = radius + _AGREE
    edge = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), _AGREE)):
        mask = sum(((1 << edge[b + 1]) - (1 << edge[b])) for b in chosen)
        keys.append(_mixed((fp & np.uint64(mask)) ^ np.uint64(0xA0761D6478BD642F * (i + 1) & 0xFFFFFFFFFFFFFFFF), 0))
    return np.stack(keys, axis=1)


# ---- tiles -------------------------------------------------------------------------------------


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of all rows of ``x`` and all rows of ``y``."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, None, w] ^ y[None, :, w])
    return out


def tile_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among the rows of ``fps`` (n, words) at ``radius`` bits or fewer.

    Rows of one component need no comparison, so a large bucket is first compared with a few of its
    rows; then tiles, cut in the order of population counts, are compared with each other.
    """
    label, out = np.arange(len(fps)), []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        """Links between rows a[i] and b[i]."""
        pairs, at = np.unique(np.sort(np.stack([label[a], label[b]]), axis=0), axis=1, return_index=True)
        for k, i in enumerate(at.tolist()):
            x, y = int(label[a[i]]), int(label[b[i]])
            if x != y:
                out.append((int(a[i]), int(b[i])))
                label[label == max(x, y)] = min(x, y)

    if len(fps) > TILE:
        tried = 0
        for _ in range(PIVOTS):
            alone = tried + np.flatnonzero(label[tried:] == np.arange(tried, len(fps)))
            if not len(alone):
                break
            p, tried = int(alone[0]), int(alone[0]) + 1
            near = np.flatnonzero(_apart(fps[p : p + 1], fps)[0] <= radius)
            labels, at = np.unique(label[near], return_index=True)
            out += [(p, int(near[i])) for k, i in zip(labels, at) if k != label[p]]
            label[np.isin(label, labels)] = min(label[p], labels.min())
    pop = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(pop, kind="stable")
    tiles = [order[i : i + TILE] for i in range(0, len(order), TILE)]
    for i, x in enumerate(tiles):
        for y in tiles[i:]:
            if pop[y[0]] - pop[x[-1]] > radius:
                break  # so do all tiles after it
            if (label[x] == label[x[0]]).all() and (label[y] == label[x[0]]).all():
                continue
            p, q = np.nonzero((_apart(fps[x], fps[y]) <= radius) & (label[x][:, None] != label[y][None, :]))
            join(x[p], y[q])
    return out


def _bucket_links(radius: int, words: int):
    """Task: rows (key, fp) sorted by key -> links between fingerprints of a bucket."""

    def close(held: bytearray) -> pd.DataFrame:
        raw = sorted({bytes(held[i : i + 8 * words]) for i in range(0, len(held), 8 * words)})
        found = tile_links(np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(-1, words), radius)
        return pd.DataFrame({"a": [raw[i] for i, _ in found], "b": [raw[j] for _, j in found]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held = None, bytearray()
        for batch in batches:
            keys, fps = batch.key.to_numpy(), batch.fp.to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if keys[lo] != held_key:
                    if len(held) > 8 * words:
                        yield close(held)
                    held_key, held = keys[lo], bytearray()
                held += b"".join(fps[lo:hi])
        if len(held) > 8 * words:
            yield close(held)

    return run


# ---- candidates and their confirmation ----------------------------------------------------------


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return float(not len(y))
    at = np.searchsorted(y, x)
    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return shared / (len(x) + len(y) - shared)


def _near(fps: np.ndarray, x: np.ndarray, y: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Which of the rows ``x`` and ``y`` of ``fps`` (fingerprint, set size) may be similar enough."""
    words = scheme.bits // 64
    a, b = fps[x, words][:, None], fps[y, words][None, :]
    return (_apart(fps[x, :words], fps[y, :words]) <= scheme.radius) & (np.minimum(a, b) >= scheme.similarity * np.maximum(a, b))


def _tile_pairs(fps: np.ndarray, scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of tiles of a quarter of ``TILE`` rows, in the order of set sizes; none of which sizes differ too much."""
    sizes = fps[:, scheme.bits // 64]
    order = np.argsort(sizes, kind="stable")
    tiles = np.array_split(order, -(-4 * len(fps) // TILE))
    for i, x in enumerate(tiles):
        for y in tiles[i:]:
            if sizes[x[-1]] < scheme.similarity * sizes[y[0]]:
                break
            yield x, y


def owned(fps: np.ndarray, keys: np.ndarray, key: int, scheme: Scheme) -> np.ndarray:
    """Rows with a candidate of which ``key`` is the first minimum that both have."""
    out = np.zeros(len(fps), bool)
    for x, y in _tile_pairs(fps, scheme):
        if out[x].all() and out[y].all():
            continue
        p, q = np.nonzero(_near(fps, x, y, scheme))
        p, q = x[p], y[q]
        p, q = (z[p != q] for z in (p, q))
        same = keys[p] == keys[q]
        first = same.argmax(axis=1)
        here = (keys[p, first] == key) | ~same.any(axis=1)
        out[p[here]] = out[q[here]] = True
    return out


def confirmed_links(fps: np.ndarray, sets: list[np.ndarray], scheme: Scheme) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of rows that are candidates and of which the sets are similar enough."""
    label, out = np.arange(len(fps)), []
    for x, y in _tile_pairs(fps, scheme):
        if (label[x] == label[y[0]]).all() and (label[y] == label[y[0]]).all():
            continue
        p, q = np.nonzero(_near(fps, x, y, scheme) & (label[x][:, None] != label[y][None, :]))
        for a, b in zip(x[p].tolist(), y[q].tolist()):
            if label[a] != label[b] and similarity(sets[a], sets[b]) >= scheme.similarity:
                out.append((a, b))
                label[label == max(label[a], label[b])] = min(label[a], label[b])
    return out


def _bucket_owned(scheme: Scheme):
    """Task: rows (key, fp, keys, own) sorted by key -> (key, fp) of those with a candidate in the bucket."""

    def close(key: int, own: int, held: dict[bytes, np.ndarray]) -> pd.DataFrame:
        raw = sorted(held)
        flags = owned(_nodes(raw), np.stack([held[r] for r in raw]), own, scheme)
        return pd.DataFrame({"key": np.full(int(flags.sum()), key, np.int64), "fp": [r for r, f in zip(raw, flags) if f]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for b in batches:
            for key, fp, keys, own in zip(b.key.tolist(), b.fp, b["keys"], b.own.tolist()):
                if at != (key, own):
                    if len(held) > 1:
                        yield close(*at, held)
                    at, held = (key, own), {}
                held[bytes(fp)] = np.asarray(keys, np.int64)
        if len(held) > 1:
            yield close(*at, held)

    return run


def _bucket_confirmed(scheme: Scheme):
    """Task: rows (key, fp, text) sorted by key -> confirmed links (a, b)."""

    def close(held: dict[bytes, np.ndarray]) -> pd.DataFrame:
        raw = sorted(held)
        found = confirmed_links(_nodes(raw), [held[r] for r in raw], scheme)
        return pd.DataFrame({"a": [raw[i] for i, _ in found], "b": [raw[j] for _, j in found]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for b in batches:
            for key, fp, text in zip(b.key.tolist(), b.fp, b.text):
                if at != key:
                    if len(held) > 1:
                        yield close(held)
                    at, held = key, {}
                if (fp := bytes(fp)) not in held:
                    held[fp] = shingle_set(text, scheme.width)
        if len(held) > 1:
            yield close(held)

    return run


def _nodes(raw: list[bytes]) -> np.ndarray:
    """Rows of 64-bit words."""
    return np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(len(raw), -1)


# ---- plans -------------------------------------------------------------------------------------


def _row_key(id_col: str, text_col: str) -> list:
    """Columns that tell rows apart: id missing, id, hash of the text."""
    i = F.col(id_col).cast("long")
    return [i.isNull().alias("_none"), F.coalesce(i, F.lit(0).cast("long")).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash")]


def fingerprints(docs: DataFrame, scheme: Scheme, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_none, _id, _hash (the row), fp (words in big-endian bytes) and the wide keys of fp.

    In a wide scheme size and 128-bit hash of the shingle set follow the fingerprint in fp, so only
    texts of equal sets share it.
    """

    def wide(b: pd.DataFrame) -> pd.DataFrame:
        fps, keys = [], []
        for t in b._text:
            some = shingle_set(t, scheme.width)
            f, low = _sketched([some], scheme)
            fps.append(f.astype(">u8").tobytes() + len(some).to_bytes(8, "big") + xxh3_128_digest(some.tobytes()))
            keys.append(low.view(np.int64))
        return b.drop(columns="_text").assign(fp=fps, keys=keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if scheme.wide:
                yield wide(b)
                continue
            done = [sketch(t, scheme) for t in b._text]
            yield b.drop(columns="_text").assign(fp=[f.astype(">u8").tobytes() for f, _ in done], keys=[[] for _ in done])

    rows = docs.select(*_row_key(id_col, text_col), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, "_none boolean, _id long, _hash long, fp binary, keys array<long>")


def _meetings(prints: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, fp): the buckets."""
    if scheme.wide:
        return prints.select("fp", "keys").distinct().select(F.explode(F.array_distinct("keys")).alias("key"), "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = block_keys(np.frombuffer(b"".join(b.fp), ">u8").astype(np.uint64), scheme.radius)
            yield pd.DataFrame({"key": keys.view(np.int64).ravel(), "fp": np.repeat(b.fp.to_numpy(), keys.shape[1])})

    return prints.select("fp").distinct().mapInPandas(run, "key long, fp binary")


def _split(met: DataFrame, most: int) -> DataFrame:
    """``met`` with buckets of over ``most`` fingerprints cut into parts by a hash, and every two parts
    of one made a bucket of their own: no pair is lost, and no task holds more than two parts at once.
    Rows are dealt out by bucket and sorted by it."""
    met = scratch.materialise(met, "meetings")
    heavy = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    heavy = scratch.materialise(heavy.select("key", F.ceil(F.col("n") / most).cast("int").alias("parts")), "heavy")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: t != own)
    keys = F.when(F.col("parts").isNull(), F.array("key")).otherwise(F.transform(others, lambda t: F.xxhash64("key", F.least(own, t), F.greatest(own, t))))
    cut = met.join(heavy, "key", "left").select(F.explode(keys).alias("key"), *(c for c in met.columns if c != "key"))
    return cut.repartition(scratch.tasks(met), "key").sortWithinPartitions("key")


def links(prints: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (a, b) between distinct fingerprints; their components are those of all links."""
    run = _bucket_links(scheme.radius, scheme.bits // 64)
    return _split(_meetings(prints, scheme), BUCKET).mapInPandas(run, "a binary, b binary")


def similar_links(docs: DataFrame, prints: DataFrame, scheme: Scheme, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links (a, b) of a wide scheme; their components are those of all links."""
    met = prints.select("fp", "keys").distinct().select(F.explode(F.array_distinct("keys")).alias("key"), "fp", "keys").withColumn("own", F.col("key"))
    taken = scratch.materialise(_split(met, BUCKET // 4).mapInPandas(_bucket_owned(scheme), "key long, fp binary"), "candidates")
    first = prints.groupBy("fp").agg(F.min(F.struct("_none", "_id", "_hash")).alias("first"))
    rows = taken.join(first.hint("merge"), "fp").select("key", "fp", "first.*")
    texts = docs.select(*_row_key(id_col, text_col), F.col(text_col).alias("text"))
    met = texts.join(rows.hint("merge"), ["_none", "_id", "_hash"]).select("key", "fp", "text")
    tasks = scratch.tasks(docs, 2.0)  # a text comes once for each bucket that has a candidate of it
    return met.repartition(tasks, "key").sortWithinPartitions("key").mapInPandas(_bucket_confirmed(scheme), "a binary, b binary")


def smallest_labels(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): for every node of ``edges`` (a, b) the smallest node of its component.

    A round takes the smallest label of a node and its neighbours, then that label's own label;
    both are joins with partial minima before the shuffle. Rounds end when no label changes; labels that
    still change after ``most_rounds`` fail, as they would be wrong.
    """
    both = scratch.materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = scratch.materialise(labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("was")), "lower")
        halved = lower.join(lower.select(F.col("node").alias("next"), F.col("next").alias("further")), "next", "left")
        new = scratch.materialise(halved.select("node", F.least("next", F.coalesce("further", "next")).alias("label"), "was"), "labels")
        changed = bool(new.where("label <> was").take(1))
        scratch.forget(labels, lower)
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {most_rounds} rounds")
    scratch.forget(both)
    return labels


def components(docs: DataFrame, scheme: Scheme = NARROW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its row key, doc_id, fp, and of its component the first row (``first``) and
    its id ``component_id``, the smallest that links reach, itself included."""
    prints = scratch.materialise(fingerprints(docs, scheme, id_col, text_col), "fingerprints")
    found = similar_links(docs, prints, scheme, id_col, text_col) if scheme.wide else links(prints, scheme)
    edges = scratch.materialise(found, "links")
    labels = smallest_labels(edges)
    first = prints.groupBy("fp").agg(F.min(F.struct("_none", "_id", "_hash")).alias("first"))
    by_fp = scratch.materialise(first.join(labels, first.fp == labels.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "labelled")
    least = scratch.materialise(by_fp.groupBy("label").agg(F.min("first").alias("first")), "least")  # apart: a join of two shuffles can be split at a hot label
    named = scratch.materialise(by_fp.select("fp", "label").join(least, "label").select("fp", "first"), "named")
    scratch.forget(edges, labels, by_fp)
    real = lambda none, i: F.when(~none, i)
    return prints.select("_none", "_id", "_hash", "fp").join(named, "fp").withColumns({"doc_id": real(F.col("_none"), F.col("_id")), "component_id": real(F.col("first._none"), F.col("first._id"))})


def digest(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal digits, highest bit first), component_id."""
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, scheme: Scheme = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id.

    Rows without an id stand for a group only if none of it has one; of rows that repeat id and
    text, one stays.
    """
    names = docs.columns
    found = components(docs, scheme, id_col, text_col)
    kept = found.where(F.struct("_none", "_id", "_hash") == F.col("first")).select("_none", "_id", "_hash").distinct()
    key = dict(zip(("_none", "_id", "_hash"), _row_key(id_col, text_col)))
    tagged = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), *key.values())
    one = Window.partitionBy("_none", "_id", "_hash").orderBy("_id")
    return tagged.join(kept, ["_none", "_id", "_hash"]).withColumn("_n", F.row_number().over(one)).where("_n = 1").select("_row.*")
