"""Language-model scores by deleted interpolation, learned and applied in blocks of texts.

The model mixes three estimates of a token w after v: count(v w) / count(v), count(w) / N, and
1 / (V + 1). The mixture weights depend on the bucket of count(v), by powers of four, and are
learned by expectation-maximisation on counts that were held out: texts of one of the training folds
are predicted from the counts of the others. Scores then use the counts of all training folds.

How counts meet texts. Each task turns its texts into blocks (one row: token numbers, the block's
own vocabulary as 64-bit hashes). A block sends its distinct keys with their counts, sorted and
cut by hash range, to the range's task; that adds up all blocks and answers each with the totals
in the order it sent. So what is shuffled is a block's distinct keys, once there, and totals, once
back; no table of counts is broadcast, collected, or in one task. The driver gets V, N and the
histogram from which the weights are learned: at most ``BUCKETS`` times ``BINS`` squared rows.

Keys are 64-bit hashes: two of n distinct keys collide with probability n * n / 2**65.

Defined cases: a null or empty text is its end token alone; a null id counts as the text '';
repeated rows count and are scored each; other columns are ignored; with no training texts every
token is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import scratch
from .shingles import word_runs

FOLDS, HELD_OUT, TUNING = 10, 0, 1
#: Tokens after which a block is closed.
BLOCK_TOKENS = 1 << 20
#: Tokens of a block of which estimates are held at once.
PART_TOKENS = 1 << 17
#: Keys that a task of a hash range gets on average.
RANGE_KEYS = 1 << 20
BUCKETS = 12
#: Steps of a tenth of a decade from 1 to 1e-12, in which tuning estimates are counted.
BINS = 121
END, START = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
ALPHA = 0.1
BLOCK = "block long, texts binary, tokens binary, vocab binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _pack(a: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


# ---- blocks ------------------------------------------------------------------------------------


def blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts as token numbers: texts (id, id missing, length), tokens, vocab (hashes, sorted)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, nth = TaskContext.get().partitionId(), 0
        number: dict[bytes | None, int] = {None: 0}
        texts, runs, held = [], [], 0

        def close() -> pd.DataFrame:
            nonlocal nth, texts, runs, held
            hashes = np.fromiter((END if w is None else xxh64_intdigest(w) for w in number), np.uint64, len(number))
            vocab, place = np.unique(hashes, return_inverse=True)
            row = {"block": part << 33 | nth, "texts": _pack(np.array(texts, np.int64).ravel()), "tokens": _pack(place.astype(np.int32)[np.concatenate(runs)]), "vocab": _pack(vocab)}
            nth, texts, runs, held = nth + 1, [], [], 0
            number.clear()
            number[None] = 0
            return pd.DataFrame([row])

        for b in batches:
            for doc, text in zip(b._id, b._text):
                n = 1
                for words in word_runs((text or "").encode("utf-8", "surrogatepass").lower()):
                    new = [w for w in set(words) if w not in number]
                    number.update(zip(new, range(len(number), len(number) + len(new))))
                    runs.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                    n += len(words)
                runs.append(np.zeros(1, np.int32))
                none = pd.isna(doc)
                texts.append((0 if none else int(doc), int(none), n))
                held += n
                if held >= BLOCK_TOKENS:
                    yield close()
        if texts:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, BLOCK)


class _Block:
    """A block's texts, tokens and keys; everything is in the order of its sorted keys."""

    def __init__(self, texts: bytes, tokens: bytes, vocab: bytes):
        t = _unpack(texts, np.int64).reshape(-1, 3)
        self.ids, self.none, self.n = t[:, 0], t[:, 1].astype(bool), t[:, 2]
        self.folds = np.array([fold(None if m else int(i)) for i, m in zip(self.ids, self.none)], np.int8)
        self.tokens, self.vocab = _unpack(tokens, np.int32), _unpack(vocab, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        self.of_token = np.repeat(self.folds, self.n)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of (previous, token) per token; distinct hashes; where each token's is among them."""
        before = np.empty(len(self.tokens), np.uint64)
        own = self.vocab[self.tokens]
        before[1:] = own[:-1]
        before[self.first] = START
        h = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (own + np.uint64(0x9FB21C651E98DF25))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h, *np.unique(h, return_inverse=True)

    def counts(self, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per key: occurrences in training folds without the tuning fold, and in the tuning fold."""
        train = (self.of_token != HELD_OUT) & (self.of_token != TUNING)
        return np.bincount(place[train], minlength=n).astype(np.uint32), np.bincount(place[self.of_token == TUNING], minlength=n).astype(np.uint32)


def _sent(kind: int, keys: np.ndarray, main: np.ndarray, tune: np.ndarray, ranges: int) -> list[tuple]:
    edges = np.searchsorted(keys, [(i << 64) // ranges for i in range(1, ranges)]) if ranges > 1 else np.array([], np.int64)
    out = []
    for r, (a, b) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(keys)])):
        if a < b:
            gaps = np.diff(keys[a:b], prepend=np.uint64(0))
            out.append((kind, r, _pack(gaps), _pack(main[a:b]), _pack(tune[a:b])))
    return out


def _ask(table: DataFrame, ranges: dict[int, int]) -> DataFrame:
    """What blocks send: kind (1 token, 2 pair), range, block, keys, main, tune."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                x = _Block(row.texts, row.tokens, row.vocab)
                out = _sent(1, x.vocab, *x.counts(x.tokens, len(x.vocab)), ranges[1])
                _, keys, place = x.pairs()
                out += _sent(2, keys, *x.counts(place, len(keys)), ranges[2])
                del x, keys, place  # before the next block's are made
                yield pd.DataFrame(out, columns=["kind", "range", "keys", "main", "tune"]).assign(block=row.block)

    return table.mapInPandas(run, "kind int, range int, keys binary, main binary, tune binary, block long")


ANSWER = "block long, kind int, range int, main binary, tune binary, n_keys long, n_main long, n_tune long"


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Totals of a range, in each block's own order; the first row also carries the range's sums."""
    keys = [np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for k in group["keys"]]
    union, place = np.unique(np.concatenate(keys), return_inverse=True)
    main, tune = (np.bincount(place, np.concatenate([_unpack(x, np.uint32) for x in group[c]]), len(union)).astype(np.uint64) for c in ("main", "tune"))
    at, out = 0, []
    for i, (block, k) in enumerate(zip(group.block, keys)):
        p = place[at : at + len(k)]
        at += len(k)
        sums = (int((main + tune > 0).sum()), int(main.sum()), int(tune.sum())) if i == 0 else (0, 0, 0)
        out.append((block, group.kind.iloc[0], group.range.iloc[0], _pack(main[p]), _pack(tune[p]), *sums))
    return pd.DataFrame(out, columns=[x.split()[0] for x in ANSWER.split(", ")])


class _Totals:
    """A block with the totals of its keys."""

    def __init__(self, row, answers: list):
        x = self.block = _Block(row.texts, row.tokens, row.vocab)
        by = {1: [], 2: []}
        for a in sorted(answers, key=lambda a: a["range"]):
            by[a["kind"]].append(a)
        join = lambda k, c: np.concatenate([_unpack(a[c], np.uint64) for a in by[k]]).astype(np.float64)
        self.word = (join(1, "main"), join(1, "tune"))
        self.pair = (join(2, "main"), join(2, "tune"))
        self.place = x.pairs()[2].astype(np.int32)

    def parts(self) -> Iterator[slice]:
        """The block's tokens, some at a time."""
        n = len(self.block.tokens)
        return (slice(lo, min(n, lo + PART_TOKENS)) for lo in range(0, n, PART_TOKENS))

    def estimates(self, part: slice, n: float, texts: float, v: float, main_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per token: bucket of the previous token, the pair's and the token's own estimate, and the token's count."""
        of = lambda counts: counts[0] if main_only else counts[0] + counts[1]
        x, words = self.block, of(self.word)
        word, pair = words[x.tokens[part]], of(self.pair)[self.place[part]]
        before = np.empty(len(word))
        before[1:] = word[:-1]
        if part.start:
            before[0] = words[x.tokens[part.start - 1]]
        begun = np.searchsorted(x.first, [part.start, part.stop])
        before[x.first[begun[0] : begun[1]] - part.start] = texts
        p2 = np.divide(pair, before, out=np.zeros(len(pair)), where=before > 0)
        bucket = np.where(before > 0, 1 + np.minimum(BUCKETS - 2, np.log2(np.maximum(before, 1)) // 2), 0).astype(np.int64)
        return bucket, p2, word / n if n else np.zeros(len(word)), word


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for an estimate of zero, else 1 and up by tenths of a decade below 1."""
    return np.where(p > 0, 1 + np.minimum(BINS - 2, np.round(-10 * np.log10(np.maximum(p, 1e-300)))), 0).astype(np.int64)


def learn_weights(histogram: np.ndarray, v: float, rounds: int = 200) -> np.ndarray:
    """Weights (bucket, [pair, token, uniform]) by EM over rows (bucket, pair bin, token bin, count)."""
    value = np.concatenate([[0.0], 10 ** (-np.arange(BINS - 1) / 10)])
    out = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    for b in range(BUCKETS):
        rows = histogram[histogram[:, 0] == b]
        if b == 0:
            out[b] = [0.0, 0.9, 0.1]
        if not len(rows):
            continue
        p = np.stack([value[rows[:, 1]], value[rows[:, 2]], np.full(len(rows), 1 / (v + 1))], axis=1)
        for _ in range(rounds):
            part = p * out[b]
            part *= (rows[:, 3] / part.sum(axis=1))[:, None]
            new = np.maximum(part.sum(axis=0) / rows[:, 3].sum(), [0.0, 1e-9, 1e-9])
            done, out[b] = np.abs(new / new.sum() - out[b]).max() < 1e-9, new / new.sum()
            if done:
                break
    return out


def _answered(table: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with their answers, one row each."""
    grouped = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "range", "main", "tune")).alias("answers"))
    return table.join(grouped, "block")


def score(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Score every text: columns of ``SCORED``; scores are log10 probabilities of the whole text."""
    spark = docs.sparkSession
    table = scratch.materialise(blocks(docs, text_col), "lm-blocks")
    sizes = table.agg(F.count("*").alias("n")).first().n
    ranges = {1: max(1, sizes // 4), 2: max(1, sizes)}  # a block has about RANGE_KEYS distinct pairs, fewer tokens
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = _ask(table, ranges).repartition(max(tasks, min(ranges[2], 4 * tasks)), "kind", "range")
    answers = scratch.materialise(asked.groupBy("kind", "range").applyInPandas(_answer, ANSWER), "lm-answers")
    sums = {r.kind: r for r in answers.groupBy("kind").agg(F.sum("n_keys").alias("keys"), F.sum("n_main").alias("main"), F.sum("n_tune").alias("tune")).collect()}
    one = sums.get(1)
    v, n_main, n_all = (one.keys, one.main, one.main + one.tune) if one else (0, 0, 0)

    def text_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            folds = np.concatenate([_Block(r.texts, r.tokens, r.vocab).folds for r in b.itertuples()] or [np.zeros(0, np.int8)])
            yield pd.DataFrame({"main": [int(((folds != HELD_OUT) & (folds != TUNING)).sum())], "tune": [int((folds == TUNING).sum())]})

    begun = table.mapInPandas(text_counts, "main long, tune long").agg(F.sum("main").alias("main"), F.sum("tune").alias("tune")).first()
    begun_main, begun_all = begun.main or 0, (begun.main or 0) + (begun.tune or 0)
    known = scratch.materialise(_answered(table, answers), "lm-answered")

    def tuning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                t, found = _Totals(row, row.answers), []
                for part in t.parts():
                    bucket, p2, p1, _ = t.estimates(part, n_main, begun_main, v, True)
                    at = t.block.of_token[part] == TUNING
                    found.append((bucket[at] * BINS + _bin(p2[at])) * BINS + _bin(p1[at]))
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                del t, found  # before the next block's are made
                yield pd.DataFrame({"bucket": keys // BINS**2, "pair": keys // BINS % BINS, "token": keys % BINS, "n": n})

    counted = known.mapInPandas(tuning, "bucket long, pair long, token long, n long").groupBy("bucket", "pair", "token").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(np.array([tuple(r) for r in counted], np.int64).reshape(-1, 4), v)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                t = _Totals(row, row.answers)
                x = t.block
                base, model, seen = (np.empty(len(x.tokens), kind) for kind in (np.float64, np.float64, np.int64))
                for part in t.parts():
                    bucket, p2, p1, count = t.estimates(part, n_all, begun_all, v, False)
                    base[part] = np.log10((count + ALPHA) / (n_all + ALPHA * (v + 1)))
                    w = weights[bucket]
                    model[part] = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1))
                    seen[part] = count > 0
                del t
                add = lambda a: np.add.reduceat(a, x.first)
                ids = pd.Series(x.ids).astype("Int64").mask(x.none)
                yield pd.DataFrame({"doc_id": ids, "held_out": x.folds == HELD_OUT, "n_tokens": x.n, "n_known": add(seen), "train_tokens": n_all, "base_score": add(base), "score": add(model)})
                del x, base, model, seen  # before the next block's are made

    scratch.forget(table, answers)
    return known.mapInPandas(apply, SCORED)
