"""Token ids in directly addressable codes: any token is read without decoding its neighbours.

An id is split into ``CHUNK_BITS``-bit chunks, lowest first. Level k holds the k-th chunks of the
ids that have one, and a bitmap that says which of them continue on level k + 1; the number of set
bits before a position, from a rank directory and a few words, is the position on the next level.

A file is a run of segments, then the document index, then a footer:
  segment:  for each level: u32 count, count bytes of chunks, bitmap of ceil(count / 64) u64 words,
            rank directory of one u32 per ``RANK_WORDS`` words (set bits before them)
  index:    per document i64 id, u8 id-is-null, u64 first token in the file, u64 number of tokens
  footer:   JSON (segments' offsets, first tokens and levels; index offset; counts), u32 its size, magic

Defined cases: a null or empty text holds the end id alone; null ids come first and repeated ids
stay together, in any order; other columns are ignored; an empty table writes no file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files, scratch
from .tokens import encoder

CHUNK_BITS = 8
RANK_WORDS = 8
#: Tokens in a segment; what a writer or a sequential reader holds at once follows from it.
SEGMENT_TOKENS = 1 << 20
MAGIC = b"DACTOK01"
MANIFEST = "part long, path string, docs long, tokens long"
_INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("first", "<u8"), ("n", "<u8")])


# ---- codes -------------------------------------------------------------------------------------


def encode_segment(ids: np.ndarray) -> tuple[bytes, int]:
    """Bytes of a segment and its number of levels."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        high = rest >> CHUNK_BITS
        more = high > 0
        n = len(rest)
        bits = np.zeros(-(-n // 64) * 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        words = bits.view("<u8")
        counts = np.bitwise_count(words).astype(np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts, dtype=np.uint32)])[:-1][::RANK_WORDS] if n else counts
        out += [np.uint32(n).tobytes(), (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes(), words.tobytes(), ranks.astype("<u4").tobytes()]
        if not more.any():
            return b"".join(out), len(out) // 4
        rest = high[more]


class Segment:
    """A decoded view of a segment's bytes; nothing is copied until tokens are asked for."""

    def __init__(self, data: bytes, levels: int):
        self.levels, at = [], 0
        for _ in range(levels):
            n = int(np.frombuffer(data, "<u4", 1, at)[0])
            words = -(-n // 64)
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            bits = np.frombuffer(data, "<u8", words, at + 4 + n)
            ranks = np.frombuffer(data, "<u4", -(-words // RANK_WORDS), at + 4 + n + 8 * words)
            self.levels.append((chunks, bits, ranks))
            at += 4 + n + 8 * words + 4 * len(ranks)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        """One token: a chunk, a bit and a rank per level."""
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            word, bit = divmod(i, 64)
            if not int(bits[word]) >> bit & 1:
                return value
            block = word // RANK_WORDS
            i = int(ranks[block]) + int(np.bitwise_count(bits[block * RANK_WORDS : word]).sum()) + (int(bits[word]) & ((1 << bit) - 1)).bit_count()
            shift += CHUNK_BITS
        raise ValueError("a code continues beyond the last level")

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Tokens lo to hi: one range per level, found by ranks."""
        out, at, shift = np.zeros(hi - lo, np.uint32), np.arange(hi - lo), 0
        for chunks, bits, ranks in self.levels:
            out[at] |= chunks[lo:hi].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[lo // 64 : -(-hi // 64)].view(np.uint8), bitorder="little")[lo % 64 :][: hi - lo].astype(bool)
            word, bit = divmod(lo, 64)
            if not more.any():
                return out
            block = word // RANK_WORDS
            lo = int(ranks[block]) + int(np.bitwise_count(bits[block * RANK_WORDS : word]).sum()) + (int(bits[word]) & ((1 << bit) - 1)).bit_count()
            at = at[more]
            hi = lo + len(at)
            shift += CHUNK_BITS
        raise ValueError("a code continues beyond the last level")


class TokenFile:
    """Random access to a file of the format above; ``raw`` is a seekable binary file."""

    def __init__(self, raw):
        self.raw = raw
        raw.seek(0, 2)
        end = raw.tell()
        size, magic = self._at(end - 12, 4), self._at(end - 8, 8)
        if magic != MAGIC:
            raise ValueError("not a token file, or one that was cut")
        n = int(np.frombuffer(size, "<u4")[0])
        self.footer = json.loads(self._at(end - 12 - n, n))
        self.first = np.array([s["first"] for s in self.footer["segments"]], np.int64)
        self.held: tuple[int, Segment | None] = (-1, None)

    def _at(self, offset: int, n: int) -> bytes:
        self.raw.seek(offset)
        if len(got := self.raw.read(n)) != n:
            raise ValueError("the token file was cut")
        return got

    def index(self) -> np.ndarray:
        return np.frombuffer(self._at(self.footer["index"], self.footer["docs"] * _INDEX.itemsize), _INDEX)

    def segment(self, k: int) -> Segment:
        if self.held[0] != k:
            s = self.footer["segments"][k]
            self.held = (k, Segment(self._at(s["at"], s["size"]), s["levels"]))
        return self.held[1]

    def token(self, i: int) -> int:
        k = int(np.searchsorted(self.first, i, "right")) - 1
        return self.segment(k).token(i - int(self.first[k]))

    def tokens(self, lo: int, hi: int) -> Iterator[np.ndarray]:
        """Tokens lo to hi in runs of a segment at most."""
        while lo < hi:
            k = int(np.searchsorted(self.first, lo, "right")) - 1
            seg, base = self.segment(k), int(self.first[k])
            to = min(hi, base + len(seg))
            yield seg.tokens(lo - base, to - base)
            lo = to


class _Writer:
    def __init__(self, out):
        self.out, self.at, self.held, self.n_held, self.tokens, self.segments, self.docs = out, 0, [], 0, 0, [], []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc or 0, doc is None, self.tokens, len(ids)))
        self.tokens += len(ids)
        while len(ids):
            some, ids = ids[: SEGMENT_TOKENS - self.n_held], ids[SEGMENT_TOKENS - self.n_held :]
            self.held.append(some)
            self.n_held += len(some)
            if self.n_held == SEGMENT_TOKENS:
                self._flush()

    def _flush(self) -> None:
        data, levels = encode_segment(np.concatenate(self.held))
        first = self.segments[-1]["first"] + self.segments[-1]["n"] if self.segments else 0
        self.segments.append({"at": self.at, "size": len(data), "levels": levels, "first": first, "n": self.n_held})
        self.out.write(data)
        self.at += len(data)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._flush()
        self.out.write(np.array(self.docs, _INDEX).tobytes())
        foot = json.dumps({"segments": self.segments, "index": self.at, "docs": len(self.docs), "tokens": self.tokens}).encode()
        self.out.write(foot + np.uint32(len(foot)).tobytes() + MAGIC)


# ---- tables ------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, text_col: str = "text") -> DataFrame:
    """Write the ids of all texts, in ascending id order over files and in each file.

    Returns the manifest (part, path, docs, tokens): files in order of ``part``, of committed tasks. All rows
    of one id are in one file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.repartitionByRange(scratch.tasks(docs), "_id").sortWithinPartitions("_id")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, enc, end, made = TaskContext.get().partitionId(), encoder(tokenizer_path), np.array([end_id], "<u4"), None
        todo = ((None if pd.isna(i) else int(i), ids) for b in batches for i, ids in zip(b._id, enc.encode_many(b._text)))
        if (row := next(todo, None)) is not None:
            with files.new_file(folder, f"part-{part:05d}", ".dac") as (path, out):
                w = _Writer(out)
                while row is not None:
                    w.add(row[0], np.concatenate([row[1], end]))
                    row = next(todo, None)
                w.close()
                made = (part, path, len(w.docs), w.tokens)
        yield pd.DataFrame([made] if made else [], columns=["part", "path", "docs", "tokens"])

    return scratch.materialise(rows.mapInPandas(write, MANIFEST), "token-manifest")


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start over all files, n_tokens and crc32 of its ids."""
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    todo = manifest.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count())  # a row per file

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, before in zip(b.path, b.before):
                with files.open_file(path) as raw:
                    f = TokenFile(raw)
                    index = f.index()
                    for lo in range(0, len(index), 20_000):
                        some = index[lo : lo + 20_000]
                        crc = []
                        for first, n in zip(some["first"].tolist(), some["n"].tolist()):
                            c = 0
                            for run in f.tokens(first, first + n):
                                c = zlib.crc32(run.astype("<u4").tobytes(), c)
                            crc.append(c)
                        ids = pd.Series(some["id"].astype(np.int64)).astype("Int64").mask(some["null"].astype(bool))
                        yield pd.DataFrame({"doc_id": ids, "start": some["first"].astype(np.int64) + before, "n_tokens": some["n"].astype(np.int64), "ids_crc32": np.array(crc, np.int64)})

    return todo.repartition(tasks, "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read every document back."""
    manifest = write_tokens(docs, scratch.new_path(spark, "tokens"), tokenizer_path, end_id)
    return read_documents(spark, manifest)
