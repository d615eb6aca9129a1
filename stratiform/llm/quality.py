"""Quality by compression bands: zstandard ratios of whole texts and of fixed chunks.

A ratio is compressed bytes over bytes. A text is rejected if its ratio leaves the band of its
length, or if chunks that leave the chunk band hold more than ``CHUNK_SHARE`` of its bytes:
repetition lies below, noise and encoded data above. Chunks have 4 KB, or 1 KB and a band of their own
in texts of under 8 KB; a text of under 2 KB is one chunk, judged by the band of its length. Short texts compress badly whatever they say,
so bands widen as texts shorten. Besides, a base rule rejects texts of fewer than 20 words and
texts of which over 30 in 100 words lie in repeated windows of eight words.

Defined cases: null is an empty text, which has no words and is rejected; repeated rows are judged
alike; any other columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 3
CHUNK_BYTES = 4096
CHUNK_BAND = (0.18, 0.70)
CHUNK_SHARE = 0.25
#: Chunks of texts that hold fewer than two of ``CHUNK_BYTES``: on good texts of sf0.1 of 2 to 8 KB their
#: ratios lie between 0.41 and 0.60; base64 has 0.79.
SMALL_BYTES = 1024
SMALL_BAND = (0.25, 0.70)
#: (bytes below which a band holds, least ratio, most ratio)
BANDS = ((256, 0.40, 1.20), (512, 0.35, 0.95), (1024, 0.32, 0.88), (4096, 0.27, 0.80), (16384, 0.20, 0.74), (float("inf"), 0.15, 0.72))
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_SPACE = " \t\n\v\f\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, odd_chunk_share double, kept boolean"

# Odd multipliers for hashing windows of word numbers, from a fixed seed.
_FACTORS = np.random.default_rng(20240607).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight that occur twice or more, the first occurrence included."""
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words)) + np.uint64(1)
    ids = ids * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    n = len(words) - WINDOW + 1
    h = np.zeros(n, np.uint64)
    for i, f in enumerate(_FACTORS):
        h += ids[i : i + n] * f
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[inverse] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_measures(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and whether the base rule fails."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    n_repeat = repeated_words(words)
    failed = len(words) < 20 or 100 * n_repeat > 30 * len(words)
    return len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeat, failed


class Bands:
    """Ratios of a text against the bands."""

    def __init__(self):
        self.z = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def ratio(self, data: bytes) -> float:
        return len(self.z.compress(data)) / max(1, len(data))

    def odd_chunk_share(self, data: bytes) -> float:
        """Share of bytes in chunks outside the chunk band; the last chunk takes a short rest along."""
        size, band = (CHUNK_BYTES, CHUNK_BAND) if len(data) >= 2 * CHUNK_BYTES else (SMALL_BYTES, SMALL_BAND)
        full = len(data) // size
        if full < 2:
            return 0.0
        edges = [i * size for i in range(full)] + [len(data)]
        odd = sum(b - a for a, b in zip(edges, edges[1:]) if not band[0] <= self.ratio(data[a:b]) <= band[1])
        return odd / len(data)

    def verdict(self, data: bytes) -> tuple[float, float, bool]:
        whole, share = self.ratio(data), self.odd_chunk_share(data)
        _, least, most = next(b for b in BANDS if len(data) < b[0])
        return whole, share, least <= whole <= most and share <= CHUNK_SHARE


def measure(docs: DataFrame, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """``docs`` with a struct of all measures and the verdict ``kept`` in ``out_col``; a column of that name gives way."""

    @F.pandas_udf(MEASURES)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bands = Bands()
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for some in texts:
            rows = []
            for t in some:
                t = t or ""
                base = base_measures(t)
                whole, share, fine = bands.verdict(t.encode("utf-8", "surrogatepass"))
                rows.append((*base, whole, share, fine and not base[-1]))
            yield pd.DataFrame(rows, columns=names)

    return docs.withColumn(out_col, judge(F.col(text_col)))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected texts."""
    names = docs.columns
    judged = measure(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(text_col).alias("_text")), "_text", "_quality")
    return judged.where("_quality.kept").select("_row.*")


def digest(judged: DataFrame, out_col: str = "quality") -> DataFrame:
    return judged.select("doc_id", f"{out_col}.*")
