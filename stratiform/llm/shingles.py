"""Words and hashed word shingles of whole texts, a bounded slice at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from xxhash import xxh64_intdigest

#: Bytes of a text that are split into words at once.
SLICE_BYTES = 1 << 21


def word_runs(data: bytes) -> Iterator[list[bytes]]:
    """All ``[^\\x20\\x09-\\x0D]+`` words of ``data``, in runs; bytes.split() cuts at just those six."""
    if len(data) <= SLICE_BYTES:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].split()
        at = end


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of ``width`` words (A-Z in lower case, joined by a space), in runs.

    A text of fewer words, but at least one, is one shingle; a text of none gives nothing.
    """
    held: list[bytes] = []
    any_yet = False
    for run in word_runs((text or "").encode("utf-8", "surrogatepass").lower()):
        held += run
        if len(held) >= width:
            joined = map(b" ".join, zip(*(held[i:] for i in range(width))))
            yield np.fromiter(map(xxh64_intdigest, joined, repeat(seed)), np.uint64, len(held) - width + 1)
            any_yet = True
            held = held[len(held) - width + 1 :]
    if held and not any_yet:
        yield np.array([xxh64_intdigest(b" ".join(held), seed)], np.uint64)
