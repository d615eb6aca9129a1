"""Token ids of whole texts by a public tokenizer, in tasks.

A byte-level tokenizer of this family cuts a text, before it looks at its vocabulary, where a space
follows a character that is no white space, and on either side of a line end between such
characters. What it gives for a piece between cuts does not depend on the pieces around it. Pieces
recur, so those of a group of texts are found by numpy, a bounded cache holds the ids that the
tokenizer has given to earlier ones, and new ones go to it many at a time. Ids equal those of
encoding each text whole.

A piece is looked up by a 64-bit hash and compared with the bytes that it stands for, in its group
and in the cache; a text with a piece that differs from them goes to the tokenizer as it is.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Pieces that the cache keeps, those used last; it may grow to twice as many.
CACHE_PIECES = 1 << 19
#: Characters of the texts that are cut at once, and pieces in one text for the tokenizer.
GROUP_CHARS, RUN_PIECES = 1 << 21, 512
#: White space beyond ASCII; a text with any goes to the tokenizer as it is.
_FOREIGN_SPACE = re.compile("[\x85\xa0 ᠎ -​    　﻿]")
#: A space after a mark, letter or digit of ASCII begins a piece.
_CUT = re.compile("[!-~] ")
#: Bytes that are, or may count as, white space.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_BASE = 0x9E3779B97F4A7C15
_NONE = np.zeros(0, np.int64)


class Encoder:
    """Ids of texts as uint32 arrays."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        names = self.tokenizer.get_vocab()
        #: Whether an id's bytes begin with a space.
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for x, i in names.items() if x.startswith(space)]] = True
        # the cache: sorted hashes, the group that used each last, where its ids and bytes are and how many
        self.keys, self.used, self.first, self.count = np.zeros(0, np.uint64), _NONE, _NONE, _NONE
        self.begin, self.size = _NONE, _NONE
        self.ids, self.bytes, self.groups = np.zeros(0, "<u4"), np.zeros(0, np.uint8), 0
        self.powers = self.inverses = np.ones(1, np.uint64)

    # ---- pieces of a group -----------------------------------------------------------------------

    def cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pieces begin in the bytes of texts that begin at ``starts``."""
        first = np.zeros(len(data) + 1, bool)
        first[starts] = first[-1] = True
        space = _SPACE[data]
        before = np.empty(len(data), bool)
        before[:1], before[1:] = True, space[:-1]
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = True, space[1:]
        line_end = (data == 10) & ~before & ~after & ~first[:-1] & ~first[1:]
        first[:-1] |= (data == 32) & ~before | line_end
        first[1:] |= line_end
        return np.flatnonzero(first[:-1])

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each piece: its bytes as digits, from sums over all bytes before."""
        if len(self.powers) < len(data) + 1:
            n = len(data) + 1
            self.powers, self.inverses = (np.cumprod(np.where(np.arange(n), np.uint64(x), np.uint64(1)), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        h = (sums[end] - sums[begin]) * self.inverses[begin]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)

    # ---- the tokenizer ---------------------------------------------------------------------------

    def _each(self, some: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for i in range(0, len(some), 1000) for e in self.tokenizer.encode_batch_fast(some[i : i + 1000], add_special_tokens=False)]

    def _tokenised(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has.

        Pieces of a space and what is no white space are encoded many in one text: a space then begins
        a token and no other token does, which shows the pieces' ids. Others are encoded one by one.
        """
        joint = [i for i, x in enumerate(some) if x[0] == " " and len(x) == len(y := x.strip()) + 1 and " " not in y]
        apart = sorted(set(range(len(some))).difference(joint))
        ids, counts = [np.zeros(0, "<u4")], np.zeros(len(some), np.int64)
        for lo in range(0, len(joint), RUN_PIECES * 64):
            runs = [joint[i : i + RUN_PIECES] for i in range(lo, min(len(joint), lo + RUN_PIECES * 64), RUN_PIECES)]
            for run, got in zip(runs, self._each(["".join([some[i] for i in r]) for r in runs])):
                edges = np.flatnonzero(self.spaced[got])
                if len(edges) != len(run):
                    raise ValueError("the tokenizer does not begin a token at each space")
                counts[run] = np.diff(edges, append=len(got))
                ids.append(got)
        got = self._each([some[i] for i in apart])
        counts[apart] = [len(x) for x in got]
        order = np.array(joint + apart, np.int64)
        first = np.zeros(len(some), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(ids + got), np.stack([first, counts])

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Add pieces to the cache."""
        some = [p.decode() for p in pieces]
        ids, (first, count) = self._tokenised(some)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        size = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.concatenate([self.begin, np.cumsum(size) - size + len(self.bytes)])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
        first = np.concatenate([self.first, first + len(self.ids)])[order]
        self.keys, self.first, self.count = keys[order], first, np.concatenate([self.count, count])[order]
        self.used = np.concatenate([self.used, np.full(len(some), self.groups)])[order]
        self.ids = np.concatenate([self.ids, ids])

    def _forget(self) -> None:
        """Keep the pieces that were used last."""
        stay = np.sort(np.argsort(-self.used, kind="stable")[:CACHE_PIECES])
        self.keys, self.used = self.keys[stay], self.used[stay]
        self.ids, edges = _gathered(self.ids, self.first[stay], self.count[stay])
        self.first, self.count = edges[:-1], self.count[stay]
        self.bytes, edges = _gathered(self.bytes, self.begin[stay], self.size[stay])
        self.begin, self.size = edges[:-1], self.size[stay]

    # ---- texts -----------------------------------------------------------------------------------

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order, a bounded group of texts at a time."""
        held, size = [], 0
        for t in texts:
            if len(t or "") > GROUP_CHARS:
                yield from self._group(held)
                held, size = [], 0
                yield np.concatenate([ids for x in slices(t, GROUP_CHARS) for ids in self._group([x])])
                continue
            held.append(t or "")
            size += len(t or "")
            if size >= GROUP_CHARS:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = [i for i, t in enumerate(texts) if _FOREIGN_SPACE.search(t)]
        whole = dict(zip(odd, self._each([texts[i] for i in odd])))
        parts = [b"" if i in whole else t.encode() for i, t in enumerate(texts)]
        blob = b"".join(parts)
        data = np.frombuffer(blob, np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        begin = self.cuts(data, edges[:-1])
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        keys, at, piece = np.unique(self.hashes(data, begin, end), return_index=True, return_inverse=True)
        self.groups += 1
        place = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = at[~known]
            self._learn(keys[~known], [blob[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist())])
            place = np.searchsorted(self.keys, keys)
        self.used[place] = self.groups
        other = ~_equal(data, begin[at], end[at] - begin[at], self.bytes, self.begin[place], self.size[place])[piece]
        other |= ~_equal(data, begin, end - begin, data, begin[at][piece], (end - begin)[at][piece])
        if other.any():
            again = np.unique(np.searchsorted(edges, begin[other], "right") - 1).tolist()
            whole |= dict(zip(again, self._each([texts[i] for i in again])))
        ids, bounds = _gathered(self.ids, self.first[place][piece], self.count[place][piece])
        of_text = bounds[np.searchsorted(begin, edges)]
        if len(self.keys) > 2 * CACHE_PIECES:
            self._forget()
        for i in range(len(texts)):
            yield whole[i] if i in whole else ids[of_text[i] : of_text[i + 1]]

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_many([text]))


def slices(text: str, size: int) -> Iterator[str]:
    """Cut a long text where pieces begin, into slices of about ``size``."""
    lo = 0
    while lo < len(text):
        cut = _CUT.search(text, lo + size)
        hi = cut.start() + 1 if cut else len(text)
        yield text[lo:hi]
        lo = hi


def _gathered(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` at ``first``, ``count`` long, one after the other, and where each begins."""
    edges = np.concatenate([[0], np.cumsum(count)])
    return ids[np.repeat(first - edges[:-1], count) + np.arange(edges[-1])], edges


def _equal(x: np.ndarray, x_at: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_at: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """Whether the runs of ``x`` and of ``y``, none of them empty, are equal, two by two."""
    size = np.minimum(x_size, y_size)
    if not len(size):
        return np.zeros(0, bool)
    edges = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(edges, size)
    differ = x[np.repeat(x_at, size) + step] != y[np.repeat(y_at, size) + step]
    return ~np.logical_or.reduceat(differ, edges) & (x_size == y_size)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder, kept between its tasks."""
    return Encoder(path)
