import functools
import random
import zlib

import numpy as np
import pytest

from stratiform.llm import packing, token_store, tokens
from stratiform.llm.queries import tokenizer_path
from stratiform.llm.tokens import Encoder, slices

TOK = tokenizer_path()
ALPHABET = ["a", "b", "'s", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "　", "é", "1", ".", "<|endoftext|>", "日", "\r\n", "​", "᠎", "﻿", "' s", "word"]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOK)


def whole(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_ids_equal_those_of_the_whole_text():
    rng, enc = random.Random(7), Encoder(TOK)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 16)))
        assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_do_not_depend_on_the_group(monkeypatch):
    rng, enc = random.Random(8), Encoder(TOK)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, ""]
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokens, "CACHE_PIECES", 20)
    monkeypatch.setattr(tokens, "RUN_PIECES", 3)
    for size in (1, 30, 1000, 1 << 20):
        monkeypatch.setattr(tokens, "GROUP_CHARS", size)
        assert [x.tolist() for x in Encoder(TOK).encode_many(texts)] == want
    assert all("".join(slices(t, 5)) == t for t in texts if t)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_pieces_of_equal_hashes_are_told_apart(n):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 in any odd base."""
    enc = Encoder(TOK)
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((word + other).encode(), np.uint8)
    h = enc.hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] == h[1]
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in (word, other, f"x {word} y", f"{other} {word}")]
    assert [x.tolist() for x in enc.encode_many([word, other, f"x {word} y", f"{other} {word}"])] == want
    assert enc.encode(other).tolist() == want[1] and enc.encode(word).tolist() == want[0]  # from the cache


def test_ids_of_real_texts(spark):
    enc = Encoder(TOK)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert enc.encode(r.text).tolist() == enc.tokenizer.encode(r.text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_fullest_is_the_best_subset_sum(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
    room = rng.randint(1, 60)
    sums = {0}
    for n, c in counts.items():
        for _ in range(c):
            sums |= {s + n for s in sums if s + n <= room}
    got = packing.fullest(counts, room)
    assert sum(got) == max(sums)
    assert all(got.count(n) <= counts[n] for n in got)


@pytest.mark.parametrize("seed", range(10))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 100): rng.randint(1, 60) for _ in range(30)}
    used = dict.fromkeys(histogram, 0)
    for times, lengths in packing.plan_bins(histogram, 100):
        assert sum(lengths) <= 100
        for n in lengths:
            used[n] += times
    assert used == histogram
    rooms = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fit = next((i for i, r in enumerate(rooms) if r >= n), None)
        if fit is None:
            rooms.append(100 - n)
        else:
            rooms[fit] -= n
    assert sum(t for t, _ in packing.plan_bins(histogram, 100)) <= len(rooms)


def check_layout(rows, texts, capacity, end_id):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = np.array([*whole(text), end_id], "<u4")
        at = 0
        for i, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at)
            assert r.length == capacity or i == 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert set(by_seq) == set(range(len(by_seq)))
    return len(by_seq)


def test_pack_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, TOK, 512, 0).collect()
    n = check_layout(rows, {r.doc_id: r.text for r in docs.collect()}, 512, 0)
    assert n <= -(-sum(r.length for r in rows) // 512) + 1


def test_pack_a_hot_length(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else f"other text {i} " * (i % 7)) for i in range(3000)], "doc_id long, text string").repartition(7)
    check_layout(packing.pack(docs, TOK, 64, 0).collect(), {i: "same text" if i % 3 else f"other text {i} " * (i % 7) for i in range(0, 3000)}, 64, 0)


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f g")], "doc_id long, text string")
    assert [r.fill for r in packing.sequences(packing.pack(docs, TOK, 2048, 0)).collect()] == [9]


def test_edges(edge_docs, no_docs):
    rows = packing.pack(edge_docs, TOK, 128, 0).collect()
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6}
    assert sum(r.doc_id == 3 for r in rows) == 2
    assert packing.pack(no_docs, TOK, 128, 0).count() == 0


# ---- token files


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], [7] * 1000, list(range(0, 70000, 7))])
def test_segment_random_access(ids):
    if not ids:
        return
    a = np.array(ids, np.uint32)
    data, levels = token_store.encode_segment(a)
    s = token_store.Segment(data, levels)
    assert s.tokens(0, len(a)).tolist() == ids
    rng = random.Random(1)
    for _ in range(200):
        i = rng.randrange(len(a))
        j = rng.randint(i + 1, len(a))
        assert s.token(i) == ids[i]
        assert s.tokens(i, j).tolist() == ids[i:j]


def test_round_trip_real_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in token_store.round_trip(spark, docs, TOK, 2).collect()}
    at = 0
    for doc in sorted(texts):
        ids = np.array([*whole(texts[doc]), 2], "<u4")
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_random_access_in_a_file(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_TOKENS", 1000)
    rng = np.random.default_rng(3)
    docs = [(i, rng.integers(0, 50_000, rng.integers(1, 900)).astype(np.uint32)) for i in range(40)]
    with open(tmp_path / "x.dac", "wb") as out:
        w = token_store._Writer(out)
        for i, ids in docs:
            w.add(i, ids)
        w.close()
    every = np.concatenate([d for _, d in docs])
    with open(tmp_path / "x.dac", "rb") as raw:
        f = token_store.TokenFile(raw)
        assert [int(f.token(i)) for i in range(0, len(every), 37)] == every[::37].tolist()
        for (i, ids), row in zip(docs, f.index()):
            assert row["id"] == i and row["n"] == len(ids)
            assert np.concatenate(list(f.tokens(int(row["first"]), int(row["first"] + row["n"])))).tolist() == ids.tolist()


def test_a_cut_file_is_noticed(tmp_path):
    with open(tmp_path / "x.dac", "wb") as out:
        w = token_store._Writer(out)
        w.add(1, np.arange(100, dtype=np.uint32))
        w.close()
    data = (tmp_path / "x.dac").read_bytes()
    (tmp_path / "y.dac").write_bytes(data[:-5])
    with pytest.raises(ValueError), open(tmp_path / "y.dac", "rb") as raw:
        token_store.TokenFile(raw)


def test_token_store_edges(spark, edge_docs, no_docs):
    rows = token_store.round_trip(spark, edge_docs, TOK, 2).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 4, 5, 6]
    assert rows[1].n_tokens == 1
    assert token_store.round_trip(spark, no_docs, TOK, 2).count() == 0


def test_sequences_of_edge_texts(edge_docs, no_docs):
    placed = packing.pack(edge_docs, TOK, capacity=64)
    rows = packing.sequences(placed).collect()
    assert sum(len(r.pieces) for r in rows) == placed.count() and max(r.fill for r in rows) <= 64
    assert all([p.offset for p in r.pieces] == sorted(p.offset for p in r.pieces) for r in rows)
    assert packing.sequences(packing.pack(no_docs, TOK)).count() == 0


def test_tasks_follow_the_bytes(spark, monkeypatch):
    from stratiform.llm import scratch

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert scratch.tasks(docs) == 4
    monkeypatch.setattr(scratch, "TASK_BYTES", 1000)
    assert 20 < scratch.tasks(docs) < 10_000 and scratch.tasks(docs, 2.0) > 1.9 * scratch.tasks(docs)
    got = token_store.round_trip(spark, docs, TOK, 2)
    assert got.count() == docs.count()
