import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratiform.llm import simhash


def brute_fp(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_real_texts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    want = brute_components(fps, 2)
    rows = simhash.digest(simhash.components(docs)).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {r.doc_id: r.component_id for r in rows} == want


def test_spark_hashes_shingles_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a é b"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a é b", 42)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_linked_fingerprints_share_a_key(radius):
    rng = random.Random(radius)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        ka, kb = simhash.block_keys(np.array([a, b], np.uint64), radius)
        assert set(ka) & set(kb)


def of(links, n):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        assert root(a) != root(b)
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("n, spread", [(40, 3), (300, 4), (900, 2)])
def test_tiles_give_the_components_of_all_pairs(n, spread, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 64)
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, (n // 20 + 1, 2), dtype=np.uint64)
    fps = centres[rng.integers(0, len(centres), n)].copy()
    for i in range(n):
        for bit in rng.integers(0, 128, rng.integers(0, spread + 1)):
            fps[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    ints = {i: int(a) << 64 | int(b) for i, (a, b) in enumerate(fps.tolist())}
    assert of(simhash.tile_links(fps, 3), n) == list(brute_components(ints, 3).values())


def test_tiles_of_distant_population_counts_are_skipped(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 256)
    fps = np.random.default_rng(5).integers(0, 2**63, (2048, 1), dtype=np.uint64)
    real, met = simhash._apart, []
    monkeypatch.setattr(simhash, "_apart", lambda x, y: met.append(len(x) > 1) or real(x, y))
    assert simhash.tile_links(fps, 2) == []
    assert sum(met) < 26  # of 36 pairs of tiles
    met.clear()
    low = fps & np.uint64(0xFFFF)
    assert len(simhash.tile_links(np.concatenate([low, ~low]), 2)) and sum(met) < 85  # of 136


@pytest.mark.parametrize("scheme", [simhash.NARROW, simhash.SIMILAR])
def test_large_buckets_are_cut_without_loss(spark, monkeypatch, scheme):
    rng = np.random.default_rng(2)
    size = scheme.bits // 8
    centres = rng.integers(0, 256, (3, size), dtype=np.uint8)
    fps = {bytes(c) for c in centres}
    while len(fps) < 150:
        c = centres[rng.integers(3)].copy()
        for bit in rng.integers(0, 8 * size, rng.integers(1, scheme.radius)):
            c[bit // 8] ^= np.uint8(1 << (bit % 8))
        fps.add(bytes(c))
    # as wide keys: a few that very many share
    rows = [(f, [int(rng.integers(2)), int(rng.integers(2)) + 5]) for f in sorted(fps)]
    prints = spark.createDataFrame(rows, "fp binary, keys array<long>")
    whole = {frozenset(x) for x in groups(simhash.links(prints, scheme).collect())}
    monkeypatch.setattr(simhash, "BUCKET", 8)
    assert {frozenset(x) for x in groups(simhash.links(prints, scheme).collect())} == whole and max(map(len, whole)) > 20


def groups(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in links:
        up[root(bytes(r.a))] = root(bytes(r.b))
    out = {}
    for x in list(up):
        out.setdefault(root(x), set()).add(x)
    return out.values()


def test_chains_reach_the_smallest_label(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(5, 60)] + [(b"\xf0", b"\xf1")]
    got = {bytes(r.node): bytes(r.label) for r in simhash.smallest_labels(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert got == {bytes([i]): b"\x05" for i in range(5, 61)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


def edited(words, rng, edits):
    w = list(words)
    for _ in range(edits):
        i = rng.randrange(len(w))
        kind = rng.randrange(3)
        w[i : i + 1] = [[f"new{rng.random()}"], [], [w[i], f"more{rng.random()}"]][kind]
    return " ".join(w)


def test_similar_texts_leave_one(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    base = {g: [rng.choice(vocab) for _ in range(300)] for g in range(25)}
    rows, group = [], {}
    for g, words in base.items():
        for k in range(rng.randint(1, 6)):
            i = len(rows)
            rows.append((i, " ".join(words) if k % 2 else edited(words, rng, 5)))
            group[i] = g
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted(min(i for i in group if group[i] == g) for g in base)


def test_unlike_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := t.lower().split())}
    owners = {}
    for i, some in shingles.items():
        for x in some:
            owners.setdefault(x, set()).add(i)
    for i in set(shingles) - kept:
        near = set().union(*(owners[x] for x in shingles[i])) - {i}
        assert any(len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) > 0.799999 for j in near), i
    for i in kept & set(shingles):
        near = {j for x in shingles[i] for j in owners[x] if j != i and j in kept}
        assert all(len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) < 0.8 for j in near), i


def test_edges(edge_docs, no_docs):
    rows = simhash.digest(simhash.components(edge_docs)).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[5].fingerprint == "0" * 16
    assert by[1].component_id == by[2].component_id == by[5].component_id == 1
    assert by[None].component_id is None
    assert simhash.components(no_docs).count() == 0
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(kept.collect(), key=str) == sorted(edge_docs.where("doc_id in (1, 3, 4, 6) or doc_id is null").distinct().collect(), key=str)
    assert simhash.keep_one(no_docs).count() == 0


def test_links_are_confirmed_by_similarity(spark, monkeypatch):
    """Texts of a shared boilerplate at J of 0.55 to 0.95: components are those of all pairs at 0.8 or more."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(300)]
    rows = [(i, " ".join(shared + [word() for _ in range(rng.choice([10, 30, 60, 75, 90, 120]))])) for i in range(90)]
    rows += [(90 + i, " ".join(shared[:200])) for i in range(3)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    want = sorted(i for i in sets if root(i) == i)
    assert 30 < len(want) < 90
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for bucket in (simhash.BUCKET, 40):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want


def test_rejected_candidates_hide_no_link():
    x = np.arange(1000, dtype=np.uint64)
    sets = [x[:800], x[100:900], x[100:905]]
    fps = np.array([[0, 0, 0, 0, len(s)] for s in sets], np.uint64)
    assert simhash.confirmed_links(fps, sets, simhash.SIMILAR) == [(1, 2)]
