import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from stratiform.llm import lm


def words(text):
    return (text or "").encode().lower().split() + [None]


def brute(docs):
    """Base scores, and the model's from plain dictionaries with weights of the same learner."""
    folds = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 for i, _ in docs}
    uni, pair, uni_main, pair_main, starts = Counter(), Counter(), Counter(), Counter(), [0, 0]
    for i, t in docs:
        if folds[i] == 0:
            continue
        w = words(t)
        ps = list(zip(["<s>", *w[:-1]], w))
        uni.update(w), pair.update(ps)
        starts[0] += 1
        if folds[i] != 1:
            uni_main.update(w), pair_main.update(ps)
            starts[1] += 1
    n, v, n_main = sum(uni.values()), len(uni), sum(uni_main.values())

    def parts(w, u, p, total, first):
        out = []
        for a, b in zip(["<s>", *w[:-1]], w):
            c = first if a == "<s>" else u[a]
            k = 0 if c == 0 else 1 + min(lm.BUCKETS - 2, int(math.log2(c) // 2))
            out.append((k, p[a, b] / c if c else 0.0, u[b] / total if total else 0.0))
        return out

    hist = Counter()
    for i, t in docs:
        if folds[i] == 1:
            for k, p2, p1 in parts(words(t), uni_main, pair_main, n_main, starts[1]):
                hist[k, int(lm._bin(np.array([p2]))[0]), int(lm._bin(np.array([p1]))[0])] += 1
    weights = lm.learn_weights(np.array([(*k, c) for k, c in hist.items()], np.int64).reshape(-1, 4), v)
    out = {}
    for i, t in docs:
        w = words(t)
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        model = sum(math.log10(weights[k] @ np.array([p2, p1, 1 / (v + 1)])) for k, p2, p1 in parts(w, uni, pair, n, starts[0]))
        out[i] = (folds[i] == 0, len(w), sum(uni[x] > 0 for x in w), n, base, model)
    return out


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_scores_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(1001, None), (1002, ""), (1003, "unseen zzzz words the THE")]
    want = brute(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = lm.score(table).collect()
    assert len(got) == len(docs)
    for r in got:
        held, n, known, total, base, model = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(model, rel=1e-6)


def test_weights_prefer_what_predicts():
    rows = np.array([[3, 5, 30, 90], [3, 0, 30, 10]], np.int64)
    w = lm.learn_weights(rows, 1000)[3]
    assert w.sum() == pytest.approx(1) and w[0] > 0.85


def test_held_out_texts_score_better_than_the_base(spark):
    rows = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_estimates_sum_to_one():
    rng = random.Random(5)
    w = lm.learn_weights(np.array([[rng.randrange(12), rng.randrange(121), rng.randrange(121), rng.randrange(1, 9)] for _ in range(400)], np.int64), 50)
    assert np.allclose(w.sum(axis=1), 1) and (w[:, 1:] > 0).all()


def test_edges(edge_docs, no_docs):
    rows = lm.score(edge_docs).collect()
    assert len(rows) == 8
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[1] == 1
    assert lm.score(no_docs).count() == 0


def test_estimates_of_a_block_come_in_parts_and_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    n, ids = 3000, np.arange(40)
    sizes = np.bincount(rng.integers(0, 40, n), minlength=40)
    texts, tokens, vocab = np.stack([ids, 0 * ids, sizes], axis=1), rng.integers(0, 90, n).astype(np.int32), np.sort(rng.integers(1, 1 << 63, 90).astype(np.uint64))
    packed = [lm._pack(a) for a in (texts.astype(np.int64).ravel(), tokens, vocab)]
    x = lm._Block(*packed)
    _, keys, place = x.pairs()
    sent = [*lm._sent(1, vocab, *x.counts(x.tokens, len(vocab)), 2), *lm._sent(2, keys, *x.counts(place, len(keys)), 3)]
    asked = pd.DataFrame(sent, columns=["kind", "range", "keys", "main", "tune"]).assign(block=0)
    answers = pd.concat(lm._answer(g) for _, g in asked.groupby(["kind", "range"])).to_dict("records")
    row = pd.DataFrame([packed], columns=["texts", "tokens", "vocab"]).iloc[0]

    t = lm._Totals(row, answers)
    whole = [t.estimates(slice(0, n), 2700.0, 30.0, 90.0, main) for main in (True, False)]
    monkeypatch.setattr(lm, "PART_TOKENS", 101)
    for main, want in zip((True, False), whole):
        got = [t.estimates(part, 2700.0, 30.0, 90.0, main) for part in t.parts()]
        assert max(len(g[0]) for g in got) == 101
        for a, b in zip(zip(*got), want):
            assert np.array_equal(np.concatenate(a), b)
    assert whole[1][3].tolist() == np.bincount(x.tokens[x.of_token != lm.HELD_OUT], minlength=90)[x.tokens].tolist()
