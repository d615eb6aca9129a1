import random
import re

import pytest

from stratiform.llm import decontam


def toks(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def brute(docs, items, least=20, share=0.8):
    """All alignments on which at least one mask's window agrees, verified as the operator does."""
    out = {}
    for d, text in docs:
        w = toks(text)
        for i, item in items:
            x = toks(item)
            width = min(least, len(x))
            for shift in range(-len(x) + 1, len(w)):
                agree = [0 <= k + shift < len(w) and w[k + shift] == t for k, t in enumerate(x)]
                hit = any(all(agree[a + j] for j, c in enumerate(m) if c == "1") for m in decontam.MASKS for a in range(max(0, -shift), min(len(x), len(w) - shift) - len(m) + 1))
                best = max((sum(agree[s : s + width]) for s in range(len(x) - width + 1)), default=0)
                if hit and best >= -(-8 * width // 10):
                    n, b = out.get((d, i), (0, 0))
                    out[d, i] = max(n, sum(agree)), max(b, best)
    return out


def cases(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([14, 18, 30, 45, 59, 8, 7, 25])]
    docs = []
    for d in range(60):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 150))]
        if d % 2:
            piece = items[d % len(items)][1].split()
            if d % 3 == 0:
                piece = piece[: len(piece) // 2]
            for _ in range(d % 7):
                piece[rng.randrange(len(piece))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = piece
        docs.append((d, " ".join(body).upper() if d % 5 == 0 else ", ".join(body)))
    return docs, items


@pytest.mark.parametrize("words", [decontam.BROADCAST_WORDS, 0])
def test_against_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", words)
    docs, items = cases()
    found = decontam.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert len(want) > 10
    assert {(r.doc_id, r.item_id): (r.n_agree, r.best) for r in found} == want


def test_planted_passages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(docs, bench).collect()}
    items = [(b.item_id, " ".join(toks(b.text))) for b in bench.collect()]
    plain = {(d.doc_id, i) for d in docs.collect() for t in [" ".join(toks(d.text))] for i, x in items if f" {x} " in f" {t} "}
    assert plain and plain <= found


def test_no_python_in_the_plan(spark):
    docs, items = cases()
    plan = decontam.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "ArrowEval"))


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "no id here but a text of several words"), (3, " ".join(f"word{i % 977}x{i}" for i in range(50_000, 50_040)))], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(edge_docs, bench).collect()}
    assert found == {(None, None), (4, 3)}
    kept = decontam.drop_contaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 3, 5, 6]
    assert decontam.find_overlaps(no_docs, bench).count() == 0
    assert decontam.find_overlaps(edge_docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("words", [decontam.BROADCAST_WORDS, 0])
def test_rows_of_one_id_are_told_apart_by_text(spark, monkeypatch, words):
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", words)
    item = " ".join(f"w{k}" for k in range(30))
    docs = [(None, "before " + item), (None, "clean without an id"), (None, None), (7, item + " after"), (7, "clean with a repeated id"), (8, "clean")]
    kept = decontam.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((docs[i] for i in (1, 2, 4, 5)), key=str)


def test_recall_of_changed_passages(spark):
    """Passages of which a fifth of the words are changed are found, nearly all of them."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(5000)}"
    for length, least in ((20, 0.9), (30, 0.95), (60, 0.99)):
        items = [(i, [word() for _ in range(length)]) for i in range(300)]
        docs = []
        for i, x in items:
            y = list(x)
            for k in rng.sample(range(length), length // 5):
                y[k] = "changed"
            docs.append((i, " ".join([word() for _ in range(30)] + y + [word() for _ in range(30)])))
        found = decontam.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string"))
        hit = {r.doc_id for r in found.where("doc_id = item_id").collect()}
        assert len(hit) >= least * 300, (length, len(hit))
