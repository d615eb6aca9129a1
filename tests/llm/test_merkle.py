import hashlib
import random

import pytest

from stratiform.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def brute(docs):
    """(doc_id, text) -> rows, each text beside the next by id; null ids last, rows of one id in any order."""
    out = []
    for (i, a), (_, b) in zip(docs, docs[1:] + docs[:1]):
        a, b = a or "", b or ""
        half = len(a) // 2
        changed = a[: len(a) - half] + b[:half]
        own, of_changed = merkle.fingerprint(a), merkle.fingerprint(changed)
        out.append((i, len(a), hashlib.sha256(changed.encode()).hexdigest(), own, of_changed, merkle.likeness(own, of_changed), merkle.likeness(own, merkle.fingerprint(b))))
    return out


def text_of(draw, lines):
    return "\n".join(" ".join("".join(draw.choices("abcdefé日", k=draw.randrange(2, 9))) for _ in range(draw.randrange(1, 30))) for _ in range(lines))


def leaves(node):
    return [p for n in node.parts for p in leaves(n)] if node.parts else [node] if node.end > node.start else []


@pytest.mark.parametrize("text", ["", "a", "\n\n\n", "a" * 5000, "日" * 3000, "ab\n" * 700, "x\n\ny\n", *(text_of(random.Random(s), 40) for s in range(4))])
def test_pieces_make_up_the_text(text):
    data = text.encode()
    pieces = leaves(merkle.tree(text))
    assert b"".join(data[p.start : p.end] for p in pieces) == data
    assert all(data[p.start : p.end].decode() for p in pieces)
    assert all(p.end - p.start <= merkle.LONGEST + 3 for p in pieces)
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text)) == 1


def test_slices_do_not_matter(monkeypatch):
    text = text_of(random.Random(9), 300)
    whole = merkle.tree(text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(merkle, "SLICE_BYTES", size)
        assert merkle.tree(text) == whole


def test_edits_are_located():
    draw = random.Random(3)
    for _ in range(60):
        text = text_of(draw, draw.randrange(1, 60))
        at, gone = draw.randrange(len(text)), draw.randrange(0, 30)
        other = text[:at] + "NEW" * draw.randrange(0, 3) + text[at + gone :]
        if other == text:
            assert merkle.changes(text, other) == []
            continue
        spans = merkle.changes(text, other)
        first, last = len(text[:at].encode()), len(text[: at + gone].encode())
        missing = [i for i in range(first, last) if not any(s <= i < e for s, e in spans)]
        told = merkle.changes(other, text)
        assert not missing or told  # what is gone shows on one side at least
        assert sum(e - s for s, e in spans) <= gone * 4 + 1200
        assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(other)) < 1


def test_likeness_falls_with_what_is_replaced():
    draw = random.Random(4)
    text, other = text_of(draw, 80), text_of(draw, 80)
    at = lambda share: merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text[: int(len(text) * (1 - share))] + other[: int(len(text) * share)]))
    found = [at(s) for s in (0, 0.1, 0.25, 0.5, 0.75, 1)]
    assert found == sorted(found, reverse=True)
    assert found[0] == 1 and 0.4 < found[3] < 0.6 and found[-1] < 0.1


def rows(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_equals_the_plain_form(spark, n):
    draw = random.Random(n)
    docs = [(i * 3 - 7, draw.choice([None, "", text_of(draw, draw.randrange(1, 9)), "same text"])) for i in range(n)]
    df = spark.createDataFrame(draw.sample(docs, n), "doc_id long, text string").selectExpr("*", "1 AS _part", "2 AS _text", "3 AS _kind").repartition(3)
    assert rows(merkle.compare_edits(df)) == sorted(brute(docs), key=repr)


def test_edges(spark, edge_docs, no_docs):
    assert merkle.compare_edits(no_docs).collect() == []
    docs = sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert rows(merkle.compare_edits(edge_docs)) == sorted(brute(docs), key=repr)


def test_equal_roots_are_equal_texts(spark):
    got = queries.QUERIES["op13_merkle"](spark, SF).select("doc_id", "fingerprint").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts)
    assert len({r.fingerprint.split(":")[0] for r in got}) == len(set(texts.values())) == len({r.fingerprint for r in got})


def test_tables(spark):
    pairs = spark.createDataFrame([(1, "one line\nand another\n", "one line\nand another\n"), (2, "kept line of a text\nthis one goes away", "kept line of a text\n"), (None, None, "x")], "doc_id long, text string, other string")
    spans = merkle.locate(pairs).collect()
    assert {r.doc_id for r in spans} == {2} and min(r.start for r in spans) >= 10
    tree = merkle.nodes(pairs).where("doc_id = 1").collect()
    assert {r.level for r in tree} == {0, 1, 2, 3}
    assert sum(r.end - r.start for r in tree if r.level == 3) == len("one line\nand another\n")
