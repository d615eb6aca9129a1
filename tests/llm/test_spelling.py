import random
import re
import zlib
from collections import Counter

import pytest

from stratiform.llm import queries, spelling
from tests.oracle import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, every=199, letters=6, occurrences=5, commoner=5):
    """All pairs of words, in plain Python."""
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= letters and c >= occurrences}
    of = {w: [o for o in words if near(w, o)] for w in words}
    best = {w: min(o, key=lambda x: (-words[x], x)) for w, o in of.items() if o}
    form = {w: b for w, b in best.items() if words[b] >= commoner * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), c, len(of[w]), words.get(form.get(w), 0)) for w, c in words.items())


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def documents(seed, alphabet, longest):
    """Words that are a few edits apart, in counts that make chains of forms."""
    draw = random.Random(seed)
    words = ["".join(draw.choices(alphabet, k=draw.randrange(6, longest))) for _ in range(12)]
    for w in list(words) * 8:
        for _ in range(draw.randrange(1, 4)):
            at, c = draw.randrange(len(w)), draw.choice(alphabet)
            w = draw.choice((w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]))
            words.append(w)
    return [(i, " ".join(w.title() if draw.random() < 0.1 else w for w in draw.choices(words, [draw.choice((1, 1, 6, 40, 300)) for _ in words], k=90))) for i in range(60)]


@pytest.mark.parametrize("seed, alphabet, longest", [(1, "ab", 9), (2, "aé", 8), (3, "abcdÿÀ", 12), (4, "a", 14), (5, "etaoinshéüß", 10)])
def test_equals_all_pairs(spark, seed, alphabet, longest):
    docs = documents(seed, alphabet, longest)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for every in (199, 3):
        assert got(spelling.variants(df, every=every)) == brute(docs, every)


def test_chains_of_forms(spark):
    step = ["abcdef", "abcdeg", "abcdgg", "abcggg", "abgggg", "aggggg"]
    docs = [(1, " ".join(w for i, w in enumerate(step) for _ in range(5 * 5**i)))]
    rows = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), every=1 << 40).collect()}
    assert rows == {w: (f, "aggggg") for w, f in zip(step, step[1:])} | {"aggggg": (None, "aggggg")}


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()] * 3
    assert got(spelling.variants(edge_docs.union(edge_docs).union(edge_docs), occurrences=2)) == brute(rows, occurrences=2)
    assert spelling.variants(no_docs).collect() == []


def test_query_equals_its_sql(spark):
    assert rows_of_spark(queries.QUERIES["op12_spelling"](spark, SF)) == rows_of_sql(connect(SF), queries.ORACLE_SQL["op12_spelling"])
