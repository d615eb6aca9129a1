import random
import re
from collections import defaultdict

from stratiform.llm import lines
from stratiform.llm.lines import templates


def patterns(line):
    """Templates of a line as tuples of words, None for an open field; written apart from the operator."""
    words = [None if re.search("[0-9]", w) else w for w in re.split("[ \t\v\f\r]+", line.strip(" \t\v\f\r"))]
    n = len(words)
    solid = lambda ws: 2 * sum(w is not None for w in ws) >= n
    if not solid(words):
        return {("as it stands", *line.split())}
    out = {("all", *words)}
    for k in range(4 if n >= 8 else 0):
        lo, hi = (2 + (n - 2) * i // 4 for i in (k, k + 1))
        left = words[:lo] + [None] * (hi - lo) + words[hi:]
        if solid(words[:lo] + words[hi:]):
            out.add((k, n, *left[:lo], "open", *left[hi:]))
    return out


def signs(text):
    """For each line of a text: what it recurs by in two documents, and what by in ten texts."""
    rows = [x.split() for x in text.split("\n")]
    full = [i for i, r in enumerate(rows) if r]
    out = []
    for i, line in enumerate(text.split("\n")):
        if not rows[i]:
            out.append((set(), None))
        elif len(rows[i]) >= 8:
            out.append((patterns(line), None))
        else:
            at = full.index(i)
            before = next((full[k : at + 1] for k in range(at, -1, -1) if sum(len(rows[j]) for j in full[k : at + 1]) >= 8), None)
            run = before or next((full[:k] for k in range(at + 1, len(full)) if sum(len(rows[j]) for j in full[:k]) >= 8), full)
            enough = sum(len(rows[j]) for j in run) >= 8
            out.append(({("passage", run.index(i), enough, *(tuple(rows[j]) for j in run))}, min(patterns(line), key=repr) if len(rows[i]) >= 3 else None))
    return out


def brute(docs):
    """The operator's rule, line by line, on rows with distinct ids."""
    of = {i: signs(t or "") for i, t in docs}
    holders, alone = defaultdict(set), defaultdict(set)
    for i, lines_ in of.items():
        for strong, weak in lines_:
            for k in strong:
                holders[k].add(i)
            if weak:
                alone[weak].add(i)
    out = {}
    for i, t in docs:
        if t is None:
            out[i] = None
            continue
        stay = [x for x, (strong, weak) in zip(t.split("\n"), of[i]) if not any(min(holders[k]) < i for k in strong) and not (weak and len(alone[weak]) >= 10 and min(alone[weak]) < i)]
        out[i] = "\n".join(stay)
    return out


def corpus(n=200):
    rng = random.Random(4)
    vocab = [f"v{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    common = [line(12), line(20), line(4), line(60)]
    out = []
    for i in range(n):
        body = [line(rng.randint(5, 40)) for _ in range(rng.randint(4, 9))]
        if i % 3 == 0:
            body.insert(1, common[i % 4])
        if i % 7 == 0:
            body.append(f"posted by {rng.choice(vocab)} on 2024-01-{i % 28 + 1:02d} at the usual place and time as ever")
        if i % 11 == 0:
            w = common[1].split()
            w[rng.randrange(2, 20)] = "changed"
            body.append(" ".join(w))
        out.append((i, "\n".join(body)))
    return out + [(n, out[5][1]), (n + 1, out[5][1] + "\nand one line more than the other has"), (n + 2, None), (n + 3, "")]


def test_against_brute_force(spark):
    docs = corpus()
    got = {r.doc_id: r for r in lines.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), count_col="n_dropped").collect()}
    want = brute(docs)
    assert {i: r.text for i, r in got.items()} == want
    before = dict(docs)
    left = lambda t: t.count("\n") + 1 if t else 0
    assert all(r.n_dropped == (left(before[i]) - left(r.text)) for i, r in got.items())
    assert sum(r.n_dropped > 0 for r in got.values()) > 60


def test_nothing_stays_of_copies_but_their_own_lines(spark):
    docs = corpus()
    got = {r.doc_id: r.text for r in lines.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[200] == "" and got[201] == "and one line more than the other has"
    assert got[5] == brute(docs)[5] != ""


def test_no_recurring_line_is_left_in_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = lines.drop_recurring(docs, count_col="n_dropped").collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.text for r in got} == want
    assert sum(r.n_dropped for r in got) > 1165


def test_short_lines_go_with_their_passage_or_when_common(spark):
    own = lambda i: " ".join(f"w{chr(97 + i)}{chr(97 + k)}" for k in range(12))
    passage = "a heading\none two three four five six seven\n*"
    rows = [(1, f"{own(1)}\n{passage}\n{own(2)}"), (2, f"{own(3)}\n*\n{passage}\n{own(4)}"), (3, "tiny"), (4, " tiny\n"), (5, f"{own(5)}\na heading")]
    got = {r.doc_id: r.text for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the heading has another line before it in document 2, so its passage is not the same
    assert got == dict(rows) | {2: f"{own(3)}\n*\na heading\n{own(4)}", 4: ""}
    rows = [(i, f"{own(i)}\nread more here\n{own(i + 13)}") for i in range(10)]
    few, many = spark.createDataFrame(rows[:9], "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    assert sum("read more" in r.text for r in lines.drop_recurring(few).collect()) == 9
    assert sum("read more" in r.text for r in lines.drop_recurring(many).collect()) == 1
    assert sum("read more" in r.text for r in lines.drop_recurring(few, short_texts=2).collect()) == 1


def test_variable_fields_share_a_template():
    a, b, c = b"user 17 logged in from host9 at noon", b"user 99 logged in from host1 at noon", b"user 17 logged in to host9 at noon"
    assert templates(a)[0] == templates(b)[0] != templates(c)[0]
    assert set(templates(a)) & set(templates(c))


def test_edges(edge_docs, no_docs):
    out = lines.drop_recurring(edge_docs)
    assert out.columns == edge_docs.columns
    assert sorted(out.collect(), key=str) == sorted(edge_docs.collect(), key=str)
    assert lines.drop_recurring(no_docs).count() == 0


def test_rows_of_numbers_are_not_one_template(spark):
    prose = lambda i: "\n" + " ".join(f"word{chr(97 + i)}{chr(97 + k)}" for k in range(26))
    rows = [(i, " ".join(str(1000 * i + k) for k in range(9)) + f"\n{i} {i + 1} {i + 2}\n{i} {i + 7} total of {i + 3} {i + 4} {i + 5} {i + 6} {i + 8}" + prose(i)) for i in range(12)]
    same = "\n2024-01-01 10 20 30 40 50 60 70"
    rows += [(20, prose(20)[1:] + same + prose(21)), (21, prose(22)[1:] + same + prose(23))]
    got = {r.doc_id: r.text for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(rows) | {21: rows[-1][1].replace(same, "")}
    assert got == want


def test_rows_without_an_id_give_way(spark):
    shared = "these eight words are a line that texts share"
    for k in range(12):  # whatever the sign of the text's hash
        docs = spark.createDataFrame([(None, f"{shared}\nown {k} of the row without an id here"), (7, f"{shared}\nof document seven alone, number {k}")], "doc_id long, text string")
        got = {r.doc_id: r.text for r in lines.drop_recurring(docs).collect()}
        assert got == {7: f"{shared}\nof document seven alone, number {k}", None: f"own {k} of the row without an id here"}


def test_shortest_is_a_parameter(spark):
    docs = spark.createDataFrame([(i, f"Thank you\n{' '.join(f'w{i}x{j}' for j in range(9))} unlike any other line there is of that") for i in range(12)], "doc_id long, text string")
    held = lambda **kw: sum("Thank you" in r.text for r in lines.drop_recurring(docs, **kw).collect())
    assert held() == 12
    assert held(shortest=2) == 1
