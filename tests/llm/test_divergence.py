import re
from collections import Counter, defaultdict

from stratiform.llm import divergence, queries
from tests.oracle import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


def brute(docs, least=10, top=10):
    """The audit in plain Python, by integers."""
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in docs):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        counts[lang, source].update(terms)
        found[lang].update(set(terms))
        groups[lang].add(source)
    rows = []
    for lang, sources in groups.items():
        kept = [t for t, d in found[lang].items() if d >= least]
        total = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}
        of, q = {s: p(counts[lang, s]) for s in sources}, p(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(of[s][t], of[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(f(of[s][t], q[t]), t) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, some, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(some, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    rows.append((lang, s, part, item, value, rank))
    return sorted(rows)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_equals_the_plain_form(spark):
    word = lambda i, j: f"{'term' if (i * j) % 3 else 'Wort'}{'abcdefgh'[(i * 7 + j) % 8]}"
    docs = [(" ".join(word(i, j) for j in range(3 + i % 11)) + " Ünï-日本 x1y", "de" if i % 5 else "en", f"s{i % 4}") for i in range(120)]
    docs += [(None, None, None), ("", "xx", "only"), ("a\x00b", "xx", "other"), (None, "de", "silent"), ("rare", "", "s0")] + docs[:6]
    df = spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS _salt", "'x' AS doc_id").repartition(3)
    assert got(divergence.audit(df)) == brute(docs)
    assert got(divergence.audit(df, least_documents=3, top_terms=2)) == brute(docs, 3, 2)


def test_no_documents(spark, no_docs):
    assert divergence.audit(no_docs).collect() == []


def test_edges(spark, edge_docs):
    rows = [(r.text, r.lang, r.source) for r in edge_docs.collect()]
    assert got(divergence.audit(edge_docs)) == brute(rows)


def test_query_equals_its_sql(spark):
    assert rows_of_spark(queries.QUERIES["op11_divergence"](spark, SF)) == rows_of_sql(connect(SF), queries.ORACLE_SQL["op11_divergence"])
