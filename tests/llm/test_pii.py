import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stratiform.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 12 <= len(d) <= 19 and luhn(d),
        "phone": lambda: 9 <= len(d) <= 15,
    }[kind]()


def brute(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}", k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(found)


def base_of(row):
    return ",".join(x for x in row.spans.split(",") if x.split(":")[0] in BASE)


CASES = [
    "mail a.b+c@x-y.example.com, a@b.c_d@e.f.g and a@b.c.d@e.f @x.y a@b",
    "x@y.z..w q@-.- .@.a.b %%@a.b 1@2.3",
    "ip 1.2.3.4 01.002.255.255 256.1.1.1 1.2.3.4.5.6.7.8 1.2.3 1..2.3.4 999999999999999999999.1.1.1",
    "card 4111 1111 1111 1111 4111-1111-1111-1112 4041894974608795 12 3  4 5-6--7 0000000000000",
    "+1 (988) 555-2485 +12 +1 2 ++49 30 1234567 +1().-.5 +123456789012345678",
    "é\U0001f600日 a@b.co ß 10.0.0.1 \U0001f600 +44 20 7946 0958",
    "1" * 5000 + " " + "a" * 5000 + " " + "+1" * 500,
    " ".join(f"u{i}@h{i}.org {i}.1.2.3" for i in range(700)),
    "",
    None,
]


def test_base_spans_match_the_plain_patterns(spark):
    rows = pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string"))).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        want = brute(CASES[r.doc_id])
        assert base_of(r) == ",".join(x[2] for x in want)
        assert r.base_sha256 == hashlib.sha256(base_of(r).encode()).hexdigest()
        for k in BASE:
            assert r[f"n_{k}"] == sum(x[3] == k for x in want)


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.digest(pii.find_pii(docs)).collect():
        assert base_of(r) == ",".join(x[2] for x in brute(texts[r.doc_id]))


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("pay to IBAN DE89 3704 0044 0532 0130 00 now", ["iban"]),
        ("pay to IBAN DE88 3704 0044 0532 0130 00 now", []),
        ("code GB82WEST12345698765432", ["iban"]),
        ("my SSN is 123-45-6789", ["ssn"]),
        ("part no 123-45-6789", []),
        ("SSN 000-45-6789", []),
        ("call 555-123-4567 today", ["local_phone"]),
        ("order 555-123-4567", []),
    ],
)
def test_checksums_and_context_decide(spark, text, kinds):
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.kind for s in row.pii if s.kind in {"iban", "ssn", "local_phone"}] == kinds


def test_context_moves_the_score(spark):
    rows = spark.createDataFrame([(1, "card 4111 1111 1111 1111"), (2, "isbn 4111 1111 1111 1111")], "doc_id long, text string")
    scores = {r.doc_id: r.pii[0].score for r in pii.find_pii(rows).collect()}
    assert scores[1] > scores[2]


def test_redaction(spark):
    out = pii.redact(spark.createDataFrame([(1, "a@b.co and 1.2.3.4 or 300.2.3.4"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["<email> and <ip> or 300.2.3.4", None]


def test_edges(edge_docs, no_docs):
    assert pii.digest(pii.find_pii(edge_docs)).count() == edge_docs.count()
    assert pii.digest(pii.find_pii(no_docs)).count() == 0
    clash = edge_docs.withColumn("pii", F.lit("x"))
    assert pii.digest(pii.find_pii(clash)).count() == edge_docs.count()
    shown = pii.redact(clash)
    assert shown.columns == clash.columns and sorted(shown.collect(), key=str) == sorted(clash.collect(), key=str)
    assert pii.redact(no_docs).count() == 0


def test_no_python_in_the_plan(edge_docs):
    plan = pii.digest(pii.find_pii(edge_docs))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert F is not None
