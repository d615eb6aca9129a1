"""Rows that used to be lost or taken for others: missing ids, namespaces, unknown fields, folding, nested braces, spans."""

import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from stratiform.functions import payload
from stratiform.functions import text as T
from stratiform.operators import bank, documents, records
from stratiform.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_rows_without_an_id_are_searched_and_masked(spark):
    texts = frame(spark, [(None, "secret answer alpha"), (None, "nothing here"), (1, "a Secret answer ALPHA."), (1, "a Secret answer ALPHA."), (2, "secret answer")], "id long, text string")
    terms = frame(spark, [("secret answer alpha",), ("nothing",), ("of",), (None,)], "term string")
    got = sorted((r.id is None, r.text) for r in bank.sanitised(texts, terms, "id", by="#").collect())
    assert got == [(False, "a #."), (False, "a #."), (False, "secret answer"), (True, "#"), (True, "# here")]
    assert sorted((r.id or 0, r.term_class) for r in bank.audit(texts, terms, "id").collect()) == [(0, "text"), (0, "text"), (1, "text")]
    assert bank.sanitised(texts, terms.limit(0), "id").count() == 5


def test_audit_and_sanitiser_fold_alike(spark):
    texts = frame(spark, [(1, "the İSTANBUL file"), (2, "istanbul FILE"), (3, "ΟΔΟΣ alpha"), (4, "straße 12x")], "id long, text string")
    terms = frame(spark, [("İstanbul file",), ("οδος ALPHA",), ("STRAßE 12x",)], "term string")
    assert sorted(r.id for r in bank.audit(texts, terms, "id").collect()) == [1, 2, 3, 4]
    assert [r.text for r in bank.sanitised(texts, terms, "id", by="#").orderBy("id").collect()] == ["the #", "#", "#", "#"]


@pytest.mark.parametrize("n_terms", [40_000])
def test_many_long_terms(spark, n_terms):
    terms = spark.range(n_terms).select(F.concat(F.lit("lead "), F.col("id").cast("string"), F.lit(" of "), F.repeat(F.lit("long words "), 40), F.lit("end")).alias("term"))
    texts = terms.limit(50).select(F.monotonically_increasing_id().alias("id"), F.concat(F.lit("so: "), "term", F.lit("!")).alias("text"))
    assert {r.text for r in bank.sanitised(texts, terms, "id", by="#").collect()} == {"so: #!"}


def test_the_cache_keeps_namespaces_apart(spark):
    wanted = frame(spark, [("m1", "a"), ("m2", "a"), (None, "a"), ("m1", "b"), ("m1", "b")], "namespace string, text string")
    have = frame(spark, [("m1", "a")], "namespace string, t string").select("namespace", F.sha2("t", 256).alias("key"))
    assert sorted((r.namespace or "", r.text) for r in records.cache_misses(wanted, have).collect()) == [("", "a"), ("m1", "b"), ("m2", "a")]


def test_first_distinct_keeps_texts_without_an_order(spark):
    items = frame(spark, [(None, "x"), (None, "Y"), (None, "y "), (3, "z"), (2, " Z"), (None, "z"), (1, None)], "n long, text string")
    assert sorted((r.n or 0, r.text or "") for r in records.first_distinct(items, "n").collect()) == [(0, "Y"), (0, "x"), (1, ""), (2, " Z")]


@pytest.mark.parametrize("lines", [True, False])
def test_unknown_fields_are_refused(spark, tmp_path, lines):
    good = {"trajectory_id": "a", "success": True, "steps": [{"step_id": 1, "action": "x"}]}
    write = lambda name, *rows: (tmp_path / name).write_text("\n".join(map(json.dumps, rows)) if lines else json.dumps(list(rows)))
    write("good.json", good, {"trajectory_id": "b"})
    assert sorted(r.trajectory_id for r in readers.read_records(spark, f"file://{tmp_path}/good.json", lines).collect()) == ["a", "b"]
    for name, bad in {"top.json": good | {"bogus": 1}, "step.json": good | {"steps": [{"bogus": 1}]}, "type.json": good | {"success": "maybe"}}.items():
        write(name, bad)
        with pytest.raises(Exception, match="unknown fields|MALFORMED|FAILFAST|PARSING"):
            readers.read_records(spark, f"file://{tmp_path}/{name}", lines).collect()


def test_folding_is_that_of_unicode(spark):
    points = spark.range(sys.maxunicode + 1).where("id NOT BETWEEN 55296 AND 57343").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    got = {r.c: r.f for r in points.select("c", T.case_folded(F.col("c")).alias("f")).where("c <> f").collect()}
    assert got == {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) <= 0xDFFF and c != c.casefold()}
    key = frame(spark, [("  Σίσυφος \n ﬁle",)], "t string").select(T.text_key(F.col("t")).alias("k")).first().k
    assert key == "σίσυφοσ file"


def test_simple_folding_takes_as_equal_what_patterns_do(spark):
    old, new = T._simple_folds()
    fold = dict(zip(old, new))
    char = spark.sparkContext._jvm.java.lang.Character
    cased = [c for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) <= 0xDFFF and (c.upper() != c or c.lower() != c)]
    of_patterns = {c: chr(char.toLowerCase(char.toUpperCase(ord(c)))) for c in cased}
    assert [c for c, j in of_patterns.items() if fold.get(c, c) != fold.get(j, j)] == []


def plainly_balanced(text):
    for start in (i for i, c in enumerate(text) if c == "{"):
        depth, quoted, skip = 0, False, False
        for i, c in enumerate(text[start:], start):
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            else:
                depth += (c == "{") - (c == "}")
                if c == "}" and not depth:
                    return text[start : i + 1]
    return None


def test_first_balanced_braces():
    draw = random.Random(5)
    for _ in range(20_000):
        text = "".join(draw.choices('{}{}"\\a', k=draw.randrange(18)))
        assert payload._first_balanced(text) == plainly_balanced(text), text


@pytest.mark.parametrize("unit", ["{", '{"', '{\\"', '{"a":', "[", '"}'])
def test_recovery_is_linear(unit):
    assert payload.recovered("so " + unit * (1_000_000 // len(unit))) is None


def test_replies():
    assert payload.recovered('see\n```json\n{"a": "}"}\n```\nend') == '{"a": "}"}'
    assert payload.recovered('it said "{" and then {"a": {"b": 1}} and {"c": 2}') == '{"a": {"b": 1}}'
    assert payload.recovered("{not json} {}") is None
    assert payload.strict('```\n{"a": 1}\n```') == '{"a": 1}'
    assert payload.strict('so {"a": 1}') is None


def test_table_spans():
    html = "<table><!-- <tr><td>no</td></tr> --><TR><th rowspan=2>A</th><th colspan='2'>B</th></TR><tr><td>c|d</td><td>e<br>f &amp; <b>g</b></td></tr><tr><td> </td></tr><tr><td rowspan=9>h</td></tr></table>"
    assert documents.table_as_markdown(html).split("\n") == ["| A | B | B |", "| --- | --- | --- |", "| A | c\\|d | e f & g |", "| h |  |  |"]
    assert documents.table_as_markdown("<tr><td colspan=999999999>x</td></tr>").count("x") == documents.MOST_COLUMNS
