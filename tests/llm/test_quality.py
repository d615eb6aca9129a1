import base64
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratiform.llm import quality


def brute(text):
    text = text or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    lines = text.split("\n")
    seen, dup = set(), 0
    for x in lines:
        if any(c not in " \t\n\v\f\r" for c in x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_base_measures_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.digest(quality.measure(docs.select("doc_id", "text"))).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize("text", ["a b " * 50, "x " * 9, "a b c d e f g h a b c d e f g h", "", None, "l\nl\n \n \nm\nl", "１ ２ 　 ３\x85\x1c w " * 9])
def test_base_measures(text):
    assert quality.base_measures(text or "") == brute(text)


def test_bands():
    rng = random.Random(2)
    bands, syll = quality.Bands(), ["ta", "ri", "mon", "el", "sto", "qua", "in", "der", "pla", "os"]
    prose = " ".join("".join(rng.choice(syll) for _ in range(rng.randint(1, 4))) for _ in range(4000))
    assert bands.verdict(prose.encode())[2]
    assert bands.verdict(prose[:300].encode())[2] and bands.verdict(prose[:90].encode())[2]
    assert not bands.verdict(b"again and again " * 3000)[2]
    noise = base64.b64encode(rng.randbytes(30_000)) 
    assert not bands.verdict(noise)[2]
    assert not bands.verdict(prose.encode() + noise)[2]
    assert not bands.verdict(prose.encode() + b"0" * 30_000)[2]


def test_clean_texts_stay(spark):
    rows = quality.digest(quality.measure(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))).collect()
    plain = [r for r in rows if not r.base_failed and r.n_symbols == 0 and r.n_repeat_words == 0 and r.n_dup_lines == 0]
    assert sum(not r.kept for r in plain) <= 0.01 * len(plain)


def test_edges(edge_docs, no_docs):
    rows = quality.digest(quality.measure(edge_docs.select("doc_id", "text"))).collect()
    assert len(rows) == 8 and not any(r.kept for r in rows)
    fine = edge_docs.limit(1).withColumn("text", F.lit("every word of this sentence differs from any other, so twenty of them in a row give the rules nothing to hold against"))
    kept = quality.keep_good(edge_docs.unionByName(fine).unionByName(fine))
    assert kept.columns == edge_docs.columns and kept.count() == 2
    assert quality.keep_good(no_docs).count() == 0
    clash = edge_docs.select("doc_id", "text", F.lit(1).alias("quality"))
    assert len(quality.digest(quality.measure(clash)).collect()) == 8
    assert quality.keep_good(clash.unionByName(fine.select("doc_id", "text", F.lit(1).alias("quality")))).first().quality == 1


def test_chunks_of_short_texts(spark):
    """From 2 KB on, junk among prose is found by chunks; below, only the whole text's ratio speaks."""
    bands, rng = quality.Bands(), random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 4500").orderBy("doc_id").limit(60).collect()
    good = [t for r in docs if bands.verdict(t := r.text.encode()[:4096])[2]]
    junk = lambda n: base64.b64encode(rng.randbytes(n))[:n]
    assert len(good) > 30
    assert not any(bands.verdict(t + junk(3072))[2] for t in good)
    assert not any(bands.verdict(t[:2048] + junk(2048) + t[2048:])[2] for t in good)
    assert not any(bands.verdict(t + b"0" * 3072)[2] for t in good)
    assert all(bands.verdict(t[:n])[2] for t in good for n in (2047, 2048, 3000, 4096))
    least = 2 * quality.SMALL_BYTES
    half = junk(least)
    assert bands.odd_chunk_share(half[: least - 1]) == 0.0 and bands.odd_chunk_share(half) == 1.0
    assert bands.odd_chunk_share(junk(2 * quality.CHUNK_BYTES - 1)) == 1.0
