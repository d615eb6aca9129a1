"""The stages of the pipeline, each against a plain form of itself on the rows it was given."""

import corpus_pipeline
import numpy as np
import pytest
from stratiform.llm import quality
from xxhash import xxh64_intdigest

from test_decontam import brute as brute_overlaps
from test_lines import brute as brute_lines
from test_packing import check_layout

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def varied(words, k):
    out = list(words)
    for i in range(k, len(out), 60):
        out[i] = f"other{k}"
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents of the small table with copies, near copies, benchmark passages, nulls and repeated ids."""
    at = tmp_path_factory.mktemp("sf")
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000").orderBy("doc_id").limit(70).collect()]
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    body = next(d[1] for d in docs if len(d[1].split()) > 200 and quality.Bands().verdict(d[1].encode())[2])
    extra = [body, " ".join(varied(body.split(), 7)), " ".join(varied(body.split(), 11)), docs[3][1] + " " + bench[2][1], None, "", "short", "same words " * 300]
    docs += [(1000 + i, t, "en", "s", len(t or "")) for i, t in enumerate(extra)] + [(1001, extra[1], "en", "s", 1), (None, docs[5][1] + " end", "en", "s", 1)]
    spark.createDataFrame(docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before each stage, and after the last."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [df.collect()]
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, df, sf_dir)
        at = f"{sf_dir}/{name}"
        done.write.parquet(at)
        df = spark.read.parquet(at)
        assert name == "packing" or df.columns == COLUMNS
        out.append(df.collect())
    return out


def same(a, b):
    return sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)


def test_quality(stages):
    bands = quality.Bands()
    want = [r for r in stages[0] if not quality.base_measures(r.text or "")[-1] and bands.verdict((r.text or "").encode())[2]]
    assert same(stages[1], want) and len(want) < len(stages[0])


def test_line_dedup(stages):
    def ident(r):
        """Rows of one id are one document; rows without an id are told apart by text."""
        return r.doc_id if r.doc_id is not None else int(np.uint64(xxh64_intdigest(r.text.encode(), 42)).astype(np.int64))

    before, after = stages[1], stages[2]
    want = brute_lines(sorted({(ident(r), r.text) for r in before}))
    changed = {i for i, t in {(ident(r), r.text) for r in before} if want[i] != t}
    assert changed
    others = lambda r: (r.lang, r.source, r.n_chars)
    assert same([(r.doc_id, want[ident(r)], *others(r)) for r in before], after)


def shingles(text):
    """Five-word shingles of a text, the whole of a shorter one."""
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_dedup(stages):
    """All pairs by the exact similarity of their shingle sets."""
    rows = stages[2]
    sets = [shingles(r.text) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    best = {}
    for r, g in zip(rows, label):
        key = (r.doc_id is None, r.doc_id or 0)
        best[g] = min(best.get(g, key), key)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in stages[3]) == sorted(best.values())
    assert len(best) < len(rows)


def test_decontamination(spark, stages, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {d for d, _ in brute_overlaps([(r.doc_id, r.text) for r in stages[3]], items)}
    assert same(stages[4], [r for r in stages[3] if r.doc_id not in hit])


def test_packing(stages):
    check_layout(stages[5], {r.doc_id: r.text for r in stages[4]}, 2048, 0)


def test_run_is_the_stages_in_order(spark, stages, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in rows) == sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in stages[5])
