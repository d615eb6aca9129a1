"""Worked cases of single operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.functions import text as T
from stratiform.operators import bank, budget, cells, chunks, hierarchy, mass, membership, mixture, records, scoring, selection
from stratiform.sources import readers, scratch, sinks
from stratiform.streaming import admission


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edges(spark, weights):
    return frame(spark, [("x", f"c{i}", w) for i, w in enumerate(weights)], "item_id string, community_id string, w double")


def as_map(df):
    return {r.community_id: round(r.w, 6) for r in df.collect()}


# ---- memberships and masses --------------------------------------------------------------------


def test_argmax(spark):
    assert as_map(membership.argmax_members(edges(spark, [0.6, 0.4]))) == {"c0": 1.0}


@pytest.mark.parametrize(
    "weights, gap, want",
    [
        ([0.6, 0.4], 0.25, {"c0": 0.6, "c1": 0.4}),
        ([0.95, 0.05], 1.0, {"c0": 0.95, "c1": 0.05}),
        ([0.5, 0.45, 0.05], 1.0, {"c0": 0.5, "c1": 0.45}),
        ([0.9, 0.1], 0.25, {"c0": 0.9}),
        ([0.5, 0.5], 0.0, {"c0": 0.5, "c1": 0.5}),
    ],
)
def test_cumulative(spark, weights, gap, want):
    assert as_map(membership.cumulative_members(edges(spark, weights), gap, 0.90)) == want


def test_token_cost_ignores_weights(spark):
    items = frame(spark, [("a", 100), ("b", 200)], "item_id string, tokens long")
    e = frame(spark, [("a", "c", 0.01), ("b", "c", 0.02), ("b", "c", 0.5)], "item_id string, community_id string, w double")
    assert mass.token_costs(items, e).first().token_cost == 300


def test_mass_follows_confidence(spark):
    c = frame(spark, [("c", 2.0)], "community_id string, support_mass double")
    cards = frame(spark, [("k0", "c", 0.5), ("k1", "c", 0.2), ("k2", "c", 0.5)], "item_id string, source_community_id string, confidence double")
    got = {r.item_id: r.support_mass for r in mass.redistribute(c, cards).collect()}
    assert got == pytest.approx({"k0": 2 * 0.5 / 1.2, "k1": 2 * 0.2 / 1.2, "k2": 2 * 0.5 / 1.2})


def test_one_bad_mass_makes_all_weights_one(spark):
    schema = "item_id string, support_mass double"
    assert {r.w for r in mass.sample_weights(frame(spark, [("a", 1.0), ("b", -1.0)], schema)).collect()} == {1.0}
    assert {r.item_id: r.w for r in mass.sample_weights(frame(spark, [("a", 1.0), ("b", 3.0)], schema)).collect()} == {"a": 0.5, "b": 1.5}


# ---- budgets -----------------------------------------------------------------------------------


def test_first_fit_packs():
    assert budget.first_fit([30, 20, 20, 10], 50) == [0, 0, 1, 1]
    assert budget.first_fit([60, 40, 40], 50) == [-1, 0, 1]
    assert budget.first_fit([10], 5) == [-1]
    assert budget.first_fit([], 5) == []


def test_first_fit_equals_the_plain_loop():
    rng = np.random.default_rng(5)
    for _ in range(40):
        costs, rooms, want = rng.integers(1, 60, rng.integers(1, 80)).tolist(), [], {}
        for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
            at = next((k for k, r in enumerate(rooms) if r >= costs[i]), None)
            if costs[i] > 50:
                want[i] = -1
                continue
            if at is None:
                at = len(rooms)
                rooms.append(50)
            rooms[at] -= costs[i]
            want[i] = at
        assert budget.first_fit(costs, 50) == [want[i] for i in range(len(costs))]


@pytest.mark.parametrize("n, want", [(8000, 1), (8001, 2), (15000, 2), (15001, 3), (20000, 3), (0, 1)])
def test_windows(spark, n, want):
    docs = frame(spark, [(1, "w " * n)], "k long, t string")
    got = chunks.windows(docs, "k", "t", 8000, 1000).select("chunk", "first", "last").collect()
    assert len(got) == want and max(r.last for r in got) == n


# ---- choosing K, fits --------------------------------------------------------------------------


def two_blobs(spark):
    rows = [(f"i{k}", v, 1.0) for k, v in enumerate([[1.0, 0.0], [0.98, 0.02], [-1.0, 0.0], [-0.98, -0.02]])]
    return frame(spark, rows, "item_id string, vec array<double>, w double")


def test_elbow_on_two_blobs(spark):
    rows = two_blobs(spark)
    fits = [(1, k, mixture.kmeans(rows, k, mixture.MixtureConfig(restarts=3), 1).bic) for k in (1, 2, 3, 4)]
    assert selection.choose_elbow(frame(spark, fits, "g int, k int, score double"), "g").first().k == 2


def test_mixture_finds_planted_groups(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[5.0, 0, 0], [0, 5.0, 0], [0, 0, 5.0]])
    x = np.concatenate([c + 0.3 * rng.standard_normal((60, 3)) for c in centres])
    rows = frame(spark, [(f"i{k:03d}", v.tolist(), 1.0) for k, v in enumerate(x)], "item_id string, vec array<double>, w double")
    best, margin = mixture.choose(mixture.fit_mixtures(rows, [1, 2, 3, 4, 5], mixture.MixtureConfig(restarts=2), 7))
    assert best.k == 3 and margin > 0
    assert sorted(np.round(best.means.max(axis=1)).tolist()) == [5, 5, 5]
    again, _ = mixture.choose(mixture.fit_mixtures(rows.orderBy(F.desc("item_id")), [1, 2, 3, 4, 5], mixture.MixtureConfig(restarts=2), 7))
    assert np.allclose(np.sort(again.means, axis=0), np.sort(best.means, axis=0), atol=1e-9)


def test_pca_equals_an_svd(spark):
    x = np.random.default_rng(3).standard_normal((80, 6)) * [9, 5, 3, 1, 0.5, 0.1]
    rows = frame(spark, [(f"i{k}", v.tolist(), 1.0) for k, v in enumerate(x)], "item_id string, vec array<double>, w double")
    b = mixture.pca(rows, 0.9)
    _, s, v = np.linalg.svd(x - x.mean(axis=0))
    n = len(b.rows)
    assert n == 2 and np.allclose(b.ratios, (s**2 / (s**2).sum())[:n])
    assert np.allclose(np.abs(np.array(b.rows) @ v[:n].T), np.eye(n), atol=1e-8)


def test_two_items_do_not_split(spark):
    items = frame(spark, [("a", [1.0, 0.0], 1.0, 5), ("b", [0.0, 1.0], 1.0, 5)], "item_id string, vec array<double>, support_mass double, tokens long")
    cfg = hierarchy.TreeConfig(mixture=mixture.MixtureConfig(min_effective=2.0))
    assert hierarchy.build_layer(items, 0, cfg, lambda t, _: scratch.kept(t)).stop_reason == "bic_selected_one"
    assert hierarchy.build_layer(items.limit(0), 0, cfg, lambda t, _: scratch.kept(t)).stop_reason == "empty_layer"


# ---- admission ---------------------------------------------------------------------------------


def level(loads):
    return admission.LevelState(["C1", "C2"], np.array([0.5, 0.5]), np.eye(2), np.ones((2, 2)), np.ones(2), np.array(loads))


@pytest.mark.parametrize("loads, selected", [((45, 20), {"C2": 0.5}), ((20, 20), {"C1": 0.5, "C2": 0.5})])
def test_admission_by_budget(loads, selected):
    s = level(loads)
    got = admission.admit(s, "x", np.array([0.5, 0.5]), 10, 50)
    assert got["selected"] == pytest.approx(selected) and got["posterior"] == pytest.approx({"C1": 0.5, "C2": 0.5})
    assert s.counts.tolist() == pytest.approx([1.5, 1.5])


def test_admission_grows_a_component():
    s = level((45, 45))
    got = admission.admit(s, "x", np.array([0.5, 0.5]), 10, 50)
    (name, w), = got["selected"].items()
    assert name.startswith("L0_DYN_") and w == 1.0 and len(s.names) == 3 and s.pi.sum() == pytest.approx(1)


def test_admission_turns_oversize_away():
    s = level((20, 20))
    assert admission.admit(s, "x", np.array([0.5, 0.5]), 51, 50)["status"] == "excluded_oversize" and s.counts.tolist() == [1, 1]


def test_readmission_replaces_what_an_item_gave():
    s, t = level((0, 0)), level((0, 0))
    admission.contribute(s, "x", np.array([3.0, 1.0]), np.array([0.2, 0.8]))
    admission.contribute(s, "x", np.array([0.5, 0.5]), np.array([0.5, 0.5]))
    admission.contribute(t, "x", np.array([0.5, 0.5]), np.array([0.5, 0.5]))
    assert np.allclose(s.means, t.means) and np.allclose(s.counts, t.counts) and np.allclose(s.variances, t.variances)


def test_stream_of_arrivals(spark, tmp_path):
    rows = [(f"a{i}", [0.5, 0.5], 51 if i == 7 else 1, i) for i in range(20)]
    frame(spark, rows, "item_id string, vec array<double>, tokens long, pos long").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item_id string, vec array<double>, tokens long, pos long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    admission.run_stream(stream, level((0, 0)), 50, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = admission.accounting(admission.admitted(spark, str(tmp_path / "out"))).first()
    assert (got.arrivals, got.updated, got.excluded) == (20, 19, 1)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 1000])
def test_micro_batches(spark, n):
    got = admission.micro_batches(spark.range(n).withColumnRenamed("id", "event_id").repartition(5), "event_id", 8).collect()
    assert sorted((r.event_id, r.batch) for r in got) == [(i, i // 8) for i in range(n)]


# ---- bank --------------------------------------------------------------------------------------


def test_levels_of_the_bank(spark):
    items = frame(spark, [(f"l{i}", "experience_card", i, []) for i in (1, 2, 3)] + [("x", "experience_card", 1, ["oversize"]), ("t", "trajectory", 1, None)], "id string, kind string, level int, skip_flags array<string>")
    assert [r.id for r in bank.exportable(items, 1, 1).collect()] == ["l1"]
    assert sorted(r.id for r in bank.exportable(items, 2).collect()) == ["l2", "l3"]


def test_dense_search_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(bank, "BLOCK_VECTORS", 7)
    x = np.random.default_rng(1).standard_normal((90, 8))
    x[5] = 0
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)
    got = bank.dense_top_k(rows.where("id % 10 = 0").withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "node_id"), 5).collect()
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for q in range(0, 90, 10):
        want = sorted(range(90), key=lambda j: (-float(u[q] @ u[j]), j))[:5]
        assert [r.node_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_leaks_are_found_and_taken_out(spark):
    texts = frame(spark, [(1, "The answer is Blue Whale."), (2, "value 999, then 1999 and 9.99"), (3, "bluewhale"), (4, "nothing"), (5, None)], "id long, text string")
    terms = frame(spark, [("blue whale",), ("999",), ("abc",), (None,)], "term string")
    got = {(r.id, r.term_class) for r in bank.audit(texts, terms, "id").collect()}
    assert got == {(1, "text"), (2, "numeric_like")}
    clean = bank.sanitised(texts, terms, "id")
    assert bank.audit(clean, terms, "id").count() == 0
    assert {r.id: r.text for r in clean.collect()}[2] == "value <train_diagnostic_value>, then 1999 and 9.99"


# ---- answers, cells, files, results ------------------------------------------------------------


def test_answers(spark):
    cases = ["<think>x <answer>1</answer></think><answer>2,602</answer>", "<answer>a</answer> b <answer> c </answer>", "FINAL_ANSWER: 7", None]
    df = frame(spark, [(c,) for c in cases], "t string").select(T.answer(F.col("t")).alias("a"), T.audit_answer(F.col("t")).alias("b"))
    assert [r.a for r in df.collect()] == ["2,602", "c", "", ""]
    assert [r.b for r in df.collect()][:3] == ["2,602", "c", "7"]
    pair = frame(spark, [("2,602 million dollars", "2602")], "p string, g string")
    assert pair.select(T.exact_match(F.col("p"), F.col("g")).alias("x")).first().x == 1.0


def test_cells(spark):
    got = frame(spark, [("B2:C3",), ("$A$1",), ("Z9:AA9",), ("ZZ1:AAA1",)], "s string").select(cells.range_cells(F.col("s")).alias("c"))
    assert [r.c for r in got.collect()] == [["B2", "B3", "C2", "C3"], ["A1"], ["Z9", "AA9"], ["ZZ1", "AAA1"]]
    pairs = [("1.004", "1", True), ("a", "a", True), ("1", "x", False), (None, "", True), ("1.01", "1", False)]
    same = frame(spark, [p[:2] for p in pairs], "a string, b string").select(cells.same_value(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in same.collect()] == [p[2] for p in pairs]


def test_files_by_path_or_unique_name(spark):
    paths = frame(spark, [("a/x.txt",), ("b/x.txt",), ("b/y.txt",)], "path string")
    got = {r.file: r.path for r in records.resolve_files(frame(spark, [("x.txt",), ("a/x.txt",), ("y.txt",), ("z.txt",)], "file string"), paths).collect()}
    assert got == {"x.txt": None, "a/x.txt": "a/x.txt", "y.txt": "b/y.txt", "z.txt": None}


def test_malformed_documents_give_no_rows(spark):
    good = json.dumps({"document": {"elements": [{"content": "one", "bbox": [{"page_id": 1}]}, {"content": "two", "bbox": [{"page_id": 1}, {"page_id": 2}]}]}})
    e = readers.document_elements(frame(spark, [("g", good), ("b", "{not json"), ("n", None)], "path string, json string"))
    assert {(r.path, r.page_id): r.text for r in readers.page_text(e).collect()} == {("g", 1): "one\n\ntwo", ("g", 2): "two"}


def test_chat_logs_round_trip(spark, tmp_path):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "line\n\nline"), (2, 0, "user", "x")]
    logs = sinks.chat_log(frame(spark, rows, "conv_id long, turn int, role string, text string"))
    back = readers.markdown_messages(logs.select(F.col("conv_id").cast("string").alias("path"), F.col("log").alias("text")))
    assert sorted((int(r.path), r.turn, r.role, r.text) for r in back.collect()) == rows


def test_jsonl_shapes(spark):
    lines = ['{"role":"user","content":"a"}', '{"message":{"role":"assistant","content":"b"}}', '{"type":"m","data":{"role":"user","content":"c"}}', "broken", '{"role":"user"}']
    got = readers.jsonl_messages(frame(spark, [("f", i, x) for i, x in enumerate(lines)], "path string, line int, value string"))
    assert [(r.role, r.text) for r in got.orderBy("line").collect()] == [("user", "a"), ("assistant", "b"), ("user", "c")]


def test_banks_round_trip(spark, tmp_path):
    at = f"file://{tmp_path}/bank"
    nodes = frame(spark, [("n", "a", "b", "c", 2, 1.5, 0.25), ("m", "a", "b", None, 1, 1.0, 1.0)], "node_id string, name string, trigger string, content string, level int, support_mass double, confidence double")
    assert sinks.write_bank(nodes, at) == 2
    (got,) = readers.read_bank(spark, at).collect()
    assert (got.node_id, got.item_id, got.name, got.level, got.support_mass, got.confidence) == ("n", "n", "a", 2, 1.5, 0.25)
    assert got.embedding_text == "name: a\ntrigger: b\ncontent: c"
    with pytest.raises(ValueError, match="needs a reason"):
        sinks.write_bank(nodes.limit(0), f"{at}0")
    assert sinks.write_bank(nodes.limit(0), f"{at}1", reason_if_empty="nothing split") == 0
    assert readers.read_bank(spark, f"{at}1", empty_ok=True).count() == 0
    with pytest.raises(ValueError, match="no node"):
        readers.read_bank(spark, f"{at}1")


def test_banks_of_one_file(spark, tmp_path):
    bank_json = {"format": readers.BANK_FORMAT, "nodes": [{"node_id": "n", "name": "a", "trigger": "b", "content": "c"}, {"node_id": "m", "name": "a"}]}
    (tmp_path / "bank.json").write_text(json.dumps(bank_json))
    assert [r.node_id for r in readers.read_bank(spark, str(tmp_path / "bank.json")).collect()] == ["n"]
    (tmp_path / "other.json").write_text(json.dumps({"format": "x", "nodes": [{"node_id": "n", "trigger": "b", "content": "c"}]}))
    with pytest.raises(Exception, match="another format"):
        readers.read_bank(spark, str(tmp_path / "other.json"))


def test_usage(spark):
    schema = "malformed boolean, cache_hit boolean, has_usage boolean, prompt_tokens long, completion_tokens long, total_tokens long, input_tokens long, output_tokens long"
    log = frame(spark, [(False, False, True, 100, 25, 125, 0, 0), (False, False, False, None, None, None, None, None), (False, True, True, 7, 7, 14, 0, 0)], schema)
    r = scoring.usage_rollup(log).first()
    assert (r.prompt_tokens, r.completion_tokens, r.provider_usage_status, r.call_source_status) == (100, 25, "partial", "mixed_cached_partial")
    assert scoring.usage_simple(log).first().prompt_tokens == 107
    assert scoring.prompt_stats(frame(spark, [(84,), (10,)], "tokens long"), 85).first().near_limit == 1


def test_reachable_in_a_dag(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")], "parent string, child string")
    got = {(r.root, r.node) for r in hierarchy.reachable(e, frame(spark, [("a",), ("d",)], "node string")).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "c")}
