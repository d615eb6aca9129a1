"""Worked cases of operators that SQL does not reach: cells, tables, replies, streams, refusals."""

import datetime
import hashlib
import json
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from stratiform.functions import payload
from stratiform.operators import bank, budget, cells, documents, hierarchy, mixture, protocol, refinement, selection, views
from stratiform.operators import state as S
from stratiform.sources import readers
from stratiform.streaming import admission, propagation


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- cells -------------------------------------------------------------------------------------


def plain(v):
    """The rule on Python values: two places for numbers and texts of numbers, whole days, short times."""
    if isinstance(v, (int, float)):
        return round(float(v), 2)
    if isinstance(v, datetime.time):
        return str(v)[:-3]
    if isinstance(v, datetime.datetime):
        d = v - datetime.datetime(1899, 12, 30)
        return round(d.days + d.seconds / 86400.0, 0)
    if isinstance(v, str):
        try:
            return round(float(v), 2)
        except ValueError:
            return v
    return v


def plain_same(a, b):
    a, b = plain(a), plain(b)
    empty = lambda v: v is None or v == ""
    return True if empty(a) and empty(b) else type(a) is type(b) and a == b


def as_cell(v):
    kinds = {bool: "boolean", int: "number", float: "number", str: "text", datetime.time: "time", datetime.datetime: "datetime", type(None): None}
    kind = kinds[type(v)]
    return (kind, None if v is None else str(v) if kind != "number" else repr(v))


VALUES = [None, "", 0, 1, -1, 1.004, 1.006, 1.005, 2.675, 0.125, 0.375, 1.0049, 0.9951, 0.996, -0.004, -2.675, 1e15, 7.1e13, 123456789.125, 0.1, 0.10499999999999998, float("inf"), float("nan"), "1.004", " 1.00 ", "1_0", "10", "1d", "1e1", "inf", "nan", "abc", "ABC", "0x10", "1,5", True, False,
          "08:15", datetime.time(8, 15), datetime.time(8, 15, 30), datetime.datetime(2024, 3, 1), datetime.datetime(2024, 3, 1, 12), datetime.datetime(2024, 3, 2, 12), datetime.datetime(2024, 3, 1, 18, 30), 45352, "45352", 45353, 45354]


def test_cells_compare_as_their_values(spark):
    rows = [(i, j, as_cell(a), as_cell(b)) for i, a in enumerate(VALUES) for j, b in enumerate(VALUES)]
    df = frame(spark, rows, f"i int, j int, a {cells.CELL}, b {cells.CELL}")
    got = {(r.i, r.j): r.s for r in df.select("i", "j", cells.same_cell(F.col("a"), F.col("b")).alias("s")).collect()}
    wrong = [(VALUES[i], VALUES[j], s) for (i, j), s in got.items() if s != plain_same(VALUES[i], VALUES[j])]
    assert wrong == []


def test_cents_are_those_of_exact_rounding(spark):
    rng = random.Random(1)
    some = [rng.choice([rng.uniform(-100, 100), rng.randint(-10**6, 10**6) / 1000, rng.randint(-10**6, 10**6) / 8, rng.uniform(-1e14, 1e14), rng.randint(-10**9, 10**9) / 200]) for _ in range(20000)]
    df = frame(spark, [(x,) for x in some], "x double")
    for r in df.select("x", cells.rounded_to_cents(F.col("x")).alias("y")).collect():
        assert r.y == round(r.x, 2), r.x


# ---- tables and replies ------------------------------------------------------------------------


def test_spans_of_a_table():
    html = '<table><tr><th rowspan="2">Fiscal year</th><th colspan="2">Debt</th></tr><tr><td>Gross</td><td>Net</td></tr><tr><td>1969</td><td>1|2<br>3</td></tr></table>'
    assert documents.table_as_markdown(html).split("\n") == ["| Fiscal year | Debt | Debt |", "| --- | --- | --- |", "| Fiscal year | Gross | Net |", "| 1969 | 1\\|2 3 |  |"]
    assert documents.table_as_markdown("<p>a &lt; b</p>\n c") == "a < b c"
    assert documents.table_as_markdown('<tr><td rowspan="x" colspan="-2">v</td></tr>') == "| v |\n| --- |"
    assert documents.table_as_markdown('<tr><td>a<td>b</td></tr>') == "| b |\n| --- |"


def test_objects_in_replies(spark):
    cases = {
        '{"a": 1}': '{"a": 1}',
        "x ```json\n{\"a\": 2}\n```": None,
        "x\n```json\n{\"a\": 2}\n```": '{"a": 2}',
        'say {"a": "}{"} end': '{"a": "}{"}',
        '{bad} {"a": 3}': None,
        "[1, 2]": None,
        '<think>{"a": 1}</think>{"a": 4}': '{"a": 4}',
        '{"a": {"b": 5}} trailing': '{"a": {"b": 5}}',
        "": None,
    }
    cases["x ```json\n{\"a\": 2}\n```"] = '{"a": 2}'  # the fence is not at a line's start, the braces are balanced
    df = frame(spark, [(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.o for r in df.select("t", payload.json_object(F.col("t")).alias("o")).collect()}
    assert got == cases | {None: None}


def test_payloads_of_a_wrong_shape_fail(spark):
    for bad in ('{"cards": 5}', '{"cards": [1]}'):
        with pytest.raises(Exception, match="cards"):
            frame(spark, [(bad,)], "t string").select(payload.cards_payload(F.col("t"))).collect()
    with pytest.raises(Exception, match="item_id"):
        frame(spark, [('{"new_cards": [{"item_id": "x"}]}',)], "t string").select(payload.patch_payload(F.col("t"))).collect()
    with pytest.raises(Exception, match="unexpected fields: new_cards"):
        frame(spark, [('{"updates": [], "new_cards": []}',)], "t string").select(payload.updates_only(F.col("t"))).collect()
    assert frame(spark, [('{"updates": [{}]}',)], "t string").select(F.size(payload.updates_only(F.col("t")))).first()[0] == 1


def test_model_tokens_are_those_of_the_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    at = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(at)
    texts = ["", None, "one two three four five six", "a " * 50]
    df = frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string")
    for how, cut in (("head", lambda ids: ids[:5]), ("tail", lambda ids: ids[-5:]), ("head_tail", lambda ids: ids[:2] + ids[-3:])):
        for r in df.select("t", payload.model_token_count(F.col("t"), at).alias("n"), payload.model_truncated(F.col("t"), 5, at, how).alias("c")).collect():
            ids = tok.encode(r.t or "", add_special_tokens=False).ids
            assert r.n == len(ids)
            assert r.c == (r.t if len(ids) <= 5 else tok.decode(cut(ids)))
    with pytest.raises(ValueError):
        payload.model_truncated(F.col("t"), 5, at, "middle")


def test_hashed_vectors_follow_the_hash(spark):
    texts = ["Alpha beta, alpha!", "", "x_y 2"]
    got = [r.v for r in frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(payload.hashed_vector(F.col("t"), 16).alias("v")).collect()]
    for text, v in zip(texts, got):
        want = np.zeros(16)
        for w in "".join(ch.lower() if ch.isalnum() else " " for ch in text).split():
            d = hashlib.blake2b(w.encode(), digest_size=8).digest()
            want[int.from_bytes(d[:4], "little") % 16] += 1 if d[4] % 2 == 0 else -1
        n = np.linalg.norm(want)
        want = want / n if n else np.eye(16)[0]
        assert np.allclose(v, want)


def test_inputs_over_the_limit_fail_unless_cut(spark):
    df = frame(spark, [("a b c",)], "t string")
    assert df.select(payload.prepared_for_embedding(F.col("t"), 2).alias("p")).first().p.text == "a b"
    with pytest.raises(Exception, match="too many tokens"):
        df.select(payload.prepared_for_embedding(F.col("t"), 2, truncate=False).alias("p")).collect()


def test_months_of_references(spark):
    urls = [("https://x.org/title/monthly-7/october-1969-5?page=32",), ("https://x.org/January-1970?pagenum=%2032",), (None,)]
    got = frame(spark, urls, "u string").select(documents.monthly_file(F.col("u")).alias("f"), documents.page_number(F.col("u")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("treasury_bulletin_1969_10.txt", 32), ("treasury_bulletin_1970_01.txt", 32), (None, None)]


# ---- streams -----------------------------------------------------------------------------------


def start():
    return admission.LevelState(["C1", "C2"], np.array([0.5, 0.5]), np.eye(2), np.ones((2, 2)), np.ones(2), np.array([0, 0]))


def arrivals(n=60):
    rng = np.random.default_rng(3)
    return [(f"a{i % 50}", rng.normal(size=2).tolist(), int(rng.integers(1, 30)), i) for i in range(n)]


def by_hand(rows, state, budget, batches):
    """A plain loop; an item that comes again takes back what it gave in an earlier batch."""
    gave, out = {}, []
    for rows_ in batches(rows):
        fresh = {}
        for i, v, t, _ in rows_:
            if i in gave:
                old = gave[i]
                state.seen[i] = np.concatenate([[old[0].get(n, 0.0) for n in state.names], old[1]])
            got = admission.admit(state, i, np.array(v), t, budget)
            state.seen.pop(i, None)
            if got["posterior"]:
                fresh[i] = (got["posterior"], np.array(v))
            out.append((i, got["status"], tuple(sorted(got["selected"]))))
        gave |= fresh
    return out, state


SCHEMA = "item_id string, vec array<double>, tokens long, pos long"


def test_a_backlog_equals_a_plain_loop(spark, tmp_path):
    rows = arrivals()
    want, model = by_hand(rows, start(), 90, lambda r: [r[k : k + 20] for k in range(0, len(r), 20)])
    edges = admission.admit_backlog(frame(spark, rows, SCHEMA).repartition(3), start(), 90, f"file://{tmp_path}/out", 20)
    got = {}
    for r in edges.collect():
        at = got.setdefault((r.batch, r.item_id), (r.status, set()))
        if r.selected_w is not None:
            at[1].add(r.community_id)
    assert sorted((i, s, tuple(sorted(c))) for (_, i), (s, c) in got.items()) == sorted(want)
    last = admission.saved_model(spark, f"file://{tmp_path}/out/batch=2")
    assert last.names == model.names and np.allclose(last.means, model.means) and np.allclose(last.counts, model.counts) and last.loads.tolist() == list(model.loads)


def test_a_stream_that_is_broken_off_goes_on(spark, tmp_path):
    rows = arrivals()
    for k in range(3):
        frame(spark, rows[20 * k : 20 * k + 20], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")

    def run(name, upto):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(*[f"{tmp_path}/in/part[0-{upto}]"])
        return admission.run_stream(stream, start(), 90, f"file://{tmp_path}/{name}/out", f"{tmp_path}/{name}/ck")

    whole = run("whole", 2)
    run("parts", 2)
    out = f"file://{tmp_path}/parts/out"
    # the last batch is lost half-way: its folder without the mark of a commit
    import shutil

    shutil.rmtree(f"{tmp_path}/parts/out/batch=2")
    batch = frame(spark, rows[40:], SCHEMA)
    admission.admit_next(batch, 2, start(), 90, out)
    admission.admit_next(batch, 2, start(), 90, out)  # and once more
    again = admission.saved_model(spark, f"{out}/batch=2")
    for a in (whole, again):
        assert a.names == whole.names and np.allclose(a.means, whole.means) and np.allclose(a.counts, whole.counts) and a.loads.tolist() == whole.loads.tolist()
    assert admission.admitted(spark, out).count() == admission.admitted(spark, f"file://{tmp_path}/whole/out").count()


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    none = frame(spark, [], SCHEMA)
    assert admission.admit_batch(start(), none, 9, f"{at}/batch=0").names == ["C1", "C2"]
    admission.admit_next(frame(spark, arrivals(5), SCHEMA), 1, start(), 90, at)
    assert admission.saved_model(spark, f"{at}/batch=1").counts.sum() == pytest.approx(7)
    assert admission.admit_backlog(none, start(), 9, f"file://{tmp_path}/other").count() == 0


# ---- state -------------------------------------------------------------------------------------


def small(spark):
    items = frame(spark, [(f"i{k}", 0, "trajectory", "t", [1.0], 1.0, None, None, 0) for k in range(4)], S.ITEM)
    coms = frame(spark, [("A", 0, None, {}), ("B", 0, None, {})], S.COMMUNITY)
    members = frame(spark, [(0, "A", "i0", 1.0, 1.0), (0, "A", "i1", 0.5, 0.5), (0, "B", "i2", 1.0, 1.0), (0, "B", "i1", None, 0.5)], S.MEMBER)
    cards = frame(spark, [("a", 1, "experience_card", "x", [1.0], None, 1.0, "A", 0), ("b", 1, "experience_card", "y", [1.0], None, 2.0, "B", 0)], S.ITEM)
    return items, coms, members, cards


def test_a_commit_needs_every_item_and_every_card(spark):
    items, coms, members, cards = small(spark)
    s = S.initialised(items)
    with pytest.raises(ValueError, match="item without community"):
        S.committed(s, 0, coms, members, cards)
    out = frame(spark, [("i3",)], "item_id string")
    done = S.committed(s, 0, coms, members, cards, excluded=out)
    assert {r.item_id: r.support_mass for r in done.items.where("level = 1").collect()} == {"a": 1.5, "b": 1.0}
    with pytest.raises(ValueError, match="no_card"):
        S.committed(s, 0, coms, members, cards.where("item_id = 'a'"), excluded=out)
    with pytest.raises(ValueError, match="excluded item"):
        S.committed(s, 0, coms, members, cards, excluded=frame(spark, [("i0",), ("i3",)], "item_id string"))
    with pytest.raises(ValueError, match="unknown community"):
        S.committed(s, 0, coms.where("community_id = 'A'"), members, cards.where("item_id = 'a'"), excluded=out)
    assert S.is_terminal(done, 1) and not S.is_terminal(done, 0)


def test_items_that_cannot_begin(spark):
    items = small(spark)[0]
    with pytest.raises(ValueError, match="repeated"):
        S.initialised(items.unionByName(items))
    with pytest.raises(ValueError, match="known"):
        S.inserted(S.initialised(items), items.limit(1))


def test_snapshots_need_vectors(spark, tmp_path):
    s = S.initialised(small(spark)[0])
    at = f"file://{tmp_path}/snap"
    assert S.restored(spark, at) is None
    S.saved(S.State(s.items.withColumn("vec", F.lit(None).cast("array<double>")), s.communities, s.members, s.layers), at, 7)
    with pytest.raises(ValueError, match="no vectors"):
        S.restored(spark, at)
    got, batch = S.restored(spark, at, s.items.select("item_id", "vec"))
    assert batch == 7 and got.items.count() == 4


def test_propagation_refuses_what_never_rests(spark):
    items, coms, members, cards = small(spark)
    done = S.committed(S.initialised(items), 0, coms, members, cards, excluded=frame(spark, [("i3",)], "item_id string"))
    bad = lambda p: p.select(F.col("community_id").alias("source_community_id"), F.lit("add").alias("operation"), F.lit("a").alias("item_id"), F.lit("t").alias("text"), F.lit(None).cast("array<double>").alias("vec"), F.lit(1.0).alias("confidence"))
    with pytest.raises(ValueError, match="add_of_a_known_id"):
        propagation.propagated(done, frame(spark, [("A",)], "community_id string"), bad, lambda items, level: None)
    none = lambda p: bad(p).limit(0)
    out = propagation.propagated(done, frame(spark, [("A",)], "community_id string"), none, lambda items, level: None)
    assert out.rounds == 1 and not out.needs_export and out.changed.count() == 0


def test_over_budget_prompts_fail(spark):
    items = frame(spark, [("x", 5), ("y", 9)], "item_id string, tokens long")
    edges = frame(spark, [("x", "A", 1.0), ("y", "B", 1.0)], "item_id string, community_id string, w double")
    assert S.preflight(S.prompt_costs(edges, items, 9)).count() == 2
    with pytest.raises(Exception, match="passes its budget: B"):
        S.preflight(S.prompt_costs(edges, items, 8)).collect()


def test_trees_are_exported_anew_only_from_the_baseline(spark):
    rows = [(k, v) for k, v in protocol.BASELINE.items() if v is not None] + [("seed", "1")]
    a = frame(spark, rows, "name string, value string")
    protocol.assert_reexportable(a, a)
    protocol.assert_reexportable(a, a.where("name <> 'seed'"), ("seed",))
    with pytest.raises(ValueError, match="both"):
        protocol.assert_reexportable(a, a.where("name <> 'seed'"))
    with pytest.raises(ValueError, match="source"):
        protocol.assert_reexportable(a.where("name <> 'max_levels'"), a)


def test_logs_of_long_runs_keep_all_messages(spark):
    log = "".join(f"## [{i}] USER\n\nm{i}\n\n---\n" for i in range(3000))
    assert readers.markdown_messages(frame(spark, [("p", log)], "path string, text string")).count() == 3000


def test_question_records_carry_their_steps(spark):
    results = frame(spark, [(1, "q", "t", "r", 1, 0.5, None), (2, None, None, None, None, None, "")], "id long, question string, task_type string, response string, hard int, soft double, fail_reason string")
    events = frame(spark, [(1, 0, "message", "hello", None, None, None, False), (1, 1, "tool_call", None, "grep(a)", "[tool error x", None, False)], "id long, pos int, type string, content string, cmd string, obs string, tool string, has_calls boolean")
    got = {r.task_id: r for r in views.question_records(results, views.conversation_steps(events, "id")).collect()}
    (step,) = got["1"].steps
    assert (step.raw_model_output, step.action, step.tool_name, step.action_valid) == ("hello", "grep(a)", "grep", False)
    assert got["2"].steps == [] and got["2"].verifier_feedback == "answer_mismatch" and not got["2"].success
    assert json.loads(json.dumps(got["1"].verifier_feedback)) == "correct"


# ---- fits, trees, packs ------------------------------------------------------------------------


def blobs(n, k, seed=0, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d)) * 4
    return centres[np.arange(n) % k] + rng.normal(size=(n, d)) * 0.3


def vec_rows(spark, x):
    return frame(spark, [(f"{i:06d}", v.tolist(), 1.0) for i, v in enumerate(x)], "item_id string, vec array<double>, w double")


@pytest.mark.parametrize("policy, want", [("projected_gmm_bic", 5), ("projected_kmeans_fixed", 3)])
def test_policies_of_a_split(spark, policy, want):
    cfg = hierarchy.TreeConfig(policy=policy, fixed_k=3)
    assert hierarchy.selected(vec_rows(spark, blobs(300, 5)), 12, cfg, 42).k == want


def test_the_elbow_of_two_pairs(spark):
    rows = vec_rows(spark, np.array([[1, 0], [0.98, 0.02], [-1, 0], [-0.98, -0.02]]))
    fit = hierarchy.selected(rows, 4, hierarchy.TreeConfig(policy="projected_kmeans_elbow"), 42)
    got = mixture.nearest(rows, fit, ["a", "b"]).collect()
    assert fit.k == 2 and {r.w for r in got} == {1.0}
    assert len({r.community_id for r in got if r.item_id in ("000000", "000001")}) == len({r.community_id for r in got if r.item_id > "000001"}) == 1


def test_an_unknown_policy_fails(spark):
    with pytest.raises(ValueError, match="unknown policy"):
        hierarchy.selected(vec_rows(spark, blobs(10, 2)), 2, hierarchy.TreeConfig(policy="x"), 1)


def test_passes_over_all_rows_go_on_from_the_sample(spark, monkeypatch):
    """A sample of some rows leads to the mixture that all rows give."""
    x = blobs(900, 4, 3)
    rows = vec_rows(spark, x).repartition(5)
    cfg = mixture.MixtureConfig(restarts=2, rounds=40, tol=1e-9)
    whole = mixture.fit_mixtures(rows, [1, 2, 3, 4, 5], cfg, 7)
    monkeypatch.setattr(mixture, "INIT_ROWS", 300)
    monkeypatch.setattr(mixture, "sample", lambda r, most=300, f=mixture.sample: f(r, most))
    monkeypatch.setattr(mixture, "LOCAL_WORK", 0)
    parts = mixture.fit_mixtures(rows, [1, 2, 3, 4, 5], cfg, 7)
    assert mixture.choose(whole)[0].k == mixture.choose(parts)[0].k == 4
    a, b = (sorted(map(tuple, np.round(next(f for f in fits if f.k == 4).means, 4))) for fits in (whole, parts))
    assert np.allclose(a, b, atol=1e-3)
    assert abs(whole[3].bic - parts[3].bic) < 1e-3 * abs(whole[3].bic)


def test_an_elbow_on_the_driver_is_that_of_the_table(spark):
    rng = random.Random(2)
    rows = []
    for g in range(30):
        n = rng.randint(1, 9)
        scores = sorted((rng.uniform(0, 10) for _ in range(n)), reverse=True) if g % 5 else [1.0] * n
        rows += [(g, k + 1, s) for k, s in enumerate(scores)]
    got = {r.g: r.k for r in selection.choose_elbow(frame(spark, rows, "g int, k int, score double"), "g").collect()}
    for g, k in got.items():
        mine = [(k, s) for h, k, s in rows if h == g]
        assert selection.elbow([k for k, _ in mine], [s for _, s in mine]) == k


def test_small_communities_split_as_large_ones(spark, monkeypatch):
    x = blobs(240, 6, 1)
    items = frame(spark, [(f"{i:06d}", v.tolist(), 10 + i % 7) for i, v in enumerate(x)], "item_id string, vec array<double>, tokens long")
    members = items.select("item_id", F.concat(F.lit("C"), (F.col("tokens") % 2).cast("string")).alias("community_id"), F.lit(0.5).alias("w"))
    cfg, fits = refinement.RefineConfig(700, ks=(2, 4), most_depth=3), mixture.MixtureConfig(restarts=1, rounds=15)
    keep = lambda t, _: t.cache()
    run = lambda: sorted((r.item_id, r.community_id, round(r.w, 9)) for r in refinement.refined(members, items, cfg, fits, 3, keep)[0].collect())
    small = run()
    monkeypatch.setattr(refinement, "SMALL_ROWS", 0)
    assert run() == small
    tokens = {r.item_id: r.tokens for r in items.collect()}
    cost = {}
    for i, c, _ in small:
        cost[c] = cost.get(c, 0) + tokens[i]
    assert max(cost.values()) <= 700 and len(cost) > 4


def test_packs_of_tables_are_those_of_the_loop(spark):
    rng = random.Random(8)
    rows = [(f"g{rng.randrange(3)}", f"i{i:04d}", rng.choice([0, 1, 5, 9, 20, 33, 60])) for i in range(500)] + [("h", "x", 61)]
    got = {(r.community_id, r.item_id): r.pack for r in budget.pack_communities(frame(spark, rows, "community_id string, item_id string, tokens long").repartition(7), 60).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == g)
        assert [got[g, i] for _, i, _ in mine] == budget.first_fit([t for _, _, t in mine], 60)


def test_histograms_pack_as_items_do():
    rng = random.Random(1)
    for _ in range(500):
        most = rng.randint(1, 60)
        costs = [rng.randint(0, rng.choice([most, most + 5, max(1, most // 3)])) for _ in range(rng.randint(0, 80))]
        counts = {c: costs.count(c) for c in set(costs)}
        runs, rank, got = budget.first_fit_runs(counts, most), {}, []
        for c in costs:
            k = rank[c] = rank.get(c, -1) + 1
            first, each, pack = next((r for r in reversed(runs.get(c, [])) if r[0] <= k), (0, 1, -1 - k))
            got.append(pack + (k - first) // each)
        assert got == budget.first_fit(costs, most)
    runs = budget.first_fit_runs({k: 10**9 for k in range(1, 300)}, 2000)
    assert max(map(len, runs.values())) < 100  # however many items


def test_a_full_filter_lets_all_through(spark, monkeypatch):
    texts = frame(spark, [(i, f"text of kind {i} and end {i % 3}.") for i in range(60)], "id long, text string")
    terms = frame(spark, [(f"Kind {k}",) for k in range(0, 60, 7)] + [("\\E quoted (x",)], "term string")
    few = sorted(map(tuple, bank.audit(texts, terms, "id").collect()))
    monkeypatch.setattr(bank, "FILTER_WORDS", 1)
    assert sorted(map(tuple, bank.audit(texts, terms, "id").collect())) == few and len(few) == 9
