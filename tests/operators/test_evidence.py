"""Evidence, patches, data sets and routing on worked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.operators import datasets, evidence, patches
from stratiform.operators.mixture import Fit
from stratiform.streaming import routing


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_sections_of_a_task(spark):
    text = "Task: ### instruction\nsum it\nup\n### spreadsheet_path\n/data/13-1/in.xlsx\n### answer_position\nA1\n---\nrules\n### other\nx"
    m = frame(spark, [(1, 0, "user", "hi"), (1, 1, "user", text), (2, 0, "user", "only"), (2, 1, "assistant", "### instruction")], "k long, turn int, role string, text string")
    got = {r.k: r for r in evidence.first_task(m, "k").select("k", "task", *evidence.task_fields(F.col("task"))).collect()}
    assert (got[1].instruction, got[1].answer_position, got[1].spreadsheet_path, got[1].output_path) == ("sum it\nup", "A1", "/data/13-1/in.xlsx", None)
    assert got[2].task == "only" and got[2].instruction is None


@pytest.mark.parametrize(
    "path, sheet, given, want",
    [
        ("a/seed_7/cli_only_agent_123__trial_2_seed_7.md", None, None, ("123", 2)),
        ("a/cli_skill_preloaded_agent_13-1.md", "/x/9/in.xlsx", 5, ("13-1", 5)),
        ("run-4/log.jsonl", "/data/13-1/in.xlsx", None, ("13-1", 4)),
        ("log.jsonl", "in.xlsx", None, ("log", 0)),
    ],
)
def test_ids(spark, path, sheet, given, want):
    r = frame(spark, [(path, sheet, given)], "p string, s string, g int").select(evidence.inferred_task_id(F.col("p"), F.col("s")).alias("t"), evidence.inferred_trial(F.col("p"), F.col("g")).alias("n")).first()
    assert (r.t, r.n) == want


def test_redaction_does_not_look_at_what_it_hides(spark):
    args = ["run", "--api-key", "--token", "x", "Token=a=b", "authorization bearer", "BEARER abc", "--n", "1"]
    got = frame(spark, [(args,), ([],)], "a array<string>").select(evidence.redacted(F.col("a")).alias("r")).collect()
    assert got[0].r == ["run", "--api-key", "<redacted>", "x", "Token=<redacted>", "authorization bearer", "Bearer <redacted>", "--n", "1"]
    assert got[1].r == []


def test_tool_calls(spark):
    cases = ['<tool_call>{"name": "read", "arguments": {"a": 1}}</tool_call>', '<tool>{"tool_name": " glob ", "args": {}}</tool>', "<tool>{broken</tool>", "none", None, '<tool>{"name": "bash"}</tool>']
    got = [r.c for r in frame(spark, [(c,) for c in cases], "t string").select(evidence.tool_call(F.col("t")).alias("c")).collect()]
    assert [g and (g.name, g.arguments) for g in got] == [("read", '{"a":1}'), ("glob", "{}"), None, None, None, None]


def test_placements(spark):
    df = frame(spark, [(" Main ",), ("ref",), ("scripts",)], "t string").select(evidence.placement(F.col("t")).alias("p"))
    assert [r.p for r in df.collect()] == ["skill_md", "reference", "script"]
    with pytest.raises(Exception, match="unknown placement"):
        frame(spark, [("elsewhere",)], "t string").select(evidence.placement(F.col("t")).alias("p")).collect()


@pytest.mark.parametrize("n, size", [(8, 700), (3, 100), (40, 5000), (0, 1)])
def test_compact_views_stay_short_and_keep_both_ends(spark, n, size):
    lines = [f"first{i} " + "x" * size + f" last{i}" for i in range(n)]
    v = frame(spark, [(lines,)], "s array<string>").select(evidence.compact_view(F.col("s"), 5000, 4, 1200).alias("v")).first().v
    assert len(v) <= 5000
    assert n == 0 or v.startswith("first0") and v.endswith(f"last{n - 1}")


def test_context_is_cut_where_the_room_ends(spark):
    cards = frame(spark, [(1, 2, "b", "second"), (1, 1, "a", "first"), (1, 3, "c", "third")], "q int, rank int, name string, content string")
    assert evidence.numbered_context(cards, "q", 16).first().context == "[1] a\nfirst\n\n[2]"


def test_patches_share_the_mass_out(spark):
    cards = frame(spark, [("k1", "c", 1, "t", [1.0], 0.8, 1.0, 1), ("k2", "c", 1, "t", [1.0], 0.2, 1.0, 1), ("z", "d", 1, "t", [1.0], 0.5, 3.0, 1)], "item_id string, source_community_id string, level int, text string, vec array<double>, confidence double, support_mass double, version int")
    com = frame(spark, [("c", 0, 2.0), ("d", 0, 3.0)], "community_id string, level int, support_mass double")
    p = frame(spark, [("c", "update", "k1", "new", [1.0], 0.5), ("c", "add", "k3", "t3", [0.0], 0.5)], "source_community_id string, operation string, item_id string, text string, vec array<double>, confidence double")
    got = {r.item_id: r for r in patches.patched(cards, com, p).collect()}
    assert {k: r.support_mass for k, r in got.items()} == pytest.approx({"k1": 2 * 0.5 / 1.2, "k2": 2 * 0.2 / 1.2, "k3": 2 * 0.5 / 1.2, "z": 3.0})
    assert {k: (r.change, r.reroute) for k, r in got.items()} == {"k1": ("updated", True), "k2": ("mass", False), "k3": ("added", True), "z": (None, False)}
    assert got["k3"].level == 1 and got["z"].version == 1 and got["k2"].version == 2
    assert patches.patch_faults(cards, com, p).count() == 0


def test_digests_ignore_order(spark):
    rows = [(f"p{i}", i, f"{i:064x}") for i in range(200)]
    digest = lambda r: datasets.set_digest(frame(spark, r, "path string, size long, sha string").repartition(3)).first()
    assert digest(rows) == digest(rows[::-1]) and digest(rows).files == 200
    assert digest(rows).digest != digest(rows[:-1]).digest != digest(rows[:-1] + [("p199", 199, "0")]).digest
    assert digest([]).files == 0


def leaf(name):
    return routing.Node("leaf", community=name)


def test_an_excluded_branch_loses_its_weight(spark):
    fit = Fit(2, np.array([0.7, 0.3]), np.array([[0.0], [1.0]]), np.ones((2, 1)))
    tree = {"r": routing.Node("split", children=("x", "y"), mean=np.zeros(2), basis=np.array([[1.0, 0.0]]), fit=fit), "x": routing.Node("excluded"), "y": leaf("Y")}
    got = routing.route(frame(spark, [("i", [0.0, 1.0], "C", 1.0), ("j", [1.0, 0.0], "D", 0.5)], "item_id string, vec array<double>, community_id string, w double"), {"C": "r"}, tree)
    rows = {r.item_id: (r.community_id, r.w) for r in got.collect()}
    assert rows["i"][0] == "Y" and 0.15 < rows["i"][1] < 0.30 and rows["j"] == ("D", 0.5)


def test_a_router_prefers_the_near_centroid(spark):
    tree = {"r": routing.Node("router", children=("x", "y"), centroids=np.eye(2)), "x": leaf("X"), "y": leaf("Y")}
    got = routing.route(frame(spark, [("i", [2.0, 0.0], "C", 1.0)], "item_id string, vec array<double>, community_id string, w double"), {"C": "r"}, tree)
    w = {r.community_id: r.w for r in got.collect()}
    assert w["X"] > 0.99 and sum(w.values()) == pytest.approx(1)
