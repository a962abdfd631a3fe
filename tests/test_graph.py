import random

import pytest
from pyspark.sql import functions as F

from codelode.operators import agents, retrieval
from codelode.operators.graph import CodeGraph, containing_class, resolve_calls
from codelode.sources.tables import clean_edges, upsert_nodes

N = "id string, name string, node_type string, file_path string, start_line int, end_line int, signature string, docstring string, metadata map<string,string>, seq bigint"
NODES = [
    ("file::pay.py", "pay", "file", "pay.py", 0, 0, "", "", None, 0), ("file::tax.py", "tax", "file", "tax.py", 0, 0, "", None, None, 1), ("class::pay.py::PaymentService", "PaymentService", "class", "pay.py", 1, 20, "class PaymentService", "Handles payments", None, 2),
    ("method::pay.py::PaymentService.process", "process", "method", "pay.py", 5, 12, "def process(self, order)", None, None, 3), ("method::pay.py::PaymentService.validate", "validate", "method", "pay.py", 14, 20, None, None, None, 4), ("function::tax.py::calculate_tax", "calculate_tax", "function", "tax.py", 1, 4, "def calculate_tax(amount)", "Taxes", None, 5),
]
C = "class::pay.py::PaymentService"
P, V, T = NODES[3][0], NODES[4][0], NODES[5][0]
EDGES = [("file::pay.py", C, "CONTAINS", 0), (C, P, "contains ", 1), (C, V, "CONTAINS", 2), ("file::tax.py", T, "CONTAINS", 3), (P, T, "CALLS", 4), (P, V, " calls", 5), (P, V, " calls", 5), (P, "method::*::*.gone", "CALLS", 6), (None, P, "CALLS", 7)]


@pytest.fixture(scope="module")
def g(spark):
    log = [*NODES, (P, "old", "method", "pay.py", 1, 1, "", "", None, -1)]
    return CodeGraph(upsert_nodes(spark.createDataFrame(log, N)), clean_edges(spark.createDataFrame(EDGES, "source_id string, target_id string, edge_type string, seq bigint")))


def test_lookups(g):
    assert {r.neighbour_name for r in g.callees().where(F.col("id") == P).collect()} == {"calculate_tax", "validate"}
    assert [r.neighbour_name for r in g.callers().where(F.col("id") == T).collect()] == ["process"]
    assert [r.parent_id for r in g.parents().where(F.col("id") == P).collect()] == [C]
    assert g.by_name("PROCESS").count() == 1 and g.by_name("old").count() == 0 and g.by_type("method").count() == 2 and g.by_id("x").count() == 0
    s = {(r.kind, r.type): r.n for r in g.stats().collect()}
    assert s[("node", "*")] == 6 and s[("edge", "CALLS")] == 3 and s[("edge", "*")] == 7
    assert {tuple(r) for r in g.callers_of("calculate_tax").collect()} == {(T, P)} and {tuple(r) for r in g.callers_of("process").collect()} == {(P, None)}
    assert g.deduplicated().edges.count() == 6
    assert {r.position for r in g.by_id(P).collect()} == {-1}


def test_breadth(g):
    got = {(r.id, r.depth, r.edge_type) for r in g.around(P, 2).collect()}
    assert got == {(T, 1, "CALLS"), (V, 1, "CALLS"), (C, 1, "CONTAINS"), ("file::tax.py", 2, "CONTAINS"), ("file::pay.py", 2, "CONTAINS")}
    assert (V, 2, "CONTAINS") in {(r.id, r.depth, r.edge_type) for r in g.paths_around(P, 2).collect()}
    assert g.around("none").count() == 0


def test_breadth_is_least_depth(spark):
    rng = random.Random(2)
    ids = [f"n{i}" for i in range(40)]
    nodes = spark.createDataFrame([(x, x, "function", "f", 1, 1, "", "", None, i) for i, x in enumerate(ids)], N)
    edges = [(rng.choice(ids), rng.choice(ids), "CALLS", i) for i in range(60)]
    graph = CodeGraph(upsert_nodes(nodes), spark.createDataFrame(edges, "source_id string, target_id string, edge_type string, seq bigint"))
    depth, todo = {"n0": 0}, ["n0"]
    for x in todo:
        for a, b, *_ in edges:
            for y in ((b,) if a == x else ()) + ((a,) if b == x else ()):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    todo.append(y)
    assert {r.id: r.depth for r in graph.around("n0", 3).collect()} == {k: v for k, v in depth.items() if 0 < v <= 3}


def test_subgraph_and_save(spark, g, tmp_path):
    sub = g.focus("tax")
    assert {r.id for r in sub.nodes.collect()} == {"file::tax.py", T, P} and sub.edges.count() == 2
    assert [r.node_type for r in g.sample(3).collect()] == ["file", "file", "class"]
    g.save(str(tmp_path / "g"))
    back = CodeGraph.load(spark, str(tmp_path / "g"))
    assert back.edges.count() == 7 and back.nodes.count() == 6
    assert g.simple_edges().count() == 7
    back.register()
    assert spark.sql("SELECT count(*) FROM graph_current_edges WHERE edge_type = 'CALLS'").first()[0] == 3


def test_search(g):
    a = retrieval.anchors(g, "process the payment order").collect()
    assert a[0].id == P and a[0].score == pytest.approx(1.0)
    got = {r.id: (r.source, round(r.score, 3)) for r in retrieval.search(g, "process").collect()}
    assert got[P] == ("anchor", 1.0) and got[T] == ("callee", 0.7) and got[V] == ("callee", 0.7)
    assert retrieval.search(g, "zzz").count() == 0 and retrieval.search(g, "the of").count() == 0


def test_snippets(spark, g):
    files = spark.createDataFrame([("tax.py", "a\nb\nc\nd\ne"), ("pay.py", None)], "path string, content string")
    assert {tuple(r) for r in retrieval.snippets(g.nodes, files).collect()} == {(T, "a\nb\nc\nd")}


def test_asof(g):
    assert {tuple(r) for r in containing_class(g.nodes).collect()} == {(P, C), (V, C), (T, None)}


def test_call_caps(spark):
    f = spark.createDataFrame([(f"f{i}", "far" if i < 6 else f"own{i}", "a.py" if i < 6 else "b.py", i) for i in range(20)], "id string, name string, file_path string, position bigint")
    calls = [("f6", "b.py", f"own{i}", i) for i in range(7, 18)] + [("f7", "b.py", "far", 1), ("f0", "a.py", "far", 1), ("f8", "b.py", "own8", 1)]
    imported = spark.createDataFrame([("b.py", "far")], "file_path string, name string")
    got = resolve_calls(spark.createDataFrame(calls, "caller_id string, file_path string, callee string, ord bigint"), f, imported).collect()
    by = {}
    for r in got:
        by.setdefault(r.caller_id, []).append(r.callee_id)
    assert len(by["f6"]) == 10 and sorted(by["f7"]) == ["f0", "f1", "f2"] and sorted(by["f0"]) == ["f1", "f2", "f3", "f4", "f5"] and "f8" not in by


def test_agents(spark):
    text = '```json\n{"ranked_locations": [{"file_path": "b.py", "function_name": "f", "class_name": "K"}, {"file_path": "a.py"}, {"file_path": "b.py"}]}\n```'
    rows = spark.createDataFrame([("i", text), ("j", "nothing"), ("k", None)], "instance_id string, answer string")
    loc = agents.locations(rows, "answer", "ranked_locations")
    assert [(r.pos, r.file_path) for r in loc.orderBy("pos").collect()] == [(0, "b.py"), (1, "a.py"), (2, "b.py")]
    cand = agents.candidate_files(loc)
    assert cand.first().files == ["b.py", "a.py"]
    assert agents.method_names(loc).first().method == "b.py::K.f"
    assert agents.ranked_with_fallback(loc, cand).first().ranked_files == ["b.py", "a.py", "b.py"]
    assert agents.ranked_with_fallback(loc.limit(0), cand).first().ranked_files == ["b.py", "a.py"]
    r = agents.Registry()
    r.register("double", lambda x: x * 2, {"x": "integer"})
    assert r.execute("double", {"x": 2}) == 4 and r.execute("none", {}).startswith("Error") and r.execute("double", {"y": 1}).startswith("Error") and r.schema("double")["name"] == "double"
    t = spark.createDataFrame([("r", "a", 1, "did", "x" * 300), ("r", "a", 2, "did", "y"), ("r", "b", 3, None, None)], "run_id string, agent string, step int, action string, result string")
    assert agents.first_traces(t).count() == 2 and len(agents.trace_summary(t).first().summary.split("\n")) == 3
    p = rows.limit(1).select(agents.compose(F.lit("report"), {"Files": F.array(F.lit("a")), "None": F.array().cast("array<string>")}).alias("p")).first().p
    assert p == "report\n\nFiles:\na"


def test_localize_fuses_all_files(spark):
    from codelode.operators.retrieval import localize

    # z.py is 61st by lines; the callees in one file would fill the best 50 nodes before late.py.
    nodes = [("z", "gateway", "function", "z.py", 1, 1, "", "", None, 0)] + [(f"n{i:02}", f"x{i}", "function", "crowd.py" if i < 60 else "late.py", i + 1, i + 1, "", "", None, i + 1) for i in range(61)]
    edges = spark.createDataFrame([("z", f"n{i:02}", "CALLS", i) for i in range(61)], "source_id string, target_id string, edge_type string, seq bigint")
    files = spark.createDataFrame([("z.py", "gateway\n")] + [(f"p{i:02}.py", "gateway\n" * 3) for i in range(60)], "path string, content string")
    got = {r.file_path: r.score for r in localize(files, CodeGraph(upsert_nodes(spark.createDataFrame(nodes, N)), edges), "gateway", 200).collect()}
    assert got["z.py"] == round(1 / 61 + 1 / 121, 9) and {"crowd.py", "late.py", "p59.py"} <= set(got)
