import random

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from codelode.operators.hierarchy import contains_links, descendants, hierarchies, looped, walk_component
from codelode.plans.hierarchy import ORACLE, p5_descendants


def rows(df):
    return {(r.node_id, r.root_id, r.depth, tuple(r.path) if r.path else None, r.n_parents, r.cycle_id, r.on_cycle) for r in df.collect()}


def brute(links):
    """Looped (cycle, node) pairs by closure."""
    reach = set(links)
    while True:
        more = {(a, d) for a, b in reach for c, d in links if b == c} - reach
        if not more:
            break
        reach |= more
    ring = {a: min([b for x, b in reach if x == a and (b, a) in reach]) for a, b in reach if a == b}
    return {(ring[a], a) for a in ring} | {(ring[a], b) for a, b in reach if a in ring}


def test_tree_cycle_and_descendants(spark):
    e = [("r", "a"), ("r", "b"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("s", "s"), ("r", "a"), (None, "q"), ("q", None)]
    t = hierarchies(spark.createDataFrame(e, "parent string, child string"))
    got = rows(t)
    assert ("c", "r", 2, ("r", "a", "c"), 1, None, False) in got
    assert {(r.cycle_id, r.node_id) for r in looped(t).collect()} == {("x", "x"), ("x", "y"), ("x", "z"), ("s", "s")}
    assert {tuple(r) for r in descendants(t).collect()} == {("r", "a", 1), ("r", "b", 1), ("r", "c", 2), ("a", "c", 1)}


def test_empty_and_extra_columns(spark):
    assert hierarchies(spark.createDataFrame([], "parent string, child string, path string")).count() == 0
    t = hierarchies(spark.createDataFrame([("a", "b", "x")], "parent string, child string, node_id string"))
    assert t.count() == 2


def test_types_are_read_loosely(spark):
    e = spark.createDataFrame([("a", "b", " contains "), ("b", "c", "CONTAINS"), ("a", "c", "CALLS"), ("a", "d", None)], "source_id string, target_id string, edge_type string")
    assert {tuple(r) for r in contains_links(e).collect()} == {("a", "b"), ("b", "c")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), max_size=14))
def test_walk_equals_closure(links):
    links = sorted(set(links))
    got = list(walk_component(links))
    assert {(r[6], r[0]) for r in got if r[6]} == brute(links)
    looped_nodes = {n for _, n in brute(links)}
    assert {r[0] for r in got if r[6] is None} == {x for e in links for x in e} - looped_nodes
    for r in got:
        if r[4]:
            assert all((a, b) in links for a, b in zip(r[4], r[4][1:])) and r[3] == len(r[4]) - 1


def test_large_components_are_not_gathered(spark):
    rng = random.Random(3)
    forest = [(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 120)] + [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("c3", "d0"), ("d0", "d1")]
    df = spark.createDataFrame(forest, "parent string, child string")
    assert rows(hierarchies(df)) == rows(hierarchies(df, max_component_links=5))


def test_large_components_with_several_parents(spark):
    rng = random.Random(5)
    links = {(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 30)} | {(f"n{rng.randrange(12)}", f"n{rng.randrange(12, 30)}") for _ in range(12)} | {("n20", "n13"), ("n13", "n20"), ("n25", "n25"), ("k", "n20"), ("n20", "m1"), ("m1", "m2"), ("m2", "m1")}
    df = spark.createDataFrame(sorted(links), "parent string, child string")
    assert rows(hierarchies(df)) == rows(hierarchies(df, max_component_links=3))


def test_roots_with_smaller_co_parents_keep_their_rows(spark):
    # r2 stands in no link to a smallest parent; r3's other child hangs under a cycle.
    plain = [("r1", "c"), ("r2", "c"), ("c", "d"), ("r1", "d")]
    cyclic = plain + [("r3", "c"), ("r3", "x"), ("x", "y"), ("y", "x"), ("r4", "y")]
    for links in (plain, cyclic):
        df = spark.createDataFrame(links, "parent string, child string")
        got = rows(hierarchies(df, max_component_links=1))
        assert ("r2", "r2", 0, ("r2",), 0, None, False) in got
        assert got == {(r[0], r[2], r[3], tuple(r[4]) if r[4] else None, r[5], r[6], r[7]) for r in walk_component(links)}


def test_descendants_over_all_parents(spark, tmp_path):
    # Two ways of length 2 from r to c, one of length 3 over b; s is no smallest parent; k stands above a cycle only.
    links = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("a", "b"), ("c", "d"), ("s", "d"), ("d", "e"), ("q", "t"), ("t", "u"), ("x", "y"), ("y", "x"), ("y", "z"), ("c", "z"), ("k", "x")]
    df = spark.createDataFrame([(p, c, "CONTAINS") for p, c in links], "source_id string, target_id string, edge_type string")
    df.write.parquet(f"{tmp_path}/graph_edges.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW graph_edges AS SELECT * FROM '{tmp_path}/graph_edges.parquet/*.parquet'")
    want = sorted(duck.execute(ORACLE["p5_descendants"]).fetchall())
    assert sorted(tuple(r) for r in p5_descendants(spark, str(tmp_path)).collect()) == want and want.count(("r", "c", 2)) == 2
    large = contains_links(df)
    assert sorted(tuple(r) for r in descendants(hierarchies(large, max_component_links=1), large).collect()) == want
    with pytest.raises(Exception, match="several parents need links"):
        descendants(hierarchies(large)).collect()
