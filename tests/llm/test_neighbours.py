import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm.neighbours import DIM, TreeParams, calibrate, fit_tree, neighbours, p3_found, unit, usable

SCHEMA = "seq long, file_path string, embedding array<float>"


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 40), DIM))
    return (centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, DIM))).astype(np.float32)


def brute(rows, k=5):
    seqs = np.array(sorted(rows))
    x = unit(np.array([rows[s] for s in seqs], dtype=np.float32))
    s = np.rint((x @ x.T) * 1e6).astype(np.int64)
    np.fill_diagonal(s, -(10**9))
    near = np.lexsort((np.broadcast_to(np.arange(len(s)), s.shape), -s), axis=1)[:, : min(k, len(s) - 1)]
    return {(int(seqs[i]), int(seqs[j])) for i in range(len(seqs)) for j in near[i]}


def asked(df, **p):
    return {(r.seq, r.near) for r in neighbours(usable(df), 5, TreeParams(**p)).collect()}


def test_small_table_is_exact(spark):
    x = clustered(300)
    rows = {i * 3: x[i] for i in range(300)}
    df = spark.createDataFrame([(s, "p", v.tolist()) for s, v in rows.items()], SCHEMA)
    assert asked(df) == brute(rows)


def test_recall_of_tree_and_blocks(spark):
    x = clustered(3000, 2)
    rows = dict(enumerate(x))
    df = spark.createDataFrame([(s, "p", v.tolist()) for s, v in rows.items()], SCHEMA)
    want = brute(rows)
    got = asked(df, leaf_rows=200, branches=8)
    assert len(got & want) / len(want) >= 0.95
    # Cutting leaves into blocks changes nothing.
    assert asked(df, leaf_rows=200, branches=8, block_rows=30) == got


def test_equal_scaled_and_unusable_vectors(spark):
    x = clustered(60, 3)
    rows = {i: x[i] for i in range(60)} | {100 + i: x[0] for i in range(12)} | {200: x[1] * 2}
    data = [(s, "p", v.tolist()) for s, v in rows.items()]
    data += [(5, "p", x[5].tolist()), (300, "p", None), (301, "p", [0.0] * DIM), (302, "p", [1.0] * 32), (None, "p", x[3].tolist()), (303, "p", [float("nan")] * DIM)]
    assert asked(spark.createDataFrame(data, SCHEMA)) == brute(rows)


def test_few_rows(spark):
    x = clustered(3)
    df = spark.createDataFrame([(i, None, v.tolist()) for i, v in enumerate(x)], SCHEMA).withColumn("near", F.lit(1))
    assert asked(df) == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert {tuple(r) for r in p3_found(df).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert p3_found(df.limit(0)).count() == 0
    assert p3_found(df.limit(1)).count() == 0


def test_calibration_reaches_target():
    x = unit(clustered(4000, 4)).astype(np.float32)
    p = TreeParams(leaf_rows=150, branches=12)
    tree = fit_tree(x, len(x), p)
    visits, recall = calibrate(tree, x, 5, p)
    assert recall >= p.target_recall and 1 <= visits < tree.leaves
    best = tree.visit(x[:50], tree.leaves)
    assert all(sorted(r) == list(range(tree.leaves)) for r in best.tolist())


def test_visits_widen_until_recall_is_reached():
    x = unit(np.random.default_rng(3).normal(size=(1500, DIM)).astype(np.float32)).astype(np.float32)
    p = TreeParams(leaf_rows=10, queries=60)
    tree = fit_tree(x, len(x), p)
    visits, recall = calibrate(tree, x, 5, p)
    assert tree.leaves >= visits > p.most_visits and recall >= p.target_recall


def test_visits_take_bounded_memory():
    x = unit(clustered(4000, 5)).astype(np.float32)
    tree = fit_tree(x, 500_000, TreeParams(leaf_rows=200))
    assert tree.leaves > 500
    tracemalloc.start()
    got = tree.visit(x, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got >= 0).all() and peak < 120e6


def test_regions_and_blocks_change_nothing(spark):
    x = clustered(2000, 6)
    df = spark.createDataFrame([(s, "p", v.tolist()) for s, v in enumerate(x)], SCHEMA)
    got = asked(df, leaf_rows=100, branches=8)
    # Several regions of which some are one large leaf, met block by block.
    assert asked(df, leaf_rows=100, branches=8, block_rows=2) == got


def test_tree_of_a_sample_reaches_recall_of_the_table(spark):
    x = clustered(3000, 7)
    rows = dict(enumerate(x))
    df = spark.createDataFrame([(s, "p", v.tolist()) for s, v in rows.items()], SCHEMA)
    want = brute(rows)
    assert len(asked(df, leaf_rows=100, branches=8, sample_rows=600) & want) / len(want) >= 0.95


def test_many_vectors_of_one_direction(spark):
    x = clustered(1, 8)[0]
    rows = {i: x * np.float32(1 + i / 64) for i in range(1500)}
    df = spark.createDataFrame([(s, "p", v.tolist()) for s, v in rows.items()], SCHEMA)
    assert asked(df) == {(a, b) for a in rows for b in [n for n in range(6) if n != a][:5]}
