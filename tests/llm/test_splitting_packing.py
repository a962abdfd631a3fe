import random

import pytest
from hypothesis import given, settings, strategies as st

from codelode.llm.packing import pack, plan_bins, token_count, window_report
from codelode.llm.splitting import overlap_start, p1_found, split_chunks, split_text
from pyspark.sql import functions as F

TEXT = "".join(f"def f{i}(a):\n    x = a + {i}\n    return x\n\n" for i in range(120))


def covers(text, parts, limit, overlap):
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for a, b, _ in parts:
        assert 0 < b - a <= limit
    for (a, b, _), (c, d, _) in zip(parts, parts[1:]):
        assert a < c <= b < d and b - c <= overlap


def test_pieces_cut_at_blank_lines():
    parts = split_text(TEXT)
    covers(TEXT, parts, 1500, 150)
    assert {k for _, _, k in parts} == {"blank", "end"}
    assert all(b - c > 0 for (_, b, _), (c, _, _) in zip(parts, parts[1:]))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab ,\n\t;é", min_size=0, max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_any_text_is_covered(text, limit, overlap):
    parts = split_text(text, limit, overlap)
    if len(text) > limit:
        covers(text, parts, limit, overlap)
    else:
        assert parts == [(0, len(text), "end")]


def test_long_line_without_boundaries():
    covers("x" * 20000, split_text("x" * 20000), 1500, 150)


def test_split_is_least_cost():
    """Against all ways to cut a small text."""
    import itertools

    from codelode.llm.splitting import boundaries

    text = "aa\nbbbb\n\ncc\ndddddd\nee\n\nff\ngg\n"
    limit, overlap = 12, 3
    at, cost, _ = boundaries(text, limit)
    target = len(text) / -(-len(text) // (limit - overlap))

    def total(cuts):
        begin, prev, c = 0, 0, 0.0
        for e in cuts:
            if e - begin > limit:
                return float("inf")
            c += ((e - prev - target) / target) ** 2 + cost[list(at).index(e)] + 1
            begin, prev = overlap_start(at, e, overlap), e
        return c

    inner = [int(x) for x in at[:-1]]
    best = min(total([*c, len(text)]) for n in range(len(inner) + 1) for c in itertools.combinations(inner, n))
    assert total([b for _, b, _ in split_text(text, limit, overlap)]) == pytest.approx(best)


def test_chunks_table(spark):
    rows = [("p::5-9::1", "p", 5, None, "Class", TEXT[:4000]), ("p::5-9::1", "p", 5, None, "Class", TEXT[:4000]), ("q::7-9::2", "q", None, 0, None, TEXT[:1600]), ("r::1-2::3", "r", 1, 2, "code", "short"), ("s::1-2::4", "s", 1, 2, "code", None), (None, None, None, None, None, TEXT[:2000])]
    df = spark.createDataFrame(rows, "chunk_id string, file_path string, start_line int, end_line int, chunk_type string, text string").withColumn("piece", F.lit("clash"))
    out = split_chunks(df).orderBy("chunk_id", "piece").collect()
    first = [r for r in out if r.chunk_id == "p::5-9::1"]
    assert first[0].start_line == 5 and first[0].chunk_type == "class" and len(first) == first[0].n_pieces
    for r in first:
        assert r.text == TEXT[:4000][r.start_char : r.end_char]
        assert r.start_line == 5 + TEXT[: r.start_char].count("\n")
    assert [r for r in out if r.chunk_id == "q::7-9::2"][0].start_line == 7
    assert {r[0] for r in p1_found(df).collect()} == {"p::5-9::1", "q::7-9::2", None}
    assert split_chunks(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_plan_places_everything_once(hist):
    segments = plan_bins(hist, 50)
    used = {}
    for length, first, n, per, start in segments:
        for r in range(n):
            used.setdefault(start + r // per, []).append(length)
    assert all(sum(v) <= 50 for v in used.values())
    assert sorted(x for v in used.values() for x in v) == sorted(k for k, n in hist.items() for _ in range(n))
    for length in hist:
        ranks = sorted((f, n) for l, f, n, _, _ in segments if l == length)
        assert ranks[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ranks, ranks[1:]))
    # Best fit never leaves two bins that fit into one.
    rooms = sorted(sum(v) for v in used.values())
    assert len(rooms) < 2 or rooms[0] + rooms[1] > 50


def test_plan_does_not_grow_with_items():
    assert len(plan_bins({k: 10**9 for k in range(1, 1025)})) < 10_000


@pytest.mark.parametrize("cell", [3, 200_000])
def test_pack_table(spark, cell):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 5, 5, 9, 40, None])) for i in range(300)] + [(7, 5), (900, 10), (901, 20), (902, 33)]
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumn("piece", F.lit(1))
    out = pack(df, "doc_id", "n", 10, cell).collect()
    room, sizes = {}, {}
    for r in out:
        if r.container_id is not None:
            room[r.container_id] = room.get(r.container_id, 0) + r.piece_size
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.piece_size
    assert max(room.values()) <= 10
    want = {}
    for i, n in rows:
        want[i] = want.get(i, 0) + (n or 0)
    assert sizes == want
    cut = {r.doc_id for r in out if r.n_pieces > 1}
    assert cut == {i for i, n in rows if n and n > 10}
    assert window_report(pack(df, "doc_id", "n", 10, cell), 10).first().tokens == sum(want.values())
    assert pack(df.limit(0), "doc_id", "n").count() == 0


def test_tokens(spark):
    t = ["a b", "a_1,,b", "", None, "  \n  ", "naïve—café", "x" * 100_000, "日本 ½²"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in t], "text string").select(token_count(F.col("text"))).collect()]
    assert got == [2, 3, 0, 0, 0, 3, 1, 2]
