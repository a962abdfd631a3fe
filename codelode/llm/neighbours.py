"""The k most similar vectors of every vector, through a hierarchical k-means tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from codelode.session import cut_lineage

DIM, K = 64, 5
#: Similarity is compared as an integer of this many parts.
PARTS = 1_000_000
#: Similarities held at once by a task.
CELLS = 4_000_000
#: Children of a node that are looked at together.
WIDTH = 16
#: Visitors of a group that are held at once.
VISITORS = 30_000


@dataclass(frozen=True)
class TreeParams:
    """Documented bounds of the index; every row is indexed whatever they are."""

    sample_rows: int = 40_000  # rows the tree is fitted on, on the driver (64 floats each)
    leaf_rows: int = 1_600  # rows of the whole table a leaf should hold
    least_sample_in_leaf: int = 8  # leaves stop splitting at this many sample rows
    branches: int = 64  # children of a node
    target_recall: float = 0.985  # calibrated on queries from the sample
    queries: int = 400  # sample rows used for calibration
    most_visits: int = 24  # leaves tried first in calibration; doubled up to all leaves while recall stays below the target
    block_rows: int = 4_000  # a task holds at most about 32 times as many members of a region


class Tree:
    """Centroids of a hierarchical k-means tree; node 0 is the root."""

    def __init__(self) -> None:
        self.children: list[list[int]] = [[]]
        self.centres: list[np.ndarray] = [np.zeros(DIM, np.float32)]
        self.leaf_of: dict[int, int] = {}
        self.sampled: list[int] = []

    @property
    def leaves(self) -> int:
        return len(self.leaf_of)

    def freeze(self) -> "Tree":
        n = len(self.children)
        self.packed = np.stack(self.centres)
        self.leaf_at = np.full(n, -1, dtype=np.int32)
        self.leaf_at[list(self.leaf_of)] = list(self.leaf_of.values())
        inner = [i for i, cs in enumerate(self.children) if cs]
        self.inner_at = np.full(n, -1, dtype=np.int32)
        self.inner_at[inner] = np.arange(len(inner))
        # Children of the inner nodes in parts of WIDTH; places beyond them name a node that is never near.
        parts = [self.children[node][lo : lo + WIDTH] for node in inner for lo in range(0, len(self.children[node]), WIDTH)]
        self.kids = np.array([cs + [n] * (WIDTH - len(cs)) for cs in parts], dtype=np.int32).reshape(-1, WIDTH)
        self.parts = np.array([-(-len(self.children[node]) // WIDTH) for node in inner], dtype=np.int64)
        self.first_part = np.cumsum(self.parts) - self.parts
        return self

    def regions(self, rows: float) -> np.ndarray:
        """The region of each leaf: leaves that follow each other in the tree, of about ``rows`` sample rows together."""
        size = np.asarray(self.sampled, dtype=np.float64)
        return ((np.cumsum(size) - size / 2) // max(rows, 1)).astype(np.int32)

    def visit(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """Best-bin-first: for each row of ``x`` the leaves met first, best first (-1: none left).

        The queue of a row holds nodes by the similarity of their centre; the best is
        taken, and either it is a leaf, which counts as visited, or its children enter.
        Rows take their steps together, as many rows as ``CELLS`` allows, so memory does not follow
        the size of the tree or of the batch.
        """
        out = np.full((len(x), leaves), -1, dtype=np.int32)
        if not len(self.kids):
            out[:, 0] = 0
            return out
        step = max(1, min(256, CELLS // len(self.packed), CELLS // (WIDTH * min(len(self.kids), 2 * leaves + 64))))
        for lo in range(0, len(x), step):
            self._visit(x[lo : lo + step], out[lo : lo + step])
        return out

    def _visit(self, x: np.ndarray, out: np.ndarray) -> None:
        n, leaves = out.shape
        near = np.full((n, len(self.packed) + 1), -np.inf, dtype=np.float32)
        near[:, :-1] = x @ self.packed.T
        # A queue has a slot for each part of an inner node taken, with the similarities of the children that are still to be taken.
        slots = min(len(self.kids), 2 * leaves + 64)
        queue = np.full((n, slots, WIDTH), -np.inf, dtype=np.float32)
        best = np.full((n, slots), -np.inf, dtype=np.float32)
        of = np.zeros((n, slots), dtype=np.int32)
        used, got, rows = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.arange(n)

        def enter(r: np.ndarray, part: np.ndarray) -> None:
            at = used[r]
            queue[r, at] = fresh = near[r[:, None], self.kids[part]]
            best[r, at] = fresh.max(1)
            of[r, at] = part
            used[r] += 1

        for part in range(self.parts[0]):
            enter(rows, np.full(n, part))
        while True:
            slot = best[rows, : used.max()].argmax(1)
            some = best[rows, slot] > -np.inf
            rows, slot = rows[some], slot[some]
            if not len(rows):
                return
            place = queue[rows, slot].argmax(1)
            node = self.kids[of[rows, slot], place]
            queue[rows, slot, place] = -np.inf
            best[rows, slot] = queue[rows, slot].max(1)
            leaf = self.leaf_at[node]
            done = leaf >= 0
            r = rows[done]
            out[r, got[r]] = leaf[done]
            got[r] += 1
            r = rows[~done]
            if len(r):
                inner = self.inner_at[node[~done]]
                parts = self.parts[inner]
                if (used[r] + parts).max() > slots:
                    if n > 1 and 2 * n * slots * WIDTH > CELLS:
                        out[:] = -1
                        self._visit(x[: n // 2], out[: n // 2])
                        self._visit(x[n // 2 :], out[n // 2 :])
                        return
                    more = min(len(self.kids), 2 * slots) - slots
                    slots += more
                    queue = np.concatenate([queue, np.full((n, more, WIDTH), -np.inf, dtype=np.float32)], 1)
                    best = np.concatenate([best, np.full((n, more), -np.inf, dtype=np.float32)], 1)
                    of = np.concatenate([of, np.zeros((n, more), dtype=np.int32)], 1)
                for part in range(parts.max()):
                    some = parts > part
                    enter(r[some], self.first_part[inner[some]] + part)
            rows = rows[got[rows] < leaves]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Labels of spherical k-means; empty clusters are dropped."""
    c = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        label = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, label, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return np.unique((x @ c.T).argmax(1), return_inverse=True)[1]


def fit_tree(x: np.ndarray, total: int, p: TreeParams) -> Tree:
    """A tree over normalised sample rows ``x`` that stand for ``total`` rows."""
    rng = np.random.default_rng(7)
    tree = Tree()
    leaf_size = max(p.least_sample_in_leaf, p.leaf_rows * len(x) / max(total, 1))
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        k = min(p.branches, int(np.ceil(len(rows) / leaf_size)))
        label = _kmeans(x[rows], k, rng) if k > 1 else np.zeros(len(rows), np.int64)
        if label.size == 0 or label.max() == 0:
            tree.leaf_of[node] = len(tree.leaf_of)
            tree.sampled.append(len(rows))
            continue
        for j in range(int(label.max()) + 1):
            own = rows[label == j]
            centre = x[own].sum(0)
            tree.children.append([])
            tree.centres.append((centre / max(np.linalg.norm(centre), 1e-12)).astype(np.float32))
            tree.children[node].append(len(tree.children) - 1)
            todo.append((len(tree.children) - 1, own))
    return tree.freeze()


def _queries(x: np.ndarray, p: TreeParams) -> np.ndarray:
    return np.linspace(0, len(x) - 1, min(p.queries, len(x))).astype(int)


def calibrate(tree: Tree, x: np.ndarray, k: int, p: TreeParams, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[int, float]:
    """Fewest leaf visits at which pairs of sample rows are found as often as asked, and that recall.

    A pair is found when either row visits the other's leaf, as in the join. Visits may grow to
    all leaves of the tree, where every pair is found. ``known`` has queries, the rows that are near them,
    and for each query the places of its k among those; else they are taken from the sample.
    """
    if tree.leaves < 2 or len(x) < 2:
        return 1, 1.0
    if known is None:
        q = _queries(x, p)
        sims = x[q] @ x.T
        sims[np.arange(len(q)), q] = -2
        needed, near = np.unique(np.argsort(-sims, axis=1)[:, :k], return_inverse=True)
        known = x[q], x[needed], near.reshape(len(q), -1)
    asked, answers, near = known
    most = min(p.most_visits, tree.leaves)
    while True:
        from_q, from_n = tree.visit(asked, most), tree.visit(answers, most)
        first = np.full(near.shape, most + 1)
        for i in range(len(asked)):
            for j, n in enumerate(near[i]):
                other = from_n[n]
                hits = np.flatnonzero(from_q[i] == other[0]), np.flatnonzero(other == from_q[i, 0])
                first[i, j] = min([most, *(int(h[0]) for h in hits if len(h))]) + 1
        for m in range(1, most + 1):
            recall = float((first <= m).mean())
            if recall >= p.target_recall:
                return m, recall
        if most == tree.leaves:
            return most, recall
        most = min(2 * most, tree.leaves)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column to a float32 matrix, without Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, DIM)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """``(seq, embedding)`` of rows whose vector has ``dim`` finite components, not all zero."""
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return chunks.where("seq is not null").where((F.size(e) == dim) & ~bad & F.exists(e, lambda v: v != 0)).select("seq", "embedding")


class Best:
    """The k most similar others of each row of ``x``, among the rows it has met; ties to the smaller id.

    Single precision picks all pairs that may be among the best, double precision ranks those.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.norm = np.concatenate([np.linalg.norm(x[lo : lo + 10_000].astype(np.float64), axis=1, keepdims=True) for lo in range(0, max(len(x), 1), 10_000)])
        self.near = np.full((len(ids), k), -1, dtype=np.int64)
        self.sim = np.full((len(ids), k), -9 * PARTS, dtype=np.int32)
        #: What a pair needs to be looked at; none while a row has met fewer than k.
        self.limit = np.full(len(ids), -np.inf, dtype=np.float32)

    def unit(self, rows: np.ndarray) -> np.ndarray:
        return self.x[rows].astype(np.float64) / self.norm[rows]

    def meet(self, asking: np.ndarray, others: "Best", answering: np.ndarray, both: bool = False) -> None:
        """Rows ``asking`` meet the rows ``answering`` of ``others``, and with ``both`` the other way round too; a row does not meet itself."""
        m = others.unit(answering).astype(np.float32).T
        step = max(1, CELLS // max(len(answering), 1))
        for lo in range(0, len(asking), step):
            a = asking[lo : lo + step]
            sims = self.unit(a).astype(np.float32) @ m
            if others is self:
                at = np.minimum(np.searchsorted(answering, a), len(answering) - 1)
                own = np.flatnonzero(answering[at] == a)
                sims[own, at[own]] = -9
            r, c = np.divmod(np.flatnonzero(sims >= self._least(a, sims)[:, None]), len(answering))
            self._merge(a, r, others, answering, c)
            if both:
                r, c = np.divmod(np.flatnonzero(sims >= others._least(answering, sims.T)), len(answering))
                others._merge(answering, c, self, a, r)

    def _least(self, asking: np.ndarray, sims: np.ndarray) -> np.ndarray:
        k, n = self.k, sims.shape[1]
        least = np.maximum(self.limit[asking], np.float32(-2))
        first = np.flatnonzero(np.isneginf(self.limit[asking]))
        if n > k and len(first):
            least[first] = np.maximum(np.partition(sims[first], n - k, axis=1)[:, n - k] - np.float32(4e-6), -2)
        return least

    def _merge(self, asking: np.ndarray, at: np.ndarray, others: "Best", answering: np.ndarray, of: np.ndarray) -> None:
        for lo in range(0, len(at), 50_000):
            self._merge_part(asking[at[lo : lo + 50_000]], others, answering[of[lo : lo + 50_000]])

    def _merge_part(self, r: np.ndarray, others: "Best", c: np.ndarray) -> None:
        exact = np.rint(np.einsum("ij,ij->i", self.unit(r), others.unit(c)) * PARTS).astype(np.int32)
        own, at = np.unique(r, return_inverse=True)
        row = np.concatenate([at, np.repeat(np.arange(len(own)), self.k)])
        near = np.concatenate([others.ids[c], self.near[own].ravel()])
        sim = np.concatenate([exact, self.sim[own].ravel()])
        order = np.lexsort((near, -sim, row))
        row, near, sim = row[order], near[order], sim[order]
        # A pair may be met twice, with the same similarity.
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (near[1:] != near[:-1])]) & (near >= 0)
        row, near, sim = row[fresh], near[fresh], sim[fresh]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.near[own[row[keep]], place[keep]] = near[keep]
        self.sim[own[row[keep]], place[keep]] = sim[keep]
        full = own[self.near[own, -1] >= 0]
        self.limit[full] = self.sim[full, -1] / PARTS - 5e-6


PARTIAL = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.int64())), ("sim", pa.list_(pa.int32()))])


def _emit(ids: np.ndarray, near: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    off = pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32))
    return pa.record_batch([pa.array(ids), pa.ListArray.from_arrays(off, pa.array(near.ravel())), pa.ListArray.from_arrays(off, pa.array(sim.ravel()))], schema=PARTIAL)


def _segments(keys: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where each key of a sorted array begins and ends."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return {int(keys[lo]): (int(lo), int(hi)) for lo, hi in zip([0, *cuts], [*cuts, len(keys)])} if len(keys) else {}


def _compare(k: int):
    """Rows sorted by group -> partial answers of each group's members and visitors, leaf by leaf."""

    class Group:
        """The members of a group; they come before the visitors, which pass by in parts."""

        def __init__(self, ids: np.ndarray, x: np.ndarray, role: np.ndarray, home: np.ndarray, many: np.ndarray, leaves: np.ndarray) -> None:
            self.best = Best(ids, x, k)
            self.members = np.argsort(home, kind="stable")
            self.held = _segments(home[self.members])
            row, leaves = np.repeat(np.arange(len(ids)), many), leaves
            asks = (role[row] & 2) > 0
            row, leaves = row[asks], leaves[asks]
            at_home = home[row] == leaves
            for m, v in self._met(row[at_home], leaves[at_home]):
                self.best.meet(v, self.best, m)
            # Members also meet the visitors that are not members themselves.
            for m, v in self._met(row[~at_home], leaves[~at_home]):
                self.best.meet(v, self.best, m, both=True)

        def _met(self, row: np.ndarray, leaves: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            order = np.argsort(leaves, kind="stable")
            row = row[order]
            for leaf, (lo, hi) in _segments(leaves[order]).items():
                if leaf in self.held:
                    yield self.members[slice(*self.held[leaf])], row[lo:hi]

        def visited(self, ids: np.ndarray, x: np.ndarray, role: np.ndarray, home: np.ndarray, many: np.ndarray, leaves: np.ndarray) -> Best:
            guests = Best(ids, x, k)
            for m, v in self._met(np.repeat(np.arange(len(ids)), many), leaves):
                guests.meet(v, self.best, m, both=True)
            return guests

    def answers(best: Best) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(best.near[:, 0] >= 0)
        for lo in range(0, len(some), 20_000):
            at = some[lo : lo + 20_000]
            yield _emit(best.ids[at], best.near[at], best.sim[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: Group | None = None
        key = None

        def take() -> list[np.ndarray]:
            cols = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            return cols

        def settle() -> Iterator[pa.RecordBatch]:
            """What is held are the members of a group as long as there is none, else some of its visitors."""
            nonlocal group
            if held and group is None:
                group = Group(*take())
            elif held:
                yield from answers(group.visited(*take()))

        for b in batches:
            if not b.num_rows:
                continue
            keys, role = np.asarray(b.column("grp")), np.asarray(b.column("role"))
            ids, x, home = np.asarray(b.column("id")), _matrix(b.column("embedding")), np.asarray(b.column("home"))
            lists = b.column("leaves")
            many, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
            off = np.concatenate(([0], np.cumsum(many)))
            member = role & 1
            for lo, hi in _segments(2 * keys + (1 - member)).values():
                if key is not None and keys[lo] != key:
                    yield from settle()
                    if group is not None:
                        yield from answers(group.best)
                    group, key = None, None
                if key is None and not member[lo]:
                    continue  # visitors of no member
                key = keys[lo]
                if not member[lo] and group is None:
                    yield from settle()
                # Copies, so that no batch is kept whole for a few of its rows.
                held.append(tuple(c.copy() for c in (ids[lo:hi], x[lo:hi], role[lo:hi], home[lo:hi], many[lo:hi], flat[off[lo] : off[hi]])))
                if group is not None and sum(len(h[0]) for h in held) >= VISITORS:
                    yield from settle()
        yield from settle()
        if group is not None:
            yield from answers(group.best)

    return run


def _by_region(got: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves visited, by row and region: row, region and end of each run, and the leaves run by run."""
    row, col = np.nonzero(got >= 0)
    leaf = got[row, col]
    at = region[leaf]
    order = np.lexsort((leaf, at, row))
    row, at, leaf = row[order], at[order], leaf[order]
    last = np.flatnonzero(np.concatenate([(row[1:] != row[:-1]) | (at[1:] != at[:-1]), [True]])) if len(row) else np.zeros(0, np.int64)
    return row[last], at[last], last + 1, leaf


VISITED = pa.struct([("region", pa.int32()), ("leaves", pa.list_(pa.int32()))])


def _visits(tree_b, visits: int):
    schema = pa.schema([("id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("home", pa.int32()), ("visited", pa.list_(VISITED))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, region = tree_b.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2_000):
                b = whole.slice(lo, 2_000)
                e = b.column("embedding")
                got = tree.visit(unit(_matrix(e)).astype(np.float32), visits)
                row, at, end, leaf = _by_region(got, region)
                runs = pa.StructArray.from_arrays([pa.array(at), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], end)).astype(np.int32)), pa.array(leaf))], fields=list(VISITED))
                off = np.searchsorted(row, np.arange(len(got) + 1)).astype(np.int32)
                yield pa.record_batch([b.column("id"), e.cast(schema.field("embedding").type), pa.array(got[:, 0]), pa.ListArray.from_arrays(pa.array(off), runs)], schema=schema)

    return run


def neighbours(vectors: DataFrame, k: int = K, params: TreeParams = TreeParams()) -> DataFrame:
    """``vectors(seq long, embedding)`` -> ``(seq, near, sim)``: for each seq its k most similar others.

    ``sim`` is the cosine times PARTS, rounded; ties go to the smaller ``near``.
    Repeated rows count once. Equal vectors form a class that is searched once, through
    its smallest seq; that is exact, since only a class's k+1 smallest seqs can be among
    anyone's k best, and so a vector held by a third of all rows costs one search.

    The tree is fitted on a bounded sample, every row is placed in it, and each class
    visits as many leaves as calibration asked for. Leaves that follow each other in the tree make a region,
    which is compared with its visitors in one task, leaf by leaf: a vector travels once to a region,
    however many of its leaves it visits. Visitors pass by the members in parts. A leaf whose members are too many
    for a task (by the sample, of which it holds its share) is cut into blocks of members, and every visitor meets every block.
    """
    spark = vectors.sparkSession
    p = params
    classes = cut_lineage(vectors.groupBy("embedding").agg(F.min("seq").alias("id"), F.max("seq").alias("last")))
    total, = classes.agg(F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "seq long, near long, sim int")
    share = min(1.0, p.sample_rows / total)
    sample = classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id")).limit(p.sample_rows).select("id", "embedding").toArrow()
    x = unit(_matrix(sample.column("embedding"))).astype(np.float32) if sample.num_rows else np.zeros((0, DIM), np.float32)
    tree = fit_tree(x, total, p)
    visits, _ = calibrate(tree, x, k, p, _known(classes, sample.column("id").to_numpy(), x, k, p) if len(x) < total and len(x) > k else None)
    # A few regions for each core, so that all have work.
    scale = total / max(len(x), 1)
    most = 32 * p.block_rows
    region = tree.regions(min(0.75 * most, total / (6 * spark.sparkContext.defaultParallelism)) / scale)
    members = np.bincount(region, weights=tree.sampled, minlength=region[-1] + 1) * scale
    cut = {r: m for r, m in enumerate(np.ceil(members / most).astype(int).tolist()) if m > 1}
    tree_b = spark.sparkContext.broadcast((tree, region))
    placed = classes.select("id", "embedding").mapInArrow(_visits(tree_b, visits), "id long, embedding array<float>, home int, visited array<struct<region:int,leaves:array<int>>>")
    one = placed.select("id", "embedding", "home", F.explode("visited").alias("s")).select("id", "embedding", "home", "s.region", "s.leaves")
    # The leaf of a row is the first that it visits, so its region is among those visited.
    inside = F.array_contains("leaves", F.col("home"))
    if not cut:
        grouped = one.select("id", "embedding", "home", "leaves", F.when(inside, 3).otherwise(2).alias("role"), F.col("region").cast("long").alias("grp"))
    else:
        blocks = F.broadcast(spark.createDataFrame(sorted(cut.items()), "region int, mb int"))
        w = one.join(blocks, "region", "left").withColumn("mb", F.coalesce("mb", F.lit(1)))
        mine = F.pmod(F.xxhash64("id", F.lit(3)), F.col("mb"))
        w = w.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
        grouped = w.select("id", "embedding", "home", "leaves", F.when(inside & (F.col("block") == mine), 3).otherwise(2).alias("role"), (F.col("region").cast("long") * 100_000 + F.col("block")).alias("grp"))
    groups = len(members) + sum(cut.values()) - len(cut)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * groups, 5_000))
    partial = grouped.repartition(tasks, "grp").sortWithinPartitions("grp", F.desc("role")).mapInArrow(_compare(k), "id long, near array<long>, sim array<int>")
    best = _merge(partial, k)
    # Classes of equal vectors: members answer for themselves.
    many = classes.where("last > id")
    if many.isEmpty():
        return best.select(F.col("id").alias("seq"), "near", "sim")
    return _expand(vectors, many.select("embedding", "id"), cut_lineage(best), k)


def _known(classes: DataFrame, ids: np.ndarray, x: np.ndarray, k: int, p: TreeParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some of the sample rows, and their k most similar of the whole table, for ``calibrate``."""
    q = _queries(x, p)
    asked = classes.sparkSession.sparkContext.broadcast((ids[q], x[q]))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, v = asked.value
        sim, near = np.zeros((len(v), 0), np.float32), np.zeros((len(v), 0), np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 5_000):
                b = whole.slice(lo, 5_000)
                other = np.asarray(b.column("id"))
                sims = v @ unit(_matrix(b.column("embedding"))).astype(np.float32).T
                sims[own[:, None] == other] = -2
                best = np.argpartition(-sims, min(k, len(other)) - 1, axis=1)[:, :k]
                sim, near = np.concatenate([sim, np.take_along_axis(sims, best, 1)], 1), np.concatenate([near, other[best]], 1)
                best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                sim, near = np.take_along_axis(sim, best, 1), np.take_along_axis(near, best, 1)
        if sim.size:
            yield pa.record_batch([pa.array(np.repeat(np.arange(len(v)), sim.shape[1])), pa.array(near.ravel()), pa.array(sim.ravel())], names=["q", "id", "sim"])

    found = classes.select("id", "embedding").mapInArrow(nearest, "q long, id long, sim float").where("sim > -2")
    found = found.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))).where(F.col("rn") <= k).select("q", "id").toArrow().sort_by("q")
    rows = classes.join(F.broadcast(classes.sparkSession.createDataFrame(found.select(["id"]).group_by("id").aggregate([]))), "id", "left_semi").select("id", "embedding").toArrow().sort_by("id")
    at = np.searchsorted(rows.column("id").to_numpy(), found.column("id").to_numpy())
    return x[q], unit(_matrix(rows.column("embedding"))).astype(np.float32), at.reshape(len(q), -1)


def _merge(partial: DataFrame, k: int) -> DataFrame:
    """The k best of all partial answers, as (id, near, sim) rows."""
    zipped = partial.select("id", F.arrays_zip(F.transform("sim", lambda s: -s).alias("s"), F.col("near").alias("n")).alias("z"))
    # Regions and their blocks give at most a few arrays of k for one id.
    flat = zipped.groupBy("id").agg(F.flatten(F.collect_list("z")).alias("z"))
    best = F.slice(F.array_sort(F.array_distinct(F.filter("z", lambda s: s["n"] >= 0))), 1, k)
    return flat.select("id", F.explode(best).alias("b")).select("id", F.col("b.n").alias("near"), (-F.col("b.s")).alias("sim"))


def _expand(vectors: DataFrame, many: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Answers of classes to answers of rows; only classes of several rows move."""
    key = F.array(F.xxhash64("embedding"), F.xxhash64(F.lit(11), F.col("embedding")))
    named = many.select(key.alias("key"), "id")
    rows = cut_lineage(vectors.select("seq", key.alias("key")).join(named, "key").select("id", "seq").distinct())
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where(F.col("rn") <= k + 1).select("id", "seq")
    # Every answer that names a class stands for the class's first rows.
    others = best.join(first.select(F.col("id").alias("near"), F.col("seq").alias("alt")), "near", "left").select("id", F.coalesce("alt", "near").alias("near"), "sim")
    own = first.select("id", F.col("seq").alias("near"), F.lit(PARTS).alias("sim"))
    pool = others.unionByName(own)
    # A class's pool is cut to k+1 before its rows take it: each row skips itself at most.
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "near")
    pool = pool.distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1).drop("rn")
    named_rows = rows.select("id", "seq")
    alone = pool.join(named_rows.select("id").distinct(), "id", "left_anti").select(F.col("id").alias("seq"), "near", "sim")
    shared = pool.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), F.col("near").alias("n")))).alias("z"))
    mine = named_rows.join(shared, "id").select("seq", F.explode(F.slice(F.filter("z", lambda s: s["n"] != F.col("seq")), 1, k)).alias("b")).select("seq", F.col("b.n").alias("near"), (-F.col("b.s")).alias("sim"))
    alone = alone.withColumn("rn", F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("sim"), "near"))).where(F.col("rn") <= k).drop("rn")
    return alone.unionByName(mine)


def chunk_neighbours(chunks: DataFrame, k: int = K, params: TreeParams = TreeParams()) -> DataFrame:
    """``(seq, file_path, near, near_file_path, sim)`` for every chunk with a usable vector."""
    best = neighbours(usable(chunks), k, params)
    paths = chunks.where("seq is not null").groupBy("seq").agg(F.min("file_path").alias("file_path"))
    near = paths.select(F.col("seq").alias("near"), F.col("file_path").alias("near_file_path"))
    return best.join(paths, "seq").join(near, "near").select("seq", "file_path", "near", "near_file_path", (F.col("sim") / PARTS).alias("sim"))


def p3_found(chunks: DataFrame) -> DataFrame:
    """Pairs of which one is among the other's five most similar."""
    best = neighbours(usable(chunks))
    return best.select(F.least("seq", "near").alias("seq_a"), F.greatest("seq", "near").alias("seq_b")).distinct()
