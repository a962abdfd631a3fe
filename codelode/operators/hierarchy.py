"""Parent-child links to full hierarchies: paths, depths, roots, descendants, cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codelode.operators.components import connected_components
from codelode.session import cut_lineage

TREE_SCHEMA = "node_id string, parent_id string, root_id string, depth int, path array<string>, n_parents int, cycle_id string, on_cycle boolean"
WHITE, GREY, BLACK = 0, 1, 2


def contains_links(graph_edges: DataFrame) -> DataFrame:
    """CONTAINS rows, type read without case and outer blanks, as distinct (parent, child)."""
    kind = F.upper(F.regexp_replace("edge_type", r"^\s+|\s+$", ""))
    e = graph_edges.where(kind == "CONTAINS").select(F.col("source_id").alias("parent"), F.col("target_id").alias("child"))
    return e.where("parent is not null and child is not null").distinct()


def walk_component(links: list[tuple[str, str]]) -> Iterator[tuple]:
    """Rows of TREE_SCHEMA for one component, by iterative depth-first search with colours.

    A grey node met again is a back edge; Tarjan's low links over the same walk
    give each cycle group its smallest id. Nodes on or beneath a cycle come out
    with ``cycle_id`` (one row per cycle above them) and no path; all other
    nodes get one path, through the smallest parent.
    """
    children: dict[str, list[str]] = {}
    parents: dict[str, list[str]] = {}
    for p, c in links:
        children.setdefault(p, []).append(c)
        parents.setdefault(c, []).append(p)
    nodes = sorted({*children, *parents}, key=lambda s: s.encode())
    colour = dict.fromkeys(nodes, WHITE)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    held: set[str] = set()
    cycles: dict[str, str] = {}
    for start in nodes:
        if colour[start] != WHITE:
            continue
        work = [(start, iter(children.get(start, ())))]
        colour[start] = GREY
        index[start] = low[start] = len(index)
        stack.append(start)
        held.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if colour[nxt] == WHITE:
                    colour[nxt] = GREY
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    held.add(nxt)
                    work.append((nxt, iter(children.get(nxt, ()))))
                    break
                if nxt in held:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                colour[node] = BLACK
                if work:
                    above = work[-1][0]
                    low[above] = min(low[above], low[node])
                if low[node] == index[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        held.discard(group[-1])
                    if len(group) > 1 or node in children.get(node, ()):
                        name = min(group, key=lambda s: s.encode())
                        for x in group:
                            cycles[x] = name
    beneath: dict[str, set[str]] = {}
    for name in sorted(set(cycles.values())):
        todo = [x for x, c in cycles.items() if c == name]
        seen = set(todo)
        while todo:
            x = todo.pop()
            beneath.setdefault(x, set()).add(name)
            fresh = [y for y in children.get(x, ()) if y not in seen]
            seen.update(fresh)
            todo.extend(fresh)
    for x, names in beneath.items():
        for name in sorted(names):
            yield x, None, None, None, None, len(parents.get(x, ())), name, cycles.get(x) == name
    first = {x: min(parents[x], key=lambda s: s.encode()) for x in parents if x not in beneath}
    tree: dict[str, list[str]] = {}
    for c, p in first.items():
        tree.setdefault(p, []).append(c)
    for root in nodes:
        if root in parents:
            continue
        todo2 = [(root, [root])]
        while todo2:
            x, path = todo2.pop()
            yield x, first.get(x), root, len(path) - 1, path, len(parents.get(x, ())), None, False
            todo2.extend((c, [*path, c]) for c in tree.get(x, ()))


def _walk_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in TREE_SCHEMA.split(", ")]
    out: list[tuple] = []
    held = 0

    def flush() -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).astype({"depth": "Int32", "n_parents": "Int32"})

    def components() -> Iterator[list[tuple[str, str]]]:
        key, links = None, []
        for pdf in batches:
            for comp, p, c in zip(pdf["component"], pdf["parent"], pdf["child"]):
                if comp != key and links:
                    yield links
                    links = []
                key = comp
                links.append((p, c))
        if links:
            yield links

    for links in components():
        for row in walk_component(links):
            out.append(row)
            held += len(row[4] or ()) + 1
            if held > 200_000:
                yield flush()
                out, held = [], 0
    if out:
        yield flush()


def _encode(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long codes for ids, and the links with both codes."""
    ids = links.select(F.col("parent").alias("id")).union(links.select(F.col("child").alias("id"))).distinct()
    ids = cut_lineage(ids.withColumn("code", F.monotonically_increasing_id()))
    coded = links.join(ids.select(F.col("id").alias("parent"), F.col("code").alias("a")), "parent").join(ids.select(F.col("id").alias("child"), F.col("code").alias("b")), "child")
    return ids, cut_lineage(coded)


def _roots(links: DataFrame) -> DataFrame:
    """``(node)``: parents that are never a child."""
    return links.select(F.col("parent").alias("node")).distinct().join(links.select(F.col("child").alias("node")), "node", "left_anti")


def _doubling(links: DataFrame, parents: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """TREE_SCHEMA rows where every child has one parent in ``links``, by doubling parent pointers.

    Nothing is co-located: each round joins unfinished nodes to the pointers of
    their current ancestor, so a component of any size takes log2(depth) rounds;
    nodes still unfinished after log2(number of nodes) rounds hang under a cycle.
    ``roots(node)`` are given where ``links`` are only some of the links: a root may have none left.
    """
    up = links.select(F.col("child").alias("node"), F.col("parent").alias("anc"))
    roots = _roots(links) if roots is None else roots
    base = cut_lineage(up.join(roots.select(F.col("node").alias("anc"), F.lit(True).alias("top")), "anc", "left").select("node", "anc", F.col("anc").alias("parent"), F.array("anc", "node").alias("path"), F.coalesce("top", F.lit(False)).alias("done"), F.least("node", "anc").alias("low")))
    total = base.count()
    cur, rounds, left = base, 0, base.where("not done").count()
    while left and (1 << rounds) <= 2 * total:
        jump = cur.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("path2"), F.col("done").alias("done2"), F.col("low").alias("low2"))
        moved = cur.where("not done").join(jump, "anc").select("node", F.col("anc2").alias("anc"), "parent", F.when(F.size("path") > 0, F.concat("path2", "path")).alias("path"), F.col("done2").alias("done"), F.least("low", "low2").alias("low"))
        cur = cut_lineage(cur.where("done").unionByName(moved))
        rounds += 1
        now = cur.where("not done").count()
        if now == left and (1 << rounds) > 64:
            # Paths under a cycle would keep doubling; from here on only pointers and minima move.
            cur = cut_lineage(cur.withColumn("path", F.when(F.col("done"), F.col("path")).otherwise(F.array().cast("array<string>"))))
        left = now
    looped = cur.where("not done")
    cyclic = looped.select("node", "parent", F.col("anc").alias("far")).join(looped.select(F.col("node").alias("far"), F.col("low").alias("cycle_id")), "far")
    on = looped.select(F.col("anc").alias("node")).distinct().withColumn("hit", F.lit(True))
    cyc = cyclic.join(on, "node", "left").select(F.col("node").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("root_id"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path"), F.lit(1).alias("n_parents"), "cycle_id", F.coalesce("hit", F.lit(False)).alias("on_cycle"))
    tree = cur.where("done").select(F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), F.element_at("path", 1).alias("root_id"), (F.size("path") - 1).alias("depth"), "path", F.lit(1).alias("n_parents"), F.lit(None).cast("string").alias("cycle_id"), F.lit(False).alias("on_cycle"))
    top = roots.select(F.col("node").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("node").alias("root_id"), F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(0).alias("n_parents"), F.lit(None).cast("string").alias("cycle_id"), F.lit(False).alias("on_cycle"))
    every = cyc.unionByName(tree).unionByName(top)
    if parents is None:
        return every
    return every.drop("n_parents").join(parents, "node_id", "left").withColumn("n_parents", F.coalesce("n_parents", F.lit(0)))


def _spread(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """All ``(label, node)`` that follow from ``pairs`` along ``links(parent, child)``; one round a step."""
    seen = fresh = cut_lineage(pairs.select("label", "node").distinct())
    while not fresh.isEmpty():
        step = fresh.join(links, fresh["node"] == links["parent"]).select("label", F.col("child").alias("node")).distinct()
        fresh = cut_lineage(step.join(seen, ["label", "node"], "left_anti"))
        seen = cut_lineage(seen.unionByName(fresh))
    return seen


def _trim(links: DataFrame, near: str, far: str) -> DataFrame:
    """Links left when nodes that never stand in ``far`` are taken away again and again."""
    while True:
        kept = cut_lineage(links.join(links.select(F.col(far).alias(near)).distinct(), near, "left_semi"))
        if kept.count() == links.count():
            return kept
        links = kept


def _rings(links: DataFrame) -> DataFrame:
    """``(label, node)``: nodes on cycles, labelled by the smallest id of their cycle group.

    Nodes take the smallest id that reaches them; those of a colour that reach the node they
    are named after form its group. What remains is coloured anew until nothing does.
    """
    out = None
    core = _trim(_trim(links, "parent", "child"), "child", "parent")
    while not core.isEmpty():
        nodes = core.select(F.col("parent").alias("node")).union(core.select("child")).distinct()
        colour = cut_lineage(nodes.select("node", F.col("node").alias("c")))
        while True:
            low = core.join(colour, core["parent"] == colour["node"]).groupBy(F.col("child").alias("node")).agg(F.min("c").alias("m"))
            new = cut_lineage(colour.join(low, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            colour, moved = new.select("node", "c"), not new.where("moved").isEmpty()
            if not moved:
                break
        p, c = colour.select(F.col("node").alias("parent"), F.col("c").alias("pc")), colour.select(F.col("node").alias("child"), F.col("c").alias("cc"))
        inside = cut_lineage(core.join(p, "parent").join(c, "child").where("pc = cc").select(F.col("child").alias("parent"), F.col("parent").alias("child"), "pc"))
        # Backwards from the namesake: a label stays within its colour, so one walk serves all.
        group = _spread(colour.where("node = c").select(F.col("c").alias("label"), "node"), inside.select("parent", "child"))
        # A namesake alone is a group only with a link to itself.
        size = group.groupBy("label").agg(F.count("*").alias("n"))
        selfish = core.where("parent = child").select(F.col("parent").alias("label")).distinct().withColumn("own", F.lit(True))
        real = group.join(size, "label").join(selfish, "label", "left").where("n > 1 or own").select("label", "node")
        out = real if out is None else out.unionByName(real)
        done = group.select("node")
        core = core.join(done.withColumnRenamed("node", "parent"), "parent", "left_anti").join(done.withColumnRenamed("node", "child"), "child", "left_anti")
        core = _trim(_trim(cut_lineage(core), "parent", "child"), "child", "parent")
    return out


def _many_parents(links: DataFrame) -> DataFrame:
    """TREE_SCHEMA rows of components too large to gather in which children have several parents.

    Cycle groups are found by colouring and spread to what lies beneath; the rest
    has no cycles, and its nodes go through their smallest parents by pointer doubling.
    Rounds grow with the longest chain of links, and nothing is gathered.
    """
    counts = links.groupBy(F.col("child").alias("node_id")).agg(F.count("*").cast("int").alias("n_parents"))
    # A root whose children all hang under cycles or go through a smaller parent has no link left, yet a row of its own.
    roots = cut_lineage(_roots(links))
    rings = _rings(links)
    if rings is None:
        return _doubling(links.groupBy("child").agg(F.min("parent").alias("parent")), counts, roots)
    rings = cut_lineage(rings)
    under = _spread(rings, links)
    on = rings.select(F.col("label"), "node", F.lit(True).alias("hit"))
    none = lambda kind: F.lit(None).cast(kind)
    looped_rows = under.join(on, ["label", "node"], "left").join(counts, under["node"] == counts["node_id"], "left").select("node_id", none("string").alias("parent_id"), none("string").alias("root_id"), none("int").alias("depth"), none("array<string>").alias("path"), "n_parents", F.col("label").alias("cycle_id"), F.coalesce("hit", F.lit(False)).alias("on_cycle"))
    bad = under.select("node").distinct()
    free = cut_lineage(links.join(bad.withColumnRenamed("node", "child"), "child", "left_anti"))
    return looped_rows.unionByName(_doubling(free.groupBy("child").agg(F.min("parent").alias("parent")), counts, roots))


def hierarchies(links: DataFrame, max_component_links: int = 200_000) -> DataFrame:
    """``links(parent, child)`` -> TREE_SCHEMA, one row per node (per cycle for looped nodes).

    Connected components are found first. Components of at most
    ``max_component_links`` links are co-located and walked depth first.
    Larger ones are never gathered: where their children have one parent each they
    go through pointer doubling, else through trimming and colouring.

    Null ends drop the link; repeated links count once; an empty table gives
    no rows; other columns are ignored. Ids compare by byte order.
    """
    links = links.select("parent", "child").where("parent is not null and child is not null").distinct()
    ids, coded = _encode(links)
    comp = cut_lineage(connected_components(coded.select("a", "b")))
    placed = coded.join(comp.withColumnRenamed("node", "a"), "a").select("component", "parent", "child")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    huge = cut_lineage(sizes.where(F.col("n") > max_component_links).select("component"))
    none = huge.isEmpty()
    small = placed if none else placed.join(huge, "component", "left_anti")
    rows = small.repartition("component").sortWithinPartitions("component").mapInPandas(_walk_batches, TREE_SCHEMA)
    if none:
        return rows
    large = cut_lineage(placed.join(huge, "component", "left_semi").select("parent", "child"))
    several = not large.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return rows.unionByName(_many_parents(large) if several else _doubling(large))


def descendants(tree: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(ancestor_id, node_id, distance) for every node not under a cycle, one row for each way from ancestor to node.

    Nodes on whose path every node has one parent have their ancestors on it. For the others
    the ways are counted up ``links(parent, child)``, of which ``tree`` was made, one round a step;
    without ``links`` a tree in which a node has several parents is refused when its rows are read.
    """
    nodes = tree.where("cycle_id is null and depth > 0").select("node_id", "depth", "path", "n_parents")
    if links is None:
        nodes = nodes.where(F.when(F.col("n_parents") > 1, F.raise_error(F.lit("descendants of a node with several parents need links")).cast("boolean")).otherwise(True))
        return _above(nodes)
    links = links.select("parent", "child").where("parent is not null and child is not null").distinct()
    if links.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _above(nodes)
    nodes, links = cut_lineage(nodes), cut_lineage(links)
    several = nodes.where("n_parents > 1").select(F.col("node_id").alias("at"))
    mixed = cut_lineage(nodes.select("node_id", F.explode("path").alias("at")).join(several, "at", "left_semi").select("node_id").distinct())
    up = links.select(F.col("child").alias("ancestor_id"), "parent")
    fresh = cut_lineage(mixed.select(F.col("node_id").alias("ancestor_id"), "node_id", F.lit(1).cast("long").alias("ways")))
    out = _above(nodes.join(mixed, "node_id", "left_anti"))
    distance = 0
    while True:
        distance += 1
        fresh = cut_lineage(fresh.join(up, "ancestor_id").groupBy(F.col("parent").alias("ancestor_id"), "node_id").agg(F.sum("ways").alias("ways")))
        if fresh.isEmpty():
            return out
        out = out.unionByName(fresh.select("ancestor_id", "node_id", F.lit(distance).alias("distance"), F.explode(F.sequence(F.lit(1).cast("long"), "ways"))).drop("col"))


def _above(nodes: DataFrame) -> DataFrame:
    """Descendant rows of nodes from their paths."""
    up = F.slice("path", 1, F.greatest(F.col("depth"), F.lit(0)))
    return nodes.select("node_id", "depth", F.posexplode(up).alias("at", "ancestor_id")).select("ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))


def looped(tree: DataFrame) -> DataFrame:
    """(cycle_id, node_id) of nodes on a cycle or beneath one."""
    return tree.where("cycle_id is not null").select("cycle_id", "node_id").distinct()
