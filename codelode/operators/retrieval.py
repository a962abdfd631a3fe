"""Graph-expanded ranking: anchors by name, weighted hops, best score per node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from codelode.functions.text import lines, name_score, query_terms
from codelode.operators.graph import ABSTRACT, CodeGraph
from codelode.session import cut_lineage

# What a hop keeps of an anchor's score.
WEIGHTS = {"callee": 0.7, "callee2": 0.4, "caller": 0.6, "sibling": 0.4, "import": 0.2, "inherit": 0.5}
ANCHORS = 5
#: Chunks of the vector search that take part in a localisation.
VECTOR_HITS = 50


def anchors(graph: CodeGraph, query: str, k: int = ANCHORS) -> DataFrame:
    """The nodes whose names fit the query best, in order of score and insertion: ``(id, score, rank, ...)``."""
    terms = query_terms(query)
    score = name_score(terms, F.col("name"), F.col("node_type"), F.col("signature"), F.col("docstring"))
    t = graph.nodes.where(~F.col("node_type").isin(*ABSTRACT)).withColumn("score", score).where("score > 0")
    top = t.orderBy(F.desc("score"), "position", "id").limit(k)
    return top.select("id", "name", "node_type", "file_path", "score", "position", F.row_number().over(Window.orderBy(F.desc("score"), "position", "id")).alias("rank"))


def search(graph: CodeGraph, query: str, top_k: int | None = 10, depth: int = 2, callers: bool = True, callees: bool = True, siblings: bool = True) -> DataFrame:
    """``(id, score, source, depth)`` of anchors and what their hops reach, best first.

    A node keeps its best score, the first of equals; ties in the ranking go to the node
    that was reached first. There are at most five anchors, so each hop is a join of the
    edges with a handful of ids.
    """
    a = anchors(graph, query).select(F.col("id").alias("anchor"), "node_type", "file_path", F.col("score").alias("s"), "rank")
    parts = [a.select(F.col("anchor").alias("id"), F.col("s").alias("score"), F.lit("anchor").alias("source"), F.lit(0).alias("depth"), F.array(F.lit(0).cast("bigint"), F.col("rank").cast("bigint")).alias("arrival"))]

    def add(hop: DataFrame, source: str, weight: str, at: int, group: int, order: list) -> None:
        arrival = F.array(F.lit(1).cast("bigint"), F.col("rank").cast("bigint"), F.lit(group).cast("bigint"), *[c.cast("bigint") for c in order])
        parts.append(hop.select("id", (F.col("s") * WEIGHTS[weight]).alias("score"), F.lit(source).alias("source"), F.lit(at).alias("depth"), arrival.alias("arrival")))

    # Five anchors at most: every hop cuts the edges to theirs first and looks up only the nodes it reaches.
    a = cut_lineage(a)
    zero = F.lit(-1)
    near = a.withColumnRenamed("anchor", "id")
    end = lambda hop: hop.drop("id").withColumnRenamed("neighbour_id", "id")
    if callees:
        one = end(graph.hop(near.select("id", "s", "rank"), "CALLS", few=True))
        if depth >= 2:
            one = cut_lineage(one)
        add(one, "callee", "callee", 1, 0, [F.col("seq"), zero])
        if depth >= 2:
            two = end(graph.hop(one.select("id", "s", "rank", F.col("seq").alias("s1")), "CALLS"))
            add(two, "callee", "callee2", 2, 0, [F.col("s1"), F.col("seq")])
    if callers:
        add(end(graph.hop(near.select("id", "s", "rank"), "CALLS", False, few=True)), "caller", "caller", 1, 1, [F.col("seq")])
    if siblings:
        p = graph.hop(near.select("id", "s", "rank"), "CONTAINS", False, few=True).groupBy(F.col("id").alias("anchor"), "s", "rank").agg(F.min_by("neighbour_id", "seq").alias("id"))
        p = p.join(graph.by_type("class").select("id"), "id", "left_semi")  # one parent an anchor
        add(end(graph.hop(p, "CONTAINS", few=True)).where("id <> anchor"), "sibling", "sibling", 1, 2, [F.col("seq")])
    of_file = graph.nodes.select("id").join(F.broadcast(near.select(F.concat(F.lit("file::"), "file_path").alias("id"), "s", "rank")), "id")
    add(end(graph.hop(of_file, "IMPORTS", few=True)), "import", "import", 1, 3, [F.col("seq")])
    add(end(graph.hop(near.where("node_type = 'class'").select("id", "s", "rank"), "INHERITS", few=True)), "inherit", "inherit", 1, 4, [F.col("seq")])
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    # The best arrival wins the node's score, its first arrival the node's place among equals.
    best = every.groupBy("id").agg(F.max_by(F.struct("score", "source", "depth"), F.struct("score", F.transform("arrival", lambda v: -v))).alias("b"), F.min("arrival").alias("first"))
    ranked = best.select("id", "b.score", "b.source", "b.depth", "first").orderBy(F.desc("score"), "first", "id")
    return ranked if top_k is None else ranked.limit(top_k)


def snippets(nodes: DataFrame, files: DataFrame, max_lines: int = 30) -> DataFrame:
    """``(id, snippet)``: source lines of nodes that have a place in a file, at most ``max_lines``."""
    t = nodes.where("file_path <> '' and start_line > 0").select("id", "file_path", "start_line", "end_line")
    f = files.where("content is not null").select(F.col("path").alias("file_path"), lines(F.col("content")).alias("ls"))
    n = F.when(F.col("end_line") > 0, F.least(F.lit(max_lines), F.col("end_line") - F.col("start_line") + 1)).otherwise(F.lit(max_lines))
    return t.join(f, "file_path").select("id", F.array_join(F.slice("ls", F.col("start_line"), F.greatest(n, F.lit(0))), "\n").alias("snippet"))


def localize(files: DataFrame, graph: CodeGraph, query: str, k: int = 10, index: DataFrame | None = None) -> DataFrame:
    """``(file_path, score, sources, functions)``: files for a report by reciprocal rank fusion.

    Fused are line search, graph search and, if there is an index, vector search. Stands where a model
    would decide; every part is deterministic. All files of the searches are ranked; only the
    fused ranking is cut to ``k``. ``sources`` names the searches that found a file, ``functions`` its
    at most five best functions in the graph search.
    """
    from codelode.operators.search import code_search
    from codelode.operators.vectors import embed_text, top_k

    terms = query_terms(query)
    pattern = "|".join(t for t in ("".join(c for c in x if c.isalnum() or c == "_") for x in terms) if len(t) > 2)
    ranked = []

    def add(found: DataFrame, best: Column, source: str) -> None:
        place = F.row_number().over(Window.orderBy(F.desc("best"), "file_path"))
        ranked.append(found.groupBy("file_path").agg(best.alias("best")).select("file_path", F.lit(source).alias("source"), place.alias("r")))

    if pattern:
        add(code_search(files, pattern, is_regex=True, max_results=None).select(F.col("path").alias("file_path")), F.count("*"), "lines")
    reached = search(graph, query, None).join(graph.nodes.select("id", "name", "node_type", "file_path"), "id").where("file_path <> ''")
    add(reached, F.max("score"), "graph")
    if index is not None:
        add(top_k(index, embed_text(query), "chunk_id", VECTOR_HITS), F.max("similarity"), "vectors")
    every = ranked[0]
    for x in ranked[1:]:
        every = every.unionByName(x)
    fused = every.groupBy("file_path").agg(F.round(F.sum(1.0 / (60 + F.col("r"))), 9).alias("score"), F.sort_array(F.collect_set("source")).alias("sources")).orderBy(F.desc("score"), "file_path").limit(k)
    within = Window.partitionBy("file_path").orderBy(F.desc("score"), "name", "id")
    best = reached.where("node_type in ('function', 'method')").withColumn("n", F.row_number().over(within)).where("n <= 5")
    named = best.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda s: s["name"]).alias("functions"))
    return fused.join(named, "file_path", "left").select("file_path", "score", "sources", F.coalesce("functions", F.array().cast("array<string>")).alias("functions")).orderBy(F.desc("score"), "file_path")


def localization_result(instance_id: str, ranked: DataFrame, seconds: float, error: str | None = None) -> DataFrame:
    """One row ``(instance_id, predicted, functions, success, time, error)`` of a localisation."""
    rows = ranked.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "file_path", "functions"))).alias("z"))
    return rows.select(F.lit(instance_id).alias("instance_id"), F.transform("z", lambda x: x["file_path"]).alias("predicted"), F.flatten(F.transform("z", lambda x: x["functions"])).alias("functions"), (F.size("z") > 0).alias("success"), F.lit(float(seconds)).alias("time"), F.lit(error).cast("string").alias("error"))
