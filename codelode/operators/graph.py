"""The code property graph: lookups, neighbours, searches in breadth, subgraphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from codelode.session import cut_lineage, small

ABSTRACT = ("module", "symbol", "import")


@dataclass
class CodeGraph:
    """Two tables: ``nodes`` (one row per id, with ``position``) and ``edges`` (a multiset with ``seq``).

    Counts are over all edges; what follows edges sees only those whose two ends have nodes.
    """

    nodes: DataFrame
    edges: DataFrame

    def deduplicated(self) -> "CodeGraph":
        """Edges as a set, without those that lack a node: what a graph database would store."""
        e = self.solid().groupBy("source_id", "target_id", "edge_type").agg(F.min("seq").alias("seq"))
        return CodeGraph(self.nodes, e)

    def solid(self) -> DataFrame:
        """Edges with both ends among the nodes."""
        ids = self.nodes.select("id")
        return self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")

    def settled(self) -> "CodeGraph":
        """Both tables written to the checkpoint folder, for searches that read them many times."""
        return CodeGraph(cut_lineage(self.nodes), cut_lineage(self.edges))

    def hop(self, near: DataFrame, edge_type: str | None = None, outgoing: bool = True, few: bool = False) -> DataFrame:
        """``near(id, ...)`` -> its columns with ``neighbour_id``, ``edge_type`` and ``seq`` of each edge to a node.

        The edges are cut to those of ``near``, which is broadcast if it is small (or known to be: ``few``), before
        any node is looked up.
        """
        met = self._met(F.broadcast(near) if few else small(near), edge_type, outgoing)
        return met.join(self.nodes.select(F.col("id").alias("neighbour_id")), "neighbour_id", "left_semi")

    def _met(self, near: DataFrame, edge_type: str | None, outgoing: bool) -> DataFrame:
        """As ``hop``, whether or not the neighbour is a node."""
        here, there = ("source_id", "target_id") if outgoing else ("target_id", "source_id")
        e = self.edges if edge_type is None else self.edges.where(F.col("edge_type") == edge_type)
        return e.select(F.col(here).alias("id"), F.col(there).alias("neighbour_id"), "edge_type", "seq").join(near, "id")

    def stats(self) -> DataFrame:
        """``(kind, type, n)`` of nodes and edges by type, with totals (type ``*``)."""
        count = lambda t, c, kind: t.rollup(c).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.coalesce(c, F.lit("*")).alias("type"), "n")
        return count(self.nodes.where("node_type is not null"), "node_type", "node").unionByName(count(self.edges.where("edge_type is not null"), "edge_type", "edge"))

    def by_type(self, node_type: str) -> DataFrame:
        return self.nodes.where(F.col("node_type") == node_type)

    def by_name(self, name: str) -> DataFrame:
        return self.nodes.where(F.lower("name") == name.lower())

    @staticmethod
    def name_entries(log: DataFrame, name: str) -> DataFrame:
        """``(id, name, seq)`` of every insert of a node with the name, repeated ids as often as they were inserted."""
        return log.where("id is not null").where(F.lower("name") == name.lower()).select("id", "name", "seq")

    def resolved_bases(self) -> DataFrame:
        """``(id, base_id, seq)``: INHERITS edges with placeholder targets (``class::*::Name``) led to the classes of that name.

        Of a dotted name the last part counts. A target that is a node itself stays.
        """
        e = self.edges.where("edge_type = 'INHERITS'").select(F.col("source_id").alias("id"), "target_id", "seq").join(self.nodes.select("id"), "id", "left_semi")
        open_ = F.col("target_id").startswith("class::*::")
        name = F.regexp_extract("target_id", r"([^.:]+)$", 1)
        classes = self.by_type("class").select(F.col("id").alias("base_id"), F.col("name").alias("base"))
        led = e.where(open_).withColumn("base", name).join(classes, "base").where("base_id <> id").select("id", "base_id", "seq")
        solid = e.where(~open_).join(self.nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("id", F.col("target_id").alias("base_id"), "seq")
        return led.unionByName(solid)

    def by_id(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def neighbours(self, edge_type: str, outgoing: bool = True) -> DataFrame:
        """``(id, neighbour_id, neighbour_name, seq)`` along edges of a type, once per edge."""
        near, far = ("source_id", "target_id") if outgoing else ("target_id", "source_id")
        n = self.nodes.select(F.col("id").alias("neighbour_id"), F.col("name").alias("neighbour_name"))
        e = self.edges.where(F.col("edge_type") == edge_type).select(F.col(near).alias("id"), F.col(far).alias("neighbour_id"), "seq")
        return e.join(n, "neighbour_id").join(self.nodes.select("id"), "id", "left_semi").select("id", "neighbour_id", "neighbour_name", "seq")

    def callees(self) -> DataFrame:
        return self.neighbours("CALLS")

    def callers(self) -> DataFrame:
        return self.neighbours("CALLS", False)

    def imports(self) -> DataFrame:
        return self.neighbours("IMPORTS")

    def children(self) -> DataFrame:
        return self.neighbours("CONTAINS")

    def superclasses(self) -> DataFrame:
        return self.neighbours("INHERITS")

    def subclasses(self) -> DataFrame:
        return self.neighbours("INHERITS", False)

    def parents(self) -> DataFrame:
        """``(id, parent_id)``: the parent of the first CONTAINS edge."""
        p = self.neighbours("CONTAINS", False)
        return p.groupBy("id").agg(F.min_by("neighbour_id", "seq").alias("parent_id"))

    def callers_of(self, name: str) -> DataFrame:
        """``(id, caller_id)`` for the nodes of a name; a null caller where nobody calls."""
        found = self.by_name(name).select("id")
        return found.join(self.callers().select("id", F.col("neighbour_id").alias("caller_id")), "id", "left").distinct()

    def callees_of(self, name: str) -> DataFrame:
        found = self.by_name(name).select("id")
        return found.join(self.callees().select("id", F.col("neighbour_id").alias("callee_id")), "id", "left").distinct()

    def around(self, start: str, max_depth: int = 2) -> DataFrame:
        """``(id, depth, edge_type)``: every node within ``max_depth`` hops either way, at its least depth.

        The edge type is that of the hop that found the node first: nodes of a level in the order
        they were found, outgoing edges before incoming ones, then by ``seq``. The frontier is
        cut off the lineage at each level.
        """
        seen = self.by_id(start).select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("edge_type"), F.array().cast("array<bigint>").alias("found"))
        frontier = seen
        for depth in range(1, max_depth + 1):
            # The order within a level is that of the path of (way, seq) that led to a node.
            near = small(frontier.select("id", F.col("found").alias("before")))
            step = None
            for way, outgoing in enumerate((True, False)):
                part = self._met(near, None, outgoing).select(F.col("neighbour_id").alias("id"), "edge_type", F.concat("before", F.array(F.lit(way).cast("bigint"), "seq")).alias("found"))
                step = part if step is None else step.unionByName(part)
            new = step.groupBy("id").agg(F.min_by("edge_type", "found").alias("edge_type"), F.min("found").alias("found")).join(seen.select("id"), "id", "left_anti")
            new = new.join(self.nodes.select("id"), "id", "left_semi")
            frontier = cut_lineage(new.select("id", F.lit(depth).alias("depth"), "edge_type", "found"))
            seen = seen.unionByName(frontier)
        return seen.where("depth > 0").select("id", "depth", "edge_type")

    def paths_around(self, start: str, max_depth: int = 2) -> DataFrame:
        """``(id, depth, edge_type)`` over all walks of at most ``max_depth`` different edges; the type is the first hop's."""
        walk = self.by_id(start).select(F.col("id").alias("a"), F.lit(None).cast("string").alias("first"), F.array().cast("array<bigint>").alias("used"))
        out = None
        for depth in range(1, max_depth + 1):
            # Parallel edges of a type are one; only those of the places reached so far are looked at.
            here = cut_lineage(walk.select(F.col("a").alias("id")).distinct())
            one = lambda hop: hop.groupBy("id", "neighbour_id", "edge_type").agg(F.min("seq").alias("seq"))
            both = one(self.hop(here)).unionByName(one(self.hop(here, None, False).where("id <> neighbour_id")))
            # An edge met from both ends has one number whichever way it is walked.
            walk = both.withColumnRenamed("id", "a").join(walk, "a").where(~F.array_contains("used", F.col("seq"))).select(F.col("neighbour_id").alias("a"), F.coalesce("first", "edge_type").alias("first"), F.concat("used", F.array("seq")).alias("used"))
            walk = cut_lineage(walk)
            part = walk.where(F.col("a") != start).select(F.col("a").alias("id"), F.lit(depth).alias("depth"), F.col("first").alias("edge_type"))
            out = part if out is None else out.union(part)
        return out.distinct()

    def of_types(self, node_types: list[str] | None = None) -> "CodeGraph":
        """The nodes of some kinds and the edges among them; all without any."""
        return self.induced(self.nodes.where(F.col("node_type").isin(node_types)).select("id")) if node_types else self

    def focus(self, file: str) -> "CodeGraph":
        """Nodes of files whose path contains ``file``, their direct neighbours, and the edges among them."""
        seeds = self.nodes.where(F.contains("file_path", F.lit(file))).select("id")
        solid = self.solid()
        out = solid.join(seeds.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
        into = solid.join(seeds.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id"))
        return self.induced(seeds.union(out).union(into).distinct())

    def induced(self, ids: DataFrame) -> "CodeGraph":
        e = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        return CodeGraph(self.nodes.join(ids, "id", "left_semi"), e)

    def sample(self, max_nodes: int = 200, node_types: list[str] | None = None) -> DataFrame:
        """The nodes to draw: by kind, files first, then in order of insertion; of some kinds only, if given."""
        rank = F.when(F.col("node_type") == "file", 0).when(F.col("node_type") == "class", 1).when(F.col("node_type") == "method", 2).when(F.col("node_type") == "function", 3).otherwise(4)
        chosen = self.nodes.where(F.col("node_type").isin(node_types)) if node_types else self.nodes
        return chosen.orderBy(rank, "position", "id").limit(max_nodes)

    def simple_edges(self) -> DataFrame:
        """Parallel edges as one; the last type stands."""
        return self.edges.groupBy("source_id", "target_id").agg(F.max_by("edge_type", F.struct("seq", "edge_type")).alias("edge_type"))

    def save(self, path: str) -> None:
        """Nodes, and edges partitioned by type."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")

    @staticmethod
    def load(spark, path: str) -> "CodeGraph":
        return CodeGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    def register(self, prefix: str = "graph_current") -> None:
        """Views for SQL in place of a graph query language."""
        self.nodes.createOrReplaceTempView(f"{prefix}_nodes")
        self.edges.createOrReplaceTempView(f"{prefix}_edges")


def containing_class(nodes: DataFrame) -> DataFrame:
    """``(id, class_id)``: for each function or method the class of its file that starts last before it.

    An as-of join without pairs: classes and functions of a file are sorted together once and the
    last class is carried down.
    """
    t = nodes.where("file_path <> '' and node_type in ('class', 'function', 'method')")
    w = Window.partitionBy("file_path").orderBy("start_line", F.when(F.col("node_type") == "class", 0).otherwise(1), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("class_id", F.last(F.when(F.col("node_type") == "class", F.col("id")), ignorenulls=True).over(w))
    return t.where("node_type <> 'class'").select("id", "class_id")


def resolve_calls(calls: DataFrame, functions: DataFrame, imported: DataFrame | None, per_caller: int = 10, per_call: int = 3) -> DataFrame:
    """``(caller_id, callee_id, ord, k)``: calls by name to functions.

    ``calls(caller_id, file_path, callee, ord)``, ``functions(id, name, file_path, position)`` and
    ``imported(file_path, name)``. A name is looked up in the caller's own file; failing
    that, and if the file imports it (or ``imported`` is None), among all functions, of which the first ``per_call`` count. A
    caller keeps its first ``per_caller`` edges.
    """
    f = functions.select(F.col("id").alias("callee_id"), F.col("name").alias("callee"), F.col("file_path").alias("f_path"), "position")
    own = calls.join(f.withColumnRenamed("f_path", "file_path"), ["file_path", "callee"]).where("callee_id <> caller_id")
    open_ = calls.join(own.select("caller_id", "ord").distinct(), ["caller_id", "ord"], "left_anti")
    if imported is not None:
        open_ = open_.join(imported.select("file_path", F.col("name").alias("callee")).distinct(), ["file_path", "callee"], "left_semi")
    # The first functions of a name, one more than asked since a caller skips itself: a bounded list per name.
    few = Window.partitionBy("callee").orderBy("position", "callee_id")
    first = f.select("callee", "callee_id", "position").withColumn("rn", F.row_number().over(few)).where(F.col("rn") <= per_call + 1).drop("rn")
    far = open_.join(first, "callee").where("callee_id <> caller_id")
    w = Window.partitionBy("caller_id", "ord").orderBy("position", "callee_id")
    far = far.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_call).drop("rn")
    cols = ["caller_id", "callee_id", "ord", "position"]
    both = own.select(cols).unionByName(far.select(cols))
    w = Window.partitionBy("caller_id").orderBy("ord", "position", "callee_id")
    return both.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_caller).drop("position")
