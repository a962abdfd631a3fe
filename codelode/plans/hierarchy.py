"""Queries over the CONTAINS hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.operators.hierarchy import contains_links, descendants, hierarchies, looped


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchies(contains_links(spark.read.parquet(f"{d}/graph_edges.parquet")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return looped(_tree(spark, d))


def p5_tree(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d).where("cycle_id is null")
    return t.select("node_id", "parent_id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    links = contains_links(spark.read.parquet(f"{d}/graph_edges.parquet"))
    return descendants(hierarchies(links), links)


_LINKS = """links AS (SELECT DISTINCT source_id AS p, target_id AS c FROM graph_edges
  WHERE upper(trim(edge_type)) = 'CONTAINS' AND source_id IS NOT NULL AND target_id IS NOT NULL)"""

_REACH = f"""WITH RECURSIVE {_LINKS}, reach AS (SELECT p AS a, c AS b FROM links UNION SELECT r.a, l.c FROM reach r JOIN links l ON l.p = r.b),
ring AS (SELECT a AS node, min(b) AS cycle_id FROM (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) GROUP BY a)"""

_TREE = f"""WITH RECURSIVE {_LINKS}, tree AS (
  SELECT p AS node_id, CAST(NULL AS VARCHAR) AS parent_id, p AS root_id, 0 AS depth, p AS path FROM (SELECT DISTINCT p FROM links) WHERE p NOT IN (SELECT c FROM links)
  UNION ALL SELECT l.c, l.p, t.root_id, t.depth + 1, t.path || ' > ' || l.c FROM tree t JOIN links l ON l.p = t.node_id)"""

QUERIES = {"p5_found": p5_found, "p5_tree": p5_tree, "p5_descendants": p5_descendants}

ORACLE = {
    "p5_found": _REACH + " SELECT cycle_id, node AS node_id FROM ring UNION SELECT g.cycle_id, r.b FROM ring g JOIN reach r ON r.a = g.node",
    "p5_tree": _TREE + " SELECT * FROM tree",
    "p5_descendants": f"WITH RECURSIVE {_LINKS}, looped AS (SELECT p AS a, c AS b FROM links UNION SELECT r.a, l.c FROM looped r JOIN links l ON l.p = r.b), bad AS (SELECT a AS n FROM looped WHERE a = b UNION SELECT y.b FROM looped x JOIN looped y ON x.a = x.b AND y.a = x.a), d AS (SELECT p AS ancestor_id, c AS node_id, 1 AS distance FROM links WHERE c NOT IN (SELECT n FROM bad) UNION ALL SELECT l.p, d.node_id, d.distance + 1 FROM d JOIN links l ON l.c = d.ancestor_id) SELECT * FROM d",
}
