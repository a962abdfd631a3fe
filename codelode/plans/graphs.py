"""Queries over the code graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.functions import text as T
from codelode.operators import extraction, retrieval
from codelode.operators.graph import CodeGraph, containing_class, resolve_calls
from codelode.sources import tables

#: What the search queries ask for, and where searches in breadth start.
QUESTION = "The registry should drain cached snapshot router handle"
NAME = "__init__"


def graph(spark: SparkSession, d: str) -> CodeGraph:
    return CodeGraph(tables.graph_nodes(spark, d), tables.graph_edges(spark, d))


def _start(g: CodeGraph) -> str:
    """The first method by place that calls something solid."""
    m = g.nodes.where("node_type in ('method', 'function')").select("id", "position")
    row = m.join(g.callees().select("id").distinct(), "id", "left_semi").orderBy("position", "id").first()
    return row["id"] if row else ""


def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    return tables.graph_nodes(spark, d).select("id", "name", "node_type", "file_path", "start_line", "end_line", "signature", "docstring", "seq", "position")


def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).deduplicated().edges.select("source_id", "target_id", "edge_type")


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).stats()


def nodes_by_name(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).by_name(NAME.upper()).select("id")


def nodes_by_type(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).by_type("class").select("id", "name")


def _pairs(df: DataFrame) -> DataFrame:
    return df.groupBy("id", "neighbour_id").agg(F.count("*").alias("n"))


def callees(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(graph(spark, d).callees())


def callers(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(graph(spark, d).callers())


def imports(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(graph(spark, d).imports())


def children(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(graph(spark, d).children())


def superclasses(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(graph(spark, d).superclasses())


def subclasses(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(graph(spark, d).subclasses())


def parent(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).parents()


def callees_2hop(spark: SparkSession, d: str) -> DataFrame:
    """Callees of callees; edges are counted before they are joined, so parallel edges do not multiply rows."""
    c = _pairs(graph(spark, d).callees())
    two = c.select("id", F.col("neighbour_id").alias("mid"), F.col("n").alias("n1")).join(c.select(F.col("id").alias("mid"), "neighbour_id", F.col("n").alias("n2")), "mid")
    return two.groupBy("id", "neighbour_id").agg(F.sum(F.col("n1") * F.col("n2")).cast("long").alias("n"))


def find_callers_outer(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).callers_of(NAME)


def find_callees_outer(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).callees_of(NAME)


def bfs_min_depth(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d).settled()
    return g.around(_start(g), 3).select("id", F.col("depth").cast("long"))


def bfs_paths_distinct(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d).settled()
    return g.paths_around(_start(g), 2).select("id", F.col("depth").cast("long"), "edge_type")


def subgraph_focus(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d).focus("cache")
    return g.edges.groupBy("source_id", "target_id", "edge_type").agg(F.count("*").alias("n"))


def priority_sample(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).sample(200).select("id", "node_type")


def simple_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).simple_edges()


def classes_by_methods(spark: SparkSession, d: str) -> DataFrame:
    """The ten classes with most methods."""
    g = graph(spark, d)
    m = g.children().join(g.by_type("class").select("id"), "id", "left_semi").join(g.by_type("method").select(F.col("id").alias("neighbour_id")), "neighbour_id", "left_semi")
    return m.groupBy("id").agg(F.countDistinct("neighbour_id").alias("methods")).orderBy(F.desc("methods"), "id").limit(10)


def asof_container(spark: SparkSession, d: str) -> DataFrame:
    return containing_class(tables.graph_nodes(spark, d))


def placeholder_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls to placeholders resolved by name."""
    g = graph(spark, d)
    functions = g.nodes.where("node_type in ('function', 'method')")
    calls = g.edges.where("edge_type = 'CALLS' and target_id like 'method::*::*.%'").groupBy("source_id", "target_id").agg(F.min("seq").alias("ord"))
    calls = calls.join(functions.select(F.col("id").alias("source_id"), "file_path"), "source_id").select(F.col("source_id").alias("caller_id"), "file_path", F.regexp_extract("target_id", r"^method::\*::\*\.(.*)$", 1).alias("callee"), "ord")
    names = g.nodes.select(F.col("id").alias("target_id"), "name")
    files = g.nodes.where("file_path <> ''").select(F.col("id").alias("source_id"), "file_path")
    imported = g.edges.where("edge_type = 'IMPORTS'").join(names, "target_id").join(files, "source_id").select("file_path", "name").distinct()
    return resolve_calls(calls, functions, imported).select("caller_id", "callee_id", "ord", F.col("k").cast("long"))


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    return tables.graph_nodes(spark, d).select("id", F.array_join(F.array_sort(T.tokens(F.col("name"))), " ").alias("terms"))


def name_scores(spark: SparkSession, d: str) -> DataFrame:
    n = tables.graph_nodes(spark, d)
    s = T.name_score(T.query_terms(QUESTION), F.col("name"), F.col("node_type"), F.col("signature"), F.col("docstring"))
    return n.select("id", F.round(s, 6).alias("score")).where("score > 0")


def anchors(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.anchors(graph(spark, d), QUESTION).select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def siblings(spark: SparkSession, d: str) -> DataFrame:
    """For each anchor the other members of its class."""
    g = graph(spark, d)
    a = retrieval.anchors(g, QUESTION).select("id").join(g.parents(), "id").join(g.by_type("class").select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    s = a.join(g.children().select(F.col("id").alias("parent_id"), F.col("neighbour_id").alias("sibling_id")), "parent_id").where("sibling_id <> id")
    return s.select("id", "sibling_id").distinct()


def graph_search(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of a question and what their hops reach, best first."""
    r = retrieval.search(graph(spark, d).settled(), QUESTION, 10)
    return r.select("id", F.round("score", 6).alias("score"), "source", F.col("depth").cast("long"))


def node_snippets(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.snippets(tables.graph_nodes(spark, d), tables.source_files(spark, d)).select("id", F.md5("snippet").alias("digest"), F.char_length("snippet").cast("long").alias("chars"))


def localized_files(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.localize(tables.source_files(spark, d), graph(spark, d), QUESTION)


def python_graph(spark: SparkSession, d: str) -> DataFrame:
    g = extraction.build_graph(tables.source_files(spark, d))
    return g.stats()


def java_graph(spark: SparkSession, d: str) -> DataFrame:
    g = extraction.build_graph(tables.source_files(spark, d), "java", strict_java=True, resolve_placeholders=True)
    return g.edges


def file_structures(spark: SparkSession, d: str) -> DataFrame:
    return extraction.python_structure(tables.source_files(spark, d))


def file_outlines(spark: SparkSession, d: str) -> DataFrame:
    return extraction.outline(extraction.python_structure(tables.source_files(spark, d)))


def function_sources(spark: SparkSession, d: str) -> DataFrame:
    f = tables.source_files(spark, d)
    name = extraction.python_structure(f).select(F.explode("functions.name").alias("n")).agg(F.min("n")).first()[0] or ""
    return extraction.function_source(f, extraction.python_structure(f), name)


QUERIES = {f.__name__: f for f in (node_upsert, edge_dedup, graph_stats, nodes_by_name, nodes_by_type, callees, callers, imports, children, superclasses, subclasses, parent, callees_2hop, find_callers_outer, find_callees_outer, bfs_min_depth, bfs_paths_distinct, subgraph_focus, priority_sample, simple_edges, classes_by_methods, asof_container, placeholder_calls, tokenize_terms, name_scores, anchors, siblings, graph_search, node_snippets, localized_files, python_graph, java_graph, file_structures, file_outlines, function_sources)}

NODES = """n AS (SELECT id, coalesce(arg_max_null(name, seq), '') AS name, coalesce(arg_max_null(node_type, seq), '') AS node_type, coalesce(arg_max_null(file_path, seq), '') AS file_path, coalesce(arg_max_null(start_line, seq), 0) AS start_line, coalesce(arg_max_null(end_line, seq), 0) AS end_line,
  coalesce(arg_max_null(signature, seq), '') AS signature, coalesce(arg_max_null(docstring, seq), '') AS docstring, max(seq) AS seq, min(seq) AS position FROM graph_nodes WHERE id IS NOT NULL GROUP BY id)"""
EDGES = r"e AS (SELECT DISTINCT source_id, target_id, upper(regexp_replace(edge_type, '^\s+|\s+$', '', 'g')) AS edge_type, seq FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"
SOLID = "s AS (SELECT e.* FROM e WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n))"
BASE = f"{NODES}, {EDGES}, {SOLID}"
PARENTS = "parents AS (SELECT target_id AS id, arg_min(source_id, seq) AS parent_id FROM s WHERE edge_type = 'CONTAINS' GROUP BY target_id)"
START = "start AS (SELECT id FROM n WHERE node_type IN ('method', 'function') AND id IN (SELECT source_id FROM s WHERE edge_type = 'CALLS') ORDER BY position, id LIMIT 1)"
BOTH = "both_ways AS (SELECT source_id AS a, target_id AS b FROM s UNION SELECT target_id, source_id FROM s)"


def _hop(kind: str, near: str, far: str) -> str:
    return f"WITH {BASE} SELECT {near} AS id, {far} AS neighbour_id, count(*) AS n FROM s WHERE edge_type = '{kind}' GROUP BY ALL"


def _tokens(c: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+'), lambda x: length(x) > 1), lambda x: lower(x)))"


_TERMS = "[" + ", ".join(f"'{t}'" for t in T.query_terms(QUESTION)) + "]"


def _share(c: str) -> str:
    return f"(len(list_intersect({_TERMS}, {_tokens(c)})) / CAST(len({_TERMS}) AS DOUBLE))"


SCORED = f"""scored AS (SELECT *, least(1.0, (CASE WHEN list_contains({_TERMS}, lower(name)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.5::DOUBLE * {_share('name')} + 0.3::DOUBLE * {_share('signature')} + 0.2::DOUBLE * {_share('left(docstring, 200)')})
  * CASE node_type WHEN 'method' THEN 1.1::DOUBLE WHEN 'class' THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END) AS score FROM n)"""
ANCHORS = f"{SCORED}, a AS (SELECT id AS anchor, node_type, file_path, score AS s, row_number() OVER (ORDER BY score DESC, position, id) AS rank FROM scored WHERE score > 0 AND node_type NOT IN ('module', 'symbol', 'import') ORDER BY score DESC, position, id LIMIT 5)"
CALLS = "calls AS (SELECT source_id, target_id, seq FROM s WHERE edge_type = 'CALLS')"
SEARCH = f"""WITH {BASE}, {PARENTS}, {ANCHORS}, {CALLS}, every AS (
  SELECT anchor AS id, s AS score, 'anchor' AS source, 0 AS depth, [0, rank] AS arrival FROM a
  UNION ALL SELECT target_id, a.s * 0.7::DOUBLE, 'callee', 1, [1, rank, 0, seq, -1] FROM a JOIN calls ON source_id = anchor
  UNION ALL SELECT c2.target_id, a.s * 0.4::DOUBLE, 'callee', 2, [1, rank, 0, c1.seq, c2.seq] FROM a JOIN calls c1 ON c1.source_id = anchor JOIN calls c2 ON c2.source_id = c1.target_id
  UNION ALL SELECT source_id, a.s * 0.6::DOUBLE, 'caller', 1, [1, rank, 1, seq] FROM a JOIN calls ON target_id = anchor
  UNION ALL SELECT target_id, a.s * 0.4::DOUBLE, 'sibling', 1, [1, rank, 2, s.seq] FROM a JOIN parents p ON p.id = anchor JOIN n c ON c.id = p.parent_id AND c.node_type = 'class' JOIN s ON s.source_id = p.parent_id AND s.edge_type = 'CONTAINS' WHERE target_id <> anchor
  UNION ALL SELECT target_id, a.s * 0.2::DOUBLE, 'import', 1, [1, rank, 3, s.seq] FROM a JOIN s ON source_id = 'file::' || a.file_path AND edge_type = 'IMPORTS'
  UNION ALL SELECT target_id, a.s * 0.5::DOUBLE, 'inherit', 1, [1, rank, 4, s.seq] FROM a JOIN s ON source_id = anchor AND edge_type = 'INHERITS' WHERE a.node_type = 'class'),
  best AS (SELECT *, min(arrival) OVER (PARTITION BY id) AS first FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, arrival) = 1)
  SELECT id, round(score, 6) AS score, source, CAST(depth AS BIGINT) AS depth FROM best ORDER BY best.score DESC, first, id LIMIT 10"""

ORACLE = {
    "node_upsert": f"WITH {NODES} SELECT * FROM n",
    "edge_dedup": f"WITH {BASE} SELECT DISTINCT source_id, target_id, edge_type FROM s",
    "graph_stats": f"WITH {BASE} SELECT 'node' AS kind, node_type AS type, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'node', '*', count(*) FROM n UNION ALL SELECT 'edge', edge_type, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'edge', '*', count(*) FROM e",
    "nodes_by_name": f"WITH {NODES} SELECT id FROM n WHERE lower(name) = '{NAME}'",
    "nodes_by_type": f"WITH {NODES} SELECT id, name FROM n WHERE node_type = 'class'",
    "callees": _hop("CALLS", "source_id", "target_id"),
    "callers": _hop("CALLS", "target_id", "source_id"),
    "imports": _hop("IMPORTS", "source_id", "target_id"),
    "children": _hop("CONTAINS", "source_id", "target_id"),
    "superclasses": _hop("INHERITS", "source_id", "target_id"),
    "subclasses": _hop("INHERITS", "target_id", "source_id"),
    "parent": f"WITH {BASE}, {PARENTS} SELECT * FROM parents",
    "callees_2hop": f"WITH {BASE}, {CALLS} SELECT a.source_id AS id, b.target_id AS neighbour_id, count(*) AS n FROM calls a JOIN calls b ON a.target_id = b.source_id GROUP BY ALL",
    "find_callers_outer": f"WITH {BASE}, {CALLS} SELECT DISTINCT n.id, calls.source_id AS caller_id FROM n LEFT JOIN calls ON calls.target_id = n.id WHERE lower(n.name) = '{NAME}'",
    "find_callees_outer": f"WITH {BASE}, {CALLS} SELECT DISTINCT n.id, calls.target_id AS callee_id FROM n LEFT JOIN calls ON calls.source_id = n.id WHERE lower(n.name) = '{NAME}'",
    "bfs_min_depth": f"WITH RECURSIVE {BASE}, {START}, {BOTH}, walk AS (SELECT id, 0 AS depth FROM start UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON a = id WHERE depth < 3) SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM walk WHERE id NOT IN (SELECT id FROM start) GROUP BY id",
    "bfs_paths_distinct": f"""WITH {BASE}, {START}, u AS (SELECT source_id, target_id, edge_type, min(seq) AS seq FROM s GROUP BY ALL), w AS (SELECT source_id AS a, target_id AS b, edge_type, seq FROM u UNION ALL SELECT target_id, source_id, edge_type, seq FROM u WHERE source_id <> target_id),
      one AS (SELECT w.* FROM w JOIN start ON a = id), two AS (SELECT w.b, one.edge_type FROM one JOIN w ON w.a = one.b WHERE w.seq <> one.seq)
      SELECT DISTINCT b AS id, CAST(1 AS BIGINT) AS depth, edge_type FROM one WHERE b NOT IN (SELECT id FROM start) UNION SELECT DISTINCT b, 2, edge_type FROM two WHERE b NOT IN (SELECT id FROM start)""",
    "subgraph_focus": f"WITH {BASE}, seed AS (SELECT id FROM n WHERE contains(file_path, 'cache')), ids AS (SELECT id FROM seed UNION SELECT target_id FROM s JOIN seed ON id = source_id UNION SELECT source_id FROM s JOIN seed ON id = target_id) SELECT source_id, target_id, edge_type, count(*) AS n FROM e WHERE source_id IN (SELECT id FROM ids) AND target_id IN (SELECT id FROM ids) GROUP BY ALL",
    "priority_sample": f"WITH {NODES} SELECT id, node_type FROM n ORDER BY coalesce(list_position(['file', 'class', 'method', 'function'], node_type), 5), position, id LIMIT 200",
    "simple_edges": f"WITH {EDGES} SELECT source_id, target_id, arg_max(edge_type, (seq, edge_type)) AS edge_type FROM e GROUP BY ALL",
    "classes_by_methods": f"WITH {BASE} SELECT c.id, count(DISTINCT m.id) AS methods FROM n c JOIN s ON s.source_id = c.id AND s.edge_type = 'CONTAINS' JOIN n m ON m.id = s.target_id AND m.node_type = 'method' WHERE c.node_type = 'class' GROUP BY c.id ORDER BY methods DESC, c.id LIMIT 10",
    "asof_container": f"WITH {NODES}, c AS (SELECT file_path, start_line, max(id) AS class_id FROM n WHERE node_type = 'class' AND file_path <> '' GROUP BY ALL), f AS (SELECT * FROM n WHERE node_type IN ('function', 'method') AND file_path <> '') SELECT f.id, c.class_id FROM f ASOF LEFT JOIN c ON f.file_path = c.file_path AND f.start_line >= c.start_line",
    "placeholder_calls": f"""WITH {BASE}, f AS (SELECT id, name, file_path, position FROM n WHERE node_type IN ('function', 'method')),
      c AS (SELECT e.source_id AS caller_id, f.file_path, regexp_extract(e.target_id, '^method::\\*::\\*\\.(.*)$', 1) AS callee, min(e.seq) AS ord FROM e JOIN f ON f.id = e.source_id WHERE e.edge_type = 'CALLS' AND starts_with(e.target_id, 'method::*::*.') GROUP BY ALL),
      own AS (SELECT caller_id, f.id AS callee_id, ord, position FROM c JOIN f ON f.file_path = c.file_path AND f.name = c.callee WHERE f.id <> caller_id),
      imp AS (SELECT DISTINCT a.file_path, b.name FROM e JOIN n a ON a.id = e.source_id AND a.file_path <> '' JOIN n b ON b.id = e.target_id WHERE e.edge_type = 'IMPORTS'),
      far AS (SELECT caller_id, f.id AS callee_id, ord, position FROM c JOIN f ON f.name = c.callee JOIN imp ON imp.file_path = c.file_path AND imp.name = c.callee WHERE f.id <> caller_id AND (caller_id, ord) NOT IN (SELECT (caller_id, ord) FROM own) QUALIFY row_number() OVER (PARTITION BY caller_id, ord ORDER BY position, f.id) <= 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY caller_id ORDER BY ord, position, callee_id) AS k FROM (SELECT * FROM own UNION ALL SELECT * FROM far)) SELECT caller_id, callee_id, ord, k FROM r WHERE k <= 10""",
    "tokenize_terms": f"WITH {NODES} SELECT id, array_to_string(list_sort({_tokens('name')}), ' ') AS terms FROM n",
    "name_scores": f"WITH {NODES}, {SCORED} SELECT id, round(score, 6) AS score FROM scored WHERE score > 0",
    "anchors": f"WITH {BASE}, {ANCHORS} SELECT anchor AS id, round(s, 6) AS score, rank FROM a",
    "siblings": f"WITH {BASE}, {PARENTS}, {ANCHORS} SELECT DISTINCT anchor AS id, s.target_id AS sibling_id FROM a JOIN parents p ON p.id = anchor JOIN n c ON c.id = p.parent_id AND c.node_type = 'class' JOIN s ON s.source_id = p.parent_id AND s.edge_type = 'CONTAINS' WHERE s.target_id <> anchor",
    "graph_search": SEARCH,
    "node_snippets": f"""WITH {NODES}, files AS (SELECT path, string_split(content, chr(10)) AS ls FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY ingested_at DESC NULLS LAST, content DESC NULLS LAST) = 1),
      t AS (SELECT id, array_to_string(list_slice(ls, start_line, start_line + (CASE WHEN end_line > 0 THEN least(30, end_line - start_line + 1) ELSE 30 END) - 1), chr(10)) AS x FROM n JOIN files ON path = file_path WHERE file_path <> '' AND start_line > 0) SELECT id, md5(coalesce(x, '')) AS digest, length(coalesce(x, '')) AS chars FROM t""",
}
