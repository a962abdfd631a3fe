"""Queries over extracted structure, raw logs and benchmark runs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from codelode.operators import benchmark, extraction
from codelode.operators.chunking import chunk_files
from codelode.operators.graph import CodeGraph, resolve_calls
from codelode.operators.vectors import build_index
from codelode.plans import corpus, graphs
from codelode.sources import files as S, tables


def _java(spark: SparkSession, d: str) -> CodeGraph:
    return extraction.build_graph(tables.source_files(spark, d), "java")


def java_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes by the default patterns."""
    return _java(spark, d).by_type("class").select("file_path", "name").distinct()


def java_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods and functions by the default patterns, control statements taken for methods included."""
    return _java(spark, d).nodes.where("node_type in ('method', 'function')").select("file_path", "name").distinct()


def java_imports(spark: SparkSession, d: str) -> DataFrame:
    e = _java(spark, d).edges.where("edge_type = 'IMPORTS'")
    return e.groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


def java_bases(spark: SparkSession, d: str) -> DataFrame:
    return _java(spark, d).edges.where("edge_type = 'INHERITS'").select("source_id", "target_id").distinct()


def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every file with text has chunks, and the text of each is that of its lines."""
    f = tables.source_files(spark, d)
    lines = f.select(F.col("path").alias("file_path"), F.split("content", "\n", -1).alias("ls"))
    c = chunk_files(f).join(lines, "file_path")
    own = F.array_join(F.slice("ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return c.groupBy("file_path").agg(F.min(F.when(F.col("text") == own, 1).otherwise(0)).cast("long").alias("agrees"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids in the index of files that are cut by lines."""
    return build_index(tables.source_files(spark, d).where(~F.col("path").endswith(".py"))).select("chunk_id", F.size("embedding").cast("long").alias("width"))


def outline_heads(spark: SparkSession, d: str) -> DataFrame:
    o = extraction.outline(extraction.python_structure(tables.source_files(spark, d)))
    return o.select("path", F.get(F.split("outline", "\n"), F.lit(0)).alias("head"))


def superclass_names(spark: SparkSession, d: str) -> DataFrame:
    """Base names of classes, solid or not."""
    g = graphs.graph(spark, d)
    e = g.edges.where("edge_type = 'INHERITS'").join(g.by_type("class").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return e.select(F.col("source_id").alias("id"), F.regexp_extract("target_id", r"([^.:]+)$", 1).alias("base")).distinct()


def resolved_superclasses(spark: SparkSession, d: str) -> DataFrame:
    return graphs.graph(spark, d).resolved_bases().groupBy("id", "base_id").agg(F.count("*").alias("n"))


def resolved_subclasses(spark: SparkSession, d: str) -> DataFrame:
    return graphs.graph(spark, d).resolved_bases().groupBy(F.col("base_id").alias("id")).agg(F.countDistinct("id").alias("subclasses"))


def placeholder_calls_anywhere(spark: SparkSession, d: str) -> DataFrame:
    """Calls to placeholders resolved by name among all functions, imported or not."""
    g = graphs.graph(spark, d)
    functions = g.nodes.where("node_type in ('function', 'method')")
    calls = g.edges.where("edge_type = 'CALLS' and target_id like 'method::*::*.%'").groupBy("source_id", "target_id").agg(F.min("seq").alias("ord"))
    calls = calls.join(functions.select(F.col("id").alias("source_id"), "file_path"), "source_id").select(F.col("source_id").alias("caller_id"), "file_path", F.regexp_extract("target_id", r"^method::\*::\*\.(.*)$", 1).alias("callee"), "ord")
    return resolve_calls(calls, functions, None).select("caller_id", "callee_id", "ord", F.col("k").cast("long"))


def name_log(spark: SparkSession, d: str) -> DataFrame:
    """All inserts of a name."""
    return CodeGraph.name_entries(tables.table(spark, d, "graph_nodes"), graphs.NAME.upper())


def nodes_of_types(spark: SparkSession, d: str) -> DataFrame:
    """The classes and methods, and the edges among them."""
    g = graphs.graph(spark, d).of_types(["class", "method"])
    return g.edges.groupBy("source_id", "target_id", "edge_type").agg(F.count("*").alias("n"))


def raw_commit_log(spark: SparkSession, d: str) -> DataFrame:
    """A raw log of all commits of a repository cut into records again, dates and all."""
    b = tables.bug_instances(spark, d)
    day = F.format_string("2024-0%s-1%s 0%s:00:00", F.length("repo") % 9 + 1, F.length("instance_id") % 9, F.length("instance_id") % 7)
    record = F.concat_ws("|", F.substring("base_commit", 1, 12), "repo", day, F.concat(F.lit("fix "), "instance_id"))
    one = F.concat(record, F.lit("\n\nsrc/"), "instance_id", F.lit(".py\nREADME.md\n"))
    raw = b.where("base_commit rlike '^[0-9a-f]{12}'").groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("instance_id", one.alias("r")))), lambda s: s["r"]), "\n").alias("raw"))
    c = S.commits(S.commit_stream(raw))
    return c.select("commit_hash", "author", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "message", F.array_join("files_changed", ";").alias("files"))


def blame_lines(spark: SparkSession, d: str) -> DataFrame:
    """Porcelain made of the lines of Go files, read back; of each file lines 2 to 40."""
    f = tables.source_files(spark, d).where("path like '%.go' and content is not null")
    t = f.select("path", F.posexplode(F.split("content", "\n", -1)).alias("i", "code"))
    block = F.array(F.concat(F.sha1(F.concat("path", F.floor(F.col("i") / 5).cast("string"))), F.lit(" 1 "), F.col("i").cast("string")), F.concat(F.lit("author a"), (F.col("i") % 3).cast("string")), F.concat(F.lit("\t"), "code"))
    raw = t.select("path", F.col("i").cast("long").alias("i"), F.posexplode(block).alias("j", "raw")).select("path", (F.col("i") * 3 + F.col("j")).alias("line_no"), "raw")
    return S.blame(raw, 2, 40).select("path", F.floor(F.col("line_no") / 3).alias("line_no"), "commit_hash", "author", F.md5("code").alias("code"))


def checkout_trees(spark: SparkSession, d: str) -> DataFrame:
    """Trees of projects and numbers with what is known of each."""
    f = tables.source_files(spark, d)
    number = F.length("path") % 4 + 1
    trees = S.checkouts(f.select(F.concat_ws("/", "repo", number.cast("string"), "path").alias("path")))
    info = trees.where("bug_id <> 2").select("project", "bug_id", F.lit("python_version").alias("key"), F.concat(F.lit("3."), F.col("bug_id").cast("string")).alias("value"))
    return S.with_metadata(trees, info).select("project", "bug_id", "n_files", F.col("metadata")["python_version"].alias("version"))


def directory_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree as text, directories first."""
    t = S.tree_text(S.directory_entries(tables.source_files(spark, d)))
    return t.select("text", F.row_number().over(Window.orderBy("place")).cast("long").alias("n"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    b = tables.bug_instances(spark, d)
    files = F.reverse(F.array_distinct(F.concat("buggy_files", F.array(F.concat("repo", F.lit("/other.py"))))))
    n = F.length("instance_id")
    return b.where(n % 7 != 0).select("instance_id", F.when(n % 5 != 0, files).alias("predicted"), (n / 4.0).alias("time"), (n % 3).cast("long").alias("llm_calls"), (n % 4).cast("long").alias("tool_calls"), F.when(n % 5 == 0, "failed").alias("error"))


def benchmark_totals(spark: SparkSession, d: str) -> DataFrame:
    e = benchmark.evaluate(tables.bug_instances(spark, d), _results(spark, d))
    return benchmark.totals(e, 2).withColumn("mean_time", F.round("mean_time", 9))


def benchmark_errors(spark: SparkSession, d: str) -> DataFrame:
    e = benchmark.evaluate(tables.bug_instances(spark, d), _results(spark, d))
    return e.select("instance_id", F.coalesce("error", F.lit("")).alias("error"), F.size("predicted").cast("long").alias("n_predicted"), "top1_hit")


def benchmark_preview(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.preview(tables.bug_instances(spark, d))


def keywords_extended(spark: SparkSession, d: str) -> DataFrame:
    b = tables.bug_instances(spark, d)
    before = b.select("instance_id", F.array("repo").alias("keywords"), F.col("buggy_files").alias("files"))
    answers = b.where(F.length("instance_id") % 2 == 0).select("instance_id", F.array("repo", "base_commit").alias("keywords"), F.array(F.lit("x.py")).alias("files"))
    t = benchmark.extended_keywords(before, answers)
    return t.select("instance_id", F.array_join("keywords", ";").alias("keywords"), F.array_join("files", ";").alias("files"))


def auto_language(spark: SparkSession, d: str) -> DataFrame:
    """What kind of graph is built where the language is told by the files."""
    f = tables.source_files(spark, d)
    return extraction.build_graph(f, "auto").by_type("file").select(F.col("id")).distinct()


QUERIES = {f.__name__: f for f in (java_classes, java_methods, java_imports, java_bases, chunk_texts, chunk_ids, outline_heads, superclass_names, resolved_superclasses, resolved_subclasses, placeholder_calls_anywhere, name_log, nodes_of_types, raw_commit_log, blame_lines, checkout_trees, directory_tree, benchmark_totals, benchmark_errors, benchmark_preview, keywords_extended, auto_language)}

_F, _B, _BASE = corpus.FILES, corpus.BUGS, graphs.BASE
_CLASS = r"(?m)" + extraction.JAVA_CLASS.pattern
_METHOD = r"(?m)" + extraction.JAVA_METHOD.pattern
_IMPORT = r"(?m)" + extraction.JAVA_IMPORT.pattern
_JAVA = f"{_F}, j AS (SELECT path, content FROM files WHERE path LIKE '%.java' AND content IS NOT NULL AND NOT list_has_any(list_slice(string_split(path, '/'), 1, -2), {S.GRAPH_SKIP_DIRS['.java']}))"
_SPANS = corpus.ORACLE["line_chunk_spans"].rsplit("SELECT path AS file_path", 1)[0]
_TREE = corpus.ORACLE["list_directory"]
_RESULTS = f"{_B}, r AS (SELECT instance_id, buggy_files, repo, length(instance_id) AS n FROM bugs)"

ORACLE = {
    "java_classes": f"WITH {_JAVA} SELECT DISTINCT path AS file_path, unnest(regexp_extract_all(content, '{_CLASS}', 1)) AS name FROM j",
    "java_methods": f"WITH {_JAVA} SELECT DISTINCT path AS file_path, unnest(regexp_extract_all(content, '{_METHOD}', 1)) AS name FROM j",
    "java_imports": f"WITH {_JAVA}, i AS (SELECT path, unnest(regexp_extract_all(content, '{_IMPORT}', 1)) AS name FROM j) SELECT 'file::' || path AS source_id, 'import::' || name AS target_id, count(*) AS n FROM i GROUP BY ALL",
    "java_bases": rf"""WITH {_JAVA}, m AS (SELECT path, unnest(regexp_extract_all(content, '{_CLASS}')) AS head FROM j), c AS (SELECT path, regexp_extract(head, '{_CLASS}', 1) AS name, regexp_extract(head, '{_CLASS}', 2) AS one, regexp_extract(head, '{_CLASS}', 3) AS more FROM m),
      b AS (SELECT path, name, unnest(list_concat([one], list_transform(string_split(more, ','), lambda x: trim(x, chr(32) || chr(10) || chr(9) || chr(13))))) AS base FROM c) SELECT DISTINCT 'class::' || path || '::' || name AS source_id, 'class::*::' || base AS target_id FROM b WHERE base <> ''""",
    "chunk_texts": rf"WITH {_F} SELECT path AS file_path, CAST(1 AS BIGINT) AS agrees FROM files WHERE regexp_matches(content, '\S')",
    "chunk_ids": rf"{_SPANS}, x AS (SELECT path, a, b FROM t WHERE regexp_matches(array_to_string(ls[a:b], chr(10)), '\S')) SELECT path || '::' || a || '-' || b || '::' || (row_number() OVER (PARTITION BY path ORDER BY a, b) - 1) AS chunk_id, CAST(64 AS BIGINT) AS width FROM x",
    "outline_heads": f"WITH {_F} SELECT path, '=== File Outline: ' || path || ' ===' AS head FROM files WHERE path LIKE '%.py' AND content IS NOT NULL",
    "superclass_names": f"WITH {_BASE} SELECT DISTINCT e.source_id AS id, regexp_extract(e.target_id, '([^.:]+)$', 1) AS base FROM e JOIN n ON n.id = e.source_id AND n.node_type = 'class' WHERE e.edge_type = 'INHERITS'",
    "resolved_superclasses": f"WITH {_BASE} SELECT e.source_id AS id, c.id AS base_id, count(*) AS n FROM e JOIN n c ON c.node_type = 'class' AND CASE WHEN starts_with(e.target_id, 'class::*::') THEN c.name = regexp_extract(e.target_id, '([^.:]+)$', 1) AND c.id <> e.source_id ELSE c.id = e.target_id END WHERE e.edge_type = 'INHERITS' AND e.source_id IN (SELECT id FROM n) GROUP BY ALL",
    "placeholder_calls_anywhere": graphs.ORACLE["placeholder_calls"].replace(" JOIN imp ON imp.file_path = c.file_path AND imp.name = c.callee", ""),
    "name_log": f"SELECT id, name, seq FROM graph_nodes WHERE id IS NOT NULL AND lower(name) = lower('{graphs.NAME}')",
    "nodes_of_types": f"WITH {_BASE}, k AS (SELECT id FROM n WHERE node_type IN ('class', 'method')) SELECT source_id, target_id, edge_type, count(*) AS n FROM e WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k) GROUP BY ALL",
    "raw_commit_log": f"WITH {_B} SELECT left(base_commit, 12) AS commit_hash, repo AS author, '2024-0' || (length(repo) % 9 + 1) || '-1' || (length(instance_id) % 9) || ' 0' || (length(instance_id) % 7) || ':00:00' AS date, 'fix ' || instance_id AS message, 'src/' || instance_id || '.py;README.md' AS files FROM bugs WHERE regexp_matches(base_commit, '^[0-9a-f]{{12}}')",
    "blame_lines": f"WITH {_F}, g AS (SELECT path, string_split(content, chr(10)) AS ls FROM files WHERE path LIKE '%.go' AND content IS NOT NULL), l AS (SELECT path, unnest(range(1, least(len(ls), 40))) AS i, ls FROM g) SELECT path, i AS line_no, left(sha1(path || CAST(i // 5 AS VARCHAR)), 8) AS commit_hash, 'a' || (i % 3) AS author, md5(ls[i + 1]) AS code FROM l",
    "checkout_trees": f"WITH {_F} SELECT repo AS project, CAST(length(path) % 4 + 1 AS BIGINT) AS bug_id, count(*) AS n_files, CASE WHEN length(path) % 4 + 1 <> 2 THEN '3.' || (length(path) % 4 + 1) END AS version FROM files WHERE path LIKE '%.py' AND repo IS NOT NULL GROUP BY ALL",
    "directory_tree": f"WITH q AS ({_TREE}), p AS (SELECT *, list_append(list_transform(list_filter(string_split(dir, '/'), lambda x: x <> ''), lambda x: '0' || lower(x) || chr(1) || x), (CASE WHEN is_file THEN '1' ELSE '0' END) || lower(name) || chr(1) || name) AS place FROM q) SELECT repeat('  ', CAST(depth AS INTEGER)) || name || CASE WHEN is_file THEN '' ELSE '/' END AS text, row_number() OVER (ORDER BY place) AS n FROM p",
    "benchmark_totals": f"WITH {_RESULTS} SELECT count(*) AS instances, count(*) FILTER (n % 7 = 0 OR n % 5 = 0) AS errors, CAST(coalesce(sum(n % 3) FILTER (n % 7 <> 0), 0) AS BIGINT) AS llm_calls, CAST(coalesce(sum(n % 4) FILTER (n % 7 <> 0), 0) AS BIGINT) AS tool_calls, round(coalesce(sum(n / 4.0) FILTER (n % 7 <> 0), 0) / 2 / greatest(count(*), 1), 9) AS mean_time FROM r",
    "benchmark_errors": f"WITH {_RESULTS} SELECT instance_id, CASE WHEN n % 7 = 0 THEN 'no result' WHEN n % 5 = 0 THEN 'failed' ELSE '' END AS error, CAST(CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN 0 ELSE len(list_distinct(list_append(buggy_files, repo || '/other.py'))) END AS BIGINT) AS n_predicted, false AS top1_hit FROM r",
    "benchmark_preview": rf"WITH {_B}, c AS (SELECT *, regexp_replace(coalesce(problem_statement, ''), '\s+', ' ', 'g') AS x FROM bugs) SELECT instance_id, CAST(len(coalesce(buggy_files, [])) AS BIGINT) AS files, array_to_string(list_transform(list_slice(coalesce(buggy_files, []), 1, 3), lambda f: split_part(f, '/', -1)), ', ') AS names, CASE WHEN length(x) > 60 THEN left(x, 60) || '...' ELSE x END AS report FROM c",
    "keywords_extended": f"WITH {_B} SELECT instance_id, CASE WHEN length(instance_id) % 2 = 0 THEN repo || ';' || repo || ';' || base_commit ELSE repo END AS keywords, CASE WHEN length(instance_id) % 2 = 0 THEN 'x.py' ELSE array_to_string(buggy_files, ';') END AS files FROM bugs",
}
ORACLE["resolved_subclasses"] = f"SELECT base_id AS id, count(DISTINCT id) AS subclasses FROM ({ORACLE['resolved_superclasses']}) GROUP BY base_id"
