"""Queries over files, lines, chunks and vectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.functions import text as T
from codelode.operators.chunking import chunk_files, line_chunks, python_chunks
from codelode.operators.search import code_search
from codelode.operators.vectors import build_index, search_all, similar_files, top_k
from codelode.sources import files as S, tables


def _joined(df: DataFrame) -> DataFrame:
    return df.select("path", "line_number", "line", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


def grep_literal(spark: SparkSession, d: str) -> DataFrame:
    return _joined(code_search(tables.source_files(spark, d), "Registry("))


def grep_regex_context(spark: SparkSession, d: str) -> DataFrame:
    return _joined(code_search(tables.source_files(spark, d), r"^\s*return \w+", is_regex=True, case_sensitive=True, context_lines=1, max_results=None))


def grep_pattern(spark: SparkSession, d: str) -> DataFrame:
    return _joined(code_search(tables.source_files(spark, d), "import", file_pattern="*_*.go", max_results=None, context_lines=0))


def find_files(spark: SparkSession, d: str) -> DataFrame:
    return S.find_files(tables.source_files(spark, d), "cache", [".py", ".go"])


def file_info(spark: SparkSession, d: str) -> DataFrame:
    return S.file_info(tables.source_files(spark, d))


def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    return S.repository_language(tables.source_files(spark, d)).select("repo", "language", F.col("py").cast("long"), F.col("java").cast("long"))


def test_file_filter(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return tables.source_files(spark, d).select("path", S.is_test(p).alias("is_test"), S.in_skipped(p).alias("skipped"))


def list_directory(spark: SparkSession, d: str) -> DataFrame:
    return S.directory_entries(tables.source_files(spark, d)).select("dir", "name", "is_file", F.col("depth").cast("long"))


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    return S.file_lines(tables.source_files(spark, d), 3, 8)


def format_sizes(spark: SparkSession, d: str) -> DataFrame:
    return S.file_info(tables.source_files(spark, d)).select("path", T.format_size(F.col("size")).alias("size"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return tables.source_files(spark, d).select("path", T.basename(p).alias("name"), T.stem(p).alias("stem"), T.suffix(p).alias("suffix"))


def line_chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    f = tables.source_files(spark, d).where("not path like '%.py'")
    return line_chunks(f).select("file_path", F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.char_length("text").cast("long").alias("chars"))


def regex_links(spark: SparkSession, d: str) -> DataFrame:
    t = tables.source_files(spark, d).where("suffix = '.java'")
    return t.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*import[ \t]+([\w.]+);"), 1)).alias("imported"))


def first_class_line(spark: SparkSession, d: str) -> DataFrame:
    at = F.locate("class ", "content")
    t = tables.source_files(spark, d).where(F.contains("content", F.lit("class ")))
    return t.select("path", T.line_of(F.col("content"), at - 1).cast("long").alias("line"))


def patch_files(spark: SparkSession, d: str) -> DataFrame:
    b = tables.bug_instances(spark, d)
    return b.select("instance_id", F.array_join(T.patch_files(F.col("patch")), ";").alias("files"))


def commit_log(spark: SparkSession, d: str) -> DataFrame:
    """Bug fixes read as a commit log: one raw record each, parsed back."""
    b = tables.bug_instances(spark, d)
    raw = F.concat(F.concat_ws("|", "base_commit", "repo", F.lit("2024-05-06T07:08:09Z"), F.regexp_replace("instance_id", r"\|", " ")), F.lit("\n\n"), F.array_join(T.patch_files(F.col("patch")), "\n"))
    r = S.commits(b.select(raw.alias("raw")))
    return r.select("commit_hash", "author", F.date_format("date", "yyyy-MM-dd").alias("day"), "message", F.size("files_changed").cast("long").alias("n_files"))


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    b = tables.bug_instances(spark, d)
    return b.select(F.col("base_commit").alias("commit_hash"), F.explode(T.patch_files(F.col("patch"))).alias("file"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("preview"))


def _first_vector(table: DataFrame, key: str) -> list[float]:
    row = table.where((F.size("embedding") == 64) & F.exists("embedding", lambda v: v != 0)).orderBy(key).select("embedding").first()
    return [float(x) for x in row[0]]


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "embeddings")
    return top_k(e, _first_vector(e, "vec_id"), "vec_id").select("vec_id", "label", "similarity")


def vector_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    c = tables.code_chunks(spark, d)
    return top_k(c, _first_vector(c, "seq"), "seq", 20, ".py", "function").select("seq", "file_path", "similarity")


def similar_file_groups(spark: SparkSession, d: str) -> DataFrame:
    c = tables.code_chunks(spark, d)
    return similar_files(c, _first_vector(c, "seq"))


def vector_search_all(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "embeddings")
    return search_all(e, e.where("vec_id % 100 = 0"), "vec_id")


def ast_chunks(spark: SparkSession, d: str) -> DataFrame:
    return python_chunks(tables.source_files(spark, d))


def all_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_files(S.indexable(tables.source_files(spark, d)))


def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    return build_index(S.indexable(tables.source_files(spark, d)))


QUERIES = {f.__name__: f for f in (grep_literal, grep_regex_context, grep_pattern, find_files, file_info, lang_detect, test_file_filter, list_directory, file_lines, format_sizes, path_parts, line_chunk_spans, regex_links, first_class_line, patch_files, commit_log, commit_files, clean_text, vector_topk, vector_filtered_topk, similar_file_groups, vector_search_all, ast_chunks, all_chunks, chunk_index)}

FILES = "files AS (SELECT * FROM source_files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY ingested_at DESC NULLS LAST, content DESC NULLS LAST) = 1)"
BUGS = "bugs AS (SELECT DISTINCT ON (instance_id) * FROM bug_instances WHERE instance_id IS NOT NULL)"
CHUNKS = "chunks AS (SELECT DISTINCT ON (seq) * REPLACE (lower(chunk_type) AS chunk_type) FROM code_chunks)"
_NAME = "split_part(path, '/', -1)"
_SUFFIX = f"regexp_extract({_NAME}, '^.+(\\.[^.]*)$', 1)"
_DIRS = "list_slice(string_split(path, '/'), 1, -2)"
_SKIP = "['.git','__pycache__','node_modules','.tox','.eggs','*.egg-info','build','dist','.venv','venv','test','tests','testing']"
IS_TEST = f"(list_has_any(string_split(path, '/'), ['test','tests','testing']) OR starts_with(lower({_NAME}), 'test_') OR ends_with(lower({_NAME}), '_test.py') OR ends_with(lower({_NAME}), 'test.java') OR ends_with(lower({_NAME}), 'tests.java'))"
SKIPPED = f"(len(list_filter({_DIRS}, lambda x: list_contains({_SKIP}, x) OR contains(lower(x), 'test'))) > 0)"
_SEARCH = "('.py','.js','.ts','.java','.c','.cpp','.h','.hpp','.go','.rs','.rb','.php','.scala','.kt')"
_PATCH = r"list_filter(list_transform(string_split(coalesce(patch, ''), chr(10)), lambda x: regexp_extract(x, '^\+\+\+ b/([^\r\t]+)', 1)), lambda x: x <> '')"
_PATCH_FILES = f"list_sort(list_transform(list_distinct({_PATCH}), lambda x: [lpad(CAST(list_position({_PATCH}, x) AS VARCHAR), 6, '0'), x]))"


def _grep(condition: str, context: int, where: str, tail: str = "") -> str:
    strip = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    near = lambda a, b: f"array_to_string(list_transform(list_slice(ls, {a}, {b}), lambda x: {strip.format('x')}), chr(10))"
    before = near(f"greatest(i - {context}, 1)", "i - 1") if context else "''"
    after = near("i + 1", f"i + {context}") if context else "''"
    return f"""WITH {FILES}, chosen AS (SELECT path, string_split(content, chr(10)) AS ls FROM files WHERE content IS NOT NULL AND NOT {IS_TEST} AND NOT {SKIPPED} AND {where}),
    rowed AS (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM chosen), hit AS (SELECT path, ls, i, ls[i] AS l FROM rowed WHERE {condition.format('ls[i]')})
    SELECT path, CAST(i AS BIGINT) AS line_number, {strip.format('l')} AS line, {before} AS before, {after} AS after FROM hit {tail}"""


def _vector(table: str, key: str) -> str:
    return f"(SELECT embedding FROM {table} WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v <> 0)) > 0 ORDER BY {key} LIMIT 1)"


def _cosine(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 64 AND len(list_filter({a}, lambda v: v <> 0)) > 0 THEN round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6) END"


_LANGS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items()) + "}"

ORACLE = {
    "grep_literal": _grep("contains(lower({}), 'registry(')", 2, f"{_SUFFIX} IN {_SEARCH}", "ORDER BY path, line_number LIMIT 50"),
    "grep_regex_context": _grep(r"regexp_matches({}, '^\s*return \w+')", 1, f"{_SUFFIX} IN {_SEARCH}"),
    "grep_pattern": _grep("contains(lower({}), 'import')", 0, r"regexp_matches(path, '(?:^|/)[^/]*_[^/]*\.go$')"),
    "find_files": f"WITH {FILES} SELECT path FROM files WHERE NOT {SKIPPED} AND contains(lower({_NAME}), 'cache') AND {_SUFFIX} IN ('.py', '.go') ORDER BY path LIMIT 100",
    "file_info": f"WITH {FILES} SELECT path, octet_length(encode(coalesce(content, ''))) AS size, coalesce(({_LANGS})[{_SUFFIX}], 'unknown') AS language, len(string_split(coalesce(content, ''), chr(10))) AS num_lines FROM files",
    "lang_detect": f"WITH {FILES}, n AS (SELECT repo, count(*) FILTER ({_SUFFIX} = '.py') AS py, count(*) FILTER ({_SUFFIX} = '.java') AS java FROM files GROUP BY repo) SELECT repo, CASE WHEN java > py THEN 'java' ELSE 'python' END AS language, py, java FROM n",
    "test_file_filter": f"WITH {FILES} SELECT path, {IS_TEST} AS is_test, {SKIPPED} AS skipped FROM files",
    "list_directory": f"WITH {FILES}, p AS (SELECT string_split(path, '/') AS p FROM files), e AS (SELECT p, unnest(range(1, least(len(p), 3) + 1)) AS n FROM p) SELECT DISTINCT array_to_string(list_slice(p, 1, n - 1), '/') AS dir, p[n] AS name, n = len(p) AS is_file, CAST(n - 1 AS BIGINT) AS depth FROM e WHERE NOT starts_with(p[n], '.') AND NOT list_contains({_SKIP}, p[n])",
    "file_lines": f"WITH {FILES}, l AS (SELECT path, string_split(coalesce(content, ''), chr(10)) AS ls FROM files), e AS (SELECT path, ls, unnest(range(3, least(8, len(ls)) + 1)) AS n FROM l) SELECT path, CAST(n AS BIGINT) AS line_number, lpad(CAST(n AS VARCHAR), 4, ' ') || ' | ' || ls[n] AS rendered, CAST(len(ls) AS BIGINT) AS total FROM e",
    "format_sizes": f"WITH {FILES}, n AS (SELECT path, octet_length(encode(coalesce(content, ''))) AS b FROM files) SELECT path, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || 'B' WHEN b < 1048576 THEN printf('%.1fKB', b / 1024) ELSE printf('%.1fMB', b / 1048576) END AS size FROM n",
    "path_parts": f"WITH {FILES} SELECT path, {_NAME} AS name, regexp_replace({_NAME}, '^(.+)\\.[^.]*$', '\\1') AS stem, {_SUFFIX} AS suffix FROM files",
    "line_chunk_spans": rf"""WITH {FILES}, l AS (SELECT path, string_split(content, chr(10)) AS ls, length(content) AS c FROM files WHERE NOT path LIKE '%.py' AND regexp_matches(content, '\S')),
    g AS (SELECT path, ls, len(ls) AS n, greatest(10, CAST(floor(512 / greatest(1.0, c / len(ls))) AS BIGINT)) AS l, greatest(2, CAST(floor(64 / greatest(1.0, c / len(ls))) AS BIGINT)) AS o FROM l),
    k AS (SELECT *, unnest(range(0, CASE WHEN n <= l THEN 1 ELSE CAST(ceil((n - l) / (l - o)) AS BIGINT) + 1 END)) AS i FROM g), t AS (SELECT path, i * (l - o) + 1 AS a, least(i * (l - o) + l, n) AS b, ls FROM k)
    SELECT path AS file_path, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, length(array_to_string(ls[a:b], chr(10))) AS chars FROM t WHERE regexp_matches(array_to_string(ls[a:b], chr(10)), '\S')""",
    "regex_links": rf"WITH {FILES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS x FROM files WHERE suffix = '.java') SELECT path, regexp_extract(x, '^[ \t]*import[ \t]+([\w.]+);', 1) AS imported FROM l WHERE regexp_matches(x, '^[ \t]*import[ \t]+([\w.]+);')",
    "first_class_line": f"WITH {FILES} SELECT path, len(string_split(left(content, strpos(content, 'class ') - 1), chr(10))) AS line FROM files WHERE contains(content, 'class ')",
    "patch_files": f"WITH {BUGS} SELECT instance_id, array_to_string(list_transform({_PATCH_FILES}, lambda x: x[2]), ';') AS files FROM bugs",
    "commit_log": f"WITH {BUGS} SELECT base_commit AS commit_hash, repo AS author, '2024-05-06' AS day, instance_id AS message, CAST(len(list_distinct({_PATCH})) AS BIGINT) AS n_files FROM bugs",
    "commit_files": f"WITH {BUGS} SELECT base_commit AS commit_hash, unnest(list_distinct({_PATCH})) AS file FROM bugs",
    "clean_text": r"WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\r?\n|\r', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 300 THEN left(t, 300) || '...' ELSE t END AS preview FROM t",
    "vector_topk": f"WITH s AS (SELECT vec_id, label, {_cosine('embedding', _vector('embeddings', 'vec_id'))} AS similarity FROM embeddings) SELECT * FROM s WHERE similarity IS NOT NULL ORDER BY similarity DESC, vec_id LIMIT 10",
    "vector_filtered_topk": f"WITH {CHUNKS}, s AS (SELECT seq, file_path, {_cosine('embedding', _vector('chunks', 'seq'))} AS similarity FROM chunks WHERE contains(file_path, '.py') AND chunk_type = 'function') SELECT * FROM s WHERE similarity IS NOT NULL ORDER BY similarity DESC, seq LIMIT 20",
    "similar_file_groups": f"WITH {CHUNKS}, s AS (SELECT file_path, {_cosine('embedding', _vector('chunks', 'seq'))} AS similarity FROM chunks WHERE file_path <> '') SELECT file_path, max(similarity) AS similarity FROM s WHERE similarity IS NOT NULL GROUP BY file_path ORDER BY similarity DESC, file_path LIMIT 20",
    "vector_search_all": f"WITH s AS (SELECT q.vec_id AS query, t.vec_id AS near, {_cosine('t.embedding', 'q.embedding')} AS similarity FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id WHERE q.vec_id % 100 = 0) SELECT * FROM s WHERE similarity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, near) <= 5",
}
