"""File trees, key-value files, bug lists and commit logs as tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from codelode.functions.text import basename, language, lines, suffix

# Suffixes that are searched, and directories that are not.
SEARCH_SUFFIXES = [".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".hpp", ".go", ".rs", ".rb", ".php", ".scala", ".kt"]
INDEX_SUFFIXES = [".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".go", ".rs", ".rb", ".scala", ".kt"]
SKIP_DIRS = [".git", "__pycache__", "node_modules", ".tox", ".eggs", "*.egg-info", "build", "dist", ".venv", "venv", "test", "tests", "testing"]
INDEX_SKIP_DIRS = [*SKIP_DIRS, ".mypy_cache", ".pytest_cache"]
GRAPH_SKIP_DIRS = {".py": [".git", "__pycache__", "node_modules", ".tox", "build", "dist", ".venv", "venv", ".eggs"], ".java": [".git", "build", "target", ".gradle", "node_modules", "test", "tests", ".idea"]}
MAX_BYTES = 1_000_000


def underscored(spark: SparkSession, root: str) -> list[tuple[str, datetime, int]]:
    """``(path, modified, size)`` of files below ``root`` with a part that starts with an underscore, none with a dot."""

    def hidden(parts: list[str]) -> bool:
        return any(x.startswith("_") and "=" not in x for x in parts) and not any(x.startswith(".") for x in parts)

    out = []
    if re.match(r"^[a-z][a-z0-9+.-]+:", root) and not root.startswith("file:"):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        base, found = len(fs.makeQualified(path).toString().rstrip("/")) + 1, fs.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            name = f.getPath().toString()
            if hidden(name[base:].split("/")):
                out.append((name, datetime.fromtimestamp(f.getModificationTime() / 1000), f.getLen()))
        return out
    top = os.path.abspath(re.sub("^file:/*", "/", root))
    for folder, _, names in os.walk(top):
        inner = os.path.relpath(folder, top)
        parts = [] if inner == "." else inner.split(os.sep)
        for name in names:
            if hidden([*parts, name]):
                at = os.stat(full := os.path.join(folder, name))
                out.append((full, datetime.fromtimestamp(at.st_mtime), at.st_size))
    return out


def _read_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for pdf in batches:
        content = []
        for path in pdf["path"]:
            system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            with system.open_input_stream(name) as f:
                content.append(f.read())
        yield pdf.assign(content=content)


def read_tree(spark: SparkSession, root: str, suffixes: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """``(path, suffix, size, modified_at, content)`` of the files below ``root``; paths relative, text in UTF-8.

    The length filter reaches the scan, and content is only read where it is used.
    Bytes that are not UTF-8 are left out. Spark's scan passes over empty files, whose rows come from the list of
    files that the scan has made, with a null ``modified_at``; and over names that start with an underscore, which
    are listed and read beside it. Names that start with a dot have no row.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = spark._jsparkSession.createDataset(spark._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(scan._jdf.inputFiles()), spark._jvm.org.apache.spark.sql.Encoders.STRING())
    name = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))
    key = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    empty = DataFrame(listed.toDF(), spark).select(key(name).alias("path")).join(scan.select(key(F.col("path")).alias("path")), "path", "left_anti")
    raw = scan.select("path", "modificationTime", "length", "content").unionByName(empty.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit("").cast("binary").alias("content")))
    if found := underscored(spark, root):
        listed = spark.createDataFrame(found, "path string, modificationTime timestamp, length long")
        if max_bytes is not None:
            listed = listed.where(F.col("length") <= max_bytes)
        raw = raw.unionByName(listed.mapInPandas(_read_bytes, "path string, modificationTime timestamp, length long, content binary"))
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    t = raw.select(F.substring(full, F.length(base) + 2, F.length(full)).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), text.alias("content"))
    t = t.withColumn("suffix", suffix(F.col("path")))
    return t.where(F.col("suffix").isin(suffixes)) if suffixes else t


def is_test(path: Column) -> Column:
    """Below a test directory, or named like a test; ``path`` is relative to its repository."""
    name = F.lower(basename(path))
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in ("test", "tests", "testing")])) | name.startswith("test_") | name.endswith("_test.py") | name.endswith("test.java") | name.endswith("tests.java")


def in_skipped(path: Column, skip: list[str] = SKIP_DIRS, word: str = "test") -> Column:
    """Below a directory that is skipped by name, or, unless ``word`` is empty, has the word in its name."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(skip) | (F.contains(F.lower(d), F.lit(word)) if word else F.lit(False)))


def searchable(files: DataFrame, suffixes: list[str] = SEARCH_SUFFIXES) -> DataFrame:
    p = F.col("path")
    return files.where(suffix(p).isin(suffixes) & ~is_test(p) & ~in_skipped(p))


def indexable(files: DataFrame) -> DataFrame:
    """Files that go into the vector index: as for search, without heavy ones."""
    p = F.col("path")
    size = F.octet_length("content")
    return files.where(suffix(p).isin(INDEX_SUFFIXES) & ~is_test(p) & ~in_skipped(p, INDEX_SKIP_DIRS) & (size <= MAX_BYTES))


def find_files(files: DataFrame, pattern: str | None = None, suffixes: list[str] | None = None, max_results: int = 100) -> DataFrame:
    """Paths whose name contains ``pattern`` without case, first ``max_results`` by path."""
    p = F.col("path")
    out = files.where(~in_skipped(p))
    if pattern:
        out = out.where(F.contains(F.lower(basename(p)), F.lit(pattern.lower())))
    if suffixes:
        out = out.where(suffix(p).isin(suffixes))
    return out.select("path").orderBy("path").limit(max_results)


def file_info(files: DataFrame) -> DataFrame:
    """``(path, size, language, num_lines)`` from the text itself; a null text counts as empty."""
    c = F.coalesce("content", F.lit(""))
    return files.select("path", F.octet_length(c).cast("long").alias("size"), language(F.col("path")).alias("language"), F.size(lines(c)).cast("long").alias("num_lines"))


def repository_language(files: DataFrame) -> DataFrame:
    """``(repo, language)``: java where it has strictly more files, else python."""
    s = suffix(F.col("path"))
    return files.groupBy("repo").agg(F.count_if(s == ".py").alias("py"), F.count_if(s == ".java").alias("java")).select("repo", F.when(F.col("java") > F.col("py"), "java").otherwise("python").alias("language"), "py", "java")


def tree_text(entries: DataFrame) -> DataFrame:
    """``(place, text)`` of directory entries, in order of ``place``: within a directory, directories first, then by name.

    A line is indented by its depth; a directory ends in a slash. ``place`` sorts as the tree is read.
    """
    rank = lambda is_file, name: F.concat(F.when(is_file, "1").otherwise("0"), F.lower(name), F.lit("\u0001"), name)
    above = F.transform(F.filter(F.split("dir", "/"), lambda x: x != ""), lambda x: rank(F.lit(False), x))
    place = F.concat(above, F.array(rank(F.col("is_file"), F.col("name"))))
    return entries.select(place.alias("place"), F.concat(F.repeat(F.lit("  "), F.col("depth")), "name", F.when(F.col("is_file"), "").otherwise("/")).alias("text"))


def directory_entries(files: DataFrame, max_depth: int = 2, hidden: bool = False) -> DataFrame:
    """``(dir, name, is_file, depth)`` of every entry at most ``max_depth`` below the top, top entries having depth 0; ``tree_text`` puts them in order."""
    parts = F.split("path", "/")
    t = files.select("path", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max_depth + 1)))).alias("n"))
    e = t.select(F.array_join(F.slice("p", F.lit(1), F.col("n") - 1), "/").alias("dir"), F.get("p", F.col("n") - 1).alias("name"), (F.col("n") == F.size("p")).alias("is_file"), (F.col("n") - 1).alias("depth")).distinct()
    return e if hidden else e.where(~F.col("name").startswith(".") & ~F.col("name").isin(SKIP_DIRS))


def file_lines(files: DataFrame, start: int = 1, end: int | None = None, max_lines: int = 200) -> DataFrame:
    """``(path, line_number, rendered, total)``: a range of lines of each file; ``max_lines`` only holds without ``end``."""
    start = max(1, start)
    ls = lines(F.coalesce("content", F.lit("")))
    count = F.greatest(F.lit(0), F.lit(end - start + 1)) if end is not None else F.lit(max_lines)
    t = files.select("path", F.size(ls).alias("total"), F.posexplode(F.slice(ls, F.lit(start), count)).alias("i", "line"))
    n = F.col("i") + start
    return t.select("path", n.cast("long").alias("line_number"), F.format_string("%4d | %s", n, "line").alias("rendered"), F.col("total").cast("long").alias("total"))


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of ``key=value`` lines, quotes stripped."""
    t = spark.read.text(path).where(F.contains("value", F.lit("=")))
    v = F.regexp_replace(F.trim(F.regexp_extract("value", "^[^=]*=(.*)$", 1)), "^[\"']+|[\"']+$", "")
    return t.select(F.trim(F.split_part("value", F.lit("="), F.lit(1))).alias("key"), v.alias("value"))


def read_active_bugs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``(bug_id, revision)`` of a bug list, by number."""
    t = spark.read.csv(path, header=True).select(F.col("`bug.id`").cast("int").alias("bug_id"), F.col("`revision.id.buggy`").alias("revision")).orderBy("bug_id")
    return t.limit(limit) if limit else t


def checkouts(files: DataFrame) -> DataFrame:
    """``(project, bug_id, n_files)`` of trees ``project/number/...`` with Python files; ``*-repo`` trees are base copies."""
    m = r"^([^/]+)/(\d+)/.*\.py$"
    t = files.where(F.col("path").rlike(m)).select(F.regexp_extract("path", m, 1).alias("project"), F.regexp_extract("path", m, 2).cast("long").alias("bug_id"))
    return t.where(~F.col("project").endswith("-repo")).groupBy("project", "bug_id").agg(F.count("*").alias("n_files"))


def commits(log: DataFrame) -> DataFrame:
    """``git log --name-only`` output, one commit a row in ``raw``, as records with their own files.

    A record is hash, author, date and message divided by ``|``, then a line per file.
    """
    ls = F.filter(F.split("raw", "\n"), lambda x: F.trim(x) != "")
    head = F.split(F.get(ls, F.lit(0)), r"\|", 4)
    return log.select(F.get(head, F.lit(0)).alias("commit_hash"), F.get(head, F.lit(1)).alias("author"), F.try_to_timestamp(F.get(head, F.lit(2))).alias("date"), F.get(head, F.lit(3)).alias("message"), F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 1, F.lit(0))).alias("files_changed"))


def commit_stream(log: DataFrame) -> DataFrame:
    """Raw ``git log`` output, all records of a repository in ``raw``, cut into rows for ``commits``: ``(..., pos, raw)``.

    A record starts at a line with a hash of 7 to 40 digits before the first ``|``.
    """
    starts = F.split("raw", r"\n(?=[0-9a-f]{7,40}\|)")
    keep = [c for c in log.columns if c != "raw"]
    return log.select(*keep, F.posexplode(starts).alias("pos", "raw")).where(F.col("raw").rlike(r"^\s*[0-9a-f]{7,40}\|"))


def with_metadata(trees: DataFrame, info: DataFrame) -> DataFrame:
    """Checkouts with what their info files say: ``info(project, bug_id, key, value)`` -> a map; trees without any keep a null."""
    said = info.groupBy("project", "bug_id").agg(F.map_from_entries(F.collect_set(F.struct("key", "value"))).alias("metadata"))
    return trees.join(said, ["project", "bug_id"], "left")


def log_of_file(records: DataFrame, path: str | None = None, max_entries: int = 10) -> DataFrame:
    """The newest commits, of one file if asked."""
    r = records.where(F.array_contains("files_changed", path)) if path else records
    return r.orderBy(F.desc("date"), "commit_hash").limit(max_entries)


def blame(porcelain: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Blame lines with hash and author carried down: ``(path, line_no, raw)`` -> ``(path, line_no, commit_hash, author, code)``."""
    w = Window.partitionBy("path").orderBy("line_no")
    hash_ = F.regexp_extract("raw", "^([0-9a-f]{40}) ", 1)
    author = F.regexp_extract("raw", "^author (.*)$", 1)
    carry = lambda c: F.last(F.when(c != "", c), ignorenulls=True).over(w)
    t = porcelain.withColumns({"commit_hash": carry(hash_), "author": carry(author)})
    t = t.where(F.col("raw").startswith("\t")).withColumn("line", F.row_number().over(w))
    if start is not None or end is not None:
        t = t.where(F.col("line").between(start or 1, end or (1 << 30)))
    return t.select("path", "line_no", F.substring("commit_hash", 1, 8).alias("commit_hash"), "author", F.substring("raw", F.lit(2), F.length("raw")).alias("code"))
