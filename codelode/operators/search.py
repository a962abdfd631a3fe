"""Line search with context."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.functions.text import lines, strip
from codelode.sources.files import searchable


def glob_to_regex(pattern: str) -> str:
    """A file pattern as a regular expression that matches from the right, part by part."""
    part = lambda p: re.sub(r"\\\*", "[^/]*", re.escape(p)).replace(r"\?", "[^/]")
    return "(?:^|/)" + "/".join(part(p) for p in pattern.split("/")) + "$"


def java_pattern(spark: SparkSession, pattern: str) -> str | None:
    """A pattern as the JVM writes it (named groups differ); None if either side does not accept it."""
    try:
        re.compile(pattern)
        changed = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<", "(?<", pattern))
        spark._jvm.java.util.regex.Pattern.compile(changed)
    except (re.error, Py4JJavaError):
        return None
    return changed


def code_search(files: DataFrame, query: str, is_regex: bool = False, case_sensitive: bool = False, max_results: int | None = 50, context_lines: int = 2, file_pattern: str | None = None) -> DataFrame:
    """``(path, line_number, line, before, after)`` of matching lines, in order of path and line.

    A pattern replaces the suffix filter. A bad regular expression finds nothing. Files that
    can't match are dropped before they are cut into lines; context comes from the file's own
    array of lines, so nothing is joined. Null texts do not match.
    """
    out = "path string, line_number long, line string, before array<string>, after array<string>"
    if is_regex:
        query = java_pattern(files.sparkSession, query)
        if query is None:
            return files.sparkSession.createDataFrame([], out)
    if file_pattern:
        from codelode.sources.files import in_skipped, is_test

        p = F.col("path")
        chosen = files.where(~is_test(p) & ~in_skipped(p) & p.rlike(glob_to_regex(file_pattern)))
    else:
        chosen = searchable(files)
    if is_regex:
        hit = lambda c: c.rlike(query if case_sensitive else f"(?i){query}")
    elif case_sensitive:
        hit = lambda c: F.contains(c, F.lit(query))
    else:
        hit = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
    # Anchors see single lines only, so whole texts can be tested first for literals alone.
    chosen = chosen.where(F.col("content").isNotNull() if is_regex else hit(F.col("content")))
    t = chosen.select("path", lines(F.col("content")).alias("ls"))
    t = t.select("path", "ls", F.posexplode("ls").alias("i", "line")).where(hit(F.col("line")))
    near = lambda a, n: F.transform(F.slice("ls", a, n), strip)
    first = F.greatest(F.col("i") - context_lines, F.lit(0))
    t = t.select("path", (F.col("i") + 1).cast("long").alias("line_number"), strip(F.col("line")).alias("line"), near(first + 1, F.col("i") - first).alias("before"), near(F.col("i") + 2, F.lit(context_lines)).alias("after"))
    return t.orderBy("path", "line_number").limit(max_results) if max_results is not None else t
