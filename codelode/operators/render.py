"""Results as text columns, for consoles and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window



def location(file_path: Column, class_name: Column, function_name: Column, start: Column, end: Column) -> Column:
    """``path::Class.function [Lstart-end]``, as far as the parts are there."""
    owner = F.when(F.coalesce(class_name, F.lit("")) != "", F.concat(class_name, F.when(F.coalesce(function_name, F.lit("")) != "", F.lit(".")).otherwise(""))).otherwise("")
    what = F.concat(owner, F.coalesce(function_name, F.lit("")))
    lines = F.when(F.coalesce(start, F.lit(0)) > 0, F.format_string(" [L%d-%d]", start, F.coalesce(end, start))).otherwise("")
    return F.concat(file_path, F.when(what != "", F.concat(F.lit("::"), what)).otherwise(""), lines)


def search_hits(hits: DataFrame) -> DataFrame:
    """Line hits as ``path:line: text`` with their context indented."""
    pad = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("    "), x)), "\n")
    head = F.format_string("%s:%d: %s", "path", "line_number", "line")
    return hits.select("path", "line_number", F.concat_ws("\n", F.when(F.size("before") > 0, pad("before")), head, F.when(F.size("after") > 0, pad("after"))).alias("text"))


def graph_hits(hits: DataFrame, nodes: DataFrame, snippets: DataFrame | None = None, preview: int = 300) -> DataFrame:
    """``(rank, text)`` of a graph search: kind, place, score, how it was reached, and a preview."""
    t = hits.join(nodes.select("id", "name", "node_type", "file_path", "start_line", "end_line", "signature"), "id")
    if snippets is not None:
        t = t.join(snippets, "id", "left")
    w = Window.orderBy(F.desc("score"), *([F.col("first")] if "first" in hits.columns else []), "id")
    body = F.when(F.coalesce(F.col("snippet"), F.lit("")) != "", F.substring("snippet", 1, preview)) if snippets is not None else F.lit(None).cast("string")
    head = F.format_string("[%s] %s (%s, score %.3f, depth %d)", "node_type", location(F.col("file_path"), F.lit(""), F.col("name"), F.col("start_line"), F.col("end_line")), "source", "score", "depth")
    return t.select(F.row_number().over(w).alias("rank"), F.concat_ws("\n", head, F.when(F.col("signature") != "", F.concat(F.lit("  "), "signature")), body).alias("text"))


def vector_hits(hits: DataFrame, preview: int = 200) -> DataFrame:
    """``(rank, text)`` of a vector search."""
    w = Window.orderBy(F.desc("similarity"), "chunk_id")
    head = F.format_string("%s (similarity %.3f)", location(F.col("file_path"), F.col("class_name"), F.col("function_name"), F.col("start_line"), F.col("end_line")), "similarity")
    return hits.select(F.row_number().over(w).alias("rank"), F.concat_ws("\n", head, F.substring("text", 1, preview)).alias("text"))


def relations(found: DataFrame, label: str) -> DataFrame:
    """``(id, text)``: the list of a node's callers or callees, or a line that says there are none."""
    other = next(c for c in found.columns if c != "id")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(other)), lambda x: F.concat(F.lit("  - "), x)), "\n")
    return found.groupBy("id").agg(F.when(F.count(other) > 0, names).otherwise(f"  (no {label} found)").alias("text"))


def commit_lines(log: DataFrame, max_files: int = 5) -> DataFrame:
    """``(commit_hash, text)``: short hash, day, author and message, and the first files."""
    files = F.array_join(F.transform(F.slice("files_changed", 1, max_files), lambda f: F.concat(F.lit("    "), f)), "\n")
    more = F.when(F.size("files_changed") > max_files, F.concat(F.lit("\n    ... and "), (F.size("files_changed") - max_files).cast("string"), F.lit(" more"))).otherwise("")
    head = F.concat_ws(" ", F.substring("commit_hash", 1, 8), F.date_format("date", "yyyy-MM-dd"), "author", "message")
    return log.select("commit_hash", F.concat_ws("\n", head, F.when(F.size("files_changed") > 0, F.concat(files, more))).alias("text"))
