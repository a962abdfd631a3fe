"""Files to chunks: by lines in the JVM, by structure for Python."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codelode.functions.text import lines

CHUNKS = "file_path string, start_line int, end_line int, function_name string, class_name string, chunk_type string, text string"
CHUNK_CHARS, OVERLAP_CHARS = 512, 64


def line_chunks(files: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Overlapping runs of lines of about ``size`` characters (CHUNKS).

    With n lines of a on average, a chunk has l = max(10, size / a) lines and shares
    o = max(2, overlap / a) with the next; the number of chunks follows from that, so
    they are made by a sequence and slices, without a loop. Blank chunks and texts are dropped.
    """
    ls = lines(F.col("content"))
    t = files.where(F.col("content").rlike(r"\S")).select(F.col("path").alias("file_path"), ls.alias("ls"), F.char_length("content").alias("c"), F.size(ls).alias("n"))
    mean = F.greatest(F.lit(1.0), F.col("c") / F.col("n"))
    t = t.withColumns({"l": F.greatest(F.lit(10), F.floor(F.lit(float(size)) / mean).cast("int")), "o": F.greatest(F.lit(2), F.floor(F.lit(float(overlap)) / mean).cast("int"))})
    count = F.when(F.col("n") <= F.col("l"), 1).otherwise(F.ceil((F.col("n") - F.col("l")) / (F.col("l") - F.col("o"))).cast("int") + 1)
    t = t.select("file_path", "ls", "n", "l", "o", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    start = F.col("i") * (F.col("l") - F.col("o"))
    text = F.array_join(F.slice("ls", start + 1, F.col("l")), "\n")
    t = t.select("file_path", (start + 1).alias("start_line"), F.least(start + F.col("l"), F.col("n")).alias("end_line"), F.lit("").alias("function_name"), F.lit("").alias("class_name"), F.lit("code").alias("chunk_type"), text.alias("text"))
    return t.where(F.col("text").rlike(r"\S"))


def structure_chunks(path: str, content: str) -> list[tuple]:
    """Header, classes, methods and functions of a Python file; none if it does not parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows = content.split("\n")
    cut = lambda a, b: "\n".join(rows[a - 1 : b])
    out = []
    head = 0
    for node in tree.body:
        if not isinstance(node, (ast.Import, ast.ImportFrom, ast.Assign, ast.Expr)):
            break
        head = max(head, node.end_lineno)
    if head and cut(1, head).strip():
        out.append((path, 1, head, "", "", "module", cut(1, head)))
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            out.append((path, node.lineno, node.end_lineno, "", node.name, "class", cut(node.lineno, node.end_lineno)))
            out += [(path, m.lineno, m.end_lineno, m.name, node.name, "function", cut(m.lineno, m.end_lineno)) for m in node.body if isinstance(m, functions)]
        elif isinstance(node, functions):
            out.append((path, node.lineno, node.end_lineno, node.name, "", "function", cut(node.lineno, node.end_lineno)))
    return out


def _structure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    for pdf in batches:
        rows = [r for path, text in zip(pdf["path"], pdf["content"]) for r in structure_chunks(path, text)]
        yield pd.DataFrame(rows, columns=names).astype({"start_line": "int32", "end_line": "int32"})


def python_chunks(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".py") & F.col("content").rlike(r"\S")).select("path", "content").mapInPandas(_structure, CHUNKS)


def chunk_files(files: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """CHUNKS of all files: by structure for Python that parses, else by lines. Null and blank texts give none."""
    by_structure = python_chunks(files)
    done = by_structure.select(F.col("file_path").alias("path")).distinct()
    rest = files.join(done, "path", "left_anti")
    return by_structure.unionByName(line_chunks(rest, size, overlap))
