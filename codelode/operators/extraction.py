"""Source files to structure: Python through its own parser, Java through patterns."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codelode.operators.graph import CodeGraph, resolve_calls
from codelode.session import cut_lineage
from codelode.sources.files import GRAPH_SKIP_DIRS, in_skipped
from codelode.sources.tables import upsert_nodes

#: One table for all that a file gives: a node, an edge, or a call by name (target is the name then).
FACTS = "path string, ord int, kind string, id string, name string, node_type string, file_path string, start_line int, end_line int, signature string, docstring string, target string, edge_type string"
_NAMES = [x.split()[0] for x in FACTS.split(", ")]
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


class Facts:
    """Collects the facts of one file in order."""

    def __init__(self, path: str) -> None:
        self.path, self.rows = path, []

    def node(self, id: str, name: str, kind: str, file_path: str, start: int = 0, end: int = 0, signature: str = "", docstring: str = "") -> None:
        self.rows.append((self.path, len(self.rows), "node", id, name, kind, file_path, start, end, signature, docstring, None, None))

    def edge(self, source: str, target: str, kind: str) -> None:
        self.rows.append((self.path, len(self.rows), "edge", source, None, None, None, 0, 0, None, None, target, kind))

    def call(self, caller: str, callee: str) -> None:
        self.rows.append((self.path, len(self.rows), "call", caller, None, None, None, 0, 0, None, None, callee, None))


def call_name(node: ast.Call) -> str:
    """The last name of what is called; empty for calls of other expressions."""
    f = node.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""


def python_facts(path: str, text: str) -> list[tuple]:
    """Nodes, edges and calls of the top level of a Python file; nothing if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = Facts(path)
    top = f"file::{path}"
    out.node(top, path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "file", path)

    def function(node, parent: str, cls: str = "") -> None:
        id = f"method::{path}::{cls}.{node.name}" if cls else f"function::{path}::{node.name}"
        out.node(id, node.name, "method" if cls else "function", path, node.lineno, node.end_lineno, f"def {node.name}({', '.join(a.arg for a in node.args.args)})", ast.get_docstring(node) or "")
        out.edge(parent, id, "CONTAINS")
        for x in ast.walk(node):  # breadth first, as caps on edges count
            if isinstance(x, ast.Call) and (name := call_name(x)):
                out.call(id, name)

    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                out.node(f"module::{a.name}", a.name, "module", "")
                out.edge(top, f"module::{a.name}", "IMPORTS")
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                full = f"{node.module}.{a.name}" if node.module else a.name
                out.node(f"symbol::{full}", a.name, "symbol", "")
                out.edge(top, f"symbol::{full}", "IMPORTS")
        elif isinstance(node, ast.ClassDef):
            id = f"class::{path}::{node.name}"
            out.node(id, node.name, "class", path, node.lineno, node.end_lineno, f"class {node.name}", ast.get_docstring(node) or "")
            out.edge(top, id, "CONTAINS")
            for b in node.bases:
                if isinstance(b, (ast.Name, ast.Attribute)):
                    out.edge(id, f"class::*::{ast.unparse(b)}", "INHERITS")
            for m in node.body:
                if isinstance(m, FUNCTIONS):
                    function(m, id, node.name)
        elif isinstance(node, FUNCTIONS):
            function(node, top)
    return out.rows


# Patterns that decide what counts as a Java declaration.
JAVA_CLASS = re.compile(r"^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+)?(?:class|interface|enum)\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?", re.M)
JAVA_METHOD = re.compile(r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(?:synchronized\s+)?(?:abstract\s+)?(?:[\w<>\[\],\s]+?)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w,\s]+)?\s*\{", re.M)
JAVA_IMPORT = re.compile(r"^\s*import\s+([\w.]+);", re.M)
JAVA_CALL = re.compile(r"\b(\w+)\s*\(")
JAVA_WORDS = frozenset("if for while switch catch return new throw super this".split())
#: What strict mode accepts besides: nested static classes and generic heads.
JAVA_CLASS_STRICT = re.compile(r"^\s*(?:(?:public|private|protected|abstract|final|static|sealed)\s+)*(?:class|interface|enum|record)\s+(\w+)(?:\s*<[^{(]*?>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(\w+)(?:<[^{]*?>)?)?(?:\s+implements\s+([\w,\s<>]+))?", re.M)


#: All that may stand before a method's bracket, and the bracket with what must follow it.
_BEFORE = re.compile(r"[\w<>\[\],\s]+")
_HEAD_END = re.compile(r"\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{")


def java_method_heads(text: str) -> Iterator[re.Match[str]]:
    """What ``JAVA_METHOD.finditer`` gives, in time that is in proportion to the text.

    A match lies in one run of the characters that may stand before a bracket, ends with it, and starts at the
    run's first line start, or nowhere in it: all later starts leave less to match. So each run is tried
    once, and only if its bracket closes before a brace.
    """
    last = 0
    for run in _BEFORE.finditer(text):
        at = run.end()
        if at < last or text[at : at + 1] != "(" or not _HEAD_END.match(text, at):
            continue
        begin = max(run.start(), last)
        start = 0 if begin == 0 else text.find("\n", begin, at) + 1
        if (start or begin == 0) and (m := JAVA_METHOD.match(text, start)):
            yield m
            last = m.end()


def block_after(text: str, start: int) -> str:
    """Text up to the brace that closes one opened before ``start``; empty without it."""
    depth = 1
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return text[start : m.start()]
    return ""


def java_facts(path: str, text: str, strict: bool = False) -> list[tuple]:
    """Nodes, edges and calls of a Java file by patterns.

    Methods belong to the class that starts last before them. Calls go to placeholders. In the default mode a
    control statement that starts its line counts as a method, as the patterns have it; strict mode drops
    those and also reads static, generic and record heads.
    """
    out = Facts(path)
    top = f"file::{path}"
    out.node(top, path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "file", path)
    line = lambda at: text.count("\n", 0, at) + 1
    for m in JAVA_IMPORT.finditer(text):
        out.node(f"import::{m[1]}", m[1].rsplit(".", 1)[-1], "import", "")
        out.edge(top, f"import::{m[1]}", "IMPORTS")
    classes = []
    for m in (JAVA_CLASS_STRICT if strict else JAVA_CLASS).finditer(text):
        id = f"class::{path}::{m[1]}"
        classes.append((m.start(), m[1]))
        out.node(id, m[1], "class", path, line(m.start()), 0, f"class {m[1]}")
        out.edge(top, id, "CONTAINS")
        bases = [m[2]] if m[2] else []
        bases += [re.sub(r"<.*", "", x).strip() for x in (m[3] or "").split(",")]
        for b in bases:
            if b:
                out.edge(id, f"class::*::{b}", "INHERITS")
    starts = [a for a, _ in classes]
    for m in java_method_heads(text):
        if strict and m[1] in JAVA_WORDS:
            continue
        i = bisect_right(starts, m.start())
        cls = classes[i - 1][1] if i else ""
        id = f"method::{path}::{cls}.{m[1]}" if cls else f"function::{path}::{m[1]}"
        out.node(id, m[1], "method" if cls else "function", path, line(m.start()), 0, f"{m[1]}({m[2].strip()})")
        out.edge(f"class::{path}::{cls}" if cls else top, id, "CONTAINS")
        for c in JAVA_CALL.finditer(block_after(text, m.end())):
            if c[1] not in JAVA_WORDS:
                out.edge(id, f"method::*::*.{c[1]}", "CALLS")
    return out.rows


def _facts(strict: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for path, text in zip(pdf["path"], pdf["content"]) for r in (python_facts(path, text) if path.endswith(".py") else java_facts(path, text, strict))]
            yield pd.DataFrame(rows, columns=_NAMES).astype({"ord": "int32", "start_line": "int32", "end_line": "int32"})

    return run


def graph_files(files: DataFrame, suffix: str) -> DataFrame:
    p = F.col("path")
    return files.where(p.endswith(suffix) & F.col("content").isNotNull() & ~in_skipped(p, GRAPH_SKIP_DIRS[suffix], ""))


def build_graph(files: DataFrame, language: str = "python", strict_java: bool = False, resolve_placeholders: bool = False) -> CodeGraph:
    """The graph of all files of a language; one pass over the files gives nodes, edges and calls.

    Insertion order is that of paths and of statements, kept in ``seq``. Python calls become edges by name
    lookup; Java's stay with placeholder targets unless ``resolve_placeholders`` is set. ``auto`` takes
    Java where there are strictly more Java files, else Python.
    """
    if language == "auto":
        n = files.select(F.count_if(F.col("path").endswith(".py")).alias("py"), F.count_if(F.col("path").endswith(".java")).alias("java")).first()
        language = "java" if n["java"] > n["py"] else "python"
    f = graph_files(files, ".py" if language == "python" else ".java")
    facts = f.select("path", "content").mapInPandas(_facts(strict_java), FACTS)
    # Numbers that grow along a sorted table: by path, then by place in the file, without one task for all.
    facts = cut_lineage(facts.orderBy("path", "ord").withColumn("seq", F.monotonically_increasing_id()))
    log = facts.where("kind = 'node'").select("id", "name", "node_type", "file_path", "start_line", "end_line", "signature", "docstring", F.lit(None).cast("map<string,string>").alias("metadata"), "seq")
    nodes = upsert_nodes(log)
    edges = facts.where("kind = 'edge'").select(F.col("id").alias("source_id"), F.col("target").alias("target_id"), "edge_type", "seq")
    functions = nodes.where("node_type in ('function', 'method')")
    names = nodes.select(F.col("id").alias("target_id"), "name")
    imported = edges.where("edge_type = 'IMPORTS'").join(names, "target_id").join(nodes.select(F.col("id").alias("source_id"), "file_path"), "source_id").select("file_path", "name")
    if language == "python":
        calls = facts.where("kind = 'call'").select(F.col("id").alias("caller_id"), F.col("path").alias("file_path"), F.col("target").alias("callee"), F.col("seq").alias("ord"))
    elif resolve_placeholders:
        calls = edges.where("edge_type = 'CALLS'").select(F.col("source_id").alias("caller_id"), F.regexp_extract("target_id", r"\*\.(.*)$", 1).alias("callee"), F.col("seq").alias("ord"))
        calls = calls.join(functions.select(F.col("id").alias("caller_id"), "file_path"), "caller_id")
        edges = edges.where("edge_type <> 'CALLS'")
    else:
        return CodeGraph(nodes, edges)
    found = resolve_calls(calls, functions, imported)
    # Calls come after everything else, in the order of their callers.
    at = functions.select(F.col("id").alias("caller_id"), F.col("position").alias("caller_at"))
    made = found.join(at, "caller_id").select(F.col("caller_id").alias("source_id"), F.col("callee_id").alias("target_id"), F.lit("CALLS").alias("edge_type"), (F.lit(1 << 60) + F.col("caller_at") * 16 + F.col("k")).alias("seq"))
    return CodeGraph(nodes, edges.unionByName(made))


FUNCTION = "struct<name:string,qualified_name:string,start_line:int,end_line:int,args:array<string>,decorators:array<string>,docstring:string,is_method:boolean,class_name:string>"
STRUCTURE = f"path string, imports array<string>, classes array<struct<name:string,start_line:int,end_line:int,bases:array<string>,docstring:string,methods:array<{FUNCTION}>>>, functions array<{FUNCTION}>, global_variables array<string>"


def file_structure(path: str, text: str) -> tuple:
    """Imports, classes with methods, functions and plain globals of a Python file; empty if it does not parse."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        body = []

    def function(n, cls: str = "") -> dict:
        return {"name": n.name, "qualified_name": f"{cls}.{n.name}" if cls else n.name, "start_line": n.lineno, "end_line": n.end_lineno, "args": [a.arg for a in n.args.args], "decorators": [ast.unparse(d) for d in n.decorator_list], "docstring": ast.get_docstring(n) or "", "is_method": bool(cls), "class_name": cls}

    imports, classes, functions, names = [], [], [], []
    for n in body:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            imports.append(ast.unparse(n))
        elif isinstance(n, ast.ClassDef):
            bases = [ast.unparse(b) for b in n.bases if isinstance(b, (ast.Name, ast.Attribute))]
            classes.append({"name": n.name, "start_line": n.lineno, "end_line": n.end_lineno, "bases": bases, "docstring": ast.get_docstring(n) or "", "methods": [function(m, n.name) for m in n.body if isinstance(m, FUNCTIONS)]})
        elif isinstance(n, FUNCTIONS):
            functions.append(function(n))
        elif isinstance(n, ast.Assign):
            names += [t.id for t in n.targets if isinstance(t, ast.Name)]
    return path, imports, classes, functions, names


def _structures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([file_structure(p, t) for p, t in zip(pdf["path"], pdf["content"])], columns=["path", "imports", "classes", "functions", "global_variables"])


def python_structure(files: DataFrame) -> DataFrame:
    """STRUCTURE rows of the Python files."""
    return files.where(F.col("path").endswith(".py") & F.col("content").isNotNull()).select("path", "content").mapInPandas(_structures, STRUCTURE)


def outline(structure: DataFrame) -> DataFrame:
    """``(path, outline)``: classes, methods and functions as text."""
    span = lambda x: F.concat(F.lit("  [L"), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"), F.lit("]"))
    deco = lambda x: F.when(F.size(x["decorators"]) > 0, F.concat(F.lit("@"), F.get(x["decorators"], F.lit(0)), F.lit(" "))).otherwise("")
    head = lambda x: F.concat(deco(x), F.lit("def "), x["name"], F.lit("("), F.array_join(x["args"], ", "), F.lit(")"), span(x))
    cls = lambda c: F.concat_ws("\n", F.concat(F.lit("class "), c["name"], F.when(F.size(c["bases"]) > 0, F.concat(F.lit("("), F.array_join(c["bases"], ", "), F.lit(")"))).otherwise(""), F.lit(":"), span(c)), F.when(c["docstring"] != "", F.concat(F.lit('  """'), F.substring(c["docstring"], 1, 100), F.lit('..."""'))), F.when(F.size(c["methods"]) > 0, F.array_join(F.transform(c["methods"], lambda m: F.concat(F.lit("  "), head(m))), "\n")), F.lit(""))
    extra = F.when(F.size("imports") > 10, F.concat(F.lit("\n  ... and "), (F.size("imports") - 10).cast("string"), F.lit(" more"))).otherwise("")
    imports = F.when(F.size("imports") > 0, F.concat(F.lit("Imports:\n"), F.array_join(F.transform(F.slice("imports", 1, 10), lambda i: F.concat(F.lit("  "), i)), "\n"), extra, F.lit("\n")))
    parts = [F.concat(F.lit("=== File Outline: "), "path", F.lit(" ===\n")), imports, F.when(F.size("classes") > 0, F.array_join(F.transform("classes", cls), "\n")), F.when(F.size("functions") > 0, F.array_join(F.transform("functions", head), "\n"))]
    return structure.select("path", F.concat_ws("\n", *parts).alias("outline"))


def function_source(files: DataFrame, structure: DataFrame, function: str, class_name: str | None = None) -> DataFrame:
    """``(path, source)``: numbered lines of a function in each file that has it; of same-named classes the last with it counts."""
    if class_name:
        c = F.filter("classes", lambda x: (x["name"] == class_name) & F.exists(x["methods"], lambda m: m["name"] == function))
        target = F.get(F.filter(F.get(c, F.size(c) - 1)["methods"], lambda m: m["name"] == function), F.lit(0))
    else:
        target = F.get(F.filter("functions", lambda f: f["name"] == function), F.lit(0))
    t = structure.select("path", target.alias("f")).where("f is not null").join(files.select("path", F.split("content", "\n", -1).alias("ls")), "path")
    rows = F.transform(F.slice("ls", F.col("f.start_line"), F.col("f.end_line") - F.col("f.start_line") + 1), lambda x, i: F.format_string("%4d | %s", i + F.col("f.start_line"), x))
    return t.select("path", F.concat(F.lit("# "), "f.qualified_name", F.lit(" ["), "path", F.lit("]\n"), F.array_join(rows, "\n")).alias("source"))
