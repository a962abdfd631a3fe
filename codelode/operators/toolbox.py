"""The operators that an agent may call, by name."""

from __future__ import annotations

from codelode.operators import extraction, retrieval
from codelode.operators.agents import Registry
from codelode.operators.search import code_search
from codelode.operators.vectors import embed_text, top_k
from codelode.sources.files import directory_entries, file_info, file_lines, find_files, log_of_file, tree_text

# Which tools each step may use.
STEPS = {
    "comprehension": ("code_search", "find_files", "list_directory"),
    "navigation": ("code_search", "find_files", "list_directory", "read_file", "file_outline", "function_source", "semantic_search", "graph_search", "find_callers", "find_callees"),
    "confirmation": ("code_search", "read_file", "function_source", "git_log", "graph_search"),
}


def tools_of_step(r: Registry, step: str) -> list[dict]:
    """The schemas of the tools that a step may use."""
    return r.schemas(STEPS[step])


def registry(files, graph=None, index=None, commits=None, language: str | None = None) -> Registry:
    """Tools bound to a corpus; those whose data is missing say so when called.

    Without a graph but with a ``language`` (or ``auto``) the graph is built when it is first asked for, and kept.
    """
    r = Registry()
    held = [graph]

    def graph_of():
        if held[0] is None and language is not None:
            held[0] = extraction.build_graph(files, language).settled()
        return need(held[0], "the graph")

    def need(table, name):
        if table is None:
            raise ValueError(f"{name} is not available")
        return table

    one = lambda path: files.where(files["path"] == path)
    text, number, flag = "string", "integer", "boolean"
    r.register("code_search", lambda query, is_regex=False, max_results=50: code_search(files, query, is_regex, max_results=max_results), {"query": text, "is_regex": flag, "max_results": number}, "Lines of source files that hold a text or match a pattern, with the lines around them.", ("query",))
    r.register("find_files", lambda pattern, max_results=100: find_files(files, pattern, None, max_results), {"pattern": text, "max_results": number}, "Files whose name contains a text, whatever its case.", ("pattern",))
    r.register("list_directory", lambda max_depth=2: tree_text(directory_entries(files, max_depth)), {"max_depth": number}, "Directories and files down to a depth, directories first.")
    r.register("read_file", lambda path, start_line=1, end_line=None: file_lines(one(path), start_line, end_line), {"path": text, "start_line": number, "end_line": number}, "Numbered lines of a file.", ("path",))
    r.register("file_info", lambda path: file_info(one(path)), {"path": text}, "Size, language and number of lines of a file.", ("path",))
    r.register("file_outline", lambda path: extraction.outline(extraction.python_structure(one(path))), {"path": text}, "Imports, classes, methods and functions of a Python file.", ("path",))
    r.register("function_source", lambda path, function, class_name=None: extraction.function_source(one(path), extraction.python_structure(one(path)), function, class_name), {"path": text, "function": text, "class_name": text}, "The numbered source of a function or method of a Python file.", ("path", "function"))
    r.register("semantic_search", lambda query, k=10: top_k(need(index, "the vector index"), embed_text(query), "chunk_id", k), {"query": text, "k": number}, "Chunks of code whose vectors are most similar to that of a text.", ("query",))
    r.register("graph_search", lambda query, k=10: retrieval.search(graph_of(), query, k), {"query": text, "k": number}, "Code that names in a text lead to, with what it calls, is called by and stands beside.", ("query",))
    r.register("find_callers", lambda name: graph_of().callers_of(name), {"name": text}, "Who calls the functions of a name.", ("name",))
    r.register("find_callees", lambda name: graph_of().callees_of(name), {"name": text}, "What the functions of a name call.", ("name",))
    r.register("git_log", lambda path=None, max_entries=10: log_of_file(need(commits, "the commit log"), path, max_entries), {"path": text, "max_entries": number}, "The newest commits, of one file if asked.")
    return r
