"""Command line: python -m codelode index|query|graph|search|localize|evaluate ROOT ..."""

from __future__ import annotations

import argparse

from codelode.config import Settings
from codelode.operators import benchmark, extraction, render, retrieval
from codelode.operators.evaluation import metrics, unpivot
from codelode.operators.reports import write_results
from codelode.operators.search import code_search
from codelode.operators.vectors import build_index, embed_text, index_stats, open_index, top_k, write_index
from codelode.session import get_session
from codelode.sources.files import indexable, read_tree


def main(argv: list[str] | None = None) -> int:
    s = Settings.from_env()
    p = argparse.ArgumentParser(prog="codelode")
    p.add_argument("command", choices=("index", "query", "graph", "search", "localize", "evaluate"))
    p.add_argument("root", help="folder of source files")
    p.add_argument("--text", default="", help="what is asked or searched for")
    p.add_argument("--index", default="codelode-index")
    p.add_argument("--language", default="auto", choices=("auto", "python", "java"))
    p.add_argument("--regex", action="store_true")
    p.add_argument("--instances", help="evaluate: JSON lines with instance_id, problem_statement, buggy_files")
    p.add_argument("--limit", type=int, default=None, help="evaluate: how many instances")
    p.add_argument("--out", default=None, help="evaluate: base name of the reports")
    p.add_argument("-k", type=int, default=s.top_k)
    p.add_argument("--master", default=None)
    a = p.parse_args(argv)
    spark = get_session(master=a.master)
    files = read_tree(spark, a.root)
    if a.command == "index":
        write_index(build_index(indexable(files), s.chunk_chars, s.chunk_overlap), a.index)
        print(index_stats(open_index(spark, a.index)), "chunks")
        return 0
    if a.command == "query":
        index = open_index(spark, a.index)
        if index is None:
            print("no index at", a.index)
            return 1
        out = render.vector_hits(top_k(index, embed_text(a.text), "chunk_id", a.k))
    elif a.command == "search":
        out = render.search_hits(code_search(files, a.text, a.regex, max_results=s.search_results, context_lines=s.context_lines))
    else:
        graph = extraction.build_graph(files, a.language)
        index = open_index(spark, a.index)
        if a.command == "evaluate":
            instances = spark.read.schema("instance_id string, problem_statement string, buggy_files array<string>").json(a.instances)
            graph = graph.settled()
            done = benchmark.run(instances, lambda _, report: [r["file_path"] for r in retrieval.localize(files, graph, report, a.k, index).collect()], a.limit)
            rows = benchmark.evaluate(instances.join(done.select("instance_id"), "instance_id", "left_semi"), done, s.top_n)
            if a.out:
                write_results(rows, a.out)
            for r in unpivot(metrics(rows, s.top_n)).unionByName(unpivot(benchmark.totals(rows))).collect():
                print(f"{r['metric']}: {r['value']:.4f}")
            return 0
        if a.command == "localize":
            out = retrieval.localize(files, graph, a.text, a.k, index).selectExpr("concat(format_string('%.5f', score), '  ', file_path) AS text", "score", "file_path").orderBy("score", ascending=False)
        elif a.text:
            out = render.graph_hits(retrieval.search(graph, a.text, a.k, s.graph_depth), graph.nodes, retrieval.snippets(graph.nodes, files))
        else:
            out = graph.stats().selectExpr("concat_ws(' ', kind, type, n) AS text", "kind", "type").orderBy("kind", "type")
    order = [c for c in ("rank", "path", "line_number") if c in out.columns]
    for r in (out.orderBy(*order) if order else out).limit(max(a.k, s.search_results)).collect():
        print(r["text"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
