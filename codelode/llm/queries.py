"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelode.llm import documented, handwritten, leakage, neighbours, packing, splitting, stuffing, syntax

Query = Callable[[SparkSession, str], DataFrame]


def _on(table: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(spark.read.parquet(f"{d}/{table}.parquet"))


def _leaks(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/bug_instances.parquet"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on("code_chunks", splitting.p1_found),
        "p1_pieces": _on("code_chunks", splitting.split_chunks),
        "p2_found": _on("source_files", documented.p2_found),
        "p2_pairs": _on("source_files", documented.useful_pairs),
        "p3_found": _on("code_chunks", neighbours.p3_found),
        "p3_neighbours": _on("code_chunks", neighbours.chunk_neighbours),
        "p4_found": _on("source_files", handwritten.p4_found),
        "p4_files": _on("source_files", handwritten.judge_files),
        "p6_found": _on("source_files", syntax.p6_found),
        "p6_files": _on("source_files", syntax.invalid_files),
        "p6_rates": _on("source_files", syntax.syntax_rates),
        "p7_found": _on("documents", packing.p7_found),
        "p7_pack": _on("documents", packing.pack_documents),
        "p7_report": lambda s, d: packing.window_report(packing.pack_documents(s.read.parquet(f"{d}/documents.parquet"))),
        "p8_found": _leaks(leakage.p8_found),
        "p8_pairs": _leaks(leakage.leaks),
        "p9_found": _on("documents", stuffing.p9_found),
        "p9_pages": _on("documents", stuffing.judge_pages),
    }


def oracle_sql() -> dict[str, str]:
    token = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x{85}]+"
    return {
        "p1_found": "SELECT DISTINCT chunk_id FROM code_chunks WHERE length(text) > 1500",
        "p7_found": f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '{token}')) > 1024",
    }
