"""Vector index over chunks and exact cosine search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from codelode.functions.text import cosine
from codelode.operators.chunking import CHUNK_CHARS, OVERLAP_CHARS, chunk_files
from codelode.session import cut_lineage

DIM = 64
#: Queries compared with the table at a time; each task holds one block.
QUERY_BLOCK = 2048


def embed_text(text: str, dim: int = DIM) -> list[float]:
    """A deterministic stand-in for a model: hashed parts of names, signed, of unit length."""
    import xxhash

    v = np.zeros(dim)
    for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", text or ""):
        h = xxhash.xxh64_intdigest(w.lower())
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(text: Column) -> Column:
    """Vectors of texts, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(embed_text)

    return run(text)


def build_index(files: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Chunks with ids and embeddings, as the index stores them.

    The id holds path and lines and the chunk's number within its file, so an index can be rebuilt file by file.
    """
    w = Window.partitionBy("file_path").orderBy("start_line", "end_line", "chunk_type", "function_name")
    c = chunk_files(files, size, overlap).withColumn("n", F.row_number().over(w) - 1)
    key = F.concat_ws("::", "file_path", F.concat_ws("-", "start_line", "end_line"), "n")
    return c.select(key.alias("chunk_id"), *[x.split()[0] for x in "file_path string, start_line int, end_line int, function_name string, class_name string, chunk_type string, text string".split(", ")], embed(F.col("text")).alias("embedding"))


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def upsert_index(index: DataFrame, fresh: DataFrame, out: str) -> None:
    """Writes ``index`` with the files of ``fresh`` replaced whole, so no stale chunk of an edited file stays."""
    kept = index.join(fresh.select("file_path").distinct(), "file_path", "left_anti")
    kept.unionByName(fresh).write.mode("overwrite").parquet(out)


def open_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored index, or None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def index_stats(index: DataFrame | None) -> int:
    return index.count() if index is not None else 0


def similarity(vector: list[float], column: Column) -> Column:
    """Cosine of a fixed vector and a column, rounded to 6 places; null for another width or no length."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return F.when(F.size(column) == len(vector), F.round(cosine(column, q), 6))


def top_k(table: DataFrame, vector: list[float], key: str, k: int = 10, file_filter: str | None = None, chunk_type: str | None = None) -> DataFrame:
    """The ``k`` most similar rows, ties by ``key``; filters come before the search."""
    if file_filter:
        table = table.where(F.contains("file_path", F.lit(file_filter)))
    if chunk_type:
        table = table.where(F.col("chunk_type") == chunk_type)
    return table.withColumn("similarity", similarity(vector, F.col("embedding"))).where(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), key).limit(k)


def similar_files(chunks: DataFrame, vector: list[float], k: int = 20) -> DataFrame:
    """``(file_path, similarity)``: files by their best chunk; empty paths are passed over."""
    t = chunks.where("file_path <> ''").withColumn("similarity", similarity(vector, F.col("embedding"))).where(F.col("similarity").isNotNull())
    return t.groupBy("file_path").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "file_path").limit(k)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def search_all(table: DataFrame, queries: DataFrame, key: str, k: int = 5) -> DataFrame:
    """``(query, near, similarity)``: for a stated set of query rows the ``k`` most similar rows of the table.

    Queries are taken in blocks; each task keeps the best of its rows for a block's queries, so what is
    shuffled is k rows per query and task, whatever the table's size. Rows do not find
    themselves; ties go to the smaller key.
    """
    spark = table.sparkSession
    fits = F.size("embedding") == DIM
    # Kept once: a set made by a limit must not differ from one use to the next.
    asked = cut_lineage(queries.where(fits).select(F.col(key).alias("q"), "embedding").dropDuplicates(["q"]))
    n_blocks = -(-asked.count() // QUERY_BLOCK)
    # Inner cuts may be inexact for large keys; the first must be the least key.
    least, cuts = asked.agg(F.min("q"), F.percentile_approx("q", [i / max(1, n_blocks) for i in range(max(1, n_blocks))], 10_000)).first()
    bounds = sorted({least, *(c for c in cuts if c > least)}) if n_blocks else []
    out = None
    rows = table.where(fits).select(F.col(key).alias("key"), "embedding")
    for lo, hi in zip(bounds, [*bounds[1:], None]):
        block = asked.where((F.col("q") >= lo) & (F.lit(True) if hi is None else F.col("q") < hi)).toArrow().combine_chunks()
        ids = np.asarray(block.column(0).combine_chunks(), dtype=np.int64)
        q = _rows(block.column(1).combine_chunks(), DIM)
        q_b = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def best(batches: Iterator[pa.RecordBatch], q_b=q_b) -> Iterator[pa.RecordBatch]:
            ids, q = q_b.value
            held: list[pd.DataFrame] = []
            for b in batches:
                if not b.num_rows:
                    continue
                keys, x = np.asarray(b.column(0), dtype=np.int64), _rows(b.column(1), DIM)
                n = np.linalg.norm(x, axis=1)
                s = np.round((q @ x.T) / np.where(n > 0, n, np.nan), 6)
                s[(ids[:, None] == keys[None, :]) | np.isnan(s)] = -9
                order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :k]
                held.append(pd.DataFrame({"query": np.repeat(ids, order.shape[1]), "near": keys[order].ravel(), "similarity": np.take_along_axis(s, order, 1).ravel()}))
                if len(held) > 8:
                    held = [_keep(held, k)]
            if held:
                yield pa.RecordBatch.from_pandas(_keep(held, k), preserve_index=False)

        part = rows.mapInArrow(best, "query long, near long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query long, near long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "near")
    return out.where("similarity > -2").distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def _keep(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    t = pd.concat(parts).drop_duplicates().sort_values(["query", "similarity", "near"], ascending=[True, False, True])
    return t.groupby("query", sort=False).head(k)
