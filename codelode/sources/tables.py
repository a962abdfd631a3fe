"""The delivered tables, cleaned to one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each path."""
    w = Window.partitionBy("path").orderBy(F.desc_nulls_last("ingested_at"), F.desc_nulls_last("content"))
    return table(spark, d, "source_files").where("path is not null").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return upsert_nodes(table(spark, d, "graph_nodes"))


def upsert_nodes(log: DataFrame) -> DataFrame:
    """The node log as a table: the last insert's values at the first insert's place (``position``).

    Aggregates per id with map-side combine, so re-inserted hot nodes do not gather. Null texts become empty.
    """
    cols = ["name", "node_type", "file_path", "start_line", "end_line", "signature", "docstring", "metadata"]
    g = log.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*cols), "seq").alias("v"), F.min("seq").alias("position"), F.max("seq").alias("seq"))
    text = [F.coalesce(F.col(f"v.{c}"), F.lit("")).alias(c) for c in ("name", "node_type", "file_path", "signature", "docstring")]
    num = [F.coalesce(F.col(f"v.{c}"), F.lit(0)).alias(c) for c in ("start_line", "end_line")]
    return g.select("id", *text, *num, F.col("v.metadata").alias("metadata"), "seq", "position")


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return clean_edges(table(spark, d, "graph_edges"))


def clean_edges(log: DataFrame) -> DataFrame:
    """Edges with types in upper case and without outer blanks; a multiset, except that a row repeated with its ``seq`` is one."""
    kind = F.upper(F.regexp_replace("edge_type", r"^\s+|\s+$", ""))
    return log.where("source_id is not null and target_id is not null").select("source_id", "target_id", kind.alias("edge_type"), "seq").distinct()


def bug_instances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bug_instances").where("instance_id is not null").dropDuplicates(["instance_id"])


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks once per ``seq``, types in lower case."""
    c = table(spark, d, "code_chunks").dropDuplicates(["seq"])
    return c.withColumn("chunk_type", F.lower("chunk_type"))
