"""The vector index kept up to date from a stream of delivered files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.operators.vectors import build_index
from codelode.sources.files import indexable


def follow(spark: SparkSession, source: str, index_dir: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads new Parquet files of ``source`` (path, content) and appends their chunks as one version per batch.

    Each batch goes to its own folder named by the batch's number, so a batch that is run again after a
    failure replaces itself and nothing is added twice. current_index reads the newest version of each file.
    """
    stream = spark.readStream.schema("path string, content string").parquet(source)
    # Of a path delivered several times in a batch the last delivery counts: the newest file's last row.
    stream = stream.select("path", "content", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index").alias("delivery"))

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("content", "delivery").alias("content"))
        build_index(indexable(last)).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{index_dir}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()


def current_index(spark: SparkSession, index_dir: str) -> DataFrame:
    """The newest version of each file's chunks."""
    t = spark.read.parquet(index_dir)
    newest = t.groupBy("file_path").agg(F.max("version").alias("version"))
    return t.join(newest, ["file_path", "version"], "left_semi").drop("batch")
