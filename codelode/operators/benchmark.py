"""Runs a localiser over bug instances and sums up what it found."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from codelode.functions.text import basename, project_long
from codelode.operators.evaluation import per_instance

RESULTS = "instance_id string, predicted array<string>, time double, llm_calls long, tool_calls long, error string"


def run(instances: DataFrame, localize: Callable[[str, str], list[str]], limit: int | None = None) -> DataFrame:
    """RESULTS of ``localize(instance_id, report)`` for each instance, in order of id; a failure is an error row, not the end.

    A benchmark's instances are few, and a localisation is itself a distributed search: the loop is over instances.
    """
    spark = instances.sparkSession
    asked = instances.where("instance_id is not null").select("instance_id", F.coalesce("problem_statement", F.lit("")).alias("report")).dropDuplicates(["instance_id"]).orderBy("instance_id")
    rows = []
    for r in (asked.limit(limit) if limit else asked).toLocalIterator():
        begun = time.monotonic()
        found, error = [], None
        try:
            found = localize(r["instance_id"], r["report"])
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
        rows.append((r["instance_id"], found, time.monotonic() - begun, 0, 1, error))
    return spark.createDataFrame(rows, RESULTS)


def evaluate(instances: DataFrame, results: DataFrame, top_n: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Every instance with its results, hits, ``rr`` and ``ap``; one without a result keeps an error row."""
    truth = instances.where("instance_id is not null").select("instance_id", F.coalesce("buggy_files", F.array().cast("array<string>")).alias("ground_truth")).dropDuplicates(["instance_id"])
    both = truth.join(results.dropDuplicates(["instance_id"]), "instance_id", "left")
    none = F.col("predicted").isNull()
    return per_instance(both.withColumns({"error": F.when(none & F.col("error").isNull(), "no result").otherwise(F.col("error")), "predicted": F.coalesce("predicted", F.array().cast("array<string>"))}), top_n)


def totals(evaluated: DataFrame, workers: int = 1) -> DataFrame:
    """One row: instances, errors, sums of calls, and mean time per instance, as wall clock where several run at once."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return evaluated.agg(F.count("*").alias("instances"), F.count_if(F.col("error").isNotNull()).alias("errors"), total("llm_calls").alias("llm_calls"), total("tool_calls").alias("tool_calls"), (F.coalesce(F.sum("time"), F.lit(0.0)) / workers / F.greatest(F.count("*"), F.lit(1))).alias("mean_time"))


def by_project_and_all(evaluated: DataFrame) -> DataFrame:
    """Metrics of each project and of all instances (project ``*``) in one pass."""
    t = evaluated.withColumn("project", F.explode(F.array(project_long(F.col("instance_id")), F.lit("*"))))
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return t.groupBy("project").agg(F.count("*").alias("n"), *[mean(f"top{n}_hit").alias(f"top_{n}_accuracy") for n in (1, 3, 5)], mean("rr").alias("mrr"), mean("ap").alias("map"))


def preview(instances: DataFrame, limit: int | None = None) -> DataFrame:
    """``(instance_id, files, names, report)``: how many true files, the names of the first three, and the report's start."""
    c = F.regexp_replace(F.coalesce("problem_statement", F.lit("")), r"\s+", " ")
    short = F.when(F.length(c) > 60, F.concat(F.substring(c, 1, 60), F.lit("..."))).otherwise(c)
    f = F.coalesce("buggy_files", F.array().cast("array<string>"))
    t = instances.where("instance_id is not null").dropDuplicates(["instance_id"]).select("instance_id", F.size(f).cast("long").alias("files"), F.array_join(F.transform(F.slice(f, 1, 3), basename), ", ").alias("names"), short.alias("report"))
    return t.orderBy("instance_id").limit(limit) if limit else t


def extended_keywords(before: DataFrame, answers: DataFrame) -> DataFrame:
    """``(instance_id, keywords, files)``: keywords of an answer are put after those already held, its candidates replace the old ones.

    ``before(instance_id, keywords, files)`` and ``answers(instance_id, keywords, files)``; a null field of an answer changes nothing.
    """
    a = answers.select("instance_id", F.col("keywords").alias("more"), F.col("files").alias("new"))
    none = F.array().cast("array<string>")
    return before.join(a, "instance_id", "left").select("instance_id", F.concat(F.coalesce("keywords", none), F.coalesce("more", none)).alias("keywords"), F.coalesce("new", "files", none).alias("files"))

