"""Ranking evaluation: hits, reciprocal rank, average precision, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions.text import basename, clean, project_long, project_short, same_file


def top_n_hit(predicted: Column, truth: Column, n: int) -> Column:
    """Whether one of the first ``n`` predictions names a true file; false where there are none."""
    return F.coalesce(F.exists(F.slice(predicted, 1, n), lambda p: F.exists(truth, lambda g: same_file(p, g))), F.lit(False))


def reciprocal_rank(predicted: Column, truth: Column) -> Column:
    """1 over the rank of the first prediction that names a true file; 0 without one."""
    ranks = F.filter(F.transform(predicted, lambda p, i: F.when(F.exists(truth, lambda g: same_file(p, g)), i + 1)), lambda r: r.isNotNull())
    return F.coalesce(F.lit(1.0) / F.array_min(ranks), F.lit(0.0))


def average_precision(predicted: Column, truth: Column) -> Column:
    """Average precision where each true file is found once, by the first prediction that names it.

    A prediction that names several still open ones takes the first. An empty truth gives 0.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum"), F.coalesce(truth, F.array().cast("array<string>")).alias("open"))

    def step(acc: Column, p: Column) -> Column:
        at = F.array_position(F.transform(acc["open"], lambda g: same_file(p, g)), True)
        hit = at > 0
        i, hits = acc["i"] + 1, acc["hits"] + F.when(hit, 1).otherwise(0)
        left = F.when(hit, F.filter(acc["open"], lambda g, k: k != at.cast("int") - 1)).otherwise(acc["open"])
        return F.struct(i.alias("i"), hits.alias("hits"), (acc["sum"] + F.when(hit, hits / i).otherwise(0.0)).alias("sum"), left.alias("open"))

    total = F.aggregate(F.coalesce(predicted, F.array().cast("array<string>")), start, step, lambda a: a["sum"])
    return F.when(F.size(truth) > 0, total / F.size(truth)).otherwise(0.0)


def per_instance(ranked: DataFrame, top_n: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Adds hits, ``rr`` and ``ap`` to rows with ``predicted`` and ``ground_truth``; no shuffle."""
    p, g = F.col("predicted"), F.col("ground_truth")
    return ranked.withColumns({f"top{n}_hit": top_n_hit(p, g, n) for n in top_n} | {"rr": reciprocal_rank(p, g), "ap": average_precision(p, g)})


def metrics(instances: DataFrame, top_n: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row of means over instances; zeros for an empty table."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return instances.agg(*[mean(F.col(f"top{n}_hit").cast("double")).alias(f"top_{n}_accuracy") for n in top_n], mean("rr").alias("mrr"), mean("ap").alias("map"), F.count("*").alias("total_instances"), F.count_if(F.col("rr") > 0).alias("instances_with_match"))


def unpivot(summary: DataFrame) -> DataFrame:
    """One row of metrics as ``(metric, value)``."""
    return summary.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in summary.columns])).alias("s")).select("s.*")


def loose_hit(predicted: Column, truth: Column, n: int) -> Column:
    """The report's own hit: equal path or equal file name."""
    names = F.transform(truth, basename)
    return F.coalesce(F.exists(F.slice(predicted, 1, n), lambda p: F.array_contains(truth, p) | F.array_contains(names, basename(p))), F.lit(False))


def report_rows(instances: DataFrame) -> DataFrame:
    """The 19 columns of the per-instance report, from rows that may lack the optional ones."""
    have = set(instances.columns)
    opt = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    p, g = F.col("predicted"), F.col("ground_truth")
    hits = {n: loose_hit(p, g, n) for n in (1, 3, 5)}
    return instances.select(
        "instance_id",
        project_short(F.col("instance_id")).alias("project"),
        F.coalesce(opt("success", "boolean"), hits[1]).alias("success"),
        *[hits[n].cast("int").alias(f"top{n}_hit") for n in hits],
        F.round("rr", 4).alias("reciprocal_rank"),
        *[F.coalesce(F.get(p, F.lit(i)), F.lit("")).alias(f"predicted_file_{i + 1}") for i in range(5)],
        F.array_join(g, "; ").alias("ground_truth_files"),
        F.coalesce(F.size(p), F.lit(0)).alias("num_predicted"),
        F.round(F.coalesce(opt("time", "double"), F.lit(0.0)), 2).alias("time_seconds"),
        F.coalesce(opt("llm_calls", "string"), F.lit("")).alias("llm_calls"),
        F.coalesce(opt("tool_calls", "string"), F.lit("")).alias("tool_calls"),
        clean(opt("root_cause", "string")).alias("root_cause"),
        clean(opt("explanation", "string")).alias("explanation"),
    )


def by_project(instances: DataFrame) -> DataFrame:
    """Counts and mean hits per project; the project is what stands before the id's last underscore."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return instances.groupBy(project_long(F.col("instance_id")).alias("project")).agg(F.count("*").alias("n"), *[mean(f"top{n}_hit").alias(f"top{n}") for n in (1, 3, 5)], F.avg("rr").alias("mrr"))


def time_summary(instances: DataFrame) -> DataFrame:
    """Mean, least, most and total time of the instances that took any."""
    return instances.where(F.col("time") > 0).agg(F.avg("time").alias("mean_time"), F.min("time").alias("least_time"), F.max("time").alias("most_time"), F.sum("time").alias("total_time"))
