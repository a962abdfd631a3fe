"""Queries on ranking evaluation, reports, answers and events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from codelode.functions import text as T
from codelode.operators import agents, evaluation as E
from codelode.plans.corpus import BUGS
from codelode.sources import tables


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """A ranking per bug: the buggy files of its repository's bugs in a fixed shuffled order, against its own."""
    b = tables.bug_instances(spark, d)
    files = b.select("repo", F.explode("buggy_files").alias("f")).distinct()
    p = b.select("instance_id", "repo").join(files, "repo", "left").groupBy("instance_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("f").isNotNull(), F.struct(F.md5(F.concat("instance_id", "f")).alias("h"), "f")))), lambda s: s["f"]), 1, 8).alias("predicted"))
    g = b.select("instance_id", F.coalesce("buggy_files", F.array().cast("array<string>")).alias("ground_truth"), (F.char_length("problem_statement") / 100.0).alias("time"))
    return E.per_instance(p.join(g, "instance_id"))


def topn_hits(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).select("instance_id", "top1_hit", "top3_hit", "top5_hit")


def reciprocal_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).select("instance_id", F.round("rr", 9).alias("rr"))


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).select("instance_id", F.round("ap", 9).alias("ap"))


def compute_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = E.metrics(ranked(spark, d))
    return m.select(*[F.round(c, 9).alias(c) if c not in ("total_instances", "instances_with_match") else F.col(c) for c in m.columns])


def unpivot_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.unpivot(E.metrics(ranked(spark, d))).select("metric", F.round("value", 9).alias("value"))


def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return E.report_rows(ranked(spark, d)).select("instance_id", "project", "success", "top1_hit", "top3_hit", "top5_hit", "reciprocal_rank", "predicted_file_1", "predicted_file_5", "ground_truth_files", "num_predicted", "time_seconds")


def path_match_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Paths of bugs against the delivered paths of the same name, put right in several ways."""
    b = tables.bug_instances(spark, d).select(F.explode("buggy_files").alias("a")).distinct()
    f = tables.source_files(spark, d).select(F.col("path").alias("b"))
    p = b.join(f, T.basename(F.col("a")) == T.basename(F.col("b")))
    every = p.union(b.select("a", F.concat(F.lit("/x/"), F.replace("a", F.lit("/"), F.lit("\\")), F.lit(" ")).alias("b"))).union(b.select("a", F.concat(F.lit("my_"), T.basename(F.col("a"))).alias("b")))
    return every.select("a", "b", T.same_file(F.col("a"), F.col("b")).alias("same"))


def project_breakdown(spark: SparkSession, d: str) -> DataFrame:
    p = E.by_project(ranked(spark, d))
    return p.select("project", "n", *[F.round(c, 9).alias(c) for c in ("top1", "top3", "top5", "mrr")])


def time_summary(spark: SparkSession, d: str) -> DataFrame:
    t = E.time_summary(ranked(spark, d))
    return t.select(*[F.round(c, 6).alias(c) for c in t.columns])


def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Event types of each user in the order they first occur."""
    e = tables.table(spark, d, "events")
    t = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"]))
    return e.groupBy("user_id").agg(F.array_join(t, ">").alias("types"))


def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """For each event of a user the value of the last view before or at it."""
    e = tables.table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(w).alias("last_view"))


def parse_json_args(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    v = agents.json_arguments(F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.col("props")))
    return e.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


def parse_fenced_json(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events")
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("So:\n```json\n"), "props", F.lit("\n```\nDone."))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.lit("no idea"))
    return e.select("event_id", F.try_variant_get(T.fenced_json(t), "$.k", "bigint").alias("k"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    b = tables.bug_instances(spark, d)
    files = F.transform("buggy_files", lambda f: F.struct(f.alias("file_path"), F.lit("f").alias("function_name"), F.lit(0.5).alias("confidence")))
    return b.select("instance_id", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat(files, files).alias("ranked_locations"))), F.lit("\n```")).alias("answer"))


def answer_locations(spark: SparkSession, d: str) -> DataFrame:
    l = agents.method_names(agents.locations(_answers(spark, d), "answer", "ranked_locations"))  # noqa: E741
    return l.select("instance_id", F.col("pos").cast("long"), "file_path", "method", "confidence")


def answer_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = agents.candidate_files(agents.locations(_answers(spark, d), "answer", "ranked_locations"))
    return c.select("instance_id", F.array_join("files", ";").alias("files"))


def answer_ranking(spark: SparkSession, d: str) -> DataFrame:
    l = agents.locations(_answers(spark, d), "answer", "ranked_locations")  # noqa: E741
    r = agents.ranked_with_fallback(l.where("instance_id like '%1'"), agents.candidate_files(l))
    return r.select("instance_id", F.array_join("ranked_files", ";").alias("ranked_files"), "success")


def traces(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("agent"), F.col("event_id").alias("step"), F.lit("saw").alias("action"), F.col("props").alias("result"))
    return agents.trace_summary(agents.first_traces(e))


QUERIES = {f.__name__: f for f in (topn_hits, reciprocal_rank, average_precision, compute_metrics, unpivot_metrics, csv_rows, path_match_pairs, project_breakdown, time_summary, ordered_distinct, forward_fill, parse_json_args, parse_fenced_json, answer_locations, answer_candidates, answer_ranking, traces)}


def _norm(x: str) -> str:
    return rf"regexp_replace(replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\', '/'), '^/+|/+$', '', 'g')"


def _same(a: str, b: str) -> str:
    x, y = _norm(a), _norm(b)
    t = lambda v: f"regexp_extract({v}, '([^/]*/[^/]*)$', 1)"
    return f"({x} = {y} OR ends_with({x}, {y}) OR ends_with({y}, {x}) OR ({t(x)} <> '' AND {t(x)} = {t(y)}))"


RANKED = f"""{BUGS}, f AS (SELECT DISTINCT repo, unnest(buggy_files) AS f FROM bugs),
  ranked AS (SELECT instance_id, coalesce(list_slice(list_transform(list_sort(list(struct_pack(h := md5(instance_id || f.f), f := f.f)) FILTER (f.f IS NOT NULL)), lambda x: x.f), 1, 8), CAST([] AS VARCHAR[])) AS predicted, coalesce(any_value(buggy_files), CAST([] AS VARCHAR[])) AS ground_truth, any_value(length(problem_statement)) / 100.0::DOUBLE AS time FROM bugs LEFT JOIN f USING (repo) GROUP BY instance_id),
  m AS (SELECT instance_id, predicted, ground_truth, time, list_transform(predicted, lambda p: len(list_filter(ground_truth, lambda g: {_same('p', 'g')})) > 0) AS hit FROM ranked),
  x AS (SELECT *, coalesce(list_contains(hit[1:1], true), false) AS top1_hit, coalesce(list_contains(hit[1:3], true), false) AS top3_hit, coalesce(list_contains(hit[1:5], true), false) AS top5_hit, coalesce(1.0::DOUBLE / nullif(list_position(hit, true), 0), 0.0) AS rr,
    CASE WHEN len(ground_truth) > 0 THEN coalesce(list_sum(list_transform(hit, lambda h, i: CASE WHEN h THEN CAST(len(list_filter(hit[1:i], lambda z: z)) AS DOUBLE) / i ELSE 0.0 END)), 0.0) / len(ground_truth) ELSE 0.0 END AS ap FROM m)"""
_METRICS = "avg(top1_hit::INT) AS top_1_accuracy, avg(top3_hit::INT) AS top_3_accuracy, avg(top5_hit::INT) AS top_5_accuracy, avg(rr) AS mrr, avg(ap) AS map, count(*) AS total_instances, count(*) FILTER (rr > 0) AS instances_with_match"
_LOOSE = lambda n: f"(len(list_filter(predicted[1:{n}], lambda p: list_contains(ground_truth, p) OR list_contains(list_transform(ground_truth, lambda g: split_part(g, '/', -1)), split_part(p, '/', -1)))) > 0)"
_TWICE = "list_concat(buggy_files, buggy_files)"

ORACLE = {
    "topn_hits": f"WITH {RANKED} SELECT instance_id, top1_hit, top3_hit, top5_hit FROM x",
    "reciprocal_rank": f"WITH {RANKED} SELECT instance_id, round(rr, 9) AS rr FROM x",
    "average_precision": f"WITH {RANKED} SELECT instance_id, round(ap, 9) AS ap FROM x",
    "compute_metrics": f"WITH {RANKED}, y AS (SELECT {_METRICS} FROM x) SELECT round(top_1_accuracy, 9) AS top_1_accuracy, round(top_3_accuracy, 9) AS top_3_accuracy, round(top_5_accuracy, 9) AS top_5_accuracy, round(mrr, 9) AS mrr, round(map, 9) AS map, total_instances, instances_with_match FROM y",
    "unpivot_metrics": f"WITH {RANKED}, y AS (SELECT {_METRICS} FROM x), z AS (SELECT COLUMNS(*)::DOUBLE FROM y) SELECT metric, round(value, 9) AS value FROM (UNPIVOT z ON COLUMNS(*) INTO NAME metric VALUE value)",
    "csv_rows": f"WITH {RANKED} SELECT instance_id, CASE WHEN contains(instance_id, '_') THEN split_part(instance_id, '_', 1) ELSE '' END AS project, {_LOOSE(1)} AS success, {_LOOSE(1)}::INT AS top1_hit, {_LOOSE(3)}::INT AS top3_hit, {_LOOSE(5)}::INT AS top5_hit, round(rr, 4) AS reciprocal_rank, coalesce(predicted[1], '') AS predicted_file_1, coalesce(predicted[5], '') AS predicted_file_5, coalesce(array_to_string(ground_truth, '; '), '') AS ground_truth_files, CAST(len(predicted) AS INT) AS num_predicted, round(time, 2) AS time_seconds FROM x",
    "path_match_pairs": f"WITH {BUGS}, b AS (SELECT DISTINCT unnest(buggy_files) AS a FROM bugs), f AS (SELECT DISTINCT path AS b FROM source_files WHERE path IS NOT NULL), e AS (SELECT a, f.b FROM b JOIN f ON split_part(a, '/', -1) = split_part(f.b, '/', -1) UNION ALL SELECT a, '/x/' || replace(a, '/', '\\') || ' ' FROM b UNION ALL SELECT a, 'my_' || split_part(a, '/', -1) FROM b) SELECT a, b, {_same('a', 'b')} AS same FROM e",
    "project_breakdown": f"WITH {RANKED} SELECT regexp_replace(instance_id, '_[^_]*$', '') AS project, count(*) AS n, round(avg(top1_hit::INT), 9) AS top1, round(avg(top3_hit::INT), 9) AS top3, round(avg(top5_hit::INT), 9) AS top5, round(avg(rr), 9) AS mrr FROM x GROUP BY ALL",
    "time_summary": f"WITH {RANKED} SELECT round(avg(time), 6) AS mean_time, round(min(time), 6) AS least_time, round(max(time), 6) AS most_time, round(sum(time), 6) AS total_time FROM x WHERE time > 0",
    "ordered_distinct": "WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, event_type, min(n) AS n FROM o GROUP BY ALL) SELECT user_id, string_agg(event_type, '>' ORDER BY n) AS types FROM f GROUP BY user_id",
    "forward_fill": "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view FROM events",
    "parse_json_args": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
    "parse_fenced_json": "SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
    "answer_locations": f"WITH {BUGS}, l AS (SELECT instance_id, {_TWICE} AS f FROM bugs), r AS (SELECT instance_id, f, unnest(range(0, len(f))) AS pos FROM l) SELECT instance_id, pos, f[pos + 1] AS file_path, f[pos + 1] || '::f' AS method, 0.5::DOUBLE AS confidence FROM r",
    "answer_candidates": f"WITH {BUGS}, r AS (SELECT instance_id, unnest(buggy_files) AS f, generate_subscripts(buggy_files, 1) AS pos FROM bugs), d AS (SELECT instance_id, f, min(pos) AS pos FROM r WHERE f <> '' GROUP BY ALL) SELECT instance_id, string_agg(f, ';' ORDER BY pos) AS files FROM d GROUP BY instance_id",
    "answer_ranking": f"WITH {BUGS}, r AS (SELECT instance_id, unnest(buggy_files) AS f, generate_subscripts(buggy_files, 1) AS pos FROM bugs), d AS (SELECT instance_id, f, min(pos) AS pos FROM r WHERE f <> '' GROUP BY ALL), c AS (SELECT instance_id, string_agg(f, ';' ORDER BY pos) AS files FROM d GROUP BY instance_id) SELECT instance_id, CASE WHEN instance_id LIKE '%1' THEN array_to_string({_TWICE}, ';') ELSE files END AS ranked_files, true AS success FROM c JOIN bugs USING (instance_id)",
    "traces": "WITH o AS (SELECT user_id AS run_id, event_type, event_id, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1) SELECT run_id, string_agg('[' || event_type || '] saw: ' || left(coalesce(props, ''), 200), chr(10) ORDER BY event_id) AS summary FROM o GROUP BY run_id",
}
