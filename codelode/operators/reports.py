"""Sinks: reports as CSV, JSON and Markdown."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, functions as F

from codelode.operators.evaluation import by_project, metrics, report_rows, time_summary, unpivot

LABELS = {"top_1_accuracy": "Top-1 accuracy", "top_3_accuracy": "Top-3 accuracy", "top_5_accuracy": "Top-5 accuracy", "mrr": "Mean reciprocal rank", "map": "Mean average precision", "total_instances": "Instances", "instances_with_match": "Instances with a match"}


def write_instances(instances: DataFrame, path: str, extra: dict[str, str] | None = None) -> bool:
    """The per-instance report as CSV with a header; nothing is written for an empty table."""
    if instances.isEmpty():
        return False
    rows = report_rows(instances)
    for k, v in (extra or {}).items():
        rows = rows.withColumn(k, F.lit(v))
    rows.write.mode("overwrite").csv(path, header=True)
    return True


def write_summary(summary: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """Metrics in long form, metadata columns first."""
    long = unpivot(summary)
    long.select(*[F.lit(v).alias(k) for k, v in (metadata or {}).items()], "metric", "value").write.mode("overwrite").csv(path, header=True)


def write_results(instances: DataFrame, base: str, metadata: dict[str, str] | None = None) -> None:
    """Both reports beside each other; a suffix of ``base`` is dropped."""
    base = base.removesuffix(".csv").removesuffix(".json")
    write_instances(instances, f"{base}_instances", metadata)
    write_summary(metrics(instances), f"{base}_summary", metadata)


def write_json(instances: DataFrame, path: str) -> None:
    """Instances one JSON object a line; columns that start with an underscore stay out."""
    instances.drop(*[c for c in instances.columns if c.startswith("_")]).write.mode("overwrite").json(path)


def results_json(instances: DataFrame, metadata: dict | None = None) -> str:
    """Metadata and metrics as one JSON text."""
    return json.dumps({"metadata": metadata or {}, "metrics": metrics(instances).first().asDict()}, indent=2, default=str)


def markdown_report(instances: DataFrame, metadata: dict[str, str] | None = None, max_rows: int = 1000) -> str:
    """A readable report; aggregates are made in Spark, and at most ``max_rows`` instances are listed."""
    out = ["# Evaluation report", ""]
    out += [f"**{k}:** {v}  " for k, v in (metadata or {}).items()]
    m = metrics(instances).first().asDict()
    out += ["", "## Metrics", "", "| Metric | Value |", "|:--|--:|"]
    out += [f"| {label} | {m[k]:.4f} |" if isinstance(m[k], float) else f"| {label} | {m[k]} |" for k, label in LABELS.items()]
    projects = by_project(instances).orderBy("project").limit(max_rows).collect()
    if len(projects) > 1:
        out += ["", "## By project", "", "| Project | Instances | Top-1 | Top-3 | Top-5 | MRR |", "|:--|--:|--:|--:|--:|--:|"]
        out += [f"| {r['project']} | {r['n']} | {r['top1']:.2%} | {r['top3']:.2%} | {r['top5']:.2%} | {r['mrr']:.4f} |" for r in projects]
    name = lambda p: p.rsplit("/", 1)[-1]
    out += ["", "## By instance", "", "| Instance | Found | RR | Predicted | True |", "|:--|:-:|--:|:--|:--|"]
    for r in instances.orderBy("instance_id").limit(max_rows).collect():
        out.append(f"| {r['instance_id']} | {'yes' if r['rr'] > 0 else 'no'} | {r['rr']:.3f} | {name(r['predicted'][0]) if r['predicted'] else '-'} | {', '.join(map(name, (r['ground_truth'] or [])[:2])) or '-'} |")
    if "time" in instances.columns:
        t = time_summary(instances).first()
        if t["mean_time"] is not None:
            out += ["", "## Time", "", f"- mean {t['mean_time']:.1f} s, least {t['least_time']:.1f} s, most {t['most_time']:.1f} s, total {t['total_time']:.1f} s"]
    if "error" in instances.columns:
        bad = instances.where("error is not null and error <> ''").select("instance_id", "error").orderBy("instance_id").limit(max_rows).collect()
        if bad:
            out += ["", "## Errors", ""] + [f"- **{r['instance_id']}:** {r['error']}" for r in bad]
    return "\n".join(out) + "\n"


def write_markdown(text: str, path: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def write_picture_data(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges of a subgraph as JSON, for a viewer."""
    nodes.select("id", "name", "node_type", "file_path").write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
