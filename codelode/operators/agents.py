"""Deterministic parts of an agent run: answers, candidates, fallbacks, traces, a registry of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from codelode.functions.text import fenced_json

LOCATION = "struct<file_path:string,function_name:string,class_name:string,start_line:int,end_line:int,suspicion_score:double,confidence:double,reason:string,explanation:string>"


def json_arguments(text: Column) -> Column:
    """Tool arguments as a variant; an empty object where they do not parse."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def locations(answers: DataFrame, column: str, key: str) -> DataFrame:
    """Rows ``(instance_id, pos, ...LOCATION)`` of a list in a model's answer, in the answer's order."""
    part = F.try_variant_get(fenced_json(F.col(column)), f"$.{key}", f"array<{LOCATION}>")
    return answers.select("instance_id", F.posexplode(part).alias("pos", "l")).select("instance_id", "pos", "l.*")


def candidate_files(found: DataFrame) -> DataFrame:
    """``(instance_id, files)``: files of locations, each where it first stands."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "file_path"))), lambda s: s["file_path"])
    return found.where("file_path is not null and file_path <> ''").groupBy("instance_id").agg(F.array_distinct(ordered).alias("files"))


def method_names(found: DataFrame) -> DataFrame:
    """Adds ``method``: ``path::Class.function`` or ``path::function``."""
    owner = F.when(F.coalesce("class_name", F.lit("")) != "", F.concat("class_name", F.lit("."))).otherwise("")
    return found.where("function_name is not null and function_name <> ''").withColumn("method", F.concat("file_path", F.lit("::"), owner, "function_name"))


def ranked_with_fallback(confirmed: DataFrame, navigated: DataFrame) -> DataFrame:
    """``(instance_id, ranked_files, success)``: confirmed files as they stand (repeats kept), else the candidates."""
    c = confirmed.where("file_path is not null").groupBy("instance_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file_path"))), lambda s: s["file_path"]).alias("c"))
    both = navigated.join(c, "instance_id", "full")
    ranked = F.when(F.size("c") > 0, F.col("c")).otherwise(F.coalesce("files", F.array().cast("array<string>")))
    return both.select("instance_id", ranked.alias("ranked_files"), (F.size(ranked) > 0).alias("success"))


def first_traces(traces: DataFrame) -> DataFrame:
    """The first trace of each agent in a run: ``(run_id, agent, step, result)`` -> the same."""
    w = Window.partitionBy("run_id", "agent").orderBy("step")
    return traces.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def trace_summary(traces: DataFrame, limit: int = 200) -> DataFrame:
    """``(run_id, summary)``: one line a trace, results cut."""
    line = F.concat(F.lit("["), "agent", F.lit("] "), F.coalesce("action", F.lit("")), F.lit(": "), F.substring(F.coalesce("result", F.lit("")), 1, limit))
    return traces.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", line.alias("l")))), lambda s: s["l"]), "\n").alias("summary"))


def compose(report: Column, parts: dict[str, Column], limit: int = 2000) -> Column:
    """A prompt: the report, cut, then each part that has any items under its title."""
    items = [F.when(F.size(c) > 0, F.concat(F.lit(f"{t}:\n"), F.array_join(c, "\n"))) for t, c in parts.items()]
    return F.concat_ws("\n\n", F.substring(report, 1, limit), *items)


@dataclass
class Tool:
    name: str
    func: Callable
    description: str
    parameters: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()


class Registry:
    """Operators by name, with typed parameters; unknown names and failures become error rows, not exceptions."""

    def __init__(self) -> None:
        self.tools: dict[str, Tool] = {}

    def register(self, name: str, func: Callable, parameters: dict[str, str] | None = None, description: str = "", required: tuple[str, ...] = ()) -> None:
        self.tools[name] = Tool(name, func, description or (func.__doc__ or "").strip().split("\n")[0], parameters or {}, required)

    def schema(self, name: str) -> dict:
        t = self.tools[name]
        return {"name": t.name, "description": t.description, "parameters": {"type": "object", "properties": {k: {"type": v} for k, v in t.parameters.items()}, "required": list(t.required)}}

    def schemas(self, names: tuple[str, ...] | None = None) -> list[dict]:
        """The schemas of some tools, or of all; names without a tool are passed over."""
        return [self.schema(n) for n in (self.tools if names is None else names) if n in self.tools]

    def rows(self, name: str, arguments: dict, limit: int = 100) -> list[dict] | str:
        """At most ``limit`` rows of a tool's result; what fails when the plan runs is an error text too."""
        got = self.execute(name, arguments)
        if isinstance(got, str):
            return got
        try:
            return [r.asDict(recursive=True) for r in got.limit(limit).collect()]
        except Exception as e:  # noqa: BLE001
            return f"Error: {name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}"

    def execute(self, name: str, arguments: dict, **fixed):
        if name not in self.tools:
            return f"Error: unknown tool {name}"
        unknown = set(arguments) - set(self.tools[name].parameters)
        if unknown:
            return f"Error: {name} has no parameter {sorted(unknown)[0]}"
        missing = [k for k in self.tools[name].required if k not in arguments]
        if missing:
            return f"Error: {name} needs {missing[0]}"
        try:
            return self.tools[name].func(**fixed, **arguments)
        except Exception as e:  # noqa: BLE001
            return f"Error: {name}: {e}"
