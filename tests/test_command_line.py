from codelode.__main__ import main
from codelode.config import Settings
from codelode.operators import render
from codelode.operators.toolbox import STEPS, registry, tools_of_step
from pyspark.sql import functions as F

SOURCE = "def parse(x):\n    '''Reads one.'''\n    return scan(x)\n\n\ndef scan(x):\n    return x\n"


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text(SOURCE)
    root, index = str(tmp_path / "src"), str(tmp_path / "index")
    assert main(["query", root, "--text", "x", "--index", index]) == 1
    assert main(["index", root, "--index", index]) == 0 and "2 chunks" in capsys.readouterr().out
    main(["query", root, "--text", "parse reads", "--index", index, "-k", "1"])
    assert "a.py::parse [L1-3]" in capsys.readouterr().out
    main(["graph", root, "--text", "parse"])
    out = capsys.readouterr().out
    assert out.startswith("[function] a.py::parse [L1-3] (anchor") and "a.py::scan" in out
    main(["graph", root])
    assert "edge CALLS 1" in capsys.readouterr().out
    main(["search", root, "--text", "return"])
    assert "a.py:3: return scan(x)" in capsys.readouterr().out
    main(["localize", root, "--text", "parse scan"])
    assert "a.py" in capsys.readouterr().out


def test_evaluate(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text(SOURCE)
    (tmp_path / "src/b.py").write_text("def other():\n    pass\n")
    (tmp_path / "bugs.json").write_text('{"instance_id": "p_1", "problem_statement": "parse and scan fail", "buggy_files": ["a.py"]}\n{"instance_id": "p_2", "problem_statement": "", "buggy_files": ["zzz.py"]}\n')
    assert main(["evaluate", str(tmp_path / "src"), "--instances", str(tmp_path / "bugs.json"), "--index", str(tmp_path / "none"), "--out", str(tmp_path / "out")]) == 0
    out = capsys.readouterr().out
    assert "top_1_accuracy: 0.5000" in out and "instances: 2.0000" in out
    assert spark.read.csv(str(tmp_path / "out_instances"), header=True).count() == 2


def test_benchmark_keeps_failures(spark):
    from codelode.operators import benchmark as B

    bugs = spark.createDataFrame([("p_1", "x", ["a/b.py"]), ("p_2", None, None), ("p_2", None, None), ("q_3", "y", ["c.py"]), (None, "z", ["d.py"])], "instance_id string, problem_statement string, buggy_files array<string>")

    def find(instance, report):
        if instance == "p_2":
            raise RuntimeError("no tree")
        return ["z.py", "b.py"]

    done = B.run(bugs, find, 2)
    rows = {r.instance_id: r for r in B.evaluate(bugs, done).collect()}
    assert set(rows) == {"p_1", "p_2", "q_3"} and rows["p_1"].rr == 0.5 and not rows["p_1"].top1_hit and rows["p_1"].top3_hit
    assert rows["p_2"].error == "RuntimeError: no tree" and rows["q_3"].error == "no result"
    t = B.totals(B.evaluate(bugs, done)).first()
    assert (t.instances, t.errors, t.tool_calls) == (3, 2, 2) and t.mean_time >= 0
    assert {(r.project, r.n) for r in B.by_project_and_all(B.evaluate(bugs, done)).collect()} == {("p", 2), ("q", 1), ("*", 3)}
    assert B.evaluate(bugs.limit(0), done.limit(0)).count() == 0 and B.totals(B.evaluate(bugs.limit(0), done.limit(0))).first().instances == 0
    assert [tuple(r) for r in B.preview(bugs, 1).collect()] == [("p_1", 1, "b.py", "x")]


def test_registry(spark):
    files = spark.createDataFrame([("a.py", SOURCE)], "path string, content string")
    r = registry(files)
    assert all(t in r.tools for tools in STEPS.values() for t in tools)
    assert r.execute("function_source", {"path": "a.py", "function": "scan"}).first().source.endswith("   7 |     return x")
    assert "not available" in r.execute("graph_search", {"query": "x"})
    assert all(x["description"].endswith(".") and x["parameters"]["type"] == "object" for x in r.schemas())
    assert r.schema("read_file")["parameters"]["required"] == ["path"] and r.execute("read_file", {}) == "Error: read_file needs path"
    assert [x["name"] for x in tools_of_step(r, "comprehension")] == ["code_search", "find_files", "list_directory"]
    built = registry(files, language="auto")
    assert {x["id"] for x in built.rows("graph_search", {"query": "scan"})} >= {"function::a.py::scan"}
    # What only fails when rows are made is an error text too.
    r.register("late", lambda: files.select(F.raise_error(F.lit("late"))), {}, "Fails late.")
    assert r.rows("late", {}).startswith("Error: late")
    assert r.execute("read_file", {"path": "a.py", "start_line": 6, "end_line": 6}).first().rendered == "   6 | def scan(x):"


def test_render(spark):
    t = spark.createDataFrame([("a", None), ("b", "x"), ("b", "w")], "id string, caller_id string")
    assert {tuple(r) for r in render.relations(t, "callers").collect()} == {("a", "  (no callers found)"), ("b", "  - w\n  - x")}
    log = spark.createDataFrame([("0123456789", "me", "say", [f"f{i}" for i in range(7)])], "commit_hash string, author string, message string, files_changed array<string>").withColumn("date", F.lit("2024-01-02").cast("timestamp"))
    assert render.commit_lines(log).first().text.split("\n")[0] == "01234567 2024-01-02 me say"


def test_settings(monkeypatch):
    monkeypatch.setenv("CODELODE_TOP_K", "3")
    monkeypatch.setenv("CODELODE_TOP_N", "1,2")
    assert Settings.from_env().top_k == 3 and Settings.from_env().top_n == (1, 2)
