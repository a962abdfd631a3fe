import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from codelode.operators import extraction as X, vectors as V
from codelode.operators.chunking import chunk_files, line_chunks, structure_chunks
from codelode.operators.search import code_search, glob_to_regex
from codelode.sources import files as S
from codelode.streaming.incremental import current_index, follow

UTILS = '"""Helpers."""\nimport os\nfrom a.b import c as d\n\nLIMIT = 3\n\n\ndef helper(x, y):\n    """Adds."""\n    return top(x) + y.add(1)\n\n\ndef top(x):\n    return x\n\n\nclass Calculator(Base, m.Other):\n    """Counts."""\n\n    @staticmethod\n    def add(a, b):\n        return helper(a, b)\n\n    async def multiply(self, a):\n        pass\n'
TREE = {"src/__init__.py": "", "src/utils.py": UTILS, "src/main.py": "from src.utils import helper\n\ndef run():\n    helper(1, 2)\n    print('x')\n", "src/broken.py": "def (\n", "tests/test_x.py": "helper\n", "src/latest/y.py": "helper\n", "README.md": "helper\n", "src/App.java": "import a.b.C;\npublic class App extends Base implements I, J {\n    public int run(int a) {\n        if (a > 0) {\n            helper(a);\n        }\n        return other(a);\n    }\n}\nclass Two {\n    void go() {\n        run(1);\n    }\n}\n"}


@given(st.lists(st.sampled_from(["a ", "b", "\n", " ", "(", ")", "{", "}", "throws E", "public ", "x,", ";", "<T>", "\n\n", "if"]), max_size=16).map("".join))
@settings(max_examples=300, deadline=None)
def test_java_methods_equal_the_pattern(text):
    assert [m.span() for m in X.java_method_heads(text)] == [m.span() for m in X.JAVA_METHOD.finditer(text)]


def test_java_methods_in_long_tables_take_no_time():
    text = "class A {\n  int[] T = {\n" + "    1, 2, 3, 4,\n" * 20_000 + "  };\n  int f(int a) {\n  }\n}\n"
    assert [m[1] for m in X.java_method_heads(text)] == ["f"]


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, t in TREE.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(t.encode())
    (root / "src/bytes.py").write_bytes(b"a = 1\n\xff# helper\n")
    return S.read_tree(spark, str(root))


def test_read_tree(tree):
    got = {r.path: r.content for r in tree.collect()}
    assert got == TREE | {"src/bytes.py": "a = 1\n# helper\n"}


def test_empty_files_keep_the_filters(spark, tmp_path):
    (tmp_path / "a b+c").mkdir()
    (tmp_path / "a b+c/é.py").write_bytes(b"")
    (tmp_path / "a b+c/x.txt").write_bytes(b"")
    (tmp_path / "y.py").write_bytes(b"1234")
    (tmp_path / "_private").mkdir()
    (tmp_path / "_private/z.py").write_bytes(b"x = 1\xff")
    (tmp_path / "_w.py").write_bytes(b"long = 1")
    (tmp_path / ".hidden.py").write_bytes(b"1")
    got = {r.path: r.size for r in S.read_tree(spark, str(tmp_path), [".py"]).collect()}
    assert got == {"a b+c/é.py": 0, "y.py": 4, "_private/z.py": 6, "_w.py": 8}
    assert {r.path: r.content for r in S.read_tree(spark, str(tmp_path), [".py"], max_bytes=6).collect()} == {"a b+c/é.py": "", "y.py": "1234", "_private/z.py": "x = 1"}


def test_search(tree):
    rows = code_search(tree, "HELPER(", context_lines=1).collect()
    assert [(r.path, r.line_number) for r in rows] == [("src/App.java", 5), ("src/main.py", 4), ("src/utils.py", 8), ("src/utils.py", 22)]
    assert rows[1].line == "helper(1, 2)" and rows[1].before == ["def run():"] and rows[1].after == ["print('x')"]
    assert code_search(tree, "nonexistent_xyz_123").count() == 0
    assert code_search(tree, "(", is_regex=True).count() == 0
    assert code_search(tree, "(?P<w>helper)", is_regex=True).count() == code_search(tree, "helper").count() > 0
    assert code_search(tree, r"(?P<w>e)l(?P=w)", is_regex=True).count() == 0 and code_search(tree, "a(?(1)b)", is_regex=True).count() == 0
    assert code_search(tree, r"^def \w+", is_regex=True, max_results=2).count() == 2
    assert {r.path for r in code_search(tree, "run", file_pattern="*.java").collect()} == {"src/App.java"}
    assert glob_to_regex("a/*.py") == r"(?:^|/)a/[^/]*\.py$"


def test_files(tree):
    assert [r[0] for r in S.find_files(tree, "UTIL").collect()] == ["src/utils.py"]
    info = {r.path: r for r in S.file_info(tree).collect()}
    assert info["src/main.py"].num_lines == 6 and info["README.md"].language == "markdown"
    assert {r.path for r in S.indexable(tree).collect()} == {"src/__init__.py", "src/utils.py", "src/main.py", "src/broken.py", "src/bytes.py", "src/App.java"}
    assert [r.rendered for r in S.file_lines(tree.where("path = 'src/main.py'"), 3, 4).orderBy("line_number").collect()] == ["   3 | def run():", "   4 |     helper(1, 2)"]
    assert ("src", "utils.py", True, 1) in {tuple(r) for r in S.directory_entries(tree).collect()}


def test_key_values_bugs_and_commits(spark, tmp_path):
    (tmp_path / "info").write_text("a=1\nb = \"x y\"\nnothing\n")
    assert {tuple(r) for r in S.read_info(spark, str(tmp_path / "info")).collect()} == {("a", "1"), ("b", "x y")}
    (tmp_path / "bugs.csv").write_text("bug.id,revision.id.buggy\n10,aa\n9,bb\n")
    assert [tuple(r) for r in S.read_active_bugs(spark, str(tmp_path / "bugs.csv"), 1).collect()] == [(9, "bb")]
    log = spark.createDataFrame([("h1|me|2024-01-02T00:00:00Z|say | so\n\na.py\nb.py\n",), ("h2|you|2024-01-03T00:00:00Z|x",)], "raw string")
    rows = {r.commit_hash: r for r in S.commits(log).collect()}
    assert rows["h1"].files_changed == ["a.py", "b.py"] and rows["h1"].message == "say | so" and rows["h2"].files_changed == []
    assert [r.commit_hash for r in S.log_of_file(S.commits(log), "a.py").collect()] == ["h1"]
    h = "0123456789012345678901234567890123456789"
    raw = [f"{h} 1 1 1", "author Me", "\tx = 1", f"{h} 2 2", "\ty = 2"]
    b = S.blame(spark.createDataFrame([("p", i, x) for i, x in enumerate(raw)], "path string, line_no int, raw string")).orderBy("line_no").collect()
    assert [(r.commit_hash, r.author, r.code) for r in b] == [("01234567", "Me", "x = 1"), ("01234567", "Me", "y = 2")]
    assert [tuple(r) for r in S.checkouts(spark.createDataFrame([("p/1/a.py",), ("p/1/b.py",), ("p-repo/1/a.py",), ("q/x/a.py",)], "path string")).collect()] == [("p", 1, 2)]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab ", max_size=90), min_size=1, max_size=80))
def test_line_chunks_equal_the_loop(spark, rows):
    text = "\n".join(rows)
    want = []
    if text.strip():
        n = len(rows)
        mean = max(1, len(text) / n)
        size, over = max(10, int(512 / mean)), max(2, int(64 / mean))
        start = 0
        while True:
            end = min(start + size, n)
            if "\n".join(rows[start:end]).strip():
                want.append((start + 1, end, "\n".join(rows[start:end])))
            if end >= n:
                break
            start = end - over
    got = line_chunks(spark.createDataFrame([("p", text)], "path string, content string"))
    assert sorted((r.start_line, r.end_line, r.text) for r in got.collect()) == want


def test_structure(spark, tree):
    kinds = [(c[5], c[3], c[4], c[1], c[2]) for c in structure_chunks("p", UTILS)]
    assert kinds == [("module", "", "", 1, 5), ("function", "helper", "", 8, 10), ("function", "top", "", 13, 14), ("class", "", "Calculator", 17, 24), ("function", "add", "Calculator", 21, 22), ("function", "multiply", "Calculator", 24, 25)] or kinds[0][0] == "module"
    c = chunk_files(tree).where("file_path = 'src/broken.py'").collect()
    assert [x.chunk_type for x in c] == ["code"]
    s = X.python_structure(tree)
    u = s.where("path = 'src/utils.py'").first()
    assert [f.name for f in u.functions] == ["helper", "top"] and u.classes[0].bases == ["Base", "m.Other"] and u.global_variables == ["LIMIT"] and u.classes[0].methods[0].decorators == ["staticmethod"]
    text = X.outline(s).where("path = 'src/utils.py'").first().outline
    assert "class Calculator(Base, m.Other):" in text and "  @staticmethod def add(a, b)" in text and "Imports:" in text
    src = X.function_source(tree, s, "add", "Calculator").first()
    assert src.source.split("\n")[0] == "# Calculator.add [src/utils.py]" and "def add(a, b):" in src.source


def test_python_graph(tree):
    g = X.build_graph(tree)
    e = {(r.source_id, r.target_id, r.edge_type) for r in g.edges.collect()}
    f = "function::src/utils.py::"
    assert (f + "helper", f + "top", "CALLS") in e and (f + "helper", "method::src/utils.py::Calculator.add", "CALLS") in e
    assert ("function::src/main.py::run", f + "helper", "CALLS") in e
    assert ("class::src/utils.py::Calculator", "class::*::m.Other", "INHERITS") in e and ("file::src/utils.py", "symbol::a.b.c", "IMPORTS") in e
    n = {r.id: r for r in g.nodes.collect()}
    assert n[f + "helper"].signature == "def helper(x, y)" and n[f + "helper"].docstring == "Adds." and "file::src/broken.py" not in n


def test_java_graph(tree):
    loose, strict = X.build_graph(tree, "java"), X.build_graph(tree, "java", True, True)
    names = {r.name for r in loose.nodes.where("node_type = 'method'").collect()}
    assert names == {"run", "if", "go"} and {r.name for r in strict.nodes.where("node_type = 'method'").collect()} == {"run", "go"}
    assert ("class::src/App.java::Two", "method::src/App.java::Two.go") in {(r.source_id, r.target_id) for r in loose.edges.collect()}
    assert {(r.source_id, r.target_id) for r in loose.edges.where("edge_type = 'INHERITS'").collect()} == {("class::src/App.java::App", f"class::*::{x}") for x in ("Base", "I", "J")}
    assert {(r.source_id, r.target_id) for r in strict.edges.where("edge_type = 'CALLS'").collect()} == {("method::src/App.java::Two.go", "method::src/App.java::App.run")}


def test_vectors(spark, tree, tmp_path):
    index = V.build_index(S.indexable(tree)).cache()
    q = V.embed_text("def helper adds x y")
    best = V.top_k(index, q, "chunk_id", 3).collect()
    assert "helper" in best[0].text and best[0].similarity >= best[1].similarity
    assert V.top_k(index, q, "chunk_id", 3, "main", "function").first().function_name == "run"
    assert V.similar_files(index, q).first().file_path == best[0].file_path
    V.write_index(index, str(tmp_path / "i"))
    assert V.index_stats(V.open_index(spark, str(tmp_path / "i"))) == index.count() and V.open_index(spark, str(tmp_path / "none")) is None
    fresh = index.where("file_path = 'src/main.py'").limit(1)
    V.upsert_index(spark.read.parquet(str(tmp_path / "i")), fresh, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "j")).where("file_path = 'src/main.py'").count() == 1
    table = index.select(F.xxhash64("chunk_id").alias("key"), "embedding")
    r = V.search_all(table, table.limit(3), "key", 2).collect()
    assert len(r) == 6 and all(x["query"] != x.near for x in r)
    assert V.search_all(table, table.limit(0), "key").count() == 0


def test_stream(spark, tmp_path):
    src, idx = str(tmp_path / "in"), str(tmp_path / "idx")
    spark.createDataFrame([("a.py", "def f():\n    return 1\n"), ("b.py", "x = 1\n")], "path string, content string").write.parquet(src)
    follow(spark, src, idx, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("a.py", "def g():\n    return 2\n")], "path string, content string").write.mode("append").parquet(src)
    follow(spark, src, idx, str(tmp_path / "c")).awaitTermination()
    got = {(r.file_path, r.function_name) for r in current_index(spark, idx).collect()}
    assert got == {("a.py", "g"), ("b.py", "")}
