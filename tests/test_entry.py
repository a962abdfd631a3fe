import __spark_entry__ as entry
import verify


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "p5_found" in q and "graph_search" in q


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "score", "source", "depth"]


def test_norm():
    assert verify.norm([1.0, None]) == "['1', 'None']"
