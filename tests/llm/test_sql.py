"""Queries with SQL against DuckDB, and what is registered."""

import duckdb
import pytest

from tidemark.llm import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = Q.QUERIES[name](spark, DIR)
    result = con.execute(Q.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(result.fetchall())


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries().keys()
    assert {n.split("_")[0] for n in Q.QUERIES} == {f"op{i}" for i in range(1, 11)} and names >= {*Q.QUERIES, "pipeline"}


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from tidemark.llm import shared

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *_: "")})
        sparkContext = type("S", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError):
        shared.shared_dir(Elsewhere)
