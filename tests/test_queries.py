"""Every registered query with SQL against DuckDB on the smallest tables; the others against their own rules."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DIR)
    result = duck.execute(Q.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    df = Q.QUERIES[name](spark, DIR)
    assert df.columns and df.count() > 0


def test_what_if_leaves_no_trace_whatever_the_numbers_of_cards(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 28:02d} 10:00:00", user, float(i), f'{{"k": {i % 9}}}') for i, user in enumerate([1, 10_001, 20_001, -2, 9_998, 1, 10_001] * 9)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double, props string")
    df.selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "'view' AS event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    assert Q.QUERIES["what_if_leaves_no_trace"](spark, str(tmp_path)).first()["n"] == 5


def test_imbalance_study_fits_until_trees_stop_helping(spark, monkeypatch):
    from tidemark.operators import models as N

    fit, begin, turns, got = N.fit_trees, N._Held.begin, [], []

    def counted(self, turn):
        turns.append(turn)
        return begin(self, turn)

    def fitted(*a, **b):
        got.append((b, fit(*a, **b), turns[-1] + 1))
        return got[-1][1]

    monkeypatch.setattr(N._Held, "begin", counted)
    monkeypatch.setattr(N, "fit_trees", fitted)
    monkeypatch.setattr(Q.E.M, "ece", lambda df: df.agg(F.avg("p").alias("ece")))  # not what is tested here, and slow
    names = [r["strategy"] for r in Q.QUERIES["imbalance_study"](spark, DIR).collect()]
    assert len(names) == 7 and len(got) == 6
    for how, model, tried in got:
        assert (how["rounds"], how["patience"], how["depth"], how["bins"]) == (3000, 100, 6, 255) and how.get("subsample", 1) == how.get("colsample", 1) == 1
        assert tried in (3000, len(model.trees) + 100)
