"""Registered queries over the driver's tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import calibration as C
from tidemark.operators import decisions as D
from tidemark.operators import drift as X
from tidemark.operators import experiments as E
from tidemark.operators import labels as L
from tidemark.operators import metrics as M
from tidemark.operators import models as N
from tidemark.operators import relational as R
from tidemark.operators import sketches as K
from tidemark.plans.features import compute, events, peek
from tidemark.plans.spec import CARD_RISK, HOUR, Feature
from tidemark.sources import storage
from tidemark.sources import tables as T
from tidemark.sources.shared import shared_path
from tidemark.streaming import desk
from tidemark.streaming import features as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DAY = 24 * HOUR
#: 2024-01-01 in microseconds, where ``events`` begins, and days after it.
START = 1_704_067_200_000_000
TYPES = ("click", "error", "purchase", "signup", "view")

VIEWS = {
    "txn": """SELECT event_id AS txn_id, epoch_us(ts) AS us, user_id AS card_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS merchant_id, event_type AS category, CAST(round(value * 100) AS BIGINT) AS cents FROM events""",
    "otxn": """SELECT o_orderkey AS txn_id, epoch_us(o_orderdate) AS us, o_custkey AS card_id, o_orderkey % 50 AS merchant_id, o_orderpriority AS category, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders""",
    "cb": "SELECT txn_id, us AS txn_us, us + (24 + (txn_id * 7919) % 480) * 3600000000 AS reported_us, card_id, merchant_id, category, cents FROM txn WHERE txn_id % 13 = 0",
    "ocb": "SELECT txn_id, us AS txn_us, us + (24 + (txn_id * 7919) % 480) * 3600000000 AS reported_us, card_id, merchant_id, category, cents FROM otxn WHERE txn_id % 13 = 0",
    "ev": "SELECT txn_id, us, card_id, merchant_id, category, cents, true AS is_txn FROM txn UNION ALL SELECT txn_id, reported_us, card_id, merchant_id, category, cents, false FROM cb",
    "oev": "SELECT txn_id, us, card_id, merchant_id, category, cents, true AS is_txn FROM otxn UNION ALL SELECT txn_id, reported_us, card_id, merchant_id, category, cents, false FROM ocb",
    "cust": "SELECT c_custkey AS card_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, CAST(-7305 + (c_custkey * 37) % 18000 AS BIGINT) AS dob_days, 25 + ((c_custkey * 7919) % 2500) / 100.0::DOUBLE AS home_lat, -120 + ((c_custkey * 104729) % 5000) / 100.0::DOUBLE AS home_lon, 100 + (c_custkey * 31) % 100000 AS city_pop FROM customer",
    "sc": "SELECT *, CASE WHEN txn_id % 13 = 0 THEN 1 ELSE 0 END AS y, (((txn_id * 7919) % 1000) / 1000.0::DOUBLE) * CASE WHEN txn_id % 13 = 0 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS p, cents / 100.0::DOUBLE AS amount, us // 86400000000 AS day FROM txn",
    "costs": "SELECT *, p * amount AS ca, 3.0::DOUBLE + (1 - p) * 1.0::DOUBLE + p * (1 - 0.95::DOUBLE) * amount AS cr, (1 - p) * (10.0::DOUBLE + 0.02::DOUBLE * amount) AS cd FROM sc",
    "acted": "SELECT *, CASE WHEN ca <= cr AND ca <= cd THEN 'approve' WHEN cr <= cd THEN 'review' ELSE 'decline' END AS action FROM costs",
    "lv": "SELECT p, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM sc GROUP BY p",
}
NEEDS = {"cb": ["txn"], "ocb": ["otxn"], "ev": ["txn", "cb"], "oev": ["otxn", "ocb"], "sc": ["txn"], "costs": ["txn", "sc"], "acted": ["txn", "sc", "costs"], "lv": ["txn", "sc"]}


def sql(body: str, *views: str, more: str = "") -> str:
    order = list(dict.fromkeys(v for name in views for v in [*NEEDS.get(name, []), name]))
    order.sort(key=list(VIEWS).index)
    ctes = [f"{v} AS ({VIEWS[v]})" for v in order] + ([more] if more else [])
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _txns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Python workers import this package; a driver that only put it on its own path has not told them.
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))
    t = T.from_events(spark, sf_dir)
    return t, T.chargebacks(t)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.scored(_txns(spark, sf_dir)[0])


# Point-in-time aggregates.


def agg_sql(a: Feature, ev: str) -> str:
    """The literal window of an aggregate."""
    part = f"PARTITION BY {', '.join(a.keys)} " if a.keys else ""
    over = f"OVER ({part}ORDER BY us RANGE BETWEEN {a.span if a.span else 'UNBOUNDED'} PRECEDING AND 1 PRECEDING)"
    f = f"FILTER (WHERE {'is_txn' if a.stream == 'txn' else 'NOT is_txn'}) {over}"
    v = a.column
    n, s = f"count(*) {f}", f"CAST(sum({v}) {f} AS HUGEINT)"
    return {
        "count": f"CAST(coalesce({n}, 0) AS BIGINT)",
        "sum": f"round(coalesce({s}, 0) / 100.0::DOUBLE, 6)",
        "mean": f"round({s} / nullif({n}, 0)::DOUBLE / 100.0::DOUBLE, 6)",
        "std": f"CASE WHEN {n} > 0 THEN round(sqrt(greatest(CAST(({n})::HUGEINT * (sum(cents::HUGEINT * cents) {f})::HUGEINT - {s} * {s} AS DOUBLE), 0)) / ({n}) / 100.0::DOUBLE, 6) END",
        "max": f"round(max({v}) {f} / 100.0::DOUBLE, 6)",
        "distinct": f"CAST(coalesce(count(DISTINCT {v}) {f}, 0) AS BIGINT)",
        "since_last": f"round((us - max(us) {f}) / 1000000.0::DOUBLE, 6)",
        "since_first": f"round((us - min(us) {f}) / 1000000.0::DOUBLE, 6)",
    }[a.measure]


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("txn_id", *((F.round(n, 6) if kinds[n] == "double" else F.col(n)).alias(n) for n in names))


def _feature(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compute(CARD_RISK.pick([name]), *_txns(spark, sf_dir)), [name])


for _a in CARD_RISK.values():
    query(_a.name, sql(f"SELECT txn_id, v AS {_a.name} FROM (SELECT txn_id, is_txn, {agg_sql(_a, 'ev')} AS v FROM ev) WHERE is_txn", "ev"))(partial(_feature, _a.name))


def _all_sql(ev: str, names: list[str]) -> str:
    cols = ", ".join(f"{agg_sql(a, ev)} AS {a.name}" for a in CARD_RISK.values() if a.name in names)
    return sql(f"SELECT * EXCLUDE (is_txn) FROM (SELECT txn_id, is_txn, {cols} FROM {ev}) WHERE is_txn", ev)


@query("all_features", _all_sql("ev", list(CARD_RISK)))
def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compute(CARD_RISK, *_txns(spark, sf_dir)), list(CARD_RISK))


@query("all_features_with_ties", _all_sql("oev", list(CARD_RISK)))
def all_features_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.from_orders(spark, sf_dir)
    return _rounded(compute(CARD_RISK, t, T.chargebacks(t)), list(CARD_RISK))


# Row and derived features.

ROW_SQL = {
    "amount": "cents / 100.0::DOUBLE",
    "hour": "CAST((us // 3600000000) % 24 AS INTEGER)",
    "day_of_week": "CAST((us // 86400000000 + 3) % 7 AS INTEGER)",
    "is_night": "CASE WHEN (us // 3600000000) % 24 >= 22 OR (us // 3600000000) % 24 < 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "age_years": "round((us / 86400000000.0::DOUBLE - dob_days) / 365.25::DOUBLE, 6)",
    "gender_m": "CASE WHEN gender = 'M' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "log_city_pop": "round(ln(city_pop), 6)",
    "dist_home_km": "round(2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE, power(sin(radians(mlat - home_lat) / 2), 2) + cos(radians(home_lat)) * cos(radians(mlat)) * power(sin(radians(mlon - home_lon) / 2), 2)))), 4)",
    "category_code": "CAST(list_position(['click', 'error', 'purchase', 'signup'], category) - 1 AS DOUBLE)",
}
FRAME_SQL = "(SELECT *, 25 + ((merchant_id * 7919) % 2500) / 100.0::DOUBLE AS mlat, -120 + ((merchant_id * 104729) % 5000) / 100.0::DOUBLE AS mlon FROM txn JOIN cust USING (card_id))"


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _txns(spark, sf_dir)[0].withColumn("amount", F.col("cents") / 100.0)
    return R.lookup(t, T.customers(spark, sf_dir), "card_id", "inner").select("*", *T.places(F.col("merchant_id")))


def _row_feature(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frame(spark, sf_dir)
    value = S.category_code(F.col("category"), TYPES[:4]) if name == "category_code" else S.ROW_FEATURES[name]()
    return f.select("txn_id", (F.round(value, 4 if name == "dist_home_km" else 6) if name in ("age_years", "log_city_pop", "dist_home_km") else value).alias(name))


for _n, _q in ROW_SQL.items():
    _q = f"coalesce({_q}, -1.0::DOUBLE)" if _n == "category_code" else _q
    query(_n, sql(f"SELECT txn_id, {_q} AS {_n} FROM {FRAME_SQL}", "txn", "cust"))(partial(_row_feature, _n))

DERIVED_SQL = {
    "amount_to_card_mean": "amount / nullif(card__mean_amount_all, 0)",
    "amount_zscore_card": "CASE WHEN card__std_amount_all > 0 THEN (amount - card__mean_amount_all) / card__std_amount_all END",
    "amount_to_card_max_7d": "amount / nullif(card__max_amount_7d, 0)",
    "amount_to_card_category_mean": "amount / nullif(card_category__mean_amount_all, 0)",
    "card_avg_amount_24h": "card__sum_amount_24h / nullif(card__count_24h, 0)",
    "merchant_cb_rate_30d": "(merchant__cb_count_30d + 200.0::DOUBLE * coalesce(global__cb_count_30d / nullif(global__count_30d, 0)::DOUBLE, 0)) / (merchant__count_30d + 200.0::DOUBLE)",
    "category_cb_rate_30d": "(category__cb_count_30d + 200.0::DOUBLE * coalesce(global__cb_count_30d / nullif(global__count_30d, 0)::DOUBLE, 0)) / (category__count_30d + 200.0::DOUBLE)",
}


def _derived(name: str, needs: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    t, cb = _txns(spark, sf_dir)
    # Features are rounded as the SQL rounds them, so that both divide the same numbers.
    f = _rounded(compute(CARD_RISK.pick(needs), t, cb), needs)
    f = f.join(t.select("txn_id", (F.col("cents") / 100.0).alias("amount")), "txn_id")
    return f.select("txn_id", F.round(S.DERIVED[name](), 5).alias(name))


for _n, _q in DERIVED_SQL.items():
    _needs = [a.name for a in CARD_RISK.values() if a.name in _q]
    _cols = ", ".join(f"{agg_sql(a, 'ev')} AS {a.name}" for a in CARD_RISK.values() if a.name in _needs)
    query(_n, sql(f"SELECT txn_id, round({_q}, 5) AS {_n} FROM (SELECT txn_id, is_txn, cents / 100.0::DOUBLE AS amount, {_cols} FROM ev) WHERE is_txn", "ev"))(partial(_derived, _n, _needs))


@query("model_features", "SELECT unnest([" + ", ".join(f"'{n}'" for n in S.model_features(list(CARD_RISK))) + "]) AS feature")
def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in S.model_features(list(CARD_RISK))], "feature string")


@query("no_history_features", "SELECT unnest([" + ", ".join(f"'{n}'" for n in S.without_history(S.model_features(list(CARD_RISK)))) + "]) AS feature")
def no_history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in S.without_history(S.model_features(list(CARD_RISK)))], "feature string")


# Relational operators.


@query("time_window_filter", sql(f"SELECT txn_id, us, cents FROM txn WHERE us >= {START + 5 * DAY} AND us < {START + 12 * DAY}", "txn"))
def time_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.time_window(_txns(spark, sf_dir)[0], START + 5 * DAY, START + 12 * DAY).select("txn_id", "us", "cents")


@query("dim_customers", sql("SELECT card_id, arg_min(category, (us, txn_id)) FILTER (WHERE category <> 'view') AS category, arg_min(merchant_id, (us, txn_id)) AS merchant_id FROM txn GROUP BY card_id", "txn"))
def dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _txns(spark, sf_dir)[0].withColumn("category", F.when(F.col("category") != "view", F.col("category")))
    return R.first_non_null(t, "card_id", ["category", "merchant_id"], ["us", "txn_id"])


@query("dim_consistency_check", sql("SELECT CAST(max(a) AS BIGINT) AS max_category, CAST(max(b) AS BIGINT) AS max_merchant_id FROM (SELECT count(DISTINCT category) a, count(DISTINCT merchant_id) b FROM txn GROUP BY card_id)", "txn"))
def dim_consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.max_distinct(_txns(spark, sf_dir)[0], "card_id", ["category", "merchant_id"])


NAMES_SQL = "names AS (SELECT DISTINCT regexp_replace(s_name, '^fraud_', '') AS name FROM (SELECT 'fraud_' || s_name AS s_name FROM supplier)), keys AS (SELECT name, row_number() OVER (ORDER BY name) AS merchant_id FROM names)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), F.concat(F.lit("fraud_"), F.col("s_name")).alias("name"))


@query("surrogate_keys", f"WITH {NAMES_SQL} SELECT name, CAST(merchant_id AS BIGINT) AS merchant_id FROM keys")
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.surrogate_keys(_names(spark, sf_dir), "name", "merchant_id")


@query("map_lookup_join", f"WITH {NAMES_SQL} SELECT s_suppkey, CAST(merchant_id AS BIGINT) AS merchant_id FROM supplier JOIN keys ON s_name = name")
def map_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _names(spark, sf_dir)
    own = raw.withColumn("name", F.regexp_replace("name", "^fraud_", ""))
    return R.lookup(own, R.surrogate_keys(raw, "name", "merchant_id"), "name", "inner").select("s_suppkey", "merchant_id")


@query("events_union", sql("SELECT txn_id, us, cents, is_txn FROM ev", "ev"))
def events_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(*_txns(spark, sf_dir)).select("txn_id", "us", "cents", "is_txn")


@query("cb_join", sql("SELECT txn_id, c.txn_us, c.reported_us, t.cents FROM cb c JOIN txn t USING (txn_id) WHERE c.txn_us = t.us", "cb"))
def cb_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, cb = _txns(spark, sf_dir)
    return R.chargebacks_with_transactions(cb, t).select("txn_id", "txn_us", "reported_us", "cents")


@query("cb_unmatched", sql("SELECT txn_id FROM cb WHERE txn_id NOT IN (SELECT txn_id FROM txn WHERE txn_id % 2 = 0)", "cb"))
def cb_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, cb = _txns(spark, sf_dir)
    return R.unmatched(cb, t.where("txn_id % 2 = 0")).select("txn_id")


@query("left_join_customers", sql("SELECT txn_id, card_id, gender, city_pop FROM txn LEFT JOIN cust USING (card_id)", "txn", "cust"))
def left_join_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lookup(_txns(spark, sf_dir)[0], T.customers(spark, sf_dir), "card_id").select("txn_id", "card_id", "gender", "city_pop")


@query("feature_join", sql("SELECT s.txn_id, s.y, CAST(n AS BIGINT) AS card__count_all FROM sc s JOIN (SELECT txn_id, is_txn, count(*) FILTER (WHERE is_txn) OVER (PARTITION BY card_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM ev) f ON f.txn_id = s.txn_id AND is_txn", "ev", "sc"))
def feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = compute(CARD_RISK.pick(["card__count_all"]), *_txns(spark, sf_dir))
    return _scored(spark, sf_dir).select("txn_id", "y").join(f.drop("us"), "txn_id")


@query("reported_at_lookup", sql("SELECT txn_id, reported_us FROM txn LEFT JOIN (SELECT txn_id, reported_us FROM cb) USING (txn_id)", "cb"))
def reported_at_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, cb = _txns(spark, sf_dir)
    return t.select("txn_id").join(cb.select("txn_id", "reported_us"), "txn_id", "left")


@query("semi_join_filter", sql("SELECT txn_id, cents FROM txn WHERE txn_id IN (SELECT txn_id FROM cb)", "cb"))
def semi_join_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, cb = _txns(spark, sf_dir)
    return t.join(cb, "txn_id", "left_semi").select("txn_id", "cents")


@query("hstack_columns", sql("SELECT txn_id, cents / 100.0::DOUBLE AS amount, CAST((us // 3600000000) % 24 AS INTEGER) AS hour FROM txn", "txn"))
def hstack_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _txns(spark, sf_dir)[0].withColumns({"amount": F.col("cents") / 100.0, "hour": S.hour(F.col("us"))}).select("txn_id", "amount", "hour")


@query("sort_ts_txn", sql("SELECT txn_id, us FROM otxn ORDER BY us, txn_id", "otxn"))
def sort_ts_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.from_orders(spark, sf_dir).select("txn_id", "us").orderBy("us", "txn_id")


@query("merge_two_streams", sql("SELECT us, 0 AS kind, txn_id FROM txn UNION ALL SELECT reported_us, 1, txn_id FROM cb", "cb"))
def merge_two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merged_streams(*_txns(spark, sf_dir))


@query("id_canonicalize", sql("SELECT txn_id, lower(replace(upper('AB-' || txn_id || '-Cd'), '-', '')) AS id FROM txn", "txn"))
def id_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _txns(spark, sf_dir)[0].select("txn_id", R.canonical_id(F.upper(F.concat(F.lit("AB-"), F.col("txn_id"), F.lit("-Cd")))).alias("id"))


POLICY_SQL = "SELECT action, us // 604800000000 AS week, CAST(count(*) AS BIGINT) AS n, round(sum(cents) / 100.0::DOUBLE, 2) AS amount FROM acted GROUP BY action, week"


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    acted = D.bayes(_scored(spark, sf_dir))
    return acted.groupBy("action", F.floor(F.col("us") / (7 * DAY)).alias("week")).agg(F.count("*").alias("n"), F.round(F.sum("cents") / 100.0, 2).alias("amount"))


@query("pivot_month_policy", sql(f"SELECT week, max(n) FILTER (WHERE action = 'approve') AS approve, max(n) FILTER (WHERE action = 'review') AS review, max(n) FILTER (WHERE action = 'decline') AS decline FROM ({POLICY_SQL}) GROUP BY week", "acted"))
def pivot_month_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pivot(_weekly(spark, sf_dir), "week", "action", "n", D.ACTIONS)


@query("policy_summary", sql(f"SELECT action, round(avg(n), 6) AS mean_n, min(n) AS min_n, round(avg(amount), 4) AS mean_amount FROM ({POLICY_SQL}) GROUP BY action", "acted"))
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weekly(spark, sf_dir).groupBy("action").agg(F.round(F.avg("n"), 6).alias("mean_n"), F.min("n").alias("min_n"), F.round(F.avg("amount"), 4).alias("mean_amount"))


@query("month_series", "SELECT CAST(unnest(generate_series(DATE '2019-07-01', DATE '2020-12-31', INTERVAL 1 MONTH)) AS DATE) AS month")
def month_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.month_starts(spark, "2019-07-01", "2021-01-01")


@query("value_counts_decision", sql("SELECT action, CAST(count(*) AS BIGINT) AS n FROM acted GROUP BY action", "acted"))
def value_counts_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.bayes(_scored(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


REGISTRY = "(VALUES ('v1', 1, 'archived'), ('v2', 2, 'production'), ('v3', 3, 'candidate'), ('v4', 4, 'candidate')) r(version, created_at, stage)"


def _registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("v1", 1, "archived"), ("v2", 2, "production"), ("v3", 3, "candidate"), ("v4", 4, "candidate")], "version string, created_at int, stage string")


@query("registry_latest", f"SELECT version, created_at, stage FROM {REGISTRY} ORDER BY created_at DESC LIMIT 1")
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark).orderBy(F.desc("created_at")).limit(1)


@query("registry_promote", f"SELECT version, created_at, CASE WHEN version = 'v4' THEN 'production' WHEN stage = 'production' THEN 'archived' ELSE stage END AS stage FROM {REGISTRY}")
def registry_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.next_version(_registry(spark))


@query("delete_by_version", sql("SELECT txn_id, txn_id % 3 AS model_version FROM txn WHERE txn_id % 3 <> 1", "txn"))
def delete_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.without_version(_txns(spark, sf_dir)[0].select("txn_id", (F.col("txn_id") % 3).alias("model_version")), "1")


@query("topn", sql("SELECT txn_id, cents FROM txn ORDER BY cents DESC, txn_id LIMIT 10", "txn"))
def topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_k(_txns(spark, sf_dir)[0], 10, "cents", "txn_id").select("txn_id", "cents")


# Labels.


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.join(T.chargebacks(s).select("txn_id", "reported_us"), "txn_id", "left")


AS_OF = START + 20 * DAY
LAB = "lab AS (SELECT s.*, c.reported_us FROM sc s LEFT JOIN (SELECT txn_id, reported_us FROM cb) c USING (txn_id))"


@query("observed_labels", sql(f"SELECT txn_id, CASE WHEN reported_us <= {AS_OF} THEN 1 ELSE 0 END AS label FROM lab", "sc", "cb", more=LAB))
def observed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("txn_id", L.observed(F.col("reported_us"), AS_OF).alias("label"))


@query("split_train_valid_test", sql(f"SELECT txn_id, part, CASE WHEN us >= {START + 22 * DAY} THEN y WHEN reported_us <= {START + 22 * DAY} THEN 1 ELSE 0 END AS label FROM (SELECT *, CASE WHEN us >= {START} AND us < {START + 14 * DAY} THEN 'train' WHEN us >= {START + 14 * DAY} AND us < {START + 20 * DAY} THEN 'valid' WHEN us >= {START + 22 * DAY} AND us < {START + 30 * DAY} THEN 'test' END AS part FROM lab) WHERE part IS NOT NULL", "sc", "cb", more=LAB))
def split_train_valid_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split(_labelled(spark, sf_dir), START, START + 14 * DAY, START + 22 * DAY, START + 30 * DAY, maturity=2 * DAY).select("txn_id", "part", "label")


@query("rolling_origin_folds", sql("SELECT fold, CAST(count(*) FILTER (WHERE us < a) AS BIGINT) AS train, CAST(count(*) FILTER (WHERE us >= a) AS BIGINT) AS valid FROM txn JOIN (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (_, a, b) in enumerate(L.rolling_folds(START, START + 30 * DAY))) + ") f(fold, a, b) ON us < b GROUP BY fold", "txn"))
def rolling_origin_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _txns(spark, sf_dir)[0]
    return R.union_all([t.where((F.col("us") >= s) & (F.col("us") < b)).agg(F.count_if(F.col("us") < a).alias("train"), F.count_if(F.col("us") >= a).alias("valid")).select(F.lit(i).alias("fold"), "train", "valid") for i, (s, a, b) in enumerate(L.rolling_folds(START, START + 30 * DAY))])


@query("matured_training_window", sql(f"SELECT txn_id, CASE WHEN reported_us <= {START + 25 * DAY} THEN 1 ELSE 0 END AS label FROM lab WHERE us < {START + 20 * DAY} AND us >= {START + 13 * DAY}", "sc", "cb", more=LAB))
def matured_training_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.matured(_labelled(spark, sf_dir), START + 25 * DAY, 12 * DAY, 5 * DAY).select("txn_id", "label")


@query("simulate_chargebacks")
def simulate_chargebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.simulated_delays(_scored(spark, sf_dir).where("y = 1")).select("txn_id", "us", "reported_us")


@query("undersample_negatives")
def undersample_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.undersample(_scored(spark, sf_dir), 0.2).select("txn_id", "y")


@query("smote")
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.smote(_scored(spark, sf_dir), ["amount", "p", "merchant_id"], {"merchant_id"}, 0.2)


@query("capped_sample")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sample_n(_txns(spark, sf_dir)[0], 500, 1, "txn_id").select("txn_id", "cents")


# Decisions.


@query("expected_cost", sql("SELECT txn_id, round(ca, 9) AS approve, round(cr, 9) AS review, round(cd, 9) AS decline FROM costs", "costs"))
def expected_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_costs(_scored(spark, sf_dir)).select("txn_id", *(F.round(f"cost_{a}", 9).alias(a) for a in D.ACTIONS))


@query("realized_cost", sql("SELECT txn_id, round(CASE action WHEN 'approve' THEN y * amount WHEN 'review' THEN 3.0::DOUBLE + (1 - y) + y * (1 - 0.95::DOUBLE) * amount ELSE (1 - y) * (10.0::DOUBLE + 0.02::DOUBLE * amount) END, 9) AS cost FROM acted", "acted"))
def realized_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.bayes(_scored(spark, sf_dir)).select("txn_id", F.round(D.COSTS.realized(F.col("action"), F.col("y"), F.col("amount")), 9).alias("cost"))


@query("bayes_policy", sql("SELECT txn_id, action FROM acted", "acted"))
def bayes_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.bayes(_scored(spark, sf_dir)).select("txn_id", "action")


CAPPED = "SELECT *, CASE WHEN action <> 'review' THEN action WHEN r <= 5 THEN 'review' WHEN ca <= cd THEN 'approve' ELSE 'decline' END AS final FROM (SELECT *, row_number() OVER (PARTITION BY day, action ORDER BY round(least(ca, cd) - cr, 9) DESC, txn_id) AS r FROM acted)"


@query("capacity_policy", sql(f"SELECT txn_id, final AS action FROM ({CAPPED})", "acted"))
def capacity_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.capacity(_scored(spark, sf_dir), 5).select("txn_id", "action")


@query("threshold_policy", sql("SELECT txn_id, CASE WHEN p >= 0.6 THEN 'decline' ELSE 'approve' END AS action FROM sc", "sc"))
def threshold_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.threshold(_scored(spark, sf_dir), 0.6).select("txn_id", "action")


TOP = "top AS (SELECT *, row_number() OVER (ORDER BY p DESC, txn_id) <= greatest(1, ceil(0.013 * count(*) OVER ())) AS taken FROM sc)"


@query("budget_policy", sql("SELECT txn_id, CASE WHEN taken THEN 'review' ELSE 'approve' END AS action FROM top", "sc", more=TOP))
def budget_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.budget(_scored(spark, sf_dir), 0.013).select("txn_id", "action")


Q_SQL = "SELECT s FROM (SELECT {s} AS s, row_number() OVER (ORDER BY {s}) AS r, count(*) OVER () AS n FROM sc WHERE y = {y}) WHERE r = ceil(round((n + 1) * (1 - {a}), 9))"


@query("conformal_quantile", sql("SELECT round(s, 9) AS q FROM (" + Q_SQL.format(s="1 - p", y=1, a=0.05) + ")", "sc"))
def conformal_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.conformal_quantile(_scored(spark, sf_dir).where("y = 1"), 1 - F.col("p"), 0.05).select(F.round("q", 9).alias("q"))


CONF = "c AS (SELECT *, (SELECT s FROM (" + Q_SQL.format(s="1 - p", y=1, a=0.05) + ")) AS qf, (SELECT s FROM (" + Q_SQL.format(s="p", y=0, a=0.002) + ")) AS ql FROM sc), sets AS (SELECT txn_id, qf IS NULL OR 1 - p <= qf AS fraud, ql IS NULL OR p <= ql AS legit FROM c)"


@query("conformal_policy", sql("SELECT txn_id, CASE WHEN legit AND NOT fraud THEN 'approve' WHEN fraud AND NOT legit THEN 'decline' ELSE 'review' END AS action FROM sets", "sc", more=CONF))
def conformal_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.conformal(_scored(spark, sf_dir)).select("txn_id", "action")


GRID = "grid AS (SELECT DISTINCT unnest(quantile_cont(p, [" + ", ".join(repr(0.95 + 0.04999 * i / 399) for i in range(400)) + "])) AS t FROM sc)"


@query("best_f1_threshold", sql("SELECT round(t, 9) AS threshold, round(f1, 9) AS f1 FROM (SELECT t, 2.0::DOUBLE * count(*) FILTER (WHERE y = 1) / (count(*) + (SELECT sum(y) FROM sc)) AS f1 FROM grid JOIN sc ON p >= t GROUP BY t) ORDER BY round(f1, 12) DESC, t LIMIT 1", "sc", more=GRID))
def best_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.best_f1(_scored(spark, sf_dir)).select(F.round("threshold", 9).alias("threshold"), F.round("f1", 9).alias("f1"))


REAL = "CASE action WHEN 'approve' THEN y * amount WHEN 'review' THEN 3.0::DOUBLE + (1 - y) + y * (1 - 0.95::DOUBLE) * amount ELSE (1 - y) * (10.0::DOUBLE + 0.02::DOUBLE * amount) END"


@query("policy_cost_table", sql(f"SELECT round(CAST(sum(CAST(round({REAL}, 6) AS DECIMAL(20,6))) AS DOUBLE), 4) AS total_cost, CAST(sum(CASE WHEN action = 'approve' AND y = 1 THEN cents ELSE 0 END) / 100.0::DOUBLE AS DOUBLE) AS fraud_approved_amount, CAST(count(*) FILTER (WHERE action = 'review') AS BIGINT) AS reviews, CAST(count(*) FILTER (WHERE action = 'decline') AS BIGINT) AS declines, CAST(count(*) FILTER (WHERE action = 'decline' AND y = 0) AS BIGINT) AS false_declines, CAST(count(*) FILTER (WHERE action = 'approve' AND y = 1) AS BIGINT) AS frauds_approved, (SELECT CAST(coalesce(max(n), 0) AS BIGINT) FROM (SELECT count(*) n FROM acted WHERE action = 'review' GROUP BY day)) AS max_reviews_day FROM acted", "acted"))
def policy_cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.policy_table(D.bayes(_scored(spark, sf_dir)))


SEG = "seg AS (SELECT unnest(['gender ' || gender, CASE WHEN age < 30 THEN 'age <30' WHEN age < 50 THEN 'age 30-49' WHEN age < 65 THEN 'age 50-64' ELSE 'age 65+' END]) AS segment, y, action FROM (SELECT a.*, gender, (us / 86400000000.0::DOUBLE - dob_days) / 365.25::DOUBLE AS age FROM acted a JOIN cust USING (card_id)))"


@query("segment_audit", sql("SELECT segment, CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) AS fraud_rate, round(count(*) FILTER (WHERE y = 0 AND action <> 'approve') / nullif(count(*) FILTER (WHERE y = 0), 0)::DOUBLE, 6) AS friction, CAST(count(*) FILTER (WHERE action = 'decline') AS BIGINT) AS declines, round(count(*) FILTER (WHERE y = 1 AND action <> 'approve') / nullif(count(*) FILTER (WHERE y = 1), 0)::DOUBLE, 6) AS capture FROM seg GROUP BY segment", "acted", "cust", more=SEG))
def segment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    acted = D.bayes(_scored(spark, sf_dir)).join(T.customers(spark, sf_dir), "card_id")
    return D.segment_audit(acted.withColumn("age_years", S.age_years(F.col("us"), F.col("dob_days"))))


@query("daily_rollup", sql("SELECT day, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS frauds, CAST(count(*) FILTER (WHERE action = 'review') AS BIGINT) AS reviews, CAST(count(*) FILTER (WHERE action = 'decline') AS BIGINT) AS declines, CAST(sum(CASE WHEN y = 1 THEN cents ELSE 0 END) / 100.0::DOUBLE AS DOUBLE) AS fraud_amount FROM acted GROUP BY day", "acted"))
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.daily_rollup(D.bayes(_scored(spark, sf_dir)))


@query("outcome_label", sql("SELECT CASE action WHEN 'approve' THEN CASE WHEN y = 1 THEN 'missed' ELSE 'ok' END WHEN 'review' THEN CASE WHEN y = 1 THEN 'caught in review' ELSE 'reviewed ok' END ELSE CASE WHEN y = 1 THEN 'stopped' ELSE 'false decline' END END AS outcome, CAST(count(*) AS BIGINT) AS n FROM acted GROUP BY 1", "acted"))
def outcome_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.bayes(_scored(spark, sf_dir)).groupBy(D.outcome().alias("outcome")).agg(F.count("*").alias("n"))


@query("review_queue_topk", sql("SELECT txn_id, round(least(ca, cd) - cr, 9) AS saving FROM acted WHERE action = 'review' ORDER BY saving DESC, txn_id LIMIT 100", "acted"))
def review_queue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = D.bayes(_scored(spark, sf_dir)).where("action = 'review'")
    return D.top_rows(q.select("txn_id", F.round(F.least("cost_approve", "cost_decline") - F.col("cost_review"), 9).alias("saving")), 100, "saving")


@query("card_view", sql("SELECT card_id, gender, txn_id, us, cents, recency FROM (SELECT *, CAST(row_number() OVER (PARTITION BY card_id ORDER BY us DESC, txn_id DESC) AS INTEGER) AS recency FROM txn) JOIN cust USING (card_id) WHERE recency <= 12", "txn", "cust"))
def card_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.latest_per_key(_txns(spark, sf_dir)[0], "card_id").join(T.customers(spark, sf_dir), "card_id").select("card_id", "gender", "txn_id", "us", "cents", "recency")


@query("transaction_detail", sql("SELECT txn_id, action = 'review' AS in_queue, round(ca, 6) AS cost_approve, round(cr, 6) AS cost_review, round(cd, 6) AS cost_decline FROM acted WHERE txn_id = 26", "acted"))
def transaction_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.bayes(_scored(spark, sf_dir).where("txn_id = 26")).select("txn_id", (F.col("action") == "review").alias("in_queue"), *(F.round(f"cost_{a}", 6).alias(f"cost_{a}") for a in D.ACTIONS))


@query("options_view", sql("SELECT 'card' AS kind, '**** ' || right('0000' || card_id, 4) AS label FROM (SELECT DISTINCT card_id FROM txn) UNION ALL SELECT DISTINCT 'category', category FROM txn UNION ALL SELECT DISTINCT 'merchant', CAST(merchant_id AS VARCHAR) FROM txn", "txn"))
def options_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _txns(spark, sf_dir)[0]
    cards = t.select("card_id").distinct().select(F.lit("card").alias("kind"), F.concat(F.lit("**** "), F.right(F.concat(F.lit("0000"), F.col("card_id")), F.lit(4))).alias("label"))
    others = (t.select(F.lit(k).alias("kind"), F.col(c).cast("string").alias("label")).distinct() for k, c in (("category", "category"), ("merchant", "merchant_id")))
    return reduce(DataFrame.unionByName, others, cards)


# Metrics.


@query("average_ranks", sql("SELECT txn_id, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rank FROM sc", "sc"))
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.average_ranks(_scored(spark, sf_dir))


RANKED = "rk AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM sc)"
AUC = "(SELECT (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) FROM rk)"
CUM = "cum AS (SELECT p, n, pos, sum(n) OVER w AS taken, sum(pos) OVER w AS hits, sum(pos) OVER () AS total FROM lv WINDOW w AS (ORDER BY p DESC))"
AP = "(SELECT sum(pos * hits / taken::DOUBLE) / max(total) FROM cum)"
BINS = "bn AS (SELECT CAST(bin AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, avg(p) AS mean_p, avg(y) AS rate FROM (SELECT *, ntile(15) OVER (ORDER BY p, txn_id) - 1 AS bin FROM sc) GROUP BY bin)"
ECE = "(SELECT sum(n * abs(mean_p - rate)) / sum(n) FROM bn)"
LOSS = "(SELECT -avg(y * ln(q) + (1 - y) * ln(1 - q)) FROM (SELECT y, greatest(least(p, 1 - 1e-15), 1e-15) AS q FROM sc))"


def _round(df: DataFrame, n: int = 9) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("roc_auc", sql(f"SELECT round({AUC}, 9) AS roc_auc", "sc", more=RANKED))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.roc_auc(_scored(spark, sf_dir)))


@query("pr_points", sql("SELECT round(p, 9) AS p, round(hits / taken::DOUBLE, 9) AS precision, round(hits / total::DOUBLE, 9) AS recall FROM cum", "lv", more=CUM))
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.pr_points(_scored(spark, sf_dir)))


@query("average_precision", sql(f"SELECT round({AP}, 9) AS average_precision", "lv", more=CUM))
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.average_precision(_scored(spark, sf_dir)))


@query("precision_at_recall", sql("SELECT round(coalesce(max(hits / taken::DOUBLE) FILTER (WHERE hits / total::DOUBLE >= 0.8), 0), 9) AS precision FROM cum", "lv", more=CUM))
def precision_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.precision_at_recall(_scored(spark, sf_dir), 0.8))


RATE = "round(count(*) FILTER (WHERE taken AND y = 1) / count(*) FILTER (WHERE y = 1)::DOUBLE, 9) AS recall, round(CAST(sum(cents) FILTER (WHERE taken AND y = 1) AS DOUBLE) / CAST(sum(cents) FILTER (WHERE y = 1) AS DOUBLE), 9) AS dollar_recall, round(count(*) FILTER (WHERE taken AND y = 1) / count(*) FILTER (WHERE taken)::DOUBLE, 9) AS precision FROM top"


@query("recall_at_rate", sql(f"SELECT {RATE}", "sc", more=TOP))
def recall_at_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.at_rate(_scored(spark, sf_dir), 0.013))


@query("brier", sql("SELECT round(avg(power(p - y, 2)), 9) AS brier FROM sc", "sc"))
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.brier(_scored(spark, sf_dir)))


@query("log_loss", sql(f"SELECT round({LOSS}, 9) AS log_loss", "sc"))
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.log_loss(_scored(spark, sf_dir)))


@query("calibration_bins", sql("SELECT bin, n, round(mean_p, 9) AS mean_p, round(rate, 9) AS rate FROM bn", "sc", more=BINS))
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.calibration_bins(_scored(spark, sf_dir)))


@query("ece", sql(f"SELECT round({ECE}, 9) AS ece", "sc", more=BINS))
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.ece(_scored(spark, sf_dir)))


@query("summarize", sql(f"SELECT round({AUC}, 9) AS roc_auc, round({AP}, 9) AS average_precision, (SELECT round(avg(power(p - y, 2)), 9) FROM sc) AS brier, round({LOSS}, 9) AS log_loss, round({ECE}, 9) AS ece, {RATE}", "lv", more=", ".join([RANKED, CUM, BINS, TOP])))
def summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.summary(_scored(spark, sf_dir), 0.013))


def _sums() -> dict:
    taken = F.col("p") >= 0.3
    return {"hits": F.when(taken & (F.col("y") == 1), 1).otherwise(0), "taken": F.when(taken, 1).otherwise(0), "pos": F.col("y")}


@query("cluster_bootstrap")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster_bootstrap(_scored(spark, sf_dir), "card_id", _sums(), F.try_divide("hits", "pos"))


@query("paired_difference")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.paired_difference(_scored(spark, sf_dir), "card_id", _sums(), F.try_divide("hits", "pos"), F.try_divide("hits", "taken"))


@query("isotonic")
def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select("txn_id", "p", C.interpolate(F.col("p"), *C.isotonic(s)).alias("calibrated"))


@query("platt")
def platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    a, b = C.platt(s)
    return s.select("txn_id", N.sigmoid(a * C.logit(F.col("p"), 1e-6) + b).alias("calibrated"))


@query("prior_shift", sql("SELECT txn_id, round(1 / (1 + exp(-(ln(q / (1 - q)) + ln(0.02::DOUBLE / 0.98) - ln(0.1::DOUBLE / 0.9)))), 8) AS p FROM (SELECT txn_id, greatest(least(p, 1 - 1e-12), 1e-12) AS q FROM sc)", "sc"))
def prior_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("txn_id", F.round(C.prior_shift(F.col("p"), 0.1, 0.02), 8).alias("p"))


# Drift.

HALF = START + 15 * DAY


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = _scored(spark, sf_dir).withColumn("x", F.when(F.col("txn_id") % 10 != 0, F.col("amount")))
    return s.where(F.col("us") < HALF), s.where(F.col("us") >= HALF)


def psi_sql(x: str, name: str) -> tuple[str, str]:
    more = f"""h_{name} AS (SELECT {x} AS x, us < {HALF} AS r FROM sc), e_{name} AS (SELECT list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM h_{name} WHERE r AND x IS NOT NULL), c_{name} AS (SELECT CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(edges, lambda b: b <= x)) END AS bin, count(*) FILTER (WHERE r) AS a, count(*) FILTER (WHERE NOT r) AS b FROM h_{name}, e_{name} GROUP BY bin), s_{name} AS (SELECT greatest(a / (sum(a) OVER ())::DOUBLE, 1e-4) AS a, greatest(b / (sum(b) OVER ())::DOUBLE, 1e-4) AS b FROM c_{name}), k_{name} AS (SELECT x, sum(CASE WHEN r THEN 1 ELSE 0 END) AS a, sum(CASE WHEN r THEN 0 ELSE 1 END) AS b FROM h_{name} WHERE x IS NOT NULL GROUP BY x), g_{name} AS (SELECT abs(sum(a) OVER w / (sum(a) OVER ())::DOUBLE - sum(b) OVER w / (sum(b) OVER ())::DOUBLE) AS gap FROM k_{name} WINDOW w AS (ORDER BY x))"""
    return more, f"(SELECT round(sum((b - a) * ln(b / a)), 7) FROM s_{name})"


XNULL = "CASE WHEN txn_id % 10 <> 0 THEN amount END"


@query("psi", sql(f"SELECT {psi_sql(XNULL, 'x')[1]} AS psi", "sc", more=psi_sql(XNULL, "x")[0]))
def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.psi(*_halves(spark, sf_dir), "x"), 7)


@query("ks_statistic", sql("SELECT round(max(gap), 9) AS ks FROM g_x", "sc", more=psi_sql(XNULL, "x")[0]))
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.ks(*_halves(spark, sf_dir), "x"))


@query("feature_drift", sql(" UNION ALL ".join(f"SELECT '{n}' AS feature, {psi_sql(x, n)[1]} AS psi, (SELECT round(max(gap), 7) FROM g_{n}) AS ks" for n, x in (("x", XNULL), ("p", "p"), ("cents", "cents"))), "sc", more=", ".join(psi_sql(x, n)[0] for n, x in (("x", XNULL), ("p", "p"), ("cents", "cents")))))
def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.feature_drift(*_halves(spark, sf_dir), ["x", "p", "cents"]), 7)


@query("alert_rate_ratio", sql(f"SELECT round(avg(CASE WHEN p >= 0.3 THEN 1.0 ELSE 0 END) FILTER (WHERE us >= {HALF}) / avg(CASE WHEN p >= 0.3 THEN 1.0 ELSE 0 END) FILTER (WHERE us < {HALF}), 9) AS ratio FROM sc", "sc"))
def alert_rate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.alert_rate_ratio(*_halves(spark, sf_dir), "p", 0.3))


@query("drift_trigger", "SELECT * FROM (VALUES (0.05::DOUBLE, false), (0.2::DOUBLE, true)) v(psi, due)")
def drift_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0.05, 0.1, 1.2), (0.2, 0.1, 1.2)], "psi double, top double, ratio double")
    return rows.select("psi", X.trigger(F.col("psi"), F.col("top"), F.col("ratio")).alias("due"))


@query("threshold_shares", sql(f"SELECT t AS threshold, round(avg(CASE WHEN p >= t THEN 1.0 ELSE 0.0 END) FILTER (WHERE us < {HALF}), 9) AS ref_share, round(avg(CASE WHEN p >= t THEN 1.0 ELSE 0.0 END) FILTER (WHERE us >= {HALF}), 9) AS cur_share FROM sc, (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS t) GROUP BY t", "sc"))
def threshold_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.threshold_shares(*_halves(spark, sf_dir), "p", [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))


@query("live_drift", sql(f"SELECT CASE WHEN (SELECT count(*) FROM sc WHERE us >= {HALF}) >= 1000 THEN {psi_sql('p', 'p')[1]} END AS psi, CASE WHEN (SELECT count(*) FROM sc WHERE us >= {HALF}) >= 1000 THEN (SELECT round(avg(CASE WHEN p >= 0.3 THEN 1.0 ELSE 0 END) FILTER (WHERE us >= {HALF}) / avg(CASE WHEN p >= 0.3 THEN 1.0 ELSE 0 END) FILTER (WHERE us < {HALF}), 7) FROM sc) END AS ratio", "sc", more=psi_sql("p", "p")[0]))
def live_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.live_drift(*_halves(spark, sf_dir), "p", 0.3), 7)


@query("latency_percentiles", sql("SELECT round(quantile_cont(amount, 0.5), 6) AS p50, round(quantile_cont(amount, 0.95), 6) AS p95, round(quantile_cont(amount, 0.99), 6) AS p99 FROM sc", "sc"))
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.percentiles(_scored(spark, sf_dir), "amount"), 6)


@query("adversarial_validation")
def adversarial_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = _halves(spark, sf_dir)
    auc, gain = X.adversarial(ref, cur, ["amount", "p", "merchant_id"])
    return spark.createDataFrame([("auc", auc), *gain.items()], "name string, value double")


CARD_ONLY = CARD_RISK.of_group("card")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both streams of ``events`` as one unbounded table."""
    t = _txns(spark, sf_dir)[0]  # also tells workers where this package is
    raw = spark.readStream.schema(T.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    own = raw.select(F.col("event_id").alias("txn_id"), T.micros(F.col("ts")).alias("us"), F.col("user_id").alias("card_id"), F.get_json_object("props", "$.k").cast("bigint").alias("merchant_id"), F.col("event_type").alias("category"), T.to_cents(F.col("value")).alias("cents"))
    return events(own, T.chargebacks(own)).select(*t.columns, "is_txn")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.replay(ST.stateful(_stream(spark, sf_dir), CARD_RISK.pick(CARD_ONLY)), "card-features")


_CARD_COLS = ", ".join(f"CAST({agg_sql(a, 'ev')} AS DOUBLE) AS {a.name}" for a in CARD_RISK.values() if a.name in CARD_ONLY)


@query("stream_card_features", sql(f"SELECT * EXCLUDE (is_txn) FROM (SELECT txn_id, is_txn, {_CARD_COLS} FROM ev) WHERE is_txn", "ev"))
def stream_card_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _streamed(spark, sf_dir)
    return got.select("txn_id", *(F.round(n, 6).alias(n) for n in CARD_ONLY))


KEYED = CARD_RISK.of_group("card_category", "merchant", "category")
_KEYED_COLS = ", ".join(f"CAST({agg_sql(a, 'ev')} AS DOUBLE) AS {a.name}" for a in CARD_RISK.values() if a.name in KEYED)


@query("stream_keyed_features", sql(f"SELECT * EXCLUDE (is_txn) FROM (SELECT txn_id, is_txn, {_KEYED_COLS} FROM ev) WHERE is_txn", "ev"))
def stream_keyed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ST.replay_groups(lambda: _stream(spark, sf_dir), CARD_RISK.pick(KEYED))
    return got.select("txn_id", *(F.round(n, 6).alias(n) for n in KEYED))


@query("parity_diff", sql("SELECT f AS feature, (SELECT CAST(count(*) AS BIGINT) FROM txn) AS rows, 0::BIGINT AS null_mismatch, 0::BIGINT AS mismatch FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in CARD_ONLY) + "]) AS f)", "txn"))
def parity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = compute(CARD_RISK.pick(CARD_ONLY), *_txns(spark, sf_dir))
    return X.parity(batch, _streamed(spark, sf_dir), "txn_id", CARD_ONLY).drop("max_diff")


@query("stream_dedup", sql("SELECT DISTINCT txn_id // 2 AS txn_id FROM txn", "txn"))
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir).where("is_txn").select((F.col("txn_id").cast("bigint") / 2).cast("bigint").alias("txn_id"), F.timestamp_micros("us").alias("ts"))
    return ST.replay(ST.deduplicated(s, "60 days"), "dedup").select("txn_id")


@query("stream_scoring", sql("SELECT txn_id, action FROM acted", "acted"))
def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = shared_path(spark, "predictions")
    ST.scored_batches(_stream(spark, sf_dir).where("is_txn").drop("is_txn"), lambda b: D.bayes(T.scored(b)).select("txn_id", "action"), sink, shared_path(spark, "predictions-state"))
    return spark.read.parquet(sink).select("txn_id", "action")


@query("stream_warm_start", sql(f"SELECT * EXCLUDE (is_txn, us) FROM (SELECT txn_id, is_txn, us, {_CARD_COLS} FROM ev) WHERE is_txn AND us >= {HALF}", "ev"))
def stream_warm_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the events as a snapshot, the second as a stream that starts from it."""
    spec, at = CARD_RISK.pick(CARD_ONLY), shared_path(spark, "snapshot")
    ST.snapshot(spec, events(*_txns(spark, sf_dir)).where(F.col("us") < HALF), at)
    got = ST.replay(ST.stateful(_stream(spark, sf_dir).where(F.col("us") >= HALF), spec, warm=at), "warm")
    return got.select("txn_id", *(F.round(n, 6).alias(n) for n in CARD_ONLY))


#: Weights and usual values of a small scorer, and the knots of its calibration.
WEIGHTS = {"card__count_24h": (0.5, 2.0), "card__sum_amount_7d": (0.001, 500.0), "card__since_last": (-0.000001, 86400.0), "card__distinct_merchant_24h": (0.25, 1.0), "card__max_amount_24h": (0.002, 200.0)}
BIAS, KNOTS = -0.5, [(0.1, 0.01), (0.5, 0.2), (0.9, 0.8)]


def _pipeline_sql(where: str = "is_txn") -> str:
    adds = {n: f"coalesce({w!r}::DOUBLE * ({n} - {usual!r}::DOUBLE), 0.0::DOUBLE)" for n, (w, usual) in WEIGHTS.items()}
    cols = ", ".join(f"CAST({agg_sql(CARD_RISK[n], 'ev')} AS DOUBLE) AS {n}" for n in WEIGHTS)
    reasons = ", ".join(f"{{'less': -({a}), 'name': '{n}'}}" for n, a in adds.items())
    steps = " ".join(f"WHEN raw < {b1}::DOUBLE THEN {v0}::DOUBLE + (raw - {b0}::DOUBLE) / ({b1}::DOUBLE - {b0}::DOUBLE) * ({v1}::DOUBLE - {v0}::DOUBLE)" for (b0, v0), (b1, v1) in zip(KNOTS[:-1], KNOTS[1:], strict=True))
    return f"""SELECT txn_id, round(p, 6) AS p, CASE WHEN ca <= cr AND ca <= cd THEN 'approve' WHEN cr <= cd THEN 'review' ELSE 'decline' END AS action, reasons FROM (SELECT *, p * amount AS ca, 3.0::DOUBLE + (1 - p) * 1.0::DOUBLE + p * (1 - 0.95::DOUBLE) * amount AS cr, (1 - p) * (10.0::DOUBLE + 0.02::DOUBLE * amount) AS cd FROM (SELECT *, CASE WHEN raw < {KNOTS[0][0]}::DOUBLE THEN {KNOTS[0][1]}::DOUBLE {steps} ELSE {KNOTS[-1][1]}::DOUBLE END AS p FROM (SELECT txn_id, cents / 100.0::DOUBLE AS amount, 1 / (1 + exp(-({BIAS}::DOUBLE + {' + '.join(adds.values())}))) AS raw, array_to_string(list_transform(list_sort(list_filter([{reasons}], lambda x: x.less < 0))[1:3], lambda x: x.name), ',') AS reasons FROM (SELECT txn_id, is_txn, cents, {cols} FROM ev) WHERE {where})))"""


def _scorer() -> Callable[[DataFrame], DataFrame]:
    return ST.scorer(WEIGHTS, BIAS, KNOTS, lambda rows: D.bayes(rows.withColumn("amount", F.col("cents") / 100.0)))


@query("stream_scoring_pipeline", sql(_pipeline_sql(), "ev"))
def stream_scoring_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, model, calibration, policy and reasons of a stream, batch by batch."""
    sink, score = shared_path(spark, "decisions"), _scorer()
    stream = ST.stateful(_stream(spark, sf_dir), CARD_RISK.pick(WEIGHTS))
    ST.scored_batches(stream, lambda b: score(b.where("not late")).select("txn_id", F.round("p", 6).alias("p"), "action", "reasons"), sink, shared_path(spark, "decisions-state"))
    return spark.read.parquet(sink).select("txn_id", "p", "action", "reasons")


@query("decision_explanation", sql(_pipeline_sql("is_txn AND txn_id = 26"), "ev"))
def decision_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detail of one transaction shows of its score."""
    t, cb = _txns(spark, sf_dir)
    rows = compute(CARD_RISK.pick(WEIGHTS), t, cb).where("txn_id = 26").join(t.where("txn_id = 26").select("txn_id", "cents"), "txn_id")
    return _scorer()(rows).select("txn_id", F.round("p", 6).alias("p"), "action", "reasons")


# Sketches.


@query("first_time_pair", sql("SELECT txn_id, row_number() OVER (PARTITION BY card_id, merchant_id ORDER BY us, txn_id) = 1 AS is_new FROM txn", "txn"))
def first_time_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.first_time(_txns(spark, sf_dir)[0], ["card_id", "merchant_id"]).select("txn_id", "is_new")


@query("welford", sql("SELECT card_id, round(avg(cents), 4) AS mean, round(var_pop(cents), 2) AS var_pop, round(var_samp(cents), 2) AS var_sample FROM txn GROUP BY card_id", "txn"))
def welford(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = K.moments(_txns(spark, sf_dir)[0], "card_id", "cents")
    return m.select("card_id", F.round("mean", 4).alias("mean"), F.round("var_pop", 2).alias("var_pop"), F.round("var_sample", 2).alias("var_sample"))


@query("lru_recency", sql("SELECT card_id, merchant_id, last_us, recency FROM (SELECT *, CAST(row_number() OVER (PARTITION BY card_id ORDER BY last_us DESC, last_id DESC) AS INTEGER) AS recency FROM (SELECT card_id, merchant_id, max(us) AS last_us, arg_max(txn_id, (us, txn_id)) AS last_id FROM txn GROUP BY ALL)) WHERE recency <= 5", "txn"))
def lru_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.most_recent(_txns(spark, sf_dir)[0], "card_id", "merchant_id", 5)


@query("lru_hits", sql("SELECT txn_id, coalesce(before IS NOT NULL AND (SELECT count(DISTINCT e.merchant_id) FROM e WHERE e.card_id = p.card_id AND e.n > p.before AND e.n < p.n) < 5, false) AS hit FROM p", "txn", more="e AS (SELECT txn_id, card_id, merchant_id, row_number() OVER (PARTITION BY card_id ORDER BY us, txn_id) AS n FROM txn), p AS (SELECT *, lag(n) OVER (PARTITION BY card_id, merchant_id ORDER BY n) AS before FROM e)"))
def lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.lru_hits(_txns(spark, sf_dir)[0], "card_id", "merchant_id", 5).select("txn_id", "hit")


@query("count_min")
def count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.count_min_estimates(_txns(spark, sf_dir)[0], "card_id", 1e-3, 0.01)


@query("bloom_filter")
def bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _txns(spark, sf_dir)[0]
    return K.bloom_contains(t, "card_id", K.bloom(t.where("card_id % 2 = 0"), F.col("card_id"), 20_000, 0.01), 20_000, 0.01)


@query("sketch_evaluation")
def sketch_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.evaluate(_txns(spark, sf_dir)[0], ["card_id", "merchant_id"], 1e-3, 0.01, 20_000, 0.01)


# Models.


def _model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("txn_id", "us", "y", "card_id", "p", F.col("amount"), F.col("merchant_id").cast("double").alias("merchant"), S.is_night(F.col("us")).alias("night"))


MODEL_COLUMNS = ["p", "amount", "merchant", "night"]


@query("irls_logistic")
def irls_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _model_frame(spark, sf_dir)
    pre = N.Preprocessor.fit(f, MODEL_COLUMNS)
    cols = pre.columns()
    x = f.withColumns(cols)
    names = [c for c in cols if not c.endswith("_missing")]
    beta = N.irls(x, names)
    return x.select("txn_id", N.sigmoid(N.linear(names, beta)).alias("score"))


@query("linear_preprocessor")
def linear_preprocessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _scored(spark, sf_dir)
    pre = N.Preprocessor.fit(f, ["amount", "p"], ["category"])
    return f.select("txn_id", *(c.alias(n) for n, c in pre.columns().items()))


@query("ftrl_online")
def ftrl_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _model_frame(spark, sf_dir).withColumn("amount", F.log1p("amount"))
    return N.ftrl(f, ["p", "amount", "night"], ["us", "txn_id"])


def _trees(f: DataFrame) -> N.Trees:
    return N.fit_trees(f, MODEL_COLUMNS, rounds=5, depth=3)


@query("gbdt_predict")
def gbdt_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _model_frame(spark, sf_dir)
    m = _trees(f)
    return m.binned(f).select("txn_id", N.sigmoid(m.margin()).alias("score"), m.leaves().alias("leaves"))


@query("gbdt_contributions")
def gbdt_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _model_frame(spark, sf_dir)
    m = _trees(f)
    rows = m.binned(f).select("txn_id", m.margin().alias("margin"), F.lit(m.bias()).alias("base"), m.contributions().alias("contributions"))
    action = F.when(F.col("margin") > 0, "decline").otherwise("approve")
    return rows.select("txn_id", "margin", "base", "contributions", N.reasons("contributions", MODEL_COLUMNS, action).alias("reasons"), N.explanation("contributions", MODEL_COLUMNS).alias("explanation"))


@query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(_trees(_model_frame(spark, sf_dir)).importance().items()), "feature string, share double")


@query("rules_baseline", sql("SELECT txn_id, amount * (1 + 2 * CASE WHEN (us // 3600000000) % 24 >= 22 OR (us // 3600000000) % 24 < 4 THEN 1 ELSE 0 END) AS score FROM sc", "sc"))
def rules_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_frame(spark, sf_dir).select("txn_id", N.rules(F.col("amount"), F.col("night")).alias("score"))


@query("logloss_gradients", sql("SELECT txn_id, round(1 / (1 + exp(-(p - 1))) - y, 9) AS g, round(greatest(1 / (1 + exp(-(p - 1))) * (1 - 1 / (1 + exp(-(p - 1)))), 1e-6), 9) AS h FROM sc", "sc"))
def logloss_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, h = N.logloss_gradients(F.col("p") - 1, F.col("y"))
    return _scored(spark, sf_dir).select("txn_id", F.round(g, 9).alias("g"), F.round(h, 9).alias("h"))


FOCAL = """SELECT txn_id, round(a * s * power(1 - q, 2) * (2 * q * ln(q) + q - 1), 9) AS g, round(greatest(a * q * (1 - q) * (power(1 - q, 2) * (2 * ln(q) + 3) - 2 * (1 - q) * (2 * q * ln(q) + q - 1)), 1e-6), 9) AS h FROM (SELECT txn_id, greatest(CASE WHEN y = 1 THEN 1 / (1 + exp(-m)) ELSE 1 - 1 / (1 + exp(-m)) END, 1e-12) AS q, CASE WHEN y = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS a, CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM (SELECT txn_id, y, MARGIN AS m FROM sc))"""


@query("focal_gradients", sql(FOCAL.replace("MARGIN", "p - 1"), "sc"))
def focal_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, h = N.focal_gradients(F.col("p") - 1, F.col("y"))
    return _scored(spark, sf_dir).select("txn_id", F.round(g, 9).alias("g"), F.round(h, 9).alias("h"))


# Sources and sinks.


@query("month_partitions", sql("SELECT txn_id, strftime(make_timestamp(us), '%Y-%m') AS month FROM otxn WHERE strftime(make_timestamp(us), '%Y-%m') BETWEEN '1995-03' AND '1995-06'", "otxn"))
def month_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "months")
    storage.write_by_month(T.from_orders(spark, sf_dir), path)
    return storage.read_months(spark, path, "1995-03", "1995-06").select("txn_id", F.col("month").cast("string").alias("month"))


@query("materialized_features", sql(f"SELECT txn_id, v AS card__count_24h FROM (SELECT txn_id, is_txn, {agg_sql(next(a for a in CARD_RISK.values() if a.name == 'card__count_24h'), 'ev')} AS v FROM ev) WHERE is_txn", "ev"))
def materialized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = CARD_RISK.pick(["card__count_24h"])
    return spark.read.parquet(storage.materialize(compute(spec, *_txns(spark, sf_dir)).drop("us"), shared_path(spark, "features"), spec))


@query("prediction_log", sql("SELECT txn_id, txn_id % 2 AS model_version FROM txn", "txn"))
def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = shared_path(spark, "log"), _txns(spark, sf_dir)[0].select("txn_id", (F.col("txn_id") % 2).alias("model_version"), F.floor(F.col("us") / DAY).alias("day"))
    storage.append_new(rows.where("txn_id % 3 = 0"), path, ["txn_id", "model_version"], "day")
    storage.append_new(rows, path, ["txn_id", "model_version"], "day")
    return spark.read.parquet(path).select("txn_id", "model_version")


@query("csv_scan", sql("SELECT txn_id, cents FROM txn", "txn"))
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    storage.write_csv(_txns(spark, sf_dir)[0].select("txn_id", "cents"), path)
    return spark.read.schema("txn_id long, cents long").option("header", True).csv(path)


@query("export_subset", sql(f"SELECT txn_id FROM txn WHERE us >= {START + 15 * DAY} OR txn_id IN (SELECT txn_id FROM cb)", "cb"))
def export_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.export_subset(*_txns(spark, sf_dir), START + 20 * DAY, 5 * DAY).select("txn_id")


@query("constraints", sql("SELECT rule, CASE rule WHEN 'amount above zero' THEN (SELECT CAST(count(*) AS BIGINT) FROM txn WHERE cents <= 0) ELSE 0 END AS n FROM (SELECT unnest(['amount above zero', 'one row per transaction', 'card has a customer', 'chargeback has a transaction', 'reported after the transaction']) AS rule)", "txn"))
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.violations(*_txns(spark, sf_dir), T.customers(spark, sf_dir))


# Questions, verdicts and hypothetical payments.

PEEK = ["card__count_24h", "card__sum_amount_7d", "card__max_amount_7d", "card__distinct_merchant_24h", "card__since_last", "card__mean_amount_all", "merchant__count_30d", "global__cb_count_30d"]
ASKED = f"asked AS (SELECT -1 - card_id AS txn_id, {START + 20 * DAY} AS us, card_id, card_id % 7 AS merchant_id, 'view' AS category, 12345 AS cents FROM (SELECT DISTINCT card_id FROM txn))"


def _asked(t: DataFrame) -> DataFrame:
    return t.select("card_id").distinct().select((-1 - F.col("card_id")).alias("txn_id"), F.lit(START + 20 * DAY).alias("us"), "card_id", (F.col("card_id") % 7).alias("merchant_id"), F.lit("view").alias("category"), F.lit(12345).cast("bigint").alias("cents"))


def _peek_sql(names: list[str] = PEEK) -> str:
    def one(a: Feature) -> str:
        v = a.column
        same = "".join(f" AND e.{k} = q.{k}" for k in a.keys)
        low = f" AND e.us >= q.us - {a.span}" if a.span else ""
        where = f"FROM ev e WHERE e.us < q.us{low}{same} AND {'' if a.stream == 'txn' else 'NOT '}e.is_txn"
        what = {"count": "CAST(count(*) AS BIGINT)", "sum": f"round(coalesce(sum({v}), 0) / 100.0::DOUBLE, 6)", "max": f"max({v}) / 100.0::DOUBLE", "distinct": f"CAST(count(DISTINCT {v}) AS BIGINT)", "since_last": "round((q.us - max(e.us)) / 1000000.0::DOUBLE, 6)", "mean": f"round(sum({v}) / nullif(count(*), 0)::DOUBLE / 100.0::DOUBLE, 6)"}[a.measure]
        return f"(SELECT {what.replace('q.us', str(START + 20 * DAY))} {where}) AS {a.name}"

    return "SELECT txn_id, " + ", ".join(one(a) for a in CARD_RISK.values() if a.name in names) + " FROM asked q"


@query("what_if", sql(_peek_sql(), "ev", more=ASKED))
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, cb = _txns(spark, sf_dir)
    spec = CARD_RISK.pick(PEEK)
    return _rounded(desk.what_if(spec, t, cb, _asked(t)), list(spec))


LIVE = ["card__count_24h", "card__sum_amount_24h", "card__max_amount_24h", "card__distinct_merchant_24h", "card__distinct_category_24h", "card__since_last", "card__count_all", "card__mean_amount_all"]
CLOCK_DAY = (START + 20 * DAY) // DAY


@query("card_live_view", sql(_peek_sql(LIVE).replace("SELECT txn_id, ", f"SELECT q.card_id, gender, round(({CLOCK_DAY} - dob_days) / 365.25::DOUBLE, 6) AS age_years, ", 1) + " JOIN cust USING (card_id)", "ev", "cust", more=ASKED))
def card_live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of each card, its holder's age at the clock, and its features as they stand then."""
    t, cb = _txns(spark, sf_dir)
    spec, asked = CARD_RISK.pick(LIVE), _asked(t)
    live = _rounded(peek(spec, t, cb, asked), list(spec)).select((-1 - F.col("txn_id")).alias("card_id"), *LIVE)
    who = T.customers(spark, sf_dir).select("card_id", "gender", F.round((F.lit(CLOCK_DAY) - F.col("dob_days")) / 365.25, 6).alias("age_years"))
    return R.lookup(live, who, "card_id", "inner").select("card_id", "gender", "age_years", *LIVE)


@query("what_if_leaves_no_trace", sql("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT card_id FROM txn)", "txn"))
def what_if_leaves_no_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, cb = _txns(spark, sf_dir)
    spec = CARD_RISK.pick(PEEK)
    once = peek(spec, t, cb, _asked(t))
    # Every question twice: whatever the cards' numbers, the last bit keeps the two apart.
    twice = _asked(t).withColumn("txn_id", F.explode(F.array(F.col("txn_id") * 2, F.col("txn_id") * 2 + 1)))
    again = peek(spec, t, cb, twice).where("txn_id % 2 = 0").withColumn("txn_id", F.expr("txn_id div 2"))
    return once.intersect(again).agg(F.count("*").alias("n"))


@query("resolve_case", sql(f"SELECT txn_id, {START + 30 * DAY} AS reported_us, cents FROM acted WHERE action = 'review' AND y = 1 AND txn_id % 2 = 1", "acted"))
def resolve_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = D.bayes(_scored(spark, sf_dir)).where("action = 'review'")
    verdicts = queue.where("txn_id % 2 = 1").select("txn_id", (F.col("y") == 1).alias("is_fraud"))
    return desk.resolve(queue, verdicts, START + 30 * DAY)[1].select("txn_id", "reported_us", "cents")


@query("resolve_queue", sql("SELECT txn_id FROM acted WHERE action = 'review' AND txn_id % 2 = 0", "acted"))
def resolve_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = D.bayes(_scored(spark, sf_dir)).where("action = 'review'")
    return desk.resolve(queue, queue.where("txn_id % 2 = 1").select("txn_id", (F.col("y") == 1).alias("is_fraud")), START)[0].select("txn_id")


MANUAL = _pipeline_sql("txn_id = -4").replace("FROM ev)", "FROM (SELECT * FROM ev UNION ALL SELECT *, true FROM asked WHERE card_id = 3))")


@query("score_manual", sql(f"SELECT m.*, round(home_lat + 10 / 111.2::DOUBLE, 9) AS merch_lat FROM ({MANUAL}) m, cust WHERE card_id = 3", "ev", "cust", more=ASKED))
def score_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment made up at the clock, ten kilometres north of its holder's home, recorded and scored."""
    t, cb = _txns(spark, sf_dir)
    payment = _asked(t).where("card_id = 3")
    rows = compute(CARD_RISK.pick(WEIGHTS), desk.record(t, payment), cb).where("txn_id < 0").join(payment.select("txn_id", "card_id", "cents"), "txn_id")
    home = T.customers(spark, sf_dir).select("card_id", "home_lat")
    got = R.lookup(_scorer()(rows), home, "card_id", "inner")
    return got.select("txn_id", F.round("p", 6).alias("p"), "action", "reasons", F.round(desk.placed(F.col("home_lat"), F.lit(10)), 9).alias("merch_lat"))


@query("idempotent_decisions", sql("SELECT txn_id, CASE WHEN txn_id % 2 = 0 THEN 'approve' ELSE action END AS action FROM acted", "acted"))
def idempotent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    seen = s.where("txn_id % 2 = 0").select("txn_id", "p", F.lit("approve").alias("action"))
    return desk.decide(s, seen).select("txn_id", "action")


# Studies.


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = _model_frame(spark, sf_dir).withColumnRenamed("p", "level")
    return f.where(F.col("us") < HALF), f.where(F.col("us") >= HALF)


STUDY = ["level", "amount", "night"]
VALID = HALF - 5 * DAY


@query("hyper_search")
def hyper_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _model_frame(spark, sf_dir).withColumnRenamed("p", "level")
    return E.search(f, STUDY, {"depth": [2, 3]}, L.rolling_folds(START, START + 30 * DAY, 2), rounds=2)


@query("retraining_backtest")
def retraining_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _labelled(spark, sf_dir).withColumns({"level": F.col("p"), "night": S.is_night(F.col("us"))}).select("txn_id", "us", "y", "reported_us", *STUDY)
    return E.backtest(f, STUDY, [(START + d * DAY, START + (d + 5) * DAY) for d in (20, 25)], 4 * DAY, 10 * DAY, rounds=2, depth=2)


@query("imbalance_study")
def imbalance_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, test = _parts(spark, sf_dir)
    return E.imbalance_study(known.where(F.col("us") < VALID), known.where(F.col("us") >= VALID), test, STUDY)


@query("model_comparison")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = {"rounds": 3, "depth": 2}
    models = {"rules": E.rules("amount", "night"), "logistic": E.logistic(STUDY), "trees": E.trees(STUDY, **how), "sampled trees": E.trees(STUDY, subsample=0.8, colsample=0.7, **how)}
    models |= {f"trees without {c}": E.trees([x for x in STUDY if x != c], **how) for c in STUDY[:2]}  # ablation
    return E.comparison(*_parts(spark, sf_dir), models, "card_id")


@query("leaf_ftrl")
def leaf_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.leaf_ftrl(*_parts(spark, sf_dir), STUDY, ["us", "txn_id"], rounds=2, depth=2)


@query("train_bundle")
def train_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = _parts(spark, sf_dir)
    model = N.fit_trees(train, STUDY, rounds=3, depth=2, valid=valid)
    fixed = C.isotonic(model.binned(valid).select("y", N.sigmoid(model.margin()).alias("p")))
    return E.ship(spark, model, *fixed, spec=CARD_RISK.fingerprint, algorithm="boosted trees")
