"""Reading and writing tables: typed files, month partitions, versioned features, registries and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.relational import canonical_id, first_non_null, max_distinct, surrogate_keys
from tidemark.plans.spec import Catalog

RAW = "trans_date_trans_time timestamp, cc_num long, merchant string, category string, amt decimal(10,2), gender string, city string, state string, zip string, lat double, long double, city_pop int, job string, dob date, trans_num string, merch_lat double, merch_long double, is_fraud int"


def read_raw(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Raw transactions of several files with a fixed schema, ordered by time and number."""
    return spark.read.schema(RAW).option("header", True).csv(list(paths)).orderBy("trans_date_trans_time", "trans_num")


def normalize(raw: DataFrame) -> dict[str, DataFrame]:
    """customers, merchants, transactions and ground_truth of raw rows; a card with several attributes is an error."""
    order = ["trans_date_trans_time", "trans_num"]
    raw = raw.withColumns({"card_id": F.col("cc_num"), "txn_id": canonical_id(F.col("trans_num")), "name": F.regexp_replace("merchant", "^fraud_", "")})
    checked = max_distinct(raw, "card_id", ["dob", "lat", "long", "job"]).first()
    if any((v or 0) > 1 for v in checked):
        raise ValueError(f"cards with several attributes: {checked}")
    merchants = surrogate_keys(raw, "name", "merchant_id")
    customers = first_non_null(raw, "card_id", ["gender", "dob", "job", "city", "state", "zip", "lat", "long", "city_pop"], order).withColumnsRenamed({"lat": "home_lat", "long": "home_lon"})
    txns = raw.join(merchants, "name").select("txn_id", F.col("trans_date_trans_time").alias("ts"), "card_id", "merchant_id", "category", F.col("amt").alias("amount"), "merch_lat", F.col("merch_long").alias("merch_lon"))
    return {"customers": customers, "merchants": merchants, "transactions": txns, "ground_truth": raw.select("txn_id", (F.col("is_fraud") == 1).alias("is_fraud"))}


def write_by_month(df: DataFrame, path: str, us: str = "us") -> None:
    """One folder per month; a filter on ``month`` reads its folders only."""
    df.withColumn("month", F.date_format(F.timestamp_micros(us), "yyyy-MM")).repartition("month", F.pmod(F.xxhash64("txn_id"), F.lit(16))).write.partitionBy("month").mode("overwrite").parquet(path)


def read_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("month").between(first, last))


def feature_path(base: str, spec: Catalog) -> str:
    """Where features of this declaration lie; another declaration has another place."""
    return f"{base.rstrip('/')}/offline_features_{spec.fingerprint}"


def materialize(features: DataFrame, base: str, spec: Catalog) -> str:
    path = feature_path(base, spec)
    features.write.mode("overwrite").parquet(path)
    return path


def append_new(df: DataFrame, path: str, key: Sequence[str], day: str) -> None:
    """Appends rows whose key isn't there yet on their ``day``; only the days that ``df`` has are read again."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        days = [r[0] for r in df.select(day).distinct().collect()]
        there = spark.read.parquet(path).where(F.col(day).isin(days)).select(day, *key)
        df = df.join(there, [day, *key], "left_anti")
    df.dropDuplicates([day, *key]).write.partitionBy(day).mode("append").parquet(path)


def without_version(predictions: DataFrame, version: str) -> DataFrame:
    return predictions.where(~F.col("model_version").eqNullSafe(version))


def export_subset(txns: DataFrame, chargebacks: DataFrame, start_us: int, history_us: int) -> DataFrame:
    """Transactions since ``history_us`` before the start, and older ones that came back."""
    recent = txns.where(F.col("us") >= start_us - history_us)
    older = txns.where(F.col("us") < start_us - history_us).join(chargebacks, "txn_id", "left_semi")
    return recent.unionByName(older)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files, as many as ``df`` has partitions, each with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A report's table of at most ``rows`` rows."""
    got = df.limit(rows).collect()
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, got)])


def bootstrap(spark: SparkSession, database: str, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Creates a database, loads tables into it, gathers their statistics and gives their sizes."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    sizes = {}
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")
        spark.sql(f"ANALYZE TABLE {database}.{name} COMPUTE STATISTICS")
        sizes[name] = spark.table(f"{database}.{name}").count()
    return sizes


def violations(txns: DataFrame, chargebacks: DataFrame, customers: DataFrame) -> DataFrame:
    """rule and n of rows that break a constraint."""
    repeated = txns.groupBy("txn_id").count().where("count > 1")
    rules = {
        "amount above zero": txns.where("cents <= 0"),
        "one row per transaction": repeated,
        "card has a customer": txns.join(customers, "card_id", "left_anti"),
        "chargeback has a transaction": chargebacks.join(txns, "txn_id", "left_anti"),
        "reported after the transaction": chargebacks.where("reported_us <= txn_us"),
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in rules.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
