"""Canonical tables (transactions, chargebacks, customers) over the star schema, with explicit types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.spec import HOUR

CB_EVERY = 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, UTC, whether the column has a time zone or not."""
    return F.unix_micros(ts.cast("timestamp"))


def to_cents(amount: Column) -> Column:
    return F.rint(amount * 100).cast("bigint")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    merchant = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("event_id").alias("txn_id"), micros(F.col("ts")).alias("us"), F.col("user_id").alias("card_id"), merchant.alias("merchant_id"), F.col("event_type").alias("category"), to_cents(F.col("value")).alias("cents"))


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with many ties: orders stand at midnight of their day."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("txn_id"), micros(F.col("o_orderdate")).alias("us"), F.col("o_custkey").alias("card_id"), (F.col("o_orderkey") % 50).alias("merchant_id"), F.col("o_orderpriority").alias("category"), to_cents(F.col("o_totalprice")).alias("cents"))


def chargebacks(txns: DataFrame) -> DataFrame:
    """Every 13th transaction comes back, one to twenty-one days later."""
    delay = (24 + (F.col("txn_id") * 7919) % 480) * HOUR
    return txns.where(F.col("txn_id") % CB_EVERY == 0).select("txn_id", F.col("us").alias("txn_us"), (F.col("us") + delay).alias("reported_us"), "card_id", "merchant_id", "category", "cents")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("card_id"),
        F.when(k % 2 == 0, "F").otherwise("M").alias("gender"),
        (F.lit(-7305) + (k * 37) % 18000).cast("bigint").alias("dob_days"),
        (25 + (k * 7919) % 2500 / 100).alias("home_lat"),
        (-120 + (k * 104729) % 5000 / 100).alias("home_lon"),
        (100 + (k * 31) % 100000).alias("city_pop"),
    )


def places(merchant: Column) -> list[Column]:
    return [(25 + (merchant * 7919) % 2500 / 100).alias("merch_lat"), (-120 + (merchant * 104729) % 5000 / 100).alias("merch_lon")]


def scored(txns: DataFrame) -> DataFrame:
    """Transactions with the label y and a score p of a thousand tied levels that leans to it."""
    y = (F.col("txn_id") % CB_EVERY == 0).cast("int")
    level = ((F.col("txn_id") * 7919) % 1000) / 1000.0
    return txns.select("*", y.alias("y"), (level * F.when(y == 1, 1.0).otherwise(0.3)).alias("p"), (F.col("cents") / 100.0).alias("amount"), F.floor(F.col("us") / (24 * HOUR)).alias("day"))
