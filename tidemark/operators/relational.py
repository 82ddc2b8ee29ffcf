"""Relational operators over the canonical tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def time_window(df: DataFrame, start: int, end: int, column: str = "us") -> DataFrame:
    """Rows with start <= column < end."""
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def first_non_null(df: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: of every column the first value that isn't null, in the given order."""
    at = F.struct(*order)
    return df.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns))


def max_distinct(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The largest number of distinct values of each column within a key; 1 throughout for a consistent dimension."""
    per_key = df.groupBy(key).agg(*(F.count_distinct(c).alias(c) for c in columns))
    return per_key.agg(*(F.max(c).cast("bigint").alias(f"max_{c}") for c in columns))


def surrogate_keys(df: DataFrame, name: str, key: str, prefix: str = "fraud_") -> DataFrame:
    """Distinct names without the prefix, numbered from 1 in order.

    Numbers come from ranges of names: each range is counted, and the counts before it are added, so that no task
    sees all names.
    """
    names = df.select(F.regexp_replace(name, f"^{prefix}", "").alias(name)).where(F.col(name).isNotNull()).distinct()
    parts = names.withColumn("part", F.substring(name, 1, 2))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(name))
    return parts.withColumn("own", own).join(before, "part").select(name, (F.col("own") + F.col("before")).cast("bigint").alias(key))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty where joins on them are many to one."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, once it is sure that no key occurs twice; raises ValueError with one that does."""
    if twice := check_unique(df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)), keys).first():
        raise ValueError(f"{', '.join(keys)} should be unique: {twice}")
    return df


def lookup(df: DataFrame, dim: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Many-to-one join with a dimension, whose keys must be unique; Spark broadcasts it while its size is below the session's threshold."""
    return df.join(unique(dim, on), on, how)


def chargebacks_with_transactions(chargebacks: DataFrame, txns: DataFrame) -> DataFrame:
    """Chargebacks joined one to one with their transactions by (txn_id, time)."""
    unique(chargebacks, "txn_id", "txn_us")
    own = unique(txns, "txn_id", "us").select("txn_id", F.col("us").alias("txn_us"), *(c for c in txns.columns if c not in ("txn_id", "us")))
    return chargebacks.select("txn_id", "txn_us", "reported_us").join(own, ["txn_id", "txn_us"])


def unmatched(chargebacks: DataFrame, txns: DataFrame) -> DataFrame:
    """Chargebacks without a transaction."""
    return chargebacks.join(txns.select("txn_id", F.col("us").alias("txn_us")), ["txn_id", "txn_us"], "left_anti")


def merged_streams(txns: DataFrame, chargebacks: DataFrame) -> DataFrame:
    """Both streams with the order in which to replay them: by time, transactions first, then by id."""
    a = txns.select("us", F.lit(0).alias("kind"), "txn_id")
    return a.unionByName(chargebacks.select(F.col("reported_us").alias("us"), F.lit(1).alias("kind"), "txn_id")).orderBy("us", "kind", "txn_id")


def canonical_id(column: Column) -> Column:
    """An id as 32 lower-case hex digits, however it was written."""
    return F.lower(F.replace(column, F.lit("-"), F.lit("")))


def pivot(df: DataFrame, index: str, columns: str, values: str, names: Sequence[str]) -> DataFrame:
    return df.groupBy(index).pivot(columns, list(names)).agg(F.first(values))


def month_starts(spark: SparkSession, start: str, end: str) -> DataFrame:
    """First days of the months from start to before end."""
    return spark.sql(f"select explode(sequence(date'{start}', date'{end}' - interval 1 day, interval 1 month)) as month")


def next_version(registry: DataFrame) -> DataFrame:
    """The registry with its newest candidate in production and what was there archived."""
    newest = registry.where("stage = 'candidate'").select(F.max(F.struct("created_at", "version")).alias("m")).select("m.version")
    to = newest.withColumnRenamed("version", "__to")
    promoted = registry.join(to, registry["version"] == to["__to"], "left")
    some = registry.where("stage = 'candidate'").agg((F.count("*") > 0).alias("__some"))
    stage = F.when(F.col("__to").isNotNull(), "production").when((F.col("stage") == "production") & F.col("__some"), "archived").otherwise(F.col("stage"))
    return promoted.join(F.broadcast(some)).withColumn("stage", stage).drop("__to", "__some")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
