"""What an analyst's desk does with the streams: verdicts and hypothetical payments enter as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import decisions as D
from tidemark.plans.features import peek
from tidemark.plans.spec import Catalog

KM_PER_DEGREE = 111.2


def resolve(queue: DataFrame, verdicts: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The queue without the cases that have a verdict, and chargebacks reported now for those found to be fraud."""
    left = queue.join(verdicts, "txn_id", "left_anti")
    fraud = queue.join(verdicts.where("is_fraud"), "txn_id", "left_semi")
    return left, fraud.select("txn_id", F.col("us").alias("txn_us"), F.lit(now).alias("reported_us"), "card_id", "merchant_id", "category", "cents")


def placed(home_lat: Column, distance_km: Column) -> Column:
    """Latitude of a merchant so far north of home."""
    return home_lat + distance_km / KM_PER_DEGREE


def what_if(spec: Catalog, txns: DataFrame, chargebacks: DataFrame, asked: DataFrame) -> DataFrame:
    """Features of hypothetical payments, with nothing recorded."""
    return peek(spec, txns, chargebacks, asked)


def record(txns: DataFrame, payment: DataFrame) -> DataFrame:
    """The transaction stream with a hypothetical payment in it."""
    return txns.unionByName(payment.select(*txns.columns))


def decide(scored: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Decisions; a payment that was decided before keeps its first decision."""
    new = D.bayes(scored).select("txn_id", "p", "action")
    if seen is None:
        return new
    return seen.select("txn_id", "p", "action").unionByName(new.join(seen, "txn_id", "left_anti"))
