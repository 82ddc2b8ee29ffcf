"""Ranking and calibration metrics over label and score columns.

All of them start from counts per distinct score, which combine before the shuffle; running sums over the scores
are taken in ranges (``ordered``), so that no task holds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import cumulative, ranged
from tidemark.sources.shared import stored


def levels(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """p, n and pos: rows and positives of each distinct score."""
    return df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))


def average_ranks(df: DataFrame, key: str = "txn_id", p: str = "p") -> DataFrame:
    """key and rank from 1, equal scores sharing the mean of their places."""
    lv = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"))
    ranks = cumulative(lv, "p", ["n"]).select("p", (F.col("c_n") - (F.col("n") - 1) / 2.0).alias("rank"))
    return df.select(key, F.col(p).alias("p")).join(ranks, "p").select(key, "rank")


def roc_auc(df: DataFrame) -> DataFrame:
    """roc_auc by ranks; null with one class only."""
    lv = cumulative(levels(df).withColumn("neg", F.col("n") - F.col("pos")), "p", ["neg"], strict=True)
    won = F.sum(F.col("pos") * (2 * F.col("c_neg") + F.col("neg")))
    both = F.sum("pos") * F.sum("neg")
    return lv.agg((won / (2 * F.nullif(both, F.lit(0)))).alias("roc_auc"))


def pr_points(df: DataFrame) -> DataFrame:
    """p, precision and recall at each distinct score, taking all rows from it upwards."""
    lv = levels(df)
    total = lv.agg(F.sum("pos").alias("total"))
    cum = cumulative(lv, "p", ["n", "pos"], descending=True).select("p", F.col("c_n").alias("taken"), F.col("c_pos").alias("hits"))
    return cum.join(F.broadcast(total)).select("p", (F.col("hits") / F.col("taken")).alias("precision"), (F.col("hits") / F.nullif("total", F.lit(0))).alias("recall"))


def average_precision(df: DataFrame) -> DataFrame:
    cum = cumulative(levels(df), "p", ["n", "pos"], descending=True)
    return cum.agg((F.sum(F.col("pos") * F.col("c_pos") / F.col("c_n")) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def precision_at_recall(df: DataFrame, target: float) -> DataFrame:
    return pr_points(df).agg(F.coalesce(F.max(F.when(F.col("recall") >= target, F.col("precision"))), F.lit(0.0)).alias("precision"))


def top_share(df: DataFrame, rate: float) -> DataFrame:
    """The ceil(rate * n) highest scores, one at least; equal scores by txn_id."""
    from tidemark.operators.decisions import budget

    return budget(df, rate).where("action = 'review'").drop("action")


def at_rate(df: DataFrame, rate: float) -> DataFrame:
    """Recall, recall of amounts and precision among the highest scores."""
    cents = F.rint(F.col("amount") * 100).cast("bigint")
    total = df.agg(F.sum("y").alias("all_pos"), F.sum(F.when(F.col("y") == 1, cents)).alias("all_cents"))
    top = top_share(df, rate).agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum(F.when(F.col("y") == 1, cents).otherwise(0)).alias("cents"))
    return top.join(F.broadcast(total)).select((F.col("pos") / F.nullif("all_pos", F.lit(0))).alias("recall"), (F.col("cents") / F.nullif("all_cents", F.lit(0))).alias("dollar_recall"), (F.col("pos") / F.col("n")).alias("precision"))


def brier(df: DataFrame) -> DataFrame:
    return levels(df).agg((F.sum(F.col("pos") * F.pow(1 - F.col("p"), 2) + (F.col("n") - F.col("pos")) * F.pow("p", 2)) / F.sum("n")).alias("brier"))


def log_loss(df: DataFrame, floor: float = 1e-15) -> DataFrame:
    q = F.greatest(F.least(F.col("p"), F.lit(1 - floor)), F.lit(floor))
    return levels(df).agg((-F.sum(F.col("pos") * F.ln(q) + (F.col("n") - F.col("pos")) * F.ln(1 - q)) / F.sum("n")).alias("log_loss"))


def calibration_bins(df: DataFrame, bins: int = 15, key: str = "txn_id") -> DataFrame:
    """bin, n, mean_p and rate of bins of equal mass, larger ones first; equal scores in the order of the key.

    Scores whose rows are all in one bin are added up as they are.  The others, fewer than the bins, are split by ranges
    of keys; only the ranges that two bins share, fewer than the bins again, are put in order row by row.
    """
    sums = [F.count("*").alias("n"), F.count("y").alias("known"), F.sum(F.col("y").cast("double")).alias("pos")]
    total = df.agg(F.count("*").alias("total"))

    def binned(at: Column) -> Column:
        small, extra = F.floor(F.col("total") / bins), F.col("total") % bins
        return F.when(at < extra * (small + 1), F.floor(at / (small + 1))).otherwise(extra + F.floor((at - extra * (small + 1)) / F.greatest(small, F.lit(1)))).cast("int")

    def shared(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Cells by place in one bin each, and those that reach over several."""
        cells = cells.join(F.broadcast(total)).withColumns({"bin": binned(F.col("before")), "last": binned(F.col("before") + F.col("n") - 1)})
        return cells.where("bin = last").select("bin", "p", "n", "known", "pos"), cells.where("bin < last")

    scores = cumulative(df.groupBy("p").agg(*sums), "p", ["n"], strict=True).withColumnRenamed("c_n", "before")
    whole, several = shared(stored(scores.where("p IS NOT NULL"), "scores"))
    rows = df.select("p", "y", key).join(F.broadcast(several.select("p", F.col("before").alias("lower"))), "p")
    rows = stored(ranged(rows, key, "keys"), "ranged")
    over = Window.partitionBy("p").orderBy("keys").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(rows.groupBy("p", "lower", "keys").agg(*sums).withColumn("before", F.col("lower") + F.coalesce(F.sum("n").over(over), F.lit(0))), "cells")
    most, split = shared(cells)
    place = F.row_number().over(Window.partitionBy("p", "keys").orderBy(key)) - 1
    single = rows.join(F.broadcast(split.select("p", "keys", "before", "total")), ["p", "keys"]).withColumn("bin", binned(F.col("before") + place))
    rest = single.groupBy("bin", "p").agg(*sums)
    out = whole.unionByName(most).unionByName(rest).groupBy("bin")
    return out.agg(F.sum("n").alias("n"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_p"), F.try_divide(F.sum("pos"), F.sum("known")).alias("rate"))


def ece(df: DataFrame, bins: int = 15) -> DataFrame:
    return calibration_bins(df, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def summary(df: DataFrame, rate: float = 0.01) -> DataFrame:
    """All of the above in one row."""
    parts = [roc_auc(df), average_precision(df), brier(df), log_loss(df), ece(df), at_rate(df, rate)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))
    return out


def cluster_bootstrap(df: DataFrame, cluster: str, sums: dict[str, Column], metric: Column, n_boot: int = 200, seed: int = 0, alpha: float = 0.05, none_above: str | None = None) -> DataFrame:
    """point, low and high of a metric of sums, with clusters drawn again with replacement; ``none_above`` names a column for the share of replicates of zero or less.

    Each cluster is first reduced to its sums; a replicate weighs it by a Poisson count from a hash, which is how
    draws with replacement fall when there are many clusters.
    """
    per = df.groupBy(cluster).agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    u = F.pmod(F.xxhash64(cluster, "replicate", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    weight, p, upto = F.lit(0), 0.36787944117144233, 0.0
    for k in range(1, 9):
        upto += p
        weight = weight + (u >= upto).cast("int")
        p /= k
    drawn = per.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("w", weight).where("w > 0")
    each = drawn.groupBy("replicate").agg(*(F.sum(F.col(k) * F.col("w")).alias(k) for k in sums)).select(metric.alias("m"))
    share = [F.avg((F.col("m") <= 0).cast("double")).alias(none_above)] if none_above else []
    band = each.agg(F.percentile("m", [alpha / 2, 1 - alpha / 2]).alias("b"), *share).select(F.col("b")[0].alias("low"), F.col("b")[1].alias("high"), *([none_above] if none_above else []))
    return per.agg(*(F.sum(k).alias(k) for k in sums)).select(metric.alias("point")).join(F.broadcast(band))


def paired_difference(df: DataFrame, cluster: str, sums: dict[str, Column], a: Column, b: Column, **how: float) -> DataFrame:
    """point, low and high of b - a on the same replicates, and ``not_above``, the share of them in which b isn't above a."""
    return cluster_bootstrap(df, cluster, sums, b - a, none_above="not_above", **how)
