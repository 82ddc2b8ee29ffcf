"""Labels as of a date, splits by time, and sampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.neighbours import near_points
from tidemark.operators.ordered import cumulative
from tidemark.plans.spec import HOUR
from tidemark.sources.shared import stored

DAY = 24 * HOUR
MATURITY = 60 * DAY


def observed(reported_us: Column, as_of: int) -> Column:
    """1 where a chargeback had been reported by then, that moment included."""
    return F.when(reported_us <= as_of, 1).otherwise(0)


def split(frame: DataFrame, start: int, train_end: int, deploy: int, end: int, maturity: int = MATURITY) -> DataFrame:
    """Rows with their part: train and valid with labels as of deployment, test with the truth; what is not mature yet is left out."""
    us = F.col("us")
    part = F.when((us >= start) & (us < train_end), "train").when((us >= train_end) & (us < deploy - maturity), "valid").when((us >= deploy) & (us < end), "test")
    label = F.when(us >= deploy, F.col("y")).otherwise(observed(F.col("reported_us"), deploy))
    return frame.withColumns({"part": part, "label": label}).where("part is not null")


def rolling_folds(start: int, end: int, folds: int = 3, first: float = 0.4) -> list[tuple[int, int, int]]:
    """(start, end of training, end of validation) of expanding folds."""
    edges = np.linspace(start + first * (end - start), end, folds + 1).astype("int64").tolist()
    return [(start, a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def matured(frame: DataFrame, now: int, sliding: int | None = None, maturity: int = MATURITY) -> DataFrame:
    """Rows old enough to be labelled now, all or those of the last ``sliding`` microseconds."""
    out = frame.where(F.col("us") < now - maturity).withColumn("label", observed(F.col("reported_us"), now))
    return out.where(F.col("us") >= now - sliding) if sliding else out


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone, not on the order of rows."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def simulated_delays(frauds: DataFrame, seed: int = 7, median: float = 12.0, sigma: float = 0.7, floor: float = 1.0) -> DataFrame:
    """reported_us of each fraud: log-normal days after it, at least ``floor``, in whole seconds; the same whatever the order of rows."""
    normal = F.sqrt(-2 * F.ln(1 - uniform(seed, "txn_id"))) * F.cos(2 * math.pi * uniform(seed + 1, "txn_id"))
    seconds = F.rint(F.greatest(median * F.exp(sigma * normal), F.lit(floor)) * 86400).cast("bigint")
    return frauds.withColumn("reported_us", F.col("us") + seconds * 1_000_000)


def undersample(df: DataFrame, keep: float, seed: int = 0, label: str = "y", key: str = "txn_id") -> DataFrame:
    """All positives, and negatives with chance ``keep``."""
    return df.where((F.col(label) == 1) | (uniform(seed, key) < keep))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """At most n rows, those with the smallest hashes."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def smote(df: DataFrame, columns: list[str], discrete: set[str], ratio: float, k: int = 5, seed: int = 0, label: str = "y", key: str = "txn_id", block: int = 2048) -> DataFrame:
    """New positives between a positive and one of its k nearest among all positives, until there are ``ratio`` for each negative.

    Every positive is a base equally often, by hash where they don't come out even.  Distances are between z-scores
    with medians for missing values; a missing value of the base stays missing, a discrete column takes the nearer
    parent's.  Equally near positives rank by key.  Positives are compared in cells of about ``block`` (``neighbours``).
    """
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    new = max(0, int(ratio * n.get(0, 0)) - n.get(1, 0))
    pos = df.where(F.col(label) == 1).select(F.col(key).alias("__key"), *(F.col(c).cast("double").alias(c) for c in columns))
    if not new or n.get(1, 0) < 2:
        return pos.limit(0).drop("__key")
    # Statistics, ranks and neighbours are readings of the same rows, which may be dear to compute.
    pos = stored(pos, "positives")
    stats = pos.agg(*(F.struct(F.median(c).alias("m"), F.avg(c).alias("a"), F.stddev_pop(c).alias("s")).alias(c) for c in columns)).first()
    z = [(F.coalesce(F.col(c), F.lit(stats[c]["m"])) - stats[c]["a"]) / stats[c]["s"] if stats[c]["s"] else F.lit(0.0) for c in columns]
    pos = pos.select("__key", F.array(*columns).alias("raw"), F.array(*z).alias("z"), F.xxhash64("__key", F.lit(seed)).alias("draw"), F.lit(1).alias("one"))
    ranked = stored(cumulative(pos, "draw", ["one"], strict=True, prefix="before_"), "ranked")
    bases = ranked.withColumn("copies", F.lit(new // n[1]) + (F.col("before_one") < new % n[1]).cast("int")).where("copies > 0")
    near = F.slice(F.filter("near", lambda mate: mate != F.col("__key")), 1, k).alias("near")
    picks = bases.join(near_points(ranked, k, block), "z").select("__key", "raw", near, "copies")
    picks = picks.select("__key", "raw", "near", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    chance = lambda of: F.pmod(F.xxhash64("__key", "copy", F.lit(seed), F.lit(of)), F.lit(1 << 52)) / float(1 << 52)
    picks = picks.select("raw", F.get("near", F.floor(chance("mate") * F.size("near")).cast("int")).alias("mate"), chance("gap").alias("gap"))
    both = picks.join(ranked.select(F.col("__key").alias("mate"), F.col("raw").alias("other")), "mate")
    out = []
    for i, c in enumerate(columns):
        a, b = F.col("raw")[i], F.coalesce(F.col("other")[i], F.col("raw")[i])
        out.append((F.when(F.col("gap") >= 0.5, b).otherwise(a) if c in discrete else a + F.col("gap") * (b - a)).alias(c))
    return both.select(*out)
