"""Probability calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import place


def isotonic(df: DataFrame, label: str = "y", p: str = "p") -> tuple[np.ndarray, np.ndarray]:
    """Boundaries and values of the isotonic fit; equal scores count together with their weight."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    lv = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.avg(F.col(label).cast("double")).alias("rate"), F.count("*").cast("double").alias("w"))
    rows = VectorAssembler(inputCols=["p"], outputCol="x").transform(lv)
    fit = IsotonicRegression(featuresCol="x", labelCol="rate", weightCol="w").fit(rows)
    return fit.boundaries.toArray(), fit.predictions.toArray()


def interpolate(x: Column, boundaries: np.ndarray, values: np.ndarray) -> Column:
    """Piecewise linear function with constant ends, as an expression."""
    b, v = F.array(*map(F.lit, map(float, boundaries))), F.array(*map(F.lit, map(float, values)))
    n = len(boundaries)
    i = place(x, boundaries)
    lo_b, hi_b, lo_v, hi_v = F.get(b, i - 1), F.get(b, F.least(i, F.lit(n - 1))), F.get(v, i - 1), F.get(v, F.least(i, F.lit(n - 1)))
    inner = F.when(hi_b > lo_b, lo_v + (x - lo_b) / (hi_b - lo_b) * (hi_v - lo_v)).otherwise(lo_v)
    return F.when(i == 0, float(values[0])).when(i >= n, float(values[-1])).otherwise(inner)


def logit(p: Column, floor: float = 1e-12) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - floor)), F.lit(floor))
    return F.ln(q / (1 - q))


def platt(df: DataFrame, l2: float = 1e-6, steps: int = 30) -> tuple[float, float]:
    """Slope and intercept of a logistic fit on the logit of p, by Newton steps over counts per score."""
    from tidemark.operators.models import irls

    lv = df.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    rows = lv.select(logit(F.col("p"), 1e-6).alias("x"), F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("pos").alias("w")), F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("pos")).alias("w")))).alias("c")).select("x", "c.y", F.col("c.w").cast("double").alias("w")).where("w > 0")
    beta = irls(rows, ["x"], "y", "w", l2, steps)
    return float(beta[0]), float(beta[1])


def prior_shift(p: Column, trained: float, actual: float) -> Column:
    """p moved from the positive rate that it was trained on to the actual one."""
    shift = float(np.log(actual / (1 - actual)) - np.log(trained / (1 - trained)))
    return 1 / (1 + F.exp(-(logit(p) + shift)))
