"""Drift between a reference and a current set of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import cumulative

FLOOR = 1e-4


def quantile_edges(ref: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: the distinct inner quantiles of the reference, in order."""
    q = [i / bins for i in range(1, bins)]
    return ref.where(F.col(column).isNotNull()).agg(F.array_distinct(F.percentile(column, q)).alias("edges"))


def psi(ref: DataFrame, cur: DataFrame, column: str, edges: Sequence[float] | None = None, bins: int = 10) -> DataFrame:
    """psi over bins of the reference's quantiles or of given edges; missing values are a bin of their own."""
    e = ref.sparkSession.createDataFrame([([float(x) for x in edges],)], "edges array<double>") if edges is not None else quantile_edges(ref, column, bins)
    x = F.col(column)
    rows = ref.select(x.alias("x"), F.lit(1).alias("r")).unionByName(cur.select(x.alias("x"), F.lit(0).alias("r")))
    bin_ = F.when(F.col("x").isNull(), -1).otherwise(F.size(F.filter("edges", lambda b: b <= F.col("x"))))
    counts = rows.join(F.broadcast(e)).groupBy(bin_.alias("bin")).agg(F.sum("r").alias("n_ref"), F.sum(1 - F.col("r")).alias("n_cur"))
    total = counts.agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
    a, b = (F.greatest(F.col(f"n_{k}") / F.col(f"t_{k}"), F.lit(FLOOR)) for k in ("ref", "cur"))
    return counts.join(F.broadcast(total)).agg(F.sum((b - a) * F.ln(b / a)).alias("psi"))


def alert_rate_ratio(ref: DataFrame, cur: DataFrame, column: str, at: float = 0.01) -> DataFrame:
    """Share of the current scores from ``at`` upwards over the reference's share; null where that is 0."""
    share = lambda df, n: df.agg(F.avg((F.col(column) >= at).cast("double")).alias(n))
    return share(ref, "a").join(F.broadcast(share(cur, "b"))).select(F.try_divide("b", "a").alias("ratio"))


def ks(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    """Largest gap of the two distribution functions, missing values left out."""
    x = F.col(column)
    rows = ref.select(x.alias("x"), F.lit(1).alias("r")).unionByName(cur.select(x.alias("x"), F.lit(0).alias("r"))).where("x is not null")
    counts = rows.groupBy("x").agg(F.sum("r").alias("n_ref"), F.sum(1 - F.col("r")).alias("n_cur"))
    total = counts.agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
    cum = cumulative(counts, "x", ["n_ref", "n_cur"]).join(F.broadcast(total))
    return cum.agg(F.max(F.abs(F.col("c_n_ref") / F.col("t_ref") - F.col("c_n_cur") / F.col("t_cur"))).alias("ks"))


def feature_drift(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, psi and ks of each column."""
    out = None
    for c in columns:
        row = psi(ref, cur, c).join(F.broadcast(ks(ref, cur, c))).select(F.lit(c).alias("feature"), "psi", "ks")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("psi"), "feature")


def trigger(score_psi: Column, top_psi: Column, ratio: Column) -> Column:
    """Whether a model is due for training again."""
    return (score_psi > 0.1) | (top_psi > 0.25) | F.coalesce((ratio > 1.5) | (ratio < 1 / 1.5), F.lit(True))


def adversarial(ref: DataFrame, cur: DataFrame, columns: list[str], n: int = 200_000, seed: int = 0, key: str = "txn_id") -> tuple[float, dict[str, float]]:
    """Two-fold AUC of telling current rows from reference rows, and the importance of each column for it."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import Imputer, VectorAssembler

    from tidemark.operators.labels import sample_n, uniform

    both = sample_n(ref, n, seed, key).select(key, *(F.col(c).cast("double").alias(c) for c in columns), F.lit(0.0).alias("label")).unionByName(sample_n(cur, n, seed, key).select(key, *(F.col(c).cast("double").alias(c) for c in columns), F.lit(1.0).alias("label")))
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(Imputer(inputCols=columns, outputCols=columns, strategy="median").fit(both).transform(both))
    rows = rows.withColumn("fold", (uniform(seed, key) < 0.5).cast("int"))
    auc, gain = 0.0, dict.fromkeys(columns, 0.0)
    for fold in (0, 1):
        model = GBTClassifier(maxIter=10, maxDepth=3, seed=seed).fit(rows.where(F.col("fold") != fold))
        auc += BinaryClassificationEvaluator().evaluate(model.transform(rows.where(F.col("fold") == fold))) / 2
        for c, g in zip(columns, model.featureImportances.toArray(), strict=True):
            gain[c] += float(g) / 2
    return auc, gain


def threshold_shares(ref: DataFrame, cur: DataFrame, column: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, share of reference and of current scores from it upwards."""
    rows = ref.select(F.col(column).alias("x"), F.lit(1).alias("r")).unionByName(cur.select(F.col(column).alias("x"), F.lit(0).alias("r")))
    each = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    share = lambda r: F.avg(F.when(F.col("r") == r, (F.col("x") >= F.col("threshold")).cast("double")))
    return each.groupBy("threshold").agg(share(1).alias("ref_share"), share(0).alias("cur_share"))


def live_drift(ref: DataFrame, cur: DataFrame, column: str, at: float, least: int = 1000) -> DataFrame:
    """psi of a score and the ratio of its alert rates, null until there are ``least`` current rows."""
    enough = cur.agg((F.count("*") >= least).alias("enough"))
    both = psi(ref, cur, column).join(F.broadcast(alert_rate_ratio(ref, cur, column, at))).join(F.broadcast(enough))
    return both.select(*(F.when(F.col("enough"), F.col(c)).alias(c) for c in ("psi", "ratio")))


def percentiles(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.percentile(column, [0.5, 0.95, 0.99]).alias("q")).select(F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


def parity(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], rtol: float = 1e-9) -> DataFrame:
    """feature, rows, null_mismatch, mismatch and max_diff between two computations of the same features."""
    ca, cb = ([F.col(c).cast("double").alias(f"{p}_{c}") for c in columns] for p in "ab")
    both = a.select(key, *ca).join(b.select(key, *cb), key)
    pairs = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"a_{c}").alias("x"), F.col(f"b_{c}").alias("y")) for c in columns))).alias("f")).select("f.*")
    gap = F.abs(F.col("x") - F.col("y"))
    return pairs.groupBy("feature").agg(F.count("*").alias("rows"), F.count_if(F.col("x").isNull() != F.col("y").isNull()).alias("null_mismatch"), F.count_if(gap > rtol * F.greatest(F.abs("x"), F.abs("y"))).alias("mismatch"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_diff"))
