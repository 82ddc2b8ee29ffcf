"""Studies made of the other operators: search, retraining over time, imbalance, comparison, and what is shipped."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import calibration as C
from tidemark.operators import decisions as D
from tidemark.operators import drift as X
from tidemark.operators import labels as L
from tidemark.operators import metrics as M
from tidemark.operators import models as N
from tidemark.sources.shared import dropped, shared_path, stored

#: Fits on rows of columns and y; gives rows the score p.
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def trees(columns: list[str], **how: object) -> Fit:
    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = N.fit_trees(train, columns, **how)
        return lambda rows: rows.withColumn("p", N.sigmoid(model.scores()))

    return fit


def logistic(columns: list[str], weight: str | None = None) -> Fit:
    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        own = N.Preprocessor.fit(train, columns).columns()
        beta = N.irls(train.withColumns(own), list(own), weight=weight)
        return lambda rows: rows.withColumns(own).withColumn("p", N.sigmoid(N.linear(list(own), beta))).drop(*own)

    return fit


def rules(amount: str, night: str) -> Fit:
    return lambda _: lambda rows: rows.withColumn("p", N.rules(F.col(amount), F.col(night)))


def leaf_ftrl(train: DataFrame, rows: DataFrame, columns: list[str], order: Sequence[str], rounds: int = 4, depth: int = 3, model: N.Trees | None = None) -> DataFrame:
    """txn_id and p of an online model over the leaves of trees that were fitted once, on ``train`` if not before, and stay as they are."""
    model = model or N.fit_trees(train, columns, rounds=rounds, depth=depth)
    width = 2**depth
    own = [f"leaf_{t}_{i}" for t in range(len(model.trees)) for i in range(width)]
    leaves = model.binned(rows).withColumn("leaves", model.leaves())
    hot = leaves.select("txn_id", "y", *order, *((F.get("leaves", F.lit(t)) == i).cast("double").alias(f"leaf_{t}_{i}") for t in range(len(model.trees)) for i in range(width)))
    return N.ftrl(hot.select(*dict.fromkeys(["txn_id", "y", *order, *own])), own, order)


def search(frame: DataFrame, columns: list[str], grid: dict[str, Sequence], folds: Sequence[tuple[int, int, int]], rounds: int = 5) -> DataFrame:
    """Average precision of every choice of the grid over expanding folds, the best first; defaults are tried first."""
    out = []
    for values in itertools.product(*grid.values()):
        choice = dict(zip(grid, values, strict=True))
        scores = []
        for start, a, b in folds:
            score = trees(columns, rounds=rounds, **choice)(frame.where((F.col("us") >= start) & (F.col("us") < a)))
            scores.append(M.average_precision(score(frame.where((F.col("us") >= a) & (F.col("us") < b)))).first()[0] or 0.0)
        out.append((json.dumps(choice), float(np.mean(scores))))
    spark = frame.sparkSession
    return spark.createDataFrame(out, "choice string, average_precision double").orderBy(F.desc("average_precision"), "choice")


def backtest(frame: DataFrame, columns: list[str], periods: Sequence[tuple[int, int]], maturity: int, sliding: int, **how: object) -> DataFrame:
    """period, policy, average_precision and retrained: static, expanding, sliding, drift-triggered and online training, period by period.

    frame has us, y, reported_us and the columns.  A model of a period knows only labels reported by its start.  The
    online one learns weights of the leaves of the first trees, which stay as they are, in order of time.
    """
    fit = trees(columns, **how)
    first = L.matured(frame, periods[0][0], maturity=maturity).withColumn("y", F.col("label"))
    static = fit(first)
    held = {"static": static, "drift": static}
    frozen = N.fit_trees(first, columns, **how)
    deep = int(how.get("depth", 4))
    reference = static(first)
    out = []
    for i, (a, b) in enumerate(periods):
        now = frame.where((F.col("us") >= a) & (F.col("us") < b))
        retrained = {"static": False, "expanding": i > 0, "sliding": i > 0, "drift": False}
        held["expanding"] = fit(L.matured(frame, a, maturity=maturity).withColumn("y", F.col("label"))) if i else static
        held["sliding"] = fit(L.matured(frame, a, sliding, maturity).withColumn("y", F.col("label"))) if i else static
        if i:
            last = held["drift"](frame.where((F.col("us") >= periods[i - 1][0]) & (F.col("us") < a)))
            row = X.psi(reference, last, "p").join(X.alert_rate_ratio(reference, last, "p")).select(X.trigger(F.col("psi"), F.lit(0.0), F.col("ratio")).alias("due")).first()
            if row["due"]:
                held["drift"], retrained["drift"] = held["expanding"], True
                reference = held["drift"](L.matured(frame, a, maturity=maturity))
        for policy in ("static", "expanding", "sliding", "drift"):
            ap = M.average_precision(held[policy](now)).first()[0]
            out.append((i, policy, ap, retrained[policy]))
        known = L.matured(frame, a, maturity=maturity).select("txn_id", "us", F.col("label").cast("double").alias("y"), *columns)
        asked = now.select("txn_id", "us", F.lit(None).cast("double").alias("y"), *columns)
        online = leaf_ftrl(first, known.unionByName(asked), columns, ["us", "txn_id"], depth=deep, model=frozen)
        ap = M.average_precision(online.join(now.select("txn_id", "y"), "txn_id")).first()[0]
        out.append((i, "online leaves", ap, False))
    return frame.sparkSession.createDataFrame(out, "period int, policy string, average_precision double, retrained boolean")


#: Trees of the imbalance study: as many as help on the rows to validate on, of 63 splits over all bins at most.
WHOLE = {"rounds": 3000, "patience": 100, "rate": 0.05, "depth": 6, "bins": 255}


def imbalance_study(train: DataFrame, valid: DataFrame, test: DataFrame, columns: list[str], **how: object) -> DataFrame:
    """strategy, average_precision, log_loss and ece on the test rows, raw and after isotonic calibration.

    Trees are fitted on the training rows (``WHOLE``, unless ``how`` says otherwise); the rows to validate on, as they are,
    stop and calibrate them.
    """
    how = WHOLE | how
    # Every strategy reads all parts several times, with all cores even where they came from few files.
    tasks = 2 * train.sparkSession.sparkContext.defaultParallelism
    train, valid, test = (stored(x.select("txn_id", "y", *columns).repartition(tasks, "txn_id"), "part") for x in (train, valid, test))
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    rate = n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))
    balance = n.get(0, 1) / max(1, n.get(1, 1))
    weighed = lambda w: train.withColumn("w", F.when(F.col("y") == 1, float(w)).otherwise(1.0))
    keep = 0.25
    few = L.undersample(train, keep)
    made = L.smote(train, columns, set(), 0.3).withColumn("y", F.lit(1))
    strategies: dict[str, tuple[DataFrame, dict]] = {
        "none": (train, {}),
        "sqrt weights": (weighed(balance**0.5), {"weight": "w"}),
        "balanced weights": (weighed(balance), {"weight": "w"}),
        "undersample": (few, {}),
        "smote": (stored(train.select("y", *columns).unionByName(made.select("y", *columns)), "made"), {}),
        "focal": (train, {"gradients": N.focal_gradients}),
    }
    out = []

    def judged(name: str, raw: DataFrame, base: DataFrame) -> None:
        fixed = stored(raw.withColumn("p", C.interpolate(F.col("p"), *C.isotonic(base))), "fixed")
        a, b = (M.log_loss(x).join(M.ece(x)).first() for x in (raw, fixed))
        out.append((name, M.average_precision(raw).first()[0], a["log_loss"], a["ece"], b["log_loss"], b["ece"]))
        dropped(fixed)

    for name, (rows, own) in strategies.items():
        score = trees(columns, valid=valid, **how, **own)(rows)
        raw, base = (stored(score(x).select("txn_id", "y", "p"), "scores") for x in (test, valid))
        judged(name, raw, base)
        if name == "undersample":  # the same trees
            judged("undersample, shifted", *(x.withColumn("p", C.prior_shift(F.col("p"), rate / (rate + (1 - rate) * keep), rate)) for x in (raw, base)))
    return train.sparkSession.createDataFrame(out, "strategy string, average_precision double, log_loss double, ece double, log_loss_isotonic double, ece_isotonic double")


def comparison(train: DataFrame, test: DataFrame, models: dict[str, Fit], cluster: str, at: float = 0.01) -> DataFrame:
    """For each model: fit_seconds, ms_per_1k rows scored, average_precision, recall among the best share with its interval,
    how much that is above the first model's on the same resamples of clusters, and the share of them where it isn't.
    """
    out, hits = [], []
    n = max(1, test.count())
    for i, (name, fit) in enumerate(models.items()):
        began = time.time()
        score = fit(train)
        fitted = time.time()
        scored = stored(score(test), "scores")
        done = time.time()
        rows = stored(D.budget(scored, at).select("p", "y", cluster, ((F.col("action") == "review") & (F.col("y") == 1)).cast("int").alias("hit")), "hits")
        band = M.cluster_bootstrap(rows, cluster, {"hits": F.col("hit"), "pos": F.col("y")}, F.try_divide("hits", "pos"), n_boot=50).first()
        hits.append(rows.select(cluster, F.lit(i).alias("of"), "hit", "y"))
        first = F.col("of") == 0
        sums = {"mine": F.when(F.col("of") == i, F.col("hit")).otherwise(0), "other": F.when(first, F.col("hit")).otherwise(0), "pos": F.when(first, F.col("y")).otherwise(0)}
        both = hits[0] if i == 0 else hits[0].unionByName(hits[i])
        gap = M.paired_difference(both, cluster, sums, F.try_divide("other", "pos"), F.try_divide("mine", "pos"), n_boot=50).first()
        out.append((name, fitted - began, (done - fitted) * 1e6 / n, M.average_precision(rows).first()[0], interval_text(band), interval_text(gap), gap["not_above"]))
    return train.sparkSession.createDataFrame(out, "model string, fit_seconds double, ms_per_1k double, average_precision double, recall string, above_first string, not_above double")


def interval_text(row) -> str:  # noqa: ANN001
    """A point with its interval, as reports print it."""
    return "-" if row["point"] is None else f"{row['point']:.4f} ({row['low']:.4f}-{row['high']:.4f})"


def ship(spark: SparkSession, model: N.Trees, boundaries: np.ndarray, values: np.ndarray, **manifest: object) -> DataFrame:
    """One row: the bundle of a model, its calibration and its manifest, written to the shared folder and read again."""

    def tree(n: N.Node) -> dict:
        own = {"value": n.value}
        return own if n.left is None else own | {"feature": n.feature, "edge": n.edge, "missing_left": n.missing_left, "gain": n.gain, "left": tree(n.left), "right": tree(n.right)}

    path = shared_path(spark, "bundle")
    body = {"columns": model.columns, "edges": model.edges, "base": model.base, "trees": [tree(t) for t in model.trees], "calibration": [boundaries.tolist(), values.tolist()], "manifest": manifest}
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "bundle string").write.parquet(path)
    return spark.read.parquet(path)


def unpack(bundle: str) -> tuple[N.Trees, np.ndarray, np.ndarray, dict]:
    body = json.loads(bundle)

    def node(d: dict) -> N.Node:
        return N.Node(d["value"]) if "left" not in d else N.Node(d["value"], d["feature"], d["edge"], d["missing_left"], node(d["left"]), node(d["right"]), d["gain"])

    return N.Trees(body["columns"], body["edges"], body["base"], [node(t) for t in body["trees"]]), np.array(body["calibration"][0]), np.array(body["calibration"][1]), body["manifest"]
