"""Costs, policies and their reports, over columns p, amount, y, day and txn_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import cumulative
from tidemark.sources.shared import stored

ACTIONS = ("approve", "review", "decline")


@dataclass(frozen=True)
class Costs:
    review: float = 3.0
    friction: float = 1.0
    catch: float = 0.95
    decline: float = 10.0
    decline_share: float = 0.02

    def of(self, p: Column, amount: Column) -> dict[str, Column]:
        """Expected cost of each action."""
        return {
            "approve": p * amount,
            "review": self.review + (1 - p) * self.friction + p * (1 - self.catch) * amount,
            "decline": (1 - p) * (self.decline + self.decline_share * amount),
        }

    def realized(self, action: Column, y: Column, amount: Column) -> Column:
        """Cost of the action taken, once the truth is known."""
        c = self.of(y.cast("double"), amount)
        return F.when(action == "approve", c["approve"]).when(action == "review", c["review"]).otherwise(c["decline"])


COSTS = Costs()


def with_costs(df: DataFrame, costs: Costs = COSTS) -> DataFrame:
    return df.withColumns({f"cost_{k}": v for k, v in costs.of(F.col("p"), F.col("amount")).items()})


def cheapest() -> Column:
    """The action of least cost; equal ones in the order approve, review, decline."""
    a, r, d = (F.col(f"cost_{k}") for k in ACTIONS)
    return F.when((a <= r) & (a <= d), "approve").when(r <= d, "review").otherwise("decline")


def bayes(df: DataFrame, costs: Costs = COSTS) -> DataFrame:
    return with_costs(df, costs).withColumn("action", cheapest())


def _saving() -> Column:
    return F.least("cost_approve", "cost_decline") - F.col("cost_review")


def _else() -> Column:
    return F.when(F.col("cost_approve") <= F.col("cost_decline"), "approve").otherwise("decline")


def capacity(df: DataFrame, per_day: int, costs: Costs = COSTS) -> DataFrame:
    """The reviews that save most each day, at most ``per_day``; equal savings by txn_id; the rest approved or declined."""
    best = bayes(df, costs).withColumn("saving", F.round(_saving(), 9))
    wants = best.where("action = 'review'").select("txn_id", "day", "saving")
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("saving"), "txn_id"))
    kept = wants.withColumn("rank", rank).where(F.col("rank") <= per_day).select("txn_id", F.lit(True).alias("kept"))
    out = best.join(kept, "txn_id", "left")
    return out.withColumn("action", F.when(F.col("action") != "review", F.col("action")).when(F.col("kept"), "review").otherwise(_else())).drop("kept")


def threshold(df: DataFrame, t: float) -> DataFrame:
    return df.withColumn("action", F.when(F.col("p") >= t, "decline").otherwise("approve"))


def top_rows(df: DataFrame, n: int, score: str = "p", key: str = "txn_id") -> DataFrame:
    """The n rows of highest score, equal scores by key: one bounded list per task, then one of them all."""
    return df.orderBy(F.desc(score), key).limit(n)


def budget(df: DataFrame, rate: float) -> DataFrame:
    """The ceil(rate * n) highest scores are reviewed, one at least; equal scores by txn_id; rows without a score are approved.

    The score at the edge comes from counts per score, and places among its ties from ranges of ids, so that no task
    sorts the whole.
    """
    levels = stored(df.where(F.col("p").isNotNull()).groupBy("p").agg(F.count("*").alias("n")), "levels")
    n = levels.agg(F.sum("n")).first()[0]
    if not n:
        return df.withColumn("action", F.lit("approve"))
    k = max(1, -(-int(round(rate * n * 1e9)) // 10**9))
    edge, above = edge_score(levels, k)
    ties = df.where(F.col("p") == edge).select("txn_id", F.lit(1).alias("n"))
    picked = cumulative(ties, "txn_id", ["n"]).where(F.col("c_n") + above <= k).select("txn_id", F.lit(True).alias("tie"))
    out = df.join(picked, "txn_id", "left")
    return out.withColumn("action", F.when((F.col("p") > edge) | F.coalesce("tie", F.lit(False)), "review").otherwise("approve")).drop("tie")


def edge_score(levels: DataFrame, k: int) -> tuple[float, int]:
    """The k-th highest score, and how many rows lie above it, of p and n per distinct score."""
    above = cumulative(levels, "p", ["n"], descending=True, strict=True)
    row = above.where((F.col("c_n") < k) & (F.col("c_n") + F.col("n") >= k)).first()
    return row["p"], row["c_n"]


def conformal_quantile(df: DataFrame, score: Column, alpha: float) -> DataFrame:
    """q: the ceil((n + 1)(1 - alpha))-th smallest score; null, for no bound, where there are too few."""
    levels = stored(df.select(score.alias("s")).where("s is not null").groupBy("s").agg(F.count("*").alias("n")), "levels")
    n = levels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    k = -(-int(round((n + 1) * (1 - alpha) * 1e9)) // 10**9)
    return cumulative(levels, "s", ["n"]).where(F.col("c_n") >= k).agg(F.min("s").alias("q"))


def conformal(df: DataFrame, alpha_fraud: float = 0.05, alpha_legit: float = 0.002) -> DataFrame:
    """Approve where only legit conforms, decline where only fraud does, else review."""
    qf = conformal_quantile(df.where("y = 1"), 1 - F.col("p"), alpha_fraud).withColumnRenamed("q", "q_fraud")
    ql = conformal_quantile(df.where("y = 0"), F.col("p"), alpha_legit).withColumnRenamed("q", "q_legit")
    both = df.join(F.broadcast(qf)).join(F.broadcast(ql))
    fraud = F.col("q_fraud").isNull() | (1 - F.col("p") <= F.col("q_fraud"))
    legit = F.col("q_legit").isNull() | (F.col("p") <= F.col("q_legit"))
    return both.withColumn("action", F.when(legit & ~fraud, "approve").when(fraud & ~legit, "decline").otherwise("review"))


def policy_table(df: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """One row of totals over actions taken."""
    cost = costs.realized(F.col("action"), F.col("y"), F.col("amount"))
    cents = F.rint(F.col("amount") * 100).cast("bigint")
    day = df.where("action = 'review'").groupBy("day").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_reviews_day"))
    is_ = lambda a, y=None: F.count_if((F.col("action") == a) & ((F.col("y") == y) if y is not None else F.lit(True)))
    total = df.agg(
        F.round(F.sum(F.round(cost, 6).cast("decimal(20,6)")).cast("double"), 4).alias("total_cost"),
        (F.sum(F.when((F.col("action") == "approve") & (F.col("y") == 1), cents).otherwise(0)) / 100.0).alias("fraud_approved_amount"),
        is_("review").alias("reviews"), is_("decline").alias("declines"), is_("decline", 0).alias("false_declines"), is_("approve", 1).alias("frauds_approved"),
    )
    return total.join(F.broadcast(day))


def segment_audit(df: DataFrame) -> DataFrame:
    """Rates per gender and per age band; a row counts in every segment it belongs to."""
    age = F.when(F.col("age_years") < 30, "age <30").when(F.col("age_years") < 50, "age 30-49").when(F.col("age_years") < 65, "age 50-64").otherwise("age 65+")
    rows = df.withColumn("segment", F.explode(F.array(F.concat(F.lit("gender "), F.col("gender")), age)))
    return rows.groupBy("segment").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("y").cast("double")), 6).alias("fraud_rate"),
        F.round(F.count_if((F.col("y") == 0) & (F.col("action") != "approve")) / F.nullif(F.count_if(F.col("y") == 0), F.lit(0)), 6).alias("friction"),
        F.count_if(F.col("action") == "decline").alias("declines"),
        F.round(F.count_if((F.col("y") == 1) & (F.col("action") != "approve")) / F.nullif(F.count_if(F.col("y") == 1), F.lit(0)), 6).alias("capture"),
    )


def outcome() -> Column:
    """What became of a decision."""
    y, a = F.col("y") == 1, F.col("action")
    return F.when(a == "approve", F.when(y, "missed").otherwise("ok")).when(a == "review", F.when(y, "caught in review").otherwise("reviewed ok")).otherwise(F.when(y, "stopped").otherwise("false decline"))


def daily_rollup(df: DataFrame) -> DataFrame:
    cents = F.rint(F.col("amount") * 100).cast("bigint")
    return df.groupBy("day").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("frauds"), F.count_if(F.col("action") == "review").alias("reviews"), F.count_if(F.col("action") == "decline").alias("declines"), (F.sum(F.when(F.col("y") == 1, cents).otherwise(0)) / 100.0).alias("fraud_amount"))


def latest_per_key(df: DataFrame, key: str, n: int = 12) -> DataFrame:
    """The last n rows of each key, newest first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("us"), F.desc("txn_id")))
    return df.withColumn("recency", rank).where(F.col("recency") <= n)


def best_f1(df: DataFrame, points: int = 400, low: float = 0.95, high: float = 0.99999) -> DataFrame:
    """threshold and f1: the best of the scores' quantiles between low and high, the lowest of equal ones.

    Every row is counted once, under the highest quantile it reaches; what follows is as long as the quantiles.
    """
    q = [low + (high - low) * i / (points - 1) for i in range(points)]
    grid = df.agg(F.array_sort(F.array_distinct(F.percentile("p", q))).alias("grid"))
    counts = df.join(F.broadcast(grid)).groupBy(F.size(F.filter("grid", lambda e: e <= F.col("p"))).alias("i")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    total = counts.agg(F.sum("pos").alias("total"))
    steps = grid.select(F.posexplode("grid").alias("at", "threshold"))
    reach = steps.join(counts, F.col("i") > F.col("at")).groupBy("at", "threshold").agg(F.sum("n").alias("taken"), F.sum("pos").alias("hits"))
    f1 = 2 * F.col("hits") / (F.col("taken") + F.col("total"))
    best = reach.join(F.broadcast(total)).select("threshold", f1.alias("f1"))
    return best.orderBy(F.desc(F.round("f1", 12)), "threshold").limit(1)
