"""Running sums over an order that no single task has to hold.

Values fall into at most ``PARTS`` ranges between approximate quantiles.  A running sum is that of whole ranges,
as short as the ranges are few, and that within a range, which is one task's share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

PARTS, STEP = 256, 16


def place(x: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending edges are not above x, which is compared with few of them: every STEP-th, then those between two."""
    edges = list(map(float, edges))
    array = lambda of: F.array(*map(F.lit, of)) if of else F.array().cast("array<double>")
    count = lambda of: F.size(F.filter(of, lambda e: e <= x))
    if len(edges) <= 2 * STEP:
        return count(array(edges))
    coarse = count(array(edges[STEP - 1 :: STEP])) * STEP
    # The array holds the places from which the count goes on: one, so that it is found once.
    return F.get(F.transform(F.array(coarse), lambda at: at + count(F.slice(array(edges), at + 1, STEP - 1))), F.lit(0))


def ranged(df: DataFrame, by: str, name: str, parts: int = PARTS) -> DataFrame:
    """``df`` with the number of the range that ``by`` falls into."""
    edges = df.agg(F.percentile_approx(F.col(by).cast("double"), [i / parts for i in range(1, parts)], 20 * parts).alias("__edges"))
    # Every STEP-th edge first, then those up to the next one: a row is compared with few of them.
    count = lambda edges: F.size(F.filter(edges, lambda e: e < F.col(by)))
    coarse = F.expr(f"filter(__edges, (e, i) -> i % {STEP} = {STEP - 1})")
    where = (count("__coarse") * STEP).alias("__from")
    rows = df.join(F.broadcast(edges.withColumn("__coarse", coarse))).select("*", where)
    return rows.withColumn(name, F.col("__from") + count(F.slice("__edges", F.col("__from") + 1, STEP - 1))).drop("__edges", "__coarse", "__from")


def cumulative(df: DataFrame, by: str, sums: Sequence[str], descending: bool = False, strict: bool = False, prefix: str = "c_") -> DataFrame:
    """``df``, whose values of ``by`` are distinct, with sums over all rows up to each (before each, if strict)."""
    # Ranges, totals and rows are three readings of the same rows, which may be dear to compute.
    df = stored(df, "ordered")
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    parts = ranged(df, by, "__range")
    within = Window.partitionBy("__range").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    across = Window.orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__range").agg(*(F.sum(s).alias(s) for s in sums))
    before = totals.select("__range", *(F.sum(s).over(across).alias(f"__before_{s}") for s in sums))
    own = parts.select("*", *(F.sum(s).over(within).alias(f"__within_{s}") for s in sums)).join(F.broadcast(before), "__range")
    added = {f"{prefix}{s}": F.coalesce(f"__before_{s}", F.lit(0)) + F.coalesce(f"__within_{s}", F.lit(0)) for s in sums}
    return own.withColumns(added).select(*df.columns, *added)
