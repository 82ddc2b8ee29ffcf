"""Approximate membership and frequency, and exact answers to hold them against."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashes(key: Column, depth: int, width: int) -> list[Column]:
    """``depth`` cells by double hashing."""
    a, b = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2)).bitwiseOR(F.lit(1))
    return [F.pmod(F.pmod(a, F.lit(width)) + i * F.pmod(b, F.lit(width)), F.lit(width)) for i in range(depth)]


def count_min_size(eps: float, delta: float) -> tuple[int, int]:
    return math.ceil(math.e / eps), math.ceil(math.log(1 / delta))


def count_min(df: DataFrame, key: Column, eps: float, delta: float) -> DataFrame:
    """row, cell and n of a count-min sketch; sketches of parts add up."""
    width, depth = count_min_size(eps, delta)
    cells = F.array(*(F.struct(F.lit(i).alias("row"), h.alias("cell")) for i, h in enumerate(hashes(key, depth, width))))
    return df.select(F.explode(cells).alias("c")).groupBy("c.row", "c.cell").agg(F.count("*").alias("n"))


def count_min_estimates(df: DataFrame, key: str, eps: float, delta: float) -> DataFrame:
    """key, exact count and the sketch's estimate, never lower."""
    width, depth = count_min_size(eps, delta)
    sketch = count_min(df, F.col(key), eps, delta)
    exact = df.groupBy(key).agg(F.count("*").alias("exact"))
    cells = F.array(*(F.struct(F.lit(i).alias("row"), h.alias("cell")) for i, h in enumerate(hashes(F.col(key), depth, width))))
    return exact.select("*", F.explode(cells).alias("c")).select(key, "exact", "c.row", "c.cell").join(sketch, ["row", "cell"]).groupBy(key).agg(F.max("exact").alias("exact"), F.min("n").alias("estimate"))


def bloom_size(n: int, p: float) -> tuple[int, int]:
    bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return bits, max(1, round(bits / n * math.log(2)))


def bloom(df: DataFrame, key: Column, n: int, p: float) -> DataFrame:
    """The positions that are set."""
    bits, k = bloom_size(n, p)
    return df.select(F.explode(F.array(*hashes(key, k, bits))).alias("bit")).distinct()


def bloom_contains(df: DataFrame, key: str, filter_: DataFrame, n: int, p: float) -> DataFrame:
    """key and whether the filter may hold it."""
    bits, k = bloom_size(n, p)
    asked = df.select(key).distinct().select(key, F.explode(F.array(*hashes(F.col(key), k, bits))).alias("bit"))
    return asked.join(filter_.withColumn("hit", F.lit(1)), "bit", "left").groupBy(key).agg((F.count_if(F.col("hit").isNull()) == 0).alias("contains"))


def first_time(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``is_new``: whether no earlier row, by time and id, has the same keys."""
    first = df.groupBy(*keys).agg(F.min(F.struct("us", "txn_id")).alias("__first"))
    return df.join(first, keys).withColumn("is_new", F.col("__first.txn_id") == F.col("txn_id")).drop("__first")


def evaluate(df: DataFrame, keys: list[str], eps: float, delta: float, n: int, p: float) -> DataFrame:
    """How a conservative count-min sketch and a Bloom filter, fed in order of time, tell first occurrences.

    The order is what is measured, so the rows pass one task in order, with memory that the sketches bound.
    """
    width, depth = count_min_size(eps, delta)
    bits, k = bloom_size(n, p)
    rows = first_time(df, keys).select("us", "txn_id", "is_new", F.array(*hashes(F.concat_ws("|", *keys), depth, width)).alias("cells"), F.array(*hashes(F.concat_ws("|", *keys), k, bits)).alias("bits"))

    def run(batches):  # noqa: ANN001, ANN202
        table, seen = np.zeros((depth, width), np.int64), np.zeros(bits, bool)
        at = np.arange(depth)
        out = {"count_min": [0, 0, 0, 0], "bloom": [0, 0, 0, 0]}
        for pdf in batches:
            for new, cells, own in zip(pdf["is_new"], pdf["cells"], pdf["bits"], strict=True):
                now = table[at, cells]
                says = {"count_min": now.min() == 0, "bloom": not seen[own].all()}
                table[at, cells] = np.maximum(now, now.min() + 1)
                seen[own] = True
                for name, yes in says.items():
                    o = out[name]
                    o[0] += bool(new)
                    o[1] += bool(new and yes)
                    o[2] += not new
                    o[3] += bool(yes and not new)
        yield pd.DataFrame([(s, *v) for s, v in out.items()], columns=["structure", "first_times", "detected", "repeats", "false_new"])

    return rows.coalesce(1).sortWithinPartitions("us", "txn_id").mapInPandas(run, "structure string, first_times long, detected long, repeats long, false_new long")


def moments(df: DataFrame, key: str, column: str) -> DataFrame:
    """Mean and variances per key, merged from partial moments."""
    return df.groupBy(key).agg(F.avg(column).alias("mean"), F.var_pop(column).alias("var_pop"), F.var_samp(column).alias("var_sample"))


def top_k(df: DataFrame, k: int, score: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k)


def most_recent(df: DataFrame, group: str, item: str, capacity: int) -> DataFrame:
    """The items of each group that a recency-bounded store of this capacity would hold now."""
    last = df.groupBy(group, item).agg(F.max(F.struct("us", "txn_id")).alias("last"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("last")))
    return last.withColumn("recency", rank).where(F.col("recency") <= capacity).select(group, item, F.col("last.us").alias("last_us"), "recency")


def lru_hits(df: DataFrame, group: str, item: str, capacity: int) -> DataFrame:
    """txn_id and whether a store that holds the ``capacity`` latest items of each group has the row's item when it comes.

    What is evicted is forgotten, so answers change once a group has more items.  A group passes one task in order of
    time; only its latest items are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = object(), {}
        for pdf in batches:
            hits = []
            for of, what in zip(pdf[group].tolist(), pdf[item].tolist(), strict=True):
                if of != now:
                    now, held = of, {}
                hits.append(what in held)
                held.pop(what, None)
                held[what] = None  # the latest stands last
                if len(held) > capacity:
                    del held[next(iter(held))]
            yield pd.DataFrame({"txn_id": pdf["txn_id"], "hit": hits})

    rows = df.select("txn_id", "us", group, item).repartition(group).sortWithinPartitions(group, "us", "txn_id")
    return rows.mapInPandas(run, f"txn_id {df.schema['txn_id'].dataType.simpleString()}, hit boolean")
