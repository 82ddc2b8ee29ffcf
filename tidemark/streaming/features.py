"""The features of one key group as keyed streaming state, and the scoring of what comes out."""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.plans.spec import STREAMS, Catalog
from tidemark.sources.shared import shared_path

#: Past events as far back as the longest window, then per stream: number, sums, first and last time.  Sums of squares outgrow 64 bits.
STATE = "us array<long>, cents array<long>, merchant_id array<long>, category array<string>, is_txn array<boolean>, n array<long>, s array<long>, ss array<string>, first array<long>, last array<long>, now long"
#: A past event: time, cents, merchant, category, whether it is a transaction.
Event = tuple[int, int, "int | None", "str | None", bool]
PLACE = {"cents": 1, "merchant_id": 2, "category": 3}


class Recent:
    """Counts, sums, the largest amounts and distinct values of the last ``span`` microseconds, kept up event by event."""

    def __init__(self, span: int, columns: set[str]) -> None:
        self.span, self.live = span, deque()
        self.n, self.s, self.ss = [0, 0], [0, 0], [0, 0]
        self.peaks: deque[tuple[int, int]] = deque()  # amounts that no later one exceeds, falling
        self.kinds = {c: Counter() for c in columns}

    def enter(self, e: Event) -> None:
        self.live.append(e)
        k = 0 if e[4] else 1
        self.n[k], self.s[k], self.ss[k] = self.n[k] + 1, self.s[k] + e[1], self.ss[k] + e[1] * e[1]
        if e[4]:
            while self.peaks and self.peaks[-1][1] <= e[1]:
                self.peaks.pop()
            self.peaks.append((e[0], e[1]))
            for c, seen in self.kinds.items():
                if e[PLACE[c]] is not None:
                    seen[e[PLACE[c]]] += 1

    def leave(self, before: int) -> None:
        """Takes out what is older than ``before``."""
        while self.live and self.live[0][0] < before:
            e = self.live.popleft()
            k = 0 if e[4] else 1
            self.n[k], self.s[k], self.ss[k] = self.n[k] - 1, self.s[k] - e[1], self.ss[k] - e[1] * e[1]
            if e[4]:
                for c, seen in self.kinds.items():
                    if (v := e[PLACE[c]]) is not None:
                        seen[v] -= 1
                        if not seen[v]:
                            del seen[v]
        while self.peaks and self.peaks[0][0] < before:
            self.peaks.popleft()


class KeyState:
    """What a key has seen strictly before its clock, and the events at the clock that nobody sees yet."""

    def __init__(self, catalog: Catalog, state: tuple | None) -> None:
        self.catalog = catalog
        spans = sorted({f.span for f in catalog.values() if f.span})
        self.recent = {w: Recent(w, {f.column for f in catalog.values() if f.span == w and f.how.way == "variety"}) for w in spans}
        self.longest = max(spans, default=0)
        self.past: deque[Event] = deque()
        self.pending: list[Event] = []
        if state is None:
            self.n, self.s, self.ss, self.first, self.last, self.now = [0, 0], [0, 0], [0, 0], [-1, -1], [-1, -1], -1
            return
        *cols, n, s, ss, first, last, now = state
        self.n, self.s, self.ss, self.first, self.last, self.now = list(n), list(s), [int(x) for x in ss], list(first), list(last), now
        for e in zip(*cols, strict=True):
            if e[0] == now:
                self.pending.append(e)
                continue
            self.past.append(e)
            for r in self.recent.values():
                if e[0] >= now - r.span:
                    r.enter(e)

    def tuple(self) -> tuple:
        events = [*self.past, *self.pending]
        cols = list(zip(*events, strict=True)) if events else [()] * 5
        return (*(list(c) for c in cols), self.n, self.s, [str(x) for x in self.ss], self.first, self.last, self.now)

    def add(self, us: int, cents: int, merchant: int | None, category: str | None, is_txn: bool) -> None:
        """An event at the clock."""
        self.pending.append((us, cents, merchant, category, is_txn))

    def advance(self, us: int) -> None:
        """Moves the clock; what stood at the old one becomes the past."""
        if us == self.now:
            return
        for e in self.pending:
            k = 0 if e[4] else 1
            self.n[k], self.s[k], self.ss[k] = self.n[k] + 1, self.s[k] + e[1], self.ss[k] + e[1] * e[1]
            self.first[k] = e[0] if self.first[k] < 0 else self.first[k]
            self.last[k] = e[0]
            self.past.append(e)
            for r in self.recent.values():
                r.enter(e)
        self.pending, self.now = [], us
        for r in self.recent.values():
            r.leave(us - r.span)
        while self.past and self.past[0][0] < us - self.longest:
            self.past.popleft()

    def features(self) -> list[float | None]:
        out: list[float | None] = []
        for f in self.catalog.values():
            k, how = STREAMS.index(f.stream), f.how
            if how.way in ("latest", "earliest"):
                t = (self.last if how.way == "latest" else self.first)[k]
                out.append(None if t < 0 else (self.now - t) / 1e6)
                continue
            of = self.recent[f.span] if f.span else self
            if how.way == "largest":
                out.append(of.peaks[0][1] / 100 if of.peaks else None)
            elif how.way == "variety":
                out.append(float(len(of.kinds[f.column])))
            else:
                out.append(how.number(*((of.n, of.s, of.ss)[p][k] for p in how.sums)))
        return out


def snapshot(catalog: Catalog, events: DataFrame, path: str) -> None:
    """Writes the state that ``stateful`` has after ``events`` (all of one key group), with the catalog's fingerprint, for a warm start."""
    keys = next(iter(catalog.values())).keys
    longest = max((f.span for f in catalog.values() if f.span), default=0)
    now = events.groupBy(*keys).agg(F.max("us").alias("now"))
    rows = events.join(now, list(keys))
    e = F.struct("us", "cents", "merchant_id", "category", "is_txn")
    seen = F.col("us") < F.col("now")
    totals = [F.struct(*(f(F.when((F.col("is_txn") == (s == "txn")) & seen, v)) for s in STREAMS)).alias(n) for n, f, v in (("n", F.count, F.lit(1)), ("s", F.sum, F.col("cents")), ("ss", F.sum, F.col("cents").cast("decimal(19,0)") * F.col("cents")), ("first", F.min, F.col("us")), ("last", F.max, F.col("us")))]
    got = rows.groupBy(*keys, "now").agg(F.sort_array(F.collect_list(F.when(F.col("us") >= F.col("now") - longest, e))).alias("events"), *totals)
    listed = [F.array(*(F.coalesce(F.col(n)[f"col{i + 1}"].cast("string"), F.lit("-1" if n in ("first", "last") else "0")) for i in range(2))).alias(n) for n in ("n", "s", "ss", "first", "last")]
    state = F.to_json(F.struct(F.struct(*(F.col("events")[c].alias(c) for c in ("us", "cents", "merchant_id", "category", "is_txn"))).alias("events"), *listed, "now"), {"ignoreNullFields": "false"})
    got.select(*keys, state.alias("state"), F.lit(catalog.fingerprint).alias("catalog")).write.parquet(path)


def _restored(text: str) -> tuple:
    x = json.loads(text)
    return (*x["events"].values(), *([int(v) for v in x[n]] for n in ("n", "s", "ss", "first", "last")), x["now"])


def stateful(stream: DataFrame, catalog: Catalog, warm: str | None = None) -> DataFrame:
    """txn_id, us, cents, late and the features of each transaction of a stream of events; all features must be of the same group.

    A key's events are taken in order of time within a micro-batch.  One that is older than the key's clock is
    rejected: it comes out with late = true and without features, and leaves the state as it is.  ``warm`` names a
    snapshot that the first micro-batch starts from; one of another catalog is refused.
    """
    keys = next(iter(catalog.values())).keys
    if any(f.keys != keys for f in catalog.values()) or not keys:
        raise ValueError("one key group at a time")
    names = list(catalog)
    spark = stream.sparkSession
    stream = stream.withColumn("state", F.lit(None).cast("string"))
    if warm is not None:
        held = spark.read.parquet(warm)
        if held.where(~F.col("catalog").eqNullSafe(catalog.fingerprint)).limit(1).count():
            raise ValueError("the snapshot is of another catalog")
        stream = stream.unionByName(spark.readStream.schema(held.schema).parquet(warm).drop("catalog"), allowMissingColumns=True)

    def step(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        start = rows["state"].dropna()
        held = KeyState(catalog, state.get if state.exists else _restored(start.iloc[0]) if len(start) else None)
        rows = rows[rows["state"].isna()].sort_values(["us", "is_txn", "txn_id"], ascending=[True, False, True], kind="stable")
        out = []
        merchants = [None if pd.isna(m) else int(m) for m in rows["merchant_id"]]
        for id_, us, cents, merchant, category, is_txn in zip(rows["txn_id"].tolist(), rows["us"].astype("int64").tolist(), rows["cents"].astype("int64").tolist(), merchants, rows["category"].tolist(), rows["is_txn"].astype(bool).tolist(), strict=True):
            if us < held.now:
                if is_txn:
                    out.append((id_, us, cents, True, *[None] * len(names)))
                continue
            held.advance(us)
            if is_txn:
                out.append((id_, us, cents, False, *held.features()))
            held.add(us, cents, merchant, category, is_txn)
        state.update(held.tuple())
        if out:
            got = pd.DataFrame(out, columns=["txn_id", "us", "cents", "late", *names])
            yield got.astype({"txn_id": "int64", **dict.fromkeys(names, "float64")})

    schema = "txn_id long, us long, cents long, late boolean, " + ", ".join(f"{n} double" for n in names)
    return stream.groupBy(*keys).applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote."""
    spark: SparkSession = stream.sparkSession
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def replay_groups(stream_of: Callable[[], DataFrame], catalog: Catalog) -> DataFrame:
    """txn_id and all features of a catalog: one stream for each group, joined by transaction.

    ``stream_of()`` opens the events anew.  A group without keys would be one state for everything and is refused;
    its features come from the batch plan, whose tasks hold a bucket each.
    """
    out = None
    for group in dict.fromkeys(f.group for f in catalog.values()):
        names = catalog.of_group(group)
        got = replay(stateful(stream_of(), catalog.pick(names)), group).where("not late").select("txn_id", *names)
        out = got if out is None else out.join(got, "txn_id")
    return out


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each txn_id once within the delay, whatever way it was written."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["txn_id"])


def scored_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Applies batch expressions to every micro-batch; a batch that is tried again replaces what it had written."""

    def write(batch: DataFrame, n: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def scorer(weights: dict[str, tuple[float, float]], bias: float, knots: list[tuple[float, float]], decide: Callable[[DataFrame], DataFrame], reasons: int = 3) -> Callable[[DataFrame], DataFrame]:
    """From features to a decision: logistic score, isotonic calibration, policy, and the features that raised the score most.

    ``weights`` has the weight and the usual value of each feature; a missing feature has its usual value and adds nothing.
    """

    def score(rows: DataFrame) -> DataFrame:
        from tidemark.operators.calibration import interpolate

        adds = {n: F.coalesce(F.lit(w) * (F.col(n).cast("double") - F.lit(usual)), F.lit(0.0)) for n, (w, usual) in weights.items()}
        raw = 1 / (1 + F.exp(-(F.lit(bias) + sum(adds.values(), start=F.lit(0.0)))))
        shares = F.array(*(F.struct((-a).alias("less"), F.lit(n).alias("name")) for n, a in adds.items()))
        top: Column = F.slice(F.array_sort(F.filter(shares, lambda x: x["less"] < 0)), 1, reasons)
        rows = rows.withColumn("raw", raw).withColumn("reasons", F.array_join(F.transform(top, lambda x: x["name"]), ","))
        return decide(rows.withColumn("p", interpolate(F.col("raw"), [k[0] for k in knots], [k[1] for k in knots])))

    return score


def rate_limited(spark: SparkSession, schema: str, path: str, files: int = 1) -> DataFrame:
    """A stream over files that takes at most ``files`` of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def monitor(stream: DataFrame, column: str) -> DataFrame:
    """Number of events and of late ones per hour of event time."""
    return stream.groupBy(F.window(F.timestamp_micros(column), "1 hour").alias("hour")).agg(F.count("*").alias("n"), F.count_if("late").alias("late"))
