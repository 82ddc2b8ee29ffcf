"""From a catalog of features to one DataFrame plan.

A feature at time t sees events with t - span <= us < t; events of the same microsecond don't see one another.

Counts and sums are invertible: each event enters as +v at its time and leaves as -v one span later, so one
running sum gives every window of a key.  So are distinct values: a value enters with an event that no event of the
value precedes by a span or less, and leaves a span after one that none follows.  All groups are one long table of
such changes, and all its running sums are taken at once: totals of whole buckets of a key, and the running sum within
a bucket, so that no task holds more than a bucket of a key and the rows that go over buckets are as few as the
buckets.  Groups of few keys have finer buckets.  A maximum is that of two halves that meet at a multiple of the span,
each a running maximum, one forwards and one backwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.spec import GROUPS, HOUR, Catalog, Feature

DAY = 24 * HOUR
#: Groups that a large share of all events may fall into, whose buckets are minutes instead of days.
BROAD, MINUTE = ("global", "category"), HOUR // 60
#: Inputs of fewer bytes may be one partition and are dealt to all cores before they are expanded.
SMALL = 64 << 20

#: A running sum: stream, what is added up, of which column, in which span.
Sum = tuple[str, str, "str | None", "int | None"]


def events(txns: DataFrame, chargebacks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Both streams as one: chargebacks stand at the time they are reported.  ``is_txn`` is null for events that are only asked about."""
    cols = ["txn_id", "us", "card_id", "merchant_id", "category", "cents"]
    reported = chargebacks.withColumn("us", F.col("reported_us")).select(*cols, F.lit(False).alias("is_txn"))
    both = txns.select(*cols, F.lit(True).alias("is_txn")).unionByName(reported)
    return both if asked is None else both.unionByName(asked.select(*cols, F.lit(None).cast("boolean").alias("is_txn")))


def _dealt(ev: DataFrame) -> DataFrame:
    size = int(str(ev._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return ev.repartition(ev.sparkSession.sparkContext.defaultParallelism) if size < SMALL else ev


def _sums(f: Feature) -> list[Sum]:
    """What a feature is made of; squares are two sums, of their high and low 32 bits, that stay in 64 bits."""
    if f.how.way == "variety":
        return [("txn", "kinds", f.column, f.span)]
    parts = {0: ["one"], 1: ["value"], 2: ["high", "low"]}
    return [(f.stream, p, f.column if p != "one" else None, f.span) for power in f.how.sums for p in parts[power]]


def _change(what: str, column: str | None) -> str:
    """What an event adds to a running sum, as SQL."""
    x = f"CAST({column} AS BIGINT)" if column else "1L"
    return {"one": "1L", "value": x, "high": f"shiftright({x} * {x}, 32)", "low": f"({x} * {x}) & {(1 << 32) - 1}L"}[what]


def _of(stream: str) -> str:
    return "is_txn" if stream == "txn" else "NOT is_txn"


class _Layout:
    """Which group a row of changes is of, and which slot of it holds which running sum.  Expressions are SQL: there are many."""

    def __init__(self, catalog: Catalog, kinds: dict[str, str]) -> None:
        running = [f for f in catalog.values() if f.how.way != "largest"]
        self.kinds = kinds
        self.groups = list(dict.fromkeys(f.group for f in running))
        self.features = {g: [f for f in running if f.group == g] for g in self.groups}
        self.sums = {g: list(dict.fromkeys(s for f in fs for s in _sums(f))) for g, fs in self.features.items()}
        self.latest = sorted({f.stream for f in running if f.how.way == "latest"})
        self.earliest = sorted({f.stream for f in running if f.how.way == "earliest"})
        self.slots = [f"s{i}" for i in range(max(map(len, self.sums.values()), default=0))]
        self.columns = list(dict.fromkeys(k for g in self.groups for k in GROUPS[g]))
        self.how = {**dict.fromkeys(self.slots, "sum"), **{f"latest_{s}": "max" for s in self.latest}, **{f"earliest_{s}": "min" for s in self.earliest}}

    def row(self, group: str, at: str, id_: str, changes: dict[Sum, str], own: bool) -> str:
        """One row of changes; one that stands for the event itself has its time."""
        sums = self.sums[group]
        keys = [f"'{c}', {c if c in GROUPS[group] else f'CAST(NULL AS {self.kinds[c]})'}" for c in self.columns]
        slots = [f"'{s}', CAST({changes.get(sums[i], 'NULL') if i < len(sums) else 'NULL'} AS BIGINT)" for i, s in enumerate(self.slots)]
        times = [f"'{kind}_{s}', {f'CASE WHEN {_of(s)} THEN us END' if own else 'CAST(NULL AS BIGINT)'}" for kind, of in (("latest", self.latest), ("earliest", self.earliest)) for s in of]
        key = f"named_struct({', '.join([f"'g', {self.groups.index(group)}", *keys])})"
        width = MINUTE if group in BROAD else DAY
        return f"named_struct({', '.join([f"'key', {key}, 'at', {at}, 'id', {id_}, 'bucket', ({at}) div {width}", *slots, *times])})"


def _kinds(ev: DataFrame, layout: _Layout, none: str) -> DataFrame | None:
    """Changes of the number of distinct values."""
    wanted = [(g, s) for g in layout.groups for s in layout.sums[g] if s[1] == "kinds"]
    if not wanted:
        return None
    # Columns that aren't keys of the group don't tell values apart.
    every = [f"named_struct('w', {i}, 'v', CAST({s[2]} AS STRING), {', '.join(f"'{c}', {c if c in GROUPS[g] else f'CAST(NULL AS {layout.kinds[c]})'}" for c in layout.columns) or "'none', 0"})" for i, (g, s) in enumerate(wanted)]
    rows = ev.where("is_txn").selectExpr("us", "is_txn", f"inline(array({', '.join(every)}))").where("v IS NOT NULL")
    over = f"OVER (PARTITION BY {', '.join(['w', 'v', *layout.columns])} ORDER BY us)"
    rows = rows.selectExpr("*", f"us - lag(us) {over} AS since", f"lead(us) {over} - us AS until")
    changes = []
    for i, (g, s) in enumerate(wanted):
        changes.append(f"CASE WHEN w = {i} AND coalesce(since > {s[3]}, true) THEN {layout.row(g, 'us', none, {s: '1'}, False)} END")
        changes.append(f"CASE WHEN w = {i} AND coalesce(until > {s[3]}, true) THEN {layout.row(g, f'us + {s[3]}', none, {s: '-1'}, False)} END")
    return rows.selectExpr(f"inline(array({', '.join(changes)}))")


def _running(ev: DataFrame, layout: _Layout, id_: str) -> DataFrame:
    """For each event that is looked at and each group, the running sums and times before it."""
    none = f"CAST(NULL AS {ev.schema['txn_id'].dataType.simpleString()})"
    rows = []
    for g in layout.groups:
        own = {s: f"CASE WHEN {_of(s[0])} THEN {_change(*s[1:3])} END" for s in layout.sums[g] if s[1] != "kinds"}
        rows.append(layout.row(g, "us", id_, own, True))
        for span in sorted({s[3] for s in own if s[3]}):
            gone = {s: f"-({c})" for s, c in own.items() if s[3] == span}
            rows.append(f"CASE WHEN {' OR '.join(sorted({_of(s[0]) for s in gone}))} THEN {layout.row(g, f'us + {span}', none, gone, False)} END")
    changes = ev.selectExpr(f"inline(array({', '.join(rows)}))")
    if (kinds := _kinds(ev, layout, none)) is not None:
        changes = changes.unionByName(kinds)
    # One exchange serves the totals and the rows: both read all columns of it.  Rows sort by the hash, which is quick.
    part = ["hash", "key", "bucket"]
    changes = changes.where("key IS NOT NULL AND bucket IS NOT NULL").selectExpr("xxhash64(key, bucket) AS hash", "*").repartition("hash")
    totals = changes.groupBy(*part).agg(F.expr("count(id)").alias("ids"), F.expr("min(at)").alias("least"), *(F.expr(f"{f}({n})").alias(n) for n, f in layout.how.items()))
    before = totals.where("ids >= 0 AND least IS NOT NULL").selectExpr(*part, *(f"{f}({n}) OVER (PARTITION BY key ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b_{n}" for n, f in layout.how.items()))
    within = changes.selectExpr(*part, "at", "id", *(f"{f}({n}) OVER (PARTITION BY {', '.join(part)} ORDER BY at RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w_{n}" for n, f in layout.how.items())).where("id IS NOT NULL")
    whole = [f"coalesce(b_{n}, 0L) + coalesce(w_{n}, 0L) AS {n}" if n in layout.slots else f"coalesce({'w' if n.startswith('latest') else 'b'}_{n}, {'b' if n.startswith('latest') else 'w'}_{n}) AS {n}" for n in layout.how]
    return within.join(before, part).selectExpr("id", "at AS us", "key.g AS g", *whole)


def _finish(f: Feature, layout: _Layout) -> Column:
    if f.how.way in ("latest", "earliest"):
        return (F.col("us") - F.col(f"{f.how.way}_{f.stream}")) / 1e6
    got = {s[1]: F.col(layout.slots[layout.sums[f.group].index(s)]) for s in _sums(f)}
    if f.how.way == "variety":
        return got["kinds"]
    if 2 in f.how.sums:
        got["square"] = (got["high"].cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + got["low"].cast("decimal(19,0)")).cast("decimal(26,0)")
    return f.how.column(*(got[("one", "value", "square")[p]] for p in f.how.sums))


def _largest(ev: DataFrame, features: Sequence[Feature], id_: str, kinds: dict[str, str]) -> DataFrame:
    """For each event that is looked at and each maximum, that of either half of its span."""
    columns = list(dict.fromkeys(k for f in features for k in f.keys))
    rows = []
    for i, f in enumerate(features):
        keys = [f"'{c}', {c if c in f.keys else f'CAST(NULL AS {kinds[c]})'}" for c in columns]
        key = f"named_struct({', '.join([f"'f', {i}", *keys])})"
        chunk = f"CAST(floor(us / {f.span}) AS BIGINT)"
        rows.append(f"named_struct('key', {key}, 'chunk', {chunk}, 'at', us, 'id', {id_}, 'back', false, 'v', CASE WHEN is_txn THEN CAST({f.column} AS BIGINT) END, 'us', us)")
        rows.append(f"CASE WHEN {id_} IS NOT NULL THEN named_struct('key', {key}, 'chunk', {chunk} - 1, 'at', us - {f.span}, 'id', {id_}, 'back', true, 'v', CAST(NULL AS BIGINT), 'us', us) END")
    rows = ev.where("coalesce(is_txn, true)").selectExpr(f"inline(array({', '.join(rows)}))").where("key IS NOT NULL").selectExpr("xxhash64(key, chunk) AS hash", "*")
    part = "OVER (PARTITION BY hash, key, chunk ORDER BY at"
    got = rows.selectExpr("key.f AS f", "id", "us", "back", f"max(v) {part} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS forth", f"max(v) {part} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS behind")
    got = got.where("id IS NOT NULL").selectExpr("id", "us", "f", "CASE WHEN back THEN behind ELSE forth END / 100.0D AS v")
    return got.selectExpr("id", "us", *(f"CASE WHEN f = {i} THEN v END AS {f.name}" for i, f in enumerate(features)))


def peek(catalog: Catalog, txns: DataFrame, chargebacks: DataFrame, asked: DataFrame) -> DataFrame:
    """Features of events that are asked about but never happen: they see the past, and nothing sees them."""
    return compute(catalog, txns, chargebacks, asked)


def compute(catalog: Catalog, txns: DataFrame, chargebacks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """txn_id, us and all features of the catalog, one row for each txn_id, or for each that is asked about."""
    ev = events(txns, chargebacks, asked)
    id_ = f"CASE WHEN {'is_txn IS NULL' if asked is not None else 'is_txn'} THEN txn_id END"
    kinds = {f.name: f.dataType.simpleString() for f in ev.schema}
    ev, layout, parts = _dealt(ev), _Layout(catalog, kinds), []
    if layout.groups:
        got = _running(ev, layout, id_)
        parts.append(got.select("id", "us", *(F.when(F.col("g") == i, _finish(f, layout)).alias(f.name) for i, g in enumerate(layout.groups) for f in layout.features[g])))
    if largest := [f for f in catalog.values() if f.how.way == "largest"]:
        parts.append(_largest(ev, largest, id_, kinds))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.groupBy(F.col("id").alias("txn_id")).agg(F.max("us").alias("us"), *(F.expr(f"max({n})").alias(n) for n in catalog)).select("txn_id", "us", *catalog)
