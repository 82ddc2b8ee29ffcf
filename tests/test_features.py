"""Point-in-time features against a literal recomputation, with ties and exact window edges."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.drift import parity
from tidemark.plans.features import compute
from tidemark.plans.spec import CARD_RISK, HOUR, MEASURES, Catalog, Measure, register
from tidemark.streaming.features import KeyState

TXN = "txn_id long, us long, card_id long, merchant_id long, category string, cents long"
CB = "txn_id long, txn_us long, reported_us long, card_id long, merchant_id long, category string, cents long"
BASE = 1_700_000_000_000_000


def made(n, seed):
    rng, us, txns, cbs = random.Random(seed), BASE, [], []
    for i in range(n):
        us += rng.choice([0, 0, 1, 1_000_000, 600_000_000, HOUR, 24 * HOUR, 20_000_000_000])
        txns.append((i, us, rng.randint(1, 5), rng.randint(1, 4), rng.choice(["a", "b", "c"]), rng.randint(100, 200_000)))
    for i, us, *rest in txns:
        if rng.random() < 0.15:
            at = us + rng.choice([1_000_000, HOUR, 24 * HOUR, 5 * 24 * HOUR])
            if rng.random() < 0.3:
                at = next((t[1] for t in txns if t[1] > us), at)
            cbs.append((i, us, at, *rest))
    return txns, cbs


def literal(spec, txns, cbs):
    events = [(t[1], *t[2:], True) for t in txns] + [(c[2], *c[3:], False) for c in cbs]
    col = {"card_id": 1, "merchant_id": 2, "category": 3, "cents": 4}
    out = {}
    for t in txns:
        row = {}
        for a in spec.values():
            past = [e for e in events if e[0] < t[1] and (a.span is None or e[0] >= t[1] - a.span) and e[5] == (a.stream == "txn") and all(e[col[k]] == t[col[k] + 1] for k in a.keys)]
            v = [e[col[a.column]] for e in past] if a.column else []
            n = len(past)
            row[a.name] = {
                "count": lambda n=n: n,
                "sum": lambda v=v: sum(v) / 100,
                "mean": lambda v=v, n=n: sum(v) / n / 100 if n else None,
                "std": lambda v=v, n=n: (n * sum(x * x for x in v) - sum(v) ** 2) ** 0.5 / n / 100 if n else None,
                "max": lambda v=v: max(v) / 100 if v else None,
                "distinct": lambda v=v: len(set(v)),
                "since_last": lambda past=past, t=t: (t[1] - max(e[0] for e in past)) / 1e6 if past else None,
                "since_first": lambda past=past, t=t: (t[1] - min(e[0] for e in past)) / 1e6 if past else None,
            }[a.measure]()
        out[t[0]] = row
    return out


def close(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(a), abs(b))


def assert_same(got, want):
    assert got.keys() == want.keys()
    for i in want:
        for k, v in want[i].items():
            assert close(got[i][k], v), (i, k, got[i][k], v)


@pytest.mark.parametrize("seed", [0, 1])
def test_compiled_features_equal_a_literal_recomputation(spark, seed):
    txns, cbs = made(250, seed)
    shuffled = random.Random(seed).sample(txns, len(txns))
    rows = compute(CARD_RISK, spark.createDataFrame(shuffled, TXN), spark.createDataFrame(cbs, CB)).collect()
    assert_same({r["txn_id"]: r.asDict() for r in rows}, literal(CARD_RISK, txns, cbs))


def test_deleting_the_future_never_changes_the_past(spark):
    txns, cbs = made(120, 3)
    cut = txns[60][1]
    full = {r["txn_id"]: r for r in compute(CARD_RISK, spark.createDataFrame(txns, TXN), spark.createDataFrame(cbs, CB)).where(f"us < {cut}").collect()}
    part = compute(CARD_RISK, spark.createDataFrame([t for t in txns if t[1] < cut], TXN), spark.createDataFrame([c for c in cbs if c[2] < cut], CB)).collect()
    assert {r["txn_id"]: r for r in part} == full


def test_window_edges_and_ties(spark):
    spec = CARD_RISK.pick(["card__count_1h", "card__max_amount_24h", "card__since_last", "card__std_amount_all", "card__cb_count_all"])
    txns = [(1, BASE, 1, 1, "a", 500), (2, BASE, 1, 1, "a", 700), (3, BASE + HOUR, 1, 1, "a", 100), (4, BASE + HOUR + 1, 1, 1, "a", 100)]
    cbs = [(1, BASE, BASE + HOUR, 1, 1, "a", 500)]
    got = {r["txn_id"]: r for r in compute(spec, spark.createDataFrame(txns, TXN), spark.createDataFrame(cbs, CB)).collect()}
    assert [got[i]["card__count_1h"] for i in (1, 2, 3, 4)] == [0, 0, 2, 1]
    assert got[1]["card__max_amount_24h"] is None and got[1]["card__std_amount_all"] is None and got[1]["card__since_last"] is None
    assert [got[i]["card__cb_count_all"] for i in (3, 4)] == [0, 1]
    assert got[4]["card__max_amount_24h"] == 7.0


def test_empty_streams(spark):
    assert compute(CARD_RISK, spark.createDataFrame([], TXN), spark.createDataFrame([], CB)).count() == 0
    rows = compute(CARD_RISK, spark.createDataFrame([(1, BASE, 1, 1, "a", 5)], TXN), spark.createDataFrame([], CB)).collect()
    assert rows[0]["card__count_all"] == 0 and rows[0]["card__mean_amount_all"] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 10_000), st.integers(0, 3), st.booleans()), max_size=60))
def test_streaming_state_equals_a_literal_recomputation(steps):
    spec = CARD_RISK.pick(CARD_RISK.of_group("card"))
    us, txns, cbs, order = BASE, [], [], []
    for i, (gap, cents, merchant, is_txn) in enumerate(steps):
        us += [0, 1, HOUR, 24 * HOUR][gap]
        (txns.append((i, us, 1, merchant, str(merchant), cents)) if is_txn else cbs.append((i, us, us, 1, merchant, str(merchant), cents)))
        order.append((us, cents, merchant, str(merchant), is_txn, i))
    state, got = KeyState(spec, None), {}
    for us, cents, merchant, category, is_txn, i in order:
        state = KeyState(spec, state.tuple())
        state.advance(us)
        if is_txn:
            got[i] = dict(zip(spec, state.features(), strict=True))
        state.add(us, cents, merchant, category, is_txn)
    assert_same(got, literal(spec, txns, cbs))


def test_declarations_are_checked():
    for bad in ("global | txn | sum", "global | txn | count amount", "global | txn | distinct category", "global | cb | sum amount | 1h", "global | txn | since_last | 1h", "global | txn | count | 2h", "global | x | count", "global | txn | median amount", "card | txn | max amount", "card | txn | sum merchant", "who | txn | count", "count", ""):
        with pytest.raises(ValueError):
            next(iter(Catalog.parse(bad or "|").values()))
    with pytest.raises(ValueError):
        Catalog.parse("global | txn | count\nglobal | txn | count | 1h all")
    assert len(CARD_RISK) == 26 and CARD_RISK.pick(["card__count_1h"]).fingerprint != CARD_RISK.fingerprint
    assert Catalog(reversed(list(CARD_RISK.values()))).fingerprint == CARD_RISK.fingerprint
    assert list(Catalog.parse("card_category | cb | count | 7d")) == ["card_category__cb_count_7d"]


def test_a_registered_measure_is_known_to_plans_and_streams(spark):
    with pytest.raises(ValueError):
        register("count", MEASURES["mean"])
    register("rms", Measure((0, 2), lambda n, q: F.when(n > 0, F.sqrt(q.cast("double") / n) / 100), lambda n, q: (q / n) ** 0.5 / 100 if n else None))
    try:
        spec = Catalog.parse("card | txn | rms amount | 7d all")
        txns, cbs = made(80, 5)
        rows = compute(spec, spark.createDataFrame(txns, TXN), spark.createDataFrame(cbs, CB)).collect()
        got = {r["txn_id"]: r.asDict() for r in rows}
        want, states = {}, {}
        for us, is_txn, e in sorted([(t[1], True, t) for t in txns] + [(c[2], False, (c[0], *c[2:])) for c in cbs], key=lambda x: (x[0], not x[1], x[2][0])):
            state = states.setdefault(e[2], KeyState(spec, None))
            state.advance(us)
            if is_txn:
                want[e[0]] = dict(zip(spec, state.features(), strict=True))
            state.add(us, e[5], e[3], e[4], is_txn)
        assert_same({i: {k: g[k] for k in spec} for i, g in got.items()}, want)
        assert any(v["card__rms_amount_7d"] for v in want.values())
    finally:
        del MEASURES["rms"]


def test_maxima_and_distinct_values_in_many_windows(spark):
    spec = Catalog.parse("card | txn | max amount | 1h 24h 7d 30d\nglobal | txn | max amount | 1h\ncard | txn | distinct merchant | 1h 24h 7d\nglobal | txn | distinct category | 24h\nmerchant | txn | distinct category | 1h\nglobal | txn | std amount | 24h")
    txns, cbs = made(200, 7)
    txns = [(*t[:3], None if t[0] % 9 == 0 else t[3], None if t[0] % 11 == 0 else t[4], t[5]) for t in txns]
    rows = compute(spec, spark.createDataFrame(txns, TXN), spark.createDataFrame(cbs, CB)).collect()
    events = [(t[1], *t[2:], True) for t in txns]
    want = literal(spec, txns, [])
    for t in txns:
        for name, column in (("card__distinct_merchant_1h", 2), ("card__distinct_merchant_24h", 2), ("card__distinct_merchant_7d", 2), ("global__distinct_category_24h", 3), ("merchant__distinct_category_1h", 3)):
            f = spec[name]
            at = {"card_id": 1, "merchant_id": 2}
            want[t[0]][name] = len({e[column] for e in events if t[1] - f.span <= e[0] < t[1] and all(e[at[k]] == t[at[k] + 1] for k in f.keys)} - {None})
    assert_same({r["txn_id"]: {k: r[k] for k in spec} for r in rows}, want)


def test_parity_counts_differences(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "txn_id long, x double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.1)], "txn_id long, x double")
    r = parity(a, b, "txn_id", ["x"]).first()
    assert (r["rows"], r["null_mismatch"], r["mismatch"]) == (3, 1, 1)
