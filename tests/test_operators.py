"""Operators without SQL: identities, guarantees and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import calibration as C
from tidemark.operators import decisions as D
from tidemark.operators import drift as X
from tidemark.operators import labels as L
from tidemark.operators import metrics as M
from tidemark.operators import models as N
from tidemark.operators import neighbours
from tidemark.operators import relational as R
from tidemark.operators import sketches as K
from tidemark.sources import storage


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    n = 2000
    p = np.round(rng.beta(0.5, 4, n), 2)
    y = (rng.random(n) < p).astype(int)
    rows = [(i, int(i * 3_600_000_000), int(i % 40), float(a), float(b), int(c), i // 24) for i, (a, b, c) in enumerate(zip(p, np.round(rng.lognormal(3, 1, n), 2), y, strict=True))]
    return spark.createDataFrame(rows, "txn_id long, us long, card_id long, p double, amount double, y int, day long").cache()


def test_bayes_never_costs_more_than_one_action_for_all(scored):
    def cost(df):
        return df.agg(F.sum(F.when(F.col("action") == "approve", F.col("cost_approve")).when(F.col("action") == "review", F.col("cost_review")).otherwise(F.col("cost_decline")))).first()[0]

    best = cost(D.bayes(scored))
    assert all(best <= cost(D.with_costs(scored).withColumn("action", F.lit(a))) + 1e-6 for a in D.ACTIONS)


def test_capacity_and_budget_hold(scored):
    per_day = D.capacity(scored, 3).where("action = 'review'").groupBy("day").count().agg(F.max("count")).first()[0]
    assert per_day <= 3
    assert D.budget(scored, 0.013).where("action = 'review'").count() == math.ceil(0.013 * 2000)
    assert D.budget(scored.limit(0), 0.1).count() == 0


def test_conformal_coverage(scored):
    out = D.conformal(scored, 0.1, 0.05)
    r = out.agg(F.avg(F.when(F.col("y") == 1, (F.col("action") == "approve").cast("int"))).alias("a"), F.avg(F.when(F.col("y") == 0, (F.col("action") == "decline").cast("int"))).alias("b")).first()
    assert r["a"] <= 0.1 and r["b"] <= 0.05


def test_conformal_quantile_of_small_sets(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 20)], "s double")
    assert D.conformal_quantile(df, F.col("s"), 0.1).first()[0] == 18.0
    assert D.conformal_quantile(df, F.col("s"), 0.01).first()[0] is None


def test_isotonic_is_monotone_and_platt_learns(scored):
    b, v = C.isotonic(scored)
    assert (np.diff(v) >= -1e-12).all()
    got = scored.select("p", C.interpolate(F.col("p"), b, v).alias("c")).distinct().orderBy("p").collect()
    assert np.allclose([r["c"] for r in got], np.interp([r["p"] for r in got], b, v))
    slope, _ = C.platt(scored)
    assert slope > 0.5


def test_single_class_metrics_are_null(spark):
    df = spark.createDataFrame([(1, 0.1, 0), (2, 0.2, 0)], "txn_id long, p double, y int")
    assert M.roc_auc(df).first()[0] is None and M.average_precision(df).first()[0] is None


def test_bootstrap_holds_its_point(scored):
    sums = {"hits": F.when((F.col("p") >= 0.2) & (F.col("y") == 1), 1).otherwise(0), "pos": F.col("y")}
    r = M.cluster_bootstrap(scored, "card_id", sums, F.col("hits") / F.col("pos"), n_boot=100).first()
    assert r["low"] <= r["point"] <= r["high"]


def test_irls_solves_its_equations(scored):
    df = scored.withColumn("x", F.log1p("amount"))
    beta = N.irls(df, ["p", "x"], l2=0.5)
    rows = df.select("p", "x", "y").toPandas().to_numpy()
    a = np.column_stack([rows[:, :2], np.ones(len(rows))])
    grad = a.T @ (1 / (1 + np.exp(-a @ beta)) - rows[:, 2]) + np.array([0.5, 0.5, 0]) * beta
    assert np.abs(grad).max() < 1e-4


def test_boosting_learns_and_contributions_add_up(scored):
    df = scored.withColumn("amount", F.when(F.col("txn_id") % 7 != 0, F.col("amount")))
    m = N.fit_trees(df, ["p", "amount"], rounds=6, depth=3)
    rows = m.binned(df).select("y", m.margin().alias("s"), m.contributions().alias("c"))
    got = rows.select("s", (F.aggregate("c", F.lit(0.0), lambda a, x: a + x) + m.bias()).alias("t")).collect()
    assert all(abs(r["s"] - r["t"]) < 1e-9 for r in got)
    auc = M.roc_auc(rows.select("y", F.col("s").alias("p"))).first()[0]
    assert auc > M.roc_auc(scored).first()[0] - 0.02
    assert abs(sum(m.importance().values()) - 1) < 1e-9


@pytest.mark.parametrize("how", [{}, {"weight": "w"}, {"valid": True, "patience": 1}, {"gradients": N.focal_gradients}])
def test_boosting_is_the_same_with_the_driver_and_spread(scored, monkeypatch, how):
    df = scored.withColumns({"amount": F.when(F.col("txn_id") % 7 != 0, F.col("amount")), "w": 1.0 + 2 * F.col("y")})
    how = how | ({"valid": df.where("txn_id % 3 = 0")} if "valid" in how else {})
    held = N.fit_trees(df, ["p", "amount"], rounds=3, depth=3, bins=64, **how)
    monkeypatch.setattr(N, "HELD", 0)
    spread = N.fit_trees(df, ["p", "amount"], rounds=3, depth=3, bins=64, **how)
    assert len(held.trees) == len(spread.trees) and all(t.left for t in held.trees)
    rows = held.binned(df).select(held.margin().alias("a"), held.scores().alias("b"), spread.margin().alias("c")).collect()
    assert all(r["a"] == r["b"] and abs(r["a"] - r["c"]) < 1e-9 for r in rows)


def test_gradients_of_numbers_equal_those_of_columns(spark):
    rows = [(float(m), float(y)) for m in (-40, -3, -0.5, 0, 0.1, 2, 40) for y in (0, 1)]
    m, y = np.array(rows).T
    df = spark.createDataFrame(rows, "m double, y double")
    for columns, numbers in N.NUMBERS.items():
        want = np.array([tuple(r) for r in df.select(*columns(F.col("m"), F.col("y"))).collect()])
        assert np.allclose(np.column_stack(numbers(m, y)), want, rtol=1e-9, atol=1e-15)


def test_places_equal_a_plain_count(spark):
    from tidemark.operators.ordered import place

    for n in (0, 1, 31, 32, 33, 47, 48, 49, 254):
        edges = [float(i) for i in range(n)]
        got = spark.range(-2, 2 * n + 4).select((F.col("id") / 2).alias("x")).select("x", place(F.col("x"), edges).alias("n")).collect()
        assert all(r["n"] == sum(e <= r["x"] for e in edges) for r in got)


def test_gradients_are_derivatives(spark):
    df = spark.createDataFrame([(float(m), y) for m in np.linspace(-3, 3, 13) for y in (0, 1)], "m double, y int")
    def loss(kind, m, y):
        p = 1 / (1 + math.exp(-m))
        q, a = (p, 0.25) if y else (1 - p, 0.75)
        return -math.log(q) if kind == "log" else -a * (1 - q) ** 2 * math.log(q)
    for kind, f in (("log", N.logloss_gradients), ("focal", N.focal_gradients)):
        g, h = f(F.col("m"), F.col("y"))
        for r in df.select("m", "y", g.alias("g"), h.alias("h")).collect():
            e = 1e-4
            a, b, c = (loss(kind, r["m"] + d, r["y"]) for d in (-e, 0, e))
            assert abs(r["g"] - (c - a) / (2 * e)) < 1e-6
            assert abs(r["h"] - max((a + c - 2 * b) / e**2, 1e-6)) < 1e-4


def test_ftrl_predicts_before_it_learns(spark):
    df = spark.createDataFrame([(i, i, i % 2, float(i % 2)) for i in range(400)], "txn_id long, us long, y int, x double")
    p = [r["p"] for r in N.ftrl(df, ["x"], ["us"]).orderBy("txn_id").collect()]
    assert p[0] == 0.5 and p[-1] > 0.7 and p[-2] < 0.45 and p[-1] > p[99]


def test_sketches_keep_their_promises(spark):
    df = spark.createDataFrame([(i % 300,) for i in range(3000)], "k long")
    assert K.count_min_estimates(df, "k", 0.01, 0.05).where("estimate < exact").count() == 0
    held = K.bloom(df.where("k < 200"), F.col("k"), 200, 0.01)
    got = {r["k"]: r["contains"] for r in K.bloom_contains(df, "k", held, 200, 0.01).collect()}
    assert all(got[k] for k in range(200)) and sum(got[k] for k in range(200, 300)) < 15


def test_undersample_and_smote(scored):
    a = L.undersample(scored, 0.3, seed=1)
    assert a.where("y = 1").count() == scored.where("y = 1").count()
    assert 0.2 < a.where("y = 0").count() / scored.where("y = 0").count() < 0.4
    made = L.smote(scored, ["amount", "p"], {"p"}, 0.5).toPandas()
    pos = scored.where("y = 1").toPandas()
    assert len(made) == int(0.5 * (2000 - len(pos))) - len(pos)
    assert made["amount"].between(pos["amount"].min(), pos["amount"].max()).all() and set(made["p"]) <= set(pos["p"])


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    grid = rng.integers(0, 6, (150, 3)).astype(float)  # many equally far and equal points
    z = np.concatenate([grid, rng.normal(3, 1, (150, 3)), rng.normal(0, 1, (60, 3)) ** 5 * 100, np.zeros((40, 3))])
    keys = rng.permutation(len(z))
    lost = [(1000, [float("nan"), 0.0, 0.0]), (1001, [None, 0.0, 0.0]), (1002, [float("inf"), 0.0, 0.0])]
    rows = spark.createDataFrame([(int(i), x) for i, x in zip(keys, z.tolist(), strict=True)] + lost, "__key long, z array<double>").repartition(5)
    for k, block in ((5, 8), (5, 100_000), (90, 64)):
        got = {tuple(r["z"]): r["near"] for r in neighbours.near_points(rows, k, block).collect()}
        assert set(got) == set(map(tuple, z.tolist()))
        for i, x in zip(keys.tolist(), z, strict=True):
            far = sum((z[:, c] - x[c]) ** 2 for c in range(3))
            want = [int(m) for m in keys[np.lexsort((keys, far))] if m != i][:k]
            assert [m for m in got[tuple(x.tolist())] if m != i][:k] == want


def test_smote_finds_near_mates_beside_far_ones(spark):
    # Pairs 1e-8 apart, 1e-7 from the next pair: in z-scores their squares vanish beside those of the points.
    pairs = [1000.0 + i * 1e-7 for i in range(30)]
    x = [p + more for p in pairs for more in (0.0, 1e-8)] + [0.0, 4000.0]
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x)] + [(100 + i, 0, 0.0) for i in range(400)], "txn_id long, y int, a double")
    made = [r["a"] for r in L.smote(df, ["a"], set(), 0.9, k=1).collect()]
    inner = [v for v in made if 999.9 < v < 1000.1]
    assert len(made) == 298 and len(inner) >= 280
    assert all(min(abs(v - p) for p in pairs) < 1.1e-8 for v in inner)


def test_jobs_of_smote_do_not_grow_with_positives(spark):
    df = spark.range(1600).selectExpr("id AS txn_id", "CAST(id % 4 = 0 AS INT) AS y", "CAST(pmod(xxhash64(id), 1000) AS DOUBLE) AS a", "CAST(pmod(xxhash64(id, 1), 97) AS DOUBLE) AS b")

    def jobs(block):
        group = f"smote-{block}"
        spark.sparkContext.setJobGroup(group, group)
        assert L.smote(df, ["a", "b"], set(), 1.0, block=block).count() == 800
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        assert jobs(8) < jobs(400) + 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_calibration_bins_put_few_rows_in_order(spark):
    n = 20_000
    df = spark.range(0, n, 1, 4).selectExpr("pmod(id * 7919, 20011) AS txn_id", "CAST(id % 3 = 0 AS INT) AS y", "(id % 4) / 4.0D AS p")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        gateway = spark.sparkContext._gateway
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = {r["bin"]: r for r in M.calibration_bins(df).collect()}
    assert shuffled() - before < n / 2
    rows = sorted((r["p"], r["txn_id"], r["y"]) for r in df.collect())
    for b, part in enumerate(np.array_split(np.array(rows), 15)):
        assert got[b]["n"] == len(part) and got[b]["mean_p"] == pytest.approx(part[:, 0].mean()) and got[b]["rate"] == pytest.approx(part[:, 2].mean())
    few = {r["bin"]: (r["n"], r["mean_p"], r["rate"]) for r in M.calibration_bins(df.where("txn_id < 7").withColumn("p", F.lit(0.5)), 5).collect()}
    ys = [r["y"] for r in df.where("txn_id < 7").orderBy("txn_id").collect()]
    assert few == {b: (len(part), 0.5, part.mean()) for b, part in enumerate(np.array_split(np.array(ys), 5))}
    assert M.calibration_bins(df.limit(0)).count() == 0


def test_delays_do_not_depend_on_order(scored):
    a = {r["txn_id"]: r["reported_us"] for r in L.simulated_delays(scored.orderBy("p")).collect()}
    b = {r["txn_id"]: r["reported_us"] for r in L.simulated_delays(scored.repartition(7)).collect()}
    assert a == b
    days = np.array([(a[i] - i * 3_600_000_000) / 86_400_000_000 for i in a])
    assert days.min() >= 1 and 10 < np.median(days) < 14.5


def test_drift_measures(spark):
    a = spark.createDataFrame([(float(x),) for x in np.random.default_rng(0).normal(0, 1, 4000)], "x double")
    b = spark.createDataFrame([(float(x),) for x in np.random.default_rng(1).normal(1, 1, 4000)], "x double")
    assert X.psi(a, a, "x").first()[0] == 0 and X.psi(a, b, "x").first()[0] > 0.5
    assert X.ks(a, a, "x").first()[0] == 0 and 0.3 < X.ks(a, b, "x").first()[0] < 0.5


def test_zero_denominators_and_unknown_categories(spark):
    r = spark.createDataFrame([(1.0, 0.0, "zzz")], "a double, b double, c string").select(S.ratio(F.col("a"), F.col("b")).alias("r"), S.zscore(F.col("a"), F.col("a"), F.col("b")).alias("z"), S.category_code(F.col("c")).alias("c")).first()
    assert r["r"] is None and r["z"] is None and r["c"] == -1.0


def test_normalize_and_promote(spark, tmp_path):
    rows = "trans_date_trans_time,cc_num,merchant,category,amt,gender,city,state,zip,lat,long,city_pop,job,dob,trans_num,merch_lat,merch_long,is_fraud\n"
    rows += "2019-01-01 00:00:18,1,fraud_B,home,4.97,F,X,NC,01234,36.0,-81.1,10,Cook,1988-03-09,0B-24,36.1,-82.0,0\n"
    rows += "2019-01-01 00:00:05,2,fraud_A,home,7.00,M,Y,NY,01111,40.0,-73.1,20,Chef,1978-03-09,1c-25,40.1,-73.0,1\n"
    (tmp_path / "a.csv").write_text(rows)
    t = storage.normalize(storage.read_raw(spark, [str(tmp_path / "a.csv")]))
    assert {r["name"]: r["merchant_id"] for r in t["merchants"].collect()} == {"A": 1, "B": 2}
    assert {r["txn_id"] for r in t["transactions"].collect()} == {"0b24", "1c25"} and t["customers"].count() == 2
    reg = spark.createDataFrame([("v1", 1, "production")], "version string, created_at int, stage string")
    assert R.next_version(reg).first()["stage"] == "production"


def test_bundle_survives_a_round_trip(scored, spark):
    from tidemark.operators import experiments as E

    m = N.fit_trees(scored, ["p", "amount"], rounds=4, depth=2, valid=scored, patience=2)
    b, v = C.isotonic(scored)
    again, b2, v2, manifest = E.unpack(E.ship(spark, m, b, v, algorithm="trees").first()["bundle"])
    assert manifest == {"algorithm": "trees"} and (b == b2).all() and (v == v2).all()
    rows = m.binned(scored).select(m.margin().alias("x"), again.margin().alias("y")).where("x <> y")
    assert rows.count() == 0


def test_recorded_payments_are_seen_and_asked_ones_are_not(spark):
    from tidemark.plans.features import compute, peek
    from tidemark.plans.spec import CARD_RISK
    from tidemark.streaming import desk

    schema = "txn_id long, us long, card_id long, merchant_id long, category string, cents long"
    t = spark.createDataFrame([(1, 1000, 1, 1, "a", 500)], schema)
    asked = spark.createDataFrame([(-1, 2000, 1, 1, "a", 900), (-2, 3000, 1, 1, "a", 900)], schema)
    cb = spark.createDataFrame([], "txn_id long, txn_us long, reported_us long, card_id long, merchant_id long, category string, cents long")
    spec = CARD_RISK.pick(["card__count_all", "card__max_amount_7d"])
    assert {tuple(r)[2:] for r in peek(spec, t, cb, asked).collect()} == {(5.0, 1)} or {(r["card__count_all"], r["card__max_amount_7d"]) for r in peek(spec, t, cb, asked).collect()} == {(1, 5.0)}
    late = compute(spec, desk.record(t, asked), cb).where("txn_id = -2").first()
    assert (late["card__count_all"], late["card__max_amount_7d"]) == (2, 9.0)


def test_streaming_rejects_what_is_late_and_leaves_its_state(spark, tmp_path):
    from tidemark.plans.spec import CARD_RISK
    from tidemark.streaming import features as ST

    schema = "txn_id long, us long, card_id long, merchant_id long, category string, cents long, is_txn boolean"
    spec = CARD_RISK.pick(["card__count_all", "card__count_1h"])
    batches = [[(1, 100, 1, 1, "a", 5, True), (2, 100, 1, 1, "a", 5, True)], [(3, 50, 1, 1, "a", 5, True), (4, 100, 1, 1, "a", 5, True), (5, 101, 1, 1, "a", 5, True)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        for f in (tmp_path / "in" / f"{i}").glob("part-*"):
            (tmp_path / "files").mkdir(exist_ok=True)
            f.rename(tmp_path / "files" / f"{i}.parquet")
    stream = ST.rate_limited(spark, schema, str(tmp_path / "files"), 1)
    got = {r["txn_id"]: (r["late"], r["card__count_all"]) for r in ST.replay(ST.stateful(stream, spec), "late").collect()}
    assert got == {1: (False, 0.0), 2: (False, 0.0), 3: (True, None), 4: (False, 0.0), 5: (False, 3.0)}


def test_adversarial_validation_takes_as_many_rows_as_the_operator(spark, monkeypatch):
    import inspect

    from tidemark import queries

    bound, seen = inspect.signature(queries.X.adversarial), {}

    def held(*a, **b):
        args = bound.bind(*a, **b)
        args.apply_defaults()
        seen.update(args.arguments)
        return 0.5, {"amount": 1.0}

    monkeypatch.setattr(queries, "_halves", lambda *_: (None, None))
    monkeypatch.setattr(queries.X, "adversarial", held)
    assert queries.adversarial_validation(spark, "").count() == 2 and seen["n"] == 200_000
