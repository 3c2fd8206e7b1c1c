import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from costplan.operators import calibration, conformal, cost, evaluation, frontier, selection
from costplan.operators.ordered import numbered, running_total


def pool(spark, rows, names="query_id string, plan_id string, pred_cost double, pred_latency double"):
    return spark.createDataFrame(rows, names)


def test_frontier_of_ties_nulls_and_empty(spark):
    rows = [("q", "a", 1.0, 4.0), ("q", "b", 1.0, 4.0), ("q", "c", 2.0, 4.0), ("q", "d", 2.0, 2.0), ("q", "e", 0.0, 9.0), ("q", "f", None, 1.0), (None, "g", 1.0, 1.0)]
    p = pool(spark, rows)
    assert {r["plan_id"] for r in frontier.keep_ties(p).collect()} == {"a", "b", "d", "e"}
    lead = {r["plan_id"]: (r["n_equivalent"], list(r["equivalents"])) for r in frontier.sort_scan(p).collect()}
    assert lead == {"a": (2, ["a", "b"]), "d": (1, ["d"]), "e": (1, ["e"])}
    assert frontier.keep_ties(p.limit(0)).count() == 0 and frontier.sort_scan(p.limit(0)).count() == 0


def test_frontier_of_a_large_query_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = rng.integers(1, 400, (3000, 2)).astype(float)
    p = pool(spark, [("q", f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(pts)])
    best = {f"p{i}" for i, (a, b) in enumerate(pts) if not (((pts[:, 0] <= a) & (pts[:, 1] <= b)) & ((pts[:, 0] < a) | (pts[:, 1] < b))).any()}
    assert {r["plan_id"] for r in frontier.keep_ties(p).collect()} == best


def test_three_plan_tradeoff(spark):
    p = pool(spark, [("q", "cheap_slow", 1.0, 4.0), ("q", "balanced", 1.3, 2.0), ("q", "fast_pricey", 3.0, 1.0)]).withColumns({"actual_cost": F.col("pred_cost"), "actual_latency": F.col("pred_latency")})
    at = lambda b: {r["strategy_name"]: r["plan_id"] for r in selection.strategy_choices(p.withColumn("budget", F.lit(b))).collect()}
    assert at(2.0)["greedy_fastest"] == "balanced" and at(0.5)["greedy_fastest"] == "cheap_slow" and at(10.0)["oracle"] == "fast_pricey"
    bounded = conformal.bounds(p, F.lit(1.25), F.lit(1.0)).withColumns({"budget": F.lit(1.5), "deadline": F.lit(None).cast("double")})
    assert selection.robust_select(bounded).first()["plan_id"] == "cheap_slow"
    none = selection.robust_select(bounded.withColumn("budget", F.lit(0.1))).first()
    assert none["plan_id"] == "cheap_slow" and none["feasible"] is False
    with pytest.raises(ValueError):
        selection.resolve_infeasible(bounded, "other")


def test_infeasible_budget(spark):
    rows = [("q", f"p{i}", 20.0 * i, 10.0 * (5 - i), 25.0 * i) for i in range(1, 5)]
    p = spark.createDataFrame(rows, "query_id string, plan_id string, pred_cost double, pred_latency double, cost_upper double").withColumns({"latency_upper": F.col("pred_latency"), "budget": F.lit(10.0)})
    d = selection.diagnostics(p).first()
    assert (d["min_budget_required"], d["deficit"], d["min_budget_for_fastest"]) == (25.0, 15.0, 100.0) and abs(d["recommended_budget"] - 26.25) < 1e-9


def test_degenerate_normalisation_is_zero(spark):
    r = selection.lagrangian(pool(spark, [("q", "a", 1.0, 1.0), ("q", "b", 1.0, 1.0)]).withColumn("budget", F.lit(0.5))).collect()
    assert all(x["norm_cost"] == 0 and x["score"] == 0.5 for x in r)


def test_quantile_rank_beyond_n(spark):
    s = spark.createDataFrame([("q", f"p{i}", "cost", float(i)) for i in range(5)], "query_id string, plan_id string, metric string, score double")
    inf, top = (conformal.quantiles(s, [0.05], b).first() for b in ("infinity", "largest"))
    assert inf["rank_exceeds_n"] and math.isinf(inf["multiplier"]) and top["q"] == 4.0
    assert conformal.quantiles(s, [0.5]).first()["q"] == 2.0
    with pytest.raises(ValueError):
        conformal.quantiles(s, [0.5], "other")


def test_leave_one_out_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(f"q{rng.integers(6)}", f"p{i}", "cost", float(rng.integers(40))) for i in range(200)]
    s = spark.createDataFrame(rows, "query_id string, plan_id string, metric string, score double")
    for r in conformal.leave_one_query_out(s, 0.2).collect():
        rest = sorted(x[3] for x in rows if x[0] != r["query_id"])
        assert r["q"] == rest[math.ceil((len(rest) + 1) * 0.8) - 1]


def test_coverage_holds_on_synthetic_pool(spark):
    rng = np.random.default_rng(3)
    rows = [(f"q{i % 60}", f"p{i}", float(c), float(c * rng.lognormal(0, 0.3)), 1.0, 1.0) for i, c in enumerate(rng.uniform(1, 5, 600))]
    p = spark.createDataFrame(rows, "query_id string, plan_id string, pred_cost double, actual_cost double, pred_latency double, actual_latency double")
    parts = conformal.query_split(p, (("a", 0.5), ("b", 0.5)))
    q = conformal.quantiles(conformal.residuals(parts.where("part = 'a'"), signed=True), [0.1])
    got = {r["metric"]: r["coverage"] for r in conformal.coverage(parts.where("part = 'b'"), q).collect()}
    assert 0.8 < got["cost"] <= 1 and got["latency"] == 1.0
    bounded = conformal.with_quantiles(p, q, 0.1)
    assert bounded.where("cost_upper < cost_lower").count() == 0


def test_least_squares_recovers_weights(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0.1, 5, (60, 3))
    y = 0.5 + x @ np.array([1.5, 1.2, 1.1])
    df = spark.createDataFrame([(f"q{i % 9}", f"p{i}", *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "query_id string, plan_id string, cpu_cost double, io_cost double, shuffle_cost double, actual_cost double")
    assert np.allclose(calibration.fit_cost_weights(df), (0.5, 1.5, 1.2, 1.1), atol=1e-6)
    h = calibration.holdout(df)
    assert h.fitted["mape"] < 1e-4 < h.raw["mape"] and h.n_train + h.n_test == 60
    with pytest.raises(ValueError):
        calibration.fit_cost_weights(df.limit(3))
    pred = cost.calibrated(df, (-100.0, 1.0, 1.0, 1.0))
    assert pred.where("pred_cost < 0").count() == 0


def test_lines_of_one_and_of_equal_rows(spark):
    df = spark.createDataFrame([("a", 2.0, 4.0), ("b", 1.0, 2.0), ("b", 1.0, 4.0), ("c", 1.0, 3.0), ("c", 2.0, 5.0)], "k string, p double, y double")
    got = {r["k"]: (r["scale"], r["bias"]) for r in calibration.fit_lines(df, ["k"], "p", "y").collect()}
    assert got["a"] == (2.0, 0.0) and got["b"] == (1.0, 2.0) and got["c"] == pytest.approx((2.0, 1.0))


def test_samples_refuse_other_queries(spark):
    p = pool(spark, [("q", "a", 1.0, 1.0)])
    t = lambda q, c: spark.createDataFrame([(q, "a", c)], "query_id string, plan_id string, actual_cost double")
    assert calibration.samples(p, t("q", 2.0)).count() == 1 and calibration.samples(p, t("q", None)).count() == 0
    with pytest.raises(ValueError):
        calibration.samples(p, t("other", 2.0)).count()


def test_folds_keep_queries_whole_and_even(spark):
    df = spark.range(500).selectExpr("id % 23 as query_id", "id")
    got = calibration.folds(df, 5).select("query_id", "fold").distinct().collect()
    sizes = np.bincount([r["fold"] for r in got])[1:]
    assert len(got) == 23 and sorted(sizes) == [4, 4, 5, 5, 5]


def test_learned_models(spark, sf):
    rows = spark.read.parquet(f"{sf}/phase1_benchmark.parquet").where("query_id is not null and true_latency > 0")
    ridge = calibration.fit_log_ridge(rows, "true_latency")
    by = evaluation.spearman(ridge.predict(rows), ["strategy"], "prediction", "true_latency").agg(F.avg("rho")).first()[0]
    assert by > 0.5
    few = ("scan_bytes", "shuffle_bytes", "exchange_count", "sort_count")
    model = calibration.fit_gbt(rows, "true_latency", few, rounds=5)
    assert calibration.predict_gbt(model, rows, few).where("prediction <= 0 or prediction is null").count() == 0
    rank = calibration.fit_ranking(rows, "true_latency", few)
    by = evaluation.spearman(rank.predict(rows), ["query_id"], "prediction", "true_latency").where("n >= 5").agg(F.avg("rho")).first()[0]
    assert len(rank.weights) == 4 and by > 0.5
    told = rank.predict(rows).agg(F.avg("prediction").alias("p"), F.avg("true_latency").alias("y"), F.min("prediction").alias("least")).first()
    assert told["least"] >= 0.001 and told["p"] == pytest.approx(told["y"], rel=0.2)
    one = calibration.fit_ranking(rows.limit(1), "true_latency", few)
    assert one.weights == calibration.fit_log_ridge(rows.limit(1), "true_latency", few).weights[1:]


def test_pairs_of_small_and_large_queries(spark):
    df = spark.range(40).selectExpr("'small' as query_id", "cast(id + 1 as double) as y", "cast(id as double) as x").union(spark.range(1000).selectExpr("'large'", "cast(id + 1 as double)", "cast(id as double)"))
    pairs = calibration.query_pairs(df, "y", ["x"], all_pairs=40)
    assert pairs.where("x >= 0").count() == 0
    n = pairs.count() - 40 * 39 // 2
    assert n == sum(1000 - 2**i for i in range(10))


def test_model_store_keeps_versions(tmp_path):
    paths = [calibration.save_model(str(tmp_path), "m", {"w": i}) for i in range(2)]
    assert [calibration.load_model(p)["w"] for p in paths] == [0, 1] and len((tmp_path / "manifest.jsonl").read_text().splitlines()) == 2


def test_rank_statistics(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 8, 60), rng.integers(0, 8, 60)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    tau = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(60) for j in range(i)) / (60 * 59 / 2)
    assert evaluation.kendall(df, ["k"], "x", "y").first()["tau"] == pytest.approx(tau)
    flat = spark.createDataFrame([("k", 1.0, 1.0), ("k", 1.0, 2.0), ("l", 1.0, 1.0)], "k string, x double, y double")
    assert {r["k"]: r["rho"] for r in evaluation.spearman(flat, ["k"], "x", "y").collect()} == {"k": 0.0, "l": 0.0}
    assert {r["k"]: r["tau"] for r in evaluation.kendall(flat, ["k"], "x", "y").collect()} == {"k": 0.0, "l": 0.0}


def test_wilcoxon_and_p_values(spark):
    df = spark.createDataFrame([("k", float(a), 0.0) for a in (1, 2, 3, -4, 5, 0)], "k string, x double, y double")
    w = evaluation.wilcoxon(df, ["k"], "x", "y").first()
    assert (w["w_plus"], w["w_minus"], w["ties"], w["n"], w["losses"], w["wins"]) == (11.0, 4.0, 1, 5, 4, 1)
    assert evaluation.exact_wilcoxon_p(5, 0) == 2 / 32 and evaluation.exact_wilcoxon_p(3, 3) == 1.0
    assert evaluation.normal_p(None) == 1.0 and evaluation.normal_p(1.959964) == pytest.approx(0.05, abs=1e-5)


def test_bootstrap_holds_the_median(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(101)], "k string, v double")
    r = evaluation.bootstrap_median(df, ["k"], "v", rounds=200).first()
    assert r["low"] <= r["median"] == 50.0 <= r["high"] and 5 < r["high"] - r["low"] < 60
    assert evaluation.bootstrap_median(df, ["k"], "v", rounds=200).first() == r


def test_bootstrap_equals_resampling(spark):
    rng = np.random.default_rng(7)
    values = {k: rng.lognormal(0, 1, n) for k, n in (("odd", 301), ("even", 300), ("one", 1))}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("odd", None), ("odd", math.nan)], "k string, v double")
    for r in evaluation.bootstrap_median(df, ["k"], "v").collect():
        v = values[r["k"]]
        want = np.percentile([np.median(rng.choice(v, len(v))) for _ in range(4000)], [2.5, 97.5])
        assert r["n"] == len(v) and r["median"] == pytest.approx(np.median(v)) and (r["low"], r["high"]) == pytest.approx(tuple(want), rel=0.03)


def test_tau_beyond_two_to_the_eighteen(spark):
    df = spark.range(300_000).selectExpr("'k' as k", "cast(id as double) as x", "cast(-id as double) as y")
    assert evaluation.kendall(df, ["k"], "x", "y").first()["tau"] == -1.0


def test_equivalence_of_results(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-9), ("y", 2.0)], "k string, v double")
    assert evaluation.same_results(a, b, ["k"], "v").first()["equal"]
    assert not evaluation.same_results(a, b.where("k = 'x'"), ["k"], "v").first()["equal"]
    assert not evaluation.same_results(a.union(a), b, ["k"], "v").first()["equal"]


def test_positions_and_totals_across_cells(spark):
    df = spark.range(1000).selectExpr("id % 2 as k", "cast(id * 7919 % 1009 as double) as v", "id")
    got = numbered(df, ["k"], ["v", "id"], F.floor(F.col("v") / 10)).orderBy("k", "v", "id").collect()
    assert [r["position"] for r in got] == [*range(1, 501)] * 2
    total = running_total(df, ["k"], ["v", "id"], "v", F.floor(F.col("v") / 10), "before").orderBy("k", "v", "id").collect()
    assert total[0]["before"] == 0 and total[499]["before"] == sum(r["v"] for r in total[:499])
