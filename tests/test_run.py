import json
import threading
import time

import pytest

from costplan.operators.cost import Pricing, load_pricing
from costplan.plans.shape import QueryRequest
from costplan.planner import Planner
from costplan.run.adaptive import AdaptiveConfig, AdaptiveController, accuracy_error, cheaper_replanner, degraded
from costplan.run.runner import Executor, PlanRunner, PlanToRun, RunSpec, background_load, was_cancelled
from costplan.session import temporary_conf
from costplan.sources import logs, profiles, star, tables, workload
from costplan.streaming.telemetry import read_stream, rolled


def test_temporary_conf_restores_and_unsets(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    with temporary_conf(spark, {"spark.sql.shuffle.partitions": 7, "spark.costplan.test": True}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "7"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.costplan.test", None) is None


def test_executor_measures_and_logs(spark, tmp_path):
    log = logs.JsonLog(str(tmp_path / "log.jsonl"))
    o = Executor(spark, log=log).execute(PlanToRun("Q", "P", "SELECT id % 3 AS k, count(*) AS n FROM range(0, 100000, 1, 4) GROUP BY 1", estimated_cost=1.0))
    assert o.status == "ok" and o.totals.source == "status_store" and o.totals.shuffled_bytes > 0 and o.actual_cost > 0
    assert Executor(spark, log=log).execute(PlanToRun("Q", "P2", "SELECT * FROM no_such_table")).status == "failed"
    read = logs.read_executions(spark, log.path).orderBy("started_at").collect()
    assert [r["status"] for r in read] == ["ok", "failed"] and read[1]["actual_cost"] is None


def test_executor_without_session_simulates():
    o = Executor(None).execute(PlanToRun("Q", "P", "SELECT 1", estimated_cost=2.0), fraction=0.25)
    assert o.status == "simulated" and o.actual_cost == 0.5


def test_overrun_cancels_then_degrades(spark):
    plan = PlanToRun("Q", "P1", "SELECT sum(hash(id, id + 1)) FROM range(0, 4000000000, 1, 200)", estimated_cost=5.0, budget=1e-9)
    began = time.monotonic()
    small = PlanToRun("Q", "P2", "SELECT sum(id) FROM range(0, 1000, 1, 2)", estimated_cost=1.0)
    o = AdaptiveController(Executor(spark), AdaptiveConfig(max_replans=1), cheaper_replanner([plan, small])).run(plan)
    assert o.status == "ok" and o.replans == 1 and o.plan_id == "P2" and o.wasted_cost > 0 and o.actual_cost >= o.wasted_cost
    assert time.monotonic() - began < 60


def test_no_budget_is_strict(spark):
    assert AdaptiveController(Executor(spark)).run(PlanToRun("Q", "P", "SELECT 1")).mode == "strict"


def test_replanner_needs_a_cheaper_untried_plan():
    pool = [PlanToRun("Q", p, "", estimated_cost=c) for p, c in (("a", 3.0), ("b", 2.0), ("c", 1.0))] + [PlanToRun("R", "d", "", estimated_cost=0.1)]
    replan = cheaper_replanner(pool)
    assert replan(pool[0], {"a"}).plan_id == "c" and replan(pool[0], {"a", "c"}).plan_id == "b" and replan(pool[2], {"c"}) is None


def test_degraded_and_accuracy(spark):
    n = degraded(spark.range(10000), 0.1, 1).count()
    assert accuracy_error(10000, n, 0.1) < 20 and accuracy_error(0, 0, 0.1) == 0
    with pytest.raises(ValueError):
        degraded(spark.range(1), 0.0, 1)


def test_cancel_classification():
    assert was_cancelled(Exception("[SPARK_JOB_CANCELLED] Job 1 cancelled")) and not was_cancelled(Exception("boom"))


def test_runner_records_valid_telemetry(spark, tmp_path):
    log = logs.JsonLog(str(tmp_path / "t.jsonl"), check=True)
    runs = PlanRunner(spark, 1, 2, "cold", log=log).run(RunSpec("Q", "P", "default", "SELECT count(*) FROM range(1000)", "x", {"spark.sql.adaptive.enabled": "false"}))
    assert len(runs) == 2 and all(not logs.problems(r) for r in runs) and runs[0]["plan_verified"] is False
    df = logs.read_telemetry(spark, log.path)
    assert df.where("size(problems) = 0").count() == 2
    assert PlanRunner(spark, 0, 3).run(RunSpec("Q", "P", "default", "SELECT broken FROM"))[0]["status"] == "failed"


def test_telemetry_problems():
    good = {"query_id": "q", "plan_id": "p", "strategy": "s", "latency_ms": 1.0, "bytes_scanned": 1.0, "bytes_shuffled": 1.0, "executor_seconds": 1.0, "run_number": 1, "cache_state": "warm", "aqe_enabled": False, "cbo_enabled": False, "num_cores": 1, "memory_gb": 1.0, "seed": None, "timestamp": 1.0}
    assert logs.problems(good) == []
    without = dict(good)
    del without["seed"]
    for bad in (without, {**good, "cache_state": "lukewarm"}, {**good, "run_number": 0}, {**good, "latency_ms": -1.0}, {**good, "num_cores": True}, {**good, "latency_ms": None}, {**good, "memory_gb": float("inf")}):
        assert logs.problems(bad)


def test_planner_budgets(spark, sf):
    tables.register(spark, sf)
    sql = workload.star_sql(4)
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    with temporary_conf(spark, off):
        wide = Planner(spark).plan(QueryRequest("Q", sql, 1.0))
        tight = Planner(spark, infeasible="formal_refusal").plan(QueryRequest("Q", sql, 1e-12))
        fallback = Planner(spark).plan(QueryRequest("Q", sql, 1e-12))
    assert wide.feasible and wide.chosen.plan_id in wide.frontier and wide.chosen.latency == min(s.latency for s in wide.scored)
    assert not tight.feasible and tight.chosen is None
    assert fallback.chosen.cost_upper == min(s.cost_upper for s in fallback.scored)
    with pytest.raises(ValueError):
        tight.to_run()


def test_background_load_ends(spark):
    with background_load(spark, "SELECT count(*) FROM range(1000)", 1):
        assert spark.range(5).count() == 5
    assert threading.active_count() < 50


def test_star_generator_and_catalog(spark, tmp_path):
    out = str(tmp_path / "star")
    assert star.ensure(spark, out, 0.001, 1.2) and not star.ensure(spark, out, 0.001, 1.2)
    assert star.sizes(2.0)["store_sales"] == 400_000
    tables.register(spark, out)
    top = spark.sql("SELECT ss_item_sk, count(*) AS n FROM store_sales GROUP BY 1 ORDER BY n DESC LIMIT 1").first()
    assert top["ss_item_sk"] == 0 and top["n"] > 10
    assert len(workload.sales_workload()) == 24 and spark.sql(workload.sales_sql(10, 1900, 2100)).first()["n_rows"] == 200
    with pytest.raises(FileNotFoundError):
        tables.register(spark, out, ["nothing"])
    with pytest.raises(ValueError):
        tables.register(spark, out, mode="other")
    tables.register(spark, out, ["store"], "table")
    assert tables.analyze(spark, "default.store") == 12 and tables.folder_bytes(spark, f"{out}/store") > 0
    told, actual = tables.make_stale(spark, "stale_store", f"{out}/store", f"{out}/promotion", str(tmp_path))
    assert told == 12 and actual == 300
    for t in ("store", "stale_store"):
        spark.sql(f"DROP TABLE default.{t}")


def test_delimited_and_sql_folder(spark, tmp_path):
    (tmp_path / "d.dat").write_text("1|x|\n2||\nbad|y|\n")
    df = tables.read_delimited(spark, str(tmp_path / "d.dat"), ["k", "v", "end"], {"k": "int"}, ["k", "v"])
    assert sorted((r["k"] or 0, r["v"]) for r in df.collect()) == [(0, "y"), (1, "x"), (2, None)] or df.count() == 3
    (tmp_path / "q01.sql").write_text("SELECT * FROM a JOIN b ON a.id = b.id;\n")
    q = workload.load_sql(spark, str(tmp_path))[0]
    assert (q.query_id, q.n_tables, q.family) == ("Q01", 2, "small") and not q.sql.endswith(";")
    assert workload.select_queries([q], ["q01"]) == [q] and workload.select_queries([q], families=["large"]) == []


def test_samples_results_measurements(spark, tmp_path):
    row = ("p", "q", 1.0, 2.0, 3.0, 6.0, 7.0, 1.0, 2.0)
    df = spark.createDataFrame([row], logs.CALIBRATION)
    logs.append_samples(df, str(tmp_path / "s"))
    logs.append_samples(df, str(tmp_path / "s"))
    assert [tuple(r) for r in logs.load_samples(spark, str(tmp_path / "s")).collect()] == [row, row]
    logs.write_results(spark.sql("SELECT 1 AS a, array(1, 2) AS b"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first()["b"] == "[1,2]"
    cache = logs.MeasurementCache(str(tmp_path / "m"))
    assert not cache.has("Q")
    cache.save("Q", [{"query_id": "Q", "plan_id": "P", "run": 1, "latency": float("nan"), "cost": 1.0}])
    assert cache.has("Q") and cache.load(spark).first()["latency"] is None
    info = logs.write_run_info(spark, str(tmp_path / "i.json"), {"x": float("inf")})
    assert json.loads((tmp_path / "i.json").read_text()) == info


def test_pricing_and_profiles(tmp_path, monkeypatch):
    (tmp_path / "p.json").write_text(json.dumps({"cpu": {"cost_per_vcore_hour": 1.0}}))
    assert load_pricing(str(tmp_path / "p.json")).vcore_hour == 1.0 and load_pricing() == Pricing()
    (tmp_path / "e.yaml").write_text("shared:\n  seed: 7\n  conf: {spark.sql.adaptive.enabled: false}\nprofiles:\n  x:\n    conf: {spark.sql.shuffle.partitions: 3}\n")
    env = profiles.load_environment(str(tmp_path / "e.yaml"), "x")
    assert env.seed == 7 and env.conf == {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "3"}
    monkeypatch.setenv("COSTPLAN_PROFILE", "cluster")
    assert profiles.load_environment().master is None
    with pytest.raises(KeyError):
        profiles.load_environment(str(tmp_path / "e.yaml"), "y")


def test_streaming_rollup(spark, tmp_path):
    base = {"query_id": "q", "plan_id": "p", "strategy": "s", "latency_ms": 10.0, "bytes_scanned": 1.0, "bytes_shuffled": 1.0, "executor_seconds": 1.0, "run_number": 1, "cache_state": "warm", "aqe_enabled": False, "cbo_enabled": False, "num_cores": 1, "memory_gb": 1.0, "seed": 1, "status": "ok", "actual_cost": 0.5}
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "a.json", "w") as f:
        for t, extra in ((0.0, {}), (10.0, {}), (20.0, {"run_number": 0}), (4000.0, {}), (90000.0, {})):
            f.write(json.dumps({**base, "timestamp": t, **extra}) + "\n")
    q = rolled(read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("rolled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["window_start"].timestamp(): r["runs"] for r in spark.table("rolled").collect()}
    assert list(got.values()) and max(got.values()) == 2
