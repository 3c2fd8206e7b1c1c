"""Summaries of measured plans and planning runs; redelivered rows count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costplan.operators import calibration
from costplan.operators.pool import SQL, plan_pool
from costplan.plans import plantext
from costplan.queries_pool import _evaluated, _MB, _q_sql, r6
from costplan.run import experiments
from costplan.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query and, if SQL can express it, its oracle."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return wrap


def _medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "exhaustive_prescoring_q05_plan_medians").distinct()
    return m.where(F.col("error").isNull() & F.col("result_equivalent") & (F.col("median_execution_s") > 0) & ~F.isnan("median_execution_s"))


_USABLE = "m AS (SELECT DISTINCT * FROM exhaustive_prescoring_q05_plan_medians WHERE error IS NULL AND result_equivalent AND median_execution_s > 0 AND NOT isnan(median_execution_s))"


@query("WITH " + _USABLE + r" SELECT regexp_replace(regexp_replace(strategy, '^join_order_', ''), '_(broadcast|merge|shuffle_hash)$', '') AS logical_order, count(*) AS n_rows, count(DISTINCT strategy) AS n_strategies, round(min(median_execution_s), 6) AS best_s FROM m GROUP BY 1")
def join_order_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy variants and the best median of each logical join order."""
    by = _medians(spark, sf_dir).groupBy(plantext.logical_order(F.col("strategy")).alias("logical_order"))
    return by.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("strategy").alias("n_strategies"), F.round(F.min("median_execution_s"), 6).alias("best_s"))


_LOSS = "count(*) AS n_plans, count(*) FILTER ({k}) AS n_kept, round(min({x}), 6) AS best, round(min({x}) FILTER ({k}), 6) AS best_kept, round((min({x}) FILTER ({k}) / min({x}) - 1) * 100, 6) AS loss_percent, coalesce(min({x}) FILTER ({k}) <= min({x}), false) AS best_retained"


@query("WITH " + _USABLE + " SELECT batch_no, " + _LOSS.format(x="median_execution_s", k="strategy LIKE '%\\_broadcast' ESCAPE '\\'") + " FROM m GROUP BY batch_no")
def broadcast_pruning_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch: what keeping only broadcast variants loses against the best of all plans."""
    loss = experiments.pruning_loss(_medians(spark, sf_dir), ["batch_no"], "median_execution_s", F.col("strategy").endswith("_broadcast"))
    return loss.withColumns({c: F.round(c, 6) for c in ("best", "best_kept", "loss_percent")})


@query("""WITH c AS (SELECT DISTINCT * FROM beam_scorer_multiscenario_candidates WHERE shared_median_latency_seconds > 0 AND NOT isnan(shared_median_latency_seconds)),
b AS (SELECT query_id, min(shared_median_latency_seconds) AS best FROM c GROUP BY 1)
SELECT c.query_id, mode, count(DISTINCT physical_fingerprint) AS n_plans, round(min(shared_median_latency_seconds), 6) AS best_of_mode, round((min(shared_median_latency_seconds) / any_value(best) - 1) * 100, 6) AS loss_percent FROM c JOIN b ON b.query_id IS NOT DISTINCT FROM c.query_id GROUP BY 1, 2""")
def beam_mode_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best plan of each search mode against the best of all modes, per query."""
    c = table(spark, sf_dir, "beam_scorer_multiscenario_candidates").distinct().where((F.col("shared_median_latency_seconds") > 0) & ~F.isnan("shared_median_latency_seconds"))
    by = c.groupBy("query_id", "mode").agg(F.countDistinct("physical_fingerprint").alias("n_plans"), F.min("shared_median_latency_seconds").alias("best_of_mode"))
    best = by.groupBy(F.col("query_id").alias("q")).agg(F.min("best_of_mode").alias("best"))
    joined = by.join(best, F.col("query_id").eqNullSafe(F.col("q")))
    return joined.select("query_id", "mode", "n_plans", F.round("best_of_mode", 6).alias("best_of_mode"), F.round((F.col("best_of_mode") / F.col("best") - 1) * 100, 6).alias("loss_percent"))


@query("""WITH r AS (SELECT DISTINCT * FROM planning_runs) SELECT table_count, lower(trim(search_mode)) AS mode, CAST(beam_width AS VARCHAR) AS width, candidate_workers, count(*) AS n_runs, round(quantile_cont(total_planning_seconds, 0.5), 6) AS median_s, round(min(total_planning_seconds), 6) AS min_s,
round(max(total_planning_seconds), 6) AS max_s, round(quantile_cont(sql_variant_count, 0.5), 6) AS median_variants FROM r GROUP BY 1, 2, 3, 4""")
def planning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planning time by number of tables, search mode, width and workers."""
    r = table(spark, sf_dir, "planning_runs").distinct()
    by = r.groupBy("table_count", F.lower(F.trim("search_mode")).alias("mode"), F.col("beam_width").cast("string").alias("width"), "candidate_workers")
    s = lambda f, c, n: F.round(f(c), 6).alias(n)
    half = lambda c: F.percentile(c, F.lit(0.5))
    t = "total_planning_seconds"
    return by.agg(F.count(F.lit(1)).alias("n_runs"), s(half, t, "median_s"), s(F.min, t, "min_s"), s(F.max, t, "max_s"), s(half, "sql_variant_count", "median_variants"))


@query("""WITH r AS (SELECT DISTINCT run_id, query_id, physical_fingerprint, latency_seconds AS x FROM beam_quality_runs WHERE latency_seconds IS NOT NULL AND NOT isnan(latency_seconds))
SELECT query_id, physical_fingerprint, count(*) AS n_runs, round(avg(x), 6) AS mean_s, round(quantile_cont(x, 0.5), 6) AS median_s, round(min(x), 6) AS min_s, round(max(x), 6) AS max_s FROM r GROUP BY 1, 2""")
def repeated_execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, mean, median and range of each plan's latency."""
    r = table(spark, sf_dir, "beam_quality_runs").select("run_id", "query_id", "physical_fingerprint", "latency_seconds").distinct().where(F.col("latency_seconds").isNotNull() & ~F.isnan("latency_seconds"))
    x = "latency_seconds"
    return r.groupBy("query_id", "physical_fingerprint").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.avg(x), 6).alias("mean_s"), F.round(F.percentile(x, F.lit(0.5)), 6).alias("median_s"), F.round(F.min(x), 6).alias("min_s"), F.round(F.max(x), 6).alias("max_s"))


@query("""WITH r AS (SELECT DISTINCT * FROM q10_validation_runs) SELECT phase, count(*) AS n_runs, count(*) FILTER (error IS NOT NULL) AS n_failed, count(*) FILTER (error IS NULL AND NOT result_equivalent) AS n_wrong, count(DISTINCT fingerprint) AS n_plans, count(DISTINCT row_count) AS n_row_counts FROM r GROUP BY phase""")
def validation_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, failures and results that differ from the reference, per phase."""
    r = table(spark, sf_dir, "q10_validation_runs").distinct()
    return r.groupBy("phase").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.count_if(F.col("error").isNull() & ~F.col("result_equivalent")).alias("n_wrong"), F.countDistinct("fingerprint").alias("n_plans"), F.countDistinct("row_count").alias("n_row_counts"))


_FRONT = "NOT EXISTS (SELECT 1 FROM f b WHERE b.multiplier=a.multiplier AND b.query_id=a.query_id AND b.pred_cost<=a.pred_cost AND b.pred_latency<=a.pred_latency AND (b.pred_cost<a.pred_cost OR b.pred_latency<a.pred_latency))"


@query("WITH" + SQL + f""", f AS (SELECT p.*, m.multiplier FROM (SELECT *, min(pred_cost) OVER (PARTITION BY query_id) AS least FROM plan_pool) p CROSS JOIN (VALUES (1.0::DOUBLE),(1.5::DOUBLE),(3.0::DOUBLE)) AS m(multiplier) WHERE pred_cost<=m.multiplier*least),
fr AS (SELECT * FROM f a WHERE {_FRONT}), ch AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY multiplier, query_id ORDER BY pred_latency, pred_cost, plan_id)=1)
SELECT multiplier, (SELECT count(*) FROM f WHERE f.multiplier=ch.multiplier) AS n_feasible, (SELECT count(*) FROM fr WHERE fr.multiplier=ch.multiplier) AS n_frontier, count(*) AS n_queries, round(avg(pred_cost),4) AS mean_cost, round(avg(pred_latency),6) AS mean_latency FROM ch GROUP BY multiplier""")
def budget_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = experiments.budget_sweep(plan_pool(spark, sf_dir), (1.0, 1.5, 3.0))
    return s.withColumns({"mean_cost": F.round("mean_cost", 4), "mean_latency": F.round("mean_latency", 6)})


@query(_MB + """, p AS (SELECT a.multiplier, a.strategy_name, CASE WHEN abs(a.latency-b.latency)<=1e-9*greatest(abs(a.latency),abs(b.latency)) THEN 0.0 ELSE a.latency-b.latency END AS d FROM ev a JOIN ev b ON a.query_id=b.query_id AND a.multiplier=b.multiplier AND b.strategy_name='oracle' WHERE a.strategy_name<>'oracle')
SELECT multiplier, strategy_name, count(*) FILTER (d<0) AS wins, count(*) FILTER (d>0) AS losses, count(*) FILTER (d=0) AS ties, round(quantile_cont(d,0.5),6) AS median_diff FROM p GROUP BY 1, 2""")
def paired_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins, losses and ties of each strategy against the oracle."""
    t = experiments.paired_tests(_evaluated(spark, sf_dir), "oracle", ["multiplier"], ["query_id"])
    return t.select("multiplier", "strategy_name", "wins", "losses", "ties", F.round("median_diff", 6).alias("median_diff"))


@query()
def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with rank sums, p and Holm-adjusted p."""
    return experiments.paired_tests(_evaluated(spark, sf_dir), "oracle", ["multiplier"], ["query_id"])


@query(_q_sql(True, (0.05, 0.1, 0.2), "infinity") + """, st AS (SELECT *, exp((2*(('0x' || substr(sha256(CAST(query_id AS VARCHAR) || '|' || CAST(plan_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0::DOUBLE)-1)*ln(1.2::DOUBLE)) AS f FROM plan_pool),
lo AS (SELECT 'cost' AS metric, actual_cost*f AS a, pred_cost AS p FROM st UNION ALL SELECT 'latency', actual_latency*f, pred_latency FROM st)
SELECT metric, delta, count(*) AS n, round(avg(CAST(a<=p*exp(q) AS DOUBLE)),6) AS coverage, round(avg(1-CAST(a<=p*exp(q) AS DOUBLE)),6) AS violation_rate, round(avg((p*exp(q)-a)/a),6) AS mean_margin FROM lo JOIN qq USING (metric) GROUP BY metric, delta""")
def stressed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of clean bounds when every plan is slower or faster by its own hashed factor."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("query_id").cast("string"), F.col("plan_id").cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return r6(experiments.stress(plan_pool(spark, sf_dir), F.exp((2 * u - 1) * F.log(F.lit(1.2))), (0.05, 0.1, 0.2)), "coverage", "violation_rate", "mean_margin")


@query("WITH" + SQL + " SELECT query_id, plan_id, round(abs(pred_cost-actual_cost),6) AS cost_error, round(abs(pred_cost-actual_cost)/actual_cost,6) AS cost_relative, round(abs(pred_latency-actual_latency),6) AS latency_error, round(abs(pred_latency-actual_latency)/actual_latency,6) AS latency_relative FROM plan_pool")
def prediction_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan_pool(spark, sf_dir)
    v = calibration.validated(p.select("query_id", "plan_id", "pred_cost", "pred_latency"), p.select("query_id", "plan_id", "actual_cost", "actual_latency"))
    return v.select("query_id", "plan_id", *[F.round(c, 6).alias(c) for c in ("cost_error", "cost_relative", "latency_error", "latency_relative")])


@query("WITH" + SQL + ", v AS (SELECT DISTINCT query_id, round(pred_cost,4) AS c FROM plan_pool) SELECT count(*) AS n_distinct, count(DISTINCT query_id) AS n_queries FROM v")
def distinct_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different predicted costs the plans of a query get, summed over queries."""
    v = plan_pool(spark, sf_dir).select("query_id", F.round("pred_cost", 4).alias("c")).distinct()
    return v.agg(F.count(F.lit(1)).alias("n_distinct"), F.countDistinct("query_id").alias("n_queries"))


@query("WITH" + SQL + """, d AS (SELECT strategy, pred_latency, cume_dist() OVER (PARTITION BY strategy ORDER BY pred_latency) AS s FROM plan_pool) SELECT DISTINCT strategy, pred_latency, round(s,6) AS share FROM d""")
def latency_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empirical distribution (steps i/n) of predicted latency per strategy, from counts of distinct values."""
    from costplan.operators.ordered import running_total

    r = plan_pool(spark, sf_dir).groupBy("strategy", "pred_latency").agg(F.count(F.lit(1)).alias("n"))
    total = r.groupBy("strategy").agg(F.sum("n").alias("all"))
    at = running_total(r, ["strategy"], ["pred_latency"], "n", F.floor(F.col("pred_latency") / 10), "before")
    return at.join(total, "strategy").select("strategy", "pred_latency", F.round((F.col("before") + F.col("n")) / F.col("all"), 6).alias("share"))


@query()
def calibration_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of raw and calibrated costs on held-out queries of phase1_benchmark (component costs from its sizes)."""
    rows = table(spark, sf_dir, "phase1_benchmark").distinct().where("query_id is not null and true_cost > 0")
    parts = rows.select("query_id", "plan_id", (F.col("num_nodes") * 1.0).alias("cpu_cost"), (F.col("scan_bytes") / 2**20).alias("io_cost"), (F.col("shuffle_bytes") / 2**20).alias("shuffle_cost"), F.col("true_cost").alias("actual_cost")).dropna()
    h = calibration.holdout(parts)
    return spark.createDataFrame([(k, h.n_test, float(e["mae"]), float(e["rmse"]), float(e["mape"])) for k, e in (("raw", h.raw), ("calibrated", h.fitted))], "model string, n_test long, mae double, rmse double, mape double")
