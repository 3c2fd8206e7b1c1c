"""Queries over the canonical plan pool: pricing, prediction, selection, bounds, calibration, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costplan.functions import geometric_mean
from costplan.operators import calibration, conformal, cost, evaluation, frontier, selection
from costplan.operators.pool import BUDGET_SQL, SQL, budgeted, plan_pool
from costplan.session import table, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
POOL = "WITH" + SQL
BUDGETED = POOL + "," + BUDGET_SQL


def query(sql: str | None = None, name: str | None = None):
    """Registers a query and, if SQL can express it, its oracle."""

    def wrap(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return wrap


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Pricing and prediction ---------------------------------------------------------------------------


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: resources derived from its items, as if it were a plan's run."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,0)")).cast("double").alias("q"))
    return items.select(F.col("l_orderkey").alias("plan_id"), "n", "q", (F.col("q") * 3.5).alias("cpu_seconds"), (F.col("n") * 1073741824.0).alias("scanned_bytes"), (F.col("q") * 1048576.0).alias("shuffled_bytes"))


RESOURCES = """WITH r AS (SELECT l_orderkey AS plan_id, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,0))) AS DOUBLE) AS q FROM lineitem GROUP BY 1),
s AS (SELECT plan_id, n, q, q*3.5::DOUBLE AS cpu, n*1073741824.0::DOUBLE AS scanned, q*1048576.0::DOUBLE AS shuffled FROM r)"""


@query(RESOURCES + """ SELECT plan_id, round(cpu/3600*0.048,6) AS cpu_cost, round(scanned/1073741824*0.005,6) AS io_cost, round(shuffled/1073741824*0.010,6) AS shuffle_cost,
round(cpu/3600*0.048::DOUBLE + scanned/1073741824*0.005::DOUBLE + shuffled/1073741824*0.010::DOUBLE,6) AS total_cost FROM s""")
def pricing_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cost.price(_resources(spark, sf_dir), cost.Pricing())
    return r6(out.select("plan_id", "cpu_cost", "io_cost", "shuffle_cost", "total_cost"), "cpu_cost", "io_cost", "shuffle_cost", "total_cost")


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural rows made from the orders: counts from key arithmetic, sizes from prices."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    count = lambda m, a=0: (k % m + a).cast("int")
    return o.select(
        k.alias("plan_id"), count(5).alias("joins"), (count(7) + count(3)).alias("exchanges"), count(3).alias("broadcast_exchanges"), count(4).alias("sorts"), count(3, 1).alias("aggregates"), count(6).alias("filters"),
        count(5, 1).alias("scans"), count(9, 3).alias("depth"), F.element_at(F.array(*map(F.lit, ("BroadcastHashJoin", "ShuffledHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "none"))), count(5, 1)).alias("actual_strategy"),
        F.when(k % 11 == 0, None).otherwise(F.col("o_totalprice") * 4096).alias("input_bytes"), F.when(k % 13 == 0, None).otherwise(F.col("o_totalprice") * 1024).alias("intermediate_bytes"),
    )


STRUCTURES = """WITH t AS (SELECT o_orderkey AS plan_id, o_orderkey%5 AS j, o_orderkey%7+o_orderkey%3 AS e, o_orderkey%3 AS be, o_orderkey%4 AS so, o_orderkey%3+1 AS ag, o_orderkey%6 AS fi, o_orderkey%5+1 AS sc, o_orderkey%9+3 AS de,
  CASE WHEN o_orderkey%11=0 THEN NULL ELSE o_totalprice*4096 END AS ib, CASE WHEN o_orderkey%13=0 THEN NULL ELSE o_totalprice*1024 END AS mb,
  CASE o_orderkey%5 WHEN 0 THEN 0.75::DOUBLE WHEN 1 THEN 1.10::DOUBLE WHEN 3 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS f FROM orders),
w AS (SELECT *, 0.35::DOUBLE*j+0.20::DOUBLE*e+0.08::DOUBLE*be+0.15::DOUBLE*so+0.12::DOUBLE*ag+0.03::DOUBLE*fi+0.05::DOUBLE*sc+0.02::DOUBLE*de AS work,
  CASE WHEN ib>0 THEN least(greatest(ib/67108864.0::DOUBLE,0.25),1000.0) ELSE 1.0 END AS ws, CASE WHEN mb>0 THEN least(mb/67108864.0::DOUBLE,1000.0) ELSE 0.0 END AS xs FROM t),
c AS (SELECT *, greatest(0.0,(0.25::DOUBLE+work*ws+0.2::DOUBLE*work*xs)*f) AS cpu, CASE WHEN ib>0 THEN ib ELSE 67108864.0::DOUBLE*greatest(1,sc) END AS scanned FROM w),
p AS (SELECT *, scanned*(greatest(0,e-be)+0.25::DOUBLE*be) AS shuffled, greatest(0.001::DOUBLE, cpu+0.15::DOUBLE*e+0.10::DOUBLE*so+0.05::DOUBLE*ag) AS lat FROM c)"""


@query(STRUCTURES + """ SELECT plan_id, round(cpu,6) AS cpu_seconds, round(scanned,2) AS scanned_bytes, round(shuffled,2) AS shuffled_bytes, round(lat,6) AS pred_latency,
round(cpu/3600*0.048::DOUBLE+scanned/1073741824*0.005::DOUBLE+shuffled/1073741824*0.010::DOUBLE,6) AS total_cost FROM p""")
def predict_cpu_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cost.predict(_structures(spark, sf_dir))
    return out.select("plan_id", F.round("cpu_seconds", 6).alias("cpu_seconds"), F.round("scanned_bytes", 2).alias("scanned_bytes"), F.round("shuffled_bytes", 2).alias("shuffled_bytes"), F.round("pred_latency", 6).alias("pred_latency"), F.round("total_cost", 6).alias("total_cost"))


WEIGHTS = (-0.00001, 1.2, 0.9, 1.1)


@query(STRUCTURES + """ SELECT plan_id, round(greatest(0.0,-0.00001::DOUBLE+1.2::DOUBLE*cpu/3600*0.048+0.9::DOUBLE*scanned/1073741824*0.005+1.1::DOUBLE*shuffled/1073741824*0.010),6) AS pred_cost FROM p""")
def calibrated_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(cost.calibrated(cost.predict(_structures(spark, sf_dir)), WEIGHTS).select("plan_id", "pred_cost"), "pred_cost")


@query("SELECT o_orderkey AS plan_id, round(2e-8::DOUBLE*(o_totalprice*4096)+0.05::DOUBLE,2) AS latency FROM orders")
def analytical_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), cost.analytical_baseline(F.col("o_totalprice") * 4096).alias("latency"))


@query(RESOURCES + """ SELECT plan_id, profile, round(cpu*(compute+service)/vcpus/3600,6) AS provider_cost FROM s CROSS JOIN (VALUES ('small',4,0.192::DOUBLE,0.10::DOUBLE),('large',16,0.768::DOUBLE,0.40::DOUBLE)) AS t(profile,vcpus,compute,service)""")
def cloud_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = spark.createDataFrame([("small", 4, 0.192, 0.10), ("large", 16, 0.768, 0.40)], "profile string, vcpus int, compute double, service double")
    each = _resources(spark, sf_dir).join(F.broadcast(profiles))
    return each.select("plan_id", "profile", F.round(cost.cluster_cost(F.col("cpu_seconds"), F.col("compute"), F.col("service"), F.col("vcpus")), 6).alias("provider_cost"))


_ERR = "count(*) AS n, round(avg(abs(pred_cost-actual_cost)),4) AS mae, round(sqrt(avg((pred_cost-actual_cost)*(pred_cost-actual_cost))),4) AS rmse, round(avg(abs(pred_cost-actual_cost)/abs(actual_cost)*100) FILTER (actual_cost<>0),6) AS mape"


@query(POOL + f" SELECT strategy, {_ERR} FROM plan_pool GROUP BY strategy")
def prediction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calibration.errors(plan_pool(spark, sf_dir), ["strategy"], "pred_cost", "actual_cost")
    return e.select("strategy", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("mape", 6).alias("mape"))


# Constraints, frontiers, ranking --------------------------------------------------------------------


def _with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a plan; those without items have no metrics."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("plan_id"))
    return budgeted(orders.join(plan_pool(spark, sf_dir).drop("query_id"), "plan_id", "left"))


_MISSING = POOL + """, m AS (SELECT o.o_custkey AS query_id, o.o_orderkey AS plan_id, p.pred_cost, p.pred_latency, 1.5::DOUBLE*min(p.pred_cost) OVER (PARTITION BY o.o_custkey) AS budget, 3.0::DOUBLE*min(p.pred_latency) OVER (PARTITION BY o.o_custkey) AS deadline
FROM orders o LEFT JOIN plan_pool p ON p.plan_id=o.o_orderkey),
j AS (SELECT *, CASE WHEN pred_cost IS NULL OR pred_latency IS NULL THEN 'NO_METRICS' WHEN pred_cost>budget AND pred_latency>deadline THEN 'BOTH_EXCEEDED' WHEN pred_cost>budget THEN 'BUDGET_EXCEEDED' WHEN pred_latency>deadline THEN 'DEADLINE_EXCEEDED' ELSE 'PASSED' END AS reason FROM m)"""


@query(_MISSING + " SELECT query_id, plan_id, reason, reason='PASSED' AS feasible, round(budget-pred_cost,6) AS budget_slack, round(deadline-pred_latency,6) AS deadline_slack FROM j")
def constraint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.constrained(_with_missing(spark, sf_dir))
    return r6(out.select("query_id", "plan_id", "reason", "feasible", "budget_slack", "deadline_slack"), "budget_slack", "deadline_slack")


@query(_MISSING + " SELECT query_id, count(*) AS n_plans, " + ", ".join(f"count(*) FILTER (reason='{r}') AS {r.lower()}" for r in selection.REASONS) + ", count(*) FILTER (reason='PASSED')=0 AS infeasible FROM j GROUP BY query_id")
def infeasibility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.reason_counts(selection.constrained(_with_missing(spark, sf_dir)), ["query_id"])


_FRONT = "f AS (SELECT * FROM {src} a WHERE NOT EXISTS (SELECT 1 FROM {src} b WHERE b.query_id=a.query_id AND b.{c}<=a.{c} AND b.pred_latency<=a.pred_latency AND (b.{c}<a.{c} OR b.pred_latency<a.pred_latency)))"


@query(POOL + ", " + _FRONT.format(src="plan_pool", c="pred_cost") + " SELECT query_id, plan_id, pred_cost, pred_latency FROM f")
def pareto_keep_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.keep_ties(plan_pool(spark, sf_dir)).select("query_id", "plan_id", "pred_cost", "pred_latency")


@query(POOL + ", " + _FRONT.format(src="plan_pool", c="pred_cost") + " SELECT query_id, min(plan_id) AS plan_id, pred_cost, pred_latency, count(*) AS n_equivalent FROM f GROUP BY query_id, pred_cost, pred_latency")
def pareto_sort_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.sort_scan(plan_pool(spark, sf_dir)).select("query_id", "plan_id", "pred_cost", "pred_latency", "n_equivalent")


def _norm_sql(a: str, b: str, src: str, c: str = "pred_cost", penalty: str = "1.0", extra: str = "budget") -> str:
    n = lambda x: f"CASE WHEN max({x}) OVER q<=min({x}) OVER q THEN 0.0::DOUBLE ELSE ({x}-min({x}) OVER q)/(max({x}) OVER q-min({x}) OVER q) END"
    pen = f"+{penalty}::DOUBLE*greatest(0.0,{c}-{extra})" if penalty else ""
    return f"(SELECT *, {a}::DOUBLE*{n('pred_latency')}+{b}::DOUBLE*{n(c)}{pen} AS score FROM {src} WINDOW q AS (PARTITION BY query_id))"


@query(BUDGETED + f", s AS (SELECT query_id, plan_id, round(score,6) AS score FROM {_norm_sql('0.5', '0.5', 'b')}) SELECT query_id, plan_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, plan_id) AS rank FROM s")
def lagrangian_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = r6(selection.lagrangian(budgeted(plan_pool(spark, sf_dir))), "score")
    return selection.ranked(scored).select("query_id", "plan_id", "score", "rank")


def _q_sql(signed: bool, deltas: tuple[float, ...], beyond: str) -> str:
    r = lambda m: f"ln(greatest(actual_{m},1e-9))-ln(greatest(pred_{m},1e-9))"
    s = lambda m: r(m) if signed else f"abs({r(m)})"
    top = "'infinity'::DOUBLE" if beyond == "infinity" else "max(score)"
    vals = ",".join(f"({d}::DOUBLE)" for d in deltas)
    return POOL + f""", sc AS (SELECT query_id, plan_id, 'cost' AS metric, {s('cost')} AS score FROM plan_pool UNION ALL SELECT query_id, plan_id, 'latency', {s('latency')} FROM plan_pool),
po AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score, query_id, plan_id) AS position, count(*) OVER (PARTITION BY metric) AS n FROM sc),
dl AS (SELECT * FROM (VALUES {vals}) AS t(delta)),
qq AS (SELECT metric, delta, n, CAST(ceil((n+1)*(1-delta)-1e-9) AS BIGINT) AS rank, CASE WHEN ceil((n+1)*(1-delta)-1e-9)>n THEN {top} ELSE min(score) FILTER (position=ceil((n+1)*(1-delta)-1e-9)) END AS q FROM po CROSS JOIN dl GROUP BY metric, delta, n)"""


def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool with bounds from its own residuals' quantiles, violated by one plan in ten; a budget of 1.9 times the least cost and a wide deadline."""
    pool = written(plan_pool(spark, sf_dir), "pool")
    q = conformal.quantiles(conformal.residuals(pool), (0.1,))
    return conformal.with_quantiles(budgeted(pool), q, 0.1).withColumn("budget", F.col("budget") * 1.25)


BOUNDED = _q_sql(False, (0.1,), "infinity") + "," + BUDGET_SQL + """, mu AS (SELECT max(exp(q)) FILTER (metric='cost') AS mc, max(exp(q)) FILTER (metric='latency') AS ml FROM qq),
u AS (SELECT query_id, plan_id, strategy, pred_cost, pred_latency, actual_cost, actual_latency, budget*1.25::DOUBLE AS budget, deadline, pred_cost*mc AS cost_upper, pred_cost/mc AS cost_lower,
pred_latency*ml AS latency_upper, pred_latency/ml AS latency_lower FROM b CROSS JOIN mu),
ok AS (SELECT * FROM u WHERE cost_upper<=budget AND latency_upper<=deadline)"""


@query(BOUNDED + """ SELECT query_id, plan_id, round(cost_upper,6) AS cost_upper, round(cost_lower,6) AS cost_lower, round(latency_upper,6) AS latency_upper, round(latency_lower,6) AS latency_lower,
CASE WHEN cost_upper>budget AND latency_upper>deadline THEN 'BOTH_EXCEEDED' WHEN cost_upper>budget THEN 'BUDGET_EXCEEDED' WHEN latency_upper>deadline THEN 'DEADLINE_EXCEEDED' ELSE 'PASSED' END AS reason, round(budget-cost_upper,6) AS budget_slack FROM u""")
def conformal_bounds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.constrained(_bounded(spark, sf_dir), "cost_upper", "latency_upper")
    cols = ["cost_upper", "cost_lower", "latency_upper", "latency_lower", "budget_slack"]
    return r6(out.select("query_id", "plan_id", "reason", *cols), *cols)


_UFRONT = BOUNDED + ", " + _FRONT.format(src="ok", c="cost_upper") + ", lead AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, cost_upper, pred_latency ORDER BY plan_id)=1)"
_KEEP = ("plan_id", "pred_cost", "pred_latency")


def _policy(policy: selection.Policy):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fits = selection.constrained(_bounded(spark, sf_dir), "cost_upper", "latency_upper").where("feasible")
        return selection.decide(frontier.sort_scan(fits, cost="cost_upper"), policy, _KEEP)

    return run


_PICK = " SELECT query_id, plan_id, pred_cost, pred_latency FROM {src} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order})=1"
query(_UFRONT + _PICK.format(src="lead", order="pred_latency, cost_upper, plan_id"), "policy_fastest")(_policy(selection.FASTEST))
query(_UFRONT + _PICK.format(src=_norm_sql("0.5", "0.5", "lead", "cost_upper", ""), order="score, pred_latency, plan_id"), "policy_scalarized")(_policy(selection.SCALARISED))
query(_UFRONT + _PICK.format(src="lead", order="cost_upper, pred_latency, plan_id"), "policy_cheapest")(_policy(selection.CHEAPEST))
query(_UFRONT + _PICK.format(src=_norm_sql("0.5", "0.5", "lead"), order="score, plan_id"), "policy_legacy_lagrangian")(_policy(selection.LEGACY))


def _grid_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_cost as predicted, pred_cost calibrated by a factor that differs by strategy."""
    p = budgeted(plan_pool(spark, sf_dir))
    return p.withColumn("raw_cost", F.col("pred_cost")).withColumn("pred_cost", F.when(F.col("strategy").startswith("1"), F.col("pred_cost") * 1.25).otherwise(F.col("pred_cost")))


def _grid_sql() -> str:
    base = BUDGETED + ", g AS (SELECT query_id, plan_id, pred_latency, budget, deadline, pred_cost AS raw_cost, CASE WHEN strategy LIKE '1%' THEN pred_cost*1.25::DOUBLE ELSE pred_cost END AS pred_cost FROM b)"
    parts = []
    for i, a in enumerate(selection.ABLATIONS):
        src = "g" if a.calibration else "(SELECT query_id, plan_id, pred_latency, budget, deadline, raw_cost AS pred_cost FROM g)"
        base += f", k{i} AS (SELECT * FROM {src} WHERE pred_cost<=budget AND pred_latency<=deadline)"
        if a.pareto:
            base += ", " + _FRONT.format(src=f"k{i}", c="pred_cost").replace("f AS", f"f{i} AS", 1)
        front = f"f{i}" if a.pareto else f"k{i}"
        if a.lagrangian:
            chosen = _PICK.format(src=_norm_sql(str(a.alpha), str(a.beta), front, penalty=str(a.penalty)), order="score, plan_id")
        else:
            chosen = _PICK.format(src=front, order="pred_cost, pred_latency, plan_id")
        parts.append(f"SELECT '{a.name}' AS variant, * FROM ({chosen})")
    return base + " " + " UNION ALL ".join(parts)


@query(_grid_sql())
def ablation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ablation_grid(_grid_pool(spark, sf_dir)).select("variant", "query_id", "plan_id", "pred_cost", "pred_latency")


@query(POOL + _PICK.format(src="plan_pool", order="pred_cost, plan_id"))
def baseline_spark_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.default_baseline(plan_pool(spark, sf_dir))


@query(BUDGETED + _PICK.format(src="(SELECT * FROM b WHERE pred_cost<=budget AND pred_latency<=deadline)", order="pred_latency, pred_cost, plan_id"))
def baseline_greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.greedy_baseline(budgeted(plan_pool(spark, sf_dir)))


@query(BOUNDED + """ SELECT query_id, count(*) AS n_plans, round(min(cost_upper),6) AS min_budget_required, round(max(cost_upper),6) AS max_cost_upper, round(min(pred_cost),6) AS min_point_cost, round(min(latency_upper),6) AS min_latency_upper,
round(arg_min(cost_upper, struct_pack(a:=pred_latency,b:=plan_id)),6) AS min_budget_for_fastest, round(min(cost_upper)*1.05::DOUBLE,6) AS recommended_budget, round(greatest(0.0,min(cost_upper)-min(budget)),6) AS deficit FROM u GROUP BY query_id""")
def infeasible_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = selection.diagnostics(_bounded(spark, sf_dir))
    cols = ["min_budget_required", "max_cost_upper", "min_point_cost", "min_latency_upper", "min_budget_for_fastest", "recommended_budget", "deficit"]
    return r6(d.select("query_id", "n_plans", *cols), *cols)


def _tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds against half the budget for every other query, so that those have no feasible plan."""
    b = _bounded(spark, sf_dir)
    return b.withColumn("budget", F.when(F.col("query_id") % 2 == 0, F.col("budget") * 0.5).otherwise(F.col("budget")))


TIGHT = BOUNDED + """, t AS (SELECT * EXCLUDE (budget), CASE WHEN query_id%2=0 THEN budget*0.5::DOUBLE ELSE budget END AS budget FROM u),
no AS (SELECT query_id, min(struct_pack(a:=cost_upper,b:=pred_latency,c:=plan_id)) AS m, min(budget) AS budget FROM t GROUP BY query_id HAVING count(*) FILTER (cost_upper<=budget AND latency_upper<=deadline)=0)"""


@query(TIGHT + """ SELECT query_id, 'min_cost_over_budget' AS mode, false AS refused, CAST(m.c AS VARCHAR) AS plan_id, round(greatest(0.0,m.a-budget),6) AS overrun, round(m.a,6) AS reported_budget FROM no
UNION ALL SELECT query_id, 'min_budget_reporting', true, NULL, 0.0, round(m.a,6) FROM no UNION ALL SELECT query_id, 'formal_refusal', true, NULL, 0.0, NULL FROM no""")
def infeasible_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _tight(spark, sf_dir)
    parts = [selection.resolve_infeasible(pool, m) for m in selection.INFEASIBLE_MODES]
    return r6(parts[0].union(parts[1]).union(parts[2]), "overrun", "reported_budget").withColumn("plan_id", F.col("plan_id").cast("string"))


@query(TIGHT + ", ok2 AS (SELECT * FROM t WHERE cost_upper<=budget AND latency_upper<=deadline), " + _FRONT.format(src="ok2", c="cost_upper") + """,
ch AS (SELECT query_id, plan_id, true AS feasible FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pred_latency, cost_upper, plan_id)=1)
SELECT * FROM ch UNION ALL SELECT query_id, m.c, false FROM no""")
def robust_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.robust_select(_tight(spark, sf_dir))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.outcomes(plan_pool(spark, sf_dir), (1.0, 1.25, 2.0), lambda p, keys: selection.strategy_choices(p, keys=keys))


_CHOICES = """ch AS (
SELECT query_id, multiplier, 'greedy_cheapest' AS strategy_name, arg_min(plan_id, struct_pack(a:=pred_cost,b:=pred_latency,c:=plan_id)) AS plan_id FROM mb GROUP BY ALL
UNION ALL SELECT query_id, multiplier, 'greedy_fastest', arg_min(plan_id, struct_pack(a:=CAST(pred_cost>budget AS INTEGER),b:=CASE WHEN pred_cost<=budget THEN pred_latency ELSE pred_cost END,c:=pred_cost,d:=plan_id)) FROM mb GROUP BY ALL
UNION ALL SELECT query_id, multiplier, 'oracle', arg_min(plan_id, struct_pack(a:=CAST(actual_cost>budget AS INTEGER),b:=CASE WHEN actual_cost<=budget THEN actual_latency ELSE actual_cost END,c:=actual_cost,d:=plan_id)) FROM mb GROUP BY ALL
UNION ALL SELECT query_id, multiplier, 'random', arg_min(plan_id, struct_pack(a:=md5(concat_ws('|','0',CAST(query_id AS VARCHAR),CAST(plan_id AS VARCHAR))),b:=plan_id)) FROM mb GROUP BY ALL)"""
_MB = POOL + """, lst AS (SELECT query_id, min(actual_cost) AS least, arg_min(actual_latency, struct_pack(a:=pred_cost,b:=plan_id)) AS reference FROM plan_pool GROUP BY query_id),
mb AS (SELECT p.*, m.multiplier, m.multiplier*l.least AS budget, l.reference FROM plan_pool p JOIN lst l USING (query_id) CROSS JOIN (VALUES (1.0::DOUBLE),(1.25::DOUBLE),(2.0::DOUBLE)) AS m(multiplier)), """ + _CHOICES + """,
jo AS (SELECT ch.query_id, ch.multiplier, ch.strategy_name, ch.plan_id, mb.actual_cost AS cost, mb.actual_latency AS latency, mb.actual_cost>mb.budget AS violated, mb.reference FROM ch JOIN mb ON ch.query_id=mb.query_id AND ch.plan_id=mb.plan_id AND ch.multiplier=mb.multiplier),
ev AS (SELECT jo.*, jo.latency/o.latency-1 AS regret, jo.reference/jo.latency AS speedup FROM jo JOIN jo o ON o.query_id=jo.query_id AND o.multiplier=jo.multiplier AND o.strategy_name='oracle')"""


@query(BUDGETED.replace("1.5::DOUBLE", "1.5::DOUBLE") + ", mb AS (SELECT *, 1 AS multiplier FROM b), " + _CHOICES + " SELECT query_id, strategy_name, plan_id FROM ch")
def pool_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.strategy_choices(budgeted(plan_pool(spark, sf_dir))).select("query_id", "strategy_name", "plan_id")


@query(_MB + " SELECT query_id, multiplier, strategy_name, plan_id, round(cost,6) AS cost, round(latency,6) AS latency, violated, round(regret,6) AS regret, round(speedup,6) AS speedup FROM ev")
def evaluate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_evaluated(spark, sf_dir), "cost", "latency", "regret", "speedup")


@query(_MB + """ SELECT strategy_name, multiplier, count(*) AS n, round(quantile_cont(latency,0.5),6) AS median_latency, round(quantile_cont(latency,0.9),6) AS p90_latency, round(quantile_cont(latency,0.99),6) AS p99_latency, round(avg(cost),4) AS mean_cost,
round(avg(CAST(violated AS DOUBLE)),6) AS violation_rate, round(avg(regret),6) AS mean_regret, round(exp(avg(ln(speedup)) FILTER (speedup>0)),6) AS geomean_speedup FROM ev GROUP BY ALL""")
def summary_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.summary(_evaluated(spark, sf_dir), ["strategy_name", "multiplier"])
    return r6(s, "median_latency", "p90_latency", "p99_latency", "violation_rate", "mean_regret", "geomean_speedup").withColumn("mean_cost", F.round("mean_cost", 4))


@query(POOL + """, t AS (SELECT query_id, plan_id, pred_cost FROM plan_pool QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pred_cost DESC, plan_id)<=2), lim AS (SELECT query_id, min(pred_cost) AS l FROM t GROUP BY query_id),
c AS (SELECT p.query_id, p.plan_id, p.pred_cost FROM plan_pool p JOIN lim USING (query_id) WHERE p.pred_cost<lim.l AND NOT EXISTS (SELECT 1 FROM t WHERE t.query_id=p.query_id AND t.plan_id=p.plan_id))
SELECT query_id, plan_id, pred_cost FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pred_cost, plan_id)=1""")
def replan_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    pool = plan_pool(spark, sf_dir)
    dear = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("pred_cost").desc(), "plan_id"))
    tried = pool.withColumn("r", dear).where("r <= 2").select("query_id", "plan_id", "pred_cost")
    return selection.replan(pool, tried)


# Conformal ------------------------------------------------------------------------------------------


_QOUT = " SELECT metric, delta, n, rank, round(q,6) AS q, round(exp(q),6) AS multiplier, rank>n AS rank_exceeds_n FROM qq"


def _quantiles(signed: bool, deltas: tuple[float, ...], beyond: str = "infinity"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return r6(conformal.quantiles(conformal.residuals(plan_pool(spark, sf_dir), signed), deltas, beyond), "q", "multiplier")

    return run


query(_q_sql(False, (0.05,), "infinity") + _QOUT, "conformal_quantile_abs")(_quantiles(False, (0.05,)))
query(_q_sql(True, (0.05,), "infinity") + _QOUT, "conformal_quantile_signed")(_quantiles(True, (0.05,)))
query(_q_sql(False, (0.0000001, 0.01, 0.05, 0.1, 0.2), "largest") + _QOUT, "conformal_quantile_multi_delta")(_quantiles(False, (0.0000001, 0.01, 0.05, 0.1, 0.2), "largest"))


@query(_q_sql(True, (0.05, 0.1, 0.2), "infinity") + """, lo AS (SELECT 'cost' AS metric, actual_cost AS a, pred_cost AS p FROM plan_pool UNION ALL SELECT 'latency', actual_latency, pred_latency FROM plan_pool)
SELECT metric, delta, count(*) AS n, round(avg(CAST(a<=p*exp(q) AS DOUBLE)),6) AS coverage, round(avg(1-CAST(a<=p*exp(q) AS DOUBLE)),6) AS violation_rate, round(avg((p*exp(q)-a)/a),6) AS mean_margin FROM lo JOIN qq USING (metric) GROUP BY metric, delta""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = plan_pool(spark, sf_dir)
    # Whether the plan at the rank itself is covered hangs on the last bit of exp(ln a - ln p); SQL and Spark agree to 6 digits.
    q = conformal.quantiles(conformal.residuals(pool, signed=True), (0.05, 0.1, 0.2))
    return r6(conformal.coverage(pool, q), "coverage", "violation_rate", "mean_margin")


@query(POOL + """, sc AS (SELECT query_id, plan_id, abs(ln(actual_cost)-ln(pred_cost)) AS score FROM plan_pool), po AS (SELECT *, row_number() OVER (ORDER BY score, query_id, plan_id) AS position FROM sc),
own AS (SELECT query_id, position, row_number() OVER (PARTITION BY query_id ORDER BY position) AS i FROM po), m AS (SELECT query_id, count(*) AS m FROM po GROUP BY 1),
k AS (SELECT query_id, (SELECT count(*) FROM po)-m AS n, CAST(ceil(((SELECT count(*) FROM po)-m+1)*(1-0.1::DOUBLE)-1e-9) AS BIGINT) AS rank FROM m),
j AS (SELECT k.query_id, k.n, k.rank, count(*) FILTER (own.position-own.i+1<=k.rank) AS j FROM k JOIN own USING (query_id) GROUP BY ALL)
SELECT j.query_id, 'cost' AS metric, j.n, j.rank, round(po.score,6) AS q FROM j JOIN po ON po.position=j.rank+j.j""")
def loqo_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = conformal.residuals(plan_pool(spark, sf_dir)).where("metric = 'cost'")
    return r6(conformal.leave_one_query_out(scores, 0.1), "q")


# Calibration ----------------------------------------------------------------------------------------


@query(POOL + """ SELECT strategy, count(*) AS n, round(regr_slope(actual_cost,pred_cost),6) AS scale, round(regr_intercept(actual_cost,pred_cost),3) AS bias FROM plan_pool GROUP BY strategy""")
def ols_line_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = calibration.fit_lines(plan_pool(spark, sf_dir), ["strategy"], "pred_cost", "actual_cost")
    return f.select("strategy", "n", F.round("scale", 6).alias("scale"), F.round("bias", 3).alias("bias"))


@query(POOL + """ SELECT count(*) AS n, CAST(sum(1) AS DOUBLE) AS g_0_0, round(sum(pred_latency),0) AS g_0_1, round(sum(pred_latency*pred_latency),0) AS g_1_1, round(sum(actual_latency),2) AS b_0, round(sum(pred_latency*actual_latency),1) AS b_1 FROM plan_pool""")
def ols_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = calibration.gram(plan_pool(spark, sf_dir), ["pred_latency"], "actual_latency")
    return g.select("n", "g_0_0", F.round("g_0_1", 0).alias("g_0_1"), F.round("g_1_1", 0).alias("g_1_1"), F.round("b_0", 2).alias("b_0"), F.round("b_1", 1).alias("b_1"))


@query(POOL + ", q AS (SELECT DISTINCT query_id FROM plan_pool) SELECT query_id, CAST(ntile(5) OVER (ORDER BY md5(CAST(query_id AS VARCHAR))) AS INTEGER) AS fold FROM q")
def grouped_kfold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.folds(plan_pool(spark, sf_dir), 5).select("query_id", "fold").distinct()


@query(POOL + """ SELECT query_id, plan_id, CASE WHEN ('0x'||substr(md5('7|'||CAST(query_id AS VARCHAR)),1,8))::BIGINT/4294967296.0::DOUBLE<0.5 THEN 'train' WHEN ('0x'||substr(md5('7|'||CAST(query_id AS VARCHAR)),1,8))::BIGINT/4294967296.0::DOUBLE<0.75 THEN 'calibrate' ELSE 'test' END AS part FROM plan_pool""")
def query_grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.query_split(plan_pool(spark, sf_dir), (("train", 0.5), ("calibrate", 0.25), ("test", 0.25)), "7").select("query_id", "plan_id", "part")


@query()
def log_ridge_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out errors of the log-ridge model on phase1_benchmark: trained on four folds of queries, tested on the fifth."""
    from costplan.plans.plantext import VECTOR

    rows = written(calibration.folds(table(spark, sf_dir, "phase1_benchmark").where("query_id is not null and true_latency > 0").distinct(), 5), "folds")
    model = calibration.fit_log_ridge(rows.where("fold < 5"), "true_latency", VECTOR)
    return calibration.errors(model.predict(rows.where("fold = 5")), ["strategy"], "prediction", "true_latency")


# Rank statistics --------------------------------------------------------------------------------------


@query(POOL + """, r AS (SELECT strategy, rank() OVER (PARTITION BY strategy ORDER BY pred_cost)+(count(*) OVER (PARTITION BY strategy, pred_cost)-1)/2.0-1 AS rx, rank() OVER (PARTITION BY strategy ORDER BY pred_latency)+(count(*) OVER (PARTITION BY strategy, pred_latency)-1)/2.0-1 AS ry FROM plan_pool)
SELECT strategy, count(*) AS n, round(corr(rx,ry),6) AS rho FROM r GROUP BY strategy""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluation.spearman(plan_pool(spark, sf_dir), ["strategy"], "pred_cost", "pred_latency"), "rho")


@query(POOL + """, s AS (SELECT a.query_id, sum(sign(b.pred_cost-a.pred_cost)*sign(b.pred_latency-a.pred_latency)) AS s FROM plan_pool a JOIN plan_pool b ON a.query_id=b.query_id AND a.plan_id<b.plan_id GROUP BY 1), n AS (SELECT query_id, count(*) AS n FROM plan_pool GROUP BY 1)
SELECT query_id, n, round(CASE WHEN n<2 THEN 0.0 ELSE s/(n*(n-1)/2.0) END,6) AS tau FROM n LEFT JOIN s USING (query_id)""")
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluation.kendall(plan_pool(spark, sf_dir), ["query_id"], "pred_cost", "pred_latency"), "tau")


@query(POOL + """, q AS (SELECT query_id, arg_min(plan_id, struct_pack(a:=pred_latency,b:=plan_id)) AS p, arg_min(plan_id, struct_pack(a:=actual_latency,b:=plan_id)) AS a FROM plan_pool GROUP BY 1 HAVING count(*)>=2)
SELECT count(*) AS n_queries, round(avg(CAST(p=a AS DOUBLE)),6) AS hit_rate FROM q""")
def top1_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluation.top1_hits(plan_pool(spark, sf_dir), "pred_latency", "actual_latency"), "hit_rate")


@query(POOL + " SELECT strategy, round(exp(avg(ln(pred_cost)) FILTER (pred_cost>0)),4) AS geomean_cost FROM plan_pool GROUP BY strategy")
def geomean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_pool(spark, sf_dir).groupBy("strategy").agg(F.round(geometric_mean(F.col("pred_cost")), 4).alias("geomean_cost"))


@query(POOL + " SELECT strategy, round(quantile_cont(actual_cost,0.5),6) AS p50, round(quantile_cont(actual_cost,0.9),6) AS p90, round(quantile_cont(actual_cost,0.99),6) AS p99 FROM plan_pool GROUP BY strategy")
def median_p90_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(evaluation.exact_percentiles(plan_pool(spark, sf_dir), ["strategy"], "actual_cost", {"p50": 0.5, "p90": 0.9, "p99": 0.99}), "p50", "p90", "p99")


@query(POOL + """, d AS (SELECT strategy, CASE WHEN abs(actual_latency-pred_latency)<=1e-9*greatest(abs(actual_latency),abs(pred_latency)) THEN 0.0 ELSE round(actual_latency-pred_latency,9) END AS d FROM plan_pool),
r AS (SELECT strategy, d, rank() OVER (PARTITION BY strategy ORDER BY abs(d))+(count(*) OVER (PARTITION BY strategy, abs(d))-1)/2.0 AS r FROM d WHERE d<>0)
SELECT b.strategy, b.wins, b.losses, b.ties, r.n, r.w_plus, r.w_minus FROM (SELECT strategy, count(*) FILTER (d<0) AS wins, count(*) FILTER (d>0) AS losses, count(*) FILTER (d=0) AS ties FROM d GROUP BY 1) b
JOIN (SELECT strategy, count(*) AS n, CAST(coalesce(sum(r) FILTER (d>0),0) AS DOUBLE) AS w_plus, CAST(coalesce(sum(r) FILTER (d<0),0) AS DOUBLE) AS w_minus FROM r GROUP BY 1) r USING (strategy)""")
def wilcoxon_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = plan_pool(spark, sf_dir).select("strategy", F.round(F.col("actual_latency") - F.col("pred_latency"), 9).alias("x"), F.lit(0.0).alias("y"))
    return evaluation.wilcoxon(pool, ["strategy"], "x", "y").select("strategy", "wins", "losses", "ties", "n", "w_plus", "w_minus")


@query("""WITH t AS (SELECT o_orderpriority AS name, o_orderstatus AS family, round(1.0::DOUBLE/(1+count(*)%97),9) AS p FROM orders GROUP BY 1,2),
s AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, name) AS k FROM t)
SELECT family, name, p, round(max(least(1.0,(m-k+1)*p)) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING),6) AS p_adjusted FROM s""")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("family")).agg(F.round(1.0 / (1 + F.count(F.lit(1)) % 97), 9).alias("p"))
    return r6(evaluation.holm(tests, ["family"]), "p_adjusted").select("family", "name", "p", "p_adjusted")


@query(POOL + ", r AS (SELECT query_id, plan_id, rank() OVER (PARTITION BY query_id ORDER BY pred_latency)+(count(*) OVER (PARTITION BY query_id, pred_latency)-1)/2.0-1 AS r FROM plan_pool) SELECT query_id, plan_id, CAST(r AS DOUBLE) AS latency_rank FROM r")
def fractional_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.tie_ranks(plan_pool(spark, sf_dir), ["query_id"], "pred_latency", "latency_rank").select("query_id", "plan_id", "latency_rank")


_MEDIANS = _MB + """, v AS (SELECT strategy_name, speedup AS x FROM ev WHERE speedup IS NOT NULL),
r AS (SELECT strategy_name, x, row_number() OVER (PARTITION BY strategy_name ORDER BY x) AS i, count(*) OVER (PARTITION BY strategy_name) AS n FROM v)"""


@query()
def bootstrap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the median speedup of each strategy over all outcomes, 2000 resamples."""
    return evaluation.bootstrap_median(_evaluated(spark, sf_dir), ["strategy_name"], "speedup")


@query(_MEDIANS + """ SELECT strategy_name, max(n) AS n, round(median(x),6) AS median, true AS low_in_place, true AS high_in_place FROM r GROUP BY strategy_name""")
def bootstrap_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same intervals held against theory: their ends lie within a tenth of 1.96 deviations of a median's rank, root of n halved, plus two ranks."""
    rows = written(_evaluated(spark, sf_dir).where("speedup is not null"), "speedups")
    ci = evaluation.bootstrap_median(rows, ["strategy_name"], "speedup")
    both = rows.join(ci, "strategy_name").groupBy("strategy_name").agg(F.max("n").alias("n"), F.round(F.max("median"), 6).alias("median"), *[F.count_if(F.col("speedup") <= F.col(e)).alias(f"{e}_upto") for e in ("low", "high")], *[F.count_if(F.col("speedup") < F.col(e)).alias(f"{e}_below") for e in ("low", "high")])
    reach = 1.96 * F.sqrt("n") / 2
    near = lambda e, rank: ((F.col(f"{e}_upto") >= rank - 0.1 * reach - 2) & (F.col(f"{e}_below") <= rank + 0.1 * reach + 2)).alias(f"{e}_in_place")
    return both.select("strategy_name", "n", "median", near("low", F.col("n") / 2 - reach), near("high", F.col("n") / 2 + reach))


@query()
def summary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """summary_by_strategy with the median cost and bootstrap intervals of median latency and cost."""
    return evaluation.summary_with_intervals(_evaluated(spark, sf_dir), ["strategy_name", "multiplier"])


@query("""WITH x AS (SELECT range AS id FROM range(300000)), w AS (SELECT id // 1000 AS block, count(*) AS c FROM x GROUP BY 1), t AS (SELECT sum(c) AS n, CAST(sum(c*(c-1)/2) AS DOUBLE) AS within FROM w)
SELECT 'blocks' AS grp, CAST(n AS BIGINT) AS n, round((n*(n-1)/2-2*within)/(n*(n-1)/2),9) AS tau FROM t""")
def kendall_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau of one group of 300000 distinct values that rise from block to block and fall within each."""
    x = F.col("id")
    df = spark.range(300_000).select(F.lit("blocks").alias("grp"), x.cast("double").alias("x"), (F.floor(x / 1000) * 1000 + 999 - x % 1000).cast("double").alias("y"))
    return evaluation.kendall(df, ["grp"], "x", "y").withColumn("tau", F.round("tau", 9))


@query(_q_sql(False, (0.05,), "infinity") + "," + BUDGET_SQL + """, k AS (SELECT max(q) AS q FROM qq WHERE metric='cost'), u AS (SELECT b.*, pred_cost*exp(q) AS cu, pred_cost*exp(-q) AS cl, pred_latency*exp(q) AS lu FROM b CROSS JOIN k)
SELECT query_id, plan_id, round(cu,6) AS cost_upper, round(cl,6) AS cost_lower, round(budget-cu,6) AS cost_headroom, round(deadline-lu,6) AS latency_headroom, cu<=budget AND lu<=deadline AS feasible FROM u""")
def chance_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older symmetric interval of one quantile for both metrics, and the filter by its upper ends."""
    pool = written(plan_pool(spark, sf_dir), "pool")
    q = conformal.quantiles(conformal.residuals(pool), (0.05,)).where("metric = 'cost'").agg(F.max("q").alias("q"))
    out = selection.chance_constrained(budgeted(pool).join(q), F.col("q"), F.col("budget"), F.col("deadline"))
    cols = ["cost_upper", "cost_lower", "cost_headroom", "latency_headroom"]
    return r6(out.select("query_id", "plan_id", *cols, "feasible"), *cols)


_FOLDED = """WITH r AS (SELECT DISTINCT row_id, query_id FROM phase1_benchmark WHERE query_id IS NOT NULL AND true_latency > 0 AND NOT isnan(true_latency)), q AS (SELECT DISTINCT query_id FROM r),
f AS (SELECT query_id, ntile(5) OVER (ORDER BY md5(query_id)) AS fold FROM q), n AS (SELECT count(*) AS n_test FROM r JOIN f USING (query_id) WHERE fold = 5)
SELECT unnest(['log_ridge', 'gbt', 'ranking']) AS model, n_test, true AS orders_plans, true AS beats_the_mean FROM n"""


@query(_FOLDED)
def learned_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-ridge, boosted trees and the ranking model, fitted on four folds of queries: on the fifth, whether they order latencies
    (Spearman above 0.5) and err less in ln latency (trees, ridge) or in order (ranking) than a constant would."""
    from costplan.plans.plantext import VECTOR

    y = "true_latency"
    rows = table(spark, sf_dir, "phase1_benchmark").where("query_id is not null and true_latency > 0 and not isnan(true_latency)").distinct()
    rows = written(calibration.folds(rows.fillna(0, list(VECTOR)), 5), "folds")
    train, test = rows.where("fold < 5"), rows.where("fold = 5")
    gbt = calibration.fit_gbt(train, y, rounds=20)
    found = {"log_ridge": calibration.fit_log_ridge(train, y).predict(test), "gbt": calibration.predict_gbt(gbt, test), "ranking": calibration.fit_ranking(train, y).predict(test)}
    both = None
    for name, df in found.items():
        part = df.select(F.lit(name).alias("model"), "prediction", y)
        both = part if both is None else both.union(part)
    both = written(both, "predictions")
    order = evaluation.spearman(both, ["model"], "prediction", y)
    gap = F.log("prediction") - F.log(y)
    error = both.groupBy("model").agg(F.avg(gap * gap).alias("mse"), F.var_pop(F.log(y)).alias("spread"))
    return order.join(error, "model").select("model", F.col("n").alias("n_test"), (F.col("rho") > 0.5).alias("orders_plans"), F.when(F.col("model") == "ranking", F.col("rho") > 0).otherwise(F.col("mse") < F.col("spread")).alias("beats_the_mean"))


@query(POOL + " SELECT count(*) AS n_keys, 0::BIGINT AS n_missing, count(*) FILTER (abs(pred_latency-actual_latency)>greatest(1e-8,1e-12*greatest(abs(pred_latency),abs(actual_latency)))) AS n_different, 0::BIGINT AS n_repeated, false AS equal FROM plan_pool")
def result_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = plan_pool(spark, sf_dir)
    return evaluation.same_results(pool.select("plan_id", F.col("pred_latency").alias("v")), pool.select("plan_id", F.col("actual_latency").alias("v")), ["plan_id"], "v")
