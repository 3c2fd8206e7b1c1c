"""Choosing plans: constraints, scores, policies, baselines and what to do when nothing fits.

All pools are rows (query_id, plan_id, ...). Choices are min-by aggregates, combined on the map
side, so that no task has to hold the plans of a large query.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costplan.operators import frontier
from costplan.operators.ordered import numbered
from costplan.session import written

REASONS = ("PASSED", "BUDGET_EXCEEDED", "DEADLINE_EXCEEDED", "BOTH_EXCEEDED", "NO_METRICS")


def reason(cost: Column, latency: Column, budget: Column, deadline: Column | None = None) -> Column:
    """Why a plan is rejected, or PASSED; null metrics are NO_METRICS, a null deadline is none."""
    over = cost > budget
    late = F.coalesce(latency > deadline, F.lit(False)) if deadline is not None else F.lit(False)
    return (
        F.when(cost.isNull() | latency.isNull(), "NO_METRICS").when(over & late, "BOTH_EXCEEDED").when(over, "BUDGET_EXCEEDED").when(late, "DEADLINE_EXCEEDED").otherwise("PASSED")
    )


def constrained(pool: DataFrame, cost: str = "pred_cost", latency: str = "pred_latency", budget: str = "budget", deadline: str | None = "deadline") -> DataFrame:
    """pool with reason, feasible and the headroom (slack) left in budget and deadline."""
    late = F.col(deadline) if deadline else None
    out = pool.withColumn("reason", reason(F.col(cost), F.col(latency), F.col(budget), late))
    slack = {"feasible": F.col("reason") == "PASSED", "budget_slack": F.col(budget) - F.col(cost)}
    if deadline:
        slack["deadline_slack"] = F.col(deadline) - F.col(latency)
    return out.withColumns(slack)


def chance_constrained(plans: DataFrame, q: Column, budget: Column, deadline: Column | None = None) -> DataFrame:
    """plans with the symmetric interval point * exp(+-q) of cost and latency, whether its upper ends fit, and the room left.

    A null deadline, or none, doesn't bind: its room is infinite. The older form of the filter,
    kept beside bounds() and constrained(), which it agrees with.
    """
    up, down = F.exp(q), F.exp(-q)
    limit = F.lit(None).cast("double") if deadline is None else deadline
    out = plans.withColumns({"cost_upper": F.col("pred_cost") * up, "cost_lower": F.col("pred_cost") * down, "latency_upper": F.col("pred_latency") * up, "latency_lower": F.col("pred_latency") * down})
    out = out.withColumns({"cost_headroom": budget - F.col("cost_upper"), "latency_headroom": F.coalesce(limit - F.col("latency_upper"), F.lit(float("inf")))})
    fits = {"is_cost_feasible": F.col("cost_headroom") >= 0, "is_latency_feasible": F.col("latency_headroom") >= 0}
    return out.withColumns(fits).withColumn("feasible", F.col("is_cost_feasible") & F.col("is_latency_feasible"))


def reason_counts(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plans per group by reason; infeasible only where none passed."""
    counts = [F.count_if(F.col("reason") == r).alias(r.lower()) for r in REASONS]
    by = judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_plans"), *counts)
    return by.withColumn("infeasible", F.col("passed") == 0)


def pick(pool: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The columns keep of the row of each group that comes first by order."""
    least = F.min(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*keep).alias("row"))).alias("b")
    return pool.groupBy(*keys).agg(least).select(*keys, "b.row.*")


def normalised(pool: DataFrame, columns: dict[str, str], keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """pool with each column's min-max position in its group as the new name; 0 where the range is empty."""
    limits = pool.groupBy(*keys).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = pool.join(limits, list(keys))
    part = {new: F.when(F.col(f"__hi_{c}") <= F.col(f"__lo_{c}"), 0.0).otherwise((F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))) for c, new in columns.items()}
    return joined.withColumns(part).drop(*[c for c in limits.columns if c.startswith("__")])


def lagrangian(pool: DataFrame, alpha: float = 0.5, beta: float = 0.5, gamma: float = 0.0, delta: float = 0.0, penalty: float = 1.0, cost: str = "pred_cost", latency: str = "pred_latency", budget: str = "budget") -> DataFrame:
    """pool with score = a L + b C + g A + d V + lambda max(0, cost - budget), L and C normalised per query.

    accuracy_loss and variance are used unscaled where pool has them.
    """
    out = normalised(pool, {latency: "norm_latency", cost: "norm_cost"})
    extra = [F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in (("accuracy_loss", gamma), ("variance", delta)) if c in pool.columns]
    score = sum(extra, F.lit(alpha) * F.col("norm_latency") + F.lit(beta) * F.col("norm_cost")) + F.lit(penalty) * F.greatest(F.lit(0.0), F.col(cost) - F.col(budget))
    return out.withColumn("score", score)


def ranked(scored: DataFrame, order: Sequence[str] = ("score", "plan_id"), name: str = "rank", cells: int = 1024) -> DataFrame:
    """scored with the 1-based rank in its query; ranking within cells of the first key, so no task ranks a whole hot query."""
    cell = F.floor(F.least(F.greatest(F.col(order[0]).cast("double"), F.lit(-1e6)), F.lit(1e6)) * F.lit(cells))
    return numbered(scored, ["query_id"], list(order), cell, name)


@dataclass(frozen=True)
class Policy:
    """Order in which a policy prefers plans; scalarised ones need weights."""

    name: str
    order: tuple[str, ...]


FASTEST = Policy("fastest_under_budget", ("pred_latency", "cost_upper", "plan_id"))
SCALARISED = Policy("normalized_scalarization", ("score", "pred_latency", "plan_id"))
CHEAPEST = Policy("cheapest_feasible", ("cost_upper", "pred_latency", "plan_id"))
LEGACY = Policy("legacy_lagrangian_ablation", ("score", "plan_id"))
POLICIES = (FASTEST, SCALARISED, CHEAPEST, LEGACY)


def decide(front: DataFrame, policy: Policy, keep: Sequence[str], alpha: float = 0.5, beta: float = 0.5, penalty: float = 1.0) -> DataFrame:
    """One plan per query from its frontier (query_id, plan_id, pred_cost, pred_latency, cost_upper, budget)."""
    if policy is SCALARISED:
        total = alpha + beta
        a, b = (alpha / total, beta / total) if total > 0 else (0.5, 0.5)
        front = normalised(front, {"pred_latency": "norm_latency", "cost_upper": "norm_cost"}).withColumn("score", F.lit(a) * F.col("norm_latency") + F.lit(b) * F.col("norm_cost"))
    elif policy is LEGACY:
        front = lagrangian(front, 0.5, 0.5, penalty=penalty)
    return pick(front, ["query_id"], policy.order, keep)


@dataclass(frozen=True)
class Ablation:
    """A selector configuration with one part changed."""

    name: str
    calibration: bool = True
    pareto: bool = True
    lagrangian: bool = True
    alpha: float = 0.5
    beta: float = 0.5
    penalty: float = 1.0
    accuracy_tolerance: float | None = None


ABLATIONS = (
    Ablation("full"), Ablation("no_calibration", calibration=False), Ablation("no_pareto", pareto=False), Ablation("no_lagrangian", lagrangian=False),
    Ablation("no_adaptive", accuracy_tolerance=0.0), Ablation("latency_only", alpha=1.0, beta=0.0), Ablation("cost_only", alpha=0.0, beta=1.0), Ablation("high_lambda", penalty=10.0),
)


def ablation(name: str) -> Ablation:
    for a in ABLATIONS:
        if a.name == name:
            return a
    raise KeyError(name)


def select(pool: DataFrame, a: Ablation = ABLATIONS[0], keep: Sequence[str] = ("plan_id", "pred_cost", "pred_latency")) -> DataFrame:
    """The three stages filter, frontier, ranking: one plan per query that has a feasible one.

    pool has pred_cost (calibrated), raw_cost (as predicted), pred_latency, budget and deadline.
    """
    rows = pool if a.calibration or "raw_cost" not in pool.columns else pool.withColumn("pred_cost", F.col("raw_cost"))
    fits = constrained(rows).where("feasible")
    front = frontier.keep_ties(fits) if a.pareto else fits
    if not a.lagrangian:
        return pick(front, ["query_id"], ("pred_cost", "pred_latency", "plan_id"), keep)
    return pick(lagrangian(front, a.alpha, a.beta, penalty=a.penalty), ["query_id"], ("score", "plan_id"), keep)


def ablation_grid(pool: DataFrame, ablations: Sequence[Ablation] = ABLATIONS) -> DataFrame:
    """The chosen plan of each query under each configuration."""
    pool = written(pool, "pool")  # every configuration reads it
    parts = [select(pool, a).withColumn("variant", F.lit(a.name)) for a in ablations]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def default_baseline(pool: DataFrame, keep: Sequence[str] = ("plan_id", "pred_cost", "pred_latency")) -> DataFrame:
    """The plan of least predicted cost, whatever the constraints."""
    return pick(pool.where("pred_cost is not null"), ["query_id"], ("pred_cost", "plan_id"), keep)


def greedy_baseline(pool: DataFrame, keep: Sequence[str] = ("plan_id", "pred_cost", "pred_latency")) -> DataFrame:
    """The fastest feasible plan."""
    return pick(constrained(pool).where("feasible"), ["query_id"], ("pred_latency", "pred_cost", "plan_id"), keep)


def diagnostics(pool: DataFrame, slack: float = 0.05) -> DataFrame:
    """Per query: the budget any plan needs, what the fastest needs, the recommended budget and the deficit.

    pool has pred_cost, pred_latency, cost_upper, latency_upper, budget.
    """
    fastest = F.min(F.struct("pred_latency", "plan_id", "cost_upper"))
    by = pool.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_plans"), F.first("budget").alias("budget"), F.min("cost_upper").alias("min_budget_required"), F.max("cost_upper").alias("max_cost_upper"), F.min("pred_cost").alias("min_point_cost"),
        F.min("latency_upper").alias("min_latency_upper"), F.min("pred_latency").alias("min_point_latency"), fastest["cost_upper"].alias("min_budget_for_fastest"),
    )
    return by.withColumns({"recommended_budget": F.col("min_budget_required") * (1 + slack), "deficit": F.greatest(F.lit(0.0), F.col("min_budget_required") - F.col("budget"))})


#: What to do with a query that no plan fits.
INFEASIBLE_MODES = ("min_cost_over_budget", "min_budget_reporting", "formal_refusal")


def resolve_infeasible(pool: DataFrame, mode: str) -> DataFrame:
    """(query_id, mode, refused, plan_id, overrun, reported_budget) of queries without a feasible plan.

    The first mode falls back to the plan of least bound; the second names the budget needed and
    runs nothing; the third refuses.
    """
    if mode not in INFEASIBLE_MODES:
        raise ValueError(f"unknown mode {mode}")
    judged = pool.withColumn("reason", reason(F.col("cost_upper"), F.col("latency_upper"), F.col("budget"), F.col("deadline") if "deadline" in pool.columns else None))
    least = F.min(F.struct("cost_upper", "pred_latency", "plan_id"))
    by = judged.groupBy("query_id").agg(F.count_if(F.col("reason") == "PASSED").alias("ok"), least.alias("b"), F.first("budget").alias("budget")).where("ok = 0")
    none = F.lit(None)
    fallback = mode == INFEASIBLE_MODES[0]
    return by.select(
        "query_id", F.lit(mode).alias("mode"), F.lit(not fallback).alias("refused"), (F.col("b.plan_id") if fallback else none.cast(pool.schema["plan_id"].dataType)).alias("plan_id"),
        (F.greatest(F.lit(0.0), F.col("b.cost_upper") - F.col("budget")) if fallback else F.lit(0.0)).alias("overrun"),
        (none.cast("double") if mode == INFEASIBLE_MODES[2] else F.col("b.cost_upper")).alias("reported_budget"),
    )


def robust_select(bounded: DataFrame, policy: Policy = FASTEST, mode: str = INFEASIBLE_MODES[0]) -> DataFrame:
    """(query_id, plan_id, feasible): bounds filter, frontier on (cost_upper, pred_latency), policy, fallback.

    bounded has cost_upper, latency_upper, pred_cost, pred_latency, budget and deadline.
    """
    fits = constrained(bounded, "cost_upper", "latency_upper").where("feasible")
    front = frontier.sort_scan(fits, cost="cost_upper")
    chosen = decide(front, policy, ["plan_id"]).withColumn("feasible", F.lit(True))
    rest = resolve_infeasible(bounded, mode).select("query_id", "plan_id", F.lit(False).alias("feasible"))
    return chosen.unionByName(rest)


def strategy_choices(pool: DataFrame, seed: int = 0, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """(keys, strategy_name, plan_id) of greedy_cheapest, greedy_fastest, random and oracle.

    The fastest looks among plans within budget and falls back to the cheapest; the oracle does
    so on measured values; random is the plan of least md5 of seed, query and plan. pool has
    pred_cost, pred_latency, actual_cost, actual_latency and budget; nulls can't be chosen.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("plan_id").cast("string")))
    inside = lambda c: (F.col(c) > F.col("budget")).cast("int")
    rules = {
        "greedy_cheapest": [F.col("pred_cost"), F.col("pred_latency")],
        # Within budget by latency, beyond it by cost.
        "greedy_fastest": [inside("pred_cost"), F.when(F.col("pred_cost") <= F.col("budget"), F.col("pred_latency")).otherwise(F.col("pred_cost")), F.col("pred_cost")],
        "oracle": [inside("actual_cost"), F.when(F.col("actual_cost") <= F.col("budget"), F.col("actual_latency")).otherwise(F.col("actual_cost")), F.col("actual_cost")],
        "random": [draw],
    }
    usable = pool.dropna(subset=["pred_cost", "pred_latency", "actual_cost", "actual_latency"])
    aggs = [F.min(F.struct(*[x.alias(f"o{i}") for i, x in enumerate(order)], F.col("plan_id")))["plan_id"].alias(name) for name, order in rules.items()]
    wide = usable.groupBy(*keys).agg(*aggs)
    return wide.unpivot(list(keys), list(rules), "strategy_name", "plan_id")


def replan(pool: DataFrame, tried: DataFrame) -> DataFrame:
    """Per query of tried (query_id, plan_id, pred_cost): the cheapest untried plan that is cheaper than all tried ones."""
    limit = tried.groupBy("query_id").agg(F.min("pred_cost").alias("__limit"))
    left = pool.join(tried.select("query_id", "plan_id"), ["query_id", "plan_id"], "left_anti").join(limit, "query_id").where(F.col("pred_cost") < F.col("__limit"))
    return pick(left, ["query_id"], ("pred_cost", "plan_id"), ("plan_id", "pred_cost"))
