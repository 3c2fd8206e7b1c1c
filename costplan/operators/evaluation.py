"""Evaluation of choices and statistics of outcomes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costplan.functions import geometric_mean
from costplan.operators.ordered import numbered, running_total
from costplan.session import written


def _cell(v: Column) -> Column:
    """A number that grows with v, in steps of about 1/256 of its size."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * 256)


def tie_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """df with 0-based ranks of value in its group, ties averaged.

    Ranks come from counts of distinct values and their running totals, summed within cells of
    the value's size, so a group's rows never have to meet in one task.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    before = running_total(counts, keys, [value], "__n", _cell(F.col(value).cast("double")), "__before")
    placed = before.select(*keys, value, (F.col("__before") + (F.col("__n") - 1) / 2).alias(name))
    return df.join(placed, [*keys, value])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): correlation of tie-averaged ranks, 0 for fewer than two rows or no variance."""
    rows = df.dropna(subset=[x, y]).select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"))
    both = tie_ranks(tie_ranks(rows, keys, "__x", "__rx"), keys, "__y", "__ry")
    sums = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("__rx", "__ry").alias("c"), (F.stddev_pop("__rx") * F.stddev_pop("__ry")).alias("s"))
    # corr() itself fails on a group without variance.
    return sums.select(*keys, "n", F.when(F.col("s") > 0, F.col("c") / F.col("s")).otherwise(0.0).alias("rho"))


def kendall(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, tau): Kendall's tau-a, counted without pairs.

    Walking up a binary tree over the positions of x's distinct values, every two rows with
    different x meet exactly once, as left and right child of one node; the tree is as high as a
    group's number of distinct x needs. In a node the pairs in equal or opposite order are
    counted from running counts by y: n log n rows in all. Positions and running counts are
    summed within cells, so neither a group nor the topmost node has to meet in one task.
    """
    rows = df.dropna(subset=[x, y]).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    # -0.0 equals 0.0.
    rows = written(rows.withColumns({"__x": F.col("__x") + 0.0, "__y": F.col("__y") + 0.0}), "ranked")
    place = lambda c, name: numbered(rows.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__c")).drop("__c"), keys, [c], _cell(F.col(c)), name)
    same = lambda a, b, c: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*keys, c]]
    at_x, at_y = place("__x", "__i"), place("__y", "__j")
    coded = rows.alias("r").join(at_x.alias("p"), same("r", "p", "__x")).select("r.*", (F.col("p.__i") - 1).alias("__i"))
    coded = coded.alias("r").join(at_y.alias("p"), same("r", "p", "__y")).select(*[F.col(f"r.{k}").alias(k) for k in keys], "r.__i", "p.__j")
    coded = written(coded.groupBy(*keys, "__i", "__j").agg(F.count(F.lit(1)).alias("c")), "coded")
    high = coded.groupBy(*keys).agg(F.ceil(F.log2(F.max("__i") + 1)).cast("int").alias("__high"))
    tall = coded.alias("r").join(high.alias("p"), same("r", "p", "__high")[:-1]).where("p.__high > 0").select("r.*", F.explode(F.sequence(F.lit(0), F.col("p.__high") - 1)).alias("__b"))
    right = F.expr("shiftright(__i, __b) & 1")
    node = tall.groupBy(*keys, "__b", F.expr("shiftright(__i, __b + 1)").alias("__node"), "__j").agg(F.sum(F.when(right == 0, F.col("c")).otherwise(0)).alias("__l"), F.sum(F.when(right == 1, F.col("c")).otherwise(0)).alias("__r"))
    node = written(node, "nodes")
    own = [*keys, "__b", "__node"]
    below = running_total(node, own, ["__j"], "__l", F.floor(F.col("__j") / 4096), "__below")
    totals = node.groupBy(*own).agg(F.sum("__l").alias("__all"))
    counted = below.alias("r").join(totals.alias("p"), [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in own])
    above = F.col("p.__all") - F.col("r.__below") - F.col("r.__l")
    sums = counted.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys]).agg(F.sum(F.col("r.__r") * (F.col("r.__below") - above)).alias("s"))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    size = F.col("a.n").cast("double")
    tau = F.when(size < 2, 0.0).otherwise(F.coalesce("b.s", F.lit(0)) / (size * (size - 1) / 2))
    both = n.alias("a").join(sums.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    return both.select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.n", tau.alias("tau"))


def top1_hits(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: queries of two plans or more, and the share whose predicted best is the measured best (ties by plan)."""
    best = lambda c: F.min(F.struct(c, "plan_id"))["plan_id"]
    by = df.dropna(subset=[predicted, actual]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), best(predicted).alias("p"), best(actual).alias("a")).where("n >= 2")
    return by.agg(F.count(F.lit(1)).alias("n_queries"), F.avg((F.col("p") == F.col("a")).cast("double")).alias("hit_rate"))


def outcomes(pool: DataFrame, multipliers: Sequence[float], choices) -> DataFrame:
    """(query_id, multiplier, strategy_name, plan_id, cost, latency, violated, regret, speedup).

    A query's budget is the multiplier times its least measured cost. choices(pool with budget,
    keys) gives (query_id, multiplier, strategy_name, plan_id). regret is latency over the oracle's less one; speedup
    is against the plan of least predicted cost.
    """
    pool = written(pool, "pool")  # read twice
    least = pool.groupBy("query_id").agg(F.min("actual_cost").alias("least"), F.min(F.struct("pred_cost", "plan_id", "actual_latency"))["actual_latency"].alias("reference"))
    each = F.explode(F.array(*[F.lit(float(m)) for m in multipliers])).alias("multiplier")
    with_budget = written(pool.join(least, "query_id").select("*", each).withColumn("budget", F.col("multiplier") * F.col("least")), "budgets")
    keys = ["query_id", "multiplier"]
    out = written(choices(with_budget, keys).join(with_budget.select(*keys, "plan_id", "actual_cost", "actual_latency", "budget", "reference"), [*keys, "plan_id"]), "outcomes")
    oracle = out.where("strategy_name = 'oracle'").select("query_id", "multiplier", F.col("actual_latency").alias("best"))
    joined = out.join(oracle, ["query_id", "multiplier"], "left")
    return joined.select(
        "query_id", "multiplier", "strategy_name", "plan_id", F.col("actual_cost").alias("cost"), F.col("actual_latency").alias("latency"), (F.col("actual_cost") > F.col("budget")).alias("violated"),
        (F.try_divide("actual_latency", "best") - 1).alias("regret"), F.try_divide("reference", "actual_latency").alias("speedup"),
    )


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation; nulls are left out.

    Spark's percentile keeps counts of distinct values per group, which suits outcome tables; for
    billions of values use the mergeable sketch of the training-data operators.
    """
    return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in shares.items()])


def summary(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: n, median, p90 and p99 latency, mean cost, violation rate, mean regret, geometric mean speedup."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("latency", F.lit(0.5)).alias("median_latency"), F.percentile("latency", F.lit(0.9)).alias("p90_latency"), F.percentile("latency", F.lit(0.99)).alias("p99_latency"),
        F.avg("cost").alias("mean_cost"), F.avg(F.col("violated").cast("double")).alias("violation_rate"), F.avg("regret").alias("mean_regret"), geometric_mean(F.col("speedup")).alias("geomean_speedup"),
    )


def _median_ranks(rounds: int):
    """Ranks (1 to n) whose values average to the median of a resample, for each row (keys.., n, seed) and round.

    The k-th of n resampled ranks is ceil(n U) for the k-th of n uniforms, which is beta
    distributed, so a round needs one or two draws whatever n is.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                rng = np.random.default_rng(int(row["__seed"]) & (2**63 - 1))
                n = int(row["n"])
                k = (n + 1) // 2
                low = rng.beta(k, n + 1 - k, rounds)
                high = low if n % 2 else low + (1 - low) * rng.beta(1, n - k, rounds)
                rank = lambda u: np.clip(np.ceil(n * u), 1, n).astype(np.int64)  # noqa: B023, E731
                yield pd.DataFrame({"__key": row["__key"], "__round": np.arange(rounds), "__lo": rank(low), "__hi": rank(high)})

    return work


def bootstrap_median(df: DataFrame, keys: Sequence[str], value: str, rounds: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(keys, n, median, low, high): percentile interval of the median over seeded resamples of n values with replacement.

    A resample's median is fixed by the ranks drawn for it (see _median_ranks), so rounds draw
    ranks, not rows: their cost doesn't grow with n. Values at ranks are found from counts of
    distinct values and running totals in cells. Null values are left out.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("__key"), x.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    placed = written(running_total(rows, ["__key"], ["__v"], "__c", _cell(F.col("__v")), "__before"), "placed")
    sizes = placed.groupBy("__key").agg(F.sum("__c").alias("n")).withColumn("__seed", F.xxhash64("__key", F.lit(seed)))
    drawn = written(sizes.select("__key", "n", "__seed").mapInPandas(_median_ranks(rounds), "__key string, __round long, __lo long, __hi long"), "drawn")
    middle = sizes.select("__key", F.lit(-1).cast("long").alias("__round"), F.floor((F.col("n") + 1) / 2).alias("__lo"), F.floor(F.col("n") / 2 + 1).alias("__hi"))
    asked = drawn.union(middle)
    spots = asked.select("__key", F.explode(F.array("__lo", "__hi")).alias("__at")).distinct()
    span = spots.groupBy("__key").agg(F.min("__at").alias("__from"), F.max("__at").alias("__to"))
    # Only values that some wanted rank can fall on take part in the ordered pass: about the root of n of them.
    near = placed.join(span, "__key").where("__before < __to and __before + __c >= __from").select("__key", (F.col("__before") + 1).alias("__at"), "__v")
    events = near.unionByName(spots.withColumn("__v", F.lit(None).cast("double")))
    order = Window.partitionBy("__key").orderBy("__at", F.col("__v").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = written(events.withColumn("__x", F.last("__v", ignorenulls=True).over(order)).where("__v is null").select("__key", "__at", "__x"), "ranks")
    at = lambda c: found.select("__key", F.col("__at").alias(c), F.col("__x").alias(f"{c}_x"))
    medians = asked.join(at("__lo"), ["__key", "__lo"]).join(at("__hi"), ["__key", "__hi"]).select("__key", "__round", ((F.col("__lo_x") + F.col("__hi_x")) / 2).alias("m"))
    tail = (1 - level) / 2
    drawn_only = F.when(F.col("__round") >= 0, F.col("m"))
    limits = medians.groupBy("__key").agg(F.max(F.when(F.col("__round") < 0, F.col("m"))).alias("median"), F.percentile(drawn_only, F.lit(tail)).alias("low"), F.percentile(drawn_only, F.lit(1 - tail)).alias("high"))
    named = F.from_json("__key", df.select(*keys).schema)
    return limits.join(sizes.select("__key", "n"), "__key").select(*[named[k].alias(k) for k in keys], "n", "median", "low", "high")


def summary_with_intervals(results: DataFrame, keys: Sequence[str], rounds: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """summary() with the median cost and the bootstrap intervals of median latency and median cost."""
    results = written(results, "results")
    out = summary(results, keys)
    for value in ("latency", "cost"):
        ci = bootstrap_median(results, keys, value, rounds, level, seed).select(*[F.col(k).alias(f"__{k}") for k in keys], *([F.col("median").alias("median_cost")] if value == "cost" else []), F.col("low").alias(f"{value}_ci_low"), F.col("high").alias(f"{value}_ci_high"))
        out = out.join(ci, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])
    return out


def wilcoxon(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Signed-rank sums of x - y per group: wins (x < y), losses, ties, n, median_diff, w_plus, w_minus, z.

    Differences within 1e-9 of the larger value are ties and don't rank; equal sizes share ranks.
    z is the normal approximation with the tie correction, null if nothing ranks.
    """
    d = F.col(x) - F.col(y)
    tied = F.abs(d) <= 1e-9 * F.greatest(F.abs(F.col(x)), F.abs(F.col(y)))
    rows = pairs.dropna(subset=[x, y]).select(*keys, F.when(tied, 0.0).otherwise(d).alias("__d"))
    base = rows.groupBy(*keys).agg(F.count_if(F.col("__d") < 0).alias("wins"), F.count_if(F.col("__d") > 0).alias("losses"), F.count_if(F.col("__d") == 0).alias("ties"), F.percentile("__d", F.lit(0.5)).alias("median_diff"))
    live = tie_ranks(rows.where("__d <> 0").withColumn("__a", F.abs("__d")), keys, "__a", "__r").withColumn("__r", F.col("__r") + 1)
    sums = live.groupBy(*keys).agg(F.sum(F.when(F.col("__d") > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("__d") < 0, F.col("__r")).otherwise(0.0)).alias("w_minus"), F.count(F.lit(1)).alias("n"))
    ties = live.groupBy(*keys, "__a").agg(F.count(F.lit(1)).alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("__ties"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("__ties") / 48
    z = F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var))
    joined = base.join(sums, list(keys), "left").join(ties, list(keys), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(*keys, "wins", "losses", "ties", zero("n"), "median_diff", F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"), z.alias("z"))


def normal_p(z: float | None) -> float:
    """Two-sided p of a normal statistic; 1 for none."""
    return 1.0 if z is None else math.erfc(abs(z) / math.sqrt(2))


def exact_wilcoxon_p(n: int, w: float) -> float:
    """Two-sided exact p of the smaller rank sum w without ties, by counting subsets of 1..n."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return min(1.0, 2 * sum(ways[: int(math.floor(w)) + 1]) / 2**n)


def holm(tests: DataFrame, keys: Sequence[str], p: str = "p", tie: str = "name") -> DataFrame:
    """tests with p_adjusted, Holm's step-down within each family of tests."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    order = own.orderBy(p, tie)
    step = tests.withColumns({"__m": F.count(F.lit(1)).over(own), "__k": F.row_number().over(order)})
    adj = F.least(F.lit(1.0), (F.col("__m") - F.col("__k") + 1) * F.col(p))
    return step.withColumn("p_adjusted", F.max(adj).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__m", "__k")


def same_results(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, relative: float = 1e-12, absolute: float = 1e-8) -> DataFrame:
    """One row: keys of either side, those in one only, those whose values differ beyond tolerance, repeated keys and equal.

    A repeated key on either side makes the results incomparable (equal is false).
    """
    one = a.groupBy(*keys).agg(F.max(value).alias("x"), F.count(F.lit(1)).alias("na"))
    two = b.groupBy(*keys).agg(F.max(value).alias("y"), F.count(F.lit(1)).alias("nb"))
    cond = [one[k].eqNullSafe(two[k]) for k in keys]
    both = one.join(two, cond, "full")
    close = F.col("x").eqNullSafe(F.col("y")) | (F.abs(F.col("x") - F.col("y")) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs("x"), F.abs("y"))))
    out = both.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("na").isNull() | F.col("nb").isNull()).alias("n_missing"), F.count_if(~F.coalesce(close, F.lit(False))).alias("n_different"), F.count_if((F.col("na") > 1) | (F.col("nb") > 1)).alias("n_repeated"))
    return out.withColumn("equal", (F.col("n_missing") + F.col("n_different") + F.col("n_repeated")) == 0)

