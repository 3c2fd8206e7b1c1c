"""Prices and predictions of plans as column arithmetic."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GIB = 2.0**30


@dataclass(frozen=True)
class Pricing:
    """Rates in currency units; the defaults are fixed values."""

    currency: str = "USD"
    vcore_hour: float = 0.048
    gb_scanned: float = 0.005
    gb_shuffled: float = 0.010
    gb_memory_hour: float = 0.006
    second_of_latency: float = 0.0


def load_pricing(path: str | None = None) -> Pricing:
    """Rates from a JSON file of sections cpu, io, shuffle, memory and latency; None gives the defaults."""
    if path is None:
        return Pricing()
    with open(path) as f:
        told = json.load(f)
    base = Pricing()
    get = lambda a, b, d: float(told.get(a, {}).get(b, d))
    return Pricing(
        told.get("currency", base.currency), get("cpu", "cost_per_vcore_hour", base.vcore_hour), get("io", "cost_per_gb_scanned", base.gb_scanned),
        get("shuffle", "cost_per_gb_shuffled", base.gb_shuffled), get("memory", "cost_per_gb_hour", base.gb_memory_hour), get("latency", "penalty_per_second", base.second_of_latency),
    )


def cpu_cost(core_seconds: Column, p: Pricing) -> Column:
    """core_seconds are summed over cores already."""
    return core_seconds / F.lit(3600.0) * F.lit(p.vcore_hour)


def io_cost(scanned_bytes: Column, p: Pricing) -> Column:
    return scanned_bytes / F.lit(GIB) * F.lit(p.gb_scanned)


def shuffle_cost(shuffled_bytes: Column, p: Pricing) -> Column:
    return shuffled_bytes / F.lit(GIB) * F.lit(p.gb_shuffled)


def total_cost(core_seconds: Column, scanned: Column, shuffled: Column, p: Pricing) -> Column:
    return cpu_cost(core_seconds, p) + io_cost(scanned, p) + shuffle_cost(shuffled, p)


def price(df: DataFrame, p: Pricing, core_seconds: str = "cpu_seconds", scanned: str = "scanned_bytes", shuffled: str = "shuffled_bytes") -> DataFrame:
    """df with cpu_cost, io_cost, shuffle_cost and total_cost; negative or null resources give null."""
    ok = (F.col(core_seconds) >= 0) & (F.col(scanned) >= 0) & (F.col(shuffled) >= 0)
    parts = {"cpu_cost": cpu_cost(F.col(core_seconds), p), "io_cost": io_cost(F.col(scanned), p), "shuffle_cost": shuffle_cost(F.col(shuffled), p)}
    priced = df.withColumns({k: F.when(ok, v) for k, v in parts.items()})
    return priced.withColumn("total_cost", F.col("cpu_cost") + F.col("io_cost") + F.col("shuffle_cost"))


def cluster_cost(executor_seconds: Column, compute_per_hour: Column, service_per_hour: Column, vcpus: Column) -> Column:
    """A provider's price of executor seconds on instances of vcpus cores."""
    return executor_seconds * (compute_per_hour + service_per_hour) / vcpus / F.lit(3600.0)


@dataclass(frozen=True)
class CloudProfile:
    """A provider's instance: cores and hourly prices."""

    provider: str
    instance: str
    vcpus: int
    compute_per_hour: float
    service_per_hour: float = 0.0

    def cost(self, executor_seconds: float) -> float:
        return executor_seconds * (self.compute_per_hour + self.service_per_hour) / self.vcpus / 3600


def load_cloud_profile(path: str, name: str) -> CloudProfile:
    """A profile by name from a JSON file {name: {provider, instance, vcpus, compute_per_hour, service_per_hour}}."""
    with open(path) as f:
        told = json.load(f)
    if name not in told:
        raise KeyError(name)
    return CloudProfile(**{k: told[name][k] for k in CloudProfile.__dataclass_fields__ if k in told[name]})


@dataclass(frozen=True)
class Priors:
    """Structural priors of the predictor, fixed values."""

    base_cpu: float = 0.25
    unit_bytes: float = 64.0 * 2**20
    join: float = 0.35
    exchange: float = 0.20
    broadcast_exchange: float = 0.08
    sort: float = 0.15
    aggregate: float = 0.12
    filter: float = 0.03
    scan: float = 0.05
    depth: float = 0.02
    latency_cpu: float = 1.0
    latency_exchange: float = 0.15
    latency_sort: float = 0.10
    latency_aggregate: float = 0.05
    broadcast_factor: float = 0.75
    shuffle_hash_factor: float = 1.10
    sort_merge_factor: float = 1.0
    nested_loop_factor: float = 1.5
    least_scale: float = 0.25
    most_scale: float = 1000.0
    intermediate_weight: float = 0.20


def strategy_factor(strategy: Column, k: Priors) -> Column:
    s = F.lower(F.coalesce(strategy, F.lit("")))
    return (
        F.when(s.contains("broadcast"), k.broadcast_factor).when(s.contains("shuffle"), k.shuffle_hash_factor)
        .when(s.contains("sortmerge") | s.contains("sort_merge"), k.sort_merge_factor)
        .when(s.contains("nestedloop") | s.contains("nested_loop"), k.nested_loop_factor).otherwise(1.0)
    )


def predict(plans: DataFrame, k: Priors = Priors(), p: Pricing = Pricing()) -> DataFrame:  # noqa: B008
    """plans with cpu_seconds, scanned_bytes, shuffled_bytes, the cost parts and pred_latency.

    plans has joins, exchanges (broadcasts included), broadcast_exchanges, sorts, aggregates,
    filters, scans, depth, actual_strategy, input_bytes and intermediate_bytes (null: unknown).
    Broadcast exchanges are charged both as exchanges and as broadcasts, a documented prior.
    """
    weights = {"joins": k.join, "exchanges": k.exchange, "broadcast_exchanges": k.broadcast_exchange, "sorts": k.sort, "aggregates": k.aggregate, "filters": k.filter, "scans": k.scan, "depth": k.depth}
    work = sum((F.col(c) * F.lit(w) for c, w in list(weights.items())[1:]), F.col("joins") * F.lit(k.join))
    known = F.col("input_bytes") > 0
    scale = F.when(known, F.least(F.greatest(F.col("input_bytes") / F.lit(k.unit_bytes), F.lit(k.least_scale)), F.lit(k.most_scale))).otherwise(1.0)
    inner = F.when(F.col("intermediate_bytes") > 0, F.least(F.col("intermediate_bytes") / F.lit(k.unit_bytes), F.lit(k.most_scale))).otherwise(0.0)
    cpu = F.greatest(F.lit(0.0), (F.lit(k.base_cpu) + work * scale + F.lit(k.intermediate_weight) * work * inner) * strategy_factor(F.col("actual_strategy"), k))
    scanned = F.when(known, F.col("input_bytes")).otherwise(F.lit(k.unit_bytes) * F.greatest(F.lit(1), F.col("scans")))
    regular = F.greatest(F.lit(0), F.col("exchanges") - F.col("broadcast_exchanges"))
    sized = plans.withColumns({"cpu_seconds": cpu, "scanned_bytes": scanned.cast("double")})
    sized = sized.withColumn("shuffled_bytes", F.col("scanned_bytes") * (regular + 0.25 * F.col("broadcast_exchanges")))
    latency = F.greatest(F.lit(0.001), k.latency_cpu * F.col("cpu_seconds") + k.latency_exchange * F.col("exchanges") + k.latency_sort * F.col("sorts") + k.latency_aggregate * F.col("aggregates"))
    return price(sized.withColumn("pred_latency", latency), p)


def calibrated(df: DataFrame, weights: tuple[float, float, float, float] | None = None) -> DataFrame:
    """df with pred_cost = w0 + w1 cpu + w2 io + w3 shuffle, at least 0; None is the identity."""
    w = (0.0, 1.0, 1.0, 1.0) if weights is None else weights
    cost = F.lit(w[0]) + F.lit(w[1]) * F.col("cpu_cost") + F.lit(w[2]) * F.col("io_cost") + F.lit(w[3]) * F.col("shuffle_cost")
    return df.withColumn("pred_cost", F.greatest(F.lit(0.0), cost))


def analytical_baseline(scan_bytes: Column) -> Column:
    """The legacy one-feature latency model."""
    return F.round(2e-8 * scan_bytes + 0.05, 2)


def priors_as_dict(k: Priors) -> dict[str, float]:
    return asdict(k)
