"""Executing plans once or repeatedly, with resources measured from Spark's stages."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costplan.operators import cost as pricing
from costplan.operators.cost import Pricing
from costplan.plans.alternatives import Candidate, plan_text
from costplan.plans.plantext import HINTED, fingerprint_of
from costplan.session import temporary_conf
from costplan.sources.logs import JsonLog, noop


@dataclass(frozen=True)
class PlanToRun:
    query_id: str
    plan_id: str
    sql: str
    strategy: str = "default"
    estimated_cost: float = 0.0
    estimated_latency: float = 0.0
    budget: float | None = None
    deadline: float | None = None
    accuracy_tolerance: float | None = None


@dataclass(frozen=True)
class StageTotals:
    """Resources of a job group; source says where they were read."""

    run_seconds: float = 0.0
    cpu_seconds: float = 0.0
    scanned_bytes: float = 0.0
    shuffled_bytes: float = 0.0
    spilled_bytes: float = 0.0
    n_stages: int = 0
    source: str = "none"


def stage_totals(spark: SparkSession, group: str, wait: float = 5.0) -> StageTotals:
    """Sums of all stages of a job group from the application's status store (the UI may be off)."""
    tracker = spark.sparkContext.statusTracker()
    store = spark.sparkContext._jsc.sc().statusStore()
    end = time.monotonic() + wait
    while True:
        jobs = list(tracker.getJobIdsForGroup(group))
        infos = [tracker.getJobInfo(j) for j in jobs]
        if jobs and all(i is None or i.status != "RUNNING" for i in infos) or time.monotonic() > end:
            break
        time.sleep(0.05)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    total, n = [0.0] * 5, 0
    for stage in {s for i in infos if i for s in i.stageIds}:
        try:
            seq = store.stageData(stage, False, spark._jvm.java.util.ArrayList(), False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0))
        except Exception:  # noqa: BLE001, S112
            continue  # a stage that was skipped has no data
        for k in range(seq.size()):
            d = seq.apply(k)
            n += 1
            for i, v in enumerate((d.executorRunTime() / 1e3, d.executorCpuTime() / 1e9, d.inputBytes(), d.shuffleWriteBytes(), d.diskBytesSpilled())):
                total[i] += v
    return StageTotals(*total, n, "status_store") if n else StageTotals()


@dataclass(frozen=True)
class Outcome:
    """One attempt; actual_cost is None unless it ran to its end."""

    execution_id: str
    query_id: str
    plan_id: str
    strategy: str
    mode: str
    status: str
    latency_seconds: float
    actual_cost: float | None
    spent_cost: float
    totals: StageTotals = field(default_factory=StageTotals)
    error: str | None = None
    wasted_cost: float = 0.0
    replans: int = 0
    sample_fraction: float | None = None
    job_group: str = ""


def was_cancelled(error: BaseException) -> bool:
    """Whether an exception comes from cancelling a job group."""
    text = str(error)
    return "SPARK_JOB_CANCELLED" in text or "XXKDA" in text or "cancelled because" in text.lower()


class Executor:
    """Runs a plan exactly once under a job group of its own and logs every attempt.

    Without a session it only simulates: no job, and the expected cost.
    """

    def __init__(self, spark: SparkSession | None, rates: Pricing = Pricing(), log: JsonLog | None = None, cores: int | None = None) -> None:  # noqa: B008
        self.spark, self.rates, self.log = spark, rates, log
        self.cores = cores or (spark.sparkContext.defaultParallelism if spark else 1)

    @property
    def core_second(self) -> float:
        return self.rates.vcore_hour / 3600

    def new_group(self, plan: PlanToRun) -> str:
        return f"costplan-{plan.query_id}-{plan.plan_id}-{uuid.uuid4().hex[:8]}"

    def execute(self, plan: PlanToRun, mode: str = "strict", group: str | None = None, fraction: float | None = None, seed: int = 42, wasted: float = 0.0, replans: int = 0) -> Outcome:
        group = group or self.new_group(plan)
        began, at = time.monotonic(), time.time()
        base = Outcome(uuid.uuid4().hex, plan.query_id, plan.plan_id, plan.strategy, mode, "ok", 0.0, None, 0.0, wasted_cost=wasted, replans=replans, sample_fraction=fraction, job_group=group)
        if self.spark is None:
            time.sleep(0.01)
            price = plan.estimated_cost * (fraction or 1.0)
            return self._logged(replace(base, status="simulated", latency_seconds=time.monotonic() - began, actual_cost=price, spent_cost=price), plan, at)
        sc = self.spark.sparkContext
        sc.setJobGroup(group, f"{plan.query_id} {plan.plan_id}", interruptOnCancel=True)
        status, error = "ok", None
        try:
            df = self.spark.sql(plan.sql)
            noop(df.sample(False, fraction, seed) if fraction else df)
        except Exception as e:  # noqa: BLE001
            status, error = ("cancelled" if was_cancelled(e) else "failed"), str(e)[:500]
        finally:
            sc._jsc.clearJobGroup()
        latency = time.monotonic() - began
        totals = stage_totals(self.spark, group, 1.0 if status == "ok" else 0.2)
        core_seconds = totals.run_seconds if totals.source != "none" else latency * self.cores
        spent = core_seconds * self.core_second + totals.scanned_bytes / pricing.GIB * self.rates.gb_scanned + totals.shuffled_bytes / pricing.GIB * self.rates.gb_shuffled
        out = replace(base, status=status, error=error, latency_seconds=latency, totals=totals, spent_cost=spent, actual_cost=spent + wasted if status == "ok" else None)
        return self._logged(out, plan, at)

    def _logged(self, o: Outcome, plan: PlanToRun, at: float) -> Outcome:
        if self.log:
            self.log.append({
                "execution_id": o.execution_id, "query_id": o.query_id, "plan_id": o.plan_id, "strategy": o.strategy, "mode": o.mode, "status": o.status, "error": o.error, "started_at": at, "finished_at": at + o.latency_seconds,
                "latency_seconds": o.latency_seconds, "cpu_seconds": o.totals.cpu_seconds, "scanned_bytes": o.totals.scanned_bytes, "shuffled_bytes": o.totals.shuffled_bytes, "metrics_source": o.totals.source, "estimated_cost": plan.estimated_cost,
                "estimated_latency": plan.estimated_latency, "actual_cost": o.actual_cost, "budget": plan.budget, "deadline": plan.deadline, "accuracy_tolerance": plan.accuracy_tolerance, "sample_fraction": o.sample_fraction,
                "replans": o.replans, "wasted_cost": o.wasted_cost, "cores": self.cores, "job_group": o.job_group,
            })
        return o


@dataclass(frozen=True)
class RunSpec:
    query_id: str
    plan_id: str
    strategy: str
    sql: str
    fingerprint: str | None = None
    conf: dict[str, str] = field(default_factory=dict)


class PlanRunner:
    """Warm-ups and repeated runs of a plan under its settings, a telemetry record for each."""

    def __init__(self, spark: SparkSession, warmups: int = 1, repeats: int = 5, cache_state: str = "warm", rates: Pricing = Pricing(), log: JsonLog | None = None, seed: int | None = 42) -> None:  # noqa: B008
        self.spark, self.warmups, self.repeats, self.cache_state = spark, warmups, repeats, cache_state
        self.executor, self.log, self.seed = Executor(spark, rates), log, seed

    def run(self, spec: RunSpec) -> list[dict]:
        with temporary_conf(self.spark, spec.conf):
            aqe = self.spark.conf.get("spark.sql.adaptive.enabled") == "true"
            try:
                executed = fingerprint_of(plan_text(self.spark, spec.sql))
            except Exception as e:  # noqa: BLE001
                return [self._record(spec, 1, None, aqe, None, str(e)[:300])]
            plan = PlanToRun(spec.query_id, spec.plan_id, spec.sql, spec.strategy)
            for _ in range(self.warmups):
                self.executor.execute(plan, "warmup")
            found = []
            for n in range(1, self.repeats + 1):
                if self.cache_state == "cold":
                    self.spark.catalog.clearCache()
                o = self.executor.execute(plan, "measure")
                found.append(self._record(spec, n, o, aqe, executed, o.error))
                if o.status != "ok":
                    break  # a failure is logged once
            return found

    def _record(self, spec: RunSpec, n: int, o: Outcome | None, aqe: bool, executed: str | None, error: str | None) -> dict:
        ok = o is not None and o.status == "ok"
        row = {
            "query_id": spec.query_id, "plan_id": spec.plan_id, "strategy": spec.strategy, "latency_ms": o.latency_seconds * 1e3 if ok else None, "bytes_scanned": o.totals.scanned_bytes if ok else None,
            "bytes_shuffled": o.totals.shuffled_bytes if ok else None, "executor_seconds": o.totals.run_seconds if ok else None, "run_number": n, "cache_state": self.cache_state, "aqe_enabled": aqe,
            "cbo_enabled": self.spark.conf.get("spark.sql.cbo.enabled") == "true", "num_cores": self.executor.cores, "memory_gb": _memory_gb(self.spark), "seed": self.seed, "timestamp": time.time(), "status": o.status if o else "failed", "error": error,
            "actual_cost": o.actual_cost if ok else None, "executor_cpu_seconds": o.totals.cpu_seconds if ok else None, "executor_seconds_source": o.totals.source if ok else None, "plan_fingerprint": spec.fingerprint, "executed_fingerprint": executed,
            # Under AQE the text isn't the plan that runs, so nothing can be verified.
            "plan_verified": None if aqe or spec.fingerprint is None else executed == spec.fingerprint,
        }
        if self.log:
            self.log.append(row)
        return row


def _memory_gb(spark: SparkSession) -> float:
    return float(spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()) / 2**30


#: The four settings under which Spark's own choice is measured.
DEFAULTS = {f"spark_default_cbo_{c}_aqe_{a}": {"spark.sql.cbo.enabled": v, "spark.sql.cbo.joinReorder.enabled": v, "spark.sql.adaptive.enabled": w, "spark.sql.autoBroadcastJoinThreshold": "10485760"} for c, v in (("off", "false"), ("on", "true")) for a, w in (("off", "false"), ("on", "true"))}


def measure_query(runner: PlanRunner, query_id: str, sql: str, found: Sequence[Candidate], most: int = 48) -> DataFrame:
    """Telemetry of every candidate (at most `most`, in their order) and of Spark's own four choices."""
    rows = []
    for c in list(found)[:most]:
        rows += runner.run(RunSpec(query_id, c.plan_id, c.strategy, c.sql, c.fingerprint))
    for name, conf in DEFAULTS.items():
        rows += runner.run(RunSpec(query_id, f"{query_id}_{name}", name, sql, conf=conf))
    from costplan.sources.logs import TELEMETRY

    return runner.spark.createDataFrame([tuple(r.get(f) for f in TELEMETRY.names) for r in rows], TELEMETRY)


def hint_held(spark: SparkSession, c: Candidate) -> bool:
    """Whether a candidate's plan shows the operator its hint asks for."""
    for suffix, op in HINTED.items():
        if c.strategy.endswith(suffix):
            return op in (c.plan or plan_text(spark, c.sql)).lower()
    return True


@contextlib.contextmanager
def background_load(spark: SparkSession, sql: str, threads: int) -> Iterator[None]:
    """Other work that runs the query again and again until the block ends."""
    stop, group = threading.Event(), f"costplan-load-{uuid.uuid4().hex[:8]}"

    def loop() -> None:
        spark.sparkContext.setJobGroup(group, "background load", interruptOnCancel=True)
        while not stop.is_set():
            with contextlib.suppress(Exception):
                noop(spark.sql(sql))

    workers = [threading.Thread(target=loop, daemon=True) for _ in range(threads)]
    for w in workers:
        w.start()
    try:
        yield
    finally:
        stop.set()
        spark.sparkContext.cancelJobGroup(group)
        for w in workers:
            w.join(10)


def as_rows(spark: SparkSession, outcomes: Sequence[Outcome]) -> DataFrame:
    """Outcomes as a DataFrame."""
    flat = [{k: v for k, v in asdict(o).items() if k != "totals"} | {f"total_{k}": v for k, v in asdict(o.totals).items()} for o in outcomes]
    schema = "execution_id string, query_id string, plan_id string, strategy string, mode string, status string, latency_seconds double, actual_cost double, spent_cost double, error string, wasted_cost double, replans int, sample_fraction double, job_group string"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in flat], schema).withColumn("measured", F.col("actual_cost").isNotNull())
