"""Running plans under a budget: monitor, cancel, replan or degrade to a sample."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from costplan.run.runner import Executor, Outcome, PlanToRun


def degraded(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """A seeded Bernoulli sample of a query's output."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    return df.sample(False, fraction, seed)


def accuracy_error(exact_rows: int, sampled_rows: int, fraction: float) -> float:
    """Percent by which the scaled-up sample misses the exact row count."""
    if exact_rows == 0:
        return 0.0 if sampled_rows == 0 else float("inf")
    return abs(sampled_rows / fraction - exact_rows) / exact_rows * 100


@dataclass(frozen=True)
class Progress:
    elapsed: float
    share: float
    projected_cost: float | None


class Monitor:
    """Polls a job group and calls on_overrun once if its projected cost passes the budget.

    Projected is elapsed / share of tasks done * cores * price of a core second. Until a share is
    known nothing is projected; at the end of the run the thread stops.
    """

    def __init__(self, spark: SparkSession, group: str, budget: float, core_second: float, cores: int, on_overrun: Callable[[Progress], None], tolerance: float = 1.0, interval: float = 0.1, least_share: float = 0.01) -> None:
        self.tracker = spark.sparkContext.statusTracker()
        self.group, self.budget, self.rate, self.cores = group, budget, core_second, cores
        self.on_overrun, self.tolerance, self.interval, self.least_share = on_overrun, tolerance, interval, least_share
        self.samples: list[Progress] = []
        self.fired = False
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._began = time.monotonic()

    def start(self) -> Monitor:
        self._began = time.monotonic()
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread.is_alive() and threading.current_thread() is not self._thread:
            self._thread.join(5)

    def done_share(self) -> float:
        """Tasks done over tasks of all submitted stages of the group."""
        done = total = 0
        for job in self.tracker.getJobIdsForGroup(self.group):
            info = self.tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = self.tracker.getStageInfo(stage)
                if s:
                    done, total = done + s.numCompletedTasks, total + s.numTasks
        return done / total if total else 0.0

    def sample(self) -> Progress:
        elapsed, share = time.monotonic() - self._began, self.done_share()
        cost = round(elapsed / share * self.cores * self.rate, 6) if share >= self.least_share else None
        p = Progress(elapsed, share, cost)
        self.samples.append(p)
        return p

    def _watch(self) -> None:
        while not self._stop.wait(self.interval):
            p = self.sample()
            if p.projected_cost is not None and p.share < 1 and p.projected_cost > self.budget * self.tolerance and not self.fired:
                self.fired = True
                self.on_overrun(p)


def cheaper_replanner(pool: Sequence[PlanToRun]) -> Callable[[PlanToRun, set[str]], PlanToRun | None]:
    """Gives the cheapest untried plan of lower predicted cost than the current one, under the same constraints."""

    def replan(current: PlanToRun, tried: set[str]) -> PlanToRun | None:
        left = [p for p in pool if p.query_id == current.query_id and p.plan_id not in tried and p.estimated_cost < current.estimated_cost]
        best = min(left, key=lambda p: (p.estimated_cost, p.plan_id), default=None)
        return replace(best, budget=current.budget, deadline=current.deadline) if best else None

    return replan


@dataclass(frozen=True)
class AdaptiveConfig:
    tolerance: float = 1.0
    max_replans: int = 1
    sample_fraction: float = 0.1
    seed: int = 42
    poll_seconds: float = 0.1


class AdaptiveController:
    """Runs a plan; on a projected overrun cancels it, tries a cheaper plan, then a sampled run.

    Without a budget it is the strict executor. What cancelled attempts cost is carried along.
    Cancelling restarts; a running query is never switched.
    """

    def __init__(self, executor: Executor, config: AdaptiveConfig = AdaptiveConfig(), replanner: Callable[[PlanToRun, set[str]], PlanToRun | None] | None = None) -> None:  # noqa: B008
        self.executor, self.config, self.replanner = executor, config, replanner

    def run(self, plan: PlanToRun) -> Outcome:
        if plan.budget is None:
            return self.executor.execute(plan, "strict")
        tried: set[str] = set()
        wasted, replans = 0.0, 0
        while True:
            tried.add(plan.plan_id)
            outcome = self._attempt(plan, wasted, replans)
            if outcome.status != "cancelled":
                return outcome
            wasted += outcome.spent_cost
            new = self.replanner(plan, tried) if self.replanner and replans < self.config.max_replans else None
            if new is None:
                return self.executor.execute(plan, "degraded", fraction=self.config.sample_fraction, seed=self.config.seed, wasted=wasted, replans=replans)
            plan, replans = new, replans + 1

    def _attempt(self, plan: PlanToRun, wasted: float, replans: int) -> Outcome:
        ex = self.executor
        group = ex.new_group(plan)
        sc = ex.spark.sparkContext
        left = max(0.0, plan.budget - wasted)
        monitor = Monitor(ex.spark, group, left, ex.core_second, ex.cores, lambda p: sc.cancelJobGroup(group), self.config.tolerance, self.config.poll_seconds).start()
        try:
            return ex.execute(plan, "adaptive", group=group, wasted=wasted, replans=replans)
        finally:
            monitor.stop()
