"""Catalyst statistics of an optimized logical plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

MOST = 1e18


@dataclass(frozen=True)
class PlanStatistics:
    """Bytes of the leaves, of the largest join input, and the first known row count."""

    input_bytes: float | None = None
    intermediate_bytes: float | None = None
    row_count: float | None = None


def _number(value) -> float | None:
    try:
        x = float(str(value))
    except ValueError:
        return None
    return x if 0 <= x <= MOST else None


def plan_statistics(df: DataFrame) -> PlanStatistics:
    """Walks the optimized plan; sizes outside [0, 1e18] count as unknown. Runs no job.

    Statistics are asked for only where they count (root, leaves, inputs of joins), as every
    question is a round trip to the JVM.
    """
    leaves: list[float] = []
    joined: list[float] = []
    rows: list[float] = []

    def size(node) -> float | None:
        return _number(node.stats().sizeInBytes())

    def count(node) -> None:
        if not rows:
            told = node.stats().rowCount()
            if told.isDefined() and (n := _number(told.get())) is not None:
                rows.append(n)

    def walk(node) -> None:
        below = node.children()
        n = below.size()
        if n == 0:
            if (s := size(node)) is not None:
                leaves.append(s)
            count(node)
            return
        is_join = n == 2 and node.nodeName() == "Join"
        for i in range(n):
            child = below.apply(i)
            if is_join and (s := size(child)) is not None:
                joined.append(s)
            walk(child)

    root = df._jdf.queryExecution().optimizedPlan()
    count(root)
    walk(root)
    return PlanStatistics(sum(leaves) if leaves else None, max(joined, default=None), rows[0] if rows else None)


def join_sizes(df: DataFrame) -> list[float | None]:
    """Estimated bytes of every join of the optimized plan, top down; None where they are unknown or beyond 1e18."""
    found: list[float | None] = []
    waiting = [df._jdf.queryExecution().optimizedPlan()]
    while waiting:
        node = waiting.pop(0)
        if node.nodeName() == "Join":
            found.append(_number(node.stats().sizeInBytes()))
        below = node.children()
        waiting += [below.apply(i) for i in range(below.size())]
    return found
