"""Join orders: exhaustive enumeration, beam search, scorers and the cap on analysed variants."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Order = tuple[str, ...]
Scorer = Callable[[Order], float]
MOST_ROWS = 1e18
LARGEST_EXPONENT = 700.0


@dataclass(frozen=True)
class SearchStatistics:
    """Estimated rows of relations and selectivities of join edges."""

    rows: Mapping[str, float] = field(default_factory=dict)
    selectivities: Mapping[tuple[str, str], float] = field(default_factory=dict)


def _graph(aliases: Sequence[str], adjacency: Mapping[str, Iterable[str]]) -> dict[str, set[str]]:
    if len(set(aliases)) != len(aliases):
        raise ValueError("aliases must be distinct")
    graph: dict[str, set[str]] = {a: set() for a in aliases}
    for a, others in adjacency.items():
        for b in others:
            if a not in graph or b not in graph:
                raise ValueError(f"edge {a}-{b} names an unknown alias")
            if a == b:
                raise ValueError("an alias can't join itself")
            graph[a].add(b)
            graph[b].add(a)
    return graph


def all_orders(aliases: Sequence[str], adjacency: Mapping[str, Iterable[str]]) -> list[Order]:
    """Connected left-deep orders other than the given one, for three to five relations."""
    if not 3 <= len(aliases) <= 5:
        return []
    graph = _graph(aliases, adjacency)
    fits = lambda o: all(graph[o[i]] & set(o[:i]) for i in range(1, len(o)))
    return [o for o in itertools.permutations(aliases) if o != tuple(aliases) and fits(o)]


def beam_orders(aliases: Sequence[str], adjacency: Mapping[str, Iterable[str]], score: Scorer, width: int = 20) -> list[Order]:
    """Complete connected orders kept by a beam of the given width, best first.

    A level keeps the best prefix of each starting relation first, then fills up by score; ties
    go by name. A disconnected graph has no complete order.
    """
    if isinstance(width, bool) or not isinstance(width, int) or width < 1:
        raise ValueError("width must be a positive integer")
    graph = _graph(aliases, adjacency)
    level: list[Order] = [(a,) for a in aliases]
    for depth in range(len(aliases)):
        if depth:
            level = [(*p, b) for p in level for b in set().union(*(graph[a] for a in p)) - set(p)]
        scored = []
        for p in set(level):
            s = score(p)
            if not math.isfinite(s):
                raise ValueError(f"score of {p} is not finite")
            scored.append((s, p))
        scored.sort()
        firsts = list({p[0]: (s, p) for s, p in reversed(scored)}.values())
        firsts.sort()
        chosen = firsts[:width]
        taken = set(chosen)
        chosen += [x for x in scored if x not in taken][: width - len(chosen)]
        level = [p for _, p in sorted(chosen)]
    return [p for p in level if len(p) == len(aliases)] if aliases else []


def size_scorer(aliases: Sequence[str], sizes: Mapping[str, float] | None) -> Scorer:
    """Sum over the prefix of ln(1 + cumulated size), sizes over the largest; unknown ones count as the median."""
    usable = {a: float(s) for a, s in (sizes or {}).items() if a in aliases and isinstance(s, (int, float)) and math.isfinite(s) and 0 <= s <= MOST_ROWS}
    middle = median(usable.values()) if usable else 1.0
    filled = {a: usable.get(a, middle) for a in aliases}
    top = max([*filled.values(), 1.0])

    def score(order: Order) -> float:
        return sum(math.log1p(c / top) for c in itertools.accumulate(filled[a] for a in order))

    return score


def cardinality_scorer(aliases: Sequence[str], adjacency: Mapping[str, Iterable[str]], statistics: SearchStatistics | None) -> Scorer | None:
    """Sum over the prefix of ln(1 + estimated rows); None where a row count or selectivity is missing."""
    if statistics is None:
        return None
    graph = _graph(aliases, adjacency)
    rows = {}
    for a in aliases:
        if a not in statistics.rows:
            return None
        rows[a] = float(statistics.rows[a])
        if not (math.isfinite(rows[a]) and rows[a] >= 0):
            raise ValueError(f"row count of {a} is invalid")
    share: dict[frozenset[str], float] = {}
    for (a, b), s in statistics.selectivities.items():
        if a == b or a not in graph or b not in graph:
            raise ValueError(f"selectivity of {a}-{b} names no edge")
        if not (math.isfinite(s) and 0 <= s <= 1):
            raise ValueError(f"selectivity of {a}-{b} must lie in [0, 1]")
        if share.setdefault(frozenset((a, b)), float(s)) != s:
            raise ValueError(f"two selectivities for {a}-{b}")
    if any(frozenset((a, b)) not in share for a in graph for b in graph[a]):
        return None
    log = lambda x: math.log(x) if x > 0 else -math.inf

    def score(order: Order) -> float:
        if len(set(order)) != len(order) or not set(order) <= set(aliases):
            raise ValueError("the order must hold distinct known aliases")
        total, logged = 0.0, 0.0
        for i, a in enumerate(order):
            edges = graph[a] & set(order[:i])
            if i and not edges:
                raise ValueError(f"{a} is not connected to the prefix")
            logged = log(rows[a]) + (logged if i else 0.0) + sum(log(share[frozenset((a, b))]) for b in edges)
            total += math.log1p(math.exp(min(logged, LARGEST_EXPONENT)))
        return total

    return score


def cap_variants(variants: Sequence[tuple[str, Order | None]], score: Scorer, limit: int) -> list[int]:
    """Places of the variants to analyse. variants: (label, order), order None for base strategies.

    Base strategies stay. Orders are ranked with the best of each start first; each gets its
    broadcast variant, then the rest goes order by order to the plain, merge and shuffle-hash ones.
    """
    if len(variants) <= limit:
        return list(range(len(variants)))
    base = [i for i, (_, o) in enumerate(variants) if o is None]
    if len(base) > limit:
        raise ValueError("the limit is below the number of base strategies")
    by_order: dict[Order, list[int]] = {}
    for i, (_, o) in enumerate(variants):
        if o is not None:
            by_order.setdefault(o, []).append(i)
    worth = {o: (score(o), o) for o in by_order}
    best_start = {min((o for o in by_order if o[0] == s), key=worth.__getitem__) for s in {o[0] for o in by_order}}
    queue = sorted(by_order, key=lambda o: (o not in best_start, worth[o]))

    def priority(o: Order, i: int) -> int:
        rest = variants[i][0].removeprefix("join_order_" + "_".join(o))
        return {"_broadcast": 0, "": 1, "_merge": 2, "_shuffle_hash": 3}.get(rest, 4)

    lists = {o: sorted(by_order[o], key=lambda i: (priority(o, i), i)) for o in queue}
    wanted = [lists[o][0] for o in queue] + [i for o in queue for i in lists[o][1:]]
    return sorted(base + wanted[: limit - len(base)])


# Batch forms over DataFrames -------------------------------------------------------------------


def enumerate_orders(edges: DataFrame, most: int) -> DataFrame:
    """(order) for every connected complete order of the aliases in edges(a, b), one join per level."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    nodes = both.select("a").distinct()
    level = nodes.select(F.array("a").alias("order"))
    for _ in range(most - 1):
        grown = level.select("order", F.explode("order").alias("a")).join(both, "a").where(~F.array_contains("order", F.col("b")))
        level = grown.select(F.concat("order", F.array("b")).alias("order")).distinct()
    return level


def keep_beam(prefixes: DataFrame, width: int) -> DataFrame:
    """The beam rule on rows (query_id, order, score): diverse starts first, then by score."""
    by_start = Window.partitionBy("query_id", F.element_at("order", 1)).orderBy("score", "order")
    first = prefixes.withColumn("of_start", F.row_number().over(by_start))
    overall = Window.partitionBy("query_id").orderBy((F.col("of_start") > 1).cast("int"), "score", "order")
    return first.withColumn("beam_rank", F.row_number().over(overall)).where(F.col("beam_rank") <= width).drop("of_start")


def size_score(order: Column, sizes: Column) -> Column:
    """size_scorer as an expression: order array<string>, sizes map<string,double> without gaps."""
    top = F.greatest(F.array_max(F.map_values(sizes)), F.lit(1.0))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))

    def step(acc: Column, a: Column) -> Column:
        c = acc["c"] + F.element_at(sizes, a) / top
        return F.struct(c.alias("c"), (acc["s"] + F.log1p(c)).alias("s"))

    return F.aggregate(order, start, step)["s"]


def cardinality_score(order: Column, rows: Column, selectivities: Column) -> Column:
    """cardinality_scorer as an expression; selectivities is a map keyed 'a|b' in both directions."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0.0).alias("l"), F.lit(0.0).alias("s"))

    def step(acc: Column, a: Column) -> Column:
        edges = F.aggregate(acc["seen"], F.lit(0.0), lambda t, b: t + F.coalesce(F.log(F.try_element_at(selectivities, F.concat_ws("|", a, b))), F.lit(0.0)))
        logged = acc["l"] + F.log(F.element_at(rows, a)) + edges
        return F.struct(F.concat(acc["seen"], F.array(a)).alias("seen"), logged.alias("l"), (acc["s"] + F.log1p(F.exp(F.least(logged, F.lit(LARGEST_EXPONENT))))).alias("s"))

    return F.aggregate(order, start, step)["s"]


def measured_statistics(relations: Mapping[str, DataFrame], edges: Mapping[tuple[str, str], str]) -> SearchStatistics:
    """Counts of (filtered) relations and pairwise selectivities matched / (rows * rows); edges map (a, b) to an ON text."""
    rows = {a: float(df.count()) for a, df in relations.items()}
    share = {}
    for (a, b), on in edges.items():
        matched = relations[a].alias(a).join(relations[b].alias(b), F.expr(on)).count()
        share[a, b] = matched / (rows[a] * rows[b]) if rows[a] and rows[b] else 0.0
    return SearchStatistics(rows, share)


def table_bytes(spark: SparkSession, name: str) -> float | None:
    """Catalyst's size estimate of a table, None outside [0, 1e18]."""
    size = float(str(spark.table(name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if 0 <= size <= MOST_ROWS else None
