"""Splits that keep related records together.

Records that share an entity, directly or by a chain of links, form a component; components are
bundled by equal size and label profile, a min-cost flow over bundles and splits, with the
deviations from the quotas as its cost, says how many of them go to each split, and the members
are dealt out in the order of a hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costplan.llm.components import components
from costplan.session import written


def canonical_query(c: Column) -> Column:
    """A query's letter and number, however written: 'q_0012 ' gives Q12; null if it has none."""
    plain = F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.when(plain == "", None).otherwise(F.regexp_replace(plain, r"^(\p{L}+)0+(?=\d)", "$1"))


def canonical_plan(c: Column) -> Column:
    """A plan's query and plan number, however written: 'q12-p007' gives Q12P7; null if it has none."""
    return F.regexp_replace(canonical_query(c), r"(?<=\d\p{L})0+(?=\d)", "")


def _move_costs(flow: np.ndarray, within: np.ndarray, step: float, label_weight: float, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Least cost to move `units` components from split j to split k by any one group, and that group: (cost[j, k], group[j, k])."""
    less = np.where(flow >= units, np.abs(within - units * step) - np.abs(within), np.inf)
    more = np.abs(within + units * step) - np.abs(within)
    change = label_weight * (less[:, :, None] + more[:, None, :])
    group = change.argmin(axis=0)
    cost = np.take_along_axis(change, group[None], axis=0)[0]
    np.fill_diagonal(cost, np.inf)
    return cost, group


def _negative_cycle(cost: np.ndarray) -> list[int] | None:
    """Nodes of a cycle of negative cost in a dense graph, in its order; None if there is none (Bellman and Ford)."""
    n = len(cost)
    far, via = np.zeros(n), np.full(n, -1)
    last = -1
    for _ in range(n):
        through = far[:, None] + cost
        best = through.argmin(axis=0)
        value = through[best, np.arange(n)]
        better = value < far - 1e-9
        if not better.any():
            return None
        far, via = np.where(better, value, far), np.where(better, best, via)
        last = int(np.flatnonzero(better)[0])
    for _ in range(n):  # into the cycle
        last = int(via[last])
    cycle, at = [last], int(via[last])
    while at != last:
        cycle.append(at)
        at = int(via[at])
    return cycle[::-1]


def solve_class(step: float, count: np.ndarray, quota: np.ndarray, rows: np.ndarray, within: np.ndarray, label_weight: float) -> np.ndarray:
    """The flow of least cost of components of one size (step rows each) from groups to splits; exact.

    rows and within are the deviations (of splits; of groups and splits) that larger components
    left; both are updated. The network is groups -> splits -> sink with convex costs
    label_weight * |within| on the first arcs and |rows| on the last ones. The flow starts from
    the quotas, rounded.
    """
    flow = np.floor(count[:, None] * quota + 1e-9).astype(np.int64)
    rows += step * (flow - count[:, None] * quota).sum(axis=0)
    within += step * (flow - count[:, None] * quota)
    for g, left in enumerate(count - flow.sum(axis=1)):
        for _ in range(int(left)):
            add = np.abs(rows + step) - np.abs(rows) + label_weight * (np.abs(within[g] + step) - np.abs(within[g]))
            j = int(add.argmin())
            flow[g, j] += 1
            rows[j] += step
            within[g, j] += step
    cancel_cycles(step, flow, rows, within, label_weight)
    return flow


def cancel_cycles(step: float, flow: np.ndarray, rows: np.ndarray, within: np.ndarray, label_weight: float) -> bool:
    """Makes flow, in place, one of least cost; whether anything changed.

    Negative cycles of the residual network are cancelled, first for steps of many components,
    then of fewer, at last of one: a flow of convex costs without a negative cycle of single
    components is of least cost.
    """
    k, changed = len(rows), False
    units = 1 << max(int(flow.max(initial=0)).bit_length() - 1, 0)
    while units:
        cost, group = _move_costs(flow, within, step, label_weight, units)
        graph = np.full((k + 1, k + 1), np.inf)
        graph[:k, :k] = cost
        graph[:k, k] = np.abs(rows + units * step) - np.abs(rows)
        graph[k, :k] = np.abs(rows - units * step) - np.abs(rows)
        cycle = _negative_cycle(graph)
        if cycle is None:
            units //= 2
            continue
        changed = True
        for a, b in zip(cycle, cycle[1:] + cycle[:1]):
            if a == k:
                rows[b] -= units * step
            elif b == k:
                rows[a] += units * step
            else:
                g = group[a, b]
                flow[g, a] -= units
                flow[g, b] += units
                within[g, a] -= units * step
                within[g, b] += units * step
    return changed


def allocate(groups: Sequence[tuple[int, str, int]], shares: dict[str, float], label_weight: float = 0.25) -> np.ndarray:
    """How many components of each group (size, label shares, components) go to each split.

    The cost is the sum of the splits' deviations from their quotas in rows, plus label_weight
    times the deviations within each kind of label shares. The fractional optimum gives each
    split its share of every group. Rounding it for components of different sizes at once is a
    partition problem, so sizes are taken from the largest to the smallest: each is a min-cost
    flow, solved exactly (solve_class), that also makes up for what larger ones left. That is
    repeated until no size's flow can be bettered while the others stay. Shares need not sum to
    1; the order of splits is that of their names.
    """
    names = sorted(shares)
    quota = np.array([float(shares[k]) for k in names])
    if not len(names) or (quota < 0).any() or quota.sum() <= 0:
        raise ValueError("shares must be positive")
    quota = quota / quota.sum()
    flow = np.zeros((len(groups), len(names)), np.int64)
    kinds: dict[str, int] = {}
    of_size: dict[int, list[int]] = {}
    for i, (size, kind, _) in enumerate(groups):
        kinds.setdefault(kind, len(kinds))
        of_size.setdefault(size, []).append(i)
    rows, within = np.zeros(len(names)), np.zeros((len(kinds), len(names)))
    for size in sorted(of_size, reverse=True):
        own = of_size[size]
        at = np.array([kinds[groups[i][1]] for i in own])
        part = within[at]
        flow[own] = solve_class(float(size), np.array([groups[i][2] for i in own], np.int64), quota, rows, part, label_weight)
        within[at] = part
    changed = True
    while changed:
        changed = False
        for size in sorted(of_size, reverse=True):
            own = of_size[size]
            at = np.array([kinds[groups[i][1]] for i in own])
            part, mine = within[at], flow[own]
            if cancel_cycles(float(size), mine, rows, part, label_weight):
                flow[own], within[at], changed = mine, part, True
    return flow


def stride(n: int) -> int:
    """A number without common divisor with n near n over the golden ratio: multiples of it, modulo n, spread evenly."""
    m = max(1, round(n * 0.6180339887498949))
    while math.gcd(m, n) > 1:
        m += 1
    return m


def tied_components(df: DataFrame, entity: str, link: str) -> tuple[DataFrame, DataFrame]:
    """Components of df's rows by two keys; adds nothing but __component to the rows.

    Rows with the same entity are tied, and rows with the same link tie their entities. A null
    ties nothing: a row without entity goes with its link, one without either stays alone
    (its key is made of all its values). Returns the rows and the (node, component) map of
    those entities that a link ties to another.
    """
    spark = df.sparkSession
    pairs = df.where(F.col(entity).isNotNull() & F.col(link).isNotNull()).select(F.col(entity).alias("e"), F.col(link).alias("l")).distinct()
    pairs = written(pairs, "ties")
    first = pairs.groupBy("l").agg(F.min("e").alias("first"), F.max("e").alias("last"))
    edges = pairs.join(first.where(F.col("first") != F.col("last")), "l").select(F.col("e").alias("u"), F.col("first").alias("v"))
    nodes = components(edges)
    nodes = written(nodes, "components")
    # Rows with an entity: their component is that of the entity. AQE splits a hot entity.
    named = df.where(F.col(entity).isNotNull()).join(nodes, F.col(entity) == F.col("node"), "left").withColumn("__component", F.concat(F.lit("e:"), F.coalesce("component", entity))).drop("node", "component")
    orphans = df.where(F.col(entity).isNull())
    through = first.join(nodes, F.col("first") == F.col("node"), "left").select(F.col("l").alias("__l"), F.coalesce("component", "first").alias("__c"))
    alone = F.concat(F.lit("r:"), F.sha2(F.to_json(F.struct(*df.columns)), 256))
    orphans = orphans.join(through, F.col(link) == F.col("__l"), "left").withColumn("__component", F.coalesce(F.concat(F.lit("e:"), F.col("__c")), F.concat(F.lit("l:"), F.col(link)), alone)).drop("__l", "__c")
    return named.unionByName(orphans), nodes


def _profiles(parts: Column, size: Column) -> tuple[Column, Column]:
    """A component's labels with their counts, 'broadcast:3,default:5', and with their shares in quarters."""
    text = lambda share: F.array_join(F.transform(F.array_sort(F.filter(F.transform(parts, lambda p: F.struct(p["label"].alias("label"), share(p).alias("q"))), lambda p: p["q"] > 0)), lambda p: F.concat(p["label"], F.lit(":"), p["q"].cast("string"))), ",")
    return text(lambda p: p["n"]), text(lambda p: F.round(4 * p["n"] / size).cast("long"))


def grouped_splits(df: DataFrame, entity: str, link: str, label: str, shares: dict[str, float], seed: int = 0, cell: int = 20_000) -> DataFrame:
    """df's distinct rows with __component and __split: related rows share a split.

    entity and link are columns of canonical keys (see canonical_query, canonical_plan). A bundle
    is the components of equal size and identical label counts. The flow runs over the groups of
    bundles that are equal in size and, to the quarter, in label shares, so what reaches the
    driver is bounded by distinct sizes (at most the root of twice the rows) times such shares,
    never components or rows. A group's components are put in the order of bundle and hash, and
    the position times a stride, modulo their number, says the split: every split gets exactly its
    flow, and every bundle, a run of positions, is spread evenly over the splits. Positions are
    ranks in cells of about `cell` components plus the cells' counts: no bundle has to fit into
    one task. A null label is a label of its own; redelivered rows count once; an empty table
    gives no rows. A component larger than every quota goes where it deviates least.
    """
    spark = df.sparkSession
    clash = {"__component", "__split", "__cell", "__rank", "__before", "__group"} & set(df.columns)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    rows, _ = tied_components(df.distinct(), entity, link)
    rows = written(rows, "tied")
    by_label = rows.groupBy("__component", F.coalesce(F.col(label), F.lit("∅")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    sized = by_label.groupBy("__component").agg(F.sum("n").alias("size"), F.collect_list(F.struct("label", "n")).alias("parts"))
    bundle, kind = _profiles(F.col("parts"), F.col("size"))
    sized = written(sized.select("__component", "size", bundle.alias("bundle"), kind.alias("kind")), "sized")
    groups = [tuple(r) for r in sized.groupBy("size", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy("size", "kind").collect()]
    names = sorted(shares)
    plan = [(s, p, n, stride(n), *np.cumsum(f).tolist()) for (s, p, n), f in zip(groups, allocate(groups, shares))]
    limits = spark.createDataFrame(plan, "size long, kind string, __n long, __stride long, " + ", ".join(f"to_{k} long" for k in range(len(names))))
    h = F.xxhash64("__component", F.lit(seed))
    cells = F.ceil(F.col("__n") / cell)
    placed = sized.join(limits, ["size", "kind"]).withColumns({"__h": h, "__cell": F.floor((F.shiftrightunsigned(h, 33) / F.lit(2.0**31)) * cells)})
    one = ["size", "kind", "bundle", "__cell"]
    counts = placed.groupBy(*one).agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("size", "kind").orderBy("bundle", "__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*one, before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy(*one).orderBy("__h", "__component"))
    ranked = placed.withColumn("__rank", rank).join(offsets, one)
    wide = lambda c: c.cast("decimal(19,0)")
    slot = F.pmod(wide(F.col("__rank") + F.col("__before") - 1) * wide(F.col("__stride")), wide(F.col("__n")))
    split = F.coalesce(*[F.when(slot < F.col(f"to_{k}"), F.lit(name)) for k, name in enumerate(names)])
    dealt = written(ranked.select("__component", split.alias("__split")), "dealt")
    return rows.join(dealt, "__component")
