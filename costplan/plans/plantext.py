"""Features of physical plans, from their text (as Column expressions) or the operator tree."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Volatile parts of a plan's text and what replaces them.
VOLATILE = ((r"plan_id=\d+", "plan_id=X"), (r"#\d+[A-Za-z]*", "#X"), (r"\*\(\d+\)", "*"), (r"\s+", " "))

#: Counted operators by feature.
COUNTED = {
    "bhj": ("BroadcastHashJoin",), "smj": ("SortMergeJoin",), "shj": ("ShuffledHashJoin",), "bnlj": ("BroadcastNestedLoopJoin",), "nlj": ("NestedLoopJoin", "CartesianProduct"),
    "exchanges": ("Exchange", "BroadcastExchange"), "broadcast_exchanges": ("BroadcastExchange",), "sorts": ("Sort",), "aggregates": ("HashAggregate", "SortAggregate", "ObjectHashAggregate"),
    "filters": ("Filter",), "projects": ("Project",), "scans": ("FileScan", "Scan", "BatchScan", "LocalTableScan", "Range", "InMemoryTableScan"),
}

#: The join operator that names a plan's strategy, first found wins.
STRATEGY = (("bhj", "BroadcastHashJoin"), ("shj", "ShuffledHashJoin"), ("smj", "SortMergeJoin"), ("bnlj", "BroadcastNestedLoopJoin"), ("nlj", "NestedLoopJoin"))

#: The operator each hinted strategy must show.
HINTED = {"broadcast": "broadcasthashjoin", "merge": "sortmergejoin", "shuffle_hash": "shuffledhashjoin"}

#: Bytes of each unit.
UNITS = {"B": 1.0, "KiB": 2.0**10, "MiB": 2.0**20, "GiB": 2.0**30, "TiB": 2.0**40, "PiB": 2.0**50, "EiB": 2.0**60, "KB": 1e3, "MB": 1e6, "GB": 1e9, "TB": 1e12}


def fingerprint_of(text: str) -> str:
    """16 hex digits that don't depend on expression ids, plan ids, codegen numbers and white space."""
    for pattern, new in VOLATILE:
        text = re.sub(pattern, new, text)
    return hashlib.sha256(text.strip().encode()).hexdigest()[:16]


def fingerprint(text: Column) -> Column:
    for pattern, new in VOLATILE:
        text = F.regexp_replace(text, pattern, new)
    return F.substring(F.sha2(F.trim(text), 256), 1, 16)


def operators(plans: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, operator, depth): the operator each plan line starts with, tree marks stripped."""
    lines = plans.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    prefix = F.length(F.regexp_extract("line", r"^[ :+\-]*", 0))
    name = F.regexp_extract("line", r"^[ :+\-]*(?:\*\(\d+\) |\* )?([A-Za-z]+)", 1)
    return lines.select(*keys, "line_no", name.alias("operator"), (F.floor(prefix / 3) + 1).cast("int").alias("depth")).where("operator <> ''")


def features(plans: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Structural features per plan: counts by kind, joins, nodes, depth and the actual join strategy."""
    found = operators(plans, keys, text)
    counts = {k: F.count_if(F.col("operator").isin(*names)).cast("int").alias(k) for k, names in COUNTED.items()}
    by = found.groupBy(*keys).agg(*counts.values(), F.count(F.lit(1)).cast("int").alias("nodes"), F.max("depth").alias("depth"))
    joins = sum((F.col(k) for k in ("smj", "shj", "bnlj", "nlj")), F.col("bhj"))
    strategy = F.coalesce(*[F.when(F.col(k) > 0, F.lit(n)) for k, n in STRATEGY])
    return by.withColumns({"joins": joins, "actual_strategy": F.coalesce(strategy, F.lit("none"))})


def features_of(text: str) -> dict[str, object]:
    """The same for one plan text, on the driver."""
    counts = dict.fromkeys(COUNTED, 0)
    depth = nodes = 0
    for line in text.split("\n"):
        m = re.match(r"^([ :+\-]*)(?:\*\(\d+\) |\* )?([A-Za-z]+)", line)
        if m:
            nodes, depth = nodes + 1, max(depth, len(m[1]) // 3 + 1)
            for k, names in COUNTED.items():
                counts[k] += m[2] in names
    joins = sum(counts[k] for k in ("bhj", "smj", "shj", "bnlj", "nlj"))
    return {**counts, "nodes": nodes, "depth": depth, "joins": joins, "actual_strategy": next((n for k, n in STRATEGY if counts[k]), "none")}


def size_bytes(number: Column, unit: Column) -> Column:
    """A printed size with its unit as bytes."""
    factor = F.coalesce(*[F.when(unit == u, F.lit(f)) for u, f in UNITS.items()])
    return number.try_cast("double") * factor


def explain_cost(plans: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, node, size_bytes, row_count, degenerate) of every EXPLAIN COST line with statistics."""
    lines = plans.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").contains("sizeInBytes="))
    number, unit = (F.regexp_extract("line", r"sizeInBytes=([0-9.]+(?:E[+-]?[0-9]+)?) ?([KMGTPE]?i?B)?", k) for k in (1, 2))
    size = size_bytes(number, F.when(unit == "", "B").otherwise(unit))
    rows = F.regexp_extract("line", r"rowCount=([0-9.]+(?:E[+-]?[0-9]+)?)", 1).try_cast("double")
    node = F.regexp_extract("line", r"^[ :+\-]*(?:\* )?([A-Za-z]+)", 1)
    return lines.select(*keys, "line_no", node.alias("node"), size.alias("size_bytes"), rows.alias("row_count"), (F.coalesce(size, F.lit(0.0)) <= 0).alias("degenerate"))


def matches_hint(text: Column, strategy: Column) -> Column:
    """Whether the plan holds the operator its hint asks for; strategies without a hint always match."""
    low = F.lower(text)
    told = [F.when(strategy.endswith(s), low.contains(op)) for s, op in HINTED.items()]
    return F.coalesce(*told, F.lit(True))


def logical_order(label: Column) -> Column:
    """The join order in a strategy label such as join_order_a_b_c_broadcast."""
    return F.regexp_replace(F.regexp_replace(label, "^join_order_", ""), "_(broadcast|merge|shuffle_hash)$", "")


#: Names of the learned models' 17 features, in order.
VECTOR = (
    "scan_bytes", "shuffle_bytes", "max_intermediate_size", "broadcast_join_sizes", "exchange_count", "broadcast_exchange_count", "bhj_count", "smj_count", "shj_count",
    "bnlj_count", "filter_count", "project_count", "aggregate_count", "sort_count", "tree_depth", "num_nodes", "estimated_rows",
)

_SIZE = re.compile(r"(?:Data size|sizeInBytes)[:=]\s*([0-9.]+(?:E[+-]?\d+)?)\s*([KMGTPE]?i?B)?")
_ROWS = re.compile(r"(?:rowCount=|number of output rows:\s*)([0-9.]+(?:E[+-]?\d+)?)")


def vector_of(text: str, telemetry: dict[str, float] | None = None) -> dict[str, float]:
    """The 17 features of a plan text; telemetry overrides sizes.

    Without a size, shuffled bytes are taken as exchanges * max(0.4 scanned, 65536) and broadcast
    bytes as min(0.15 scanned, 10 MiB) per broadcast.
    """
    f = features_of(text)
    sizes = [float(n) * UNITS.get(u or "B", 1.0) for n, u in _SIZE.findall(text)]
    rows = [float(n) for n in _ROWS.findall(text)]
    told = telemetry or {}
    scan = told.get("scan_bytes", sum(sizes))
    regular = f["exchanges"] - f["broadcast_exchanges"]
    return {
        "scan_bytes": scan, "shuffle_bytes": told.get("shuffle_bytes", regular * max(0.4 * scan, 65536.0)), "max_intermediate_size": told.get("max_intermediate_size", max(sizes, default=0.0)),
        "broadcast_join_sizes": told.get("broadcast_join_sizes", f["broadcast_exchanges"] * min(0.15 * scan, 10 * 2.0**20)), "exchange_count": float(f["exchanges"]),
        "broadcast_exchange_count": float(f["broadcast_exchanges"]), "bhj_count": float(f["bhj"]), "smj_count": float(f["smj"]), "shj_count": float(f["shj"]), "bnlj_count": float(f["bnlj"] + f["nlj"]),
        "filter_count": float(f["filters"]), "project_count": float(f["projects"]), "aggregate_count": float(f["aggregates"]), "sort_count": float(f["sorts"]), "tree_depth": float(f["depth"]),
        "num_nodes": float(f["nodes"]), "estimated_rows": max(rows, default=0.0),
    }
