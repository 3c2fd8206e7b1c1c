"""Sinks and readers for runs: telemetry, execution log, calibration samples, measurements, results."""

from __future__ import annotations

import json
import math
import os
import threading
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def noop(df: DataFrame) -> None:
    """Runs the full plan and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()

#: Required telemetry fields in order: type, nullable.
REQUIRED = {
    "query_id": (_S, False), "plan_id": (_S, False), "strategy": (_S, False), "latency_ms": (_D, True), "bytes_scanned": (_D, True), "bytes_shuffled": (_D, True), "executor_seconds": (_D, True),
    "run_number": (_I, False), "cache_state": (_S, False), "aqe_enabled": (_B, False), "cbo_enabled": (_B, False), "num_cores": (_I, False), "memory_gb": (_D, False), "seed": (_I, True), "timestamp": (_D, False),
}
OPTIONAL = {
    "status": _S, "error": _S, "actual_cost": _D, "executor_cpu_seconds": _D, "executor_seconds_source": _S, "experiment": _S, "scenario": _S, "plan_fingerprint": _S, "executed_fingerprint": _S, "plan_verified": _B,
    "extra": T.MapType(_S, _S),
}
TELEMETRY = T.StructType([T.StructField(n, t) for n, (t, _) in REQUIRED.items()] + [T.StructField(n, t) for n, t in OPTIONAL.items()])
CACHE_STATES, STATUSES = ("cold", "warm"), ("ok", "failed", "cancelled")


def problems(record: Mapping[str, object]) -> list[str]:
    """What is wrong with a telemetry record; an empty list if nothing is."""
    found = []
    kinds = {_S: str, _D: (int, float), _I: int, _B: bool}
    for name, (kind, nullable) in REQUIRED.items():
        if name not in record:
            found.append(f"{name}: missing")
            continue
        v = record[name]
        if v is None:
            if not nullable:
                found.append(f"{name}: null")
        elif not isinstance(v, kinds[kind]) or (isinstance(v, bool) and kind is not _B):
            found.append(f"{name}: wrong type")
        elif isinstance(v, float) and not math.isfinite(v):
            found.append(f"{name}: not finite")
        elif kind in (_D, _I) and name != "seed" and v < (1 if name in ("run_number", "num_cores") else 0):
            found.append(f"{name}: too small")
    if record.get("cache_state") is not None and record["cache_state"] not in CACHE_STATES:
        found.append("cache_state: unknown")
    status = record.get("status") or "ok"
    if status not in STATUSES:
        found.append("status: unknown")
    if status == "ok" and record.get("latency_ms") is None:
        found.append("latency_ms: null in a run that went well")
    return found


def problem_column() -> Column:
    """The same for rows read with the TELEMETRY schema (types were enforced by the reader)."""
    checks = []
    for name, (kind, nullable) in REQUIRED.items():
        c = F.col(name)
        if not nullable:
            checks.append(F.when(c.isNull(), f"{name}: null"))
        if kind is _D:
            checks.append(F.when(F.isnan(c) | (F.abs(c) == float("inf")), f"{name}: not finite"))
        if kind in (_D, _I) and name != "seed":
            checks.append(F.when(c < (1 if name in ("run_number", "num_cores") else 0), f"{name}: too small"))
    checks.append(F.when(~F.col("cache_state").isin(*CACHE_STATES), "cache_state: unknown"))
    status = F.coalesce("status", F.lit("ok"))
    checks.append(F.when(~status.isin(*STATUSES), "status: unknown"))
    checks.append(F.when((status == "ok") & F.col("latency_ms").isNull(), "latency_ms: null in a run that went well"))
    return F.array_compact(F.array(*checks))


class JsonLog:
    """Append-only JSON lines, safe for threads; telemetry is checked before it is written."""

    def __init__(self, path: str, check: bool = False) -> None:
        self.path, self.check, self._lock = path, check, threading.Lock()
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)

    def append(self, record: object) -> None:
        row = asdict(record) if is_dataclass(record) else dict(record)
        if self.check and (wrong := problems(row)):
            raise ValueError("; ".join(wrong))
        line = json.dumps(json_safe(row), sort_keys=True)
        with self._lock, open(self.path, "a") as f:
            f.write(line + "\n")


def json_safe(x: object) -> object:
    """x with infinities and NaN as null, so that any JSON reader takes it."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, Mapping):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [json_safe(v) for v in x]
    return x


def read_telemetry(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Telemetry of one or many logs with the column problems; broken lines show nulls and their problems."""
    df = spark.read.schema(TELEMETRY).option("mode", "PERMISSIVE").json(list(paths) if not isinstance(paths, str) else paths)
    return df.withColumn("problems", problem_column())


#: One attempt at running a plan.
EXECUTION = T.StructType([T.StructField(n, t) for n, t in (
    ("execution_id", _S), ("query_id", _S), ("plan_id", _S), ("strategy", _S), ("mode", _S), ("status", _S), ("error", _S), ("started_at", _D), ("finished_at", _D), ("latency_seconds", _D), ("cpu_seconds", _D), ("scanned_bytes", _D),
    ("shuffled_bytes", _D), ("metrics_source", _S), ("estimated_cost", _D), ("estimated_latency", _D), ("actual_cost", _D), ("budget", _D), ("deadline", _D), ("accuracy_tolerance", _D), ("sample_fraction", _D), ("replans", _I),
    ("wasted_cost", _D), ("cores", _I), ("job_group", _S),
)])


def read_executions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXECUTION).json(path)


CALIBRATION = T.StructType([T.StructField(n, _S if n.endswith("_id") else _D) for n in ("plan_id", "query_id", "cpu_component", "io_component", "shuffle_component", "estimated_cost", "actual_cost", "estimated_latency", "actual_latency")])


def append_samples(df: DataFrame, path: str) -> None:
    """Adds calibration samples to a CSV folder."""
    df.select(*CALIBRATION.names).write.mode("append").option("header", True).csv(path)


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALIBRATION).option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """CSV with nested values as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_run_info(spark: SparkSession, path: str, arguments: Mapping[str, object]) -> dict:
    """Environment and arguments as JSON beside a result."""
    sc = spark.sparkContext
    info = {"spark_version": spark.version, "master": sc.master, "parallelism": sc.defaultParallelism, "aqe": spark.conf.get("spark.sql.adaptive.enabled"), "cbo": spark.conf.get("spark.sql.cbo.enabled"), "arguments": json_safe(dict(arguments))}
    with open(path, "w") as f:
        json.dump(info, f, indent=1)
    return info


class MeasurementCache:
    """One JSON document per measured query; a query that is there isn't measured again."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _file(self, query_id: str) -> str:
        return os.path.join(self.folder, f"{query_id}.json")

    def has(self, query_id: str) -> bool:
        return os.path.exists(self._file(query_id))

    def save(self, query_id: str, runs: Iterable[Mapping[str, object]]) -> None:
        with open(self._file(query_id), "w") as f:
            json.dump(json_safe(list(runs)), f)

    def load(self, spark: SparkSession, query_ids: Sequence[str] | None = None) -> DataFrame:
        """All measured runs in long form, a row per run."""
        schema = "query_id string, plan_id string, strategy string, run int, latency double, cost double, pred_cost double, pred_latency double, fingerprint string, status string"
        files = [self._file(q) for q in query_ids] if query_ids else [f"{self.folder}/*.json"]
        return spark.read.schema(schema).option("multiLine", True).json(files)
