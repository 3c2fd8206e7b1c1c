"""The pN_ queries of the general problems (3 and 5), with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costplan.operators import drift, spikes
from costplan.session import table, written


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "planning_files").select("file_id", "feed", "written_at", "line_no", "payload")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a file against the file written before it in its feed."""
    return drift.changes(_lines(spark, sf_dir)).select("file_id", "field_name", "change_kind")


def p3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered log of differences with old and new names and kinds."""
    return drift.changes(_lines(spark, sf_dir)).orderBy("feed", "position", "field_name", "change_kind")


#: Fields of the two tables that hold the same thing under two names.
SAME = (("search_mode", "mode"), ("sql_variant_count", "generated_sql_variant_count"))


def p3_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the two run tables by file, read from the Parquet footers."""
    found = []
    for name in ("planning_runs", "prescoring_all_runs"):
        files = table(spark, sf_dir, name).inputFiles()
        found.append(drift.read_headers(spark, files).groupBy(F.lit(name).alias("table_name"), "field", "kind").agg(F.count(F.lit(1)).alias("n_files")))
    return found[0].union(found[1])


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads, planning_runs and prescoring_all_runs as one consistent table, a row per run.

    Runs are told apart by origin (table, or feed) and run_id; of a run that several files
    repeat, each field has its value written last. Numbers are in the unit of their feed's first
    file, as told by repeated records. Redelivered rows count once.
    """
    lines = _lines(spark, sf_dir)
    cells = written(drift.parsed(lines), "cells")
    log = drift.changes(lines, cells=cells)
    tables = {name: table(spark, sf_dir, name) for name in ("prescoring_all_runs", "planning_runs")}
    header = p3_headers(spark, sf_dir).select("table_name", "field", "kind").collect()
    links = [tuple(r) for r in log.where("change_kind = 'renamed'").select("old_name", "field_name").distinct().collect()]
    known = [c for name in tables for c in tables[name].columns]
    fields = [tuple(r) for r in drift.majority(drift.file_fields(cells, by_content=True)).where("kind is not null").select("key", "kind").distinct().collect()]
    names = drift.canonical_names([*SAME, *links], known)
    kinds: dict[str, list[str]] = {}
    for field, kind in [*((r["field"], r["kind"]) for r in header), *fields]:
        kinds.setdefault(names.get(field, field), []).append(kind)
    # Times are texts in some files and times in others: all are ISO, so they are read as times.
    schema = {c: "timestamp" if "timestamp" in k and set(k) <= {"timestamp", "text"} else drift.fold(k) for c, k in sorted(kinds.items())}
    spelled: dict[str, list[str]] = {c: [c] for c in schema}
    for name, c in names.items():
        if c in spelled and name != c:
            spelled[c].append(name)
    numbers = [c for c, k in schema.items() if k in ("integer", "decimal") and c != "run_id"]
    body = written(drift.cast_lines(lines.dropDuplicates(["file_id", "line_no"]), schema, spelled), "cast")
    steps = written(drift.unit_steps(body, numbers), "units")
    converted = [r["field"] for r in steps.select("field").distinct().collect()]
    schema |= {c: "decimal" for c in converted}
    parts = [drift.cast_table(df.distinct(), schema, spelled).withColumn("origin", F.lit(name)) for name, df in tables.items()]
    body = drift.in_one_unit(body.withColumns({c: F.col(c).cast("double") for c in converted}), steps, converted)
    columns = [*schema, "strays"]
    origin = F.concat(F.lit("planning_files:"), F.coalesce("feed", F.lit(""))).alias("origin")
    own = drift.latest(body.where("run_id is not null"), ["feed", "run_id"], [*schema]).select(*columns, origin)
    rest = body.where("run_id is null").select(*columns, origin)
    result = parts[0].unionByName(parts[1]).unionByName(own).unionByName(rest)
    return result.withColumn("strays", F.to_json("strays")).select("origin", *columns)


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "q10_validation_runs")
    return spikes.implausible(rows, "fingerprint", "timestamp_utc", "execution_seconds", "run_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that can't be true."""
    return _readings(spark, sf_dir).select(F.col("row_id").alias("run_id")).distinct()


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the plan and the rule that flags it."""
    return _readings(spark, sf_dir).select(F.col("row_id").alias("run_id"), F.col("source").alias("fingerprint"), "reason").distinct()


def p5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of p5_flags that the plausibility and the stuck rule name."""
    return p5_flags(spark, sf_dir).where("reason <> 'spike'")


QUERIES = {f.__name__: f for f in (p3_found, p3_changes, p3_headers, p3_runs, p5_found, p5_flags, p5_rules)}
ORACLE: dict[str, str] = {
    "p3_headers": """SELECT table_name, column_name AS field, CASE WHEN data_type = 'BOOLEAN' THEN 'boolean' WHEN data_type LIKE '%INT%' THEN 'integer' WHEN data_type IN ('DOUBLE', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'decimal'
WHEN data_type LIKE 'TIMESTAMP%' OR data_type IN ('DATE', 'TIME') THEN 'timestamp' ELSE 'text' END AS kind, 1::BIGINT AS n_files FROM information_schema.columns WHERE table_name IN ('planning_runs', 'prescoring_all_runs')""",
    "p5_rules": """WITH r AS (SELECT DISTINCT run_id, fingerprint, timestamp_utc AS t, execution_seconds AS x FROM q10_validation_runs WHERE fingerprint IS NOT NULL AND execution_seconds IS NOT NULL),
c AS (SELECT *, CASE WHEN x = lag(x) OVER w THEN 0 ELSE 1 END AS begins FROM r WINDOW w AS (PARTITION BY fingerprint ORDER BY t NULLS FIRST, run_id)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY fingerprint ORDER BY t NULLS FIRST, run_id ROWS UNBOUNDED PRECEDING) AS run FROM c), s AS (SELECT *, count(*) OVER (PARTITION BY fingerprint, run) AS len FROM g)
SELECT run_id, fingerprint, CASE WHEN isnan(x) OR isinf(x) OR x <= 0 THEN 'impossible' ELSE 'stuck' END AS reason FROM s WHERE isnan(x) OR isinf(x) OR x <= 0 OR len >= 6""",
}
