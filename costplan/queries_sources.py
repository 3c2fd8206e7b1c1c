"""Queries of sources, sinks and execution: each writes or runs something real and reports what came back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costplan.operators import cost
from costplan.plans import alternatives, plantext, search, statistics
from costplan.plans.shape import QueryRequest, shape
from costplan.queries_workload import TABLES, _telemetry, views
from costplan.run import adaptive, runner
from costplan.session import new_path, table, temporary_conf
from costplan.sources import logs, star, tables, workload

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query and, if SQL can express it, its oracle."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return wrap


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)

# Sources --------------------------------------------------------------------------------------------


@query(_COUNTS)
def registered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table of a folder registered as views."""
    tables.register(spark, sf_dir, TABLES)
    return spark.sql(_COUNTS)


@query("SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(12,2))::DOUBLE AS o_totalprice, o_orderpriority FROM orders")
def delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a bar-delimited file without header, and read back with casts and fewer columns."""
    path = new_path(spark, "orders.dat")
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    rows = table(spark, sf_dir, "orders").select(*names).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(12,2)"))
    rows.write.option("sep", "|").csv(path)
    return tables.read_delimited(spark, path, names, {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])


@query("SELECT * FROM (VALUES (1::BIGINT, 'x', 0.5::DOUBLE), (2, 'y', NULL), (3, NULL, 1.5)) AS t(k, name, v)")
def memory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.rows(spark, [(1, "x", 0.5), (2, "y", None), (3, None, 1.5)], ["k", "name", "v"])


@query("SELECT name, CAST(25 * f AS BIGINT) AS n_rows, CAST(25 * f - 1 AS BIGINT) AS last_key FROM (VALUES ('nation', 1), ('customer', 10), ('orders', 100)) AS t(name, f)")
def key_range_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(df.columns[0]).alias("last_key")).select(F.lit(name).alias("name"), "*") for name, df in tables.key_ranges(spark, 25).items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("""SELECT * FROM (VALUES ('store_sales', 2000::BIGINT), ('date_dim', 73049), ('item', 180), ('store', 12), ('customer_demographics', 19208), ('time_dim', 86400), ('customer', 1000), ('customer_address', 500),
('household_demographics', 7200), ('promotion', 300)) AS t(table_name, n_rows), (SELECT 0::BIGINT AS n_orphans)""")
def star_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic star at a hundredth of its size with skewed keys: rows, and keys of other tables that lead nowhere."""
    made = star.star(spark, 0.01, 1.1)
    orphans = {}
    for line in filter(None, star.FOREIGN_KEYS.split("\n")):
        (here, fk), (there, pk) = (side.split(".") for side in line.split(" = "))
        lost = made[here].select(fk).join(made[there].select(pk), F.col(fk) == F.col(pk), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(here).alias("table_name"), "n")
        orphans[here] = orphans[here].union(lost) if here in orphans else lost
    parts = []
    for name, df in made.items():
        n = df.agg(F.count(F.lit(1)).alias("n_rows"))
        lost = orphans[name].agg(F.sum("n").alias("n_orphans")) if name in orphans else spark.range(1).select(F.lit(0).cast("long").alias("n_orphans"))
        parts.append(n.join(lost).select(F.lit(name).alias("table_name"), "n_rows", "n_orphans"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT * FROM (VALUES (1, true), (2, false)) AS t(attempt, generated)")
def star_generated_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "star")
    return spark.createDataFrame([(i, star.ensure(spark, path, 0.001, 0.0)) for i in (1, 2)], "attempt int, generated boolean")


@query("SELECT 'STAR' || lpad(CAST(n AS VARCHAR), 2, '0') || '_' || s AS query_id, CASE WHEN n <= 4 THEN 'small' WHEN n <= 7 THEN 'medium' ELSE 'large' END AS family, CAST(n AS INTEGER) AS n_tables FROM range(3, 10) t(n), (VALUES ('NARROW'), ('MID'), ('WIDE')) AS u(s) UNION ALL SELECT 'GROUPBY', 'medium', 5")
def sql_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workload written as one SQL file per query and loaded from the folder."""
    path = new_path(spark, "sql")
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    for q in workload.star_workload():
        p = hadoop.fs.Path(f"{path}/{q.query_id.lower()}.sql")
        out = p.getFileSystem(conf).create(p)
        out.write(bytearray(f"{q.sql};\n".encode()))
        out.close()
    found = [(q.query_id, q.family, q.n_tables) for q in workload.load_sql(spark, path)]
    return spark.createDataFrame(found, "query_id string, family string, n_tables int")


# Statistics -----------------------------------------------------------------------------------------


@query(_COUNTS)
def recorded_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts that ANALYZE recorded in the catalog for external tables."""
    database = f"costplan_{uuid.uuid4().hex[:10]}"
    tables.register(spark, sf_dir, TABLES, "table", database)
    try:
        found = [(t, tables.analyze(spark, f"{database}.{t}", None)) for t in TABLES]
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    return spark.createDataFrame(found, "table_name string, n_rows long")


@query("SELECT count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS recorded, count(*) AS actual FROM orders")
def stale_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table analysed while it held the orders of early years, and grown since."""
    orders = table(spark, sf_dir, "orders")
    old, grown, work = (new_path(spark, n) for n in ("old", "grown", "work"))
    orders.where("o_orderdate < timestamp_ntz'1996-01-01'").write.parquet(old)
    orders.write.parquet(grown)
    name = f"costplan_stale_{uuid.uuid4().hex[:10]}"
    try:
        told, actual = tables.make_stale(spark, name, old, grown, work)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.createDataFrame([(told, actual)], "recorded long, actual long")


@query("SELECT CAST(n AS INTEGER) AS n_tables, CAST(n - 1 AS INTEGER) AS n_joins, true AS largest_known, true AS input_known FROM range(3, 10) t(n)")
def join_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalyst's sizes of the joins of star queries: their number, and whether input and largest intermediate are known."""
    views(spark, sf_dir)
    found = []
    for n in range(3, 10):
        df = spark.sql(workload.star_sql(n))
        sizes, told = statistics.join_sizes(df), statistics.plan_statistics(df)
        found.append((n, len(sizes), told.intermediate_bytes is not None, (told.input_bytes or 0) > 0))
    return spark.createDataFrame(found, "n_tables int, n_joins int, largest_known boolean, input_known boolean")


@query("SELECT CAST(n AS INTEGER) AS n_tables, CAST(n - 1 AS INTEGER) AS n_joins, CAST(n AS INTEGER) AS n_relations, false AS star, true AS reorderable FROM range(3, 10) t(n)")
def query_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure read from query texts by Spark's parser."""
    found = []
    for n in range(3, 10):
        s = shape(spark, workload.star_sql(n))
        found.append((n, len(s.joins), len(s.relations), s.star_span is not None, s.reorderable))
    return spark.createDataFrame(found, "n_tables int, n_joins int, n_relations int, star boolean, reorderable boolean")


@query("""SELECT * FROM (VALUES ('two', false, 2::BIGINT, 'n,r'), ('left', false, 3, 'n,r,c'), ('one table', false, 1, 'n'), ('three', true, 3, 'n,r,c'), ('filtered', true, 3, 'c,n,r')) AS t(text, reorderable, n_relations, aliases)""")
def order_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts may be reordered: inner joins of three relations or more; and their aliases in FROM order."""
    views(spark, sf_dir, "nation region customer")
    texts = {
        "two": "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "filtered": "SELECT n.n_name FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name > 'A' ORDER BY 1",
        "left": "SELECT * FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey", "one table": "SELECT * FROM nation n",
        "three": "SELECT count(*) FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey",
    }
    found = [(k, s.reorderable, len(s.relations), ",".join(s.aliases)) for k, s in ((k, shape(spark, t)) for k, t in texts.items())]
    return spark.createDataFrame(found, "text string, reorderable boolean, n_relations long, aliases string")


_STAR_ORDER = "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey"


@query(_STAR_ORDER)
def star_columns_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SELECT * from the other join order; the columns must come in the order of the original."""
    views(spark, sf_dir, _STAR_ORDER)
    s = shape(spark, _STAR_ORDER)
    out, want = spark.sql(alternatives.reordered(s, ("s", "n", "r"))), spark.sql(_STAR_ORDER)
    if out.columns != want.columns:
        raise ValueError(f"columns came as {out.columns}")
    return out


@query("""SELECT * FROM (VALUES ('plain', 'SELECT /*+ MERGE(n, r) */ n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey'),
('with', 'WITH x AS (SELECT r_regionkey AS k FROM region) SELECT /*+ MERGE(n, x) */ n.n_name FROM nation n JOIN x ON n.n_regionkey = x.k')) AS t(text, hinted)""")
def hint_spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a hint goes: into the outer SELECT, not that of a WITH."""
    views(spark, sf_dir, "nation region")
    texts = {"plain": "SELECT n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "with": "WITH x AS (SELECT r_regionkey AS k FROM region) SELECT n.n_name FROM nation n JOIN x ON n.n_regionkey = x.k"}
    found = [(k, alternatives.with_hint(s, t, "MERGE", s.aliases)) for k, t in texts.items() for s in [shape(spark, t)]]
    return spark.createDataFrame(found, "text string, hinted string")


@query("SELECT t AS table_name, true AS known FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") AS x(t)")
def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether Catalyst estimates each table's bytes (the figures are those of the files)."""
    views(spark, sf_dir)
    return spark.createDataFrame([(t, (search.table_bytes(spark, t) or 0) > 0) for t in TABLES], "table_name string, known boolean")


@query("""SELECT * FROM (VALUES ('exchange_count', 3.0::DOUBLE), ('broadcast_exchange_count', 1.0), ('bhj_count', 1.0), ('smj_count', 1.0), ('shj_count', 0.0), ('scan_bytes', 1000000.0), ('shuffle_bytes', 800000.0), ('broadcast_join_sizes', 150000.0)) AS t(feature, v)""")
def vector_of_a_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a real plan (one broadcast and one merge join) whose scanned bytes are told; sizes not told follow from them."""
    sql = "SELECT /*+ BROADCAST(n), MERGE(o, c) */ o.o_orderkey, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"
    views(spark, sf_dir, sql)
    with temporary_conf(spark, HINTS_OFF):
        v = plantext.vector_of(alternatives.plan_text(spark, sql), {"scan_bytes": 1e6})
    if tuple(v) != tuple(plantext.VECTOR):
        raise ValueError("the vector's order changed")
    names = "exchange_count broadcast_exchange_count bhj_count smj_count shj_count scan_bytes shuffle_bytes broadcast_join_sizes".split()
    return spark.createDataFrame([(n, float(v[n])) for n in names], "feature string, v double")


# Sinks ----------------------------------------------------------------------------------------------


@query("""SELECT CAST(event_id % 7 AS BIGINT) AS plan, count(*) AS n_rows, count(*) FILTER (event_id%23<>0 AND event_id%5>=1 AND event_id%9<>0 AND NOT (event_id%20<>0 AND (event_id%10=0 OR value IS NULL)) AND NOT (event_id%10<>0 AND value<0)) AS n_valid,
CAST(sum(event_id*1024) AS DOUBLE) AS bytes_scanned FROM events GROUP BY 1""")
def telemetry_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry written as JSON lines and read back with its problems."""
    path = new_path(spark, "telemetry")
    _telemetry(spark, sf_dir).drop("event_id").write.option("ignoreNullFields", False).json(path)
    read = logs.read_telemetry(spark, path)
    return read.groupBy(F.substring("plan_id", 2, 9).cast("long").alias("plan")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("problems") == 0).alias("n_valid"), F.sum("bytes_scanned").alias("bytes_scanned"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS query_id, 2*count(*) AS n_samples, CAST(2*sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS actual_cost FROM orders GROUP BY 1")
def calibration_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration samples appended to a CSV folder twice and loaded."""
    path = new_path(spark, "samples")
    o = table(spark, sf_dir, "orders")
    made = {"plan_id": F.col("o_orderkey").cast("string"), "query_id": F.col("o_custkey").cast("string"), "actual_cost": F.col("o_totalprice").cast("decimal(12,2)").cast("double")}
    samples = o.select(*[made.get(f.name, F.lit(1.0)).cast(f.dataType).alias(f.name) for f in logs.CALIBRATION])
    for _ in range(2):
        logs.append_samples(samples, path)
    return logs.load_samples(spark, path).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("actual_cost").cast("decimal(12,2)")).cast("double").alias("actual_cost"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS customer, CAST(count(*) AS VARCHAR) AS n, '{\"low\":' || CAST(min(o_orderkey) AS VARCHAR) || ',\"high\":' || CAST(max(o_orderkey) AS VARCHAR) || '}' AS keys FROM orders GROUP BY o_custkey")
def results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with nested values written as CSV and read back as text."""
    path = new_path(spark, "results")
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("n"), F.struct(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")).alias("keys"))
    logs.write_results(by, path)
    return spark.read.option("header", True).option("escape", "\\").csv(path)


@query("SELECT count(*) AS n_collected, CAST(sum(n) AS BIGINT) AS n_counted, (SELECT count(*) FROM lineitem) AS n_written FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows seen by the collecting, the counting and the no-op sink (observed while it discards them)."""
    from pyspark.sql import Observation

    orders, seen = table(spark, sf_dir, "orders"), Observation()
    collected = orders.groupBy("o_orderpriority").count().collect()  # a handful of priorities
    logs.noop(table(spark, sf_dir, "lineitem").observe(seen, F.count(F.lit(1)).alias("n")))
    return spark.createDataFrame([(len(collected), orders.count(), seen.get["n"])], "n_collected long, n_counted long, n_written long")


@query("""SELECT * FROM (VALUES ('execution log', 2::BIGINT, 'ok,simulated'), ('measurement cache', 3, 'q1,q2'), ('model store', 2, '1,2'), ('run info', 1, 'seed'), ('profile', 2, 'local[2],7')) AS t(sink, n, holds)""")
def driver_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small files that the driver keeps for itself: execution log, measurements, models, run information and profiles, written and read back."""
    import json
    import os
    import tempfile

    from costplan.operators import calibration
    from costplan.sources import profiles

    found = []
    with tempfile.TemporaryDirectory() as folder:
        log = logs.JsonLog(f"{folder}/runs.jsonl")
        runner.Executor(spark, log=log).execute(runner.PlanToRun("Q", "P", "SELECT 1"))
        runner.Executor(None, log=log).execute(runner.PlanToRun("Q", "P", "SELECT 1"))
        with open(log.path) as f:
            lines = [json.loads(line) for line in f]
        found.append(("execution log", len(lines), ",".join(sorted(r["status"] for r in lines))))
        cache = logs.MeasurementCache(f"{folder}/cache")
        cache.save("q1", [{"query_id": "q1", "plan_id": "a"}, {"query_id": "q1", "plan_id": "b"}])
        cache.save("q2", [{"query_id": "q2", "plan_id": "a"}])
        runs = []
        for q in ("q1", "q2"):
            with open(cache._file(q)) as f:
                runs += json.load(f)
        found.append(("measurement cache", len(runs), ",".join(q for q in ("q1", "q2", "q3") if cache.has(q))))
        models = [calibration.save_model(f"{folder}/models", "m", {"w": w}) for w in (1, 2)]
        found.append(("model store", len(models), ",".join(str(calibration.load_model(m)["w"]) for m in models)))
        logs.write_run_info(spark, f"{folder}/info.json", {"seed": 7})
        with open(f"{folder}/info.json") as f:
            found.append(("run info", 1, ",".join(json.load(f)["arguments"])))
        with open(f"{folder}/profiles.yaml", "w") as f:
            f.write("shared:\n  seed: 7\nprofiles:\n  small:\n    master: local[2]\n  other: {}\n")
        told = profiles.load_environment(f"{folder}/profiles.yaml", "small")
        found.append(("profile", 2, f"{told.master},{told.seed}"))
        left = len(os.listdir(folder))
    if left != 5:
        raise ValueError(f"{left} files")
    return spark.createDataFrame(found, "sink string, n long, holds string")


# Execution ------------------------------------------------------------------------------------------

HINTS_OFF = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.cbo.joinReorder.enabled": "false"}
SMALL = "SELECT COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"


@query("SELECT strategy, operator, CAST(r AS BIGINT) AS run_number, 'ok' AS status, true AS measured, true AS plan_verified, false AS has_problems FROM (VALUES ('default', 'SortMergeJoin'), ('broadcast', 'BroadcastHashJoin'), ('shuffle_hash', 'ShuffledHashJoin')) AS t(strategy, operator), range(1, 3) u(r)")
def executed_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry of the distinct plans of a join, each run once warm and twice measured: times and bytes from the status store, the plan that ran verified."""
    views(spark, sf_dir, SMALL)
    measured = runner.PlanRunner(spark, 1, 2)
    found = []
    with temporary_conf(spark, HINTS_OFF):
        for c in alternatives.candidates(spark, QueryRequest("Q", SMALL, 1.0)):
            if c.strategy.startswith("join_order"):
                continue  # the swapped orders of two relations run the same operators
            for r in measured.run(runner.RunSpec("Q", c.plan_id, c.strategy, c.sql, c.fingerprint, HINTS_OFF)):
                seen = r["executor_seconds"] is not None and r["executor_seconds"] > 0 and r["bytes_scanned"] > 0 and r["executor_seconds_source"] == "status_store"
                found.append((c.strategy, plantext.features_of(c.plan)["actual_strategy"], r["run_number"], r["status"], seen, r["plan_verified"], bool(logs.problems(r))))
    return spark.createDataFrame(found, "strategy string, operator string, run_number long, status string, measured boolean, plan_verified boolean, has_problems boolean")


@query("SELECT hint, 4::BIGINT AS n_variants, 4::BIGINT AS n_held, true AS distinct_plans FROM (VALUES ('broadcast'), ('merge'), ('shuffle_hash'), ('none')) AS t(hint)")
def hints_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every variant of a three-relation star query, planned by Spark, whether the plan shows the operator its hint asks for."""
    sql = workload.star_sql(3)
    views(spark, sf_dir, sql)
    with temporary_conf(spark, HINTS_OFF):
        found = [(v.label, alternatives.plan_text(spark, v.sql)) for v in alternatives.variants(shape(spark, sql))]
    plans = spark.createDataFrame(found, "strategy string, plan string")
    hint = F.regexp_extract("strategy", "(broadcast|merge|shuffle_hash)$", 1)
    by = plans.groupBy(F.when(hint == "", "none").otherwise(hint).alias("hint"))
    return by.agg(F.count(F.lit(1)).alias("n_variants"), F.count_if(plantext.matches_hint(F.col("plan"), F.col("strategy"))).alias("n_held"), (F.countDistinct(plantext.fingerprint(F.col("plan"))) > 1).alias("distinct_plans"))


@query("SELECT * FROM (VALUES ('missing table', 'failed'), ('bad column', 'failed'), ('division', 'failed'), ('fine', 'ok')) AS t(text, status), (SELECT false AS was_cancelled)")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strict executor says of texts that fail in analysis or at run time; none of them is a cancellation."""
    views(spark, sf_dir, "orders")
    texts = {"missing table": "SELECT * FROM no_such_table", "bad column": "SELECT nothing FROM orders", "division": "SELECT raise_error('broken') FROM orders", "fine": "SELECT o_orderkey FROM orders"}
    run = runner.Executor(spark)
    found = [(name, run.execute(runner.PlanToRun("Q", name, sql))) for name, sql in texts.items()]
    return spark.createDataFrame([(n, o.status, runner.was_cancelled(Exception(o.error or ""))) for n, o in found], "text string, status string, was_cancelled boolean")


@query("""SELECT * FROM (VALUES ('no budget', 'strict', 'ok', 'P1', 0, false, NULL::DOUBLE), ('wide budget', 'adaptive', 'ok', 'P1', 0, false, NULL), ('no session', 'strict', 'simulated', 'P1', 0, false, NULL), ('overrun, cheaper plan', 'adaptive', 'ok', 'P2', 1, true, NULL),
('overrun, no other plan', 'degraded', 'ok', 'P3', 0, true, 0.1)) AS t(scenario, mode, status, plan_id, replans, wasted, sample_fraction)""")
def adaptive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The controller under budgets: strict without one, undisturbed within it; on an overrun it cancels and takes a cheaper plan, or a sample of the same."""
    plan = runner.PlanToRun("Q", "P1", SMALL, estimated_cost=1.0)
    # Projected at several times its budget after a hundredth of its tasks, which leaves more than the cheaper plan needs.
    slow = runner.PlanToRun("Q", "P0", "SELECT sum(hash(id, id + 1)) FROM range(0, 900000000000, 1, 12000)", estimated_cost=5.0, budget=0.01)
    views(spark, sf_dir, SMALL)
    run = runner.Executor(spark)
    control = adaptive.AdaptiveController(run, adaptive.AdaptiveConfig(poll_seconds=0.02))
    cheaper = adaptive.cheaper_replanner([runner.PlanToRun("Q", "P2", SMALL, estimated_cost=2.0), slow])

    # A plan whose first attempt is slow and whose sample is quick: the view behind it shrinks once the run is cancelled.
    class Shrinking(runner.Executor):
        def execute(self, p, mode="strict", **options):
            spark.range(0, 60_000_000_000 if mode == "adaptive" else 1000, 1, 400).createOrReplaceTempView("costplan_slow")
            return super().execute(p, mode, **options)

    shrinking = adaptive.AdaptiveController(Shrinking(spark), adaptive.AdaptiveConfig(max_replans=0, poll_seconds=0.02))
    outcomes = {
        "no budget": control.run(plan), "wide budget": control.run(runner.PlanToRun("Q", "P1", SMALL, estimated_cost=1.0, budget=1e6)), "no session": runner.Executor(None).execute(plan),
        "overrun, cheaper plan": adaptive.AdaptiveController(run, adaptive.AdaptiveConfig(poll_seconds=0.02), cheaper).run(slow),
        "overrun, no other plan": shrinking.run(runner.PlanToRun("Q", "P3", "SELECT hash(id, id + 1) AS h FROM costplan_slow", estimated_cost=5.0, budget=1e-9)),
    }
    spark.catalog.dropTempView("costplan_slow")
    rows = [(k, o.mode, o.status, o.plan_id, o.replans, o.wasted_cost > 0, o.sample_fraction) for k, o in outcomes.items()]
    return spark.createDataFrame(rows, "scenario string, mode string, status string, plan_id string, replans int, wasted boolean, sample_fraction double")


@query("SELECT CAST(b AS BOOLEAN) AS reorder, true AS cbo_active, true AS knows_rows FROM (VALUES (true), (false)) AS t(b)")
def cbo_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics-based optimisation with and without join reordering: whether the optimiser knows an analysed table's rows."""
    database = f"costplan_{uuid.uuid4().hex[:10]}"
    tables.register(spark, sf_dir, ["customer"], "table", database)
    settings = ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled", "spark.sql.statistics.histogram.enabled")
    found = []
    try:
        known = tables.analyze(spark, f"{database}.customer", None)
        for reorder in (True, False):
            with temporary_conf(spark, {k: spark.conf.get(k, "false") for k in settings}):
                tables.enable_cbo(spark, reorder)
                found.append((spark.conf.get(settings[1]) == "true", tables.cbo_active(spark, f"{database}.customer"), bool(known)))
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    return spark.createDataFrame(found, "reorder boolean, cbo_active boolean, knows_rows boolean")


@query("SELECT 52::BIGINT AS n_plans, 48::BIGINT AS n_candidates, 4::BIGINT AS n_defaults, true AS all_ok")
def measured_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-relation query measured as a study does: the first 48 of its candidates and Spark's own four choices, each once."""
    sql = workload.star_sql(5)
    views(spark, sf_dir, sql)
    with temporary_conf(spark, HINTS_OFF):
        found = alternatives.candidates(spark, QueryRequest("Q", sql, 1.0))
        runs = runner.measure_query(runner.PlanRunner(spark, 0, 1), "Q", sql, found)
    own = F.col("strategy").startswith("spark_default")
    return runs.agg(F.countDistinct("plan_id").alias("n_plans"), F.countDistinct(F.when(~own, F.col("plan_id"))).alias("n_candidates"), F.countDistinct(F.when(own, F.col("plan_id"))).alias("n_defaults"), F.bool_and(F.col("status") == "ok").alias("all_ok"))


@query("SELECT 'predictor' AS source, 3.0::DOUBLE AS latency, 2.0::DOUBLE AS cost UNION ALL SELECT 'priors', NULL, NULL")
def pluggable_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans scored by a predictor of the caller's, beside the structural one (whose figures depend on sizes and aren't shown)."""
    from costplan.planner import Planner

    views(spark, sf_dir, SMALL)
    with temporary_conf(spark, HINTS_OFF):
        told = Planner(spark, predictor=lambda s, c: (2.0, 3.0)).plan(QueryRequest("Q", SMALL, 10.0)).chosen
        own = Planner(spark).plan(QueryRequest("Q", SMALL, 10.0)).chosen
    ok = own.latency > 0 and own.cost > 0
    return spark.createDataFrame([("predictor", told.latency, told.cost), ("priors" if ok else "none", None, None)], "source string, latency double, cost double")


@query("SELECT 'default' AS source, round(10.0::DOUBLE / 3600 * 0.048, 9) AS cpu_cost UNION ALL SELECT 'file', round(10.0::DOUBLE / 3600 * 0.2, 9)")
def pricing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPU cost of ten core seconds by the built-in prices and by those of a configuration file."""
    import json
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:  # read by the driver alone
        json.dump({"cpu": {"cost_per_vcore_hour": 0.2}}, f)
        f.flush()
        prices = {"default": cost.Pricing(), "file": cost.load_pricing(f.name)}
    return spark.createDataFrame([(k, round(10.0 / 3600 * p.vcore_hour, 9)) for k, p in prices.items()], "source string, cpu_cost double")
