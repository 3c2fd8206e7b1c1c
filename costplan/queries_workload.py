"""Queries of the workload itself: joins, aggregates, orders, plan texts, functions and telemetry."""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costplan import functions
from costplan.functions import family_of
from costplan.operators.ordered import latest_upto
from costplan.plans import alternatives, plantext, search
from costplan.plans.shape import shape
from costplan.session import table, temporary_conf, written
from costplan.sources import logs, star, workload

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def query(sql: str | None = None, name: str | None = None):
    """Registers a query and, if SQL can express it, its oracle."""

    def wrap(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return wrap


def views(spark: SparkSession, sf_dir: str, sql: str = "") -> None:
    """Registers the tables that sql names (all without one)."""
    words = set(re.findall(r"\w+", sql.lower()))
    for t in TABLES:
        if not sql or t in words:
            table(spark, sf_dir, t).createOrReplaceTempView(t)


def run_sql(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, sql)
        return spark.sql(sql)

    return run


# Scans, joins, aggregates ---------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 100000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey IS NOT NULL")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    keep = (F.col("o_orderstatus") == "F") & F.col("o_totalprice").between(1000, 100000) & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & F.col("o_custkey").isNotNull()
    return o.where(keep).select("o_orderkey", "o_custkey", "o_totalprice")


for _q in workload.star_workload():
    if _q.query_id.startswith("STAR"):
        _name = f"star_join_{_q.n_tables:02d}_{_q.selectivity}"
        _as = _q.sql.replace("SUM(CAST(l.l_extendedprice AS DECIMAL(12,2)))", "CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2))) AS DOUBLE)")
    else:
        _name, _as = "star_groupby", _q.sql.replace("SUM(CAST(l.l_extendedprice AS DECIMAL(12,2)))", "CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2))) AS DOUBLE)")
    query(_as, _name)(run_sql(_as))

_JOIN = "SELECT{hint} c.c_mktsegment, COUNT(*) AS n_orders, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment"
for _name, _hint in (("join_bhj", "BROADCAST(c)"), ("join_smj", "MERGE(c, o)"), ("join_shj", "SHUFFLE_HASH(c, o)")):
    query(_JOIN.format(hint=""), _name)(run_sql(_JOIN.format(hint=f" /*+ {_hint} */")))


def _side(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    return c, o


_BIG = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000) o"


@query(f"SELECT c.c_custkey, c.c_mktsegment, CAST(o.o_orderkey AS VARCHAR) AS o_orderkey FROM customer c LEFT JOIN {_BIG} ON c.c_custkey = o.o_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _side(spark, sf_dir)
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "c_mktsegment", F.col("o_orderkey").cast("string").alias("o_orderkey"))


@query(f"SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM {_BIG} WHERE o.o_custkey = c_custkey)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _side(spark, sf_dir)
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi")


@query(f"SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM {_BIG} WHERE o.o_custkey = c_custkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _side(spark, sf_dir)
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti")


@query(f"SELECT CAST(c.c_custkey AS VARCHAR) AS c_custkey, CAST(o.o_orderkey AS VARCHAR) AS o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c FULL JOIN {_BIG} ON c.c_custkey = o.o_custkey")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, o = _side(spark, sf_dir)
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "full").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("o_orderkey"))


@query("SELECT p.p_partkey, b.band FROM part p JOIN (VALUES ('low', 0.0::DOUBLE, 1000.0::DOUBLE), ('mid', 1000.0::DOUBLE, 1500.0::DOUBLE), ('high', 1500.0::DOUBLE, 1e12::DOUBLE)) AS b(band, lo, hi) ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join against three fixed bands, which are broadcast."""
    bands = spark.createDataFrame([("low", 0.0, 1000.0), ("mid", 1000.0, 1500.0), ("high", 1500.0, 1e12)], "band string, lo double, hi double")
    p = table(spark, sf_dir, "part")
    return p.join(F.broadcast(bands), (p["p_retailprice"] >= bands["lo"]) & (p["p_retailprice"] < bands["hi"])).select("p_partkey", "band")


@query("""SELECT e.event_id, max(b.ts) AS last_ts FROM events e LEFT JOIN events b ON b.user_id = e.user_id AND b.event_type = (SELECT min(event_type) FROM events) AND b.ts <= e.ts GROUP BY e.event_id""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the latest event of one type at or before each event, by ordered passes over hours of a user instead of pairs."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("kind"))
    hit = F.when(F.col("event_type") == F.col("kind"), F.col("ts"))
    return latest_upto(e.join(first), ["user_id"], "ts", hit, F.date_trunc("hour", "ts"), "last_ts").select("event_id", "last_ts")


query("SELECT CAST(SUM(l_orderkey) AS BIGINT) AS total, COUNT(*) AS n, COUNT(l_shipdate) AS n_shipped FROM lineitem", "global_agg")(run_sql("SELECT SUM(l_orderkey) AS total, COUNT(*) AS n, COUNT(l_shipdate) AS n_shipped FROM lineitem"))
_TOPK = "SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS revenue FROM orders GROUP BY o_custkey ORDER BY revenue DESC, o_custkey LIMIT 20"
query(_TOPK, "topk_revenue")(run_sql(_TOPK))
query("SELECT l_returnflag, count(DISTINCT round(l_discount, 4)) AS n_discounts FROM lineitem GROUP BY 1", "distinct_values")(run_sql("SELECT l_returnflag, count(DISTINCT round(l_discount, 4)) AS n_discounts FROM lineitem GROUP BY 1"))
_CUBE = "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY {how}"
query(_CUBE.format(how="CUBE (l_returnflag, l_linestatus)"), "agg_cube")(run_sql(_CUBE.format(how="CUBE (l_returnflag, l_linestatus)")))
query(_CUBE.format(how="ROLLUP (l_returnflag, l_linestatus)"), "agg_rollup")(run_sql(_CUBE.format(how="ROLLUP (l_returnflag, l_linestatus)")))
query(_CUBE.format(how="GROUPING SETS ((l_returnflag), (l_linestatus))"), "agg_grouping_sets")(run_sql(_CUBE.format(how="GROUPING SETS ((l_returnflag), (l_linestatus))")))
_HAVING = "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12"
query(_HAVING, "agg_having")(run_sql(_HAVING))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


for _name, _op in (("set_union", "UNION"), ("set_intersect", "INTERSECT"), ("set_except", "EXCEPT")):
    _sql = f"SELECT c_nationkey AS k FROM customer {_op} SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 8000"
    query(_sql, _name)(run_sql(_sql))
_WIN = "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS is_first, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)"
query(_WIN, "window_functions")(run_sql(_WIN))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, year(ts) AS y, month(ts) AS m, regexp_extract(event_type, '^([a-z]+)', 1) AS stem FROM events")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.year("ts").cast("bigint").alias("y"), F.month("ts").cast("bigint").alias("m"), F.regexp_extract("event_type", "^([a-z]+)", 1).alias("stem"))


# Join orders ------------------------------------------------------------------------------------------

_FOUR = "SELECT cn.n_name, COUNT(*) AS n_items, CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey WHERE o.o_totalprice > 1000 GROUP BY cn.n_name"
_SIX = "SELECT COUNT(*) AS n_items, CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size > 10"


def _equivalent(sql: str, mode: str, width: int, together: str = "order"):
    """Runs every variant and keeps the distinct rows: one result if the rewrites are right.

    Relations of up to 1 MiB make one job. Beyond it the variants that agree in `together` are run and their rows written before
    the next ones, so that driver and disk never hold the broadcasts and shuffles of all.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, sql)
        parsed = shape(spark, sql)
        found = alternatives.variants(parsed, mode, width, small=alternatives.broadcastable(spark, parsed))
        # The mark keeps Spark from dropping variants that differ in hints only as equal children of the union.
        results = [spark.sql(v.sql).withColumn("__variant", F.lit(i)) for i, v in enumerate(found)]
        if len(alternatives.broadcastable(spark, parsed, 1 / 32)) < len(parsed.aliases):
            groups = [[r for r, _ in g] for _, g in groupby(zip(results, found), lambda x: getattr(x[1], together))]
            with temporary_conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": True}):
                results = [written(reduce(DataFrame.unionByName, g), "variants") for g in groups]
        out = reduce(DataFrame.unionByName, results)
        rows = [c for c in out.columns if c != "__variant"]
        return out.groupBy(*rows).agg(F.max("__variant").alias("__variant")).where("__variant >= 0").select(*rows)

    return run


query(_FOUR, "join_order_equivalence")(_equivalent(_FOUR, "exhaustive", 0))
query(_SIX, "beam_variants_equivalence")(_equivalent(_SIX, "beam", 3, "label"))

EDGES = (("l", "o"), ("o", "c"), ("c", "n"), ("l", "s"))
_EDGE_SQL = "e(a,b) AS (VALUES " + ",".join(f"('{a}','{b}')" for a, b in EDGES) + "), d AS (SELECT a,b FROM e UNION SELECT b,a FROM e)"
_ORDERS = "WITH RECURSIVE " + _EDGE_SQL + ", o(ord) AS (SELECT DISTINCT [a] FROM d UNION SELECT list_append(o.ord, d.b) FROM o JOIN d ON list_contains(o.ord, d.a) AND NOT list_contains(o.ord, d.b))"


def _orders(spark: SparkSession) -> DataFrame:
    return search.enumerate_orders(spark.createDataFrame(list(EDGES), "a string, b string"), 5)


@query(_ORDERS + " SELECT array_to_string(ord, ',') AS join_order FROM o WHERE len(ord) = 5")
def join_orders_enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark).select(F.array_join("order", ",").alias("join_order"))


#: Sizes and selectivities of the literal graph.
SIZES = {"l": 60000.0, "o": 15000.0, "c": 1500.0, "n": 25.0, "s": 100.0}
SHARES = {("l", "o"): 1 / 15000, ("c", "o"): 1 / 1500, ("c", "n"): 1 / 25, ("l", "s"): 1 / 100}


def _size_map() -> F.Column:
    return F.create_map(*[x for k, v in SIZES.items() for x in (F.lit(k), F.lit(v))])


_SZ = "CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SIZES.items()) + " END"
_SIZE_SCORE = "+".join("ln(1+(" + "+".join(_SZ.format(x=f"ord[{j}]") for j in range(1, i + 1)) + ")/60000.0)" for i in range(1, 6))


@query(_ORDERS + f" SELECT array_to_string(ord, ',') AS join_order, round({_SIZE_SCORE}, 6) AS score FROM o WHERE len(ord) = 5")
def size_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark).select(F.array_join("order", ",").alias("join_order"), F.round(search.size_score(F.col("order"), _size_map()), 6).alias("score"))


def _sel(a: str, b: str) -> str:
    return "(CASE " + " ".join(f"WHEN ({a}='{x}' AND {b}='{y}') OR ({a}='{y}' AND {b}='{x}') THEN {s!r}::DOUBLE" for (x, y), s in SHARES.items()) + " ELSE 1.0 END)"


def _rows_sql(i: int) -> str:
    parts = [_SZ.format(x=f"ord[{j}]") for j in range(1, i + 1)] + [_sel(f"ord[{j}]", f"ord[{k}]") for j in range(1, i + 1) for k in range(1, j)]
    return "*".join(parts)


@query(_ORDERS + " SELECT array_to_string(ord, ',') AS join_order, round(" + "+".join(f"ln(1+{_rows_sql(i)})" for i in range(1, 6)) + ", 6) AS score FROM o WHERE len(ord) = 5")
def cardinality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = {f"{x}|{y}": s for (a, b), s in SHARES.items() for x, y in ((a, b), (b, a))}
    shares = F.create_map(*[x for k, v in both.items() for x in (F.lit(k), F.lit(v))])
    return _orders(spark).select(F.array_join("order", ",").alias("join_order"), F.round(search.cardinality_score(F.col("order"), _size_map(), shares), 6).alias("score"))


_LEVEL = _ORDERS + f", p AS (SELECT ord, array_to_string(ord, ',') AS join_order, round({'+'.join('ln(1+(' + '+'.join(_SZ.format(x=f'ord[{j}]') for j in range(1, i + 1)) + ')/60000.0)' for i in range(1, 4))}, 6) AS score FROM o WHERE len(ord) = 3)"


@query(_LEVEL + ", f AS (SELECT *, row_number() OVER (PARTITION BY ord[1] ORDER BY score, ord) AS k FROM p) SELECT join_order, score, row_number() OVER (ORDER BY k > 1, score, ord) AS beam_rank FROM f QUALIFY beam_rank <= 6")
def beam_level_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame(list(EDGES), "a string, b string")
    level = search.enumerate_orders(edges, 3).withColumns({"query_id": F.lit("Q"), "score": F.round(search.size_score(F.col("order"), _size_map()), 6)})
    return search.keep_beam(level, 6).select(F.array_join("order", ",").alias("join_order"), "score", F.col("beam_rank").cast("bigint").alias("beam_rank"))


@query(_ORDERS + f""", g AS (SELECT ord, array_to_string(ord, '_') AS nm, round({_SIZE_SCORE}, 9) AS score FROM o WHERE len(ord) = 5),
st AS (SELECT *, row_number() OVER (PARTITION BY ord[1] ORDER BY score, ord) AS k FROM g), qu AS (SELECT *, row_number() OVER (ORDER BY k > 1, score, ord) AS place FROM st),
v AS (SELECT nm, place, h.p, h.s FROM qu CROSS JOIN (VALUES (0,'_broadcast'),(1,''),(2,'_merge'),(3,'_shuffle_hash')) AS h(p,s)),
r AS (SELECT 'join_order_' || nm || s AS label, row_number() OVER (ORDER BY p > 0, place, p) AS n FROM v)
SELECT label FROM r WHERE n <= 26 UNION ALL SELECT * FROM (VALUES ('default'),('broadcast'),('merge'),('shuffle_hash'))""")
def prescore_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels kept of all variants of the literal graph when 30 may be analysed."""
    adjacency: dict[str, set[str]] = {}
    for a, b in EDGES:
        adjacency.setdefault(a, set()).add(b)
        adjacency.setdefault(b, set()).add(a)
    aliases = tuple(SIZES)
    orders = [tuple(r[0].split(",")) for r in join_orders_enumerated(spark, sf_dir).collect()]
    labels = [("default", None), ("broadcast", None), ("merge", None), ("shuffle_hash", None)]
    labels += [("join_order_" + "_".join(o) + s, o) for o in sorted(orders) for s in ("", "_broadcast", "_merge", "_shuffle_hash")]
    keep = search.cap_variants(labels, search.size_scorer(aliases, SIZES), 30)
    return spark.createDataFrame([(labels[i][0],) for i in keep], "label string")


@query("""WITH c AS (SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS c, (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM nation) AS n)
SELECT 'c' AS a, 'o' AS b, round((SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0)::DOUBLE / (c.c * c.o), 9) AS selectivity FROM c
UNION ALL SELECT 'c', 'n', round((SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0)::DOUBLE / (c.c * c.n), 9) FROM c""")
def measured_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = {"c": table(spark, sf_dir, "customer").where("c_acctbal > 0"), "o": table(spark, sf_dir, "orders"), "n": table(spark, sf_dir, "nation")}
    s = search.measured_statistics(rel, {("c", "o"): "c.c_custkey = o.o_custkey", ("c", "n"): "c.c_nationkey = n.n_nationkey"})
    return spark.createDataFrame([(a, b, round(v, 9)) for (a, b), v in s.selectivities.items()], "a string, b string, selectivity double")


# Plan texts -------------------------------------------------------------------------------------------

#: A captured plan, with expression ids and codegen numbers.
PLAN = """*(5) HashAggregate(keys=[c_mktsegment#12], functions=[count(1)])
+- Exchange hashpartitioning(c_mktsegment#12, 8), ENSURE_REQUIREMENTS, [plan_id=88]
   +- *(4) HashAggregate(keys=[c_mktsegment#12], functions=[partial_count(1)])
      +- *(4) Project [c_mktsegment#12]
         +- *(4) SortMergeJoin [c_custkey#9L], [o_custkey#21L], Inner
            :- *(1) Sort [c_custkey#9L ASC NULLS FIRST], false, 0
            :  +- Exchange hashpartitioning(c_custkey#9L, 8), ENSURE_REQUIREMENTS, [plan_id=77]
            :     +- *(1) Filter isnotnull(c_custkey#9L)
            :        +- FileScan parquet [c_custkey#9L,c_mktsegment#12]
            +- *(2) Sort [o_custkey#21L ASC NULLS FIRST], false, 0
               +- BroadcastExchange HashedRelationBroadcastMode(List(input[0, bigint, true])), [plan_id=70]
                  +- FileScan parquet [o_custkey#21L]"""
COST_PLAN = """Aggregate [sum(id)], Statistics(sizeInBytes=16.0 B, rowCount=1)
+- Project [id], Statistics(sizeInBytes=120.0 KiB, rowCount=1.00E+3)
   +- Join Inner, Statistics(sizeInBytes=2.5 GiB)
      :- Relation a, Statistics(sizeInBytes=8.0 EiB)
      +- Relation b, Statistics(sizeInBytes=0, rowCount=0)"""


def _plans(spark: SparkSession, sf_dir: str, text: str = PLAN) -> DataFrame:
    """One plan text per nation, its ids shifted so that texts differ but plans don't."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("plan_no"))
    return n.withColumn("plan", F.regexp_replace(F.lit(text), "#1", F.concat(F.lit("#"), F.col("plan_no").cast("string"))))


def _text_sql(text: str) -> str:
    return "WITH t AS (SELECT CAST(n_nationkey AS INTEGER) AS plan_no, regexp_replace('" + text.replace("'", "''") + "', '#1', '#' || CAST(n_nationkey AS VARCHAR), 'g') AS plan FROM nation)"


_LINES = _text_sql(PLAN) + r""", l AS (SELECT plan_no, unnest(string_split(plan, chr(10))) AS line FROM t),
o AS (SELECT plan_no, regexp_extract(line, '^[ :+\-]*(?:\*\(\d+\) |\* )?([A-Za-z]+)', 1) AS op, CAST(floor(length(regexp_extract(line, '^[ :+\-]*', 0)) / 3) + 1 AS INTEGER) AS depth FROM l)"""


@query(_text_sql(PLAN) + r" SELECT plan_no, substr(sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(plan, 'plan_id=\d+', 'plan_id=X', 'g'), '#\d+[A-Za-z]*', '#X', 'g'), '\*\(\d+\)', '*', 'g'), '\s+', ' ', 'g'))), 1, 16) AS fingerprint FROM t")
def plan_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir).select("plan_no", plantext.fingerprint(F.col("plan")).alias("fingerprint"))


@query(_text_sql(PLAN) + r", f AS (SELECT plan_no, sha256(regexp_replace(regexp_replace(plan, '#\d+[A-Za-z]*', '#X', 'g'), '\s+', ' ', 'g')) AS f FROM t) SELECT min(plan_no) AS plan_no, count(*) AS n FROM f GROUP BY f")
def plan_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First plan of each fingerprint and how many share it."""
    f = _plans(spark, sf_dir).withColumn("f", plantext.fingerprint(F.col("plan")))
    return f.groupBy("f").agg(F.min("plan_no").alias("plan_no"), F.count(F.lit(1)).alias("n")).drop("f")


@query(_LINES + " SELECT plan_no, op AS operator, count(*) AS n FROM o WHERE op <> '' GROUP BY ALL")
def plan_operator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plantext.operators(_plans(spark, sf_dir), ["plan_no"], "plan").groupBy("plan_no", "operator").agg(F.count(F.lit(1)).alias("n"))


@query(_LINES + " SELECT plan_no, max(depth) AS depth FROM o GROUP BY plan_no")
def plan_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plantext.operators(_plans(spark, sf_dir), ["plan_no"], "plan").groupBy("plan_no").agg(F.max("depth").alias("depth"))


def _feature_sql() -> str:
    lists = {k: ",".join(f"'{n}'" for n in names) for k, names in plantext.COUNTED.items()}
    return ", ".join(f"CAST(count(*) FILTER (op IN ({v})) AS INTEGER) AS {k}" for k, v in lists.items())


@query(_LINES + f" SELECT plan_no, {_feature_sql()}, CAST(count(*) AS INTEGER) AS nodes, max(depth) AS depth, CAST(count(*) FILTER (op IN ('BroadcastHashJoin','SortMergeJoin','ShuffledHashJoin','BroadcastNestedLoopJoin','NestedLoopJoin','CartesianProduct')) AS INTEGER) AS joins, 'SortMergeJoin' AS actual_strategy FROM o WHERE op <> '' GROUP BY plan_no")
def plan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plantext.features(_plans(spark, sf_dir), ["plan_no"], "plan")


@query(_text_sql(COST_PLAN) + r""", l AS (SELECT plan_no, unnest(string_split(plan, chr(10))) AS line FROM t), x AS (SELECT plan_no, regexp_extract(line, '^[ :+\-]*([A-Za-z]+)', 1) AS node, line, CAST(regexp_extract(line, 'sizeInBytes=([0-9.]+)', 1) AS DOUBLE) AS v, regexp_extract(line, 'sizeInBytes=[0-9.]+ ?([A-Za-z]*)', 1) AS u, regexp_extract(line, 'rowCount=([0-9.E+]+)', 1) AS rc FROM l)
SELECT plan_no, node, v * CASE u WHEN 'KiB' THEN 1024.0 WHEN 'GiB' THEN 1073741824.0 WHEN 'EiB' THEN 1152921504606846976.0 ELSE 1.0 END AS size_bytes, CASE WHEN rc = '' THEN NULL ELSE CAST(rc AS DOUBLE) END AS row_count, v <= 0 AS degenerate FROM x""")
def explain_cost_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plantext.explain_cost(_plans(spark, sf_dir, COST_PLAN), ["plan_no"], "plan").drop("line_no")


_LABELS = ("default", "join_order_c_o_broadcast", "join_order_c_o_merge", "join_order_o_c", "broadcast", "join_order_a_b_c_shuffle_hash")
_LABEL_SQL = "(VALUES " + ",".join(f"('{x}')" for x in _LABELS) + ") AS t(strategy)"


@query(f"SELECT strategy, regexp_replace(regexp_replace(strategy, '^join_order_', ''), '_(broadcast|merge|shuffle_hash)$', '') AS logical_order FROM {_LABEL_SQL}")
def strategy_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _LABELS], "strategy string").withColumn("logical_order", plantext.logical_order(F.col("strategy")))


@query(f"SELECT strategy, CASE WHEN strategy LIKE '%broadcast' THEN false WHEN strategy LIKE '%shuffle_hash' THEN false ELSE true END AS matches FROM {_LABEL_SQL}")
def hint_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _LABELS], "strategy string").withColumn("matches", plantext.matches_hint(F.lit(PLAN), F.col("strategy")))


@query("SELECT CAST(n AS INTEGER) AS n_tables, CASE WHEN n <= 4 THEN 'small' WHEN n <= 7 THEN 'medium' ELSE 'large' END AS family FROM range(3, 11) t(n)")
def family_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(3, 11).select(F.col("id").cast("int").alias("n_tables"), family_of(F.col("id")).alias("family"))


@query("""WITH u AS (SELECT o_orderkey AS k, (o_orderkey * 7919 % 10007) / 10007.0::DOUBLE AS u FROM orders)
SELECT k, CAST(least(floor(u * 1000), 999) AS BIGINT) AS uniform, CAST(least(floor(exp(u * ln(1001.0::DOUBLE)) - 1), 999) AS BIGINT) AS s1, CAST(least(floor(pow(u * (pow(1001.0::DOUBLE, -0.5) - 1) + 1, -2.0) - 1), 999) AS BIGINT) AS s15 FROM u""")
def zipf_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 7919 % 10007 / F.lit(10007.0)).alias("u"))
    z = lambda s: functions.zipf_index(F.col("u"), 1000, s)
    return u.select("k", z(0).alias("uniform"), z(1).alias("s1"), z(1.5).alias("s15"))


@query("SELECT o_custkey AS query_id, o_orderkey AS plan_id, round(exp(ln(0.5::DOUBLE) + (ln(2.0::DOUBLE) - ln(0.5::DOUBLE)) * (('0x' || substr(sha256(CAST(o_custkey AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0::DOUBLE)), 6) AS factor FROM orders")
def plan_factor_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log-uniform factor in [0.5, 2] that depends on query and plan alone."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    factor = F.exp(F.log(F.lit(0.5)) + (F.log(F.lit(2.0)) - F.log(F.lit(0.5))) * u)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("plan_id"), F.round(factor, 6).alias("factor"))


# Telemetry and sampling -------------------------------------------------------------------------------


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry rows made from events; some break the rules."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    made = {
        "query_id": F.concat(F.lit("Q"), F.col("user_id").cast("string")), "plan_id": F.concat(F.lit("P"), (k % 7).cast("string")), "strategy": F.col("event_type"), "latency_ms": F.when(k % 10 == 0, None).otherwise(F.col("value")),
        "bytes_scanned": (k * 1024).cast("double"), "bytes_shuffled": (k * 512).cast("double"), "executor_seconds": F.when(k % 23 == 0, -1.0).otherwise((k % 50).cast("double")), "run_number": k % 5, "cache_state": F.when(k % 9 == 0, "lukewarm").otherwise("warm"),
        "aqe_enabled": F.lit(False), "cbo_enabled": F.lit(False), "num_cores": F.lit(8).cast("long"), "memory_gb": F.lit(16.0), "seed": F.lit(None).cast("long"), "timestamp": F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double"),
        "status": F.when(k % 20 == 0, "failed").otherwise("ok"),
    }
    rest = {n: F.lit(None).cast(t) for n, t in logs.OPTIONAL.items() if n not in made}
    return e.select(k.alias("event_id"), *[c.alias(n) for n, c in {**made, **rest}.items()])


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id%10<>0 AND value<0 THEN 'latency_ms: too small' END, CASE WHEN event_id%23=0 THEN 'executor_seconds: too small' END, CASE WHEN event_id%5<1 THEN 'run_number: too small' END,
CASE WHEN event_id%9=0 THEN 'cache_state: unknown' END, CASE WHEN event_id%20<>0 AND (event_id%10=0 OR value IS NULL) THEN 'latency_ms: null in a run that went well' END], lambda x: x IS NOT NULL), '; ') AS problems FROM events""")
def telemetry_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _telemetry(spark, sf_dir)
    return t.select("event_id", F.array_join(logs.problem_column(), "; ").alias("problems"))


@query("""SELECT event_type AS batch, count(*) AS runs, CAST(sum(CASE WHEN event_id%23=0 THEN 0 ELSE event_id%50 END) AS DOUBLE) AS executor_seconds, CAST(sum(event_id*1024) AS DOUBLE) AS bytes_scanned,
round(sum(CASE WHEN event_id%23=0 THEN 0 ELSE event_id%50 END)*(0.192::DOUBLE+0.1::DOUBLE)/4/3600,6) AS provider_cost FROM events GROUP BY 1""")
def telemetry_batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costplan.operators.cost import cluster_cost

    t = _telemetry(spark, sf_dir).withColumn("executor_seconds", F.greatest("executor_seconds", F.lit(0.0)))
    by = t.groupBy(F.col("strategy").alias("batch")).agg(F.count(F.lit(1)).alias("runs"), F.sum("executor_seconds").alias("executor_seconds"), F.sum("bytes_scanned").alias("bytes_scanned"))
    return by.withColumn("provider_cost", F.round(cluster_cost(F.col("executor_seconds"), F.lit(0.192), F.lit(0.1), F.lit(4)), 6))


@query("""WITH e AS (SELECT count(*) AS n FROM lineitem), s AS (SELECT count(*) AS n FROM lineitem WHERE l_orderkey%10=0) SELECT e.n AS exact_rows, s.n AS sampled_rows, round(abs(s.n/0.1::DOUBLE-e.n)/e.n*100,6) AS error_percent FROM e, s""")
def aqp_sample_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of a deterministic tenth of the rows (by key); sample_degraded draws at random."""
    items = table(spark, sf_dir, "lineitem")
    both = items.agg(F.count(F.lit(1)).alias("exact_rows"), F.count_if(F.pmod("l_orderkey", F.lit(10)) == 0).alias("sampled_rows"))
    return both.withColumn("error_percent", F.round(F.abs(F.col("sampled_rows") / 0.1 - F.col("exact_rows")) / F.col("exact_rows") * 100, 6))


@query()
def sample_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degraded form of a query: a seeded Bernoulli sample of its output (a sampling operator, by design)."""
    from costplan.run.adaptive import degraded

    views(spark, sf_dir)
    return degraded(spark.sql("SELECT l_orderkey, l_linenumber FROM lineitem"), 0.1, 42)


@query("""SELECT scenario, policy, count(*) AS n, round(avg(CAST(cost<=budget AS DOUBLE)),6) AS within_rate, round(quantile_cont(cost,0.5),6) AS median_cost, round(max(cost),6) AS max_cost, round(quantile_cont(cost,0.5)/max(strict),6) AS ratio_to_strict
FROM (SELECT *, quantile_cont(cost,0.5) FILTER (policy='strict') OVER (PARTITION BY scenario) AS strict FROM (SELECT o_orderstatus AS scenario, CASE WHEN o_orderkey%3=0 THEN 'strict' ELSE 'adaptive' END AS policy, round(o_totalprice,2) AS cost, 150000.0::DOUBLE AS budget FROM orders)) GROUP BY 1,2""")
def policy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costplan.run.evaluate import policy_summary

    runs = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("scenario"), F.when(F.col("o_orderkey") % 3 == 0, "strict").otherwise("adaptive").alias("policy"), F.round("o_totalprice", 2).alias("cost"), F.lit(150000.0).alias("budget"))
    s = policy_summary(runs)
    return s.select("scenario", "policy", "n", *[F.round(c, 6).alias(c) for c in ("within_rate", "median_cost", "max_cost", "ratio_to_strict")])
