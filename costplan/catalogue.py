"""All queries of the core package, by name, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costplan import queries_general, queries_pool, queries_results, queries_sources, queries_workload
from costplan.plans.shape import QueryRequest
from costplan.planner import Planner
from costplan.session import temporary_conf

QUERIES: dict = {**queries_general.QUERIES, **queries_pool.QUERIES, **queries_workload.QUERIES, **queries_results.QUERIES, **queries_sources.QUERIES}
ORACLE: dict = {**queries_general.ORACLE, **queries_pool.ORACLE, **queries_workload.ORACLE, **queries_results.ORACLE, **queries_sources.ORACLE}


FLAGSHIP = (
    "SELECT cn.n_name, COUNT(*) AS n_items, CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
    "JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey WHERE o.o_totalprice > 1000 GROUP BY cn.n_name"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four-relation star query, planned under a budget: the chosen plan's result.

    Plans are compared as their hints ask, so reordering and automatic broadcasts are off while planning.
    """
    queries_workload.views(spark, sf_dir, FLAGSHIP)
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.cbo.joinReorder.enabled": "false"}
    with temporary_conf(spark, off):
        plan = Planner(spark).plan(QueryRequest("FLAGSHIP", FLAGSHIP, budget=0.01, deadline=600.0))
    return spark.sql(plan.chosen.candidate.sql)


QUERIES["flagship"] = flagship
ORACLE["flagship"] = FLAGSHIP
