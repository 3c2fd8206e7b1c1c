"""Every query of the core package that SQL can express, against DuckDB on the smallest tables."""

import pytest
from helpers import assert_same, connect

from costplan import catalogue

SLOW = {"join_order_equivalence", "beam_variants_equivalence", "flagship", "ablation_grid"}
NAMES = [n for n in catalogue.ORACLE if not (n.startswith("star_join_") and not n.endswith("_mid"))]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, con, name):
    assert_same(catalogue.QUERIES[name](spark, sf).toPandas(), con.execute(catalogue.ORACLE[name]).df())


def test_every_query_of_the_other_years(spark, sf, con):
    for name in ("star_join_04_narrow", "star_join_06_wide"):
        assert_same(catalogue.QUERIES[name](spark, sf).toPandas(), con.execute(catalogue.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs_without_sql(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
