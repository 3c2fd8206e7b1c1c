import math

import pytest
from helpers import assert_same, connect

from costplan.plans import alternatives, plantext, search
from costplan.plans.shape import QueryRequest, shape
from costplan.plans.statistics import plan_statistics
from costplan.session import temporary_conf

CHAIN = "SELECT COUNT(*) AS n FROM a JOIN b ON a.id = b.a_id JOIN c ON b.id = c.b_id JOIN d ON c.id = d.c_id"


@pytest.fixture(scope="module")
def chain(spark):
    for i, (t, up) in enumerate((("a", None), ("b", "a"), ("c", "b"), ("d", "c"))):
        cols = "id" if up is None else f"id, id % 5 as {up}_id"
        spark.range(10 * (i + 1)).selectExpr(*cols.split(", ")).createOrReplaceTempView(t)
    return shape(spark, CHAIN)


@pytest.mark.parametrize("bad", [{"query_id": " "}, {"sql": ""}, {"budget": 0.0}, {"budget": math.inf}, {"deadline": -1.0}, {"accuracy_tolerance": 101.0}])
def test_request_is_checked(bad):
    with pytest.raises(ValueError):
        QueryRequest(**{"query_id": "Q", "sql": "SELECT 1", "budget": 1.0, **bad})


def test_shape_of_a_chain(chain):
    assert chain.aliases == ("a", "b", "c", "d") and chain.reorderable and chain.has_aggregate and not chain.has_order_by
    assert chain.adjacency["b"] == {"a", "c"}


def test_outer_join_keeps_its_type_and_blocks_reordering(spark, chain):
    s = shape(spark, CHAIN.replace("JOIN c", "LEFT JOIN c"))
    assert [j.kind for j in s.joins] == ["INNER", "LEFT OUTER", "INNER"] and not s.reorderable
    assert {v.label for v in alternatives.variants(s)} == {"default", "broadcast", "merge", "shuffle_hash"}


@pytest.mark.parametrize("sql", ["WITH x AS (SELECT 1 AS id) SELECT * FROM x", "SELECT * FROM (SELECT * FROM a) q JOIN b ON q.id = b.a_id JOIN c ON b.id = c.b_id", CHAIN + " AND a.id = c.id", "SELECT 1"])
def test_no_reordering_beyond_plain_pairs(spark, chain, sql):
    assert not shape(spark, sql).reorderable


def test_hint_goes_to_the_outer_select(spark, chain):
    s = shape(spark, "WITH x AS (SELECT id FROM a) SELECT 'select' AS t, x.id FROM x JOIN b ON x.id = b.a_id")
    assert "SELECT /*+ MERGE(x, b) */ 'select'" in alternatives.with_hint(s, s.sql, "MERGE", ("x", "b"))


def test_every_variant_gives_the_same_rows_and_columns(spark, chain):
    s = shape(spark, CHAIN.replace("COUNT(*) AS n", "*"))
    want, columns = None, spark.sql(s.sql).columns
    for v in alternatives.variants(s)[::4]:
        df = spark.sql(v.sql)
        rows = sorted(map(tuple, df.collect()))
        assert df.columns == columns
        assert want is None or rows == want
        want = rows


def test_candidates_are_distinct_and_the_same_in_parallel(spark, chain):
    q = QueryRequest("Q", CHAIN, 1.0)
    one, four = alternatives.candidates(spark, q), alternatives.candidates(spark, q, workers=4)
    assert [c.plan_id for c in one] == [c.plan_id for c in four] and len({c.fingerprint for c in one}) == len(one) > 2
    assert one[0].plan_id == "Q_P01" and len({c.features["actual_strategy"] for c in one}) >= 2
    assert len(alternatives.candidates(spark, q, limit=8)) <= 8


def test_beam_edges():
    flat = lambda o: 0.0
    full = {x: set("abcdef") - {x} for x in "abcdef"}
    assert len(search.beam_orders("abcdef", full, flat, 3)) == 3
    assert search.beam_orders("abc", {"a": {"b"}}, flat, 5) == []
    star = {"f": {"a", "b", "c"}}
    assert {o[0] for o in search.beam_orders("fabc", star, flat, 4)} == set("fabc")
    for bad in ({"width": 0}, {"width": True}):
        with pytest.raises(ValueError):
            search.beam_orders("ab", {"a": {"b"}}, flat, **bad)
    with pytest.raises(ValueError):
        search.beam_orders("ab", {"a": {"z"}}, flat)
    with pytest.raises(ValueError):
        search.beam_orders("ab", {"a": {"b"}}, lambda o: math.nan)


def test_cardinality_scorer():
    stats = search.SearchStatistics({"f": 1e6, "a": 100, "b": 100, "c": 100}, {("f", "a"): 1e-4, ("f", "b"): 0.1, ("c", "f"): 0.1})
    score = search.cardinality_scorer("fabc", {"f": "abc"}, stats)
    assert score(("a", "f", "b", "c")) < score(("b", "f", "a", "c"))
    assert search.cardinality_scorer("fabcd", {"f": "abcd"}, stats) is None
    with pytest.raises(ValueError):
        score(("a", "b"))
    with pytest.raises(ValueError):
        search.cardinality_scorer("fa", {"f": "a"}, search.SearchStatistics({"f": 1, "a": 1}, {("f", "a"): 2.0}))


def test_cap_keeps_bases_and_covers_orders():
    labels = [("default", None), ("broadcast", None)] + [(f"join_order_{'_'.join(o)}{s}", o) for o in (("a", "b"), ("b", "a")) for s in ("", "_broadcast", "_merge")]
    score = search.size_scorer(("a", "b"), {"a": 1.0, "b": 10.0})
    assert [labels[i][0] for i in search.cap_variants(labels, score, 4)] == ["default", "broadcast", "join_order_a_b_broadcast", "join_order_b_a_broadcast"]
    assert search.cap_variants(labels, score, 99) == list(range(len(labels)))
    with pytest.raises(ValueError):
        search.cap_variants(labels, score, 1)


def test_plan_text_of_a_live_plan(spark, chain):
    text = alternatives.plan_text(spark, CHAIN)
    f = plantext.features_of(text)
    assert f["joins"] == 3 and f["aggregates"] == 2
    v = plantext.vector_of(text)
    assert list(v) == list(plantext.VECTOR) and v["num_nodes"] > 5
    assert plantext.vector_of(text, {"scan_bytes": 7.0})["scan_bytes"] == 7.0


def test_fingerprint_ignores_ids_only():
    a = "*(1) Project [x#1L]\n+- Scan t [x#1L], [plan_id=3]"
    assert plantext.fingerprint_of(a) == plantext.fingerprint_of(a.replace("#1L", "#99").replace("*(1)", "*(7)").replace("=3", "=4"))
    assert plantext.fingerprint_of(a) != plantext.fingerprint_of(a.replace("Scan t", "Scan u"))


def test_plan_statistics(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").crossJoin(spark.read.parquet(f"{sf}/customer.parquet"))
    s = plan_statistics(df)
    assert s.input_bytes > 0 and s.intermediate_bytes > 0


def test_equivalence_queries_run_every_variant(spark, sf, monkeypatch):
    from costplan import queries_workload as q
    from costplan.plans import alternatives
    from costplan.plans.shape import shape

    for name, sql, mode, width in (("join_order_equivalence", q._FOUR, "exhaustive", 0), ("beam_variants_equivalence", q._SIX, "beam", 3)):
        q.views(spark, sf, sql)
        want = [v.sql for v in alternatives.variants(shape(spark, sql), mode, width)]
        run, real = [], type(spark).sql
        with monkeypatch.context() as m:
            m.setattr(type(spark), "sql", lambda self, text, *a, **k: (run.append(text), real(self, text, *a, **k))[1])
            df = q.QUERIES[name](spark, sf)
        assert [t for t in run if t in set(want)] == want, name
        # All of them are left after optimisation.
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == len(want) * sql.count(" JOIN "), name


def test_broadcast_hints_name_only_what_the_driver_can_hold(spark, sf, chain, monkeypatch):
    from costplan import catalogue

    hints = {v.label: v.sql.partition("*/")[0] for v in alternatives.variants(chain, small={"b", "d"}) if v.label.endswith("broadcast")}
    assert hints["broadcast"].endswith("BROADCAST(b) ") and hints["join_order_b_a_c_d_broadcast"].endswith("BROADCAST(b, d) ")
    assert [v.label for v in alternatives.variants(chain, small=())] == [v.label for v in alternatives.variants(chain)]
    assert not any("BROADCAST" in v.sql for v in alternatives.variants(chain, small=()))
    # 8 GB of keys.
    spark.range(10**9).createOrReplaceTempView("wide")
    sql = CHAIN.replace("FROM a JOIN b ON a.id", "FROM wide JOIN b ON wide.id")
    assert alternatives.broadcastable(spark, shape(spark, sql)) == {"b", "c", "d"}
    with temporary_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        named = [c.sql.partition("BROADCAST(")[2].partition(")")[0] for c in alternatives.candidates(spark, QueryRequest("Q", sql, 1.0))]
    assert any(named) and not any("wide" in n for n in named)

    monkeypatch.setattr(alternatives, "MOST_BROADCAST", 10_000)
    with temporary_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        df = catalogue.flagship(spark, sf)
        text = df._jdf.queryExecution().executedPlan().toString()
        # Customer and nation; orders and lineitem are joined by a shuffle.
        assert text.count("BroadcastExchange") == 2 and text.count("SortMergeJoin") + text.count("ShuffledHashJoin") == 1, text
        assert_same(df.toPandas(), connect(sf).execute(catalogue.FLAGSHIP).df())


@pytest.mark.parametrize(("name", "jobs"), [("join_order_equivalence", 8), ("beam_variants_equivalence", 16)])
def test_equivalence_over_relations_too_large_for_a_broadcast(spark, sf, monkeypatch, name, jobs):
    from costplan import queries_workload as q

    monkeypatch.setattr(alternatives, "MOST_BROADCAST", 10_000)
    run, parts, sql, written = [], [], type(spark).sql, q.written
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: (run.append(text), sql(self, text, *a, **k))[1])
    monkeypatch.setattr(q, "written", lambda df, *a: (parts.append(written(df, *a)), parts[-1])[1])
    got = q.QUERIES[name](spark, sf).toPandas()
    hints = [t.partition("BROADCAST(")[2].partition(")")[0].split(", ") for t in run]
    assert any("cn" in h for h in hints) and not any({"l", "o"} & set(h) for h in hints)
    # Every variant has its rows in one of the parts.
    assert len(parts) == jobs and sorted({r[0] for p in parts for r in p.select("__variant").collect()}) == list(range(len(run)))
    assert_same(got, connect(sf).execute(q.ORACLE[name]).df())
