"""Problems 3 and 5: schema drift and implausible readings."""

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costplan.operators import drift, spikes
from costplan.queries_general import QUERIES

KINDS = list(drift.SPARK_TYPE)


@given(st.lists(st.sampled_from(KINDS), max_size=6), st.randoms())
@settings(max_examples=60, deadline=None)
def test_fold_is_order_free_and_idempotent(kinds, random):
    mixed = list(kinds)
    random.shuffle(mixed)
    assert drift.fold(kinds) == drift.fold(mixed) == drift.fold([*kinds, drift.fold(kinds)])


def test_promotion():
    assert drift.promote("integer", "decimal") == "decimal" and drift.promote("boolean", "integer") == "text" and drift.promote("null", "boolean") == "boolean" and drift.fold([]) == "null"
    with pytest.raises(ValueError):
        drift.promote("integer", "what")


def _lines(spark, files, feed="f"):
    """files: list of (file_id, hour, [payload])"""
    rows = [(i, feed, f"2021-01-01 {h:02d}:00:00", n, p if isinstance(p, str) or p is None else json.dumps(p)) for i, h, ps in files for n, p in enumerate(ps)]
    return spark.createDataFrame(rows, "file_id long, feed string, written_at string, line_no int, payload string").withColumn("written_at", F.col("written_at").cast("timestamp"))


def _found(df):
    return {(r["file_id"], r["field_name"], r["change_kind"]) for r in drift.changes(df).collect()}


BASE = [{"run_id": i, "mode": "beam" if i % 2 else "all", "count": i * 3, "seconds": i + 0.5, "ok": True} for i in range(1, 7)]


def _with(records, **change):
    """Records with fields renamed (str), converted (callable) or dropped (None)."""
    out = []
    for r in records:
        new = {}
        for k, v in r.items():
            c = change.get(k, k)
            if c is None:
                continue
            new[c if isinstance(c, str) else k] = v if isinstance(c, str) else c(v)
        out.append(new)
    return out


def test_each_kind_of_change(spark):
    second = _with(BASE, mode="searchMode", count=str, ok=None)
    for r in second:
        r["workers"] = 4
    second = [dict(reversed(r.items())) for r in second]
    got = _found(_lines(spark, [(1, 1, BASE), (2, 2, second), (3, 3, second)]))
    assert got == {(2, "searchMode", "renamed"), (2, "count", "retyped"), (2, "ok", "removed"), (2, "workers", "added")}


def test_renamed_and_retyped(spark):
    assert _found(_lines(spark, [(1, 1, BASE), (2, 2, _with([{**r, "n": str(r["count"])} for r in BASE], count=None))])) == {(2, "n", "renamed"), (2, "n", "retyped")}


def test_units_nulls_strays_broken_lines_and_late_files_are_no_change(spark):
    second = _with(BASE, seconds=lambda v: v * 1000)
    second[0]["count"], second[1]["ok"] = "n/a", None
    lines = [(2, 2, [*second, second[0], '{"run_id": 1, "mo', "[1]", "null", None, ""]), (1, 1, BASE)]
    assert _found(_lines(spark, lines)) == set()


def test_unrelated_fields_are_no_rename(spark):
    second = _with(BASE, count=None)
    for i, r in enumerate(second):
        r["depth"] = 100 - i
    assert _found(_lines(spark, [(1, 1, BASE), (2, 2, second)])) == {(2, "count", "removed"), (2, "depth", "added")}


def test_feeds_apart_ties_and_empty(spark):
    a, b = _lines(spark, [(1, 1, BASE)]), _lines(spark, [(2, 2, _with(BASE, ok=None))], feed="g")
    assert _found(a.union(b)) == set() and _found(a.limit(0)) == set()
    assert _found(_lines(spark, [(1, 1, BASE), (2, 1, _with(BASE, ok=None))])) == {(2, "ok", "removed")}
    nulls = a.union(_lines(spark, [(2, 2, _with(BASE, ok=None))])).withColumn("feed", F.lit(None).cast("string"))
    assert _found(nulls) == {(2, "ok", "removed")}


def test_brute_force_on_the_smallest_files(spark, sf):
    import collections

    d = spark.read.parquet(f"{sf}/planning_files.parquet").toPandas().sort_values(["feed", "written_at", "file_id", "line_no"])
    kind = lambda v: "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "decimal" if isinstance(v, float) else "text"
    want, before = set(), None
    for (feed, _, fid), g in d.groupby(["feed", "written_at", "file_id"]):
        recs, types = [], {}
        for p in g.payload:
            try:
                o = json.loads(p)
            except ValueError:
                continue
            if isinstance(o, dict):
                recs.append(o)
                for k, v in o.items():
                    c = types.setdefault(k, collections.Counter())
                    if v is not None:
                        c[kind(v)] += 1
        types = {k: c.most_common(1)[0][0] if c else None for k, c in types.items()}
        if before and before[0] == feed:
            old = {o.get("run_id"): o for o in before[2]}
            both = [(old[o["run_id"]], o) for o in recs if o.get("run_id") in old]
            same = lambda r, a: (lambda v: bool(v) and all(str(x).lower() == str(y).lower() or (kind(x) != "text" and float(x) == float(y)) for x, y in v))([(p[r], o[a]) for p, o in both if p.get(r) is not None and o.get(a) is not None])  # noqa: B023, E731
            gone, new = set(before[1]) - set(types), set(types) - set(before[1])
            pairs = {a: r for a in new for r in gone if same(r, a)}
            want |= {(fid, a, "renamed" if a in pairs else "added") for a in new} | {(fid, r, "removed") for r in gone - set(pairs.values())}
            want |= {(fid, a, "retyped") for a, r in [*pairs.items(), *((k, k) for k in set(types) & set(before[1]))] if types[a] and before[1][r] and types[a] != before[1][r]}
        before = (feed, types, recs)
    assert {tuple(r) for r in QUERIES["p3_found"](spark, sf).collect()} == want and want


def test_union_keeps_every_run_once(spark, sf):
    df = QUERIES["p3_runs"](spark, sf)
    n = {r["origin"]: r["n"] for r in df.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).collect()}
    for name in ("planning_runs", "prescoring_all_runs"):
        assert n[name] == spark.read.parquet(f"{sf}/{name}.parquet").distinct().count()
    assert dict(df.dtypes)["timestamp_utc"] == "timestamp_ntz" and df.where("timestamp_utc is not null").count() > 0.9 * sum(n.values())
    assert {"mode", "generated_sql_variant_count"} <= set(df.columns) and not {"search_mode", "sql_variant_count"} & set(df.columns)


def test_cast_keeps_strays(spark):
    got = drift.cast_lines(_lines(spark, [(1, 1, [{"a": "x", "b": 2}, {"a": "3", "B": 1.5}])]), {"a": "integer", "b": "decimal"}, {"b": ["b", "B"]}).orderBy("line_no").collect()
    assert [(r["a"], r["b"]) for r in got] == [(None, 2.0), (3, 1.5)] and got[0]["strays"] == {"a": "x"} and got[1]["strays"] is None


def test_union_converts_units_and_keeps_earlier_values(spark):
    files = [(1, 1, [{"run_id": "a", "s": 1.5, "x": 1}, {"run_id": "b", "s": 2.5, "x": "?"}]), (2, 2, [{"run_id": "a", "s": 1500}, {"run_id": "b", "s": 2501}, {"run_id": "c", "s": 4000}]), (3, 3, [{"run_id": "d", "s": 8000}])]
    rows = drift.cast_lines(_lines(spark, files), {"run_id": "text", "s": "decimal", "x": "integer"}, {})
    steps = drift.unit_steps(rows, ["s", "x"])
    assert [(r["field"], r["file_id"], r["step"]) for r in steps.collect()] == [("s", 2, 1000.0)]
    got = drift.latest(drift.in_one_unit(rows, steps, ["s"]), ["feed", "run_id"], ["run_id", "s", "x"]).orderBy("run_id").collect()
    assert [(r["run_id"], r["s"], r["x"], r["strays"]) for r in got] == [("a", 1.5, 1, None), ("b", 2.501, None, {"x": "?"}), ("c", 4.0, None, None), ("d", 8.0, None, None)]


def test_tables_keep_strays_and_received_at(spark, sf):
    got = drift.cast_table(spark.createDataFrame([("7",), ("x",)], "a string"), {"a": "integer"}, {}).collect()
    assert [(r["a"], r["strays"]) for r in got] == [(7, None), (None, {"a": "x"})]
    assert QUERIES["p3_runs"](spark, sf).where("received_at is not null").count() > 0


# Readings -----------------------------------------------------------------------------------------------


def _series(rng, n=200, level=3.0, scatter=0.05):
    return level * np.exp(rng.normal(0, scatter, n))


def _readings(spark, series, source="s", extra=""):
    rows = [(i, source, i, None if v is None else float(v)) for i, v in enumerate(series)]
    df = spark.createDataFrame(rows, "id long, plan string, at long, v double").withColumn("t", F.timestamp_seconds(F.col("at") * 600))
    return df.withColumns({"chunk": F.lit(1), "source": F.lit("clash"), "x": F.lit("clash"), "core": F.lit(0)})


def _flags(df, **options):
    return {(r["row_id"], r["reason"]) for r in spikes.implausible(df, "plan", "t", "v", "id", **options).collect()}


def test_rules(spark):
    x = list(_series(np.random.default_rng(0)))
    x[20], x[50:52], x[80:83] = 30.0, [0.5, 0.5], [9.0, 9.1, 9.2]
    x[100:106] = [x[100]] * 6
    x[120:125] = [x[120]] * 5
    x[140], x[141], x[142], x[143] = float("nan"), float("inf"), 0.0, -1.0
    want = {(20, "spike"), *((i, "spike") for i in (50, 51, 80, 81, 82)), *((i, "stuck") for i in range(100, 106)), *((i, "impossible") for i in range(140, 144))}
    assert _flags(_readings(spark, x)) == want
    # Chunks of about 40 readings give the same as the whole series.
    assert _flags(_readings(spark, x), target=40) == want


def test_shifts_trends_and_long_excursions_are_no_cases(spark):
    rng = np.random.default_rng(1)
    shift = np.r_[_series(rng, 100), _series(rng, 100, 9.0)]
    trend = _series(rng) * np.exp(np.linspace(0, 2, 200))
    swing = _series(rng) * np.exp(np.sin(np.arange(200) / 30))
    plateau = _series(rng)
    plateau[90:96] *= 3
    for x in (shift, trend, swing, plateau, _series(rng, scatter=0.25)):
        assert _flags(_readings(spark, x)) == set()


def test_repeats_nulls_short_and_empty(spark):
    x = [3.0, 3.1, None, 30.0, 3.05, 2.95, 3.2]
    df = _readings(spark, x)
    assert _flags(df) == {(3, "spike")} == _flags(df.union(df))
    assert _flags(df.withColumn("plan", F.lit(None).cast("string"))) == set() and _flags(df.limit(0)) == set()
    assert _flags(_readings(spark, [1.0])) == set()


def test_tail_cutoff_decides(spark):
    """Of a plan with a heavy tail a reading that passes the rule alone is no spike; of a calm plan it is."""
    rng = np.random.default_rng(5)
    calm = _series(rng, 480, scatter=0.005)
    heavy = calm.copy()
    heavy[6::12] *= np.exp(rng.uniform(0.2, 0.42, 40))
    for x in (calm, heavy):
        x[240], x[360] = 5.1, 9.0
    assert _flags(_readings(spark, calm)) == {(240, "spike"), (360, "spike")}
    assert _flags(_readings(spark, heavy)) == {(360, "spike")}


def test_many_spikes_do_not_hide_each_other(spark):
    """The threshold of the fit is that of the usual readings: here 3 of 16 are spikes."""
    x = _series(np.random.default_rng(6), 16, scatter=0.01)
    x[7:10] *= 2.0
    cut = spikes.tail_cutoffs(spikes.judged_readings(_readings(spark, x), "plan", "t", "v", "id"), 1.55, 6.4, 1e-4).first()
    assert cut["pot_cutoff"] < cut["rule_cutoff"]
    assert _flags(_readings(spark, x)) == {(i, "spike") for i in (7, 8, 9)}


def test_chunked_hot_source_equals_whole(spark):
    rng = np.random.default_rng(7)
    x = _series(rng, 3000)
    at = rng.choice(3000, 40, replace=False)
    x[at] *= 4
    whole = _flags(_readings(spark, x))
    assert whole == _flags(_readings(spark, x), target=100) and len(whole & {(int(i), "spike") for i in at}) >= 38


def test_seasons_widen_the_tail_of_hours_that_are_slow(spark):
    """A source that is always slow from 9 to 10: its level there is found, plain residuals would hold it against the tail."""
    rng = np.random.default_rng(0)
    t = pd.date_range("2024-01-01", periods=4000, freq="17min")
    x = np.exp(rng.normal(0, 0.02, len(t)) + np.where(t.hour == 9, 0.2, 0.0))
    df = spark.createDataFrame(pd.DataFrame({"run": range(len(t)), "plan": "p", "at": t, "v": x}))
    judged = spikes.judged_readings(df, "plan", "at", "v", "run")
    both = spikes.seasonal(judged, 0.47)
    level = {r["slow"]: r["m"] for r in both.join(df.select(F.col("run").alias("row_id"), (F.hour("at") == 9).alias("slow")), "row_id").groupBy("slow").agg(F.median(F.col("residual") - F.col("seasonal_residual")).alias("m")).collect()}
    assert level[True] > 0.1 > abs(level[False])
    plain, season = spikes.tail_cutoffs(judged, 1.6, 8.0, 1e-4).first(), spikes.tail_cutoffs(both, 1.6, 8.0, 1e-4).first()
    assert season["pot_cutoff"] < plain["pot_cutoff"] and season["rule_cutoff"] == plain["rule_cutoff"]
    few = spikes.seasonal(spikes.judged_readings(df.limit(300), "plan", "at", "v", "run"), 0.47)
    assert few.where("residual <> seasonal_residual").count() == 0


def test_promotion_of_columns_equals_that_of_kinds(spark):
    kinds = list(drift.SPARK_TYPE)
    rows = [(a, b) for a in kinds for b in kinds] + [(None, "text"), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", drift.promoted(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r["p"] == drift.promote(r["a"] or "null", r["b"] or "null") for r in got)
