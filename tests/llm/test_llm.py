"""Problems 1, 2, 4, 6, 7 and 8."""

import collections
import itertools
import math
import os

import numpy as np
import offence_sentences as sentences
import pytest
from helpers import assert_same, connect
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costplan.llm import components, leaks, mixing, offence, queries, sketch, splits, text, topn
from costplan.session import temporary_conf


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_matches_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf).toPandas(), connect(sf).execute(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.count() > 0


# Problem 1 ------------------------------------------------------------------------------------------------


def test_spellings_of_ids(spark):
    rows = [("Q00000012", "Q00000012_P07"), (" q-12", "q12-p007 "), ("q_0012", "Q 12 P7"), ("", ""), (None, None), ("Q0", "Q0_P0")]
    got = spark.createDataFrame(rows, "q string, p string").select(splits.canonical_query(F.col("q")).alias("q"), splits.canonical_plan(F.col("p")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("Q12", "Q12P7")] * 3 + [(None, None)] * 2 + [("Q0", "Q0P0")]


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
@settings(max_examples=6, deadline=None)
def test_components_equal_union_find(spark, pairs):
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in pairs:
        up[root(a)] = root(b)
    least = collections.defaultdict(lambda: 99)
    for x in list(up):
        least[root(x)] = min(least[root(x)], x)
    edges = spark.createDataFrame([(f"{a:02d}", f"{b:02d}") for a, b in pairs], "u string, v string")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {f"{x:02d}": f"{least[root(x)]:02d}" for x in up if any(a != b and x in (a, b) for a, b in pairs)}


def test_long_chain(spark):
    n = 130
    edges = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in np.random.default_rng(0).permutation(n)], "u string, v string")
    got = components.components(edges).collect()
    assert len(got) == n + 1 and {r["component"] for r in got} == {"0000"}


@given(st.lists(st.tuples(st.integers(1, 50), st.sampled_from(["a", "b"]), st.integers(1, 40)), min_size=1, max_size=12, unique_by=lambda b: b[:2]))
@settings(max_examples=50, deadline=None)
def test_allocation_is_whole_and_near(bundles):
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    flow = splits.allocate(bundles, shares)
    assert (flow >= 0).all() and flow.sum(axis=1).tolist() == [b[2] for b in bundles]
    size = np.array([b[0] for b in bundles])
    gap = np.abs(size @ flow - (size @ [b[2] for b in bundles]) * np.array([0.15, 0.7, 0.15]))
    assert gap.max() <= 2 * size.max()


def test_split_edges(spark):
    schema = "row_id long, entity string, link string, label string"
    rows = [(1, "A", "x", "l"), (2, "B", "x", None), (3, "B", "y", "l"), (4, None, "y", "l"), (5, None, None, "l"), (6, None, None, "l"), (7, "C", None, "m"), (7, "C", None, "m"), (8, None, "z", "m"), (9, None, "z", "m")]
    df = spark.createDataFrame(rows, schema)
    got = splits.grouped_splits(df, "entity", "link", "label", {"a": 0.5, "b": 0.5}).collect()
    assert sorted(r["row_id"] for r in got) == list(range(1, 10))
    of = {r["row_id"]: r["__component"] for r in got}
    assert len({of[i] for i in (1, 2, 3, 4)}) == 1 and of[8] == of[9] and len(set(of.values())) == 5
    for c in set(of.values()):
        assert len({r["__split"] for r in got if r["__component"] == c}) == 1
    assert splits.grouped_splits(df.limit(0), "entity", "link", "label", {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        splits.grouped_splits(df.withColumn("__split", F.lit(1)), "entity", "link", "label", {"a": 1.0})
    with pytest.raises(ValueError):
        splits.allocate([(1, "a", 1)], {})


def _parts(n, k):
    if k == 1:
        yield (n,)
        return
    for i in range(n + 1):
        yield from ((i, *rest) for rest in _parts(n - i, k - 1))


def _cost(groups, quota, flow):
    size, n = np.array([g[0] for g in groups]), np.array([g[2] for g in groups])
    gap = size[:, None] * (flow - n[:, None] * quota)
    kinds = [[i for i, g in enumerate(groups) if g[1] == k] for k in {g[1] for g in groups}]
    return np.abs(gap.sum(axis=0)).sum() + 0.25 * sum(np.abs(gap[i].sum(axis=0)).sum() for i in kinds)


@given(st.integers(1, 9), st.lists(st.integers(1, 5), min_size=1, max_size=3), st.tuples(*[st.integers(1, 20)] * 3))
@settings(max_examples=60, deadline=None)
def test_flow_of_one_size_costs_least(size, counts, shares):
    groups = [(size, f"k{i}", n) for i, n in enumerate(counts)]
    flow = splits.allocate(groups, dict(zip("abc", shares)))
    quota = np.array(shares) / sum(shares)
    least = min(_cost(groups, quota, np.array(f)) for f in itertools.product(*[list(_parts(n, 3)) for n in counts]))
    assert _cost(groups, quota, flow) <= least + 1e-6


def test_many_groups_settle(spark):
    rng = np.random.default_rng(0)
    groups = sorted(collections.Counter(zip(np.maximum(1, rng.pareto(1.1, 40000) * 3).astype(int).tolist(), rng.integers(0, 60, 40000).astype(str).tolist())).items())
    groups = [(s, k, n) for (s, k), n in groups]
    flow = splits.allocate(groups, {"train": 0.8, "validation": 0.1, "test": 0.1})
    size = np.array([g[0] for g in groups])
    assert np.abs(size @ flow - (size @ np.array([g[2] for g in groups])) * np.array([0.1, 0.8, 0.1])).max() < 2


def test_strides_reach_every_position():
    for n in [*range(1, 60), 1000, 4096]:
        assert {i * splits.stride(n) % n for i in range(n)} == set(range(n))


def test_hot_query_and_many_singles_reach_the_shares(spark):
    hot = spark.range(1000).selectExpr("id as row_id", "'HOT' as entity", "cast(id as string) as link", "'l' as label")
    single = spark.range(1000, 3000).selectExpr("id as row_id", "cast(id as string) as entity", "cast(id as string) as link", "'l' as label")
    got = splits.grouped_splits(hot.union(single), "entity", "link", "label", {"train": 0.7, "validation": 0.15, "test": 0.15}, cell=100)
    n = {r["__split"]: r["n"] for r in got.groupBy("__split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"train": 2100, "validation": 450, "test": 450}
    again = splits.grouped_splits(hot.union(single), "entity", "link", "label", {"train": 0.7, "validation": 0.15, "test": 0.15}, cell=37)
    assert got.select("row_id", "__split").exceptAll(again.select("row_id", "__split")).count() < 150  # cells only change how ranks are found within a hash range


# Problem 2 ------------------------------------------------------------------------------------------------


def _brute_top(rows, n):
    by = collections.defaultdict(dict)
    for g, item, s, i in rows:
        if None in (g, item, s, i) or math.isnan(s):
            continue
        by[g][item] = min(by[g].get(item, (math.inf, 0)), (s, i))
    return {(g, i) for g, items in by.items() for s, item, i in sorted((s, item, i) for item, (s, i) in items.items())[:n]}


def test_top_n_equals_brute_force_with_ties_and_a_hot_group(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), f"i{rng.integers(3000)}", float(rng.integers(200)) / 10, i) for i, g in enumerate(np.where(rng.random(9000) < 0.5, 1, rng.integers(0, 60, 9000)))]
    rows += rows[:50] + [(None, "a", 1.0, -1), (2, None, 0.0, -2), (2, "b", None, -3), (2, "b", float("nan"), -4)]
    df = spark.createDataFrame(rows, "grp long, item string, v double, row_id long").withColumns({"g": F.lit("clash"), "score": F.lit("clash"), "rank": F.lit("clash")})
    got = topn.top_n(df, ["grp"], "item", F.col("v"), "row_id", 5, rows_each=100)
    assert {(r["g"], r["row_id"]) for r in got.collect()} == _brute_top(rows, 5)
    assert topn.top_n(df.limit(0), ["grp"], "item", F.col("v"), "row_id", 5).count() == 0
    two = topn.top_n(df, ["grp", "g"], "item", F.col("v"), "row_id", 1)
    assert two.count() == len({r[0] for r in rows if r[0] is not None})
    with pytest.raises(ValueError):
        topn.top_n(df, ["grp"], "item", F.col("v"), "row_id", 0)


def test_row_groups_are_skipped_across_files(spark):
    """One hot group in several files, many repeats of the best items, small groups between: nothing is lost."""
    hot = spark.range(40000).selectExpr("500 as grp", "cast(pmod(hash(id), 9000) as string) as item", "cast(pmod(hash(id), 9000) div 3 as double) as v", "id as row_id")
    same = spark.range(3000).selectExpr("501 as grp", "cast(id % 3 as string) as item", "1.0 as v", "100000 + id as row_id")
    small = spark.range(2000).selectExpr("id % 900 as grp", "cast(id as string) as item", "cast(id as double) as v", "200000 + id as row_id")
    df = hot.union(same).union(small)
    with temporary_conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": False}):  # several files
        got, parts = topn.top_n_and_reads(df, ["grp"], "item", F.col("v"), "row_id", 5, rows_each=500)
    rows = [tuple(r) for r in df.select("grp", "item", F.col("v").cast("double"), "row_id").collect()]
    assert {(r["g"], r["row_id"]) for r in got.collect()} == _brute_top(rows, 5)
    parts = parts.collect()
    assert sum(r["n_rows"] for r in parts) == 45000 and sum(not r["is_read"] for r in parts) > 60 and len({r["path"] for r in parts if r["g"] == 500}) > 1
    assert all(r["g"] == 500 for r in parts if not r["is_read"])  # group 501 has three items only, so its N-th score is unknown


# Problem 4 ------------------------------------------------------------------------------------------------


@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=40))
@settings(max_examples=8, deadline=None)
def test_sketch_error_bound_and_merging(spark, values):
    df = spark.createDataFrame([("k", i % 3, v) for i, v in enumerate(values)], "k string, day int, v double")
    merged = sketch.merge(sketch.sketch(df, ["k", "day"], "v", 0.02), ["k"])
    got = sketch.percentiles(merged, ["k"], {"p50": 0.5, "p99": 0.99}, 0.02).first()
    s = sorted(values)
    for name, p in (("p50", 0.5), ("p99", 0.99)):
        want = s[math.floor(p * (len(s) - 1))]
        assert abs(got[name] - want) <= 0.02 * abs(want) * (1 + 1e-9)
    assert got["n_values"] == len(values)


def test_sketch_edges(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 0.0), ("b", float("inf")), ("b", float("-inf")), (None, 2.0)], "k string, v double").withColumns({"bucket": F.lit(1), "sign": F.lit(1), "n": F.lit(1)})
    got = {r["k"]: r for r in sketch.percentiles(sketch.sketch(df, ["k"], "v"), ["k"], {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()}
    assert set(got) == {"b", None} and (got["b"]["lo"], got["b"]["mid"], got["b"]["hi"]) == (-math.inf, 0.0, math.inf) and abs(got[None]["hi"] - 2) <= 0.02
    assert sketch.sketch(df.limit(0), ["k"], "v").count() == 0
    assert {r["k"]: (r["lo"], r["mid"], r["hi"]) for r in sketch.exact_percentiles(df, sketch.sketch(df, ["k"], "v"), ["k"], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()} == {"b": (-math.inf, 0.0, math.inf), None: (2.0, 2.0, 2.0)}


def test_hot_keys_are_dealt_to_parts_and_tiny_values_keep_their_error(spark):
    rows = spark.range(20000).selectExpr("id as run", "if(id % 3 = 0, null, 'cold' || id % 500) as k", "(id + 1) * 1e-12 as v")
    placed = sketch.placed_once(rows.union(rows.limit(500)), ["k"], "run", hot_rows=500, look=4)
    assert placed.count() == 20000 and placed.where("k is null").select("__salt").distinct().count() > 5 and placed.where("k is not null and __salt > 0").count() == 0
    parts = sketch.sketch(placed, ["k", "__salt"], "v")
    near = {r["k"]: r["m"] for r in sketch.percentiles(parts, ["k"], {"m": 0.5}).collect()}
    exact = {r["k"]: r["m"] for r in sketch.exact_percentiles(placed, sketch.merge(parts, ["k"]), ["k"], "v", {"m": 0.5}).collect()}
    assert len(near) == 501 and exact[None] == pytest.approx(9999e-12 + 1e-12) and all(abs(near[k] - exact[k]) <= 0.01 * (1 + 1e-9) * exact[k] for k in near)
    with pytest.raises(ValueError):
        sketch.gamma(1.0)


# Problem 6 ------------------------------------------------------------------------------------------------


def test_words():
    assert text.words("<b>Éc</b>o​n­os ﬁn! 42ª, İstanbul") == ["econos", "fin", "42a", "istanbul"]
    assert text.words(f'one <span style="{"x" * 5000}">two</span> <!-- not <b>this --> three &CounterClockwiseContourIntegral; <!-- open') == ["one", "two", "three", "open"]
    assert text.words("<!--" * 50000 + " a") == ["a"]
    assert text.words(None) == [] and text.words("") == [] and text.words("a &amp; b &lt;") == ["a", "b"] and text.words("1 < 2 and 3 > 2") == ["1", "2", "and", "3", "2"]


@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40), st.integers(0, 30))
@settings(max_examples=80, deadline=None)
def test_winnowing_never_misses_a_span(left, right, seed):
    shared = [str(x) for x in np.random.default_rng(seed).integers(0, 10**6, 10)]
    a, b = [*map(str, left), *shared, *map(str, right)], [*map(str, right), *shared]
    kept = lambda t: set(leaks._hashes(t, 6, {})[leaks.winnow(leaks._hashes(t, 6, {}), 5)].tolist())
    assert kept(a) & kept(b)


def test_leaks_equal_brute_force(spark, sf):
    d, e = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "eval_items"))
    grams = collections.defaultdict(set)
    for i, *sides in zip(e.item_id, e.src_text, e.tgt_text):
        for s in sides:
            w = text.words(s)
            for j in range(len(w) - 9):
                grams[tuple(w[j : j + 10])].add(i)
    want = {(doc, i) for doc, t in zip(d.doc_id, d.text) for w in [text.words(t)] for j in range(len(w) - 9) for i in grams.get(tuple(w[j : j + 10]), ())}
    assert {tuple(r) for r in queries.QUERIES["p6_found"](spark, sf).collect()} == want
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    wide = leaks.leaks(docs, "doc_id", "text", items, "item_id", ["src_text", "tgt_text"], most_broadcast=0)
    assert {(r["doc_id"], r["item_id"]) for r in wide.collect()} == want


def test_leak_edges(spark):
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, f"x {ten} y"), (2, ten.rsplit(" ", 1)[0]), (3, None), (4, ""), (5, "ten " + ten.replace("ten", "") + "one"), (6, ("word " * 20000) + ten.upper().replace(" ", "\n, ")), (1, f"x {ten} y")]
    items = spark.createDataFrame([(7, ten, None), (8, "", "other")], "item long, s string, t string").withColumns({"id": F.lit(1), "hash": F.lit(1)})
    df = spark.createDataFrame(docs, "d long, body string").withColumns({"hash": F.lit("clash"), "side": F.lit("clash")})
    run = lambda x, y: {tuple(r) for r in leaks.leaks(x, "d", "body", y, "item", ["s", "t"]).collect()}
    assert run(df, items) == {(1, 7, "s"), (6, 7, "s")}
    assert run(df.limit(0), items) == set() and run(df, items.limit(0)) == set()
    with pytest.raises(ValueError):
        leaks.leaks(df, "d", "body", items, "item", ["s"], span=5)


# Problem 7 ------------------------------------------------------------------------------------------------


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("word " * 30000,)], "t string")
    assert [r["n_tokens"] for r in mixing.count_tokens(df, "t", queries.tokenizer_path()).collect()][:3] == [2, 0, 0]
    import base64

    import tiktoken

    folder = os.path.dirname(queries.tokenizer_path())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb"))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    s = "Ein Text, mit Zahlen 123 und Übergröße… <|endoftext|>\n\n  fin"
    assert mixing.count_tokens(spark.createDataFrame([(s,)], "t string"), "t", queries.tokenizer_path()).first()["n_tokens"] == len(other.encode_ordinary(s))


def _mix(spark, docs, targets, **options):
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, weight double").withColumns({"key": F.lit("clash"), "rank": F.lit("clash")})
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    drawn, report = mixing.draw(d, t, **options)
    return drawn.collect(), {r["source"]: r for r in report.collect()}


def test_mix_meets_shares_and_caps(spark):
    rng = np.random.default_rng(0)
    docs = [(i, ("Big", "big ", "BIG")[i % 3], int(n), None) for i, n in enumerate(rng.integers(5, 60, 3000))] + [(10_000 + i, "small", 30, 1.0) for i in range(40)] + [(20_000, "unlisted", 5, 1.0), (20_001, None, 5, 1.0), (20_002, "small", 0, 1.0)]
    targets = [("big", 0.9, 2), ("small", 0.1, 3), ("absent", 0.2, 1)]
    drawn, report = _mix(spark, docs + docs[:100], targets)
    total = sum(r["n_tokens"] * r["copies"] for r in drawn)
    assert report["small"]["tokens"] == 3600 and report["small"]["most_copies"] == 3
    assert abs(report["big"]["tokens"] / report["small"]["tokens"] - 9) < 0.02 and report["absent"]["tokens"] == 0
    assert sum(r["tokens"] for r in report.values()) == total and len({r["doc_id"] for r in drawn}) == len(drawn) and all(r["source"] in ("big", "small") for r in drawn)
    again, _ = _mix(spark, docs, targets, cells=8)
    assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in drawn}
    other, _ = _mix(spark, docs, targets, seed=1)
    assert {r["doc_id"] for r in other} != {r["doc_id"] for r in drawn}


def test_weights_shift_inclusion_and_empty_mixes(spark):
    docs = [(i, "s", 10, 4.0 if i % 2 else 1.0) for i in range(4000)]
    drawn, report = _mix(spark, docs, [("s", 1.0, 1)], total=8000)
    odd = sum(r["doc_id"] % 2 for r in drawn)
    assert abs(report["s"]["tokens"] - 8000) <= 10 and 0.72 < odd / len(drawn) < 0.88
    # 500 documents of weight 40 would pass 1: they are certain, and the rest of the quota goes to the others.
    docs = [(i, "s", 10, 40.0 if i < 500 else 1.0) for i in range(4000)]
    drawn, report = _mix(spark, docs, [("s", 1.0, 1)], total=22500)
    ids = {r["doc_id"] for r in drawn}
    assert set(range(500)) <= ids and abs(len(ids) - 2250) <= 1
    near = [(i, "s", 10, 4.0 if i < 1000 else 1.0) for i in range(2000)]
    listed = spark.createDataFrame(near, "doc_id long, key string, n_tokens long, weight double").withColumn("key", F.lit("s"))
    c = mixing._odds(listed, {"s": 15000.0}, {"s": {"weighted": 50000.0}})["s"]
    assert 1000 + 1000 * c == pytest.approx(1500)
    drawn, report = _mix(spark, [], [("s", 1.0, 1)])
    assert drawn == [] and report["s"]["tokens"] == 0
    assert _mix(spark, docs, [])[0] == []


# Problem 8 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def matcher():
    return offence.Matcher()


@pytest.mark.parametrize("t", [
    "Shut up, you asshole.", "shut up you 4$$h0l3", "You f.u.c.k.i.n.g loser", "you f u c k i n g loser", "FUUUUCK off", "You fucki​ng loser", "a**hole like you", "f**k off", "Du Arschloooch!", "fils de p*te", "Vete a la m13rda, cabrón", "stronzо", "ＦＵＣＫ you",
    "<b>fuck</b> you", "I will break your legs", "The Druskers are not people, they are animals.", "Die Vorlani sind keine Menschen, sondern Tiere", "spread her legs", "quiero follarte", "je vais te casser les dents", "va te faire foutre",
])
def test_offensive(matcher, t):
    assert sum(matcher.hits(t)[0].values()) >= 1, matcher.folded(t)


@pytest.mark.parametrize("t", [
    "Our bitch had six puppies in the kennel last night.", "Ms Dickens from Scunthorpe assessed the class analysis.", "The cock crowed when the pilot entered the cockpit.", "Breast cancer screening is free at the sexual health clinic.", "You have to kill the hanging process before the restart.",
    "The manual is meant to be idiot-proof.", "Die Muschel lag am Strand.", "La chatte dort près du poêle.", "The judge said that calling Vorlani vermin is hate speech and fined the paper.", "La zorra cuidaba a sus crías en el bosque.", "The star is visible to the naked eye.", "1234 5 6 7 a b c", "", None, "a b c d e f g",
])
def test_harmless(matcher, t):
    assert sum(matcher.hits(t)[0].values()) < 1


def test_score_edges(spark):
    df = spark.createDataFrame([(1, "fuck you"), (2, None), (3, ""), (4, "fine " * 50000 + "fuck you"), (1, "fuck you")], "doc_id long, body string").withColumn("text", F.lit("clash"))
    got = {r["doc_id"]: r for r in offence.score(df, "body").collect()}
    assert [got[i]["offensive"] for i in (1, 2, 3, 4)] == [True, False, False, False] and got[1]["score"] > got[4]["score"] > 0 and got[2]["n_words"] == 0
    assert got[4]["score"] == round(offence.strength(got[4]["evidence"], got[4]["n_words"]), 6)
    assert offence.score(df.limit(0), "body").count() == 0
    with pytest.raises(ValueError):
        offence.score(df.withColumn("score", F.lit(1)), "body")


def _is_offensive(matcher, t):
    found, n = matcher.hits(t)
    return offence.strength(sum(found.values()), n) >= offence.OFFENSIVE


def test_precision_and_recall_on_sentences_that_took_no_part(matcher):
    hit = [_is_offensive(matcher, t) for t in sentences.lines(sentences.OFFENSIVE)]
    false = [_is_offensive(matcher, t) for t in sentences.lines(sentences.HARMLESS)]
    assert np.mean(hit) >= 0.9 and sum(hit) / (sum(hit) + sum(false)) >= 0.9


@pytest.mark.parametrize("t", sentences.lines(sentences.CHECKED) + sentences.lines(sentences.HARMLESS)[:8] + ["Tu es mon ami. Tu es gentil. Tu es libre.", "Le pauvre enfant avait un chien pauvre", "La guerra di Troia", "the prick of the needle", "horny toads"])
def test_everyday_sentences_are_harmless(matcher, t):
    assert not _is_offensive(matcher, t)


def test_longer_texts_need_more(matcher):
    few, many = "word " * 3000 + "you asshole", "word " * 3000 + "you asshole, fuck you, kill yourself, you stupid moron"
    assert not _is_offensive(matcher, few) and _is_offensive(matcher, many) and _is_offensive(matcher, "word " * 300 + "you asshole")


def test_agrees_with_the_raters(spark, sf):
    found = {r[0] for r in queries.QUERIES["p8_found"](spark, sf).collect()}
    v = spark.read.parquet(f"{sf}/doc_labels.parquet").toPandas()
    agree = [(d in found) == bool(o) for d, o in zip(v.doc_id, v.offensive)]
    assert np.mean(agree) > 0.9


def test_entries_are_folded():
    from costplan.llm.lexicon import entries, harmless

    for phrase in itertools.chain(entries(), harmless()):
        assert " ".join(text.words(text.fold_letters(phrase))) == phrase, phrase


