"""The pN_ queries of the problems tagged llm, with production parameters, and their SQL."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costplan.llm import leaks, mixing, offence, sketch, splits, topn
from costplan.session import table, written

ACCURACY = 0.01
SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "phase1_benchmark").select("row_id", "query_id", "plan_id", "strategy")
    rows = rows.withColumns({"entity": splits.canonical_query(F.col("query_id")), "link": splits.canonical_plan(F.col("plan_id"))})
    shares = {r["split_name"]: r["target_share"] for r in table(spark, sf_dir, "split_targets").where("split_name is not null").collect()}
    return splits.grouped_splits(rows, "entity", "link", "strategy", shares)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings and queries that share a split because their rows are tied."""
    named = _split_rows(spark, sf_dir).where(F.col("query_id").isNotNull()).select("query_id", "__component", "__split").distinct()
    one, two = (named.select(F.col("query_id").alias(f"query_id_{k}"), "__component", "__split") for k in (1, 2))
    return one.join(two, ["__component", "__split"]).where("query_id_1 < query_id_2").select("query_id_1", "query_id_2").distinct()


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its split."""
    return _split_rows(spark, sf_dir).select("row_id", "query_id", "plan_id", F.col("__component").alias("component"), F.col("__split").alias("split_name"))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of rows that each split reached, beside its target."""
    reached = _split_rows(spark, sf_dir).groupBy(F.col("__split").alias("split_name")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("__component").alias("n_components"))
    targets = table(spark, sf_dir, "split_targets").where("split_name is not null")
    total = reached.agg(F.sum("n_rows").alias("total"))
    return targets.join(reached, "split_name", "left").join(F.broadcast(total)).select("split_name", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_components", F.lit(0)).alias("n_components"), F.round(F.coalesce("n_rows", F.lit(0)) / F.col("total"), 6).alias("share"))


def p1_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that hold for any right split: rows, groups of tied queries, keys found in two splits, splits more than a row off target."""
    rows = written(_split_rows(spark, sf_dir).select("entity", "link", "__component", "__split"), "split")
    torn = lambda key: rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("__split").alias("a"), F.max("__split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")))
    targets = table(spark, sf_dir, "split_targets").where("split_name is not null")
    reached = rows.groupBy(F.col("__split").alias("split_name")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    off = targets.join(reached, "split_name", "left").join(total).agg(F.count_if(F.abs(F.coalesce("n", F.lit(0)) - F.col("target_share") * F.col("total")) > 1))
    found = {"rows": total, "components": rows.where(F.col("entity").isNotNull()).agg(F.countDistinct("__component")), "queries_in_two_splits": torn("entity"), "plans_in_two_splits": torn("link"), "splits_off_target": off}
    parts = [df.toDF("n").select(F.lit(name).alias("check_name"), "n") for name, df in found.items()]
    return reduce(DataFrame.union, parts)


def _best_plans(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, name)
    if name == "exhaustive_prescoring_q05_plan_medians":
        rows = rows.where(F.col("error").isNull() & F.col("result_equivalent") & (F.col("median_execution_s") > 0))
        return topn.top_n_and_reads(rows, ["batch_no"], "fingerprint", F.col("median_execution_s"), "row_id", 5)
    rows = rows.where(F.col("shared_median_latency_seconds") > 0)
    return topn.top_n_and_reads(rows, ["query_id", "mode"], "physical_fingerprint", F.col("shared_median_latency_seconds"), "row_id", 5)


P2_TABLES = ("exhaustive_prescoring_q05_plan_medians", "beam_scorer_multiscenario_candidates")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows kept of each batch, and of each query and mode."""
    kept = [_best_plans(spark, sf_dir, name)[0].select(F.lit(name).alias("table_name"), "row_id") for name in P2_TABLES]
    return kept[0].union(kept[1])


def p2_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with group, plan, median and rank."""
    kept = [_best_plans(spark, sf_dir, name)[0].select(F.lit(name).alias("table_name"), F.col("rank").cast("int").alias("rank"), F.col("item").alias("fingerprint"), F.col("score").alias("median_s"), "row_id") for name in P2_TABLES]
    return kept[0].union(kept[1])


def p2_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups of each clustered table, and how many of them and of their rows were skipped."""
    found = []
    for name in P2_TABLES:
        parts = _best_plans(spark, sf_dir, name)[1]
        found.append(parts.agg(F.count(F.lit(1)).alias("row_groups"), F.count_if(~F.col("is_read")).alias("skipped"), F.sum("n_rows").alias("n_rows"), F.sum(F.when(~F.col("is_read"), F.col("n_rows")).otherwise(0)).alias("rows_skipped")).select(F.lit(name).alias("table_name"), "*"))
    return found[0].union(found[1])


KEYS = ["query_id", "physical_fingerprint"]


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "beam_quality_runs")
    # Redelivered runs repeat entirely, so the distinct rows of the needed columns count each once.
    rows = runs.select("run_id", *KEYS, "latency_seconds", F.to_date("measured_at").alias("day"))
    return sketch.sketch(sketch.placed_once(rows, KEYS, "run_id"), [*KEYS, "__salt", "day"], "latency_seconds", ACCURACY)


def _signif(x: Column, digits: int = 10) -> Column:
    """x to so many significant digits, which hides the last bits that power functions differ in."""
    shift = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | (F.abs(x) == float("inf")), x).otherwise(F.round(x * shift) / shift)


def _signif_sql(x: str, digits: int = 10) -> str:
    shift = f"pow(10.0::DOUBLE, {digits - 1}.0::DOUBLE - floor(log10(abs({x}))))"
    return f"CASE WHEN {x} IS NULL OR {x} = 0 OR isinf({x}) THEN {x} ELSE round({x} * {shift}) / {shift} END"


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, p90, p95 and p99 within 1 % of each query and plan, from the days' sketches."""
    # Days are added up within the part that holds them; only a key's sketch crosses the network again.
    parts = sketch.merge(_daily(spark, sf_dir), [*KEYS, "__salt"])
    found = sketch.percentiles(parts, KEYS, SHARES, ACCURACY)
    return found.select(*KEYS, "n_values", *(_signif(F.col(k)).alias(k) for k in SHARES), F.lit(ACCURACY).alias("relative_error"))


def p4_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketches of single days that p4_percentiles adds up."""
    daily = sketch.merge(_daily(spark, sf_dir), [*KEYS, "day"])
    return daily.select(*KEYS, F.col("day").cast("string").alias("day"), "sign", "bucket", F.col("n").alias("n_values"))


def p4_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of each query and plan, and whether the sketch's lie within the stated error of all of them."""
    runs = table(spark, sf_dir, "beam_quality_runs")
    rows = written(sketch.placed_once(runs.select("run_id", *KEYS, "latency_seconds"), KEYS, "run_id"), "once")
    parts = sketch.sketch(rows, [*KEYS, "__salt"], "latency_seconds", ACCURACY)
    near = sketch.percentiles(parts, KEYS, SHARES, ACCURACY)
    exact = sketch.exact_percentiles(rows, written(sketch.merge(parts, KEYS), "sketch"), KEYS, "latency_seconds", SHARES, ACCURACY)
    both = near.alias("s").join(exact.alias("e"), [F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}")) for k in KEYS])
    within = lambda k: F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}")) | (F.abs(F.col(f"s.{k}") - F.col(f"e.{k}")) <= ACCURACY * (1 + 1e-9) * F.abs(F.col(f"e.{k}")))
    holds = within("p50") & within("p90") & within("p95") & within("p99")
    return both.select(*[F.col(f"e.{k}").alias(k) for k in KEYS], *[F.col(f"e.{k}").alias(k) for k in SHARES], holds.alias("holds"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks.leaks(docs, "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", ["src_text", "tgt_text"], span=10)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text holds ten successive words of a side of a test item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked test item: documents that hold a passage of either side, and of each side."""
    side = lambda s: F.countDistinct(F.when(F.col("side") == s, F.col("doc_id")))
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), side("src_text").alias("n_src"), side("tgt_text").alias("n_tgt"))


#: A file of the public tokenizers; its folder can be set with COSTPLAN_TOKENIZERS.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    return os.path.join(os.environ.get("COSTPLAN_TOKENIZERS", "/opt/tokenizers"), TOKENIZER)


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "align_score")
    # Only sources with a target are tokenized; better aligned segments are likelier to be drawn.
    targets = table(spark, sf_dir, "mix_targets")
    keys = targets.select(mixing.source_key(F.col("source")).alias("k")).distinct()
    wanted = docs.join(keys, mixing.source_key(F.col("source")) == F.col("k"), "left_semi")
    counted = mixing.count_tokens(wanted, "text", tokenizer_path())
    weight = F.when(F.col("align_score").between(0, 1), 0.5 + F.col("align_score")).otherwise(1.0)
    return mixing.draw(counted.select("doc_id", "source", "n_tokens", weight.alias("weight")), targets)


def p7_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with the number of times each is used."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each listed source."""
    return _mix(spark, sf_dir)[1]


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that hold for any right mix: listed sources, those more than a document off their quota, documents used too often, of no listed source, or twice in the list."""
    drawn, report = _mix(spark, sf_dir)
    targets = table(spark, sf_dir, "mix_targets")
    largest = drawn.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    off = report.join(largest, "source", "left").agg(F.count_if(F.abs(F.col("tokens") - F.col("quota")) > F.coalesce("largest", F.lit(0)) + 0.01))
    often = drawn.join(targets.select("source", "max_repeats"), "source", "left").agg(F.count_if(F.col("max_repeats").isNull() | (F.col("copies") > F.col("max_repeats"))))
    found = {"sources": report.agg(F.count(F.lit(1))), "off_quota": off, "used_too_often": often, "listed_twice": drawn.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1))}
    return reduce(DataFrame.union, [df.toDF("n").select(F.lit(name).alias("check_name"), "n") for name, df in found.items()])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offence.score(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual language."""
    return _scored(spark, sf_dir).where("offensive and doc_id is not null").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document and its parts."""
    return _scored(spark, sf_dir).drop("text", "source")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of offensive documents per source, spellings of a source taken together."""
    by = _scored(spark, sf_dir).groupBy(mixing.source_key(F.col("source")).alias("source"))
    return by.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("offensive").cast("long")).alias("n_offensive"), F.round(F.avg(F.col("offensive").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_shares, p1_checks, p2_found, p2_ranked, p2_skipping, p4_percentiles, p4_daily, p4_guarantee, p6_found, p6_items, p7_drawn, p7_shares, p7_checks, p8_found, p8_scores, p8_rates)}

_TIES = """
WITH RECURSIVE r AS (
  SELECT DISTINCT row_id, query_id,
    regexp_replace(upper(regexp_replace(query_id, '[^\\p{L}\\p{N}]', '', 'g')), '^(\\p{L}+)0+(\\d)', '\\1\\2') AS q,
    regexp_replace(regexp_replace(upper(regexp_replace(plan_id, '[^\\p{L}\\p{N}]', '', 'g')), '^(\\p{L}+)0+(\\d)', '\\1\\2'), '(\\d\\p{L})0+(\\d)', '\\1\\2') AS p
  FROM phase1_benchmark),
l AS (SELECT p, min(q) AS a, max(q) AS b FROM r WHERE q IS NOT NULL AND p IS NOT NULL GROUP BY p HAVING min(q) <> max(q)),
e AS (SELECT DISTINCT r.q AS u, l.a AS v FROM r JOIN l USING (p) WHERE r.q IS NOT NULL),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT DISTINCT q AS u, q AS v FROM r WHERE q IS NOT NULL UNION SELECT reach.u, s.v FROM reach JOIN s ON reach.v = s.u),
c AS (SELECT u AS q, min(v) AS comp FROM reach GROUP BY u),
n AS (SELECT DISTINCT query_id, comp FROM r JOIN c USING (q) WHERE query_id IS NOT NULL)
"""

_TOP = """
WITH u AS (
  SELECT 'exhaustive_prescoring_q05_plan_medians' AS table_name, CAST(batch_no AS VARCHAR) AS g1, '' AS g2, fingerprint, median_execution_s AS m, row_id
  FROM exhaustive_prescoring_q05_plan_medians
  WHERE error IS NULL AND result_equivalent AND median_execution_s > 0 AND NOT isnan(median_execution_s) AND batch_no IS NOT NULL AND fingerprint IS NOT NULL
  UNION
  SELECT 'beam_scorer_multiscenario_candidates', query_id, mode, physical_fingerprint, shared_median_latency_seconds, row_id
  FROM beam_scorer_multiscenario_candidates
  WHERE shared_median_latency_seconds > 0 AND NOT isnan(shared_median_latency_seconds) AND query_id IS NOT NULL AND mode IS NOT NULL AND physical_fingerprint IS NOT NULL),
once AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY table_name, g1, g2, fingerprint ORDER BY m, row_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name, g1, g2 ORDER BY m, fingerprint) AS rk FROM once)
"""

_SKETCH = """
WITH once AS (SELECT DISTINCT run_id, query_id, physical_fingerprint, latency_seconds AS x, CAST(measured_at AS DATE) AS day FROM beam_quality_runs),
d AS (
  SELECT query_id, physical_fingerprint, day, CAST(sign(x) AS INTEGER) AS sign,
    CASE WHEN x = 0 THEN 0 WHEN isinf(x) THEN 2147483647 ELSE CAST(ceil(ln(abs(x)) / ln(1.01::DOUBLE / 0.99::DOUBLE)) AS INTEGER) END AS bucket, count(*) AS n
  FROM once WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY ALL)
"""

#: Ten-word passages of both sides, by plain comparison; DuckDB folds accents, case, markup and invisible characters.
_PASSAGES = r"""
WITH t AS (SELECT item_id AS id, 'src_text' AS side, src_text AS x FROM eval_items UNION SELECT item_id, 'tgt_text', tgt_text FROM eval_items UNION SELECT doc_id, '', text FROM documents),
w AS (SELECT id, side, regexp_extract_all(regexp_replace(lower(strip_accents(regexp_replace(x, '</?[A-Za-z][^<>]*>', '', 'g'))), '[\p{Cf}\p{Mn}\p{Me}]+', '', 'g'), '[\p{L}\p{N}]+') AS w FROM t WHERE id IS NOT NULL AND x IS NOT NULL),
p AS (SELECT DISTINCT id, side, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT id, side, w, unnest(range(1, len(w) - 8)) AS i FROM w)),
hit AS (SELECT DISTINCT d.id AS doc_id, e.id AS item_id, e.side FROM p d JOIN p e USING (g) WHERE d.side = '' AND e.side <> '')
"""

ORACLE = {
    "p6_found": _PASSAGES + "SELECT DISTINCT doc_id, item_id FROM hit",
    "p6_items": _PASSAGES + "SELECT item_id, count(DISTINCT doc_id) AS n_docs, count(DISTINCT doc_id) FILTER (side = 'src_text') AS n_src, count(DISTINCT doc_id) FILTER (side = 'tgt_text') AS n_tgt FROM hit GROUP BY item_id",
    "p7_checks": "SELECT 'sources' AS check_name, count(*) AS n FROM mix_targets UNION ALL SELECT unnest(['off_quota', 'used_too_often', 'listed_twice']), 0",
    "p1_found": _TIES + "SELECT x.query_id AS query_id_1, y.query_id AS query_id_2 FROM n x JOIN n y USING (comp) WHERE x.query_id < y.query_id",
    "p1_checks": _TIES
    + """SELECT 'rows' AS check_name, count(*) AS n FROM (SELECT DISTINCT row_id, query_id, plan_id, strategy FROM phase1_benchmark)
UNION ALL SELECT 'components', count(DISTINCT comp) FROM c
UNION ALL SELECT unnest(['queries_in_two_splits', 'plans_in_two_splits', 'splits_off_target']), 0""",
    "p2_found": _TOP + "SELECT table_name, row_id FROM ranked WHERE rk <= 5",
    "p2_ranked": _TOP + "SELECT table_name, CAST(rk AS INTEGER) AS rank, fingerprint, m AS median_s, row_id FROM ranked WHERE rk <= 5",
    "p4_daily": _SKETCH + "SELECT query_id, physical_fingerprint, CAST(day AS VARCHAR) AS day, sign, bucket, n AS n_values FROM d",
    "p4_percentiles": _SKETCH
    + """, b AS (SELECT query_id, physical_fingerprint, sign, bucket, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY ALL),
v AS (SELECT *, CASE WHEN sign = 0 THEN 0.0::DOUBLE WHEN bucket = 2147483647 THEN sign * 'infinity'::DOUBLE ELSE sign * (2 / (1.01::DOUBLE / 0.99::DOUBLE + 1)) * pow(1.01::DOUBLE / 0.99::DOUBLE, bucket) END AS x FROM b),
c AS (SELECT *, sum(n) OVER (PARTITION BY query_id, physical_fingerprint ORDER BY x) AS upto, sum(n) OVER (PARTITION BY query_id, physical_fingerprint) AS total FROM v)
SELECT query_id, physical_fingerprint, n_values, """
    + ", ".join(f"{_signif_sql(k)} AS {k}" for k in SHARES)
    + """, 0.01::DOUBLE AS relative_error FROM (SELECT query_id, physical_fingerprint, CAST(max(total) AS BIGINT) AS n_values,
  """
    + ", ".join(f"min(x) FILTER (upto > floor({p}::DOUBLE * (total - 1))) AS {k}" for k, p in SHARES.items())
    + """
FROM c GROUP BY query_id, physical_fingerprint)""",
    "p4_guarantee": """WITH once AS (SELECT DISTINCT run_id, query_id, physical_fingerprint, latency_seconds AS x FROM beam_quality_runs WHERE latency_seconds IS NOT NULL AND NOT isnan(latency_seconds)),
r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY query_id, physical_fingerprint) AS n FROM once WINDOW w AS (PARTITION BY query_id, physical_fingerprint ORDER BY x))
SELECT query_id, physical_fingerprint, """
    + ", ".join(f"min(x) FILTER (i = floor({p}::DOUBLE * (n - 1))) AS {k}" for k, p in SHARES.items())
    + """, true AS holds FROM r GROUP BY query_id, physical_fingerprint""",
}
