"""Mixing sources to target weights by Pareto order sampling.

Each source gets a quota of tokens, its target share of the total. Whole copies are certain:
a source whose quota is a times its tokens gives floor(a) copies of every document. The rest of
the quota is drawn without replacement: document i has an inclusion probability p_i, and with a
uniform random u_i its rank is the odds of u_i over the odds of p_i; documents are taken in that
order (Pareto sampling, a fixed-size design) until the quota of tokens is met. The p_i are in
proportion to the weights, those that would pass 1 are certain, and sum p_i n_i is the rest.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costplan.session import written


def source_key(c: Column) -> Column:
    """One key for all spellings of a source: case, blanks, hyphens and underscores don't matter."""
    return F.regexp_replace(F.trim(F.lower(c)), r"[\s_\-]+", "_")


def count_tokens(df: DataFrame, text: str, file: str, name: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of a tokenizers file; 0 for null and empty texts.

    The tokenizer is loaded once per Python worker from the path given; texts are encoded whole,
    a few at a time, as an encoding takes many times the memory of its text.
    """

    @F.pandas_udf("long")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(file)
        t.encode_special_tokens = True
        for s in parts:
            n = []
            for k in range(0, len(s), 128):
                n += [len(e) for e in t.encode_batch_fast([x if isinstance(x, str) else "" for x in s.iloc[k : k + 128]], add_special_tokens=False)]
            yield pd.Series(n, dtype="int64")

    return df.withColumn(name, tokens(F.col(text)))


def _odds(listed: DataFrame, rest: dict[str, float], sums: dict[str, dict]) -> dict[str, float]:
    """c of each source with sum min(1, c w_i) n_i = rest over its documents.

    Documents with c w_i >= 1 are certain; taking them out raises c for the others, so this is
    repeated until no more become certain. Each round is one aggregate of a row per source.
    """
    c = {k: r / sums[k]["weighted"] for k, r in rest.items() if r > 0}
    sure: dict[str, int] = dict.fromkeys(c, 0)
    while c:
        limit = F.create_map(*[F.lit(x) for k, v in c.items() for x in (k, v)])[F.col("key")]
        certain = limit * F.col("weight") >= 1
        found = listed.where(limit.isNotNull()).groupBy("key").agg(F.count_if(certain).alias("n"), F.sum(F.when(certain, F.col("n_tokens"))).alias("tokens"), F.sum(F.when(~certain, F.col("n_tokens") * F.col("weight"))).alias("weighted")).collect()
        moved = [r for r in found if r["n"] > sure[r["key"]]]
        for r in moved:
            sure[r["key"]] = r["n"]
            if r["weighted"]:
                # Never lower, so that what is certain stays so whatever the rounding.
                c[r["key"]] = max(c[r["key"]], (rest[r["key"]] - r["tokens"]) / r["weighted"])
        if not moved:
            return c
    return c


def draw(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, cells: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(drawn, report). docs: doc_id, source, n_tokens, weight; targets: source, target_share, max_repeats.

    drawn has (doc_id, source, n_tokens, copies) of the documents used, copies >= 1; report has a
    row per target with the share reached. Without total the mix is as large as the scarcest
    source allows. Sources are matched by source_key; those without a target give nothing; a
    target without text gets nothing, is reported, and doesn't bound the total. Weights (null or
    not above zero counts as 1) set the odds within a source. Rows of the same doc_id count once.

    Ranks are summed in cells of equal width, then row by row only within the one cell of each
    source where the quota ends, so no task sees a whole source.
    """
    spark = docs.sparkSession
    goal = targets.select(source_key(F.col("source")).alias("key"), F.col("source").alias("named"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("most")).where("key is not null and share > 0")
    goals = {r["key"]: r for r in goal.collect()}  # one row per listed source
    known = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    listed = docs.select("doc_id", source_key(F.col("source")).alias("key"), "n_tokens", F.when((known > 0) & (known < float("inf")), known).otherwise(1.0).alias("weight"))
    listed = listed.where(F.col("key").isin(list(goals)) & (F.col("n_tokens") > 0) & F.col("doc_id").isNotNull())
    listed = written(listed.groupBy("doc_id").agg(F.min(F.struct("key", "n_tokens", "weight")).alias("d")).select("doc_id", "d.*"), "listed")
    sums = {r["key"]: r for r in listed.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.sum(F.col("n_tokens") * F.col("weight")).alias("weighted")).collect()}
    shares = sum(g["share"] for g in goals.values()) or 1.0
    limits = [sums[k]["tokens"] * max(g["most"] or 0, 0) * shares / g["share"] for k, g in goals.items() if k in sums]
    size = min([*([total] if total is not None else []), *limits], default=0.0)
    plan = []
    for k, g in goals.items():
        have = sums[k]["tokens"] if k in sums else 0
        quota = min(size * g["share"] / shares, have * max(g["most"] or 0, 0)) if have else 0.0
        whole = int(quota // have) if have else 0
        rest = quota - whole * have if have else 0.0
        plan.append((k, g["named"], g["share"] / shares, g["most"], have, float(quota), whole, float(rest)))
    c = _odds(listed, {k: rest for k, *_, rest in plan if rest > 0}, sums)
    plan = [(*row, c.get(row[0], 0.0)) for row in plan]
    table = spark.createDataFrame(plan, "key string, named string, share double, most long, have long, quota double, whole long, rest double, c double")
    p = F.greatest(F.col("c") * F.col("weight"), F.lit(1e-12))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / F.lit(2.0**53)
    # Documents of probability 1 come first.
    rank = F.when(p >= 1, 0.0).otherwise((u / (1 - u)) / (p / (1 - p)))
    ranked = listed.join(table, "key").withColumn("rank", rank)
    # rank / (1 + rank) lies in (0, 1) in the same order; a cell is a range of it.
    ranked = ranked.withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * cells).cast("int"))
    by_cell = ranked.groupBy("key", "cell").agg(F.sum("n_tokens").alias("t"))
    own = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At most `cells` rows per listed source; its written size tells Spark whether to broadcast it.
    upto = written(by_cell.withColumn("upto", F.sum("t").over(own)).select("key", "cell", (F.col("upto") - F.col("t")).alias("before"), "upto"), "cells")
    placed = ranked.join(upto, ["key", "cell"])
    inside = placed.where((F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest")))
    running = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("key").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The document at the quota's end is taken if that comes nearer to the quota.
    edge = inside.withColumn("one", (running - F.col("n_tokens") / 2 <= F.col("rest")).cast("long"))
    outside = placed.where(~((F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest")))).withColumn("one", (F.col("upto") <= F.col("rest")).cast("long"))
    copies = F.least(F.col("whole") + F.col("one"), F.col("most"))
    drawn = edge.unionByName(outside).select("doc_id", F.col("named").alias("source"), "n_tokens", copies.alias("copies")).where("copies > 0")
    drawn = written(drawn, "drawn")
    used = drawn.groupBy(F.col("source").alias("named")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    everything = used.agg(F.sum("tokens").alias("all_tokens"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = table.join(used, "named", "left").join(F.broadcast(everything)).select(
        F.col("named").alias("source"), F.col("share").alias("target_share"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), none("tokens"), none("n_docs"), none("most_copies"), F.col("have").alias("tokens_available"), F.round("quota", 3).alias("quota")
    )
    return drawn, report
