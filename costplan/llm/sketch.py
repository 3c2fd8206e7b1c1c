"""Percentiles of very large numeric columns from mergeable logarithmic bucket counts.

A value x > 0 falls in bucket ceil(log_g x) with g = (1 + a) / (1 - a); negative values mirror
this with a sign, zero has a bucket of its own. The midpoint 2 g^i / (g + 1) of a bucket differs
from each of its values by at most the share a, so any percentile read from the counts is within
the relative error a of the value of that rank. Sketches are plain rows (keys, sign, bucket, n):
those of separate partitions or days are combined by adding the counts of equal buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costplan.session import written


def gamma(accuracy: float) -> float:
    """Ratio of neighbouring bucket limits for a relative error."""
    if not 0 < accuracy < 1:
        raise ValueError("accuracy must lie between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def _bucket(x: Column, accuracy: float) -> Column:
    return F.ceil(F.log(F.abs(x)) / F.lit(math.log(gamma(accuracy)))).cast("int")


def sketch(df: DataFrame, keys: Sequence[str], value: str, accuracy: float = 0.01) -> DataFrame:
    """Bucket counts (keys..., sign, bucket, n) of the values of each key.

    Nulls and NaN are no values and are left out; infinities count in a bucket beyond all
    others of their sign (Spark's largest int). Null keys form groups like any other key.
    Tied and repeated values simply add up; an empty table gives no rows. Other columns,
    whatever their names, are ignored. The count is combined on the map side, so a key that
    holds a third of all rows sends no more rows than it has buckets.
    """
    x = F.col(value).cast("double")
    kept = df.where(x.isNotNull() & ~F.isnan(x))
    buckets = kept.select(
        *keys,
        F.signum(x).cast("int").alias("sign"),
        F.when(x == 0, F.lit(0)).when(F.abs(x) == float("inf"), F.lit(2**31 - 1)).otherwise(_bucket(x, accuracy)).alias("bucket"),
    )
    return buckets.groupBy(*keys, "sign", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds up the counts of equal buckets: the sketch of the union of the inputs."""
    return sketches.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def placed_once(rows: DataFrame, keys: Sequence[str], row_id: str, hot_rows: int = 2_000_000, look: int = 64) -> DataFrame:
    """The distinct rows with __salt, on one exchange by (keys, __salt): keys' rows lie together, hot keys in several parts.

    Grouping by keys and __salt (and anything else) then needs no further exchange. A key that
    holds more than hot_rows rows, as judged by one row_id in `look`, is dealt to as many parts
    by a hash of row_id; the others have salt 0. The judgement only places rows, all are kept.
    """
    seen = rows.where(F.pmod(F.xxhash64(row_id, F.lit(7)), F.lit(look)) == 0).groupBy(*keys).agg((F.count(F.lit(1)) * look).alias("n"))
    hot = written(seen.where(F.col("n") > hot_rows).select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("n") / hot_rows).alias("__parts")), "hot")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    salt = F.coalesce(F.pmod(F.xxhash64(row_id), F.col("__parts")), F.lit(0)).cast("int")
    salted = rows.join(hot, same, "left").select(*rows.columns, salt.alias("__salt"))
    return salted.repartition(*keys, "__salt").distinct()


def percentiles(sketches: DataFrame, keys: Sequence[str], shares: dict[str, float], accuracy: float = 0.01) -> DataFrame:
    """One row per key: n values and, for each name in shares, the value of rank floor(p (n-1)).

    The sketches must have been made with the same accuracy; parts of a key (days, salts) are
    added up here. An infinite value is returned as infinity. A key's rows here are its buckets,
    a few thousand at most at an accuracy of 0.01, times its parts.
    """
    g = gamma(accuracy)
    order = F.col("sign") * F.when(F.col("sign") == 0, F.lit(0)).otherwise(F.col("bucket").cast("long") + F.lit(2**32))
    own = Window.partitionBy(*keys)
    up_to = own.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = merge(sketches.repartition(*keys) if keys else sketches, keys)
    counted = placed.withColumns({"__upto": F.sum("n").over(up_to), "__total": F.sum("n").over(own)})
    value = (
        F.when(F.col("sign") == 0, F.lit(0.0))
        .when(F.col("bucket") == 2**31 - 1, F.col("sign") * F.lit(float("inf")))
        .otherwise(F.col("sign") * F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.col("bucket")))
    )
    # The first bucket whose running count passes the rank.
    pick = {name: F.min(F.when(F.col("__upto") > F.floor(F.lit(p) * (F.col("__total") - 1)), value)).alias(name) for name, p in shares.items()}
    return counted.groupBy(*keys).agg(F.max("__total").alias("n_values"), *pick.values())


def exact_percentiles(df: DataFrame, sketches: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], accuracy: float = 0.01) -> DataFrame:
    """One row per key with the exact value of rank floor(p (n-1)) for each name in shares.

    The sketch of the same values names the one bucket that holds each rank, and only the values
    of those buckets are ordered, as counts of distinct values: no key is sorted whole.
    """
    order = F.col("sign") * F.when(F.col("sign") == 0, F.lit(0)).otherwise(F.col("bucket").cast("long") + F.lit(2**32))
    own = Window.partitionBy(*keys)
    spots = sketches.withColumns({"__upto": F.sum("n").over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)), "__total": F.sum("n").over(own)})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.lit(p) * (F.col("__total") - 1)).alias("rank")) for name, p in shares.items()])).alias("w")
    spots = spots.select(*keys, "sign", "bucket", "__upto", (F.col("__upto") - F.col("n")).alias("__before"), wanted).where("w.rank >= __before and w.rank < __upto")
    x = F.col(value).cast("double")
    kept = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("__x"))
    bucket = F.when(F.col("__x") == 0, F.lit(0)).when(F.abs("__x") == float("inf"), F.lit(2**31 - 1)).otherwise(_bucket(F.col("__x"), accuracy))
    counts = kept.groupBy(*keys, F.signum("__x").cast("int").alias("sign"), bucket.alias("bucket"), "__x").agg(F.count(F.lit(1)).alias("c"))
    names = [*keys, "sign", "bucket"]
    places = spots.select(*names, "__before").distinct()
    near = counts.alias("a").join(places.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in names]).select("a.*", "b.__before")
    inside = Window.partitionBy(*names).orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("__to", F.col("__before") + F.sum("c").over(inside))
    found = near.alias("a").join(spots.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in names]).where("b.w.rank < a.__to and b.w.rank >= a.__to - a.c")
    pick = [F.max(F.when(F.col("b.w.name") == name, F.col("a.__x"))).alias(name) for name in shares]
    return found.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(*pick)
