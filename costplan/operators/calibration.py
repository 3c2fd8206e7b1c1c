"""Calibration of predictions: linear models from sums, grouped folds, errors and learned models."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costplan.plans.plantext import VECTOR


def gram(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row of sums of products of (1, features) and the target: all that least squares needs."""
    terms = [F.lit(1.0), *(F.col(f) for f in features)]
    sums = [F.sum(terms[i] * terms[j]).alias(f"g_{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]
    sums += [F.sum(t * F.col(target)).alias(f"b_{i}") for i, t in enumerate(terms)]
    return df.dropna(subset=[*features, target]).groupBy().agg(*sums, F.count(F.lit(1)).alias("n"))


def solve(row, n_features: int, ridge: float = 0.0) -> np.ndarray:
    """Least-squares weights (intercept first, never penalised) of a gram row; minimum norm if rank deficient."""
    k = n_features + 1
    g, b = np.zeros((k, k)), np.array([row[f"b_{i}"] for i in range(k)], float)
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
    g[1:, 1:] += ridge * np.eye(k - 1)
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return np.linalg.lstsq(g / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale


def fit_cost_weights(df: DataFrame) -> tuple[float, float, float, float]:
    """w0..w3 of actual_cost on (1, cpu_cost, io_cost, shuffle_cost); needs four rows."""
    row = gram(df, ["cpu_cost", "io_cost", "shuffle_cost"], "actual_cost").first()
    if row["n"] < 4:
        raise ValueError("at least four rows are needed")
    return tuple(float(x) for x in solve(row, 3))


def fit_lines(df: DataFrame, keys: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """(keys, n, scale, bias) of actual on predicted.

    One row, or equal predictions: with one row the scale is actual / predicted and no bias, with
    equal predictions the scale stays 1 and the bias takes the mean error.
    """
    x, y = F.col(predicted), F.col(actual)
    by = df.dropna(subset=[predicted, actual]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("cut"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.max(x).alias("hi"), F.min(x).alias("lo"))
    single, flat = F.col("n") == 1, F.col("hi") == F.col("lo")
    scale = F.when(single & (F.col("mx") > 0), F.col("my") / F.col("mx")).when(flat, 1.0).otherwise(F.col("slope"))
    bias = F.when(single & (F.col("mx") > 0), 0.0).when(flat, F.col("my") - F.col("mx")).otherwise(F.col("cut"))
    return by.select(*keys, "n", scale.alias("scale"), bias.alias("bias"))


def apply_line(predicted: Column, scale: Column, bias: Column) -> Column:
    return F.greatest(F.lit(0.0), scale * predicted + bias)


def samples(predictions: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Predictions beside their measurements, joined on plan AND query.

    Cancelled runs (null actual_cost) are no samples. A plan measured under another query is an
    error: the result is only returned if there is none.
    """
    measured = telemetry.where(F.col("actual_cost").isNotNull())
    pairs = measured.select("plan_id", "query_id").distinct()
    wrong = pairs.join(predictions.select("plan_id", F.col("query_id").alias("q")).distinct(), "plan_id").groupBy("plan_id", "query_id").agg(F.max((F.col("q") == F.col("query_id")).cast("int")).alias("ok")).where("ok = 0")
    if not wrong.isEmpty():
        raise ValueError("telemetry names plans under other queries than the predictions")
    return predictions.join(measured, ["query_id", "plan_id"])


def validated(predictions: DataFrame, telemetry: DataFrame) -> DataFrame:
    """samples() with absolute and relative errors of cost and latency; relative ones are null where nothing was spent."""
    both = samples(predictions, telemetry)
    out = {}
    for m in ("cost", "latency"):
        d = F.abs(F.col(f"pred_{m}") - F.col(f"actual_{m}"))
        out |= {f"{m}_error": d, f"{m}_relative": F.try_divide(d, F.abs(F.col(f"actual_{m}")))}
    return both.withColumns(out)


def folds(df: DataFrame, k: int, seed: str = "") -> DataFrame:
    """df with fold 1..k; whole queries, dealt evenly in the order of an md5 of the query."""
    queries = df.select("query_id").distinct().withColumn("h", F.md5(F.concat(F.lit(seed), F.col("query_id").cast("string"))))
    from costplan.operators.ordered import numbered

    # Ranked in cells of the hash's first two digits, so not all queries meet in one task.
    placed = numbered(queries.withColumn("all", F.lit(1)), ["all"], ["h"], F.substring("h", 1, 2), "r")
    total = placed.groupBy("all").agg(F.max("r").alias("n"))
    big, size = F.col("n") % k, F.floor(F.col("n") / k)
    # The first n mod k folds are larger by one, as ntile deals.
    edge = big * (size + 1)
    fold = F.when(F.col("r") <= edge, F.floor((F.col("r") - 1) / (size + 1))).otherwise(big + F.floor((F.col("r") - 1 - edge) / F.greatest(size, F.lit(1)))) + 1
    return df.join(placed.join(total, "all").select("query_id", fold.cast("int").alias("fold")), "query_id")


def errors(df: DataFrame, keys: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """n, mae, rmse and mape (percent over actual <> 0; null if there are none) per group."""
    d = F.col(predicted) - F.col(actual)
    rel = F.when(F.col(actual) != 0, F.abs(d) / F.abs(F.col(actual)) * 100)
    return df.dropna(subset=[predicted, actual]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(rel).alias("mape"))


@dataclass(frozen=True)
class Holdout:
    """Errors of the raw and the calibrated prediction on queries kept out of the fit."""

    n_train: int
    n_test: int
    weights: tuple[float, ...]
    raw: dict[str, float]
    fitted: dict[str, float]


def holdout(df: DataFrame, test_share: float = 0.3, seed: str = "0") -> Holdout:
    """Fits cost weights on most queries and compares both predictions on the rest."""
    from costplan.operators.conformal import query_split
    from costplan.operators.cost import calibrated

    parts = query_split(df, (("test", test_share), ("train", 1 - test_share)), seed)
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    n = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(n.values()) < 8 or len(n) < 2:
        raise ValueError("at least eight rows of two queries are needed")
    w = fit_cost_weights(train)
    raw = errors(test.withColumn("p", F.col("cpu_cost") + F.col("io_cost") + F.col("shuffle_cost")), [], "p", "actual_cost").first().asDict()
    fitted = errors(calibrated(test, w).withColumnRenamed("pred_cost", "p"), [], "p", "actual_cost").first().asDict()
    return Holdout(n["train"], n["test"], w, raw, fitted)


def report(h: Holdout) -> str:
    """The comparison as a Markdown table."""
    line = lambda n, e: f"| {n} | {e['n']} | {e['mae']:.6g} | {e['rmse']:.6g} | {e['mape']:.2f} % |"
    return "\n".join(["| model | n | MAE | RMSE | MAPE |", "| --- | ---: | ---: | ---: | ---: |", line("raw", h.raw), line("calibrated", h.fitted), "", f"{h.n_train} rows fitted, {h.n_test} held out; weights {', '.join(f'{w:.6g}' for w in h.weights)}"])


def save_model(folder: str, name: str, model: dict) -> str:
    """Writes an immutable timestamped version and notes it in manifest.jsonl; returns its path."""
    os.makedirs(folder, exist_ok=True)
    version = time.strftime("%Y%m%dT%H%M%S") + f"_{time.time_ns() % 10**9:09d}"
    path = os.path.join(folder, f"{name}_{version}.json")
    with open(path, "x") as f:
        json.dump(model, f)
    with open(os.path.join(folder, "manifest.jsonl"), "a") as f:
        f.write(json.dumps({"name": name, "version": version, "path": os.path.basename(path)}) + "\n")
    return path


def load_model(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


# Learned models ------------------------------------------------------------------------------


@dataclass(frozen=True)
class LogRidge:
    """Ridge regression of ln target on standardised ln(1 + feature)."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        z = [(F.log1p(F.greatest(F.col(f), F.lit(0))) - F.lit(m)) / F.lit(s) for f, m, s in zip(self.features, self.mean, self.scale)]
        return df.withColumn(name, F.exp(sum((F.lit(w) * x for w, x in zip(self.weights[1:], z)), F.lit(self.weights[0]))))

    def to_dict(self) -> dict:
        return asdict(self)


def fit_log_ridge(df: DataFrame, target: str, features: Sequence[str] = VECTOR, ridge: float = 1.0) -> LogRidge:
    """Two passes: means and deviations, then the Gram sums; only their k * k numbers reach the driver."""
    logs = df.where(F.col(target) > 0).select(F.log(target).alias("__y"), *[F.log1p(F.greatest(F.col(f), F.lit(0))).cast("double").alias(f) for f in features]).dropna()
    m = logs.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mean, scale = [m[f"m_{f}"] or 0.0 for f in features], [m[f"s_{f}"] or 1.0 for f in features]
    z = logs.select("__y", *[((F.col(f) - a) / b).alias(f) for f, a, b in zip(features, mean, scale)])
    w = solve(gram(z, features, "__y").first(), len(features), ridge)
    return LogRidge(tuple(features), tuple(mean), tuple(scale), tuple(float(x) for x in w))


def _assembled(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    logs = df.withColumns({f"__{f}": F.log1p(F.greatest(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))) for f in features})
    return VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol=out).transform(logs).drop(*[f"__{f}" for f in features])


def fit_gbt(df: DataFrame, target: str, features: Sequence[str] = VECTOR, rounds: int = 50, depth: int = 4, step: float = 0.1, seed: int = 42):
    """Gradient-boosted trees of ln target; predict with predict_gbt."""
    from pyspark.ml.regression import GBTRegressor

    data = _assembled(df.where(F.col(target) > 0).withColumn("__y", F.log(target)), features)
    return GBTRegressor(labelCol="__y", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(data)


def predict_gbt(model, df: DataFrame, features: Sequence[str] = VECTOR, name: str = "prediction") -> DataFrame:
    return model.transform(_assembled(df, features)).withColumn(name, F.exp("prediction")).drop("features")


@dataclass(frozen=True)
class Ranking:
    """Linear scores on standardised ln(1 + feature) that order a query's plans, brought to the target's scale."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    factor: float
    intercept: float

    def score(self) -> Column:
        z = [(F.log1p(F.greatest(F.col(f), F.lit(0))) - F.lit(m)) / F.lit(s) for f, m, s in zip(self.features, self.mean, self.scale)]
        return sum((F.lit(w) * x for w, x in zip(self.weights, z)), F.lit(0.0))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, F.greatest(F.lit(0.001), self.score() * F.lit(self.factor) + F.lit(self.intercept)))

    def to_dict(self) -> dict:
        return asdict(self)


def query_pairs(df: DataFrame, target: str, columns: Sequence[str], all_pairs: int = 64) -> DataFrame:
    """(weight, columns): pairs of plans of one query with different targets, columns of the better less those of the worse.

    A query of up to all_pairs plans gives every pair. Of a larger one each plan is paired with
    those that follow it at distances 1, 2, 4, ... in the order of a hash, through the whole
    query: n log n pairs that connect all its plans. weight is the gap over the better target.
    """
    from costplan.operators.ordered import numbered

    h = df.where((F.col(target) > 0) & F.col("query_id").isNotNull()).select("query_id", F.col(target).alias("__y"), *columns).withColumn("__h", F.xxhash64("query_id", "__y", *columns))
    placed = numbered(h, ["query_id"], ["__h"], F.shiftright("__h", 52), "__r")
    sizes = placed.groupBy("query_id").agg(F.max("__r").alias("__n"))
    steps = F.when(F.col("__n") <= all_pairs, F.sequence(F.lit(1).cast("long"), F.col("__n"))).otherwise(F.transform(F.sequence(F.lit(0), F.floor(F.log2("__n")).cast("int")), lambda i: F.pow(F.lit(2.0), i).cast("long")))
    ahead = placed.join(sizes, "query_id").withColumn("__r", F.explode(F.transform(F.filter(steps, lambda d: d + F.col("__r") <= F.col("__n")), lambda d: d + F.col("__r"))))
    pairs = placed.alias("a").join(ahead.alias("b"), ["query_id", "__r"]).where("a.__y <> b.__y")
    sign = F.when(F.col("a.__y") < F.col("b.__y"), 1.0).otherwise(-1.0)
    gap = F.abs(F.col("a.__y") - F.col("b.__y")) / (F.least("a.__y", "b.__y") + 1e-6)
    return pairs.select(gap.alias("weight"), *[(sign * (F.col(f"a.{c}") - F.col(f"b.{c}"))).alias(c) for c in columns])


def fit_ranking(df: DataFrame, target: str, features: Sequence[str] = VECTOR, step: float = 0.01, rounds: int = 150, l2: float = 0.01, sigma: float = 1.0, momentum: float = 0.9, all_pairs: int = 64, most_pairs: int = 200_000) -> Ranking:
    """Pairwise logistic ranking: starts from the log-ridge weights, descends with momentum, is scaled to the target.

    The descent runs on the driver over at most about most_pairs pairs, a sample by hash where
    there are more; means, deviations and the final scale are those of all rows. Without any pair
    the log-ridge weights stay.
    """
    start = fit_log_ridge(df, target, features)
    names = [f"z{i}" for i in range(len(features))]
    logs = [((F.log1p(F.greatest(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))) - F.lit(m)) / F.lit(s)).alias(n) for n, f, m, s in zip(names, features, start.mean, start.scale)]
    base = df.where(F.col(target) > 0).select("query_id", F.col(target), *logs)
    sizes = base.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = sizes.agg(F.sum(F.when(F.col("n") <= all_pairs, F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.floor(F.log2("n") + 1)))).first()[0] or 0.0
    pairs = query_pairs(base, target, names, all_pairs)
    if total > most_pairs:
        pairs = pairs.where(F.pmod(F.xxhash64("weight", *names), F.lit(1_000_000)) < int(1e6 * most_pairs / total))
    found = pairs.toPandas()
    w = np.array(start.weights[1:], float)
    if len(found):
        gap, d = found["weight"].to_numpy(float), found[names].to_numpy(float)
        velocity = np.zeros_like(w)
        for _ in range(rounds):
            # d holds better less worse: its score should be negative.
            push = gap * sigma / (1 + np.exp(np.clip(-sigma * (d @ w), -500, 500)))
            velocity = momentum * velocity + step * ((push @ d) + l2 * w) / len(d)
            w = w - velocity
    model = Ranking(tuple(features), start.mean, start.scale, tuple(float(x) for x in w), 1.0, 0.0)
    m = df.where(F.col(target) > 0).withColumn("__s", model.score()).agg(F.avg(target).alias("y"), F.stddev_pop(target).alias("ys"), F.avg("__s").alias("s"), F.stddev_pop("__s").alias("ss")).first()
    factor = m["ys"] / m["ss"] if m["ss"] and m["ss"] > 1e-6 else 1.0
    return replace(model, factor=float(factor), intercept=float((m["y"] or 0.0) - factor * (m["s"] or 0.0)))
