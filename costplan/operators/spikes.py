"""Implausible readings of a source relative to its normal behaviour.

Readings are looked at in order of time within a source. Three rules flag them:

* impossible: not finite or not above zero;
* stuck: part of a run of `stuck` or more successive identical readings;
* spike: an excursion of at most three successive readings whose residual from the local
  (seasonal) level on both sides lies beyond the source's tail cutoff.

The cutoff is found by peaks over threshold: a generalised Pareto distribution is fitted to the
excesses of the absolute seasonal residuals over their 90th percentile and gives the value passed
with a fixed risk. A seasonal residual is the residual less its median at that hour of the day, on
working days or weekends, for sources with enough readings to tell. An exact check follows: a spike differs from the readings around it at least `fold`
times and by at least `scatters` times the source's usual relative scatter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costplan.session import written

SIDE = 7  # readings on either side that give the local level
LONGEST = 3  # readings of an excursion at most
HALO = 3 * SIDE  # readings a chunk borrows from its neighbours


def _medians(values: np.ndarray, group: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Median of values[first : first + width] within the reading's own group; NaN if none is left."""
    n = len(values)
    at = first[:, None] + np.arange(width)
    inside = (at >= 0) & (at < n)
    at = np.clip(at, 0, max(n - 1, 0))
    window = np.where(inside & (group[at] == group[:, None]), values[at], np.nan)
    window.sort(axis=1)  # NaN goes last
    m = (~np.isnan(window)).sum(axis=1)
    rows = np.arange(n)
    low, high = window[rows, np.maximum(m - 1, 0) // 2], window[rows, np.minimum(m // 2, width - 1)]
    return np.where(m > 0, (low + high) / 2, np.nan)


def judge(group: np.ndarray, x: np.ndarray, stuck: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(impossible, stuck, residual, excursion) of readings sorted by time within each group.

    residual is that of ln x from the median of its 2 * SIDE neighbours (NaN where a reading is
    impossible or stuck); excursion is the signed distance, in ln, by which the most distinct
    excursion of up to three readings around the reading stands off from both sides, else 0.
    """
    n = len(x)
    impossible = ~(np.isfinite(x) & (x > 0))
    change = np.ones(n, bool)
    change[1:] = (group[1:] != group[:-1]) | (x[1:] != x[:-1])
    run = np.cumsum(change) - 1
    held = np.bincount(run, minlength=1)[run] >= stuck if n else np.zeros(0, bool)
    residual, excursion = np.full(n, np.nan), np.zeros(n)
    ok = np.flatnonzero(~impossible)
    if not len(ok):
        return impossible, held, residual, excursion
    v, g = np.log(x[ok]), group[ok]
    at = np.arange(len(ok))
    before, after = _medians(v, g, at - SIDE, SIDE), _medians(v, g, at + 1, SIDE)
    around = np.where(np.isnan(before), after, np.where(np.isnan(after), before, (before + after) / 2))
    residual[ok] = np.where(held[ok], np.nan, v - around)
    best = np.zeros(len(v))
    for m in range(1, min(LONGEST, len(v)) + 1):
        start, end = at[: len(v) - m + 1], at[m - 1 :]
        left, right = before[start], after[end]
        same = g[start] == g[end]
        segment = np.lib.stride_tricks.sliding_window_view(v, m)
        for sign in (1, -1):
            lowest = (sign * segment).min(axis=1)
            off_left, off_right = lowest - sign * left, lowest - sign * right
            # A side without readings (the ends of a series) can't speak against an excursion.
            off = np.fmin(off_left, off_right)
            # The readings next to it must be back at least half way, or it is longer than m.
            prev, nxt = np.maximum(start - 1, 0), np.minimum(end + 1, len(v) - 1)
            level = np.fmax(sign * left, sign * right)
            back = lambda i, there: ~there | (sign * v[i] - level < off / 2)  # noqa: B023, E731
            fine = same & (off > 0) & back(prev, (start > 0) & (g[prev] == g[start])) & back(nxt, (end < len(v) - 1) & (g[nxt] == g[end]))
            for shift in range(m):
                who = start[fine] + shift
                better = off[fine] > np.abs(best[who])
                best[who[better]] = sign * off[fine][better]
    excursion[ok] = best
    return impossible, held, residual, excursion


def _chunks(df: DataFrame, target: int, cell_s: int) -> DataFrame:
    """(source, cell, chunk, core) for sources of more than target readings.

    A chunk is a range of whole time cells with about target readings; the cells at its rim are
    lent (core false) to the neighbour, enough of them to hold HALO readings.
    """
    cells = df.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("source")
    upto = own.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hot = cells.withColumns({"all": F.sum("n").over(own), "upto": F.sum("n").over(upto)}).where(F.col("all") > target)
    # The chunk is that of a cell's first reading; the last part joins its predecessor if small.
    last = F.greatest(F.floor(F.col("all") / target) - 1, F.lit(0))
    hot = hot.withColumn("chunk", F.least(F.floor((F.col("upto") - F.col("n")) / target), last))
    part = Window.partitionBy("source", "chunk")
    hot = hot.withColumns({"from": F.min(F.col("upto") - F.col("n")).over(part), "to": F.max("upto").over(part), "least": F.min("chunk").over(own), "most": F.max("chunk").over(own)})
    spots = F.array(
        F.struct(F.col("chunk"), F.lit(True).alias("core")),
        F.when((F.col("to") - F.col("upto") < HALO) & (F.col("chunk") < F.col("most")), F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(False).alias("core"))),
        F.when((F.col("upto") - F.col("n") - F.col("from") < HALO) & (F.col("chunk") > F.col("least")), F.struct((F.col("chunk") - 1).alias("chunk"), F.lit(False).alias("core"))),
    )
    return hot.select("source", "cell", F.explode(F.array_compact(spots)).alias("s")).select("source", "cell", "s.chunk", "s.core")


def _judged(stuck: int):
    """Works through batches sorted by source, chunk and time; a group cut by a batch's end waits for the next."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part])
            if rest.num_rows < 20_000:
                continue
            ids = _ids(rest)
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut:
                yield done(rest.slice(0, cut), ids[:cut])
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield done(rest, _ids(rest))

    def _ids(t: pa.Table) -> np.ndarray:
        source = t["source"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        chunk = t["chunk"].to_numpy()
        return np.cumsum(np.r_[False, (source[1:] != source[:-1]) | (chunk[1:] != chunk[:-1])])

    def done(t: pa.Table, ids: np.ndarray) -> pa.RecordBatch:
        row = t["row_id"].to_numpy()
        again = np.r_[False, (row[1:] == row[:-1]) & (ids[1:] == ids[:-1])]  # redelivered: same time, same id
        keep = np.flatnonzero(~again)
        ids, x = ids[keep], t["x"].to_numpy()[keep]
        impossible, held, residual, excursion = judge(ids, x, stuck)
        core = np.flatnonzero(t["core"].to_numpy(zero_copy_only=False)[keep])
        out = t.take(pa.array(keep[core])).select(["row_id", "source", "season"])
        for name, v in (("impossible", impossible), ("stuck", held), ("residual", residual), ("excursion", excursion)):
            out = out.append_column(name, pa.array(v[core]))
        return out.combine_chunks().to_batches()[0] if out.num_rows else pa.RecordBatch.from_pylist([], schema=out.schema)

    return work


def judged_readings(df: DataFrame, source: str, time: str, value: str, row_id: str, stuck: int = 6, target: int = 50_000, cell_s: int = 600) -> DataFrame:
    """(row_id, source, season, impossible, stuck, residual, excursion) for every reading of df.

    A reading has a source and a value; rows without either are no readings. Rows of the same
    row_id and time count once; ties in time are ordered by row_id, a null time comes first. A
    source of more than target readings is cut into chunks of whole time cells that borrow
    readings from their neighbours, so no task holds a whole hot source. season is the hour of
    the day, plus 24 at weekends; -1 without a time.
    """
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    season = F.coalesce(F.hour(time) + F.when(F.dayofweek(time).isin(1, 7), 24).otherwise(0), F.lit(-1)).cast("byte")
    # Readings without a time come before all others, in the order of their ids.
    untimed = F.floor(F.col(row_id).cast("long") / 4096) - F.lit(2**60)
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(source).cast("string").alias("source"), F.col(time).alias("t"), F.col(value).cast("double").alias("x"), season.alias("season"), F.coalesce(F.floor(seconds / cell_s), untimed).alias("cell"))
    rows = rows.where(F.col("source").isNotNull() & F.col("x").isNotNull())
    spots = _chunks(rows, target, cell_s)
    spread = rows.join(spots, ["source", "cell"], "left").withColumns({"chunk": F.coalesce("chunk", F.lit(0)).cast("long"), "core": F.coalesce("core", F.lit(True))})
    placed = spread.select("source", "chunk", "t", "row_id", "season", "x", "core").repartition("source", "chunk").sortWithinPartitions("source", "chunk", "t", "row_id")
    return placed.drop("t").mapInArrow(_judged(stuck), "row_id long, source string, season byte, impossible boolean, stuck boolean, residual double, excursion double")


def seasonal(judged: DataFrame, tame: float, least: int = 1000, least_each: int = 20, bins_per_ln: int = 400) -> DataFrame:
    """judged with seasonal_residual and seasonal_excursion: less the median residual of the source's season.

    Sources of fewer than `least` residuals, and seasons of fewer than least_each, have a level of
    0. Residuals beyond `tame` don't count for the level. Medians come from counts of bins.
    """
    known = judged.where(~F.isnan("residual"))
    large = written(known.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("source"), "large")
    bins = known.where(F.abs("residual") < tame).join(large, "source").groupBy("source", "season", F.floor(F.col("residual") * bins_per_ln).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("source", "season")
    at = bins.withColumns({"upto": F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "all": F.sum("n").over(own)})
    level = F.min(F.when(F.col("upto") * 2 >= F.col("all"), (F.col("bin") + 0.5) / bins_per_ln))
    levels = written(at.where(F.col("all") >= least_each).groupBy("source", "season").agg(level.alias("level")), "seasons")
    level = F.coalesce("level", F.lit(0.0))
    shifted = {"seasonal_residual": F.col("residual") - level, "seasonal_excursion": F.when(F.col("excursion") != 0, F.col("excursion") - level).otherwise(0.0)}
    return judged.join(levels, ["source", "season"], "left").withColumns(shifted).drop("level", "season")


def tail_cutoffs(judged: DataFrame, fold: float, scatters: float, risk: float, bins_per_ln: int = 400) -> DataFrame:
    """(source, n_residuals, scatter, pot_cutoff, rule_cutoff) from the absolute residuals.

    Residuals are counted in bins of 1/400 in ln, so quantiles are mergeable counts, a hot
    source is combined on the map side and a source has a few thousand bins at most. The scatter,
    and with it rule_cutoff, is that of the plain residuals; the tail is fitted to the seasonal
    ones, if judged has them. Residuals beyond the rule's cutoff (the spikes themselves) don't
    take part in the fit.
    """
    width = 1.0 / bins_per_ln
    adjusted = "seasonal_residual" if "seasonal_residual" in judged.columns else "residual"
    bin_of = lambda c: F.least(F.floor(F.abs(c) / width), F.lit(20 * bins_per_ln))
    bins = judged.where(~F.isnan("residual")).groupBy("source", bin_of("residual").alias("bin"), bin_of(adjusted).alias("sbin")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("source")
    upto = F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = written(bins.withColumns({"upto": upto, "all": F.sum("n").over(own), "mid": (F.col("bin") + 0.5) * width}), "bins")

    def quantile(q: float) -> Column:
        """Within the bin that holds the rank, by linear interpolation."""
        rank = F.lit(q) * F.col("all")
        inside = (F.col("bin") + (rank - (F.col("upto") - F.col("n"))) / F.col("n")) * width
        return F.min(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank), inside))

    # The neighbours' median is itself uncertain: the residual's variance is larger by (pi / 2) / (2 * SIDE).
    usual = 1.4826 / math.sqrt(1 + math.pi / 2 / (2 * SIDE))
    quant = at.groupBy("source").agg(F.max("all").alias("n_residuals"), (quantile(0.5) * usual).alias("scatter"))
    quant = written(quant.withColumn("rule_cutoff", F.greatest(F.lit(math.log(fold)), scatters * F.col("scatter"))), "quantiles")
    # The threshold too is that of the usual residuals, else a source with many spikes hides them.
    usual_ones = at.join(quant.select("source", "rule_cutoff"), "source").where(F.col("mid") < F.col("rule_cutoff"))
    usual_ones = usual_ones.groupBy("source", F.col("sbin").alias("bin")).agg(F.sum("n").alias("n"))
    tame = written(usual_ones.withColumns({"upto": upto, "all": F.sum("n").over(own), "mid": (F.col("bin") + 0.5) * width}), "tame")
    quant = quant.join(tame.groupBy("source").agg(F.max("all").alias("n_tame"), quantile(0.9).alias("u")), "source", "left")
    y = F.col("mid") - F.col("u")
    beyond = tame.join(quant.select("source", "u"), "source").where(y > 0)
    fit = beyond.groupBy("source").agg(F.sum("n").alias("k"), (F.sum(y * F.col("n")) / F.sum("n")).alias("m"), (F.sum(y * y * F.col("n")) / F.sum("n")).alias("m2"))
    ratio = F.col("m") * F.col("m") / F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(1e-12))
    xi = F.greatest(0.5 * (1 - ratio), F.lit(-0.5))
    sigma = F.col("m") * (1 - xi)  # keeps the mean excess where xi is held at its bound
    odds = F.lit(risk) * F.col("n_tame") / F.col("k")
    pot = F.col("u") + F.when(F.abs(xi) < 1e-6, -sigma * F.log(odds)).otherwise(sigma / xi * (F.pow(odds, -xi) - 1))
    return quant.join(fit, "source", "left").select("source", "n_residuals", "scatter", F.greatest(F.coalesce(pot, "u"), F.col("u")).alias("pot_cutoff"), "rule_cutoff")


def implausible(df: DataFrame, source: str, time: str, value: str, row_id: str, fold: float = 1.6, scatters: float = 8.0, risk: float = 1e-4, stuck: int = 6, target: int = 50_000, slack: float = 0.8, fold_slack: float = 0.97) -> DataFrame:
    """(row_id, source, reason) of the readings that can't be true; reason is the first that applies.

    A spike must pass the tail cutoff fitted to the seasonal residuals at the given risk and, as
    an exact check, `fold` and `scatters` usual scatters, both with a slack for the uncertainty of the estimated level and scatter. A source with too few
    readings for a fit is held against the check alone. An empty table gives no rows; all other
    columns are ignored.
    """
    judged = written(judged_readings(df, source, time, value, row_id, stuck, target), "judged")
    judged = seasonal(judged, math.log(fold))
    floor = math.log(fold * fold_slack)
    named = judged.where(F.col("impossible") | F.col("stuck")).select("row_id", "source", F.when(F.col("impossible"), "impossible").otherwise("stuck").alias("reason"))
    cut = tail_cutoffs(judged, fold * fold_slack, scatters * slack, risk)
    far = judged.where(~F.col("impossible") & ~F.col("stuck") & (F.abs("excursion") >= floor))
    beyond = lambda x, c: F.abs(x) >= F.coalesce(c, F.lit(floor))
    candidates = far.join(cut, "source", "left").where(beyond("seasonal_excursion", "pot_cutoff"))
    spikes = candidates.where(beyond("excursion", "rule_cutoff"))
    return named.unionByName(spikes.select("row_id", "source", F.lit("spike").alias("reason")))
