"""Top N items within every group by statistics-guided skipping of Parquet row groups.

The rows are clustered once into files by (group, score): range partitioned, so that a group
with a third of all rows spreads over many files, and sorted, with row groups so small that a
large group fills several. The footers of all files are read in parallel, and row groups are
read in the order of their best score in two passes:

1. every row group that holds more than one group, and the best one of each group that fills row
   groups alone; their rows give each such group's N-th score, known to all files from then on;
2. of the other row groups those that aren't strictly worse than their group's N-th score.

As rows are sorted by group first, a row group that holds several groups holds the best row of
one of them at least, so it is never strictly worse than every contained group's N-th score:
only row groups of a single group can be skipped, and nothing else has to be known of a group.
What is read, at most N items of a group and row group, is merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costplan.session import new_path, written

#: Limits of a row group's rows, and the row groups that the group of an average row should fill.
LEAST_ROWS, MOST_ROWS, PER_GROUP = 512, 1 << 17, 16


def row_group_rows(rows: DataFrame, look: int = 64) -> int:
    """Rows of a row group, from the size of the group that an average row is in, as judged by one row in `look`."""
    seen = rows.where(F.pmod(F.xxhash64("row_id"), F.lit(look)) == 0).groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"))
    size = seen.agg(F.sum(F.col("n") * F.col("n") * look) / F.sum("n")).first()[0] or 0.0
    return int(min(max(size / PER_GROUP, LEAST_ROWS), MOST_ROWS))


def cluster(df: DataFrame, group: Sequence[str], item: str, score: Column, row_id: str, rows_each: int | None = None) -> str:
    """Writes (g, score, item, row_id), clustered and sorted, and returns the folder.

    g is the group's key: the column itself, or the JSON of several. Rows whose group, item,
    score or row_id is null, or whose score is NaN, can't be ranked and are left out. The best
    score is the lowest.
    """
    key = F.col(group[0]) if len(group) == 1 else F.to_json(F.struct(*group))
    rows = df.dropna(subset=[*group, item, row_id]).select(key.alias("g"), score.cast("double").alias("score"), F.col(item).alias("item"), F.col(row_id).alias("row_id"))
    rows = rows.where(F.col("score").isNotNull() & ~F.isnan("score"))
    order = ["g", "score", "item", "row_id"]
    path = new_path(df.sparkSession, "clustered")
    each = row_group_rows(rows) if rows_each is None else rows_each
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.row.count.limit", each).parquet(path)
    return path


def _open(path: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(inner))


def _plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Joined Arrow-backed strings come in chunks, which Spark doesn't take."""
    return rows.astype({c: object for c in rows.columns if not pd.api.types.is_numeric_dtype(rows[c])})


def footers(files: DataFrame, kind: str) -> DataFrame:
    """(path, k, n_rows, g, best) of every row group; g, of type kind, is null where it holds several groups."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                meta = _open(path).metadata
                columns = {meta.schema.column(j).name: j for j in range(meta.num_columns)}
                found = []
                for k in range(meta.num_row_groups):
                    part = meta.row_group(k)
                    g, s = (part.column(columns[c]).statistics for c in ("g", "score"))
                    single = g is not None and g.has_min_max and g.min == g.max and s is not None and s.has_min_max
                    found.append((path, k, part.num_rows, g.min if single else None, s.min if single else -np.inf))
                if found:
                    frame = pd.DataFrame(found, columns=["path", "k", "n_rows", "g", "best"])
                    yield frame.astype({"path": object, "g": "Int64" if kind == "bigint" else object})

    return files.mapInPandas(scan, f"path string, k int, n_rows long, g {kind}, best double")


def best_rows(path: str, spots: Sequence[tuple[int, float, float]], n: int, at_once: int = 200_000) -> Iterator[pd.DataFrame]:
    """The n best items of each group of each row group (k, best, limit) of a file, read from the best on.

    A row group that is strictly worse than the N-th score of its group so far (limit at first,
    NaN where unknown) is skipped.
    """
    file = _open(path)
    known: dict = {}
    some: list[int] = []
    for k, best, limit in [*sorted(spots, key=lambda s: s[1:2]), (-1, 0.0, 0.0)]:
        single = best > -np.inf
        if some and (k < 0 or single or sum(file.metadata.row_group(i).num_rows for i in some) > at_once):
            yield _heads(file.read_row_groups(sorted(some)).to_pandas(), n)
            some = []
        if k < 0:
            break
        if not single:
            some.append(k)
            continue
        g = file.metadata.row_group(k).column(0).statistics.min
        seen = known.setdefault(g, {})
        bar = sorted(seen.values())[n - 1] if len(seen) >= n else np.inf
        if best > min(bar, limit if limit == limit else np.inf):
            continue
        rows = _heads(file.read_row_group(k).to_pandas(), n)
        for item, score in zip(rows["item"], rows["score"]):
            seen[item] = min(score, seen.get(item, np.inf))
        yield rows


def _heads(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    rows = rows[~rows.duplicated(["g", "item"])]  # sorted by score, then row_id: the first is the item's best
    return _plain(rows[rows.groupby("g").cumcount() < n])


def _read(spots: DataFrame, n: int, schema, tasks: int) -> DataFrame:
    """The best rows of the row groups (path, k, best, limit); files are dealt to `tasks` tasks, as their names are too small for Spark to tell the work."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, ks, bests, limits in zip(batch["path"], batch["k"], batch["best"], batch["limit"]):
                yield from best_rows(path, list(zip(ks, bests, limits)), n)

    by_file = spots.repartition(tasks, "path").groupBy("path").agg(*[F.collect_list(F.struct("k", "best", "limit")).alias("s")])
    return by_file.select("path", *[F.col(f"s.{c}").alias(c) for c in ("k", "best", "limit")]).mapInPandas(scan, schema)


def _once(rows: DataFrame) -> DataFrame:
    return rows.groupBy("g", "item").agg(F.min(F.struct("score", "row_id")).alias("b")).select("g", "item", "b.score", "b.row_id")


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("g").orderBy("score", "item"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def top_n(df: DataFrame, group: Sequence[str], item: str, score: Column, row_id: str, n: int, rows_each: int | None = None) -> DataFrame:
    """The n items of lowest score of every group: (g, item, score, row_id, rank).

    An item counts once per group, by its lowest score and then lowest row_id; ties of items
    are ordered by score, then item. Rows that repeat entirely therefore count once. Groups of
    fewer than n items give all of theirs; an empty table gives no rows. Columns of df beyond
    those named are ignored, so their names can't clash.
    """
    return top_n_and_reads(df, group, item, score, row_id, n, rows_each)[0]


def top_n_and_reads(df: DataFrame, group: Sequence[str], item: str, score: Column, row_id: str, n: int, rows_each: int | None = None) -> tuple[DataFrame, DataFrame]:
    """top_n, and the row groups (path, k, n_rows, g, best, is_read) of the clustered files."""
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = df.sparkSession
    path = cluster(df, group, item, score, row_id, rows_each)
    stored = spark.read.parquet(path)
    files = stored.inputFiles()
    kind = stored.schema["g"].dataType.simpleString()
    tasks = min(max(len(files), 1), 20_000)
    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(tasks)
    parts = written(footers(listed, kind), "footers")
    unknown = F.lit(float("nan")).alias("limit")
    several = parts.where("g is null").select("path", "k", "best", unknown)
    first = parts.where("g is not null").groupBy("g").agg(F.min(F.struct("best", "path", "k")).alias("f"))
    heads = first.select("f.path", "f.k", "f.best", unknown)
    one = written(_read(several.union(heads), n, stored.schema, tasks), "heads")
    # The N-th scores of the groups that fill row groups alone; they are few beside the rows.
    nth = _ranked(_once(one.join(first.select("g"), "g", "left_semi")), n).where(F.col("rank") == n).select("g", F.col("score").alias("limit"))
    rest = parts.where("g is not null").join(heads.select("path", "k"), ["path", "k"], "left_anti").join(nth, "g", "left")
    wanted = rest.where(F.col("limit").isNull() | (F.col("best") <= F.col("limit"))).select("path", "k", "best", F.coalesce("limit", unknown).alias("limit"))
    two = _read(wanted, n, stored.schema, tasks)
    reads = several.union(heads).union(wanted).select("path", "k", F.lit(True).alias("is_read"))
    return _ranked(_once(one.union(two)), n), parts.join(reads, ["path", "k"], "left").withColumn("is_read", F.coalesce("is_read", F.lit(False)))
