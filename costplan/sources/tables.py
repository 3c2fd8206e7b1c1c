"""Tables: Parquet folders, delimited files, statistics and the catalog."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from costplan.session import new_path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_tables(spark: SparkSession, base: str) -> list[str]:
    """Names of the Parquet folders or files (name.parquet) under base."""
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        raise FileNotFoundError(base)
    found = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if not name.startswith((".", "_")) and (s.isDirectory() or name.endswith(".parquet")):
            found.append(name.removesuffix(".parquet"))
    return sorted(found)


def _path(spark: SparkSession, base: str, name: str) -> str:
    fs, p = _fs(spark, f"{base}/{name}")
    return str(p) if fs.exists(p) else f"{base}/{name}.parquet"


def register(spark: SparkSession, base: str, tables: Sequence[str] | None = None, mode: str = "view", database: str = "default") -> list[str]:
    """Registers the tables under base as temporary views, or as external tables that can be analysed."""
    if mode not in ("view", "table"):
        raise ValueError("mode must be view or table")
    names = list(tables) if tables is not None else list_tables(spark, base)
    if tables is not None and not set(tables) <= set(list_tables(spark, base)):
        raise FileNotFoundError(f"{set(tables) - set(list_tables(spark, base))} under {base}")
    for n in names:
        path = _path(spark, base, n)
        if mode == "view":
            spark.read.parquet(path).createOrReplaceTempView(n)
        else:
            # The tables are external; the database's own folder stays empty and lies in the shared folder.
            if not spark.catalog.databaseExists(database):
                spark.sql(f"CREATE DATABASE {database} LOCATION '{new_path(spark, database)}'")
            spark.sql(f"DROP TABLE IF EXISTS {database}.{n}")
            spark.catalog.createTable(f"{database}.{n}", path=path, source="parquet")
    return names


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], casts: dict[str, str], keep: Sequence[str], sep: str = "|") -> DataFrame:
    """A delimited file without header, read as text columns; casts name the columns to convert."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("sep", sep).csv(path)
    return df.select(*[df[c].try_cast(casts[c]).alias(c) if c in casts else df[c] for c in keep])


def rows(spark: SparkSession, data: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """In-memory rows with inferred types."""
    return spark.createDataFrame(list(data), list(names))


def key_ranges(spark: SparkSession, n: int) -> dict[str, DataFrame]:
    """Key tables of n, 10 n and 100 n rows."""
    return {"nation": spark.range(n).toDF("n_id"), "customer": spark.range(10 * n).toDF("c_id"), "orders": spark.range(100 * n).toDF("o_id")}


def analyze(spark: SparkSession, name: str, columns: Sequence[str] | str | None = "all") -> int | None:
    """Collects statistics of a catalog table (columns "all", a list, or None) and returns its recorded rows."""
    what = "" if columns is None else " FOR ALL COLUMNS" if columns == "all" else " FOR COLUMNS " + ", ".join(columns)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS{what}")
    return recorded_rows(spark, name)


def recorded_rows(spark: SparkSession, name: str) -> int | None:
    """Row count in the catalog's statistics, None without any."""
    told = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Statistics'").select("data_type").first()
    m = re.search(r"(\d+) rows", told[0]) if told else None
    return int(m[1]) if m else None


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copies a folder within or between file systems, replacing the target."""
    (fa, a), (fb, b) = _fs(spark, source), _fs(spark, target)
    fb.delete(b, True)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, spark._jsc.hadoopConfiguration())


def make_stale(spark: SparkSession, name: str, base: str, grown: str, work: str) -> tuple[int | None, int]:
    """An external table analysed on base files that now holds the grown ones: (recorded rows, actual rows)."""
    path = f"{work}/{name}"
    copy(spark, base, path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path=path, source="parquet")
    told = analyze(spark, name)
    copy(spark, grown, path)
    refresh(spark, [name])
    return told, spark.table(name).count()


def refresh(spark: SparkSession, names: Sequence[str]) -> None:
    for n in names:
        spark.sql(f"REFRESH TABLE {n}")


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


def enable_cbo(spark: SparkSession, reorder: bool = True) -> None:
    """Statistics-based optimisation; reorder False is the mode for testing hints."""
    for k, v in {"spark.sql.cbo.enabled": True, "spark.sql.cbo.joinReorder.enabled": reorder, "spark.sql.statistics.histogram.enabled": reorder}.items():
        spark.conf.set(k, str(v).lower())


def cbo_active(spark: SparkSession, name: str) -> bool:
    """Whether the optimiser knows the table's row count."""
    return spark.conf.get("spark.sql.cbo.enabled") == "true" and spark.table(name)._jdf.queryExecution().optimizedPlan().stats().rowCount().isDefined()
