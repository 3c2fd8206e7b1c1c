"""Session helpers: shared folder for written tables, scoped settings, table access."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the schema comes from the Parquet footer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the master is local does this fall back to a temporary
    folder of this machine; on a cluster that would lose data, so it raises there.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="costplan-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/costplan-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder written by this module through Hadoop's file system layer."""
    with contextlib.suppress(Exception):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def drop_written(df: DataFrame) -> None:
    """Removes a table made by written() that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rpartition("/")[0]
        if "/costplan-" in folder:
            remove(df.sparkSession, folder)


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            remove(spark, path)


@contextlib.contextmanager
def temporary_conf(spark: SparkSession, settings: dict[str, object]) -> Iterator[None]:
    """Settings that hold inside the block and are restored (or unset) after it.

    Spark plans lazily, so the caller has to run the action, or force executedPlan(), inside.
    """
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, str(v).lower() if isinstance(v, bool) else str(v))
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
