"""Where intermediate tables go: the folder that all executors share."""

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session, which has no other machine, gets a folder of its own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Spark deletes a query's shuffle files when it ends; otherwise they stay until the driver happens to collect its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scopes: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """The tables that ``materialize`` makes inside, for ``release`` once nothing reads them any more."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def materialize(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, with a folder for each value of ``by``, and read it back.

    It cuts the lineage without tying the rows to the executors that made them.
    What was shuffled for it is deleted, so that of a chain of tables only one's shuffles are on disk at a time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palimpsest-{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, wherever Spark's paths lead; nothing happens where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def set_times(spark: SparkSession, paths: list[str], step: int = 1000) -> None:
    """Give files times ``step`` milliseconds apart in the order of the list, the last one's as it would be now: streams take files by their times."""
    now = int(time.time() * 1000)
    for k, path in enumerate(paths, 1):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(place, now - step * (len(paths) - k), -1)


def release(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for df in tables:
        if df is not None and (path := getattr(df, "table_path", None)):
            remove(df.sparkSession, path)


def numbered(df: DataFrame, group: list[str], by: list, name: str, start: int = 1) -> DataFrame:
    """Add ``name``: the row's number in its group in the order of ``by``.

    Rows are dealt to ranges of (group, by) and sorted there; a range adds the
    rows of its group in the ranges before it. A group of any size is shared by
    many tasks.
    """
    ranged = df.repartitionByRange(*group, *by).sortWithinPartitions(*group, *by)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged")  # written once, so rows keep their places
    parts = ranged.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parts = parts.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.col("_part").alias("_p"), "_first", "_before")
    on = ranged["_part"] == parts["_p"]
    for k, g in enumerate(group):
        on = on & ranged[g].eqNullSafe(parts[f"_g{k}"])
    return ranged.join(parts, on).select(*df.columns, (F.col("_before") + F.col("_row") - F.col("_first") + start).cast("long").alias(name))
