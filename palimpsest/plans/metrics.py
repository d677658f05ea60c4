"""Metrics of a run, and the analysis of metric logs."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.keys import hit_rate


# fixed values: the log's columns, and those of its shorter form
LOG = ("Batch", "Batch_Time", "Throughput", "Hits", "Misses", "Reads_Aligned", "Compression_Ratio")
SHORT_LOG = tuple(c for c in LOG if c != "Misses")


def running_sums(df: DataFrame, at: str, columns: list[str], block: int = 4096) -> DataFrame:
    """``columns`` as sums of all rows up to each one in the order of ``at``, by blocks of it: a row for each block meets in one task."""
    blocked = df.withColumn("_block", F.floor(F.col(at) / block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("_block").agg(*(F.sum(c).alias(f"_s_{c}") for c in columns))
    sums = sums.select("_block", *(F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in columns))
    inside = Window.partitionBy("_block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocked.join(sums, "_block").select(*(c for c in df.columns if c not in columns), *((F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(c) for c in columns))


def batch_metrics(counted: DataFrame, bucket_size: int, seconds: DataFrame | None = None) -> DataFrame:
    """A row per bucket in the log's columns; counters run on. ``seconds`` (bucket, seconds) gives times and throughput."""
    if seconds is not None:
        counted = counted.join(seconds, "bucket", "left")
    else:
        counted = counted.withColumn("seconds", F.lit(None).cast("double"))
    return running_sums(counted, "bucket", ["hits", "misses", "n_unique"]).select(
        F.col("bucket").alias("Batch"),
        F.col("seconds").alias("Batch_Time"),
        F.try_divide(F.lit(float(bucket_size)), F.col("seconds")).alias("Throughput"),
        F.col("hits").cast("long").alias("Hits"),
        F.col("misses").cast("long").alias("Misses"),
        F.col("n_unique").cast("long").alias("Reads_Aligned"),
        F.col("compression_ratio").alias("Compression_Ratio"),
    )


def summary(counted: DataFrame, seconds: float | None = None, mode: str = "intended") -> DataFrame:
    """One row: rows seen, rows mapped, hits, misses, hit rate, average throughput (rows seen by seconds of mapping)."""
    total = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_rows", "n_unique", "n_dup", "hits", "misses")))
    return total.withColumn("hit_rate", hit_rate(F.col("hits"), F.col("misses"), mode)).withColumn(
        "avg_throughput", F.lit(None).cast("double") if not seconds else F.col("n_rows") / F.lit(seconds)
    )


def log_lines(metrics: DataFrame, files: list[str], config: str, total_reads: int, runtime: float) -> DataFrame:
    """The log as lines (n, value): comments on the inputs, the columns' names, a row for each bucket, a comment on the run."""
    head = [f"# Num_Files:{len(files)}", "# File_Names:" + "".join(f + "," for f in files), ",".join(LOG)]
    foot = f"# config:{config} total_reads:{total_reads} runtime:{runtime:g}"
    return _lines(metrics, head, LOG, F.col("Batch").cast("string"), foot)


def short_log_lines(metrics: DataFrame, bucket_size: int, cache: str, total_reads: int, runtime: float, manager: str = "buckets") -> DataFrame:
    """The log without misses, its batches counted from 0, and what the run was in the first line."""
    head = [f"# batch_size:{bucket_size} manager_type:{manager} cache_type:{cache} total_reads:{total_reads} runtime:{runtime:g}", ",".join(SHORT_LOG)]
    return _lines(metrics, head, SHORT_LOG, (F.col("Batch") - 1).cast("string"), None)


def _lines(metrics: DataFrame, head: list[str], columns: tuple[str, ...], batch: Column, foot: str | None) -> DataFrame:
    cells = [batch, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns[1:])]
    rows = metrics.select(F.col("Batch").cast("long").alias("n"), F.concat_ws(",", *cells).alias("value"))
    around = [(k - len(head), x) for k, x in enumerate(head)] + ([((1 << 62), foot)] if foot else [])
    return rows.unionByName(metrics.sparkSession.createDataFrame(around, "n long, value string"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, comment="#")


def row_slice(log: DataFrame, at: str, lo: int, hi: int) -> DataFrame:
    return log.where((F.col(at) >= lo) & (F.col(at) < hi))


def clamp_outliers(log: DataFrame, column: str, above: float = 1000.0) -> DataFrame:
    """Values more than ``above`` over the mean become the mean, taken before any change."""
    mean = log.agg(F.avg(column).alias("_mean"))
    joined = log.crossJoin(F.broadcast(mean))  # one row
    return joined.withColumn(column, F.when(F.col(column) > F.col("_mean") + above, F.col("_mean")).otherwise(F.col(column))).drop("_mean")


def cumulative_mean(log: DataFrame, column: str, at: str, block: int = 100_000) -> DataFrame:
    """The mean of all rows up to each one, by blocks of ``at``: sums before a block are few rows, the rest stays inside blocks."""
    blocked = log.withColumn("_block", F.floor(F.col(at) / block))
    sums = blocked.groupBy("_block").agg(F.sum(column).alias("_s"), F.count(column).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = blocked.join(sums, "_block")
    mean: Column = (F.col("_s0") + F.sum(column).over(inside)) / (F.col("_n0") + F.count(column).over(inside))
    return out.withColumn("cum_mean", mean).drop("_block", "_s0", "_n0")


def group_means(log: DataFrame, column: str, at: str, size: int = 5, drop_first: bool = False) -> DataFrame:
    out = log.groupBy(F.floor(F.col(at) / size).cast("long").alias("g")).agg(F.avg(column).alias("mean"))
    return out.where("g > 0") if drop_first else out
