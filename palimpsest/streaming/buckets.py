"""The bounded cache under Structured Streaming: one file per bucket, one micro-batch per file.

Files are taken in the order of their times, so they are written one after
another. The cache's state, its filter and the results that wait for the next
bucket are Parquet in the cache's folder, a version for each bucket; with the
stream's own checkpoint they let a stream that was stopped go on as if it
hadn't been.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import dedup
from palimpsest.operators.cache import CacheStats, MemoCache
from palimpsest.sources import fastq

Mapper = Callable[[DataFrame], DataFrame]  # rows with key and pos to pos and value


def step(cache: MemoCache, rows: DataFrame, bucket: int, mapping: Mapper, compression: str = "none", mode: str = "intended") -> DataFrame:
    """One bucket (key, pos, for cross file_id): probe, map what is left to do, hold the results. Returns pos and value of every row."""
    found = cache.probe(dedup.firsts(rows.withColumn("bucket", F.lit(bucket)), compression, mode), bucket)
    missed = found.where("not hit").select("key", "pos", "_work")
    mapped = cache.keep(mapping(missed.where("pos = _work").select("key", "pos")).select("pos", "value"), bucket, "mapped")
    given = missed.join(mapped.withColumnRenamed("pos", "_work"), "_work").select("key", "value", "pos")
    # a row's result is written also for duplicates, where it changes nothing: the first value of a key stays
    cache.write(given, bucket)
    return found.where("hit").select("pos", "value").unionByName(cache.pending.select("pos", "value"))


def run_buckets(cache: MemoCache, rows: DataFrame, mapping: Mapper, n_buckets: int, output: str, compression: str = "none", first: int = 1) -> CacheStats:
    """A loop over the buckets of a table (bucket, key, pos), each a filter on a sorted column; pos and value go to ``output``."""
    for b in range(first, n_buckets + 1):
        own = rows.where(F.col("bucket") == b).drop("bucket")
        step(cache, own, b, mapping, compression).write.mode("overwrite").parquet(f"{output}/bucket={b}")
    return cache.close()


def run_files(spark: SparkSession, folder: str, cache: MemoCache, mapping: Mapper, output: str, checkpoint: str, kind: str = "fastq", compression: str = "none") -> CacheStats:
    """Run all buckets that lie in ``folder`` as FASTQ or FASTA files, one a bucket, and write pos and value to ``output``; the key is the sequence.

    Files are taken once each, in the order of their times, also after a restart. pos is the
    file's turn, in the bits above ``fastq.SPLIT_BITS``, and the record's number in it, from 1.
    """

    def batch(lines: DataFrame, batch_id: int) -> None:
        found = fastq.records(lines.withColumn("_id", F.monotonically_increasing_id()).withColumn("file_id", F.lit(batch_id)), kind)
        rows = found.select(F.col("sequence").alias("key"), (F.lit(batch_id << fastq.SPLIT_BITS) + F.col("rec_idx") + 1).alias("pos"), "file_id")
        rows = cache.keep(rows, batch_id + 1, "records")
        step(cache, rows, batch_id + 1, mapping, compression).write.mode("overwrite").parquet(f"{output}/bucket={batch_id + 1}")

    text = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", 1).option("pathGlobFilter", f"*.{kind}").text(folder)
    return _run(text.select(F.col("_metadata.file_block_start").alias("_start"), "value"), batch, cache, checkpoint)


def run_stream(spark: SparkSession, source: str, schema: str, cache: MemoCache, mapping: Mapper, output: str, checkpoint: str, compression: str = "none") -> CacheStats:
    """Run all buckets that lie in ``source`` as Parquet files and write pos and value to ``output``."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        step(cache, rows, batch_id + 1, mapping, compression).write.mode("overwrite").parquet(f"{output}/bucket={batch_id + 1}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return _run(stream, batch, cache, checkpoint)


def _run(stream: DataFrame, batch: Callable[[DataFrame, int], None], cache: MemoCache, checkpoint: str) -> CacheStats:
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    cache.start(cache.last() + 1)  # where no batch was left to run
    return cache.close()
