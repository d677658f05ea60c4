"""Similarity buckets: chains by hash, buckets of ``bucket_size`` in arrival order, chains drained in a defined order.

Rows are numbered inside blocks of neighbouring arrivals of their chain; running
sums over the counts of the blocks carry the numbers on, so a chain that holds
most rows is shared by many tasks. What is known of the chains, a row for each
of at most 64, gives every chain its place, so no window spans the table:
bucket = buckets before the chain + (number in chain - 1) / size. In random order a
row for each bucket says when it is handed out.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.metrics import running_sums
from palimpsest.storage import materialize, numbered

BLOCK_BITS = 20  # a block has at most 2 ** 20 arrivals
SORTED_BY = {"intended": ["sequence", "file_id", "header"], "wired": ["file_id", "header", "sequence", "plus", "quality"]}


def _blocks(reads: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """``reads`` with its block, and rows of each chain's block with the rows of the chain before it. Rows without an arrival come first."""
    rows = reads.withColumn("_block", F.coalesce(F.shiftright(F.col("arrival").cast("long"), bits), F.lit(-(1 << 63) >> bits)))
    before = Window.partitionBy("chain").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("chain", "_block").agg(F.count("*").alias("_n"))
    return rows, blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _numbered(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add rn, a row's number in its chain from 1."""
    own = F.row_number().over(Window.partitionBy("chain", "_block").orderBy("arrival"))
    return rows.join(blocks.select("chain", "_block", "_before"), ["chain", "_block"]).withColumn("rn", (own + F.col("_before")).cast("long"))


def chain_table(rows: DataFrame, blocks: DataFrame, bucket_size: int) -> DataFrame:
    """chain, n_buckets, cord (its turn from 1), buckets and rows before it, whether it is first. At most 64 rows; they pass the driver."""
    fills = F.col("_before").between(bucket_size - F.col("_n"), bucket_size - 1)
    filling = blocks.where(fills)  # at most one block of each chain
    filled = _numbered(rows.select("chain", "_block", "arrival"), F.broadcast(filling)).where(F.col("rn") == bucket_size).select("chain", F.col("arrival").alias("filled"))
    chains = blocks.groupBy("chain").agg(F.sum("_n").alias("n_rows")).join(F.broadcast(filled), "chain", "left")
    chains = chains.withColumn("n_buckets", F.ceil(F.col("n_rows") / bucket_size).cast("long"))
    # the chain whose first bucket is full first starts; without a full bucket the longest does
    first = F.row_number().over(Window.orderBy(F.col("filled").asc_nulls_last(), F.col("n_buckets").desc(), "chain")) == 1
    by = Window.orderBy(F.col("first").desc(), F.col("n_buckets").desc(), F.col("chain"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    chains = chains.withColumn("first", first.cast("int")).select(
        "chain",
        "n_buckets",
        F.row_number().over(by).cast("long").alias("cord"),
        F.coalesce(F.sum("n_buckets").over(before), F.lit(0)).cast("long").alias("buckets_before"),
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).cast("long").alias("rows_before"),
        F.col("n_rows").cast("long").alias("n_rows"),
        "first",
    )
    return rows.sparkSession.createDataFrame(chains.collect(), chains.schema)


def random_turns(chains: DataFrame, bucket_size: int, seed: int) -> DataFrame:
    """chain, cb, bucket and rows_before: after each bucket the next one is of any chain that has some left, all alike, in the chain's own order.

    A chain's buckets come at the times of a Poisson process, all chains at one rate until they end, so at each time every
    chain that isn't empty is equally likely to be next. The starting chain gives the first bucket. A row for each bucket.
    """
    each = chains.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_buckets") - 1)).alias("cb"))
    draw = (F.pmod(F.xxhash64("chain", "cb", F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    own = Window.partitionBy("chain").orderBy("cb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.when((F.col("first") == 1) & (F.col("cb") == 0), F.lit(0.0)).otherwise(-F.log(draw))
    each = each.withColumn("size", F.least(F.lit(bucket_size).cast("long"), F.col("n_rows") - F.col("cb") * bucket_size)).withColumn("time", F.sum(gap).over(own))
    # buckets are numbered by ranges of time and their sizes summed by blocks of turns, so no task sees them all
    turns = numbered(each.withColumn("all", F.lit(0)), ["all"], ["time", "chain", "cb"], "bucket").select("chain", "cb", "bucket", "size")
    return running_sums(turns.withColumn("upto", F.col("size")), "bucket", ["upto"]).select("chain", "cb", "bucket", (F.col("upto") - F.col("size")).alias("rows_before"))


def assign_buckets(reads: DataFrame, bucket_size: int, order: str = "longest", seed: int = 0, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Add cb (the bucket's number in its chain from 0), bucket and pos (from 1, in the order in which buckets are handed out).

    ``reads`` has arrival and chain and is read three times, twice for these two
    columns. With one chain and arrivals without gaps, ``assign_arrival_buckets``
    needs no window.
    """
    rows, blocks = _blocks(reads, block_bits)
    blocks = materialize(blocks, "blocks")
    chains = chain_table(rows, blocks, bucket_size)
    numbered_rows = _numbered(rows, blocks).withColumn("cb", F.floor((F.col("rn") - 1) / bucket_size).cast("long"))
    if order == "random":
        joined = numbered_rows.join(random_turns(chains, bucket_size, seed), ["chain", "cb"])
        return joined.select(*reads.columns, "cb", "bucket", (F.col("rows_before") + F.col("rn") - F.col("cb") * bucket_size).alias("pos"))
    joined = numbered_rows.join(F.broadcast(chains), "chain")
    return joined.select(*reads.columns, "cb", (F.col("buckets_before") + F.col("cb") + 1).alias("bucket"), (F.col("rows_before") + F.col("rn")).alias("pos"))


def assign_arrival_buckets(reads: DataFrame, bucket_size: int) -> DataFrame:
    """One chain, arrivals from 0 without gaps: arithmetic alone."""
    cb = F.floor(F.col("arrival") / bucket_size).cast("long")
    return reads.withColumn("cb", cb).withColumn("bucket", cb + 1).withColumn("pos", F.col("arrival").cast("long") + 1)


def sorted_chain(reads: DataFrame, mode: str = "intended") -> DataFrame:
    """One bucket per chain, sorted: by sequence, or wired by the whole row. bucket follows the chain, pos the order; a chain is shared by many tasks."""
    return numbered(reads, ["chain"], [*SORTED_BY[mode], "arrival"], "pos").withColumn("bucket", F.col("chain").cast("long") + 1)
