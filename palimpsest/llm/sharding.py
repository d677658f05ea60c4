"""Sharding by sampled splitters.

Records are ordered by the MD5 of their text, then by doc_id and then by a
number that each row gets when the records are written, so equal texts lie
together and no two keys are equal. A sample drawn in proportion to size gives
quantile boundaries; records are partitioned into many more ranges than shards;
the size of every range is then measured over all rows, and a range that is
overfull (bad luck, or few very large records) is subdivided at further sampled
keys. Sums over the ranges before it and a running sum inside its range place
each record exactly, so shards hold nearly equal sizes whatever the sample was,
and slots are gapless. All of it is DataFrame operations; only boundaries reach
the driver: about shards * ranges_per_shard * samples_per_range keys (10,240 by
default), whatever the number of rows.

Edge cases: a null text has no bytes and its size is the overhead; rows of one
text, also with the same or no doc_id, are told apart by their numbers, so that
a text with very many copies fills as many ranges and shards as it needs; null
doc_ids come first in a tie; one record larger than a shard keeps its shard
nearly to itself; the law is ``bytes``, so copies of one text may lie on both
sides of a shard's end; an empty table gives no rows; other columns are ignored.
"""

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


Bound = tuple[str, int | None, int]
_KEY = "struct<h:string,id:bigint,row:bigint>"


def _range_of(key: Column, bounds: list[Bound]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``: a search in two steps over a literal array."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    keys = [{"h": h, "id": i, "row": r} for h, i, r in bounds]
    written = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  a constant, folded by the optimizer
    heads = F.size(F.filter(written(keys[::step], f"array<{_KEY}>"), lambda b: b <= key))
    blocks = written([keys[k : k + step] for k in range(0, len(keys), step)], f"array<array<{_KEY}>>")
    inside = F.size(F.filter(F.element_at(blocks, F.greatest(heads, F.lit(1))), lambda b: b <= key))
    return F.when(heads == 0, 0).otherwise((heads - 1) * step + inside)


def _sample(records: DataFrame, want: int, total: int, seed: int) -> list[Bound]:
    """About ``want`` keys, drawn by a hash of the row with a chance in proportion to size: no more than that, as no two rows share a draw."""
    chance = F.col("size") * F.lit(want / max(total, 1))
    draw = F.pmod(F.xxhash64("row", "h", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return [(r.h, r.doc_id, r["row"]) for r in records.where(draw < chance).select("h", "doc_id", "row").collect()]


def _order(key: Bound) -> tuple:
    return key[0], key[1] is not None, key[1] or 0, key[2]


def _quantiles(sample: list[Bound], parts: int) -> list[Bound]:
    sample = sorted(sample, key=_order)
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}, key=_order) if sample else []


def shard(
    docs: DataFrame,
    shards: int = 40,
    ranges_per_shard: int = 16,
    samples_per_range: int = 16,
    overhead: int = 16,
    seed: int = 11,
    rounds: int = 3,
) -> DataFrame:
    """Place every record: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    records = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.octet_length(text).cast("long").alias("bytes"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("h"),
        ).select("doc_id", (F.col("bytes") + overhead).alias("size"), "text_crc32", "h", F.monotonically_increasing_id().alias("row")),
        "shard-records",  # written once, so a row keeps its number

    )
    key = F.struct(F.col("h"), F.col("doc_id").alias("id"), F.col("row"))
    total, n = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(shards * ranges_per_shard, max(n // 8, 1))  # a range of a few rows would gain nothing
    bounds = _quantiles(_sample(records, ranges * samples_per_range, total, seed), ranges)
    for k in range(rounds):
        # at most as many rows as there are ranges
        measured = records.select(_range_of(key, bounds).alias("range"), "size").groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        sizes = {r["range"]: (r["size"], r["n"]) for r in measured.collect()}
        full = {r: s for r, (s, m) in sizes.items() if s > 2 * total / ranges and m > 8}
        if not full or k == rounds - 1:
            break
        crowded = records.where(_range_of(key, bounds).isin(*full))
        more = _sample(crowded, sum(-(-s * ranges // total) for s in full.values()) * samples_per_range, sum(full.values()), seed + k + 1)
        inside: dict[int, list] = {}
        for x in more:
            inside.setdefault(sum(_order(b) <= _order(x) for b in bounds), []).append(x)
        bounds = sorted({*bounds, *(b for r, own in inside.items() for b in _quantiles(own, max(2, -(-full.get(r, 0) * ranges // total))))}, key=_order)
    # where each range begins: few rows, on the driver as the boundaries are
    begun, rows = 0, []
    for r in sorted(sizes):
        rows.append((r, begun))
        begun += sizes[r][0]
    starts = records.sparkSession.createDataFrame(rows, "range int, begun long")
    by_range = Window.partitionBy("range").orderBy("h", "doc_id", "row")
    running = F.sum("size").over(by_range.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (
        records.withColumn("range", _range_of(key, bounds))
        .withColumn("at", F.row_number().over(by_range))
        .withColumn("upto", running)
        .join(F.broadcast(starts), "range")
        .withColumn("middle", F.col("begun") + F.col("upto") - F.expr("size div 2"))
        .withColumn("shard", F.least(F.floor(F.col("middle") * shards / F.lit(total)), F.lit(shards - 1)).cast("int"))
    )
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "range", "at", "shard"), "shard-placed")
    # in a shard, ranges follow each other, and rows keep their order: where a range's rows of a shard begin there
    each = placed.groupBy("shard", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    at = each.select("shard", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(at), ["shard", "range"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") + F.col("shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
