"""Routes of rows: taken from the cache, a duplicate inside the bucket, or unique work.

A bucket sees the results of buckets at least two before it. While the different
keys fit the cache, its state follows from the rows alone: from the row whose
write stores the key. What is known of each key comes from one aggregate, or a
row limit, that starts before the shuffle and is joined back, so that a hot
key's rows never meet in one task; windows are over equal keys of one bucket at
most. A smaller cache is walked through bucket by bucket (``cache.walk``); both
ways end in the same columns.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import BloomBits
from palimpsest.functions import keys
from palimpsest.storage import materialize

LAG = 2
#: bits of a filter whose table of bits, a row of 24 bytes each, may be broadcast
SMALL_FILTER = 1 << 18


def _two_rows(rows: DataFrame) -> DataFrame:
    """One row for each key: key and of its first two rows _p1, _b1, _f1 and _p2, _b2, _f2 (pos, bucket, file)."""
    file = "file_id" if "file_id" in rows.columns else "pos"
    # a limit by rank is taken before the shuffle too: two rows of a key leave each task
    nth = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
    two = rows.select("key", "pos", "bucket", F.col(file).alias("_file")).withColumn("_nth", nth).where("_nth <= 2")
    of = lambda k, c: F.max(F.when(F.col("_nth") == k, F.col(c))).alias(f"_{c.strip('_')[0]}{k}")
    return two.groupBy("key").agg(*(of(k, c) for k in (1, 2) for c in ("pos", "bucket", "_file")))


def first_set(keyed: DataFrame, size: BloomBits) -> DataFrame:
    """When a filter of ``size`` knows each key: ``keyed`` (key, _p1, _b1: the first row of a key) with _known and _seen, the pos and bucket at which the last of its bits is set.

    A key's first row is written whatever the cache holds, and after any write of a
    key all its bits are set. So a bit is set first by the earliest first row among
    the keys that have it, evictions or not, and no row has to be replayed. A key
    whose bits all come from others is known too early: a false positive.
    """
    places = keys.bloom_positions(size.bits, size.functions, size.length, size.seed)
    bits = F.array_distinct(F.array(*(keys.bloom_hash(F.coalesce("key", F.lit("")), own, size.bits) for own in places)))
    each = keyed.select("_p1", "_b1", F.explode(bits).alias("_bit"))
    first = each.groupBy("_bit").agg(F.min(F.struct("_p1", "_b1")).alias("_set"))  # a row for each bit at most
    if size.bits <= SMALL_FILTER:
        first = F.broadcast(first)
    known = each.join(first, "_bit").groupBy("_p1").agg(F.max("_set").alias("_set"))
    return keyed.join(known.select("_p1", F.col("_set._p1").alias("_known"), F.col("_set._b1").alias("_seen")), "_p1")


def admissions(rows: DataFrame, compression: str = "none", bloom: bool | BloomBits = False, mode: str = "intended") -> DataFrame:
    """One row for each key: _key, _seen (the bucket from whose writes on the filter knows it), _from (the bucket whose write stores it), _by (the pos whose result that is) and _out (the pos of a row that the filter keeps out).

    ``bloom``: a key is stored at its second row; wired, the filter swallows the very first row only. A filter
    of a size stores a key at its first row if it takes it for a known one.
    """
    none = F.lit(None).cast("long")
    if not bloom:
        out = rows.groupBy("key").agg(F.min("bucket").alias("_seen"), F.min("pos").alias("_by")).withColumn("_from", F.col("_seen")).withColumn("_out", none)
    elif mode == "wired" and bloom is True:
        stored = lambda c: F.min(F.when(F.col("pos") > 1, F.col(c)))
        out = rows.groupBy("key").agg(stored("pos").alias("_by"), stored("bucket").alias("_from"), F.min(F.when(F.col("pos") == 1, F.col("pos"))).alias("_out"))
        out = out.withColumn("_seen", F.lit(1).cast("long"))  # the filter's only bit is set by the first write of all
    else:
        out = _two_rows(rows)
        if bloom is True:
            out = out.withColumns({"_seen": F.col("_b1"), "_known": F.col("_p1")})
        else:
            out = first_set(materialize(out, "keys"), bloom)
        swallowed = F.col("_known") == F.col("_p1")
        same = F.col("_b2") == F.col("_b1")  # a duplicate in its own bucket has the first row's result
        if mode == "wired":
            compression = "none"
        repeated = {"none": F.lit(False), "full": same, "cross": same & (F.col("_f1") != F.col("_f2"))}[compression]
        out = out.withColumns({
            "_from": F.when(swallowed, F.col("_b2")).otherwise(F.col("_b1")),
            "_by": F.when(~swallowed | repeated, F.col("_p1")).otherwise(F.col("_p2")),
            "_out": F.when(swallowed, F.col("_p1")),
        })
    return out.select(F.col("key").alias("_key"), "_seen", "_from", "_by", "_out")


def mark_hits(rows: DataFrame, policy: str = "lru", bloom: bool | BloomBits = False, mode: str = "intended", compression: str = "none", known: DataFrame | None = None) -> DataFrame:
    """Add ``hit``, ``_by`` (the pos that a hit's result comes from) and ``_asks`` (whether a miss would be counted).

    Valid while the different keys fit the cache: nothing is evicted. ``known``: ``admissions``, where they are made already.
    """
    if policy == "none":
        return rows.withColumn("hit", F.lit(False)).withColumn("_by", F.lit(None).cast("long")).withColumn("_asks", F.lit(False))
    known = admissions(rows, compression, bloom, mode) if known is None else known
    joined = rows.join(known, F.col("key").eqNullSafe(F.col("_key")), "left")
    asks = F.col("bucket") >= F.col("_seen") + LAG if bloom else F.lit(True)
    return joined.withColumn("hit", F.coalesce(F.col("bucket") >= F.col("_from") + LAG, F.lit(False))).withColumn("_asks", asks).drop("_key", "_seen", "_from", "_out")


def firsts(rows: DataFrame, compression: str, mode: str = "intended") -> DataFrame:
    """Add ``_first`` (the pos of the first row of the key in the bucket) and ``_work`` (the pos whose result a row has unless it is a hit).

    full: of equal keys in a bucket the first is work. cross: rows from the
    first one's file are work too, only rows of other files are duplicates.
    Wired, both do what none does.
    """
    if mode == "wired" or compression == "none":
        return rows.withColumn("_first", F.col("pos")).withColumn("_work", F.col("pos"))
    same = Window.partitionBy("bucket", "key").orderBy("pos")
    rows = rows.withColumn("_first", F.first("pos").over(same))
    if compression == "full":
        return rows.withColumn("_work", F.col("_first"))
    file = F.first("file_id").over(same)
    return rows.withColumn("_work", F.when(F.col("file_id") == file, F.col("pos")).otherwise(F.col("_first")))


def mark_routes(rows: DataFrame, compression: str = "none", mode: str = "intended") -> DataFrame:
    """Rows with ``hit``, ``_by`` and ``_asks`` to rows with

    route: cache, dup or unique. rep: the pos of the row of the same bucket whose
    result a row takes, null from the cache. src: the pos of the row whose result
    it has, also from the cache. asked: whether the row counts as a miss; without
    compression each row asks, else the first of equal keys.
    """
    columns = [c for c in rows.columns if c not in ("_by", "_asks", "_first", "_work")]
    if "_work" not in rows.columns:
        rows = firsts(rows, compression, mode)
    hit, work = F.col("hit"), F.col("_work")
    route = F.when(hit, "cache").when(work == F.col("pos"), "unique").otherwise("dup")
    return rows.select(
        *columns,
        route.alias("route"),
        F.when(~hit, work).alias("rep"),
        F.when(hit, F.col("_by")).otherwise(work).alias("src"),
        (~hit & F.col("_asks") & (F.col("_first") == F.col("pos"))).alias("asked"),
    )


def totals() -> list[Column]:
    """rows, unique, dup, hits and misses of routed rows."""
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("route") == "unique").alias("n_unique"),
        F.count_if(F.col("route") == "dup").alias("n_dup"),
        F.count_if("hit").alias("hits"),
        F.count_if("asked").alias("misses"),
    ]


def counters(routed: DataFrame) -> DataFrame:
    """Per bucket: rows, unique, dup, hits, misses, ratio. Each row from the cache is a hit; misses are the rows that asked in vain.

    A key that the admission filter doesn't know isn't counted; without a cache nothing is.
    """
    counted = routed.groupBy("bucket").agg(*totals())
    return counted.withColumn("compression_ratio", F.try_divide(F.col("n_rows").cast("double"), F.col("n_unique").cast("double")))


def fan_out(routed: DataFrame, results: DataFrame) -> DataFrame:
    """Give every row its value by one join. ``results``: pos and value of the unique rows."""
    return routed.join(results.select(F.col("pos").alias("_pos"), "value"), F.col("src") == F.col("_pos"), "left").drop("_pos")
