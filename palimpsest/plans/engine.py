"""The engine: from reads to mapped output.

scan, key, chain, bucket, route, map the unique rows, fan out, write. Tables
that several of these steps read are written once to the shared folder, so that
inputs are scanned once and the mapper is called once for each unique row,
whatever the optimizer does with what reads them; only the counts of at most 64
chains and the number of different keys reach the driver. A cache that is
smaller than the keys that it would hold is walked through bucket by bucket
(``operators.cache.walk``); mapping and fan-out are the same then.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from palimpsest.config import EngineConfig
from palimpsest.functions import keys
from palimpsest.operators import bucketing, cache, dedup, mapper
from palimpsest.storage import materialize, release, scope


@dataclass(frozen=True)
class Run:
    """routed: each row with its route. output: file_id, pos, bucket, route, line. counters: a row per bucket. seconds: map time by bucket.

    totals: the counters' sums, observed while the routes were written. replay: how a cache
    that evicts was followed. ``close`` deletes the run's tables; what it gave can't be read after that.
    """

    routed: DataFrame
    output: DataFrame
    counters: DataFrame
    seconds: DataFrame | None = None
    totals: dict[str, int] = field(default_factory=dict)
    replay: cache.Replay | None = None
    tables: list[DataFrame] = field(default_factory=list, repr=False)

    def close(self) -> None:
        release(*self.tables)
        self.tables.clear()


def prepare(reads: DataFrame, config: EngineConfig) -> DataFrame:
    """Add chain, key, cb, bucket and pos to reads (file_id, header, sequence, plus, quality, arrival). ``n_rows`` of the result is their number."""
    sequence = F.col("sequence")
    key = keys.KEYS[config.key](sequence) if config.key else keys.packed_key(sequence, config.mode) if config.packed_key else sequence
    chained = materialize(reads.withColumn("chain", keys.chain_hash(sequence, config.hasher, mode=config.mode)).withColumn("key", key), "reads")
    n_rows = chained.count()  # from the footers of what has just been written
    if config.max_chain == 1:
        sorted_rows = bucketing.sorted_chain(chained, config.mode)
        before = sorted_rows.groupBy("chain").agg(F.count("*").alias("n"))  # a row for each of at most 64 chains
        n = {r.chain: r.n for r in before.collect()}
        table = [(c, sum(v for k, v in n.items() if k < c), sorted(n).index(c) + 1) for c in n]
        starts = reads.sparkSession.createDataFrame(table, "chain int, before long, turn long")
        placed = sorted_rows.join(F.broadcast(starts), "chain")
        out = placed.select(*chained.columns, F.lit(0).cast("long").alias("cb"), F.col("turn").alias("bucket"), (F.col("before") + F.col("pos")).alias("pos"))
    else:
        out = bucketing.assign_buckets(chained, config.bucket_size, config.chain_order, config.seed)
    out.n_rows = n_rows
    return out


def route(prepared: DataFrame, config: EngineConfig) -> DataFrame:
    """Add hit, route, rep, src and asked, as ``dedup.mark_routes`` says, for a cache of ``config.cache_capacity`` keys.

    ``replay`` of the result says how a cache that evicts was followed.
    """
    bloom, replay = config.bloom_bits or config.bloom, None
    if config.cache_policy == "none":
        marked = dedup.mark_hits(prepared, "none")
    elif getattr(prepared, "n_rows", config.cache_capacity + 1) <= config.cache_capacity and not config.bloom_bits:
        # no more rows than the cache holds: there is nothing to count first
        marked = dedup.mark_hits(prepared, config.cache_policy, bloom, config.mode, config.compression)
    else:
        prepared = materialize(prepared, "prepared")
        known = materialize(dedup.admissions(prepared, config.compression, bloom, config.mode), "keys")
        if known.where("_from is not null").count() <= config.cache_capacity:
            marked = dedup.mark_hits(prepared, config.cache_policy, bloom, config.mode, config.compression, known)
        else:  # keys will be evicted
            marked, replay = cache.walk(prepared, config.cache_capacity, config.cache_policy, bloom, config.mode, config.compression, known)
    routed = dedup.mark_routes(marked, config.compression, config.mode)
    routed.replay = replay
    return routed


def run(reads: DataFrame, config: EngineConfig, function: Callable[[list[str]], list[str]] | None = None) -> Run:
    """``function`` maps record texts to lines; without one, the stand-in expression does."""
    with scope() as tables:
        marked, seen = route(prepare(reads, config), config), Observation()
        routed = materialize(marked.observe(seen, *dedup.totals()), "routed")
        unique = routed.where("route = 'unique'")
        if function:
            results = materialize(mapper.map_unique(unique, function, config.bucket_size, config.threads), "results")
            seconds = routed.select("pos", "bucket").join(results.select("pos", "seconds"), "pos").groupBy("bucket").agg(F.sum("seconds").alias("seconds"))
        else:
            results, seconds = unique.select("pos", mapper.stand_in(F.col("sequence")).alias("value")), None
    line = keys.OUTPUTS[config.output](F.col("header"), F.col("value")) if config.output else keys.retag(F.col("header"), F.col("value"), config.mode) if config.retag else F.col("value")
    output = dedup.fan_out(routed, results).select("file_id", "pos", "bucket", "route", line.alias("line"))
    return Run(routed, output, dedup.counters(routed), seconds, seen.get, marked.replay, tables)
