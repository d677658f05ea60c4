"""The cache between buckets: bounded LRU and MRU with an optional admission filter.

A bucket is probed against the state before the results of the bucket before it
are written, so its own lag is two. An entry is as recent as its last hit, or
its write. Trimming happens after a bucket's writes, once there are more than
``capacity`` entries, and leaves ``capacity - 1``: LRU drops the oldest, MRU the
newest.

Hits and evictions depend on keys alone, not on what they are mapped to. So
``walk`` finds for a whole table which keys of which buckets are hits and whose
results these are: different keys of each bucket come from an aggregate, tasks
follow ranges of buckets with the cache's keys as their only state, and the
mapper can then run on all buckets at once. ``MemoCache`` keeps
state and values in tables, to which each bucket adds its changes, for streams whose buckets
come one after another; a stream that was stopped goes on from them.
"""

import hashlib
import json
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.config import BloomBits
from palimpsest.functions.keys import BLOOM_CODES, BLOOM_OTHER, bloom_positions
from palimpsest.operators import dedup
from palimpsest.storage import materialize, release, remove

#: seq: a later word on a key has a higher one; gone: it was evicted
CHANGES = "key string, value string, t long, row long, gone boolean, seq long"


def trim(state: DataFrame, capacity: int, policy: str = "lru") -> DataFrame:
    """At most ``capacity - 1`` entries, once there are more than ``capacity``; the cut is found by a top-k, not a global window."""
    return state if state.count() <= capacity else _cut(state, capacity, policy)


def _cut(state: DataFrame, capacity: int, policy: str) -> DataFrame:
    side = (F.col("t").desc(), F.col("row").desc()) if policy == "lru" else (F.col("t").asc(), F.col("row").asc())
    return state.orderBy(*side).limit(capacity - 1)


class BloomFilter:
    """Bits that keys set. A key is possibly known if all of its bits are set."""

    def __init__(self, size: BloomBits = BloomBits()):
        self.size = size
        self.places = bloom_positions(size.bits, size.functions, size.length, size.seed)
        self.clear()

    def clear(self) -> None:
        self.set = np.zeros(self.size.bits, dtype=bool)

    def _bits(self, key: str) -> list[int]:
        codes = lambda p: BLOOM_CODES.get(key[p], BLOOM_OTHER) if p < len(key) else BLOOM_OTHER
        return [sum(codes(p) << (3 * i) for i, p in enumerate(own)) % self.size.bits for own in self.places]

    def add(self, key: str) -> None:
        self.set[self._bits(key)] = True

    def possibly(self, key: str) -> bool:
        return bool(self.set[self._bits(key)].all())


class Recency:
    """The keys of a bounded cache from the oldest to the newest, each with what it is mapped to."""

    def __init__(self, capacity: int, policy: str = "lru"):
        self.capacity, self.policy, self.order = capacity, policy, OrderedDict()

    def find(self, key) -> bool:
        """Whether the key is there; that alone doesn't make it recent."""
        return key in self.order

    def at(self, key):
        """The value of a key, which becomes the newest."""
        self.order.move_to_end(key)
        return self.order[key]

    def insert_no_evict(self, key, value) -> None:
        """Add as the newest what is absent; what is there keeps its value and place."""
        self.order.setdefault(key, value)

    def insert(self, key, value) -> None:
        """Add what is absent and make room at once: the key itself may be the victim."""
        if key not in self.order:
            self.order[key] = value
            self._evict()

    def trim(self) -> None:
        if len(self.order) > self.capacity:
            self._evict()

    def _evict(self) -> None:
        while len(self.order) >= self.capacity:
            self.order.popitem(last=self.policy == "mru")

    def clear(self) -> None:
        self.order.clear()


@dataclass(frozen=True)
class Replay:
    """How a bounded cache was followed: in how many ranges of buckets, in how many rounds, and how many ranges were done again."""

    ranges: int = 1
    rounds: int = 1
    replayed: int = 0


#: a range is warmed up by so many (bucket, key) pairs for each key that the cache holds, and is this many times as long as that
WARM_UP, LENGTH = 8, 3
#: pairs that a range has at least, and is warmed up by: below that a task costs more than what it follows, and ranges of few buckets often have to be followed again
LEAST_RANGE, LEAST_WARM_UP = 200_000, 10_000
#: pairs that a task follows of an MRU cache, or the capacity if that is more; at most MOST_CHUNKS times as many where its keys go on changing
CHUNK, MOST_CHUNKS = 200_000, 4
#: more ranges than this aren't made; the driver holds two digests of each
MOST_RANGES = 10_000
_ENTRY, _WAIT, _BUCKET = 0, 1, 2
MARKS = "kind string, range int, bucket long, key string, pos long, work long, flag boolean, asks boolean"


def walk(
    rows: DataFrame, capacity: int, policy: str = "lru", bloom: bool | BloomBits = False, mode: str = "intended", compression: str = "none", known: DataFrame | None = None,
    warm_up: int | None = None, length: int | None = None,
) -> tuple[DataFrame, Replay]:
    """Add to rows (bucket, key, pos, for cross file_id) ``hit``, ``_by`` and ``_asks``, as ``dedup.mark_hits`` does, for a cache that evicts.

    Buckets are cut into ranges, which tasks follow at the same time. What an LRU cache
    holds depends on the keys used last: a range starts from an empty cache and
    the buckets before it, ``warm_up`` pairs of bucket and key for each key of the
    capacity, and has ``length`` times as many; unless these are given, ranges and warm-ups of a small cache are longer. Where its first state isn't the last one of the range before, it is
    followed again from that one, until all states meet; results are exact in any
    case. At worst each round puts one range right and the ranges come one after
    another. An MRU cache keeps its oldest keys for ever, so no later bucket tells
    what it holds, but once it is full its keys hardly change (``_walk_mru``).

    Whose result a hit has doesn't influence what is held, so it is looked up
    afterwards: it is the key's last insertion before the bucket.
    """
    rows = dedup.firsts(rows, compression, mode)
    keyed = rows
    if bloom:
        known = dedup.admissions(rows, compression, bloom, mode) if known is None else known
        keyed = rows.join(known.select("_key", "_seen", "_out"), F.col("key").eqNullSafe(F.col("_key")))
        new, seen = F.coalesce(F.min("pos") == F.min("_out"), F.lit(False)), F.min("_seen")
    else:
        new, seen = F.lit(False), F.lit(-dedup.LAG)
    # the first two rows of a key in a bucket are all that its write depends on; a bucket's rows are a bounded group
    two = F.slice(F.sort_array(F.collect_list(F.struct("pos", "_work"))), 1, 2)
    each = keyed.groupBy("bucket", "key").agg(two.alias("two"), F.max("pos").alias("last"), new.alias("new"), seen.cast("long").alias("seen"))
    each = each.select(F.col("bucket").cast("long").alias("bucket"), F.col("key").cast("string").alias("key"), F.col("two.pos").alias("pos"), F.col("two._work").alias("work"), "last", "new", "seen")
    each = materialize(each, "pairs")
    n, last = each.agg(F.count("*"), F.max("bucket")).first()
    if not n:
        release(each)
        return rows.select("*", F.lit(False).alias("hit"), F.lit(None).cast("long").alias("_by"), F.lit(True).alias("_asks")), Replay()
    if policy == "mru":
        marks, replay = _walk_mru(each, n, last, capacity, bool(bloom))
    else:
        marks, replay = _walk_lru(each, n, last, capacity, bool(bloom), warm_up, length)
    # a stored row is kept under its bucket; no hit of the key is in that one or the next
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    asked = marks.where(F.col("flag") | (F.col("kind") == "stored"))
    by = asked.withColumn("_by", F.last("work", ignorenulls=True).over(before)).where("kind = 'mark'")
    by = by.select(F.col("bucket").alias("_bucket"), F.col("key").alias("_key"), "_by")
    flags = marks.where("kind = 'mark'").select(F.col("bucket").alias("_b"), F.col("key").alias("_k"), F.col("flag").alias("hit"), F.col("asks").alias("_asks"))
    flags = flags.join(by, (F.col("_b") == F.col("_bucket")) & F.col("_k").eqNullSafe(F.col("_key")), "left").select("_b", "_k", "hit", "_asks", "_by")
    return rows.join(flags, (F.col("bucket") == F.col("_b")) & F.col("key").eqNullSafe(F.col("_k"))).drop("_b", "_k"), replay


_DEALT = ("range", "part", "bucket", "key", "pos", "work", "last", "new", "seen")


def _followed(dealt: DataFrame, ranges: int, follow: Callable) -> DataFrame:
    """The marks (see MARKS) of dealt rows, whose ranges are followed by a task each."""
    ordered = dealt.select(*_DEALT).repartitionById(ranges, "range").sortWithinPartitions("range", "part", "bucket", "last")
    return materialize(ordered.mapInArrow(follow, MARKS), "ranges", ["kind"])


def _walk_mru(each: DataFrame, n: int, last: int, capacity: int, bloom: bool) -> tuple[DataFrame, Replay]:
    """Marks of an MRU cache, for ``n`` pairs (``each``) in buckets up to ``last``.

    A full cache drops what is new, unless it is just one key: with ``capacity - 1`` keys it
    takes a single new one, with ``capacity`` it drops one of its own for any. So a task follows a
    chunk of buckets, and from its last state on an aggregate over all later buckets finds the first one whose
    writes change the set of keys. Up to there a hit is a key of that set, which is a join, and the
    order of the keys is that of their last hits. From there the next chunk is followed. Chunks grow up to
    a bound, so a cache whose keys change all the time is followed in tasks of that size one after another.
    """
    per_chunk = -(-max(capacity, CHUNK) * last // n)
    follow = _follow(capacity, "mru", bloom, None, True)
    asks = F.col("bucket") >= F.col("seen") + dedup.LAG if bloom else F.lit(True)
    pieces, lo, rounds, leaps, state = [], 1, 0, 0, None
    while lo <= last:
        hi = lo + per_chunk * min(1 << rounds, MOST_CHUNKS) - 1
        dealt = each.where(F.col("bucket").between(lo, hi)).withColumn("part", F.lit(_BUCKET))
        if state is not None:
            dealt = dealt.unionByName(state)
        table = _followed(dealt.withColumn("range", F.lit(0)), 1, follow)
        pieces.append(table.where(F.col("kind").isin("mark", "stored")))
        rounds += 1
        lo = hi + 1
        if lo > last:
            break
        end = table.where("kind = 'end'").select(F.col("pos").alias("held"), F.col("work").alias("n_new")).first()
        held, n_new = (end.held, end.n_new) if end else (0, 0)
        changes = lambda n_new: n_new == 1 if held == capacity - 1 else n_new >= 1  # noqa: B023, E731
        state = _states(table)
        if changes(n_new):
            continue
        holds = materialize(table.where("kind = 'entry'").select(F.col("key").alias("_key"), F.col("pos").alias("_place")), "held")
        later = each.where(F.col("bucket") >= lo).join(holds, F.col("key").eqNullSafe(F.col("_key")), "left").withColumn("_in", F.col("_place").isNotNull())
        written = F.count_if(~F.col("_in") & (~F.col("new") | (F.size("pos") > 1)))
        at = later.groupBy("bucket").agg(written.alias("n_new")).where(changes(F.col("n_new"))).agg(F.min("bucket")).first()[0]
        if at is None:
            at = last
        own = later.where(F.col("bucket") <= at).withColumn("_asks", asks).withColumn("_hit", F.col("_in") & F.col("_asks"))
        none = F.lit(None).cast("long")
        pieces.append(own.select(F.lit("mark").alias("kind"), F.lit(0).alias("range"), "bucket", "key", none.alias("pos"), none.alias("work"), F.col("_hit").alias("flag"), F.col("_asks").alias("asks")))
        leaps += 1
        lo = at + 1
        # keys in the order of their last hits, after those without; what the bucket has missed waits
        hits = own.where("_hit").groupBy("_place").agg(F.max(F.struct("bucket", "last")).alias("_at")).withColumnRenamed("_place", "_p")
        entries = holds.join(hits, F.col("_place") == F.col("_p"), "left")
        entries = _state(entries, _ENTRY, F.coalesce("_at.bucket", F.lit(-1).cast("long")), "_key", F.col("_place"), none, F.coalesce("_at.last", "_place"), F.lit(False))
        waits = own.where((F.col("bucket") == at) & ~F.col("_hit")).select("key", "new", F.posexplode(F.arrays_zip("pos", "work")).alias("_k", "_row"))
        waits = _state(waits, _WAIT, F.lit(-1).cast("long"), "key", F.col("_row.pos"), F.col("_row.work"), F.col("_row.pos"), F.col("new") & (F.col("_k") == 0))
        state = entries.unionByName(waits)
    marks = pieces[0]
    for piece in pieces[1:]:
        marks = marks.unionByName(piece.select(*marks.columns))
    return marks, Replay(rounds + leaps, rounds, 0)


def _state(rows: DataFrame, part: int, bucket: Column, key: str, pos: Column, work: Column, last: Column, new: Column) -> DataFrame:
    """Rows of a state as those that ``_follow`` takes: entries come in the order of bucket and last."""
    return rows.select(
        bucket.alias("bucket"), F.col(key).alias("key"), F.array(pos).alias("pos"), F.array(work).alias("work"), last.alias("last"), new.alias("new"), F.lit(0).cast("long").alias("seen"), F.lit(part).alias("part")
    )


def _states(table: DataFrame) -> DataFrame:
    """The state that a followed range has ended with, for the next one."""
    of = lambda kind, part: _state(table.where(F.col("kind") == kind), part, F.lit(-1).cast("long"), "key", F.col("pos"), F.col("work"), F.col("pos"), F.col("flag"))
    return of("entry", _ENTRY).unionByName(of("wait", _WAIT))


def _walk_lru(each: DataFrame, n: int, last: int, capacity: int, bloom: bool, warm_up: int | None, length: int | None) -> tuple[DataFrame, Replay]:
    """Marks of an LRU cache, for ``n`` pairs (``each``) in buckets up to ``last``."""
    warm_pairs = max(WARM_UP * capacity, LEAST_WARM_UP) if warm_up is None else warm_up * capacity
    pairs = max(LENGTH * warm_pairs, LEAST_RANGE) if length is None else length * warm_pairs
    warm = -(-warm_pairs * last // n)
    per_range = max(-(-pairs * last // n), -(-last // MOST_RANGES)) if length is None else max(length * warm, -(-last // MOST_RANGES))
    ranges = -(-last // per_range)

    own = F.floor((F.col("bucket") - 1) / per_range).cast("int")
    warms = (F.pmod(F.col("bucket") - 1, F.lit(per_range)) >= per_range - warm) & (own < ranges - 1)
    dealt = each.withColumn("range", F.explode(F.when(warms, F.array(own, own + 1)).otherwise(F.array(own))))
    done: list[tuple[DataFrame, list[int]]] = []
    first, end, rounds, todo = {}, {}, 0, list(range(ranges))
    while todo:
        if rounds:  # from the states that the ranges before them have ended with
            dealt = each.withColumn("range", own).where(F.col("range").isin(todo)).select("range", *each.columns)
            dealt = dealt.withColumn("part", F.lit(_BUCKET))
            for table, has in done:
                states = table.where(F.col("kind").isin("entry", "wait") & F.col("range").isin([r - 1 for r in todo if r - 1 in has]))
                dealt = dealt.unionByName(states.select(
                    (F.col("range") + 1).alias("range"), F.lit(-1).cast("long").alias("bucket"), "key", F.array("pos").alias("pos"), F.array("work").alias("work"), F.col("pos").alias("last"),
                    F.col("flag").alias("new"), F.lit(0).cast("long").alias("seen"), F.when(F.col("kind") == "entry", _ENTRY).otherwise(_WAIT).alias("part"),
                ))
        else:
            dealt = dealt.withColumn("part", F.lit(_BUCKET))
        table = _followed(dealt, ranges, _follow(capacity, "lru", bloom, per_range, ranges > 1))
        done = [(t, [r for r in has if r not in set(todo)]) for t, has in done] + [(table, todo)]
        for r in table.where("kind in ('first', 'end')").select("kind", "range", "key").collect():
            (first if r.kind == "first" else end)[r.range] = r.key
        rounds += 1
        again = [r for r in range(1, ranges) if first[r] != end[r - 1]]
        replay = Replay(ranges, rounds, sum(len(has) for _, has in done[1:])) if not again else None
        todo = again

    marks = None
    for table, has in done:
        mine = table.where(F.col("kind").isin("mark", "stored") & F.col("range").isin(has)) if len(has) < ranges else table.where(F.col("kind").isin("mark", "stored"))
        marks = mine if marks is None else marks.unionByName(mine)
    return marks, replay


def _follow(capacity: int, policy: str, bloom: bool, per_range: int | None, states: bool) -> Callable:
    """Follows ranges of buckets one after another: their marks, what is stored when, and the digests of their first and last states, with ``states`` the last one itself.

    Buckets that aren't of a range of ``per_range`` buckets warm it up; without that all are its own. The end says how many keys
    are held and how many more the next writes will add.
    """

    def state_of(cache: Recency, waiting: list[tuple]) -> str:
        digest = hashlib.blake2b(digest_size=16)
        for key in cache.order:
            digest.update(f"{key!r};".encode())
        digest.update(repr(sorted(waiting, key=lambda x: x[0])).encode())
        return digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []  # as MARKS
        now, cache, waiting, started = None, Recency(capacity, policy), [], False
        bucket, own = None, []

        def close() -> None:
            """Probe a bucket, touch its hits, write the bucket before, trim."""
            nonlocal waiting, own
            counts, missed, touched = per_range is None or (bucket - 1) // per_range == now, [], []
            for key, pos, work, last, new, seen in own:
                asks = not bloom or bucket >= seen + dedup.LAG
                hit = asks and cache.find(key)
                if hit:
                    touched.append((last, key))
                else:
                    missed += [(p, key, w, new and k == 0) for k, (p, w) in enumerate(zip(pos, work, strict=True))]
                if counts:
                    out.append(("mark", now, bucket, key, None, None, hit, asks))
            for _, key in sorted(touched, key=lambda x: x[0]):
                cache.at(key)
            for p, key, w, kept_out in sorted(waiting, key=lambda x: x[0]):
                if not kept_out and not cache.find(key):
                    cache.insert_no_evict(key, p)
                    if counts:
                        out.append(("stored", now, bucket - 1, key, p, w, None, None))
            cache.trim()
            waiting, own = missed, []

        def finish() -> None:
            if own:
                close()
            n_new = len({key for _, key, _, kept_out in waiting if not kept_out and not cache.find(key)})
            out.append(("end", now, None, state_of(cache, waiting), len(cache.order), n_new, None, None))
            if states:
                out.extend(("entry", now, None, key, k, None, None, None) for k, key in enumerate(cache.order))
                out.extend(("wait", now, None, key, p, w, kept_out, None) for p, key, w, kept_out in waiting)

        def made() -> Iterator[pa.RecordBatch]:
            nonlocal out
            for k in range(0, len(out), 100_000):
                part = out[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _MARKS, strict=True)], schema=_MARKS)
            out = []

        for batch in batches:
            for r, part, b, key, pos, work, last, new, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != now:
                    if now is not None:
                        finish()
                    now, cache, waiting, started, bucket, own = r, Recency(capacity, policy), [], False, None, []
                if part == _ENTRY:
                    cache.order[key] = pos[0]
                elif part == _WAIT:
                    waiting.append((pos[0], key, work[0], new))
                else:
                    if b != bucket:
                        if own:
                            close()
                        if not started and (per_range is None or (b - 1) // per_range == now):
                            started = True
                            out.append(("first", now, None, state_of(cache, waiting), None, None, None, None))
                        bucket = b
                    own.append((key, pos, work, last, new, seen))
            if len(out) >= 100_000:
                yield from made()
        if now is not None:
            finish()
        yield from made()

    return run


_MARKS = pa.schema([("kind", pa.string()), ("range", pa.int32()), ("bucket", pa.int64()), ("key", pa.string()), ("pos", pa.int64()), ("work", pa.int64()), ("flag", pa.bool_()), ("asks", pa.bool_())])


@dataclass
class CacheStats:
    hits: int = 0
    misses: int = 0
    size: int = 0

    def __str__(self) -> str:
        return f"Hits: {self.hits} Misses: {self.misses} Size: {self.size}"

    def hit_rate(self, mode: str = "intended") -> float | None:
        """Wired, the division is of whole numbers."""
        asked = self.hits + self.misses
        if not asked:
            return None
        return self.hits // asked * 1.0 if mode == "wired" else self.hits / asked


@dataclass
class MemoCache:
    """State, admission filter and results that wait, as Parquet under ``folder``, for buckets that come one after another.

    A bucket writes what it changes: entries that are new or were touched, keys that
    the filter sees for the first time, and which entries were evicted. The state
    is the last word on each key; it is read once for a bucket's probe, and once more
    if something has to go, and after ``compact_every`` buckets written anew as one table.
    Bucket b starts from what version b - 1 refers to, whether that was made by this
    object or before a restart; a bucket that is run again starts from there
    again. A version counts once its manifest is there, which is written last;
    tables are deleted when no bucket can start from them any more.
    """

    spark: SparkSession
    folder: str
    capacity: int = 4_194_304
    policy: str = "lru"
    bloom: bool = False
    compact_every: int = 16
    stats: CacheStats = field(default_factory=CacheStats)

    def __post_init__(self):
        self.folder = self.folder.rstrip("/")
        self.clear(keep_stats=True)
        self.bucket = 0

    def clear(self, keep_stats: bool = True) -> None:
        """Forget all entries and known keys; the counters stay unless asked otherwise."""
        self.segments: list[str] = []  # folders of changes below ``folder``, and of keys that the filter knows
        self.known: list[str] = []
        self.referred: dict[int, set[str]] = {}
        self.size = 0
        self.pending: DataFrame | None = None
        if not keep_stats:
            self.stats = CacheStats()

    def _read(self, segments: list[str], schema: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{x}" for x in segments))

    @property
    def state(self) -> DataFrame:
        """The entries: key, value, t, row."""
        last = self._read(self.segments, CHANGES).groupBy("key").agg(F.max_by(F.struct("value", "t", "row", "gone"), "seq").alias("s"))
        return last.where("not s.gone").select("key", "s.value", "s.t", "s.row")

    @property
    def seen(self) -> DataFrame:
        """The keys that the filter knows, each once."""
        return self._read(self.known, "key string")

    def _path(self, bucket: int, name: str = "") -> str:
        return f"{self.folder}/version={bucket}" + f"/{name}" * bool(name)

    def keep(self, df: DataFrame, bucket: int, name: str) -> DataFrame:
        """A table of a bucket's version."""
        df.write.mode("overwrite").parquet(self._path(bucket, name))
        return self.spark.read.schema(df.schema).parquet(self._path(bucket, name))

    def last(self) -> int:
        """The newest bucket whose version is complete; 0 without any."""
        try:
            found = self.spark.read.format("binaryFile").load(f"{self.folder}/version=*/manifest").inputFiles()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        return max((int(x.rsplit("/version=", 1)[1].split("/")[0]) for x in found), default=0)

    def start(self, bucket: int) -> None:
        """Take up the version before ``bucket``, unless it is the one at hand."""
        if self.bucket == bucket - 1:
            return
        if bucket == 1:
            self.__post_init__()
            self.stats = CacheStats()
            return
        self.bucket = bucket - 1
        if self.policy == "none":
            return
        manifest = json.loads(self.spark.read.text(self._path(bucket - 1, "manifest")).first()[0])
        self.segments, self.known, self.size = manifest["segments"], manifest["known"], manifest["size"]
        self.referred = {bucket - 1: {*self.segments, *self.known}}
        self.pending = self.spark.read.schema("key string, value string, pos long").parquet(self._path(bucket - 1, "pending"))
        self.stats = CacheStats(**manifest["stats"])

    def probe(self, rows: DataFrame, bucket: int) -> DataFrame:
        """Add hit and value to a bucket's rows (key, pos), count, touch what was hit, then write the bucket before."""
        self.start(bucket)
        if self.policy == "none":
            return rows.withColumn("hit", F.lit(False)).withColumn("value", F.lit(None).cast("string"))
        held = self._held(rows, bucket)
        found = rows.join(held.select("key", "value").withColumn("_in", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("_in", F.lit(False))).drop("_in")
        if self.bloom:
            found = found.join(self.seen.withColumn("_asks", F.lit(True)), "key", "left").withColumn("_asks", F.coalesce("_asks", F.lit(False)))
        else:
            found = found.withColumn("_asks", F.lit(True))
        found = self.keep(found, bucket, "probed")
        hits, misses = found.agg(F.count_if("hit"), F.count_if(~F.col("hit") & F.col("_asks"))).first()
        self.stats = replace(self.stats, hits=self.stats.hits + hits, misses=self.stats.misses + misses)
        touched = found.where("hit").groupBy("key").agg(F.any_value("value").alias("value"), F.max("pos").alias("row"))
        self._write_pending(touched.select("key", "value", F.lit(2 * (bucket - 1)).cast("long").alias("t"), "row"), held, bucket)
        return found.drop("_asks")

    def _held(self, rows: DataFrame | None, bucket: int) -> DataFrame:
        """What the state has of the keys that a bucket asks for or that wait to be written: the only part of it that a bucket needs."""
        asked = [df.select("key") for df in (rows, self.pending) if df is not None]
        keys = asked[0] if len(asked) == 1 else asked[0].unionByName(asked[1])
        return self.keep(self.state.join(keys.distinct(), "key", "left_semi"), bucket, "held")

    def write(self, results: DataFrame, bucket: int) -> None:
        """Hold a bucket's results (key, value, pos) until the next bucket has been probed; that ends the bucket's version."""
        self.pending = self.keep(results.select("key", "value", "pos"), bucket, "pending")
        self.bucket = bucket
        text = json.dumps({"stats": asdict(self.stats), "segments": self.segments, "known": self.known, "size": self.size})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self._path(bucket, "manifest"))
        self.referred[bucket] = {*self.segments, *self.known}
        old = self.referred.pop(bucket - 2, set()) | self.referred.get(bucket - 1, set())
        for name in old - self.referred[bucket] - self.referred.get(bucket - 1, set()):
            remove(self.spark, f"{self.folder}/{name}")
        for name in ("manifest", "records", "probed", "held", "ranked", "mapped", "pending"):
            remove(self.spark, self._path(bucket - 2, name))

    def _change(self, changes: DataFrame, bucket: int, name: str, gone: bool = False) -> DataFrame:
        """Write changed entries, or evicted ones, as the state's last word on their keys."""
        made = self.keep(changes.select("key", "value", "t", "row", F.lit(gone).alias("gone"), F.lit(2 * bucket + gone).cast("long").alias("seq")), bucket, name)
        self.segments = [*self.segments, f"version={bucket}/{name}"]
        return made

    def _evict(self, bucket: int, name: str) -> None:
        """Down to ``capacity - 1``: what has to go is found by a top-k of about as many rows as a bucket has added."""
        side = (F.col("t").asc(), F.col("row").asc()) if self.policy == "lru" else (F.col("t").desc(), F.col("row").desc())
        self._change(self.state.orderBy(*side).limit(self.size - self.capacity + 1), bucket, name, True)
        self.size = self.capacity - 1

    def _write_pending(self, changes: DataFrame | None, held: DataFrame, bucket: int) -> None:
        """The changes of the probe of ``bucket`` and of the writes of the bucket before it, and what has to be evicted then."""
        if self.pending is not None:
            new = self.pending
            if self.bloom:
                nth = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
                ranked = self.keep(new.withColumn("nth", nth).join(self.seen.withColumn("known", F.lit(True)), "key", "left"), bucket, "ranked")
                self.keep(ranked.where("known is null").select("key").distinct(), bucket, "seen")
                self.known = [*self.known, f"version={bucket}/seen"]
                new = ranked.where("known or nth > 1").select("key", "value", "pos")
            first = new.join(held.select("key"), "key", "left_anti").groupBy("key").agg(F.min("pos").alias("row"), F.min_by("value", "pos").alias("value"))
            first = first.select("key", "value", F.lit(2 * (bucket - 1) + 1).cast("long").alias("t"), "row")
            changes = first if changes is None else changes.unionByName(first)
        if changes is not None:
            self.size += self._change(changes, bucket, "changed").where(F.col("t") == 2 * (bucket - 1) + 1).count()
        if self.size > self.capacity:
            self._evict(bucket, "evicted")
        if len(self.segments) > 2 * self.compact_every:
            whole = self.state
            self.segments = []
            self._change(whole, bucket, "state")
        if len(self.known) > self.compact_every:
            self.keep(self.seen, bucket, "known")
            self.known = [f"version={bucket}/known"]
        self.stats = replace(self.stats, size=self.size)

    def insert(self, entries: DataFrame, bucket: int) -> None:
        """Add entries (key, value, pos) at once, with eviction: at most ``capacity - 1`` stay."""
        first = entries.join(self.state.select("key"), "key", "left_anti").groupBy("key").agg(F.min("pos").alias("row"), F.min_by("value", "pos").alias("value"))
        self.size += self._change(first.select("key", "value", F.lit(2 * bucket + 1).cast("long").alias("t"), "row"), bucket, f"inserted-{uuid.uuid4().hex}").count()
        if self.size >= self.capacity:
            self._evict(bucket, f"evicted-{uuid.uuid4().hex}")
        self.stats = replace(self.stats, size=self.size)

    def fetch(self, keys: DataFrame) -> DataFrame:
        """The entries of the keys that are there; nothing is counted or touched."""
        return self.state.join(keys.select("key").distinct(), "key", "left_semi").select("key", "value")

    def close(self) -> CacheStats:
        """Apply the last bucket's writes, in a version of their own that no bucket starts from."""
        if self.pending is not None and self.policy != "none":
            self._write_pending(None, self._held(None, self.bucket + 1), self.bucket + 1)
        self.bucket = -1  # whatever bucket comes next starts from its version
        return self.stats
