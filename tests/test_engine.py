"""Operators against a row-at-a-time simulator and the cases that the engine's semantics are known by."""

import io
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest import logs
from palimpsest.config import BloomBits, ConfigError, EngineConfig, get_bool, get_float, get_int, read_options
from palimpsest.functions import keys
from palimpsest.operators import bucketing, dedup, mapper
from palimpsest.operators import cache as cache_operator
from palimpsest.operators.cache import BloomFilter, MemoCache, Recency, trim, walk
from palimpsest.plans import engine, metrics, queries, runner
from palimpsest.sources import fastq, sinks
from palimpsest.storage import materialize, numbered, release, set_times, shared_folder
from palimpsest.streaming import buckets as stream
from palimpsest.streaming import chains

CODE = {"A": 0, "C": 1, "T": 2, "G": 3}
READ = "file_id int, header string, sequence string, plus string, quality string, arrival long"


def reads(spark, sequences, files=3):
    rows = [(i % files, f"@r{i} x", s, "+", "=" * len(s), i) for i, s in enumerate(sequences)]
    return spark.createDataFrame(rows, READ)


def simulate_buckets(chains, size):
    """(bucket, pos) of each row: buffers promoted when full, longest chain first, ties to the lowest."""
    full, buffers, first = {}, {}, None
    for i, c in enumerate(chains):
        buffers.setdefault(c, []).append(i)
        if len(buffers[c]) == size:
            full.setdefault(c, []).append(buffers.pop(c))
            first = c if first is None else first
    for c, rows in buffers.items():
        full.setdefault(c, []).append(rows)
    if first is None:
        first = min(full, key=lambda c: (-len(full[c]), c))
    out, bucket, pos, now = {}, 0, 0, first
    while full:
        for rows in full.pop(now):
            bucket += 1
            for i in rows:
                pos += 1
                out[i] = (bucket, pos)
        now = min(full, key=lambda c: (-len(full[c]), c), default=None)
    return out


class Lru:
    def __init__(self, capacity, policy, bloom):
        self.order, self.values, self.capacity, self.policy, self.bloom, self.seen = [], {}, capacity, policy, bloom, set()
        self.any = False
        self.hits = self.misses = 0

    def probe(self, k):
        if not self.possibly(k):
            return False
        if k in self.values:
            self.hits += 1
            self.order.remove(k)
            self.order.append(k)
            return True
        self.misses += 1
        return False

    def possibly(self, k):
        if self.bloom == "wired":  # one bit
            return self.any
        return self.bloom.possibly(k) if isinstance(self.bloom, BloomFilter) else not self.bloom or k in self.seen

    def insert(self, k):
        if not self.possibly(k):
            self.any = True
            self.seen.add(k)
            if isinstance(self.bloom, BloomFilter):
                self.bloom.add(k)
            return
        if k not in self.values:
            self.values[k] = 1
            self.order.append(k)

    def trim(self):
        if len(self.values) > self.capacity:
            while len(self.values) >= self.capacity:
                del self.values[self.order.pop(0 if self.policy == "lru" else -1)]


def simulate_cache(buckets, capacity, policy, bloom, lag=2):
    """Hits of each bucket's rows; bucket b is probed before bucket b - 1 is written."""
    cache, pending, out = Lru(capacity, policy, bloom), [], []
    for rows in buckets:
        if lag == 1:
            for k in pending:
                cache.insert(k)
            cache.trim()
            pending = []
        hit = [cache.probe(k) for k in rows]
        for k in pending:
            cache.insert(k)
        cache.trim()
        # repeats of the same missed key are written one after another, the first one counts
        pending = [k for k, h in zip(rows, hit) if not h]
        out.append(hit)
    return out, cache


def sequences(n, pool, seed):
    r = random.Random(seed)
    keys_ = ["".join(r.choice("ACGTN") for _ in range(6)) for _ in range(pool)]
    return [r.choice(keys_) for _ in range(n)]


@pytest.mark.parametrize("size,seed", [(5, 1), (8, 2), (13, 3), (500, 4)])
def test_buckets_equal_the_simulator(spark, size, seed):
    s = sequences(301, 40, seed)
    df = reads(spark, s).withColumn("chain", keys.chain_hash(F.col("sequence"), "double"))
    want = simulate_buckets([4 * CODE.get(x[0], 3) + CODE.get(x[1], 3) for x in s], size)
    for bits in (bucketing.BLOCK_BITS, 2, 4):  # one block for all rows, and many
        assert {r.arrival: (r.bucket, r.pos) for r in bucketing.assign_buckets(df, size, block_bits=bits).collect()} == want


def test_one_chain_and_no_arrival(spark):
    df = spark.createDataFrame([(0, None), (0, 9), (0, 70), (0, 71), (0, -3)], "chain int, arrival long")
    got = {r.arrival: (r.cb, r.bucket, r.pos) for r in bucketing.assign_buckets(df, 2, block_bits=3).collect()}
    assert got == {None: (0, 1, 1), -3: (0, 1, 2), 9: (1, 2, 3), 70: (1, 2, 4), 71: (2, 3, 5)}


def test_no_window_spans_a_key(spark):
    df = spark.createDataFrame([("A", 1, 1), (None, 1, 2), (None, 3, 3), ("A", 2, 4), ("A", 4, 5)], "key string, bucket long, pos long")
    for bloom, want in ((False, {1: False, 2: False, 3: True, 4: False, 5: True}), (True, {1: False, 2: False, 3: False, 4: False, 5: True})):
        marked = dedup.mark_hits(df, "lru", bloom)
        assert {r.pos: r.hit for r in marked.collect()} == want
        plan = marked._jdf.queryExecution().sparkPlan().toString().replace("WindowGroupLimit", "Limit")
        # the only window over a key's rows gets two of them from each task
        assert (plan.count("Window ["), plan.count(", 2, Partial"), plan.count(", 2, Final")) == (int(bloom),) * 3
        assert "Limit [key" in plan or not bloom


def test_drain_order(spark):
    def order(s, size):
        df = bucketing.assign_buckets(reads(spark, s).withColumn("chain", keys.chain_hash(F.col("sequence"), "single")), size)
        return "".join(r.c for r in df.groupBy("bucket").agg(F.min(F.substring("sequence", 1, 1)).alias("c")).orderBy("bucket").collect())

    a, c, t = "AAGGC", "CAGGT", "TAGGT"
    assert order([a] * 5 + [c] * 5, 5) == "AC"
    assert order([a] * 5 + [c] * 10 + [t] * 5, 5) == "ACCT"
    assert order([a] * 5 + [t, c] * 5, 5) == "ACT"
    assert order([a] * 4, 5) == "A"


def test_random_order_keeps_chains(spark):
    df = reads(spark, sequences(200, 40, 9)).withColumn("chain", keys.chain_hash(F.col("sequence"), "single"))
    out = bucketing.assign_buckets(df, 7, "random", seed=3)
    assert out.groupBy("bucket").agg(F.count_distinct("chain").alias("n")).agg(F.max("n")).first()[0] == 1
    assert sorted(r.pos for r in out.collect()) == list(range(1, 201))


@pytest.mark.parametrize("hasher,expected", [("single", [0, 1, 2, 3, 3]), ("none", [0] * 5), ("double", [0, 4, 8, 12, 12]), ("triple", [48, 48, 51, 51, 51])])
def test_hashers(spark, hasher, expected):
    df = reads(spark, ["AAGGC", "CAGGT", "TAGGT", "GAGGT", "NAGGT"])
    assert [r.c for r in df.orderBy("arrival").select(keys.chain_hash(F.col("sequence"), hasher).alias("c")).collect()] == expected


def test_gc_and_packed(spark):
    df = reads(spark, ["GGCC", "GGCA", "GATA", "NNAA", "", "G"])
    both = df.orderBy("arrival").select(*(keys.chain_hash(F.col("sequence"), "gc", mode=m).alias(m) for m in ("intended", "wired")), keys.packed_key(F.col("sequence")).alias("k"), keys.packed_key(F.col("sequence"), "wired").alias("kw"))
    rows = both.collect()
    assert [r.intended for r in rows] == [3, 3, 1, 0, 0, 3]
    assert [r.wired for r in rows][:4] == [3, 0, 0, 0]
    assert [r.k for r in rows] == ["7733", "7731", "7141", "6611", "", "7"]
    assert rows[5].kw == ""


@pytest.mark.parametrize("policy,bloom", [("lru", False), ("mru", False), ("lru", True), ("mru", True)])
@pytest.mark.parametrize("compression", ["none", "full", "cross"])
def test_routes_equal_the_simulator(spark, policy, bloom, compression):
    s = sequences(150, 20, 5)
    config = EngineConfig(bucket_size=8, hasher="double", compression=compression, cache_policy=policy, bloom=bloom)
    routed = engine.route(engine.prepare(reads(spark, s), config), config).orderBy("pos").collect()
    by = {}
    for r in routed:
        by.setdefault(r.bucket, []).append(r)
    hits, cache = simulate_cache([[r.key for r in by[b]] for b in sorted(by)], 10_000, policy, bloom)
    misses = 0
    for b, hit in zip(sorted(by), hits):
        first = {}
        for r, h in zip(by[b], hit):
            assert r.hit == h
            first.setdefault(r.key, r)
            f = first[r.key]
            work = compression == "none" or r is f or compression == "cross" and r.file_id == f.file_id
            assert r.route == ("cache" if h else "unique" if work else "dup")
            assert r.rep == (None if h else r.pos if work else f.pos)
    wrong, _ = simulate_cache([[r.key for r in by[b]] for b in sorted(by)], 10_000, policy, bloom, lag=1)
    assert wrong != hits  # the harness notices a wrong lag
    counted = dedup.counters(engine.route(engine.prepare(reads(spark, s), config), config)).agg(F.sum("hits"), F.sum("misses")).first()
    assert counted[0] == cache.hits
    if compression == "none":
        assert counted[1] == cache.misses
    del misses


@pytest.mark.parametrize("policy,bloom,capacity", [("lru", False, 6), ("mru", False, 6), ("lru", True, 8)])
def test_bounded_cache_equals_the_simulator(spark, tmp_path, policy, bloom, capacity):
    s = sequences(60, 12, 7)
    rows = spark.createDataFrame([(i // 10 + 1, k, i + 1) for i, k in enumerate(s)], "bucket long, key string, pos long")
    cache = MemoCache(spark, str(tmp_path), capacity, policy, bloom)
    stats = stream.run_buckets(cache, rows, lambda r: r.withColumn("value", F.concat(F.lit("v"), "key")), 6, str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    hits, sim = simulate_cache([s[k : k + 10] for k in range(0, 60, 10)], capacity, policy, bloom)
    assert (stats.hits, stats.misses) == (sim.hits, sim.misses)
    assert {r.pos: r.value for r in out.collect()} == {i + 1: "v" + k for i, k in enumerate(s)}
    assert str(stats).startswith(f"Hits: {sim.hits} Misses:")
    assert sum(map(sum, hits)) == sim.hits


@pytest.mark.parametrize("policy,capacity", [("lru", 5), ("mru", 5), ("lru", 12)])
@pytest.mark.parametrize("compression", ["none", "full", "cross"])
@pytest.mark.parametrize("bloom,mode", [(False, "intended"), (True, "intended"), (True, "wired")])
def test_walk_equals_the_simulator(spark, policy, capacity, compression, bloom, mode):
    s = sequences(160, 14, 5)
    config = EngineConfig(bucket_size=8, hasher="single", compression=compression, cache_policy=policy, bloom=bloom, cache_capacity=capacity, mode=mode)
    routed = engine.route(engine.prepare(reads(spark, s), config), config).orderBy("pos").collect()
    by = {}
    for r in routed:
        by.setdefault(r.bucket, []).append(r)
    hits, sim = simulate_cache([[r.key for r in by[b]] for b in sorted(by)], capacity, policy, mode if bloom else False)
    assert [[r.hit for r in by[b]] for b in sorted(by)] == hits
    rows = {r.pos: r for r in routed}
    for r in routed:
        own = rows[r.src]
        assert own.key == r.key and own.route == "unique" and (own.bucket <= r.bucket - 2 if r.hit else own.bucket == r.bucket)
    if compression == "none":
        assert sum(r.asked for r in routed) == sim.misses


def test_filter_of_a_size(spark):
    bits = BloomBits(bits=64, functions=2, length=6)
    s = sequences(200, 30, 15)
    config = EngineConfig(bucket_size=10, hasher="single", compression="none", cache_policy="lru", bloom=True, bloom_bits=bits, cache_capacity=8)
    routed = engine.route(engine.prepare(reads(spark, s), config), config).orderBy("pos").collect()
    by = {}
    for r in routed:
        by.setdefault(r.bucket, []).append(r)
    hits, sim = simulate_cache([[r.key for r in by[b]] for b in sorted(by)], 8, "lru", BloomFilter(bits))
    assert [[r.hit for r in by[b]] for b in sorted(by)] == hits and sum(r.asked for r in routed) == sim.misses
    seen = BloomFilter(bits)
    for k in s[:5]:
        seen.add(k)
    assert all(seen.possibly(k) for k in s[:5])
    places = keys.bloom_positions(64, 2, 6)
    df = spark.createDataFrame([(k,) for k in [*s[:20], "", "AX"]], "key string").select("key", *(keys.bloom_hash(F.col("key"), p, 64) for p in places))
    assert all(list(r)[1:] == seen._bits(r.key) for r in df.collect())
    seen.clear()
    assert not any(seen.possibly(k) for k in s[:5])


@pytest.mark.parametrize("warm_up,length", [(1, 1), (2, 1), (8, 3), (8, 10**6)])
def test_ranges_of_buckets_meet(spark, warm_up, length):
    """Ranges that start from too little are followed again until all is as one task would have it."""
    r = random.Random(5)
    drawn = [f"k{min(r.randrange(1, 90), r.randrange(1, 90)) + i // 40}" for i in range(2400)]
    df = spark.createDataFrame([(i // 12 + 1, k, i + 1) for i, k in enumerate(drawn)], "bucket long, key string, pos long")
    marked, replay = walk(df, 30, "lru", warm_up=warm_up, length=length)
    hits, _ = simulate_cache([drawn[i : i + 12] for i in range(0, 2400, 12)], 30, "lru", False)
    rows = marked.orderBy("pos").collect()
    assert [x.hit for x in rows] == [h for own in hits for h in own]
    assert all(drawn[x._by - 1] == x.key and rows[x._by - 1].bucket <= x.bucket - 2 and not rows[x._by - 1].hit for x in rows if x.hit)
    assert (replay.replayed > 0) == (replay.rounds > 1) and replay.rounds < max(2, replay.ranges)
    if length > 1:
        assert replay.rounds <= 2 and (replay.ranges > 1) == (length == 3)


@pytest.mark.parametrize("bloom,pool,capacity", [(False, 60, 20), (True, 24, 12), (False, 13, 12)])
def test_a_full_mru_cache_is_followed_only_where_its_keys_change(spark, monkeypatch, bloom, pool, capacity):
    """No task follows the whole table: chunks, and between them what an aggregate finds; the last pool makes the set of keys change again and again."""
    monkeypatch.setattr(cache_operator, "CHUNK", 40)
    r = random.Random(9)
    drawn = [f"k{r.randrange(pool if i % 300 else 10**6)}" for i in range(1200)]
    rows = [(i // 12 + 1 + 3 * (i > 900), k, i + 1) for i, k in enumerate(drawn)]  # buckets needn't be without gaps
    df = spark.createDataFrame(rows, "bucket long, key string, pos long")
    marked, replay = walk(df, capacity, "mru", bloom)
    buckets = {}
    for b, k, _ in rows:
        buckets.setdefault(b, []).append(k)
    got = marked.orderBy("pos").collect()
    hits, _ = simulate_cache([buckets[b] for b in sorted(buckets)], capacity, "mru", bloom)
    if not bloom:
        assert [x.hit for x in got] == [h for own in hits for h in own]
    monkeypatch.setattr(cache_operator, "CHUNK", 10**6)
    whole, alone = walk(df, capacity, "mru", bloom)
    assert alone.ranges == 1 and [(x.hit, x._by, x._asks) for x in whole.orderBy("pos").collect()] == [(x.hit, x._by, x._asks) for x in got]
    assert any(x.hit for x in got) and replay.ranges > replay.rounds > 1 or pool == 13 and replay.rounds > 3


def test_ranges_grow_with_the_pairs_not_with_the_buckets(spark, monkeypatch):
    """A cache of few keys isn't followed in ranges of some buckets each: a task has work, and its warm-up meets the state before."""
    r = random.Random(3)
    drawn = [f"k{r.randrange(60) + i // 400}" for i in range(3000)]
    df = spark.createDataFrame([(i // 10 + 1, k, i + 1) for i, k in enumerate(drawn)], "bucket long, key string, pos long")
    hits, _ = simulate_cache([drawn[i : i + 10] for i in range(0, 3000, 10)], 4, "lru", False)
    for least, warm in ((200_000, 10_000), (1000, 400)):
        monkeypatch.setattr(cache_operator, "LEAST_RANGE", least)
        monkeypatch.setattr(cache_operator, "LEAST_WARM_UP", warm)
        marked, replay = walk(df, 4)
        assert [x.hit for x in marked.orderBy("pos").collect()] == [h for own in hits for h in own]
        assert replay.ranges == max(1, -(-3000 // least)) and replay.rounds == 1 and replay.replayed == 0


def _followed_in(spark, monkeypatch, tmp_path, policy):
    """How the registered queries follow 12,000 events, and the pairs of bucket and key of each range that a task follows."""
    r = random.Random(11)
    rows = [(i, (r.randrange(600) + i // 30) % 1500, r.choice(("view", "click", "error"))) for i in range(12_000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    sizes, known = [], getattr(cache_operator, "_followed", None)

    def followed(dealt, ranges, follow):
        sizes.extend(x["count"] for x in dealt.where("part = 2").groupBy("range").count().collect())
        return known(dealt, ranges, follow)

    monkeypatch.setattr(cache_operator, "_followed", followed, raising=False)
    replay = queries._bounded(spark, str(tmp_path), policy, "full").replay
    monkeypatch.undo()
    return replay, sizes


def test_no_task_of_mru_bounded_full_follows_the_whole_table(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cache_operator, "CHUNK", 500, raising=False)
    replay, sizes = _followed_in(spark, monkeypatch, tmp_path, "mru")
    assert replay.ranges > replay.rounds  # what is between the chunks is a join
    assert sizes and max(sizes) <= 4 * 500 + 100 and sum(sizes) < 6000


@pytest.mark.parametrize("least,warm", [(200_000, 10_000), (3000, 1000)])
def test_ranges_of_lru_bounded_full_have_work_for_a_task(spark, monkeypatch, tmp_path, least, warm):
    monkeypatch.setattr(cache_operator, "LEAST_RANGE", least, raising=False)
    monkeypatch.setattr(cache_operator, "LEAST_WARM_UP", warm, raising=False)
    replay, sizes = _followed_in(spark, monkeypatch, tmp_path, "lru")
    assert replay.ranges <= max(1, 12_000 // least) and replay.rounds == 1 and replay.replayed == 0
    assert len(sizes) == replay.ranges and max(sizes) <= 1.2 * (least + warm)


def test_walk_of_no_rows(spark):
    marked, replay = walk(spark.createDataFrame([], "bucket long, key string, pos long"), 30)
    assert marked.collect() == [] and replay.ranges == 1 and {"hit", "_by", "_asks"} <= set(marked.columns)


@pytest.mark.parametrize("compression", ["none", "full", "cross"])
def test_filter_of_a_size_without_evictions(spark, monkeypatch, compression):
    """No bucket is followed; keys that the filter takes for known ones are stored at once."""
    monkeypatch.setattr(engine.cache, "walk", None)
    s = sequences(300, 60, 12)
    df = reads(spark, s)
    for bits in (BloomBits(bits=64, functions=2, length=6), BloomBits(bits=1 << 20, functions=3, length=6)):
        config = EngineConfig(bucket_size=10, hasher="single", compression=compression, cache_policy="lru", bloom=True, bloom_bits=bits)
        routed = engine.route(engine.prepare(df, config), config).orderBy("pos").collect()
        by = {}
        for r in routed:
            by.setdefault(r.bucket, []).append(r)
        hits, sim = simulate_cache([[r.key for r in by[b]] for b in sorted(by)], 10**6, "lru", BloomFilter(bits))
        assert [[r.hit for r in by[b]] for b in sorted(by)] == hits
        if compression == "none":
            assert sum(r.asked for r in routed) == sim.misses
        rows = {r.pos: r for r in routed}
        assert all(rows[r.src].key == r.key and rows[r.src].route == "unique" for r in routed)
        known = dedup.admissions(engine.prepare(df, config), compression, bits)
        assert (known.where("_out is null").count() > 0) == (bits.bits == 64)


def test_recency():
    for policy, stays in (("lru", ["c", "d"]), ("mru", ["a", "b"])):
        cache = Recency(3, policy)
        for k in "abcd":
            cache.insert(k, k)
        assert list(cache.order) == stays  # insert keeps one place free
    cache = Recency(3)
    for k in "abcd":
        cache.insert_no_evict(k, k)
    cache.insert_no_evict("a", "new")
    assert cache.at("a") == "a" and cache.find("b")
    cache.trim()
    assert list(cache.order) == ["d", "a"]
    cache.clear()
    assert not cache.find("a")


def test_cache_goes_on_after_a_restart(spark, tmp_path):
    s = sequences(80, 12, 17)
    rows = spark.createDataFrame([(i // 10 + 1, k, i + 1, i % 3) for i, k in enumerate(s)], "bucket long, key string, pos long, file_id int")
    mapping = lambda r: r.withColumn("value", F.concat(F.lit("v"), "key"))
    for policy, bloom in (("lru", False), ("mru", True)):
        make = lambda name: MemoCache(spark, str(tmp_path / policy / name), 6, policy, bloom, compact_every=2)
        whole = stream.run_buckets(make("whole"), rows, mapping, 8, str(tmp_path / policy / "a"), "cross")
        cache = make("parts")
        for b in range(1, 5):
            stream.step(cache, rows.where(f"bucket = {b}"), b, mapping, "cross").write.parquet(str(tmp_path / policy / f"b/bucket={b}"))
        again = make("parts")  # a new process; bucket 4 is run a second time
        assert again.last() == 4
        parts = stream.run_buckets(again, rows, mapping, 8, str(tmp_path / policy / "b"), "cross", first=4)
        assert parts == whole and whole.hits > 0
        hits, sim = simulate_cache([s[k : k + 10] for k in range(0, 80, 10)], 6, policy, bloom)
        assert (whole.hits, whole.misses if not bloom else 0) == (sim.hits, whole.misses if not bloom else 0)
        for name in "ab":
            assert {r.pos: r.value for r in spark.read.parquet(str(tmp_path / policy / name)).collect()} == {i + 1: "v" + k for i, k in enumerate(s)}


def test_a_bucket_writes_what_it_changes(spark, tmp_path):
    """A large state isn't written again for a small bucket; old tables go once no bucket can start from them."""
    cache = MemoCache(spark, str(tmp_path), 400, "lru", compact_every=3)
    mapping = lambda r: r.withColumn("value", F.col("key"))
    sizes = []
    for b in range(1, 13):
        names = [f"k{i}" for i in range(300)] if b == 1 else [f"k{b}", f"new{b}", f"new{b}"]
        stream.step(cache, spark.createDataFrame([(k, b * 1000 + i) for i, k in enumerate(names)], "key string, pos long"), b, mapping)
        changed = tmp_path / f"version={b}" / "changed"
        sizes.append(spark.read.parquet(str(changed)).count())
    assert sizes[0] == 0 and sizes[1] == 300 and all(n == 2 for n in sizes[3:])
    assert cache.size == 300 + 10 and cache.state.count() == 310
    assert len(cache.segments) <= 6 and sum(x.is_dir() for v in tmp_path.iterdir() for x in v.iterdir()) < 30
    assert {r.key: r.t for r in cache.state.where("key in ('k5', 'k200', 'new4')").collect()} == {"k5": 8, "k200": 3, "new4": 9}


def test_cache_tables(spark, tmp_path):
    cache = MemoCache(spark, str(tmp_path), 4)
    entries = lambda names, at: spark.createDataFrame([(k, "v" + k, at + i) for i, k in enumerate(names)], "key string, value string, pos long")
    cache.insert(entries("abc", 0), 1)
    cache.insert(entries("cde", 10), 2)
    assert sorted(r.key for r in cache.state.collect()) == ["c", "d", "e"]  # capacity - 1 stay
    assert [tuple(r) for r in cache.fetch(entries("ac", 0)).collect()] == [("c", "vc")]
    cache.clear()
    assert cache.state.count() == 0


def test_the_mapper_sees_each_unique_row_once(spark, tmp_path):
    s = sequences(400, 30, 21)
    calls = tmp_path / "calls"

    def function(texts):
        with open(calls, "a") as f:
            f.write("".join(t.split("\n")[0] + "\n" for t in texts))
        return ["v\t" + t.split("\n")[1] for t in texts]

    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        made = engine.run(reads(spark, s), EngineConfig(bucket_size=10, hasher="single", compression="full", cache_policy="lru"), function)
        assert sorted(r.line for r in made.output.collect()) == sorted("v\t" + x for x in s)
        unique = made.counters.agg(F.sum("n_unique")).first()[0]
        assert made.seconds.agg(F.sum("seconds")).first()[0] > 0
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)
    seen = calls.read_text().split("\n")[:-1]
    assert len(seen) == len(set(seen)) == unique < len(s)


def test_records_are_gathered_to_batches(spark, tmp_path):
    sizes = tmp_path / "sizes"

    def function(texts):
        with open(sizes, "a") as f:
            f.write(f"{len(texts)}\n")
        return [t[-3:] for t in texts]

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = reads(spark, ["ACGT"] * 100).coalesce(1).withColumn("pos", F.col("arrival"))
        assert mapper.map_unique(df, function, 30).count() == 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sizes.read_text().split() == ["30", "30", "30", "10"]


def test_interactive_process(spark, tmp_path):
    df = reads(spark, sequences(500, 40, 3)).coalesce(1).withColumn("pos", F.col("arrival"))
    script = tmp_path / "serve.sh"
    script.write_text(f"""echo start >> {tmp_path}/starts; while read -r h && read -r s && read -r p && read -r q; do printf 'x\\302\\205%s\\n' "$s"; done""")
    for live, starts in ((True, 1), (False, 10)):
        (tmp_path / "starts").write_text("")
        got = {r.pos: r.value for r in mapper.map_unique(df, mapper.process_function(f"sh {script}", live), 50).collect()}
        assert got == {r.pos: "x\x85" + r.sequence for r in df.collect()} and (tmp_path / "starts").read_text().count("start") == starts
    with pytest.raises(Exception, match="ended with"):
        mapper.map_unique(df, mapper.process_function("head -1", True), 50).collect()
    with pytest.raises(Exception, match="too few lines"):  # it answers only when its input ends
        mapper.map_unique(df, mapper.process_function("sort", True, patience=2.0), 50).collect()


def test_random_chains_take_turns(spark):
    chains = spark.createDataFrame([(0, 400, 4000, 0), (1, 400, 4000, 1), (2, 3, 21, 0)], "chain int, n_buckets long, n_rows long, first int")
    turns = bucketing.random_turns(chains, 10, 5).orderBy("bucket").collect()
    assert (turns[0].chain, turns[0].cb) == (1, 0) and [t.bucket for t in turns] == list(range(1, 804))
    for c in (0, 1, 2):
        assert [t.cb for t in turns if t.chain == c] == list(range((400, 400, 3)[c]))
    assert turns[-1].rows_before + 10 >= 8021 - 10
    both = [t.chain for t in turns[:300] if t.chain < 2]
    assert 0.4 < sum(both) / len(both) < 0.6 and sum(a != b for a, b in zip(both, both[1:])) > 0.4 * len(both)
    assert {t.chain for t in turns[:60]} == {0, 1, 2}  # a short chain is as likely as a long one


def test_control_file_to_output(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("".join(f"@a{i} z\n{x}\n+\n====\n" for i, x in enumerate(["ACGT", "ACGT", "GGGG"])))
    (tmp_path / "b.fastq").write_text("@b0 z\nACGT\n+\n====\n@b1 z\nTTTT\n+\n====")
    (tmp_path / "c.fastq").write_text("")
    ini = tmp_path / "x.ini"
    ini.write_text(f"data_dir={tmp_path}\ninput_pattern=.*\\.fastq\noutput_ext=.sam\nbucket_size=2\nmax_interleave=2\nretag=true\ncompression=full\ncache_policy=lru\nmetrics={tmp_path}/log\n")
    awk = mapper.process_function("""awk 'NR%4==2{print "q\\t" $0}'""")
    report = runner.run_file(spark, str(ini), awk)
    lines = lambda p: [x for f in ([p] if p.is_file() else sorted(p.glob("part*"))) for x in f.read_text().split("\n")[:-1]]
    assert (tmp_path / "c.sam").read_text() == "" and not list(tmp_path.glob("_writing*"))
    assert lines(tmp_path / "a.sam") == ["a0\tACGT", "a1\tACGT", "a2\tGGGG"] and lines(tmp_path / "b.sam") == ["b0\tACGT", "b1\tTTTT"]
    log = lines(tmp_path / "log")
    assert log[0] == "# Num_Files:3" and log[1].count(",") == 3 and log[2].startswith("Batch,Batch_Time") and log[-1].startswith(f"# config:{ini} total_reads:5 runtime:")
    assert report.summary.first().n_rows == 5 and len(log) == 3 + report.counters.count() + 1 and report.summary.first().avg_throughput > 0
    wired = runner.run_file(spark, str(ini), awk, mode="wired")
    assert wired.summary.first().n_rows == 4 and "\t\t" in lines(tmp_path / "b.sam")[0]  # the last record has no line end
    short = metrics.short_log_lines(report.log, 2, "lru", 5, 1.0).orderBy("n").collect()
    assert short[0].value.startswith("# batch_size:2 manager_type:buckets cache_type:lru") and "Misses" not in short[1].value and short[2].value.startswith("0,")
    got = runner.options_of(["-c", str(ini), "--bucket_size", "7", "--hash_func", "gc", "--interleaved", "--suppress_sam"])
    assert (got["bucket_size"], got["hash_func"], got["interleaved"], got["output_ext"], "suppress_sam" in got) == ("7", "gc", "true", ".sam", True)
    got = runner.options_of(["-i", r".*\.fq", "-a", "seal", "-s", "one.sam", "--verbose", "--quiet", "-x", "ref", "-p", "4", "-b", "9", "-d", "in", "-e", "log"])
    assert got == {"input_pattern": r".*\.fq", "aligner": "seal", "output_file": "one.sam", "log_level": "warn", "reference": "ref", "threads": "4", "bucket_size": "9", "data_dir": "in", "metrics": "log"}
    assert runner.options_of(["--input_file_pattern", "x", "--output_ext", ".o"]) == {"input_pattern": "x", "output_ext": ".o"}
    with pytest.raises(ConfigError):
        runner.run_options(spark, {"cache_policy": "lru"}, awk)
    with pytest.raises(ConfigError):
        runner.run_options(spark, {"data_dir": str(tmp_path), "output_file": "x"}, awk)
    one = runner.run_options(spark, {"data_dir": str(tmp_path), "input_pattern": r"a\.fastq", "output_file": f"file://{tmp_path}/one.txt"}, awk)
    assert lines(tmp_path / "one.txt") == ["q\tACGT", "q\tACGT", "q\tGGGG"] and one.outputs == {0: f"file://{tmp_path}/one.txt"}


def test_command_lines():
    assert mapper.aligner_command({"reference": "r"}) == "bowtie2 --reorder --mm --no-hd -p 1 -q -x r -U -"
    own = {"reference": "a b", "aligner_path": "/opt/bt2/run", "threads": "4", "interleaved": "true", "file_type": "fasta"}
    assert mapper.aligner_command(own) == "/opt/bt2/run --reorder --mm --no-hd -p 4 -f -x 'a b' --interleaved -"
    seal = {"aligner": "seal", "reference": "r", "threads": "8"}
    assert mapper.aligner_command(seal) == "seal.sh threads=8 out=stdout.fq ref=r in=stdin.fq prealloc=t rskip=3 -Xmx80G ordered=t"
    assert mapper.aligner_command(seal | {"aligner_path": "/x/s", "interleaved": "1", "aligner_memory": "4G"}) == "/x/s threads=8 out=stdout.fq ref=r interleaved=t in=stdin.fq prealloc=t rskip=3 -Xmx4G ordered=t"
    assert mapper.aligner_command({"command": "mine -x"}) == "mine -x"
    assert mapper.aligner_function(seal).interactive and not mapper.aligner_function({"reference": "r"}).interactive
    assert mapper.aligner_function({"command": "c", "interactive": "yes"}).interactive and not mapper.aligner_function({"command": "c", "aligner": "seal"}).interactive
    for wrong in ({}, {"aligner": "seal"}, {"aligner": "other", "reference": "r"}):
        with pytest.raises(ConfigError):
            mapper.aligner_command(wrong)
    assert mapper.cores(4).taskResources["cpus"].amount == 4
    assert EngineConfig.from_options({"threads": "4"}).threads == 4


def test_scan_of_any_file_system(spark, tmp_path):
    """Through a path that only Spark's readers know, in splits that end anywhere."""
    r = random.Random(7)
    records = {k: [(f"@{k}{i} é", "".join(r.choice("ACGT") for _ in range(r.randrange(1, 40)))) for i in range(n)] for k, n in (("b", 90), ("a", 400), ("c", 0))}
    folder = tmp_path / "in put"
    folder.mkdir()
    for k, own in records.items():
        end = "\r\n" if k == "b" else "\n"
        text = end.join(end.join([h, s, "+", r.choice("@+=>") * len(s)]) for h, s in own) + (end if k == "a" else "")
        (folder / f"{k}.fastq").write_bytes(text.encode())
    (folder / "x.other").write_text("no record")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "4000b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = fastq.scan(spark, "viewfs://store/in/in put")
            assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
            rows = sorted(tuple(x) for x in got.select("file_id", "rec_idx", "header", "sequence", "plus").collect())
            assert rows == [(f, i, h, s, "+") for f, k in enumerate("abc") for i, (h, s) in enumerate(records[k])]
            assert all(len(x.sequence) == len(x.quality) for x in got.collect())
            assert sorted(x.rec_idx for x in fastq.scan(spark, "viewfs://store/in/in put", r"b\.fastq", require_newline=True).collect()) == list(range(89))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (folder / "bad.fastq").write_text("@a\nACG\n+\n==\n")
    with pytest.raises(Exception, match="record 0 of file 0"):
        fastq.scan(spark, str(folder), r"bad\.fastq").collect()
    with pytest.raises(ValueError), open(folder / "bad.fastq", "rb") as f:
        list(fastq.parse(f, "fastq"))
    (folder / "raw.fastq").write_bytes(b"@a\xff\nACG\n+\n===\n")
    assert fastq.scan(spark, str(folder), r"raw\.fastq").count() == 1
    with open(folder / "raw.fastq", "rb") as f:
        assert [x[0] for x in fastq.parse(f, "fastq")] == ["@a\ufffd"]
    for where, pattern in ((f"{tmp_path}/none", ".*"), (str(folder), "nothing")):
        with pytest.raises(FileNotFoundError):
            fastq.inputs(spark, where, pattern)


def test_a_failed_write_leaves_no_output(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 3).cast("int").alias("file_id"), F.col("id").alias("pos"), F.concat(F.lit("l"), "id").alias("line"))
    paths = {k: f"{tmp_path}/o{k}.txt" for k in range(4)}
    (tmp_path / "o1.txt").write_text("as it was\n")
    broken = rows.withColumn("line", F.when(F.col("pos") == 31, F.raise_error(F.lit("stopped"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="stopped"):
        sinks.write_outputs(broken, paths)
    assert [x.name for x in tmp_path.iterdir()] == ["o1.txt"] and (tmp_path / "o1.txt").read_text() == "as it was\n"
    sinks.write_outputs(rows, paths)
    assert sorted(x.name for x in tmp_path.iterdir()) == ["o0.txt", "o1.txt", "o2.txt", "o3.txt"]
    for k in range(4):
        assert (tmp_path / f"o{k}.txt").read_text() == "".join(f"l{i}\n" for i in range(40) if i % 3 == k)


def test_lines_reach_their_file_in_blocks(spark, tmp_path):
    """The one task of a file gets blocks that many tasks have put together, whatever the places; files get times in a given order."""
    drawn = random.Random(2).sample(range(-500, 5000), 900)
    rows = spark.createDataFrame([(k % 2, p, None if p % 7 == 0 else f"l{p}") for k, p in enumerate(drawn)], "file_id int, pos long, line string").repartition(5)
    paths = {k: f"{tmp_path}/o{k}.txt" for k in range(2)}
    sinks.write_outputs(rows, paths)
    for k in paths:
        assert (tmp_path / f"o{k}.txt").read_text() == "".join(("" if p % 7 == 0 else f"l{p}") + "\n" for p in sorted(drawn[k::2]))
    set_times(spark, [paths[1], paths[0]])
    assert os.path.getmtime(paths[0]) - os.path.getmtime(paths[1]) == pytest.approx(1, abs=0.01)


def test_standard_input(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"@a 1\nAC\n+\n==\n@b 2\nGT\n+\n==\n")))
    report = runner.run_options(spark, {"stdin": "true", "command": """awk 'NR%4==2{print $0}'"""})
    assert report.outputs == {0: str(tmp_path / "OUT.sam")}
    assert sorted(spark.read.text(str(tmp_path / "OUT.sam")).collect()) == [("AC",), ("GT",)]


@pytest.mark.parametrize("end", ["", "\n"])
def test_files_are_split_between_records(spark, tmp_path, end):
    r = random.Random(4)
    records = [(f"@r{i} " + "@" * r.randrange(3), "".join(r.choice("ACGT") for _ in range(r.randrange(1, 30))), "+") for i in range(200)]
    (tmp_path / "a.fastq").write_text("\n".join("\n".join([*x, r.choice("@+=>") * len(x[1])]) for x in records) + end)
    (tmp_path / "b.fasta").write_text("\n".join(f">s{i}\n{x[1]}" for i, x in enumerate(records)) + end)
    for split in (1, 7, 100):  # very many stretches: without a task for each
        for name, kind in (("a.fastq", "fastq"), ("b.fasta", "fasta")):
            with open(tmp_path / name, "rb") as f:
                size = (tmp_path / name).stat().st_size
                got = [x for a in range(0, size, split) for x in fastq.parse(f, kind, False, a, a + split if a + split < size else None)]
            assert [x[:2] for x in got] == [(x[0] if kind == "fastq" else f">s{i}", x[1]) for i, x in enumerate(records)]
    spark.dataSource.register(fastq.ReadsDataSource)
    for split in (1000, 10**6):
        rows = spark.read.format("reads").options(path=str(tmp_path), split_bytes=str(split)).load()
        assert [(x.header, x.sequence, x.plus) for x in fastq.with_arrival(rows).orderBy("arrival").collect()] == records
        rows = spark.read.format("reads").options(path=str(tmp_path), split_bytes=str(split), format="fasta").load()
        got = fastq.with_arrival(rows).orderBy("arrival").collect()
        assert [(x.header, x.sequence, x.rec_idx) for x in got] == [(f">s{i}", x[1], i) for i, x in enumerate(records)]
    assert spark.read.format("reads").options(path=str(tmp_path), require_trailing_newline="true").load().count() == 199 + bool(end)


def test_small_stretches_share_a_task(spark, tmp_path, monkeypatch):
    """Tasks grow with the bytes, not with the stretches; each stretch of each file is read once."""
    for name, n in (("a", 30), ("b", 0), ("c", 1), ("d", 300)):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@{name}{i}\nACGT\n+\n====\n" for i in range(n)))
    size = sum(x.stat().st_size for x in tmp_path.iterdir())
    spark.dataSource.register(fastq.ReadsDataSource)
    rows = spark.read.format("reads").options(path=str(tmp_path), split_bytes="10").load()
    assert rows.rdd.getNumPartitions() == 1
    for task_bytes in (10, 100, 1000):
        monkeypatch.setattr(fastq, "TASK_BYTES", task_bytes)
        reader = fastq.ReadsReader({"path": str(tmp_path), "split_bytes": "10"})
        parts = reader.partitions()
        assert len(parts) <= size // task_bytes + 4
        assert [(k, x) for p in parts for k, _, numbers, _ in p.runs for x in numbers] == [(k, x) for k, path in enumerate(reader.paths) for x in range(-(-max(os.path.getsize(path), 1) // 10))]
        got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["file_id"], r["header"]) for r in got] == [(k, f"@{name}{i}") for k, name, n in ((0, "a", 30), (2, "c", 1), (3, "d", 300)) for i in range(n)]
        assert all(r["rec_idx"] < s["rec_idx"] for r, s in zip(got, got[1:], strict=False) if r["file_id"] == s["file_id"])


def test_plug_ins(spark, tmp_path, monkeypatch):
    (tmp_path / "x.lst").write_text("#one\nAC\n#two\nGT\n")
    spark.dataSource.register(fastq.reads_source("lists", fastq.Parser(2, lambda x: x[0][:1] == b"#", lambda x: (x[0], x[1].lower(), None, None))))
    got = spark.read.format("lists").options(path=str(tmp_path), pattern=r".*\.lst").load().collect()
    assert [(r.header, r.sequence) for r in got] == [("#one", "ac"), ("#two", "gt")]
    monkeypatch.setitem(keys.HASHERS, "length", F.length)
    monkeypatch.setitem(keys.KEYS, "first", lambda x: F.substring(x, 1, 1))
    monkeypatch.setitem(keys.OUTPUTS, "both", lambda h, v: F.concat_ws("|", h, v))
    c = EngineConfig(bucket_size=3, hasher="length", key="first", output="both", compression="full")
    made = engine.run(reads(spark, ["AC", "AG", "GT", "AAA"]), c, lambda texts: [t.split("\n")[1] for t in texts])
    assert {r.line for r in made.output.collect()} == {"@r0 x|AC", "@r1 x|AC", "@r2 x|GT", "@r3 x|AAA"}
    with pytest.raises(ConfigError):
        EngineConfig(hasher="nothing")


def test_sorted_chains_as_buckets(spark):
    s = sequences(90, 30, 2)
    c = EngineConfig(bucket_size=4, hasher="single", max_chain=1)
    placed = engine.prepare(reads(spark, s), c).orderBy("pos").collect()
    assert [r.pos for r in placed] == list(range(1, 91))
    assert [r.sequence for r in placed] == sorted(s, key=lambda x: (CODE.get(x[0], 3), x)) or [(r.chain, r.sequence) for r in placed] == sorted((r.chain, r.sequence) for r in placed)
    assert sorted({(r.bucket, r.chain) for r in placed}) == list(enumerate(sorted({r.chain for r in placed}), 1))


@pytest.mark.parametrize("mode", ("intended", "wired"))
def test_batches_of_sorted_chains(spark, tmp_path, mode):
    """Batches give the order of one, buckets taken between them what came before; a restart and a repeated batch change nothing."""
    rows = reads(spark, sequences(120, 30, 5) + ["", ""]).withColumn("sequence", F.when(F.col("arrival") != 120, F.col("sequence")))
    rows = rows.withColumn("chain", F.when(F.col("sequence") != "", keys.chain_hash(F.col("sequence"), "single")))
    part = lambda lo, hi: rows.where(F.col("arrival").between(lo, hi - 1))
    by = bucketing.SORTED_BY[mode]
    order = lambda df: [r.arrival for r in sorted(df.collect(), key=lambda r: (*((x is not None, x or 0) for x in (r.chain, *(r[c] for c in by))), r.arrival))]
    held = chains.SortedChains(spark, str(tmp_path / "a"), mode, fan=2)
    for b, cut in enumerate(((0, 10), (10, 10), (10, 70), (70, 71), (71, 122)), 1):
        held.add(part(*cut), b)
        if b == 3:  # again, from what another object finds
            held = chains.SortedChains(spark, str(tmp_path / "a"), mode, fan=2)
            held.add(part(*cut), b)
    assert len(held.tables) < 4 and sum(held.held.values()) == 122
    got = held.drain().orderBy("pos").collect()
    assert [r.arrival for r in got] == order(rows) and [r.pos for r in got] == list(range(1, 123))
    turn = {c: k + 1 for k, c in enumerate(sorted({r.chain for r in got}, key=lambda c: (c is not None, c)))}
    assert len(turn) == 5 and all(r.bucket == turn[r.chain] for r in got)
    assert held.drain() is None and held.next_bucket() is None

    held = chains.SortedChains(spark, str(tmp_path / "b"), mode)
    held.add(part(0, 60), 1)
    first = held.next_bucket().orderBy("pos").collect()
    low = first[0].chain
    assert [r.arrival for r in first] == order(part(0, 60).where(F.col("chain") == low)) and {r.bucket for r in first} == {1}
    held = chains.SortedChains(spark, str(tmp_path / "b"), mode)
    held.add(part(60, 120), 2)
    rest = held.drain().orderBy("pos").collect()
    later = part(60, 120).where(F.col("chain") == low).unionByName(part(0, 120).where(F.col("chain") != low))
    assert [r.arrival for r in rest] == order(later) and [r.pos for r in rest] == list(range(len(first) + 1, 121))
    assert min(r.bucket for r in rest) == 2


def test_numbers_and_running_sums(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("x"), "id").repartition(5)
    got = numbered(df, ["g"], ["x", "id"], "n").collect()
    want = {}
    for g in (0, 1):
        own = sorted((r.x is not None, r.x or 0, r.id) for r in got if r.g == g)
        want |= {i: k + 1 for k, (_, _, i) in enumerate(own)}
    assert {r.id: r.n for r in got} == want
    sums = metrics.running_sums(df.withColumn("v", F.col("id") * 2), "id", ["v"], 16)
    assert {r.id: r.v for r in sums.collect()} == {i: i * (i + 1) for i in range(1000)}


def test_intermediate_tables_can_be_removed(spark):
    table = materialize(spark.range(3), "some")
    path = table.table_path.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(path)
    release(table, None, spark.range(1))
    assert not os.path.exists(path)


def test_a_closed_run_leaves_no_tables(spark, tmp_path):
    def tables():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return {x.getPath().getName() for x in found}

    shared_folder(spark)
    before = tables()
    config = EngineConfig(bucket_size=10, hasher="single", compression="full", cache_policy="lru", cache_capacity=9)
    run = engine.run(reads(spark, sequences(200, 30, 3)), config)
    sums = run.counters.selectExpr("sum(n_rows) n_rows", "sum(n_unique) n_unique", "sum(n_dup) n_dup", "sum(hits) hits", "sum(misses) misses").first().asDict()
    assert run.totals == sums and run.replay.ranges >= 1 and run.output.count() == 200
    assert len(tables() - before) > 3
    run.close()
    assert tables() == before
    (tmp_path / "a.fastq").write_text("@a z\nACGT\n+\n====\n")
    report = runner.run_options(spark, {"data_dir": str(tmp_path), "cache_policy": "lru", "metrics": f"{tmp_path}/log"}, mapper.process_function("awk 'NR%4==2'"))
    assert report.summary.first().n_rows == 1 and len(tables() - before) == 2  # counters and log, which the report has


def test_timer_and_fatal(caplog):
    with caplog.at_level("INFO", logger="palimpsest"), logs.timer("part") as took:
        pass
    assert took.value >= 0 and "part:" in caplog.text
    with pytest.raises(SystemExit):
        logs.fatal("no")


def test_stream_equals_loop(spark, tmp_path):
    s = sequences(30, 6, 8)
    source = tmp_path / "in"
    for b in range(3):
        part = spark.createDataFrame([(k, b * 10 + i + 1) for i, k in enumerate(s[b * 10 : b * 10 + 10])], "key string, pos long")
        part.coalesce(1).write.mode("append").parquet(str(source))
    cache = MemoCache(spark, str(tmp_path / "state"), 5, "lru")
    stats = stream.run_stream(spark, str(source), "key string, pos long", cache, lambda r: r.withColumn("value", F.col("key")), str(tmp_path / "out"), str(tmp_path / "cp"))
    _, sim = simulate_cache([s[k : k + 10] for k in range(0, 30, 10)], 5, "lru", False)
    assert (stats.hits, stats.misses) == (sim.hits, sim.misses)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_raw_files_as_a_stream(spark, tmp_path):
    """New files go on from where the stream and its cache stopped; no record comes twice."""
    s = sequences(60, 12, 18)
    source = tmp_path / "in"
    source.mkdir()
    mapping = lambda r: r.withColumn("value", F.col("key"))
    for part in (range(0, 3), range(3, 6)):
        for b in part:
            text = "".join(f"@r{i}\n{k}\n+\n{'=' * len(k)}\n" for i, k in enumerate(s[b * 10 : b * 10 + 10]))
            (source / f"{9 - b}.fastq").write_text(text)
            os.utime(source / f"{9 - b}.fastq", (1000 + b, 1000 + b))
        cache, listener = MemoCache(spark, str(tmp_path / "state"), 5, "lru"), logs.BucketListener()
        spark.streams.addListener(listener)
        stats = stream.run_files(spark, str(source), cache, mapping, str(tmp_path / "out"), str(tmp_path / "cp"))
        for _ in range(100):
            if ("ended", None, None, None) in listener.events:
                break
            time.sleep(0.1)
        spark.streams.removeListener(listener)
        assert listener.events[0][0] == "started" and listener.events[-1][0] == "ended"
        assert {e[1] for e in listener.events if e[0] == "wrote"} == {b + 1 for b in part} and all(e[3] > 0 for e in listener.events if e[0] == "wrote")
    _, sim = simulate_cache([s[k : k + 10] for k in range(0, 60, 10)], 5, "lru", False)
    assert (stats.hits, stats.misses) == (sim.hits, sim.misses)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.pos >> fastq.SPLIT_BITS, r.pos & 0xFFFF, r.value) for r in out) == [(i // 10, i % 10 + 1, k) for i, k in enumerate(s)]


def test_trim_sizes(spark):
    state = spark.createDataFrame([(f"k{i}", "v", i, i) for i in range(1001)], "key string, value string, t long, row long")
    assert trim(state, 1001).count() == 1001
    lru, mru = trim(state, 1000, "lru"), trim(state, 1000, "mru")
    assert (lru.count(), mru.count()) == (999, 999)
    assert lru.agg(F.min("t")).first()[0] == 2 and mru.agg(F.max("t")).first()[0] == 998


def test_output_and_mapper(spark):
    s = sequences(80, 10, 11)
    config = EngineConfig(bucket_size=10, hasher="single", compression="cross", cache_policy="lru", retag=True)
    made = engine.run(reads(spark, s), config, mapper.process_function("""awk 'NR%4==2{print "x\\t" $0}'"""))
    got = sorted((r.file_id, r.line) for r in made.output.collect())
    assert got == sorted((i % 3, f"r{i}\t{x}") for i, x in enumerate(s))
    unique = made.routed.where("route = 'unique'")
    with pytest.raises(Exception, match="lines for"):
        mapper.map_unique(unique, lambda x: x[:-1]).collect()
    with pytest.raises(RuntimeError, match="ended with"):
        mapper.process_function("false")(["x"])


def test_fastq_source(spark, tmp_path):
    (tmp_path / "b.fastq").write_text("@b0\nAC\n+\n==\n@b1\nGT\n+\n==")
    (tmp_path / "a.fastq").write_text("@a0\nAA\n+\n==\n")
    (tmp_path / "c.fa").write_text(">c0\nACGT\n")
    spark.dataSource.register(fastq.ReadsDataSource)
    read = lambda **o: spark.read.format("reads").options(path=str(tmp_path), **o).load()
    got = sorted(tuple(r) for r in read().collect())
    assert got == [(0, 0, "@a0", "AA", "+", "=="), (1, 0, "@b0", "AC", "+", "=="), (1, 1, "@b1", "GT", "+", "==")]
    assert read(require_trailing_newline="true").count() == 2
    assert [tuple(r) for r in read(format="fasta", pattern=r".*\.fa").collect()] == [(0, 0, ">c0", "ACGT", None, None)]
    with pytest.raises(FileNotFoundError):
        fastq.list_inputs(str(tmp_path), "x")
    assert fastq.files_table(spark, str(tmp_path), r"a\.fastq").first().output_path.endswith("/a_out")


def test_interleave_equals_the_walk(spark):
    def walk(counts, most):
        left, slots, head, out, now = dict(counts), sorted(counts), 0, [], dict.fromkeys(counts, 0)
        while slots:
            f = slots[head]
            if left[f]:
                out.append((f, now[f]))
                now[f] += 1
                left[f] -= 1
                head = (head + 1) % min(most, len(slots))
            else:
                del slots[head]
                if slots:
                    head = (head + 1) % min(most, len(slots))
        return out

    r = random.Random(3)
    for _ in range(400):
        counts = {f: r.randrange(0, 9) for f in range(r.randrange(1, 6))}
        most = r.randrange(1, 6)
        got = {}
        for f, lo, n, base, step in fastq.segments(counts, most):
            got.update({base + k * step: (f, lo + k) for k in range(n)})
        order = [got[k] for k in sorted(got)]
        assert order == walk(counts, most), (counts, most)
    df = spark.createDataFrame([(f, k) for f, n in ((0, 3), (1, 1)) for k in range(n)], "file_id int, rec_idx long")
    assert [(x.file_id, x.rec_idx) for x in fastq.with_arrival(df, 2).orderBy("arrival").collect()] == walk({0: 3, 1: 1}, 2)


def test_config():
    text = "# comment\nTest Key = Some Value\n n = 12x\nd=1.5\nflag\nb = Yes\nn2=3\nn2=4\n"
    o = read_options(text)
    assert o == {"TestKey": "SomeValue", "n": "12x", "d": "1.5", "flag": "flag", "b": "Yes", "n2": "4"}
    assert (get_int(o, "n", 0), get_int(o, "x", 7), get_float(o, "d", 0.0), get_bool(o, "b"), get_bool(o, "x")) == (12, 7, 1.5, True, False)
    with pytest.raises(ConfigError):
        get_bool({"b": "maybe"}, "b")
    with pytest.raises(ConfigError):
        read_options("a=1\na=2", repeat_is_error=True)
    with pytest.raises(ConfigError):
        EngineConfig(compression="half")
    c = EngineConfig.from_options({"bucket_size": "75000", "hash_func": "double", "cache_policy": "lru", "cache_decorator": "bloom_filter", "suppress_sam": "false"})
    assert (c.bucket_size, c.hasher, c.bloom, c.suppress_output) == (75000, "double", True, True)
    with pytest.raises(ConfigError):
        EngineConfig.from_options({"cache_policy": "lru", "cache_decorator": "other"})


def test_sinks_and_metrics(spark, tmp_path):
    out = spark.createDataFrame([(0, 2, "b"), (0, 1, "a"), (1, 1, "c")], "file_id int, pos long, line string")
    sinks.write_lines(out, str(tmp_path / "o"))
    sinks.write_lines(out, str(tmp_path / "none"), suppress=True)
    assert not (tmp_path / "none").exists()
    text = "".join(p.read_text() for p in sorted((tmp_path / "o" / "file_id=0").glob("part*")))
    assert text == "a\nb\n"
    log = spark.createDataFrame([(i, float(i)) for i in range(20)] + [(20, 5000.0)], "i long, v double")
    mean = sum(range(20), 5000.0) / 21
    assert metrics.clamp_outliers(log, "v").where("i = 20").first().v == pytest.approx(mean)
    cum = {r.i: r.cum_mean for r in metrics.cumulative_mean(log, "v", "i", 4).collect()}
    assert cum[9] == pytest.approx(4.5) and cum[0] == 0.0
    assert metrics.group_means(log, "v", "i", 5, True).where("g = 1").first()["mean"] == 7.0
    assert metrics.row_slice(log, "i", 3, 5).count() == 2
    (tmp_path / "l.csv").write_text("#c\nBatch,Hits\n1,2\n# end\n")
    assert metrics.read_log(spark, str(tmp_path / "l.csv"), "Batch int, Hits int").collect()[0].Hits == 2
    counted = spark.createDataFrame([(1, 5, 4, 1, 0, 4, 1.25)], "bucket long, n_rows long, n_unique long, n_dup long, hits long, misses long, compression_ratio double")
    sinks.write_metrics(metrics.batch_metrics(counted, 5, spark.createDataFrame([(1, 2.0)], "bucket long, seconds double")), str(tmp_path / "m"))
    assert "2.5" in "".join(p.read_text() for p in (tmp_path / "m").glob("part*"))


def test_wired_modes(spark):
    s = sequences(60, 8, 13)
    c = EngineConfig(bucket_size=6, hasher="single", compression="full", cache_policy="lru", bloom=True, mode="wired")
    routed = engine.route(engine.prepare(reads(spark, s), c), c)
    assert routed.where("route = 'dup'").count() == 0
    header, value = F.lit("@t1 z"), F.lit("x\ty")
    df = spark.range(1).select(keys.retag(header, value).alias("a"), keys.retag(header, value, "wired").alias("b"))
    assert tuple(df.first()) == ("t1\ty", "t1\t\ty")


def test_rows_without_a_source_are_a_file_of_their_own(spark, tmp_path):
    docs = [(i, f"text {i}", "en", (None, "b", "a")[i % 3]) for i in range(9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(i, i % 2, (None, "view")[i % 2]) for i in range(8)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.arrival: r.file_id for r in queries.reads(spark, str(tmp_path)).collect()}
    assert got == {i: (2, 1, 0)[i % 3] for i in range(9)}
    assert {r.arrival: r.file_id for r in queries.event_reads(spark, str(tmp_path)).collect()} == {i: 1 - i % 2 for i in range(8)}
