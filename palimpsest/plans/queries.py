"""Registered queries of the engine's own operators, each with the SQL that it has to equal."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest import config as conf
from palimpsest.config import EngineConfig
from palimpsest.functions import keys
from palimpsest.operators import bucketing, cache, dedup, mapper
from palimpsest.plans import engine, metrics, runner
from palimpsest.sources import fastq, sinks
from palimpsest.sources.fastq import with_arrival
from palimpsest.storage import numbered, set_times, shared_folder
from palimpsest.streaming import buckets, chains

Query = Callable[[SparkSession, str], DataFrame]
B, EVENT_B = 20, 100


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Documents as reads: equal texts are equal sequences; files are the sources by name."""
    docs = _table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    names = docs.select(F.col("source").alias("name")).distinct().withColumn("file_id", (F.dense_rank().over(Window.orderBy(F.col("name").asc_nulls_last())) - 1).cast("int"))
    return docs.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name"))).select(
        "file_id",
        F.concat(F.lit("@d"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang")).alias("header"),
        F.translate(F.md5("text"), "0123456789abcdef", "ACGTNACGTNACGTNA").alias("sequence"),
        F.lit("+").alias("plus"),
        F.lit("=").alias("quality"),
        F.col("doc_id").alias("arrival"),
    )


def event_reads(spark: SparkSession, d: str) -> DataFrame:
    """Events as reads with much repetition: the key is the user."""
    rows = _table(spark, d, "events").select("event_id", "user_id", "event_type")
    names = rows.select(F.col("event_type").alias("name")).distinct().withColumn("file_id", (F.dense_rank().over(Window.orderBy(F.col("name").asc_nulls_last())) - 1).cast("int"))
    user = F.col("user_id").cast("string")
    return rows.join(F.broadcast(names), F.col("event_type").eqNullSafe(F.col("name"))).select(
        "file_id",
        F.concat(F.lit("@e"), F.col("event_id").cast("string")).alias("header"),
        F.translate(F.md5(user), "0123456789abcdef", "ACGTNACGTNACGTNA").alias("sequence"),
        F.lit("+").alias("plus"),
        F.lit("=").alias("quality"),
        F.col("event_id").alias("arrival"),
    )


def code_sql(at: int) -> str:
    return f"(case substr(sequence, {at}, 1) when 'A' then 0 when 'C' then 1 when 'T' then 2 when 'G' then 3 else 3 end)"


CHAIN_SQL = {
    "none": "0",
    "cache_aware": "cast(('0x' || substr(md5(sequence), 1, 8)) as bigint) % 16",
    "single": code_sql(1),
    "double": f"4 * {code_sql(1)} + {code_sql(2)}",
    "triple": f"(case when substr(sequence, 1, 1) in ('A', 'C') then 0 else 3 end) + 4 * {code_sql(2)} + 16 * {code_sql(3)}",
    "gc": "least(3, (4 * length(translate(sequence, 'ATN', ''))) // length(sequence))",
    "gc_wired": "case when length(translate(sequence, 'ATN', '')) = length(sequence) then 3 else 0 end",
}
READS_SQL = """reads as (select cast(dense_rank() over (order by source) - 1 as integer) as file_id, '@d' || doc_id || ' ' || lang as header,
  translate(md5(text), '0123456789abcdef', 'ACGTNACGTNACGTNA') as sequence, doc_id as arrival from documents)"""
EVENTS_SQL = """reads as (select cast(dense_rank() over (order by event_type) - 1 as integer) as file_id, '@e' || event_id as header,
  translate(md5(cast(user_id as varchar)), '0123456789abcdef', 'ACGTNACGTNACGTNA') as sequence, event_id as arrival from events)"""


def buckets_sql(source: str = READS_SQL, hasher: str = "double", size: int = B) -> str:
    return f"""{source}, chained as (select *, sequence as key, cast({CHAIN_SQL[hasher]} as bigint) as chain from reads),
numbered as (select *, row_number() over (partition by chain order by arrival) as rn from chained),
chains as (select chain, ceil(count(*) / {size}) as nb, min(case when rn = {size} then arrival end) as filled from numbered group by chain),
started as (select *, row_number() over (order by filled nulls last, nb desc, chain) = 1 as first from chains),
turns as (select chain, cast(nb as bigint) as nb, row_number() over (order by first desc, nb desc, chain) as cord from started),
bucketed as (select n.*, (rn - 1) // {size} as cb, cord, dense_rank() over (order by cord, (rn - 1) // {size}) as bucket,
  row_number() over (order by cord, rn) as pos from numbered n join turns using (chain))"""


HIT_SQL = {
    "none": "hits as (select *, false as hit from bucketed)",
    "lru": "hits as (select *, bucket >= min(bucket) over (partition by key) + 2 as hit from bucketed)",
    "bloom": """nth as (select *, row_number() over (partition by key order by pos) as nth from bucketed),
hits as (select *, coalesce(bucket >= min(case when nth = 2 then bucket end) over (partition by key) + 2, false) as hit from nth)""",
}
ROUTE_SQL = {
    "none": "routed as (select *, case when hit then 'cache' else 'unique' end as route, case when not hit then pos end as rep from hits)",
    "full": """firsts as (select *, min(pos) over (partition by bucket, key) as f from hits),
routed as (select *, case when hit then 'cache' when pos = f then 'unique' else 'dup' end as route, case when not hit then f end as rep from firsts)""",
    "cross": """firsts as (select *, first_value(pos) over (partition by bucket, key order by pos) as f,
  first_value(file_id) over (partition by bucket, key order by pos) as ff from hits),
routed as (select *, case when hit then 'cache' when file_id = ff then 'unique' else 'dup' end as route,
  case when hit then null when file_id = ff then pos else f end as rep from firsts)""",
}


def bounded_sql(capacity: int, policy: str = "lru", hasher: str = "single", size: int = EVENT_B) -> str:
    """Events and whether each is a hit (``hits``) of a cache that evicts, by recursion over the buckets: ``st`` has the state that bucket b is probed against."""
    side = "desc" if policy == "lru" else "asc"
    return f"""with recursive {buckets_sql(EVENTS_SQL, hasher, size)},
own as materialized (select bucket, key, min(pos) as lo, max(pos) as hi from bucketed group by 1, 2),
st as (
  select cast(1 as bigint) as b, 'none' as kind, cast(null as varchar) as key, cast(0 as bigint) as t, cast(0 as bigint) as row
  union all
  select b, kind, key, t, row from (
    with now as (select b, kind, key, t, row from st),
    cur as (select max(b) as b from now),
    mine as (select own.* from own join cur on own.bucket = cur.b),
    kept as (select s.key, case when m.key is null then s.t else 2 * (s.b - 1) end as t, coalesce(m.hi, s.row) as row
      from now s left join mine m on s.key = m.key where s.kind = 'state'),
    grown as (select key, t, row from kept
      union all select w.key, 2 * (w.b - 1) + 1, w.row from now w where w.kind = 'wait' and w.key not in (select key from kept)),
    ranked as (select *, row_number() over (order by t {side}, row {side}) as rank, count(*) over () as n from grown)
    select cur.b + 1 as b, 'none' as kind, null as key, 0 as t, 0 as row from cur where cur.b <= (select max(bucket) from own) + 1
    union all select cur.b + 1, 'state', key, t, row from ranked, cur where (n <= {capacity} or rank < {capacity}) and cur.b <= (select max(bucket) from own) + 1
    union all select cur.b + 1, 'wait', m.key, 0, m.lo from mine m, cur where m.key not in (select key from now where kind = 'state')
  )
), hits as (select p.*, s.key is not null as hit from bucketed p left join st s on s.b = p.bucket and s.key = p.key and s.kind = 'state')"""


def routed_sql(compression: str, policy: str = "lru", source: str = READS_SQL, size: int = B) -> str:
    return f"with {buckets_sql(source, 'double', size)}, {HIT_SQL[policy]}, {ROUTE_SQL[compression]}"


def _config(compression: str = "full", policy: str = "lru", size: int = B, **more) -> EngineConfig:
    return EngineConfig(bucket_size=size, hasher="double", compression=compression, cache_policy="none" if policy == "none" else "lru", bloom=policy == "bloom", **more)


def _routed(spark, d, compression, policy="lru", source=reads, size=B) -> DataFrame:
    c = _config(compression, policy, size)
    return engine.route(engine.prepare(source(spark, d), c), c)


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


for _name, _hasher, _mode in (
    ("hash_prefix", "single", "intended"), ("hash_double", "double", "intended"), ("hash_triple", "triple", "intended"),
    ("hash_gc", "gc", "intended"), ("hash_gc_wired", "gc", "wired"), ("hash_md5mod", "cache_aware", "intended"), ("hash_none", "none", "intended"),
):
    register(
        _name,
        lambda s, d, h=_hasher, m=_mode: reads(s, d).select("arrival", keys.chain_hash(F.col("sequence"), h, mode=m).alias("chain")),
        f"with {READS_SQL} select arrival, cast({CHAIN_SQL['gc_wired' if _mode == 'wired' else _hasher]} as integer) as chain from reads",
    )
for _mode, _text in (("intended", "sequence"), ("wired", "substr(sequence, 1, length(sequence) - length(sequence) % 2)")):
    register(
        "key_packed" + "_wired" * (_mode == "wired"),
        lambda s, d, m=_mode: reads(s, d).select("arrival", keys.packed_key(F.col("sequence"), m).alias("key")),
        f"with {READS_SQL} select arrival, translate({_text}, 'ACGTN', '13746') as key from reads",
    )
_placed = ("arrival", "chain", "cb", "bucket", "pos")
register(
    "bucket_assign",
    lambda s, d: engine.prepare(reads(s, d), _config()).select(*_placed),
    f"with {buckets_sql()} select arrival, cast(chain as integer) as chain, cast(cb as bigint) as cb, cast(bucket as bigint) as bucket, cast(pos as bigint) as pos from bucketed",
)
register(
    "chain_order",
    lambda s, d: engine.prepare(reads(s, d), _config()).groupBy("chain").agg(F.count_distinct("bucket").alias("n_buckets"), F.min("bucket").alias("first_bucket")),
    f"with {buckets_sql()} select cast(chain as integer) as chain, count(distinct bucket) as n_buckets, cast(min(bucket) as bigint) as first_bucket from bucketed group by chain",
)


def _random_order(s: SparkSession, d: str) -> DataFrame:
    """What any random order has to keep: each chain's buckets in their own order and whole, the starting chain first."""
    p = engine.prepare(reads(s, d), _config(chain_order="random", seed=5))
    b = p.groupBy("chain", "cb").agg(F.min("bucket").alias("b"), F.max("bucket").alias("last"), F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    before = F.lag("b").over(Window.partitionBy("chain").orderBy("cb"))  # a row for each bucket
    b = b.withColumn("fine", (F.coalesce(before, F.lit(0)) < F.col("b")) & (F.col("b") == F.col("last")) & (F.col("hi") - F.col("lo") + 1 == F.col("n")))
    return b.groupBy("chain").agg(F.count("*").alias("n_buckets"), F.sum("n").alias("n_rows"), F.bool_and("fine").alias("in_order"), (F.min("b") == 1).alias("starts"))


register(
    "random_order",
    _random_order,
    f"with {buckets_sql()} select cast(chain as integer) as chain, count(distinct bucket) as n_buckets, count(*) as n_rows, true as in_order, min(cord) = 1 as starts from bucketed group by chain",
)
register(
    "bucket_arrival",
    lambda s, d: bucketing.assign_arrival_buckets(reads(s, d), B).select("arrival", "bucket", "pos"),
    f"with {READS_SQL} select arrival, cast(arrival // {B} + 1 as bigint) as bucket, arrival + 1 as pos from reads",
)
for _mode, _by in (("intended", "sequence, file_id, header, arrival"), ("wired", "file_id, header, sequence, arrival")):
    register(
        "sorted_chain" + "_wired" * (_mode == "wired"),
        lambda s, d, m=_mode: bucketing.sorted_chain(reads(s, d).withColumn("chain", keys.chain_hash(F.col("sequence"), "double")), m).select("arrival", "bucket", "pos"),
        f"with {READS_SQL}, c as (select *, {CHAIN_SQL['double']} as chain from reads) select arrival, cast(chain + 1 as bigint) as bucket, row_number() over (partition by chain order by {_by}) as pos from c",
    )
for _c in ("none", "full", "cross"):
    register(
        f"route_{_c}",
        lambda s, d, c=_c: _routed(s, d, c).select("arrival", "bucket", "route", F.coalesce("rep", F.lit(0)).alias("rep")),
        f"{routed_sql(_c)} select arrival, cast(bucket as bigint) as bucket, route, cast(coalesce(rep, 0) as bigint) as rep from routed",
    )
    for _p, _asked in (("lru", "true"), ("bloom", "bucket >= min(bucket) over (partition by key) + 2")):
        _first = "true" if _c == "none" else "pos = min(pos) over (partition by bucket, key)"
        register(
            f"counters_{_c}" + "_bloom" * (_p == "bloom"),
            lambda s, d, c=_c, p=_p: dedup.counters(_routed(s, d, c, p, event_reads, EVENT_B)),
            f"""{routed_sql(_c, _p, EVENTS_SQL, EVENT_B)}, asked as (select *, not hit and {_first} and {_asked} as asked from routed)
select cast(bucket as bigint) as bucket, count(*) as n_rows, count(*) filter (where route = 'unique') as n_unique, count(*) filter (where route = 'dup') as n_dup,
count(*) filter (where hit) as hits, count(*) filter (where asked) as misses,
count(*) / nullif(cast(count(*) filter (where route = 'unique') as double), 0) as compression_ratio from asked group by bucket""",
        )
for _name, _p in (("memo_plain", "lru"), ("memo_bloom", "bloom")):
    register(
        _name,
        lambda s, d, p=_p: _routed(s, d, "none", p).select("arrival", "bucket", "hit"),
        f"{routed_sql('none', _p)} select arrival, cast(bucket as bigint) as bucket, hit from routed",
    )
register(
    "memo_events",
    lambda s, d: _routed(s, d, "cross", "lru", event_reads, EVENT_B).groupBy("file_id", "route").agg(F.count("*").alias("n")),
    f"{routed_sql('cross', 'lru', EVENTS_SQL, EVENT_B)} select file_id, route, count(*) as n from routed group by file_id, route",
)
_value_sql = "'ref' || chr(9) || substr(md5(sequence), 1, 8) || chr(9) || length(sequence)"
register(
    "demux_output",
    lambda s, d: engine.run(reads(s, d), _config()).output.select("file_id", "pos", "line"),
    f"{routed_sql('full')} select file_id, cast(pos as bigint) as pos, {_value_sql} as line from routed",
)
register(
    "demux_cross",
    lambda s, d: engine.run(event_reads(s, d), _config("cross", size=EVENT_B)).output.select("file_id", "pos", "line"),
    f"{routed_sql('cross', 'lru', EVENTS_SQL, EVENT_B)} select file_id, cast(pos as bigint) as pos, {_value_sql} as line from routed",
)
for _mode, _tabs in (("intended", "chr(9)"), ("wired", "chr(9) || chr(9)")):
    register(
        "retag_output" + "_wired" * (_mode == "wired"),
        lambda s, d, m=_mode: engine.run(reads(s, d), _config(retag=True, mode=m)).output.select("file_id", "pos", "line"),
        f"{routed_sql('full')} select file_id, cast(pos as bigint) as pos, regexp_extract(header, '^.([^ ]*)', 1) || {_tabs} || substr(md5(sequence), 1, 8) || chr(9) || length(sequence) as line from routed",
    )
register(
    "compression_ratio",
    lambda s, d: metrics.summary(dedup.counters(_routed(s, d, "full"))).select("n_rows", "n_unique", keys.ratio(F.col("n_rows"), F.col("n_unique")).alias("ratio")),
    f"{routed_sql('full')} select count(*) as n_rows, count(*) filter (where route = 'unique') as n_unique, count(*) / cast(count(*) filter (where route = 'unique') as double) as ratio from routed",
)
register(
    "metrics_log",
    lambda s, d: metrics.batch_metrics(dedup.counters(_routed(s, d, "full")), B).select("Batch", "Hits", "Misses", "Reads_Aligned", "Compression_Ratio"),
    f"""{routed_sql('full')}, asked as (select *, not hit and pos = min(pos) over (partition by bucket, key) as asked from routed),
c as (select bucket, count(*) as n, count(*) filter (where hit) as h, count(*) filter (where asked) as m, count(*) filter (where route = 'unique') as u from asked group by bucket)
select cast(bucket as bigint) as Batch, cast(sum(h) over w as bigint) as Hits, cast(sum(m) over w as bigint) as Misses, cast(sum(u) over w as bigint) as Reads_Aligned,
n / nullif(cast(u as double), 0) as Compression_Ratio from c window w as (order by bucket)""",
)
register(
    "run_summary",
    lambda s, d: metrics.summary(dedup.counters(_routed(s, d, "cross", "lru", event_reads, EVENT_B))).drop("avg_throughput"),
    f"""{routed_sql('cross', 'lru', EVENTS_SQL, EVENT_B)}, asked as (select *, not hit and pos = min(pos) over (partition by bucket, key) as asked from routed)
select count(*) as n_rows, count(*) filter (where route = 'unique') as n_unique, count(*) filter (where route = 'dup') as n_dup, count(*) filter (where hit) as hits,
count(*) filter (where asked) as misses, count(*) filter (where hit) / cast(count(*) filter (where hit) + count(*) filter (where asked) as double) as hit_rate from asked""",
)


def _numbered(s: SparkSession, d: str) -> DataFrame:
    """Event reads with their record number inside the file."""
    own = Window.partitionBy("file_id").orderBy("arrival")
    return event_reads(s, d).select("file_id", F.col("arrival").alias("event_id"), (F.row_number().over(own) - 1).cast("long").alias("rec_idx"))


def _even(s: SparkSession, d: str) -> DataFrame:
    """All events dealt to five files of equal length."""
    event = F.col("event_id")
    return _table(s, d, "events").select(event, F.pmod(event, F.lit(5)).cast("int").alias("file_id"), F.floor(event / 5).cast("long").alias("rec_idx"))


_rec_sql = f"with {EVENTS_SQL}, n as (select file_id, arrival as event_id, row_number() over (partition by file_id order by arrival) - 1 as rec_idx from reads)"
register(
    "interleave_seq",
    lambda s, d: with_arrival(_numbered(s, d), 1).select("event_id", "arrival"),
    f"{_rec_sql} select event_id, row_number() over (order by file_id, rec_idx) - 1 as arrival from n",
)
register(
    "interleave_equal",
    lambda s, d: with_arrival(_even(s, d), 5).select("event_id", "arrival"),
    "select event_id, row_number() over (order by event_id // 5, event_id % 5) - 1 as arrival from events",
)
# one read after another: each open file in turn; a file is seen to have ended when it is read once more, and the files after it move up
register(
    "interleave_general",
    lambda s, d: with_arrival(_numbered(s, d), 3).select("event_id", "arrival"),
    f"""with recursive {_rec_sql.removeprefix('with ')},
w as (
  select cast(0 as bigint) as done, -1 as file_id, cast(-1 as bigint) as rec_idx, 0 as head, list({{'f': file_id, 'n': n, 'k': cast(0 as bigint)}} order by file_id) as s
  from (select file_id, count(*) as n from n group by file_id)
  union all
  select case when s[head + 1].n > 0 then done + 1 else done end, case when s[head + 1].n > 0 then s[head + 1].f else -1 end, s[head + 1].k,
    case when s[head + 1].n > 0 then (head + 1) % least(3, len(s)) when len(s) > 1 then (head + 1) % least(3, len(s) - 1) else 0 end,
    list_concat(s[1:head], case when s[head + 1].n > 0 then [{{'f': s[head + 1].f, 'n': s[head + 1].n - 1, 'k': s[head + 1].k + 1}}] else [] end, s[head + 2:])
  from w where len(s) > 0
) select n.event_id, w.done - 1 as arrival from w join n using (file_id, rec_idx)""",
)
for _policy, _dir in (("lru", "desc"), ("mru", "asc")):
    register(
        f"{_policy}_trim",
        lambda s, d, p=_policy: cache.trim(
            event_reads(s, d).groupBy(F.col("sequence").alias("key")).agg(F.max(F.floor(F.col("arrival") / EVENT_B)).cast("long").alias("t"), F.max("arrival").alias("row")), 40, p
        ),
        f"with {EVENTS_SQL}, k as (select sequence as key, cast(max(arrival // {EVENT_B}) as bigint) as t, max(arrival) as row from reads group by 1) "
        f"select * from k where (select count(*) from k) <= 40 or key in (select key from k order by t {_dir}, row {_dir} limit 39)",
    )


def _log(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "events").select(F.col("event_id").alias("i"), F.col("value").alias("v"))


register(
    "throughput_cummean",
    lambda s, d: metrics.cumulative_mean(_log(s, d), "v", "i", 1000).select("i", F.round(F.col("cum_mean") + 3.7e-9, 6).alias("cum_mean")),  # the small offset keeps halves from rounding either way
    "select event_id as i, round(avg(value) over (order by event_id) + 3.7e-9, 6) as cum_mean from events",
)
register("log_slice", lambda s, d: metrics.row_slice(_log(s, d), "i", 10, 390).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean")), "select count(*) as n, round(avg(value), 6) as mean from events where event_id >= 10 and event_id < 390")
register("mean5", lambda s, d: metrics.group_means(_log(s, d), "v", "i", 5, True).select("g", F.round("mean", 6).alias("mean")), "select cast(event_id // 5 as bigint) as g, round(avg(value), 6) as mean from events where event_id >= 5 group by 1")
register("clamp", lambda s, d: metrics.clamp_outliers(_log(s, d), "v", 50.0).select("i", F.round("v", 6).alias("v")), "select event_id as i, round(case when value > avg(value) over () + 50 then avg(value) over () else value end, 6) as v from events")
register(
    "sorted_output",
    lambda s, d: numbered(engine.run(reads(s, d), _config()).output.select("file_id", "pos", "line"), ["file_id"], ["pos"], "n").select("file_id", "n", "line"),
    f"{routed_sql('full')} select file_id, row_number() over (partition by file_id order by pos) as n, {_value_sql} as line from routed",
)
register(
    "record_text",
    lambda s, d: reads(s, d).select("arrival", keys.record_text(F.col("header"), F.col("sequence"), F.col("plus"), F.col("quality")).alias("text")),
    f"with {READS_SQL} select arrival, header || chr(10) || sequence || chr(10) || '+' || chr(10) || '=' as text from reads",
)


# caches that are not there, or evict, or err
register(
    "cache_none",
    lambda s, d: dedup.counters(_routed(s, d, "full", "none", event_reads, EVENT_B)),
    f"""{routed_sql('full', 'none', EVENTS_SQL, EVENT_B)} select cast(bucket as bigint) as bucket, count(*) as n_rows, count(*) filter (where route = 'unique') as n_unique,
count(*) filter (where route = 'dup') as n_dup, cast(0 as bigint) as hits, cast(0 as bigint) as misses, count(*) / cast(count(*) filter (where route = 'unique') as double) as compression_ratio
from routed group by bucket""",
)


def _wired(s: SparkSession, d: str) -> DataFrame:
    c = _config("full", "bloom", EVENT_B, mode="wired")
    return engine.route(engine.prepare(event_reads(s, d), c), c)


_wired_sql = f"""with {buckets_sql(EVENTS_SQL, 'double', EVENT_B)},
hits as (select *, coalesce(bucket >= min(case when pos > 1 then bucket end) over (partition by key) + 2, false) as hit from bucketed)"""
register(
    "bloom_wired",
    lambda s, d: _wired(s, d).select("arrival", "bucket", "route", "asked"),
    f"{_wired_sql} select arrival, cast(bucket as bigint) as bucket, case when hit then 'cache' else 'unique' end as route, not hit and bucket >= 3 as asked from hits",
)
CAPACITY = 30


def _bounded(s: SparkSession, d: str, policy: str, compression: str = "none") -> DataFrame:
    c = EngineConfig(bucket_size=EVENT_B, hasher="single", compression=compression, cache_policy=policy, cache_capacity=CAPACITY)
    return engine.route(engine.prepare(event_reads(s, d), c), c)


for _policy in ("lru", "mru"):
    register(
        f"{_policy}_bounded",
        lambda s, d, p=_policy: _bounded(s, d, p).select("arrival", "bucket", "hit"),
        f"{bounded_sql(CAPACITY, _policy)} select arrival, cast(bucket as bigint) as bucket, hit from hits",
    )
    register(
        f"{_policy}_bounded_full",
        lambda s, d, p=_policy: dedup.counters(_bounded(s, d, p, "full")).drop("compression_ratio"),
        f"""{bounded_sql(CAPACITY, _policy)}, f as (select *, pos = min(pos) over (partition by bucket, key) as first from hits)
select cast(bucket as bigint) as bucket, count(*) as n_rows, count(*) filter (where not hit and first) as n_unique, count(*) filter (where not hit and not first) as n_dup,
count(*) filter (where hit) as hits, count(*) filter (where not hit and first) as misses from f group by bucket""",
    )
PLACES = keys.bloom_positions(1 << 16, 2, 32)
#: small enough that it takes unknown keys for known ones
SIZED = conf.BloomBits(bits=1 << 9, functions=2, length=32)


def _sized(s: SparkSession, d: str) -> DataFrame:
    c = EngineConfig(bucket_size=EVENT_B, hasher="double", compression="cross", cache_policy="lru", bloom=True, bloom_bits=SIZED)
    return engine.route(engine.prepare(event_reads(s, d), c), c)


_code_sql = "(case substr(sequence, {}, 1) when 'A' then 0 when 'C' then 1 when 'G' then 2 when 'T' then 3 when 'N' then 4 else 7 end) * cast({} as bigint)"
register(
    "bloom_hash",
    lambda s, d: reads(s, d).select("arrival", *(keys.bloom_hash(F.col("sequence"), p, 1 << 16).alias(f"bit{k}") for k, p in enumerate(PLACES))),
    f"with {READS_SQL} select arrival, " + ", ".join("(" + " + ".join(_code_sql.format(x + 1, 8**i) for i, x in enumerate(p)) + f") % {1 << 16} as bit{k}" for k, p in enumerate(PLACES)) + " from reads",
)
_sized_bits = ", ".join("(" + " + ".join(_code_sql.format(x + 1, 8**i) for i, x in enumerate(p)) + f") % {SIZED.bits}" for p in keys.bloom_positions(SIZED.bits, SIZED.functions, SIZED.length, SIZED.seed))
_sized_sql = f"""with {buckets_sql(EVENTS_SQL, 'double', EVENT_B)},
nth as (select *, row_number() over (partition by key order by pos) as nth from bucketed),
bit as (select key, pos, bucket, unnest([{_sized_bits}]) as bit from nth where nth = 1),
first as (select bit, min(pos) as pos, min(bucket) as bucket from bit group by bit),
known as (select b.key, any_value(b.pos) as p1, max(f.pos) as known, max(f.bucket) as seen from bit b join first f using (bit) group by b.key),
h as (select n.*, k.p1, k.known, k.seen, min(case when n.nth = case when k.known = k.p1 then 2 else 1 end then n.bucket end) over (partition by n.key) as stored from nth n join known k using (key)),
hits as (select *, coalesce(bucket >= stored + 2, false) as hit from h), {ROUTE_SQL['cross']}"""
register(
    "bloom_sized",
    lambda s, d: _sized(s, d).select("arrival", "bucket", "route", F.coalesce("rep", F.lit(0)).alias("rep"), "asked"),
    f"""{_sized_sql} select arrival, cast(bucket as bigint) as bucket, route, cast(coalesce(rep, 0) as bigint) as rep,
not hit and bucket >= seen + 2 and pos = min(pos) over (partition by bucket, key) as asked from routed""",
)
register(
    "bloom_sized_errors",
    lambda s, d: (k := dedup.admissions(engine.prepare(event_reads(s, d), EngineConfig(bucket_size=EVENT_B, hasher="double")), "none", SIZED)).agg(
        F.count("*").alias("n_keys"), F.count_if(F.col("_out").isNull()).alias("n_taken_for_known"), F.sum("_seen").alias("seen_from")
    ),
    f"{_sized_sql} select count(*) as n_keys, count(*) filter (where known < p1) as n_taken_for_known, cast(sum(seen) as bigint) as seen_from from known",
)
register(
    "hit_rate_wired",
    lambda s, d: metrics.summary(dedup.counters(_wired(s, d)), 2.0, "wired").select("hits", "misses", "hit_rate", "avg_throughput"),
    f"""{_wired_sql} select count(*) filter (where hit) as hits, count(*) filter (where not hit and bucket >= 3) as misses,
floor(count(*) filter (where hit) / cast(count(*) filter (where hit or bucket >= 3) as double)) as hit_rate, count(*) / 2.0 as avg_throughput from hits""",
)
register(
    "log_throughput",
    lambda s, d: metrics.batch_metrics(
        (c := dedup.counters(_routed(s, d, "none"))), B, c.select("bucket", (F.col("bucket") / 8).alias("seconds"))
    ).select("Batch", "Batch_Time", "Throughput"),
    f"with {buckets_sql()} select distinct cast(bucket as bigint) as Batch, bucket / 8 as Batch_Time, {B} / (bucket / 8) as Throughput from bucketed",
)


def _stream(s: SparkSession, d: str, raw: bool = False) -> DataFrame:
    """Six buckets as six files, one micro-batch each, through the cache that lives in tables: its counters at the end. ``raw``: FASTQ files."""
    rows = event_reads(s, d).withColumns({"key": F.col("sequence"), "pos": F.col("arrival") + 1})
    size = -(-rows.count() // 6)
    folder = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    line = keys.record_text(F.col("header"), F.col("sequence"), F.col("plus"), F.repeat(F.lit("="), F.length("sequence")))
    if raw:  # all files at once, a task each; their times say in which order they come
        files = {b: f"{folder}/in/{b}.fastq" for b in range(6)}
        sinks.write_outputs(rows.select(F.floor((F.col("pos") - 1) / size).cast("int").alias("file_id"), "pos", line.alias("line")), files)
        set_times(s, list(files.values()))
    else:
        for b in range(6):
            own = rows.where((F.col("pos") > b * size) & (F.col("pos") <= (b + 1) * size))
            own.select("key", "pos").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    cache_ = cache.MemoCache(s, f"{folder}/cache", CAPACITY, "lru")
    mapping = lambda r: r.select("pos", mapper.stand_in(F.col("key")).alias("value"))
    places = f"{folder}/out", f"{folder}/checkpoint"
    stats = buckets.run_files(s, f"{folder}/in", cache_, mapping, *places) if raw else buckets.run_stream(s, f"{folder}/in", "key string, pos long", cache_, mapping, *places)
    done = s.read.parquet(f"{folder}/out").agg(F.count("value").alias("answered"), F.count_distinct("pos").alias("rows"))
    return done.select("answered", "rows", F.lit(stats.hits).cast("long").alias("hits"), F.lit(stats.misses).cast("long").alias("misses"), F.lit(stats.size).cast("long").alias("size"))


def six_buckets_sql(policy: str) -> str:
    sql = bounded_sql(CAPACITY, policy, "none", EVENT_B).replace(f"(rn - 1) // {EVENT_B}", "(rn - 1) // (select cast(ceil(count(*) / 6) as bigint) from reads)")
    return sql.replace(f"count(*) / {EVENT_B}", "count(*) / (select ceil(count(*) / 6) from reads)")


_stream_sql = (
    six_buckets_sql("lru")
    + """ select count(*) as answered, count(*) as rows, count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses,
(select count(*) from st where kind = 'state' and b = (select max(b) from st)) as size from hits"""
)
register("lru_stream", _stream, _stream_sql)
register("lru_stream_fastq", lambda s, d: _stream(s, d, True), _stream_sql)


def _stats(s: SparkSession, d: str) -> DataFrame:
    """What the counters of an MRU cache in tables say after six buckets of a table."""
    rows = event_reads(s, d).select(F.col("sequence").alias("key"), (F.col("arrival") + 1).alias("pos"))
    size = -(-rows.count() // 6)
    folder = f"{shared_folder(s)}/stats-{uuid.uuid4().hex}"
    rows = rows.withColumn("bucket", F.floor((F.col("pos") - 1) / size) + 1)
    cache_ = cache.MemoCache(s, f"{folder}/cache", CAPACITY, "mru")
    stats = buckets.run_buckets(cache_, rows, lambda r: r.select("pos", mapper.stand_in(F.col("key")).alias("value")), 6, f"{folder}/out")
    return s.read.parquet(f"{folder}/out").agg(F.count("value").alias("answered"), F.lit(str(stats)).alias("stats"))


register(
    "cache_stats",
    _stats,
    six_buckets_sql("mru")
    + """ select count(*) as answered, 'Hits: ' || count(*) filter (where hit) || ' Misses: ' || count(*) filter (where not hit)
|| ' Size: ' || (select count(*) from st where kind = 'state' and b = (select max(b) from st)) as stats from hits""",
)


def _insert(s: SparkSession, d: str) -> DataFrame:
    """Entries put into an LRU cache in three lots, outside of any bucket: each lot adds the keys that aren't there, then the oldest go."""
    rows = event_reads(s, d).select(F.col("sequence").alias("key"), F.col("header").alias("value"), (F.col("arrival") + 1).alias("pos"))
    size = -(-rows.count() // 3)
    cache_ = cache.MemoCache(s, f"{shared_folder(s)}/insert-{uuid.uuid4().hex}", CAPACITY, "lru")
    for lot in range(3):
        cache_.insert(rows.where((F.col("pos") > lot * size) & (F.col("pos") <= (lot + 1) * size)), lot + 1)
    return cache_.state


_lots = ["lot0 as (select key, value, t, row from (select '' as key, '' as value, 0 as t, 0 as row) where false)"]
for _k in (1, 2, 3):
    _lots.append(f"""new{_k} as (select key, arg_min(value, pos) as value, {2 * _k + 1} as t, min(pos) as row from e where lot = {_k} and key not in (select key from lot{_k - 1}) group by key),
all{_k} as (select * from lot{_k - 1} union all select * from new{_k}),
lot{_k} as (select key, value, t, row from (select *, row_number() over (order by t desc, row desc) as rank, count(*) over () as n from all{_k}) where n < {CAPACITY} or rank < {CAPACITY})""")
register(
    "cache_insert",
    _insert,
    f"""with {EVENTS_SQL}, e as (select sequence as key, header as value, arrival + 1 as pos,
arrival // (select cast(ceil(count(*) / 3) as bigint) from reads) + 1 as lot from reads), {", ".join(_lots)}
select key, value, cast(t as bigint) as t, cast(row as bigint) as row from lot3""",
)


def _chain_stream(s: SparkSession, d: str) -> DataFrame:
    """The reads as five files, a batch each, into sorted chains; then the buckets of all chains."""
    rows = reads(s, d).withColumn("chain", keys.chain_hash(F.col("sequence"), "double"))
    folder = f"{shared_folder(s)}/chains-{uuid.uuid4().hex}"
    rows.repartition(5).write.parquet(f"{folder}/in")
    held = chains.SortedChains(s, f"{folder}/held", fan=2)
    chains.run_stream(s, f"{folder}/in", rows.schema, held, f"{folder}/checkpoint")
    return held.drain().select("arrival", "chain", "bucket", "pos")


register(
    "sorted_chain_stream",
    _chain_stream,
    f"""with {READS_SQL}, c as (select *, cast({CHAIN_SQL["double"]} as integer) as chain from reads)
select arrival, chain, dense_rank() over (order by chain) as bucket, row_number() over (order by chain, sequence, file_id, header, arrival) as pos from c""",
)


# files: written by the query, read again
def _fastq_folder(s: SparkSession, d: str, kind: str = "fastq") -> str:
    """The documents' reads as a file for each source, named by its number, in a new folder."""
    rows = reads(s, d)
    folder = f"{shared_folder(s)}/inputs-{uuid.uuid4().hex}"
    four = [F.col(c) for c in ("header", "sequence", "plus")]
    quality = F.repeat(F.lit("="), F.length("sequence"))
    text = keys.record_text(*four, quality) if kind == "fastq" else F.concat_ws("\n", *four[:2])
    ids = [r.file_id for r in rows.select("file_id").distinct().collect()]
    sinks.write_outputs(rows.select("file_id", F.col("arrival").alias("pos"), text.alias("line")), {k: f"{folder}/f{k:03d}.{kind}" for k in ids})
    return folder


def _scan(s: SparkSession, d: str, kind: str = "fastq") -> DataFrame:
    return fastq.scan(s, _fastq_folder(s, d, kind), kind=kind)


def _source(s: SparkSession, d: str, **options) -> DataFrame:
    """The same by the data source, which needs a folder that all nodes see by one path."""
    s.dataSource.register(fastq.ReadsDataSource)
    return s.read.format("reads").options(path=_fastq_folder(s, d).removeprefix("file://").removeprefix("file:"), **options).load()


_rec = "cast(row_number() over (partition by file_id order by arrival) - 1 as bigint) as rec_idx"
_four_sql = "header, sequence, '+' as plus, repeat('=', length(sequence)) as quality"
register("scan_fastq", _scan, f"with {READS_SQL} select file_id, {_rec}, {_four_sql} from reads")
register("scan_source", _source, f"with {READS_SQL} select file_id, {_rec}, {_four_sql} from reads")
register(
    "scan_fasta",
    lambda s, d: _scan(s, d, "fasta").select("file_id", "rec_idx", "header", "sequence", F.col("plus").isNull().alias("no_plus")),
    f"with {READS_SQL} select file_id, {_rec}, header, sequence, true as no_plus from reads",
)
register(
    "scan_splits",
    lambda s, d: with_arrival(_source(s, d, split_bytes="1000"), 1).select("file_id", "rec_idx", "arrival", "header", "sequence"),
    f"with {READS_SQL} select file_id, {_rec}, row_number() over (order by file_id, arrival) - 1 as arrival, header, sequence from reads",
)


def _stdin(s: SparkSession, d: str) -> DataFrame:
    """All files by standard input's way: one after another through a stream, then read as the only input."""
    folder = _fastq_folder(s, d)
    paths = [x for x, _ in fastq.inputs(s, folder, r".*\.fastq")]
    with _Joined(paths) as stream:
        fastq.spool(f"{folder}/stdin", "fastq", stream)
    return fastq.scan(s, f"{folder}/stdin").select("file_id", "rec_idx", "header", "sequence")


class _Joined:
    """Files read one after another, as from a pipe."""

    def __init__(self, paths: list[str]):
        self.paths, self.now = list(paths), None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.now:
            self.now.close()

    def read(self, size: int) -> bytes:
        while self.now or self.paths:
            if not self.now:
                system, place = sinks.file_system(self.paths.pop(0))
                self.now = system.open_input_stream(place)
            if part := self.now.read(size):
                return part
            self.now = self.now.close()
        return b""


register(
    "scan_stdin",
    _stdin,
    f"with {READS_SQL} select 0 as file_id, cast(row_number() over (order by file_id, arrival) - 1 as bigint) as rec_idx, header, sequence from reads",
)
register(
    "list_inputs",
    lambda s, d: fastq.files_table(s, _fastq_folder(s, d), r"f[0-9]+\.fastq", ".sam").select("file_id", F.substring_index("path", "/", -1).alias("name"), F.substring_index("output_path", "/", -1).alias("output")),
    f"with {READS_SQL} select distinct file_id, 'f' || lpad(cast(file_id as varchar), 3, '0') || '.fastq' as name, 'f' || lpad(cast(file_id as varchar), 3, '0') || '.sam' as output from reads",
)
def _options(s: SparkSession, d: str) -> DataFrame:
    """A control file with a table's figures in it: what it says, as it stands there and as typed values."""
    n = _table(s, d, "documents").count()
    found = conf.read_options(f"# a comment\nbucket_size = 20\nhash func=double\nflag\nbucket_size={n} 5\nratio={n}.5e1x\nretag = YES\n")
    typed = {"bucket_size": conf.get_int(found, "bucket_size", -1), "ratio": conf.get_float(found, "ratio", 0.0), "retag": conf.get_bool(found, "retag")}
    return s.createDataFrame([(k, v, str(typed.get(k, v))) for k, v in found.items()], "name string, value string, typed string")


register(
    "config_options",
    _options,
    """with n as (select count(*) as n from documents) select name, value, typed from (
select 'bucket_size' as name, n || '5' as value, n || '5' as typed from n union all select 'ratio', n || '.5e1x', (10 * n + 5) || '.0' from n
union all values ('hashfunc', 'double', 'double'), ('flag', 'flag', 'flag'), ('retag', 'YES', 'True'))""",
)
_AWK = """awk 'NR%4==2{print "ref\\t" length($0) "\\t" $0; fflush()}'"""
_awk_sql = "'ref' || chr(9) || length(sequence) || chr(9) || sequence"
# awk may read ahead of what it answers, a shell's read doesn't
_SERVE = """sh -c 'while read -r h && read -r s && read -r p && read -r q; do printf "ref\\t%s\\t%s\\n" "${#s}" "$s"; done'"""
for _name, _live in (("mapper_process", False), ("mapper_interactive", True)):
    register(
        _name,
        lambda s, d, live=_live: mapper.map_unique(reads(s, d).withColumn("pos", F.col("arrival")), mapper.process_function(_SERVE if live else _AWK, live, patience=600.0), 64).select("pos", "value"),
        f"with {READS_SQL} select arrival as pos, {_awk_sql} as value from reads",
    )


def _control_run(s: SparkSession, d: str, **more) -> tuple[runner.Report, str]:
    """A control file for the documents' files, run with a process; the report and the folder."""
    folder = _fastq_folder(s, d)
    text = f"data_dir={folder}\ninput_pattern=(.*)\\.fastq\nbucket_size={B}\nhash_func=double\ncompression=full\ncache_policy=lru\noutput_ext=.sam\nmetrics={folder}/log\n"
    system, place = sinks.file_system(f"{folder}/run.ini")
    with system.open_output_stream(place) as f:
        f.write((text + "".join(f"{k}={v}\n" for k, v in more.items())).encode())
    return runner.run_file(s, f"{folder}/run.ini", mapper.process_function(_AWK)), folder


def _control_output(s: SparkSession, d: str) -> DataFrame:
    report, _ = _control_run(s, d)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"f([0-9]+)\.sam$", 1).cast("int")
    # lines in the order of a file's splits and in them
    rows = s.read.text(list(report.outputs.values())).select(name.alias("file_id"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    return numbered(rows, ["file_id"], ["start", "id"], "n").select("file_id", "n", "line")


_FILES_SQL = READS_SQL.replace("reads as", "unordered as") + ", reads as (select file_id, header, sequence, row_number() over (order by file_id, arrival) - 1 as arrival from unordered)"
register(
    "run_control_file",
    _control_output,
    f"{routed_sql('full', 'lru', _FILES_SQL)} select file_id, row_number() over (partition by file_id order by pos) as n, {_awk_sql} as line from routed",
)
_log_sql = f"""{routed_sql('full', 'lru', _FILES_SQL)}, asked as (select *, not hit and pos = min(pos) over (partition by bucket, key) as asked from routed),
c as (select bucket, count(*) as n, count(*) filter (where hit) as h, count(*) filter (where asked) as m, count(*) filter (where route = 'unique') as u from asked group by bucket)"""


def _log_file(s: SparkSession, d: str) -> DataFrame:
    """The log of such a run, read back without its comments; times are there for each bucket that has been mapped."""
    _, folder = _control_run(s, d)
    schema = "Batch long, Batch_Time double, Throughput double, Hits long, Misses long, Reads_Aligned long, Compression_Ratio double"
    timed = ((F.col("Batch_Time") > 0) & (F.col("Throughput") > 0)).alias("timed")
    return metrics.read_log(s, f"{folder}/log", schema).select("Batch", F.coalesce(timed, F.lit(False)).alias("timed"), "Hits", "Misses", "Reads_Aligned", F.round("Compression_Ratio", 6).alias("Compression_Ratio"))


register(
    "log_file",
    _log_file,
    f"""{_log_sql} select cast(bucket as bigint) as Batch, u > 0 as timed, cast(sum(h) over w as bigint) as Hits, cast(sum(m) over w as bigint) as Misses,
cast(sum(u) over w as bigint) as Reads_Aligned, round(n / nullif(cast(u as double), 0), 6) as Compression_Ratio from c window w as (order by bucket)""",
)
register(
    "log_comments",
    lambda s, d: s.read.text(f"{_control_run(s, d)[1]}/log").where("value like '#%'").select(F.regexp_extract("value", r"^# (\w+):", 1).alias("what"), F.coalesce(F.regexp_extract("value", r"(?:Num_Files|total_reads):([0-9]+)", 1).try_cast("long"), F.size(F.split("value", ",")) - 1).cast("long").alias("n")),
    "select 'Num_Files' as what, (select count(distinct coalesce(source, '')) from documents) as n union all select 'File_Names', (select count(distinct coalesce(source, '')) from documents) union all select 'config', (select count(*) from documents)",
)
register(
    "short_log",
    lambda s, d: metrics.short_log_lines(metrics.batch_metrics(dedup.counters(_routed(s, d, "full")), B), B, "lru", 7, 1.5).where("n > 0").select("n", F.substring_index("value", ",", 5).alias("value")),
    f"""{_log_sql.replace(_FILES_SQL, READS_SQL)} select cast(bucket as bigint) as n, (bucket - 1) || ',,,' || cast(sum(h) over w as bigint) || ',' || cast(sum(u) over w as bigint) as value from c window w as (order by bucket)""",
)


def _suppressed(s: SparkSession, d: str) -> DataFrame:
    report, _ = _control_run(s, d, suppress_sam="false")  # that it is there is enough
    there = 0
    for path in report.outputs.values():
        system, place = sinks.file_system(path)
        there += system.get_file_info(place).is_file
    return report.summary.select("n_rows", F.lit(there).cast("long").alias("n_outputs"))


register("suppressed_output", _suppressed, "select count(*) as n_rows, cast(0 as bigint) as n_outputs from documents")
