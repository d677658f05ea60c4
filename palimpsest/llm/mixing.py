"""Mixing sources to target weights by a splitting tree.

Documents of a source fall into blocks by a hash; a source has as many blocks as
its size asks for (``words_per_block``), so a block stays small at every size,
and the mix has as many shards as its size asks for. A source that is taken r
times gives each block floor(r) times and, for the rest, the first blocks of a
random order, the last one up to the document and the word that meets the
target. The block quotas of the sources are divided exactly among the output
shards by a tree: each node splits its quotas between its halves by a
multivariate hypergeometric draw. A source's block instances, in permuted order,
are dealt to the shards in disjoint runs as the quotas say; inside a shard a
hash orders the documents.

Weights 5, 2, 1 (``weights``) repeat over the sources by code point, null last.
A target stops at ``most`` times its source's size; what is too much is shared
again by weight. The driver holds one row per source and the tree's quotas, a
number for each source and shard; more than ``most_sources`` or ``most_quotas``
of them raise an error that names the parameter, nothing is left out.

Edge cases: a null text has no words; a source without words has target 0; the
null source is a source of its own; a repeated row is a document of its own,
stays in one block with its equals and is treated alike; an empty table gives no rows; other columns are kept by
``mix_documents`` and ignored by ``mix``. Draws depend on doc_id, text, source
and ``seed`` only, so reruns agree.
"""

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, numbered

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most: float = 3.0
    #: shards and blocks of a source: at least so many (blocks only where there are documents for them), more as the words ask for
    shards: int = 64
    words_per_shard: int = 50_000_000
    blocks: int = 256
    words_per_block: int = 1 << 20
    docs_per_block: int = 4
    #: what the driver takes
    most_sources: int = 100_000
    most_quotas: int = 20_000_000
    seed: int = 17
    #: rows of the table of blocks, or quotas, up to which a table is broadcast; a larger one is joined by a shuffle
    broadcast_rows: int = 200_000


def share(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """All of the sizes' sum by weight, none above ``most`` times its own size; the excess goes to the others by weight."""
    targets = [0.0] * len(sizes)
    free, left = [k for k, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        all_weights = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / all_weights > most * sizes[k]]
        if not over:
            for k in free:
                targets[k] = left * weights[k] / all_weights
            break
        for k in over:
            targets[k] = most * sizes[k]
        left -= sum(targets[k] for k in over)
        free = [k for k in free if k not in set(over)]
    return targets


def _draw(rng: np.random.Generator, good: int, bad: int, need: int, most: int = 10**9) -> int:
    """How many of ``need`` drawn without replacement are ``good``: a hypergeometric draw.

    numpy's takes populations below 10**9. Above, the chances are summed from the most likely count
    outwards by the ratio of neighbours, ten standard deviations to either side, and inverted.
    """
    if max(good, bad) < most:
        return int(rng.hypergeometric(good, bad, need))
    lo, hi, total = max(0, need - bad), min(good, need), good + bad
    mode = min(max((good + 1) * (need + 1) // (total + 2), lo), hi)
    wide = 10 * int(math.sqrt(need * (good / total) * (bad / total) * ((total - need) / max(total - 1, 1))) + 2)
    up = np.arange(mode, min(hi, mode + wide), dtype=np.float64)
    down = np.arange(mode, max(lo, mode - wide), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (need - up) / ((up + 1) * (bad - need + up + 1)))
    below = np.cumprod(down * (bad - need + down) / ((good - down + 1) * (need - down + 1)))
    chances = np.concatenate((below[::-1], [1.0], above))
    return mode - len(below) + int(np.searchsorted(np.cumsum(chances), rng.random() * chances.sum(), side="right"))


def split_quotas(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Divide ``counts`` (blocks by source) exactly among ``shards``; a row for each shard.

    Each half gets a number of blocks in proportion to its shards; which sources
    they are of is a multivariate hypergeometric draw, source by source, seeded by the node.
    """
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    todo = [(0, shards, counts.astype(np.int64))]
    while todo:
        lo, hi, own = todo.pop()
        if hi - lo == 1:
            out[lo] = own
            continue
        mid = (lo + hi) // 2
        total = int(own.sum())
        part = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = np.zeros_like(own)
        rest, need = total, part
        for k, n in enumerate(own.tolist()):
            others = rest - n
            if need and n:
                left[k] = _draw(rng, n, others, need) if others else need
            need -= int(left[k])
            rest = others
        todo += [(lo, mid, left), (mid, hi, own - left)]
    return out


def _sized(docs: DataFrame) -> tuple[Column, ...]:
    text = docs["text"].cast("string")
    return (
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("h"),
    )


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and ``draws``.

    ``draws``: an array of (copy, words, shard, position): each time that the
    document is taken, with how many of its words, and where it goes.
    """
    sized = materialize(docs.select(*_sized(docs)), "mix-sizes")
    return _mix(sized, sized, p).select("doc_id", "source", "size", "source_size", "target", "taken", "draws")


def _shards(words: int, p: MixParams) -> int:
    return max(p.shards, -(-words // p.words_per_shard))


def _mix(sized: DataFrame, rows: DataFrame, p: MixParams) -> DataFrame:
    """The draws for ``rows``, which has the same doc_id, source, size and h (a hash of the text) as ``sized`` and perhaps more columns."""
    spark = sized.sparkSession
    stats = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(p.most_sources + 1).collect()
    if len(stats) > p.most_sources:
        raise ValueError(f"more than {p.most_sources} sources: most_sources")
    stats.sort(key=lambda r: (r.source is None, r.source or ""))  # code points, null last
    sizes = [r["size"] for r in stats]
    weights = [p.weights[k % len(p.weights)] for k in range(len(stats))]
    targets = share(sizes, weights, p.most)
    rate = [t / s if s else 0.0 for t, s in zip(targets, sizes)]
    n_blocks = [max(1, min(max(p.blocks, -(-r["size"] // p.words_per_block)), r.n // p.docs_per_block)) for r in stats]
    shards = _shards(sum(sizes), p)
    if shards * len(stats) > p.most_quotas:
        raise ValueError(f"{shards} shards of {len(stats)} sources: more than most_quotas; words_per_shard makes fewer shards")
    whole = [int(math.floor(x + 1e-12)) for x in rate]
    # instances: each whole copy of each block, and the blocks that the rest reaches (nearly that many, known below exactly)
    rest = [max(0, round(t - w * s)) for t, w, s in zip(targets, whole, sizes)]
    instances = np.array([w * b + (math.ceil(b * r / s) if s else 0) for w, b, r, s in zip(whole, n_blocks, rest, sizes)], dtype=np.int64)
    ends = np.cumsum(split_quotas(instances, shards, p.seed), axis=0) if stats else np.zeros((shards, 0), np.int64)
    step = max(1, math.isqrt(shards))
    plan = spark.createDataFrame(
        [(r.source, sizes[k], targets[k], n_blocks[k], whole[k], rest[k], ends[:, k].tolist(), ends[step - 1 :: step, k].tolist()) for k, r in enumerate(stats)],
        "source string, source_size long, target double, n_blocks long, whole int, rest long, ends array<long>, heads array<long>",
    )
    small = lambda df, rows: F.broadcast(df) if rows <= p.broadcast_rows else df

    def planned(df: DataFrame) -> DataFrame:
        df = df.alias("d").join(small(plan, shards * len(stats)).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", *(f"p.{c}" for c in plan.columns if c != "source"))
        return df.withColumn("block", F.pmod(F.xxhash64("doc_id", "h", "source", F.lit(p.seed)), F.col("n_blocks")))

    own = planned(rows.withColumn("_n", F.monotonically_increasing_id()))
    keys = ["source", "block"]
    blocks = planned(sized).groupBy(*keys).agg(F.sum("size").alias("block_size"), F.first("rest").alias("rest"), F.first("whole").alias("whole"), F.first("ends").alias("ends"), F.first("heads").alias("heads"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(p.seed + 1)), "block")  # a row for about ``words_per_block`` words
    upto = F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.withColumn("rank", F.row_number().over(order) - 1).withColumn("blocks_here", F.count("*").over(Window.partitionBy("source"))).withColumn("before", upto - F.col("block_size"))

    def shard_of(place: Column) -> Column:
        """How many of the sorted ``ends`` are at most ``place``, by a search in two steps."""
        head = F.size(F.filter("heads", lambda e: e <= place))
        inside = F.size(F.filter(F.slice("ends", head * step + 1, F.lit(step)), lambda e: e <= place))
        return F.least(head * step + inside, F.lit(shards - 1))

    copies = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0), F.col("whole") - 1), lambda c: shard_of(c * F.col("blocks_here") + F.col("rank")))).otherwise(F.array().cast("array<int>"))
    blocks = blocks.select(
        *keys,
        copies.alias("whole_shards"),
        shard_of(F.col("whole") * F.col("blocks_here") + F.col("rank")).alias("rest_shard"),
        F.greatest(F.least(F.col("rest") - F.col("before"), F.col("block_size")), F.lit(0)).alias("rest_words"),
        F.col("block_size"),
    ).withColumnRenamed("source", "b_source").withColumnRenamed("block", "b_block")
    joined = own.join(small(blocks, sum(n_blocks)), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    at = F.xxhash64("doc_id", "h", F.lit(p.seed + 2))
    cut = (F.col("rest_words") > 0) & (F.col("rest_words") < F.col("block_size"))
    # only the block in which a source's target lies needs its documents in order: one of a source's blocks. Equal rows count
    # as one document in that order and are numbered by tasks that share them
    same = ["source", "block", "doc_id", "h", "size"]
    inside = Window.partitionBy("source", "block").orderBy(at, "doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.where(cut)
    ahead = edge.groupBy(*same).agg(F.count("*").alias("copies")).withColumn("ahead", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    ahead = ahead.select(*(F.col(c).alias(f"_a_{c}") for c in same), "ahead")
    edge = numbered(edge, same, ["_n"], "nth")
    edge = edge.join(ahead, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in same)))
    left = F.col("rest_words") - F.col("ahead") - (F.col("nth") - 1) * F.col("size")
    edge = edge.select(*joined.columns, F.greatest(F.least(left, F.col("size")), F.lit(0)).cast("long").alias("extra"))
    plain = joined.where(~cut).withColumn("extra", F.when(F.col("rest_words") > 0, F.col("size")).otherwise(F.lit(0).cast("long")))
    position = lambda c: F.xxhash64("doc_id", "h", c, F.lit(p.seed + 3))
    draw = lambda c, words, shard: F.struct(c.cast("int").alias("copy"), words.alias("words"), shard.cast("int").alias("shard"), position(c.cast("int")).alias("position"))
    draws = F.concat(
        F.transform("whole_shards", lambda s, c: draw(c, F.col("size"), s)),
        F.when(F.col("extra") > 0, F.array(draw(F.col("whole"), F.col("extra"), F.col("rest_shard")))).otherwise(F.array().cast("array<struct<copy:int,words:bigint,shard:int,position:bigint>>")),
    )
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    return plain.unionByName(edge).select(*rows.columns, "source_size", "target", taken.alias("taken"), draws.alias("draws"))


def mix_documents(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mix itself: a row with all columns of ``docs`` for each time that a document is taken.

    The last copy of a document may hold only its first words; n_chars, where
    there is such a column, follows. Rows of a shard are together and in the
    shard's order.
    """
    rows = docs.select(*_sized(docs), F.struct(*docs.columns).alias("row"))
    sized = materialize(rows.drop("row"), "mix-sizes")
    out = _mix(sized, rows, p).select("row", "size", F.explode("draws").alias("draw"))
    words = F.regexp_extract_all("row.text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.col("draw.words") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("draw.words").cast("int")), "")).otherwise(F.col("row.text"))
    columns = {c: F.col(f"row.{c}") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    out = out.repartition(_shards(sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], p), "draw.shard").sortWithinPartitions("draw.shard", "draw.position")
    return out.select(*(v.alias(c) for c, v in columns.items()))
