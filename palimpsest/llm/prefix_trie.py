"""Conversations that begin alike, as a trie of turns.

A turn is known by the digest of its role and text. Equal conversations are
counted first, so a very common one is a single path. Paths are dealt out by the
digest of their first turn and each bucket builds its trie from pointers and
dictionaries. A first turn under which too much meets is taken out before: what
all its paths share becomes a spine of nodes, and the paths are dealt out again by
the turn after it, until every part fits a task. Sums then go up the spines.

The driver holds the rounds, never a path. What is broadcast are the keys of
oversized parts, at most ``MOST_PARTS`` of them. One conversation's path is a row of
about 24 bytes a turn.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import own_names
from .storage import materialize, release

#: turns of different paths that one task builds a trie of, unless there are more than MOST_PARTS times as many
MOST_TURNS = 200_000
#: below so many turns nothing is split
LEAST_TURNS = 1_000
#: a part is taken out only if it has this share of all turns or more, so there are never more parts than this at once
MOST_PARTS = 100_000
#: conversation ids of one block of 2**BLOCK_BITS are gathered to a row
BLOCK_BITS = 10
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_key binary"


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn; null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def conversation_paths(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one row (conv_id, turns) per conversation.

    ``turns`` is an array of (key, size): the turn's digest and its text's bytes,
    by turn, null first; rows of one turn are ordered by digest, repeated ones
    stay. Rows without conv_id belong to no conversation. Other columns are left out.
    """
    one = F.struct("turn", turn_key(F.col("role"), F.col("text")).alias("key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    rows = rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size")))  # a null turn comes first
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def prefix_trie(paths: DataFrame, most_turns: int = MOST_TURNS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """All nodes of the trie of ``paths`` (conv_id, turns; conv_id unique, see ``conversation_paths``).

    A node is a sequence of first turns that some conversation has; the root is the
    empty one. Columns: ``conv_id``, the smallest conversation that begins so;
    ``depth``; ``parent_conv_id``, the same of the node above (root: null);
    ``n_convs``, the conversations that begin so; ``n_children``; ``n_leaves``,
    nodes without children in its subtree; ``saved_tokens``, over its subtree the
    sum of (n_convs - 1) times the bytes of the node's last text;
    ``ends_sha256`` of the ids that end here, ascending and comma-joined;
    ``turn_key`` of its last turn (root: null). (conv_id, depth) is unique. Null
    or empty turns end at the root. Without a conversation there is no node.
    """
    spark = paths.sparkSession
    blocks = materialize(_blocks(paths), "trie-blocks")
    whole = materialize(_classes(blocks), "trie-paths")
    release(blocks)
    total = whole.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0)), F.min("conv_id"), F.sum("n_convs")).first()
    if total[1] is None:
        release(whole)
        return spark.createDataFrame([], NODE)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(least_turns, min(most_turns, total[0] // parts), total[0] // MOST_PARTS)
    buckets = max(parts, -(-total[0] // limit))

    rest = whole.select("*", F.lit("").alias("prefix"), F.lit(0).alias("at"), F.lit(total[1]).alias("parent_conv_id"))
    rounds, spent = [], [whole]
    while True:
        ended = rest.where(F.size("turns") <= F.col("at")).select("prefix", "ends")
        going = rest.where(F.size("turns") > F.col("at")).withColumn("part", F.sha2(F.concat("prefix", F.hex(F.get("turns", F.col("at"))["key"])), 256))
        sizes = going.groupBy("part").agg(F.sum(F.size("turns") - F.col("at")).alias("own"), F.count("*").alias("n"))
        heavy = materialize(sizes.where((F.col("own") > limit) & (F.col("n") > 1)).select("part"), "trie-heavy")
        built = materialize(_built(going.join(F.broadcast(heavy), "part", "left_anti"), buckets), "trie-nodes")
        if heavy.isEmpty():
            release(heavy)
            rounds.append((ended, built, None))
            break
        large = going.join(F.broadcast(heavy), "part", "left_semi")
        spines = materialize(_spines(large), "trie-spines")
        below = spines.select("part", F.col("to").alias("_to"), F.col("conv_id").alias("_conv"))
        large = large.join(F.broadcast(below), "part")  # as many rows as heavy has
        large = large.select("path", "turns", "conv_id", "n_convs", "ends", F.col("part").alias("prefix"), F.col("_to").alias("at"), F.col("_conv").alias("parent_conv_id"))
        rounds.append((ended, built, spines))
        rest = materialize(large, "trie-rest")
        spent += [heavy, rest]
    return _summed(rounds, total, spent)


def _blocks(paths: DataFrame) -> DataFrame:
    """A row for each different path and block of ids: path (its digest), turns, block, n, smallest conv_id, ids; at most 2**BLOCK_BITS ids each."""
    turns = F.coalesce("turns", F.array().cast(paths.schema["turns"].dataType))
    path = F.sha2(F.array_join(F.transform(turns, lambda t: F.hex(t["key"])), ""), 256)
    rows = paths.select("conv_id", turns.alias("turns"), path.alias("path"), F.shiftright("conv_id", BLOCK_BITS).alias("block"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy("path", "block").agg(ids.alias("ids"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.any_value("turns").alias("turns"))


def _classes(blocks: DataFrame) -> DataFrame:
    """A row for each different path: path, turns, smallest conv_id, n_convs, ends."""
    one = F.when(F.count("*") == 1, F.sha2(F.max("ids"), 256))
    out = blocks.groupBy("path").agg(F.any_value("turns").alias("turns"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), one.alias("ends"))
    many = blocks.join(out.where(F.col("ends").isNull()).select("path"), "path", "left_semi").select("path", "block", "ids")
    ordered = many.repartition("path").sortWithinPartitions("path", "block").mapInPandas(_digest, "path string, _ends string")
    return out.join(ordered, "path", "left").select("path", "turns", "conv_id", "n_convs", F.coalesce("ends", "_ends").alias("ends"))


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of paths whose ids fill several blocks, one block after another; only a hash's state is kept between them."""
    path, state = None, None
    for batch in batches:
        done = []
        for p, ids in zip(batch["path"], batch["ids"], strict=True):
            if p != path:
                if path is not None:
                    done.append((path, state.hexdigest()))
                path, state = p, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield pd.DataFrame(done, columns=["path", "_ends"])
    if path is not None:
        yield pd.DataFrame([(path, state.hexdigest())], columns=["path", "_ends"])


def _built(going: DataFrame, buckets: int) -> DataFrame:
    """The nodes of the parts that fit, below what their prefix has."""
    left = F.slice("turns", F.col("at") + 1, F.size("turns"))
    rows = going.select(
        F.pmod(F.xxhash64("part"), F.lit(buckets)).alias("bucket"), "part", "prefix", "parent_conv_id", "conv_id", "n_convs", "ends", "at",
        F.transform(left, lambda t: t["key"]).alias("keys"), F.transform(left, lambda t: t["size"]).alias("sizes"),
    )
    return rows.groupBy("bucket").applyInPandas(_build, f"{NODE}, prefix string")


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket's tries: a dictionary of children for each node, filled path by path, then summed from the last node to the first.

    A node is made after the one above it, so going backwards is a postorder without recursion.
    """
    tops: dict[str, int] = {}
    above, depth, conv, n, size, ends, key, prefix, over = [], [], [], [], [], [], [], [], []
    children: list[dict[bytes, int]] = []
    columns = ("part", "prefix", "parent_conv_id", "conv_id", "n_convs", "ends", "at", "keys", "sizes")
    for part, pre, parent, c, count, end, at, keys, sizes in zip(*(rows[x] for x in columns), strict=True):
        node = -1
        for k in range(len(keys)):
            turn = bytes(keys[k])
            found, label = (tops, part) if node < 0 else (children[node], turn)
            next_node = found.get(label)
            if next_node is None:
                found[label] = next_node = len(above)
                above.append(node)
                depth.append(at + k + 1)
                conv.append(c)
                n.append(0)
                size.append(int(sizes[k]))
                ends.append(NOTHING)
                key.append(turn)
                prefix.append(pre if node < 0 else None)
                over.append(parent)
                children.append({})
            node = next_node
            n[node] += count
            if c < conv[node]:
                conv[node] = c
        ends[node] = end
    leaves = [0 if x else 1 for x in children]
    saved = [(m - 1) * s for m, s in zip(n, size, strict=True)]
    for k in range(len(above) - 1, -1, -1):
        if above[k] >= 0:
            leaves[above[k]] += leaves[k]
            saved[above[k]] += saved[k]
    parents = [over[k] if above[k] < 0 else conv[above[k]] for k in range(len(above))]
    return pd.DataFrame({
        "conv_id": conv, "depth": depth, "parent_conv_id": parents, "n_convs": n, "n_children": [len(x) for x in children], "n_leaves": leaves,
        "saved_tokens": saved, "ends_sha256": ends, "turn_key": key, "prefix": prefix,
    })


def _spines(large: DataFrame) -> DataFrame:
    """For each oversized part what all its paths share: (part, prefix, at, to, chain, n_convs, conv_id, parent_conv_id).

    Sorted paths share as much as the first and the last of them do.
    """
    grouped = large.groupBy("part").agg(
        F.any_value("prefix").alias("prefix"), F.any_value("at").alias("at"), F.any_value("parent_conv_id").alias("parent_conv_id"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("turns").alias("lo"), F.max("turns").alias("hi"),
    )
    same = F.zip_with("lo", "hi", lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False)
    to = F.when(first == 0, F.size("lo")).otherwise(first - 1).cast("int")
    grouped = grouped.withColumn("to", to)
    return grouped.select("part", "prefix", "at", "to", F.slice("lo", F.col("at") + 1, F.col("to") - F.col("at")).alias("chain"), "n_convs", "conv_id", "parent_conv_id")


def _summed(rounds: list, total, spent: list[DataFrame]) -> DataFrame:
    """All nodes; what hangs below a spine is added to its nodes, the deepest round first."""
    out, below, ended_below = [], None, None
    for ended, built, spines in reversed(rounds):
        tops = built.where(F.col("prefix").isNotNull()).select("prefix", "n_leaves", "saved_tokens")
        if spines is not None:
            mine = spines.join(below.withColumnRenamed("prefix", "part"), "part", "left").join(ended_below.withColumnRenamed("prefix", "part"), "part", "left")
            chain = materialize(mine.select(F.transform("chain", lambda t: t["key"]).alias("keys"), F.transform("chain", lambda t: t["size"]).alias("sizes"), *(c for c in mine.columns if c != "chain")).mapInPandas(_unfold, f"{NODE}, prefix string"), "trie-nodes")
            spent.append(spines)
            out.append(chain)
            tops = tops.unionByName(chain.where(F.col("prefix").isNotNull()).select("prefix", "n_leaves", "saved_tokens"))
        out.append(built)
        below = tops.groupBy("prefix").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        ended_below = ended
    one, here = below.first(), ended_below.first()  # nothing but the root is left above
    root = (total[1], 0, None, total[2], one.children if one else 0, one.leaves if one else 1, one.saved if one else 0, here.ends if here else NOTHING, None)
    result = below.sparkSession.createDataFrame([root], NODE)
    release(*spent)
    for nodes in out:
        result = result.unionByName(nodes.drop("prefix"))
    return result


def _unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spine's nodes, with what hangs below its last one."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            m = len(r.keys)
            own = np.asarray(r.sizes, dtype=np.int64) * (r.n_convs - 1)
            last = np.arange(m) == m - 1
            yield pd.DataFrame({
                "conv_id": r.conv_id, "depth": r.at + 1 + np.arange(m), "parent_conv_id": np.where(np.arange(m) == 0, r.parent_conv_id, r.conv_id), "n_convs": r.n_convs,
                "n_children": np.where(last, int(r.children), 1), "n_leaves": int(r.leaves), "saved_tokens": int(r.saved) + own[::-1].cumsum()[::-1],
                "ends_sha256": np.where(last, r.ends or NOTHING, NOTHING), "turn_key": [bytes(x) for x in r.keys], "prefix": [r.prefix] + [None] * (m - 1),
            })


def with_texts(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``nodes`` with ``role`` and ``text`` of their last turn, from the rows that the paths were made of (root: null)."""
    (key,) = own_names(rows, "key")
    said = rows.where(F.col("conv_id").isNotNull()).select(turn_key(F.col("role"), F.col("text")).alias(key), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return nodes.join(said.dropDuplicates([key]).withColumnRenamed(key, "turn_key"), "turn_key", "left").select(*nodes.columns, "role", "text")
