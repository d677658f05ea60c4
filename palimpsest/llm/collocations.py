"""Phrases of words that stick together, mined level by level.

Level k counts only phrases whose two overlapping parts of k - 1 words are both
frequent. What is frequent is sent to the tasks as a bitmap of hashes of at most
``MOST_BITS`` bits, whatever the corpus: a wrong bit lets a phrase be counted that
the level's exact counts then drop, so counts and results are exact. Words are
split and phrases numbered in numpy, slice by slice; Spark sums their counts.
Scores, coverage and ranks are joins and windows over the level tables.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, release
from .textscan import LOWER, row_of, slices, words

#: 32 MB for each level that is sent out
MOST_BITS = 1 << 28
#: bits by which a phrase's hash is turned for each word
TURN = 13
#: bits of one row of Spark's bitmap aggregates
BUCKET = 32_768
#: bytes of text that are split at a time
SLICE = 4 << 20

BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
OUTSIDE = BREAK.copy()
OUTSIDE[[0x20, 0x09]] = True

#: a product may pass 64 bits
SCORE = "cast(cast(a as decimal(20)) * 2000000 div (cast(l as decimal(20)) + r) as long)"
COUNTS = "lang string, phrase string, f long"


def levels(docs: DataFrame, min_count: int, longest: int) -> list[DataFrame]:
    """Tables (lang, phrase, f) of the phrases of 1, 2, ... ``longest`` words that occur ``min_count`` times or more; the first also has each lang's number of words, with a null phrase.

    ``f`` counts all occurrences inside pieces, overlaps included. Null lang is
    ``und``, null text empty.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sc, out, filters = docs.sparkSession.sparkContext, [], []
    for k in range(1, longest + 1):
        counted = rows.mapInArrow(_counter(k, filters), COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        out.append(materialize(counted.where(F.col("phrase").isNull() | (F.col("f") >= min_count)), f"phrases-{k}"))
        if k < longest:
            filters.append(sc.broadcast(_bitmap(out[-1])))
    return out


def _bitmap(level: DataFrame) -> np.ndarray:
    """Bits at the hashes of the level's phrases; the driver gets the bitmap, built by the tasks, never the phrases.

    A phrase's hash turns that of the phrase without its last word and adds the word's, beginning with the lang's.
    """
    bits = BUCKET
    while bits < min(16 * level.count(), MOST_BITS):
        bits *= 2
    turned = lambda h: F.shiftleft(h, TURN).bitwiseOR(F.shiftrightunsigned(h, 64 - TURN))
    hashed = F.aggregate(F.split("phrase", " "), F.xxhash64("lang"), lambda h, w: turned(h).bitwiseXOR(F.xxhash64(w)))
    place = level.where(F.col("phrase").isNotNull()).select((hashed.bitwiseAND(bits - 1) + 1).alias("p"))
    rows = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        out[(r.b - 1) * (BUCKET // 8) : r.b * (BUCKET // 8)] = np.frombuffer(r.m, dtype=np.uint8)
    return out


def _turned(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(TURN)) | (h >> np.uint64(64 - TURN))


def _known(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which phrases of these hashes may be frequent."""
    at = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counter(k: int, filters: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    filters = list(filters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, of_row = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            seeds = np.array([_hash(x) for x in names], dtype=np.uint64)
            for row, stop, buf, offsets in slices(batch.column(1), SLICE):
                for part, cuts in _short(buf, offsets):
                    own = of_row[row:stop] if len(cuts) == stop - row + 1 else np.repeat(of_row[row:stop], len(cuts) - 1)
                    phrases, lang, f = _phrases(k, filters, part, cuts, own, seeds)
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), phrases, pa.array(f, pa.int64())], names=["lang", "phrase", "f"])

    return count


def _short(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A single row longer than SLICE in several parts, cut where a piece ends; anything else as it is."""
    at = 0
    while len(offsets) == 2 and len(buf) - at > SLICE:
        ends = np.flatnonzero(BREAK[buf[at + SLICE :]])
        if not len(ends):
            break
        stop = at + SLICE + int(ends[0])
        yield buf[at:stop], np.array([0, stop - at])
        at = stop
    yield (buf[at:], offsets - at) if not at else (buf[at:], np.array([0, len(buf) - at]))


def _hash(text: str) -> int:
    """Spark's hash of a string."""
    return xxhash.xxh64_intdigest(text.encode(), seed=42)


def _phrases(k: int, filters: list, buf: np.ndarray, offsets: np.ndarray, of_row: np.ndarray, seeds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Phrases of ``k`` words with their langs and counts; for k = 1 also the number of words of each lang, as phrase null."""
    buf = LOWER[buf]
    starts, ends, bounds = words(buf, offsets, OUTSIDE)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = row_of(bounds, len(starts))
    places = np.concatenate(([0], np.cumsum(ends - starts)))
    spelt = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(buf[~OUTSIDE[buf]])).dictionary_encode()
    spelling, n_words = spelt.dictionary, len(spelt.dictionary)
    units, which = pd.factorize(of_row[rows].astype(np.int64) * n_words + spelt.indices.to_numpy(zero_copy_only=False))
    lang, word, n_units = which // n_words, which % n_words, len(which)
    if k == 1:
        f = np.bincount(units)
        total = np.bincount(lang, weights=f, minlength=len(seeds)).astype(np.int64)
        here = np.flatnonzero(total)
        phrases = pa.concat_arrays([spelling.take(pa.array(word)), pa.nulls(len(here), pa.large_string())])
        return phrases.cast(pa.string()), np.concatenate((lang, here)), np.concatenate((f, total[here]))
    piece = np.cumsum(BREAK[buf])[starts]
    same = (piece[1:] == piece[:-1]) & (rows[1:] == rows[:-1])
    own = np.fromiter((_hash(x) for x in spelling.to_pylist()), dtype=np.uint64, count=n_words)[word]
    grams, spelled, hashes = units, [word], _turned(seeds[lang]) ^ own  # each place's phrase, and of each phrase its words and hash
    fine = _known(filters[0].value, hashes)[grams]
    for size in range(2, k + 1):
        at = np.flatnonzero(fine[:-1] & fine[1:] & same)
        made, codes = pd.factorize(grams[at] * n_units + units[at + size - 1])
        first, last = codes // n_units, codes % n_units
        spelled, lang = [*(x[first] for x in spelled), word[last]], lang[first]
        if size == k:
            phrases = pc.binary_join_element_wise(*(spelling.take(pa.array(x)) for x in spelled), pa.scalar(" ", pa.large_string()))
            return phrases.cast(pa.string()), lang, np.bincount(made, minlength=len(codes))
        hashes = _turned(hashes[first]) ^ own[last]
        grams, fine = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
        grams[at] = made
        fine[at] = _known(filters[size - 1].value, hashes)[made]
    raise AssertionError


def collocations(docs: DataFrame, min_count: int = 30, longest: int = 4, cover_percent: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
    these at spaces and tabs into words. A candidate is a phrase of 2 to ``longest``
    words that occurs ``a >= min_count`` times. Each cut into a first part (``l``
    times) and a rest (``r`` times) scores floor(2000000 * a / (l + r)) in exact
    decimals; the lowest cut counts, the earliest of equal ones. A candidate goes
    if some longer candidate holds its words and occurs at least
    ``cover_percent`` / 100 as often. Ties rank by a, then phrase. ``n`` is the
    lang's number of words. Null lang is ``und``; null, empty and wordless texts
    have no phrases; repeated rows count each time; other columns are ignored.
    """
    tables = levels(docs, min_count, longest)
    own = [t.where(F.col("phrase").isNotNull()) for t in tables]
    totals = tables[0].where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))

    long = own[1]
    for t in own[2:]:
        long = long.unionByName(t)
    part_of = lambda k, n: F.array_join(F.slice("w", k, n), " ")
    long = long.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = long.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part_of(F.lit(1), F.col("k")).alias("left"), part_of(F.col("k") + 1, F.size("w")).alias("right"))
    parts = own[0]
    for t in own[1:-1]:
        parts = parts.unionByName(t)
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    best = cuts.groupBy("lang", "phrase").agg(F.any_value("a").alias("a"), F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("cut"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda s: F.array_join(F.slice("w", s, n), " "))))
    inside = long.where(F.size("w") > 2).select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover_percent))
    left = left.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")

    ranked = left.withColumn("salt", F.xxhash64("phrase"))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for salts in (spread, 16, 1):  # a lang of any size is cut down to its best by many tasks before one sees them
        order = Window.partitionBy("lang", F.pmod("salt", F.lit(salts))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    result = materialize(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(*tables)
    return result
