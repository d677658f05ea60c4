"""N-gram Jaccard self-join with a count-vector R-tree.

A text's set holds its distinct word shingles as 64-bit hashes. Texts with
equal sets, told by 128-bit digests, are one class; a class is known by the
first half of its digest, or by another number where several classes share
that half. The hash space is cut into groups; how many shingles
fall in each group is a point, and the sum over the groups of the smaller of
two counts bounds the overlap of two sets. Points are indexed in R-trees, whose
nodes are skipped by that bound, and the pairs that survive are verified on
the sets themselves.

So that no tree has to hold the corpus, classes are first brought together by
group signatures: two sets of a bounded difference agree in all but so many
groups, hence they share the hash of a whole group. For small sets there are
more groups than differences, so that sharing is certain; empty groups count
only in a set that has no more other groups than differences. Large sets use the
first 62 groups of a finer division, where the chance to share none is below
1e-12. Of classes that share a signature, those are joined whose points let
them link; joined classes form clusters, and all links lie inside clusters. A
large cluster is joined anew with points of more coordinates, which keep apart
what only shares some passages. A cluster is one cell, or, if it is still large, is dealt to many cells; each of these
also holds the cluster's central sets, which links most of a group of copies at
once, and what stays apart is then compared with those other cells of its
cluster in which a class shares a signature with it. So each link's two ends
become connected, whatever the size of a group, and neither pairs nor groups
are gathered in one place. A signature's classes are counted by an aggregate
that starts before the shuffle; if more than ``LONG_RUN`` share it, they are
joined with the first of them without a look at their points, where they lie.

Links are only established as far as components need them. Edge cases: null
texts and texts without words have an empty set, link with nothing and are
their own component; a text of fewer words than a shingle is one shingle;
repeated rows are one class; a null doc_id can link but never names a component
unless it has no other id; an empty table gives no rows; other columns are
ignored by ``components`` and kept by ``keep_one``.
"""

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .columns import own_names
from .components import connected_components
from .storage import materialize, release, scope

GROUPS = 64  # coordinates of the count vectors
FINE = 1024  # the same in large clusters
LONG_RUN = 100_000  # rows (signature, class) of one signature whose points one task holds
FINE_RUN = 10_000  # the same in large clusters
SMALL_RUN = 64  # the same, up to which all pairs of points are compared without a tree
MOST_SIGNATURES = 62
CELL = 192  # classes in a cell
CELL_SHINGLES = 400_000
PIVOTS = 4


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    buf = ts.LOWER[buf]
    starts, ends, first = ts.words(buf, offsets)
    hashes = ts.span_hash(buf, starts, ends)
    every = ts.windows(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        own = every[a : b - n + 1] if b - a >= n else ts.windows(hashes[a:b], b - a) if b > a else every[:0]
        own = np.sort(own)
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    return out


def class_of(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """A set's digest: equal for equal sets, different else but for a chance of 2**-128. ``bits`` of its first half count."""
    both = np.array([ts.mix(s + np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64), ts.mix(s ^ np.uint64(0x6A09E667F3BCC908)).sum(dtype=np.uint64)])
    first, second = ts.mix(both + np.full(2, len(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64).tolist()
    return first >> (64 - bits), second


def count_vector(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """How many shingles fall in each group; ``groups`` is a power of two."""
    return np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def packed_vector(v: np.ndarray) -> bytes:
    return v.astype("u1" if v.max() < 256 else "<u4").tobytes()


def unpacked_vectors(column: pa.Array, groups: int = GROUPS) -> np.ndarray:
    return np.array([np.frombuffer(x, dtype="u1" if len(x) == groups else "<u4") for x in column.to_pylist()], dtype=np.int32).reshape(-1, groups)


@lru_cache(maxsize=8)
def bands(t: Fraction) -> list[int]:
    """Largest sizes of the bands: a set and a partner lie in one band or in neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(int(int(out[-1] / t) / t), out[-1] + 1))
    return out


@lru_cache(maxsize=4096)
def division(band: int, t: Fraction) -> tuple[np.ndarray, bool, np.ndarray]:
    """Group edges, whether the groups cover the whole hash space, and the salts of the signatures of a band."""
    most = int(2 * bands(t)[band] * (1 - t) / (1 + t))  # elements that are in one of two linked sets only
    whole = most + 2 <= MOST_SIGNATURES
    groups = most + 4 + most // 16 if whole else max(most, MOST_SIGNATURES)  # some more than it takes, so that empty ones hardly ever count
    count = groups if whole else MOST_SIGNATURES
    edges = np.array([(k << 64) // groups for k in range(count)] + [min((count << 64) // groups, (1 << 64) - 1)], dtype=np.uint64)
    salts = ts.mix(np.arange(count, dtype=np.uint64) + np.uint64((band + 1) << 32))
    return edges, whole, salts


def signatures(s: np.ndarray, t: Fraction) -> np.ndarray:
    """Hashes of the set's groups in its own band and, if a larger partner can lie there, in the next."""
    sizes, n = bands(t), len(s)
    band = int(np.searchsorted(sizes, n))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ts.mix(s ^ np.uint64(0x3C6EF372FE94F82B)))))
    out = []
    for k in (band, band + 1) if int(n / t) > sizes[band] else (band,):
        edges, whole, salts = division(k, t)
        at = np.searchsorted(s, edges)
        if whole:
            at[-1] = n
        full = at[1:] > at[:-1]
        if whole and full.sum() <= (n + min(int(n / t), sizes[k])) * (t.denominator - t.numerator) // (t.denominator + t.numerator):
            full[:] = True  # as many differences as that set and a partner can have could lie in all groups but empty ones
        out.append(ts.mix((sums[at[1:]] - sums[at[:-1]]) ^ salts)[full])
    return np.concatenate(out)


class CountVectorTree:
    """An R-tree over count vectors, packed in runs of the widest coordinates."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, fanout: int = 8):
        self.order = self._tile(vectors, np.arange(len(vectors)), fanout * fanout, fanout)
        self.vectors, self.sizes, self.fanout = vectors[self.order], sizes[self.order], fanout
        self.levels = []  # (upper corners, least size, largest size), leaves first
        high, low, large = self.vectors, self.sizes, self.sizes
        while len(high) > fanout:
            cuts = np.arange(0, len(high), fanout)
            high, low, large = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(large, cuts)
            self.levels.append((high, low, large))

    def _tile(self, vectors: np.ndarray, rows: np.ndarray, run: int, fanout: int) -> np.ndarray:
        if len(rows) <= fanout:
            return rows
        axis = int(vectors[rows].var(axis=0).argmax())
        rows = rows[np.argsort(vectors[rows, axis], kind="stable")]
        if len(rows) <= run:
            return rows
        half = -(-len(rows) // (2 * fanout)) * fanout
        return np.concatenate((self._tile(vectors, rows[:half], run, fanout), self._tile(vectors, rows[half:], run, fanout)))

    def search(self, vector: np.ndarray, size: int, t: Fraction) -> np.ndarray:
        """Rows that the bound lets link with the set of ``vector`` and ``size``."""
        top = (len(self.levels[-1][0]) if self.levels else len(self.vectors)) if len(self.vectors) else 0
        nodes = np.arange(top)
        for high, low, large in reversed(self.levels):
            nodes = nodes[self._may(vector, size, t, high[nodes], low[nodes], large[nodes])]
            below = (nodes[:, None] * self.fanout + np.arange(self.fanout)).ravel()
            nodes = below
            limit = len(self.vectors) if high is self.levels[0][0] else len(self.levels[[x[0] is high for x in self.levels].index(True) - 1][0])
            nodes = nodes[nodes < limit]
        own = self.sizes[nodes]
        return self.order[nodes[self._may(vector, size, t, self.vectors[nodes], own, own)]]

    @staticmethod
    def _may(vector, size, t, high, low, large) -> np.ndarray:
        p, q = t.numerator, t.denominator
        overlap = np.minimum(vector, high).sum(axis=-1)
        # linked sets a, b overlap in at least t / (1 + t) * (|a| + |b|), and t * |larger| <= |smaller|
        return (overlap * (p + q) >= p * (size + low)) & (q * large >= p * size) & (p * low <= q * size)


def linked(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both * t.denominator >= t.numerator * (len(a) + len(b) - both)


def cell_links(sets: list[np.ndarray], ask: np.ndarray, give: np.ndarray, group: list, t: Fraction) -> list[tuple[int, int]]:
    """Links between rows to ``ask`` for and rows to ``give`` that are needed to connect what is linked.

    ``group``: rows of an equal group are known to be connected.
    """
    vectors = np.array([count_vector(s) for s in sets]).reshape(-1, GROUPS)
    sizes = np.array([len(s) for s in sets])
    given = np.flatnonzero(give)
    tree = CountVectorTree(vectors[given], sizes[given])
    top = list(range(len(sets)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    first: dict = {}
    for i, g in enumerate(group):
        top[find(i)] = find(first.setdefault(g, i))
    out = []
    for i in np.flatnonzero(ask).tolist():
        for j in given[tree.search(vectors[i], int(sizes[i]), t)].tolist():
            a, b = find(i), find(j)
            if a != b and linked(sets[i], sets[j], t):
                top[a] = b
                out.append((i, j))
    return out


def _profile(docs: DataFrame, n: int, t: Fraction, bits: int) -> DataFrame:
    """In one pass: (0, doc_id, both halves of the digest, size, point, hash of the text) of each row and (1, signature, first half)."""
    names = ["kind", "a", "b", "b2", "n", "v", "h"]

    def rows(kind: int, a: pa.Array, b: pa.Array, b2=None, size=None, v=None, h=None) -> pa.RecordBatch:
        m = len(a)
        none = lambda x, kind: pa.nulls(m, kind) if x is None else x
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), a, b, none(b2, pa.int64()), none(size, pa.int64()), none(v, pa.binary()), none(h, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, own, points, sigs, of = [], [], [], [], []
            seen = set()
            for _, _, buf, offsets in ts.slices(batch.column(1)):
                for s in shingle_sets(buf, offsets, n):
                    c = class_of(s, bits) if len(s) else (None, None)
                    size.append(len(s))
                    own.append(c)
                    new = len(s) > 0 and c not in seen
                    points.append(packed_vector(count_vector(s)) if new else None)
                    if new:
                        seen.add(c)
                        x = signatures(s, t)
                        sigs.append(x)
                        of.append(np.full(len(x), c[0], dtype=np.int64))
            first, second = (pa.array([c[k] for c in own], pa.int64()) for k in (0, 1))
            yield rows(0, batch.column(0).cast(pa.int64()), first, second, pa.array(size, pa.int64()), pa.array(points, pa.binary()), batch.column(2))
            if sigs:
                a, b = np.concatenate(sigs).view(np.int64), np.concatenate(of)
                for k in range(0, len(a), 50_000):
                    yield rows(1, pa.array(a[k : k + 50_000].copy()), pa.array(b[k : k + 50_000].copy()))

    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(run, "kind byte, a long, b long, b2 long, n long, v binary, h long")


def _least(doc_id: str, h: str) -> Column:
    """The row of the smallest doc_id, one without any last, then of the smallest hash of the text."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(h).alias("h")))


def _least_reached(may: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that it hangs together with."""
    label = np.arange(len(may))
    while True:
        best = np.minimum(label, np.where(may, label[None, :], len(may)).min(axis=1))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _reach(v: np.ndarray, n: np.ndarray, t: Fraction) -> np.ndarray:
    """For each point the first one that it hangs together with, where points hang together that may link."""
    if len(v) <= SMALL_RUN:
        return _least_reached(np.array([CountVectorTree._may(v[k], n[k], t, v, n, n) for k in range(len(v))]))
    label = np.arange(len(v))
    near = CountVectorTree._may(v[0], n[0], t, v, n, n)
    label[near] = 0
    tree = CountVectorTree(v, n)
    for k in np.flatnonzero(~near).tolist():  # all pairs but those of two points near the first
        met = np.unique(label[tree.search(v[k], int(n[k]), t)])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return label


def _joined(t: Fraction, groups: int = GROUPS):
    """From rows (signature, class, point) sorted by signature: pairs that connect the classes whose points let them link."""

    def pairs(c: np.ndarray, v: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = v.sum(axis=1)
        lengths = ends - starts
        two = starts[lengths == 2]
        ok = CountVectorTree._may(v[two], size[two], t, v[two + 1], size[two + 1], size[two + 1])
        yield c[two[ok]], c[two[ok] + 1]
        for lo, hi in zip(starts[lengths > 2].tolist(), ends[lengths > 2].tolist()):
            top = _reach(v[lo:hi], size[lo:hi], t)
            other = np.flatnonzero(top != np.arange(hi - lo))
            yield c[lo:hi][top[other]], c[lo:hi][other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, groups), np.int32)

        def closed(a, c, v) -> Iterator[pa.RecordBatch]:
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))  # a class comes once for each batch that holds a copy
            a, c, v = a[new], c[new], v[new]
            starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            found = list(pairs(c, v, starts, np.append(starts[1:], len(a))))
            x, y = np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])
            if len(x):
                p = np.unique(np.stack((x, y), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.concatenate((a, batch.column(0).to_numpy()))
            c = np.concatenate((c, batch.column(1).to_numpy()))
            v = np.concatenate((v, unpacked_vectors(batch.column(2), groups)))
            last = int(np.searchsorted(a, a[-1]))
            if last:
                yield from closed(a[:last], c[:last], v[:last])
            a, c, v = a[last:], c[last:], v[last:]
        if len(a):
            yield from closed(a, c, v)

    return run


def _classes(profile: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """A row for each class (c, c0, c2, id, h, n, v), and the first halves that several classes share, if there are any.

    c is the first half of the digest but for all classes except one of those that share it.
    """
    classes = profile.where("kind = 0 and b is not null").groupBy("b", "b2").agg(_least("a", "h").alias("least"), F.max("n").alias("n"), F.min("v").alias("v"))
    classes = materialize(classes.select(F.col("b").alias("c0"), F.col("b2").alias("c2"), "least.id", "least.h", "n", "v"), "classes")
    twice = materialize(classes.groupBy("c0").agg(F.min("c2").alias("first"), F.count("*").alias("many")).where("many > 1").drop("many"), "twice")
    if twice.isEmpty():
        return classes.withColumn("c", F.col("c0")), None
    c = F.when(F.col("first").isNull() | (F.col("first") == F.col("c2")), F.col("c0")).otherwise(F.xxhash64("c0", "c2"))
    return materialize(classes.join(twice, "c0", "left").withColumn("c", c).drop("first"), "classes"), twice


def _dealt(held: DataFrame) -> DataFrame:
    """Rows (component, c, n, ...) with the number of the cluster's cells and the class's own cell."""
    sizes = held.groupBy("component").agg(F.count("*").alias("many"), F.sum("n").alias("shingles"))
    cells = F.greatest(F.ceil(F.col("many") / CELL), F.ceil(F.col("shingles") / CELL_SHINGLES)).cast("int")
    return held.join(sizes.select("component", cells.alias("cells")), "component").withColumn("cell", F.pmod(F.xxhash64("c"), F.col("cells")).cast("int"))


def _cut(large: DataFrame, shared: DataFrame, t: Fraction) -> DataFrame:
    """The rows of large clusters in the clusters that finer points leave of them; a class that these let link with none goes.

    The classes of a signature of more than ``FINE_RUN`` stay with their cluster.
    """
    own = shared.join(large.select("c", "component", "fine"), "c")
    fine = own.where(F.col("many") <= FINE_RUN).select("a", "c", F.col("fine").alias("v"))
    met = fine.repartition("a").sortWithinPartitions("a", "c").mapInArrow(_joined(t, FINE), "a long, b long")
    met = met.unionByName(own.where(F.col("many") > FINE_RUN).select(F.col("component").alias("a"), F.col("c").alias("b")))
    clusters = connected_components(met).withColumnRenamed("node", "c")
    return _dealt(large.drop("component", "cells", "cell", "fine").join(clusters, "c"))


def _components(docs: DataFrame, n: int, t: Fraction, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, h, c0, c2, n_shingles), the component of each class (c0, c2, top), and the least row of each component (top, id, h)."""
    profile = materialize(_profile(docs, n, t, bits), "profile")
    rows = profile.where("kind = 0").select(F.col("a").alias("doc_id"), "h", F.col("b").alias("c0"), F.col("b2").alias("c2"), F.col("n").alias("n_shingles"))
    classes, twice = _classes(profile)
    signed = profile.where("kind = 1").select("a", F.col("b").alias("c0"))
    runs = signed.groupBy("a").agg(F.min("c0").alias("lead"), F.max("c0").alias("last"), F.count("*").alias("many"))
    if twice is None:
        runs = runs.where("lead <> last")
    else:
        runs = runs.join(twice.select(F.col("c0").alias("lead"), F.lit(True).alias("more")), "lead", "left").where("lead <> last or more")
    # lead stands for a class: the one that is known by this number itself
    shared = signed.join(materialize(runs.select("a", "lead", "many"), "runs"), "a")
    shared = shared.withColumnRenamed("c0", "c") if twice is None else shared.join(classes.select("c0", "c"), "c0").drop("c0")
    shared = materialize(shared, "shared")
    near = shared.where(F.col("many") <= LONG_RUN).join(classes.select("c", "v"), "c")
    met = near.select("a", "c", "v").repartition("a").sortWithinPartitions("a", "c").mapInArrow(_joined(t), "a long, b long")
    met = met.unionByName(shared.where(F.col("many") > LONG_RUN).select(F.col("lead").alias("a"), F.col("c").alias("b")))
    clusters = connected_components(met)
    # one document of each class in a cluster, with its text
    held = _dealt(classes.select("c", "c0", "c2", "id", "h", "n").join(clusters.withColumnRenamed("node", "c"), "c"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row can be given several times: keep one for the class. Adds the points of what is in a large cluster."""
        seen = set()
        for batch in batches:
            c = list(zip(batch.column("c0").to_pylist(), batch.column("c2").to_pylist(), strict=True))
            large = np.asarray(batch.column("cells")) > 1
            for lo, _, buf, offsets in ts.slices(batch.column("text")):
                keep, vectors, fine = [], [], []
                for k, s in enumerate(shingle_sets(buf, offsets, n)):
                    if len(s) and c[lo + k] not in seen and class_of(s, bits) == c[lo + k]:
                        seen.add(c[lo + k])
                        keep.append(lo + k)
                        vectors.append(count_vector(s).tolist() if large[lo + k] else None)
                        fine.append(packed_vector(count_vector(s, FINE)) if large[lo + k] else None)
                if keep:
                    points = [pa.array(vectors, pa.list_(pa.int64())), pa.array(fine, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).columns, *points], names=[*batch.schema.names, "vector", "fine"])

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), text.alias("text"), F.xxhash64(text).alias("own_h"))
    held = held.join(texts, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h"))).select("component", "cells", "cell", "c", "c0", "c2", "n", "text")
    held = materialize(held.mapInArrow(check, "component long, cells int, cell int, c long, c0 long, c2 long, n long, text string, vector array<long>, fine binary").drop("c0", "c2"), "held")

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        return [s for _, _, buf, offsets in ts.slices(table.column("text")) for s in shingle_sets(buf, offsets, n)]

    def links(table: pa.Table, ask: np.ndarray, give: np.ndarray, group: list) -> pa.Table:
        c = table.column("c").to_numpy()
        found = cell_links(sets_of(table), ask, give, group, t)
        return pa.table({"a": c[[i for i, _ in found]].astype(np.int64), "b": c[[j for _, j in found]].astype(np.int64)})

    def within(table: pa.Table) -> pa.Table:
        every = np.ones(table.num_rows, dtype=bool)
        return links(table, every, every, table.column("c").to_pylist())

    inside = held.where("cells = 1").select("component", "cell", "c", "text")
    large = held.where("cells > 1")
    if not large.isEmpty():
        large = materialize(_cut(large, shared, t), "large")
        inside = inside.unionByName(large.select("component", "cell", "c", "text"))
        large = large.where("cells > 1")
    any_large = not large.isEmpty()
    if any_large:
        # the sets nearest to a large cluster's mean point go to all of its cells
        mean = large.groupBy("component").agg(*(F.avg(F.col("vector")[k]).alias(f"m{k}") for k in range(GROUPS)))
        mean = mean.select("component", F.array(*(f"m{k}" for k in range(GROUPS))).alias("mean"))
        away = F.aggregate(F.zip_with("vector", "mean", lambda x, m: F.abs(x - m)), F.lit(0.0), lambda a, x: a + x)
        near = large.join(mean, "component").groupBy("component", F.pmod("c", F.lit(PIVOTS)).alias("k")).agg(F.min(F.struct(away.alias("away"), F.col("c").alias("c"))).alias("best"))
        pivots = large.join(near.select(F.col("best.c").alias("c")).distinct(), "c").select("component", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "c", "text")
        inside = inside.unionByName(pivots)
    edges = materialize(inside.groupBy("component", "cell").applyInArrow(within, "a long, b long"), "links")
    if any_large:
        edges = edges.unionByName(_across(large, shared.select("a", "c"), edges, links))
    joined = connected_components(edges).select(F.col("node").alias("c"), F.col("component").alias("top"))
    tops = classes.select("c", "c0", "c2", "id", "h").join(joined, "c", "left").select("c0", "c2", "id", "h", F.coalesce("top", "c").alias("top"))
    least = tops.groupBy("top").agg(_least("id", "h").alias("least")).select("top", "least.id", "least.h")
    return rows, tops.select("c0", "c2", "top"), least


def components(docs: DataFrame, n: int = 5, threshold: str = "0.8", bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. Sets link at a Jaccard similarity of ``threshold`` or more.

    ``bits`` of a digest's first half are used to tell classes apart at first; it never changes the result.
    """
    with scope() as made:
        rows, tops, least = _components(docs, n, Fraction(threshold), bits)
        named = materialize(tops.join(least, "top").select("c0", "c2", F.col("id").alias("component_id")), "named")
    release(*made[1:-1])  # rows reads the first
    return rows.join(named, ["c0", "c2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _across(large: DataFrame, shared: DataFrame, edges: DataFrame, links) -> DataFrame:
    """Links between the cells of a cluster, for the classes that aren't connected with most of it.

    Two linked sets share a signature, so such a class is given to the cells
    that hold one of its signatures, however many of their classes do.
    """
    known = connected_components(edges).select(F.col("node").alias("c"), F.col("component").alias("top"))
    large = large.select("component", "cells", "cell", "c", "text").join(known, "c", "left").withColumn("top", F.coalesce("top", "c"))
    large = materialize(large, "large")
    main = large.groupBy("component", "top").count().groupBy("component").agg(F.max(F.struct("count", "top")).alias("best")).select("component", F.col("best.top").alias("main"))
    apart = large.join(main, "component").where(F.col("top") != F.col("main")).select("component", "c", "text", "top", F.col("cell").alias("from"))
    asking = materialize(shared.join(apart.select("c", "component", "from"), "c"), "asking")
    cells = shared.join(asking.select("a").distinct(), "a", "left_semi").join(large.select("c", "component", "cell"), "c").select("a", "component", "cell").distinct()
    to = asking.join(cells, ["a", "component"]).where(F.col("cell") != F.col("from")).select("c", "component", "from", "cell").distinct()
    to = materialize(to, "asked")
    ask = apart.drop("from", "component").join(to, "c").select("component", "c", "text", "top", "from", "cell", F.lit(True).alias("ask"))
    asked = to.select("component", "cell", "from").distinct()
    give = large.select("component", "c", "text", "top", "cell").join(asked, ["component", "cell"]).select("component", "c", "text", "top", "from", "cell", F.lit(False).alias("ask"))
    pairs = ask.unionByName(give)

    def between(table: pa.Table) -> pa.Table:
        asks = table.column("ask").to_numpy(zero_copy_only=False)
        if asks.all() or not asks.any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        return links(table, asks, ~asks, table.column("top").to_pylist())

    return materialize(pairs.groupBy("component", "from", "cell").applyInArrow(between, "a long, b long"), "links-across")


def keep_one(docs: DataFrame, n: int = 5, threshold: str = "0.8") -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest doc_id and then hash of its text; empty texts all stay."""
    with scope() as made:
        rows, _, least = _components(docs, n, Fraction(threshold))
        given = rows.where("c0 is not null").groupBy("doc_id", "h").agg(F.count("*").alias("many"))
        least = least.select(F.col("id").alias("l_id"), F.col("h").alias("l_h"))
        own_id, own_h, many = own_names(docs, "id", "h", "rows")
        kept = given.join(least, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("h") == F.col("l_h")))
        kept = materialize(kept.select(F.col("l_id").alias(own_id), F.col("l_h").alias(own_h), F.col("many").alias(many)), "kept")
    release(*made[:-1])
    text = docs["text"].cast("string")
    empty = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    joined = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[own_id]) & (F.xxhash64(text) == kept[own_h]), "left")
    single = joined.where(empty | (F.col(many) == 1)).select(*docs.columns)
    if kept.where(F.col(many) > 1).isEmpty():
        return single
    # the same doc_id and text given more than once: one of the rows
    again = joined.where(~empty & (F.col(many) > 1)).dropDuplicates([own_id, own_h]).select(*docs.columns)
    return single.unionByName(again)
