"""Near duplicates among embeddings.

Equal vectors are one class. Classes get sign codes under random hyperplanes in
several tables. Codes are counted without their vectors; only classes that share
a code in a table are given their vectors and compared by exact cosine in double
precision, scaled by a power of two first, so that no square overflows. A pair is counted in the first table in which it
meets, so counts need no list of pairs. Inside a bucket only a spanning forest
of the links is kept, and distributed connected components joins the forests.
A bucket of more than ``bucket`` classes is cut into parts whose pairs are
separate tasks, so no task holds more than two parts; as every direct link of a
vector is counted, a group of near copies takes as many comparisons as it has
pairs.

Bits grow with the logarithm of the number of vectors, so that a code has
``per_bucket`` classes on average: fewer make more tables, each of which ships the
vectors again, more make more comparisons. The number of tables follows from the bits, so that a pair exactly at the threshold is met with the
chance ``recall``; closer pairs are met more often. Both are the same rule at
every size.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths don't link; repeated
rows are vectors of their own with the same id; ``label`` and other columns are
ignored; an empty table gives no rows.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .storage import materialize


def tables_for(bits: int, threshold: float, recall: float) -> int:
    """Tables with which a pair at ``threshold`` shares a code of ``bits`` with the chance ``recall``."""
    one = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row as doubles, times the power of two that brings its largest component below 1."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row the smallest row that it hangs together with in the symmetric matrix ``linked``."""
    n = len(linked)
    label = np.arange(n)
    has = linked.any(1)
    while has.any():
        best = np.minimum(label, np.where(linked, label[None, :], n).min(1))
        best = np.minimum(best, best[best])
        if (best == label).all():
            break
        label = best
    return label


def embedding_links(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.98, per_bucket: int = 256, bucket: int = 1024, seed: int = 7) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    kind = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "array<double>"  # floats are doubles as they are
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast(kind).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce((F.size("v") > 0) & ~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    digest = F.struct(F.xxhash64("v").alias("x"), F.crc32(F.col("v").cast("string")).alias("y"), F.size("v").alias("d"))
    rows = materialize(rows.select("vec_id", F.when(usable, digest).alias("k"), F.when(usable, F.col("v")).alias("v")), "vectors")
    # a class is known by its smallest vec_id; repeated rows of that id are one of its vectors each
    classes = rows.where("k is not null").groupBy("k").agg(F.min("vec_id").alias("id"), F.count("*").alias("many"), F.min("v").alias("v"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("c"), "k", "id", "many", "v"), "classes")
    n = classes.count()
    bits = max(6, math.ceil(math.log2(max(n, 1) / per_bucket))) if n else 6
    tables = tables_for(bits, threshold, recall)
    power = (1 << np.arange(bits, dtype=np.int64)).astype(np.float64)
    names = ["c", "many", "v", "codes"]
    code, code_type = ("int", np.int32) if bits < 32 else ("long", np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            codes = np.zeros((batch.num_rows, tables), dtype=code_type)
            v = batch.column("v")
            lengths = np.diff(v.offsets.to_numpy())
            flat, starts = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(lengths)))
            for d in np.unique(lengths).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
                own = np.flatnonzero(lengths == d)
                for part in np.array_split(own, -(-len(own) // 2048)):
                    x = _scaled(flat[starts[part][:, None] + np.arange(d)])
                    codes[part] = ((x @ planes[d] > 0).reshape(len(part), tables, bits) @ power).astype(code_type)
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("many"), v, out], names=names)

    coded = materialize(classes.select("c", "many", "v").mapInArrow(encode, f"c long, many long, v {kind}, codes array<{code}>"), "codes")
    key = ["t", "code", "d"]
    posted = coded.select("c", F.size("v").alias("d"), F.posexplode("codes").alias("t", "code"))
    shared = posted.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    posted = posted.join(shared, key).join(coded, "c").withColumn("parts", F.ceil(F.col("n") / bucket).cast("int"))
    posted = posted.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    posted = posted.withColumn("codes", F.slice("codes", F.lit(1), F.col("t")))  # a bucket asks only whether a pair has met in a table before its own
    posted = posted.withColumn("other", other).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))

    def compare(table: pa.Table) -> pa.Table:
        t = table.column("t")[0].as_py()
        c, many, part = (table.column(x).to_numpy() for x in ("c", "many", "part"))
        order = np.argsort(c, kind="stable")
        c, many, part = c[order], many[order], part[order]
        d = table.column("d")[0].as_py()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)[order]
        codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(c), t)[order]
        x = _scaled(x)
        x = x / np.sqrt((x * x).sum(1))[:, None]
        across = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        links = np.zeros(len(c), dtype=np.int64)
        linked = np.zeros((len(c), len(c)), dtype=bool)
        for k in range(0, len(c), 512):
            own = slice(k, k + 512)
            near = x[own] @ x.T >= threshold
            near[np.arange(near.shape[0]), np.arange(k, k + near.shape[0])] = False
            if across:
                near &= part[own][:, None] != part[None, :]
            linked[own] = near
            i, j = np.nonzero(near)
            if t and len(i):
                first = ~(codes[i + k] == codes[j]).any(1)
                i, j = i[first], j[first]
            links[own] += np.bincount(i, weights=many[j], minlength=near.shape[0]).astype(np.int64)
        linked |= linked.T
        top = _forest(linked)
        hangs = np.flatnonzero(top != np.arange(len(c)))
        counted = np.flatnonzero(links)
        out_a = np.concatenate((c[counted], c[hangs]))
        out_b = np.concatenate((links[counted], c[top[hangs]]))
        kind = np.repeat(np.array([0, 1], dtype=np.int8), [len(counted), len(hangs)])
        return pa.table({"edge": pa.array(kind == 1), "a": out_a, "b": out_b})

    columns = ["t", "code", "d", "lo", "hi", "part", "c", "many", "v", "codes"]
    found = posted.select(*columns).groupBy("t", "code", "d", "lo", "hi").applyInArrow(compare, "edge boolean, a long, b long")
    found = materialize(found, "found")
    labels = connected_components(found.where("edge").select("a", "b"))
    links = found.where(~F.col("edge")).groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "c")
    known = classes.select("c", "k", "id", "many").join(links, "c", "left").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = known.groupBy("component").agg(F.min("id").alias("component_id"))
    known = known.join(least, "component").select("k", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "k").join(known, "k", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
