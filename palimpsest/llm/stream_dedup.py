"""Exact duplicates of texts, kept in the state of a stream.

Documents are read as a stream. Its state is keyed by the text's digest, never
expires and lives on disk (RocksDB, its changes in the checkpoint): how many rows
had that digest, the identifier and place of the one that stays, and the place of
the first text, the content that every later one is compared with. New files
only touch the keys that they hold, and a run goes on where the last one ended.

What the state takes for copies is checked on full bytes: a group whose smallest
and largest text are equal has one text. Texts of a group that differ from its
content (another text with an equal digest) go on to the next level, a stream of
its own with another digest.

Only column expressions are used; the driver calls Spark once for each micro-batch.
"""

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, release

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: set while a stream starts; it keeps them
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no megabytes of disk laid by for each small store
}
#: a group with more than this share of all rows is hot; there are fewer such groups than its inverse
HOT_SHARE = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256_digest(text: Column, level: int) -> Column:
    """The key of a text at a level; each level has a digest of its own."""
    return F.unhex(F.sha2(text if not level else F.concat(F.lit(f"{level}:"), text), 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass
class StreamDedup:
    """Deduplicates the Parquet files under ``source``, present and future ones.

    ``folder`` (shared) keeps checkpoint and state; a new object over the same
    folder goes on with them. ``batch_bytes`` bounds a micro-batch by its files'
    bytes. Rows are told apart by their place (file and row), so repeated rows and
    ids are rows of their own; of equal texts the row with the largest ``id_column``
    stays (null is smaller than any), of equal ids the one that arrived last.
    Files arrive by modification time, then name, and must not change. Other
    columns are ignored, whatever their names.
    """

    spark: SparkSession
    source: str
    folder: str
    id_column: str = "doc_id"
    text_column: str = "text"
    batch_bytes: int = 64 << 30
    digest: Callable[[Column, int], Column] = sha256_digest
    level: int = 0
    deeper: "StreamDedup | None" = field(default=None, init=False)

    def _rows(self, df: DataFrame) -> DataFrame:
        """id, text, place and digest of each row."""
        file = df.metadataColumn("_metadata")
        text = df[self.text_column] if self.level else normalised(df[self.text_column])
        place = F.struct(file["file_modification_time"].alias("time"), file["file_path"].alias("file"), file["row_index"].alias("row"))
        rows = df.select(df[self.id_column].alias("id"), text.alias("text"), place.alias("place"))
        return rows.select("id", "text", "place", self.digest(F.col("text"), self.level).alias("digest"))

    def rows(self) -> DataFrame:
        return self._rows(self.spark.read.parquet(self.source))

    def absorb(self) -> None:
        """Take in all files that haven't been, in micro-batches."""
        path = self.source.rstrip("/")
        pattern = path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file by a pattern only
        with _settings(self.spark, SETTINGS):
            stream = self.spark.readStream.schema(self.spark.read.parquet(self.source).schema).option("maxBytesPerTrigger", str(self.batch_bytes)).parquet(pattern)
            kept = F.max(F.struct("id", "place")).alias("keep")
            state = self._rows(stream).groupBy("digest").agg(F.count("*").alias("n"), kept, F.min("place").alias("content"))
            out = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True)
            run = out.foreachBatch(lambda changed, batch: changed.write.mode("overwrite").parquet(f"{self.folder}/changed/batch={batch}")).start()
            run.awaitTermination()

    def states(self) -> DataFrame:
        """The state as it is now: digest, n, keep (id, place), content (place). A batch's changes are written under its number, so one that is done again replaces them."""
        changed = self.spark.read.parquet(f"{self.folder}/changed")
        return changed.groupBy("digest").agg(F.max(F.struct("n", "keep", "content")).alias("s")).select("digest", "s.*")

    def documents(self) -> DataFrame:
        """All rows absorbed so far: id, place, group_size, keep_id, kept, text_sha256 (of the normalised text, lower-case hex)."""
        states = materialize(self.states(), "states")
        collided = materialize(self._collided(states), "collided")
        if collided.isEmpty():
            release(collided)
            return self._joined(self.rows(), states)
        return self._with_deeper(states, collided)

    def _joined(self, rows: DataFrame, states: DataFrame) -> DataFrame:
        sha = F.hex("digest") if self.digest is sha256_digest and not self.level else F.sha2("text", 256)
        light = rows.select("id", "place", "digest", F.lower(sha).alias("text_sha256"))
        whole = states.select("digest", F.col("n").alias("group_size"), F.col("keep.id").alias("keep_id"), F.col("keep.place").alias("_keep"))
        return light.join(whole, "digest").select("id", "place", "group_size", "keep_id", (F.col("place") == F.col("_keep")).alias("kept"), "text_sha256")

    def _collided(self, states: DataFrame) -> DataFrame:
        """Digests of groups that hold different texts, with the place of their content.

        Only groups of several rows are looked at. Rows of hot groups meet their state by broadcast and are
        aggregated where they lie; those of the others are shuffled once for join and aggregate.
        """
        total = states.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        several = states.where(F.col("n") > 1).select("digest", "n", "content")
        hot = several.where(F.col("n") * HOT_SHARE > total).select("digest", "content")  # fewer than HOT_SHARE
        cold = several.where(F.col("n") * HOT_SHARE <= total).select("digest", "content")
        rows, found = self.rows().select("digest", "text"), []
        for part, own in ((F.broadcast(hot), hot), (cold, cold)):
            ends = rows.join(part.select("digest"), "digest").groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
            found.append(ends.where(F.col("lo") != F.col("hi")).select("digest").join(own, "digest"))
        return found[0].unionByName(found[1])

    def _with_deeper(self, states: DataFrame, collided: DataFrame) -> DataFrame:
        """The groups of ``collided`` row by row: what equals the content is its group, the rest is deduplicated with another digest."""
        fine = self._joined(self.rows().join(collided.select("digest"), "digest", "left_anti"), states)
        odd = materialize(self.rows().join(collided, "digest"), "odd")
        content = odd.where(F.col("place") == F.col("content")).select("digest", F.col("text").alias("_text"))
        odd = odd.join(content, "digest")
        same = odd.where(F.col("text") == F.col("_text"))
        groups = same.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "place")).alias("keep"), F.any_value("content").alias("content"))
        rest = materialize(odd.where(F.col("text") != F.col("_text")).select(F.struct("id", "place").alias("id"), "text"), "rest")
        self.deeper = StreamDedup(self.spark, rest.table_path, f"{rest.table_path}-state", "id", "text", self.batch_bytes, self.digest, self.level + 1)
        self.deeper.absorb()
        below = self.deeper.documents().select(F.col("id.id").alias("id"), F.col("id.place").alias("place"), "group_size", F.col("keep_id.id").alias("keep_id"), "kept", "text_sha256")
        return fine.unionByName(self._joined(same, groups)).unionByName(below)
