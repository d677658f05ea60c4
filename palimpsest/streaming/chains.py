"""Sorted chains that grow by batches: a chain's bucket is all that the chain holds, in order, whatever batches its rows came in.

A batch is written once, sorted, with a folder for each chain. As soon as ``fan``
tables of one level are there they are written again as one of the next
level, so a row is written once for each level, of which there are as many as the
logarithm of the number of batches. Handing out a bucket reads only the folders of its
chain; ranges of it are sorted by many tasks. What is counted on the
driver is a number for each table and each of at most 64 chains.
"""

import json
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import bucketing
from palimpsest.storage import remove


@dataclass
class SortedChains:
    """Rows (file_id, header, sequence, plus, quality, arrival, chain) of batches from 1 on, under ``folder``.

    Batch b starts from what version b - 1 holds, also after a restart or if b is run again. A version
    counts once its manifest is there. Rows without a chain are a chain of their own, the first. Arrivals decide between
    rows that are equal otherwise, so they have to be the same in whatever batches rows come. An empty batch
    is a version like any other.
    """

    spark: SparkSession
    folder: str
    mode: str = "intended"
    fan: int = 8

    def __post_init__(self):
        self.folder = self.folder.rstrip("/")
        self._set({"batch": 0, "turn": 0, "given": 0, "tables": [], "dropped": [], "schema": None})

    def _set(self, kept: dict) -> None:
        self.batch, self.turn, self.given = kept["batch"], kept["turn"], kept["given"]
        self.tables = [(name, level, dict(map(tuple, counts))) for name, level, counts in kept["tables"]]
        self.schema = T.StructType.fromJson(kept["schema"]) if kept["schema"] else None
        self.dropped = kept["dropped"]  # tables that only the version before refers to

    def _commit(self) -> None:
        tables = [(name, level, list(counts.items())) for name, level, counts in self.tables]
        kept = {"batch": self.batch, "turn": self.turn, "given": self.given, "tables": tables, "dropped": self.dropped, "schema": self.schema and self.schema.jsonValue()}
        row = self.spark.createDataFrame([(json.dumps(kept),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.folder}/version={self.batch}/manifest")

    def start(self, batch: int) -> None:
        """Take up the version before ``batch``, unless it is the one at hand."""
        if self.batch == batch - 1:
            return
        if batch == 1:
            self.__post_init__()
            return
        self._set(json.loads(self.spark.read.text(f"{self.folder}/version={batch - 1}/manifest").first()[0]))

    def _read(self, tables: list[tuple[str, int, dict]], chains: list) -> DataFrame:
        """The rows that ``tables`` have of ``chains``; other chains' folders aren't read."""
        found = []
        for name, _, counts in tables:
            if own := [c for c in chains if c in counts]:
                rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}")
                asked = F.col("chain").isin([c for c in own if c is not None])
                found.append(rows.where(asked | F.col("chain").isNull() if None in own else asked))
        return reduce(DataFrame.unionByName, found)

    def _write(self, rows: DataFrame, name: str, level: int) -> None:
        by = ["chain", *bucketing.SORTED_BY[self.mode], "arrival"]
        path = f"{self.folder}/{name}"
        rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("chain").parquet(path)
        counts = {r.chain: r.n for r in self.spark.read.schema(self.schema).parquet(path).groupBy("chain").agg(F.count("*").alias("n")).collect()}
        if counts:
            self.tables.append((name, level, counts))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Hold a batch's rows."""
        self.start(batch)
        rows = rows.withColumn("chain", F.col("chain").cast("int"))
        self.schema = self.schema or rows.schema
        old, self.dropped, self.batch = self.dropped, [], batch
        self._write(rows, f"version={batch}/rows", 0)
        level = 0
        while len(own := [t for t in self.tables if t[1] == level]) >= self.fan:
            self.tables = [t for t in self.tables if t[1] != level]
            self._write(self._read(own, list({c for t in own for c in t[2]})), f"version={batch}/level={level + 1}", level + 1)
            self.dropped += [t[0] for t in own]
            level += 1
        self._commit()
        for name in old:
            remove(self.spark, f"{self.folder}/{name}")
        remove(self.spark, f"{self.folder}/version={batch - 2}/manifest")

    @property
    def held(self) -> dict:
        """The rows of each chain that has some."""
        return dict(sum((Counter(counts) for _, _, counts in self.tables), Counter()))

    def next_bucket(self) -> DataFrame | None:
        """The bucket of the first chain that has rows, which is empty then; None when all are."""
        chains = self._in_turn()
        return self._take(chains[:1]) if chains else None

    def drain(self) -> DataFrame | None:
        """The buckets of all chains in turn."""
        chains = self._in_turn()
        return self._take(chains) if chains else None

    def _in_turn(self) -> list:
        """No chain has more than one bucket, so all are equally long and the lowest number is next."""
        return sorted(self.held, key=lambda c: (c is not None, c))

    def _take(self, chains: list) -> DataFrame:
        """Rows of the chains with bucket and pos, which go on over all that has been handed out; kept as a table of its own."""
        held, turns, given = self.held, [], self.given
        for k, c in enumerate(chains):
            turns.append((c, self.turn + k + 1, given))
            given += held[c]
        starts = self.spark.createDataFrame(turns, "_chain int, bucket long, _before long")
        rows = bucketing.sorted_chain(self._read(self.tables, chains), self.mode).drop("bucket")
        rows = rows.join(F.broadcast(starts), F.col("chain").eqNullSafe(F.col("_chain")))
        path = f"{self.folder}/buckets/from={self.turn + 1}"
        rows.withColumn("pos", F.col("_before") + F.col("pos")).drop("_chain", "_before").write.mode("overwrite").parquet(path)
        for _, _, counts in self.tables:
            for c in chains:
                counts.pop(c, None)
        self.dropped = [*self.dropped, *(name for name, _, counts in self.tables if not counts)]
        self.tables = [t for t in self.tables if t[2]]
        self.turn, self.given = self.turn + len(chains), given
        self._commit()
        return self.spark.read.parquet(path)


def run_stream(spark: SparkSession, source: str, schema: str, chains: SortedChains, checkpoint: str) -> None:
    """Add all rows that lie in ``source`` as Parquet files, a batch for each file in the order of their times; a restart goes on."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = rows.writeStream.foreachBatch(lambda df, b: chains.add(df, b + 1)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
