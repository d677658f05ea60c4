"""Outputs: the lines of each input in order, the log of a run, or nothing.

``LinesDataSource`` writes one text file for each path. A task writes what it has
into a folder beside the target that readers don't see, and says where; the
driver moves files to their names once all tasks are done. A task that is killed
or done again leaves nothing under a name that is read.
"""

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI names, and the path there."""
    for other in ("s3a://", "s3n://"):
        if path.startswith(other):
            path = "s3://" + path.removeprefix(other)
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


#: lines that are put together before they reach the task that writes their file
BLOCK = 16


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where it is, and what it is to be called


class _LinesWriter(DataSourceArrowWriter):
    """Rows (path, line), equal paths next to each other, to a file for each path."""

    def __init__(self, options: dict):
        self.job = f"_writing-{options.get('job', uuid.uuid4().hex)}"
        self.paths = json.loads(options.get("paths", "[]"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done, now, out = [], None, None
        try:
            for batch in iterator:
                for path, line in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist(), strict=True):
                    if path != now:
                        if out:
                            out.close()
                        now = path
                        system, place = file_system(path)
                        folder = posixpath.join(posixpath.dirname(place), self.job)
                        system.create_dir(folder, recursive=True)
                        own = posixpath.join(folder, uuid.uuid4().hex)
                        out = system.open_output_stream(own)
                        done.append((own, path))
                    out.write((line or "").encode() + b"\n")
        finally:
            if out:
                out.close()
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        moved = set()
        for own, path in (x for m in messages if m for x in m.files):
            if path in moved:
                raise ValueError(f"{path} was written by more than one task: rows of a path have to lie together")
            moved.add(path)
            system, place = file_system(path)
            if system.get_file_info(place).type == fs.FileType.Directory:
                system.delete_dir(place)
            system.move(own, place)
        for path in self.paths:
            if path not in moved:  # an input without records
                system, place = file_system(path)
                system.open_output_stream(place).close()
        self._clear(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(messages)

    def _clear(self, messages: list[WriterCommitMessage | None]) -> None:
        targets = {*self.paths, *(path for m in messages if m for _, path in m.files)}
        for folder in {posixpath.join(posixpath.dirname(x), self.job) for x in targets}:
            system, place = file_system(folder)
            if system.get_file_info(place).type == fs.FileType.Directory:
                system.delete_dir(place)


class LinesDataSource(DataSource):
    """``df.write.format("lines")``. Options: job (a name of its own for each write), paths (JSON: files that have to be there also without a line)."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "path string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _LinesWriter(self.options)


def write_lines(output: DataFrame, path: str, suppress: bool = False) -> None:
    """Write (file_id, pos, line) as text below file_id=...; a file's lines keep the order of pos, read by the names of the parts.

    Rows are dealt to ranges of (file_id, pos), so one large file is written by many tasks.
    """
    if suppress:
        output.write.format("noop").mode("overwrite").save()
        return
    ordered = output.repartitionByRange("file_id", "pos").sortWithinPartitions("file_id", "pos")
    ordered.select("file_id", "line").write.partitionBy("file_id").mode("overwrite").text(path)


def write_outputs(output: DataFrame, paths: dict[int, str], suppress: bool = False) -> None:
    """Each input's lines in the order of pos as one file, at the path that ``paths`` names for it.

    A file is written by one task, from sorted blocks of lines, which many tasks have put together, and without holding them; ``write_lines`` shares
    one input's lines among many tasks, as a folder of parts.
    """
    if suppress:
        output.write.format("noop").mode("overwrite").save()
        return
    spark = output.sparkSession
    spark.dataSource.register(LinesDataSource)
    named = spark.createDataFrame(list(paths.items()), "file_id int, path string")  # the inputs, a list that the driver has
    own = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("line", F.lit("")).alias("line"))))
    blocks = output.groupBy("file_id", F.floor(F.col("pos") / BLOCK).alias("_block")).agg(F.array_join(own["line"], "\n").alias("line"))
    rows = blocks.withColumnRenamed("_block", "pos").join(F.broadcast(named), "file_id").repartition("path").sortWithinPartitions("path", "pos").select("path", "line")
    rows.write.format("lines").mode("append").options(job=uuid.uuid4().hex, paths=json.dumps(list(paths.values()))).save()


def write_text(lines: DataFrame, path: str) -> None:
    """Lines (n, value) as one text file in the order of n: a log has a line for each bucket."""
    lines.coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One CSV file with a header: there is a row per bucket."""
    metrics.coalesce(1).sortWithinPartitions("Batch").write.mode("overwrite").option("header", True).csv(path)
