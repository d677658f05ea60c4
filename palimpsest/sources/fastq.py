"""FASTQ and FASTA files as a Spark data source, and the inputs' arrival order.

    spark.dataSource.register(ReadsDataSource)
    spark.read.format("reads").option("path", folder).option("pattern", r".*\\.fastq").load()

Options: path (a folder that all nodes see), pattern (matched against the whole
file name), format (fastq or fasta), require_trailing_newline (true drops a
last record whose last line isn't ended), split_bytes (a file is cut into stretches
of so many bytes; a task reads one, or neighbouring small ones together). Files are numbered by name. A task reads the
records whose first line begins in its stretches; rec_idx holds the
stretch's number in its upper bits, so it is the record's number in a file of
one stretch and grows with the file in any. ``with_arrival`` takes both.

``scan`` reads the same records without Python, from any path that Spark reads;
runs of control files use it. The data source is for formats of one's own and for
folders that all nodes see.
"""

import os
import re
import sys
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from palimpsest.functions.keys import output_path
from palimpsest.sources.sinks import file_system
from palimpsest.storage import materialize

#: splits, a row of 28 bytes each, that may be broadcast; more are joined by a shuffle
MOST_SPLITS = 1_000_000
SCHEMA = "file_id int, rec_idx long, header string, sequence string, plus string, quality string"
SPLIT_BITS = 40
#: stretches are read together up to so many bytes, so that tasks grow in number with the input's bytes, not with its stretches
TASK_BYTES = 1 << 20


class Parser:
    """Records of ``lines`` lines each. ``begins``: whether a record can begin at the first of these lines (without their ends). ``whole``: whether these lines are one."""

    def __init__(self, lines: int, begins: Callable[[list[bytes]], bool], fields: Callable[[list[str]], tuple] | None = None, whole: Callable[[list[bytes]], bool] | None = None):
        self.lines, self.begins, self.whole = lines, begins, whole
        self.fields = fields or (lambda own: (*own, *[None] * (4 - len(own))))


#: a quality line can begin with @ too, but then the next line but one is a sequence
PARSERS = {
    "fastq": Parser(4, lambda x: x[0][:1] == b"@" and len(x) > 2 and x[2][:1] == b"+", whole=lambda x: x[0][:1] == b"@" and x[2][:1] == b"+" and len(x[1]) == len(x[3])),
    "fasta": Parser(2, lambda x: x[0][:1] == b">"),
}


def list_inputs(path: str, pattern: str) -> list[str]:
    if not os.path.isdir(path):
        raise FileNotFoundError(f"{path} is no folder")
    found = sorted(x for x in os.listdir(path) if re.fullmatch(pattern, x) and os.path.isfile(os.path.join(path, x)))
    if not found:
        raise FileNotFoundError(f"no file in {path} matches {pattern}")
    return [os.path.join(path, x) for x in found]


def _first_record(f: BinaryIO, start: int, parser: Parser) -> int:
    """Where the first record begins whose first line begins at ``start`` or later."""
    if not start:
        return 0
    f.seek(start - 1)
    f.readline()  # to the end of the line that reaches into the stretch, or that ends right before it
    places, lines = [f.tell()], []
    while len(lines) < 2 * parser.lines and (line := f.readline()):
        lines.append(line.rstrip(b"\r\n"))
        places.append(f.tell())
    for k in range(len(lines)):
        if parser.begins(lines[k:]):
            return places[k]
    if len(lines) == 2 * parser.lines:
        raise ValueError(f"{f.name}: no record begins near byte {start}")
    return places[-1]  # the file's end: what is left belongs to the record before


def parse(f: BinaryIO, kind: str | Parser, require_newline: bool = False, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    """Records (header, sequence, plus, quality) that begin from ``start`` on and before ``end``; an incomplete last record is dropped."""
    parser = PARSERS[kind] if isinstance(kind, str) else kind
    at = _first_record(f, start, parser) if start else 0
    f.seek(at)
    while end is None or at < end:
        own = [f.readline() for _ in range(parser.lines)]
        if not own[-1] or require_newline and not own[-1].endswith(b"\n"):
            return
        if parser.whole and not parser.whole([x.rstrip(b"\r\n") for x in own]):
            raise ValueError(f"{getattr(f, 'name', 'input')}: no record at byte {at}")
        at += sum(map(len, own))
        yield parser.fields([x.decode(errors="replace").rstrip("\r\n") if x.endswith(b"\n") else x.decode(errors="replace") for x in own])


class _Stretches(InputPartition):
    """Neighbouring stretches of one or more files: runs (file_id, path, numbers of its stretches, how many the file has)."""

    def __init__(self, runs: list[tuple[int, str, range, int]]):
        self.runs = runs


class ReadsReader(DataSourceReader):
    batch = 20_000

    def __init__(self, options: dict, parser: Parser | None = None):
        kind = options.get("format", "fastq")
        if parser is None and kind not in PARSERS:
            raise ValueError(f"format={kind}: fastq or fasta")
        self.parser = parser or PARSERS[kind]
        self.require = options.get("require_trailing_newline", "false").lower() == "true"
        self.split = int(options.get("split_bytes", 128 << 20))
        self.paths = list_inputs(options["path"], options.get("pattern", r".*\." + kind))

    def partitions(self):
        most = max(TASK_BYTES // self.split, 1)
        out, own, room = [], [], most
        for k, path in enumerate(self.paths):
            n, at = -(-max(os.path.getsize(path), 1) // self.split), 0
            while at < n:
                end = min(at + room, n)
                own.append((k, path, range(at, end), n))
                at, room = end, room - (end - at)
                if not room:
                    out.append(_Stretches(own))
                    own, room = [], most
        return [*out, _Stretches(own)] if own else out

    def read(self, partition):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int32(), pa.int64(), *[pa.string()] * 4]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return made

        for file_id, path, numbers, n in partition.runs:
            with open(path, "rb") as f:
                for number in numbers:
                    start, base = number * self.split, number << SPLIT_BITS
                    for k, record in enumerate(parse(f, self.parser, self.require, start, start + self.split if number + 1 < n else None)):
                        rows.append((file_id, base + k, *record))
                        if len(rows) == self.batch:
                            yield out()
        if rows:
            yield out()


class ReadsDataSource(DataSource):
    parser: Parser | None = None

    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReadsReader(self.options, self.parser)


def reads_source(source_name: str, own_parser: Parser) -> type[DataSource]:
    """A data source of one's own format: register it and read it by ``source_name``."""

    class Own(ReadsDataSource):
        parser = own_parser

        @classmethod
        def name(cls) -> str:
            return source_name

    return Own


def spool(folder: str, kind: str = "fastq", stream: BinaryIO | None = None, chunk: int = 1 << 20) -> str:
    """Copy standard input into ``folder``, a path or URI, as a file that all tasks can read; its path. It is the only input, number 0."""
    stream = stream or sys.stdin.buffer
    path = f"{folder.rstrip('/')}/stdin.{kind}"
    system, place = file_system(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as f:
        while part := stream.read(chunk):
            f.write(part)
    return path


def inputs(spark: SparkSession, path: str, pattern: str) -> list[tuple[str, str]]:
    """Path and key (the name as paths of its rows end) of each file in the folder ``path`` whose whole name matches ``pattern``, by name.

    The listing is Spark's, so any file system that its readers know will do.
    """
    try:
        listed = [(unquote(x), x.rsplit("/", 1)[1]) for x in spark.read.format("binaryFile").load(path).inputFiles()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"{path} is no folder") from e
    name = lambda x: x[0].rsplit("/", 1)[1]
    found = sorted((x for x in listed if re.fullmatch(pattern, name(x))), key=name)
    if not found:
        raise FileNotFoundError(f"no file in {path} matches {pattern}")
    return found


def scan(spark: SparkSession, path: str, pattern: str | None = None, kind: str = "fastq", require_newline: bool = False) -> DataFrame:
    """The records of all inputs (see ``inputs``), in Spark's own operators; rec_idx is the record's number in its file.

    Lines are read by splits of any size. A row for each split says how many lines of its file come before it, so each
    line knows its number and with it its record, wherever a split ends. A record's lines are put together before
    they are shuffled. A FASTQ record without its @ and +, or whose sequence and quality differ in length, is an error; an incomplete last one is dropped, with ``require_newline`` also one whose last line isn't ended.
    """
    files = inputs(spark, path, pattern or rf".*\.{kind}")
    names = spark.createDataFrame([(key, k) for k, (_, key) in enumerate(files)], "_key string, file_id int")
    lines = numbered_lines(spark.read.option("lineSep", "\n").text([x for x, _ in files])).join(F.broadcast(names), "_key").drop("_key")
    length = None
    if require_newline:
        sized = spark.read.format("binaryFile").load([x for x, _ in files]).select(F.substring_index("_metadata.file_path", "/", -1).alias("_key"), "length")
        length = {r.file_id: r.length for r in sized.join(names, "_key").collect()}
    return records(lines, kind, length)


def numbered_lines(text: DataFrame) -> DataFrame:
    """Lines of Spark's text reader with the name of their file, their split and a number that grows along it."""
    return text.select(F.substring_index("_metadata.file_path", "/", -1).alias("_key"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value")


def records(lines: DataFrame, kind: str = "fastq", length: dict[int, int] | None = None) -> DataFrame:
    """Records of ``numbered_lines`` with a file_id. ``length``: the files' bytes; then a last record without the end of its line is dropped."""
    spark, size = lines.sparkSession, {"fastq": 4, "fasta": 2}[kind]
    splits = lines.groupBy("file_id", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.sum(F.octet_length("value") + 1).alias("_bytes"))
    splits = materialize(splits, "splits")
    before = Window.partitionBy("file_id").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    places = splits.select("file_id", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if splits.count() <= MOST_SPLITS:
        places = F.broadcast(places)
    at = F.col("_before") + F.col("_id") - F.col("_first")
    value, k = F.regexp_replace("value", "\r+$", ""), F.pmod(at, F.lit(size))
    fields = ("header", "sequence", "plus", "quality")
    made = [F.max(F.when(F.col("_k") == i, F.col("value"))).alias(c) if i < size else F.lit(None).cast("string").alias(c) for i, c in enumerate(fields)]
    placed = lines.join(places, ["file_id", "_start"]).select("file_id", F.floor(at / size).cast("long").alias("rec_idx"), k.alias("_k"), value.alias("value"))
    found = placed.groupBy("file_id", "rec_idx").agg(*made, F.count("*").alias("_n")).where(F.col("_n") == size)
    if length is not None:
        ends = splits.groupBy("file_id").agg(F.sum("_n").alias("n"), F.sum("_bytes").alias("bytes")).collect()
        cut = [(r.file_id, (r.n - 1) // size) for r in ends if r.bytes != length[r.file_id]]
        if cut:
            found = found.join(F.broadcast(spark.createDataFrame(cut, "file_id int, rec_idx long")), ["file_id", "rec_idx"], "left_anti")
    if kind == "fasta":
        return found.select("file_id", "rec_idx", *fields)
    fine = F.startswith("header", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.octet_length("sequence") == F.octet_length("quality"))
    wrong = F.concat(F.lit("record "), F.col("rec_idx").cast("string"), F.lit(" of file "), F.col("file_id").cast("string"), F.lit(f" is no {kind} record"))
    return found.select("file_id", "rec_idx", F.when(fine, F.col("header")).otherwise(F.raise_error(wrong)).alias("header"), *fields[1:])


def files_table(spark: SparkSession, path: str, pattern: str, ext: str = "_out") -> DataFrame:
    """file_id, path and the output's path of each input."""
    files = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(inputs(spark, path, pattern))], "file_id int, path string")
    return files.withColumn("output_path", output_path(F.col("path"), ext))


def segments(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """Round-robin over at most ``most`` files as pieces (file, first record, records, first arrival, step).

    While all open files have records left, the arrivals of a file are evenly
    spaced. When one ends, the next waiting file takes its slot's place and the
    turn passes that slot.
    """
    slots = sorted(counts)
    left, done = dict(counts), dict.fromkeys(counts, 0)
    out, base, head = [], 0, 0
    while slots:
        width = min(most, len(slots))
        offsets = [(j - head) % width for j in range(width)]
        turns = min(left[slots[j]] * width + offsets[j] for j in range(width))
        for j in range(width):
            n = max(0, -(-(turns - offsets[j]) // width))
            if n:
                f = slots[j]
                out.append((f, done[f], n, base + offsets[j], width))
                done[f] += n
                left[f] -= n
        dead = (head + turns) % width
        base += turns
        del slots[dead]
        if slots:
            head = (dead + 1) % min(most, len(slots))
    return out


def with_arrival(reads: DataFrame, max_interleave: int = 1) -> DataFrame:
    """Add arrival: the place of each record in the interleaved stream; rec_idx becomes the record's number in its file.

    One row per file reaches the driver. The pieces, at most ``max_interleave``
    for each file that ends, are joined as a table, which Spark broadcasts only
    if it is small.
    """
    stretch = F.shiftright(F.col("rec_idx"), SPLIT_BITS)
    counts = reads.groupBy("file_id", stretch.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    per_file = {r.file_id: r["n"] for r in counts.groupBy("file_id").agg(F.sum("_n").alias("n")).collect()}
    parts = counts.select(F.col("file_id").alias("_f"), "_part", "_before")
    placed = reads.join(parts, (F.col("file_id") == F.col("_f")) & (stretch == F.col("_part")))
    placed = placed.withColumn("rec_idx", F.col("rec_idx").bitwiseAND((1 << SPLIT_BITS) - 1) + F.col("_before")).drop("_f", "_part", "_before")
    table = reads.sparkSession.createDataFrame(segments(per_file, max_interleave), "_f int, _lo long, _n long, _base long, _step long")
    on = (F.col("file_id") == F.col("_f")) & (F.col("rec_idx") >= F.col("_lo")) & (F.col("rec_idx") < F.col("_lo") + F.col("_n"))
    joined = placed.join(table, on)
    return joined.select(*reads.columns, (F.col("_base") + (F.col("rec_idx") - F.col("_lo")) * F.col("_step")).alias("arrival"))
