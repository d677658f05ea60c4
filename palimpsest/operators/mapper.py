"""The expensive external function, run on unique rows only.

A row's result is found by its own pos, and the numbers of lines in and out
must agree, so Arrow's batches don't matter: they are gathered until ``batch``
records are there. A task that is run again calls the function again: it has to
be idempotent.
"""

import shlex
import subprocess
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.config import ConfigError, get_bool
from palimpsest.functions.keys import record_text

Function = Callable[[list[str]], list[str]]
ALIGNERS = {"bowtie2": "bowtie2", "seal": "seal.sh"}


def _checked(values: list[str], n: int) -> list[str]:
    if len(values) != n:
        raise RuntimeError(f"the mapper gave {len(values)} lines for {n} records")
    return values


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of ``size`` rows, the last one smaller, whatever the batches' sizes are."""
    waiting, n = [], 0
    for rows in batches:
        while rows.num_rows:
            took = rows.slice(0, size - n)
            waiting.append(took)
            n += took.num_rows
            rows = rows.slice(took.num_rows)
            if n == size:
                yield pa.Table.from_batches(waiting)
                waiting, n = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def map_unique(unique: DataFrame, function: Function, batch: int = 50_000, threads: int = 1) -> DataFrame:
    """pos, value and seconds for each row; ``function`` takes the texts of up to ``batch`` records.

    ``threads``: how many it uses itself; a task of this stage then takes as many of a cluster's cores.

    seconds: the row's share of the time of the call that it was in, so that a
    bucket's sum is its map time, whichever calls its rows were in. A function
    that has ``session`` is opened once for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @contextmanager
        def plain():
            yield function

        with getattr(function, "session", plain)() as call:
            for own in _gathered(batches, batch):
                began = time.monotonic()
                values = _checked(call(own.column(1).to_pylist()), own.num_rows)
                share = (time.monotonic() - began) / own.num_rows
                yield from pa.table({"pos": own.column(0), "value": pa.array(values, pa.string()), "seconds": pa.array([share] * own.num_rows)}).to_batches(10_000)

    text = record_text(*(F.col(c) for c in ("header", "sequence", "plus", "quality")))
    local = unique.sparkSession.sparkContext.master.startswith("local")  # there are no executors to ask for cores
    return unique.select("pos", text.alias("text")).mapInArrow(run, "pos long, value string, seconds double", profile=cores(threads) if threads > 1 and not local else None)


class ProcessFunction:
    """Hands records to a process and reads a line for each; a failed process is an error.

    One process for each call, or, ``interactive``, one that lives as long as
    the task and answers each record with one line before its input ends. A
    process that holds its answers back until then would never be done; it is
    ended, as an error, once a call has taken ``patience`` seconds.
    """

    def __init__(self, command: str, interactive: bool = False, encoding: str = "utf-8", patience: float = 3600.0):
        self.words, self.interactive, self.encoding, self.patience = shlex.split(command), interactive, encoding, patience

    def __call__(self, texts: list[str]) -> list[str]:
        done = subprocess.run(self.words, input="\n".join([*texts, ""]).encode(self.encoding), capture_output=True, check=False)
        if done.returncode:
            self._failed(done.returncode, done.stderr)
        lines = done.stdout.decode(self.encoding).split("\n")  # no other character ends a line
        return lines[:-1] if lines[-1] == "" else lines

    def _failed(self, code: int | None, said: bytes) -> None:
        raise RuntimeError(f"{self.words[0]} ended with {code}: {said[-500:].decode(self.encoding, 'replace')}")

    @contextmanager
    def session(self) -> Iterator[Function]:
        if not self.interactive:
            yield self
            return
        with subprocess.Popen(self.words, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as process:

            def call(texts: list[str]) -> list[str]:
                def give() -> None:
                    try:
                        process.stdin.write("\n".join([*texts, ""]).encode(self.encoding))
                        process.stdin.flush()
                    except BrokenPipeError:
                        pass  # noticed below, as there will be too few lines

                writer = threading.Thread(target=give)  # so that neither side waits for a full pipe
                writer.start()
                limit = threading.Timer(self.patience, process.kill)
                limit.start()
                lines = [line for _ in texts if (line := process.stdout.readline())]
                writer.join()
                limit.cancel()
                if len(lines) < len(texts):
                    self._failed(process.poll(), b"too few lines")
                return [line.decode(self.encoding).removesuffix("\n") for line in lines]

            yield call
            process.stdin.close()
            if process.stdout.read():
                self._failed(process.wait(), b"more lines than records")
            if process.wait():
                self._failed(process.returncode, b"")


def process_function(command: str, interactive: bool = False, encoding: str = "utf-8", patience: float = 3600.0) -> ProcessFunction:
    return ProcessFunction(command, interactive, encoding, patience)


# fixed values: the options of the two known aligners; --reorder and ordered=t keep the order that results are matched by
def aligner_command(options: dict[str, str]) -> str:
    """The command that a control file asks for: its own, or one of two known aligners, which need a ``reference``. ``aligner_path`` takes the program's place."""
    if command := options.get("command"):
        return command
    kind = options.get("aligner", "bowtie2")
    if kind not in ALIGNERS:
        raise ConfigError(f"unknown aligner {kind}")
    reference, threads = options.get("reference"), options.get("threads", "1")
    if not reference:
        raise ConfigError("a run with an aligner needs a reference")
    program, interleaved = options.get("aligner_path") or ALIGNERS[kind], get_bool(options, "interleaved")
    fasta = options.get("file_type") == "fasta"
    if kind == "bowtie2":
        words = [program, "--reorder", "--mm", "--no-hd", "-p", threads, "-f" if fasta else "-q", "-x", reference, *(["--interleaved"] if interleaved else ["-U"]), "-"]
    else:
        suffix = "fa" if fasta else "fq"
        words = [program, f"threads={threads}", "out=stdout.fq", f"ref={reference}", *(["interleaved=t"] if interleaved else []), f"in=stdin.{suffix}", "prealloc=t", "rskip=3", f"-Xmx{options.get('aligner_memory', '80G')}", "ordered=t"]
    return shlex.join(words)


def aligner_function(options: dict[str, str]) -> "ProcessFunction":
    """The process that a control file asks for; ``seal`` lives as long as its task, as a command does that is called ``interactive``."""
    live = get_bool(options, "interactive") or not options.get("command") and options.get("aligner") == "seal"
    return process_function(aligner_command(options), live)


def cores(threads: int) -> ResourceProfile:
    """What a task of the mapper asks of a cluster: a core for each of its process's threads."""
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(threads)).build


def stand_in(sequence: Column) -> Column:
    """A deterministic mapper as an expression: what tests and oracles use in the place of an aligner."""
    return F.concat(F.lit("ref"), F.lit("\t"), F.substring(F.md5(sequence), 1, 8), F.lit("\t"), F.length(sequence).cast("string"))
