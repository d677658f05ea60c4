"""A run from a control file to its outputs: what the command line does.

    python -m palimpsest --from_config run.ini

Inputs come from ``data_dir`` and ``input_pattern``, or from standard input if
only ``stdin`` is given. Each input's lines become a file named like the input
with ``output_ext`` in the place of its extension (``output_file`` names that of a
single input), unless ``suppress_sam`` is there; ``metrics`` names the folder of the log.
"""

import argparse
import logging
import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import config as conf
from palimpsest.logs import fatal, logger, timer
from palimpsest.operators import mapper
from palimpsest.plans import engine, metrics
from palimpsest.sources import fastq, sinks
from palimpsest.storage import materialize, release, scope, shared_folder

STDIN_OUTPUT = "OUT.sam"


@dataclass(frozen=True)
class Report:
    """What a run leaves: its counters, the one-row summary, the log's rows, the outputs' files and the seconds that it took."""

    counters: DataFrame
    summary: DataFrame
    log: DataFrame
    outputs: dict[int, str]
    runtime: float


def _inputs(spark: SparkSession, options: dict[str, str], c: conf.EngineConfig) -> tuple[DataFrame, dict[int, str], list[str]]:
    """Reads with their arrival, the output of each input and the inputs' paths."""
    if folder := options.get("data_dir"):
        pattern = c.input_pattern
    elif conf.get_bool(options, "stdin"):
        folder, pattern = f"{shared_folder(spark)}/stdin-{uuid.uuid4().hex}", rf"stdin\.{c.file_type}"
        fastq.spool(folder, c.file_type)
    else:
        raise conf.ConfigError("a run needs data_dir or stdin")
    files = fastq.files_table(spark, folder, pattern, c.output_ext).collect()
    outputs = {r.file_id: r.output_path for r in files}
    if options.get("output_file") and len(files) > 1:
        raise conf.ConfigError("output_file names one output, but there are several inputs")
    if not options.get("data_dir") or options.get("output_file"):
        outputs = {0: os.path.abspath(name) if "://" not in (name := options.get("output_file", STDIN_OUTPUT)) else name}
    # as wired, a last line without its end loses its record
    records = materialize(fastq.scan(spark, folder, pattern, c.file_type, c.mode == "wired"), "records")  # parsed once
    return fastq.with_arrival(records, c.max_interleave), outputs, [r.path for r in files]


def run_options(spark: SparkSession, options: dict[str, str], function: Callable[[list[str]], list[str]] | None = None, **more) -> Report:
    """Run what ``options`` ask for. ``function`` takes the place of their command; ``more`` are fields of the configuration."""
    c = conf.EngineConfig.from_options(options, **more)
    with timer("run") as took, scope() as records:
        reads, outputs, paths = _inputs(spark, options, c)
        function = function or mapper.aligner_function(options)
        made = engine.run(reads, c, function)
        sinks.write_outputs(made.output, outputs, c.suppress_output)
    counted = materialize(made.counters, "counters")
    log = materialize(metrics.batch_metrics(counted, c.bucket_size, made.seconds), "log")
    mapping = made.seconds.agg(F.sum("seconds")).first()[0]
    total = metrics.summary(counted, mapping, c.mode)
    seen = total.first()
    made.close()
    release(*records)
    if path := options.get("metrics"):
        sinks.write_text(metrics.log_lines(log, paths, options.get("_this_config", ""), seen.n_rows, took.value), path)
    logging.getLogger("palimpsest").info("%d reads, %d mapped, %d hits, %d misses, %.1f s of mapping", seen.n_rows, seen.n_unique, seen.hits, seen.misses, mapping or 0.0)
    return Report(counted, total, log, outputs, took.value)


def run_file(spark: SparkSession, path: str, function: Callable[[list[str]], list[str]] | None = None, **more) -> Report:
    return run_options(spark, conf.read_file(path), function, **more)


#: long options of the command line and what they are called in a control file
CLI = {
    "input_pattern": "input_pattern", "input_file_pattern": "input_pattern", "data_dir": "data_dir", "reference": "reference", "output_file": "output_file", "output_ext": "output_ext",
    "metrics_file": "metrics", "bucket_size": "bucket_size", "threads": "threads", "aligner": "aligner", "aligner_path": "aligner_path", "aligner_memory": "aligner_memory", "command": "command",
    "cache_policy": "cache_policy", "cache_decorator": "cache_decorator", "hash_func": "hash_func", "compression": "compression", "chain_switch": "chain_switch",
    "max_interleave": "max_interleave", "max_chain": "max_chain", "file_type": "file_type",
}
SHORT = {"input_pattern": "i", "data_dir": "d", "reference": "x", "output_file": "s", "metrics_file": "e", "bucket_size": "b", "threads": "p", "aligner": "a"}
FLAGS = ("interleaved", "retag", "store_bin", "stdin", "interactive")


def options_of(arguments: list[str]) -> dict[str, str]:
    """The options that a command line asks for; those of a control file come first, the others replace them."""
    parser = argparse.ArgumentParser(prog="palimpsest")
    parser.add_argument("-c", "--from_config")
    for name in CLI:
        parser.add_argument(*([f"-{SHORT[name]}"] if name in SHORT else []), f"--{name}")
    for name in FLAGS:
        parser.add_argument(f"--{name}", action="store_true")
    parser.add_argument("--suppress_sam", action="store_true")
    parser.add_argument("--verbose", dest="log_level", action="store_const", const="debug")
    parser.add_argument("--quiet", dest="log_level", action="store_const", const="warn")
    given = vars(parser.parse_args(arguments))
    options = conf.read_file(given["from_config"]) if given["from_config"] else {}
    options |= {CLI[k]: v for k, v in given.items() if k in CLI and v is not None}
    options |= {k: "true" for k in (*FLAGS, "suppress_sam") if given[k]}
    return options | ({"log_level": given["log_level"]} if given["log_level"] else {})


def main(arguments: list[str] | None = None) -> None:
    try:
        options = options_of(sys.argv[1:] if arguments is None else arguments)
        logger(options.get("log_level", "info"))
        spark = SparkSession.builder.appName("palimpsest").getOrCreate()
        run_options(spark, options).summary.show(truncate=False)
    except (conf.ConfigError, FileNotFoundError) as e:
        fatal(str(e))
