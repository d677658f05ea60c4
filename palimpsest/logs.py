"""Messages of a run, and how long its parts take."""

import logging
import time
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql.streaming.listener import StreamingQueryListener

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR, "fatal": logging.CRITICAL}


def logger(level: str = "info") -> logging.Logger:
    log = logging.getLogger("palimpsest")
    log.setLevel(LEVELS[level])
    return log


def fatal(message: str) -> None:
    """Log and end the program."""
    logger().critical(message)
    raise SystemExit(1)


class Seconds:
    """What ``timer`` measured, once its block has ended."""

    value = 0.0


@contextmanager
def timer(what: str) -> Iterator[Seconds]:
    """Seconds that a block took, logged at its end, also where it fails."""
    took, began = Seconds(), time.monotonic()
    try:
        yield took
    finally:
        took.value = time.monotonic() - began
        logging.getLogger("palimpsest").info("%s: %.3f s", what, took.value)


class BucketListener(StreamingQueryListener):
    """Notes and logs when a stream of buckets starts, has written a bucket, and ends: ``spark.streams.addListener(BucketListener())``.

    ``events``: (what, bucket, rows, milliseconds); the last ``keep`` of them.
    """

    def __init__(self, keep: int = 1000):
        self.events: deque[tuple[str, int | None, int | None, int | None]] = deque(maxlen=keep)

    def _note(self, what: str, bucket: int | None = None, rows: int | None = None, took: int | None = None) -> None:
        self.events.append((what, bucket, rows, took))
        logging.getLogger("palimpsest").info("%s%s", what, "" if bucket is None else f" bucket {bucket}: {rows} rows in {took} ms")

    def onQueryStarted(self, event) -> None:
        self._note("started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self._note("wrote", p.batchId + 1, p.numInputRows, p.durationMs.get("triggerExecution"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._note("failed" if event.exception else "ended")
