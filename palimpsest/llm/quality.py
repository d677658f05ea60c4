"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark the characters that lie inside
an n-gram found twice or more in the same text; repeated lines are measured
alike. Each text is judged alone, so nothing is shuffled and a lost task is
simply run again.

Edge cases: a null text counts as empty; a text without words has zero counts
and fails the base rule; lines and n-grams compare byte by byte, so case
matters; repeated rows each get their own row; other columns are ignored.
Memory is bounded by one Arrow batch plus 512 KB slices of it, or one longer text.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as ts

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules. A text is kept if it passes all of them."""

    min_words: int = 50
    max_repeat_words: float = 0.5
    #: word counts of the n-grams whose coverage is measured, with the largest covered share of the characters in words
    ngrams: tuple[tuple[int, float], ...] = ((5, 0.5), (8, 0.45), (10, 0.4))
    max_dup_line_chars: float = 0.5
    max_symbols_per_word: float = 0.1


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, {coverage}"
)


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _covered(keys: np.ndarray, at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside a window of ``n`` words whose key is found twice; ``at`` has the windows' first words."""
    begun = np.zeros(total + 1, dtype=np.int64)
    again = at[ts.seen_twice(keys)]
    if not len(again):
        return np.zeros(total, dtype=bool)
    begun[again] += 1
    np.add.at(begun, again + n, -1)
    return np.cumsum(begun[:-1]) > 0


def measure(buf: np.ndarray, offsets: np.ndarray, rules: QualityRules) -> dict[str, np.ndarray]:
    """The counts of each row of one slice."""
    rows = len(offsets) - 1
    starts, ends, first = ts.words(buf, offsets)
    chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)))  # code points before each byte
    word_chars = chars[ends] - chars[starts]
    out = {
        "n_words": np.diff(first),
        "word_chars": _per_row(word_chars, first),
        "n_symbols": _per_row(SYMBOLS[buf], offsets),
    }
    hashes = ts.span_hash(buf, starts, ends)
    row = ts.row_of(first, len(starts))
    salt = ts.mix(np.arange(rows, dtype=np.uint64) + np.uint64(0x51ED2701))  # keeps equal windows of different rows apart
    at = np.arange(len(starts), dtype=np.int64)
    for n, name in ((3, "repeat"), *((n, f"cover_{n}") for n, _ in rules.ngrams)):
        own = at[at + n <= first[row[at] + 1]]  # windows inside their row
        keys = (ts.windows(hashes, n)[own] ^ salt[row[own]]) if len(own) else np.zeros(0, np.uint64)
        if name == "repeat":
            cover = _covered(keys, own, n, len(starts))
            out["n_repeat_words"] = _per_row(cover, first)
            at = own[ts.seen_twice(keys)]  # a longer window can only repeat where the short one does
        else:
            cover = _covered(keys, own, n, len(starts))
            out[name] = _per_row(word_chars * cover, first)
    # lines that have a word
    cuts = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate((offsets[:-1], cuts + 1)), kind="stable")
    inner = np.searchsorted(begin, offsets[:-1], side="left")
    end = np.empty_like(begin)
    end[:-1] = begin[1:]
    end[-1:] = len(buf)
    line_row = np.repeat(np.arange(rows), np.diff(np.append(inner, len(begin))))
    # an offset that follows a line break at the end of a row starts the next row; that empty line has no word
    end = np.minimum(end, offsets[line_row + 1])
    closed = (end > begin) & (buf[np.maximum(end - 1, 0)] == 10) if len(buf) else np.zeros(len(begin), dtype=bool)
    end = end - closed
    filled = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, line_row = begin[filled], end[filled], line_row[filled]
    keys = ts.span_hash(buf, begin, end) ^ salt[line_row] if len(begin) else np.zeros(0, np.uint64)
    order = np.lexsort((begin, keys))
    later = np.zeros(len(keys), dtype=bool)
    if len(order):
        later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=rows)
    out["dup_line_chars"] = np.bincount(line_row[later], weights=(chars[end] - chars[begin])[later], minlength=rows).astype(np.int64)
    return out


def judge(m: dict[str, np.ndarray], rules: QualityRules) -> None:
    n, c = m["n_words"], np.maximum(m["word_chars"], 1)
    m["base_failed"] = (n < rules.min_words) | (m["n_repeat_words"] > rules.max_repeat_words * n)
    bad = (m["n_symbols"] > rules.max_symbols_per_word * n) | (m["dup_line_chars"] > rules.max_dup_line_chars * c)
    for k, most in rules.ngrams:
        bad |= m[f"cover_{k}"] > most * c
    m["kept"] = ~m["base_failed"] & ~bad


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, what each rule measured and the verdict."""
    schema = SCHEMA.format(coverage=", ".join(f"cover_{n} long" for n, _ in rules.ngrams))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in ts.slices(batch.column(1)):
                m = measure(buf, offsets, rules)
                judge(m, rules)
                m["doc_id"] = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(m[x]) for x in names], names=names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with all their columns: the filter that a pipeline needs, in one pass without a join."""
    schema = docs.schema
    at = [x.lower() for x in schema.names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in ts.slices(batch.column(at)):
                m = measure(buf, offsets, rules)
                judge(m, rules)
                if m["kept"].any():
                    yield batch.slice(lo, hi - lo).filter(pa.array(m["kept"]))

    return docs.mapInArrow(run, schema)
