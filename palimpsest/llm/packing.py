"""Packing of token sequences by minimum bin slack.

Each task tokenizes its documents and packs them as they come. A document of
more than a sequence fills whole sequences first; what remains goes into a
window of remaining lengths. From a full window, a bitset subset-sum dynamic
program picks the multiset of lengths that, with the largest one, fills a
sequence closest to its capacity; counts of each length are backtracked from
the bitsets. Picks with slack wait for the next window. At a task's end the
last lengths are laid one after another and cut into full sequences and then
into sequences of powers of two, so that no token is padding.

Nothing is shuffled. A task's input is what the scan planned for it, so a task
that is run again gives the same sequences; sequence_id holds the task's number
in its upper bits. Edge cases: a null or empty text is one end token; repeated
rows are packed each; memory holds one Arrow batch and the ids of one window
(``window`` lengths below ``capacity``); other columns are ignored.
"""

from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import default_tokenizer, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: Counter, capacity: int) -> list[int]:
    """Lengths, the largest one among them, whose sum is the closest to ``capacity`` from below.

    Bit s of a set says that s can be reached. The program takes one length
    after another, larger ones first, and ends early where the capacity is met.
    """
    lengths = sorted(counts, reverse=True)
    seed = next((x for x in lengths if x <= capacity), None)
    if seed is None:
        return []
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        many = min(counts[length] - (length == seed), room // length)
        if many <= 0:
            continue
        steps.append((length, many, reach))
        part = 1
        while many:  # a count in binary parts: as many shifts as its logarithm
            take = min(part, many)
            reach |= (reach << (take * length)) & mask
            many -= take
            part *= 2
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    out = [seed]
    for length, many, before in reversed(steps):
        k = 0
        while not before >> left & 1:
            k += 1
            left -= length
            assert k <= many and left >= 0
        out += [length] * k
    return out


class Window:
    """Pieces that wait to be packed, by length."""

    def __init__(self, capacity: int, size: int):
        self.capacity, self.size = capacity, size
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.counts: Counter = Counter()
        self.n = 0

    def add(self, piece: tuple, length: int) -> None:
        self.waiting[length].append(piece)
        self.counts[length] += 1
        self.n += 1

    def take(self, length: int) -> tuple:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        self.n -= 1
        piece = self.waiting[length].popleft()
        if not self.waiting[length]:
            del self.waiting[length]
        return piece

    def fills(self, least: int) -> Iterator[list[tuple]]:
        """Full sequences, until fewer than ``least`` pieces wait or the closest fill has slack."""
        while self.n > least:
            lengths = best_fill(self.counts, self.capacity)
            if sum(lengths) < self.capacity:
                return
            yield [self.take(x) for x in lengths]

    def rest(self) -> list[tuple]:
        return [self.take(x) for x in sorted(self.counts.elements(), reverse=True)]


def powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Packs one task's documents. Emits pieces (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, window: int, first_sequence: int):
        self.capacity, self.window, self.sequence = capacity, Window(capacity, window), first_sequence

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        total, wide = len(ids) // 4, 4 * self.capacity
        whole = total - total % self.capacity
        for k in range(0, 4 * whole, wide):
            yield from self._emit([(doc, k // 4, ids[k : k + wide], total)])
        if whole < total:
            self.window.add((doc, whole, ids[4 * whole :], total), total - whole)
        if self.window.n >= self.window.size:
            before = self.window.n
            for pieces in self.window.fills(self.window.size // 2):
                yield from self._emit(pieces)
            if self.window.n == before:  # no exact fill in the whole window: lay it out with cuts
                yield from self._lay(self.window.rest(), tail=False)

    def end(self) -> Iterator[tuple]:
        for pieces in self.window.fills(0):
            yield from self._emit(pieces)
        yield from self._lay(self.window.rest(), tail=True)

    def _lay(self, pieces: list[tuple], tail: bool) -> Iterator[tuple]:
        """One after another, cut at the capacity; the tail into powers of two, or back to the window."""
        total = sum(len(x[2]) // 4 for x in pieces)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        todo = deque(pieces)
        for size in [*sizes, *(powers(rest) if tail else [])]:
            own = []
            while size:
                doc, start, ids, n = todo.popleft()
                took = min(size, len(ids) // 4)
                own.append((doc, start, ids[: 4 * took], n))
                if 4 * took < len(ids):
                    todo.appendleft((doc, start + took, ids[4 * took :], n))
                size -= took
            yield from self._emit(own)
        for piece in todo:
            self.window.add(piece, len(piece[2]) // 4)


def pack(
    docs: DataFrame,
    capacity: int = 4096,
    end_id: int = 2,
    window: int = 512,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document, with its place in a sequence; ``with_ids`` adds the ids themselves."""
    path = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        packer = Packer(capacity, window, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = (list(x) for x in zip(*rows, strict=True))
            columns = [doc, start, [len(x) // 4 for x in ids], [crc32(x) for x in ids], total, sequence, offset] + [ids] * with_ids
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            texts = (x.as_py() for x in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode_all(texts), strict=True):
                rows.extend(packer.add(doc, ids + end))
                if len(rows) >= 2048:
                    yield flush()
        rows.extend(packer.end())
        if rows:
            yield flush()

    schema = SCHEMA + ", ids binary" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
