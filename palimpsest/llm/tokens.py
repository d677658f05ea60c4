"""Token counts that follow edits.

``ChunkEncoder`` encodes the stretches between ASCII white space one by one and
keeps what it has encoded: no rule of the tokenizer reaches across such white
space, so the joined ids are those of the whole text, with control strings as
the single tokens that the tokenizer makes of them. ``TokenTree`` keeps, for
one document, the chunks in leaves and a segment tree of the leaves' token
counts; an edit re-encodes the chunks that it touches, with the boundary chunks
on either side, and updates the sums above the touched leaves only.

Edge cases: a null or empty text has no tokens; edits that overlap or lie
outside the text raise ``ValueError``; an edit may join, split, empty or append
chunks; memory holds one text and its tree; repeated rows are independent.
"""

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER = "word_bpe_49k.json"
#: str.split() also parts at these, which the tokenizer doesn't take as white space
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: letters beyond Latin, and the dotted capital I whose lower case is two characters
_NOT_PLAIN = re.compile("[^\x00-\u012f\u0131-\u017f]")
_SPACES = re.compile("[ \t\n\r\v\f]+")
#: begins the tokenizer's control strings, which count as one token where a text spells them exactly, before lower-casing
_CONTROL = "<|"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit values.

    ``keep``: so many chunks are remembered in two generations, the older of
    which is dropped; it changes the speed, never the ids.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.marks = {x: array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes() for x in ".,"}

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The memory, with all of ``chunks`` in it."""
        if missing := chunks.difference(self.known):
            if 2 * (len(self.known) + len(missing)) > self.keep:
                self.older, self.known = self.known, {}
                missing = chunks
            if self.older:
                older, known = self.older, self.known
                for chunk in missing:
                    if chunk in older:
                        known[chunk] = older[chunk]
                missing = missing.difference(known)
            words, marked, rest = set(), [], []
            for chunk in missing:
                if chunk.isalpha():
                    words.add(chunk)
                elif chunk[-1] in ".," and chunk[:-1].isalpha():
                    marked.append(chunk)  # letters and one mark: two pre-tokens
                    words.add(chunk[:-1])
                else:
                    rest.append(chunk)
            words = words.difference(self.known)
            self._learn_words(sorted(words))
            for chunk in marked:
                self.known[chunk] = self.known[chunk[:-1]] + self.marks[chunk[-1]]
            self._learn_each(rest)
        return self.known

    def _learn_each(self, chunks: list[str]) -> None:
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            self.known[chunk] = array("I", e.ids).tobytes()

    def _learn_words(self, words: list[str], together: int = 512) -> None:
        """Words of letters are one pre-token each, and only its last token ends a word: so many are encoded in one text and parted there."""
        groups = [words[k : k + together] for k in range(0, len(words), together)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) != len(group) or 4 * len(ids) != ends[-1]:
                self._learn_each(group)
                continue
            data, start = ids.tobytes(), 0
            for word, end in zip(group, ends):
                self.known[word] = data[start:end]
                start = end

    @staticmethod
    def chunks(text: str | None) -> list[str]:
        if not text:
            return []
        if _CONTROL not in text and (text.isascii() or not _NOT_PLAIN.search(text)):
            text = text.lower()  # as the tokenizer does; for these letters no rule depends on their neighbours
        if _ODD_SPACE.search(text):
            return [x for x in _SPACES.split(text) if x]
        return text.split()

    def encode(self, text: str | None) -> bytes:
        chunks = self.chunks(text)
        return b"".join(map(self.learn(set(chunks)).__getitem__, chunks))

    def encode_all(self, texts: Iterable[str | None], together: int = 1 << 20) -> Iterator[bytes]:
        """``encode`` for each text; what is new in about ``together`` characters is encoded at once."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(self.chunks(text))
            size += len(text or "")
            if size >= together:
                yield from self._joined(waiting)
                waiting, size = [], 0
        yield from self._joined(waiting)

    def _joined(self, waiting: list[list[str]]) -> Iterator[bytes]:
        get = self.learn(set().union(*waiting)).__getitem__
        for chunks in waiting:
            yield b"".join(map(get, chunks))


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process."""
    return ChunkEncoder(path)


class TokenTree:
    """A text with its token count, kept up to date under edits.

    ``leaf_chunks``: chunks in one leaf. The text stays as it was given; edits
    are replacements (start, end, new text) in code points.
    """

    def __init__(self, text: str | None, encoder: ChunkEncoder, leaf_chunks: int = 64):
        self.encoder, self.leaf_chunks = encoder, leaf_chunks
        self.encoded_chars = 0
        self._load(text or "")

    def _load(self, text: str) -> None:
        self.leaves = self._cut(text)
        self._build()

    def _cut(self, text: str) -> list[tuple[str, int]]:
        """Leaves (text, tokens) that together are ``text``; each ends at white space or the end."""
        out, begun, k = [], 0, 0
        for m in _SPACES.finditer(text):
            k += 1
            if k == self.leaf_chunks:
                out.append(text[begun : m.end()])
                begun, k = m.end(), 0
        if begun < len(text):
            out.append(text[begun:])
        self.encoded_chars += len(text)
        return [(x, len(self.encoder.encode(x)) // 4) for x in out]

    def _build(self) -> None:
        n = max(len(self.leaves), 1)
        self.width = 1 << (n - 1).bit_length()
        self.tokens = [0] * (2 * self.width)
        self.chars = [0] * (2 * self.width)
        for i, (text, tokens) in enumerate(self.leaves):
            self.tokens[self.width + i], self.chars[self.width + i] = tokens, len(text)
        for i in range(self.width - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(x for x, _ in self.leaves)

    def _find(self, position: int) -> tuple[int, int]:
        """The leaf that holds ``position`` and where the leaf starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if position >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the code points from ``start`` to ``end``."""
        if not 0 <= start <= end <= self.length:
            raise ValueError(f"edit {start}:{end} is outside a text of {self.length}")
        if not self.leaves:
            self._load(new)
            return
        first, begun = self._find(start)
        last, last_begun = self._find(max(end - 1, start))
        if start == begun and first and start:  # what is put before a leaf can touch the chunk before it
            first -= 1
            begun -= len(self.leaves[first][0])
        stop = last_begun + len(self.leaves[last][0])
        if end == stop and last + 1 < len(self.leaves):
            last += 1
            stop += len(self.leaves[last][0])
        old = "".join(self.leaves[i][0] for i in range(first, last + 1))
        text = old[: start - begun] + new + old[end - begun :]
        if last - first <= 2 and text and len(text) <= 4 * max(len(old), 64):
            # the same number of leaves: re-encode the chunks around the edit, count the rest from what is known
            self._renew(first, last, text, start - begun, end - begun, new)
        else:
            self.leaves[first : last + 1] = self._cut(text)
            self._build()

    def _renew(self, first: int, last: int, text: str, start: int, end: int, new: str) -> None:
        """Leaves ``first`` to ``last`` become one leaf with ``text`` and empty ones; only sums above them change."""
        tokens = sum(self.leaves[i][1] for i in range(first, last + 1))
        old = "".join(self.leaves[i][0] for i in range(first, last + 1))
        a, b = _touched(old, start, end)
        after = old[a:start] + new + old[end:b]
        tokens += (len(self.encoder.encode(after)) - len(self.encoder.encode(old[a:b]))) // 4
        self.encoded_chars += len(after) + b - a
        for i in range(first, last + 1):
            own = (text, tokens) if i == first else ("", 0)
            self.leaves[i] = own
            k = self.width + i
            self.tokens[k], self.chars[k] = own[1], len(own[0])
            while k > 1:
                k //= 2
                self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
                self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        if len(text) > 64 * 16 * self.leaf_chunks:  # many edits in one place: cut that leaf again
            self.leaves = [x for x in self.leaves if x[0]]
            at = next(i for i, x in enumerate(self.leaves) if x[0] is text)
            self.leaves[at : at + 1] = self._cut(text)
            self._build()

    def apply(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Apply edits whose positions refer to the text before any of them."""
        edits = sorted(edits)
        for (_, stop, _), (start, _, _) in zip(edits, edits[1:]):
            if start < stop:
                raise ValueError("edits overlap")
        for start, end, new in reversed(edits):
            self.replace(start, end, new)


def _touched(text: str, start: int, end: int) -> tuple[int, int]:
    """The stretch around ``start``:``end`` that reaches to white space on both sides."""
    a = start
    while a and text[a - 1] not in " \t\n\r\v\f":
        a -= 1
    b = end
    while b < len(text) and text[b] not in " \t\n\r\v\f":
        b += 1
    return a, b


Edits = Callable[[str], list[tuple[int, int, str]]]


def count_after_edits(docs: DataFrame, edits: Edits, tokenizer: str | None = None, leaf_chunks: int = 64) -> DataFrame:
    """Token counts of each text before and after ``edits``, counted through its tree.

    Returns doc_id, n_tokens, n_edits, n_tokens_edited, n_chars, encoded_chars:
    the last counts the characters encoded for the edits alone.
    """
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            rows: list[list[int]] = []
            for value in batch.column(1):
                text = value.as_py() or ""
                tree = TokenTree(text, own, leaf_chunks)
                before, spent = tree.count, tree.encoded_chars
                todo = edits(text)
                tree.apply(todo)
                rows.append([before, len(todo), tree.count, len(text), tree.encoded_chars - spent])
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, ", ".join(f"{x} long" for x in names))


EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}")


def redact_and_sign(text: str) -> list[tuple[int, int, str]]:
    """The edits of the registered query: mail addresses become ``[email]`` and an end mark is appended."""
    return [*((m.start(), m.end(), "[email]") for m in EMAIL.finditer(text)), (len(text), len(text), "\n-- end of document --")]
