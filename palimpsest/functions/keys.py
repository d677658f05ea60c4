"""Keys, chain hashers and output text, as column expressions."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: base codes of the hashers, T before G, all else 3
CODES = {"A": 0, "C": 1, "T": 2, "G": 3}
OTHER = 3
WIDTHS = {"none": 1, "cache_aware": 16, "single": 4, "double": 16, "triple": 64, "gc": 4}
# fixed values: three-bit codes of the packed key, in the order of the alphabet
ALPHABET, PACKED = "ACGTN", "13746"

# fixed values: codes of the admission filter's hash, G before T; any other letter, or none at that place, is 7
BLOOM_CODES = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}
BLOOM_OTHER = 7

#: hashers, keys and outputs of one's own, as column expressions, by the name that options give them
HASHERS: dict[str, Callable[[Column], Column]] = {}
KEYS: dict[str, Callable[[Column], Column]] = {}
OUTPUTS: dict[str, Callable[[Column, Column], Column]] = {}


def base_code(sequence: Column, at: int) -> Column:
    """The code of the base at 1-based position ``at``."""
    c = F.substring(sequence, at, 1)
    out = None
    for base, code in CODES.items():
        out = F.when(c == base, code) if out is None else out.when(c == base, code)
    return out.otherwise(OTHER)


def gc_count(sequence: Column) -> Column:
    return F.length(F.translate(sequence, "ATN", ""))


def chain_hash(sequence: Column, hasher: str = "none", bins: int = 4, mode: str = "intended") -> Column:
    """The chain of a sequence. ``gc``: an empty sequence goes to the first bin."""
    if hasher in HASHERS:
        out = HASHERS[hasher](sequence)
    elif hasher == "none":
        out = F.lit(0)
    elif hasher == "cache_aware":
        out = F.pmod(F.conv(F.substring(F.md5(sequence), 1, 8), 16, 10).cast("long"), F.lit(16))
    elif hasher == "single":
        out = base_code(sequence, 1)
    elif hasher == "double":
        out = 4 * base_code(sequence, 1) + base_code(sequence, 2)
    elif hasher == "triple":
        first = F.when(F.substring(sequence, 1, 1).isin("A", "C"), 0).otherwise(3)
        out = first + 4 * base_code(sequence, 2) + 16 * base_code(sequence, 3)
    elif hasher == "gc":
        gc, n = gc_count(sequence), F.length(sequence)
        if mode == "wired":
            out = F.when(gc == n, bins - 1).otherwise(0)
        else:
            out = F.when(n == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor(bins * gc / n)))
    else:
        raise ValueError(f"unknown hasher {hasher}")
    return out.cast("int")


def packed_key(sequence: Column, mode: str = "intended") -> Column:
    """Three bits a base as octal digits; the wired form loses an odd last base."""
    if mode == "wired":
        sequence = F.substr(sequence, F.lit(1), F.length(sequence) - F.length(sequence) % 2)
    return F.translate(sequence, ALPHABET, PACKED)


def retag(header: Column, value: Column, mode: str = "intended") -> Column:
    """The reader's own tag before what the mapper returned from its first tab on."""
    tag = F.regexp_extract(header, "^.([^ ]*)", 1)
    rest = F.substr(value, F.instr(value, "\t"))
    rest = F.when(F.instr(value, "\t") > 0, rest).otherwise(F.raise_error(F.lit("a mapped line without a tab can't be retagged")))
    return F.concat(tag, F.lit("\t"), rest) if mode == "wired" else F.concat(tag, rest)


def record_text(header: Column, sequence: Column, plus: Column, quality: Column) -> Column:
    """A record as text: four lines, or two where plus and quality are null."""
    return F.concat_ws("\n", header, sequence, plus, quality)


def ratio(part: Column, whole: Column) -> Column:
    """Null where nothing is divided."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def output_path(path: Column, ext: str = "_out") -> Column:
    """The input's path with its extension replaced."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(ext))


def bloom_positions(bits: int, functions: int, length: int, seed: int = 1234) -> list[list[int]]:
    """The places of a key that each of the filter's functions samples: as many as octal digits cover ``bits``, from a fixed seed."""
    digits = -(-(bits - 1).bit_length() // 3)
    return np.random.default_rng(seed).integers(0, length, (functions, digits)).tolist()


def bloom_hash(key: Column, places: list[int], bits: int) -> Column:
    """The bit that one function sets: three bits for each sampled letter, the first lowest."""
    out = F.lit(0).cast("long")
    for i, p in enumerate(places):
        c = F.substring(key, p + 1, 1)
        code = F.lit(BLOOM_OTHER)
        for base, value in BLOOM_CODES.items():
            code = F.when(c == base, value).otherwise(code)
        out = out + F.shiftleft(code.cast("long"), 3 * i)
    return F.pmod(out, F.lit(bits))


def hit_rate(hits: Column, misses: Column, mode: str = "intended") -> Column:
    """Null where nothing was asked. Wired, the division is of whole numbers."""
    rate = F.try_divide(hits.cast("double"), (hits + misses).cast("double"))
    return F.floor(rate).cast("double") if mode == "wired" else rate
