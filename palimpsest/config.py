"""Options of the engine, from key=value text or from code.

``read_options`` follows the format of the engine's control files: every
character of white space is dropped, ``#`` opens a comment line, a later key
replaces an earlier one and a line without ``=`` is its own key and value.
"""

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyarrow import fs

from palimpsest.functions import keys

# fixed values: the names that control files use
COMPRESSIONS = ("none", "full", "cross")
HASHERS = ("none", "cache_aware", "single", "double", "triple", "gc")
POLICIES = ("none", "lru", "mru")
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


class ConfigError(ValueError):
    pass


def read_options(text: str, repeat_is_error: bool = False) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in text.split("\n"):
        line = re.sub(r"\s", "", line)
        if not line or line.startswith("#"):
            continue
        key, found, value = line.partition("=")
        if repeat_is_error and key in out:
            raise ConfigError(f"{key} is given twice")
        out[key] = value if found else line
    return out


def read_file(path: str) -> dict[str, str]:
    if not path.endswith(".ini"):
        raise ConfigError(f"{path}: a control file ends in .ini")
    system, place = fs.FileSystem.from_uri(path if "://" in path else str(Path(path).absolute()))
    with system.open_input_stream(place) as f:
        return read_options(f.read().decode()) | {"_this_config": path}


def get_bool(options: dict[str, str], key: str) -> bool:
    """False where the key is missing; anything but a known word is an error."""
    value = options.get(key, "false").lower()
    if value in TRUE:
        return True
    if value in FALSE:
        return False
    raise ConfigError(f"{key}={value} is no truth value")


def get_int(options: dict[str, str], key: str, default: int) -> int:
    """The leading integer of a value; the default where the key is missing."""
    if key not in options:
        return default
    m = re.match(r"[+-]?\d+", options[key])
    if not m:
        raise ConfigError(f"{key}={options[key]} is no integer")
    return int(m[0])


def get_float(options: dict[str, str], key: str, default: float) -> float:
    if key not in options:
        return default
    m = re.match(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", options[key])
    if not m:
        raise ConfigError(f"{key}={options[key]} is no number")
    return float(m[0])


@dataclass(frozen=True)
class BloomBits:
    """Size of an admission filter that may take an unknown key for a known one: ``bits``, ``functions``, and how many places of a key they sample."""

    bits: int = 1 << 24
    functions: int = 4
    length: int = 100
    seed: int = 1234


@dataclass(frozen=True)
class EngineConfig:
    """

    ``bloom`` alone stands for an admission filter that never errs; ``bloom_bits`` gives one of a size.
    ``hasher``, ``key`` and ``output`` can name expressions that were added to ``functions.keys``.
    """

    bucket_size: int = 50_000
    hasher: str = "none"
    compression: str = "none"
    cache_policy: str = "none"
    bloom: bool = False
    cache_capacity: int = 4_194_304
    chain_order: str = "longest"
    #: 1: one sorted bucket for each chain
    max_chain: int = 0
    seed: int = 0
    key: str = ""
    output: str = ""
    bloom_bits: BloomBits | None = None
    max_interleave: int = 1
    file_type: str = "fastq"
    input_pattern: str = r"(.*)\.fastq"
    output_ext: str = "_out"
    suppress_output: bool = False
    retag: bool = False
    packed_key: bool = False
    #: threads of the mapper's process, for which its tasks take cores
    threads: int = 1
    mode: str = "intended"
    options: dict[str, str] = field(default_factory=dict, compare=False)

    def __post_init__(self):
        for name, value, known in (
            ("hasher", self.hasher, (*HASHERS, *keys.HASHERS)),
            ("key", self.key, ("", *keys.KEYS)),
            ("output", self.output, ("", *keys.OUTPUTS)),
            ("file_type", self.file_type, ("fastq", "fasta")),
            ("compression", self.compression, COMPRESSIONS),
            ("cache_policy", self.cache_policy, POLICIES),
            ("chain_order", self.chain_order, ("longest", "random")),
            ("mode", self.mode, ("intended", "wired")),
        ):
            if value not in known:
                raise ConfigError(f"{name}={value}: one of {', '.join(known)}")
        if self.threads < 1:
            raise ConfigError("threads: at least 1")
        if self.bucket_size < 1 or self.cache_capacity < 2 or self.max_interleave < 1:
            raise ConfigError("bucket_size, max_interleave: at least 1; cache_capacity: at least 2")

    @classmethod
    def from_options(cls, options: dict[str, str], **more) -> "EngineConfig":
        decorator = options.get("cache_decorator", "")
        if decorator and decorator != "bloom_filter":
            raise ConfigError(f"cache_decorator={decorator} is unknown")
        hasher = options.get("hash_func", "none")
        return cls(
            **{
                "bucket_size": get_int(options, "bucket_size", 50_000),
                "hasher": hasher if hasher in HASHERS or hasher in keys.HASHERS else "none",  # unknown names mean no hashing
                "compression": options.get("compression", "none"),
                "cache_policy": options.get("cache_policy", "none"),
                "bloom": bool(decorator) and "cache_policy" in options,  # only heeded beside a policy
                "chain_order": "random" if options.get("chain_switch") == "random" else "longest",
                "max_chain": get_int(options, "max_chain", 0),
                "file_type": "fasta" if options.get("file_type") == "fasta" else "fastq",
                "max_interleave": get_int(options, "max_interleave", 1),
                "input_pattern": options.get("input_pattern", r"(.*)\.fastq"),
                "output_ext": options.get("output_ext", "_out"),
                "suppress_output": "suppress_sam" in options,  # present is enough
                "retag": get_bool(options, "retag"),
                "packed_key": get_bool(options, "store_bin"),
                "threads": get_int(options, "threads", 1),
                "options": options,
            }
            | more
        )
