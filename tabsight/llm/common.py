"""Helpers shared by the training-data operators.

* ``write_table`` cuts lineage: it writes a DataFrame to the shared folder
  named by ``spark.checkpoint.dir`` and reads it back, so a lost executor
  never repeats or changes what follows.
* ``ascii_words`` / ``space_words`` / ``token_hashes`` split texts inside
  Arrow batches.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabsight.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def free_name(base: str, *taken: list[str]) -> str:
    """``base``, with underscores in front until no column has that name (in any case)."""
    used = {c.lower() for names in taken for c in names}
    while base.lower() in used:
        base = "_" + base
    return base


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bounds the texts of one Arrow batch, in Spark and in the Python worker.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of about 4 MB, where the session names no size of its own:
    the row limit alone lets a batch grow with the length of the texts."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, "4m")


# ------------------------------------------------------------------ words
#: A-Z to a-z; 0-9, a-z and all bytes of non-ASCII characters stay; the rest becomes a space.
_WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: A-Z to a-z, the rest unchanged.
_LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def ascii_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(_WORD_TABLE).split()


def lower_ascii(text: bytes) -> bytes:
    """The text with A-Z lower-cased."""
    return text.translate(_LOWER_TABLE)


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``bytes.split`` splits at exactly these bytes."""
    return text.split()


# ------------------------------------------------- vectorised token hashes
_rng = np.random.default_rng(20240501)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process and grown by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        np.multiply.accumulate(np.full(size - 1, base, dtype=np.uint64), out=have[1:])
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Byte classes: 0 white space, 1 letters, digits and non-ASCII bytes, 2 other signs.
TOKEN_CLASS = np.array(
    [0 if c in (32, 9, 10, 11, 12, 13) else 1 if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 2 for c in range(256)],
    dtype=np.uint8,
)
#: Byte classes of plain white-space words.
SPACE_CLASS = np.minimum(TOKEN_CLASS, 1)
_CHUNK = 1 << 20  # bytes hashed at once, so that very long texts need bounded memory


def token_hashes(text: bytes, classes: np.ndarray, lower: bool = False, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """64-bit hashes of the runs of bytes of one non-zero class, in order.

    The hash of a run is a polynomial of its bytes modulo 2**64, mixed. Long
    texts are cut at white space into bounded chunks first. With ``prefixes``
    there is a row per run: its hash and those of its first so many bytes (0
    if it is shorter).
    """
    if len(text) > _CHUNK + (_CHUNK >> 1):
        parts, at = [], 0
        while at < len(text):
            end = min(len(text), at + _CHUNK)
            while end < len(text) and classes[text[end]] != 0:
                end += 1
            parts.append(_hash_runs(text[at:end], classes, lower, prefixes))
            at = end
        return np.concatenate(parts)
    return _hash_runs(text, classes, lower, prefixes)


def _hash_runs(text: bytes, classes: np.ndarray, lower: bool, prefixes: tuple[int, ...]) -> np.ndarray:
    if lower:
        text = text.translate(_LOWER_TABLE)
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        return np.empty((0, 1 + len(prefixes)) if prefixes else 0, dtype=np.uint64)
    kind = classes[raw]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], edge))
    ends = np.concatenate((edge, [len(raw)]))
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[raw] * powers(_BASE, len(raw)), out=sums[1:])
    back = powers(_BASE_INV, len(raw))[starts]
    whole = mix((sums[ends] - sums[starts]) * back)
    if not prefixes:
        return whole
    out = np.zeros((len(whole), 1 + len(prefixes)), dtype=np.uint64)
    out[:, 0] = whole
    for k, size in enumerate(prefixes, 1):
        fits = ends - starts >= size
        out[fits, k] = mix((sums[starts[fits] + size] - sums[starts[fits]]) * back[fits])
    return out


class KeyTable:
    """Places of 64-bit keys (not 0) in a sorted array, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.row = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int32)
        self.probes = 1
        for row, (key, slot) in enumerate(zip(keys.tolist(), (keys >> self.shift).tolist(), strict=True)):
            step = 0
            while self.key[(slot + step) & self.mask]:
                step += 1
            self.key[(slot + step) & self.mask], self.row[(slot + step) & self.mask] = key, row
            self.probes = max(self.probes, step + 1)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, -1 if it is none of the keys."""
        slot = (wanted >> self.shift).astype(np.int64)
        found = np.full(wanted.shape, -1, dtype=np.int32)
        for step in range(self.probes):
            at = (slot + step) & self.mask
            hit = (self.key[at] == wanted) & (wanted != 0)
            found[hit] = self.row[at[hit]]
        return found
