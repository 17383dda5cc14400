"""Helpers shared by the operators of this package: word rules, the scratch
table that cuts lineage, and vectorised word hashing for Arrow tasks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.session import checkpoint_root

#: The white space between words, and its complement.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
_SPACE_BYTES = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint8)


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage_table(spark: SparkSession, df: DataFrame, name: str,
                partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: later steps reread the files when an executor is
    lost, and columns they don't need are pruned.  An empty table keeps its
    schema because the reader is given it."""
    path = stage_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_shards(spark: SparkSession, least: int = 32) -> int:
    """Shards for hash-dealt work: follows the session's shuffle width."""
    return max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def doc_fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, mod ``k``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


# --- numpy side -----------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    space = np.zeros(256, dtype=bool)
    space[_SPACE_BYTES] = True
    value = mix64(lower + np.uint64(0x1234567))
    value[space] = 0
    return value, space


#: A random value per byte (that of the lower-case letter for A-Z, 0 for white space).
_VALUE, _IS_SPACE = _byte_tables()

#: Powers of the odd multiplier, and of its inverse, for words up to this many bytes at once.
_POWERS = 1 << 12

#: Bytes of text hashed at once (one text at least).
_HASH_BYTES = 1 << 19


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _MULT, dtype=np.uint64))]).astype(np.uint64)


_POW = _powers(_POWERS)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the (n + 1) offsets of an Arrow string column; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def hash_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) of several texts, in order,
    and the number of words of each text.

    A word's hash is a polynomial over its bytes modulo 2^64, mixed with its
    length.  Sums over the words come from ``reduceat``, so a batch of texts
    takes a few passes over its bytes."""
    n_docs = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    space = _IS_SPACE[raw]
    inner = ~space
    start = inner.copy()
    start[1:] &= space[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(raw)]
    start[bounds] = inner[bounds]          # a text's first byte never continues the text before it
    first = np.flatnonzero(start)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    position = np.arange(len(raw), dtype=np.int64)
    owner = np.cumsum(start) - 1           # the word that a byte belongs to, or follows
    owner[owner < 0] = 0
    within = position - first[owner]
    weight = _POW[within % _POWERS]
    if within.size and int(within[inner].max(initial=0)) >= _POWERS:   # very long words: fold the block number in
        weight = weight ^ mix64((within // _POWERS).astype(np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_VALUE[raw] * weight, first)
        length = np.add.reduceat(inner.astype(np.int64), first).astype(np.uint64)
        hashes = mix64(sums ^ mix64(length + np.uint64(0x51ED270B)))
    counts = np.diff(np.searchsorted(first, offsets))
    return hashes, counts


def byte_slices(offsets: np.ndarray, limit: int = 2 << 20):
    """Ranges of texts holding at most ``limit`` bytes together (one text at least)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_hash_slices(column, limit: int = 2 << 20):
    """For an Arrow string column: ``(first row, last row + 1, hashes, words per row)``."""
    raw, offsets = text_buffers(column)
    for i, j in byte_slices(offsets, limit):
        # Hashing takes dozens of bytes a byte of text, so a slice is hashed piece by piece.
        pieces = []
        for a, b in byte_slices(offsets[i: j + 1], _HASH_BYTES):
            part = offsets[i + a: i + b + 1]
            pieces.append(hash_words(raw[part[0]: part[-1]], part - part[0]))
        yield i, j, *(np.concatenate(x) for x in zip(*pieces, strict=True))
