"""Operator 4, exact dedup: minimal perfect hash over historical distinct digests.

A text's digest is the SHA-256 of its UTF-8 bytes after each run of white space
became one space.  The distinct digests of the history are dealt to shards by
hash; each shard builds a minimal perfect hash (levels of bit arrays; a digest
takes the first level at which no other digest hits its bit) and stores, by
slot, the full digest and a locator: the smallest doc_id and the number of
rows.  A new digest is looked up in its shard's slot and compared byte by byte:
a match is a repeat of the history, everything else is grouped by itself.

Null text counts as empty, so null and empty texts are equal.  Null doc_ids come
after all others when the smallest doc_id is sought; a group of null ids only
has a null ``keep_id`` and keeps its rows.  Rows that repeat a doc_id are
returned each, and all of them are ``kept`` if their id is the one that stays.
Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import common

BITS_PER_KEY = 2.0               # first guess for a level's bits; more levels take the rest
ROWS_PER_SHARD = 50_000
INDEX_SCHEMA = ("shard int, n_keys long, level_bits array<long>, bits binary, digests binary, "
                "locators binary, known binary, counts binary")
FOUND_SCHEMA = "digest binary, keep long, n long"


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text with each run of white space as one space."""
    normal = F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACES, " ")
    return F.unhex(F.sha2(normal.cast("binary"), 256))


# --- the hash -------------------------------------------------------------------------------

def _positions(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """A bit for each key; the levels take turns with the digest's four parts, so different digests part in the end."""
    turn = np.array([level + 1], np.uint64)
    return (common.mix64(keys[:, level % 4] ^ common.mix64(keys[:, (level + 1) % 4] + turn)) % np.uint64(bits)).astype(np.int64)


def _keys(digests: np.ndarray) -> np.ndarray:
    """An (n, 32) byte array as (n, 4) 64-bit parts."""
    return np.ascontiguousarray(digests).view("<u8").reshape(len(digests), 4)


def build_mphf(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Bits per level and the concatenated bit array for distinct (n, 4) keys."""
    sizes, parts, level = [], [], 0
    while len(keys):
        bits = max(64, int(len(keys) * BITS_PER_KEY))
        at = _positions(keys, level, bits)
        alone = np.bincount(at, minlength=bits) == 1
        sizes.append(bits)
        parts.append(alone)
        keys = keys[~alone[at]]
        level += 1
    return sizes, np.concatenate(parts) if parts else np.zeros(0, bool)


def mphf_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 where no level has a bit for it (certainly not a member)."""
    rank = np.cumsum(bits) - 1
    slots = np.full(len(keys), -1, np.int64)
    left, start = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = _positions(keys[left], level, size) + start
        hit = bits[at]
        slots[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + size
    return slots


def _bytes_of(column, width: int) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), width)


def _locators(table) -> tuple[np.ndarray, np.ndarray]:
    """The smallest doc_ids, and which of them there are (a group of null ids has none)."""
    keep = table["keep"].combine_chunks()
    return keep.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), keep.is_valid().to_numpy(zero_copy_only=False)


def _build_shard(key, table):
    digests = _bytes_of(table["digest"], 32)
    keys = _keys(digests)
    sizes, bits = build_mphf(keys)
    slots = mphf_slots(keys, sizes, bits)
    order = np.empty(len(keys), np.int64)
    order[slots] = np.arange(len(keys))
    keep, known = _locators(table)
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()), "n_keys": pa.array([len(keys)], pa.int64()),
        "level_bits": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
        "digests": pa.array([digests[order].tobytes()], pa.binary()),
        "locators": pa.array([keep[order].tobytes()], pa.binary()), "known": pa.array([known[order].tobytes()], pa.binary()),
        "counts": pa.array([table["n"].to_numpy().astype("<i8")[order].tobytes()], pa.binary())})


def _lookup_shard(incoming, index):
    keep, known = (x.copy() for x in _locators(incoming))
    n = incoming["n"].to_numpy().astype(np.int64, copy=True)
    if incoming.num_rows and index.num_rows:
        row = index.to_pylist()[0]
        digests = _bytes_of(incoming["digest"], 32)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["level_bits"])].astype(bool)
        slots = mphf_slots(_keys(digests), row["level_bits"], bits)
        stored = np.frombuffer(row["digests"], np.uint8).reshape(row["n_keys"], 32)
        hit = np.flatnonzero(slots >= 0)
        hit = hit[(stored[slots[hit]] == digests[hit]).all(axis=1)]      # the byte check
        old, old_known = np.frombuffer(row["locators"], "<i8")[slots[hit]], np.frombuffer(row["known"], bool)[slots[hit]]
        keep[hit] = np.where(known[hit] & old_known, np.minimum(keep[hit], old), np.where(old_known, old, keep[hit]))
        known[hit] |= old_known
        n[hit] += np.frombuffer(row["counts"], "<i8")[slots[hit]]
    return pa.table({"digest": incoming["digest"].combine_chunks().cast(pa.binary()), "keep": pa.array(keep, pa.int64(), mask=~known), "n": n})


# --- the operator ---------------------------------------------------------------------------

def _grouped(rows: DataFrame, shards: int) -> DataFrame:
    """Distinct digests with the smallest doc_id and the number of rows.  Counted
    inside each input partition first, so a digest of very many rows moves once per partition."""
    grouped = rows.groupBy("digest").agg(
        F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """Index of (doc_id, digest) rows: one row of bit levels and slots per shard."""
    return _grouped(rows, shards).groupBy("shard").applyInArrow(_build_shard, INDEX_SCHEMA)


def lookup(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, keep, n) of the new rows' distinct digests: those in the index with
    the history's winner and rows counted in, the others by themselves."""
    return (_grouped(rows, shards).groupBy("shard").cogroup(index.groupBy("shard"))
            .applyInArrow(_lookup_shard, FOUND_SCHEMA))


def exact_dedup(spark: SparkSession, docs: DataFrame, historical: Column) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``historical`` tells the rows that the index is built over; the others are looked up in it."""
    rows = common.stage_table(spark, docs.select(
        "doc_id", digest(F.col("text")).alias("digest"), F.coalesce(historical, F.lit(False)).alias("old")), "op4-digests")
    shards = max(common.n_shards(spark), rows.count() // ROWS_PER_SHARD)
    old, new = rows.where("old"), rows.where("NOT old")
    index = common.stage_table(spark, build_index(old, shards), "op4-index")
    groups = (lookup(new, index, shards).unionByName(_grouped(old, shards).drop("shard"))
              .groupBy("digest").agg(F.min("keep").alias("keep"), F.max("n").alias("n")))
    keep = F.col("keep")
    return rows.join(groups, "digest").select(
        "doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def older_half(doc_id: Column) -> Column:
    """Rows that the query and the pipeline take as history (by hash of the id)."""
    return common.doc_fold(doc_id, 2) == 0


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay."""
    winners = (exact_dedup(spark, docs, older_half(F.col("doc_id"))).where("kept")
               .select(F.col("doc_id").alias("__winner"), "text_sha256").distinct())
    marked = docs.withColumn("__sha256", F.lower(F.hex(digest(F.col("text")))))
    same = marked["doc_id"].eqNullSafe(winners["__winner"]) & (marked["__sha256"] == winners["text_sha256"])
    return marked.join(winners, same, "left_semi").dropDuplicates(["doc_id", "__sha256"]).drop("__sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(common.table(sf_dir, "documents"))
    return exact_dedup(spark, docs, older_half(F.col("doc_id")))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
     g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.h AS text_sha256
FROM t JOIN g ON t.h = g.h
"""
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
SQL = {"op4_exact_dedup": OP4_SQL}
