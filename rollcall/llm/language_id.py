"""Operator 6, language identification by rank-order profiles.

A language's profile lists its ``PROFILE`` most frequent character n-grams (1 to 3
characters, words padded with a space) by rank; a document's most frequent n-grams
are ranked the same way, and its distance to a profile is the sum of how far each
n-gram is out of place (``PROFILE`` for one the profile lacks).  The nearest profile
names the language.

N-grams are counted over all training rows; only the profiles (``PROFILE`` rows per
language) reach the driver, in blocks of about ``BLOCK`` languages.  A document goes
through the blocks one after the other and keeps the nearest language so far.

Null texts and texts without a letter are ``und`` with score 0, and so is everything
when nothing could be learned.  Ties in frequency go by n-gram code, ties in distance
by language name.  Whole texts are counted, whatever their length.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.llm import common

PROFILE = 400
BLOCK = 1000                    # languages a broadcast holds, about
UNKNOWN = "und"
_CHAR_BITS = 21


@cache
def _letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's 1- to 3-grams and their counts; none without a letter.

    Anything but a letter separates words; a word is padded with one space on each side."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    x = _letters()[points]
    inner = x > 0
    if not inner.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = inner.copy()
    keep[1:] |= inner[:-1]                            # the first separator after a word stays, as its space
    x = np.concatenate([[0], x[keep], [0]])
    two = (x[:-1] << _CHAR_BITS) | x[1:]
    three = (two[:-1] << _CHAR_BITS) | x[2:]
    grams = np.concatenate([x[x > 0], two[two > 0] | 1 << 61, three[(three > 0) & (x[1:-1] > 0)] | 1 << 62])
    return np.unique(grams, return_counts=True)


def ranked(text: str, most: int = PROFILE) -> np.ndarray:
    """The text's most frequent n-grams, in order of rank."""
    grams, counts = gram_counts(text)
    return grams[np.argsort(-counts, kind="stable")[:most]]


def _count_rows(batches):
    """(lang, gram, n), summed within the task as far as ``LIMIT`` entries."""
    limit, held = 200_000, {}

    def rows():
        langs, grams, counts = [], [], []
        for (lang, g), n in held.items():
            langs.append(lang), grams.append(g), counts.append(n)
        held.clear()
        return pa.record_batch({"lang": pa.array(langs, pa.string()), "gram": pa.array(grams, pa.int64()), "n": pa.array(counts, pa.int64())})

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            grams, counts = gram_counts(text)
            for g, n in zip(grams.tolist(), counts.tolist(), strict=True):
                held[lang, g] = held.get((lang, g), 0) + n
            if len(held) > limit:
                yield rows()
    yield rows()


def learn(rows: DataFrame) -> DataFrame:
    """(lang, gram, rank) profiles from (text, lang) rows."""
    counts = (rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
              .mapInArrow(_count_rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    first = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROFILE)     # cut before the shuffle, too
    return first.select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Profiles:
    """Profiles as a sorted array of their n-grams, each with its range of (language, rank) entries."""

    def __init__(self, rows):
        self.langs = sorted({r["lang"] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        grams = np.array([r["gram"] for r in rows], np.int64)
        order = np.argsort(grams, kind="stable")
        self.lang = np.array([at[r["lang"]] for r in rows], np.int32)[order]
        self.rank = np.array([r["rank"] for r in rows], np.int32)[order]
        self.grams, starts = np.unique(grams[order], return_index=True)
        self.starts = np.append(starts, len(grams))

    def nearest(self, grams: np.ndarray) -> tuple[int, str]:
        """(distance, language) of the nearest profile to ranked n-grams."""
        at = np.searchsorted(self.grams, grams)
        here = np.flatnonzero((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == grams))
        first, n = self.starts[at[here]], self.starts[at[here] + 1] - self.starts[at[here]]
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        less = PROFILE - np.abs(self.rank[entry] - np.repeat(here, n))
        distance = PROFILE * len(grams) - np.bincount(self.lang[entry], weights=less, minlength=len(self.langs)).astype(np.int64)
        best = int(np.argmin(distance))
        return int(distance[best]), self.langs[best]


def _nearest_rows(shared, names):
    def rows(batches):
        for batch in batches:
            out = {"n": [], "distance": [], "lang_pred": []}
            for text, distance, lang in zip(*(batch.column(c).to_pylist() for c in ("text", "distance", "lang_pred")), strict=True):
                grams = ranked(text) if text is not None else ()
                best = (distance, lang) if lang is not None else None
                if len(grams):
                    here = shared.value.nearest(grams)
                    best = here if best is None else min(best, here)
                out["n"].append(len(grams))
                out["distance"].append(best[0] if best else None)
                out["lang_pred"].append(best[1] if best else None)
            kept = {c: batch.column(c) for c in names if c not in out}
            yield pa.record_batch(kept | {"n": pa.array(out["n"], pa.int64()), "distance": pa.array(out["distance"], pa.int64()),
                                          "lang_pred": pa.array(out["lang_pred"], pa.string())})
    return rows


def identify(spark: SparkSession, docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``; score is 1 less the distance's share of the largest."""
    profiles = common.stage_table(spark, profiles, "op6-profiles")
    blocks = -(-profiles.agg(F.countDistinct("lang")).first()[0] // BLOCK)
    found = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("distance"),
                        F.lit(None).cast("string").alias("lang_pred"))
    for k in range(blocks):
        rows = profiles.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k).collect()
        if rows:
            names = ["doc_id", "text", "n", "distance", "lang_pred"]
            shared = spark.sparkContext.broadcast(Profiles(rows))
            found = found.mapInArrow(_nearest_rows(shared, names), "doc_id long, text string, n long, distance long, lang_pred string")
    share = F.col("distance").cast("double") / (F.col("n") * PROFILE)
    return found.select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
                        F.when(F.col("lang_pred").isNull(), 0.0).otherwise(1.0 - share).alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(common.table(sf_dir, "documents"))
    profiles = learn(docs.where(common.doc_fold(F.col("doc_id"), 4) != 2))
    return identify(spark, docs, profiles).select(
        "doc_id", (common.doc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


#: Not in SQL; tests hold it against a plain version of the same method.
QUERIES = {"op6_language_id": op6_language_id}
SQL: dict[str, str] = {}
