"""Operator 12, phrase collocation mining: prefix-free parsing.

A text is cut where its content says so: at words whose window of four words hashes to a
trigger.  A chunk reaches from one trigger to the end of the next one's window, so
neighbours overlap by four words; copies of a passage give the same chunks.  The
dictionary holds each distinct chunk of a language once, with its frequency in the parse.
N-grams (five words at most) are then counted inside distinct chunks, weighted by that
frequency; one that begins in a chunk's last four words begins in the next chunk as well
and is left to it, so that every occurrence is counted once.

The counts go up level by level over the dictionary: an n-gram can only reach the least
count if both its parts of ``n - 1`` words do.  Which ones do is kept in a table of bits
(of their hashes) that a task looks up; these counts are of hashes and may only be too
high.  At the end the n-grams that may reach the least count are counted by their very
words, and the count decides.  A bit table holds at most ``MOST_BITS`` bits.  Where the
frequent n-grams outgrow it, more n-grams are counted in vain, none is lost.

Scores are cut by cut exact: whole numbers in 38 digits (counts up to some 10^12).

Null text has no words; a null language counts as ``und``, with documents that say so
themselves.  Repeated rows count each.  Pieces end at ``[.,;:!?]`` and line ends, words at
blanks and tabs; other white space is part of a word.  Very long texts are chunked like
others.  Equal scores rank by count, then by the phrase's bytes.  An empty table, or one
without frequent phrases, gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.llm import common

LONGEST = 5
OVERLAP = LONGEST - 1           # words of a trigger's window
PERIOD = 32                     # one window in so many is a trigger
LEAST = 100
BEST = 2000
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
SLICE_BYTES = 1 << 19           # bytes of text parsed at once (one text at least)
PHRASES = 500_000               # n-grams that a task holds before it adds up equal ones
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _byte_kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: its lower case, whether it parts words, whether it parts pieces."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    ends = np.zeros(256, bool)
    ends[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
    gap = ends.copy()
    gap[[32, 9]] = True
    return lower, gap, ends


_LOWER, _GAP, _ENDS = _byte_kinds()
_VALUES = common.mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51CED))


class Words:
    """The words of several lower-cased texts: hash, place in ``raw``, text, and whether a
    word opens a piece."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        inner = ~_GAP[raw]
        start = inner.copy()
        start[1:] &= ~inner[:-1]
        heads = offsets[:-1][offsets[:-1] < len(raw)]
        start[heads] = inner[heads]
        last = inner.copy()
        last[:-1] &= ~inner[1:] | start[1:]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(last) + 1
        n = len(self.start)
        self.first = np.searchsorted(self.start, offsets)           # first word of each text, and the end
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        ends = np.concatenate([[0], np.cumsum(_ENDS[raw])])
        self.opens = np.ones(n, bool)
        if n:
            self.opens[1:] = (ends[self.start[1:]] > ends[self.end[:-1]]) | (self.text[1:] != self.text[:-1])
            place = np.arange(len(raw)) - self.start[np.maximum(np.cumsum(start) - 1, 0)]
            with np.errstate(over="ignore"):
                weight = common._POW[place % common._POWERS] ^ (place // common._POWERS).astype(np.uint64) << np.uint64(1)
                self.hash = common.mix64(np.add.reduceat(np.where(inner, _VALUES[raw] * weight, np.uint64(0)), self.start)
                                         ^ common.mix64((self.end - self.start).astype(np.uint64)))
        else:
            self.hash = np.zeros(0, np.uint64)


def _slices(column):
    """(first row, last row + 1, lower-cased bytes, offsets) of an Arrow string column."""
    raw, offsets = common.text_buffers(column)
    for i, j in common.byte_slices(offsets, SLICE_BYTES):
        part = offsets[i: j + 1]
        yield i, j, _LOWER[raw[part[0]: part[-1]]], part - part[0]


def _window(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    size = max(0, len(h) - width + 1)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _STEP + h[k:][:size]
        return common.mix64(out + np.uint64(width))


def parse(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, whether it is its text's last) of every chunk."""
    n = len(words.hash)
    head = np.zeros(n, bool)
    head[words.first[:-1][np.diff(words.first) > 0]] = True
    trigger = head.copy()
    w = _window(words.hash, OVERLAP)
    if len(w):
        whole = words.text[: len(w)] == words.text[OVERLAP - 1:]
        trigger[: len(w)] |= whole & (w % np.uint64(PERIOD) == 0)
    first = np.flatnonzero(trigger)
    nxt = np.append(first[1:], n)
    last = np.append(head[first[1:]], True) if len(first) else np.zeros(0, bool)
    return first, np.where(last, nxt, nxt + OVERLAP), last


def _chunk_rows(batches):
    """(lang, text, last, own, n) of the chunks of a batch, equal ones together; own: words
    that begin in a chunk and are not left to the next."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        found: Counter = Counter()
        size = 0
        for i, _, raw, offsets in _slices(batch.column("text")):
            words = Words(raw, offsets)
            first, end, last = parse(words)
            if not len(first):
                continue
            data = raw.tobytes()
            own = np.where(last, end, end - OVERLAP) - first
            for a, b, t, z, k in zip(words.start[first].tolist(), words.end[end - 1].tolist(), words.text[first].tolist(), last.tolist(), own.tolist(), strict=True):
                found[langs[i + t], data[a:b], z, k] += 1
            size += len(raw)
            if size > 8 << 20:
                yield _chunk_batch(found)
                found, size = Counter(), 0
        if found:
            yield _chunk_batch(found)


def _chunk_batch(found: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()).cast(pa.string()),
                            pa.array([k[2] for k in found], pa.bool_()), pa.array([k[3] for k in found], pa.int64()),
                            pa.array(list(found.values()), pa.int64())], names=["lang", "text", "last", "own", "n"])


def dictionary(docs: DataFrame) -> DataFrame:
    """The distinct chunks (lang, text, last, own) of all texts, and how often each is in the parse."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    return (texts.mapInArrow(_chunk_rows, "lang string, text string, last boolean, own long, n long")
            .groupBy("lang", "text", "last", "own").agg(F.sum("n").alias("n")))


def _looked_up(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class _Chunks:
    """N-grams of a slice of dictionary chunks; those a chunk leaves to the next are out."""

    def __init__(self, raw, offsets, langs, last):
        self.words = w = Words(raw, offsets)
        count = np.diff(w.first)
        own = np.where(last, count, np.maximum(count - OVERLAP, 0))
        self.own = np.arange(len(w.hash)) - w.first[w.text] < own[w.text]
        seeds = {x: common.mix64(np.frombuffer(x.encode().ljust(8, b"\0")[:8], np.uint64))[0] ^ np.uint64(len(x)) for x in set(langs)}
        self.seed = np.array([seeds[x] for x in langs], np.uint64)[w.text] if len(langs) else np.zeros(0, np.uint64)
        self.inside = {1: np.ones(len(w.hash), bool)}
        for n in range(2, LONGEST + 1):         # runs of n words within one piece
            before = self.inside[n - 1]
            self.inside[n] = before[:-1] & ~w.opens[n - 1:] if len(before) else before

    def hashes(self, n: int) -> np.ndarray:
        h = _window(self.words.hash, n)
        return common.mix64(h ^ self.seed[: len(h)])

    def frequent(self, n: int, tables: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the n-grams that the tables let pass."""
        h = self.hashes(n)
        take = self.inside[n] & self.own[: len(h)]
        if n in tables:
            take &= _looked_up(tables[n], h)
        elif n > 1:
            part = _looked_up(tables[n - 1], self.hashes(n - 1))
            take &= part[:-1] & part[1:]
        at = np.flatnonzero(take)
        return at, h[at]


def _chunk_slices(batch):
    langs, last, n = batch.column("lang").to_pylist(), batch.column("last").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
    for i, j, raw, offsets in _slices(batch.column("text")):
        yield _Chunks(raw, offsets, langs[i:j], last[i:j]), raw, langs[i:j], n[i:j]


def _summed(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, total = _first_of_each(h, weight)
    return h[at], total


def _first_of_each(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one entry, sum of weights) of each distinct hash."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h)
    first = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
    return order[first], np.add.reduceat(weight[order].astype(np.int64), first)


def _hash_rows(n: int, tables):
    """Task function: (h, n) of the n-grams of a dictionary that may be frequent."""

    def rows(batches):
        known = {k: b.value for k, b in tables.items()}
        held, size = [], 0
        for batch in batches:
            for chunks, _, _, weight in _chunk_slices(batch):
                at, h = chunks.frequent(n, known)
                held.append(_summed(h, weight[chunks.words.text[at]]))
                size += len(held[-1][0])
                if size > 2_000_000:
                    h, w = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(w)], names=["h", "n"])
                    held, size = [], 0
        if size:
            h, w = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(w)], names=["h", "n"])
    return rows


def _bit_table(spark: SparkSession, hashes: DataFrame, name: str) -> np.ndarray:
    """A bit table (a power of two in size) of the column ``h``."""
    hashes = common.stage_table(spark, hashes, name)
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * hashes.count()):
        bits *= 2
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = (hashes.groupBy(F.shiftright(place, 6).alias("place"))
             .agg(F.expr(f"bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("word")).toArrow())
    table = np.zeros(bits // 64, np.int64)
    table[words["place"].to_numpy()] = words["word"].to_numpy()
    return table.view(np.uint8)


def _spaced(words: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with one space after each, and where each word begins there."""
    size = words.end - words.start
    first = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(first[-1], 32, np.uint8)
    out[_ranges(first[:-1], size)] = raw[_ranges(words.start, size)]
    return out, first


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of every range of ``size`` numbers, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(size.sum())


def _phrase_rows(tables):
    """Task function: (lang, phrase, n) of all n-grams that may be frequent, by their words."""

    def rows(batches):
        known = {k: b.value for k, b in tables.items()}
        held, texts, size, found = [], [], 0, 0
        for batch in batches:
            for chunks, raw, langs, weight in _chunk_slices(batch):
                w = chunks.words
                data, first = _spaced(w, raw)
                names = np.array(langs, object)
                for n in range(1, LONGEST + 1):
                    at, h = chunks.frequent(n, known)
                    one, total = _first_of_each(h, weight[w.text[at]])
                    at = at[one]
                    held.append((h[one], total, size + first[at], first[at + n] - first[at] - 1, names[w.text[at]]))
                    found += len(one)
                texts.append(data)
                size += len(data)
                if found > PHRASES or size > 16 * SLICE_BYTES:
                    yield from _phrase_batches(held, texts)
                    held, texts, size, found = [], [], 0, 0
        if found:
            yield from _phrase_batches(held, texts)
    return rows


def _phrase_batches(held: list[tuple], texts: list[np.ndarray]):
    """Equal n-grams of several slices together; ``held``: (hash, count, place and length in
    ``texts``, language) of each slice."""
    h, n, first, size, lang = (np.concatenate(x) for x in zip(*held, strict=True))
    one, n = _first_of_each(h, n)
    first, size, lang = first[one], size[one], lang[one]
    data = np.concatenate(texts)
    ends = np.concatenate([[0], np.cumsum(size)])
    for i, j in common.byte_slices(ends, SLICE_BYTES):
        part = pa.py_buffer((ends[i: j + 1] - ends[i]).astype(np.int64)), pa.py_buffer(data[_ranges(first[i:j], size[i:j])])
        phrase = pa.LargeStringArray.from_buffers(j - i, *part).cast(pa.string())
        yield pa.record_batch([pa.array(lang[i:j], pa.string()), phrase, pa.array(n[i:j])], names=["lang", "phrase", "n"])


def phrase_counts(spark: SparkSession, chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to 5 words found ``least`` times or more."""
    tables: dict = {}
    for n in range(1, LONGEST):
        counted = chunks.mapInArrow(_hash_rows(n, tables), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        tables[n] = spark.sparkContext.broadcast(        # MOST_BITS / 8 bytes at most: 64 MB
            _bit_table(spark, counted.where(F.col("n") >= least).select("h"), f"op12-frequent-{n}"))
    return (chunks.mapInArrow(_phrase_rows(tables), "lang string, phrase string, n long")
            .groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least))


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """Per language the ``best`` phrases: lang, rank, phrase, a, l, r, n, score."""
    chunks = common.stage_table(spark, dictionary(docs), "op12-dictionary")
    counts = common.stage_table(spark, phrase_counts(spark, chunks, least), "op12-phrases")
    size = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))

    split = F.split("phrase", " ")
    candidates = counts.withColumn("w", split).where(F.size("w") > 1).withColumnRenamed("f", "a")
    # A phrase inside a longer one as frequent is inside one a word longer that is (counts only fall).
    longer = (candidates.where(F.size("w") > 2)
              .select("lang", F.explode(F.array(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"))).alias("part"), "a")
              .groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("a").alias("within")))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where("within IS NULL OR within < a").drop("within")
    cut = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"),
        F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("right"))
    parts = (cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
             .join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
             .join(size, "lang"))
    exact = "cast(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(16,0)) as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))"
    scored = parts.withColumn("score", F.expr(exact))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, spark.read.parquet(common.table(sf_dir, "documents")))


OP12_SQL = r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
gram AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_part AS (
    SELECT lang, array_to_string(w[s:s + size - 1], ' ') AS phrase, max(a) AS within
    FROM (SELECT lang, a, w, m, size, unnest(range(1, m - size + 2)) AS s
          FROM cand, (SELECT unnest(range(2, 5)) AS size) WHERE size < m)
    GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN inner_part i USING (lang, phrase) WHERE i.within IS NULL OR 100 * i.within < 100 * c.a),
cut AS (
    SELECT lang, phrase, a, c AS cut_at, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:m], ' ') AS rp
    FROM (SELECT *, unnest(range(1, m)) AS c FROM kept)),
scored AS (
    SELECT cut.lang, cut.phrase, cut.a, cut_at, x.f AS l, y.f AS r, t.n,
           1000::HUGEINT * cut.a::HUGEINT * t.n::HUGEINT // (x.f::HUGEINT * y.f::HUGEINT) AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp JOIN total t ON t.lang = cut.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
QUERIES = {"op12_phrase_collocations": op12_phrase_collocations}
SQL = {"op12_phrase_collocations": OP12_SQL}
