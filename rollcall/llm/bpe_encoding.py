"""Operator 13, BPE encoding and decoding: content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts every text into chunks of about 640 bytes, so
passages that documents share give the same chunks wherever they stand.  A text is known
by its MD5, a chunk by its BLAKE2b digest (128 bits each).

1. Digests that occur in two different texts are found by a grouped count; a bit table of
   bounded size, built from them, tells the tasks which chunks may be shared.
2. Each shared chunk is encoded once: its words (maximal runs without a blank or line
   feed) give the token ids; a word that the chunk's edges may cut is kept as text.
3. Texts and the encodings of their shared chunks meet, once per different text.  Runs of
   chunks that no other text has are encoded there.  Where two pieces join, the text
   around the cut is encoded again, widened to both sides until it ends where its
   tokens agree with the pieces' own.  A blank or line feed is such a place: the
   tokenizer's pattern has no match across white space, normalisation does not look
   across it, and its special tokens hold none.  A chunk without one is part of a wider
   join.

So the ids are those of encoding the whole text.  Tasks remember the ids of words they
have met (bounded; a matter of speed only).  The bit table holds at most ``MOST_BITS``
bits: when shared digests outgrow it, more chunks pass for shared, which moves more data
but changes no result.

The tokenizer must cut words at blanks and line feeds and drop these, and have no decoder
of its own (tokens are joined by one blank); ``Encoder`` refuses others.  Null text is
empty: no tokens, the digests of the empty string.  Rows that repeat an id, or have none,
are each returned.  Very long texts are held whole in one task, as rows are.  An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import common

WINDOW_STEPS = 4                # the hash sees 2^4 bytes
MASK_BITS = 9                   # one place in 512 is a cut
LEAST, MOST = 128, 8192         # bytes of a chunk
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
MEMO = 300_000                  # words remembered by a worker
MEMO_CHARS = 64                 # longer words aren't
KEYS = 50_000                   # texts that a task remembers having sent
BATCH_TEXT = 8 << 20            # bytes of text that a task encodes at once (one text at least)

_GEAR = (common.mix64(np.arange(256, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32)


def cuts(raw: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's UTF-8 bytes; the last one is its length.

    A cut depends on the 16 bytes before it and the one behind; chunks are at least
    ``LEAST`` bytes (but the last) and at most ``MOST``."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    with np.errstate(over="ignore"):
        h = _GEAR[raw]
        for k in range(WINDOW_STEPS):
            far = 1 << k
            h[far:] = (h[far:] << np.uint32(far)) + h[:-far] if far < n else h[far:]
    starts = (raw & 0xC0) != 0x80                                      # bytes that begin a code point
    found = np.flatnonzero((h[:-1] >> np.uint32(32 - MASK_BITS) == 0) & starts[1:]) + 1
    out, last = [], 0
    for end in [*found.tolist(), n]:
        while end - last > MOST:
            at = last + MOST
            while not starts[at]:
                at -= 1
            out.append(at)
            last = at
        if end - last >= LEAST and end < n:
            out.append(end)
            last = end
    out.append(n)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunks(text: str) -> list[bytes]:
    raw = text.encode()
    ends = cuts(np.frombuffer(raw, np.uint8))
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """A tokenizer read from its file, with a memory of words."""

    _loaded: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if spec.get("decoder") is not None or first.get("behavior") != "Removed" or not first.get("invert"):
            raise ValueError("the tokenizer must drop white space between words and have no decoder")
        if any(c.isspace() for t in spec["added_tokens"] for c in t["content"]):
            raise ValueError("special tokens must hold no white space")
        size = max([*self.tokenizer.get_vocab(with_added_tokens=True).values()]) + 1
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.tokens = np.array([self.tokenizer.id_to_token(k) or "" for k in range(size)], object)
        self.numbers = np.array([str(k) for k in range(size)], object)
        self.memo: dict[str, bytes] = {"": b""}

    def words(self, texts: list[str]) -> list[bytes]:
        """The ids, as bytes, of every text; none may be cut inside a word."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
            memo[""] = b""
        # In order of appearance, so that encoding does not depend on the hash seed.
        unknown = list(dict.fromkeys(w for words in split for w in words if w not in memo))
        own = {}
        for k in range(0, len(unknown), 4096):
            part = unknown[k: k + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (memo if len(w) <= MEMO_CHARS else own)[w] = np.array(e.ids, self.dtype).tobytes()
        if own:
            return [b"".join([own[w] if w in own else memo[w] for w in words]) for words in split]
        return [b"".join([memo[w] for w in words]) for words in split]

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.dtype)


def edges(text: str) -> tuple[str, str, str] | None:
    """(first word, words between, last word) of a piece; None if it has no gap.  The
    first and last may be cut (or empty)."""
    a = min((k for k in (text.find(" "), text.find("\n")) if k >= 0), default=-1)
    if a < 0:
        return None
    z = max(text.rfind(" "), text.rfind("\n"))
    return text[:a], text[a + 1: z] if z > a else "", text[z + 1:]


def assemble(pieces: list[tuple[str, bytes, str] | str]) -> list[str | bytes]:
    """The ids (bytes) of pieces that follow each other, and between them the words
    (text) to encode again.  A piece: (first word, ids between, last word), or a text
    without a gap."""
    out: list[str | bytes] = []
    open_word: list[str] = []
    for piece in pieces:
        if isinstance(piece, str):
            open_word.append(piece)
            continue
        first, ids, last = piece
        out += ["".join([*open_word, first]), ids]
        open_word = [last]
    return [*out, "".join(open_word)]


# --- Spark side -----------------------------------------------------------------------------


def text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _texts(batches):
    """(key, text) of different texts, as far as the task remembers; empty ones left out."""
    met: set[bytes] = set()
    for batch in batches:
        if len(met) > KEYS:
            met.clear()
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
            if key not in met:
                met.add(key)
                if text := text.as_py():
                    yield key, text


def _record(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_DIGESTS = pa.schema([("d", pa.binary()), ("k", pa.int64())])


def _digest_rows(batches):
    """(d, k) of every chunk of every text; k: 64 bits of the text's key."""
    held: list[tuple[bytes, int]] = []
    for key, text in _texts(batches):
        k = int.from_bytes(key[:8], "big", signed=True)
        held += [(d, k) for d in {digest(c) for c in chunks(text)}]
        if len(held) > 20_000:
            yield _record(held, _DIGESTS)
            held = []
    if held:
        yield _record(held, _DIGESTS)


def _bit(d: bytes, bits: int) -> int:
    return int.from_bytes(d[:8], "big") >> 1 & bits - 1


def shared_bits(spark: SparkSession, texts: DataFrame) -> np.ndarray:
    """A bit table of the digests found in two texts or more (its size is a power of two)."""
    met = texts.mapInArrow(_digest_rows, "d binary, k long")
    # Texts whose 64 bits agree would only have their chunks encoded in place.
    twice = met.groupBy("d").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b")
    places = common.stage_table(spark, twice.select("d"), "op13-shared")
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * places.count()):
        bits *= 2

    def marks(batches):
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = np.array([_bit(d, bits) for d in batch.column("d").to_pylist()], np.int64)
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        words = table.view(np.int64)
        some = np.flatnonzero(words)
        if len(some):
            yield pa.record_batch([pa.array(some), pa.array(words[some])], names=["place", "word"])

    words = places.mapInArrow(marks, "place long, word long").groupBy("place").agg(F.expr("bit_or(word)").alias("word")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["place"].to_numpy()] = words["word"].to_numpy()
    return table.view(np.uint8)


def _maybe(table: np.ndarray, d: bytes) -> bool:
    at = _bit(d, 8 * len(table))
    return bool(table[at >> 3] >> (at & 7) & 1)


_CHUNKS = pa.schema([("d", pa.binary()), ("key", pa.binary()), ("pos", pa.int32()), ("chunk", pa.binary())])


def _shared_rows(table):
    """Task function: (d, key, pos, chunk) of chunks that may be shared; the chunk's bytes
    when the task meets it first."""

    def rows(batches):
        bits, held, sent, size = table.value, [], set(), 0
        for key, text in _texts(batches):
            for pos, c in enumerate(chunks(text)):
                d = digest(c)
                if _maybe(bits, d):
                    held.append((d, key, pos, None if d in sent else c))
                    size += 60 + (0 if d in sent else len(c))
                    sent.add(d)
            if size > 4 << 20:
                yield _record(held, _CHUNKS)
                held, size = [], 0
                if len(sent) > KEYS:
                    sent.clear()
        if held:
            yield _record(held, _CHUNKS)
    return rows


_TEXTS = pa.schema([("key", pa.binary()), ("text", pa.binary())])


def _different(batches):
    """(key, text) of different texts, each text compressed for the way."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    held, size = [], 0
    for key, text in _texts(batches):
        held.append((key, squeeze(text.encode())))
        size += len(held[-1][1])
        if size > 4 << 20:
            yield _record(held, _TEXTS)
            held, size = [], 0
    if held:
        yield _record(held, _TEXTS)


def _decoded(chunk: bytes) -> str:
    return chunk.decode()


def _encode_chunks(path: str):
    """Task function: (d, first, ids, last) of chunks; ``ids`` is null, and the chunk in
    ``first``, where it has no gap."""

    def rows(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                found = [(edges(t), t) for t in map(_decoded, part.column("chunk").to_pylist())]
                ids = encoder.words([e[1] if e else "" for e, _ in found])
                yield pa.record_batch({
                    "d": part.column("d"), "first": pa.array([e[0] if e else t for e, t in found], pa.string()),
                    "ids": pa.array([i if e else None for (e, _), i in zip(found, ids, strict=True)], pa.binary()),
                    "last": pa.array([e[2] if e else None for e, _ in found], pa.string())})
    return rows


def _pieces(text: str, shared: dict[int, tuple | str]) -> list:
    """The text's pieces in order: those of shared chunks, and runs of others as
    (first word, text between, last word), to be encoded."""
    if not shared:
        runs = [text]
    else:
        runs, run = [], []
        for pos, c in enumerate(chunks(text)):
            if pos in shared:
                if run:
                    runs.append(_decoded(b"".join(run)))
                    run = []
                runs.append(shared[pos])
            else:
                run.append(c)
        if run:
            runs.append(_decoded(b"".join(run)))
    return [(edges(r) or r) if isinstance(r, str) else r for r in runs]


_RESULT = pa.schema([("key", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _result_rows(path: str):
    """Task function over rows (key, pos, text, first, ids, last), by key, texts first."""

    def rows(batches):
        encoder, unsqueeze = Encoder.of(path), zstandard.ZstdDecompressor().decompress

        def finished(held):
            jobs, plans = [], []
            for key, text, shared in held:
                plan = []
                for part in assemble(_pieces(text, shared)):
                    if isinstance(part, str):           # text still to encode
                        plan.append(len(jobs))
                        jobs.append(part)
                    else:
                        plan.append(part)
                plans.append((key, plan))
            done = encoder.words(jobs)
            out = []
            for key, plan in plans:
                ids = encoder.ids(b"".join([done[p] if isinstance(p, int) else p for p in plan]))
                out.append((key, len(ids), hashlib.sha256(" ".join(encoder.numbers[ids].tolist()).encode()).hexdigest(),
                            hashlib.sha256(" ".join(encoder.tokens[ids].tolist()).encode()).hexdigest()))
            return _record(out, _RESULT)

        held, size = [], 0
        for batch in batches:
            for r in (r for k in range(0, batch.num_rows, 500) for r in batch.slice(k, 500).to_pylist()):
                if not held or held[-1][0] != r["key"]:
                    if size > BATCH_TEXT:
                        yield finished(held)
                        held, size = [], 0
                    text = unsqueeze(r["text"]).decode()
                    held.append((r["key"], text, {}))
                    size += len(text)
                elif r["pos"] >= 0:
                    held[-1][2][r["pos"]] = r["first"] if r["ids"] is None else (r["first"], r["ids"], r["last"])
        if held:
            yield finished(held)
    return rows


def bpe_encode(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, and the digests of its ids and of the
    text that they decode to.  ``path``: the tokenizer's file, at hand for every executor."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key())
    texts = keyed.select("key", "text")
    table = spark.sparkContext.broadcast(shared_bits(spark, texts))        # MOST_BITS / 8 bytes at most: 64 MB
    met = common.stage_table(spark, texts.mapInArrow(_shared_rows(table), "d binary, key binary, pos int, chunk binary"), "op13-chunks")
    encoded = (met.where("chunk IS NOT NULL").groupBy("d").agg(F.first("chunk").alias("chunk"))
               .mapInArrow(_encode_chunks(path), "d binary, first string, ids binary, last string"))
    places = met.select("d", "key", "pos").distinct().join(encoded, "d")

    none = F.lit(None)
    rows = (texts.mapInArrow(_different, "key binary, text binary")
            .select("key", F.lit(-1).alias("pos"), "text", none.cast("string").alias("first"), none.cast("binary").alias("ids"), none.cast("string").alias("last"))
            .unionByName(places.select("key", "pos", none.cast("binary").alias("text"), "first", "ids", "last")))
    shards = common.n_shards(spark, 12)
    results = rows.repartition(shards, "key").sortWithinPartitions("key", "pos").mapInArrow(
        _result_rows(path), "key binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    empty = hashlib.sha256(b"").hexdigest()
    return (keyed.select("doc_id", "key").join(results, "key", "left")
            .select("doc_id", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"),
                    *[F.coalesce(c, F.lit(empty)).alias(c) for c in ("ids_sha256", "decoded_sha256")]))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(spark, spark.read.parquet(common.table(sf_dir, "documents")), vocabulary())


QUERIES = {"op13_bpe_encoding": op13_bpe_encoding}
#: SQL has no tokenizer; the tests hold the query against encoding every text whole.
SQL: dict[str, str] = {}
