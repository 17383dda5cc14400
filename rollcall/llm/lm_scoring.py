"""Operator 7, language-model scoring with Elias-Fano n-gram tries.

The model reads a text backwards: it gives each token's probability under the token
that follows (the end mark follows the last word and is the last to be predicted),
``p(w | c) = (n(c, w) + MU q(w)) / (n(c) + MU)``, with a smoothed unigram ``q``.  Every
word of the training texts has its own q, rounded down to a power of 2^(1/4); a word
they don't have counts once.

The trie is cut by context into shards.  A shard has two levels, each one monotone
sequence in Elias-Fano code: the contexts' hashes, and the words seen below them
with the context's rank in front.  A word is thus found by a successor search
relative to its context.  Probabilities are quantised to a byte.  Levels are flat
buffers in a memory-mapped temporary file of the task, closed with it.

Each input slice sends a shard one packed row with the positions whose context
belongs to it; the shard's task builds the trie from those of training texts and
looks up all of them.  It handles the distinct pairs of a slice with their numbers,
so that a very common pair, all of whose positions meet in one shard, costs memory
once per slice.  What goes back to the slice is a byte per position and the contexts'
totals, from which the slice's rows are summed: sums by row and shard would grow with
the number of shards.  Contexts frequent enough to fill a shard are spread over all
shards by the predicted word; their totals come from the table of the ``TOP`` most
frequent words.  That table also spares frequent words a join: slices write their
codes of q.  Each other word that a shard predicts is sent, once per slice, to the
bucket of its count, which returns its code to the shard.  Nothing but the table and
three totals reaches the driver; word counts stay in Spark.

Null text is empty: one token, the end mark.  Repeated rows are scored alike, and
each trains.  Without training texts the base and the model give every token
probability 1 (log 0).  Words are 64-bit hashes; below a context, 32 bits of them.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import common
from rollcall.session import shuffles_dropped

TOP = 65_536
MU = 20.0
TOKENS_PER_SHARD = 1_000_000
SLICE_BYTES = 4 << 20
SLICE_ROWS = 1 << 15
STEPS = 32.0                    # quantisation: steps per power of ten
END = int(common.mix64(np.array([7], np.uint64))[0])
RUN = 255                       # positions of one context that a byte counts
CHUNK = 1 << 18                 # pairs looked up at once
SLICE_SCHEMA = "shard int, base long, tops binary, contexts binary, repeats binary, held binary, top_words binary, words binary, rows binary, ids binary, known binary"
KEY_SCHEMA = "bucket int, shards binary, words binary"
CODE_SCHEMA = "shard int, words binary, codes binary"
FOUND_SCHEMA = "base long, tops binary, totals binary, repeats binary, rows binary, seen binary, codes binary, ids binary, known binary"
SCORE_SCHEMA = "doc_id long, n_tokens long, n_known long, base double, score double"


# --- Elias-Fano -----------------------------------------------------------------------------

SAMPLED = 8                     # one zero in so many has its place in a directory
_WORD = 56                      # bits read at once from any place


def _windows(raw: np.ndarray) -> np.ndarray:
    """The 64 bits that begin at each byte, without a copy; ``raw`` ends with 8 spare bytes."""
    return np.ndarray((max(len(raw) - 7, 0),), "<u8", buffer=raw, strides=(1,))


def _bits_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """At least 57 bits from each bit place on, the first one lowest."""
    return _windows(raw)[at >> 3] >> (at & 7).astype(np.uint64)


class Monotone:
    """A sorted sequence of distinct 64-bit numbers in Elias-Fano code: the low bits at
    their exact width, the high parts as a unary bit string, and the places of every
    eighth zero of it as 32-bit numbers.  All three stay on the mapped bytes."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray, zeros: np.ndarray, n_zeros: int):
        self.n, self.low_bits, self.high, self.low, self.zeros, self.n_zeros = n, low_bits, high, low, zeros, n_zeros

    @staticmethod
    def encode(values: np.ndarray) -> tuple[dict[str, int], dict[str, np.ndarray]]:
        """(shape, parts) of a sequence; the parts may be written and mapped again."""
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = min(_WORD, max(0, (universe // max(n, 1)).bit_length() - 1))
        top = (values >> np.uint64(low_bits)).astype(np.int64) if n else np.zeros(0, np.int64)
        bits = np.zeros((int(top[-1]) if n else 0) + n + 1, np.uint8)
        bits[top + np.arange(n)] = 1
        zeros = np.flatnonzero(bits == 0)
        high = np.concatenate([np.packbits(bits, bitorder="little"), np.zeros(8, np.uint8)])
        parts = []
        step = 1 << 16                  # a multiple of 8, so that pieces end on whole bytes
        for k in range(0, n, step):
            each = np.unpackbits(values[k: k + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            parts.append(np.packbits(each[:, :low_bits].ravel(), bitorder="little"))
        low = np.concatenate([*parts, np.zeros(8, np.uint8)])
        return ({"n": n, "low_bits": low_bits, "n_zeros": len(zeros)},
                {"high": high, "low": low, "zeros": zeros[::SAMPLED].astype("<u8" if len(bits) >> 32 else "<u4")})

    @classmethod
    def of(cls, values: np.ndarray) -> Monotone:
        shape, parts = cls.encode(values)
        return cls(**shape, **parts)

    @property
    def nbytes(self) -> int:
        return self.high.nbytes + self.low.nbytes + self.zeros.nbytes

    def _low(self, at: np.ndarray) -> np.ndarray:
        return _bits_at(self.low, at * self.low_bits) & np.uint64((1 << self.low_bits) - 1)

    def _zero(self, t: np.ndarray) -> np.ndarray:
        """The place of the t-th zero of the high part: from the directory's zero before it
        on, word by word."""
        place = self.zeros[t // SAMPLED].astype(np.int64)
        more = t % SAMPLED
        left = np.flatnonzero(more > 0)
        start, want = place[left] + 1, more[left]
        while len(left):
            open_ = ~_bits_at(self.high, start) & np.uint64((1 << _WORD) - 1)       # its zeros as ones
            have = np.bitwise_count(open_).astype(np.int64)
            hit = have >= want
            word, skip = open_[hit], want[hit] - 1
            for k in range(SAMPLED - 2):                                            # drop those before it
                word = np.where(skip > k, word & (word - np.uint64(1)), word)
            first = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            place[left[hit]] = start[hit] + first
            left, start, want = left[~hit], start[~hit] + _WORD, (want - have)[~hit]
        return place

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key, or -1: the successor within the key's run of equal high parts."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n:
            return out
        top = keys >> np.uint64(self.low_bits)
        low = keys & np.uint64((1 << self.low_bits) - 1)
        left = np.flatnonzero(top < np.uint64(self.n_zeros))
        t = top[left].astype(np.int64)
        # Before the run of t lie as many ones as its first place less t.
        at = np.where(t > 0, self._zero(np.maximum(t - 1, 0)) + 1 - t, 0)
        end = self._zero(t) - t
        # The successor by halving: a frequent context's words may all share one high part.
        key, lo, hi = low[left], at, end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < key[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        inside = np.flatnonzero(lo < end)
        hit = inside[self._low(lo[inside]) == key[inside]]
        out[left[hit]] = lo[hit]
        return out


class Trie:
    """Contexts and the words below them, with the context's total and the quantised
    probability of each word."""

    def __init__(self, levels: dict[str, np.ndarray], shape: dict[str, dict[str, int]]):
        self.file = tempfile.TemporaryFile()
        place, at = {}, 0
        for name, data in levels.items():
            raw = data.tobytes()
            self.file.write(raw)
            place[name] = (at, len(raw), data.dtype)
            pad = -len(raw) % 8             # the next part begins at a multiple of 8
            self.file.write(bytes(pad))
            at += len(raw) + pad
        self.file.write(b"\0")
        self.file.flush()
        mapped = np.memmap(self.file, np.uint8, "r")
        view = {name: mapped[a: a + size].view(kind) if size else np.zeros(0, kind) for name, (a, size, kind) in place.items()}
        level = lambda name: Monotone(**shape[name], **{k: view[f"{name}_{k}"] for k in ("high", "low", "zeros")})
        self.contexts, self.words = level("contexts"), level("words")
        self.totals, self.codes = view["totals"], view["codes"]

    @classmethod
    def build(cls, contexts, totals, pair_context, pair_word, log_p) -> Trie:
        shape, levels = {}, {"totals": totals.astype("<f8"), "codes": quantised(log_p)}
        for name, keys in (("contexts", contexts), ("words", (pair_context.astype(np.uint64) << np.uint64(32)) | pair_word)):
            shape[name], parts = Monotone.encode(keys)
            levels |= {f"{name}_{k}": v for k, v in parts.items()}
        return cls(levels, shape)

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Rank of each word under its context, or -1."""
        context = self.contexts.find(contexts)
        keys = (np.maximum(context, 0).astype(np.uint64) << np.uint64(32)) | words
        return np.where(context >= 0, self.words.find(keys), -1)

    def close(self) -> None:
        self.file.close()


def quantised(log_p: np.ndarray) -> np.ndarray:
    """Steps below 0, rounded away from it, so that probabilities don't grow."""
    return np.minimum(np.ceil(-log_p * STEPS - 1e-9), 255).astype(np.uint8)


# --- counts and slices ----------------------------------------------------------------------

def _texts(batches):
    """(batch, first row, last row + 1, word hashes, words per row), in slices of bounded size."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(k, SLICE_ROWS)
            for i, j, hashes, counts in common.word_hash_slices(part.column("text"), SLICE_BYTES):
                yield part.slice(i, j - i), hashes, counts


def _count_rows(batches):
    held, counts, size = [], [], 0

    def merged():
        words, at = np.unique(np.concatenate(held), return_inverse=True)
        return words, np.bincount(at, np.concatenate(counts), len(words)).astype(np.int64)

    def rows():
        words, n = merged()
        return pa.record_batch({"w": pa.array(words.view(np.int64)), "n": pa.array(n)})

    for part, hashes, _ in _texts(batches):
        words, n = np.unique(np.concatenate([hashes, np.full(part.num_rows, END, np.uint64)]), return_counts=True)
        held.append(words), counts.append(n)
        size += len(words)
        if size > 1_000_000:
            words, n = merged()
            held, counts, size = [words], [n], len(words)
            if size > 500_000:
                yield rows()
                held, counts, size = [], [], 0
    if held:
        yield rows()


def lower_codes(counts: np.ndarray) -> np.ndarray:
    """Code of the lower order of words with these counts; 0 is left for words without one."""
    return np.minimum(1 + np.floor(4 * np.log2(np.maximum(counts, 1)) + 1e-9), 255).astype(np.uint8)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Frequent:
    """The totals and the table of the most frequent words, sorted by hash."""

    def __init__(self, tokens: int, distinct: int, words: np.ndarray, counts: np.ndarray, shards: int):
        order = np.argsort(words)
        self.tokens, self.distinct, self.words, self.counts, self.shards = tokens, distinct, words[order], counts[order], shards
        self.q = np.concatenate([[1.0], 2.0 ** (np.arange(255) / 4)]) / (tokens + 1)
        self.codes = lower_codes(self.counts)
        self.heavy = self.counts > max(1, tokens // (4 * shards))

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Index in the table, or -1."""
        return _find(self.words, hashes)

    def shard(self, contexts: np.ndarray, words: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        heavy = np.append(self.heavy, False)[self.place(contexts) if at is None else at]
        spread = np.where(heavy, common.mix64(contexts ^ words), contexts)
        return (spread % np.uint64(self.shards)).astype(np.int64)


def _positions(hashes: np.ndarray, counts: np.ndarray):
    """(row, context, word) of each position of a slice.  Each row: its words and the
    end mark are contexts; the end mark and its words are predicted."""
    n = len(counts)
    row = np.repeat(np.arange(n), counts + 1)
    place = np.arange(len(hashes)) + np.repeat(np.arange(n), counts)
    contexts, words = np.full(len(row), END, np.uint64), np.full(len(row), END, np.uint64)
    contexts[place] = hashes
    words[place + 1] = hashes
    return row, contexts, words


def _key_rows(shared):
    """Task function: the distinct (shard, predicted word) of a slice for words that are
    not in the table, as one packed row per slice and bucket."""

    def rows(batches):
        top = shared.value
        for _, hashes, counts in _texts(batches):
            _, contexts, words = _positions(hashes, counts)
            other = top.place(words) < 0
            words, shard = words[other], top.shard(contexts[other], words[other])
            bucket = ((words >> np.uint64(33)) % np.uint64(top.shards)).astype(np.int64)     # as many as shards
            order = np.lexsort((words, shard, bucket))
            words, shard, bucket = words[order], shard[order], bucket[order]
            new = np.ones(len(words), bool)
            new[1:] = (np.diff(words) != 0) | (np.diff(shard) != 0)
            words, shard, bucket = words[new], shard[new], bucket[new]
            found, starts = np.unique(bucket, return_index=True)
            yield pa.record_batch({
                "bucket": pa.array(found.astype(np.int32)),
                "shards": pa.array([x.tobytes() for x in np.split(shard.astype(np.uint32), starts[1:])[: len(found)]], pa.binary()),
                "words": pa.array([x.tobytes() for x in np.split(words, starts[1:])[: len(found)]], pa.binary())})
    return rows


def _unpacked(table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_py(), kind) for x in table[name])])


def _code_rows(keys, counts):
    """The codes of a bucket's words, as one packed row per shard that wants some."""
    shard, words = _unpacked(keys, "shards", "<u4"), _unpacked(keys, "words", "<u8")
    known, n = counts["w"].to_numpy().astype(np.int64).view(np.uint64), counts["n"].to_numpy()
    order = np.argsort(known)
    at = _find(known[order], words)
    shard, words, at = shard[at >= 0], words[at >= 0], at[at >= 0]
    codes = lower_codes(n[order][at]) if len(at) else np.zeros(0, np.uint8)
    order = np.lexsort((words, shard))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(words[order]) != 0) | (np.diff(shard[order]) != 0)
    order = order[new]
    found, starts = np.unique(shard[order], return_index=True)
    split = lambda x: pa.array([y.tobytes() for y in np.split(x[order], starts[1:])[: len(found)]], pa.binary())
    return pa.table({"shard": pa.array(found.astype(np.int32)), "words": split(words), "codes": split(codes)})


def _slice_rows(shared):
    """Task function: one packed row per slice and shard.  Bit 15 of ``rows`` marks training
    texts.  Contexts come with the lengths of their runs, first those in the table as indices
    (``tops``), then the others as hashes; words likewise, ``held`` has a bit for each."""

    def rows(batches):
        top = shared.value
        for part, hashes, counts in _texts(batches):
            row, contexts, words = _positions(hashes, counts)
            mark = (row | np.where(part.column("train").to_numpy(zero_copy_only=False), 1 << 15, 0)[row]).astype(np.uint16)
            word_at, context_at = top.place(words).astype(np.int32), top.place(contexts).astype(np.int32)
            shard = top.shard(contexts, words, context_at)
            order = np.lexsort((words, contexts, 2 * shard + (context_at < 0)))
            shard, contexts, words, word_at, context_at, mark = (x[order] for x in (shard, contexts, words, word_at, context_at, mark))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(contexts) != 0) | (np.diff(shard) != 0)
            starts = np.flatnonzero(new)
            new |= (np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))) % RUN == 0
            base = int(part.column("row")[0].as_py())
            ids = part.column("doc_id")
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(order)]
            for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                starts = np.flatnonzero(new[i:j])
                lead, word = context_at[i:j][starts], word_at[i:j]
                known = ids.is_valid().to_numpy(zero_copy_only=False) if k == 0 else np.zeros(0, bool)
                yield pa.record_batch([
                    pa.array([int(shard[i])], pa.int32()), pa.array([base], pa.int64()),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (
                        lead[lead >= 0].astype(np.uint16), contexts[i:j][starts[lead < 0]], np.diff(np.append(starts, j - i)).astype(np.uint8),
                        np.packbits(word >= 0), word[word >= 0].astype(np.uint16), words[i:j][word < 0], mark[i:j],
                        ids.fill_null(0).to_numpy().astype(np.int64) if k == 0 else np.zeros(0, np.int64), known))],
                    names=["shard", "base", "tops", "contexts", "repeats", "held", "top_words", "words", "rows", "ids", "known"])
    return rows


def _pieces(table, name: str, kind: str) -> list[np.ndarray]:
    """A binary column's values where they lie, row by row."""
    return [np.frombuffer(x.as_buffer(), kind) for x in table[name]]


def trained(top: Frequent, contexts, words, lower, n) -> Trie:
    """The trie of pairs that come ``n`` times in training texts; pairs may repeat, or come 0 times."""
    seen = np.flatnonzero(n)
    n = n[seen]
    own, back = np.unique(contexts[seen], return_inverse=True)
    place = top.place(own)
    totals = np.where(place >= 0, np.append(top.counts, 0)[place], np.bincount(back, n, len(own))).astype(np.float64)
    keys, first, at = np.unique((back.astype(np.uint64) << np.uint64(32)) | words[seen], return_index=True, return_inverse=True)
    pair_context = (keys >> np.uint64(32)).astype(np.int64)
    log_p = np.log10((np.bincount(at, n, len(keys)) + MU * top.q[lower[seen][first]]) / (totals[pair_context] + MU))
    return Trie.build(own, totals, pair_context, keys & np.uint64(0xFFFFFFFF), log_p)


def _found_rows(shared):
    """Task function: builds a shard's trie and looks up its positions.  One row per slice again:
    a byte per position (the pair's code if it is ``seen``, else the word's lower order), and the
    totals of the contexts outside the table."""

    def rows(table, codes):
        top = shared.value
        tops, others = _pieces(table, "tops", "<u2"), _pieces(table, "contexts", "<u8")
        each = np.concatenate([x for t, c in zip(tops, others, strict=True) for x in (top.words[t], c)])
        marks, repeats = (np.concatenate(_pieces(table, k, t)) for k, t in (("rows", "<u2"), ("repeats", "u1")))
        sizes = [x.as_buffer().size // 2 for x in table["rows"]]
        held = np.concatenate([np.unpackbits(x, count=n) for x, n in zip(_pieces(table, "held", "u1"), sizes, strict=True)]).astype(bool)
        at, other = np.concatenate(_pieces(table, "top_words", "<u2")), np.concatenate(_pieces(table, "words", "<u8"))
        words, lower = np.empty(len(held), np.uint32), np.empty(len(held), np.uint8)
        words[held], lower[held] = (top.words >> np.uint64(32)).astype(np.uint32)[at], top.codes[at]
        own, own_codes = _unpacked(codes, "words", "<u8"), _unpacked(codes, "codes", "u1")
        order = np.argsort(own)
        words[~held], lower[~held] = other >> np.uint64(32), np.append(own_codes[order], 0)[_find(own[order], other)]
        # A slice's positions of one pair are neighbours: from here on they are one entry.
        run = np.zeros(len(words), bool)
        run[np.cumsum(repeats, dtype=np.int64) - repeats] = True
        new = run.copy()
        new[1:] |= (words[1:] != words[:-1]) | (lower[1:] != lower[:-1])
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(words)))
        contexts = each[np.cumsum(run[begin]) - 1]
        trie = trained(top, contexts, words[begin], lower[begin], np.add.reduceat(marks >> 15, begin, dtype=np.int64))
        try:
            seen, code = np.zeros(len(begin), bool), lower[begin]
            for k in range(0, len(begin), CHUNK):
                at = trie.find(contexts[k: k + CHUNK], words[begin[k: k + CHUNK]].astype(np.uint64))
                hit = np.flatnonzero(at >= 0)
                seen[k + hit], code[k + hit] = True, trie.codes[at[hit]]
            totals = np.append(trie.totals, 0)
            totals = [totals[trie.contexts.find(c)].astype("<f8") for c in others]
        finally:
            trie.close()
        ends = np.cumsum(sizes)[:-1]
        return pa.table({
            "base": table["base"], "tops": table["tops"], "totals": pa.array([x.tobytes() for x in totals], pa.binary()),
            "repeats": table["repeats"], "rows": table["rows"],
            "seen": pa.array([np.packbits(x).tobytes() for x in np.split(np.repeat(seen, times), ends)], pa.binary()),
            "codes": pa.array([x.tobytes() for x in np.split(np.repeat(code, times), ends)], pa.binary()),
            "ids": table["ids"], "known": table["known"]})
    return rows


def _slice_sums(shared):
    """Task function: the rows of one slice with their sums over all shards."""

    def rows(table):
        top = shared.value
        ids, valid = np.concatenate(_pieces(table, "ids", "<i8")), np.concatenate(_pieces(table, "known", "?"))
        codes = _pieces(table, "codes", "u1")
        total = np.concatenate([x for t, n in zip(_pieces(table, "tops", "<u2"), _pieces(table, "totals", "<f8"), strict=True) for x in (top.counts[t], n)])
        total = np.repeat(total.astype(np.float64), np.concatenate(_pieces(table, "repeats", "u1")))
        seen = np.concatenate([np.unpackbits(b, count=len(c)) for b, c in zip(_pieces(table, "seen", "u1"), codes, strict=True)]).astype(bool)
        codes, at = np.concatenate(codes), np.concatenate(_pieces(table, "rows", "<u2")) & 0x7FFF
        base = np.log10((total + 0.1) / (top.tokens + 0.1 * (top.distinct + 1)))
        score = np.where(seen, codes / -STEPS, np.log10(MU * top.q[codes] / (total + MU))) if top.tokens else np.zeros(len(at))
        add = lambda v: np.bincount(at, v, len(ids))
        return pa.table({"doc_id": pa.array(ids, mask=~valid), "n_tokens": np.bincount(at, minlength=len(ids)).astype(np.int64),
                         "n_known": add(total > 0).astype(np.int64), "base": add(base), "score": add(score)})
    return rows


def lm_score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of
    (doc_id, text, train boolean)."""
    with shuffles_dropped(spark):
        counts = common.stage_table(spark, docs.where("train").select("text").mapInArrow(_count_rows, "w long, n long")
                                    .groupBy("w").agg(F.sum("n").alias("n")), "op7-words")
    all_ = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    best = counts.orderBy(F.desc("n"), "w").limit(TOP).toPandas()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-all_["tokens"] // TOKENS_PER_SHARD))
    shared = spark.sparkContext.broadcast(Frequent(all_["tokens"], all_["distinct"], best["w"].to_numpy(np.int64).view(np.uint64),
                                                   best["n"].to_numpy(np.int64), shards))     # at most TOP words
    numbered = docs.select("doc_id", "text", "train", F.monotonically_increasing_id().alias("row"))
    slices = numbered.mapInArrow(_slice_rows(shared), SLICE_SCHEMA)
    keys = docs.select("text").mapInArrow(_key_rows(shared), KEY_SCHEMA)
    words = counts.select(F.pmod(F.shiftrightunsigned("w", 33), F.lit(shards)).cast("int").alias("bucket"), "w", "n")
    with shuffles_dropped(spark):
        codes = common.stage_table(spark, keys.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_code_rows, CODE_SCHEMA), "op7-codes")
    found = slices.groupBy("shard").cogroup(codes.groupBy("shard")).applyInArrow(_found_rows(shared), FOUND_SCHEMA)
    scores = found.groupBy("base").applyInArrow(_slice_sums(shared), SCORE_SCHEMA)
    return scores.select("doc_id", "n_tokens", "n_known", F.lit(all_["tokens"]).cast("long").alias("train_tokens"),
                         F.col("base").alias("base_score"), "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(common.table(sf_dir, "documents")).select("doc_id", "text")
    held_out = common.doc_fold(F.col("doc_id"), 10) == 0
    return lm_score(spark, docs.withColumn("train", ~held_out)).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The model is not in SQL; tests hold the base score and the model against plain versions.
QUERIES = {"op7_lm_scoring": op7_lm_scoring}
SQL: dict[str, str] = {}
