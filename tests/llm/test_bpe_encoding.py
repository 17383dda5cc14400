"""BPE encoding by shared chunks against encoding every text whole."""

import collections
import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from rollcall.llm import bpe_encoding as bpe

DOCS = "doc_id long, text string, key string, d int, pos int, n_tokens int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def whole(tokenizer, doc_id, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))


def held(spark, tokenizer, rows, parts=5):
    got = bpe.bpe_encode(spark, make(spark, rows).repartition(parts), bpe.vocabulary()).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(whole(tokenizer, *r) for r in rows)


ODD = ["don't", "WE'LL", "é", "é", "́x", "naïve", "12345", "a1b2", "<|endoftext|>", "<|startoftext|>x", "<|endof", "…!?", "漢字かな", " ", " ",
       "ẞ", "İ", "ǅ", "가", "😀👍🏽", "\x1c", "\x00", "\t\t", "\r\n", "  ", "\n\n", "''s", "’s", "q̣̇", "̈́", " ", "\x85", "-" * 40]


def odd_text(rng, n):
    return "".join(rng.choice(ODD) + rng.choice(["", " ", "\n", " ", "\t", "　"]) for _ in range(n))


def test_like_whole_texts(spark, tokenizer):
    rng = random.Random(2)
    passages = [odd_text(rng, 400) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (None, "no id"), (5, "twice"), (5, "twice"), (None, None)]
    rows += [(100 + k, odd_text(rng, rng.randrange(1, 300))) for k in range(60)]
    for k in range(60):         # passages shared at any place, also glued to what stands before and behind
        rows.append((200 + k, odd_text(rng, rng.randrange(0, 150)) + rng.choice(["", "x", " "]) + rng.choice(passages) + rng.choice(["", "'s", "́", "z"]) + odd_text(rng, rng.randrange(0, 80))))
    rows += [(300 + k, passages[0]) for k in range(40)]                             # exact copies
    held(spark, tokenizer, rows)


def test_long_texts_without_gaps(spark, tokenizer):
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdeé'1漢") for _ in range(12_000))
    rows = [(1, letters), (2, "x" + letters + " end"), (3, "start " + letters), (4, "a" * 30_000), (5, "a" * 30_000 + " b"), (6, " " * 20_000), (7, "é" * 9_000),
            (8, "á" * 6_000), (9, odd_text(rng, 40_000))]
    held(spark, tokenizer, rows, 3)


def test_all_chunks_pass_for_shared(spark, tokenizer, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(bpe, "_maybe", lambda table, d: True)
    held(spark, tokenizer, [(k, odd_text(rng, 300)) for k in range(20)])


def test_registered_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = bpe.op13_bpe_encoding(spark, sf).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(whole(tokenizer, *r) for r in rows)


def test_empty_table(spark):
    assert bpe.bpe_encode(spark, make(spark, []), bpe.vocabulary()).collect() == []


def test_chunks_follow_content():
    rng = random.Random(5)
    passage = "".join(rng.choice("abc déf漢 ") for _ in range(20_000))
    for text in (passage, "", "short", "aaaa" * 9000, "漢" * 9000):
        assert "".join(c.decode() for c in bpe.chunks(text)) == text
        assert all(len(c) <= bpe.MOST for c in bpe.chunks(text)) and all(len(c) >= bpe.LEAST for c in bpe.chunks(text)[:-1])
    one, two = (set(bpe.chunks(head + passage)) for head in ("first head ", "another and longer head, not the same "))
    assert len(one & two) > 0.8 * len(one)


def test_shared_chunks_are_encoded_once(spark, monkeypatch):
    rng = random.Random(6)
    passage = odd_text(rng, 2000)
    df = make(spark, [(k, f"{k} " + passage) for k in range(30)])
    texts = df.select("text").withColumn("key", bpe.text_key())
    table = bpe.shared_bits(spark, texts.select("key", "text"))
    chunks = bpe.chunks("1 " + passage)
    assert sum(bpe._maybe(table, bpe.digest(c)) for c in chunks) >= 0.8 * len(chunks)
    assert np.unpackbits(table).sum() <= 2 * len(chunks)
