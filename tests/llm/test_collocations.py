"""Collocations against a plain count of all n-grams."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rollcall.llm import collocations as c

DOCS = "doc_id long, text string, lang string, n long, phrase string, w string, last int"


def make(spark, rows):
    return spark.createDataFrame([(k, t, x, 1, "p", "w", 2) for k, (t, x) in enumerate(rows)], DOCS)


def plain(rows, least, best):
    total, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i: i + n])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = set()
    for (lang, w), a in candidates.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                if a >= f[lang, w[i: i + n]]:
                    inside.add((lang, w[i: i + n]))
    out = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in inside:
            score, _, l, r = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items()
                  for k, (s, a, p, l, r) in enumerate(sorted(found)[:best]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocabulary = ["a", "B", "the", "Der", "né", "naïve", "x\xa0y", "--", "(of)", "漢字", "\x1cq", "it's", " z"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "; ", "?!"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(n))
    passage = text(300)
    out = [(None, None), ("", "en"), (" \t\n.", "en"), ("one", None), (None, "en"), ("a b " * 40, "und"), ("a b " * 30, None), ("z " * 4000, "fr"), ("z " * 4000, "fr")]
    out += [(text(rng.randrange(1, 200)), rng.choice(["en", "en", "de", None])) for _ in range(60)]
    out += [(text(rng.randrange(0, 60)) + passage + text(rng.randrange(0, 60)), "en") for _ in range(30)]
    out += [(passage, "de")] * 25 + [(text(20_000), "en")]
    return out


@pytest.mark.parametrize("least,best", [(3, 2000), (8, 50)])
def test_like_a_plain_count(spark, rows, least, best):
    got = c.collocations(spark, make(spark, rows).repartition(6), least, best)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, best)


def test_full_bit_tables_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(c, "LEAST_BITS", 64)
    monkeypatch.setattr(c, "MOST_BITS", 64)
    assert sorted(map(tuple, c.collocations(spark, make(spark, rows[:40]), 4).collect())) == plain(rows[:40], 4, c.BEST)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("a b c", "en")]])
def test_nothing_frequent(spark, rows):
    assert c.collocations(spark, make(spark, rows)).collect() == []


def test_large_products(spark):
    big = 10**12
    row = spark.sql(f"select cast(cast(1000 as decimal(4,0)) * cast({big}L as decimal(15,0)) * cast({big}L as decimal(16,0)) as decimal(38,0)) div "
                    f"cast(cast({10**7}L as decimal(19,0)) * cast({10**9}L as decimal(19,0)) as decimal(38,0)) as s").first()
    assert row.s == 1000 * big * big // 10**16


def test_every_word_is_owned_once(rows):
    texts = [t for t, _ in rows]
    batch = pa.record_batch([pa.array(texts, pa.string()), pa.array(["x"] * len(texts))], names=["text", "lang"])
    got = pa.Table.from_batches(c._chunk_rows([batch]))
    want = sum(len(re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", t or "")) for t in texts)
    assert int(np.dot(got["own"].to_numpy(), got["n"].to_numpy())) == want
    assert got.num_rows < got["n"].to_numpy().sum()


def test_slices_of_a_task_are_added_up(rows, monkeypatch):
    """A phrase met in several slices is sent once, however the texts are sliced."""
    monkeypatch.setattr(c, "SLICE_BYTES", 256)
    monkeypatch.setattr(c, "PHRASES", 10**9)
    small = rows[:60]
    chunks = pa.Table.from_batches(c._chunk_rows([pa.record_batch([pa.array([t for t, _ in small], pa.string()), pa.array([x or "und" for _, x in small])], names=["text", "lang"])]))
    monkeypatch.setattr(c, "SLICE_BYTES", 1 << 12)
    everything = type("Bits", (), {"value": np.full(8, 255, np.uint8)})
    got = pa.Table.from_batches(c._phrase_rows({n: everything for n in range(1, c.LONGEST)})(chunks.combine_chunks().to_batches())).to_pylist()
    want = collections.Counter()
    for text, lang in small:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({k: k + 32 for k in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    want[lang or "und", " ".join(w[i: i + n])] += 1
    blocks = collections.Counter((r["lang"], r["phrase"]) for r in got)
    total = collections.Counter()
    for r in got:
        total[r["lang"], r["phrase"]] += r["n"]
    assert total == want
    texts = sum(len(t or "") for t in chunks["text"].to_pylist())
    assert texts > 4 * (1 << 12) and max(blocks.values()) <= -(-texts // (16 * (1 << 12))) + 1
