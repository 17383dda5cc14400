"""Small cases of each operator: nulls, empty and long texts, ties, repeated rows,
empty tables, clashing column names; brute force where SQL has no say."""

import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc
import types
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollcall.llm import (best_fit_packing, chat_format, common, exact_dedup, language_id, lm_scoring, ngram_join, quality_classifier,
                          quality_rules, registry, source_mixing, warc)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, __n string, keep long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, rows):
    """rows: (doc_id, text, lang, source); further columns clash with names the operators use."""
    return spark.createDataFrame([(*r, 1, "x", "y", 7) for r in rows], DOCS)


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(1, None, None, None), (2, "", "en", None), (3, " \t\n", "en", "a"), (4, "one", "en", "a"), (5, "One", "en", "b"),
           (6, "a b c d e", "de", "b"), (6, "a b c d e", "de", "b"), (None, "A b  c d e", "de", "b"), (None, "unlike any other text", "en", "a")]
    base = sentence(rng, 200).split()
    for k in range(30):                                # near copies
        words = list(base)
        words[rng.randrange(200)] = f"w{k}"
        out.append((100 + k, " ".join(words), "en", "hot"))
    for k in range(60):
        out.append((200 + k, sentence(rng, rng.choice([60, 100, 300])), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "a", "b"])))
    out.append((999, sentence(rng, 20_000), "en", "long"))
    return out


def grams(text):
    w = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("limits", [{}, {"SHARD": 500, "HOT": 20}, {"ROUNDS": 1, "HOT": 0}])
def test_ngram_join_brute_force(spark, rows, limits, monkeypatch):
    for name, value in limits.items():             # many shards; n-grams counted apart: some, all
        monkeypatch.setattr(ngram_join, name, value)
    got = collections.Counter(tuple(r) for r in ngram_join.ngram_join(spark, make(spark, rows)).select("doc_id", "n_shingles", "component_id").collect())
    sets = [grams(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = collections.defaultdict(lambda: math.inf)
    for r, g in zip(rows, group):
        least[g] = min(least[g], math.inf if r[0] is None else r[0])
    want = collections.Counter((r[0], len(s), r[0] if least[g] == math.inf or not s else least[g]) for r, g, s in zip(rows, group, sets))
    assert got == want


def test_ngram_join_null_and_repeated_ids(spark):
    rng = random.Random(12)
    text = {k: sentence(rng, 120) for k in "abcdef"}
    near = {k: f"{t} more" for k, t in text.items()}
    lone = [(None, sentence(rng, 80), None, None) for _ in range(40)]
    same = [(9, text["e"], None, None)] * 2 + [(None, text["f"], None, None)] * 3
    rows = [(None, text["a"], None, None), (None, near["a"], None, None), (7, text["b"], None, None), (7, near["b"], None, None),
            (7, text["c"], None, None), (8, near["c"], None, None), (None, text["d"], None, None), (3, near["d"], None, None),
            (4, "", None, None), (4, "", None, None), (None, None, None, None), *same, *lone]
    docs = make(spark, rows)
    want = collections.Counter((r[0], len(grams(r[1])), {text["d"]: 3, near["c"]: 7}.get(r[1], r[0])) for r in rows)
    assert collections.Counter(map(tuple, ngram_join.ngram_join(spark, docs).select("doc_id", "n_shingles", "component_id").collect())) == want
    kept = collections.Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_one(spark, docs).collect())
    assert sum(kept[None, t] for t in (text["a"], near["a"])) == 1 and sum(kept[7, t] for t in (text["b"], near["b"])) == 1
    assert kept[7, text["c"]] == 1 and kept[3, near["d"]] == 1 and (8, near["c"]) not in kept and (None, text["d"]) not in kept
    assert kept[9, text["e"]] == 1 and kept[None, text["f"]] == 1 and kept[4, ""] == 2 and kept[None, None] == 1
    assert all(kept[r[:2]] == 1 for r in lone) and sum(kept.values()) == 4 + 2 + 3 + 40


def test_ngram_join_prefixes_are_rare_first(spark):
    """Texts that share a passage of most of their words, but no rare n-grams, are no candidates."""
    rng = random.Random(3)
    passage = sentence(rng, 120)
    docs = make(spark, [(k, f"{passage} " + " ".join(f"own{k}x{i}" for i in range(60)), "en", "a") for k in range(40)])
    texts = docs.select(ngram_join.row_key().alias("row"), "doc_id", "text")
    facts = texts.mapInArrow(ngram_join._fact_rows, ngram_join.FACTS_SCHEMA)
    classes = facts.where("bucket IS NULL").select("doc_id", "n_shingles", "cls", "row")
    sets = ngram_join.shared_sets(texts, facts, classes).collect()
    assert len(sets) == 40 and all((r["n"], len(r["grams"])) == (176, 116) for r in sets)
    prefixes = ngram_join.shared_sets(texts, facts, classes).mapInArrow(ngram_join._prefix_rows, ngram_join.PREFIX_SCHEMA)
    assert prefixes.count() == 0


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    assert dict(map(tuple, ngram_join.components(spark, edges, "t").collect())) == {**{i: 0 for i in range(41)}, 100: 90, 90: 90}


def test_exact_dedup_cases(spark, rows):
    docs = make(spark, rows)
    got = exact_dedup.exact_dedup(spark, docs, exact_dedup.older_half(docs["doc_id"])).collect()
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    size = collections.Counter(normal)
    least = {}
    for r, t in zip(rows, normal):
        if r[0] is not None:
            least[t] = min(least.get(t, r[0]), r[0])
    want = collections.Counter((r[0], least.get(t), size[t], r[0] == least.get(t), hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, normal))
    assert collections.Counter(tuple(r) for r in got) == want


def test_minimal_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    sizes, bits = exact_dedup.build_mphf(keys[:4000])
    assert sorted(exact_dedup.mphf_slots(keys[:4000], sizes, bits)) == list(range(4000))


def test_quality_rules_cases(spark, rows):
    got = quality_rules.quality_rules(spark, make(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    kept = quality_rules.keep_good(spark, make(spark, rows))
    assert kept.columns == make(spark, rows).columns and kept.count() == sum(r["kept"] for r in got) > 50


def test_quality_rules_follow_the_data(spark):
    """A signal that is common in one source is an outlier in another."""
    rng = random.Random(14)
    rows = [(k, f"{sentence(rng, 100)} {'# ' * rng.randrange(30, 50)}", "en", "code") for k in range(300)]
    rows += [(1000 + k, sentence(rng, 100), "en", "prose") for k in range(300)]
    rows += [(2000, f"{sentence(rng, 100)} {'# ' * 40}", "en", "prose"), (2001, f"{sentence(rng, 100)} {'# ' * 40}", "en", "code")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark, make(spark, rows)).collect()}
    assert all(got[k]["kept"] for k in got if k != 2000) and not got[2000]["kept"]
    assert {r["symbol_rate_high"] for r in got.values() if r["source"] == "prose"} == {0.0}
    assert min(r["symbol_rate_high"] for r in got.values() if r["source"] == "code") > 0.3


def test_quality_rules_limits_differ_by_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "source", "text")
    scored = common.stage_table(spark, quality_rules.with_signals(docs).drop("text"), "test-signals")
    limits = quality_rules.thresholds(scored).toPandas()
    assert min(limits[f"{s}_high"].nunique() for s in ("word_length", "dup_line_rate", "repeat_rate")) >= 3


def test_quality_rules_sketch_of_a_large_group(spark):
    n = 150_000
    scored = spark.range(n).select(F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(False).alias("base_failed"),
                                   *[(F.pmod(F.col("id") * 77_773, F.lit(n)) / n).alias(s) for s in quality_rules.SIGNALS])
    (limit,) = quality_rules.thresholds(scored.repartition(16)).collect()
    for s, (_, outer, _, _) in quality_rules.SIGNALS.items():
        assert limit[f"{s}_high"] == pytest.approx(outer + 4 * (outer - 0.5), abs=9 * 0.002), s


def test_mixing_targets_and_bounds(spark, rows):
    got = [r.asDict() for r in source_mixing.mix(spark, make(spark, rows)).collect()]
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, left = {}, 1.5 * sum(size.values())
    while True:                                        # the plain loop of the contract
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            capped[s] = 2 * size[s]
        left = 1.5 * sum(size.values()) - sum(capped.values())
    target = capped | share
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * max((len(WORD.findall(r[1] or "")) for r in rows if r[3] == s), default=0)
    again = source_mixing.mix(spark, make(spark, rows)).collect()
    assert sorted(map(str, again)) == sorted(str(x) for x in source_mixing.mix(spark, make(spark, rows[::-1])).collect())


def plain_pack(sizes, sources, clusters, capacity, most):
    bins = []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= size and not (size and c in b[2]) and (s in b[1] or len(b[1]) < most)]
        if fits:
            b = bins[min(fits)[1]]
        else:
            bins.append(b := [capacity, set(), set()])
        b[0] -= size
        b[1].add(s)
        if size:
            b[2].add(c)
        yield next(k for k, x in enumerate(bins) if x is b)


def test_packing_is_tightest_fit():
    rng = np.random.default_rng(3)
    sizes, sources, clusters = np.sort(rng.integers(0, 90, 400))[::-1], rng.integers(0, 6, 400), rng.integers(0, 60, 400)
    got = best_fit_packing.pack(sizes, sources, clusters, 100, 2)
    assert got == list(plain_pack(sizes.tolist(), sources.tolist(), clusters.tolist(), 100, 2))


def test_packing_many_sources():
    rng = np.random.default_rng(6)
    sizes, sources, clusters = np.sort(rng.integers(0, 30, 3000))[::-1], rng.integers(-2**63, 2**63, 1000)[rng.integers(0, 1000, 3000)], rng.integers(0, 9000, 3000)
    got = best_fit_packing.pack(sizes, sources, clusters, 400, 8)
    held = collections.defaultdict(set)
    for b, s in zip(got, sources.tolist()):
        held[b].add(s)
    assert max(map(len, held.values())) == 8
    assert got == list(plain_pack(sizes.tolist(), sources.tolist(), clusters.tolist(), 400, 8))


def test_packing_without_words_or_ids(spark):
    top = 2**63 - 1
    docs = make(spark, [(k, None, None, "a") for k in range(300)] + [(None, "x", "en", "a"), (top, "x", "en", "a"), (None, "x", "en", "a")])
    got = best_fit_packing.best_fit_packing(spark, docs, 5).collect()
    assert len(got) == 303 and len({r["bin_id"] for r in got}) == 3
    assert collections.Counter(r["doc_id"] for r in got if r["size"]) == {None: 2, top: 1}


def test_packing_whole(spark, rows):
    got = best_fit_packing.best_fit_packing(spark, make(spark, rows), 500).collect()
    words = collections.Counter()
    for r in got:
        words[r["doc_id"]] += r["size"]
        assert r["bin_size"] <= 500
    want = collections.Counter()
    for r in rows:
        want[r[0]] += len(WORD.findall(r[1] or ""))
    assert words == want and {r["doc_id"] for r in got} == {r[0] for r in rows}


def test_chat_tree_and_round_trip(spark):
    odd = "x<|im_end|>\n<|im_start|>assistant <\\| <\\\\| \\ <"
    rows = [(1, 1, None, "user", odd, 1.0), (1, 2, 1, "assistant", "short", 1.0), (1, 3, 1, "assistant", odd, 1.0), (1, 4, 3, "a\\n\nb<|", None, 5.0),
            (2, 9, 77, "assistant", None, 0.0), (None, 1, None, None, "é\U0001F600", 0.0)]
    messages = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    out = chat_format.chat_format(spark, messages)
    got = {r["tree_id"]: r for r in out.select("tree_id", "leaf", "formatted", "loss_spans", chat_format.read_turns(out["formatted"]).alias("turns")).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", odd), ("assistant", odd), ("a\\n\nb<|", "")] and got[1]["leaf"] == 4
    (span,) = got[1]["loss_spans"]
    part = got[1]["formatted"][span["start"]: span["start"] + span["length"]]
    assert re.sub(r"<\\(\\*)\|", r"<\1|", part) == odd
    assert [tuple(t) for t in got[2]["turns"]] == [("assistant", "")] and [tuple(t) for t in got[None]["turns"]] == [("", "é\U0001F600")]
    assert chat_format.chat_format(spark, messages, 2).count() == 4


def test_chat_circles_and_outermost_trees(spark):
    low = -(2**63)
    rows = [(low, 1, None, "user", "a", 1.0), (low, 2, 1, "assistant", "b", 1.0), (None, 1, None, "user", "c", 1.0),
            (7, 5, 9, "user", "five", 1.0), (7, 9, 6, "user", "nine", 1.0), (7, 6, 5, "assistant", "six", 1.0), (7, 3, 9, "assistant", "three", 1.0),
            (8, 4, 4, "user", "self", 1.0)]
    out = chat_format.chat_format(spark, spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double"), 9)
    got = collections.Counter((r["tree_id"], r["leaf"], "".join(t["text"] + " " for t in r["turns"]))
                              for r in out.select("tree_id", "leaf", chat_format.read_turns(out["formatted"]).alias("turns")).collect())
    assert got == {(low, 2, "a b "): 1, (None, 1, "c "): 1, (7, 3, "five six nine three "): 1, (8, 4, "self "): 1}
    assert chat_format.chat_format(spark, out.sparkSession.createDataFrame([], "tree_id long, msg_id long, parent_id long, role string, text string, score double")).count() == 0


def test_language_profiles(spark):
    rng = random.Random(2)
    vocabulary = {"aa": ["the", "house", "with", "three"], "bb": ["und", "zwei", "Haus", "mit"]}
    rows = [(i, " ".join(rng.choices(vocabulary[k], k=30)), k, None) for i, k in enumerate(["aa", "bb"] * 20)]
    model = language_id.learn(make(spark, rows))
    test = [(100, "THE HOUSE", None, None), (101, "zwei und", "aa", None), (102, None, "aa", None), (103, "12 ?!", "aa", None), (104, "", None, None)]
    got = {r[0]: (r[1], r[2]) for r in language_id.identify(spark, make(spark, test), model).collect()}
    assert [got[k][0] for k in range(100, 105)] == ["aa", "bb", "und", "und", "und"]
    assert all(0 <= s <= 1 for _, s in got.values())
    plain = collections.Counter()
    padded = " the house "
    for n in (1, 2, 3):
        for k in range(len(padded) - n + 1):
            g = padded[k:k + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                plain[g] += 1
    assert sorted(language_id.gram_counts("The, house")[1].tolist()) == sorted(plain.values())


@pytest.mark.parametrize("block", [1000, 2, 1])
def test_language_id_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng = random.Random(16)
    docs = rows + rows[:7] + [(3000 + k, " ".join("".join(rng.choices("abcdeéß", k=rng.randrange(1, 9))) for _ in range(40)), lang, None)
                              for k, lang in enumerate(["fr", "it", "nl", "pl", None] * 4)] + [(4000, "xyz " * 200_000, "xx", None)]
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang, _ in docs:
        if text is not None and lang is not None:
            for g, n in zip(*(x.tolist() for x in language_id.gram_counts(text))):
                counts[lang][g] += n
    first = lambda c: {g: k for k, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[:language_id.PROFILE])}
    profiles = {lang: first(c) for lang, c in counts.items()}
    made = make(spark, docs)
    learned = language_id.learn(made)
    assert {(r["lang"], r["gram"], r["rank"]) for r in learned.collect()} == {(x, g, k) for x, p in profiles.items() for g, k in p.items()}
    assert "WindowGroupLimit" in learned._jdf.queryExecution().executedPlan().toString()
    want = collections.Counter()
    for doc_id, text, _, _ in docs:
        own = first(collections.Counter(dict(zip(*(x.tolist() for x in language_id.gram_counts(text or ""))))))
        far = lambda p: sum(abs(p[g] - k) if g in p else language_id.PROFILE for g, k in own.items())
        best = min((far(p), lang) for lang, p in profiles.items()) if own else None
        want[doc_id, *((best[1], round(1 - best[0] / (language_id.PROFILE * len(own)), 9)) if best else ("und", 0.0))] += 1
    got = collections.Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(spark, made, learned).collect())
    assert got == want


def test_elias_fano():
    rng = np.random.default_rng(4)
    for values in (np.array([], np.uint64), np.array([0, 5, 2**64 - 1], np.uint64), np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)),
                   np.arange(900, dtype=np.uint64)):
        code = lm_scoring.Monotone.of(values)
        assert code.find(values).tolist() == list(range(len(values)))
        other = np.setdiff1d(rng.integers(0, 2**63, 500).astype(np.uint64), values)
        assert (code.find(other) == -1).all()


def test_lm_scores(spark, rows):
    docs = make(spark, rows)
    got = lm_scoring.lm_score(spark, docs.withColumn("train", docs["doc_id"].isNull() | (docs["doc_id"] % 3 != 0))).collect()
    texts = {r[0]: [w.lower() for w in WORD.findall(r[1] or "")] + ["\n"] for r in rows}
    train = [[w.lower() for w in WORD.findall(r[1] or "")] + ["\n"] for r in rows if r[0] is None or r[0] % 3]
    c = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(t, ["\n", *t[:-1]]))
    n, v = sum(c.values()), len(c)
    q = lambda w: 2 ** (math.floor(4 * math.log2(c[w]) + 1e-9) / 4) / (n + 1) if c[w] else 1 / (n + 1)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        t = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        plain = sum(math.log10((pairs[p, w] + 20 * q(w)) / (c[p] + 20)) for p, w in zip(t, ["\n", *t[:-1]]))
        assert plain - len(t) / 32 - 1e-6 <= r["score"] <= plain + 1e-6


def test_lm_scores_words_beyond_the_table(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(200)), None, None) for i in range(60)]
    docs = make(spark, rows)
    docs = docs.withColumn("train", docs["doc_id"] % 3 != 0)
    whole = {r["doc_id"]: r for r in lm_scoring.lm_score(spark, docs).collect()}
    monkeypatch.setattr(lm_scoring, "TOP", 5)          # most words now lie outside the table
    got = {r["doc_id"]: r for r in lm_scoring.lm_score(spark, docs).collect()}
    assert got.keys() == whole.keys()
    for k, r in got.items():
        assert r["n_known"] == whole[k]["n_known"] and r["base_score"] == pytest.approx(whole[k]["base_score"])
        assert r["score"] == pytest.approx(whole[k]["score"], abs=1e-9)


def test_lm_common_pair_costs_little_memory():
    """All positions of one pair meet in a shard; the shard's task holds them as one pair per slice."""
    texts = ["the " * n for n in (200_000, 255, 256, 0, 1)] + ["the other the", None, "the cat"]
    train = [True] * 6 + [False] * 2
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string()), "train": pa.array(train), "row": pa.array(range(len(texts)))})
    counts = pa.Table.from_batches(lm_scoring._count_rows([batch.slice(0, 6)])).to_pydict()
    words, n = np.array(counts["w"], np.int64).view(np.uint64), np.array(counts["n"])
    top = lm_scoring.Frequent(int(n.sum()), len(n), words[n > 1], n[n > 1], 3)      # "other" and "cat" lie outside the table
    shared = types.SimpleNamespace(value=top)
    slices = pa.Table.from_batches(lm_scoring._slice_rows(shared)([batch]))
    keys = pa.Table.from_batches(lm_scoring._key_rows(shared)([batch]))
    codes = lm_scoring._code_rows(keys, pa.table(counts))
    found = []
    for k in sorted(set(slices["shard"].to_pylist())):
        mine, own = (t.filter(pc.equal(t["shard"], k)).combine_chunks() for t in (slices, codes))
        tracemalloc.start()
        found.append(lm_scoring._found_rows(shared)(mine, own))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        positions = sum(len(x.as_py()) for x in mine["rows"]) // 2
        assert peak < 1_000_000 + 32 * positions
    got = lm_scoring._slice_sums(shared)(pa.concat_tables(found)).to_pydict()
    own = [[*(t or "").split(), "\n"] for t in texts]
    c = collections.Counter(w for t, use in zip(own, train) for w in t if use)
    pairs = collections.Counter(p for t, use in zip(own, train) for p in zip(t, ["\n", *t[:-1]]) if use)
    total = sum(c.values())
    q = lambda w: 2 ** (math.floor(4 * math.log2(c[w]) + 1e-9) / 4) / (total + 1) if c[w] else 1 / (total + 1)
    assert got["doc_id"] == list(range(len(texts)))
    for k, t in enumerate(own):
        assert (got["n_tokens"][k], got["n_known"][k]) == (len(t), sum(c[w] > 0 for w in t))
        assert got["base"][k] == pytest.approx(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in t))
        plain = sum(math.log10((pairs[p, w] + 20 * q(w)) / (c[p] + 20)) for p, w in zip(t, ["\n", *t[:-1]]))
        assert plain - len(t) / 32 - 1e-6 <= got["score"][k] <= plain + 1e-6


def test_warc_round_trip(spark):
    big = "é" * 600
    pages = [(1, "http://a/ b\n", big), (2, None, big), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (None, "u", big), (2, "again", big)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    got = warc.read_archives(warc.normalise_archives(spark, warc.write_archives(spark, df))).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got) == sorted([
        ("1", "revisit", "2"), ("2", "response", "None"), ("3", "response", "None"), ("4", "response", "None"), ("5", "response", "None"),
        ("None", "response", "None"), ("2", "response", "None")])
    assert {r["payload_bytes"] for r in got if r["page_id"] == 1} == {1200}
    archives = warc.write_archives(spark, df).collect()
    heads = [h for a in archives for h, _ in warc.records(bytes(a["content"]))]
    assert len({h["warc-record-id"] for h in heads}) == len(pages)
    assert all({"warc-type", "warc-record-id", "warc-date", "content-length"} <= h.keys() for h in heads)
    assert all(h.keys() >= {"warc-profile", "warc-refers-to"} and h["warc-refers-to"] in {x["warc-record-id"] for x in heads}
               for h in heads if h["warc-type"] == "revisit")
    assert warc.write_archives(spark, df.limit(0)).count() == 0
    long = warc.record(1, 0, "u", b"a" * 5_000_000, hashlib.sha1(b"a" * 5_000_000).hexdigest(), None)
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = packed.compress(long + long) + packed.flush()
    out, index = warc.normalise(whole)
    assert warc.normalise(out) == (out, index) and len(index) == 2
    with pytest.raises(ValueError):
        warc.normalise(whole[:-20])


def test_warc_outermost_page_ids(spark):
    top, low = 2**63 - 1, -(2**63)
    df = spark.createDataFrame([(top, "u", "a" * 1000), (low, "u", "a" * 1000), (low, "u", "b" * 1000), (low, "u", "b" * 1000), (-5, "u", "c" * 1000), (-7, "u", "c" * 1000)],
                               "page_id long, url string, html string")
    got = warc.read_archives(warc.normalise_archives(spark, warc.write_archives(spark, df))).collect()
    assert collections.Counter((r["page_id"], r["refers_to"]) for r in got) == {(top, None): 1, (low, top): 1, (low, None): 2, (-5, None): 1, (-7, -5): 1}


def test_warc_of_others():
    """Versions, header spelling and digests that other writers use."""
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<html>"
    ours = base64.b32encode(hashlib.sha1(b"<html>").digest()).decode()
    one = (b"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID:\t<urn:uuid:1>\r\nContent-length:%d\r\nWARC-Target-URI: http://a/\r\n  b\r\n"
           b"WARC-Payload-Digest: sha1:%s\r\n\r\n%s\r\n\r\n" % (len(body), ours.encode(), body))
    two = b"WARC/1.1\r\nWARC-Type:   warcinfo\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    out, index = warc.normalise(gz.compress(one + two) + gz.flush())
    read = [warc.read_member(out[x["offset"]: x["offset"] + x["length"]]) for x in index]
    assert [(x["record_id"], x["record_type"]) for x in index] == [("<urn:uuid:1>", "response"), ("<urn:uuid:2>", "warcinfo")]
    assert (read[0]["page_id"], read[0]["payload"], read[0]["url"], read[0]["payload_digest"]) == (None, body, "http://a/ b", hashlib.sha1(b"<html>").hexdigest())
    assert (read[1]["payload"], read[1]["payload_bytes"], read[1]["refers_to"]) == (b"", 0, None)
    with pytest.raises(ValueError):
        warc.headers(b"HTTP/1.1 200 OK")


def test_classifier(spark):
    rng = random.Random(9)
    good = [sentence(rng, 80) for _ in range(120)]
    bad = [" ".join(rng.choice(["WIN!!", "$$$", "BUY", "CLICK!!"]) for _ in range(80)) for _ in range(120)]
    labelled = [(k, t, 1) for k, t in enumerate(good[:100])] + [(k, t, 0) for k, t in enumerate(bad[:100])]
    labelled += labelled[:3] + [(500, None, 1), (501, "", 0)]
    train = lambda rows: quality_classifier.train(spark, spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    model = train(labelled)
    assert train([]) is None and train(labelled[:100]) is None and train(labelled[:1] + labelled[100:101]) is not None
    rows = [(i, t, None, None) for i, t in enumerate(good[100:] + bad[100:] + [None, ""])]
    got = {r[0]: r[1] for r in quality_classifier.classify(spark, make(spark, rows), model).collect()}
    assert min(got[i] for i in range(20)) > 0.7 > max(got[i] for i in range(20, 40)) and got[40] == got[41]
    assert {r[1] for r in quality_classifier.classify(spark, make(spark, rows), None).collect()} == {0.5}
    assert quality_classifier.classify(spark, make(spark, []), model).count() == 0
    plain = [1 / (1 + math.exp(-(model.slope * model.signal(r[1]) + model.offset))) for r in rows]
    assert [got[r[0]] for r in rows] == pytest.approx(plain)


def test_classifier_takes_whole_texts(spark):
    """What tells the labels apart comes late in long texts, beyond any prefix."""
    rng = random.Random(10)
    own = [["".join(rng.choices("abcdefghij", k=10)) for _ in range(600)] for _ in (0, 1)]
    rows = [(2 * k + q, f"{sentence(rng, 3000)} {' '.join(rng.choices(own[q], k=900))}", q) for k in range(40) for q in (0, 1)]
    model = quality_classifier.train(spark, spark.createDataFrame(rows[:60], "doc_id long, text string, quality int"))
    found = [[sum(w.encode() in d for w in own[q]) for d in (model.bad, model.good)] for q in (0, 1)]
    assert found[0][0] > 100 and found[0][1] == 0 and found[1][1] > 100 and found[1][0] == 0
    docs = make(spark, [(k, t, None, None) for k, t, _ in rows[60:]])
    got = dict(map(tuple, quality_classifier.classify(spark, docs, model).collect()))
    assert all((got[k] > 0.5) == (q == 1) for k, _, q in rows[60:])


def test_empty_tables(spark):
    none = make(spark, [])
    assert ngram_join.ngram_join(spark, none).count() == 0
    assert exact_dedup.exact_dedup(spark, none, none["keep"] > 0).count() == 0
    assert quality_rules.quality_rules(spark, none).count() == 0
    assert source_mixing.mix(spark, none).count() == 0
    assert best_fit_packing.best_fit_packing(spark, none).count() == 0
    assert language_id.identify(spark, none, language_id.learn(none)).count() == 0
    assert lm_scoring.lm_score(spark, none.withColumn("train", none["keep"] > 0)).count() == 0


def test_pipeline_keeps_columns_and_words(spark, rows):
    docs = make(spark, rows + [(i, f"{sentence(random.Random(i), 120)}", "en", "c") for i in range(2000, 2300)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, "")
        assert docs.columns == before, name
    assert docs.count() > 300
    assert len({r["doc_id"] for r in docs.where("doc_id BETWEEN 100 AND 129").collect()}) <= 1


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cols = sorted(got.columns)
    want = con.execute(registry.oracle_sql()[name]).df()
    key = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()), key=str)
    assert key(got) == key(want)


@pytest.mark.parametrize("n,universe", [(200_000, 64), (200_000, 50), (300_000, 40), (1, 64), (5, 3), (60_000, 17)])
def test_elias_fano_is_compact_and_exact(n, universe):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, 2**universe - 1, n, dtype=np.uint64, endpoint=True))
    code = lm_scoring.Monotone.of(values)
    assert n < 1000 or code.nbytes < 8 * len(values)
    ask = np.concatenate([values, values + np.uint64(1), rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64, endpoint=True), np.array([0, 2**64 - 1], np.uint64)])
    place = np.minimum(np.searchsorted(values, ask), len(values) - 1)
    assert np.array_equal(code.find(ask), np.where(values[place] == ask, place, -1))


def test_elias_fano_of_runs():
    """Long runs of ones and of zeros in the high part."""
    values = np.concatenate([np.arange(5000, dtype=np.uint64), np.uint64(1 << 40) + np.arange(3000, dtype=np.uint64) * np.uint64(3), np.array([2**63], np.uint64)])
    code = lm_scoring.Monotone.of(values)
    assert np.array_equal(code.find(values), np.arange(len(values)))
    assert (code.find(np.array([5000, 7000, (1 << 40) + 1, 2**63 - 1, 2**63 + 1], np.uint64)) == -1).all()


def test_exact_dedup_of_the_outermost_ids(spark):
    """The largest and the smallest id are ids like others; null ids come after both."""
    top, low = 2**63 - 1, -(2**63)
    ids = [(top, "only"), (None, "only null"), (top, "a b"), (None, "a  b"), (low, "c"), (top, "c"), (None, "d"), (None, "d"), (top, "e"), (3, "e")]
    docs = make(spark, [(i, t, "en", "a") for i, t in ids])
    for historical in (F.lit(False), F.lit(True), exact_dedup.older_half(F.col("doc_id")), F.col("doc_id").isNull()):
        got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, docs, historical).collect())
        assert got == collections.Counter([(top, top, 1, True), (None, None, 1, True), (top, top, 2, True), (None, top, 2, False), (low, low, 2, True),
                                           (top, low, 2, False), (None, None, 2, True), (None, None, 2, True), (top, 3, 2, False), (3, 3, 2, True)])
    assert sorted(r.text for r in exact_dedup.keep_first(spark, docs).collect()) == ["a b", "c", "d", "e", "only", "only null"]
