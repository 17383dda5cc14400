"""Which n-gram sets are kept for checking links."""

from rollcall.llm import common, ngram_join

DOCS = "doc_id long, text string"


def test_sets_that_cannot_link_are_not_kept(spark, monkeypatch):
    """All sets are shuffled whenever links are checked: those without a prefix stay out."""
    words = lambda k, a, b: " ".join(f"{k}x{i}" for i in range(a, b))
    near = [(1, words("s", 0, 104)), (2, words("s", 0, 104) + " z"), (3, words("s", 0, 103) + " z y")]
    half = [(10 + k, words("p", 0, 54) + " " + words(f"own{k}", 0, 50)) for k in range(20)]
    docs = spark.createDataFrame([*near, *half, (50, None)], DOCS)
    kept = {}
    stage = common.stage_table

    def seen(spark, df, name, *more):
        out = stage(spark, df, name, *more)
        kept.setdefault(name, out)
        return out

    monkeypatch.setattr(common, "stage_table", seen)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(spark, docs).collect()}
    assert got == {1: (100, 1), 2: (101, 1), 3: (101, 1), **{10 + k: (100, 10 + k) for k in range(20)}, 50: (0, 50)}
    assert kept["op2-sets"].count() == 3


def test_the_least_share_that_links_is_kept(spark):
    sets = spark.createDataFrame([(n, n, 0.0, list(range(g))) for n in range(1, 60) for g in range(1, n + 1)], "cls long, n int, place double, grams array<long>")
    live = {(r["n"], len(r["grams"])) for r in ngram_join.linkable(sets).collect()}
    assert live == {(n, g) for n in range(1, 60) for g in range(1, n + 1) if ngram_join.prefix_length(n) - (n - g) > 0}


def test_most_ngrams_of_sets_that_cannot_link_are_not_shuffled(spark, monkeypatch):
    """All n-grams at once take twice the texts' room: once a fifth of a set is known to be its own, the rest stays."""
    words = lambda k, a, b: " ".join(f"{k}x{i}" for i in range(a, b))
    near = [(1, words("s", 0, 204)), (2, words("s", 0, 204) + " z")]
    docs = spark.createDataFrame([*near, *[(10 + k, words(f"own{k}", 0, 504)) for k in range(40)], (60, ""), (None, None)], DOCS)
    dealt = []
    plain = type(docs).mapInArrow

    def seen(self, func, schema, *more, **named):
        out = plain(self, func, schema, *more, **named)
        if "shard" in str(schema):
            dealt.append(out)
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", seen)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(spark, docs).collect()}
    assert got == {1: (200, 1), 2: (201, 1), **{10 + k: (500, 10 + k) for k in range(40)}, 60: (0, 60), None: (0, None)}
    n = sum(r["n"] for out in dealt for r in out.selectExpr("length(grams) / 8 AS n").collect())
    assert 401 <= n < 0.4 * (401 + 40 * 500)


def test_sets_at_the_least_similarity_link(spark):
    """Pairs with 80 of 100 n-grams in common, and with 79."""
    words = lambda k, a, b: " ".join(f"{k}x{i}" for i in range(a, b))
    rows = []
    for k in range(30):
        rows += [(100 * k, words(k, 0, 104)), (100 * k + 1, words(k, 0, 84)), (100 * k + 50, words(f"b{k}", 0, 104)), (100 * k + 51, words(f"b{k}", 0, 83))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i - 1 if i % 100 == 1 else i for i, _ in rows}
