"""Operator 2, n-gram Jaccard join: rare-first prefix filtering.

A document's set holds its distinct word 5-grams as 64-bit hashes.  Documents
with equal sets form one class, which the join treats as one record.  N-grams are
dealt by hash to shards of about ``SHARD`` entries, which count in how many classes
each occurs; n-grams of one class only are dropped there, as they link nothing.
That takes two steps, as shuffling all n-grams takes twice the texts' room: first
those below ``FIRST``, of all classes; then the others, of the classes that may
still link.  A class may not once more than a fifth of its set is known to occur
nowhere else.  The rows to read again are kept in a bit table of at most 64 MB;
where it is too small, or marks a row in vain, more n-grams are dealt out, with the
same links.  The counts are exact, over all classes below ``FIRST`` and over those
read again above.  The n-grams go back to their classes and are put in order of
that count, then of hash; the dropped ones, whose number is known, come before
them.  Two sets of Jaccard similarity 0.8 or more share an n-gram among the first
``n - ceil(0.8 n) + 1`` of each.

Joining on prefix n-grams takes two passes, so that a large group of near copies
is not spelled out as all its pairs:

1. in rounds, each prefix n-gram names the most central of its classes as its hub
   (whose n-grams occur in most classes on average), and every other component
   proposes one link, to the hub that it shares most n-grams with; verified links
   join components;
2. n-grams whose classes lie in different components are joined with each other,
   pairs of one component left out; length, positional and suffix filters cut the
   candidates, each pair is verified once against the whole sets.

A pair skipped in pass 2 lies in one component already, so the components are
those of all links, however many rounds pass 1 takes.

An n-gram that could fill a shard by itself (its bucket of a small count table is
above ``HOT``) is counted and joined by Spark's own aggregation instead, which
combines before the shuffle and splits skewed keys.

Null, empty and white-space texts have an empty set and link with nothing.  Rows
that repeat a doc_id are returned each; null doc_ids come after all others when
the smallest id is sought.  As ids may be null or repeated, a row is known by a
hash of its id and text, which any reading of the texts gives alike; rows that
share it are the same.  Set and row hashes are 64 bits wide: two different sets
(n-grams, rows) are taken for one with probability 2^-64 per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import collocations, common

SHINGLE = 5
SHARD = 1 << 20                 # n-grams counted in one task
BLOCK = 1 << 20                 # n-grams that a task holds before it deals them out
BUCKETS = 1 << 16               # size of the table that finds very frequent n-grams
HOT = 1 << 20                   # bucket count from which n-grams are counted apart
FIRST = 3 * (1 << 64) // 10      # n-grams below, as unsigned numbers, are dealt out first
SEEN_CLASSES = 200_000          # classes that a task remembers, so as not to deal out copies' n-grams again
ROUNDS = 3                      # rounds of hub links before all pairs of different components
REGIONS = 4                     # hash regions of the suffix filter
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct n-gram hashes of one text's word hashes."""
    if not len(hashes):
        return hashes
    width = min(SHINGLE, len(hashes))
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _STEP + hashes[k: len(hashes) - width + 1 + k]
        out = common.mix64(out + np.uint64(width))
    return np.unique(out)


def set_hash(grams: np.ndarray) -> int:
    """One 64-bit hash of a set of n-grams."""
    with np.errstate(over="ignore"):
        total = common.mix64(grams ^ _STEP).sum(dtype=np.uint64) + np.uint64(len(grams)) * _STEP
    return int(common.mix64(np.array([total], np.uint64)).view(np.int64)[0])


def _sets(column):
    """(row, n-gram set) of an Arrow text column."""
    for i, j, hashes, counts in common.word_hash_slices(column):
        ends = np.cumsum(counts)
        for k in range(j - i):
            yield i + k, shingles(hashes[ends[k] - counts[k]: ends[k]])


FACTS_SCHEMA = "row long, doc_id long, n_shingles long, n_first long, cls long, bucket int, n long"


def _fact_rows(batches):
    """A row (row, doc_id, n_shingles, n_first, cls) per document, and at the task's end a
    row (bucket, n) per bucket of n-grams met: both from one pass over the texts."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        first = np.zeros(batch.num_rows, np.int64)
        cls = np.zeros(batch.num_rows, np.int64)
        held = []
        for row, grams in _sets(batch.column("text")):
            size[row] = len(grams)
            first[row] = _cut(grams)
            cls[row] = set_hash(grams) if len(grams) else 0
            held.append((grams % np.uint64(BUCKETS)).astype(np.int64))
        if held:
            counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        yield pa.record_batch({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_shingles": pa.array(size),
                               "n_first": pa.array(first), "cls": pa.array(cls), "bucket": pa.nulls(batch.num_rows, pa.int32()), "n": pa.nulls(batch.num_rows, pa.int64())})
    some = np.flatnonzero(counts)
    none = pa.nulls(len(some), pa.int64())
    yield pa.record_batch({"row": none, "doc_id": none, "n_shingles": none, "n_first": none, "cls": none,
                           "bucket": pa.array(some.astype(np.int32)), "n": pa.array(counts[some])})


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _class_sets(batches):
    """(cls, n-grams) of each class that the task meets."""
    done: set[int] = set()
    for batch in batches:
        if len(done) > SEEN_CLASSES:
            done.clear()
        for _, grams in _sets(batch.column("text")):
            if not len(grams):
                continue
            cls = set_hash(grams)
            if cls not in done:
                done.add(cls)
                yield cls, grams


def _cut(grams: np.ndarray) -> int:
    """How many of the sorted n-grams are dealt out first."""
    return int(np.searchsorted(grams, np.uint64(FIRST)))


def _first_sets(batches):
    """(cls, n-grams below ``FIRST``) of each class that the task meets."""
    for cls, grams in _class_sets(batches):
        yield cls, grams[:_cut(grams)]


def _other_sets(again):
    """(cls, other n-grams) of each class among the rows marked in the bit table ``again``."""

    def marked(batches):
        for batch in batches:
            rows = batch.column("row").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(collocations._looked_up(again.value, rows)))

    def sets(batches):
        for cls, grams in _class_sets(marked(batches)):
            yield cls, grams[_cut(grams):]
    return sets


def _is_hot(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return np.isin((grams % np.uint64(BUCKETS)).astype(np.int64), hot)


def _dealt(held: list[tuple[int, np.ndarray]], shards: int):
    """Rows (shard, grams, cls): equally long blocks of 8-byte numbers."""
    grams = np.concatenate([g for _, g in held])
    cls = np.repeat(np.array([c for c, _ in held], np.int64), [len(g) for _, g in held])
    shard = ((grams >> np.uint64(34)) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    grams, cls, shard = grams[order], cls[order], shard[order]
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = np.append(cuts[1:], len(shard))
    return pa.record_batch({"shard": pa.array(shard[cuts]),
                            "grams": pa.array([grams[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary()),
                            "cls": pa.array([cls[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary())})


def _block_rows(sets, shards: int, hot: np.ndarray):
    """Task function: the n-grams that ``sets`` takes, dealt to shards by hash; without hot ones."""

    def rows(batches):
        held, size = [], 0
        for cls, grams in sets(batches):
            if len(hot):
                grams = grams[~_is_hot(grams, hot)]
            if not len(grams):
                continue
            held.append((cls, grams))
            size += len(grams)
            if size >= BLOCK:
                yield _dealt(held, shards)
                held, size = [], 0
        if held:
            yield _dealt(held, shards)
    return rows


def _hot_rows(sets, hot: np.ndarray):
    def rows(batches):
        for cls, grams in sets(batches):
            found = grams[_is_hot(grams, hot)].view(np.int64)
            yield pa.record_batch({"cls": pa.array(np.full(len(found), cls)), "gram": pa.array(found)})
    return rows


SHARED_SCHEMA = "cls long, gram long, df int"


def _shared_rows(key, table):
    """(cls, gram, df) of a shard's n-grams that occur in ``df`` >= 2 classes."""
    grams, cls = (np.frombuffer(b"".join(table[name].to_pylist()), np.int64) for name in ("grams", "cls"))
    order = np.lexsort((cls, grams))
    grams, cls = grams[order], cls[order]
    new = np.ones(len(grams), bool)                 # several tasks may have dealt out one class
    new[1:] = (grams[1:] != grams[:-1]) | (cls[1:] != cls[:-1])
    grams, cls = grams[new], cls[new]
    starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    df = np.diff(np.append(starts, len(grams)))
    df = np.repeat(df, df)
    many = df >= 2
    return pa.table({"cls": cls[many], "gram": grams[many], "df": df[many].astype(np.int32)})


def _shared(texts: DataFrame, sets, total: int, hot: np.ndarray) -> DataFrame:
    """(cls, gram, df) of those of the about ``total`` n-grams taken by ``sets`` that occur in
    ``df`` >= 2 classes."""
    blocks = texts.mapInArrow(_block_rows(sets, -(-total // SHARD) or 1, hot), "shard int, grams binary, cls binary")
    shared = blocks.groupBy("shard").applyInArrow(_shared_rows, SHARED_SCHEMA)
    if len(hot):
        pairs = texts.mapInArrow(_hot_rows(sets, hot), "cls long, gram long").distinct()
        counts = pairs.groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df >= 2")
        shared = shared.unionByName(pairs.join(counts, "gram"))
    return shared


def shared_sets(texts: DataFrame, facts: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, n, place, grams) of the classes that may link, and of others in part: their n-grams
    that other classes have too, by falling rarity; ``n`` is the size of the whole set,
    ``place`` falls as its n-grams' mean count of classes grows."""
    spark = texts.sparkSession
    total = facts.agg(F.sum("n_first").alias("n")).first()["n"] or 0
    # At most BUCKETS rows.
    hot = np.array([r["bucket"] for r in facts.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n"))
                    .where(F.col("n") > HOT).collect()], np.int64)
    first = common.stage_table(spark, _shared(texts.select("text"), _first_sets, total, hot), "op2-first-grams")

    each = facts.where("n_shingles > 0").groupBy("cls").agg(
        F.first("n_shingles").alias("n"), F.first("n_first").alias("n_first"), F.min("row").alias("h"))
    met = first.groupBy("cls").agg(F.count(F.lit(1)).alias("k"))
    alone = F.col("n_first") - F.coalesce("k", F.lit(0))
    again = common.stage_table(spark, each.join(met, "cls", "left").where(5 * alone <= F.col("n"))
                               .select("h", (F.col("n") - F.col("n_first")).alias("n")), "op2-again")
    total = again.agg(F.sum("n").alias("n")).first()["n"] or 0
    table = spark.sparkContext.broadcast(collocations._bit_table(spark, again.select("h"), "op2-again-rows"))   # 64 MB at most
    others = _shared(texts.select("row", "text"), _other_sets(table), total, hot)

    sizes = classes.where("n_shingles > 0").groupBy("cls").agg(F.first("n_shingles").cast("int").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("df", "gram")))["gram"]      # one text's n-grams at most
    return (first.unionByName(others).groupBy("cls").agg(ordered.alias("grams"), F.sum("df").alias("met")).join(sizes, "cls")
            .select("cls", "n", (-F.col("met") / F.col("n")).alias("place"), "grams"))


def linkable(sets: DataFrame) -> DataFrame:
    """The sets that may link with another: two linked sets have 0.8 of the n-grams of each
    in common, so one of which fewer are shared has none in its prefix."""
    return sets.where("5 * size(grams) >= 4 * n")


PREFIX_SCHEMA = "token long, cls long, n int, place double, pos int, after long"


def _prefix_rows(batches):
    """Rows (token, cls, n, place, pos, after) of the shared n-grams in each set's prefix.
    ``after``: how many n-grams follow in each hash region, modulo 256."""
    for batch in batches:
        parts: list[tuple] = []
        numbers = (batch.column(name).to_pylist() for name in ("cls", "n", "place"))
        for cls, n, place, grams in zip(*numbers, batch.column("grams"), strict=True):
            grams = grams.values.to_numpy(zero_copy_only=False)
            first = n - len(grams)                  # so many n-grams of this class alone come before
            p = prefix_length(n) - first
            if p <= 0:
                continue
            region = (grams.view(np.uint64) >> np.uint64(32)) % np.uint64(REGIONS)
            total = np.bincount(region.astype(np.int64), minlength=REGIONS)
            seen = np.cumsum(region[:p, None] == np.arange(REGIONS, dtype=np.uint64), axis=0)
            after = ((total - seen) % 256 << (8 * np.arange(REGIONS))).sum(axis=1)
            parts.append((grams[:p], np.full(p, cls), np.full(p, n, np.int32), np.full(p, place),
                          np.arange(first, first + p, dtype=np.int32), after.astype(np.int64)))
        if parts:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)],
                                  names=["token", "cls", "n", "place", "pos", "after"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets have similarity 0.8 or more; n-grams of one
    class alone count in the sizes only."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    return (pairs.join(left, "a").join(right, "b").withColumn("i", both)
            .where("100 * i >= 80 * (na + nb - i)").select("a", "b"))


def components(spark: SparkSession, edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches.

    Every round a node takes the smallest label among its neighbours, then its
    label's label; each round's labels are written to the shared folder."""
    both = common.stage_table(spark, edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), f"{name}-edges")
    labels = common.stage_table(spark, both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.toDF("other", "l"), "other").groupBy("node").agg(F.min("l").alias("l"))
        step = labels.join(near, "node").select("node", F.least("label", "l").alias("next"), F.col("label").alias("was"))
        jump = labels.toDF("next", "far")
        new = common.stage_table(spark, step.join(jump, "next", "left").select(
            "node", F.coalesce(F.least("next", "far"), "next").alias("label"), "was"), f"{name}-labels")
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _near(a: str, b: str) -> str:
    """SQL: the length, positional and suffix filters on two prefix rows of one n-gram."""
    need = f"ceil(4 * ({a}.n + {b}.n) / 9)"
    gap = [f"abs((shiftright({a}.after, {8 * k}) & 255) - (shiftright({b}.after, {8 * k}) & 255))" for k in range(REGIONS)]
    differ = " + ".join(f"least({g}, 256 - {g})" for g in gap)
    return f"""5 * {a}.n >= 4 * {b}.n AND 5 * {b}.n >= 4 * {a}.n
        AND 1 + least({a}.n - {a}.pos - 1, {b}.n - {b}.pos - 1) >= {need}
        AND {a}.pos + {b}.pos + {differ} <= {a}.n + {b}.n - 2 * {need}"""


def _spread(live: DataFrame) -> DataFrame:
    """The rows of n-grams that lie in several components."""
    tokens = (live.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
              .where("lo <> hi").select("token"))
    return live.join(tokens, "token")


def hub_pairs(live: DataFrame, seen: DataFrame | None) -> DataFrame:
    """One pair (a, b) for each component at most: the hub ``a`` that its members share
    most prefix n-grams with.  Pairs in ``seen`` are left out."""
    entry = F.struct("place", "cls", "n", "pos", "after")
    each = live.groupBy("token", "comp").agg(F.min(entry).alias("m"))
    hubs = (each.groupBy("token").agg(F.min(F.struct("m", "comp")).alias("h"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .where("lo <> hi").select("token", F.col("h.comp").alias("hub_comp"), F.col("h.m").alias("h")))
    near = (each.join(hubs, "token").where("comp <> hub_comp").where(_near("h", "m"))
            .groupBy("comp", F.col("h.cls").alias("a"), F.col("m.cls").alias("b")).agg(F.count(F.lit(1)).alias("k")))
    if seen is not None:
        near = near.join(seen, ["a", "b"], "left_anti")
    best = near.groupBy("comp").agg(F.min(F.struct((-F.col("k")).alias("k"), "a", "b")).alias("x"))
    return best.select("x.a", "x.b")


def candidates(live: DataFrame) -> DataFrame:
    """Distinct pairs a < b from different components (``comp``) that share a prefix
    n-gram and pass the filters.  ``live``: (token, cls, n, place, pos, after, comp)."""
    rows = _spread(live)
    a, b = rows.alias("a"), rows.alias("b")
    return (a.join(b, F.expr(f"a.token = b.token AND a.cls < b.cls AND a.comp <> b.comp AND {_near('a', 'b')}"))
            .select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct())


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _marked(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``live`` with each class's component so far (``comp``)."""
    if labels is None:
        return live.withColumn("comp", F.col("cls"))
    return (live.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
            .withColumn("comp", F.coalesce("label", "cls")).drop("label"))


def ngram_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, set hash ``cls``,
    its ``row_key`` as ``row`` and that of its component's first row as ``first_row``
    (null for an empty set)."""
    texts = docs.select(row_key().alias("row"), "doc_id", "text")
    facts = common.stage_table(spark, texts.mapInArrow(_fact_rows, FACTS_SCHEMA), "op2-classes")
    classes = facts.where("bucket IS NULL").select("doc_id", "n_shingles", "cls", "row")

    sets = common.stage_table(spark, linkable(shared_sets(texts, facts, classes)), "op2-sets")
    live = common.stage_table(spark, sets.mapInArrow(_prefix_rows, PREFIX_SCHEMA), "op2-prefixes")

    links = seen = labels = None
    for _ in range(ROUNDS):
        tried = common.stage_table(spark, hub_pairs(_marked(live, labels), seen), "op2-hubs")
        found = common.stage_table(spark, _verified(tried, sets), "op2-links")
        both_ways = tried.union(tried.select("b", "a"))
        seen = both_ways if seen is None else seen.union(both_ways)
        links = found if links is None else links.union(found)
        if not found.limit(1).count():
            break
        labels = components(spark, links, "op2-first")

    rest = common.stage_table(spark, candidates(_marked(live, labels)).join(seen, ["a", "b"], "left_anti"), "op2-pairs")
    more = common.stage_table(spark, _verified(rest, sets), "op2-links")
    labels = components(spark, links.union(more), "op2-last")

    # A class, or a component of classes, is named by its smallest doc_id; its first row has that id.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    own = classes.where("n_shingles > 0").groupBy("cls").agg(F.min(place).alias("least"))
    named = own.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = named.groupBy("label").agg(F.min("least").alias("least"))
    names = named.select("cls", "label").join(smallest, "label").select("cls", "least")
    least = F.when(F.col("n_shingles") > 0, F.col("least"))
    return classes.join(names, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce(least["doc_id"], "doc_id").alias("component_id"), "cls", "row",
        least["row"].alias("first_row"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, of its smallest doc_id, and all rows of
    empty sets; all columns stay."""
    rows = common.stage_table(spark, ngram_join(spark, docs).where("n_shingles > 0").select("row", "first_row"), "op2-rows")
    gone = rows.where("row <> first_row").select(F.col("row").alias("__gone")).distinct()
    # Rows alike in id and text: any one of them.
    again = rows.where("row = first_row").groupBy(F.col("row").alias("__again")).count().where("count > 1").select("__again")
    keyed = docs.withColumn("__row_key", row_key())
    kept = keyed.join(gone, F.col("__row_key") == F.col("__gone"), "left_anti")
    same = F.col("__row_key") == F.col("__again")
    return (kept.join(again, same, "left_anti")
            .unionByName(kept.join(again, same, "left_semi").dropDuplicates(["__row_key"])).drop("__row_key"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(common.table(sf_dir, "documents"))
    return ngram_join(spark, docs).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.root), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""
QUERIES = {"op2_ngram_join": op2_ngram_join}
SQL = {"op2_ngram_join": OP2_SQL}
