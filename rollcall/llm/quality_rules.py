"""Operator 1, quality rules: adaptive thresholds from mergeable quantile sketches.

Each text gets a few signals.  Per language and source, KLL sketches of the
signals are built in one aggregation (partial sketches per input partition, then
merged), and merged on into sketches per language and over everything.  A
group's limit of a signal is a fence: an outer quantile plus ``FENCE`` times its
distance to the median, with no least width.  A group with too few documents takes
its language's, and a language with too few the overall ones.  The limits are
joined back to the signals and the documents filtered.

All signals are rates of counted things, and a short text's rate scatters more: one
repeated line of three is a third.  Beyond the limit r a document of n words or
lines is allowed ``FENCE`` standard deviations of such a count, sqrt((r + u) * u)
with u = unit / n, where unit is how many are counted at once (a three-word window
found twice covers three words).

DataFrame and SQL functions only.

Null text has no words, like the empty text: ``n_words`` is 0 and ``base_failed``
true.  Null languages and sources are groups of their own.  Repeated rows are
judged alike, and so are ties: a signal equal to its limit is within it.  Texts of any
length are counted whole.  Without any document that passes the base rules there are no
thresholds and nothing is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SKETCH_K = 4096
MIN_GROUP = 200                 # documents that a group needs for thresholds of its own
FENCE = 4.0                     # distances beyond the outer quantile, and deviations of a document's own count
#: signal -> (two-sided, outer quantile, what its rate is over, counted at once).  Lines and phrases that repeat are
#: frequent in good texts too, so their limits come from the tail.
SIGNALS = {"word_length": (True, 0.75, "n_words", 1.0), "symbol_rate": (False, 0.75, "n_words", 1.0),
           "dup_line_rate": (False, 0.9375, "n_lines", 1.0), "repeat_rate": (False, 0.9375, "n_words", 3.0)}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_signals(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and the signals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Windows as (hash, position), sorted: equal neighbours are windows found twice or more.
    windows = F.expr("""array_sort(transform(sequence(1, greatest(size(__w) - 2, 1)),
        i -> struct(xxhash64(get(__w, i - 1), get(__w, i), get(__w, i + 1)) AS h, i AS p)))""")
    repeated = F.expr("""CASE WHEN size(__w) < 4 THEN array() ELSE
        filter(__g, (x, k) -> x.h = get(__g, k - 1).h OR x.h = get(__g, k + 1).h).p END""")
    covered = F.expr("size(array_distinct(flatten(transform(__r, p -> array(p, p + 1, p + 2)))))")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, common.SPACE_CHARS, "")) > 0)
    out = (docs.withColumn("__w", common.words(F.col("text")))
           .withColumn("n_words", F.size("__w").cast("long"))
           .withColumn("__g", windows).withColumn("__r", repeated)
           .withColumn("n_repeat_words", covered.cast("long"))
           .drop("__w", "__g", "__r")
           .withColumn("word_chars", F.length(F.translate(text, common.SPACE_CHARS, "")).cast("long"))
           .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
           .withColumn("__lines", lines).withColumn("n_lines", F.size("__lines").cast("long"))
           .withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("__lines"))).drop("__lines"))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b))
    return (out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                           | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
            .withColumn("word_length", per("word_chars", "n_words"))
            .withColumn("symbol_rate", per("n_symbols", "n_words"))
            .withColumn("dup_line_rate", per("n_dup_lines", "n_lines"))
            .withColumn("repeat_rate", per("n_repeat_words", "n_words")))


def thresholds(scored: DataFrame) -> DataFrame:
    """(lang, source, low and high per signal) from the rows that pass the base rules."""
    passed = scored.where("NOT base_failed")
    groups = passed.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.kll_sketch_agg_double(s, F.lit(SKETCH_K)).alias(s) for s in SIGNALS])

    def level(prefix: str, *keys: str) -> DataFrame:
        named = [F.kll_merge_agg_double(s).alias(f"{prefix}_{s}") for s in SIGNALS]
        return groups.groupBy(*keys).agg(F.sum("n").alias(f"{prefix}_n"), *named)

    by_lang = level("lang", "lang").withColumnRenamed("lang", "__lang")
    overall = level("all").select(F.struct(*[f"all_{s}" for s in SIGNALS])).scalar()
    table = groups.join(by_lang, F.col("lang").eqNullSafe(F.col("__lang"))).withColumn("overall", overall)
    out = [F.col("lang").alias("__lang"), F.col("source").alias("__source")]
    for s, (two_sided, outer, _, _) in SIGNALS.items():
        sketch = (F.when(F.col("n") >= MIN_GROUP, F.col(s)).when(F.col("lang_n") >= MIN_GROUP, F.col(f"lang_{s}"))
                  .otherwise(F.col(f"overall.all_{s}")))
        low, middle, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (1 - outer, 0.5, outer))
        below = F.greatest(low - FENCE * (middle - low), F.lit(0.0)) if two_sided else F.lit(0.0)
        out += [below.alias(f"{s}_low"), (high + FENCE * (high - middle)).alias(f"{s}_high")]
    return table.select(*out)


def within() -> Column:
    verdict = F.lit(True)
    for s, (_, _, over, unit) in SIGNALS.items():
        u = F.when(F.col(over) > 0, F.lit(unit) / F.col(over))
        scatter = lambda limit: FENCE * F.sqrt((limit + u) * u)
        low, high = F.col(f"{s}_low"), F.col(f"{s}_high")
        verdict = verdict & F.col(s).between(low - scatter(low), high + scatter(high))
    return F.coalesce(verdict, F.lit(False))


def quality_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` (without need of the text from here on) with counts, signals, limits and ``kept``."""
    scored = common.stage_table(spark, with_signals(docs).drop("text"), "op1-signals")
    return _judged(spark, scored)


def _judged(spark: SparkSession, scored: DataFrame) -> DataFrame:
    # Written first: Spark knows the table's size, and sends it to the rows where it is small.
    limits = common.stage_table(spark, thresholds(scored), "op1-limits")
    joined = scored.join(limits, scored["lang"].eqNullSafe(limits["__lang"])
                         & scored["source"].eqNullSafe(limits["__source"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & within()).drop("__lang", "__source")


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows; all columns stay as they are."""
    names = docs.columns
    whole = docs.select("lang", "source", "text", F.struct(*names).alias("__row"))
    scored = common.stage_table(spark, with_signals(whole).drop("text"), "op1-documents")
    return _judged(spark, scored).where("kept").select("__row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(common.table(sf_dir, "documents")).select("doc_id", "lang", "source", "text")
    return quality_rules(spark, docs).select("doc_id", *BASE, "base_failed", "kept")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
         len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_kinds,
         coalesce(cover.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cover ON d.doc_id = cover.doc_id),
s AS (SELECT *, n_lines - n_kinds AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             word_chars::DOUBLE / n_words AS m1, n_symbols::DOUBLE / n_words AS m2,
             (n_lines - n_kinds)::DOUBLE / n_lines AS m3, n_repeat_words::DOUBLE / n_words AS m4 FROM base),
p AS (SELECT * FROM s WHERE NOT base_failed),
l AS (
  SELECT grouping(lang) AS gl, grouping(source) AS gs, lang, source, count(*) AS n,
         quantile_disc(m1, [0.25, 0.5, 0.75]) AS q1, quantile_disc(m2, [0.5, 0.75]) AS q2,
         quantile_disc(m3, [0.5, 0.9375]) AS q3, quantile_disc(m4, [0.5, 0.9375]) AS q4
  FROM p GROUP BY GROUPING SETS ((lang, source), (lang), ())),
pick AS (SELECT a.lang, a.source, CASE WHEN a.n >= 200 THEN a ELSE CASE WHEN b.n >= 200 THEN b ELSE c END END AS f
         FROM l a JOIN l b ON b.gl = 0 AND b.gs = 1 AND b.lang IS NOT DISTINCT FROM a.lang JOIN l c ON c.gl = 1
         WHERE a.gl = 0 AND a.gs = 0),
lim AS (SELECT lang, source, greatest(f.q1[1] - 4e0 * (f.q1[2] - f.q1[1]), 0e0) AS low, f.q1[3] + 4e0 * (f.q1[3] - f.q1[2]) AS h1,
               f.q2[2] + 4e0 * (f.q2[2] - f.q2[1]) AS h2, f.q3[2] + 4e0 * (f.q3[2] - f.q3[1]) AS h3,
               f.q4[2] + 4e0 * (f.q4[2] - f.q4[1]) AS h4 FROM pick),
u AS (SELECT *, 1e0 / nullif(n_words, 0) AS uw, 1e0 / nullif(n_lines, 0) AS ul, 3e0 / nullif(n_words, 0) AS ur FROM s)
SELECT u.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed
         AND m1 >= low - 4e0 * sqrt((low + uw) * uw) AND m1 <= h1 + 4e0 * sqrt((h1 + uw) * uw)
         AND m2 <= h2 + 4e0 * sqrt((h2 + uw) * uw) AND m3 <= h3 + 4e0 * sqrt((h3 + ul) * ul)
         AND m4 <= h4 + 4e0 * sqrt((h4 + ur) * ur), false) AS kept
FROM u LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM u.lang AND lim.source IS NOT DISTINCT FROM u.source
"""
QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL = {"op1_quality_rules": OP1_SQL}
