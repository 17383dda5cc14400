"""Operator 10, quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts.
A text that resembles one kind is smaller under that kind's dictionary; the
difference of the two sizes, divided by the size without a dictionary, is the
signal.  A logistic curve fitted on labelled rows that the dictionaries did not
see turns it into a score between 0 and 1, the likelihood of label 1.

The fit takes a bounded sample of rows: per label, the ``SAMPLE`` rows of lowest hash,
a third of them for the curve.  Their texts are taken whole: the curve's signals are
computed in tasks over whole texts, and a dictionary is made from ``PIECES`` pieces at
most, those of lowest hash among all pieces of all its texts.  All rows are scored, over
their whole texts.

Null and empty texts have signal 0 and so the score of an undecided text.  Labels
that disagree about one doc_id are each taken.  Without rows of both labels every
score is 0.5 (predicted 0).  Repeated rows are scored alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import common

SAMPLE = 1200
HELD_EVERY = 3                  # one in so many sampled rows is for the curve
PIECE_CHARS = 4096
PIECES = 2000                   # per label
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
THRESHOLD = 0.7


def training_sample(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(quality, text, held): per label the first rows by hash, from (doc_id, text, quality) rows."""
    parts = [rows.where((F.col("quality") == label) & (F.length("text") > 0)).select(
        F.lit(label).alias("quality"), "text", F.xxhash64("doc_id", "text").alias("h")).orderBy("h").limit(SAMPLE) for label in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select("quality", "text", (F.pmod("h", F.lit(HELD_EVERY)) == 0).alias("held"))
    return common.stage_table(spark, chosen, "op10-sample")


def _piece_rows(batches):
    for batch in batches:
        for text in batch.column("text").to_pylist():
            yield pa.record_batch({"piece": [text[k:k + PIECE_CHARS] for k in range(0, len(text), PIECE_CHARS)]})


def dictionary(texts: DataFrame) -> bytes:
    """A zstandard dictionary from the pieces of (text) rows."""
    pieces = texts.select("text").mapInArrow(_piece_rows, "piece string")
    raw = [r["piece"].encode("utf-8", "surrogatepass") for r in pieces.orderBy(F.xxhash64("piece"), "piece").limit(PIECES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, raw).as_bytes()
    except zstandard.ZstdError:                       # too little text to choose from: all of it
        return b"".join(raw)[-DICTIONARY_BYTES:]


class Model:
    """Dictionaries and the logistic curve ``1 / (1 + exp(-(slope * signal + offset)))``."""

    def __init__(self, good: bytes, bad: bytes, slope: float, offset: float):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset

    def __getstate__(self):
        return self.good, self.bad, self.slope, self.offset

    def __setstate__(self, state):
        self.__init__(*state)

    def _compressors(self):
        if not hasattr(self, "_three"):
            small = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), **small)
            self._three = make(self.good), make(self.bad), zstandard.ZstdCompressor(level=LEVEL, **small)
        return self._three

    def signal(self, text: str | None) -> float:
        if not text:
            return 0.0
        raw = text.encode("utf-8", "surrogatepass")
        good, bad, plain = (len(c.compress(raw)) for c in self._compressors())
        return (bad - good) / plain

    def score(self, text: str | None) -> float:
        z = self.slope * self.signal(text) + self.offset
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def fit_curve(signals: np.ndarray, labels: np.ndarray, weights: tuple[float, float], rounds: int = 100, ridge: float = 1e-4) -> tuple[float, float]:
    """Logistic regression on one signal by Newton steps; ``weights`` by label."""
    scale = signals.std() or 1.0
    x = np.column_stack([signals / scale, np.ones(len(signals))])
    weight = np.where(labels == 1, weights[1] / max((labels == 1).sum(), 1), weights[0] / max((labels == 0).sum(), 1))
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - labels)) + ridge * w * [1, 0]
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.diag([1.0, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _signal_rows(shared):
    def rows(batches):
        for batch in batches:
            signals = [shared.value.signal(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"quality": batch.column("quality"), "signal": pa.array(signals, pa.float64())})
    return rows


def train(spark: SparkSession, rows: DataFrame, good_share: float = 0.5) -> Model | None:
    """The model of (doc_id, text, quality) rows; None where a label has no text.
    ``good_share``: how much of the labelled rows has label 1."""
    sample = training_sample(spark, rows)
    n = {(r["quality"], r["held"]): r["n"] for r in sample.groupBy("quality", "held").agg(F.count(F.lit(1)).alias("n")).collect()}
    dictionaries, held = [], []
    for label in (0, 1):
        if not any(n.get((label, x)) for x in (False, True)):
            return None
        part = sample.where(F.col("quality") == label)
        dictionaries.append(dictionary(part.where("NOT held") if n.get((label, False)) else part))
        held.append(part.where("held") if n.get((label, True)) else part)
    model = Model(dictionaries[1], dictionaries[0], 1.0, 0.0)
    shared = spark.sparkContext.broadcast(model)      # two dictionaries of fixed size
    found = held[0].unionByName(held[1]).select("quality", "text").mapInArrow(_signal_rows(shared), "quality int, signal double")
    fitted = found.orderBy("quality", "signal").collect()
    signals, labels = (np.array([r[k] for r in fitted]) for k in ("signal", "quality"))
    model.slope, model.offset = fit_curve(signals, labels, (1 - good_share, good_share))
    return model


def _score_rows(shared):
    def rows(batches):
        model = shared.value
        for batch in batches:
            scores = [0.5 if model is None else model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())})
    return rows


def classify(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    shared = spark.sparkContext.broadcast(model)      # two dictionaries of fixed size
    return docs.select("doc_id", "text").mapInArrow(_score_rows(shared), "doc_id long, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(common.table(sf_dir, "documents")).select("doc_id", "text")
    labels = spark.read.parquet(common.table(sf_dir, "labels")).select("doc_id", "quality")
    chosen = (labels.where(common.doc_fold(F.col("doc_id"), 4) != 2).where("quality IN (0, 1)")
              .withColumn("k", F.xxhash64("doc_id")))
    # Ids first, so that only the sampled rows' texts are joined.
    ids = [chosen.where(F.col("quality") == q).orderBy("k", "doc_id").limit(SAMPLE) for q in (0, 1)]
    wanted = F.broadcast(ids[0].unionByName(ids[1]).select("doc_id", "quality"))
    share = chosen.agg(F.avg(F.col("quality").cast("double")).alias("m")).first()["m"]
    model = train(spark, docs.join(wanted, "doc_id"), 0.5 if share is None else share)
    return classify(spark, docs, model).select(
        "doc_id", (common.doc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


#: Not in SQL; tests hold it against held-out labels.
QUERIES = {"op10_quality_classifier": op10_quality_classifier}
SQL: dict[str, str] = {}
