"""Operator 11, embedding whitening: Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers (``floor(1024 c) + 100000``) and are packed once into blocks in
the shared folder.  Each Lanczos step is one pass over the blocks: every task centres
its rows, forms ``t = X z`` and adds up ``X' t``; only sums of the vectors' length reach
the driver.  A left vector is kept as the combination ``w`` of dimensions it came from
(``u = X w``), so no vector as long as the table is ever stored; its products with the
rows (``X' u``) are at hand when the next one is made orthogonal to all before it.  Right
vectors are made orthogonal to all before them, twice.  The small bidiagonal matrix's
singular value decomposition gives the components and deviations.

The steps end when the first ``k`` values have converged *and* what is left of the total
variance is too small to hide another value as large, so that a repeated eigenvalue can't
be missed; at the latest after as many steps as there are dimensions.  A sequence that
closes early (an invariant subspace) goes on from a new direction.

Rows whose vector is null, or holds a null, infinite or not-a-number entry, are left out;
so are vectors of another length than the most common one (ties: the longer).  Rows that
repeat an id, or have none, are each returned and each count.  An empty table, or vectors
that are all alike, have no components and give no rows; there are fewer than ``k``
components where the vectors span fewer dimensions.  Equal eigenvalues have no unique
vectors: any orthonormal ones are right.  Entries count up to 2^42 in size, larger ones as
that.  A ``deviation`` that passes 64 bits is null.  Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import common

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000
BLOCK_BYTES = 2 << 20
MOST_PARTS = 1024               # partial sums that the driver adds; more are first added in tasks
CONVERGED = 1e-14               # residual of a singular triple, against the largest value
NOTHING = 1e-12                 # a singular value below this share of the largest is zero


@dataclass
class Whitening:
    """A fitted whitening: x goes to ``(x - sums / n) @ components / sqrt(values)``."""

    n: int
    sums: list[int]
    components: np.ndarray      # one column per component
    values: np.ndarray          # eigenvalues of the covariance, falling
    trace: float
    steps: int

    @property
    def matrix(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def _pack(width: int):
    """Task function: blocks (ids, x) of integer vectors, row by row as 64-bit integers."""
    step = max(1, BLOCK_BYTES // (8 * width))

    def rows(batches):
        for batch in batches:
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = np.clip(np.floor(SCALE * flat), -2.0**52, 2.0**52).astype(np.int64) + SHIFT
            ids = batch.column("id")
            for i in range(0, len(x), step):
                ends = pa.array([0, len(ids[i: i + step])], pa.int32())
                yield pa.record_batch([pa.ListArray.from_arrays(ends, ids[i: i + step]),
                                       pa.array([x[i: i + step].tobytes()], pa.binary())], names=["ids", "x"])
    return rows


def _blocks(batches, width: int):
    """(ids, integer rows) of every block."""
    for batch in batches:
        for ids, x in zip(batch.column("ids"), batch.column("x"), strict=True):
            yield ids.values, np.frombuffer(x.as_py(), np.int64).reshape(-1, width)


class _Rows:
    """The centred rows of a staged block table."""

    def __init__(self, blocks: DataFrame, width: int):
        self.blocks, self.width = blocks, width
        self.wide = blocks.rdd.getNumPartitions() > MOST_PARTS

    def summed(self, task, dtype=np.float64) -> np.ndarray:
        """The sum over all partitions of ``task(integer blocks)``, an array each."""
        width = self.width

        def part(batches):
            yield pa.record_batch([pa.array([task(x for _, x in _blocks(batches, width)).tobytes()], pa.binary())], names=["part"])

        def added(batches):
            parts = [np.frombuffer(p, dtype) for b in batches for p in b.column("part").to_pylist()]
            if parts:
                yield pa.record_batch([pa.array([np.sum(parts, axis=0, dtype=dtype).tobytes()], pa.binary())], names=["part"])

        parts = self.blocks.select("ids", "x").mapInArrow(part, "part binary")
        if self.wide:
            parts = parts.repartition(MOST_PARTS).mapInArrow(added, "part binary")
        return np.sum([np.frombuffer(r.part, dtype) for r in parts.collect()], axis=0, dtype=dtype)

    def centre(self, n: int, sums: list[int]) -> None:
        """Sets the mean: whole parts are subtracted as integers, so nothing is lost."""
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def centred(self):
        whole, rest = self.whole, self.rest
        return lambda x: (x - whole).astype(np.float64) - rest

    def products(self, z: np.ndarray) -> tuple[np.ndarray, float]:
        """``X'(X z)`` and the square of the length of ``X z``."""
        centred, width = self.centred(), self.width

        def task(blocks):
            out = np.zeros(width + 1)
            for x in blocks:
                x = centred(x)
                t = x @ z
                out[:width] += t @ x
                out[width] += t @ t
            return out

        out = self.summed(task)
        return out[:width], float(out[width])

    def gram(self, m: np.ndarray, mean: np.ndarray | None = None) -> np.ndarray:
        """Sums of the rows of ``X m``, or of their products when centred on ``mean``."""
        centred, k = self.centred(), m.shape[1]

        def task(blocks):
            out = np.zeros(k if mean is None else k * k)
            for x in blocks:
                y = centred(x) @ m
                out += y.sum(axis=0) if mean is None else ((y - mean).T @ (y - mean)).ravel()
            return out

        return self.summed(task)


def bidiagonalise(rows: _Rows, total: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(right singular vectors as columns, singular values, steps) of the ``k`` largest.

    ``total``: the sum of squares of all centred entries."""
    d = rows.width
    rng = np.random.default_rng(11)
    right = np.zeros((d, 0))        # V: right vectors
    left = np.zeros((d, 0))         # W: u = X w
    image = np.zeros((d, 0))        # X'u
    alpha: list[float] = []
    beta: list[float] = []

    def fresh() -> np.ndarray | None:
        """A unit vector in the rows' span, orthogonal to ``right``; None if it is used up."""
        for _ in range(2):
            r = rng.standard_normal(d)
            r -= right @ (right.T @ r)
            g, square = rows.products(r / np.linalg.norm(r))
            if square <= NOTHING**2 * total:
                continue
            for _ in range(2):
                g = g - right @ (right.T @ g)
            if (size := np.linalg.norm(g)) > NOTHING * total:
                return g / size
        return None

    def decomposed():
        m = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1)
        p, s, qt = np.linalg.svd(m)
        return p, s, qt

    v = fresh()
    while v is not None and right.shape[1] < d:
        right = np.column_stack([right, v])
        z = v - (beta[-1] * left[:, -1] if beta else 0.0)
        g, square = rows.products(z)
        for again in range(2):
            c = left.T @ g                          # what X z shares with the left vectors
            z = z - left @ c
            if c @ c <= 1e-8 * square or again:     # tiny: correct the products as well
                g, square = g - image @ c, square - c @ c
                break
            g, square = rows.products(z)            # not tiny: take them anew
        if square <= NOTHING**2 * total:            # nothing new below the rows' span
            right = right[:, :-1]
            if beta:
                beta[-1] = 0.0
            break
        a = math.sqrt(square)
        alpha.append(a)
        left, image = np.column_stack([left, z / a]), np.column_stack([image, g / a])
        s = g / a - a * v
        for _ in range(2):
            s = s - right @ (right.T @ s)
        b = float(np.linalg.norm(s))
        steps = len(alpha)
        if steps == d:
            break
        if steps >= k and (d <= 128 or steps % 8 == 0):
            p, values, _ = decomposed()
            least = values[k - 1] ** 2
            if b * np.abs(p[-1, :k]).max() <= CONVERGED * values[0] and total - (values**2).sum() < 0.5 * least:
                break
        if b > NOTHING * a and b > NOTHING * math.sqrt(total):
            beta.append(b)
            v = s / b
        else:
            beta.append(0.0)
            v = fresh()
    if not alpha:
        return np.zeros((d, 0)), np.zeros(0), 0
    _, values, qt = decomposed()
    keep = values[:k] > NOTHING * values[0]
    return (right[:, : len(alpha)] @ qt.T)[:, :k][:, keep], values[:k][keep], len(alpha)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of the rows that can be whitened, and the length of their vectors."""
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
            .where(F.col("vec").isNotNull() & ~bad))
    most = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    width = most[0].w if most else 0
    return rows.where(F.size("vec") == width), width


def fit(spark: SparkSession, vectors: DataFrame, id_col: str, vector_col: str, k: int = COMPONENTS) -> tuple[Whitening, _Rows] | None:
    """The whitening of all usable vectors and their staged rows; None without any."""
    clean, width = usable(vectors, id_col, vector_col)
    if not width:
        return None
    kind = clean.schema["id"].dataType.simpleString()
    blocks = common.stage_table(spark, clean.mapInArrow(_pack(width), f"ids array<{kind}>, x binary"), "op11-blocks")
    rows = _Rows(blocks, width)

    def sums(parts):
        out = np.zeros(2 * width + 1, np.int64)         # halves apart, so that no sum passes 64 bits
        for x in parts:
            out[:width] += (x >> 24).sum(axis=0)
            out[width:-1] += (x & 0xFFFFFF).sum(axis=0)
            out[-1] += len(x)
        return out

    found = [int(v) for v in rows.summed(sums, np.int64)]
    n = found[-1]
    exact = [(hi << 24) + lo for hi, lo in zip(found[:width], found[width:-1], strict=True)]
    rows.centre(n, exact)
    centred = rows.centred()
    total = float(rows.summed(lambda parts: np.array([sum(float((centred(x) ** 2).sum()) for x in parts)]))[0])
    if total > 0:
        components, values, steps = bidiagonalise(rows, total, min(k, width))
    else:
        components, values, steps = np.zeros((width, 0)), np.zeros(0), 0
    return Whitening(n, exact, components, values**2 / n, total / n, steps), rows


def identity_error(model: Whitening, rows: _Rows) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    m = model.matrix
    mean = rows.gram(m) / model.n
    covariance = rows.gram(m, mean).reshape(m.shape[1], -1) / model.n
    return float(np.abs(covariance - np.eye(m.shape[1])).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the exact sum of squares of ``n x - sums``."""
    most = max(n * max(abs(int(x.max())), abs(int(x.min()))), 0) + max(map(abs, sums))
    if most < 1 << 62:
        y = x * n - np.array(sums, np.int64)
        if len(sums) * int(np.abs(y).max()) ** 2 < 1 << 63:
            return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * n - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1)]


def whiten(spark: SparkSession, vectors: DataFrame, id_col: str, vector_col: str, k: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: id, component, n, deviation, whitened,
    explained, identity_error."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(spark, vectors, id_col, vector_col, k)
    if fitted is None or not len(fitted[0].values):
        return spark.createDataFrame([], schema)
    model, rows = fitted
    error, centred, width, m = identity_error(model, rows), rows.centred(), rows.width, model.matrix
    n, sums, shares, c = model.n, model.sums, model.values / model.trace, m.shape[1]

    def task(batches):
        for ids, x in _blocks(batches, width):
            y = centred(x) @ m
            rows_ = np.repeat(np.arange(len(x)), c)
            yield pa.record_batch({
                "id": ids.take(pa.array(rows_)), "component": pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(rows_), n)), "deviation": pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(rows_)),
                "whitened": pa.array(y.ravel()), "explained": pa.array(np.tile(shares, len(x))),
                "identity_error": pa.array(np.full(len(rows_), error))})

    return rows.blocks.mapInArrow(task, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(common.table(sf_dir, "embeddings"))
    return whiten(spark, vectors, "vec_id", "embedding").withColumnRenamed("id", "vec_id")


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
#: Eigenvectors to double precision can't be had from DuckDB; the tests hold the query against numpy's.
SQL: dict[str, str] = {}
