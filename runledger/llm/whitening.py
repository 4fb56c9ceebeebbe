"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

X holds the centred rows over the square root of their number, so the squares
of its singular values are the eigenvalues of the covariance.  Starting from a
random direction, products X v and X^T u alternate, each new direction made
orthogonal to all earlier ones on both sides, and X becomes a bidiagonal
matrix with one row per step, whose small SVD gives components and deviations.

A left vector u has one entry per row of X, but it is always X w for a w with
one entry per dimension.  So nothing of the table's length is kept: one pass
reads the rows, forms their entries of X w and of all earlier left vectors,
and adds up the dot products and X^T u in every task; the driver holds vectors
and matrices of the dimensions only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000
SEED = 13
#: least deviation of a component, as a share of the largest one's
NULL_SHARE = 1e-10
LARGEST = 1 << 45          # of |64 c|: beyond, whole numbers and their sums are no longer exact


def whole(embeddings: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``embeddings`` (vec_id, embedding) as whole numbers x = floor(scale * c)
    + offset; rows with a null vector, or a null, non-finite or huge entry, are
    left out."""
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False)))
    return embeddings.filter(sound).select("vec_id", F.transform(
        "embedding", lambda c: F.floor(c.cast("double") * scale) + F.lit(offset)).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors x, one per row."""
    lists = batch.column("x")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class Centre:
    """Number of rows and sums of their whole numbers: what centring needs."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.base = [s // n for s in sums]                     # whole part of the mean
        self.rest = [s - n * b for s, b in zip(sums, self.base, strict=True)]

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, with the whole part taken off exactly."""
        return (x - np.array(self.base)).astype(float) - np.array(self.rest, float) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n * x - S)^2."""
        gap = x - np.array(self.base)
        bound = (int(np.abs(gap).max(initial=0)) + 1) * self.n
        if bound * bound * len(self.base) < 1 << 63:
            gap = gap * self.n - np.array(self.rest)
            return [int(v) for v in np.einsum("ij,ij->i", gap, gap)]
        gap = gap.astype(object) * self.n - np.array(self.rest, object)
        return [int(v) for v in (gap * gap).sum(axis=1)]


def _summed(x: DataFrame, centre: Centre, fold, size: int) -> np.ndarray:
    """Sum over all rows of ``fold(centred rows)``, an array of ``size``
    numbers that depends on the dimensions only.  Every task gives one array;
    they are added up by place, so ``size`` numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += fold(centre.rows(_matrix(batch)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "v"])

    out = np.zeros(size)
    for r in x.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out


def _product(x: DataFrame, centre: Centre, right: np.ndarray, w: np.ndarray):
    """One pass with u = X w: (dot products of u with the left vectors X right,
    |u|^2, X^T u)."""
    k, scale = right.shape[1], 1.0 / centre.n

    def fold(rows: np.ndarray) -> np.ndarray:
        u = rows @ w
        return np.r_[(rows @ right).T @ u, u @ u, rows.T @ u] * scale

    out = _summed(x, centre, fold, k + 1 + len(w))
    return out[:k], out[k], out[k + 1:]


def _against(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` orthogonal to the columns of ``basis``; twice, for rounding."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def _fresh(rng: np.random.Generator, basis: np.ndarray) -> np.ndarray:
    v = _against(rng.standard_normal(len(basis)), basis)
    return v / np.linalg.norm(v)


def bidiagonalise(x: DataFrame, centre: Centre, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(V, diagonal, superdiagonal) with X V = U B, U and V orthonormal, B upper
    bidiagonal: one step and pass per dimension, since a shorter run can miss a
    second direction of an equal deviation.  Where a direction is used up, the
    run goes on from a fresh one orthogonal to all before."""
    d = len(centre.sums)
    rng = np.random.default_rng([seed, d])
    v = _fresh(rng, np.zeros((d, 0)))
    right, left, images = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))     # V, W with U = X W, X^T U
    alphas, betas = [], []
    beta, largest = 0.0, 0.0
    for step in range(d):
        right = np.c_[right, v]
        w = v - beta * left[:, -1] if step else v
        dots, square, image = _product(x, centre, left, w)
        w, image = w - left @ dots, image - images @ dots                          # full reorthogonalisation of u
        alpha = np.sqrt(max(square - dots @ dots, 0.0))
        largest = max(largest, alpha, beta)
        if alpha <= largest * NULL_SHARE:                                          # nothing left in this direction
            alpha, w, image = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, image = w / alpha, image / alpha
        alphas.append(alpha)
        left, images = np.c_[left, w], np.c_[images, image]
        if step + 1 < d:
            r = _against(image, right)                                             # X^T u - alpha v, and all of V
            beta = float(np.linalg.norm(r))
            if beta <= largest * NULL_SHARE:
                beta, v = 0.0, _fresh(rng, right)
            else:
                v = r / beta
            betas.append(beta)
    return right, np.array(alphas), np.array(betas)


def fit(x: DataFrame, components: int = COMPONENTS, seed: int = SEED) -> tuple[Centre, np.ndarray, np.ndarray, np.ndarray] | None:
    """(centre, components as columns, their deviations, shares of the trace)
    of the vectors in ``x`` (vec_id, x; all of one length), by falling
    deviation; None where there are no rows.  Components without deviation are
    left out: there is nothing to scale by."""
    sums = x.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("at").collect()   # one row per dimension
    if not sums:
        return None
    centre = Centre(sums[0].n, [int(r.s) for r in sums])
    trace = _summed(x, centre, lambda rows: np.array([(rows * rows).sum() / centre.n]), 1)[0]
    right, alphas, betas = bidiagonalise(x, centre, seed)
    b = np.diag(alphas) + np.diag(betas, 1)
    _, deviations, rotated = np.linalg.svd(b)
    found = int(((deviations > deviations[0] * NULL_SHARE) & (deviations > 0)).sum())
    m = min(components, found)
    return centre, right @ rotated[:m].T, deviations[:m], deviations[:m] ** 2 / trace if trace else deviations[:0]


def _project(centre: Centre, axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            out = centre.rows(x) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, axes.shape[1] or 1, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([str(v) for v in centre.deviations(x)]), lists], ["vec_id", "deviation", "whitened"])
    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET,
           seed: int = SEED) -> DataFrame:
    """Whitened vectors of ``embeddings`` (vec_id, embedding).

    One row per sound row and component: vec_id, component (from 1, by falling
    deviation), n, deviation (decimal, exact), whitened, explained (the
    component's share of the trace), identity_error (largest entry of the
    whitened rows' covariance minus the identity; one number).  Rows with a
    null or empty vector, or a null, non-finite or huge entry, are left out,
    as are rows whose length is not the commonest one (of two, the longer):
    they fit in no matrix with the others.  Repeated rows and ids count as they
    stand.  Vectors that span fewer dimensions have fewer components; a table
    of one or of equal vectors has none, and an empty one neither: no rows.
    Other columns are not read."""
    x = whole(embeddings, scale, offset)
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = store(x.filter(F.size("x") == (lengths.d if lengths else 0)), "vectors")
    made = fit(x, components, seed)
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    if made is None or not made[2].size:
        return x.filter("false").select(
            "vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
                ("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"),
                ("explained", "double"), ("identity_error", "double"))])
    centre, axes, deviations, explained = made
    axes = axes / deviations
    m = len(deviations)
    gram = _summed(x, centre, lambda rows: ((rows @ axes).T @ (rows @ axes)).ravel() / centre.n, m * m).reshape(m, m)
    error = float(np.abs(gram - np.eye(m)).max())
    rows = x.mapInArrow(_project(centre, axes), f"vec_id {id_type}, deviation string, whitened array<double>")
    share = F.array(*[F.lit(float(e)) for e in explained])
    return rows.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
