"""Whitening by a Jacobi-Davidson eigensolver over distributed covariance products.

The covariance is never formed: V y = sum of c (c . y) / n over the centred vectors c,
a block of columns y at a time, is one pass in which each task sums its own rows. The
solver keeps a subspace and the products of its basis. Each round takes the Ritz pairs of
the subspace (Rayleigh-Ritz), locks those whose residual has reached double precision, and
extends the subspace by corrections: the equation
(I - QQ')(V - theta)(I - QQ') t = -residual is solved by a few MINRES steps, all columns
in step, so a step is one pass whatever their number. Q holds the locked vectors and the
Ritz vectors to be corrected. A subspace that grows too wide restarts from its best Ritz
vectors. What the driver holds is a few dozen columns of the dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm._shared import release, stash

FACTOR, SHIFT = 64, 1_000_000  # an entry c becomes floor(FACTOR * c) + SHIFT
MOST = 32
LARGEST = 2.0**56  # of an entry, so that what it becomes is a long
PRECISION = 2.0**-44  # residual of a locked pair, against the largest eigenvalue
NOTHING = 1e-11  # an eigenvalue below this part of the largest is zero in double precision
INNER = 5  # MINRES steps of a round
EXTRA = 8  # columns of the first subspace beyond those asked for
ROUNDS = 200

Product = Callable[[np.ndarray], np.ndarray]


def _orthogonal(t: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``t`` adds to the orthonormal ``basis``."""
    for least in (0, 1e-10, 1e-10):
        size = np.sqrt((t * t).sum(0))
        t = t[:, size > least] / size[size > least]
        t = t - basis @ (basis.T @ t)
    if not t.shape[1]:
        return t
    left, size, _ = np.linalg.svd(t, full_matrices=False)
    left = left[:, size > 1e-6 * size[0]]
    return np.linalg.qr(left - basis @ (basis.T @ left))[0]


def _minres(product: Product, right: np.ndarray, steps: int) -> np.ndarray:
    """A few steps of MINRES for each column of ``right``, all in step."""
    beta = np.sqrt((right * right).sum(0))
    x, old, v, w, w_old = np.zeros_like(right), np.zeros_like(right), right / np.where(beta > 0, beta, 1), np.zeros_like(right), np.zeros_like(right)
    phi, beta = beta, np.zeros_like(beta)
    c, s, c_old, s_old = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * old
        after = np.sqrt((p * p).sum(0))
        far, delta = s_old * beta, c_old * beta
        gamma, delta = c * alpha - s * delta, c * delta + s * alpha
        size = np.sqrt(gamma * gamma + after * after)
        safe = np.where(size > 0, size, 1)
        turn, lean = np.where(size > 0, gamma / safe, 1.0), after / safe
        w, w_old = (v - delta * w - far * w_old) / safe, w
        x = x + turn * phi * w * (size > 0)
        phi = -lean * phi
        c_old, s_old, c, s = c, s, turn, lean
        old, v, beta = v, p / np.where(after > 0, after, 1), after
    return x


def largest_pairs(product: Product, dim: int, most: int, inner: int = INNER, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of the symmetric ``product``'s largest pairs.

    Rounds end when every residual is ``PRECISION`` of the largest value or less.
    """
    most = min(most, dim)
    wide = 2 * most + 2 * EXTRA
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, min(dim, most + EXTRA))))[0]
    images = product(basis)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    for _ in range(ROUNDS):
        middle = basis.T @ images
        theta, turn = np.linalg.eigh((middle + middle.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        left = most - len(values)
        ritz, moved = basis @ turn, images @ turn
        rest = moved[:, :left] - ritz[:, :left] * theta[:left]
        rest = rest - locked @ (locked.T @ rest)
        top = max(abs(theta[0]) if len(theta) else 0.0, abs(values[0]) if len(values) else 0.0)
        bad = np.sqrt((rest * rest).sum(0)) > PRECISION * top
        done = int(np.argmax(bad)) if bad.any() else len(bad)
        locked, values = np.c_[locked, ritz[:, :done]], np.r_[values, theta[:done]]
        if len(values) == most:
            break
        keep = min(ritz.shape[1], max(left - done + EXTRA, wide // 2)) if ritz.shape[1] + left > wide else ritz.shape[1]
        basis, images = ritz[:, done : max(keep, done + 1)], moved[:, done : max(keep, done + 1)]
        tries = np.flatnonzero(bad)
        at, q = theta[tries], np.c_[locked, ritz[:, tries]]
        q = np.linalg.qr(q)[0]

        def projected(y: np.ndarray) -> np.ndarray:
            y = y - q @ (q.T @ y)
            z = product(y) - y * at
            return z - q @ (q.T @ z)

        new = _orthogonal(_minres(projected, -(rest[:, tries] - q @ (q.T @ rest[:, tries])), inner), np.c_[locked, basis])
        if not new.shape[1]:  # residuals are rounding, or the basis spans all there is
            new = _orthogonal(np.random.default_rng(seed + 1).normal(size=(dim, min(left, dim))), np.c_[locked, basis])
        if new.shape[1]:
            basis, images = np.c_[basis, new], np.c_[images, product(new)]
        elif basis.shape[1] + locked.shape[1] == dim:  # nothing is left to add: these are the pairs
            images = product(basis)
            theta, turn = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
            locked, values = np.c_[locked, (basis @ turn)[:, ::-1]], np.r_[values, theta[::-1]]
            break
    else:
        raise ArithmeticError(f"{len(values)} of {most} eigenpairs reached double precision in {ROUNDS} rounds")
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], locked[:, order]


def _summed(x: DataFrame, cells: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of ``part`` (a matrix of rows -> ``cells`` numbers): summed in
    each task, then by cell in Spark; ``cells`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(cells), False
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total, any_rows = total + part(rows), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], ["cell", "value"])

    out = np.zeros(cells)
    for row in x.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[row["cell"]] = row["value"]
    return out


class Fit:
    """Exact sums of the fit list of one dimension, and the pairs of its covariance."""

    def __init__(self, x: DataFrame, dim: int, most: int):
        self.dim = dim

        def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    rows = np.stack(batch["x"])
                    yield pd.DataFrame({"at": np.arange(dim, dtype=np.int32), "n": len(batch), "high": (rows >> 32).sum(0), "low": (rows & 0xFFFFFFFF).sum(0), "least": rows.min(0), "most": rows.max(0)})

        sums = x.select("x").mapInPandas(halves, "at int, n long, high long, low long, least long, most long")
        wide = "decimal(38,0)"
        sums = sums.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"), F.min("least").alias("least"), F.max("most").alias("most"))
        found = sorted(sums.collect())
        self.n = int(found[0]["n"])
        self.sums = [int(r["high"]) * (1 << 32) + int(r["low"]) for r in found]
        middle = [(2 * s + self.n) // (2 * self.n) for s in self.sums]  # the mean, rounded
        self.middle = np.array(middle, np.int64)
        self.off = [s - self.n * m for s, m in zip(self.sums, middle)]
        self.rest = np.array([o / self.n for o in self.off])
        widest = max(max(r["most"] - m, m - r["least"]) for r, m in zip(found, middle))
        self.small = dim * (self.n * (widest + 1)) ** 2 < 1 << 63
        self.trace = _summed(x, 1, lambda rows: (self.centred(rows) ** 2).sum(keepdims=True).ravel())[0] / self.n
        self.values, self.vectors = np.zeros(0), np.zeros((dim, 0))
        if self.trace > 0:
            values, vectors = largest_pairs(lambda y: self.product(x, y), dim, most)
            real = values > NOTHING * values[0]
            self.values, self.vectors = values[real], vectors[:, real]
        k = len(self.values)
        if k:
            both = _summed(x, k * k + k, lambda rows: self._moments(self.whitened(rows)))
            mean = both[k * k :] / self.n
            self.error = float(np.abs(both[: k * k].reshape(k, k) / self.n - np.outer(mean, mean) - np.eye(k)).max())

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.middle) - self.rest

    def product(self, x: DataFrame, y: np.ndarray) -> np.ndarray:
        def part(rows: np.ndarray) -> np.ndarray:
            c = self.centred(rows)
            return (c.T @ (c @ y)).ravel()

        return _summed(x, y.size, part).reshape(y.shape) / self.n

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return self.centred(rows) @ (self.vectors / np.sqrt(self.values))

    @staticmethod
    def _moments(z: np.ndarray) -> np.ndarray:
        return np.r_[(z.T @ z).ravel(), z.sum(0)]

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sum) ** 2, exact; null beyond a long."""
        if self.small:
            gap = self.n * (rows - self.middle) - np.array(self.off, np.int64)
            return (gap * gap).sum(1).tolist()
        totals = [sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums)) for row in rows.tolist()]
        return [t if t < 1 << 63 else None for t in totals]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, component, n, deviation, whitened, explained,
    identity_error), a row for each vector and component.

    Entries become whole numbers, floor(64 c) + 1,000,000. Vectors that are null or hold null or
    non-finite entries, or entries of 2 ** 56 or more, whose number is no long, take no part; all
    others are the fit list. A zero vector is a vector like others, an empty one has no
    components. Vectors of different dimensions are separate lists, each with its own fit. At most
    ``most`` components, fewer where the dimension or the rank is lower: directions without
    variance can't be whitened, so equal vectors alone have no rows. ``deviation`` is null where it
    exceeds a long. Null and repeated ids are rows like others; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)) & (F.size("v") > 0), F.lit(False))
    kept = stash(rows.where(fine).select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(c * FACTOR).cast("long") + SHIFT).alias("x")))
    out = None
    for dim in sorted(r["dim"] for r in kept.select("dim").distinct().collect()):
        part = kept.where(F.col("dim") == dim).select("vec_id", "x")
        fit = Fit(part, dim, most)
        if len(fit.values):
            one = part.mapInArrow(_rows_of(fit), OUT)
            out = one if out is None else out.unionByName(one)
    if out is None:
        release(kept)
        return spark.createDataFrame([], OUT)
    return out


def _rows_of(fit: Fit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k, explained = len(fit.values), fit.values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                n = some.num_rows
                rows = some.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                each = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, fit.n)),
                        pa.array(fit.deviations(rows), pa.int64()).take(pa.array(each)), pa.array(fit.whitened(rows).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, fit.error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run
