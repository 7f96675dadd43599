"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed: all that the iteration asks for is ``V Q`` for a thin block Q, which is one pass
over the vectors. Each task multiplies its centred rows by Q and back, and Spark adds up the tasks' blocks by dimension, so a pass brings
dimension x block numbers to the driver, however many vectors there are.

A round filters the block with a polynomial of V: the Chebyshev three-term recurrence, scaled to the unwanted part of the spectrum
(from a Lanczos bound to the smallest Ritz value of the block), stays small there and grows fast above. QR makes the block orthonormal and
Rayleigh-Ritz turns it to the best approximations of eigenvectors. Rounds end when every wanted residual ``|V q - e q|`` is
certified to be at rounding level.

Entries become whole numbers first (``floor(scale * c) + shift``), so sums and deviations are exact whatever the order of the rows, and
``n * x - S`` is centred without error before anything is multiplied.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are entries whose whole number
does not fit into 62 bits; if lengths differ, vectors of the most frequent length stay (ties: the longest); equal rows count each;
a null id stays null; components whose eigenvalue is zero to rounding are left out, so equal vectors, a single vector or an empty
table give no rows; a deviation beyond a long is null; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanflow.llm.common import staged, table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
# Columns of the block besides the wanted ones; the filter separates the wanted from what lies beyond all of these.
GUARDS = 24
DEGREE = 8
MAX_ROUNDS = 60
SEED = 7


# --- vectors ------------------------------------------------------------------------------


def whole_vectors(embeddings: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x``: the rows that count, with entries as whole numbers; staged."""
    entries = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    limit = float(1 << 62)
    fits = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) * scale < limit, F.lit(False)))
    rows = embeddings.select("vec_id", F.when(fits, F.transform(entries, lambda x: x.cast("long") + shift)).alias("x"))
    rows = staged(rows.where(F.size("x") > 0))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).take(2)
    return rows.where(F.size("x") == lengths[0]["d"]) if len(lengths) > 1 else rows


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


@dataclass(frozen=True)
class Centre:
    """Number of vectors and exact sums, as every task needs them; its size depends on the dimension alone."""

    n: int
    sums: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]

    def offsets(self) -> list[int]:
        """The largest distance ``|n * x - S|`` of any dimension bounds all products."""
        return [
            max(abs(self.n * lo - s), abs(self.n * hi - s)) for s, lo, hi in zip(self.sums, self.low, self.high, strict=True)
        ]


def centre_of(vectors: DataFrame) -> Centre | None:
    """Sums in halves of 31 bits, so that no task overflows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, tops, rests, low, high = 0, 0, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            n += len(x)
            tops = tops + (x >> 31).sum(axis=0)
            rests = rests + (x & ((1 << 31) - 1)).sum(axis=0)
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict(
                {"i": np.arange(len(low)), "n": np.full(len(low), n), "top": tops, "rest": rests, "low": low, "high": high}
            )

    parts = vectors.select("x").mapInArrow(summed, "i long, n long, top long, rest long, low long, high long")
    rows = (
        parts.groupBy("i")
        .agg(F.sum("n").alias("n"), F.sum("top").alias("top"), F.sum("rest").alias("rest"), F.min("low").alias("low"), F.max("high").alias("high"))
        .collect()
    )
    rows.sort()
    if not rows:
        return None
    return Centre(
        rows[0]["n"], tuple((r["top"] << 31) + r["rest"] for r in rows),
        tuple(r["low"] for r in rows), tuple(r["high"] for r in rows),
    )


class Centred:
    """Rows minus the mean: ``(n * x - S) / n``, exact up to the division wherever 64 bits hold it."""

    def __init__(self, centre: Centre):
        self.n = centre.n
        widest = max(max(map(abs, centre.low)), max(map(abs, centre.high)))
        self.exact = max(centre.n * widest, *map(abs, centre.sums), *centre.offsets()) < 1 << 62
        self.sums = np.array(centre.sums, np.int64 if self.exact else object)
        self.squares_fit = self.exact and sum(m * m for m in centre.offsets()) < 1 << 63

    def numerators(self, x: np.ndarray) -> np.ndarray:
        return self.n * (x if self.exact else x.astype(object)) - self.sums

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n if self.exact else (self.numerators(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        parts = self.numerators(x)
        if self.squares_fit:
            return (parts * parts).sum(axis=1).tolist()
        totals = (sum(int(v) ** 2 for v in row) for row in parts.tolist())
        return [t if t < 1 << 63 else None for t in totals]


# --- passes -------------------------------------------------------------------------------


def added_up(parts: DataFrame, width: int) -> np.ndarray:
    """Blocks of all tasks, summed by row number ``i``; the driver gets one row per ``i``."""
    sums = parts.groupBy("i").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(width)])
    return np.array(sorted(tuple(r) for r in sums.collect()), np.float64)[:, 1:]


def covariance_times(vectors: DataFrame, centre: Centre, block: np.ndarray) -> np.ndarray:
    """``V block`` in a pass over the vectors."""
    centred = Centred(centre)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                c = centred.rows(matrix(batch.column(0)))
                part = c.T @ (c @ block)
                total = part if total is None else total + part
        if total is not None:
            values = pa.array(list(total), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), values], ["i", "v"])

    parts = vectors.select("x").mapInArrow(multiplied, "i long, v array<double>")
    return added_up(parts, block.shape[1]) / centre.n


def total_variance(vectors: DataFrame, centre: Centre) -> float:
    centred = Centred(centre)

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = centred.rows(matrix(batch.column(0)))
                yield pa.RecordBatch.from_pydict({"s": [math.fsum((c * c).sum(axis=1))]})

    return (vectors.select("x").mapInArrow(squared, "s double").agg(F.sum("s")).first()[0] or 0.0) / centre.n


# --- iteration ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Spectrum:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int
    rounds: int


def turned(block: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz in the orthonormal ``block`` whose image is ``V block``: values (falling), vectors, their images."""
    small = block.T @ image
    values, basis = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1]
    return values[order], block @ basis[:, order], image @ basis[:, order]


class LowerEnd:
    """Lanczos steps that ride along as one more column of the passes and bound the spectrum from below."""

    def __init__(self, d: int):
        start = np.random.default_rng(SEED + 1).standard_normal(d)
        self.basis, self.diagonal, self.beside = [start / np.linalg.norm(start)], [], []

    def column(self) -> np.ndarray:
        return self.basis[-1][:, None]

    def step(self, image: np.ndarray) -> None:
        if self.beside and self.beside[-1] == 0:
            return
        self.diagonal.append(float(self.basis[-1] @ image))
        known = np.array(self.basis).T
        rest = image - known @ (known.T @ image)
        rest -= known @ (known.T @ rest)
        size = float(np.linalg.norm(rest))
        # Nothing new: the space of the start vector is exhausted.
        self.beside.append(size if size > 1e-10 * np.linalg.norm(image) else 0.0)
        if self.beside[-1]:
            self.basis.append(rest / size)

    def bound(self) -> float:
        """The smallest Ritz value less the size of what is left over; 0 before any step."""
        if not self.diagonal:
            return 0.0
        off = self.beside[: len(self.diagonal) - 1]
        return max(0.0, float(np.linalg.eigvalsh(np.diag(self.diagonal) + np.diag(off, 1) + np.diag(off, -1))[0]) - self.beside[-1])


def leading_spectrum(multiply, d: int, wanted: int, trace: float, guards: int = GUARDS, degree: int = DEGREE) -> Spectrum:
    """The ``wanted`` largest eigenvalues and their vectors of the d x d matrix behind ``multiply(block)``.

    A residual r puts an eigenvalue within r of the Ritz value and the vector within r over the gap to the others, so the iteration
    goes on until residuals are certified to be below ``floor``, or, near it, no longer fall.
    """
    width = min(d, wanted + guards)
    block = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, width)))[0]
    image, passes, rounds = multiply(block), 1, 0
    values, block, image = turned(block, image)
    lower = LowerEnd(d)
    floor, best, stalled = 2 * np.finfo(float).eps * math.sqrt(d), math.inf, 0
    while True:
        residuals = np.linalg.norm(image[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0)
        worst = residuals.max() / max(values[0], trace / d, np.finfo(float).tiny)
        stalled = 0 if worst < best / 2 else stalled + 1
        best = min(best, worst)
        if worst <= floor or (worst <= floor * 64 and stalled) or rounds == MAX_ROUNDS or width == d:
            break
        rounds += 1
        # Chebyshev polynomials on the unwanted interval, scaled to 1 at the largest Ritz value so that nothing overflows.
        edge, bottom = max(values[-1], np.finfo(float).eps * trace), lower.bound()
        bottom = bottom if bottom < 0.99 * edge else 0.0
        half, middle = (edge - bottom) / 2, (edge + bottom) / 2
        sigma = first = half / (values[0] - middle)
        older, newer = block, (image - middle * block) * (sigma / half)
        for _ in range(degree - 1):
            following = 1 / (2 / first - sigma)
            product = multiply(np.hstack((newer, lower.column())) if rounds == 1 else newer)
            if rounds == 1:
                lower.step(product[:, -1])
                product = product[:, :-1]
            older, newer = newer, (product - middle * newer) * (2 * following / half) - sigma * following * older
            sigma = following
            passes += 1
        block = np.linalg.qr(newer)[0]
        image = multiply(block)
        passes += 1
        values, block, image = turned(block, image)
    if worst > 1e-6:
        raise ArithmeticError(f"eigenvectors not certified after {rounds} rounds: residual {worst:.1e}")
    return Spectrum(values[:wanted], block[:, :wanted], residuals, passes, rounds)


# --- operator -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """Fitted on all vectors: ``apply`` gives their whitened coordinates."""

    centre: Centre
    spectrum: Spectrum
    trace: float
    identity_error: float


def projected(vectors: DataFrame, centre: Centre, spectrum: Spectrum) -> DataFrame:
    """``vec_id, deviation, whitened array<double>``."""
    centred, basis = Centred(centre), spectrum.vectors / np.sqrt(spectrum.values)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(centred.deviations(x), pa.int64()),
                     pa.array(list(centred.rows(x) @ basis), pa.list_(pa.float64()))],
                    ["vec_id", "deviation", "whitened"],
                )

    return vectors.select("vec_id", "x").mapInArrow(mapped, "vec_id long, deviation long, whitened array<double>")


def fitted(vectors: DataFrame, components: int = COMPONENTS, guards: int = GUARDS, degree: int = DEGREE) -> Whitening | None:
    """Fit on ``whole_vectors``; None if nothing varies."""
    centre = centre_of(vectors)
    if centre is None or not any(centre.offsets()):
        return None
    trace, d = total_variance(vectors, centre), len(centre.sums)
    found = leading_spectrum(
        lambda block: covariance_times(vectors, centre, block), d, min(components, d), trace, guards, degree
    )
    real = found.values > 64 * np.finfo(float).eps * trace
    found = Spectrum(found.values[real], found.vectors[:, real], found.residuals[real], found.passes, found.rounds)
    # The covariance of the whitened coordinates: their means first, then products of what is left.
    white = projected(vectors, centre, found)
    k = int(real.sum())
    means = np.array(white.agg(*[F.avg(F.col("whitened")[j]) for j in range(k)]).first(), np.float64)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = matrix(batch.column(0)) - means
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(k)), pa.array(list(w.T @ w), pa.list_(pa.float64()))], ["i", "v"]
                )

    covariance = added_up(white.select("whitened").mapInArrow(crossed, "i long, v array<double>"), k) / centre.n
    return Whitening(centre, found, trace, float(np.abs(covariance - np.eye(k)).max()))


def whitened(vectors: DataFrame, fit: Whitening | None) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(e / fit.trace)) for e in fit.spectrum.values])
    rows = projected(vectors, fit.centre, fit.spectrum)
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit.centre.n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(fit.identity_error).alias("identity_error"),
    )


def op13_chebyshev_whitening(spark, sf_dir):
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return whitened(vectors, fitted(vectors))
