"""Whitening of embeddings by an exact covariance from variances alone (polarisation).

An entry c counts as the long x = floor(1024 c) + 100000. The covariance of two dimensions is
(Var(i + j) - Var(i) - Var(j)) / 2, so only squares are aggregated: of every dimension and of every
sum of two dimensions, centred about the whole number next to the mean, in exact integers. What the
centring leaves is taken off exactly, and each covariance is rounded once, to a double. ``eigh`` of
the assembled matrix (dimensions x dimensions, whatever the number of rows) gives the components.

Passes over the vectors: lengths, sums, squares, projection. A task hands over one row a pair of
dimensions, which Spark adds up; no vector leaves its task, and nothing is grouped by vector.

Defined cases: vectors that are null, or hold null or non-finite entries, are dropped; so are those
whose length is not the commonest (of equally common ones the greatest counts). x saturates at
+-2**53. Rows with equal or null id are whitened one by one. A component without variance has null
whitened values and is left out of ``identity_error``; without any variance ``explained`` is null. A
deviation beyond a long is null. No vectors, or vectors without entries, give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

SCALE, SHIFT = 1024, 100_000
MOST = float(1 << 53)
#: An eigenvalue below this share of the trace is rounding, not variance.
NO_VARIANCE = 1e-13
EXACT = pa.decimal128(38, 0)
LONG = 1 << 63


def usable(vec: Column) -> Column:
    """Not null, no null and no non-finite entry."""
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & finite, F.lit(False))


def whole_numbers(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) of x from an Arrow list array."""
    c = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    return np.clip(np.floor(c * SCALE) + SHIFT, -MOST, MOST).astype(np.int64)


def squares(y: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of y_i^2 (on the diagonal) and (y_i + y_j)^2 (above it), as Python numbers."""
    rows, dims = y.shape
    out = np.zeros((dims, dims), object)
    most = int(np.abs(y).max(initial=0))
    if 4 * most * most * max(rows, 1) >= LONG:      # too large for a long: numbers of any size
        y = y.astype(object)
    for i in range(dims):
        out[i, i] = int((y[:, i] * y[:, i]).sum())
        both = y[:, i:i + 1] + y[:, i + 1:]
        out[i, i + 1:] = [int(v) for v in (both * both).sum(axis=0)]
    return out


def covariance(n: int, left: list[int], total: np.ndarray) -> np.ndarray:
    """Of ``n`` rows with sums ``left`` and ``squares`` ``total`` about the same centre; divisor n."""
    dims = len(left)
    spread = [n * int(total[i, i]) - left[i] ** 2 for i in range(dims)]      # n^2 Var, exact
    out = np.empty((dims, dims))
    for i in range(dims):
        out[i, i] = spread[i] / (n * n)
        for j in range(i + 1, dims):
            both = n * int(total[i, j]) - (left[i] + left[j]) ** 2
            out[i, j] = out[j, i] = (both - spread[i] - spread[j]) / (2 * n * n)
    return out


@dataclass
class Whitening:
    n: int
    centre: np.ndarray      # whole numbers next to the means
    left: list[int]         # sums of x - centre
    trace: float
    values: np.ndarray      # falling eigenvalues
    axes: np.ndarray        # (dims, components), unit columns

    @property
    def dims(self) -> int:
        return len(self.left)

    def sound(self) -> np.ndarray:
        return self.values > NO_VARIANCE * self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """(rows, components) of whitened values, NaN for a component without variance."""
        off = (x - self.centre) - np.array([s / self.n for s in self.left])
        sound = self.sound()
        w = off @ self.axes / np.sqrt(np.where(sound, self.values, 1.0))
        w[:, ~sound] = np.nan
        return w

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exact; None beyond a long."""
        y = x - self.centre
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.left), default=0)
        if most * most * self.dims >= LONG:
            y = y.astype(object)
            z = self.n * y - np.array(self.left, object)
        else:
            z = self.n * y - np.array(self.left, np.int64)
        return [v if v < LONG else None for v in map(int, (z * z).sum(axis=1))]


def _add_up(vectors: DataFrame, dims: int, part) -> dict[tuple[int, int], int]:
    """Sums over all tasks of ``part(x)``, an (a, b) array of whole numbers; zero entries may be missing."""

    def run(batches):
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                one = part(whole_numbers(batch.column(0).slice(lo, 1024), dims))
                total = one if total is None else total + one
        if total is not None:
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in total[i, j]], EXACT)],
                ["i", "j", "s"])

    sums = map_arrow(vectors, run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return {(r["i"], r["j"]): int(r["s"]) for r in sums.collect()}      # dims x dims at most


def fit(vectors: DataFrame, components: int = 8, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None if there are none."""
    usable_ones = vectors.select(F.col(vec_col).alias("v")).where(usable(F.col("v")))
    lengths = usable_ones.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths or lengths[0]["d"] == 0:
        return None
    dims, n = lengths[0]["d"], lengths[0]["count"]
    same = usable_ones.where(F.size("v") == dims)
    sums = _add_up(same, dims, lambda x: x.sum(axis=0, dtype=object)[None, :])
    s = [sums.get((0, i), 0) for i in range(dims)]
    centre = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    left = [v - n * int(c) for v, c in zip(s, centre)]
    found = _add_up(same, dims, lambda x: squares(x - centre))
    total = np.zeros((dims, dims), object)
    for at, v in found.items():
        total[at] = v
    cov = covariance(n, left, total)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    lead = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    return Whitening(n, centre, left, float(np.trace(cov)), np.maximum(values, 0.0), axes * np.where(lead < 0, -1.0, 1.0))


def project(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, deviation, w): every usable vector, ``w`` its whitened components."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).where(
        usable(F.col("v")) & (F.size("v") == model.dims))

    def run(batches):
        for batch in batches:
            x = whole_numbers(batch.column(1), model.dims)
            w = model.project(x)
            ends = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                ["vec_id", "deviation", "w"])

    return map_arrow(rows, run, f"vec_id {kind}, deviation bigint, w array<double>")


def identity_error(projected: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of ``w`` (centred, divisor n) minus the identity."""
    sound = [int(k) for k in np.nonzero(model.sound())[0]]
    if not sound:
        return None
    w = {k: F.col("w")[k] for k in sound}
    mean = projected.agg(*[F.avg(w[k]).alias(f"m{k}") for k in sound]).first()
    pairs = [(a, b) for a in sound for b in sound if a <= b]
    cov = projected.agg(*[(F.sum((w[a] - mean[f"m{a}"]) * (w[b] - mean[f"m{b}"])) / model.n).alias(f"c{a}_{b}")
                          for a, b in pairs]).first()
    return max(abs(cov[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    model = fit(vectors, components, vec_col)
    if model is None:
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    projected = materialize(project(vectors, model, id_col, vec_col), "whitened")
    error = identity_error(projected, model)
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
    share = F.array(*[F.lit(v).cast("double") for v in explained])
    return projected.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
