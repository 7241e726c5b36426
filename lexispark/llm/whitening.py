"""Whitening of embeddings: the covariance of exactly centred vectors, its main axes, and the projections on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import drop_stored, spread, stored

_LONG = 2**63


def whole_numbers(vector: str, scale: float = 256.0) -> Column:
    """floor(scale * entry) of each entry as a long; null for a vector that is null or has an entry that is null, not
    finite or beyond a long."""
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda c: c * F.lit(scale))
    fits = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < F.lit(float(_LONG)), F.lit(False)))
    return F.when(fits, F.transform(scaled, lambda c: F.floor(c).cast("long")))


def _matrix(column: pa.Array | pd.Series, size: int) -> np.ndarray:
    flat = np.concatenate(column.to_numpy()) if isinstance(column, pd.Series) else column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(-1, size)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each length of vectors in this task: rows, sums and the largest absolute value by dimension, as exact numbers."""
    sums: dict[int, list] = {}
    for b in batches:
        sizes = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            x = _matrix(b.column(0).filter(pa.array(sizes == size)), size)
            most = np.maximum(x.max(axis=0).astype(object), -x.min(axis=0).astype(object))
            total = x.sum(axis=0) if max(most) * len(x) < _LONG else x.astype(object).sum(axis=0)
            own = sums.setdefault(size, [0, np.zeros(size, dtype=object), np.zeros(size, dtype=object)])
            sums[size] = [own[0] + len(x), own[1] + total.astype(object), np.maximum(own[2], most)]
    for size, (n, total, most) in sums.items():
        exact = [pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0)) for values in (total, most)]
        yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), *exact], names=["size", "at", "n", "total", "most"])


@dataclass
class Whitening:
    """What vectors of one length are projected with; `scales` is 0 for an axis without variance."""

    n: int
    sums: list[int]
    most: int
    axes: np.ndarray  # a column for each component
    scales: np.ndarray  # square roots of the eigenvalues
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def bound(self) -> int:
        """No |n * x - sum| of a fitted vector is larger."""
        return self.n * self.most + max(map(abs, self.sums))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: longs where the bound allows, else Python's numbers."""
        if self.bound < _LONG:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.scales > 0, (centred.astype(np.float64) / self.n) @ self.axes / self.scales, np.nan)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        if centred.shape[1] * self.bound**2 < _LONG:
            return (centred**2).sum(axis=1).tolist()
        exact = (centred.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < _LONG else None for v in exact]


def _fit(own: DataFrame, n: int, sums: list[int], most: int, components: int) -> Whitening:
    """own: the distinct vectors of one length."""
    size = len(sums)
    wide = "long" if n * most + max(map(abs, sums)) < _LONG else "decimal(38,0)"
    middle = F.array(*(F.lit(s if wide == "long" else Decimal(s)).cast(wide) for s in sums))
    times = F.lit(n if wide == "long" else Decimal(n)).cast("long" if wide == "long" else "decimal(19,0)")
    deviation = F.transform("x", lambda c, i: (c.cast("long" if wide == "long" else "decimal(19,0)") * times - F.get(middle, i)).cast("double") / F.lit(float(n)))
    rows = MLUtils.convertVectorColumnsFromML(own.select(array_to_vector(deviation).alias("row")), "row")
    gram = RowMatrix(rows, n, size).computeGramianMatrix().toArray()
    covariance = (gram + gram.T) / (2.0 * n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    there = values > max(values[0], 0.0) * size * np.finfo(float).eps
    values = np.where(there, values, 0.0)
    return Whitening(n, sums, most, axes, np.sqrt(values), [float(v) / trace if trace > 0 else None for v in values])


def _identity_error(own: DataFrame, fit: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the fitted vectors' projections, less the identity."""
    there = np.flatnonzero(fit.scales > 0).tolist()
    if not there:
        return None
    sent, size = own.sparkSession.sparkContext.broadcast(fit), len(fit.sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                y = sent.value.project(sent.value.centred(_matrix(b["x"], size)))
                yield pd.DataFrame({f"y{k}": y[:, k] for k in there})

    white = own.mapInPandas(run, ", ".join(f"y{k} double" for k in there))
    middle = white.agg(*(F.avg(f"y{k}").alias(f"y{k}") for k in there)).first()
    apart = {k: F.col(f"y{k}") - F.lit(middle[f"y{k}"]) for k in there}
    pairs = [(a, b) for a in there for b in there if a <= b]
    found = white.agg(*(F.avg(apart[a] * apart[b]).alias(f"{a}_{b}") for a, b in pairs)).first()
    return max(abs(found[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def fit_whitening(x: DataFrame, components: int = 4) -> dict[int, Whitening]:
    """x (x array<long>, without nulls) -> the whitening of each length of vectors, from its distinct vectors.

    Sums are exact; a vector less the mean is (n * x - sum) / n, rounded once at the end, so a common offset of any size
    costs no digits. RowMatrix adds up the outer products in the executors by a tree; its sum, of size x size numbers,
    and the axes are all that the driver gets. Eigenvectors have their largest entry positive."""
    distinct = stored(x.where(F.size("x") > 0).select("x").distinct(), "fit")
    parts = distinct.mapInArrow(_partial_sums, "size int, at int, n long, total decimal(38,0), most decimal(38,0)")
    found = parts.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))
    by: dict[int, list] = {}
    for r in found.collect():
        by.setdefault(r["size"], []).append((r["at"], int(r["n"]), int(r["total"]), int(r["most"])))
    out = {}
    for size, rows in by.items():
        rows.sort()
        own = distinct.where(F.size("x") == size)
        fit = out[size] = _fit(own, rows[0][1], [r[2] for r in rows], max(r[3] for r in rows), components)
        fit.identity_error = _identity_error(own, fit)
    drop_stored(distinct)
    return out


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = 4, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each vector on the main axes of all of them: vec_id, component (from 1, by falling variance), n, deviation,
    whitened, explained, identity_error.

    Entries become floor(scale * entry). Vectors that are null or have entries that are null, not finite or beyond a long
    are left out. The axes are fitted to the distinct vectors, so copies weigh nothing, but all rows are returned, those
    with a null or repeated vec_id too. Vectors of another length are a space of their own with axes of its own; empty
    ones have no axis and no row. An axis without variance (no more than rounding errors of the first one's) has a null
    `whitened` and explains 0; where nothing varies `explained` and `identity_error` are null. `deviation`, the sum of
    (n * x - sum)^2, is null where it exceeds a long. Other columns are ignored; an empty table gives an empty result."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(vector, scale).alias("x")).where("x is not null")
    fits = vectors.sparkSession.sparkContext.broadcast(fit_whitening(x, components))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["x"].map(len).to_numpy()
            for size, fit in fits.value.items():
                own = b[sizes == size]
                if not len(own):
                    continue
                centred = fit.centred(_matrix(own["x"], size))
                y, k = fit.project(centred), len(fit.explained)
                yield pd.DataFrame(
                    {
                        "vec_id": np.repeat(own["vec_id"].astype("Int64").array, k),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(own)),
                        "n": fit.n,
                        "deviation": pd.array(fit.deviations(centred), "Int64").repeat(k),
                        "whitened": pd.array(y.ravel(), "Float64"),
                        "explained": pd.array(fit.explained * len(own), "Float64"),
                        "identity_error": pd.array([fit.identity_error] * (k * len(own)), "Float64"),
                    }
                )

    return spread(x).mapInPandas(run, _RESULT)
