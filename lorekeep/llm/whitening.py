"""Embedding whitening by a covariance made in two passes over distinct vectors.

Entries become whole numbers first, so the sums of the first pass, and with
them the mean, are exact.  The second pass centres each block of vectors and
sums outer products by one matrix product a block.  Both are merged by
``treeAggregate``, so the driver adds up a few matrices of dimension squared,
however many partitions there are.  A symmetric eigensolver gives components,
and their projection is broadcast to all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import fresh, stored

#: Entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries of this size and more do not fit whole numbers with room for differences; their rows are dropped like non-finite ones.
MOST = float(1 << 54)
#: Eigenvalues up to this times dimension times the greatest are rounding of zero.
ZERO = 16 * np.finfo(np.float64).eps
#: Depth of the tree of merges.
DEPTH = 3


@dataclass(frozen=True)
class Whitening:
    """What was learned from the vectors of one dimension."""

    n: int  # distinct vectors
    sums: tuple[int, ...]  # of each entry, exact
    values: np.ndarray  # eigenvalues of the covariance that are not zero, falling
    components: np.ndarray  # their unit vectors, a column each
    trace: float
    identity_error: float = 0.0  # measured: the whitened vectors' covariance against the identity

    @property
    def whole_mean(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """sums - n * whole_mean, from 0 to n - 1."""
        return np.array([s % self.n for s in self.sums], np.int64)

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole numbers first, the fraction last."""
        return (x - self.whole_mean).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """For each row the sum of (n x - sums) squared, exact."""
        apart = x - self.whole_mean
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if len(self.sums) * most * most < 1 << 63:
            return ((self.n * apart - self.rest) ** 2).sum(axis=1).tolist()
        apart = apart.astype(object) * self.n - self.rest.astype(object)
        return (apart * apart).sum(axis=1).tolist()


def whole_numbers(vector: Column) -> Column:
    """The vector in whole numbers; null if it is null or has entries that are null, not finite or too large."""
    ok = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < MOST, F.lit(False)))
    return F.when(vector.isNotNull() & ok, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")))


def _blocks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each dimension in a batch: rows' places, and their vectors as a matrix."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, flat[begin[at][:, None] + np.arange(d)[None, :]].reshape(len(at), d)


def _merged(fit: DataFrame, partial: Callable[[np.ndarray], np.ndarray | None]) -> dict[int, np.ndarray]:
    """Sums ``partial`` (dimension-wise: vectors -> array) over all vectors of the fit list."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _blocks(b.column(0)):
                if (one := partial(x)) is not None:
                    held[x.shape[1]] = held[x.shape[1]] + one if x.shape[1] in held else one
        for d, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([v.dtype.str]), pa.array([v.tobytes()], pa.binary())], names=["d", "kind", "data"])

    def add(total: dict, row) -> dict:
        v = np.frombuffer(bytes(row["data"]), np.dtype(row["kind"]))
        return both(total, {row["d"]: v.astype(object) if v.dtype == np.int64 else v})

    def both(a: dict, b: dict) -> dict:
        return {d: a[d] + b[d] if d in a and d in b else a.get(d, b.get(d)) for d in {**a, **b}}

    parts = fit.mapInArrow(summed, "d int, kind string, data binary")
    return parts.rdd.treeAggregate({}, add, both, DEPTH)


def _sums(x: np.ndarray) -> np.ndarray:
    """Rows, and the sums of entries as high and low 32 bits, which do not overflow."""
    return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]).astype(np.int64)


def fit_whitening(vectors: DataFrame, vector_col: str, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A Whitening for each dimension of the given vectors (whole numbers), each distinct one once.

    At most ``components`` of them, fewer if the covariance has a smaller
    rank.  Equal vectors are put together in partial aggregates before they
    move, so a vector that a third of all rows share is one row a task.
    """
    fit = stored(vectors.filter(vectors[vector_col].isNotNull()).groupBy(F.col(vector_col).alias("x")).agg(F.lit(1).alias("one")).select("x"), "vectors")
    models: dict[int, Whitening] = {}
    for d, v in _merged(fit, lambda x: _sums(x) if x.shape[1] else None).items():
        sums = tuple(int(h) * (1 << 32) + int(low) for h, low in zip(v[1 : d + 1], v[d + 1 :], strict=True))
        models[d] = Whitening(int(v[0]), sums, np.empty(0), np.empty((d, 0)), 0.0)

    def outer(x: np.ndarray) -> np.ndarray | None:
        if (own := models.get(x.shape[1])) is None:
            return None
        c = own.centred(x)
        return (c.T @ c).ravel()

    made: dict[int, Whitening] = {}
    for d, v in _merged(fit, outer).items():
        own = models[d]
        values, vectors_ = np.linalg.eigh(v.reshape(d, d) / own.n)
        values, vectors_ = values[::-1], vectors_[:, ::-1]
        k = min(components, int((values > ZERO * d * max(values[0], 0.0)).sum()))
        made[d] = Whitening(own.n, own.sums, values[:k].copy(), vectors_[:, :k].copy(), float(np.trace(v.reshape(d, d)) / own.n))

    def after(x: np.ndarray) -> np.ndarray | None:
        own = made.get(x.shape[1])
        if own is None or not len(own.values):
            return None
        y = own.centred(x) @ own.projection
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    for d, v in _merged(fit, after).items():
        own = made[d]
        k = len(own.values)
        mean = v[:k] / own.n
        error = np.abs(v[k:].reshape(k, k) / own.n - np.outer(mean, mean) - np.eye(k)).max()
        made[d] = Whitening(own.n, own.sums, own.values, own.components, own.trace, float(error))
    return made


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fits on all distinct vectors of rows and whitens every row.

    Returns the id (under its name), ``n`` (distinct vectors), ``deviation``,
    ``deviation_text`` (its digits where it passes 64 bits, where ``deviation``
    is null), ``whitened`` and ``explained`` (an entry for each component) and
    ``identity_error`` (measured on the fit list).

    Rows are dropped whose vector is null, or has an entry that is null, not
    finite, or 2 ** 54 and more in size.  Vectors of different dimensions are
    fitted apart.  Directions without variance have no component; if there are
    none (one distinct vector, empty vectors) the arrays are empty.  Null and
    repeated ids, and repeated rows, are rows like any other; other columns are
    not read, whatever their names; an empty table gives no rows.
    """
    vec = fresh([id_col], "_x")
    ready = rows.select(rows[id_col].alias(id_col), whole_numbers(rows[vector_col]).alias(vec)).filter(F.col(vec).isNotNull())
    models = rows.sparkSession.sparkContext.broadcast(fit_whitening(ready, vec, components))
    kind = ready.schema[id_col].dataType
    names = [id_col, *(fresh([id_col], x) for x in ("n", "deviation", "deviation_text", "whitened", "explained", "identity_error"))]
    lists, number = T.ArrayType(T.DoubleType()), T.LongType()
    shape = T.StructType([T.StructField(n, k) for n, k in zip(names, (kind, number, number, T.StringType(), lists, lists, T.DoubleType()), strict=True)])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _blocks(b.column(1)):
                own = models.value.get(x.shape[1])
                if own is None:  # empty vectors
                    continue
                k, m = len(own.values), len(at)
                far = own.deviations(x)
                fits = [v if v < 1 << 63 else None for v in far]
                text = [None if v < 1 << 63 else str(v) for v in far]
                places = pa.array(np.arange(m + 1, dtype=np.int32) * k)
                y = own.centred(x) @ own.projection if k else np.empty((m, 0))
                share = np.tile(own.values / own.trace if k else np.empty(0), m)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array([own.n] * m, pa.int64()), pa.array(fits, pa.int64()), pa.array(text, pa.string()),
                     pa.ListArray.from_arrays(places, pa.array(y.ravel())), pa.ListArray.from_arrays(places, pa.array(share)), pa.array([own.identity_error] * m)], names=names
                )

    return ready.mapInArrow(applied, shape)
