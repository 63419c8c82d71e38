"""Whitening of embeddings by a polarisation covariance.

Vectors become integers, and all sums over rows are exact. A task adds up the
squares of each centred dimension and of each centred sum of two dimensions;
the covariance of two dimensions is half of what the variance of their sum has
over both variances. Tasks hand over sums in 40-bit limbs, so no sum rounds or
overflows, and only those of one dimension pair each reach the driver, D * D / 2
of them whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Scaled entries saturate at this absolute value.
MOST = 1 << 61
#: Sums are handed over in limbs of so many bits; squares of sums of two entries over 2^34 rows fit.
LIMB, LIMBS = 40, 4
#: Centred entries below this are squared and added in 64 bits.
SMALL = 1 << 20
#: Eigenvalues up to this share of the trace are rounding: such a component has no variance.
NO_VARIANCE = 1e-13


def matrices(col: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and integers x of the usable vectors of a batch, for each length."""
    offsets, flat = np.asarray(col.offsets).astype(np.int64), col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    size = np.diff(offsets)
    ok = np.asarray(col.is_valid()) & (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    for d in np.unique(size[ok]):
        rows = np.flatnonzero(ok & (size == d))
        with np.errstate(over="ignore"):
            c = np.clip(np.floor(SCALE * flat[offsets[rows][:, None] + np.arange(d)]), -float(MOST), float(MOST))
        yield int(d), rows, c.astype(np.int64) + SHIFT


def _limbs(sums: np.ndarray) -> list[list[int]]:
    """Python integers as LIMBS arrays of longs; the last limb keeps the sign."""
    out, rest = [], [int(v) for v in sums]
    for _ in range(LIMBS - 1):
        out.append([v & ((1 << LIMB) - 1) for v in rest])
        rest = [v >> LIMB for v in rest]
    return [*out, rest]


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of limbs, each a decimal, by ``keys``, from rows with arrays l0, l1, ... over j."""
    each = F.arrays_zip(*[f"l{k}" for k in range(LIMBS)])
    rows = parts.select(*keys, "n", F.posexplode(each).alias("j", "l"))
    return rows.groupBy(*keys, "j").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"l.l{k}").cast("decimal(20,0)")).alias(f"l{k}") for k in range(LIMBS)])


def _whole(row: dict) -> int:
    return sum(int(row[f"l{k}"]) << (LIMB * k) for k in range(LIMBS))


_PARTS = "size int, i int, n long, " + ", ".join(f"l{k} array<long>" for k in range(LIMBS))


def _part(size: int, i: int, n: int, sums: np.ndarray) -> dict:
    return {"size": size, "i": i, "n": n, **{f"l{k}": v for k, v in enumerate(_limbs(sums))}}


def _batch(parts: list[dict]) -> pa.RecordBatch:
    kinds = [("size", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), *[(f"l{k}", pa.list_(pa.int64())) for k in range(LIMBS)]]
    return pa.RecordBatch.from_pylist(parts, pa.schema(kinds))


def totals(vectors: DataFrame) -> tuple[int, int, list[int]] | None:
    """Rows n, dimensions and exact sums S of the usable vectors; their length is the commonest, the smaller of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for d, rows, x in matrices(b.column(0)):
                own = held.setdefault(d, [0, np.zeros(d, object)])
                own[0] += len(rows)
                own[1] += (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
        yield _batch([_part(d, 0, n, s) for d, (n, s) in held.items()])

    sums = _added(vectors.mapInArrow(run, _PARTS), ["size"])
    top = sums.where("j = 0").orderBy(F.desc("n"), "size").select("size", "n").limit(1).collect()
    if not top:
        return None
    d, n = top[0]
    s = {r["j"]: _whole(r) for r in sums.where(F.col("size") == d).collect()}
    return n, d, [s[j] for j in range(d)]


def pair_squares(z: np.ndarray) -> list[np.ndarray]:
    """Row i: exact sums of z_i squared, then of (z_i + z_j) squared for each j after i."""
    if np.abs(z).max(initial=0) >= SMALL or len(z) > 1 << 20:
        z = z.astype(object)
    out = []
    for i in range(z.shape[1]):
        t = z[:, i:] + z[:, i : i + 1]
        t[:, 0] = z[:, i]
        out.append((t * t).sum(axis=0) if z.dtype == object else np.einsum("ij,ij->j", t, t))
    return out


def polarised(vectors: DataFrame, n: int, d: int, s: list[int]) -> list[list[int]]:
    """n * n times the covariance matrix, exact."""
    centre = np.array([_near(v, n) for v in s], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(d - i, object) for i in range(d)]
        for b in batches:
            for size, _, x in matrices(b.column(0)):
                if size == d:
                    for own, add in zip(held, pair_squares(x - centre)):
                        own += add.astype(object)
        yield _batch([_part(d, i, 0, own) for i, own in enumerate(held)])

    q = {(r["i"], r["i"] + r["j"]): _whole(r) for r in _added(vectors.mapInArrow(run, _PARTS), ["i"]).collect()}
    rest = [v - n * int(c) for v, c in zip(s, centre)]
    own = [n * q[i, i] - rest[i] ** 2 for i in range(d)]
    cov = [[0] * d for _ in range(d)]
    for i in range(d):
        cov[i][i] = own[i]
        for j in range(i + 1, d):
            cov[i][j] = cov[j][i] = (n * q[i, j] - (rest[i] + rest[j]) ** 2 - own[i] - own[j]) // 2
    return cov


def _near(v: int, n: int) -> int:
    return (2 * v + n) // (2 * n)


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: integer sums, and the first components with their eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([_near(v, self.n) for v in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        return [v - self.n * int(c) for v, c in zip(self.sums, self.centre)]

    def project(self) -> Callable[[np.ndarray], np.ndarray]:
        """Integers centred at ``centre`` -> whitened components; NaN for a component without variance."""
        shift = np.array([r / self.n for r in self.rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            w = self.axes / np.where(self.values > NO_VARIANCE * self.trace, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return lambda z: (z.astype(np.float64) - shift) @ w

    def deviation(self, z: np.ndarray) -> list[int]:
        """Exact sums over dimensions of (n * x - S) squared."""
        rest = np.array(self.rest, object)
        if np.abs(z).max(initial=0) < SMALL and self.n < 1 << 62 - 20 - z.shape[1].bit_length():
            squares, cross = np.einsum("ij,ij->i", z, z), z @ rest.astype(np.int64)
        else:
            z = z.astype(object)
            squares, cross = (z * z).sum(axis=1), (z * rest).sum(axis=1)
        last = int((rest * rest).sum())
        return [self.n * self.n * a - 2 * self.n * b + last for a, b in zip(squares.tolist(), cross.tolist())]


def fit(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors; None if there are none."""
    vectors = table.select(vector)
    found = totals(vectors)
    if not found:
        return None
    n, d, s = found
    cov = np.array([[v / (n * n) for v in row] for row in polarised(vectors, n, d, s)])
    values, axes = np.linalg.eigh(cov)
    last = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, s, axes[:, last], values[last], float(np.trace(cov)))


def identity_error(table: DataFrame, model: Whitening, vector: str = "embedding") -> float | None:
    """Largest entry of the whitened vectors' own covariance minus the identity, over components with variance."""
    project, centre, k = model.project(), model.centre, len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for size, _, x in matrices(b.column(0)):
                if size == len(centre):
                    w = project(x - centre)
                    total += w.sum(axis=0)
                    square += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.r_[square.ravel(), total])], ["j", "v"])

    rows = table.select(vector).mapInArrow(run, "j long, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()
    v = np.array([v for _, v in sorted(map(tuple, rows))])
    square, mean = v[: k * k].reshape(k, k) / model.n, v[k * k :] / model.n
    error = np.abs(square - np.outer(mean, mean) - np.eye(k))
    return None if np.isnan(error).all() else float(np.nanmax(error))


_OUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(table: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Only ``key`` and ``vector`` are read. A vector is usable if it is not null or
    empty, has no null or non-finite entry, and is as long as the commonest
    length among such vectors (of two, the smaller); others give no row. Entries
    whose 1024-fold lies beyond 2^61 saturate there. Null or repeated keys and equal vectors count
    as often as they occur. A component without variance has a null ``whitened``, and
    ``explained`` is null where nothing varies at all; ``deviation`` is null beyond
    38 digits. With fewer dimensions than ``components`` there are as many as
    dimensions. No usable vector: no rows.
    """
    model = fit(table, vector, components)
    kind = table.schema[key].dataType.simpleString()
    if model is None:
        return table.select(key).limit(0).select(key, *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _OUT.split(", ")])
    error = identity_error(table, model, vector)
    project, centre, k = model.project(), model.centre, len(model.values)
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, rows, x in matrices(b.column(1)):
                if size != len(centre):
                    continue
                z, m = x - centre, len(rows)
                dev = [Decimal(v) if v < 10**38 else None for v in model.deviation(z)]
                repeat = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array(dev, pa.decimal128(38, 0)).take(repeat),
                        pa.array(project(z).ravel(), from_pandas=True),
                        pa.array(explained * m, pa.float64()),
                        pa.array([error] * (m * k), pa.float64()),
                    ],
                    [key, *[c.split()[0] for c in _OUT.split(", ")]],
                )

    return table.select(key, vector).mapInArrow(run, f"`{key}` {kind}, {_OUT}")


def digest(found: DataFrame) -> DataFrame:
    """``deviation`` as long, null where it passes 64 bits."""
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
