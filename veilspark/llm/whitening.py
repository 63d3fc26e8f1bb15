"""Whitening of embeddings through polarised covariances.

Entries become integers, x = floor(scale * c) + shift, so that everything up to the
eigenvectors is exact:

1. n and the sums S of every dimension.
2. With d = n * x - S (centred, still an integer): the sums of d_i^2 for every dimension
   and of (d_i + d_j)^2 for every pair. Tasks add them up in 20-bit pieces, as machine
   integers that cannot overflow, and the totals as decimals.
3. (sum (d_i + d_j)^2 - sum d_i^2 - sum d_j^2) / (2 n^3) is the covariance of i and j.
   What reaches the driver is one number for each pair of dimensions, however many rows
   there are. ``eigh`` of that matrix gives the components.
4. Rows are projected where they are, and a last aggregate takes the covariance of what
   came out.

Results for odd input: a row whose vector is null or empty, or has null or non-finite
entries, is dropped, and so is one whose length is not the table's most frequent (of
equally frequent ones the largest); null and repeated ids stay as they are; repeated
vectors count as often as they occur; a component without variance (at most 1e-12 of the
trace) has null as its whitened value, and ``explained`` is null where there is no variance
at all; a deviation beyond a long is null (``spread``, the same over n^2, always has a
value); entries beyond 2^40 are refused with an error, for their sums would not be exact;
an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.session import ship_package

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
BLOCK_ROWS = 4096
PIECE = 20
"""Bits of a piece: two pieces multiply to 40 bits, and 4,096 rows of such products stay below 2^53."""
LIMIT = float(1 << 40)
FLAT = 1e-12


@dataclass(frozen=True)
class Fit:
    """n and sums S of the integer vectors, and their components: eigenvalues falling, eigenvectors as columns."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))

    def scaled(self) -> np.ndarray:
        """dimensions x components: the eigenvectors over the root of their eigenvalue, NaN without variance."""
        real = self.values > FLAT * self.trace
        return self.vectors / np.sqrt(np.where(real, self.values, np.nan))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec (doubles) of the rows that have entries, finite ones only."""
    vectors = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)


def _integers(vectors: pa.Array, dims: int) -> np.ndarray:
    c = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(c) and np.abs(c).max() * SCALE > LIMIT:
        raise ValueError(f"an entry is beyond {LIMIT / SCALE:.3g}")
    return np.floor(SCALE * c).astype(np.int64).reshape(-1, dims) + SHIFT


def _blocks(batches, column: str, dims: int):
    for batch in batches:
        for begin in range(0, len(batch), BLOCK_ROWS):
            part = batch.slice(begin, BLOCK_ROWS)
            yield part, _integers(part.column(part.schema.get_field_index(column)), dims)


def _totals(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    def run(batches):
        sums, n = np.zeros(dims, np.int64), 0
        for _, x in _blocks(batches, "vec", dims):
            sums += x.sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dims, dtype=np.int32)), pa.array(sums), pa.array(np.full(dims, n))], names=["i", "s", "n"]
        )

    got = rows.select("vec").mapInArrow(run, "i int, s long, n long").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")
    ).orderBy("i").collect()
    return int(got[0].n), [int(r.s) for r in got]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in Python's integers where a machine's would overflow."""
    mean = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, mean, strict=True)]
    y = x - np.array(mean, np.int64)
    if len(y) and int(np.abs(y).max() + 1) * n >= 1 << 61:
        y = y.astype(object)
    return n * y - np.array(rest, y.dtype)


def _squares(e: np.ndarray) -> list[int]:
    """Exact sums of squares of e's columns."""
    if e.dtype == object:
        return [int(v) for v in (e * e).sum(axis=0)]
    e = np.abs(e)
    pieces = [(e >> PIECE * k) & ((1 << PIECE) - 1) for k in range(4)]
    while len(pieces) > 1 and not pieces[-1].any():
        pieces.pop()
    total = [0] * e.shape[1]
    for a in range(len(pieces)):
        for b in range(a, len(pieces)):
            part = (pieces[a] * pieces[b]).sum(axis=0).tolist()
            weight = (1 if a == b else 2) << PIECE * (a + b)
            total = [t + weight * p for t, p in zip(total, part, strict=True)]
    return total


def polarised(rows: DataFrame, dims: int, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """(i, j) -> exact sum of (d_i + d_j)^2 for i < j, and (i, i) -> that of d_i^2."""

    def run(batches):
        held = [[0] * (dims - i) for i in range(dims)]
        for _, x in _blocks(batches, "vec", dims):
            d = _centred(x, n, sums)
            for i in range(dims):
                e = d[:, i:] + d[:, i:i + 1]
                e[:, 0] = d[:, i]
                held[i] = [t + s for t, s in zip(held[i], _squares(e), strict=True)]
        low = (1 << 60) - 1
        flat = [(i, i + k, v) for i, row in enumerate(held) for k, v in enumerate(row)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _, _ in flat], pa.int32()), pa.array([j for _, j, _ in flat], pa.int32())]
            + [pa.array([v >> 60 * k & low for _, _, v in flat], pa.int64()) for k in range(3)],
            names=["i", "j", "p0", "p1", "p2"],
        )

    got = rows.select("vec").mapInArrow(run, "i int, j int, p0 long, p1 long, p2 long").groupBy("i", "j").agg(
        *[F.sum(F.col(f"p{k}").cast("decimal(38,0)")).alias(f"p{k}") for k in range(3)]
    )
    return {(r.i, r.j): int(r.p0) + (int(r.p1) << 60) + (int(r.p2) << 120) for r in got.collect()}


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Fit:
    """Fit over ``rows`` (vec), all of ``dims`` entries; at least one."""
    n, sums = _totals(rows, dims)
    squares = polarised(rows, dims, n, sums)
    cov = np.empty((dims, dims))
    for (i, j), both in squares.items():
        twice = 2 * both if i == j else both - squares[i, i] - squares[j, j]
        cov[i, j] = cov[j, i] = twice / (2 * n**3)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return Fit(n, sums, cov, values, vectors * np.where(lead < 0, -1.0, 1.0))


def _projected(d: np.ndarray, model: Fit) -> np.ndarray:
    return (d.astype(np.float64) / model.n) @ model.scaled()


def identity_error(rows: DataFrame, dims: int, model: Fit) -> float:
    """Largest absolute entry of (covariance of the whitened rows - identity), over the components with variance."""
    k = model.vectors.shape[1]

    def run(batches):
        total = np.zeros((k + 1, k))
        for _, x in _blocks(batches, "vec", dims):
            w = _projected(_centred(x, model.n, model.sums), model)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        at = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["i", "j", "s"])

    got = np.zeros((k + 1, k))
    for r in rows.select("vec").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        got[r.i, r.j] = r.s
    mean = got[k] / model.n  # whitened values are centred already: this is rounding
    cov = got[:k] / model.n - np.outer(mean, mean)
    real = ~np.isnan(np.diag(cov))
    return float(np.abs(cov - np.eye(k))[np.ix_(real, real)].max(initial=0.0))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, spread, whitened, explained, identity_error."""
    ship_package(rows.sparkSession)
    good = usable(rows, id_col, vector_col)
    schema = good.select(
        "id", F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("spread"), F.lit(None).cast("array<double>").alias("w")
    ).schema
    most = good.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if most is None:
        dims, model, error = 1, Fit(0, [0], np.zeros((1, 1)), np.zeros(0), np.zeros((1, 0))), 0.0
    else:
        dims = most.dims
        good = good.where(F.size("vec") == dims)
        model = fit(good, dims, components)
        error = identity_error(good, dims, model)

    def run(batches):
        for part, x in _blocks(batches, "vec", dims):
            d = _centred(x, model.n, model.sums)
            exact = _squares(np.ascontiguousarray(d.T))  # a column per row of the table
            w = _projected(d, model)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()),
                 pa.array([v / model.n**2 for v in exact], pa.float64()), pa.array(list(w), pa.list_(pa.float64()))],
                names=schema.names,
            )

    trace = model.trace
    explained = F.array(*[F.lit(float(v) / trace if trace else None).cast("double") for v in model.values])
    return (
        good.mapInArrow(run, schema)
        .select("id", "deviation", "spread", F.posexplode("w").alias("at", "w"))
        .select(
            "id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "spread",
            F.when(~F.isnan("w"), F.col("w")).alias("whitened"),
            F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )
