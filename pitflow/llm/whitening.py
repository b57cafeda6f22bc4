"""Whitening directions of embeddings by a bidiagonal qd solver.

Tasks reduce centred rows to triangular factors by QR, block after block; the
rows of such factors are rows like any other and are reduced again until one
factor R is left, whose Gram matrix is that of all rows. Householder reflections
make R bidiagonal. dqds, the differential qd algorithm with shifts, finds the
squared singular values to high relative accuracy, and twisted factorisations
give the directions that belong to them. No covariance is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitflow.llm.common import cut

COMPONENTS = 8
#: Steps of the grid that entries are counted on, and what is added to a count.
GRID, OFFSET = 1024, 100_000
#: Rows that a task gathers before it reduces them to a triangle.
BLOCK_ROWS = 4096
#: Tasks of the later reductions, the last of which leaves one factor.
FANS = (64, 1)
EPS = np.finfo(np.float64).eps
#: Relative distance below which neighbouring values share an invariant subspace.
CLUSTER = 1e-3
LARGEST = (1 << 63) - 1


# --- bidiagonal solver, on one small matrix -----------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and P, so that r = Q B P^T."""
    work, d = r.astype(np.float64).copy(), r.shape[1]
    right = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0:
            return None
        v = x.copy()
        v[0] += norm if x[0] >= 0 else -norm
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(work[k:, k])
        if v is not None:
            work[k:, k:] -= 2 * np.outer(v, v @ work[k:, k:])
        if k + 2 < d:
            v = reflector(work[k, k + 1 :])
            if v is not None:
                work[k:, k + 1 :] -= 2 * np.outer(work[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(work).copy(), np.diag(work, 1).copy(), right


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], bool]:
    """One differential qd transform; false if the shift was too large."""
    new_q, new_e, rest = [], [], q[0] - shift
    for i, off in enumerate(e):
        if rest < 0:
            return q, e, False
        value = rest + off
        ratio = q[i + 1] / value if value > 0 else 0.0
        new_q.append(value)
        new_e.append(off * ratio)
        rest = rest * ratio - shift if value > 0 else q[i + 1] - shift
    new_q.append(rest)
    return new_q, new_e, rest >= 0


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by dqds."""
    found: list[float] = []
    stack = [([float(a) ** 2 for a in diagonal], [float(b) ** 2 for b in above], 0.0)]
    small = (10 * EPS) ** 2
    while stack:
        q, e, moved = stack.pop()
        while len(q) > 1:
            n = len(q)
            if e[-1] <= small * (moved + q[-1]):
                found.append(moved + q.pop())
                e.pop()
                continue
            split = next((i for i in range(n - 2) if e[i] <= small * (moved + q[i])), None)
            if split is not None:
                stack.append((q[: split + 1], e[:split], moved))
                q, e = q[split + 1 :], e[split + 1 :]
                continue
            if q[0] < q[-1]:  # large values first, so that the small end converges
                q, e = q[::-1], e[::-1]
            # The smaller value of the last two rows is a bound from above; a little less is tried.
            half, part = (q[-2] + e[-1] + q[-1]) / 2, q[-2] * q[-1]
            low = part / (half + np.sqrt(max(half * half - part, 0.0))) if half > 0 else 0.0
            shift = low * (1 - 4 * EPS) if n == 2 else max(0.0, low - e[-2] / 2 if low > e[-2] else low / 4)
            for tried in (shift, shift / 4, shift / 64, 0.0):
                next_q, next_e, fits = _dqds_step(q, e, tried)
                if fits:
                    q, e, moved = next_q, next_e, moved + tried
                    break
        found.append(moved + q[0])
    return np.sort(np.array(found))[::-1]


class Twisted:
    """Twisted factorisation of B^T B - value, from the top and from the bottom
    and joined where the remaining pivot is smallest."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        n = len(diagonal)
        pivots, tiny = diagonal**2, EPS * EPS * max(value, 1e-300)
        off = diagonal[:-1] * above  # the off-diagonal of B^T B
        down, up = np.empty(n), np.empty(n)
        self.lower, self.upper = np.empty(n - 1), np.empty(n - 1)
        s = np.empty(n)
        s[0] = -value
        for i in range(n - 1):
            down[i] = pivots[i] + s[i] or tiny
            self.lower[i] = off[i] / down[i]
            s[i + 1] = s[i] * (above[i] ** 2 / down[i]) - value
        down[n - 1] = pivots[n - 1] + s[n - 1]
        p = pivots[n - 1] - value
        gamma = np.empty(n)
        gamma[n - 1] = s[n - 1] + p + value
        for i in range(n - 2, -1, -1):
            up[i + 1] = above[i] ** 2 + p or tiny
            self.upper[i] = off[i] / up[i + 1]
            p = p * (pivots[i] / up[i + 1]) - value
            gamma[i] = s[i] + p + value
        self.twist = k = int(np.argmin(np.abs(gamma)))
        self.gamma = gamma[k]
        self.pivots = np.concatenate([down[:k], [gamma[k] or tiny], up[k + 1 :]])

    def spread(self, w: np.ndarray) -> np.ndarray:
        """Solves with the transposed factor: from the twist to both ends."""
        z, k = w.copy(), self.twist
        for i in range(k - 1, -1, -1):
            z[i] -= self.lower[i] * z[i + 1]
        for i in range(k, len(z) - 1):
            z[i + 1] -= self.upper[i] * z[i]
        return z

    def solve(self, b: np.ndarray) -> np.ndarray:
        y, k, n = b.copy(), self.twist, len(b)
        for i in range(k):
            y[i + 1] -= self.lower[i] * y[i]
        for i in range(n - 1, k, -1):
            y[i - 1] -= self.upper[i - 1] * y[i]
        return self.spread(y / self.pivots)

    def vector(self) -> np.ndarray:
        start = np.zeros(len(self.pivots))
        start[self.twist] = 1.0
        return self.spread(start)


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors of a bidiagonal matrix, a column per value of
    ``values`` (squares, falling). Vectors of values that lie close together are
    turned until they are orthogonal, by inverse iteration."""
    rng = np.random.default_rng(1)
    columns: list[np.ndarray] = []
    cluster = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * values[i - 1]:
            cluster = i
        twisted = Twisted(diagonal, above, value)
        if i == cluster and (i + 1 == len(values) or value - values[i + 1] > CLUSTER * value):
            z = twisted.vector()
            z /= np.linalg.norm(z)
        else:
            z = rng.standard_normal(len(diagonal))
            for _ in range(4):
                z = twisted.solve(z)
                z /= np.abs(z).max()
                for other in columns[cluster:] * 2:
                    z = z - (other @ z) * other
                z /= np.linalg.norm(z)
        columns.append(z)
    return np.stack(columns, axis=1)


def principal_directions(r: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of ``r``, falling, and as columns the right
    vectors of the first ``wanted`` whose values are not rounding alone. Each
    vector's largest entry is positive."""
    d = r.shape[1]
    square = np.zeros((d, d))
    square[: len(r)] = r[:d]
    scale = np.abs(square).max()
    if scale == 0:
        return np.zeros(d), np.zeros((d, 0))
    diagonal, above, right = bidiagonal(square / scale)
    values = squared_singular_values(diagonal, above)
    real = int((values[:wanted] > (8 * d * EPS) ** 2 * values[0]).sum())
    # One value more shows whether the last one wanted stands alone.
    vectors = right @ right_vectors(diagonal, above, values[: real + 1])[:, :real]
    tops = vectors[np.abs(vectors).argmax(axis=0), np.arange(real)]
    return values * scale * scale, vectors * np.where(tops < 0, -1.0, 1.0)


# --- on Spark -----------------------------------------------------------------


@dataclass
class Fit:
    """What is known of all vectors of one length: their number, sums of each
    dimension, eigenvalues of the covariance, and directions as columns."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    directions: np.ndarray

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        if self.n * int(np.abs(x).max(initial=0)) < 1 << 62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def deviations(self, numerators: np.ndarray) -> list[int | None]:
        """Sums of the squares, exactly; None beyond a long."""
        about = np.square(numerators.astype(np.float64)).sum(axis=1)
        exact: list[int | None] = []
        for row, size in zip(numerators, about):
            if size < 9e18:
                exact.append(int((row.astype(np.int64) ** 2).sum()))
            else:
                total = sum(int(v) ** 2 for v in row) if size < 9.5e18 else LARGEST + 1
                exact.append(total if total <= LARGEST else None)
        return exact


def counted(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is neither null nor empty and holds
    only finite entries, each entry c as floor(1024 c) + 100000."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    most = float(1 << 52)

    def step(c: Column) -> Column:
        at = F.greatest(F.lit(-most), F.least(F.lit(most), c.cast("double") * GRID))
        return F.floor(at).cast("long") + OFFSET

    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return usable.select("vec_id", F.transform("embedding", step).alias("x"))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their matrix) for each length of vectors in a batch."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def sums(x: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of vectors: how many, and the exact sum of each dimension.
    A row per dimension and task leaves the tasks, one per dimension the cluster."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for d, at, rows in by_length(batch["x"]):
                total = totals.setdefault(d, [0, [0] * d])
                total[0] += len(at)
                # 512 entries of 2^53 fit in a long; sums of batches are Python's.
                for part in np.array_split(rows, -(-len(rows) // 512)):
                    total[1] = [a + int(b) for a, b in zip(total[1], part.sum(axis=0))]
        for d, (n, values) in totals.items():
            columns = [[d] * d, range(d), [n] * d, [Decimal(v) for v in values]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["d", "at", "n", "total"]
            )

    rows = x.select("x").mapInArrow(task, "d long, at long, n long, total decimal(38,0)")
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for d, at, n, total in rows.groupBy("d", "at").agg(F.sum("n"), F.sum("total")).collect():
        found.setdefault(d, {})[at] = (n, int(total))
    return {d: (per[0][0], [per[i][1] for i in range(d)]) for d, per in found.items()}


def triangle(rows: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(rows), mode="r")


def factors(x: DataFrame, fits: dict[int, Fit]) -> dict[int, np.ndarray]:
    """For each length of vectors the triangular factor of all centred rows."""

    def reduced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for d, _, rows in by_length(batch[column]):
                if column == "x":
                    rows = fits[d].numerators(rows).astype(np.float64) / fits[d].n
                part = held.setdefault(d, [])
                part.append(rows)
                if sum(map(len, part)) >= max(BLOCK_ROWS, 4 * d):
                    held[d] = [triangle(part)]
        for part in held.values():
            yield pa.RecordBatch.from_pydict({"row": pa.array(list(triangle(part)), pa.list_(pa.float64()))})

    schema = "row array<double>"
    rows = x.select("x").mapInArrow(lambda batches: reduced(batches, "x"), schema)
    for fan in FANS:
        rows = rows.repartition(fan).mapInArrow(lambda batches: reduced(batches, "row"), schema)
    found: dict[int, list] = {}
    for (row,) in rows.collect():  # as many rows as dimensions
        found.setdefault(len(row), []).append(row)
    return {d: np.array(part) for d, part in found.items()}


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Whitening directions for each length of vectors. The driver holds a square
    matrix of each length."""
    x = counted(vectors)
    fits = {d: Fit(n, s, np.zeros(d), np.zeros((d, 0))) for d, (n, s) in sums(x).items()}
    for d, r in factors(x, fits).items():
        values, directions = principal_directions(r, components)
        fits[d].eigenvalues, fits[d].directions = values / fits[d].n, directions
    return fits


def projected(vectors: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(vec_id, d, deviation, whitened) of the usable rows of ``vectors``: exact
    deviation, and the coordinates along the directions at variance 1."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, rows in by_length(batch["x"]):
                own = fits[d]
                numerators = own.numerators(rows)
                scale = 1 / np.sqrt(own.eigenvalues[: own.directions.shape[1]])
                whitened = (numerators.astype(np.float64) / own.n) @ own.directions * scale
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["vec_id"].take(pa.array(at)),
                        pa.array([d] * len(at), pa.int64()),
                        pa.array(own.deviations(numerators), pa.int64()),
                        pa.array(list(whitened), pa.list_(pa.float64())),
                    ],
                    names=["vec_id", "d", "deviation", "whitened"],
                )

    schema = f"vec_id {id_type}, d long, deviation long, whitened array<double>"
    return counted(vectors).mapInArrow(task, schema)


def identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """For each length of vectors the largest absolute entry of the covariance of
    ``whitened`` minus the identity, centred before multiplying."""
    errors = {}
    for d, own in fits.items():
        k = own.directions.shape[1]
        if not k:
            continue
        part = rows.where(F.col("d") == d).select(*(F.col("whitened")[i].alias(f"w{i}") for i in range(k)))
        means = part.agg(*(F.avg(f"w{i}") for i in range(k))).first()
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        centred = [F.col(f"w{i}") - F.lit(means[i]) for i in range(k)]
        products = part.agg(*(F.avg(centred[i] * centred[j]) for i, j in pairs)).first()
        errors[d] = max(abs(value - (i == j)) for (i, j), value in zip(pairs, products))
    return errors


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of
    every usable row of ``vectors`` (vec_id, embedding) and component.

    Rows whose vector is null, empty or holds null or non-finite entries go.
    Repeated rows count as often as they are there; rows without vec_id are rows
    like any other. Vectors of different lengths are tables of their own. An
    entry is clipped where 1024 times it passes 2^52; a deviation beyond a long
    is null. Components without variance have no direction: ``whitened`` is null
    there, and so is ``identity_error`` if no component has variance. An empty
    table gives no rows; other columns are not read.
    """
    vectors = vectors.select("vec_id", "embedding")
    fits = fit(vectors, components)
    rows = cut(projected(vectors, fits))
    errors = identity_errors(rows, fits)
    facts = []
    for d, own in fits.items():
        trace = float(own.eigenvalues.sum())
        for i in range(min(components, d)):
            share = float(own.eigenvalues[i] / trace) if trace else 0.0
            facts.append((d, i + 1, own.n, share, errors.get(d)))
    schema = "length long, component int, n long, explained double, identity_error double"
    known = vectors.sparkSession.createDataFrame(facts, schema)
    # As many rows as components of each length of vectors.
    return rows.join(F.broadcast(known), F.col("d") == F.col("length")).select(
        "vec_id",
        "component",
        "n",
        "deviation",
        F.get("whitened", F.col("component") - 1).alias("whitened"),
        "explained",
        "identity_error",
    )
