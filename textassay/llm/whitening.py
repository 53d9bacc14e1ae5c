"""Whitening of embeddings by Jacobi-Davidson on a covariance that is never formed.

The vectors are written once as blocks of integers in the shared folder.  All that is asked
of them is the centred product Y = C (V), one pass of tasks over the blocks for a whole
group of vectors V: each task centres its rows by the mean, multiplies and sums, and sums of
tasks meet in rounds of at most FAN_IN, in a fixed order.  The driver holds bases of d
coordinates, never a row.

The method keeps a search space, takes its Rayleigh-Ritz pairs, locks those whose residual
is at rounding level (ROUNDING * d * eps of the largest value), and enlarges the space by
corrections t of the others, each from (I - XX')(C - theta)(I - XX') t = -r, with X the
locked and the current vectors, by MINRES.  The equations of one round advance in
lockstep, so a step of all of them is one pass.  Beyond RESTART vectors the space is cut
to its best Ritz vectors.

Defined cases: rows whose vector is null, empty, or holds null, non-finite or entries with
|1024 c| >= 2**52 are dropped; where lengths differ, the most frequent one (ties: the
longest) stays and other rows are dropped; a null id and repeated ids or rows are rows like
others; fewer than `count` dimensions, or a covariance of smaller rank (eigenvalue within
rounding of 0), give as many components as there are, so without variance there are none
and the result is empty, as for an empty table; equal eigenvalues give any unit vectors of
their space; a deviation beyond 2**63 - 1 is null; further columns are ignored.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.llm.io import bounded, drop, stored

#: Rows of a stored block, and partial sums that meet in one task or on the driver.
BLOCK_ROWS, FAN_IN = 4096, 256
RESTART, INNER_STEPS, INNER_DROP, ROUNDS = 56, 10, 0.03, 60
ROUNDING = 2.0
LIMIT = float(1 << 52)
SCALE, SHIFT = 1024, 100_000


@dataclasses.dataclass(frozen=True)
class Blocks:
    """Stored integer vectors: table of (ids, n, x) and its tasks, their number, dimension and sums a dimension."""

    rows: DataFrame
    tasks: int
    n: int
    dim: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # correctly rounded quotients of integers


@dataclasses.dataclass(frozen=True)
class Fit:
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int


def _integers(vectors: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows of floor(1024 c) + 100000) of the vectors of `dim` finite entries; dim None keeps each row's length instead."""
    flat, sizes = vectors.flatten(), np.diff(vectors.offsets.to_numpy())
    sizes = np.where(vectors.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    value = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    good = np.isfinite(value)
    good[good] = np.abs(value[good] * SCALE) < LIMIT
    row = np.repeat(np.arange(len(sizes)), sizes)
    fine = (np.bincount(row[~good], minlength=len(sizes)) == 0) & (sizes > 0)
    if dim is None:
        return np.flatnonzero(fine), sizes
    fine &= sizes == dim
    kept = value[fine[row]].reshape(-1, dim)
    return np.flatnonzero(fine), np.floor(kept * SCALE).astype(np.int64) + SHIFT


def _packed(x: np.ndarray) -> bytes:
    """Rows of a block in 32 bits an entry where they fit, else in 64."""
    return x.astype("<i4" if np.abs(x).max(initial=0) < 1 << 31 else "<i8").tobytes()


def _unpacked(x: pa.Scalar, n: int, dim: int) -> np.ndarray:
    buffer = x.as_buffer()
    return np.frombuffer(buffer, "<i4" if buffer.size == 4 * n * dim else "<i8").reshape(n, dim).astype(np.int64)


def blocks(df: DataFrame, id_column: str, vector_column: str) -> Blocks | None:
    """Store the usable rows; None without any."""
    spark = df.sparkSession
    bounded(spark)
    rows = df.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))

    def lengths(batches):
        for batch in batches:
            at, sizes = _integers(batch.column(1), None)
            dims, n = np.unique(sizes[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(dims.astype(np.int32)), pa.array(n.astype(np.int64))], ["dim", "n"])

    # one row per distinct length reaches the driver: the first of this order
    best = rows.mapInArrow(lengths, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not best:
        return None
    dim = best[0]["dim"]
    kind = pa.int64()

    def pack(batches):
        ids, held = [], []

        def block():
            x = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([[i for own in ids for i in own]], pa.list_(kind)), pa.array([len(x)], pa.int64()), pa.array([_packed(x)], pa.binary())], ["ids", "n", "x"])

        for batch in batches:
            at, x = _integers(batch.column(1), dim)
            ids.append(batch.column(0).take(pa.array(at)).cast(kind).to_pylist())
            held.append(x)
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield block()
                ids, held = [], []
        if sum(map(len, held)):
            yield block()

    kept = stored(rows.mapInArrow(pack, "ids array<long>, n long, x binary"), "vectors")
    half = 1 << 20

    def add(batches):
        for batch in batches:
            for n, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = _unpacked(x, n, dim)
                high, low = own // half, own % half  # sums of 4096 rows of either stay far below 2**63
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high.sum(0).tolist()], pa.list_(kind)), pa.array([low.sum(0).tolist()], pa.list_(kind))], ["n", "high", "low"])

    parts = kept.mapInArrow(add, "n long, high array<long>, low array<long>")
    exact = [F.sum(F.col(c)[k].cast("decimal(38,0)")).alias(f"{c}{k}") for c in ("high", "low") for k in range(dim)] if dim <= 256 else None
    if exact is not None:
        total = parts.agg(F.sum("n").alias("n"), *exact).first()
        sums = [int(total[f"high{k}"]) * half + int(total[f"low{k}"]) for k in range(dim)]
        count = int(total["n"])
    else:
        long = parts.select("n", F.posexplode(F.arrays_zip("high", "low"))).groupBy("pos").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"col.{c}").cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
        found = {r["pos"]: r for r in long.collect()}  # dim rows
        sums, count = [int(found[k]["high"]) * half + int(found[k]["low"]) for k in range(dim)], int(found[0]["n"])
    return Blocks(kept, kept.select("n", "x").rdd.getNumPartitions(), count, dim, sums)


def _sum_blocks(data: Blocks, work, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of work(x) over all blocks x; partial sums of tasks are added in a fixed order, FAN_IN at a time."""
    dim = data.dim

    def part(batches):
        total = np.zeros(shape)
        for batch in batches:
            for n, x in zip(batch.column("n").to_pylist(), batch.column("x"), strict=True):
                total += work(_unpacked(x, n, dim))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def meet(batches):
        found = sorted(x.as_py() for batch in batches for x in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([np.sum([np.frombuffer(x) for x in found], axis=0).tobytes()] if found else [], pa.binary())], ["s"])

    rows = data.rows.select("n", "x")
    tasks = data.tasks
    sums = rows.mapInArrow(part, "s binary")
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        sums = sums.repartition(tasks).mapInArrow(meet, "s binary")
    found = sorted(bytes(r["s"]) for r in sums.collect())  # at most FAN_IN rows of this shape
    return np.sum([np.frombuffer(x) for x in found], axis=0).reshape(shape)


class _Product:
    """V -> C V for d x m matrices V, one pass over the blocks each."""

    def __init__(self, data: Blocks):
        self.data, self.mean, self.passes = data, data.mean, 0

    def __call__(self, v: np.ndarray) -> np.ndarray:
        mean, v = self.mean, np.ascontiguousarray(v)

        def work(x):
            centred = x - mean
            return centred.T @ (centred @ v)

        self.passes += 1
        return _sum_blocks(self.data, work, v.shape) / self.data.n

    def trace(self) -> float:
        mean = self.mean
        return float(_sum_blocks(self.data, lambda x: np.array([((x - mean) ** 2).sum()]), (1,))[0]) / self.data.n


def _orthonormal(new: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Columns of `new` made orthogonal to `base` and each other, twice; what is dependent is left out."""
    kept = base
    for t in new.T:
        size = np.linalg.norm(t)
        for _ in range(2):
            t = t - kept @ (kept.T @ t)
        left = np.linalg.norm(t)
        if left > 1e-10 * size > 0:
            t = t - kept @ (kept.T @ t)
            kept = np.column_stack([kept, t / np.linalg.norm(t)])
    return kept[:, base.shape[1] :]


def _corrections(apply, theta: np.ndarray, right: np.ndarray, away: list[np.ndarray]) -> np.ndarray:
    """MINRES on the projected equation of each column, all in lockstep: one product a step.

    `away[k]` are the orthonormal vectors that equation k stays orthogonal to.
    """
    m = right.shape[1]

    def project(v):
        return np.column_stack([v[:, k] - away[k] @ (away[k].T @ v[:, k]) for k in range(m)])

    r = project(right)
    beta1 = np.linalg.norm(r, axis=0)
    x = np.zeros_like(r)
    v_old, v = np.zeros_like(r), r / np.where(beta1 > 0, beta1, 1)
    w_old, w = np.zeros_like(r), np.zeros_like(r)
    c_old, s_old, c, s = np.ones(m), np.zeros(m), np.ones(m), np.zeros(m)
    beta, eta = np.zeros(m), beta1.copy()
    live = beta1 > 0
    for _ in range(INNER_STEPS):
        if not live.any():
            break
        p = np.zeros_like(v)
        p[:, live] = apply(v[:, live])
        p = project(p - theta * v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        new_beta = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        rho1 = np.hypot(delta, new_beta)
        rho2 = s * alpha + c_old * c * beta
        rho3 = s_old * beta
        live &= rho1 > 0
        safe = np.where(live, rho1, 1)
        new_w = (v - rho3 * w_old - rho2 * w) / safe
        c_old, s_old, c, s = c, s, delta / safe, new_beta / safe
        x = x + np.where(live, c * eta, 0) * new_w
        eta = -s * eta
        w_old, w = w, new_w
        v_old, v = v, p / np.where(new_beta > 0, new_beta, 1)
        beta = new_beta
        live &= (np.abs(eta) > INNER_DROP * beta1) & (new_beta > 0)
    return project(x)


def jacobi_davidson(apply, dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest `count` eigenpairs of a symmetric positive semidefinite operator on blocks of vectors."""
    count = min(count, dim)
    rng = np.random.default_rng(12)
    base = _orthonormal(rng.standard_normal((dim, min(dim, count + 4))), np.zeros((dim, 0)))
    image = apply(base)
    locked, values = np.zeros((dim, 0)), []
    last = np.inf
    for _ in range(ROUNDS):
        small = base.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = base @ y, image @ y
        size = max([abs(theta[0]) if len(theta) else 0.0, *values])
        enough = ROUNDING * dim * np.finfo(float).eps * size
        want = count - len(values)
        r = au[:, :want] - u[:, :want] * theta[:want]
        left = np.linalg.norm(r, axis=0)
        full = locked.shape[1] + base.shape[1] >= dim
        # the leading pairs lock in order; a full space is exact, so what is left there is rounding
        good = np.arange(len(left)) < (len(left) if full or size == 0 else np.argmin(np.append(left <= enough, False)))
        if good.any():
            locked = np.column_stack([locked, u[:, :want][:, good]])
            values += theta[:want][good].tolist()
            if len(values) >= count:
                break
        rest = ~good
        keep = np.ones(u.shape[1], bool)
        keep[np.flatnonzero(good)] = False
        base, image, left_most = u[:, keep], au[:, keep], theta[keep]
        r, want = r[:, rest], count - len(values)
        if base.shape[1] > RESTART:
            base, image = base[:, : 2 * count + 4], image[:, : 2 * count + 4]
        away = [np.column_stack([locked, base[:, k]]) for k in range(r.shape[1])]
        t = _corrections(apply, left_most[: r.shape[1]], -r, away)
        held = np.column_stack([locked, base])
        t = _orthonormal(t, held)
        if not t.shape[1]:  # corrections lie in the space: go on from new directions
            t = _orthonormal(rng.standard_normal((dim, want)), held)
        image = np.column_stack([image, apply(t)])
        base = np.column_stack([base, t])
        last = min(last, float(left[rest].max()))
    else:
        raise ArithmeticError(f"residual {last:g} after {ROUNDS} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], _polish(locked[:, order])


def _polish(v: np.ndarray) -> np.ndarray:
    """Unit columns, each orthogonal to those before it, largest entry positive: one form for every run."""
    v = _orthonormal(v, np.zeros((len(v), 0)))
    return v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def fit(data: Blocks, count: int) -> Fit:
    product = _Product(data)
    trace = product.trace()
    if trace <= 0:
        return Fit(np.zeros(0), np.zeros((data.dim, 0)), 0.0, 1)
    values, vectors = jacobi_davidson(product, data.dim, count)
    good = values > trace * data.dim * 1e-14
    return Fit(values[good], vectors[:, good], trace, product.passes + 1)


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", count: int = 8) -> DataFrame:
    """A row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    data = blocks(df, id_column, vector_column)
    if data is None:
        return spark.createDataFrame([], schema)
    model = fit(data, count)
    k = len(model.values)
    if not k:
        drop(data.rows)
        return spark.createDataFrame([], schema)
    mean, turn, n, dim = data.mean, model.vectors / np.sqrt(model.values), data.n, data.dim

    def moments(x):
        w = (x - mean) @ turn
        return np.vstack([w.T @ w, w.sum(0)])

    both = _sum_blocks(data, moments, (k + 1, k)) / n
    error = float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max())
    explained, sums = (model.values / model.trace).tolist(), data.sums
    names = [s.split()[0] for s in schema.split(", ")]

    def deviations(x: np.ndarray) -> list[int | None]:
        # exact in 64 bits if no partial result can leave them, else in Python integers
        most = max(abs(int(x.min(0)[j]) * n - sums[j]) for j in range(dim)), max(abs(int(x.max(0)[j]) * n - sums[j]) for j in range(dim))
        if max(most) ** 2 * dim < 1 << 63 and max(map(abs, sums)) < 1 << 62 and int(np.abs(x).max()) * n < 1 << 62:
            return ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
        exact = (sum((int(v) * n - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
        return [v if v < 1 << 63 else None for v in exact]

    def rows(batches):
        for batch in batches:
            for ids, size, x in zip(batch.column("ids"), batch.column("n").to_pylist(), batch.column("x"), strict=True):
                x = _unpacked(x, size, dim)
                at = np.repeat(np.arange(size), k)
                w = (x - mean) @ turn
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values.take(pa.array(at)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * k, n)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(at)),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, size)),
                        pa.array(np.full(size * k, error)),
                    ],
                    names,
                )

    return data.rows.mapInArrow(rows, schema)
