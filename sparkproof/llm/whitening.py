"""Whitening of embeddings with leading principal components found by the Jacobi-Davidson method.

The covariance matrix is never formed. All that is asked of the data are products of the centred rows
with a few vectors: each is one pass in which Spark's tasks multiply their blocks of rows and the sums of
blocks meet by dimension. Around it runs a block Jacobi-Davidson iteration: Rayleigh-Ritz in a growing
subspace, corrections from the projected equation by inner MINRES steps (one product serves all columns),
restarts, and locking of pairs whose residual has reached double precision.

The driver holds vectors of the embeddings' dimension, a few dozen at a time, and no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkproof.llm.common import keep

COMPONENTS = 4
#: Entries are rounded down to this part of one.
SCALE = 256
#: Rows that are multiplied at once.
BLOCK_ROWS = 4096
#: Ritz pairs that are corrected beside the wanted ones, so that close values part sooner.
GUARDS = 4
#: Most vectors of the search space, as a multiple of the pairs that are corrected.
SPACE = 5
#: Most MINRES steps of one correction, and most corrections before giving up.
INNER, OUTER = 6, 300
EPS = float(np.finfo(float).eps)
#: A pair is locked when its residual is below this times the spectral norm and the root of the dimension.
RESIDUAL = 8 * EPS

Product = Callable[[np.ndarray], np.ndarray]


def orthonormal(v: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns that span v beside `against` (which is orthonormal); what is already spanned is left out."""
    for _ in range(2):
        v = v - against @ (against.T @ v)
    norms = np.linalg.norm(v, axis=0)
    v = v[:, norms > 0] / norms[norms > 0]
    if not v.shape[1]:
        return v
    u, s, _ = np.linalg.svd(v, full_matrices=False)
    v = u[:, s > 1e-8 * max(s[0], 1e-300)]
    # What is left of nearly spanned columns is made orthogonal once more.
    v = v - against @ (against.T @ v)
    return np.linalg.qr(v)[0]


def minres(product: Product, project: Callable, shifts: np.ndarray, right: np.ndarray, steps: int, within: np.ndarray) -> np.ndarray:
    """Solutions of (A - shift) t = right in the projected space, one system for each column.

    Columns run side by side: Lanczos vectors of all of them are multiplied in one product. A column
    stops changing when its residual has fallen to its `within`."""
    n, m = right.shape
    x = np.zeros((n, m))
    v_old, v = np.zeros((n, m)), project(right)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = v / np.where(live, beta, 1.0)
    eta = beta.copy()
    first = beta.copy()
    beta = np.zeros(m)
    c_old = c = np.ones(m)
    s_old = s = np.zeros(m)
    w_old = w = np.zeros((n, m))
    for _ in range(steps):
        if not live.any():
            break
        z = np.zeros((n, m))
        z[:, live] = product(v[:, live])
        z = project(z - v * shifts)
        alpha = np.sum(v * z, axis=0)
        z = z - alpha * v - beta * v_old
        beta_new = np.linalg.norm(z, axis=0)
        delta = c * alpha - c_old * s * beta
        rho2 = s * alpha + c_old * c * beta
        rho3 = s_old * beta
        rho = np.hypot(delta, beta_new)
        rho = np.where(rho > 0, rho, 1.0)
        c_old, s_old, c, s = c, s, delta / rho, beta_new / rho
        w_old, w = w, (v - rho3 * w_old - rho2 * w) / rho
        x = x + np.where(live, c * eta, 0.0) * w
        eta = -s * eta
        live = live & (np.abs(eta) > within * first) & (beta_new > EPS * np.abs(shifts))
        v_old, v, beta = v, z / np.where(beta_new > 0, beta_new, 1.0), beta_new
    return x


def leading_pairs(product: Product, dims: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and unit eigenvectors of the symmetric matrix behind `product`.

    Raises if residuals don't reach double precision."""
    wanted = min(wanted, dims)
    width = min(wanted + GUARDS, dims)
    rng = np.random.default_rng(seed)
    space = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    image = product(space)
    values, locked = np.zeros(0), np.zeros((dims, 0))
    norm = 0.0
    for outer in range(OUTER):
        # Rayleigh-Ritz; locked vectors are outside of the space.
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_image = space @ turn, image @ turn
        norm = max(norm, float(np.abs(theta).max(initial=0.0)))
        active = min(width, len(theta))
        outside = ritz_image[:, :active] - locked @ (locked.T @ ritz_image[:, :active])
        residual = outside - ritz[:, :active] * theta[:active]
        sizes = np.linalg.norm(residual, axis=0)
        done = 0
        while done < active and len(values) + done < wanted and sizes[done] <= RESIDUAL * dims**0.5 * norm:
            done += 1
        if done:
            values = np.concatenate([values, theta[:done]])
            locked = np.hstack([locked, ritz[:, :done]])
        if len(values) == wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        # The rest of the space goes on; beyond its limit only the leading Ritz vectors do.
        limit = max(SPACE * width, width + 1)
        if len(theta) - done <= limit - width:
            space, image = ritz[:, done:], ritz_image[:, done:]
        else:
            space = orthonormal(ritz[:, done : done + 2 * width], locked)
            image = product(space)  # afresh, so that rounding doesn't build up
        many = active - done
        fix, theta_fix = residual[:, done:active], theta[done:active]
        if many:
            guard = np.hstack([locked, ritz[:, done:active]])

            def project(z: np.ndarray, guard: np.ndarray = guard) -> np.ndarray:
                return z - guard @ (guard.T @ z)

            within = np.full(many, 2.0 ** -min(outer + 1, 10))
            step = minres(product, project, theta_fix, -fix, INNER, within)
        else:
            step = np.zeros((dims, 0))
        step = orthonormal(step, np.hstack([locked, space]))
        if not step.shape[1]:
            # Nothing new came: a random direction keeps the space growing.
            step = orthonormal(rng.standard_normal((dims, 1)), np.hstack([locked, space]))
        if step.shape[1]:
            space, image = np.hstack([space, step]), np.hstack([image, product(step)])
        else:
            image = product(space)  # the whole space is spanned: only products can be made afresh
    raise ArithmeticError("residuals did not reach double precision")


@dataclass(frozen=True)
class Fit:
    """Distinct rounded vectors: n of them, their sums, and blocks of them for products."""

    n: int
    dims: int
    sums: list[int]
    blocks: DataFrame | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def rounded(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id and x of rows whose vector is whole: not null, not empty, without null or non-finite entries."""
    c = F.col(column)
    whole = F.forall(c, lambda e: F.coalesce(e.between(F.lit(-1.7976931348623157e308), F.lit(1.7976931348623157e308)), F.lit(False)))
    x = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE))
    return vectors.where(c.isNotNull() & (F.size(c) > 0) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Whole numbers of a list column, a row for each list."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def packer(dims: int) -> Callable:
    """Rows of x to blocks in the fewest bytes an entry, with exact sums of each block."""
    schema = pa.schema([("block", pa.binary()), ("width", pa.int32()), ("rows", pa.int64()), ("sums", pa.list_(pa.string()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                x = matrix(batch.slice(start, BLOCK_ROWS).column("x"), dims)
                low, high = int(x.min()), int(x.max())
                width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
                sums = x.sum(axis=0).tolist() if width < 8 else [sum(map(int, column)) for column in x.T]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x.astype(f"<i{width}").tobytes()], pa.binary()), pa.array([width], pa.int32()),
                        pa.array([len(x)], pa.int64()), pa.array([[str(s) for s in sums]]),
                    ],
                    schema=schema,
                )

    return pack


def fit_list(rows: DataFrame) -> Fit:
    """The distinct x vectors. The space has the length that most rows have (the larger of equals)."""
    sizes = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    if top is None:
        return Fit(0, 0, [], None)
    dims = top["dims"]
    distinct = rows.where(F.size("x") == dims).select("x").distinct()
    blocks = keep(distinct.mapInArrow(packer(dims), "block binary, width int, rows long, sums array<string>"), "vectors")
    at = blocks.select("rows", F.posexplode("sums").alias("dim", "part"))
    sums = at.groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"), F.sum("rows").alias("n")).collect()
    found = {r["dim"]: int(r["s"]) for r in sums}
    return Fit(sums[0]["n"], dims, [found[i] for i in range(dims)], blocks.select("block", "width"))


def summed(fit: Fit, columns: int, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of the matrix, of so many columns, that `of_block` makes of a block's centred rows.

    Tasks add up their blocks; their sums meet row by row, so that the driver gets one matrix only."""
    mean = fit.mean
    schema = pa.schema([("row", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block, width in zip(batch.column("block"), batch.column("width").to_pylist(), strict=True):
                x = np.frombuffer(block.as_buffer(), f"<i{width}").reshape(-1, len(mean))
                found = of_block(x - mean)
                total = found if total is None else total + found
        if total is not None:
            rows = pa.array(range(len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([rows, pa.array(total.tolist(), pa.list_(pa.float64()))], schema=schema)

    parts = fit.blocks.mapInArrow(run, "row int, sums array<double>")
    table = parts.groupBy("row").agg(*[F.sum(F.col("sums")[j]).alias(f"c{j}") for j in range(columns)]).orderBy("row").toArrow()
    return np.column_stack([table[f"c{j}"].to_numpy() for j in range(columns)])


def covariance_product(fit: Fit) -> Product:
    """Products of the covariance with the columns of a matrix, one pass over the blocks each."""

    def product(vectors: np.ndarray) -> np.ndarray:
        v = np.ascontiguousarray(vectors)
        return summed(fit, v.shape[1], lambda c: c.T @ (c @ v)) / fit.n

    return product


@dataclass(frozen=True)
class Whitening:
    """Components as columns; whitening divides a projection by the root of its eigenvalue."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def known(self) -> np.ndarray:
        """Components with a variance above rounding; the rest can't be whitened."""
        return self.values > len(self.vectors) * RESIDUAL * max(self.values.max(initial=0.0), 0.0)


def learn(fit: Fit, components: int) -> Whitening:
    values, vectors = leading_pairs(covariance_product(fit), fit.dims, components)
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
    trace = float(summed(fit, 1, lambda c: np.array([[np.sum(c * c)]]))[0, 0] / fit.n)
    found = Whitening(vectors, values, trace, None)
    if not found.known.any():
        return found
    to_white = vectors[:, found.known] / np.sqrt(values[found.known])
    mean = summed(fit, to_white.shape[1], lambda c: (c @ to_white).sum(axis=0)[None])[0] / fit.n

    def spread(c: np.ndarray) -> np.ndarray:
        z = c @ to_white - mean
        return z.T @ z

    error = np.abs(summed(fit, len(mean), spread) / fit.n - np.eye(len(mean))).max()
    return Whitening(vectors, values, trace, float(error))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 over the dimensions, exact; null beyond a long."""
    most = n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, sums))
    if len(sums) * most * most < 2**63:
        d = x * n - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in found]


OUT = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
    ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
])
OUT_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitener(fit: Fit, found: Whitening) -> Callable:
    n, sums, mean, dims = fit.n, fit.sums, fit.mean, fit.dims
    k = len(found.values)
    scale = np.where(found.known, 1 / np.sqrt(np.where(found.known, found.values, 1.0)), np.nan)
    explained = found.values / found.trace if found.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            m = len(x)
            white = ((x - mean) @ found.vectors) * scale
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)), pa.array(deviations(x, n, sums), pa.int64()).take(at),
                    pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(explained, m), from_pandas=True),
                    pa.array([found.identity_error] * (m * k), pa.float64()),
                ],
                schema=OUT,
            )

    return run


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every row's vector on the leading principal components.

    Input: vec_id and an array column; other columns are ignored. Rows go whose vector is null, empty,
    holds a null or non-finite entry, or has another length than most rows (the larger of equals). An
    entry c becomes floor(256 c). Mean and covariance are those of the distinct vectors, so copies weigh
    nothing. Output: a row for each row and component, see OUT; `n` distinct vectors, `deviation` the
    exact sum of (n x - S)^2 (null beyond a long). A component without variance has whitened null, and
    explained null if there is no variance at all; `identity_error` is over the others, null without
    any. Equal eigenvalues give any basis of theirs. No rows give none."""
    rows = rounded(vectors, column)
    fit = fit_list(rows)
    if not fit.n:
        return rows.sparkSession.createDataFrame([], OUT_DDL)
    found = learn(fit, components)
    return rows.where(F.size("x") == fit.dims).mapInArrow(whitener(fit, found), OUT_DDL)
