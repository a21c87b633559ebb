"""Whitening by the leading eigenvectors of a covariance, found by a block Jacobi-Davidson method with distributed products.

Each component c becomes the whole number floor(scale * c) + shift; c counts as held at +-2**40 / scale. The distinct vectors
are packed into blocks in the shared folder. The covariance itself is never formed: a product with a few vectors is one pass
over the blocks, centred row by row (n * x - S is exact), summed in the tasks and in a tree. Each outer round takes the Ritz
pairs of the subspace, locks the leading ones whose residuals are rounding errors, and solves the others' correction equations,
projected against the locked vectors and their own, by a few MINRES steps in lock step: one pass a step serves all pairs. Only
numbers in proportion to the dimension times the subspace reach the driver.

Vectors that are null, empty or hold null or non-finite components take no part; of several lengths, the commonest does (ties: the
longest). A null id stays. Repeated vectors count once in the fit and have rows each. Components without variance, and so all
of a table of one distinct vector, have no rows. A deviation outside the range of a long is held at its end.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm.common import tree_sum, written

TILE = 4096
HELD = 1 << 40
EPS = float(np.finfo(np.float64).eps)
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def minres(product: Callable, shift: np.ndarray, project: Callable, rhs: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of project((A - shift) t) = rhs, a column each; the columns go in lock step, one product a step."""
    safe = lambda a: np.where(a > 0, a, 1.0)
    beta = np.linalg.norm(rhs, axis=0)
    v, v_old, eta = rhs / safe(beta), np.zeros_like(rhs), beta.copy()
    w, w_old, x = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        p = project(product(v) - v * shift)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        after = np.linalg.norm(p, axis=0)
        first, second, third = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        length = np.hypot(first, after)
        c_old, s_old, c, s = c, s, first / safe(length), after / safe(length)
        w_old, w = w, np.where(length > 0, (v - third * w_old - second * w) / safe(length), 0.0)
        x = x + c * eta * w
        eta = -s * eta
        live = after > EPS * np.abs(shift)
        v_old, v, beta = v, np.where(live, p / safe(after), 0.0), np.where(live, after, 0.0)
    return x


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of new add to the spans of the others."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        for q in against:
            new = new - q @ (q.T @ new)
        u, size, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, size > 1e-8 * max(1.0, size[0])] if len(size) and size[0] > 1e-8 else u[:, :0]
    return new


def jacobi_davidson(product: Callable, d: int, k: int, *, guard: int = 8, inner: int = 6, tolerance: float = 100 * EPS, rounds: int = 200, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric d x d operator, falling, their unit vectors as columns, and the residuals' norms.

    product: columns to columns. A residual passes below tolerance * the largest eigenvalue. guard: pairs beyond the k that are
    followed so that near ones aren't missed; before the end, random vectors probe the space outside for a larger eigenvalue.
    """
    k = min(k, d)
    rng = np.random.default_rng(seed)
    block = min(d, k + guard)
    basis = orthonormal(rng.normal(size=(d, block)))
    image = product(basis)
    locked, values, errors = np.zeros((d, 0)), np.zeros(0), np.zeros(0)
    probed = False
    for _ in range(rounds):
        theta, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        rest = image - basis * theta
        rest = rest - locked @ (locked.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        most = max([*values, *theta[:1], 0.0])
        full = locked.shape[1] + basis.shape[1] >= d  # nothing is left outside the subspace
        good = 0
        while good < len(theta) and (size[good] <= tolerance * most or full) and (len(values) + good < k or (len(values) and theta[good] > values.min())):
            good += 1
        if good:
            locked, values, errors = np.hstack([locked, basis[:, :good]]), np.r_[values, theta[:good]], np.r_[errors, size[:good]]
            basis, image, theta, rest, size = basis[:, good:], image[:, good:], theta[good:], rest[:, good:], size[good:]
        if len(values) >= k and not (len(theta) and theta[0] > np.sort(values)[-k] and size[0] > tolerance * most):
            if probed or full:
                break
            probed = True
            extra = orthonormal(rng.normal(size=(d, min(4, d))), locked, basis)
            for _ in range(3):
                extra = orthonormal(product(extra), locked, basis)
        else:
            own = np.arange(min(len(theta), max(1, k - len(values)) + guard))
            own = own[size[own] > tolerance * most]
            u = basis[:, own]
            project = lambda z, u=u: (lambda y: y - u * (u * y).sum(axis=0))(z - locked @ (locked.T @ z))
            fix = minres(product, theta[own], project, project(-rest[:, own]), inner) if len(own) else rng.normal(size=(d, 1))
            keep = min(basis.shape[1], block)
            if basis.shape[1] + len(own) > 3 * block:
                basis, image = basis[:, :keep], image[:, :keep]
            extra = orthonormal(fix, locked, basis)
        if extra.shape[1]:
            basis, image = np.hstack([basis, extra]), np.hstack([image, product(extra)])
        if not basis.shape[1]:
            break
    else:
        raise ArithmeticError(f"{k - len(values)} of {k} eigenpairs have not converged")
    order = np.argsort(-values, kind="stable")[:k]
    vectors = locked[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return values[order], vectors, errors[order]


def spread_out(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: as int64 where that holds it, else as Python integers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total))
    return x * n - np.array(total, np.int64) if most < 1 << 62 else x.astype(object) * n - np.array(total, object)


def deviations(spread: np.ndarray) -> np.ndarray:
    most = int(max(abs(spread.max(initial=0)), abs(spread.min(initial=0)))) if spread.size else 0
    if spread.shape[1] * most * most < 1 << 63:
        return (spread.astype(np.int64) ** 2).sum(axis=1)
    return np.array([min(sum(int(v) ** 2 for v in r), 2**63 - 1) for r in spread], np.int64)


def whiten(vectors: DataFrame, k: int = 16, scale: float = 64.0, shift: int = 1_000_000, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and each of the k leading components."""
    spark = vectors.sparkSession
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(F.col(vector), lambda c: F.floor(F.greatest(F.lit(-float(HELD)), F.least(F.lit(float(HELD)), c.cast("double") * scale))) + shift)
    rows = vectors.where(fine).select(F.col(vec_id).alias("vec_id"), whole.alias("x"))
    kind = vectors.schema[vec_id].dataType.simpleString()
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = spark.createDataFrame([], f"vec_id {kind}, {OUT}")
    if common is None:
        return empty
    d = common.d
    rows = rows.where(F.size("x") == d)

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("x").flatten().to_numpy().astype(np.int64).tobytes())
            n += batch.num_rows
            if n >= TILE:
                yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["x"])
                held, n = [], 0
        if held:
            yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["x"])

    blocks = written(rows.select("x").distinct().mapInArrow(pack, "x binary"))
    tiles = lambda batch: (np.frombuffer(batch.column("x")[i].as_buffer(), np.int64).reshape(-1, d) for i in range(batch.num_rows))

    def sums(batch):
        # low and high parts apart, so that no sum leaves an int64
        each = [(len(x), (x & 0xFFFFFF).sum(axis=0), (x >> 24).sum(axis=0)) for x in tiles(batch)]
        return sum(np.concatenate([[n], low, high]) for n, low, high in each)

    found = [int(v) for v in tree_sum(blocks, sums, (2 * d + 1,), np.int64)]
    n, total = found[0], [low + (high << 24) for low, high in zip(found[1 : d + 1], found[d + 1 :])]
    centred = lambda x: (spread_out(x, n, total) / n).astype(np.float64)

    def product(columns: np.ndarray) -> np.ndarray:
        def part(batch):
            return sum((c.T @ (c @ columns) for c in map(centred, tiles(batch))), np.zeros_like(columns))

        return tree_sum(blocks, part, columns.shape) / n

    trace = float(tree_sum(blocks, lambda batch: sum(np.array([(c * c).sum()]) for c in map(centred, tiles(batch))), (1,))[0]) / n
    if not trace > 0:
        return empty
    values, axes, _ = jacobi_davidson(product, d, k)
    there = values > 100 * d * EPS * values[0]
    values, axes = values[there], axes[:, there]
    turn, k = axes / np.sqrt(values), len(values)

    def moments(batch):
        out = np.zeros((k + 1, k))
        for x in tiles(batch):
            w = centred(x) @ turn
            out += np.vstack([w.T @ w, w.sum(axis=0)])
        return out

    found = tree_sum(blocks, moments, (k + 1, k)) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())

    def project(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            spread = spread_out(x, n, total)
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(np.repeat(deviations(spread), k))]
            columns += [pa.array(((spread / n).astype(np.float64) @ turn).ravel()), pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, f"vec_id {kind}, {OUT}")
