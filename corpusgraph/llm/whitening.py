"""Whitening of embeddings by the leading components of their covariance.

The components come from a Jacobi-Davidson iteration that never forms the covariance: it only asks for products of
the covariance with a few vectors, each of which is one Spark job over the distinct vectors (centred before
multiplying, summed by dimension). The driver holds blocks of `dimension x few` numbers. The correction equations
of all open pairs are solved together by projected MINRES, so that their steps share a product; Rayleigh-Ritz over
the search space follows; pairs are locked once their residual is at the level of double precision.

Defined results: a row whose vector is null, holds null, NaN or an infinity, or is shorter than the longest vector
(it lacks entries) is dropped. Repeated vectors count once in the fit and each keeps its rows in the result, null and
repeated ids included. Entries beyond a long, times 256, saturate. A component without variance (one row, equal
rows, rank below k) can't be whitened by and is left out, so such a table yields fewer components or no rows; so does
an empty one. A deviation beyond a long is null. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

#: An entry c becomes floor(SCALE * c).
SCALE = 256.0
#: Steps of the inner solver for one correction; pairs corrected at once, open ones first; vectors of the search space
#: before a restart; outer rounds at most.
INNER, PAIRS, SPACE, ROUNDS = 3, 16, 64, 200
EPS = float(np.finfo(np.float64).eps)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
LONG = 2**63


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S by dimension; unit components as columns, their eigenvalues, the covariance's trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def usable(df: DataFrame, vec: str, *ids: str) -> DataFrame:
    """(ids, x) of the rows that take part, x being the whole numbers."""
    c = F.col(vec).cast("array<double>")
    odd = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.filter(F.col(vec).isNotNull() & ~F.coalesce(odd, F.lit(True)))
    return rows.select(*ids, F.transform(c, lambda e: F.floor(F.lit(SCALE) * e).cast("long")).alias("x"))


def matrix(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _by_dimension(fit: DataFrame, width: int, columns: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(x) over all batches, each `width x columns`; partial sums meet by row in a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, columns))
        for batch in batches:
            total += part(matrix(batch, 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["dim", "part"])

    rows = map_arrow(fit.select("x"), run, "dim int, part array<double>", __name__)
    out = np.zeros((width, columns))
    for row in rows.groupBy("dim").agg(*[F.sum(F.get("part", F.lit(i))).alias(f"c{i}") for i in range(columns)]).collect():  # one row a dimension
        out[row["dim"]] = row[1:]
    return out


def _sums(fit: DataFrame, width: int) -> list[int]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            x = matrix(batch, 0, width)
            big = len(x) and int(max(x.max(), -int(x.min()))) * len(x) >= LONG
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0, dtype=object if big else np.int64), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(str, total))], names=["dim", "part"])

    rows = map_arrow(fit.select("x"), run, "dim int, part string", __name__).groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    found = {r["dim"]: int(r["s"]) for r in rows.collect()}  # one row a dimension
    return [found[i] for i in range(width)]


def fit(df: DataFrame, vec: str = "embedding", k: int = 4) -> Whitening | None:
    """The k leading components of the distinct vectors; None if no vector takes part."""
    rows = usable(df, vec)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    distinct = materialise(rows.filter(F.size("x") == width).distinct(), "whitening")
    n, sums = distinct.count(), _sums(distinct, width)
    mean = np.array([s / n for s in sums])
    centred = lambda x: x - mean

    def product(block: np.ndarray) -> np.ndarray:
        return _by_dimension(distinct, width, block.shape[1], lambda x: (c := centred(x)).T @ (c @ block)) / n

    trace = float(_by_dimension(distinct, width, 1, lambda x: (centred(x) ** 2).sum(axis=0)[:, None]).sum()) / n
    values, vectors = leading(product, width, min(k, width))
    keep = values > 8 * width * EPS * values[0] if len(values) else []
    values, vectors = values[keep], vectors[:, keep]
    scaled, m = vectors / np.sqrt(values), len(values)
    error = 0.0
    if m:
        got = _moments(distinct, width, m, lambda x: centred(x) @ scaled)
        at = got[:, m] / n
        error = float(np.abs(got[:, :m] / n - np.outer(at, at) - np.eye(m)).max())
    return Whitening(n, sums, vectors, values, trace, error)


def _moments(fit: DataFrame, width: int, m: int, whitened: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The m x m sums of products of the whitened vectors, with their sums in a last column."""

    def part(x: np.ndarray) -> np.ndarray:
        y, out = whitened(x), np.zeros((width, m + 1))
        out[:m, :m], out[:m, m] = y.T @ y, y.sum(axis=0)
        return out

    return _by_dimension(fit, width, m + 1, part)[:m]


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """What the columns of block add to an orthonormal basis, twice orthogonalised."""
    out = np.zeros((len(block), 0))
    for v in block.T:
        size = np.linalg.norm(v)
        for _ in range(2):
            for base in (against, out):
                v = v - base @ (base.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10 * size > 0:
            out = np.hstack([out, (v / left)[:, None]])
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Solutions of apply(t) = rhs for a symmetric apply, column by column, the columns' steps in common."""
    norm = lambda b: np.sqrt((b * b).sum(axis=0))
    over = lambda a, b: np.divide(a, b, out=np.zeros(np.broadcast_shapes(np.shape(a), np.shape(b))), where=np.broadcast_to(b > 0, np.broadcast_shapes(np.shape(a), np.shape(b))))
    first = beta = norm(rhs)
    v, before = over(rhs, beta), np.zeros_like(rhs)
    t, w, w_before = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    cos, sin = -np.ones_like(beta), np.zeros_like(beta)
    slant, far, left = np.zeros_like(beta), np.zeros_like(beta), beta.copy()
    coupling = np.zeros_like(beta)
    for _ in range(steps):
        if (left <= tolerance * first).all():
            break
        y = apply(v)
        alpha = (v * y).sum(axis=0)
        y = y - alpha * v - coupling * before
        coupling = norm(y)
        coupling[coupling <= 8 * EPS * np.maximum(np.abs(alpha), 1e-300)] = 0  # an invariant space: the solution is exact
        far_now, delta, diagonal = far, cos * slant + sin * alpha, sin * slant - cos * alpha
        far, slant = sin * coupling, -cos * coupling
        gamma = np.hypot(diagonal, coupling)
        cos, sin = over(diagonal, gamma), over(coupling, gamma)
        w, w_before = over(v - far_now * w_before - delta * w, gamma), w
        t = t + cos * left * w
        left = sin * left
        before, v = v, over(y, coupling)
    return t


def leading(product: Callable[[np.ndarray], np.ndarray], width: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors of the symmetric operator behind product.

    Jacobi-Davidson: the search space grows by the corrections of all open pairs, is restarted from its best Ritz
    vectors, and pairs are locked from the top as their residuals reach rounding level.
    """
    locked, values = np.zeros((width, 0)), []
    space = orthonormal(np.random.default_rng(seed).standard_normal((width, min(width, max(PAIRS, 2 * k)))), locked)
    image, scale, history = product(space), 0.0, []
    for _ in range(ROUNDS):
        inner = space.T @ image
        theta, ritz = np.linalg.eigh((inner + inner.T) / 2)
        theta, ritz = theta[::-1], ritz[:, ::-1]
        space, image = space @ ritz, image @ ritz
        scale = max([scale, *np.abs(theta)])
        want = k - len(values)
        residuals = image - space * theta
        residuals = residuals - locked @ (locked.T @ residuals)
        size = np.linalg.norm(residuals, axis=0)
        history.append((len(values), size[0]))
        whole = space.shape[1] + len(values) == width  # nothing is left to search
        # No gain in three rounds near rounding level: the products themselves are no more exact than this.
        still = len(history) > 3 and history[-4][0] == len(values) and size[0] > 0.5 * history[-4][1] and size[0] <= 1e-12 * scale
        ready = 0
        while ready < want and (whole or size[ready] <= 16 * EPS * scale or (still and ready == 0)):
            ready += 1
        if ready:
            values += list(theta[:ready])
            locked = np.hstack([locked, space[:, :ready]])
            space, image, residuals, theta, want = space[:, ready:], image[:, ready:], residuals[:, ready:], theta[ready:], want - ready
        if not want:
            break
        if space.shape[1] > SPACE:
            space, image = space[:, : max(PAIRS, 2 * k)], image[:, : max(PAIRS, 2 * k)]
        open_pairs = min(max(PAIRS, want), space.shape[1])
        base = np.hstack([locked, space[:, :open_pairs]])
        outside = lambda b: b - base @ (base.T @ b)  # noqa: B023, E731
        shift = theta[:open_pairs]
        found = minres(lambda b: outside(product(outside(b)) - shift * b), -outside(residuals[:, :open_pairs]), INNER, 1e-3)  # noqa: B023
        new = orthonormal(found, np.hstack([locked, space]))
        if not new.shape[1]:  # the corrections lie in the space already
            new = orthonormal(np.random.default_rng(seed + len(history)).standard_normal((width, want)), np.hstack([locked, space]))
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    else:
        raise RuntimeError("no convergence")
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order]


def whiten(df: DataFrame, model: Whitening | None, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """RESULT: a row for each usable row of df and each component."""
    spark = df.sparkSession
    if model is None or not len(model.values):
        return spark.createDataFrame([], RESULT)
    n, sums, m, width = model.n, model.sums, len(model.values), len(model.sums)
    mean, scaled = np.array([s / n for s in sums]), model.components / np.sqrt(model.values)
    explained, error, top = model.values / model.trace, model.identity_error, max(map(abs, sums))
    exact = [np.array(sums, dtype=object), np.array(sums, dtype=np.int64) if top < LONG else None]

    def deviations(x: np.ndarray) -> list[int | None]:
        most = n * int(max(x.max(), -int(x.min()))) + top
        if width * most * most < LONG:
            d = n * x - exact[1]
            return (d * d).sum(axis=1).tolist()
        d = n * x.astype(object) - exact[0]
        return [int(v) if v < LONG else None for v in (d * d).sum(axis=1)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, 1, width)
            y, rows = (x - mean) @ scaled, len(x)
            at = np.repeat(np.arange(rows), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)), pa.array(np.full(rows * m, n, dtype=np.int64)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(at)), pa.array(y.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * m, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    rows = usable(df, vec, F.col(vec_id).cast("long").alias("vec_id")).filter(F.size("x") == width)
    return map_arrow(rows, run, RESULT, __name__)
