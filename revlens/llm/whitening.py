"""Embedding whitening by distributed Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers x = floor(256 c).  The distinct ones are the fit list, written once as
blocks of rows.  With X the centred fit list, the driver holds right vectors V and the products
Z = X'U (dimensions x steps); a step is two passes over the blocks:

1. every task recomputes its rows of the left vectors U from the recurrence X V = U R, takes
   p = X v and returns its share of U'p;
2. every task takes r = p - U (U'p) and returns its share of U'r, r'r and X'r.

The second product U'r corrects the first (full reorthogonalisation, twice), so the next column of the
triangular R, the next column of Z and, after taking V out of it twice, the next v follow.  U is
never stored: its rows are a function of X, V and R, so a lost task is simply run again.  In
exact arithmetic R is upper bidiagonal; what rounding leaves above is kept.  When the next v vanishes
(repeated or zero deviations), a seeded vector orthogonal to V takes its place; a v whose product
lies in the span of U adds a column to R and no row.  The SVD of the
small R gives components V P and deviations.  All steps up to the dimension or the rank are
taken, except that from CHECK steps on the search ends when the residuals |Z R p - s^2 V p| of the wanted
components are below TOLERANCE and a restart from a new vector has not changed them.

Only sums of the size of the dimension and the steps leave the tasks, from MOST_SHARES tasks at most.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries take no part,
nor do vectors whose length is not the most frequent one (ties: the longer).  Repeated rows are
kept in the result and count once in the fit.  Components with no variance do not exist, so
equal vectors, a single row or an empty table give no rows.  ``deviation`` is null where it does not fit
a long.  A null vec_id stays null; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revlens.llm.store import stored

SCALE = 256
COMPONENTS = 4
BLOCK_BYTES = 2 << 20    # of one block of the fit list
TASK_BYTES = 8 << 20     # of blocks that are worth a task
MOST_SHARES = 4096       # tasks of a pass, and so rows of sums that reach the driver
TOLERANCE = 1e-13        # of a residual, against the largest variance
VANISHED = 1e-12         # a deviation this small against the largest is none
CHECK = 128              # steps before an early end is looked for
RESTART_STEPS = 16       # further steps that must not change the components
SEED = 12


def usable(embedding: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & finite, F.lit(False))


def integers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    rows = embeddings.where(usable(F.col(vector))).select(
        "vec_id", F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def matrix(column: pa.Array):
    """The vectors of a list column as rows of an int64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class FitList:
    """The distinct vectors in blocks: ``n`` rows of ``d`` integers, exact ``sums``, ``mean``."""

    def __init__(self, rows: DataFrame):
        def packed(batches):
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(0))
                    step = max(1, BLOCK_BYTES // (8 * x.shape[1]))
                    parts = [x[i:i + step] for i in range(0, len(x), step)]
                    yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["n", "x"])
        blocks = stored(rows.select("x").distinct().mapInArrow(packed, "n long, x binary"), "fit-list")
        self.n = blocks.agg(F.sum("n")).first()[0] or 0
        first = rows.select(F.size("x")).first()
        self.d = first[0] if first else 0
        self.blocks = blocks.select("x").coalesce(max(1, min(MOST_SHARES, -(-8 * self.n * self.d // TASK_BYTES))))
        if self.n:
            # in two halves, whose sums over the rows of a task fit a long
            sums = self.total(lambda x: np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]), raw=True)
            self.sums = [(int(a) << 32) + int(b) for a, b in zip(sums[:self.d], sums[self.d:])]
            self.mean = np.array([s / self.n for s in self.sums])

    def total(self, share, raw: bool = False):
        """The sum over all blocks of ``share`` of a block's centred (or raw) rows.  A task gives one row;
        there are at most MOST_SHARES, added up in order, so reruns agree."""
        d, mean, kind = self.d, None if raw else self.mean, pa.int64() if raw else pa.float64()

        def shares(batches):
            total = 0
            for batch in batches:
                for data in batch.column("x").to_pylist():
                    x = np.frombuffer(data, np.int64).reshape(-1, d)
                    total = total + share(x if raw else x.astype(float) - mean)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(kind))], ["v"])
        rows = self.blocks.mapInArrow(shares, "v array<long>" if raw else "v array<double>").toArrow().column("v").to_pylist()
        return sum(np.array(r, object if raw else float) for r in rows)


def left_vectors(x, v, r, pivots):
    """The rows of U that belong to the rows of ``x``: X V = U R, where column ``pivots[i]`` of R is
    the first with an entry in row i."""
    u = np.empty((len(x), len(pivots)))
    for i, j in enumerate(pivots):
        u[:, i] = (x @ v[:, j] - u[:, :i] @ r[:i, j]) / r[i, j]
    return u


def apart(vector, basis):
    """``vector`` less its part in the span of ``basis``, taken out twice."""
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def bidiagonalise(fit: FitList, wanted: int = COMPONENTS, check: int = CHECK):
    """(components, variances): unit vectors as columns by falling variance, those that vanish left out."""
    d, random = fit.d, np.random.default_rng(SEED)
    v, z, r, pivots = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((0, 0)), []
    scale = float(np.sqrt(fit.total(lambda x: np.array([(x * x).sum()]))[0]))
    if not scale:
        return v, np.zeros(0)
    nxt, settled = random.standard_normal(d), None
    while v.shape[1] < d:
        while True:  # orthogonal to V, also where little but rounding was left
            left = apart(nxt / np.linalg.norm(nxt), v)
            if np.linalg.norm(left) > 0.5:
                break
            nxt = left
        nxt, rank = left / np.linalg.norm(left), len(pivots)
        first = fit.total(lambda x: left_vectors(x, v, r, pivots).T @ (x @ nxt)) if rank else np.zeros(0)

        def second(x):
            u = left_vectors(x, v, r, pivots)
            p = x @ nxt - u @ first
            return np.concatenate([u.T @ p, [p @ p], x.T @ p])
        sums = fit.total(second)
        again, alpha = sums[:rank], np.sqrt(max(0.0, sums[rank] - sums[:rank] @ sums[:rank]))
        v, r = np.column_stack([v, nxt]), np.column_stack([r, first + again])
        if alpha > VANISHED * scale:
            r = np.vstack([r, np.append(np.zeros(v.shape[1] - 1), alpha)])
            pivots.append(v.shape[1] - 1)
            z = np.column_stack([z, (sums[rank + 1:] - z @ again) / alpha])
            nxt = apart(z[:, -1], v)
        if alpha <= VANISHED * scale or np.linalg.norm(nxt) <= VANISHED * scale:
            nxt = random.standard_normal(d)
        if v.shape[1] >= check and v.shape[1] % RESTART_STEPS == 0:
            _, s, p = np.linalg.svd(r)
            p = p[:wanted].T
            residual = np.linalg.norm(z @ (r @ p) - v @ p * s[:wanted] ** 2, axis=0).max() / s[0] ** 2
            if residual > TOLERANCE:
                settled = None
            elif settled is not None and np.allclose(settled, s[:wanted], rtol=1e-12, atol=0):
                break
            else:
                settled, nxt = s[:wanted], random.standard_normal(d)
    _, s, p = np.linalg.svd(r)
    s = s[:wanted]
    components = v @ p[:len(s)][s > VANISHED * scale].T
    return components / np.linalg.norm(components, axis=0), s[s > VANISHED * scale] ** 2 / fit.n


def deviations(x, n: int, sums: list[int]):
    """Per row the exact sum over dimensions of (n x - S)^2, None beyond a long."""
    reach = max(abs(n * int(m) - s) for edge in (x.min(0), x.max(0)) for m, s in zip(edge, sums))
    if reach * reach * len(sums) < 1 << 63 and max(map(abs, sums)) + reach < 1 << 63:
        off = x * np.int64(n) - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS, check: int = CHECK) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that takes
    part and every component with variance, up to ``components``."""
    rows = stored(integers(embeddings, vector), "integers")
    fit = FitList(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not fit.n:
        return rows.sparkSession.createDataFrame([], schema)
    axes, variances = bidiagonalise(fit, components, check)
    k = len(variances)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    weights = axes / np.sqrt(variances)
    moments = fit.total(lambda x: np.concatenate([((x @ weights).T @ (x @ weights)).ravel(), (x @ weights).sum(0), [(x * x).sum()]])) / fit.n
    error = float(np.abs(moments[:k * k].reshape(k, k) - np.outer(moments[k * k:-1], moments[k * k:-1]) - np.eye(k)).max())
    explained = variances / moments[-1]
    n, sums, mean = fit.n, fit.sums, fit.mean

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)), pa.array(((x - mean) @ weights).ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, schema)
