"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first search.

*Index.*  The tree is fitted on a bounded sample: the SAMPLE_ROWS vectors with the smallest
hash (fewer if they are long, SAMPLE_BYTES).  Every node is split by k-means into up to
BRANCH children until its share of all vectors is about LEAF.  Every vector of the table is
then put into a leaf by descending to the nearest centroid.

*Search.*  A query walks the tree with a priority queue ordered by the inner product with
the centroids, always opening the best bin.  The number of leaves it visits is widened on
calibration queries from the sample, whose true neighbours are known there, until RECALL
is reached; if need be that is every leaf, which is exact.  A query whose leaves hold no more
than k vectors goes on to the next bins, so it has k neighbours if the table has.

*Spread.*  Leaves that stand next to each other in the tree are packed into bins of about
BLOCK vectors, and a query meets a whole bin if it visits one of its leaves.  A larger leaf
is dealt into blocks of BLOCK vectors, and the queries of a bin into blocks of BLOCK
queries, so a task never holds more than two blocks of vectors and one of queries, however
many vectors crowd into one leaf.  A query's k-th best score among the sample vectors in
its bins is a lower bound of its k-th best there; tasks return only what reaches it, at
most k per query, and Spark ranks them.

Nearness is the inner product in double precision, added up component by component, so
equal vectors have equal scores; ties go to the smaller vec_id.

Defined results: vectors that are null, empty, zero, of another length than most, or that
hold null or non-finite components take no part, nor do rows without vec_id.  Repeated
rows of one vec_id are one vector (the smallest).  Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from revlens.llm.store import shipped, stored, unpacked

K = 20
QUERY_STEP = 20
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 32 << 20
BRANCH = 16
LEAF = 512
CALIBRATION = 256
RECALL = 0.96
BLOCK = 4096
_SLICE = 256


def valid(column: str = "embedding"):
    c = F.col(column)
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(c, lambda x: x != 0), F.lit(False))


def _kmeans(x, k: int, rng, rounds: int = 10):
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmin((centre ** 2).sum(1) - 2 * (x @ centre.T), 1)
        count = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(count)
        centre[some] = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(count[some])[:-1])), axis=0) / count[some][:, None]
    return centre, np.argmin((centre ** 2).sum(1) - 2 * (x @ centre.T), 1)


class Tree:
    """Node 0 is the root; ``children`` maps inner nodes to (node numbers, centroids)."""

    def __init__(self, sample, least: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.children, self.leaves, todo, nodes = {}, [], [(0, np.arange(len(sample)))], 1
        while todo:
            node, rows = todo.pop()
            k = min(BRANCH, len(rows) // least)
            if k > 1:
                centre, own = _kmeans(sample[rows], k, rng)
                parts = [(i, rows[own == i]) for i in range(k) if (own == i).any()]
                if len(parts) > 1:
                    numbers = np.arange(nodes, nodes + len(parts))
                    nodes += len(parts)
                    self.children[node] = (numbers, centre[[i for i, _ in parts]])
                    todo += [(int(n), part) for n, (_, part) in zip(numbers, parts)]
                    continue
            self.leaves.append(node)
        self.visits = len(self.leaves)
        self.sample = self.ids = None

    def leaf_of(self, x):
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node not in self.children:
                out[rows] = node
                continue
            numbers, centre = self.children[node]
            own = np.argmin((centre ** 2).sum(1) - 2 * (x[rows] @ centre.T), 1)
            todo += [(int(n), rows[own == i]) for i, n in enumerate(numbers) if (own == i).any()]
        return out

    def visit(self, x, most: int, sizes=None, k: int = 0):
        """For each query the leaves opened, best bin first: ``most`` of them, and given the
        ``sizes`` of the leaves as many as hold more than ``k`` vectors (one may be its own)."""
        near = {node: x @ centre.T for node, (_, centre) in self.children.items()}
        for q in range(len(x)):
            queue, found, held = [(0.0, 0)], [], 0
            while queue and (len(found) < most or sizes is not None and held <= k):
                _, node = heapq.heappop(queue)
                if node in self.children:
                    for n, score in zip(self.children[node][0].tolist(), near[node][q].tolist()):
                        heapq.heappush(queue, (-score, n))
                else:
                    found.append(node)
                    held += sizes.get(node, 0) if sizes else 0
            yield found

    def bins(self, sizes: dict) -> dict:
        """leaf -> bin: leaves in tree order, filled up to BLOCK vectors."""
        order, todo = [], [0]
        while todo:
            node = todo.pop()
            if node in self.children:
                todo += self.children[node][0].tolist()[::-1]
            elif node in sizes:
                order.append(node)
        out, number, held = {}, 0, 0
        for leaf in order:
            if held and held + sizes[leaf] > BLOCK:
                number, held = number + 1, 0
            out[leaf], held = number, held + sizes[leaf]
        return out

    def bounds(self, ids, x, k: int, met):
        """A score that the k-th best of each query reaches at least, from the sample vectors
        it meets (``met``: queries x sample)."""
        score = x @ self.sample.T
        score[~met | (ids[:, None] == self.ids[None, :])] = -np.inf
        top = min(k, score.shape[1])
        edge = np.partition(score, score.shape[1] - top, axis=1)[:, score.shape[1] - top]
        slack = 1e-9 * (np.abs(x).sum(1) * np.abs(self.sample).max() + 1)
        return np.where(np.isfinite(edge) & (top == k), edge - slack, -np.inf)

    def calibrate(self, sample, k: int, recall: float):
        """Smallest number of visits that finds ``recall`` of the true neighbours."""
        leaf = self.leaf_of(sample)
        some = np.arange(0, len(sample), max(1, len(sample) // CALIBRATION))
        needed = []
        for q, found in zip(some, self.visit(sample[some], len(self.leaves))):
            score = sample @ sample[q]
            score[q] = -np.inf
            best = np.argpartition(-score, min(k, len(score) - 1) - 1)[:min(k, len(score) - 1)]
            place = {node: i + 1 for i, node in enumerate(found)}
            needed += [place[n] for n in leaf[best].tolist()]
        if needed:
            self.visits = int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
        return self


def _matrix(column):
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64).reshape(len(column), -1)


def fit(vectors: DataFrame, rows: int, dimension: int, k: int = K, recall: float = RECALL) -> Tree | None:
    most = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dimension)))
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
    sample = _matrix(picked.column("embedding")) if picked.num_rows else np.zeros((0, dimension))
    if not len(sample):
        return None
    least = max(16, int(LEAF * len(sample) / max(1, rows)))
    tree = Tree(sample, least).calibrate(sample, k, recall)
    tree.sample, tree.ids = sample, picked.column("vec_id").to_numpy()
    return tree


def _assign(shared):
    def run(batches):
        tree = unpacked(shared)
        for batch in batches:
            if batch.num_rows:
                leaf = tree.leaf_of(_matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(leaf)], ["vec_id", "embedding", "leaf"])
    return run


def _visits(shared, sizes: dict, bins: dict, sampled: dict, k: int):
    """``sampled``: vec_id -> leaf of the sample vectors, as they were placed."""
    def run(batches):
        tree = unpacked(shared)
        of_sample = np.array([bins[sampled[i]] for i in tree.ids.tolist()], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                x = _matrix(part.column("embedding"))
                found = [sorted({bins[leaf] for leaf in leaves if leaf in bins}) for leaves in tree.visit(x, tree.visits, sizes, k)]
                met = np.zeros((len(found), max(bins.values()) + 1), bool)
                for q, numbers in enumerate(found):
                    met[q, numbers] = True
                bounds = tree.bounds(part.column("vec_id").to_numpy(), x, k, met[:, of_sample])
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array(bounds), pa.array(found, pa.list_(pa.int64()))],
                                                 ["query_id", "query", "bound", "bins"])
    return run


def _nearest(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        qid, vid = queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()
        out = []
        if len(qid) and len(vid):
            q, v = _matrix(queries.column("query")), _matrix(vectors.column("embedding"))
            bound = queries.column("bound").to_numpy()
            for at in range(0, len(qid), _SLICE):
                part, ids = q[at:at + _SLICE], qid[at:at + _SLICE]
                near = part @ v.T
                near[ids[:, None] == vid[None, :]] = -np.inf
                top = min(k, len(vid))
                edge = np.partition(near, len(vid) - top, axis=1)[:, len(vid) - top]
                slack = 1e-9 * (np.abs(part).sum(1) * np.abs(v).max() + 1)
                least = np.maximum(edge - slack, bound[at:at + _SLICE])
                rows, cols = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                score = np.zeros(len(rows))
                for d in range(q.shape[1]):
                    score += part[rows, d] * v[cols, d]
                order = np.lexsort((vid[cols], -score, rows))
                rows, cols, score = rows[order], cols[order], score[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                keep = place < k
                out.append(pa.table({"query_id": ids[rows[keep]], "vec_id": vid[cols[keep]], "score": score[keep]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    return run


def search(embeddings: DataFrame, is_query=None, k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows."""
    spark = embeddings.sparkSession
    is_query = (F.col("vec_id") % QUERY_STEP == 0) if is_query is None else is_query
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .where("vec_id is not null").where(valid()).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    rows = stored(rows, "vectors")
    common = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    rows = rows.where(F.size("embedding") == common["d"])
    tree = fit(rows, common["n"], common["d"], k, recall)
    shared = shipped(spark, tree)  # the sample and its centroids: SAMPLE_BYTES bound it
    placed = stored(rows.mapInArrow(_assign(shared), "vec_id long, embedding array<double>, leaf long"), "leaves")
    # one number per leaf, and there are at most SAMPLE_ROWS / 16 leaves
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    bins = tree.bins(sizes)
    ids = F.broadcast(spark.createDataFrame([(i,) for i in tree.ids.tolist()], "vec_id long"))  # SAMPLE_ROWS at most
    sampled = dict(placed.select("vec_id", "leaf").join(ids, "vec_id").collect())
    bin_of = F.broadcast(spark.createDataFrame(sorted(bins.items()), "leaf long, bin long"))
    asked = (placed.where(is_query).select("vec_id", "embedding")
             .mapInArrow(_visits(shared, sizes, bins, sampled, k), "query_id long, query array<double>, bound double, bins array<long>"))
    asked = stored(asked.select("query_id", "query", "bound", F.explode("bins").alias("bin")), "visits")
    binned = placed.join(bin_of, "leaf")
    size = binned.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    load = asked.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("asks"))
    deal = F.broadcast(size.join(load, "bin"))  # one row per bin
    left = (asked.join(deal, "bin").withColumn("ask", F.pmod(F.xxhash64("query_id"), F.col("asks")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("query_id", "query", "bound", "bin", "block", "ask"))
    right = (binned.join(deal, "bin").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
             .withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select("vec_id", "embedding", "bin", "block", "ask"))
    by = ["bin", "block", "ask"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
