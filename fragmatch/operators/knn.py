"""Exact k-nearest-neighbour joins by squared L2 distance, in blocks.

If the query matrix is proven small (its size is counted first) it is broadcast
to the targets, which stay where they are, and each partition keeps a running
best k; otherwise a metric index of the targets is built, and queries meet the
blocks that it can't exclude. Either way a partial top-k leaves the kernel, one
row per query and block, and two aggregations merge them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmatch.functions.kernels import nearest
from fragmatch.operators import metric
from fragmatch.operators.blocks import BLOCK_ROWS, NEAR, merged, near_lists
from fragmatch.operators.patches import stack
from fragmatch.plans.scratch import drop

#: Query matrices up to this size are broadcast.
BROADCAST_BYTES = 64 << 20
#: Queries and targets that a sieve compares at a time: their distances stay in the processor's cache.
SIEVE_QUERIES, SIEVE_TARGETS = 512, 1024


def _broadcast_join(queries: DataFrame, targets: DataFrame, k: int, limit: float) -> DataFrame:
    rows = queries.toArrow()  # size checked by the caller
    ids = rows["q"].to_numpy()
    width = len(rows["v"][0]) if len(rows) else 0
    matrix = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width) if len(rows) else np.zeros((0, 0))
    held = queries.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches):
        q_ids, q = held.value
        if not len(q_ids):
            return
        d, i = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                nd, ni = nearest(q, stack(part["v"], -1), part["t"].to_numpy(), k, np.minimum(d[:, -1], limit))
                new = np.flatnonzero(np.isfinite(nd[:, 0]))
                both, who = np.concatenate([d[new], nd[new]], axis=1), np.concatenate([i[new], ni[new]], axis=1)
                order = np.lexsort((who, both), axis=1)[:, :k]
                d[new], i[new] = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)
        found = np.flatnonzero(np.isfinite(d[:, 0]))
        for at in range(0, len(found), 8192):
            rows = found[at : at + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64()), near_lists(d[rows], i[rows])], names=["q", "part", "near"])

    return targets.mapInArrow(run, f"q long, part long, near {NEAR}")


class Sieve:
    """Tells of targets, some at a time, which may be among the ``k`` nearest of any query, at its limit or nearer.

    It keeps the k smallest distances to each query so far: a target that is
    farther from every query than these is none of its k nearest. Equal
    distances pass, as ids decide. Distances come from one product in single
    precision, with room for its error, and are measured again exactly.
    """

    def __init__(self, q: np.ndarray, k: int, limit: float):
        self.q, self.k = q, k
        self.best = np.full((len(q), k), float(limit))
        self.size = (q * q).sum(axis=1)
        self.axes = None
        if q.size:
            # products need the queries' span only, which may have fewer axes than the vectors
            _, s, axes = np.linalg.svd(q.T @ q, hermitian=True)
            axes = axes[: int((s > s[0] * 1e-12).sum())].T
            if axes.shape[1] < q.shape[1] and np.abs(q - q @ axes @ axes.T).max() < 1e-10:
                self.axes = axes
        own = q if self.axes is None else q @ self.axes
        self.room = 2e-7 * (q.shape[1] + 8)
        #: |q|^2 + |t|^2 - 2 q t - limit as one product: (-2 q, 1, |q|^2 - limit) by (t, |t|^2, 1)
        self.left = np.concatenate([own * -2, np.ones((len(q), 1)), np.zeros((len(q), 1))], axis=1).astype(np.float32)
        self.made = np.empty((SIEVE_QUERIES, SIEVE_TARGETS), np.float32)

    def __call__(self, v: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(v), bool)
        if not len(self.q) or not len(v):
            return keep
        size = (v * v).sum(axis=1)
        room = self.room * (size.max(initial=0.0, where=np.isfinite(size)) + self.size.max())
        right = np.concatenate([v if self.axes is None else v @ self.axes, size[:, None], np.ones((len(v), 1))], axis=1).astype(np.float32)
        self.left[:, -1] = self.size - self.best[:, -1] - room
        for lo in range(0, len(v), SIEVE_TARGETS):
            some = right[lo : lo + SIEVE_TARGETS].T
            for at in range(0, len(self.q), SIEVE_QUERIES):
                rows = self.left[at : at + SIEVE_QUERIES]
                rough = np.matmul(rows, some, out=self.made[: len(rows), : some.shape[1]]) if some.shape[1] == SIEVE_TARGETS else rows @ some
                met = np.flatnonzero(~(rough.min(axis=1) > 0))  # few; also queries beside a target that is no number
                near = np.flatnonzero(rough[met] <= 0)
                for k in range(0, len(near), BLOCK_ROWS):
                    r, c = np.divmod(near[k : k + BLOCK_ROWS], some.shape[1])
                    self._take(met[r] + at, c + lo, v, keep)
        return keep

    def _take(self, r: np.ndarray, c: np.ndarray, v: np.ndarray, keep: np.ndarray) -> None:
        d = ((v[c] - self.q[r]) ** 2).sum(axis=1)
        close = d <= self.best[r, -1]
        r, c, d = r[close], c[close], d[close]
        keep[c] = True
        order = np.lexsort((d, r))
        r, d = r[order], d[order]
        who, first, n = np.unique(r, return_index=True, return_counts=True)
        rank = np.arange(len(r)) - np.repeat(first, n)
        new = np.full((len(who), self.k), np.inf)
        some = rank < self.k
        new[np.repeat(np.arange(len(who)), n)[some], rank[some]] = d[some]
        self.best[who] = np.sort(np.concatenate([self.best[who], new], axis=1), axis=1)[:, : self.k]


def sift(queries: DataFrame, k: int, vector: str = "descriptor", limit: float = float("inf"), broadcast_bytes: int = BROADCAST_BYTES):
    """What makes a ``Sieve`` of ``queries`` in each task, or null if they are too many to broadcast.

    Of all targets that come through, a search for the ``k`` nearest at ``limit`` or nearer needs only those that sieves let pass.
    """
    q = queries.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    n, width = q.agg(F.count("*"), F.max(F.size("v"))).first()
    if n * (width or 0) * 8 > broadcast_bytes:
        return None
    rows = q.toArrow()["v"].combine_chunks()  # size checked
    held = q.sparkSession.sparkContext.broadcast(stack(rows, width) if n else np.zeros((0, 0)))
    return lambda: Sieve(held.value, k, limit)


def knn(queries: DataFrame, targets: DataFrame, k: int, query_id: str, target_id: str, vector: str = "descriptor", skip_self: bool = False, broadcast_bytes: int = BROADCAST_BYTES, limit: float = float("inf")) -> DataFrame:
    """(q, rank, t, dist): the ``k`` nearest targets of every query, rank from 1.

    Ids are bigint. Rows with a null vector or id take no part; with fewer
    targets than ``k`` all are given. ``skip_self`` leaves out targets of the
    query's own id. Equal distances go to the smaller target id. With a
    ``limit``, farther targets are left out, which prunes most of the work.
    """
    vec = F.col(vector).cast("array<double>").alias("v")
    q = queries.select(F.col(query_id).cast("long").alias("q"), vec).where("q is not null and v is not null")
    t = targets.select(F.col(target_id).cast("long").alias("t"), vec).where("t is not null and v is not null")
    n_q, width = q.agg(F.count("*"), F.max(F.size("v"))).first()
    take = k + (1 if skip_self else 0)
    if n_q * (width or 0) * 8 <= broadcast_bytes:
        return metric.ranked(merged(_broadcast_join(q, t, take, limit), take), k, skip_self)
    index = metric.build(t, "t", "v")
    near = metric.nearest(index, q, take, limit)  # a saved table
    drop(index.cells)
    return metric.ranked(near, k, skip_self)


def within(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits at ``threshold`` or nearer."""
    return hits.where(F.col("dist") <= threshold)


def of_targets(hits: DataFrame, ids, image_col: str = "image_id") -> DataFrame:
    """Hits in some images only, applied after the top k as a filter that can starve."""
    return hits.where(F.col(image_col).isin(list(ids))) if not isinstance(ids, DataFrame) else hits.join(ids, image_col, "left_semi")


def sharded_knn(queries: DataFrame, targets: DataFrame, k: int, query_id: str, target_id: str, shard: str, vector: str = "descriptor") -> DataFrame:
    """(q, rank, t, dist) as ``knn`` over targets that lie in shards: best k of each shard, then of all.

    A shard is no unit of work: its rows spread over partitions, so that a
    large one is no bottleneck, and the merge gives what a merge of the shards'
    own best would.
    """
    return knn(queries, targets.repartition(F.col(shard), F.pmod(F.xxhash64(target_id), F.lit(16))), k, query_id, target_id, vector)


def by_image(hits: DataFrame, score: str, top: int) -> DataFrame:
    """The best hit of each image, and of these the ``top`` best."""
    ranked = hits.groupBy("image_id").agg(F.max_by(F.struct(*[c for c in hits.columns if c != "image_id"]), F.struct(F.col(score), (-F.col("match_ord")))).alias("b"))
    return ranked.select("image_id", "b.*").orderBy(F.desc(score), "image_id").limit(top)
