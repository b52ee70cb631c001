"""A metric index for exact nearest neighbours: pivots, their cells, and bounds of distance.

Pivots are targets drawn by a hash. Every target lies in the cell of its nearest
pivot, and a cell keeps how near and how far its targets are from the pivot. A
query is measured against the pivots only; it meets the cells next to it first,
which bounds the distance of its k-th neighbour, and then only cells for which the
triangle inequality (a ring around the pivot) or the plane halfway between two
pivots leaves room for anything nearer. Cells that are small share a block with
cells next to them, large ones are cut (``blocks``). On data without any
structure every cell has to be met, and no query meets a block twice, so that
this costs what plain blocks would.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.errors import IndexCorruptedError
from fragmatch.operators import blocks
from fragmatch.operators.patches import stack
from fragmatch.plans.scratch import drop, save

#: The matrix of pivots goes to every task: at most so many bytes and pivots.
PIVOT_BYTES, MOST_PIVOTS = 16 << 20, 4096
SEED = 7
#: Queries that are measured against the pivots at a time, and rows of them that leave at a time, however many blocks they meet.
ASKED, SENT = 256, 8192
#: Relative room for rounding in bounds of distance.
ROOM = 1e-9


@dataclass
class MetricIndex:
    """``cells`` holds (key, cell, t, v); the arrays have an entry for each pivot: how many targets, the nearest and farthest, its block key."""

    pivots: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    key: np.ndarray
    cells: DataFrame

    def sizes(self) -> DataFrame:
        """(key, n) of blocks with targets: at most one row for each pivot."""
        n = np.bincount(self.key, self.count, len(self.key)).astype(int)
        return self.cells.sparkSession.createDataFrame([(k, int(x)) for k, x in enumerate(n) if x], "key long, n long")


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Plain distances of rows to pivots."""
    d = (v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * (v @ pivots.T)
    near = d < 1e-6 * ((v * v).sum(axis=1)[:, None] + 1e-300)  # what cancels is measured again
    r, c = np.nonzero(near)
    if len(r):
        d[r, c] = ((v[r] - pivots[c]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(d, 0))


def _neighbourhood(pivots: np.ndarray, count: np.ndarray, block_rows: int) -> np.ndarray:
    """A block key for every pivot: from pivot to nearest pivot not yet seen, cells share a block until it is full."""
    key, left, k, used, now = np.zeros(len(pivots), np.int64), np.ones(len(pivots), bool), -1, block_rows, 0
    for _ in range(len(pivots)):
        if used + count[now] > block_rows:
            k, used = k + 1, 0
        key[now], used = k, used + count[now]
        left[now] = False
        if left.any():
            rest = np.flatnonzero(left)
            now = rest[((pivots[rest] - pivots[now]) ** 2).sum(axis=1).argmin()]
    return key


def build(targets: DataFrame, target_id: str, vector: str = "descriptor", pivots: int | None = None, block_rows: int = blocks.BLOCK_ROWS) -> MetricIndex:
    """The index of all targets whose id and vector are not null; vectors have one length.

    By default there are as many pivots as the square root of the targets, within
    the bounds above. The cells are a saved table.
    """
    rows = targets.select(F.col(target_id).cast("long").alias("t"), F.col(vector).cast("array<double>").alias("v")).where("t is not null and v is not null")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    many = max(1, min(pivots or int(np.ceil(np.sqrt(n))), MOST_PIVOTS, PIVOT_BYTES // (8 * width)))
    drawn = rows.orderBy(F.xxhash64("t", F.lit(SEED)), "t", "v").limit(many).select("v").toPandas()["v"]
    at = np.unique(np.array(drawn.tolist(), float).reshape(-1, width), axis=0)
    held = rows.sparkSession.sparkContext.broadcast(at)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                d = distances(stack(part["v"], -1), held.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part["t"], part["v"], pa.array(d[np.arange(len(d)), cell])], names=["cell", "t", "v", "r"])

    placed = save(rows.mapInArrow(run, "cell int, t long, v array<double>, r double"))
    count, low, high = np.zeros(len(at), np.int64), np.full(len(at), np.inf), np.zeros(len(at))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect():  # one row for each pivot
        count[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["lo"], r["hi"]
    key = _neighbourhood(at, count, block_rows)
    keys = rows.sparkSession.createDataFrame([(c, int(x)) for c, x in enumerate(key)], "cell int, key long")
    cells = placed.join(F.broadcast(keys), "cell").select("key", "cell", "t", "v")  # at most MOST_PIVOTS rows
    cells._scratch_path = placed._scratch_path  # for scratch.drop
    return MetricIndex(at, count, low, high, key, cells)


def lower_bounds(index: MetricIndex, d: np.ndarray) -> np.ndarray:
    """(queries, pivots): no target of the cell is nearer than that, for distances ``d`` to the pivots; infinite for empty cells."""
    own = d.argmin(axis=1)
    ring = np.maximum(d - index.high[None], index.low[None] - d)
    apart = distances(index.pivots[own], index.pivots)
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d * d - d[np.arange(len(d)), own][:, None] ** 2) / (2 * apart)
    plane[apart == 0] = 0
    out = np.maximum(np.maximum(ring, plane), 0) * (1 - ROOM) - ROOM * d
    out[:, index.count == 0] = np.inf
    return out


def _first_cells(index: MetricIndex, d: np.ndarray, take: int) -> np.ndarray:
    """(queries, pivots): the cells nearest to each query that hold ``take`` targets together, whole blocks counted."""
    order = np.argsort(np.where(index.count[None] > 0, d, np.inf), axis=1, kind="stable")
    before = np.cumsum(index.count[order], axis=1) - index.count[order]
    out = np.zeros(d.shape, bool)
    np.put_along_axis(out, order, (before < take) & (index.count[order] > 0), axis=1)
    return out


def _visits(index: MetricIndex, take: int, first: bool, with_vectors: bool):
    """Rows (q, v, limit) to (key, q[, v, limit]): blocks that a query meets at first, or those that its limit leaves besides."""
    order = np.argsort(index.key, kind="stable")
    starts = np.flatnonzero(np.diff(index.key[order], prepend=-1))  # keys are 0, 1, ... without gaps
    by_key = lambda cells: np.logical_or.reduceat(cells[:, order], starts, axis=1)
    held = index.cells.sparkSession.sparkContext.broadcast((index.pivots, index.count, index.low, index.high, index.key))

    def run(batches):
        pivots, count, low, high, key = held.value
        own = MetricIndex(pivots, count, low, high, key, None)
        for batch in batches:
            for lo in range(0, batch.num_rows, ASKED):
                part = batch.slice(lo, ASKED)
                d = distances(stack(part["v"], -1), pivots)
                met = _first_cells(own, d, take)
                if not first:
                    limit = part["limit"].to_numpy()
                    bound = lower_bounds(own, d)
                    bound = np.where(bound > 0, bound * bound, 0)
                    more = bound <= (limit * (1 + ROOM) + ROOM * ROOM)[:, None]
                    more[:, count == 0] = False
                    met = by_key(more) & ~by_key(met)  # blocks of the first pass were met whole
                else:
                    met = by_key(met)
                q, k = np.nonzero(met)
                for at in range(0, len(q), SENT):
                    rows = pa.array(q[at : at + SENT])
                    cols = [pa.array(k[at : at + SENT].astype(np.int64)), part["q"].take(rows)]
                    if with_vectors:
                        cols += [part["v"].take(rows), part["limit"].take(rows)]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "q", "v", "limit"][: len(cols)])

    return run


def visits(index: MetricIndex, queries: DataFrame, take: int, first: bool) -> DataFrame:
    """(key, q) of ``queries`` (q, v, limit): the blocks that each query meets."""
    return queries.mapInArrow(_visits(index, take, first, False), "key long, q long")


def _pass(index: MetricIndex, queries: DataFrame, take: int, first: bool) -> DataFrame:
    asked = visits(index, queries, take, first).groupBy("key").agg(F.count("*").alias("m"))
    sent = queries.mapInArrow(_visits(index, take, first, True), "key long, q long, v array<double>, limit double")
    return blocks.meet(index.cells.select("key", "t", "v"), index.sizes(), sent, asked, take)


def nearest(index: MetricIndex, queries: DataFrame, take: int, limit: float = float("inf")) -> DataFrame:
    """(q, near): the ``take`` nearest targets of rows (q, v), at the squared distance ``limit`` or nearer, as lists of (d, t).

    Two passes: the cells next to a query, then those that its k-th distance so
    far does not exclude. Rows with a null id or vector take no part. Queries
    without any target in reach have no row.
    """
    if not len(index.pivots):
        return queries.select("q", F.lit(None).cast(blocks.NEAR).alias("near")).limit(0)
    asked = queries.select("q", "v").where("q is not null and v is not null").withColumn("limit", F.lit(float(limit)))
    first = save(blocks.merged(_pass(index, asked, take, True), take))
    worst = F.when(F.size("near") >= take, F.least(F.element_at("near", -1)["d"], F.lit(float(limit)))).otherwise(F.lit(float(limit)))
    so_far = first.select(F.col("q").alias("_q"), worst.alias("_w"))
    again = save(asked.join(so_far, F.col("q") == F.col("_q"), "left").select("q", "v", F.coalesce("_w", "limit").alias("limit")))
    more = _pass(index, again, take, False)
    both = first.select("q", F.lit(-1).cast("long").alias("part"), "near").unionAll(more)
    out = save(blocks.merged(both, take))
    drop(first, again)
    return out


def write(index: MetricIndex, path: str) -> None:
    """The index as two tables, pivots last, whose row counts tell whether the cells are whole; cells lie in the order of their keys."""
    spark = index.cells.sparkSession
    index.cells.repartitionByRange("key", "t").sortWithinPartitions("key", "t").write.mode("overwrite").parquet(f"{path}/cells")
    rows = [(k, [float(x) for x in p], int(n), float(a), float(b), int(c)) for k, (p, n, a, b, c) in enumerate(zip(index.pivots, index.count, index.low, index.high, index.key))]
    spark.createDataFrame(rows, "cell int, pivot array<double>, n long, low double, high double, key long").write.mode("overwrite").parquet(f"{path}/pivots")


def read(spark: SparkSession, path: str) -> MetricIndex:
    rows = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()  # bounded by MOST_PIVOTS and PIVOT_BYTES
    cells = spark.read.parquet(f"{path}/cells")
    if cells.count() != sum(r["n"] for r in rows):
        raise IndexCorruptedError(f"{path}: {sum(r['n'] for r in rows)} rows expected")
    col = lambda c, kind=float: np.array([r[c] for r in rows], kind)
    return MetricIndex(np.array([r["pivot"] for r in rows], float).reshape(len(rows), -1), col("n", np.int64), col("low"), col("high"), col("key", np.int64), cells)


def knn(index: MetricIndex, queries: DataFrame, k: int, query_id: str, vector: str = "descriptor", skip_self: bool = False, limit: float = float("inf")) -> DataFrame:
    """(q, rank, t, dist) like ``operators.knn.knn``, from an index that is built once."""
    take = k + (1 if skip_self else 0)
    q = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    return ranked(nearest(index, q, take, limit), k, skip_self)


def ranked(near: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """(q, rank, t, dist) of lists (q, near), without a query itself if asked."""
    if skip_self:
        near = near.select("q", F.slice(F.filter("near", lambda x: x["t"] != F.col("q")), 1, k).alias("near"))
    out = near.select("q", F.posexplode("near").alias("pos", "x"))
    return out.select("q", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.t").alias("t"), F.col("x.d").alias("dist"))
