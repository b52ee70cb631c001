"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance by one more component that
gives all indexed vectors the same norm. Each of ``TABLES`` tables hashes a
vector by M Gaussian projections, floor((a.v + b) / w); M grows with the
logarithm of the number of vectors. A query visits its own bucket and then
perturbed ones (-1, 0 or +1 in each projection) in the order of the squared
distances to the cell walls, which estimates their success; the best ones are
built up projection by projection, so that the 3^M of them are never listed.
How many are visited is fitted on a bounded sample, to ``FIT_RECALL`` there,
with fewer projections where ``MOST_PROBES`` visits would miss it; recall rises
with the number of vectors. Candidates of all tables are merged, reranked by
the exact measure.

Equal vectors are folded first: of their ids only the smallest k + 1 can be
found, and equal queries are asked once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragmatch.llm.vectors import common_size, matrix, packed, stacked, usable
from fragmatch.plans.scratch import drop, save

TABLES = 2
WIDTH = 2.0  # of a cell, in standard deviations of a projection
#: The number of probes is fitted on so many vectors, drawn by a hash of the id, and so many of them as queries.
FIT_ROWS, FIT_QUERIES, FIT_RECALL = 8192, 200, 0.95
#: Where more visits than this would be needed, cells are made larger by taking fewer projections.
MOST_PROBES = 2187
#: Vectors and queries of a bucket that meet in one task.
BLOCK, QUERY_BLOCK = 512, 256


@dataclass(frozen=True)
class Hasher:
    size: int
    radius: float
    a: np.ndarray  # (tables, size + 1, M)
    b: np.ndarray
    probes: int

    @property
    def m(self) -> int:
        return self.a.shape[2]

    def cells(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """(tables, rows, M) positions in units of a cell."""
        norm = np.linalg.norm(vectors, axis=1)
        if query:
            full = np.column_stack([vectors / norm[:, None], np.zeros(len(vectors))])
        else:
            v = vectors / self.radius
            full = np.column_stack([v, np.sqrt(np.maximum(0.0, 1 - (v * v).sum(axis=1)))])
        return np.einsum("nd,tdm->tnm", full, self.a) / WIDTH + self.b[:, None, :]

    def key(self, cells: np.ndarray, table: int) -> np.ndarray:
        """One number for each row of whole cells."""
        h = np.full(cells.shape[:-1], table + 1, np.uint64)
        for k in range(cells.shape[-1]):
            h = (h ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def probed(self, vectors: np.ndarray, most: int | None = None) -> np.ndarray:
        """(rows, tables, probes) bucket keys, the likeliest first."""
        at = self.cells(vectors, True)
        base = np.floor(at)
        walls = wall_distances(at)
        return np.stack([self.key(base[t][:, None, :] + perturbations(walls[t], most or self.probes)[0], t) for t in range(len(base))], axis=1)


def wall_distances(at: np.ndarray) -> np.ndarray:
    """(..., M, 3): the squared distances that steps of -1, 0 and +1 go, from positions in units of a cell."""
    low = at - np.floor(at)
    return np.stack([low**2, np.zeros_like(low), (1 - low) ** 2], axis=-1)


def perturbations(walls: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, n, M) steps and (rows, n) scores of the ``most`` perturbations with the smallest scores, in their order.

    After each projection the best partial ones are kept: what is among the
    best in the end begins with one of them.
    """
    rows, m, _ = walls.shape
    score, code = np.zeros((rows, 1)), np.zeros((rows, 1), np.int64)
    for k in range(m):
        score = (score[:, :, None] + walls[:, k, None, :]).reshape(rows, -1)
        code = (code[:, :, None] * 3 + np.arange(3)).reshape(rows, -1)
        if score.shape[1] > most:
            best = np.argpartition(score, most - 1, axis=1)[:, :most]
            score, code = np.take_along_axis(score, best, 1), np.take_along_axis(code, best, 1)
    order = np.lexsort((code, score), axis=1)
    score, code = np.take_along_axis(score, order, 1), np.take_along_axis(code, order, 1)
    steps = np.zeros((*code.shape, m), np.int64)
    for k in range(m - 1, -1, -1):
        steps[..., k] = code % 3 - 1
        code //= 3
    return steps, score


def make_hasher(count: int, size: int, radius: float) -> Hasher:
    m = max(0, int(np.log2(max(count, 1) / 64) / 2)) if count >= 256 else 0
    rng = np.random.Generator(np.random.PCG64(7))
    return Hasher(size, radius, rng.standard_normal((TABLES, size + 1, m)), rng.random((TABLES, m)), min(3**m, MOST_PROBES))


def fit(hasher: Hasher, sample: np.ndarray, k: int) -> Hasher:
    """The least number of probes that reaches ``FIT_RECALL`` among ``sample``, by as many projections as can.

    Without projections all vectors share a bucket, and search is exact.
    """
    if hasher.m == 0 or len(sample) <= k + 1:
        return hasher
    q = sample[: min(FIT_QUERIES, len(sample))]
    exact = q @ sample.T
    exact[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argpartition(-exact, k, axis=1)[:, :k]
    for m in range(hasher.m, 0, -1):
        now = replace(hasher, a=hasher.a[:, :, :m], b=hasher.b[:, :m])
        most = min(3**m, MOST_PROBES)
        rank = np.full((len(q), k), most)
        at, cells = now.cells(q, True), np.floor(now.cells(sample, False))
        for t in range(len(at)):
            walls = wall_distances(at[t])
            step = cells[t][top] - np.floor(at[t])[:, None, :]
            near = (np.abs(step) <= 1).all(axis=2)
            score = np.take_along_axis(walls[:, None], np.clip(step, -1, 1).astype(int)[..., None] + 1, 3)[..., 0].sum(axis=2)
            listed = perturbations(walls, most)[1]
            for i in range(len(q)):
                place = np.searchsorted(listed[i], score[i] + 1e-12, side="right") - 1  # the last of equal ones
                inside = near[i] & (score[i] <= listed[i, -1] - 1e-12 if most < 3**m else True)
                rank[i] = np.where(inside, np.minimum(rank[i], place), rank[i])
        ranks = np.sort(rank.ravel())
        need = int(ranks[int(np.ceil(FIT_RECALL * len(ranks))) - 1]) + 1
        if need <= most:
            return replace(now, probes=need)
    return replace(hasher, a=hasher.a[:, :, :0], b=hasher.b[:, :0], probes=1)


def _nearest(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """For each query its ``k`` best of ``vectors``: lists of ids and of exact scores."""
    scores = queries @ vectors.T
    out_ids, out_scores = [], []
    for i in range(len(queries)):
        s = scores[i]
        if len(s) > k:
            cut = np.partition(s, len(s) - k)[len(s) - k]
            near = np.flatnonzero(s >= cut - 1e-9 * (1 + abs(cut))) if np.isfinite(cut) else np.flatnonzero(np.isfinite(s))
        else:
            near = np.flatnonzero(np.isfinite(s))
        exact = (vectors[near] * queries[i]).sum(axis=1)
        order = np.lexsort((ids[near], -exact))[:k]
        out_ids.append(ids[near][order])
        out_scores.append(exact[order])
    return out_ids, out_scores


def _rerank(size: int, k: int):
    """Rows sorted by block, vectors before queries: each query's best in the block."""

    def run(batches):
        now, v, v_ids, ready = None, [], [], None
        for batch in batches:
            key = np.stack([batch["key"].to_numpy(), batch["sub"].to_numpy(), batch["role"].to_numpy().astype(np.int64)], axis=1)
            ids, vec = batch["id"].to_numpy(), stacked(batch["vec"], size)
            cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            got_q, got_ids, got_scores = [], [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if (block := tuple(key[lo, :2])) != now:
                    now, v, v_ids, ready = block, [], [], None
                if key[lo, 2] == 0:
                    v.append(vec[lo:hi])
                    v_ids.append(ids[lo:hi])
                elif v:
                    if ready is None:
                        ready = np.concatenate(v), np.concatenate(v_ids)
                    for at in range(lo, hi, 512):
                        to = min(hi, at + 512)
                        i, s = _nearest(vec[at:to], *ready, k)
                        got_q += ids[at:to].tolist()
                        got_ids += i
                        got_scores += s
            if got_q:
                near = [[{"s": float(x), "id": int(y)} for x, y in zip(s, i)] for s, i in zip(got_scores, got_ids)]
                yield pa.RecordBatch.from_arrays([pa.array(got_q, pa.int64()), pa.array(near, pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())])))], names=["query_id", "near"])

    return run


def _merge(k: int):
    """Rows sorted by query: the best ``k`` of all that its blocks gave, each candidate once."""

    def run(batches):
        now, scores, ids, out = None, [], [], []

        def close():
            if now is not None:
                s, i = np.concatenate(scores), np.concatenate(ids)
                i, first = np.unique(i, return_index=True)
                order = np.lexsort((i, -s[first]))[:k]
                out.append((np.full(len(order), now), np.arange(1, len(order) + 1), i[order], s[first][order]))

        def table():
            q, r, i, s = (np.concatenate(c) for c in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r.astype(np.int32)), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            q, flat = batch["query_id"].to_numpy(), batch["near"].flatten()
            end = np.concatenate([[0], np.cumsum(pc.list_value_length(batch["near"]).to_numpy(zero_copy_only=False))])
            s, i = flat.field("s").to_numpy(), flat.field("id").to_numpy()
            cuts = np.flatnonzero(q[1:] != q[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(q)]):
                if q[lo] != now:
                    close()
                    now, scores, ids = q[lo], [], []
                scores.append(s[end[lo] : end[hi]])
                ids.append(i[end[lo] : end[hi]])
            if len(out) > 4096:
                yield table()
                out.clear()
        close()
        if out:
            yield table()

    return run


def _merged(hits: DataFrame, k: int) -> DataFrame:
    return hits.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def _hits(index: DataFrame, sizes: DataFrame, probes: DataFrame, asked: DataFrame, size: int, k: int) -> DataFrame:
    """(query_id, near): the best of each visited block.

    The vectors of a large bucket are cut into blocks, and so are its queries;
    each block of the ones meets each of the others, in a task of its own.
    """
    blocks = sizes.join(asked.groupBy("key").agg(F.count("*").alias("q")), "key")
    blocks = save(blocks.select("key", F.ceil(F.col("n") / F.lit(BLOCK)).alias("blocks"), F.ceil(F.col("q") / F.lit(QUERY_BLOCK)).alias("parts")))
    one = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    vectors = index.join(blocks, "key").select("key", one("blocks").alias("block"), every("parts").alias("part"), "parts", F.lit(0).alias("role"), "id", "vec")
    queries = probes.join(blocks, "key").select("key", every("blocks").alias("block"), one("parts").alias("part"), "parts", F.lit(1).alias("role"), "id", "vec")
    dealt = vectors.unionAll(queries).select("key", (F.col("block") * F.col("parts") + F.col("part")).alias("sub"), "role", "id", "vec")
    return dealt.repartition("key", "sub").sortWithinPartitions("key", "sub", "role").mapInArrow(_rerank(size, k), "query_id long, near array<struct<s:double,id:long>>")


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vec: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row where ``is_query`` holds.

    Nearness is the inner product, ties go to the smaller id. Vectors that are
    null, empty, zero, hold null or non-finite components, or are not of the
    usual length take no part, as rows with a null id. Repeated rows count
    once; of rows with one id and different vectors, each is asked if it is a
    query, and the best of them found. Queries that their probes give too few
    candidates are compared with every block.
    """
    spark = rows.sparkSession
    good = rows.where(F.col(id_col).isNotNull() & usable(F.col(vec))).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    size = common_size(good, "v")
    good = good.where(F.size("v") == size).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), "q")
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    folded = save(good.select("id", "v").distinct().withColumn("r", least).where(F.col("r") <= k + 1).select("id", "v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    count, radius = folded.agg(F.count("*"), F.max(norm)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hasher = make_hasher(count, size, radius * (1 + 1e-12))
    sample = folded.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(FIT_ROWS).select("v").toPandas()["v"]
    hasher = fit(hasher, np.array(sample.tolist(), np.float64), k)
    held = spark.sparkContext.broadcast(hasher)

    def hashed(batches):
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch["v"])
                cells = np.floor(held.value.cells(v, False))
                for t in range(len(cells)):
                    yield pa.RecordBatch.from_arrays([pa.array(held.value.key(cells[t], t)), batch["id"], packed(v)], names=["key", "id", "vec"])

    def asked(with_vectors: bool):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    v = matrix(part["v"])
                    keys = held.value.probed(v).reshape(len(v), -1)
                    n = keys.shape[1]
                    cols = [pa.array(keys.ravel()), pa.array(np.repeat(part["id"].to_numpy(), n))]
                    if with_vectors:
                        cols.append(packed(v).take(pa.array(np.repeat(np.arange(len(v)), n))))
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "vec"][: len(cols)])

        return run

    index = save(folded.mapInArrow(hashed, "key long, id long, vec binary"))
    sizes = save(index.groupBy("key").agg(F.count("*").alias("n")))
    # a query stands for all with its vector, under the smallest of their ids
    queries = save(good.where("q").groupBy("v").agg(F.min("id").alias("id")))
    member = save(good.where("q").select(F.col("id").alias("query_id"), "v").distinct().join(queries, "v").select("query_id", "id"))
    probes, keys = queries.mapInArrow(asked(True), "key long, id long, vec binary"), queries.mapInArrow(asked(False), "key long, id long")
    found = save(_merged(_hits(index, sizes, probes, keys, size, k + 1), k + 1))
    if hasher.m:
        enough = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, count))
        short = save(queries.join(enough, "id", "left_anti"))
        if short.head(1):  # a stated query set against all rows, in blocks
            every = sizes.select("key")
            vectors = short.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([b["id"], packed(matrix(b["v"]))], names=["id", "vec"]) for b in it if b.num_rows), "id long, vec binary").join(every)
            rest = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(found.columns)
            found = save(rest.unionAll(_merged(_hits(index, sizes, vectors, short.select("id").join(every), size, k + 1), k + 1)))
    drop(folded, index, sizes, queries)
    near = found.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))  # k + 1 at most
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = member.join(near, "id").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, F.col("vec_id") % 20 == 0)
