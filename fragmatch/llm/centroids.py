"""Centroid clustering by sort-means, in whole numbers.

Each round orders, for every centroid, the others by their distance from it. A
vector is measured against the centroid it had, and then against that one's
neighbours in this order, up to the first that lies strictly farther from it
than twice the vector's own distance: by the triangle inequality none beyond can
be nearer, or as near. One pass of a round assigns the vectors and adds up its
clusters in each task; a few rows per task, and of those one per cluster, are
what the next centroids need.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.llm.vectors import matrix
from fragmatch.plans.scratch import drop, save

CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Whole components stay below this in magnitude, so that squared distances of up to 64 dimensions fit a long.
REACH = 1 << 27


def assign(v: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroids (ties: the smaller number), squared distances, and how many distances were measured.

    ``before`` holds the cluster that each vector had; every one gives the same
    result, a good one sooner.
    """
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    cluster, distance, measured = before.astype(np.int32), np.zeros(len(v), np.int64), 0
    for c in np.unique(before).tolist():
        mine = np.flatnonzero(before == c)
        own = ((v[mine] - centroids[c]) ** 2).sum(axis=1)
        best, near = np.full(len(mine), c, np.int32), own.copy()
        measured += len(mine)
        for j in np.lexsort((np.arange(len(centroids)), apart[c])).tolist():
            if j == c:
                continue
            open_ = np.flatnonzero(apart[c, j] <= 4 * own)
            if not len(open_):
                break  # those after it are as far or farther
            d = ((v[mine[open_]] - centroids[j]) ** 2).sum(axis=1)
            measured += len(open_)
            better = (d < near[open_]) | ((d == near[open_]) & (j < best[open_]))
            near[open_[better]], best[open_[better]] = d[better], j
        cluster[mine], distance[mine] = best, near
    return cluster, distance, measured


_STATE = "id long, v binary, cluster int, distance long, n long, sums array<long>, inertia long"


def _round(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One pass: vectors with their clusters, and, as rows with ``n``, each task's count, sums and inertia of its clusters."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)  # clusters x dimensions

    def run(batches):
        at = held.value
        k, dim = at.shape
        n, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        schema = pa.schema([("id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("inertia", pa.int64())])
        none = lambda size, kind: pa.nulls(size, kind)
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            v = np.frombuffer(b"".join(batch["v"].to_pylist()), np.int64).reshape(size, dim)
            cluster, distance, _ = assign(v, batch["cluster"].to_numpy(), at)
            n += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, v)
            np.add.at(inertia, cluster, distance)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(cluster), pa.array(distance), none(size, pa.int64()), none(size, pa.list_(pa.int64())), none(size, pa.int64())], schema=schema)
        some = np.flatnonzero(n)
        if len(some):
            m = len(some)
            yield pa.RecordBatch.from_arrays([none(m, pa.int64()), none(m, pa.binary()), pa.array(some.astype(np.int32)), none(m, pa.int64()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64())), pa.array(inertia[some])], schema=schema)

    return save(rows.mapInArrow(run, _STATE))


def _summed(state: DataFrame, dim: int) -> dict[int, tuple[int, list[int], int]]:
    """Count, sums and inertia by cluster: as many rows as there are clusters, added up as decimals."""
    big = lambda c: F.sum(c.cast("decimal(20,0)"))
    parts = state.where("n is not null")  # reads no vector
    got = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[big(F.col("sums")[k]) for k in range(dim)]).alias("sums"), F.sum("inertia").alias("inertia")).collect()
    whole = lambda x: int(Decimal(x))
    return {r["cluster"]: (r["n"], [whole(x) for x in r["sums"]], r["inertia"]) for r in got}


def cluster(rows: DataFrame, id_col: str = "vec_id", vec: str = "embedding", dim: int = 64, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance) per kept vector, and (cluster, size, centroid, inertia) per centroid.

    Kept are vectors of exactly ``dim`` components, none null or non-finite;
    components become floor(1024 x). Centroids start as the ``k`` kept vectors
    with the smallest SHA-256 of ``seed:id``; rows of one id tie, and the
    vector that is smaller component by component comes first; null ids come
    last. With fewer kept vectors there are fewer centroids, and without any the
    result is empty. Repeated rows count as often as they come. Empty clusters
    keep their centroid. A component of 2^17 or more in magnitude is an error,
    as distances would not fit a long.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("x"))
    inf = F.lit(float("inf"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf))
    good = given.where(F.coalesce((F.size("x") == dim) & fine, F.lit(False)))

    def whole(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.floor(SCALE * matrix(batch["x"]))
                if (np.abs(v) >= REACH).any():
                    raise ValueError(f"a component of {REACH // SCALE} or more in magnitude")
                raw = v.astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(np.zeros(len(raw), np.int32))], names=["id", "v", "cluster"])

    first = good.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.transform("x", lambda c: F.floor(c * SCALE))).limit(k)
    start = [r["x"] for r in first.select("x").collect()]  # k vectors
    names = "cluster int, size long, centroid array<long>, inertia long"
    if not start:
        return given.limit(0).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), spark.createDataFrame([], names)
    centroids = np.floor(SCALE * np.array(start, np.float64)).astype(np.int64)
    state = good.mapInArrow(whole, "id long, v binary, cluster int")
    for _ in range(rounds):
        was, state = state, _round(state, centroids)
        drop(was)
        for c, (n, sums, _) in _summed(state, dim).items():
            centroids[c] = [s // n for s in sums]
        state = _members(state)
    was, state = state, _round(state, centroids)
    drop(was)
    found = _summed(state, dim)
    table = [(c, found[c][0] if c in found else 0, [int(x) for x in centroids[c]], found[c][2] if c in found else 0) for c in range(len(centroids))]
    return state.where("n is null").select("id", "cluster", "distance"), spark.createDataFrame(table, names)


def _members(state: DataFrame) -> DataFrame:
    """The vectors of a saved round, which can still be dropped by ``scratch.drop``."""
    out = state.where("n is null").select("id", "v", "cluster")
    out._scratch_path = state._scratch_path  # type: ignore[attr-defined]
    return out


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centres = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = centres.collect()  # one per cluster
    total = sum(r["inertia"] for r in rows)
    notes = [(r["cluster"], r["inertia"], total, hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()) for r in rows]
    small = spark.createDataFrame(notes, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(small), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = 64) -> str:
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT v.row, arg_min(c.k, ({far}, c.k)) AS k, CAST(min({far}) AS BIGINT) AS d FROM v, c{r} c GROUP BY v.row)")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.k, unnest(v.q) AS x, unnest(range({dim})) AS i FROM a{r} a JOIN v ON a.row = v.row) GROUP BY k, i)""")
            steps.append(f"""m{r} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{r} GROUP BY k)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k)")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, q) - 1 AS k, q FROM v QUALIFY k < {k}
), {", ".join(steps)}, t AS (
  SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY k
)
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, t.cluster_inertia, CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a ON v.row = a.row JOIN t ON a.k = t.k JOIN c{rounds} c ON a.k = c.k
"""


OP11_SQL = _sql()
