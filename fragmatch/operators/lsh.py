"""Candidate pruning for kNN by MinHash over quantised vector components.

A component gives the token (place, sign, size class); vectors whose token sets
share a band of minhashes are candidates, which the exact distance then ranks.
The index keeps vectors, the buckets that each lies in, and the buckets' sizes.
A query visits its buckets from the smallest on, until they hold as many targets
as it asks for, so that what it costs is bounded and frequent bands come last;
targets and queries of a bucket meet in blocks (``blocks``), however many
there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragmatch.errors import IndexCorruptedError
from fragmatch.operators import blocks, metric
from fragmatch.operators.knn import knn
from fragmatch.operators.patches import stack
from fragmatch.plans.scratch import save

#: Minhashes of a vector, shared out among bands.
MINHASHES = 128
#: Upper ends of the size classes; fixed values.
EDGES = (0.1, 0.3, 0.5, 0.7, 0.9)
_MIX = 0x9E3779B97F4A7C15


def tokens(vectors: np.ndarray) -> np.ndarray:
    """(rows, dims) token numbers."""
    size = np.digitize(np.abs(vectors), EDGES)
    return (np.arange(vectors.shape[1])[None, :] * 2 + (vectors > 0)) * (len(EDGES) + 1) + size


def shape(threshold: float) -> tuple[int, int]:
    """(bands, rows) that put the middle of the S-curve, (1 / bands) ** (1 / rows), nearest to a Jaccard similarity."""
    rows = min(range(1, MINHASHES + 1), key=lambda r: abs((1 / (MINHASHES // r)) ** (1 / r) - threshold))
    return MINHASHES // rows, rows


def bands(vectors: np.ndarray, count: int, rows: int) -> np.ndarray:
    """(vectors, count) keys of bands of ``rows`` minhashes."""
    t = tokens(vectors).astype(np.uint64)
    seeds = np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 63, count * rows, dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(t), count), np.uint64)
    for k, s in enumerate(seeds):
        h = (t + np.uint64(1)) * s
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
        out[:, k // rows] = out[:, k // rows] * np.uint64(_MIX) + (h >> np.uint64(8)).min(axis=1)
    return out.view(np.int64)


def _vectors(rows: DataFrame, id_col: str, vector: str, name: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v")).where(f"{name} is not null and v is not null")


def banded(rows: DataFrame, name: str, threshold: float = 0.3) -> DataFrame:
    """(id, key): a row for each band of each vector of rows (id, v); the id's column is ``name``, and a key tells bands apart."""
    count, size = shape(threshold)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = bands(stack(part["v"], -1), count, size)
                for band in range(count):
                    yield pa.RecordBatch.from_arrays([part[name], pa.array(keys[:, band]), pa.array(np.full(len(keys), band, np.int32))], names=[name, "key", "band"])

    return rows.select(name, "v").mapInArrow(run, f"{name} long, key long, band int").select(name, F.xxhash64("key", "band").alias("key"))


@dataclass
class LshIndex:
    """``vectors`` (t, v), ``members`` (key, t) and ``sizes`` (key, n) of all buckets; ``threshold`` shapes the bands."""

    vectors: DataFrame
    members: DataFrame
    sizes: DataFrame
    threshold: float

    def count(self) -> int:
        return self.vectors.count()


def build(targets: DataFrame, target_id: str, vector: str = "descriptor", threshold: float = 0.3) -> LshIndex:
    """The index of all targets whose id and vector are not null, as saved tables."""
    vectors = save(_vectors(targets, target_id, vector, "t"))
    members = save(banded(vectors, "t", threshold))
    return LshIndex(vectors, members, save(members.groupBy("key").agg(F.count("*").alias("n"))), threshold)


def write(index: LshIndex, path: str) -> None:
    """The index as Parquet, members in the order of their keys; what tells its counts comes last."""
    spark = index.vectors.sparkSession
    index.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    index.members.repartitionByRange("key", "t").sortWithinPartitions("key", "t").write.mode("overwrite").parquet(f"{path}/members")
    index.sizes.write.mode("overwrite").parquet(f"{path}/sizes")
    spark.createDataFrame([(index.threshold, index.vectors.count(), index.members.count())], "threshold double, vectors long, members long").write.mode("overwrite").parquet(f"{path}/about")


def read(spark: SparkSession, path: str) -> LshIndex:
    """A written index; nothing is signed again."""
    try:
        about = spark.read.parquet(f"{path}/about").first()
        index = LshIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("vectors", "members", "sizes")), about["threshold"])
    except AnalysisException as e:
        raise IndexCorruptedError(f"{path}: {e}") from e
    if (index.vectors.count(), index.members.count()) != (about["vectors"], about["members"]):
        raise IndexCorruptedError(f"{path}: {about['vectors']} vectors in {about['members']} buckets expected")
    return index


def visits(index: LshIndex, queries: DataFrame, candidates: int) -> DataFrame:
    """(q, key) of rows (q, v): the buckets that a query visits, smallest first, up to the one with which they hold ``candidates`` targets."""
    met = banded(queries, "q", index.threshold).distinct().join(index.sizes, "key")
    before = F.sum("n").over(Window.partitionBy("q").orderBy("n", "key")) - F.col("n")  # a row for each band
    return met.withColumn("before", before).where(F.col("before") < candidates).select("q", "key")


def search(index: LshIndex, queries: DataFrame, k: int, query_id: str, vector: str = "descriptor", candidates: int = 1000) -> DataFrame:
    """(q, rank, t, dist) by exact distance among the targets of the visited buckets.

    With fewer targets than ``candidates``, and for queries without any
    candidate, the exact search answers instead.
    """
    if index.count() < candidates:
        return knn(_vectors(queries, query_id, vector, "q"), index.vectors, k, "q", "t", "v")
    asked = save(_vectors(queries, query_id, vector, "q"))
    chosen = save(visits(index, asked, candidates))
    counts = save(chosen.groupBy("key").agg(F.count("*").alias("m")))
    held = index.members.join(counts.select("key"), "key").join(index.vectors, "t").select("key", "t", "v")
    sent = chosen.join(asked, "q").withColumn("limit", F.lit(float("inf")))
    found = metric.ranked(blocks.merged(blocks.meet(held, index.sizes, sent, counts, k), k), k, False)
    rest = asked.join(chosen.select("q").distinct(), "q", "left_anti")
    return found.unionByName(knn(rest, index.vectors, k, "q", "t", "v")) if rest.head(1) else found


def lsh_knn(queries: DataFrame, targets: DataFrame, k: int, query_id: str, target_id: str, vector: str = "descriptor", candidates: int = 1000, threshold: float = 0.3) -> DataFrame:
    """``search`` in an index of ``targets`` made for it."""
    if targets.count() < candidates:
        return knn(queries, targets, k, query_id, target_id, vector)
    return search(build(targets, target_id, vector, threshold), queries, k, query_id, vector, candidates)
