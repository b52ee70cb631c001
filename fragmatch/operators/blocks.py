"""Nearest neighbours of vectors that meet in blocks.

Targets and queries come with the key of a block. A key with many targets is
cut into blocks, and its queries into parts; each block meets each part in a task
that holds the block's targets and streams the queries. So no key is too large
for a task, whatever its share of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmatch.functions.kernels import nearest
from fragmatch.operators.patches import stack
from fragmatch.plans.scratch import save

BLOCK_ROWS = 8192
QUERY_ROWS = 16384
NEAR = "array<struct<d:double,t:long>>"


def near_lists(d: np.ndarray, i: np.ndarray) -> pa.Array:
    """Rows of distances and ids as lists, without the places that hold infinity."""
    some = np.isfinite(d)
    items = pa.StructArray.from_arrays([pa.array(d[some]), pa.array(i[some])], names=["d", "t"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32)), items)


def merged(parts: DataFrame, take: int) -> DataFrame:
    """(q, near) of rows (q, part, near): the ``take`` nearest of all, each target once, by two aggregations."""
    merge = lambda c: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))), 1, take)
    first = parts.groupBy("q", F.pmod("part", F.lit(64)).alias("part")).agg(merge("near").alias("near"))
    return first.groupBy("q").agg(merge("near").alias("near"))


def _search(take: int):
    """Rows (key, sub, role, id, v, limit), targets (role 0) before queries within each (key, sub)."""

    def run(batches):
        now, held, ids, width = None, [], [], 0
        for batch in batches:
            key, sub, role = (batch[c].to_numpy() for c in ("key", "sub", "role"))
            change = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1]) | (role[1:] != role[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(key)]):
                if lo == hi:
                    continue
                if (key[lo], sub[lo]) != now:
                    now, held, ids = (key[lo], sub[lo]), [], []
                part = batch.slice(lo, hi - lo)
                v = stack(part["v"], -1)
                if role[lo] == 0:
                    held.append(v)
                    ids.append(part["id"].to_numpy())
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held, ids = [np.concatenate(held)], [np.concatenate(ids)]
                d, i = nearest(v, held[0], ids[0], take, part["limit"].to_numpy())
                found = np.flatnonzero(np.isfinite(d[:, 0]))
                if len(found):
                    part_no = pa.array(np.full(len(found), hash(now) & 0x7FFFFFFF, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(part["id"].to_numpy()[found]), part_no, near_lists(d[found], i[found])], names=["q", "part", "near"])

    return run


def meet(targets: DataFrame, sizes: DataFrame, queries: DataFrame, asked: DataFrame, take: int, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(q, part, near): each query's ``take`` nearest in each block that it meets, at its limit or nearer.

    ``targets`` has (key, t, v), ``queries`` (key, q, v, limit) with squared
    distances as limits. ``sizes`` counts the targets (key, n), ``asked`` the
    queries (key, m). Ties go to the smaller target id.
    """
    # saved, so that Spark knows its size: a small table is broadcast, and no key's rows meet in one task before they are dealt
    cut = save(sizes.join(asked, "key").select("key", F.ceil(F.col("n") / F.lit(block_rows)).alias("blocks"), F.ceil(F.col("m") / F.lit(query_rows)).alias("parts")))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = targets.join(cut, "key").select("key", one("t", "blocks").alias("block"), every("parts").alias("part"), "parts", F.lit(0).alias("role"), F.col("t").alias("id"), "v", F.lit(0.0).alias("limit"))
    sent = queries.join(cut, "key").select("key", every("blocks").alias("block"), one("q", "parts").alias("part"), "parts", F.lit(1).alias("role"), F.col("q").alias("id"), "v", "limit")
    dealt = held.unionAll(sent).select("key", (F.col("block") * F.col("parts") + F.col("part")).alias("sub"), "role", "id", "v", "limit")
    return dealt.repartition("key", "sub").sortWithinPartitions("key", "sub", "role").mapInArrow(_search(take), f"q long, part long, near {NEAR}")
