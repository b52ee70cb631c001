"""The metric index against brute force, and what it spares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmatch.errors import IndexCorruptedError
from fragmatch.operators import blocks, knn, metric

VEC = "id long, v array<double>"


def table(spark, v, start=0):
    return spark.createDataFrame([(start + i, x.tolist()) for i, x in enumerate(v)], VEC).repartition(5)


def brute(q, t, k, limit=np.inf):
    d = ((q[:, None] - t[None]) ** 2).sum(2)
    out = {}
    for i in range(len(q)):
        best = [j for j in np.lexsort((np.arange(len(t)), d[i]))[:k] if d[i, j] <= limit]
        out |= {(i, r + 1): (int(j), d[i, j]) for r, j in enumerate(best)}
    return out


def clustered(r, n, dim=8, centres=12, spread=0.02):
    c = r.randn(centres, dim)
    return c[r.randint(centres, size=n)] + spread * r.randn(n, dim)


@pytest.mark.parametrize("shape", ["clustered", "uniform", "lattice", "same"])
def test_equals_brute_force(spark, shape):
    r = np.random.RandomState(1)
    if shape == "clustered":
        t, q = clustered(r, 700), clustered(np.random.RandomState(1), 90)
    elif shape == "uniform":
        t, q = r.rand(500, 3), r.rand(60, 3)
    elif shape == "lattice":  # many equal distances
        t, q = r.randint(0, 4, (400, 3)).astype(float), r.randint(0, 4, (50, 3)).astype(float)
    else:
        t, q = np.ones((300, 2)), np.array([[1.0, 1.0], [5.0, 1.0]])
    index = metric.build(table(spark, t), "id", "v", block_rows=64)
    got = {(x["q"], x["rank"]): (x["t"], x["dist"]) for x in metric.knn(index, table(spark, q), 7, "id", "v").collect()}
    want = brute(q, t, 7)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_limits_self_few_targets_and_nulls(spark):
    r = np.random.RandomState(2)
    t = clustered(r, 200)
    rows = table(spark, t).unionByName(spark.createDataFrame([(None, [0.0] * 8), (900, None)], VEC))
    index = metric.build(rows, "id", "v", block_rows=32)
    got = {(x["q"], x["rank"]): x["t"] for x in metric.knn(index, rows, 5, "id", "v", skip_self=True, limit=0.01).collect()}
    want = {}
    for i in range(200):
        d = ((t - t[i]) ** 2).sum(1)
        best = [j for j in np.lexsort((np.arange(200), d)) if j != i and d[j] <= 0.01][:5]
        want |= {(i, k + 1): int(j) for k, j in enumerate(best)}
    assert got == want
    assert metric.knn(index, table(spark, t[:3]), 300, "id", "v").count() == 600
    none = metric.build(rows.limit(0), "id", "v")
    assert metric.knn(none, rows, 3, "id", "v").count() == 0 and metric.knn(index, rows.limit(0), 3, "id", "v").count() == 0
    assert metric.knn(none, rows, 3, "id", "v").columns == ["q", "rank", "t", "dist"]


def test_clustered_queries_meet_few_blocks(spark):
    """24 tight clusters: a query meets at most a fifth of all blocks, and of the targets in them."""
    t, q = clustered(np.random.RandomState(3), 3000, centres=24), clustered(np.random.RandomState(3), 400, centres=24)
    index = metric.build(table(spark, t), "id", "v", block_rows=64)
    sizes = {x["key"]: x["n"] for x in index.sizes().collect()}
    asked = table(spark, q).select(F.col("id").alias("q"), "v").withColumn("limit", F.lit(float("inf")))
    first = metric.visits(index, asked, 5, True).collect()
    near = blocks.merged(metric._pass(index, asked, 5, True), 5)
    bound = asked.drop("limit").join(near.select("q", F.element_at("near", -1)["d"].alias("limit")), "q")
    second = metric.visits(index, bound, 5, False).collect()
    assert len({(x["q"], x["key"]) for x in first + second}) == len(first) + len(second)  # none twice
    assert len(first) + len(second) < 400 * len(sizes) / 5
    assert sum(sizes[x["key"]] for x in first + second) < 400 * 3000 / 5
    got = {(x["q"], x["rank"]): x["t"] for x in knn.knn(table(spark, q), table(spark, t), 5, "id", "id", "v", broadcast_bytes=0).collect()}
    assert got == {k: v[0] for k, v in brute(q, t, 5).items()}


def test_bounds_hold_for_every_target():
    r = np.random.RandomState(4)
    t, q, p = r.randn(500, 6), r.randn(80, 6), r.randn(20, 6)
    d = metric.distances(t, p)
    cell, near = d.argmin(1), d.min(1)
    own = lambda f, none: np.array([f(near[cell == j]) if (cell == j).any() else none for j in range(20)])
    index = metric.MetricIndex(p, np.bincount(cell, minlength=20), own(np.min, np.inf), own(np.max, 0.0), np.zeros(20, int), None)
    bound = metric.lower_bounds(index, metric.distances(q, p))
    true = np.sqrt(((q[:, None] - t[None]) ** 2).sum(2))
    for j in range(20):
        assert (bound[:, j][:, None] <= true[:, cell == j]).all()
    assert (bound > 0).mean() > 0.3


def test_hot_blocks_are_cut_on_both_sides(spark):
    r = np.random.RandomState(5)
    t, q = r.rand(200, 4), r.rand(90, 4)
    targets = table(spark, t).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("t"), "v")
    queries = table(spark, q).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("q"), "v", F.lit(float("inf")).alias("limit"))
    count = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    parts = blocks.meet(targets, count(targets, "n"), queries, count(queries, "m"), 3, block_rows=50, query_rows=20)
    assert parts.count() == 90 * 4  # a row for each of four blocks
    got = {x["q"]: [y["t"] for y in x["near"]] for x in blocks.merged(parts, 3).collect()}
    want = brute(q, t, 3)
    assert got == {i: [want[i, k][0] for k in (1, 2, 3)] for i in range(90)}


def test_index_is_kept_whole(spark, tmp_path):
    t = clustered(np.random.RandomState(6), 300)
    metric.write(metric.build(table(spark, t), "id", "v", block_rows=40), f"{tmp_path}/m")
    back = metric.read(spark, f"{tmp_path}/m")
    got = {(x["q"], x["rank"]): x["t"] for x in metric.knn(back, table(spark, t[:30]), 4, "id", "v").collect()}
    assert got == {k: v[0] for k, v in brute(t[:30], t, 4).items()}
    back.cells.limit(10).write.parquet(f"{tmp_path}/m/cells", mode="append")
    with pytest.raises(IndexCorruptedError):
        metric.read(spark, f"{tmp_path}/m")
