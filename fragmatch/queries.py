"""Registered queries over the test tables, each with its SQL where SQL can state it.

Texts become images of 16 x n pixels (``sources.rasters``); patches are 4 x 4
at a stride of 4, and the entropy threshold is 1.3, as text has little entropy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.config import Config
from fragmatch.functions import exprs as X
from fragmatch.functions import kernels as K
from fragmatch.operators import bp, coherence, evaluate, geometry, heatmap, hough, knn, lsh, medians, metric, patches, priors, scale, tiles, verify
from fragmatch.plans import engine
from fragmatch.plans.scratch import drop, folder, save
from fragmatch.sources import index as store
from fragmatch.sources.rasters import text_images, text_rasters
from fragmatch.streaming.ingest import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}
SIZE, STRIDE, ENTROPY = 4, 4, 1.3
TILE_SIDE = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d) -> DataFrame:
    return text_images(_t(spark, d, "documents"), "doc_id", "text")


def _patches(spark, d, threshold=None, kernel=None, columns=None) -> DataFrame:
    return patches.explode(_docs(spark, d), SIZE, STRIDE, threshold, kernel, columns)


RASTER_SQL = """
ras AS (SELECT CAST(doc_id AS VARCHAR) AS image_id, list_transform(string_split(text, ''), lambda c: unicode(c) % 256 / CAST(255 AS DOUBLE)) AS v FROM documents WHERE length(text) > 144
), cell AS (SELECT image_id, v, unnest(range((ceil(len(v) / 48.0)::INT - 4) // 4 + 1)) AS iy FROM ras
), pat AS (
  SELECT image_id, CAST(iy * 4 + ix AS INT) AS patch_idx, CAST(ix * 4 AS INT) AS x, CAST(iy * 4 AS INT) AS y,
    list_transform(range(48), lambda k: coalesce(v[((iy * 4 + k // 12) * 16 + ix * 4 + (k % 12) // 3) * 3 + k % 3 + 1], CAST(0 AS DOUBLE))) AS p
  FROM cell, (SELECT unnest(range(4)) AS ix)
), gr AS (SELECT *, list_transform(range(16), lambda j: CAST(0.299 AS DOUBLE) * p[3 * j + 1] + CAST(0.587 AS DOUBLE) * p[3 * j + 2] + CAST(0.114 AS DOUBLE) * p[3 * j + 3]) AS g FROM pat)
"""
_ENT = """
, hist AS (SELECT image_id, patch_idx, unnest(range(8)) AS b, g FROM gr
), cnt AS (SELECT image_id, patch_idx, b, len(list_filter(g, lambda x: least(7, floor(8 * x)) = b)) / (16 + CAST(1e-10 AS DOUBLE)) AS q FROM hist
), ent AS (SELECT image_id, patch_idx, sum(CASE WHEN q > 0 THEN -q * log2(q) ELSE 0 END) AS e FROM cnt GROUP BY ALL)
"""


@query(f"WITH {RASTER_SQL} SELECT image_id, patch_idx, x, y, CAST(len(p) AS INT) AS n, round(list_sum(p), 6) AS total FROM pat")
def patch_extract(spark, d):
    total = F.aggregate("patch", F.lit(0.0), lambda s, x: s + x)
    return _patches(spark, d, columns=("image_id", "patch_idx", "x", "y", "patch")).select("image_id", "patch_idx", "x", "y", F.size("patch").alias("n"), F.round(total, 6).alias("total"))


@query(f"WITH {RASTER_SQL} {_ENT} SELECT image_id, patch_idx, round(e, 6) + 0.0 AS entropy FROM ent")
def patch_entropy(spark, d):
    return _patches(spark, d, columns=("image_id", "patch_idx", "entropy")).select("image_id", "patch_idx", (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"))


@query(f"WITH {RASTER_SQL} {_ENT} SELECT image_id, count(*) AS kept, round(avg(e), 6) AS mean_entropy FROM ent WHERE e > {ENTROPY} GROUP BY image_id")
def entropy_filter(spark, d):
    return _patches(spark, d, ENTROPY, columns=("image_id", "entropy")).groupBy("image_id").agg(F.count("*").alias("kept"), F.round(F.avg("entropy"), 6).alias("mean_entropy"))


def _checksum(spark, d, kernel, places: int = 5) -> DataFrame:
    """A weighted sum of each patch's descriptor, taken where it is described, value by value."""

    def total(p):
        v = kernel(p)
        return np.add.reduce(np.ascontiguousarray((v * np.arange(1.0, v.shape[1] + 1)).T), axis=0)[:, None]

    out = _patches(spark, d, kernel=total, columns=("image_id", "patch_idx", "descriptor"))
    return out.select("image_id", "patch_idx", (F.round(F.col("descriptor")[0], places) + F.lit(0.0)).alias("checksum"))


def _checksum_sql(raw: str, unit: str = "unit") -> str:
    """SQL for ``_checksum``; ``raw`` gives the descriptor before scaling."""
    norm = "sqrt(list_sum(list_transform(r, lambda a: a * a)))"
    scaled = f"CASE WHEN {norm} < 1e-8 THEN list_transform(r, lambda a: 1 / sqrt(len(r))) ELSE list_transform(r, lambda a: a / {norm}) END" if unit == "unit" else f"list_transform(r, lambda a: a / greatest({norm}, 1e-8))"
    return f"WITH {RASTER_SQL}, raw AS ({raw}), d AS (SELECT image_id, patch_idx, {scaled} AS v FROM raw) SELECT image_id, patch_idx, round(list_sum(list_transform(range(1, len(v) + 1), lambda k: v[k] * k)), 5) + 0.0 AS checksum FROM d"


_CHANNEL = "list_sum(list_transform(range(16), lambda j: {p}[3 * j + {c}])) / 16"


def _centred(p: str) -> str:
    means = "[" + ", ".join(_CHANNEL.format(p=p, c=c) for c in (1, 2, 3)) + "]"
    return f"SELECT image_id, patch_idx, list_transform(range(48), lambda k: {p}[k + 1] - m[k % 3 + 1]) AS r FROM (SELECT *, {means} AS m FROM src)"


@query(_checksum_sql("WITH src AS (SELECT * FROM gr) " + _centred("p")))
def desc_difference(spark, d):
    return _checksum(spark, d, K.difference)


@query(_checksum_sql("WITH src AS (SELECT image_id, patch_idx, list_transform(range(48), lambda k: p[k + 1] / greatest(p[k - k % 3 + 1] + p[k - k % 3 + 2] + p[k - k % 3 + 3], CAST(0.03 AS DOUBLE))) AS c FROM gr) " + _centred("c")))
def desc_chromaticity(spark, d):
    return _checksum(spark, d, K.chromaticity)


_LBP_SQL = "SELECT image_id, patch_idx, list_transform(range(32), lambda i: CASE WHEN g[(1 + i // 16 + [-1,-1,-1,0,1,1,1,0][i % 8 + 1]) * 4 + 1 + (i // 8) % 2 + [-1,0,1,1,1,0,-1,-1][i % 8 + 1] + 1] >= g[(1 + i // 16) * 4 + 1 + (i // 8) % 2 + 1] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM gr"
_RANK_SQL = "SELECT image_id, patch_idx, flatten(list_transform(range(1, 17), lambda i: list_transform(range(i + 1, 17), lambda j: CASE WHEN g[i] > g[j] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) AS r FROM gr"


@query(_checksum_sql(_LBP_SQL))
def desc_lbp(spark, d):
    return _checksum(spark, d, K.binary_pattern)


@query(_checksum_sql(_RANK_SQL))
def desc_rank_order(spark, d):
    return _checksum(spark, d, K.rank_order)


@query(_checksum_sql("SELECT image_id, patch_idx, list_transform(range(48), lambda k: (p[k + 1] - m) - ((p[k - k % 3 + 1] - m) + (p[k - k % 3 + 2] - m) + (p[k - k % 3 + 3] - m)) / 3) AS r FROM (SELECT *, list_sum(p) / 48 AS m FROM gr)", "floor"))
def desc_photometric(spark, d):
    return _checksum(spark, d, K.photometric)


_GRAD_SQL = """SELECT image_id, patch_idx, list_transform(range(8), lambda b: list_sum(list_transform(range(16), lambda k: CASE WHEN a[k + 1] >= -pi() + b * pi() / 4 AND a[k + 1] < -pi() + (b + 1) * pi() / 4 THEN z[k + 1]::DOUBLE ELSE 0.0::DOUBLE END))) AS r FROM (
  SELECT *, list_transform(range(16), lambda k: atan2(v[k + 1]::DOUBLE, u[k + 1]::DOUBLE)::FLOAT::DOUBLE) AS a, list_transform(range(16), lambda k: sqrt((u[k + 1] * u[k + 1] + v[k + 1] * v[k + 1])::DOUBLE)::FLOAT) AS z FROM (
    SELECT image_id, patch_idx,
      list_transform(range(16), lambda k: CASE k % 4 WHEN 0 THEN f[k + 2] - f[k + 1] WHEN 3 THEN f[k + 1] - f[k] ELSE (f[k + 2] - f[k]) * 0.5::FLOAT END) AS u,
      list_transform(range(16), lambda k: CASE k // 4 WHEN 0 THEN f[k + 5] - f[k + 1] WHEN 3 THEN f[k + 1] - f[k - 3] ELSE (f[k + 5] - f[k - 3]) * 0.5::FLOAT END) AS v
    FROM (SELECT image_id, patch_idx, list_transform(g, lambda x: x::FLOAT) AS f FROM gr)))"""


@query(_checksum_sql(_GRAD_SQL))
def desc_gradient(spark, d):
    return _checksum(spark, d, K.gradient_histogram)


def _composite_sql() -> str:
    """The five parts side by side, each scaled by itself, summed up like ``_checksum``."""
    chroma = "SELECT *, list_transform(range(48), lambda k: p[k + 1] / greatest(p[k - k % 3 + 1] + p[k - k % 3 + 2] + p[k - k % 3 + 3], CAST(0.03 AS DOUBLE))) AS c FROM gr"
    raws = [f"WITH src AS (SELECT * FROM gr) {_centred('p')}", f"WITH src AS ({chroma}) {_centred('c')}", _LBP_SQL, _RANK_SQL, _GRAD_SQL]
    norm = "sqrt(list_sum(list_transform(r, lambda a: a * a)))"
    scaled = f"CASE WHEN {norm} < 1e-8 THEN list_transform(r, lambda a: 1 / sqrt(len(r))) ELSE list_transform(r, lambda a: a / {norm}) END"
    parts = ", ".join(f"d{k} AS (SELECT image_id, patch_idx, {scaled} AS v{k} FROM ({raw}))" for k, raw in enumerate(raws))
    joins = " ".join(f"JOIN d{k} USING (image_id, patch_idx)" for k in range(1, len(raws)))
    every = " || ".join(f"v{k}" for k in range(len(raws)))
    return f"WITH {RASTER_SQL}, {parts}, d AS (SELECT image_id, patch_idx, {every} AS v FROM d0 {joins}) SELECT image_id, patch_idx, round(list_sum(list_transform(range(1, len(v) + 1), lambda k: v[k] * k)), 4) + 0.0 AS checksum FROM d"


@query(_composite_sql())
def desc_composite_raw(spark, d):
    """The composite descriptor before projection."""
    return _checksum(spark, d, lambda p: K.composite(p, False), 4)


@query()
def desc_composite(spark, d):
    return _checksum(spark, d, lambda p: K.project(K.composite(p, False), 64))


@query()
def desc_persistence(spark, d):
    return _checksum(spark, d, K.persistence_descriptor)


@query()
def desc_zernike(spark, d):
    return _checksum(spark, d, K.zernike)


@query()
def desc_bayesian(spark, d):
    return _checksum(spark, d, K.bayesian)


@query()
def desc_pca(spark, d):
    """Principal axes of raw descriptors, and the descriptors projected to them."""
    rows = _patches(spark, d, columns=("image_id", "patch_idx", "patch"))
    sample = np.stack(priors.sample(rows, 5000).select("patch").toPandas()["patch"]).reshape(-1, SIZE, SIZE, 3)
    basis = K.principal_axes(K.composite(sample, False), 64)
    return _checksum(spark, d, lambda p: K.project(K.composite(p, False), 64, basis))


def _tiles(spark, d) -> DataFrame:
    return tiles.text_tiles(_t(spark, d, "documents"), "doc_id", "text", side=TILE_SIDE)


@query(f"WITH {RASTER_SQL} {_ENT} SELECT image_id, count(*) AS kept, round(avg(e), 6) AS mean_entropy, CAST(max(patch_idx) AS INT) AS last FROM ent WHERE e > {ENTROPY} GROUP BY image_id")
def tile_patches(spark, d):
    """Documents in tiles of 64 pixels, cut into patches across the tiles' edges."""
    rows = tiles.explode(_tiles(spark, d), SIZE, STRIDE, ENTROPY, side=TILE_SIDE)
    return rows.groupBy("image_id").agg(F.count("*").alias("kept"), F.round(F.avg("entropy"), 6).alias("mean_entropy"), F.max("patch_idx").alias("last"))


_LEVELS_SQL = """
WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS image_id, CAST(ceil(length(text) / 48.0) AS INT) AS h FROM documents WHERE length(text) > 144
), l AS (SELECT image_id, 0 AS level, 1.0::DOUBLE AS scale, h, 16 AS w FROM h UNION ALL SELECT image_id, 1, 0.5::DOUBLE, h // 2, 8 FROM h)
SELECT image_id, CAST(level AS INT) AS level, scale, CAST(((h - 4) // 4 + 1) * ((w - 4) // 4 + 1) AS BIGINT) AS n, CAST((w - 4) // 4 * 4 / scale AS INT) AS max_x, CAST((h - 4) // 4 * 4 / scale AS INT) AS max_y FROM l WHERE h >= 8"""


@query(_LEVELS_SQL)
def tile_pyramid(spark, d):
    """Patches of two levels of documents in tiles of 64 pixels."""
    rows = tiles.pyramid_patches(_tiles(spark, d), SIZE, [1.0, 0.5], STRIDE, 8, side=TILE_SIDE, columns=("image_id", "level"))
    return rows.groupBy("image_id", "level", "scale").agg(F.count("*").alias("n"), F.max("orig_x").alias("max_x"), F.max("orig_y").alias("max_y"))


@query(_LEVELS_SQL)
def pyramid_patches(spark, d):
    rows = patches.pyramid_patches(_docs(spark, d), SIZE, [1.0, 0.5], STRIDE, 8, columns=("image_id", "level"))
    return rows.groupBy("image_id", "level", "scale").agg(F.count("*").alias("n"), F.max("orig_x").alias("max_x"), F.max("orig_y").alias("max_y"))


# -- search --------------------------------------------------------------------------------

_NEAR = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), m AS (SELECT a.vec_id AS q, b.vec_id AS t, b.label AS label, list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY dist, t) AS INT) AS rank FROM m QUALIFY rank <= 10)
"""


def _knn(spark, d) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return knn.knn(e, e, 10, "vec_id", "vec_id", "embedding", skip_self=True)


def _out(hits: DataFrame) -> DataFrame:
    return hits.select("q", "rank", "t", F.round("dist", 6).alias("dist"))


@query(_NEAR + "SELECT q, rank, t, round(dist, 6) AS dist FROM r")
def knn_topk(spark, d):
    return _out(_knn(spark, d))


@query(_NEAR + "SELECT q, rank, t, round(dist, 6) AS dist FROM r")
def knn_metric(spark, d):
    """All vectors searched in a metric index of all vectors, which is written and read again."""
    e, path = _t(spark, d, "embeddings"), folder(spark)
    made = metric.build(e, "vec_id", "embedding")
    metric.write(made, path)
    drop(made.cells)
    return _out(metric.knn(metric.read(spark, path), e, 10, "vec_id", "embedding", skip_self=True))


@query(_NEAR + "SELECT q, rank, t, round(dist, 6) AS dist FROM r WHERE dist <= 1.2")
def knn_threshold(spark, d):
    return _out(knn.within(_knn(spark, d), 1.2))


@query(_NEAR + "SELECT q, rank, t, round(dist, 6) AS dist FROM r WHERE label IN (1, 2)")
def knn_target_filter(spark, d):
    hits = _knn(spark, d).join(_t(spark, d, "embeddings").select(F.col("vec_id").alias("t"), F.col("label")), "t")
    return _out(knn.of_targets(hits, [1, 2], "label"))


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), m AS (SELECT a.vec_id AS q, b.vec_id AS t, list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS dist FROM e a CROSS JOIN e b
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY dist, t) AS INT) AS rank FROM m QUALIFY rank <= 5)
SELECT q, rank, t, round(dist, 6) AS dist FROM r""")
def knn_sharded(spark, d):
    e = store.with_shard(_t(spark, d, "embeddings").withColumn("image_id", F.col("vec_id").cast("string")), 4)
    return _out(knn.sharded_knn(e, e, 5, "vec_id", "vec_id", "shard", "embedding"))


@query(_NEAR + "SELECT q, rank, t, round(dist, 6) AS dist FROM r WHERE label <> 3")
def tombstone_filter(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("t"), F.col("label").alias("image_id"))
    return _out(store.live_hits(_knn(spark, d).join(e, "t"), e.where("image_id <> 3")))


@query()
def lsh_knn(spark, d):
    """All vectors searched in a stored index of banded buckets, each among up to 1,000 candidates."""
    e, path = _t(spark, d, "embeddings"), folder(spark)
    lsh.write(lsh.build(e, "vec_id", "embedding"), path)
    return _out(lsh.search(lsh.read(spark, path), e, 5, "vec_id", "embedding"))


@query(_NEAR + "SELECT a.q, a.t, round(a.dist, 6) AS dist FROM r a JOIN r b ON a.q = b.q AND a.rank = 1 AND b.rank = 2 WHERE a.dist < b.dist * CAST(0.9 AS DOUBLE) * CAST(0.9 AS DOUBLE)")
def ratio_test(spark, d):
    """Vectors whose nearest other one is clearly nearer than the second."""
    e = _t(spark, d, "embeddings")
    return geometry.ratio_test(knn.knn(e, e, 2, "vec_id", "vec_id", "embedding", skip_self=True), 0.9).select("q", "t", F.round("dist", 6).alias("dist"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings), r AS (SELECT vec_id, unnest(range(len(a))) AS k, a, list_sum(a) + 1e-7 AS total FROM v) SELECT vec_id, CAST(k AS INT) AS pos, round(sqrt(a[k + 1] / total), 6) AS v FROM r")
def desc_root(spark, d):
    """Magnitudes of vectors as histograms, root-normalised."""
    e = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))
    return e.select("vec_id", F.posexplode(X.root_normalised("a")).alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("SELECT CAST(list_reduce(list_transform(string_split(md5(c_name), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, b: (a * 16 + b) % 7) AS INT) AS shard, count(*) AS size FROM customer GROUP BY 1")
def shard_counts(spark, d):
    return store.shard_info(store.with_shard(_t(spark, d, "customer").withColumn("image_id", F.col("c_name")), 7))


_SHARD = "list_reduce(list_transform(string_split(md5({}), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, b: (a * 16 + b) % {})"


@query(f"WITH {RASTER_SQL} SELECT CAST({_SHARD.format('image_id', 5)} AS INT) AS shard, count(*) AS size, count(DISTINCT image_id) AS images, CAST(max(len(p)) AS INT) AS dim FROM pat GROUP BY 1")
def index_roundtrip(spark, d):
    """All documents' patches written as a sharded index twice, and the latest version read again."""
    path = folder(spark)
    rows = engine.cut(_docs(spark, d), config(stride=STRIDE, entropy_threshold=None))
    for shards in (3, 5):  # descriptors, several times as large as patches, are made as they are read
        store.write(rows, path, shards, K.difference)
    return store.read(spark, path).groupBy("shard").agg(F.count("*").alias("size"), F.count_distinct("image_id").alias("images"), F.max(F.size("descriptor")).alias("dim"))


@query("""
WITH t AS (SELECT c_nationkey, c_nationkey % 4 + 1 AS seq, count(*) AS patches FROM customer GROUP BY ALL
), k AS (SELECT * FROM t QUALIFY row_number() OVER (ORDER BY seq DESC, CAST(c_nationkey AS VARCHAR) DESC) <= 10)
SELECT CAST(c_nationkey AS VARCHAR) AS image_id, seq, patches FROM k WHERE c_nationkey <> 7""")
def catalog_latest(spark, d):
    """Customers' nations as targets, added in four steps, the ten latest kept, and one removed."""
    rows = _t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("image_id"), (F.col("c_nationkey") % 4).alias("step"), "c_custkey")
    held = store.Catalog(max_targets=10)
    for k in range(4):
        held.add(rows.where(F.col("step") == k).drop("step"))
    return held.remove("7").targets()


@query("""
WITH t AS (SELECT c_nationkey, c_nationkey % 4 AS seq, count(*) AS patches FROM customer GROUP BY ALL
), k AS (SELECT * FROM t QUALIFY row_number() OVER (ORDER BY seq DESC, CAST(c_nationkey AS VARCHAR) DESC) <= 10)
SELECT CAST(c_nationkey AS VARCHAR) AS image_id, CAST(seq AS BIGINT) AS seq, patches FROM k WHERE c_nationkey <> 7""")
def index_targets(spark, d):
    """``catalog_latest`` on disk: four commits, the ten latest kept, one removed, and the log compacted."""
    rows, path = _t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("image_id"), (F.col("c_nationkey") % 4).alias("step"), "c_custkey"), folder(spark)
    for k in range(4):
        store.add(rows.where(F.col("step") == k).drop("step"), path)
    store.evict(spark, path, 10)
    store.remove(spark, path, ["7"])
    store.compact(spark, path)
    return store.targets(spark, path)


@query(f"WITH {RASTER_SQL} SELECT image_id, count(*) AS patches, CAST(max(y) AS INT) AS last_y FROM pat JOIN documents ON image_id = CAST(doc_id AS VARCHAR) WHERE source IS DISTINCT FROM 'src2' GROUP BY image_id")
def index_log(spark, d):
    """All documents' patches in one commit; those of one source added again, those of another removed; the stored index as readers see it."""
    path, docs = folder(spark), _t(spark, d, "documents")
    made = lambda rows: engine.index(text_images(rows, "doc_id", "text"), config(stride=STRIDE, entropy_threshold=None), K.difference)
    store.add(made(docs), path, shards=3)
    store.add(made(docs.where("source = 'src1'")), path)
    store.remove(spark, path, docs.where("source = 'src2'").select(F.col("doc_id").cast("string").alias("image_id")))
    return store.read(spark, path).groupBy("image_id").agg(F.count("*").alias("patches"), F.max("y").alias("last_y"))


@query(f"WITH {RASTER_SQL} SELECT image_id, count(*) AS patches, CAST(max(y) AS INT) AS last_y FROM pat GROUP BY image_id")
def stream_ingest(spark, d):
    """All documents as a stream of rasters, indexed incrementally, and the index read again."""
    path = folder(spark)
    docs = spark.readStream.schema(_t(spark, d, "documents").schema).parquet(f"{d}/documents.parque[t]")  # a pattern, as the table may be one file
    ingest(text_images(docs, "doc_id", "text"), path, f"{path}/checkpoint", config(stride=STRIDE, entropy_threshold=None), K.difference).awaitTermination()
    return store.read(spark, path).groupBy("image_id").agg(F.count("*").alias("patches"), F.max("y").alias("last_y"))


_MIXTURE = ([0.5, 0.3, 0.2], [[0.02, 10.0], [0.05, 25.0], [0.08, 40.0]], [[0.0004, 30.0], [0.0009, 60.0], [0.0004, 90.0]])


def _mixture_sql() -> str:
    from math import log, pi

    parts = [f"CAST({log(w) - 0.5 * sum(log(2 * pi * x) for x in v)!r} AS DOUBLE) - (l_discount - CAST({m[0]!r} AS DOUBLE)) ** 2 / CAST({2 * v[0]!r} AS DOUBLE) - (l_quantity - CAST({m[1]!r} AS DOUBLE)) ** 2 / CAST({2 * v[1]!r} AS DOUBLE)" for w, m, v in zip(*_MIXTURE)]
    return f"WITH p AS (SELECT l_orderkey, l_linenumber, [{', '.join(parts)}] AS a FROM lineitem) SELECT l_orderkey, l_linenumber, round(list_max(a) + ln(list_sum(list_transform(a, lambda x: exp(x - list_max(a))))), 6) AS log_p0 FROM p"


@query(_mixture_sql())
def prior_density(spark, d):
    """Log density under a diagonal mixture, that of a prior's embedding space."""
    return priors.score_mixture(_t(spark, d, "lineitem"), ["l_discount", "l_quantity"], *_MIXTURE, "log_p0").select("l_orderkey", "l_linenumber", F.round("log_p0", 6).alias("log_p0"))


@query("SELECT l_suppkey, median(l_extendedprice) AS median FROM lineitem GROUP BY l_suppkey")
def group_medians(spark, d):
    """Exact medians by group, those that give each image its kernel width."""
    return medians.grouped(_t(spark, d, "lineitem"), "l_suppkey", "l_extendedprice")


@query()
def hash_sample(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_name").alias("image_id"), F.col("p_partkey").cast("int").alias("patch_idx"))
    return priors.sample(rows, 100)


@query(r"SELECT p_partkey, regexp_replace(p_name || ' #' || p_type, '[^\p{L}\p{N}._-]', '', 'g') AS clean FROM part")
def sanitize_id(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.clean_id(F.concat("p_name", F.lit(" #"), "p_type")).alias("clean"))


# -- scores --------------------------------------------------------------------------------


def _chi2_sql(h: str) -> str:
    from math import lgamma

    return f"exp(-{h}) + " + " + ".join(f"exp(-{h} + {j} * ln({h}) - CAST({lgamma(j + 1)!r} AS DOUBLE))" for j in range(1, 18))


@query(f"SELECT l_orderkey, l_linenumber, round(CASE WHEN rss = 0 THEN 1 ELSE least(1, greatest(0, {_chi2_sql('h')})) END, 8) AS probability FROM (SELECT *, l_discount * l_tax * 4 AS rss, l_discount * l_tax * 4 / CAST({2 * 0.02 * 0.02!r} AS DOUBLE) AS h FROM lineitem)")
def chi2_prob_even_dof(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.chi2_probability(F.col("l_discount") * F.col("l_tax") * 4, 4), 8).alias("probability"))


@query("SELECT l_orderkey, l_linenumber, round(-(l_discount * l_tax) / (2 * 0.0004) - 48 * 0.5 * ln(2 * pi() * 0.0004) - l_quantity, 6) AS log_bf FROM lineitem")
def log_bf(spark, d):
    value = X.log_bayes_factor(F.col("l_discount") * F.col("l_tax"), F.lit(4), 0.02, F.col("l_quantity"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(value, 6).alias("log_bf"))


@query("SELECT p_size, CAST(greatest(1, 3 * p_size * p_size - 12) AS INT) AS dof, count(*) AS n FROM part GROUP BY p_size")
def dof_by_size(spark, d):
    return _t(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n")).select("p_size", X.dof_for(F.col("p_size")).alias("dof"), "n")


@query("SELECT l_suppkey, round(coalesce((regr_slope(ln(l_extendedprice), ln(l_quantity)) - 2) / 2, 0), 6) AS alpha FROM lineitem GROUP BY l_suppkey")
def rg_slope(spark, d):
    slope = F.regr_slope(F.log("l_extendedprice"), F.log("l_quantity"))
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(slope.alias("slope")).select("l_suppkey", F.round(X.holder_exponent(F.col("slope")), 6).alias("alpha"))


@query("WITH a AS (SELECT l_suppkey, l_returnflag, coalesce((regr_slope(ln(l_extendedprice), ln(l_quantity)) - 2) / 2, 0) AS alpha FROM lineitem GROUP BY ALL) SELECT a.l_suppkey, round(-0.5 * pow((a.alpha - b.alpha) / 0.4, 2), 5) + 0.0 AS agreement FROM a JOIN a b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'N'")
def rg_agreement(spark, d):
    a = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(X.holder_exponent(F.regr_slope(F.log("l_extendedprice"), F.log("l_quantity"))).alias("alpha"))
    b = a.where("l_returnflag = 'N'").select("l_suppkey", F.col("alpha").alias("beta"))
    return a.where("l_returnflag = 'A'").join(b, "l_suppkey").select("l_suppkey", (F.round(X.agreement(F.col("alpha"), F.col("beta")), 5) + F.lit(0.0)).alias("agreement"))


@query(f"WITH {RASTER_SQL} SELECT image_id, patch_idx, round(list_sum(list_transform(p, lambda a: (a - list_sum(p) / 48) * (a - list_sum(p) / 48))) / 48, 8) AS energy FROM pat")
def patch_energy(spark, d):
    return _patches(spark, d, columns=("image_id", "patch_idx", "patch")).select("image_id", "patch_idx", F.round(X.patch_energy(F.col("patch")), 8).alias("energy"))


@query()
def affine_huber(spark, d):
    """Each patch fitted to the patch below it."""
    p = save(_patches(spark, d, columns=("image_id", "patch_idx", "x", "y", "patch")))
    below = p.select("image_id", "x", (F.col("y") - STRIDE).alias("y"), F.col("patch").alias("tgt_patch"))
    out = verify.fit(p.select("image_id", "patch_idx", "x", "y", F.col("patch").alias("src_patch")).join(below, ["image_id", "x", "y"]))
    return out.select("image_id", "patch_idx", F.round("rss", 6).alias("rss"), "dof", "success", F.round("probability", 6).alias("probability"))


# -- aggregation ---------------------------------------------------------------------------


def _matches(spark, d) -> DataFrame:
    """Matches with sparse offsets, made of orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return _t(spark, d, "orders").select(
        F.col("o_orderpriority").alias("image_id"), (k % 50).cast("int").alias("src_x"), (c % 40).cast("int").alias("src_y"), (k % 50 + c * 7919 % 2000 - 1000).cast("int").alias("tgt_x"), (c % 40 + k * 104729 % 2000 - 1000).cast("int").alias("tgt_y"),
        (F.lit(3) + k % 4).cast("int").alias("patch_size"), (F.col("o_totalprice") % 100 / 100).alias("probability"), k.alias("match_ord"), (F.col("o_totalprice") / 10000 - 5).alias("log_bf"), k.alias("node"),
    )


_MATCH_SQL = """
mt AS (SELECT o_orderpriority AS image_id, CAST(o_orderkey % 50 AS INT) AS src_x, CAST(o_custkey % 40 AS INT) AS src_y, CAST(o_orderkey % 50 + o_custkey * 7919 % 2000 - 1000 AS INT) AS tgt_x,
  CAST(o_custkey % 40 + o_orderkey * 104729 % 2000 - 1000 AS INT) AS tgt_y, CAST(3 + o_orderkey % 4 AS INT) AS patch_size, o_totalprice % 100 / 100 AS probability, o_orderkey AS match_ord, o_totalprice / 10000 - 5 AS log_bf, o_orderkey AS node FROM orders)
"""
_CELL_SQL = f"WITH RECURSIVE {_MATCH_SQL}, c AS (SELECT *, CAST(floor((tgt_x - src_x) / 2.0) AS INT) AS cx, CAST(floor((tgt_y - src_y) / 2.0) AS INT) AS cy FROM mt)"


@query(f"{_CELL_SQL} SELECT image_id, cx, cy, count(*) AS n FROM c GROUP BY ALL")
def offset_cells(spark, d):
    return coherence.offset_cells(_matches(spark, d)).groupBy("image_id", "cx", "cy").agg(F.count("*").alias("n"))


@query(f"""{_CELL_SQL}, cell AS (SELECT DISTINCT image_id, cx, cy FROM c
), step AS (SELECT a.image_id, a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS b_y FROM cell a JOIN (SELECT image_id, cx, cy, unnest([-1, 0, 1]) + cx AS nx FROM cell) b ON a.image_id = b.image_id AND a.cx = b.nx AND abs(a.cy - b.cy) <= 1
), reach AS (SELECT image_id, cx AS ax, cy AS ay, cx AS bx, cy AS b_y FROM cell UNION SELECT r.image_id, r.ax, r.ay, s.bx, s.b_y FROM reach r JOIN step s ON r.image_id = s.image_id AND r.bx = s.ax AND r.b_y = s.ay
), root AS (SELECT image_id, ax, ay, min(bx * 100000 + b_y) AS k FROM reach GROUP BY ALL)
SELECT image_id, CAST(arg_min(cx, match_ord) * 2 AS INT) AS offset_x, CAST(arg_min(cy, match_ord) * 2 AS INT) AS offset_y, count(*) AS n, round(avg(probability), 6) AS mean_probability, round(avg(probability) * log2(count(*) + 1), 6) AS confidence,
  CAST(max(src_x) - min(src_x) + arg_min(patch_size, match_ord) AS INT) AS source_w, CAST(max(tgt_y) - min(tgt_y) + arg_min(patch_size, match_ord) AS INT) AS target_h
FROM c JOIN root r ON c.image_id = r.image_id AND c.cx = r.ax AND c.cy = r.ay GROUP BY c.image_id, r.k HAVING count(*) >= 2 AND avg(probability) >= 0.5""".replace("SELECT image_id, CAST(arg_min", "SELECT c.image_id, CAST(arg_min"))
def coherent_regions(spark, d):
    r = coherence.regions(_matches(spark, d), 2, 2, 0.5)
    return r.select("image_id", F.col("offset_x").cast("int"), F.col("offset_y").cast("int"), "n", F.round("mean_probability", 6).alias("mean_probability"), F.round("confidence", 6).alias("confidence"), F.col("source_bbox")[2].alias("source_w"), F.col("target_bbox")[3].alias("target_h"))


@query(f"WITH {_MATCH_SQL} SELECT image_id, src_x, src_y, match_ord, round(probability, 6) AS probability FROM mt ORDER BY mt.probability DESC, match_ord LIMIT 1")
def best_match(spark, d):
    return verify.best_match(_matches(spark, d)).select("image_id", "src_x", "src_y", "match_ord", F.round("probability", 6).alias("probability"))


@query(f"WITH {_MATCH_SQL} SELECT image_id, match_ord, round(probability, 6) AS probability FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY probability DESC, match_ord) AS k FROM mt) WHERE k = 1 ORDER BY probability DESC LIMIT 3")
def topk_by_image(spark, d):
    return knn.by_image(_matches(spark, d), "probability", 3).select("image_id", "match_ord", F.round("probability", 6).alias("probability"))


@query(f"WITH {_MATCH_SQL} SELECT image_id, tgt_y AS y, tgt_x AS x, round(sum(probability * w) / sum(w), 6) AS value FROM (SELECT *, CASE patch_size WHEN 3 THEN 1.0::DOUBLE WHEN 4 THEN 1.2::DOUBLE WHEN 5 THEN 1.5::DOUBLE WHEN 6 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM mt) GROUP BY ALL")
def heatmap_raw(spark, d):
    return heatmap.pixels(_matches(spark, d)).withColumn("value", F.round("value", 6))


_SMOOTH_SQL = f"""WITH RECURSIVE {_MATCH_SQL}, px AS (
  SELECT image_id, tgt_y + 1000 AS y, tgt_x + 1000 AS x, sum(probability * w) / sum(w) AS v FROM (SELECT *, CASE patch_size WHEN 4 THEN 1.2::DOUBLE WHEN 5 THEN 1.5::DOUBLE WHEN 6 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM mt) GROUP BY ALL
), tap AS (SELECT d, exp(-d * d / CAST(8 AS DOUBLE)) / sum(exp(-d * d / CAST(8 AS DOUBLE))) OVER () AS g FROM (SELECT unnest(range(-8, 9)) AS d)
), tall AS (SELECT * FROM px UNION ALL SELECT image_id, -1 - y, x, v FROM px WHERE y < 8  -- mirrored at the edge; no target is near the others
), src AS (SELECT * FROM tall UNION ALL SELECT image_id, y, -1 - x, v FROM tall WHERE x < 8
), down AS (SELECT image_id, y + d AS y, x, sum(v * g) AS v FROM src, tap WHERE y + d >= 0 GROUP BY ALL
), heat AS (SELECT image_id, y, x + d AS x, sum(v * g) AS v FROM down, tap WHERE x + d >= 0 GROUP BY ALL
), hot AS (SELECT image_id, y * 2060 + x AS k FROM (SELECT *, max(v) OVER (PARTITION BY image_id) AS top FROM heat) WHERE v > 0.5 * top
), step AS (SELECT a.image_id, a.k, b.k AS n FROM hot a JOIN (SELECT image_id, k, unnest([k - 2060, k - 1, k + 1, k + 2060]) AS j FROM hot) b ON a.image_id = b.image_id AND a.k = b.j
), reach AS (SELECT image_id, k, k AS n FROM hot UNION SELECT r.image_id, r.k, s.n FROM reach r JOIN step s ON r.image_id = s.image_id AND r.n = s.k
), root AS (SELECT image_id, k, min(n) AS first FROM reach GROUP BY ALL
), part AS (SELECT image_id, first, count(*) AS area, min(k % 2060) AS x, min(k // 2060) AS y, max(k % 2060) - min(k % 2060) + 1 AS w, max(k // 2060) - min(k // 2060) + 1 AS h FROM root GROUP BY ALL
)
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY first) AS INT) AS region, CAST(area AS INT) AS area, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS w, CAST(h AS INT) AS h FROM part QUALIFY area >= 9"""


@query(_SMOOTH_SQL)
def heatmap_smooth(spark, d):
    """Hot regions of all matches, whose targets of -1000 to 1048 are moved into the image."""
    m = _matches(spark, d).withColumns({c: F.col(c) + 1000 for c in ("tgt_x", "tgt_y")})
    sizes = m.select("image_id").distinct().withColumn("height", F.lit(2060)).withColumn("width", F.lit(2060))
    return heatmap.hot_regions(heatmap.smooth_tiles(heatmap.pixels(m), sizes), 0.5)


_FOOT_SQL = f"WITH {_MATCH_SQL}, f AS (SELECT DISTINCT image_id, y, x FROM (SELECT image_id, patch_size, src_x, unnest(range(src_y, src_y + patch_size)) AS y, unnest(range(0, patch_size)) AS k FROM mt), LATERAL (SELECT unnest(range(src_x, src_x + patch_size)) AS x))"


@query(_FOOT_SQL + " SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM f")
def footprint_mask(spark, d):
    return heatmap.footprint(_matches(spark, d))


@query(_FOOT_SQL + " SELECT image_id, count(*) AS area, CAST(min(x) AS INT) AS x, CAST(min(y) AS INT) AS y, CAST(max(x) - min(x) + 1 AS INT) AS w, CAST(max(y) - min(y) + 1 AS INT) AS h FROM f GROUP BY image_id")
def mask_bbox(spark, d):
    return heatmap.box(heatmap.footprint(_matches(spark, d)))


_LARGEST_SQL = _FOOT_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, cell AS (SELECT image_id, y * 56 + x AS k, y, x FROM f WHERE y BETWEEN 0 AND 45 AND x BETWEEN 0 AND 55
), near AS (SELECT a.image_id, a.k, b.k AS n FROM cell a JOIN (SELECT image_id, k, y, x, unnest([-57, -56, -55, -1, 1, 55, 56, 57]) AS d FROM cell) b ON a.image_id = b.image_id AND a.k = b.k + b.d AND abs(a.x - b.x) <= 1
), seed AS (SELECT image_id, k FROM cell EXCEPT SELECT image_id, k FROM near WHERE n < k
), reach AS (SELECT image_id, k AS seed, k FROM seed UNION SELECT r.image_id, r.seed, n.n FROM reach r JOIN near n ON r.image_id = n.image_id AND r.k = n.k
), root AS (SELECT image_id, k, min(seed) AS root FROM reach GROUP BY ALL
), part AS (SELECT image_id, root, count(*) AS area, min(k % 56) AS x, min(k // 56) AS y, max(k % 56) AS x1, max(k // 56) AS y1 FROM root GROUP BY image_id, root QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, root) = 1)
SELECT image_id, area, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(x1 - x + 1 AS INT) AS w, CAST(y1 - y + 1 AS INT) AS h, area / CAST(46 * 56 AS DOUBLE) AS area_fraction FROM part"""


@query(_LARGEST_SQL)
def localize(spark, d):
    m = _matches(spark, d)
    return heatmap.localize(m, m.select("image_id").distinct().withColumn("height", F.lit(46)).withColumn("width", F.lit(56)))


@query("""
WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
SELECT tp, fp, fn, tn, round(tp / (tp + fp + fn), 6) AS iou, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE), 6) AS mcc FROM c""")
def localization_metrics(spark, d):
    rows = _t(spark, d, "labels").select((F.col("quality") == 1).alias("predicted"), (F.col("toxic") == 1).alias("actual"))
    out = heatmap.localization_scores(rows)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("iou", "precision", "recall", "f1", "mcc")])


@query("""
WITH s AS (SELECT n_chars, toxic = 1 AS pos FROM labels JOIN documents USING (doc_id)
), r AS (SELECT pos, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM s)
SELECT round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auc, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg FROM r""")
def detection_auc(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("n_chars").alias("score"), (F.col("toxic") == 1).alias("positive"))
    return heatmap.detection_auc(rows).select(F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


_VOTE_SQL = f"WITH {_MATCH_SQL}, v AS (SELECT CAST(round_even((tgt_x - src_x) / 2.0, 0) AS INT) AS ix, CAST(round_even((tgt_y - src_y) / 2.0, 0) AS INT) AS iy, 0 AS it, 0 AS \"is\", sum(log_bf) AS weight, count(*) AS votes FROM mt WHERE log_bf > 0 GROUP BY ALL)"


@query(_VOTE_SQL + ' SELECT ix, iy, CAST(it AS INT) AS it, CAST("is" AS INT) AS "is", round(weight, 6) AS weight, votes FROM v')
def hough_votes(spark, d):
    return hough.vote(_matches(spark, d)).withColumn("weight", F.round("weight", 6))


@query(_VOTE_SQL + " SELECT ix, iy, round(sum(weight), 6) AS weight FROM v GROUP BY ix, iy")
def hough_project(spark, d):
    return hough.plane(hough.vote(_matches(spark, d))).withColumn("weight", F.round("weight", 6))


@query(_VOTE_SQL + " SELECT ix, iy, round(weight, 4) AS weight, ix * 2.0::DOUBLE AS dx, iy * 2.0::DOUBLE AS dy FROM v ORDER BY v.weight DESC, ix, iy LIMIT 20")
def hough_topk(spark, d):
    return hough.transforms(hough.top_cells(hough.vote(_matches(spark, d)), 20)).select("ix", "iy", F.round("weight", 4).alias("weight"), "dx", "dy")


@query(_VOTE_SQL + ' SELECT min(ix) AS min_ix, max(ix) AS max_ix, min(iy) AS min_iy, max(iy) AS max_iy, CAST(min(it) AS INT) AS min_it, CAST(max(it) AS INT) AS max_it, CAST(min("is") AS INT) AS min_is, CAST(max("is") AS INT) AS max_is FROM v')
def hough_bounds(spark, d):
    return hough.bounds(hough.vote(_matches(spark, d)))


@query()
def hough_peaks(spark, d):
    return hough.peaks(hough.vote(_matches(spark, d))).select("peak", "ix", "iy", F.round("persistence", 4).alias("persistence"), "votes")


def _fixed_peaks(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return _t(spark, d, "nation").select(k.alias("peak"), (k * 71 % 2000 - 1000).cast("double").alias("dx"), (k * 173 % 2000 - 1000).cast("double").alias("dy"))


@query(f"WITH {_MATCH_SQL}, p AS (SELECT n_nationkey AS peak, n_nationkey * 71 % 2000 - 1000 AS dx, n_nationkey * 173 % 2000 - 1000 AS dy FROM nation) SELECT node, peak, round(max(log_bf), 6) AS evidence FROM mt JOIN p ON abs(tgt_x - src_x - dx) <= 40 AND abs(tgt_y - src_y - dy) <= 40 GROUP BY node, peak")
def unary_table(spark, d):
    return hough.unary_table(_matches(spark, d), _fixed_peaks(spark, d), 40.0).withColumn("evidence", F.round("evidence", 6))


_PEAK_SQL = "p AS (SELECT n_nationkey AS peak, n_nationkey * 71 % 2000 - 1000 AS dx, n_nationkey * 173 % 2000 - 1000 AS dy FROM nation)"


@query(f"""WITH {_MATCH_SQL}, {_PEAK_SQL}, u AS (SELECT node, peak, dx, dy, max(log_bf) AS e, min(match_ord) AS match_ord, arg_min(image_id, match_ord) AS image_id FROM mt JOIN p ON abs(tgt_x - src_x - dx) <= 60 AND abs(tgt_y - src_y - dy) <= 60 GROUP BY ALL
), z AS (SELECT node, sum(exp(e)) + (25 - count(*)) + exp(CAST(0.5 AS DOUBLE)) AS total FROM u GROUP BY node
), best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY node ORDER BY e DESC, peak) = 1)
SELECT node, b.image_id, CAST(src_x + dx AS INT) AS tgt_x, CAST(src_y + dy AS INT) AS tgt_y, round(exp(e) / total, 6) AS probability, b.match_ord FROM best b JOIN z USING (node) JOIN mt USING (node) WHERE e > 0.5""")
def map_decode(spark, d):
    """Source patches without neighbours decoded to their best supported peak, or to none."""
    cands, found = _matches(spark, d), _fixed_peaks(spark, d)
    backed = save(hough.support(cands, found, 60.0))
    table = bp.unary_vectors(cands.select("node").distinct(), backed, 25, engine.NULL_LABEL)
    nodes = cands.select("node", F.lit("q").alias("src_image"), F.col("node").alias("src_idx"), F.col("src_x").alias("x"), F.col("src_y").alias("y"), F.col("patch_size").alias("size"))
    beliefs, _ = bp.loopy_bp(table, spark.createDataFrame([], "a long, b long, beta double"), 5, 0.4)
    out = engine.map_decode(beliefs, nodes, found, backed, 25)
    return out.select(F.col("src_idx").alias("node"), "image_id", "tgt_x", "tgt_y", F.round("probability", 6).alias("probability"), "match_ord")


def _nodes(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(k.alias("node"), (F.lit(3) + F.col("p_size") % 4).cast("int").alias("size"), (k * 37 % 211).cast("int").alias("x"), (k * 101 % 223).cast("int").alias("y"))


@query("""
WITH m AS (SELECT l_suppkey AS pair, l_orderkey % 10 < 3 AS good FROM lineitem
) SELECT pair, round((0.8 + pair % 5 * 0.1) * cos(pair % 7 * 0.3), 2) AS a, round((0.8 + pair % 5 * 0.1) * sin(pair % 7 * 0.3), 2) + 0.0 AS b, CAST(pair % 50 - 25 AS DOUBLE) AS c, CAST(pair % 30 AS DOUBLE) AS d, true AS most FROM m GROUP BY pair HAVING count(*) FILTER (good) >= 20""")
def ransac_pairs(spark, d):
    """Planted similarities, one for each supplier, recovered from line items of which seven in ten are outliers."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    x, y = ((k * 37 + n * 11) % 997).cast("double"), ((k * 59 + n * 101) % 991).cast("double")
    p = F.col("l_suppkey")
    turn, zoom = p % 7 * 0.3, F.lit(0.8) + p % 5 * 0.1
    a, b = zoom * F.cos(turn), zoom * F.sin(turn)
    rows = _t(spark, d, "lineitem").select(p.alias("pair"), (k % 10 < 3).alias("good"), x.alias("sx"), y.alias("sy"), (a * x - b * y + p % 50 - 25).alias("gx"), (b * x + a * y + p % 30).alias("gy"), ((k * 7919 + n * 104729) % 1999).cast("double").alias("rx"), ((k * 15485863 + n * 32452843) % 2003).cast("double").alias("ry"))
    found, _ = geometry.similarity(rows.select("pair", "sx", "sy", F.when(F.col("good"), F.col("gx")).otherwise(F.col("rx")).alias("tx"), F.when(F.col("good"), F.col("gy")).otherwise(F.col("ry")).alias("ty")), ["pair"])
    good = rows.where("good").groupBy("pair").agg(F.count("*").alias("n")).where("n >= 20")
    out = found.join(good, "pair").withColumn("most", (F.col("inliers") >= F.col("n")) & (F.col("inliers") <= F.col("n") * 1.1))
    whole = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    return out.select("pair", whole("a", 2), whole("b", 2), whole("c", 0), whole("d", 0), "most")


_NODE_SQL = "WITH n AS (SELECT p_partkey AS node, CAST(3 + p_size % 4 AS INT) AS size, p_partkey * 37 % 211 AS x, p_partkey * 101 % 223 AS y FROM part)"


@query(_NODE_SQL + " SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON a.size = b.size AND a.node < b.node WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 16")
def spatial_edges(spark, d):
    return hough.spatial_edges(_nodes(spark, d))


@query(_NODE_SQL + " SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON a.size < b.size AND abs(a.x - b.x) <= b.size / 2.0 AND abs(a.y - b.y) <= b.size / 2.0")
def inclusion_edges(spark, d):
    return hough.inclusion_edges(_nodes(spark, d))


BP_ROUNDS, BP_DAMPING, BP_TOL = 10, 0.4, 1e-4


def _bp_sql() -> str:
    """The rounds one below the other; a round after messages have settled keeps them."""
    ks = range(3)
    each = lambda text, sep=", ": sep.join(text.format(k=k) for k in ks)
    parts = [
        _NODE_SQL,
        f"u AS (SELECT node, {each('sin(node * ({k} + 1)) AS u{k}')} FROM n)",
        "e AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON a.size = b.size AND a.node <> b.node WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 16)",
        f"m0 AS (SELECT a, b, {each('0::DOUBLE AS m{k}')}, 1e9::DOUBLE AS moved FROM e)",
    ]
    state = lambda r: f"s{r} AS MATERIALIZED (SELECT u.node, {each('any_value(u{k}) + coalesce(sum(m{k}), 0) AS s{k}')} FROM u LEFT JOIN m{r} ON u.node = b GROUP BY u.node)"
    for r in range(1, BP_ROUNDS + 1):
        was = r - 1
        parts += [
            state(was),
            f"c{r} AS (SELECT m.a, m.b, {each('m.m{k} AS m{k}')}, {each('s{k} - back.m{k} AS c{k}')} FROM m{was} m JOIN s{was} s ON s.node = m.a JOIN m{was} back ON back.a = m.b AND back.b = m.a)",
            f"d{r} AS (SELECT *, {each('ln(exp(c{k}) * (1 - exp(-1)) + exp(-1) * (exp(c0) + exp(c1) + exp(c2))) AS r{k}')} FROM c{r})",
            f"f{r} AS (SELECT a, b, {each('m{k}')}, {each('(r{k} - greatest(r0, r1, r2)) * ' + str(1 - BP_DAMPING) + ' + m{k} * ' + str(BP_DAMPING) + ' AS w{k}')} FROM d{r})",
            f"m{r} AS MATERIALIZED (SELECT a, b, {each('CASE WHEN last < ' + str(BP_TOL) + ' THEN m{k} ELSE w{k} END AS m{k}')}, CASE WHEN last < {BP_TOL} THEN last ELSE greatest({each('abs(w{k} - m{k})')}) END AS moved FROM f{r}, (SELECT max(moved) AS last FROM m{was}))",
        ]
    last = f"SELECT node, CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INT) AS map_label, {each('round(exp(s{k}) / (exp(s0) + exp(s1) + exp(s2)), 4) AS marginal_{k}')} FROM s{BP_ROUNDS}"
    return ", ".join([*parts, state(BP_ROUNDS)]) + " " + last


@query(_bp_sql())
def belief_propagation(spark, d):
    """Marginals of three labels on the parts' spatial network."""
    n = _nodes(spark, d)
    unary = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.sin(F.col("node") * (k + 1)))
    beliefs, _ = bp.loopy_bp(n.select("node", unary.alias("unary")), hough.spatial_edges(n).withColumn("beta", F.lit(1.0)), BP_ROUNDS, BP_DAMPING, BP_TOL, dense=True)
    return beliefs.select("node", "map_label", *[F.round(F.col("marginal")[k], 4).alias(f"marginal_{k}") for k in range(3)])


@query("WITH v AS (SELECT l_suppkey, [l_quantity, l_discount, l_tax, l_extendedprice, l_quantity * l_tax, l_linenumber, l_partkey, l_orderkey, l_discount * 2, l_tax * 3, l_quantity / 7, l_discount - l_tax]::DOUBLE[] AS a FROM lineitem), u AS (SELECT l_suppkey, unnest(range(12)) AS k, a FROM v) SELECT l_suppkey AS cluster, CAST(k AS INT) AS pos, round(median(a[k + 1]), 6) AS v FROM u GROUP BY l_suppkey, k")
def region_median_transform(spark, d):
    c = lambda s: F.expr(s).cast("double")
    m = F.array(*[c(s) for s in ("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_quantity * l_tax", "l_linenumber", "l_partkey", "l_orderkey", "l_discount * 2")])
    b = F.array(*[c(s) for s in ("l_tax * 3", "l_quantity / 7", "l_discount - l_tax")])
    out = coherence.median_transform(_t(spark, d, "lineitem").select(F.col("l_suppkey").alias("cluster"), m.alias("M"), b.alias("b")))
    return out.select("cluster", F.posexplode(F.concat("M", "b")).alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("SELECT round(avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS detect_rate, round(median(value) FILTER (event_type = 'purchase'), 6) AS error_median, round(quantile_cont(value, 0.9) FILTER (event_type = 'purchase'), 6) AS error_p90, round(avg(value), 4) AS latency_ms, count(*) AS n FROM events")
def trial_report(spark, d):
    rows = _t(spark, d, "events").select((F.col("event_type") == "purchase").alias("detected"), F.col("value").alias("error"), F.col("value").alias("latency_ms"))
    return heatmap.trial_report(rows).select(*[F.round(c, 6).alias(c) for c in ("detect_rate", "error_median", "error_p90")], F.round("latency_ms", 4).alias("latency_ms"), "n")


@query()
def scale_cue(spark, d):
    """Resampling cue of benchmark passages' images."""
    return scale.scale_inconsistency(text_rasters(_t(spark, d, "benchmark"), "item_id", "text"), 16, 8)


# -- engines -------------------------------------------------------------------------------


def config(**more) -> Config:
    return Config(**({"patch_size": SIZE, "stride": 1, "entropy_threshold": ENTROPY, "k_neighbors": 5, "distance_threshold": 0.5} | more))


def _passages(spark, d) -> DataFrame:
    """Images of benchmark passages, one for each of the three channels that a passage may start in."""
    rows = _t(spark, d, "benchmark").withColumn("phase", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return text_rasters(rows.select(F.concat_ws(":", "item_id", "phase").alias("item"), F.expr("substring(text, phase)").alias("text")), "item", "text")


@query()
def match_chi2(spark, d):
    """Benchmark passages' patches among those of all documents: fits, probabilities, regions' members."""
    targets = engine.Unindexed(_docs(spark, d), config(stride=2))  # an index would be fifty times its texts
    return engine.match(_passages(spark, d), targets, config(), K.photometric).matches.select("src_image", "image_id", "src_idx", "tgt_idx", "rank", F.round("dist", 6).alias("dist"), F.round("rss", 6).alias("rss"), F.round("probability", 6).alias("probability"))


@query()
def match_regions(spark, d):
    targets = engine.Unindexed(_docs(spark, d), config(stride=2))  # an index would be fifty times its texts
    return engine.match(_passages(spark, d), targets, config(coherence_min_cluster=2), K.photometric).regions.drop("members")


_BELOW = "CAST(2 + item_id % 3 * 2 AS INT)"


@query(f"SELECT 'q' || item_id AS src_image, 't' || item_id AS image_id, 0 AS dx, {_BELOW} AS dy FROM benchmark WHERE length(text) > 144")
def match_bayes(spark, d):
    """Benchmark passages found by the Bayes engine in images that hold them 2, 4 or 6 rows further down, under the passage's characters in reverse: image and offset that most of each passage's matches name."""
    b = _t(spark, d, "benchmark")
    shift = F.col("item_id") % 3 * 2 + 2
    above = F.rpad(F.reverse("text"), 48 * 6, ".")
    sources = text_rasters(b.select(F.concat(F.lit("q"), "item_id").alias("item"), "text"), "item", "text")
    targets = text_rasters(b.select(F.concat(F.lit("t"), "item_id").alias("item"), F.concat(F.substring(above, F.lit(1), (48 * shift).cast("int")), "text").alias("text")), "item", "text")
    result = engine.match_bayes(sources, targets, config(), sizes=(SIZE,), k=3, distance=0.2)
    votes = result.matches.groupBy("src_image", "image_id", (F.col("tgt_x") - F.col("src_x")).alias("dx"), (F.col("tgt_y") - F.col("src_y")).alias("dy")).agg(F.count("*").alias("n"))
    best = votes.groupBy("src_image").agg(F.max_by(F.struct("image_id", "dx", "dy"), F.struct("n", "image_id")).alias("b"))
    return best.select("src_image", "b.*")


def _splice_trials(spark, d) -> DataFrame:
    """Each benchmark passage with a recoloured square of the next one in it, and as it is."""
    rows = _t(spark, d, "benchmark")
    pairs = rows.select(F.col("item_id").cast("string").alias("host_id"), (F.col("item_id") + 1).cast("string").alias("donor_id"))
    return evaluate.plant(text_rasters(rows, "item_id", "text"), pairs)


@query()
def splice_accuracy(spark, d):
    """Accuracy of the search on squares planted into all benchmark passages that have room for a patch; squares of one patch can't have the three fits that must agree."""
    return evaluate.summary(evaluate.detect(_splice_trials(spark, d), SIZE, 1))


@query()
def copy_move_accuracy(spark, d):
    """Offsets found in all benchmark passages that have room for a square and its copy."""
    trials = evaluate.plant_copies(text_rasters(_t(spark, d, "benchmark"), "item_id", "text"), region=6)
    return heatmap.trial_report(evaluate.own_offsets(trials, SIZE, 1).withColumn("latency_ms", F.lit(0.0))).drop("latency_ms")
