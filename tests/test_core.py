import hashlib
import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmatch.config import Config
from fragmatch.errors import ConfigError, ImageError, ImageShapeError, IndexCorruptedError, TargetExistsError, TargetNotFoundError
from fragmatch.functions import exprs as X
from fragmatch.functions import kernels as K
from fragmatch.operators import bp, coherence, heatmap, hough, knn, lsh, patches, priors, scale, verify
from fragmatch.operators.components import components
from fragmatch.plans import engine
from fragmatch.sources import images, report, synthetic
from fragmatch.sources import index as store
from fragmatch.sources.rasters import from_array, text_rasters

MATCH = "image_id string, src_x int, src_y int, tgt_x int, tgt_y int, patch_size int, probability double, match_ord long"


def test_config():
    assert Config().patch_size == 3
    for bad in ({"patch_size": 2}, {"patch_size": 10}, {"pyramid_scales": [0.5]}, {"distributed_enabled": True, "num_shards": 1}, {"lsh_enabled": True, "k_neighbors": 2000}, {"scoring_mode": "x"}, {"min_probability": 1.5}):
        with pytest.raises(ConfigError):
            Config(**bad)
    assert Config.from_env({"FRAGMATCH_STRIDE": "3", "FRAGMATCH_LSH_ENABLED": "true", "FRAGMATCH_PYRAMID_SCALES": "1,0.5"}).stride == 3
    with pytest.raises(ConfigError):
        Config.from_env({"FRAGMATCH_STRIDE": "x"})


def test_normalise():
    with pytest.raises(ImageShapeError):
        images.normalise(np.zeros((4, 4)))
    with pytest.raises(ImageError):
        images.normalise(np.zeros((4, 4, 3)))
    with pytest.raises(ImageError):
        images.normalise(np.full((4, 4, 3), np.nan, np.float32))
    assert images.normalise(np.full((4, 4, 3), 255, np.uint8)).max() == 1
    assert images.normalise(np.full((4, 4, 3), 4.0)).max() == 1


def test_components_against_union_find(spark):
    r = np.random.RandomState(0)
    edges = r.randint(0, 300, (220, 2))
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame([(int(a), int(b)) for a, b in edges] + [(None, 5), (7, 7)], "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges.tolist():
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in edges.tolist() if a != b for x in (a, b)}
    assert got == want
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {x["component"] for x in components(chain).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_explode_counts_and_filter(spark):
    r = np.random.RandomState(0)
    df = from_array(spark, {"a": r.rand(10, 10, 3), "b": r.rand(3, 3, 3), "c": r.rand(2, 9, 3)})
    rows = patches.explode(df, 3).collect()
    assert sum(x["image_id"] == "a" for x in rows) == 64 and sum(x["image_id"] == "b" for x in rows) == 1 and not [x for x in rows if x["image_id"] == "c"]
    assert patches.explode(df, 3, 1, 3.0).count() == 0
    kept = patches.explode(df, 3, 1, 2.0).collect()
    assert kept and all(x["entropy"] > 2.0 for x in kept)
    empty = text_rasters(spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200)], "i long, t string"), "i", "t")
    assert {x["image_id"] for x in patches.explode(empty, 4).collect()} == {"3"}


def test_pyramid_levels(spark):
    df = from_array(spark, {"a": np.random.RandomState(0).rand(64, 64, 3)})
    rows = patches.pyramid(df, [1.0, 0.5, 0.25, 0.125], 16).select("level", "height").collect()
    assert sorted((x["level"], x["height"]) for x in rows) == [(0, 64), (1, 32), (2, 16)]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_knn_both_ways(spark, limit):
    r = np.random.RandomState(1)
    q, t = r.randn(30, 8), r.randn(90, 8)
    t[5] = t[6]
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "q long, v array<double>")
    td = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], "t long, v array<double>").repartition(5)
    got = {(x["q"], x["rank"]): x["t"] for x in knn.knn(qd, td, 4, "q", "t", "v", broadcast_bytes=limit).collect()}
    d = ((q[:, None] - t[None]) ** 2).sum(2)
    want = {(i, k + 1): int(j) for i in range(30) for k, j in enumerate(np.lexsort((np.arange(90), d[i]))[:4])}
    assert got == want
    assert knn.knn(qd, td.limit(2), 4, "q", "t", "v", broadcast_bytes=limit).count() == 60


def test_lsh_is_exact_on_what_it_finds(spark):
    r = np.random.RandomState(2)
    t = K.unit(r.randn(300, 16))
    q = K.unit(t[:20] + 0.02 * r.randn(20, 16))
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q long, v array<double>")
    td = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], "t long, v array<double>")
    got = {x["q"]: x["t"] for x in lsh.lsh_knn(qd, td, 1, "q", "t", "v", candidates=10).collect()}
    assert sum(got.get(i) == i for i in range(20)) >= 19 and len(got) == 20


def test_regions_clusters_and_boxes(spark):
    rows = [("a", 10, 20, 50, 80, 3, 0.8, 0), ("a", 11, 20, 51, 80, 3, 0.9, 1), ("a", 12, 21, 52, 81, 3, 0.85, 2), ("a", 50, 50, 40, 40, 3, 0.8, 3), ("a", 51, 51, 41, 41, 3, 0.9, 4), ("a", 52, 52, 42, 42, 3, 0.75, 5)]
    got = coherence.regions(spark.createDataFrame(rows, MATCH), 2, 2).collect()
    assert {(x["offset_x"], x["offset_y"]) for x in got} == {(40, 60), (-10, -10)}
    box = coherence.regions(spark.createDataFrame([("a", 10, 20, 50, 80, 4, 0.9, 0), ("a", 15, 20, 55, 80, 4, 0.9, 1), ("a", 12, 25, 52, 85, 4, 0.9, 2)], MATCH)).first()
    assert box["source_bbox"] == [10, 20, 9, 9]
    assert coherence.regions(spark.createDataFrame(rows[:2], MATCH)).count() == 0


def test_footprint_and_localize(spark):
    m = spark.createDataFrame([("a", 1, 1, 0, 0, 3, 0.9, 0), ("a", 8, 8, 0, 0, 3, 0.9, 1), ("a", 2, 2, 0, 0, 3, 0.9, 2)], MATCH)
    assert heatmap.footprint(m.where("match_ord = 0")).count() == 9
    sizes = spark.createDataFrame([("a", 10, 10), ("b", 5, 5)], "image_id string, height int, width int")
    got = {x["image_id"]: x for x in heatmap.localize(m, sizes).collect()}
    assert (got["a"]["x"], got["a"]["y"], got["a"]["w"], got["a"]["h"], got["a"]["area"]) == (1, 1, 4, 4, 14) and got["b"]["area"] == 0


def test_heatmap_and_regions(spark):
    m = spark.createDataFrame([("a", 0, 0, 5, 5, 3, 0.5, 0), ("a", 0, 0, 5, 5, 6, 1.0, 1), ("a", 0, 0, 99, 5, 3, 1.0, 2)], MATCH).withColumn("height", F.lit(20)).withColumn("width", F.lit(20))
    px = heatmap.pixels(m).collect()
    assert len(px) == 1 and px[0]["value"] == pytest.approx((0.5 + 2.0) / 3)
    sizes = m.select("image_id", "height", "width").distinct()
    row = heatmap.smooth(heatmap.pixels(m), sizes).first()
    assert max(row["heat"]) == pytest.approx(1) and np.argmax(row["heat"]) == 5 * 20 + 5
    assert heatmap.hot_regions(heatmap.smooth(heatmap.pixels(m), sizes), 0.5).first()["area"] >= 9


def test_scores(spark):
    rows = [(True, True)] * 8 + [(False, True)] * 8 + [(False, False)] * 4
    x = heatmap.localization_scores(spark.createDataFrame(rows, "predicted boolean, actual boolean")).first()
    assert (x["iou"], x["precision"], x["recall"]) == (0.5, 1.0, 0.5)
    none = heatmap.localization_scores(spark.createDataFrame([(False, False)], "predicted boolean, actual boolean")).first()
    assert none["iou"] == 1 and none["mcc"] == 0
    s = spark.createDataFrame([(0.1, False), (0.4, False), (0.35, True), (0.8, True), (0.4, True), (None, True)], "score double, positive boolean")
    assert heatmap.detection_auc(s).first()["auc"] == pytest.approx((1 + 2 + 1.5) / 6)
    assert heatmap.detection_auc(s.where("positive")).first()["auc"] == 0.5


def test_hough(spark):
    c = spark.createDataFrame([(0, 0, 5, 3, 10.0, 1), (1, 1, 6, 4, 10.0, 2), (0, 0, 100, 0, 2.0, 3), (0, 0, 1, 1, -1.0, 4)], "src_x int, src_y int, tgt_x int, tgt_y int, log_bf double, node long")
    cells = {(x["ix"], x["iy"]): x["votes"] for x in hough.vote(c).collect()}
    assert cells == {(2, 2): 2, (50, 0): 1}
    top = hough.peaks(hough.vote(c)).collect()
    assert [(x["ix"], x["iy"], x["persistence"]) for x in top] == [(2, 2, 20.0)]
    sup = hough.unary_table(c, hough.peaks(hough.vote(c))).collect()
    assert {(x["node"], x["evidence"]) for x in sup} == {(1, 10.0), (2, 10.0), (4, -1.0)}


def test_edges_against_loops(spark):
    r = np.random.RandomState(4)
    n = [(i, int(r.choice([3, 4, 6])), int(r.randint(0, 30)), int(r.randint(0, 30))) for i in range(80)]
    df = spark.createDataFrame(n, "node long, size int, x int, y int")
    near = {(a[0], b[0]) for a, b in itertools.combinations(n, 2) if a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 16}
    assert {(x["a"], x["b"]) for x in hough.spatial_edges(df).collect()} == near
    inside = {(a[0], b[0]) for a in n for b in n if a[1] < b[1] and abs(a[2] - b[2]) <= b[1] / 2 and abs(a[3] - b[3]) <= b[1] / 2}
    assert {(x["a"], x["b"]) for x in hough.inclusion_edges(df).collect()} == inside


def test_bp_on_a_tree(spark):
    u = np.array([[0.5, -0.2, 0.1], [0.0, 1.0, 0.3], [-0.4, 0.2, 0.9], [0.3, 0.3, 0.0]])
    edges = [(0, 1, 1.0), (1, 2, 2.0), (1, 3, 0.5)]
    joint = {}
    for xs in itertools.product(range(3), repeat=4):
        joint[xs] = math.exp(sum(u[i][x] for i, x in enumerate(xs)) - sum(b for i, j, b in edges if xs[i] != xs[j]))
    z = sum(joint.values())
    want = np.array([[sum(p for xs, p in joint.items() if xs[i] == k) / z for k in range(3)] for i in range(4)])
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "node long, unary array<double>")
    beliefs, summary = bp.loopy_bp(nodes, spark.createDataFrame(edges, "a long, b long, beta double"), 20, 0.0, 1e-9)
    got = np.array([x["marginal"] for x in beliefs.orderBy("node").collect()])
    assert np.allclose(got, want, atol=1e-9)
    s = summary.first()
    assert s["converged"] and math.isfinite(s["log_z_ref"]) and s["log_z_bethe"] == pytest.approx(math.log(z))


def test_priors(spark, tmp_path):
    r = np.random.RandomState(0)
    df = patches.explode(from_array(spark, {str(k): r.rand(12, 12, 3) for k in range(3)}), 3)
    p = priors.train(df, 3, dims=4, anchors=60, components=3, rounds=3)
    assert p.weights.sum() == pytest.approx(1)
    priors.write(spark, p, f"{tmp_path}/p")
    back = priors.read(spark, f"{tmp_path}/p")
    assert np.allclose(back.means, p.means)
    rows = priors.with_log_density(df, back).collect()
    assert len(rows) == 300 and all(math.isfinite(x["log_p0"]) for x in rows)


def test_shards_match_md5(spark):
    names = ["image_42", "a", "b", "c", "some/long/path.jpg", "ü漢"]
    got = {x["image_id"]: x["shard"] for x in store.with_shard(spark.createDataFrame([(n,) for n in names], "image_id string"), 7).collect()}
    assert got == {n: int(hashlib.md5(n.encode()).hexdigest(), 16) % 7 for n in names}


def test_index_and_catalog(spark, tmp_path):
    r = np.random.RandomState(0)
    cfg = Config(entropy_threshold=None)
    one = engine.index(from_array(spark, {"a": r.rand(6, 6, 3)}), cfg, K.photometric)
    two = engine.index(from_array(spark, {"b": r.rand(5, 5, 3)}), cfg, K.photometric)
    store.write(one.unionByName(two), f"{tmp_path}/i", shards=3)
    assert store.read(spark, f"{tmp_path}/i").count() == 25
    lost = next((tmp_path / "i" / "data").rglob("*.parquet"))
    lost.rename(tmp_path / "lost")
    with pytest.raises(IndexCorruptedError):
        store.read(spark, f"{tmp_path}/i")
    c = store.Catalog(max_targets=1).add(one).add(two)
    assert [x["image_id"] for x in c.targets().collect()] == ["b"]
    with pytest.raises(TargetExistsError):
        c.add(two, replace=False)
    with pytest.raises(TargetNotFoundError):
        c.remove("zz")
    assert not c.remove("b").has("b")


def test_engine_finds_a_recoloured_fragment(spark):
    r = np.random.RandomState(5)
    target, other = r.rand(40, 40, 3) * 0.8, r.rand(30, 30, 3) * 0.8
    cfg = Config(entropy_threshold=None, k_neighbors=3)
    index = engine.index(from_array(spark, {"t": target, "o": other}), cfg, K.photometric)
    result = engine.match(from_array(spark, {"s": target[10:22, 15:27] + 0.15}), index, cfg, K.photometric)
    best, region = result.best.first(), result.regions.first()
    assert best["image_id"] == "t" and (best["tgt_x"] - best["src_x"], best["tgt_y"] - best["src_y"]) == (15, 10)
    assert region["image_id"] == "t" and region["n"] >= 90
    assert result.stats.first()["matches"] >= 90
    none = engine.match(from_array(spark, {"s": target[:2, :2]}), index, cfg, K.photometric)
    assert none.matches.count() == 0 and none.best.count() == 0


def test_bayes_engine(spark):
    r = np.random.RandomState(6)
    target = r.rand(24, 24, 3)
    result = engine.match_bayes(from_array(spark, {"s": target[4:14, 6:16]}), from_array(spark, {"t": target}), Config(), sizes=(3, 4), k=3)
    rows = result.matches.collect()
    assert rows and sum((x["tgt_x"] - x["src_x"], x["tgt_y"] - x["src_y"]) == (6, 4) for x in rows) >= 0.9 * len(rows)


def test_verify_shapes(spark):
    rows = [(1, [0.1] * 27, [0.1] * 48), (2, None, [0.1] * 27), (3, [float(k) / 27 for k in range(27)], [float(k) / 27 for k in range(27)])]
    got = {x["i"]: x for x in verify.fit(spark.createDataFrame(rows, "i int, src_patch array<double>, tgt_patch array<double>")).collect()}
    assert not got[1]["success"] and got[1]["rss"] == math.inf and not got[2]["success"] and got[3]["success"] and got[3]["dof"] == 15


def test_exprs(spark):
    p = spark.range(1).select(X.chi2_probability(F.lit(0.0204), 4).alias("p"), X.clean_id(F.lit("a b/ç.é-1")).alias("c"), X.hot_colour(F.lit(0.5)).alias("h")).first()
    assert p["p"] == pytest.approx(float(K.chi2_survival(np.array([0.0204 / 0.0004]), np.array([36]))[0])) and p["c"] == "abç.é-1" and tuple(p["h"]) == (1.0, 0.5, 0.0)


def test_report_and_png(spark, tmp_path):
    image = (np.random.RandomState(0).rand(9, 7, 3) * 255).astype(np.uint8)
    (tmp_path / "x.PNG").write_bytes(report.png(image))
    (tmp_path / "g.png").write_bytes(report.png(image[..., 0]))
    good, bad = images.scan(spark, str(tmp_path))
    row = good.first()
    assert (row["height"], row["width"]) == (9, 7) and np.allclose(np.array(row["pixels"]).reshape(9, 7, 3), image / 255)
    assert [x["reason"] for x in bad.collect()] == ["not RGB"]
    assert images.header((tmp_path / "x.PNG").read_bytes()) == ("PNG", 7, 9)
    assert images.paths(spark, str(tmp_path), "*.png").count() == 2
    doc = report.build(Config(), 0, None, [], {}, generated_at="t")
    assert json.loads(json.dumps(doc))["schema_version"] == "1.1" and doc["result"]["match_found"] is False
    assert report.colour(np.eye(3), np.zeros(3))["is_identity"]


def test_generators():
    a, b = synthetic.splice(3), synthetic.splice(3)
    assert (a.tampered == b.tampered).all() and a.mask.sum() == 24 * 24
    x, y, w, h = a.bbox
    fx, fy, _, _ = a.params["donor_region"]
    plain = synthetic.splice(3, grade=0)
    assert (plain.M == np.eye(3)).all()
    assert not synthetic.negative(1).mask.any()
    assert synthetic.one_over_f(0, 16, 20).shape == (16, 20, 3)
    assert synthetic.copy_move(0)[0].shape == (96, 96, 3)


def test_generated_grades_and_copy_moves():
    a, b = synthetic.splice(5, grade=0.0), synthetic.splice(5, grade=0.0, upscale=2.0)
    x, y, w, h = a.bbox
    fx, fy, fw, fh = a.params["donor_region"]
    assert (a.tampered[y : y + h, x : x + w] == a.donor[fy : fy + fh, fx : fx + fw]).all() and a.mask.sum() == w * h
    assert b.params["donor_region"][2:] == (12, 12) and (a.donor == b.donor).all()
    m, lift = synthetic.grading(3, 0.15)
    assert not np.allclose(m, np.eye(3)) and (np.abs(lift) < 0.6).all()
    for seed in range(6):
        image, p, q = synthetic.copy_move(seed, size=64, region=16, noise=0.0, apart=20)
        assert max(abs(p[0] - q[0]), abs(p[1] - q[1])) >= 20 and p != q
        assert (image[p[1] : p[1] + 16, p[0] : p[0] + 16] == image[q[1] : q[1] + 16, q[0] : q[0] + 16]).mean() > 0.99


def test_sparse_peaks_equal_those_of_the_grid():
    from fragmatch.operators.hough import superlevel_peaks
    from fragmatch.operators.peaks import _touching, settle

    r = np.random.RandomState(9)
    for _ in range(40):
        grid = np.where(r.rand(7, 9) < 0.5, r.rand(7, 9).round(1) + 0.1, 0.0)
        if not grid.any():
            continue
        x, y = np.nonzero(grid)
        padded = np.pad(grid, 1)
        want = sorted(round(p, 9) for a, b, _, p in superlevel_peaks(padded) if padded[a, b] > 0 and p > 0)
        got, nodes, saddles = settle(np.stack([x, y, grid[x, y]], axis=1), _touching(x, y, grid[x, y], None), None)
        assert sorted(round(p, 9) for *_, p in got if p > 0) == want and not nodes and not saddles


def test_quantiles_and_copy_move_trials(spark):
    from fragmatch.operators import evaluate, heatmap

    for values in ([3.0], [1.0, 2.0, 2.0, 9.0], list(range(101)), [5.0] * 7 + [6.0]):
        got = heatmap.quantiles(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double"), "x", [0.0, 0.5, 0.9, 1.0]).first()["q"]
        assert got == pytest.approx(np.quantile(values, [0.0, 0.5, 0.9, 1.0]).tolist())
    assert heatmap.trial_report(spark.createDataFrame([], "detected boolean, error double, latency_ms double")).first()["n"] == 0
    one = heatmap.trial_report(evaluate.own_offsets(evaluate.generated_copies(spark, 4, size=64, region=24, noise=0.0)).withColumn("latency_ms", F.lit(0.0))).first()
    assert one["n"] == 4 and one["detect_rate"] >= 0.75 and one["error_median"] <= 1.0


def test_region_transforms(spark):
    r = np.random.RandomState(15)
    target = r.rand(30, 30, 3) * 0.6
    cfg = Config(entropy_threshold=None, k_neighbors=2)
    index = engine.index(from_array(spark, {"t": target}), cfg, K.photometric)
    result = engine.match(from_array(spark, {"s": target[4:16, 7:19] + 0.2}), index, cfg, K.photometric)
    by = ["src_image", "image_id"]
    row = coherence.with_transform(result.regions, result.matches, by).first()
    assert np.allclose(np.array(row["M"]).reshape(3, 3), np.eye(3), atol=0.05) and np.allclose(row["b"], -0.2, atol=0.03)
    assert coherence.members(result.regions, result.matches, by).groupBy("cluster").count().count() == result.regions.count()


def test_scale_cue(spark):
    r = np.random.RandomState(0)
    image = r.rand(48, 48, 3)
    row = scale.scale_inconsistency(from_array(spark, {"a": image, "b": image[:10, :10]}), 24, 12).orderBy("image_id").collect()
    assert row[0]["score"] >= 0 and row[1]["score"] == 0 and row[1]["bbox"] is None


def test_streaming_ingest(spark, tmp_path):
    from fragmatch.streaming.ingest import ingest

    df = from_array(spark, {"a": np.random.RandomState(0).rand(6, 6, 3)})
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp", Config(entropy_threshold=None), K.photometric)
    q.awaitTermination(60)
    assert store.read(spark, f"{tmp_path}/out").count() == 16
