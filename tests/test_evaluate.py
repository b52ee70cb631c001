import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fragmatch import queries
from fragmatch.operators import evaluate
from fragmatch.plans.scratch import save
from fragmatch.sources.rasters import RASTER, from_array

SF = "/root/testdata/sf0.001"


def _images(spark):
    r = np.random.RandomState(4)
    big = {f"i{k}": np.rint(r.rand(24 + k, 20, 3) * 255) / 255 for k in range(4)}
    return from_array(spark, big | {"small": r.rand(3, 20, 3)}).unionAll(spark.createDataFrame([("none", None, None, None)], RASTER))


def test_planted_squares(spark):
    pairs = spark.createDataFrame([("i0", "i1"), ("i1", "i2"), ("i2", "small"), ("small", "i3"), ("i3", "none"), ("i3", "gone"), (None, "i0")], "host_id string, donor_id string")
    trials = evaluate.plant(_images(spark), pairs)
    rows = {(x["host_id"], x["positive"]): x for x in trials.collect()}
    assert set(rows) == {("i0", True), ("i0", False), ("i1", True), ("i1", False)}
    for host in ("i0", "i1"):
        p, n = rows[host, True], rows[host, False]
        a, b = (np.array(x["pixels"]).reshape(x["height"], x["width"], 3) for x in (p, n))
        y, x = np.nonzero((a != b).any(axis=2))
        assert p["seed"] == n["seed"] and len(y) > 50
        assert p["x"] <= x.min() and x.max() < p["x"] + p["side"] and p["y"] <= y.min() and y.max() < p["y"] + p["side"]
    again = evaluate.plant(_images(spark).repartition(3), pairs.repartition(5))
    assert {(x["host_id"], x["positive"]): x["pixels"] for x in again.collect()} == {k: v["pixels"] for k, v in rows.items()}


def test_detection_counts_every_pixel(spark):
    pairs = spark.createDataFrame([("i0", "i1"), ("i1", "i2"), ("i2", "i3"), ("i3", "i0")], "host_id string, donor_id string")
    got = evaluate.detect(evaluate.plant(_images(spark), pairs, grade=0.1), 4, 1).collect()
    assert len(got) == 8
    for x in got:
        assert x["tp"] + x["fn"] == (64 if x["positive"] else 0)
        assert x["tp"] + x["fp"] + x["fn"] + x["tn"] in {20 * (24 + k) for k in range(4)}
        if x["positive"]:
            assert x["tp"] == 64 and x["fp"] == 0
        else:
            assert x["score"] == 0


def test_planted_copies(spark):
    trials = evaluate.plant_copies(_images(spark), noise=0.005)
    rows = {x["image_id"]: x for x in trials.collect()}
    assert set(rows) == {f"i{k}" for k in range(4)}
    assert all(max(abs(x["dx"]), abs(x["dy"])) >= 8 for x in rows.values())
    found = evaluate.own_offsets(trials, 4, 1).collect()
    assert len(found) == 4 and all(x["detected"] and x["error"] == 0 for x in found)
    plain = _images(spark).where("height > 8").select(F.monotonically_increasing_id().alias("seed"), "height", "width", "pixels", F.lit(9).alias("dx"), F.lit(0).alias("dy"))
    assert not any(x["detected"] for x in evaluate.own_offsets(plain, 4, 1).collect())


def test_without_trials(spark):
    none = spark.createDataFrame([], RASTER)
    pairs = spark.createDataFrame([], "host_id string, donor_id string")
    assert evaluate.summary(evaluate.detect(evaluate.plant(none, pairs))).first()["n"] == 0
    assert evaluate.own_offsets(evaluate.plant_copies(none)).count() == 0


def test_all_passages(spark):
    trials = queries._splice_trials(spark, SF)
    trials = save(trials)
    rows = evaluate.detect(trials, 4, 1).join(trials.select("seed", "positive", "side"), ["seed", "positive"]).toPandas()
    planted, iou = rows[rows["positive"]], rows["tp"] / (rows["tp"] + rows["fp"] + rows["fn"])
    # a square of one window can't have the three fits that must agree
    assert (planted["side"] == 4).any() and (planted.loc[planted["side"] == 4, "tp"] == 0).all()
    assert iou[rows["positive"] & (rows["side"] > 4)].mean() > 0.95
    assert (rows.loc[~rows["positive"], "score"] == 0).mean() > 0.95
    one = entry.queries()["splice_accuracy"](spark, SF).first()
    assert one["n"] == len(rows) and abs(one["iou"] - iou[rows["positive"]].mean()) < 1e-9
    copies = entry.queries()["copy_move_accuracy"](spark, SF).first()
    assert copies["detect_rate"] > 0.95 and copies["error_p90"] == 0
