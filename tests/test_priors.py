"""Priors by image: exact medians, and results that no batch decides."""

import numpy as np
import pytest

from fragmatch.functions import kernels as K
from fragmatch.operators import medians, patches, priors
from fragmatch.plans import engine
from fragmatch.sources.rasters import from_array


def test_medians_with_one_large_group_ties_and_nulls(spark):
    r = np.random.RandomState(0)
    groups = {"hot": r.rand(3001).round(2), "even": r.rand(40), "one": [5.0], "same": [2.0] * 9, "two": [1.0, 4.0], "minus": -r.rand(7)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), (None, 3.0), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {x["g"]: x["median"] for x in medians.grouped(df, "g", "v").collect()}
    assert got == pytest.approx({g: float(np.median(v)) for g, v in groups.items()})
    assert medians.grouped(df.where("false"), "g", "v").count() == 0


@pytest.fixture(scope="module")
def images(spark):
    r = np.random.RandomState(1)
    return {"a": r.rand(20, 17, 3), "b": r.rand(9, 9, 3) * 0.4, "c": np.full((6, 6, 3), 0.5), "d": r.rand(4, 4, 3)}


@pytest.fixture(scope="module")
def prior(spark, images):
    rows = patches.explode(from_array(spark, images), 3)
    return priors.train(rows, 3, dims=4, anchors=80, components=3, rounds=4)


def test_equal_to_whole_images_and_for_any_batch(spark, images, prior):
    rows = patches.explode(from_array(spark, images), 3)
    told = []
    for limit in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
        try:
            density = {(x["image_id"], x["patch_idx"]): x["log_p0"] for x in priors.with_log_density(rows, prior).collect()}
            vectors = {(x["image_id"], x["patch_idx"]): x["descriptor"] for x in priors.BayesKernel(prior).frame(rows).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        told.append((density, vectors))
    assert told[0] == told[1]
    for name, image in images.items():
        whole = K.windows(image, 3)[0]
        want = prior.log_density(whole)
        got = [told[0][0][name, k] for k in range(len(whole))]
        assert np.allclose(got, want, atol=1e-9)
        assert np.allclose([told[0][1][name, k] for k in range(len(whole))], K.bayesian(whole, prior.embed), atol=1e-9)


def test_nearest_anchors_against_all(prior):
    r = np.random.RandomState(2)
    f = K.photometric(r.rand(50, 3, 3, 3))
    d = np.sqrt(((f[:, None] - prior.anchors[None]) ** 2).sum(2))
    got, at = prior.near(f)
    assert np.allclose(got, np.sort(d, axis=1)[:, :25]) and np.allclose(np.take_along_axis(d, at, 1), got)


def test_bayes_engine_with_a_prior(spark, images, prior):
    from fragmatch.config import Config

    r = np.random.RandomState(3)
    target = r.rand(30, 30, 3)
    result = engine.match_bayes(from_array(spark, {"s": target[4:16, 6:18]}), from_array(spark, {"t": target, "u": r.rand(20, 20, 3)}), Config(), {3: prior}, sizes=(3,), k=2, distance=0.3)
    got = [(m["image_id"], m["tgt_x"] - m["src_x"], m["tgt_y"] - m["src_y"]) for m in result.matches.collect()]
    assert len(got) > 50 and np.mean([g == ("t", 6, 4) for g in got]) > 0.9
