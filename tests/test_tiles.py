"""Tiles against whole images: patches, pyramid levels, scale windows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmatch.functions import kernels as K
from fragmatch.operators import patches, scale, tiles
from fragmatch.sources.rasters import from_array, text_rasters


@pytest.fixture(scope="module")
def images(spark):
    r = np.random.RandomState(0)
    eight = lambda h, w: r.randint(0, 256, (h, w, 3)) / 255.0
    return from_array(spark, {"long": eight(150, 37), "wide": eight(20, 131), "float": r.rand(70, 66, 3), "one": eight(30, 30), "small": eight(3, 9), "line": eight(1, 70)})


def rows(df, *cols):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("size,stride,side", [(3, 1, 32), (4, 4, 32), (5, 3, 31), (4, 7, 16), (16, 5, 10)])
def test_patches_equal_those_of_the_whole_image(images, size, stride, side):
    cut = tiles.cut(images, side)
    got = tiles.explode(cut, size, stride, 1.5, K.difference, side)
    want = patches.explode(images, size, stride, 1.5, K.difference)
    cols = ("image_id", "patch_idx", "x", "y", "patch", "entropy", "descriptor")
    assert rows(got, *cols) == rows(want, *cols)


def test_tiles_need_not_be_those_of_the_output(images):
    got = tiles.explode(tiles.cut(images, 17), 4, 2, side=40)
    assert rows(got, "image_id", "patch_idx", "patch") == rows(patches.explode(images, 4, 2), "image_id", "patch_idx", "patch")


def test_eight_bits_travel_as_bytes_and_floats_as_floats(images):
    per_pixel = {r["image_id"]: r["b"] for r in tiles.cut(images, 32).groupBy("image_id").agg((F.sum(F.length("pixels")) / F.sum(F.col("h") * F.col("w"))).alias("b")).collect()}
    assert per_pixel["long"] == 3 and per_pixel["float"] == 24


def put_together(df):
    out = {}
    for r in df.collect():
        image = out.setdefault((r["image_id"], r["level"], r["scale"]), np.full((r["height"], r["width"], 3), np.nan))
        image[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = tiles.from_bytes(r["pixels"], r["h"], r["w"])
    return out


@pytest.mark.parametrize("scales", [[1.0, 0.5, 0.25], [1.0, 0.73, 1.6]])
def test_pyramid_levels_equal_those_of_the_whole_image(images, scales):
    got = put_together(tiles.pyramid(tiles.cut(images, 32), scales, 8, 24))
    want = {(r["image_id"], r["level"], r["scale"]): np.array(r["pixels"]).reshape(r["height"], r["width"], 3) for r in patches.pyramid(images, scales, 8).collect()}
    assert got.keys() == want.keys() and len(got) > 6
    assert all((got[k] == want[k]).all() for k in want)


def test_pyramid_patches_equal_those_of_the_whole_image(images):
    cols = ("image_id", "level", "scale", "patch_idx", "orig_x", "orig_y", "patch")
    got = tiles.pyramid_patches(tiles.cut(images, 20), 4, [1.0, 0.5], 3, 8, 1.0, 20)
    assert rows(got, *cols) == rows(patches.pyramid_patches(images, 4, [1.0, 0.5], 3, 8, 1.0), *cols)


@pytest.mark.parametrize("window,stride,side", [(16, 8, 32), (24, 7, 20), (64, 32, 50)])
def test_scale_windows_equal_those_of_the_whole_image(images, window, stride, side):
    got = tiles.scale_map(tiles.cut(images, side), window, stride, side)
    assert rows(got, "image_id", "y", "x", "fraction") == rows(scale.scale_map(images, window, stride), "image_id", "y", "x", "fraction")
    cols = ("image_id", "score", "min_fraction", "median_fraction", "bbox")
    ids = images.select("image_id")
    assert rows(scale.inconsistency(got, ids, window), *cols[:4]) == rows(scale.scale_inconsistency(images, window, stride), *cols[:4])


def test_texts_as_tiles(spark):
    r = np.random.RandomState(1)
    texts = [(k, "".join(r.choice(list("abc é漢\n"), n))) for k, n in enumerate((0, 1, 47, 48, 49, 5000))] + [(6, None)]
    df = spark.createDataFrame(texts, "i long, t string")
    got = tiles.explode(tiles.text_tiles(df, "i", "t", side=32), 4, 2, side=32)
    assert rows(got, "image_id", "patch_idx", "patch") == rows(patches.explode(text_rasters(df, "i", "t"), 4, 2), "image_id", "patch_idx", "patch")
    narrow = tiles.text_tiles(df, "i", "t", side=10)
    assert rows(tiles.explode(narrow, 4, 2, side=10), "image_id", "patch_idx", "patch") == rows(got, "image_id", "patch_idx", "patch")


def test_parts_of_a_pass_equal_the_whole():
    r = np.random.RandomState(2)
    image = r.randint(0, 256, (40, 57, 3)).astype(float)
    for size, kernel in itertools.product((20, 33, 57, 90), ("lanczos", "cubic")):
        whole = K.resample(image, 1, 57, size, kernel, 0, size, 0)
        for lo in range(0, size, 7):
            hi = min(size, lo + 7)
            a, b = (0, 57) if size == 57 else K.resample_reach(57, size, kernel, lo, hi)
            assert (K.resample(image[:, a:b], 1, 57, size, kernel, lo, hi, a) == whole[:, lo:hi]).all()


def test_empty(spark, images):
    none = tiles.cut(images.where("false"))
    assert tiles.explode(none, 3).count() == tiles.pyramid(none, [1.0, 0.5]).count() == tiles.scale_map(none).count() == 0
