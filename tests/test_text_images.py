import time

import numpy as np
from pyspark.sql import functions as F

from fragmatch.functions import exprs as X
from fragmatch.functions import kernels as K
from fragmatch.operators import patches, tiles
from fragmatch.sources.rasters import text_images, text_rasters


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def texts(spark):
    r = np.random.RandomState(0)
    made = ["".join(chr(c) for c in r.randint(32, 900, n)) for n in (0, 5, 144, 145, 191, 192, 700, 2000)]
    return spark.createDataFrame([*enumerate(made), (90, None), (91, "ab" * 150_000)], "i long, t string")


def test_texts_as_images_equal_rasters(spark):
    df = texts(spark)
    for stride, threshold in ((1, 1.3), (2, None), (4, 1.3)):
        made = [patches.explode(f(df.where("i <> 91"), "i", "t"), 4, stride, threshold, K.difference) for f in (text_images, text_rasters)]
        assert rows(made[0]) == rows(made[1])
    made = [patches.pyramid_patches(f(df.where("i <> 91"), "i", "t"), 4, [1.0, 0.5], 4, 8) for f in (text_images, text_rasters)]
    assert made[0].columns == made[1].columns and rows(made[0]) == rows(made[1])


def test_one_pass_and_no_more_columns_than_asked_for(spark):
    def counted(p):
        return np.full((len(p), 1), float(len(p)))

    out = patches.explode(text_images(texts(spark), "i", "t"), 4, 1, None, counted, ("image_id", "patch_idx", "descriptor"))
    assert out.columns == ["image_id", "patch_idx", "descriptor"]
    got = out.agg(F.max(F.col("descriptor")[0]).alias("most"), F.count("*").alias("n"), F.count_distinct("image_id", "patch_idx").alias("distinct")).first()
    assert got["most"] <= patches.WINDOWS  # however long a text is, and however many share a batch
    assert got["n"] == got["distinct"] == sum(13 * (-(-n // 48) - 3) for n in (145, 191, 192, 700, 2000, 300_000))
    few = patches.explode(text_images(texts(spark).where("i < 8").repartition(1), "i", "t"), 4, 4, None, counted)
    assert few.agg(F.count_distinct(F.col("descriptor")[0])).first()[0] == 1  # short texts are described together


def test_energy_takes_the_mean_once(spark):
    v = np.random.RandomState(1).rand(20_000)
    df = spark.createDataFrame([(v.tolist(),)], "p array<double>")
    start = time.time()
    got = df.select(X.patch_energy(F.col("p"))).first()[0]
    assert abs(got - v.var()) < 1e-9 and time.time() - start < 10


def test_persistence_of_a_whole_batch(monkeypatch):
    r = np.random.RandomState(2)
    grid = np.linspace(0, 1, 8)
    for s, values in ((3, 3), (4, 256), (5, 4), (6, 9)):
        p = r.randint(0, values, (60, s, s, 3)) / 255.0
        want = []
        for image in K.gray(p):
            d = np.searchsorted(np.sort(image.ravel()), K.sublevel_diagram(image), side="right") / image.size
            want.append(sum((np.outer(np.exp(-((grid - (y - x)) ** 2) / 0.005) * (y - x), np.exp(-((grid - x) ** 2) / 0.005)) for x, y in d if y - x > 1e-8), np.zeros((8, 8))).ravel())
        with monkeypatch.context() as m:
            m.setattr(K, "elder_pairs", None)  # no loop over patches
            assert np.allclose(K.persistence_descriptor(p), K.unit(np.array(want)), atol=1e-12)


def test_levels_of_tiles_with_columns_asked_for(spark):
    df = texts(spark)
    made = tiles.pyramid_patches(tiles.text_tiles(df, "i", "t", side=64), 4, [1.0, 0.5], 4, 8, side=64, columns=("image_id", "level"))
    assert made.columns == ["image_id", "x", "y", "level", "scale", "orig_x", "orig_y"]
    assert rows(made) == rows(patches.pyramid_patches(text_images(df, "i", "t"), 4, [1.0, 0.5], 4, 8).select(made.columns))
