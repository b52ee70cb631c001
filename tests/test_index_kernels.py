"""Stored indexes whose descriptors are made as they are read."""

import numpy as np
import pytest

from fragmatch.config import Config
from fragmatch.functions import kernels as K
from fragmatch.plans import engine
from fragmatch.sources import index as store
from fragmatch.sources.rasters import from_array

CFG = Config(patch_size=4, entropy_threshold=None)
COLUMNS = ["image_id", "patch_idx", "x", "y", "patch", "t", "level", "orig_x", "descriptor"]


def rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_descriptors_are_not_written_and_read_back_bit_by_bit(spark, tmp_path):
    r = np.random.RandomState(2)
    images = from_array(spark, {k: r.randint(97, 123, (40, 16, 3)) / 255.0 for k in "abc"})
    for kernel in (K.difference, K.photometric):
        want, p = engine.index(images, CFG, kernel), tmp_path / kernel.__name__
        store.write(want, f"{p}/plain", 3)
        store.write(engine.cut(images, CFG), f"{p}/made", 3, kernel)
        assert rows(store.read(spark, f"{p}/made")) == rows(store.read(spark, f"{p}/plain")) == rows(want)
        assert size(p / "made" / "data") < size(p / "plain" / "data") / 3


def test_a_compaction_keeps_descriptors_of_either_kind(spark, tmp_path):
    r = np.random.RandomState(3)
    one, two = (from_array(spark, {k: r.rand(9, 6, 3)}) for k in "ab")
    p = f"{tmp_path}/i"
    store.write(engine.cut(one, CFG), p, 2, K.difference)
    assert store.history(spark, p)[0].kernel == "difference"
    store.add(engine.index(two, CFG, K.difference), p)
    want = rows(engine.index(one, CFG, K.difference)) + rows(engine.index(two, CFG, K.difference))
    assert rows(store.read(spark, p)) == want
    store.compact(spark, p)
    assert rows(store.read(spark, p)) == want
    store.write(engine.cut(one.unionAll(two), CFG), p, 2, K.difference)
    store.remove(spark, p, ["a"])
    store.compact(spark, p)
    assert rows(store.read(spark, p)) == rows(engine.index(two, CFG, K.difference)) and store.history(spark, p)[-1].kernel == "difference"
    with pytest.raises(ValueError):
        store.write(engine.cut(one, CFG), p, 2, lambda x: x)


def test_writers_that_overlap_leave_the_setting_as_it_was(spark):
    before = spark.conf.get(store._FILES, None)
    first, second = store._open_files(spark, 16), store._open_files(spark, 16)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(store._FILES) == "16"  # the second one still writes
    second.__exit__(None, None, None)
    assert spark.conf.get(store._FILES, None) == before
