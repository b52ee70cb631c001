"""The stored index: commits, snapshots, and writers that take turns."""

import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmatch.config import Config
from fragmatch.errors import IndexCorruptedError, TargetExistsError, TargetNotFoundError
from fragmatch.functions import kernels as K
from fragmatch.plans import engine
from fragmatch.sources import index as store
from fragmatch.sources.rasters import from_array
from fragmatch.streaming.ingest import ingest

CFG = Config(entropy_threshold=None)
ROW = "image_id string, patch_idx int, note string"


def rows(spark, **images):
    return spark.createDataFrame([(i, k, note) for i, (n, note) in images.items() for k in range(n)], ROW)


def state(df):
    return {r["image_id"]: (r["n"], r["note"]) for r in df.groupBy("image_id").agg(F.count("*").alias("n"), F.max("note").alias("note")).collect()}


def test_add_replace_remove_evict_and_compact(spark, tmp_path):
    p = f"{tmp_path}/i"
    with pytest.raises(IndexCorruptedError):
        store.read(spark, p)
    store.add(rows(spark, a=(2, "1"), b=(3, "1")), p, shards=2)
    store.add(rows(spark, a=(5, "2"), c=(1, "2")), p)
    assert state(store.read(spark, p)) == {"a": (5, "2"), "b": (3, "1"), "c": (1, "2")}
    with pytest.raises(TargetExistsError):
        store.add(rows(spark, b=(1, "x")), p, replace=False)
    with pytest.raises(TargetNotFoundError):
        store.remove(spark, p, ["b", "zz"])
    store.remove(spark, p, ["b"])
    store.add(rows(spark, b=(4, "3")), p)  # removed, and there again
    want = {"a": (5, "2"), "b": (4, "3"), "c": (1, "2")}
    assert state(store.read(spark, p)) == want and "shard" in store.read(spark, p).columns
    store.compact(spark, p)
    assert state(store.read(spark, p)) == want and len(store.in_force(store.history(spark, p))) == 1
    store.evict(spark, p, 2)  # order of commits outlives compaction
    assert state(store.read(spark, p)) == {"b": (4, "3"), "c": (1, "2")}
    assert state(store.read(spark, p, 1)) == {"a": (5, "2"), "b": (3, "1"), "c": (1, "2")}  # as it was
    store.write(rows(spark, z=(1, "9")), p)
    assert state(store.read(spark, p)) == {"z": (1, "9")}
    store.write(rows(spark, y=(1, "9")), p)
    assert {c.number for c in store.history(spark, p)} >= {max(c.number for c in store.history(spark, p)) - 1}
    assert len(list((tmp_path / "i" / "data").iterdir())) <= 3  # two states, and no more


def test_readers_see_whole_commits_only(spark, tmp_path):
    p = f"{tmp_path}/i"
    store.add(rows(spark, a=(2, "1")), p)
    before = store.read(spark, p)
    store._folder(rows(spark, b=(7, "x")), p, None)  # a writer that stopped before its entry
    (tmp_path / "i" / "log" / "_half").write_text('{"number": 5, "da')
    assert state(store.read(spark, p)) == {"a": (2, "1")}
    store.add(rows(spark, a=(9, "2")), p)
    store.compact(spark, p)
    assert state(before) == {"a": (2, "1")}  # started earlier, and ends as it started


def test_two_writers_get_two_numbers(spark, tmp_path):
    p = f"{tmp_path}/i"
    store.add(rows(spark, a=(1, "1")), p)
    threads = [threading.Thread(target=store.add, args=(rows(spark, **{f"w{k}": (k + 1, "w")}), p)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert state(store.read(spark, p)) == {"a": (1, "1")} | {f"w{k}": (k + 1, "w") for k in range(4)}
    assert [c.number for c in store.history(spark, p)] == [0, 1, 2, 3, 4]
    assert not store._put(spark, p, store.Commit(2))


def test_commits_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    p = f"{tmp_path}/i"
    store.add(rows(spark, a=(1, "1"), b=(1, "1")), p)
    store.add(rows(spark, c=(1, "2")), p)
    folder = store._folder

    def slow(df, path, shards):
        monkeypatch.setattr(store, "_folder", folder)
        out = folder(df, path, shards)
        store.add(rows(spark, a=(6, "3")), p)
        store.remove(spark, p, ["b"])
        return out

    monkeypatch.setattr(store, "_folder", slow)
    store.compact(spark, p)
    assert state(store.read(spark, p)) == {"a": (6, "3"), "c": (1, "2")}

    def overtaken(df, path, shards):
        monkeypatch.setattr(store, "_folder", folder)
        out = folder(df, path, shards)
        store.compact(spark, p)
        return out

    monkeypatch.setattr(store, "_folder", overtaken)
    with pytest.raises(IndexCorruptedError):
        store.compact(spark, p)
    assert state(store.read(spark, p)) == {"a": (6, "3"), "c": (1, "2")}


def test_lost_files_are_noticed(spark, tmp_path):
    p = f"{tmp_path}/i"
    store.add(rows(spark, a=(3, "1")).repartition(2), p)
    next((tmp_path / "i" / "data").rglob("part-*.parquet")).unlink()
    with pytest.raises(IndexCorruptedError):
        store.read(spark, p)


def image_files(spark, folder, images):
    from_array(spark, images).write.mode("append").parquet(folder)


def stream(spark, tmp_path, p):
    schema = from_array(spark, {"x": np.zeros((3, 3, 3))}).schema
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    ingest(source, p, f"{tmp_path}/checkpoint", CFG, K.difference).awaitTermination()


def counts(spark, p):
    return {r["image_id"]: r["n"] for r in store.read(spark, p).groupBy("image_id").agg(F.count("*").alias("n")).collect()}


def test_streams_and_batches_take_turns(spark, tmp_path):
    r, p = np.random.RandomState(0), f"{tmp_path}/i"
    image_files(spark, f"{tmp_path}/in", {"a": r.rand(5, 5, 3), "b": r.rand(4, 4, 3)})
    stream(spark, tmp_path, p)
    assert counts(spark, p) == {"a": 9, "b": 4}
    image_files(spark, f"{tmp_path}/in", {"a": r.rand(6, 5, 3)})  # the same image again
    stream(spark, tmp_path, p)
    assert counts(spark, p) == {"a": 12, "b": 4}
    store.write(engine.index(from_array(spark, {"c": r.rand(3, 3, 3)}), CFG, K.difference), p)  # a batch writer makes it anew
    assert counts(spark, p) == {"c": 1}
    image_files(spark, f"{tmp_path}/in", {"d": r.rand(3, 4, 3)})  # and the stream goes on
    stream(spark, tmp_path, p)
    assert counts(spark, p) == {"c": 1, "d": 2}
    store.add(engine.index(from_array(spark, {"d": r.rand(4, 4, 3)}), CFG, K.difference), p)
    store.compact(spark, p)
    assert counts(spark, p) == {"c": 1, "d": 4}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    p = f"{tmp_path}/i"
    for _ in range(2):
        store.add(rows(spark, a=(2, "1")), p, tag="s#0")
    assert state(store.read(spark, p)) == {"a": (2, "1")} and len(store.history(spark, p)) == 1
    assert json.loads(next((tmp_path / "i" / "log").glob("*.json")).read_text())["tag"] == "s#0"
