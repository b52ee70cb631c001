"""What queries leave on disk beside their results."""

import weakref

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fragmatch import queries
from fragmatch.operators import metric, patches
from fragmatch.operators.patches import lists
from fragmatch.plans import engine
from fragmatch.plans.scratch import save
from fragmatch.sources import index as store
from fragmatch.streaming import ingest


def test_targets_of_a_match_are_not_saved(spark, monkeypatch):
    saved = []
    for module in (engine, queries):
        monkeypatch.setattr(module, "save", lambda df: saved.append(set(df.columns)) or save(df))
    assert queries.match_chi2(spark, "/root/testdata/sf0.001").columns[:2] == ["src_image", "image_id"]
    assert saved and not any({"t", "descriptor"} <= names for names in saved)


def test_index_files_have_small_row_groups_of_zstd(spark, tmp_path):
    rows = spark.range(40000).selectExpr("cast(id % 50 as string) as image_id", "transform(sequence(1, 48), k -> xxhash64(id, k) / 9e18D) as descriptor").coalesce(1)
    store.write(rows, f"{tmp_path}/i", shards=2)
    files = list((tmp_path / "i" / "data").rglob("*.parquet"))
    assert store.read(spark, f"{tmp_path}/i").count() == 40000 and len(files) == 2
    meta = pq.ParquetFile(min(files, key=lambda f: f.stat().st_size)).metadata
    assert meta.row_group(0).column(0).compression == "ZSTD"
    assert max(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)) < 2 * store.ROW_GROUP
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) in (None, "0")


def test_texts_of_a_stream_are_exchanged_only_where_ids_repeat(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    texts = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "image_id string, text string")
    assert "Exchange" not in plan(ingest.one_each(texts, ingest.repeated(texts)))
    more = texts.unionAll(texts.where("image_id = 'b' or image_id is null").withColumn("text", F.lit("w")))
    rows = ingest.one_each(more, ingest.repeated(more)).collect()
    assert sorted(str(r["image_id"]) for r in rows) == ["None", "a", "b"]


class _Frame:
    """Stands for a table of images; gives the function that its batches would go through."""

    columns, schema = ["image_id", "width", "text"], []

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_a_batch_of_texts_is_free_before_the_next_is_read():
    kept = []

    def batches():
        for _ in range(3):
            assert not any(ref() for ref in kept)
            batch = pa.RecordBatch.from_pydict({"image_id": ["a"], "width": pa.array([16], pa.int32()), "text": ["some words " * 40]})
            kept.append(weakref.ref(batch))
            yield batch
            del batch

    assert sum(b.num_rows for b in patches.explode(_Frame(), 4, 4)(batches())) > 0 and len(kept) == 3


def test_queries_that_meet_many_blocks_leave_in_small_batches(spark):
    r = np.random.RandomState(3)
    pivots = r.rand(200, 4)
    one = np.ones(200, np.int64)
    index = metric.MetricIndex(pivots, one, 0.0 * one, 9.0 * one, np.arange(200), spark.range(1))
    asked = pa.RecordBatch.from_arrays([pa.array(np.arange(500)), lists(r.rand(500, 4)), pa.array(np.full(500, np.inf))], names=["q", "v", "limit"])
    out = list(metric._visits(index, 2, False, True)([asked]))
    assert sum(b.num_rows for b in out) == 500 * 198 and max(b.num_rows for b in out) <= metric.SENT
