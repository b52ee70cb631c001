"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors whose cosine is at least t lie within epsilon = sqrt(2 - 2 t) of
each other, and so do their projections. Vectors are sorted by label and by
the grid cells, epsilon wide, of their leading principal components (fitted on
a bounded sample; any rotation keeps the result exact). The sequence is cut
into intervals; intervals meet only where their first two cells are the same or
next to each other and their boxes are not provably farther apart, and a pair
of intervals is joined by recursive halving with the same test.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.llm.vectors import common_size, matrix, packed, usable
from fragmatch.operators.components import components
from fragmatch.plans.scratch import drop, save

THRESHOLD = 0.98
DIMS = 6
INTERVAL = 1024
LEAF = 128
#: Principal axes come from so many vectors, drawn by a hash of the id.
FIT_ROWS = 4096


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _axes(sample: np.ndarray, dims: int) -> np.ndarray:
    unit = _units(sample)
    _, _, v = np.linalg.svd(unit - unit.mean(axis=0), full_matrices=True)
    return v[:dims].T


class _Sets:
    """Union-find over positions, smallest position first."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` with that of ``b``: products and squares added up in order, in double precision."""
    last = lambda x: np.cumsum(x, axis=1)[:, -1]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        plain = last(a * b) / np.sqrt(last(a * a) * last(b * b))
    odd = np.flatnonzero(~np.isfinite(plain) | (last(a * a) < 1e-140) | (last(b * b) < 1e-140))
    if len(odd):  # squares out of range: by the largest component first
        x, y = a[odd] / np.abs(a[odd]).max(axis=1, keepdims=True), b[odd] / np.abs(b[odd]).max(axis=1, keepdims=True)
        plain[odd] = last(x * y) / np.sqrt(last(x * x) * last(y * y))
    return plain


def _join(raw, unit, place, weight, lo, hi, lo2, hi2, eps, least, links, sets) -> None:
    """Links between rows lo..hi and lo2..hi2 (the same range or apart), by halving.

    Unit vectors find candidates; their cosine is that of the original ones.
    """
    same = lo == lo2 and hi == hi2
    if not same:
        a, b = place[lo:hi], place[lo2:hi2]
        gap = np.maximum(0, np.maximum(b.min(axis=0) - a.max(axis=0), a.min(axis=0) - b.max(axis=0)))
        if (gap * gap).sum() > eps * eps:
            return
    if hi - lo <= LEAF and hi2 - lo2 <= LEAF:
        near = unit[lo:hi] @ unit[lo2:hi2].T >= least - 1e-9  # rounding is far smaller
        if same:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        if len(i):
            fine = cosines(raw[lo + i], raw[lo2 + j]) >= least
            i, j = i[fine], j[fine]
            np.add.at(links, lo + i, weight[lo2 + j])
            if not same:
                np.add.at(links, lo2 + j, weight[lo + i])
            for x, y in zip((lo + i).tolist(), (lo2 + j).tolist()):
                if x < y or not same:
                    sets.join(x, y)
        return
    mid, mid2 = (lo + hi) // 2, (lo2 + hi2) // 2
    args = (eps, least, links, sets)
    if same:
        _join(raw, unit, place, weight, lo, mid, lo, mid, *args)
        _join(raw, unit, place, weight, mid, hi, mid, hi, *args)
        _join(raw, unit, place, weight, lo, mid, mid, hi, *args)
    elif hi - lo >= hi2 - lo2:
        _join(raw, unit, place, weight, lo, mid, lo2, hi2, *args)
        _join(raw, unit, place, weight, mid, hi, lo2, hi2, *args)
    else:
        _join(raw, unit, place, weight, lo, hi, lo2, mid2, *args)
        _join(raw, unit, place, weight, lo, hi, mid2, hi2, *args)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", least: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) per row.

    Rows link if their labels are equal and not null, their vectors have equally
    many components and the cosine is at least ``least`` (below it by any
    rounding is below it). Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with null labels or ids, link with nothing;
    a null id has a null component and is kept. Every row is a vector of its
    own: repeated rows link with each other, and rows that share an id but not
    the vector are two. Equal vectors are folded and compared once.
    """
    spark = rows.sparkSession
    vector, name = F.col(vec).cast("array<double>"), F.col(label)
    fine = F.col(id_col).isNotNull() & name.isNotNull() & usable(vector)
    everything = rows.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.transform(vector, lambda x: x + F.lit(0.0))).alias("v"), name.alias("label"))
    good = everything.where("v is not null")
    folded = save(good.groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("weight")).withColumn("rep", F.monotonically_increasing_id()))
    # axes are fitted for the usual number of components; vectors of others are laid out by their first ones
    size = common_size(folded, "v")
    sample = folded.where(F.size("v") == size).orderBy(F.xxhash64("low", F.lit(5)), "low", "v").limit(FIT_ROWS).select("v").toPandas()["v"]
    if not len(sample):
        return everything.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dims = min(DIMS, size)
    held = spark.sparkContext.broadcast(_axes(np.array(sample.tolist(), np.float64), dims))
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-7
    cells = [f"c{k}" for k in range(dims)]

    def placed(batches):
        for batch in batches:
            sizes = batch["v"].value_lengths().to_numpy()
            for n in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == n)))
                v = matrix(part["v"])
                unit = _units(v)
                at = unit @ held.value if n == size else np.pad(unit[:, :dims], ((0, 0), (0, max(0, dims - n))))
                cell = np.floor(at / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["rep"], part["weight"], part["label"], pa.array(np.full(len(v), n, np.int32)), packed(v), packed(at), *[pa.array(cell[:, k]) for k in range(dims)]], names=["id", "weight", "label", "size", "vec", "place", *cells])

    label_type = rows.schema[label].dataType.simpleString()
    grid = folded.mapInArrow(placed, f"id long, weight long, label {label_type}, size int, vec binary, place binary, " + ", ".join(f"{c} int" for c in cells))

    def cut(batches):
        part, number, used, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            labels = list(zip(batch["label"].to_pylist(), batch["size"].to_pylist()))
            out = np.zeros(len(labels), np.int64)
            for k, x in enumerate(labels):
                if x != last or used == INTERVAL:
                    number, used, last = number + 1, 0, x
                used += 1
                out[k] = (part << 32) | number
            yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns], names=["interval", *batch.schema.names])

    ordered = grid.repartitionByRange("label", "size", *cells, "id").sortWithinPartitions("label", "size", *cells, "id")
    ordered = save(ordered.mapInArrow(cut, grid.schema.__class__([*spark.createDataFrame([], "interval long").schema, *grid.schema])))
    boxes = save(ordered.groupBy("interval", "label", "size").agg(*[f(c).alias(f"{n}_{c}") for c in cells for n, f in (("lo", F.min), ("hi", F.max))]))

    def keyed(df: DataFrame, side: str, reach: int) -> DataFrame:
        for c in cells[:2]:
            df = df.withColumn(f"k_{c}", F.explode(F.sequence(F.col(f"lo_{c}") - reach, F.col(f"hi_{c}") + reach)))
        return df.select("label", "size", *[f"k_{c}" for c in cells[:2]], *[F.col(x).alias(f"{side}_{x}") for x in ("interval", *[f"{n}_{c}" for c in cells for n in ("lo", "hi")])])

    met = keyed(boxes, "a", 0).join(keyed(boxes, "b", 1), ["label", "size", *[f"k_{c}" for c in cells[:2]]])
    near = F.lit(True)
    for c in cells:
        near = near & (F.col(f"a_lo_{c}") <= F.col(f"b_hi_{c}") + 1) & (F.col(f"b_lo_{c}") <= F.col(f"a_hi_{c}") + 1)
    pairs = save(met.where(near & (F.col("a_interval") <= F.col("b_interval"))).select(F.col("a_interval").alias("a"), F.col("b_interval").alias("b")).distinct())
    sides = pairs.select("a", "b", F.col("a").alias("interval")).unionAll(pairs.where("a <> b").select("a", "b", F.col("b").alias("interval")))
    dealt = ordered.select("interval", "id", "weight", "vec", "place").join(sides, "interval")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf["a"].iloc[0], pdf["b"].iloc[0]
        at = np.frombuffer(b"".join(pdf["place"]), np.float64).reshape(len(pdf), -1)
        cell = np.floor(at / eps)
        order = np.lexsort((pdf["id"].to_numpy(), *cell.T[::-1], pdf["interval"].to_numpy() == second))
        pdf, at = pdf.iloc[order], at[order]
        raw = np.frombuffer(b"".join(pdf["vec"]), np.float64).reshape(len(pdf), -1)
        unit = _units(raw)
        ids, weight = pdf["id"].to_numpy(), pdf["weight"].to_numpy()
        links, sets = np.zeros(len(ids), np.int64), _Sets(len(ids))
        n = int((pdf["interval"] == first).sum())
        span = (0, n, 0, n) if first == second else (0, n, n, len(ids))
        _join(raw, unit, at, weight, *span, eps, least, links, sets)
        some = np.flatnonzero(links)
        root = np.array([sets.find(k) for k in some.tolist()], int)
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[root] if len(some) else ids[:0]})

    found = save(dealt.groupBy("a", "b").applyInPandas(run, "id long, links long, root long"))
    drop(ordered, boxes, pairs)
    comp = components(found.select("id", "root"))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    # a component is named by its smallest id
    named = comp.join(folded.select(F.col("rep").alias("node"), "low"), "node").groupBy("component").agg(F.min("low").alias("name"))
    comp = comp.join(named, "component").select("node", "name")
    reps = folded.join(counted, folded["rep"] == counted["id"], "left").join(comp, folded["rep"] == comp["node"], "left")
    reps = reps.select(F.col("label").alias("of"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("name", "low").alias("component"))
    out = everything.join(reps, (F.col("label") == F.col("of")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


OP8_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), best AS (SELECT a, min(b) AS low FROM reach GROUP BY a
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, least(m.vec_id, coalesce(best.low, m.vec_id)) AS component_id, m.vec_id = least(m.vec_id, coalesce(best.low, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN n ON m.vec_id = n.a LEFT JOIN best ON m.vec_id = best.a
"""
