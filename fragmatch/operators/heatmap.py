"""Heatmaps, masks, and localisation of what matched."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmatch.functions import kernels as K
from fragmatch.operators.components import components
from fragmatch.plans.scratch import save

#: Images are worked on in tiles of so many pixels a side.
SIDE = 128
HEAT = "image_id string, height int, width int, y int, x int, h int, w int, heat array<double>"
WEIGHTS = {3: 1.0, 4: 1.2, 5: 1.5, 6: 2.0}


def pixels(matches: DataFrame, weights: dict[int, float] | None = None, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(by, y, x, value): the mean probability per target pixel, weighted by patch size (1 for unknown sizes).

    Where ``height`` and ``width`` are columns, coordinates outside are left out.
    """
    table = WEIGHTS if weights is None else weights
    weight = F.coalesce(F.create_map([x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("patch_size")], F.lit(1.0)) if table else F.lit(1.0)
    rows = matches.withColumn("_w", weight)
    if {"height", "width"} <= set(matches.columns):
        rows = rows.where("tgt_x >= 0 and tgt_y >= 0 and tgt_x < width and tgt_y < height")
    return rows.groupBy(*by, F.col("tgt_y").alias("y"), F.col("tgt_x").alias("x")).agg((F.sum(F.col("probability") * F.col("_w")) / F.sum("_w")).alias("value"))


def inside(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixels within their image's ``height`` and ``width``."""
    return values.join(sizes.select("image_id", "height", "width"), "image_id").where("x >= 0 and y >= 0 and x < width and y < height").drop("height", "width")


def smooth_tiles(values: DataFrame, sizes: DataFrame, sigma: float = 2.0, side: int = SIDE) -> DataFrame:
    """Tiles of blurred heat, divided by the image's maximum, as ``HEAT``; tiles that no value reaches are missing, and zero.

    ``values`` has (image_id, y, x, value) inside its image, ``sizes``
    (image_id, height, width). A value goes to the tiles within the filter's
    radius, so that a task holds a tile and its surroundings, however large the
    image is. Edges are mirrored at the image's, not at tiles'.
    """
    radius = K.blur_radius(sigma)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        spans = []
        for n, k in ((int(first["height"]), int(first["ky"])), (int(first["width"]), int(first["kx"]))):
            lo, hi = k * side, min(n, (k + 1) * side)
            spans.append((lo, hi, *K.mirrored(n, lo - radius, hi + radius)))
        (y0, y1, a, down), (x0, x1, b, along) = spans
        grid = np.zeros((down.max() + 1, along.max() + 1))
        grid[pdf["y"].to_numpy() - a, pdf["x"].to_numpy() - b] = pdf["value"]
        heat = K.blur_pass(K.blur_pass(grid, 0, down, sigma), 1, along, sigma)
        return pd.DataFrame({"image_id": [first["image_id"]], "height": [first["height"]], "width": [first["width"]], "y": [y0], "x": [x0], "h": [y1 - y0], "w": [x1 - x0], "heat": [heat.ravel()]})

    tile = lambda c: F.floor(c / side).cast("int")
    near = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), tile(F.col(c) - radius)), F.least(tile(F.col(n) - 1), tile(F.col(c) + radius))))
    placed = values.select("image_id", "y", "x", "value").where("value is not null").join(sizes.select("image_id", "height", "width"), "image_id")
    placed = placed.withColumn("ky", near("y", "height")).withColumn("kx", near("x", "width"))
    raw = save(placed.groupBy("image_id", "ky", "kx").applyInPandas(run, HEAT))
    top = raw.groupBy("image_id").agg(F.max(F.array_max("heat")).alias("top"))
    share = F.when(F.col("top") > 0, F.transform("heat", lambda v: v / F.col("top"))).otherwise(F.col("heat"))
    return raw.join(top, "image_id").withColumn("heat", share).select(*raw.columns)


def smooth(values: DataFrame, sizes: DataFrame, sigma: float = 2.0) -> DataFrame:
    """(image_id, height, width, heat): whole blurred images, for pictures of single ones; zero without values."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        grid = np.zeros((h, w))
        for t in pdf.dropna(subset=["y"]).itertuples():
            grid[int(t.y) : int(t.y + t.h), int(t.x) : int(t.x + t.w)] = np.asarray(t.heat).reshape(int(t.h), int(t.w))
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "height": [h], "width": [w], "heat": [grid.ravel()]})

    parts = smooth_tiles(inside(values, sizes), sizes, sigma).drop("height", "width")
    return sizes.select("image_id", "height", "width").join(parts, "image_id", "left").groupBy("image_id").applyInPandas(run, "image_id string, height int, width int, heat array<double>")


def _joined_parts(parts: DataFrame, borders: DataFrame, key: str, diagonal: bool) -> DataFrame:
    """``parts`` with ``part``, one number for all that touch across tiles.

    ``parts`` has a row (key, ty, tx, c, ...) for each connected part of a tile,
    ``borders`` its pixels (key, ty, tx, c, y, x) at the tile's edges. What
    touches is an edge of a graph of parts, whose components are found by star
    steps; no image is held anywhere.
    """
    named = save(parts.withColumn("id", F.monotonically_increasing_id()))
    at = save(borders.join(named.select(key, "ty", "tx", "c", "id"), [key, "ty", "tx", "c"]).select(key, "y", "x", "id"))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    shifted = at.select(F.col(key).alias("_k"), F.col("id").alias("_id"), F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps])).alias("p"))
    touch = at.join(shifted, (F.col(key) == F.col("_k")) & (F.col("y") == F.col("p.y")) & (F.col("x") == F.col("p.x"))).where("id <> _id").select("id", "_id").distinct()
    touch = save(touch)
    if not touch.head(1):
        return named.withColumnRenamed("id", "part")
    found = components(touch)
    return named.join(found, named["id"] == found["node"], "left").withColumn("part", F.coalesce("component", "id")).drop("id", "node", "component")


def hot_regions(heatmaps: DataFrame, threshold: float = 0.5, min_area: int = 9) -> DataFrame:
    """(image_id, region, area, x, y, w, h): 4-connected parts above ``threshold`` of at least ``min_area`` pixels.

    ``heatmaps`` are tiles or whole images. Regions are numbered by their first
    pixel, row by row, the small ones too.
    """
    if "y" not in heatmaps.columns:
        heatmaps = heatmaps.select("image_id", "height", "width", F.lit(0).alias("y"), F.lit(0).alias("x"), F.col("height").alias("h"), F.col("width").alias("w"), "heat")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                label, n = K.label_cells(np.asarray(r.heat).reshape(r.h, r.w) > threshold, diagonal=False)
                y, x = np.nonzero(label)
                c = label[y, x]
                for k, (at, down, right) in enumerate(_spans(c, y, x, n), 1):
                    rows.append((r.image_id, r.y, r.x, k, len(at), r.y + down[0], r.x + right[0], r.y + down.min(), r.x + right.min(), r.y + down.max(), r.x + right.max(), False))
                edge = np.flatnonzero((y == 0) | (x == 0) | (y == r.h - 1) | (x == r.w - 1)) if (r.h, r.w) != (r.height, r.width) else []
                rows += [(r.image_id, r.y, r.x, c[e], 1, r.y + y[e], r.x + x[e], None, None, None, None, True) for e in edge]
            yield pd.DataFrame(rows, columns=["image_id", "ty", "tx", "c", "n", "y", "x", "y0", "x0", "y1", "x1", "border"])

    told = save(heatmaps.mapInPandas(run, "image_id string, ty int, tx int, c int, n int, y int, x int, y0 int, x0 int, y1 int, x1 int, border boolean"))
    joined = _joined_parts(told.where("not border").drop("border"), told.where("border"), "image_id", False)
    ends = [f(c).alias(c) for f, c in ((F.min, "y0"), (F.min, "x0"), (F.max, "y1"), (F.max, "x1"))]
    regions = joined.groupBy("image_id", "part").agg(F.sum("n").cast("int").alias("area"), F.min(F.struct("y", "x")).alias("first"), *ends)
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("first")).alias("region")
    out = regions.select("image_id", number, "area", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"))
    return out.where(F.col("area") >= min_area)


def _spans(c: np.ndarray, y: np.ndarray, x: np.ndarray, n: int):
    """For each label 1 to ``n``: places, y and x of its cells in row-major order."""
    order = np.argsort(c, kind="stable")
    for at in np.split(order, np.cumsum(np.bincount(c, minlength=n + 1)[1:])[:-1]) if n else []:
        yield at, y[at], x[at]


def footprint(matches: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(by, y, x): source pixels that any matched patch covers, inside ``height`` x ``width`` if these are columns."""
    span = lambda c: F.explode(F.sequence(F.col(c), F.col(c) + F.col("patch_size") - 1))
    size = [c for c in ("height", "width") if c in matches.columns]
    out = matches.select(*by, *size, "src_x", "patch_size", span("src_y").alias("y")).select(*by, *size, "y", span("src_x").alias("x")).where("x >= 0 and y >= 0")
    if len(size) == 2:
        out = out.where("x < width and y < height")
    return out.select(*by, "y", "x").distinct()


def largest_component(mask: DataFrame, key: str = "image_id", side: int = SIDE) -> DataFrame:
    """The mask's largest 8-connected component per key; the first in row-major order wins ties.

    Cells (key, y, x, each once) are labelled in tiles, and parts that touch
    across tiles are joined. Memory follows a tile's cells.
    """
    kind = mask.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
        y, x = pdf["y"].to_numpy() - ty * side, pdf["x"].to_numpy() - tx * side
        grid = np.zeros((side, side), bool)
        grid[y, x] = True
        return pdf.assign(c=K.label_cells(grid, diagonal=True)[0][y, x], border=(y == 0) | (x == 0) | (y == side - 1) | (x == side - 1))

    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    cells = mask.select(F.col(key).alias("k"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).withColumn("ty", tile("y")).withColumn("tx", tile("x"))
    told = save(cells.groupBy("k", "ty", "tx").applyInPandas(run, f"k {kind}, y int, x int, ty int, tx int, c int, border boolean"))
    parts = told.groupBy("k", "ty", "tx", "c").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("first"))
    joined = save(_joined_parts(parts, told.where("border").drop("border"), "k", True))
    sizes = joined.groupBy("k", "part").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = sizes.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "part")).alias("best")).select("k", F.col("best.part").alias("part"))
    mine = joined.join(best, ["k", "part"]).select("k", "ty", "tx", "c")
    kept = told.join(mine, ["k", "ty", "tx", "c"]).select(F.col("k").alias(key), "y", "x")
    return mask.join(kept, [key, "y", "x"], "left_semi")


def box(mask: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, area, x, y, w, h) of each mask."""
    grouped = mask.groupBy(key).agg(F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return grouped


def localize(matches: DataFrame, sizes: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, area, x, y, w, h, area_fraction): the largest part of the footprint; area 0 without matches.

    The share of the area is the detection score.
    """
    clipped = matches.join(sizes, key)
    found = box(largest_component(footprint(clipped, (key,)), key), key)
    out = sizes.join(found, key, "left")
    return out.select(key, F.coalesce("area", F.lit(0)).alias("area"), "x", "y", "w", "h", (F.coalesce("area", F.lit(0)) / (F.col("height") * F.col("width"))).alias("area_fraction"))


# -- measures ------------------------------------------------------------------------------


def localization_scores(cells: DataFrame, predicted: str = "predicted", actual: str = "actual", by: tuple[str, ...] = ()) -> DataFrame:
    """IoU, F1, precision, recall and MCC of boolean columns.

    IoU, precision and recall are 1 where nothing could be hit, F1 is 0 if both
    of its parts are, MCC is 0 without a denominator.
    """
    p, a = F.coalesce(F.col(predicted), F.lit(False)), F.coalesce(F.col(actual), F.lit(False))
    counts = cells.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    share = lambda x, y, empty: F.when(y == 0, F.lit(empty)).otherwise(x / y)
    out = counts.withColumn("iou", share(tp, tp + fp + fn, 1.0)).withColumn("precision", share(tp, tp + fp, 1.0)).withColumn("recall", share(tp, tp + fn, 1.0))
    pr = F.col("precision") + F.col("recall")
    bottom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return out.withColumn("f1", F.when(pr == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / pr)).withColumn("mcc", F.when(bottom == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / bottom))


def detection_auc(scored: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """(auc, n_pos, n_neg): the rank statistic with average ranks for ties; 0.5 with one class only.

    Scores are counted first, and running counts go over distinct scores in
    range partitions, so no window holds all rows. Null scores or classes are left out.
    """
    rows = scored.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    part = rows.repartitionByRange("s").withColumn("part", F.spark_partition_id())
    part = save(part)
    totals = part.groupBy("part").agg(F.sum("n").alias("below"))
    before = totals.select("part", F.coalesce(F.sum("below").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = part.withColumn("inside", inside).join(before, "part").agg(F.sum(F.col("p") * (F.col("before") + F.col("inside") + F.col("n") / 2)).alias("u"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    pos, neg = F.coalesce("n_pos", F.lit(0)), F.coalesce("n_neg", F.lit(0))
    return u.select(F.when((pos > 0) & (neg > 0), F.col("u") / (pos * neg)).otherwise(F.lit(0.5)).alias("auc"), pos.alias("n_pos"), neg.alias("n_neg"))


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with exact, interpolated quantiles as an array ``q``, null without values.

    Values are counted first and ranked within range partitions, so that no
    buffer or window holds all of them.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    part = save(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sums = part.groupBy("part").agg(F.sum("n").alias("m"))
    before = sums.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = part.withColumn("upto", upto).join(before, "part").select("v", (F.col("before") + F.col("upto") - F.col("n")).alias("lo"), (F.col("before") + F.col("upto") - 1).alias("hi"))
    total = part.agg((F.sum("n") - 1).alias("last"))
    asked = total.select(F.posexplode(F.array(*[F.lit(float(q)) for q in shares])).alias("k", "share"), "last").select("k", (F.col("share") * F.col("last")).alias("at"))
    hit = placed.join(F.broadcast(asked), (F.col("lo") <= F.ceil("at")) & (F.col("hi") >= F.floor("at")))  # one row for each share asked
    low = F.max(F.when((F.col("lo") <= F.floor("at")) & (F.col("hi") >= F.floor("at")), F.col("v")))
    high = F.max(F.when((F.col("lo") <= F.ceil("at")) & (F.col("hi") >= F.ceil("at")), F.col("v")))
    each = hit.groupBy("k").agg((low + (high - low) * F.first(F.col("at") - F.floor("at"))).alias("x"))
    return each.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("q"))


def trial_report(trials: DataFrame) -> DataFrame:
    """Detection rate, median and 90th percentile of the error of detected trials, and mean latency."""
    one = trials.agg(F.avg(F.col("detected").cast("double")).alias("detect_rate"), F.avg("latency_ms").alias("latency_ms"), F.count("*").alias("n"))
    q = quantiles(trials.where("detected"), "error", [0.5, 0.9])
    return one.crossJoin(q).select("detect_rate", F.get("q", F.lit(0)).alias("error_median"), F.get("q", F.lit(1)).alias("error_p90"), "latency_ms", "n")  # one row each
