"""Evaluation of the search on images with known answers: planted fragments and copies, found by joins.

A trial is a row: two rasters with the truth about them. Trials are made from a
table's images (``plant``, ``plant_copies``) or generated (``generated``,
``generated_copies``), a row at a time where it lies; everything after that is the
engine's own: patches, nearest neighbours that meet by trial in blocks, colour
fits, coherent offsets, footprints and their largest part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.functions import kernels as K
from fragmatch.operators import blocks, coherence, heatmap, patches, verify
from fragmatch.plans.scratch import save
from fragmatch.sources import synthetic

TRIAL = "seed long, positive boolean, height int, width int, pixels array<double>, donor_height int, donor_width int, donor_pixels array<double>, x int, y int, side int"
COPY = "seed long, height int, width int, pixels array<double>, dx int, dy int"


def _bytes(pixels, height: int, width: int) -> np.ndarray:
    """A raster's pixels as an 8-bit image."""
    return np.rint(np.clip(np.asarray(pixels, float), 0, 1) * 255).astype(np.uint8).reshape(height, width, 3)


def _seed(*parts) -> int:
    return zlib.crc32(":".join(map(str, parts)).encode())


def _splice(host: np.ndarray, donor: np.ndarray, side: int, seed: int, grade: float) -> tuple[np.ndarray, int, int]:
    """``host`` with a graded square of ``donor``, and the square's corner (x, y)."""
    place = synthetic._stream(seed, "place")
    at = [int(place.integers(n - side + 1)) for image in (donor, host) for n in image.shape[:2]]
    out = host.copy()
    out[at[2] : at[2] + side, at[3] : at[3] + side] = synthetic.graded(donor[at[0] : at[0] + side, at[1] : at[1] + side], *synthetic.grading(seed, grade))
    return out, at[3], at[2]


def plant(images: DataFrame, pairs: DataFrame, fragment: int = 8, least: int = 4, grade: float = 0.15, seed: int = 0) -> DataFrame:
    """Two trials (host_id, donor_id, ``TRIAL``) for each of ``pairs``: the host with a square of the donor, and as it is.

    The square has ``fragment`` pixels a side, or as many as both images have
    room for. Its place and colour grade follow from the seed and the ids. Pairs
    with an image that is missing, null or smaller than ``least`` on a side are
    no trials. ``seed`` in the result numbers the pairs.
    """
    side = lambda who, **names: images.select(F.col("image_id").alias(f"{who}_id"), *[F.col(c).alias(n) for c, n in names.items()])
    hosts = side("host", height="height", width="width", pixels="pixels")
    donors = side("donor", height="donor_height", width="donor_width", pixels="donor_pixels")
    met = pairs.select("host_id", "donor_id").join(hosts, "host_id").join(donors, "donor_id").where("pixels is not null and donor_pixels is not null")
    met = met.where(F.least("height", "width", "donor_height", "donor_width") >= least).withColumn("seed", F.monotonically_increasing_id())

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                host, donor = _bytes(r.pixels, r.height, r.width), _bytes(r.donor_pixels, r.donor_height, r.donor_width)
                s = min(fragment, *host.shape[:2], *donor.shape[:2])
                made, x, y = _splice(host, donor, s, _seed(seed, r.host_id, r.donor_id), grade)
                for positive, image in ((True, made), (False, host)):
                    rows.append((r.host_id, r.donor_id, r.seed, positive, r.height, r.width, image.ravel() / 255.0, r.donor_height, r.donor_width, donor.ravel() / 255.0, x if positive else 0, y if positive else 0, s if positive else 0))
            yield pd.DataFrame(rows, columns=["host_id", "donor_id", *[c.split()[0] for c in TRIAL.split(", ")]])

    return met.mapInPandas(run, f"host_id string, donor_id string, {TRIAL}")


def plant_copies(images: DataFrame, region: int = 8, apart: int = 8, noise: float = 0.01, seed: int = 0) -> DataFrame:
    """A trial (image_id, ``COPY``) for each of ``images``: a square of it copied ``apart`` pixels away or farther, with noise.

    Where the image has no room for that, or is null, it is no trial.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                room = (r.height - region, r.width - region)
                if min(room) < 0 or max(room) < apart:
                    continue
                image, own = _bytes(r.pixels, r.height, r.width) / 255.0, _seed(seed, r.image_id)
                place = synthetic._stream(own, "place")
                long = int(np.argmax(room))  # the axis on which the two lie apart
                a, b = [int(place.integers(n + 1)) for n in room], [int(place.integers(n + 1)) for n in room]
                a[long] = int(place.integers(room[long] - apart + 1))
                b[long] = a[long] + apart + int(place.integers(room[long] - apart - a[long] + 1))
                image[b[0] : b[0] + region, b[1] : b[1] + region] = image[a[0] : a[0] + region, a[1] : a[1] + region].copy()
                made = np.clip(image + synthetic._stream(own, "noise").normal(0, noise, image.shape), 0, 1)
                rows.append((r.image_id, r.seed, r.height, r.width, np.rint(made * 255).ravel() / 255.0, b[1] - a[1], b[0] - a[0]))
            yield pd.DataFrame(rows, columns=["image_id", *[c.split()[0] for c in COPY.split(", ")]])

    known = images.select("image_id", "height", "width", "pixels").where("pixels is not null").withColumn("seed", F.monotonically_increasing_id())
    return known.mapInPandas(run, f"image_id string, {COPY}")


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism)))


def generated(spark: SparkSession, positives: int, negatives: int = 0, seed: int = 0, **splice) -> DataFrame:
    """Trials (``TRIAL``) of generated splices and of pairs of unrelated images."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k in pdf["id"].tolist():
                s = synthetic.splice(seed + k, **splice) if k < positives else synthetic.negative(seed + k, splice.get("size", 96))
                (h, w), (dh, dw) = s.tampered.shape[:2], s.donor.shape[:2]
                rows.append((k, k < positives, h, w, s.tampered.ravel() / 255.0, dh, dw, s.donor.ravel() / 255.0, *s.bbox[:3]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRIAL.split(", ")])

    return _numbers(spark, positives + negatives).mapInPandas(run, TRIAL)


def generated_copies(spark: SparkSession, n: int, seed: int = 0, size: int = 96, region: int = 32, noise: float = 0.01, apart: int = 16) -> DataFrame:
    """Trials (``COPY``) of generated copy-moves."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k in pdf["id"].tolist():
                image, a, b = synthetic.copy_move(seed + k, size, region, noise, apart)
                rows.append((k, *image.shape[:2], image.ravel() / 255.0, b[0] - a[0], b[1] - a[1]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COPY.split(", ")])

    return _numbers(spark, n).mapInPandas(run, COPY)


def fits(sources: DataFrame, targets: DataFrame, size: int, stride: int, k: int, threshold: float, probability: float, sigma: float, apart: int = 0) -> DataFrame:
    """(image_id, src_x, src_y, tgt_x, tgt_y, patch_size, probability): patches of source images that fit some patch of their key's targets.

    ``sources`` and ``targets`` are rasters with ``key``; a source's patches meet
    the targets of its key only, in blocks, so that neither a key with many
    images nor a large image is one task. Each takes its ``k`` nearest within the
    squared distance ``threshold``; hits nearer than ``apart`` on both axes don't
    count. Patches are numbered as they are saved, so that numbers are unique.
    """
    number = lambda df, step, name: save(patches.explode(df, size, step, None, K.photometric).withColumn(name, F.monotonically_increasing_id()))
    q, t = number(sources, stride, "q"), number(targets, 1, "t")
    sizes, asked = t.groupBy("key").agg(F.count("*").alias("n")), q.groupBy("key").agg(F.count("*").alias("m"))
    sent = q.select("key", "q", F.col("descriptor").alias("v"), F.lit(float(threshold)).alias("limit"))
    near = blocks.merged(blocks.meet(t.select("key", "t", F.col("descriptor").alias("v")), sizes, sent, asked, k), k)
    hits = save(near.select("q", F.explode("near").alias("n")).select("q", "n.t"))
    src = q.select("q", "image_id", F.col("x").alias("src_x"), F.col("y").alias("src_y"), F.col("patch").alias("src_patch"))
    tgt = t.select("t", F.col("x").alias("tgt_x"), F.col("y").alias("tgt_y"), F.col("patch").alias("tgt_patch"))
    met = hits.join(src, "q").join(tgt, "t").where(F.greatest(F.abs(F.col("tgt_x") - F.col("src_x")), F.abs(F.col("tgt_y") - F.col("src_y"))) >= apart)
    good = verify.accept(verify.fit(met, sigma=sigma), probability)
    return good.select("image_id", "src_x", "src_y", "tgt_x", "tgt_y", F.lit(size).alias("patch_size"), "probability")


def detect(trials: DataFrame, size: int = 8, stride: int = 2, k: int = 1, threshold: float = 0.5, probability: float = 0.5, tolerance: int = 2, least: int = 3, sigma: float = 0.02) -> DataFrame:
    """(seed, positive, tp, fp, fn, tn, score) of trials: the largest part of what coherent fits cover, against the truth.

    ``least`` fits must agree on an offset, up to touching cells of ``tolerance``
    pixels. The score is the share of the image that is covered.
    """
    trials = save(trials)
    name = F.concat_ws(":", F.col("seed").cast("string"), F.col("positive").cast("string")).alias("image_id")
    sources = trials.select(F.col("seed").alias("key"), name, "height", "width", "pixels")
    # a pair's trials share the donor
    donors = trials.groupBy("seed").agg(F.max("positive").alias("positive")).join(trials, ["seed", "positive"]).select(F.col("seed").alias("key"), name, F.col("donor_height").alias("height"), F.col("donor_width").alias("width"), F.col("donor_pixels").alias("pixels"))
    found = save(fits(sources, donors, size, stride, k, threshold, probability, sigma))
    grouped = coherence.clusters(found, tolerance)
    enough = grouped.groupBy("image_id", "cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("image_id", "cluster")
    truth = trials.select(name, "seed", "positive", "height", "width", F.col("x").alias("bx"), F.col("y").alias("by"), "side")
    kept = grouped.join(enough, ["image_id", "cluster"], "left_semi").join(truth.select("image_id", "height", "width"), "image_id")
    cells = heatmap.largest_component(save(heatmap.footprint(kept))).join(truth, "image_id")
    inside = F.col("x").between(F.col("bx"), F.col("bx") + F.col("side") - 1) & F.col("y").between(F.col("by"), F.col("by") + F.col("side") - 1)
    counts = cells.groupBy("image_id").agg(F.count_if(inside).alias("tp"), F.count_if(~inside).alias("fp"))
    out = truth.join(counts, "image_id", "left").withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("fp", F.coalesce("fp", F.lit(0)))
    area, planted = F.col("height").cast("long") * F.col("width"), F.col("side").cast("long") * F.col("side")
    return out.select("seed", "positive", "tp", "fp", (planted - F.col("tp")).alias("fn"), (area - planted - F.col("fp")).alias("tn"), ((F.col("tp") + F.col("fp")) / area).alias("score"))


def summary(rows: DataFrame) -> DataFrame:
    """Mean IoU, F1, precision and recall of the positives, and the AUC of the scores."""
    share = lambda x, y: F.when(y == 0, F.lit(1.0)).otherwise(x / y)
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    each = rows.withColumn("iou", share(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("precision", p).withColumn("recall", r)
    each = each.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
    mean = lambda c: F.avg(F.when(F.col("positive"), F.col(c))).alias(c)
    one = each.agg(*[mean(c) for c in ("iou", "f1", "precision", "recall")], F.count("*").alias("n"))
    return one.crossJoin(heatmap.detection_auc(rows).select(F.col("auc").alias("det_auc")))  # one row each


def own_offsets(trials: DataFrame, size: int = 8, stride: int = 2, k: int = 8, apart: int = 8, threshold: float = 0.5, sigma: float = 0.02, probability: float = 0.5, least: int = 9) -> DataFrame:
    """(seed, detected, votes, error) of trials with copies: how far the offset that most fits within the image name is from the true one.

    An offset and its opposite are one; equal votes go to the smallest (dx, dy).
    It counts as detected with ``least`` votes. Without any fit ``error`` is null.
    """
    trials = save(trials)
    images = trials.select(F.col("seed").alias("key"), F.col("seed").cast("string").alias("image_id"), "height", "width", "pixels")
    found = fits(images, images, size, stride, k, threshold, probability, sigma, apart)
    dx, dy = F.col("tgt_x") - F.col("src_x"), F.col("tgt_y") - F.col("src_y")
    sign = F.when((dx < 0) | ((dx == 0) & (dy < 0)), -1).otherwise(1)
    votes = found.groupBy(F.col("image_id").cast("long").alias("seed"), (dx * sign).alias("fx"), (dy * sign).alias("fy")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("seed").agg(F.min(F.struct((-F.col("votes")).alias("less"), "fx", "fy")).alias("b")).select("seed", "b.*")
    off = lambda s: F.hypot(F.col("fx") - s * F.col("dx"), F.col("fy") - s * F.col("dy"))
    out = trials.select("seed", "dx", "dy").join(best, "seed", "left")
    return out.select("seed", F.coalesce(-F.col("less") >= least, F.lit(False)).alias("detected"), F.coalesce(-F.col("less"), F.lit(0)).alias("votes"), F.least(off(1), off(-1)).alias("error"))
