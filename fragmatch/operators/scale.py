"""Resampling cues: how far parts of an image can be reduced without losing detail."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmatch.functions import kernels as K


def scale_map(images: DataFrame, window: int = 64, stride: int = 32) -> DataFrame:
    """(image_id, y, x, fraction) per window, in steps from the top left."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                image = np.clip(np.asarray(r.pixels).reshape(r.height, r.width, 3) * 255, 0, 255).round().astype(np.uint8)
                for y in range(0, max(1, r.height - window + 1), stride):
                    for x in range(0, max(1, r.width - window + 1), stride):
                        rows.append((r.image_id, y, x, K.native_fraction(image[y : y + window, x : x + window])))
            yield pd.DataFrame(rows, columns=["image_id", "y", "x", "fraction"])

    return images.select("image_id", "height", "width", "pixels").mapInPandas(run, "image_id string, y int, x int, fraction double")


def scale_inconsistency(images: DataFrame, window: int = 64, stride: int = 32) -> DataFrame:
    """(image_id, score, min_fraction, median_fraction, bbox): median less minimum; (0, 1, 1) under two windows."""
    return inconsistency(scale_map(images, window, stride), images.select("image_id"), window)


def inconsistency(cells: DataFrame, ids: DataFrame, window: int = 64) -> DataFrame:
    """The same of a map's rows (image_id, y, x, fraction), for the images of ``ids``."""
    cells = cells.groupBy("image_id").agg(
        F.count("*").alias("n"), F.min("fraction").alias("lo"), F.percentile("fraction", F.lit(0.5)).alias("mid"), F.min_by(F.struct("x", "y"), F.struct("fraction", "y", "x")).alias("at")
    )
    out = ids.select("image_id").join(cells, "image_id", "left")
    enough = F.coalesce(F.col("n") >= 2, F.lit(False))
    return out.select(
        "image_id", F.when(enough, F.col("mid") - F.col("lo")).otherwise(F.lit(0.0)).alias("score"), F.when(enough, F.col("lo")).otherwise(F.lit(1.0)).alias("min_fraction"),
        F.when(enough, F.col("mid")).otherwise(F.lit(1.0)).alias("median_fraction"), F.when(enough, F.array("at.x", "at.y", F.lit(window), F.lit(window))).alias("bbox"),
    )
