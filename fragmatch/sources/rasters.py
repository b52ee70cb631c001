"""Tables as images: rows (image_id, height, width, pixels) with pixels row-major in [0, 1]."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmatch.operators.patches import text_rows

RASTER = "image_id string, height int, width int, pixels array<double>"


def text_rasters(rows: DataFrame, id_col: str, text: str, width: int = 16) -> DataFrame:
    """Each whole text as an image: a character is a channel, code point mod 256 / 255.

    Three characters make a pixel and ``width`` pixels a row; the last row is
    filled up with zeros. Null and empty texts give images of height 0.
    """

    def run(batches):
        for batch in batches:
            ids, heights, pixels, held = [], [], [], 0
            for k in range(batch.num_rows):
                t = batch["text"][k].as_py() or ""
                h = -(-len(t) // (3 * width))
                ids.append(k)
                heights.append(h)
                pixels.append(text_rows(t, width, 0, h).ravel())
                held += len(pixels[-1])
                if held > 1 << 17 or k == batch.num_rows - 1:  # 1 MB of numbers, or one image
                    yield pa.RecordBatch.from_arrays([batch["image_id"].take(pa.array(ids)), pa.array(heights, pa.int32()), pa.array([width] * len(ids), pa.int32()), pa.array(pixels, pa.list_(pa.float64()))], names=["image_id", "height", "width", "pixels"])
                    ids, heights, pixels, held = [], [], [], 0

    return rows.select(F.col(id_col).cast("string").alias("image_id"), F.col(text).alias("text")).mapInArrow(run, RASTER)


def text_images(rows: DataFrame, id_col: str, text: str, width: int = 16) -> DataFrame:
    """The images of ``text_rasters`` as texts: (image_id, width, text), which ``operators.patches`` decodes where it cuts them."""
    return rows.select(F.col(id_col).cast("string").alias("image_id"), F.lit(width).alias("width"), F.col(text).alias("text"))


def from_array(spark, images: dict[str, np.ndarray]) -> DataFrame:
    """A few images that the caller holds, (H, W, 3) arrays, as raster rows."""
    rows = [(k, int(v.shape[0]), int(v.shape[1]), [float(x) for x in np.asarray(v, float).ravel()]) for k, v in images.items()]
    return spark.createDataFrame(rows, RASTER)
