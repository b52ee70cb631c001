"""Image files: scans by pattern, checks, and normalisation to rasters."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.errors import ImageError, ImageShapeError
from fragmatch.operators import tiles
from fragmatch.sources.rasters import RASTER

EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp")
MAX_BYTES = 50 * 1024 * 1024
MAX_PIXELS = 50_000_000
FORMATS = ("JPEG", "PNG", "BMP", "TIFF", "WEBP")


def normalise(image: np.ndarray) -> np.ndarray:
    """An image in [0, 1]: 8-bit / 255; single precision up to 1 as it is; else divided by its maximum."""
    if image.ndim != 3 or image.shape[2] != 3:
        raise ImageShapeError(f"expected an RGB image, got shape {image.shape}")
    if image.dtype == np.uint8:
        return image / 255.0
    if not np.isfinite(image).all():
        raise ImageError("the image holds NaN or infinite values")
    most = float(image.max()) if image.size else 0.0
    if image.dtype == np.float32 and most <= 1.0:
        return image.astype(np.float64)
    if most == 0:
        raise ImageError("the image is all zero")
    return image.astype(np.float64) / most


def paths(spark: SparkSession, folder: str, patterns: str = "*.jpg,*.jpeg,*.png", recursive: bool = False) -> DataFrame:
    """(path, length) of files that match a comma list of globs in either case, each once, sorted."""
    names = [p.strip() for p in patterns.split(",") if p.strip()]
    globs = sorted({v for p in names for v in (p, p.lower(), p.upper())})
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(globs) + "}")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(folder).select("path", "length").dropDuplicates(["path"]).orderBy("path")


def _decoded(spark: SparkSession, folder: str, patterns: str | None, recursive: bool, least: int) -> DataFrame:
    """Spark's rows of image files, with ``reason`` where a file can't be used."""
    globs = patterns or ",".join(f"*.{e}" for e in EXTENSIONS)
    names = sorted({v for p in globs.split(",") for v in (p.strip(), p.strip().lower(), p.strip().upper())})
    loaded = spark.read.format("image").option("pathGlobFilter", "{" + ",".join(names) + "}").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("image.*")
    bad = F.when(F.col("nChannels") != 3, "not RGB").when(F.least("height", "width") < least, f"smaller than {least} pixels")
    return loaded.withColumn("reason", F.when(F.col("height") < 0, "not readable").otherwise(bad))


def scan(spark: SparkSession, folder: str, patterns: str | None = None, recursive: bool = True, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Images of a folder as raster rows, and (path, reason) of the files that can't be used.

    Files are decoded by Spark's image source; it gives blue, green, red, and
    here the order is turned round. ``image_id`` is the path.
    """
    marked = _decoded(spark, folder, patterns, recursive, least)

    def run(batches):
        for batch in batches:
            h, w = batch["height"].to_pylist(), batch["width"].to_pylist()
            pixels = [(np.frombuffer(d, np.uint8).reshape(-1, 3)[:, ::-1] / 255.0).ravel() for d in batch["data"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["origin"], pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(pixels, pa.list_(pa.float64()))], names=["image_id", "height", "width", "pixels"])

    good = marked.where("reason is null").select("origin", "height", "width", "data").mapInArrow(run, RASTER)
    return good, marked.where("reason is not null").select(F.col("origin").alias("path"), "reason")


def scan_tiles(spark: SparkSession, folder: str, patterns: str | None = None, recursive: bool = True, least: int = 3, side: int = tiles.SIDE) -> tuple[DataFrame, DataFrame]:
    """Like ``scan``, with images as tiles of 8-bit values (``operators.tiles``): a decoded image is never a list of numbers."""
    marked = _decoded(spark, folder, patterns, recursive, least)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                origin, h, w = (batch[c][k].as_py() for c in ("origin", "height", "width"))
                image = np.frombuffer(batch["data"][k].as_buffer(), np.uint8).reshape(h, w, 3)[:, :, ::-1]
                for row in tiles.cut_array(image, side):
                    yield tiles.tile_batch([(origin, h, w)], [row])

    good = marked.where("reason is null").select("origin", "height", "width", "data").mapInArrow(run, tiles.TILE)
    return good, marked.where("reason is not null").select(F.col("origin").alias("path"), "reason")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str) -> DataFrame:
    """One image file; errors if it is missing, unreadable, not RGB or under 3 x 3."""
    try:
        good, bad = scan(spark, path, patterns="*", recursive=False)
    except AnalysisException as e:
        raise ImageError(f"{path}: no such file") from e
    problem = bad.first()
    if problem:
        raise ImageError(f"{problem['path']}: {problem['reason']}")
    if not good.head(1):
        raise ImageError(f"{path}: no image")
    return good


def sample(files: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` files, the same ones for the same seed, whatever the order of the input."""
    return files.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(n)


def header(content: bytes) -> tuple[str, int, int] | None:
    """Format, width and height from an image file's first bytes, without decoding it."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return ("PNG", *struct.unpack(">II", content[16:24]))
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return "BMP", w, abs(h)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP" and len(content) >= 30:
        if content[12:16] == b"VP8X":
            return "WEBP", 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
        if content[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", content[26:30])
            return "WEBP", w & 0x3FFF, h & 0x3FFF
        bits = int.from_bytes(content[21:25], "little")
        return "WEBP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if content[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if content[:2] == b"II" else ">"
        at, size = struct.unpack(order + "I", content[4:8])[0], {}
        if at + 2 <= len(content):
            for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
                entry = content[at + 2 + 12 * k : at + 14 + 12 * k]
                if len(entry) == 12:
                    tag, kind = struct.unpack(order + "HH", entry[:4])
                    size[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8:10] if kind == 3 else entry[8:12])[0]
        return ("TIFF", size[256], size[257]) if {256, 257} <= size.keys() else None
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            if content[at] != 0xFF:
                return None
            mark = content[at + 1]
            if mark == 0xFF or 0xD0 <= mark <= 0xD8 or mark == 1:
                at += 1 if mark == 0xFF else 2
                continue
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    return None


def uploads(files: DataFrame) -> DataFrame:
    """Rows (path, length, content) with ``reason``: null if acceptable, else why not."""

    def run(batches):
        for batch in batches:
            out = []
            for n, content in zip(batch["length"].to_pylist(), batch["content"].to_pylist()):
                if n > MAX_BYTES:
                    out.append("too large")
                    continue
                found = header(content or b"")
                out.append("format not allowed" if found is None else "too many pixels" if found[1] * found[2] > MAX_PIXELS else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "reason"])

    kept = files.select("path", "length", F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content"))
    return kept.mapInArrow(run, "path string, length long, content binary, reason string")
