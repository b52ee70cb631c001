"""Rasters in tiles: windows, pyramid levels and scale windows of images that no task holds whole.

A tile is a row with its place in the image. What an output tile needs beyond its
own pixels (a window's reach, a filter's support) is a range on each axis; every
tile sends its share of each range, and the ranges are put together where they
meet. Images of one tile need no exchange. Results equal those of the whole image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fragmatch.functions import kernels as K
from fragmatch.operators.patches import PATCH, lists
from fragmatch.plans.scratch import save

#: ``pixels`` holds 8-bit values where that is exact, else 64-bit floats; rows of the tile, one after the other.
TILE = "image_id string, height int, width int, y int, x int, h int, w int, pixels binary"
SIDE = 256
_OWN = ("image_id", "height", "width", "y", "x", "h", "w", "pixels")

#: An axis of n pixels to the ranges (tile number, from, to) that its output tiles need.
Need = Callable[[int], list[tuple[int, int, int]]]


def to_bytes(image: np.ndarray) -> bytes:
    eight = np.rint(image * 255)
    if ((eight >= 0) & (eight <= 255) & (eight / 255.0 == image)).all():
        return eight.astype(np.uint8).tobytes()
    return np.ascontiguousarray(image, np.float64).tobytes()


def from_bytes(raw: bytes, h: int, w: int) -> np.ndarray:
    """Pixels in [0, 1] of a tile."""
    if len(raw) == h * w * 3:
        return np.frombuffer(raw, np.uint8).reshape(h, w, 3) / 255.0
    return np.frombuffer(raw, np.float64).reshape(h, w, 3)


def cut_array(image: np.ndarray, side: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(y, x, h, w, pixels) of an image that is at hand, 8-bit or in [0, 1]."""
    for y in range(0, image.shape[0], side):
        for x in range(0, image.shape[1], side):
            part = image[y : y + side, x : x + side]
            raw = np.ascontiguousarray(part).tobytes() if part.dtype == np.uint8 else to_bytes(part)
            yield y, x, part.shape[0], part.shape[1], raw


def tile_batch(head: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
    """Rows (image_id, height, width) and (y, x, h, w, pixels), side by side, as ``TILE``."""
    types = (pa.string(), *[pa.int32()] * 6, pa.binary())
    cols = list(zip(*[(*h, *r) for h, r in zip(head, rows)]))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(_OWN))


def cut(images: DataFrame, side: int = SIDE) -> DataFrame:
    """Raster rows as tiles; null and empty images have none. A single image of this form is held whole once; sources give tiles themselves."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, h, w = (batch[c][k].as_py() for c in ("image_id", "height", "width"))
                if not h or not w or not batch["pixels"][k].is_valid:
                    continue
                image = batch["pixels"][k].values.to_numpy(zero_copy_only=False).reshape(h, w, 3)
                for row in cut_array(image, side):
                    yield tile_batch([(i, h, w)], [row])

    return images.select("image_id", "height", "width", "pixels").mapInArrow(run, TILE)


def text_tiles(rows: DataFrame, id_col: str, text: str, width: int = 16, side: int = SIDE) -> DataFrame:
    """Texts as the images of ``sources.rasters.text_rasters``, in tiles of up to ``side`` pixel rows; no text is a list of numbers as a whole."""

    def run(batches):
        for batch in batches:
            head, out, held = [], [], 0
            for k in range(batch.num_rows):
                i, t = batch["image_id"][k].as_py(), batch["text"][k].as_py() or ""
                height = -(-len(t) // (3 * width))
                for y in range(0, height, side):
                    part = t[y * 3 * width : (y + side) * 3 * width]
                    raw = (np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32) % 256).astype(np.uint8)
                    h = -(-len(raw) // (3 * width))
                    raw = np.concatenate([raw, np.zeros(h * 3 * width - len(raw), np.uint8)]).reshape(h, width, 3)
                    for x in range(0, width, side):
                        piece = raw[:, x : x + side]
                        head.append((i, height, width))
                        out.append((y, x, h, piece.shape[1], piece.tobytes()))
                        held += piece.size
                    if held > 1 << 20:
                        yield tile_batch(head, out)
                        head, out, held = [], [], 0
            if out:
                yield tile_batch(head, out)

    return rows.select(F.col(id_col).cast("string").alias("image_id"), F.col(text).alias("text")).mapInArrow(run, TILE)


# -- exchange ------------------------------------------------------------------------------


class _Needs:
    """Ranges of an axis, worked out once for each length."""

    def __init__(self, need: Need):
        self.need, self.known = need, {}

    def of(self, n: int) -> np.ndarray:
        if n not in self.known:
            self.known[n] = np.array(self.need(n), np.int64).reshape(-1, 3)
        return self.known[n]

    def meeting(self, n: int, lo: int, hi: int) -> np.ndarray:
        r = self.of(n)
        return r[(r[:, 1] < hi) & (r[:, 2] > lo)]


def _pieces(rows: Need, cols: Need, more: list[str]):
    """Each tile's share of the ranges that meet it."""

    def run(batches):
        down, along = _Needs(rows), _Needs(cols)
        for batch in batches:
            for k in range(batch.num_rows):
                i, height, width, y, x, h, w, raw = (batch[c][k].as_py() for c in _OWN)
                image, size = np.frombuffer(raw, np.uint8).reshape(h, w, -1), []
                got: dict[str, list] = {c: [] for c in ("ky", "kx", "y", "x", "h", "w", "pixels")}
                for ky, a, b in down.meeting(height, y, y + h).tolist():
                    for kx, c, d in along.meeting(width, x, x + w).tolist():
                        top, left, end, right = max(a, y), max(c, x), min(b, y + h), min(d, x + w)
                        part = image[top - y : end - y, left - x : right - x]
                        for name, v in zip(got, (ky, kx, top, left, end - top, right - left, part.tobytes())):
                            got[name].append(v)
                        size.append(1)
                if size:
                    same = [pa.array([batch[c][k].as_py()] * len(size), batch.schema.field(c).type) for c in ("image_id", "height", "width", *more)]
                    own = [pa.array(v, pa.binary() if c == "pixels" else pa.int32()) for c, v in got.items()]
                    yield pa.RecordBatch.from_arrays([*same, *own], names=["image_id", "height", "width", *more, *got])

    return run


def _put_together(rows: Need, cols: Need, more: list[str], work):
    """Sorted pieces to regions, and what ``work`` makes of each."""
    keys = ["image_id", *more, "ky", "kx"]

    def run(batches):
        down, along = _Needs(rows), _Needs(cols)
        now = region = args = None
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            cols_ = {c: batch[c].to_pylist() for c in batch.schema.names}
            for k in range(batch.num_rows):
                key = tuple(cols_[c][k] for c in keys)
                if key != now:
                    if region is not None:
                        yield from work(*args, region)
                    height, width, ky, kx = (cols_[c][k] for c in ("height", "width", "ky", "kx"))
                    a, b = next((a, b) for n, a, b in down.of(height).tolist() if n == ky)
                    c, d = next((c, d) for n, c, d in along.of(width).tolist() if n == kx)
                    now, region = key, np.zeros((b - a, d - c, 3))
                    args = (key[0], height, width, [cols_[m][k] for m in more], ky, kx, a, c)
                y, x, h, w = (cols_[c][k] for c in ("y", "x", "h", "w"))
                a, c = args[-2:]
                region[y - a : y - a + h, x - c : x - c + w] = from_bytes(cols_["pixels"][k], h, w)
        if region is not None:
            yield from work(*args, region)

    return run


def over_regions(tiles: DataFrame, rows: Need, cols: Need, work, schema: str) -> DataFrame:
    """What ``work(image_id, height, width, more, ky, kx, y, x, region)`` yields as record batches for every output tile.

    Further columns of ``tiles`` (``more``, in order) are the same for all tiles
    of an image, and part of its key. Images of one tile are worked on where
    they lie; others send each output tile its range, spread over tasks by
    image and tile.
    """
    more = [c for c in tiles.columns if c not in _OWN]

    def at_hand(batches):
        down, along = _Needs(rows), _Needs(cols)
        for batch in batches:
            for k in range(batch.num_rows):
                i, height, width, _, _, h, w, raw = (batch[c][k].as_py() for c in _OWN)
                image, rest = from_bytes(raw, h, w), [batch[c][k].as_py() for c in more]
                for ky, a, b in down.of(height).tolist():
                    for kx, c, d in along.of(width).tolist():
                        yield from work(i, height, width, rest, ky, kx, a, c, image[a:b, c:d])

    types = {f.name: f.dataType.simpleString() for f in tiles.schema}
    piece = ", ".join(f"`{c}` {types[c]}" for c in ("image_id", "height", "width", *more)) + ", ky int, kx int, y int, x int, h int, w int, pixels binary"
    whole = "h = height and w = width"
    split = tiles.where(f"not ({whole})").mapInArrow(_pieces(rows, cols, more), piece)
    key = ["image_id", *more, "ky", "kx"]
    split = split.repartition(*key).sortWithinPartitions(*key).mapInArrow(_put_together(rows, cols, more, work), schema)
    return tiles.where(whole).mapInArrow(at_hand, schema).unionAll(split)


def grid(side: int, before: int = 0, after: int = 0) -> Need:
    """Tiles of ``side`` pixels with so many more on either side, inside the image."""
    return lambda n: [(k, max(0, k * side - before), min(n, (k + 1) * side + after)) for k in range(-(-n // side))]


# -- operators -----------------------------------------------------------------------------


def explode(tiles: DataFrame, size: int, stride: int = 1, entropy_threshold: float | None = None, kernel=None, side: int = SIDE, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``patches.explode``, from tiles: the same numbers, coordinates and patches, in another order."""
    more = [c for c in tiles.columns if c not in _OWN]
    types = {f.name: f for f in tiles.schema}
    arrow = {c: to_arrow_type(types[c].dataType) for c in more}
    schema = {p.split()[0]: p for p in PATCH.split(", ")} | {c: f"`{c}` {types[c].dataType.simpleString()}" for c in more} | ({"descriptor": "descriptor array<double>"} if kernel else {})
    names = [c for c in schema if columns is None or c in columns]

    def work(i, height, width, rest, ky, kx, y0, x0, region):
        across = (width - size) // stride + 1
        down, right = -y0 % stride, -x0 % stride
        step = max(1, (1 << 21) // max(1, region.shape[1] * 3 * size)) * stride  # rows of windows at a time
        for top in range(down, region.shape[0] - size + 1, step):
            part, xy = K.windows(region[top : top + step - stride + size, right:], size, stride)
            if not len(part):
                break
            e = K.entropy(part) if entropy_threshold is not None or "entropy" in names else None
            keep = np.flatnonzero(e > entropy_threshold) if entropy_threshold is not None else np.arange(len(part))
            if not len(keep):
                continue
            x, y = xy[keep, 0] + right + x0, xy[keep, 1] + top + y0
            out = {
                "image_id": lambda: pa.array([i] * len(keep), pa.string()), "patch_idx": lambda: pa.array((y // stride * across + x // stride).astype(np.int32)), "x": lambda: pa.array(x.astype(np.int32)), "y": lambda: pa.array(y.astype(np.int32)),
                "patch": lambda: lists(part[keep]), "entropy": lambda: pa.array(e[keep]), **{c: (lambda c=c, v=v: pa.array([v] * len(keep), arrow[c])) for c, v in zip(more, rest)},
                "descriptor": lambda: lists(np.concatenate([kernel(part[keep[k : k + 4096]]) for k in range(0, len(keep), 4096)])),
            }
            yield pa.RecordBatch.from_arrays([out[c]() for c in names], names=names)

    need = grid(side, 0, size - 1)
    return over_regions(tiles, need, need, work, ", ".join(schema[c] for c in names))


def _level_need(scale: float, least: int, side: int) -> Need:
    def need(n: int) -> list[tuple[int, int, int]]:
        size = int(n * scale)
        if size < least:
            return []
        starts = range(0, size, side)
        return [(k, *K.resample_reach(n, size, "lanczos", lo, min(size, lo + side))) for k, lo in enumerate(starts)]

    return need


def pyramid(tiles: DataFrame, scales: list[float], min_size: int = 16, side: int = SIDE) -> DataFrame:
    """Tiles of every level, with ``level`` and ``scale``: the pixels of ``patches.pyramid``."""

    def at(level: int, scale: float) -> DataFrame:
        def work(i, height, width, rest, ky, kx, y0, x0, region):
            hh, ww = int(height * scale), int(width * scale)
            eight = np.clip(region * 255, 0, 255).astype(np.uint8).astype(np.float64)
            y, x = ky * side, kx * side
            if ww != width:
                eight = K.resample(eight, 1, width, ww, "lanczos", x, min(ww, x + side), x0)
            if hh != height:
                eight = K.resample(eight, 0, height, hh, "lanczos", y, min(hh, y + side), y0)
            out = tile_batch([(i, hh, ww)], [(y, x, *eight.shape[:2], eight.astype(np.uint8).tobytes())])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([level], pa.int32()), pa.array([scale], pa.float64())], names=[*_OWN, "level", "scale"])

        if scale == 1.0:
            return tiles.where(F.least("height", "width") >= min_size).select(*_OWN, F.lit(level).alias("level"), F.lit(1.0).alias("scale"))
        need = _level_need(scale, min_size, side)
        return over_regions(tiles.select(*_OWN), need, need, work, f"{TILE}, level int, scale double")

    out = None
    for level, scale in enumerate(scales):
        out = at(level, scale) if out is None else out.unionAll(at(level, scale))
    return out


def pyramid_patches(tiles: DataFrame, size: int, scales: list[float], stride: int = 1, min_size: int = 16, entropy_threshold: float | None = None, side: int = SIDE, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``patches.pyramid_patches``, from tiles; tiles and levels are saved, or each branch over them would make them again."""
    levels = save(pyramid(save(tiles.select(*_OWN)), scales, min_size, side))
    rows = explode(levels, size, stride, entropy_threshold, side=side, columns=None if columns is None else (*columns, "x", "y", "scale"))
    return rows.withColumn("orig_x", F.bround(F.col("x") / F.col("scale")).cast("int")).withColumn("orig_y", F.bround(F.col("y") / F.col("scale")).cast("int"))


def scale_map(tiles: DataFrame, window: int = 64, stride: int = 32, side: int = SIDE) -> DataFrame:
    """The rows of ``scale.scale_map``, from tiles."""

    def need(n: int) -> list[tuple[int, int, int]]:
        tops = np.arange(0, max(1, n - window + 1), stride)
        return [(k, int(mine[0]), min(n, int(mine[-1]) + window)) for k in range(-(-n // side)) if len(mine := tops[tops // side == k])]

    def work(i, height, width, rest, ky, kx, y0, x0, region):
        image, rows = np.clip(region * 255, 0, 255).round().astype(np.uint8), []
        for y in range(0, max(1, region.shape[0] - window + 1), stride):
            for x in range(0, max(1, region.shape[1] - window + 1), stride):
                rows.append((i, y0 + y, x0 + x, K.native_fraction(image[y : y + window, x : x + window])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.float64()))], names=["image_id", "y", "x", "fraction"])

    return over_regions(tiles.select(*_OWN), need, need, work, "image_id string, y int, x int, fraction double")
