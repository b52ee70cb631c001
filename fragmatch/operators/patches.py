"""Exploding images into patches, with the entropy filter inside the same pass."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmatch.functions import kernels as K

PATCH = "image_id string, patch_idx int, x int, y int, patch array<double>, entropy double"


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column."""
    rows = np.ascontiguousarray(rows.reshape(len(rows), -1), np.float64)
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width, pa.int32()), pa.array(rows.ravel()))


def stack(column: pa.Array, *shape: int) -> np.ndarray:
    """An Arrow list column as one array of (rows, *shape)."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), *shape)


#: Windows that are described at once, of as many images as they come from.
WINDOWS = 4096
#: Of these, a kernel gets so many at a time: what it makes on the way then stays in the processor's cache.
KERNEL_ROWS = 512
_RASTER = ("image_id", "height", "width", "pixels")
_TEXT = ("image_id", "width", "text")
_TEXT_PART = 1 << 20


def _own(images: DataFrame) -> tuple[str, ...]:
    return _TEXT if "text" in images.columns else _RASTER


def _size(batch: pa.RecordBatch, k: int) -> tuple[int, int, object]:
    """Height, width and content of an image: its pixels, or its text; height 0 if there is none."""
    if "text" not in batch.schema.names:
        h, w, pixels = batch["height"][k].as_py(), batch["width"][k].as_py(), batch["pixels"][k]
        return (h, w, pixels.values.to_numpy(zero_copy_only=False).reshape(h, w, 3)) if h and w and pixels.is_valid else (0, 0, None)
    text, w = batch["text"][k].as_py() or "", batch["width"][k].as_py()
    return -(-len(text) // (3 * w)), w, text


def text_rows(text: str, width: int, lo: int, hi: int) -> np.ndarray:
    """Rows ``lo`` to ``hi`` of a text's image, (rows, width, 3); what lacks at the end is 0."""
    n = hi - lo
    v = np.zeros(n * width * 3)
    part = text[lo * width * 3 : hi * width * 3].encode("utf-32-le", "surrogatepass")
    for at in range(0, len(part), _TEXT_PART):
        some = np.frombuffer(part[at : at + _TEXT_PART], np.uint32) % 256 / 255.0
        v[at // 4 : at // 4 + len(some)] = some
    return v.reshape(n, width, 3)


def _rows(content, width: int, lo: int, hi: int) -> np.ndarray:
    return text_rows(content, width, lo, hi) if isinstance(content, str) else content[lo:hi]


def _cut(height: int, width: int, rows, size: int, stride: int):
    """(first number, windows, xy) in row-major order, some rows of windows at a time; ``rows(lo, hi)`` gives pixel rows."""
    if height < size or width < size:
        return
    across = (width - size) // stride + 1
    step = max(1, WINDOWS // across) * stride
    for top in range(0, height - size + 1, step):
        part, xy = K.windows(rows(top, min(height, top + step - stride + size)), size, stride)
        xy[:, 1] += top
        yield top // stride * across, part, xy


def _exploded(images: DataFrame, size: int, stride: int, entropy_threshold: float | None, kernel, columns, levels, level_columns: tuple[str, ...] = (), sift=None) -> DataFrame:
    """Windows of the images that ``levels(height, width, content)`` makes of each, as (values of ``level_columns``, height, width, rows)."""
    own = _own(images)
    more = [c for c in images.columns if c not in own]
    types = {"image_id": "string", "patch_idx": "int", "x": "int", "y": "int", "patch": "array<double>", "entropy": "double", "level": "int", "scale": "double"}
    types |= {f.name: f.dataType.simpleString() for f in images.select(*more).schema} | ({"descriptor": "array<double>"} if kernel else {})
    names = ["image_id", "patch_idx", "x", "y", "patch", "entropy", *level_columns, *more, *(["descriptor"] if kernel else [])]
    names = [c for c in names if columns is None or c in columns]

    def told(batch, held, wanted):
        part = np.concatenate([h[3] for h in held])
        e = K.entropy(part) if entropy_threshold is not None or "entropy" in names else None
        each = [len(h[3]) for h in held]
        keep = np.flatnonzero(e > entropy_threshold) if entropy_threshold is not None else None
        if keep is not None and not len(keep):
            return
        some = (lambda v: v) if keep is None else (lambda v: v[keep])
        xy = np.concatenate([h[4] for h in held])
        part = some(part)
        described = (lambda: np.concatenate([kernel(part[k : k + KERNEL_ROWS]) for k in range(0, len(part), KERNEL_ROWS)])) if kernel else None
        if wanted:
            vectors = described()
            near = np.flatnonzero(wanted(vectors))
            if not len(near):
                return
            keep, part, vectors = near if keep is None else keep[near], part[near], vectors[near]
            some, described = (lambda v: v[keep]), (lambda: vectors)
        out = {"patch_idx": lambda: some(np.concatenate([h[2] + np.arange(n) for h, n in zip(held, each)])).astype(np.int32), "x": lambda: some(xy[:, 0]).copy(), "y": lambda: some(xy[:, 1]).copy(), "patch": lambda: lists(part), "entropy": lambda: some(e)}
        out |= {c: (lambda k=k: some(np.repeat([h[1][k] for h in held], each))) for k, c in enumerate(level_columns)}
        out |= {"descriptor": lambda: lists(described())}
        rows = pa.array(some(np.repeat([h[0] for h in held], each)))
        out |= {c: (lambda c=c: batch[c].take(rows)) for c in ("image_id", *more)}
        made = {c: out[c]() for c in names}
        arrow = {"level": pa.int32()}
        yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, arrow.get(c)) for c, v in made.items()], names=names)

    def run(batches):
        wanted = sift() if sift else None
        for batch in batches:
            held, n, content = [], 0, None
            for k in range(batch.num_rows):
                height, width, content = _size(batch, k)
                if not height:
                    continue
                for level, h, w, rows in levels(height, width, content):
                    for first, part, xy in _cut(h, w, rows, size, stride):
                        held.append((k, level, first, part, xy))
                        n += len(part)
                        if n >= WINDOWS:
                            yield from told(batch, held, wanted)
                            held, n = [], 0
            if held:
                yield from told(batch, held, wanted)
            del batch, held, content  # or they would be kept while the next batch is read

    return images.select(*own, *more).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names))


def explode(images: DataFrame, size: int, stride: int = 1, entropy_threshold: float | None = None, kernel=None, columns: tuple[str, ...] | None = None, sift=None) -> DataFrame:
    """One row per ``size`` x ``size`` window, in row-major order, as ``PATCH``.

    ``images`` are rasters, or texts as images (``sources.rasters.text_images``), which
    are decoded some rows at a time. Windows whose entropy is not above the
    threshold are dropped before they leave the kernel. ``patch_idx`` counts all
    windows, kept or not. Images smaller than a window, and null ones, give no
    rows. Further columns of ``images`` pass with each of its patches. With a
    ``kernel`` (see ``describe``) patches are described in the same pass, and come
    with a column ``descriptor``. ``columns`` names those that are asked for.
    ``sift`` makes for each task a function from descriptors to which of their
    windows are wanted (see ``knn.sift``); others don't leave the kernel either.
    """
    whole = lambda height, width, content: [((), height, width, lambda lo, hi: _rows(content, width, lo, hi))]
    return _exploded(images, size, stride, entropy_threshold, kernel, columns, whole, sift=sift)


def describe(patches: DataFrame, kernel, size: int | None = None, column: str = "descriptor") -> DataFrame:
    """``patches`` with what ``kernel`` makes of (N, size, size, 3) batches, a row for each; without ``size`` patches tell it, which are then of one size.

    ``kernel`` is any function from such a batch to (N, dims): the extension
    point for descriptors of one's own.
    """
    keep, own = [c for c in patches.columns if c != column], size

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                size = own or math.isqrt(len(part["patch"][0]) // 3)
                yield pa.RecordBatch.from_arrays([*part.columns, lists(kernel(stack(part["patch"], size, size, 3)))], names=[*keep, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patches.select(*keep).schema)
    return patches.select(*keep).mapInArrow(run, f"{schema}, {column} array<double>")


def _levels(scales: list[float], min_size: int):
    """An image's levels as ((level, scale), height, width, rows), one held at a time."""

    def levels(height: int, width: int, content):
        image = _rows(content, width, 0, height)
        for level, scale in enumerate(scales):
            h, w = int(height * scale), int(width * scale)
            if h < min_size or w < min_size:
                continue
            made = image if scale == 1.0 else K.resize(np.clip(image * 255, 0, 255).astype(np.uint8), h, w) / 255.0
            yield (level, float(scale)), h, w, lambda lo, hi, made=made: made[lo:hi]

    return levels


def pyramid(images: DataFrame, scales: list[float], min_size: int = 16) -> DataFrame:
    """``images`` at each scale, with ``level`` and ``scale``; too small levels are skipped.

    Sides are int(side * scale). Scales other than 1 are resampled by Lanczos
    filtering of 8-bit values. ``level`` is a scale's place in the list.
    """
    levels = _levels(scales, min_size)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                height, width, content = _size(batch, k)
                for (level, scale), h, w, rows in levels(height, width, content) if height else ():
                    types = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.float64())
                    row = (batch["image_id"][k].as_py(), h, w, rows(0, h).ravel(), level, scale)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["image_id", "height", "width", "pixels", "level", "scale"])

    return images.select(*_own(images)).mapInArrow(run, "image_id string, height int, width int, pixels array<double>, level int, scale double")


def pyramid_patches(images: DataFrame, size: int, scales: list[float], stride: int = 1, min_size: int = 16, entropy_threshold: float | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Patches of all levels, with coordinates in the original image (halves to even); an image's levels are made and cut in one pass."""
    keep = None if columns is None else (*columns, "x", "y", "scale")
    rows = _exploded(images.select(*_own(images)), size, stride, entropy_threshold, None, keep, _levels(scales, min_size), ("level", "scale"))
    return rows.withColumn("orig_x", F.bround(F.col("x") / F.col("scale")).cast("int")).withColumn("orig_y", F.bround(F.col("y") / F.col("scale")).cast("int"))
