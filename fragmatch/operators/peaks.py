"""Persistent peaks of a sparse plane by a forest that is merged from tile to tile.

Cells of positive weight stand on a ground of 0. From the highest down, cells
join the parts next to them, and where parts meet, the younger peak ends (elder
rule): its persistence is its height above that saddle. A tile settles what it
can: a part that does not reach the tile's edge is the same in the whole plane,
and so is the saddle at which it ends. What reaches the edge is passed on as a
forest: edge cells, peaks, and the saddles between them. Sixteen tiles'
forests make the next tile, until one is left. No task holds a plane; it
holds a tile's cells, or the edges of sixteen tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmatch.plans.scratch import drop, save

SIDE = 128
GROW = 4
PEAK, NODE, SADDLE = 0, 1, 2
_CELLS = [f"{c}{k}" for k in "abs" for c in "xyw"]  # a peak or node; the other end; the saddle


def _before(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places from the highest cell down; ties by x, then y."""
    return np.lexsort((y, x, -w))


def settle(nodes: np.ndarray, saddles: np.ndarray, side: int | None) -> tuple[list, list, list]:
    """(peaks, nodes, saddles): what is final, and the forest that is passed on.

    ``nodes`` are rows (x, y, weight), each cell once; ``saddles`` rows of two
    cells and the saddle (each x, y, weight). ``side`` is that of the tile, whose
    edge cells stay open; without it nothing does. Peaks come with their
    persistence.
    """
    x, y, w = nodes.T
    rank = np.empty(len(nodes), int)
    order = _before(w, x, y)
    rank[order] = np.arange(len(nodes))
    place = {(a, b): k for k, (a, b) in enumerate(zip(x.tolist(), y.tolist()))}
    edge = np.zeros(len(nodes), bool) if side is None else (x % side == 0) | (y % side == 0) | (x % side == side - 1) | (y % side == side - 1)
    up, open_ = list(range(len(nodes))), edge.tolist()  # roots are the parts' peaks

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    final, kept, rest = [], set(np.flatnonzero(edge).tolist()), []
    ends = [[place[p] for p in zip(saddles[:, 3 * k].tolist(), saddles[:, 3 * k + 1].tolist())] for k in (0, 1)]
    sx, sy, sw = saddles[:, 6], saddles[:, 7], saddles[:, 8]
    for e in _before(sw, sx, sy).tolist():
        p, q = find(ends[0][e]), find(ends[1][e])
        if p == q:
            continue
        old, young = (p, q) if rank[p] < rank[q] else (q, p)
        if open_[young]:
            kept |= {old, young}
            rest.append((*nodes[young], *nodes[old], sx[e], sy[e], sw[e]))
            open_[old] = True
        elif (x[young], y[young]) != (sx[e], sy[e]):  # a cell that begins here is no peak
            final.append((x[young], y[young], w[young] - sw[e]))
        up[young] = old
    for k in range(len(nodes)):
        if up[k] == k and not open_[k]:
            final.append((x[k], y[k], w[k]))  # down to the ground
    return final, [tuple(nodes[k]) for k in sorted(kept)], rest


def _rows(g, final, nodes, saddles) -> pd.DataFrame:
    none = (np.nan,) * 3
    rows = [(PEAK, *p, *none, *none) for p in final] + [(NODE, *n, *none, *none) for n in nodes] + [(SADDLE, *s) for s in saddles]
    out = pd.DataFrame(rows, columns=["kind", *_CELLS])
    out.insert(0, "g", [g] * len(out))
    return out.astype({"kind": "int32"})


def _touching(x: np.ndarray, y: np.ndarray, w: np.ndarray, side: int | None) -> np.ndarray:
    """Saddles between cells next to each other, those in different tiles of ``side`` only if it is given: the lower cell, of equal ones the later."""
    place = {(a, b): k for k, (a, b) in enumerate(zip(x.tolist(), y.tolist()))}
    pairs = [(k, place[n]) for (a, b), k in place.items() for n in ((a + 1, b), (a, b + 1)) if n in place]
    if not pairs:
        return np.zeros((0, 9))
    i, j = np.array(pairs).T
    if side is not None:
        apart = (x[i] // side != x[j] // side) | (y[i] // side != y[j] // side)
        i, j = i[apart], j[apart]
    cell = np.stack([x, y, w], axis=1)
    rank = np.empty(len(x), int)
    rank[_before(w, x, y)] = np.arange(len(x))
    low = np.where(rank[i] > rank[j], i, j)
    return np.concatenate([cell[i], cell[j], cell[low]], axis=1)


def persistent(plane: DataFrame, side: int = SIDE) -> DataFrame:
    """(g, x, y, persistence): all peaks of rows (g, x, y, weight), each cell once and of positive weight.

    ``g`` names planes that have nothing to do with each other. The result reads
    saved tables.
    """
    kind = plane.schema["g"].dataType.simpleString()
    schema = f"g {kind}, kind int, " + ", ".join(f"{c} double" for c in _CELLS)
    low = plane.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("mx"), F.max("y").alias("my")).first()
    if low["x"] is None:
        return plane.select("g", "x", "y", F.lit(0.0).alias("persistence")).limit(0)
    reach = max(low["mx"] - low["x"], low["my"] - low["y"]) + 1
    cells = plane.select("g", *[(F.col(c) - low[c]).cast("double").alias(c) for c in "xy"], F.col("weight").cast("double").alias("w"))
    tile = lambda c, s: F.floor(F.col(c) / s).cast("long")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (pdf[c].to_numpy() for c in ("x", "y", "w"))
        last = side >= reach
        return _rows(pdf["g"].iloc[0], *settle(np.stack([x, y, w], axis=1), _touching(x, y, w, None), None if last else side))

    def later(now: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            nodes = pdf[pdf["kind"] == NODE][_CELLS[:3]].to_numpy()
            known = pdf[pdf["kind"] == SADDLE][_CELLS].to_numpy()
            saddles = np.concatenate([known, _touching(*nodes.T, now)])
            return _rows(pdf["g"].iloc[0], *settle(nodes, saddles, None if now * GROW >= reach else now * GROW))

        return run

    state = save(cells.groupBy("g", tile("x", side).alias("tx"), tile("y", side).alias("ty")).applyInPandas(first, schema))
    done = [state]
    while side < reach:
        open_ = done[-1].where(F.col("kind") != PEAK)
        wide = side * GROW
        done.append(save(open_.groupBy("g", tile("xa", wide).alias("tx"), tile("ya", wide).alias("ty")).applyInPandas(later(side), schema)))
        side = wide
    out = None
    for part in done:
        mine = part.where(F.col("kind") == PEAK).select("g", "xa", "ya", "wa")
        out = mine if out is None else out.unionAll(mine)
    types = {c: plane.schema[c].dataType.simpleString() for c in "xy"}
    return out.select("g", *[(F.col(f"{c}a") + low[c]).cast(types[c]).alias(c) for c in "xy"], F.col("wa").alias("persistence"))


def strongest(found: DataFrame, plane: DataFrame, floor: float, most: int) -> DataFrame:
    """(g, peak, x, y, persistence): the peaks at ``floor`` or above, at most ``most`` of each plane, numbered from 0 by persistence.

    Ties go to the higher peak, then by x and y. Every task keeps no more than ``most`` a plane before rows meet.
    """
    rows = found.where(F.col("persistence") >= floor).join(plane.select("g", "x", "y", "weight"), ["g", "x", "y"])
    number = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("persistence"), F.desc("weight"), "x", "y"))
    return rows.withColumn("peak", number).where(F.col("peak") <= most).select("g", (F.col("peak") - 1).cast("int").alias("peak"), "x", "y", "persistence")
