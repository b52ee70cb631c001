"""Geometric verification of point matches: ratio test, partial-affine RANSAC, hull of the inliers.

Minimal samples are drawn by hashes of the matches, so that they are the same for
any partitioning. Hypotheses of a pair of images meet its matches in tasks that
hold the hypotheses and stream the matches; a pair with very many matches is
dealt to several tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmatch.operators.patches import lists, stack
from fragmatch.plans.scratch import drop, save

RATIO = 0.75
TRIALS = 256
TOLERANCE = 3.0
MIN_INLIERS = 4
#: Inliers farther than so many times their root mean square residual are left out of the last fit.
OUTLYING = 3.0
#: Matches of one task that meet a pair's hypotheses.
PART_ROWS = 65536
_POINT = ("sx", "sy", "tx", "ty")
_MODEL = ("a", "b", "c", "d")  # (x, y) goes to (a x - b y + c, b x + a y + d)


def ratio_test(hits: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(q, t, dist) of rows (q, rank, t, dist): nearest targets that are nearer than ``ratio`` times the second.

    ``dist`` is squared. Queries with one target only are left out. One aggregation, no sort.
    """
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    two = hits.where("rank <= 2").groupBy("q").agg(at(1, "t").alias("t"), at(1, "dist").alias("dist"), at(2, "dist").alias("second"))
    return two.where(F.col("dist") < F.col("second") * F.lit(ratio * ratio)).select("q", "t", "dist")


def _hypotheses(points: DataFrame, pairs: DataFrame, trials: int, seed: int) -> DataFrame:
    """(pair, h, a, b, c, d): transforms through two matches each.

    A match stands for so many trials, by hashes, that a trial has some four to
    choose from; of these the two with the smallest hashes are taken. Of pairs
    with very many matches, hashes choose those that stand for one.
    """
    row = points.join(pairs.select(F.col("pair").alias("_p"), "n"), F.col("pair") == F.col("_p"))
    unit = F.shiftrightunsigned(F.xxhash64(*_POINT, F.lit(seed)), 11) / F.lit(float(1 << 53))
    times = F.ceil(F.lit(4.0 * trials) / F.col("n")).cast("int")
    some = row.where(unit < F.lit(4.0 * trials) / F.col("n")).withColumn("j", F.explode(F.sequence(F.lit(1), times)))
    hashed = some.withColumn("h", F.pmod(F.xxhash64(*_POINT, "j", F.lit(seed + 1)), F.lit(trials)).cast("int")).withColumn("k", F.xxhash64(*_POINT, "j", F.lit(seed + 2)))
    lots = hashed.groupBy("pair", "h").agg(F.sort_array(F.collect_set(F.struct("k", *_POINT))).alias("lot")).where(F.size("lot") >= 2)  # equal matches are one
    p, q = F.col("lot")[0], F.col("lot")[1]
    dx, dy, ex, ey = q["sx"] - p["sx"], q["sy"] - p["sy"], q["tx"] - p["tx"], q["ty"] - p["ty"]
    n = dx * dx + dy * dy
    two = lots.select("pair", "h", p.alias("p"), dx.alias("dx"), dy.alias("dy"), ex.alias("ex"), ey.alias("ey"), n.alias("n")).where("n > 0 and ex * ex + ey * ey > 0")
    two = two.withColumn("a", (F.col("ex") * F.col("dx") + F.col("ey") * F.col("dy")) / F.col("n")).withColumn("b", (F.col("ey") * F.col("dx") - F.col("ex") * F.col("dy")) / F.col("n"))
    return two.select("pair", "h", "a", "b", (F.col("p.tx") - F.col("a") * F.col("p.sx") + F.col("b") * F.col("p.sy")).alias("c"), (F.col("p.ty") - F.col("b") * F.col("p.sx") - F.col("a") * F.col("p.sy")).alias("d"))


def _score(trials: int, tolerance: float):
    """Rows (pair, part, role, v) with a pair's hypotheses (role 0) before its matches, to inliers by hypothesis."""

    def run(batches):
        now, models, count = None, None, None

        def told():
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), lists(count[None].astype(float))], names=["pair", "counts"])

        for batch in batches:
            pair, part, role = (batch[c].to_numpy() for c in ("pair", "part", "role"))
            change = np.flatnonzero((pair[1:] != pair[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(pair)]):
                if lo == hi:
                    continue
                if (pair[lo], part[lo]) != now:
                    if models is not None:
                        yield told()
                    now, models, count = (pair[lo], part[lo]), np.full((trials, 4), np.nan), np.zeros(trials, np.int64)
                v = stack(batch.slice(lo, hi - lo)["v"], 5)
                if role[lo] == 0:
                    models[v[:, 0].astype(int)] = v[:, 1:]
                    continue
                for at in range(0, len(v), 4096):
                    sx, sy, tx, ty = v[at : at + 4096, 1:, None].transpose(1, 0, 2)
                    a, b, c, d = models.T
                    far = (a * sx - b * sy + c - tx) ** 2 + (b * sx + a * sy + d - ty) ** 2
                    count += (far <= tolerance * tolerance).sum(axis=0)
        if models is not None:
            yield told()

    return run


def similarity(matches: DataFrame, by: list[str], trials: int = TRIALS, tolerance: float = TOLERANCE, min_inliers: int = MIN_INLIERS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(by, a, b, c, d, inliers, matches) per pair of images, and its inlying matches.

    ``matches`` has the columns ``by`` and sx, sy, tx, ty; rows with nulls are
    left out. The transform with the most matches within ``tolerance`` (ties:
    the smallest trial) is fitted again to these by least squares, once more without those of them
    that are ``OUTLYING``, and matches within the tolerance of that are the inliers. Pairs with fewer than
    ``min_inliers`` have no row. The second table has the columns of ``matches``.
    """
    # names of our own for ``by``, which may have any, that of the pair's number too
    key = [f"_by{k}" for k in range(len(by))]
    named = [F.col(k).alias(c) for k, c in zip(key, by)]
    points = matches.select(*[F.col(c).alias(k) for k, c in zip(key, by)], *[F.col(c).cast("double").alias(c) for c in _POINT]).na.drop()
    pairs = save(points.groupBy(*key).agg(F.count("*").alias("n")).withColumn("pair", F.monotonically_increasing_id()))
    given = save(points.join(pairs, key).select("pair", *_POINT))
    found = save(_hypotheses(given, pairs, trials, seed))
    parts = pairs.select("pair", F.ceil(F.col("n") / F.lit(PART_ROWS)).alias("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    held = found.join(parts, "pair").select("pair", every.alias("part"), F.lit(0).alias("role"), F.array(F.col("h").cast("double"), *_MODEL).alias("v"))
    sent = given.join(parts, "pair").select("pair", F.pmod(F.xxhash64(*_POINT), F.col("parts")).alias("part"), F.lit(1).alias("role"), F.array(F.lit(0.0), *_POINT).alias("v"))
    dealt = held.unionAll(sent).repartition("pair", "part").sortWithinPartitions("pair", "part", "role")
    votes = dealt.mapInArrow(_score(trials, tolerance), "pair long, counts array<double>").select("pair", F.posexplode("counts").alias("h", "s")).groupBy("pair", "h").agg(F.sum("s").alias("s"))
    best = votes.groupBy("pair").agg(F.max(F.struct("s", (-F.col("h")).alias("h"))).alias("best")).select("pair", (-F.col("best.h")).alias("h"))
    first = save(found.join(best, ["pair", "h"]).select("pair", *_MODEL))

    def inlying(models: DataFrame) -> DataFrame:
        far = (F.expr("a * sx - b * sy + c - tx") ** 2) + (F.expr("b * sx + a * sy + d - ty") ** 2)
        return given.join(models, "pair").where(far <= tolerance * tolerance)

    def fitted(near: DataFrame) -> DataFrame:
        # least squares by sums of deviations from the means, which are small
        near = near.select("pair", *_POINT)
        m = near.groupBy("pair").agg(*[F.avg(c).alias(f"m{c}") for c in _POINT])
        x, y, u, v = (F.col(c) - F.col(f"m{c}") for c in _POINT)
        sums = near.join(m, "pair").groupBy("pair").agg(F.sum(x * x + y * y).alias("n"), F.sum(x * u + y * v).alias("p"), F.sum(x * v - y * u).alias("q"), *[F.first(f"m{c}").alias(f"m{c}") for c in _POINT]).where("n > 0")
        made = sums.select("pair", (F.col("p") / F.col("n")).alias("a"), (F.col("q") / F.col("n")).alias("b"), *[f"m{c}" for c in _POINT])
        return made.select("pair", "a", "b", F.expr("mtx - a * msx + b * msy").alias("c"), F.expr("mty - b * msx - a * msy").alias("d"))

    near = save(inlying(first).select("pair", *_POINT))
    rough = save(fitted(near))
    r2 = (F.expr("a * sx - b * sy + c - tx") ** 2) + (F.expr("b * sx + a * sy + d - ty") ** 2)
    off = near.join(rough, "pair").withColumn("r2", r2)
    # what is near by chance stands out from the others' residuals
    cut = off.groupBy("pair").agg((F.avg("r2") * F.lit(OUTLYING**2)).alias("cut"))
    again = save(fitted(off.join(cut, "pair").where("r2 <= cut")))
    kept = save(inlying(again).drop(*_MODEL))
    drop(found, first, near, rough)
    counted = kept.groupBy("pair").agg(F.count("*").alias("inliers")).where(F.col("inliers") >= min_inliers)
    models = pairs.join(again, "pair").join(counted, "pair")
    inliers = kept.join(models.select("pair", *key), "pair").select(*named, *_POINT)
    return models.select(*named, *_MODEL, "inliers", F.col("n").alias("matches")), inliers


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Corners of the hull of integer points, counter-clockwise from the smallest; fewer than three if they lie on a line."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    rows = p.tolist()
    return np.array(half(rows) + half(rows[::-1]))


def _hulls(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = convex_hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(corners) for k in keys} | {"x": corners[:, 0], "y": corners[:, 1]})

    return run


def hull(points: DataFrame, by: list[str], x: str = "tx", y: str = "ty") -> DataFrame:
    """(by, x, y): corners of the convex hull of each group's points, cut to whole numbers.

    Hulls of parts first, dealt by a hash, then the hull of their corners: a
    group's points are never in one task, only its parts' corners are.
    """
    types = {f.name: f.dataType.simpleString() for f in points.schema}
    kind = ", ".join(f"`{k}` {types[k]}" for k in by) + ", x long, y long"
    rows = points.select(*by, F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).distinct()
    part = rows.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(64)))
    corners = part.groupBy(*by, "_part").applyInPandas(_hulls(by), kind)
    return corners.groupBy(*by).applyInPandas(_hulls(by), kind)


def fill(corners: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, x): the pixels in and on each hull, row by row."""
    types = {f.name: f.dataType.simpleString() for f in corners.schema}
    kind = ", ".join(f"`{k}` {types[k]}" for k in by) + ", y long, x0 long, x1 long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = convex_hull(pdf[["x", "y"]].to_numpy())
        low, high = {}, {}
        for (x0, y0), (x1, y1) in zip(p.tolist(), np.roll(p, -1, axis=0).tolist()):
            (x0, y0), (x1, y1) = sorted(((x0, y0), (x1, y1)), key=lambda q: q[1])
            rise = y1 - y0
            for y in range(y0, y1 + 1):  # whole-number arithmetic: floor and ceiling are exact
                up, down = (x0 * rise + (x1 - x0) * (y - y0), rise) if rise else (0, 0)
                ends = (-(-up // down), up // down) if rise else (min(x0, x1), max(x0, x1))
                low[y], high[y] = min(low.get(y, ends[0]), ends[0]), max(high.get(y, ends[1]), ends[1])
        ys = sorted(low)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(ys) for k in by} | {"y": ys, "x0": [low[y] for y in ys], "x1": [high[y] for y in ys]})

    rows = corners.groupBy(*by).applyInPandas(run, kind).where("x0 <= x1")
    return rows.select(*by, "y", F.explode(F.sequence("x0", "x1")).alias("x"))
