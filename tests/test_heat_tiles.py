"""Blur, hot regions, components and localisation in tiles of 64 pixels against whole grids."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmatch.functions import kernels as K
from fragmatch.operators import heatmap

SIZES = {"a": (150, 200), "b": (64, 64), "c": (5, 300), "d": (70, 3), "none": (20, 20)}


@pytest.fixture(scope="module")
def values(spark):
    r = np.random.RandomState(0)
    rows = [(i, int(y), int(x), float(v)) for i, (h, w) in SIZES.items() if i != "none" for y, x, v in [(p // w, p % w, r.rand()) for p in r.choice(h * w, h * w // 40, False)]]
    rows += [("a", 63, 63, 0.9), ("a", 64, 64, 0.8), ("a", 0, 0, 1.0), ("a", 149, 199, 1.0)]
    rows = list({(i, y, x): (i, y, x, v) for i, y, x, v in rows}.values())
    return spark.createDataFrame(rows, "image_id string, y int, x int, value double")


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame([(i, h, w) for i, (h, w) in SIZES.items()], "image_id string, height int, width int")


def dense(values):
    out = {i: np.zeros(s) for i, s in SIZES.items()}
    for r in values.collect():
        out[r["image_id"]][r["y"], r["x"]] = r["value"]
    return out


def plain(grid, sigma):
    """Every pixel's weighted sum of its surroundings, mirrored with the edge pixel."""
    n = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    padded = np.pad(grid, n, "symmetric")
    two = np.outer(k, k) / k.sum() ** 2
    return np.array([[(two * padded[y : y + 2 * n + 1, x : x + 2 * n + 1]).sum() for x in range(grid.shape[1])] for y in range(grid.shape[0])])


def test_blur_by_tiles(values, sizes, sigma=2.0):
    want = {i: plain(g, sigma) for i, g in dense(values).items()}
    got = {i: np.zeros(s) for i, s in SIZES.items()}
    seen = 0
    for t in heatmap.smooth_tiles(values, sizes, sigma, 64).collect():
        got[t["image_id"]][t["y"] : t["y"] + t["h"], t["x"] : t["x"] + t["w"]] = np.array(t["heat"]).reshape(t["h"], t["w"])
        seen = max(seen, len(t["heat"]))
    assert seen <= 64 * 64
    for i in SIZES:
        assert np.allclose(got[i], want[i] / (want[i].max() or 1), atol=1e-12)
    whole = {r["image_id"]: np.array(r["heat"]).reshape(r["height"], r["width"]) for r in heatmap.smooth(values, sizes, sigma).collect()}
    assert whole.keys() == SIZES.keys() and all(np.allclose(whole[i], got[i], atol=1e-15) for i in SIZES)


def test_tiles_change_no_value(values, sizes):
    one = {r["image_id"]: r["heat"] for r in heatmap.smooth_tiles(values, sizes, 2.0, 512).collect()}
    for t in heatmap.smooth_tiles(values, sizes, 2.0, 64).collect():
        whole = np.array(one[t["image_id"]]).reshape(t["height"], t["width"])
        assert (whole[t["y"] : t["y"] + t["h"], t["x"] : t["x"] + t["w"]] == np.array(t["heat"]).reshape(t["h"], t["w"])).all()


def flood(mask, diagonal):
    """Components as lists of cells, by their first cell in row-major order."""
    out, seen = [], np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        seen[y, x], todo, cells = True, [(y, x)], []
        while todo:
            a, b = todo.pop()
            cells.append((int(a), int(b)))
            for p, q in itertools.product((-1, 0, 1), repeat=2):
                c = (a + p, b + q)
                if (diagonal or not (p and q)) and 0 <= c[0] < mask.shape[0] and 0 <= c[1] < mask.shape[1] and mask[c] and not seen[c]:
                    seen[c] = True
                    todo.append(c)
        out.append(sorted(cells))
    return out


def test_hot_regions_by_tiles(values, sizes):
    want, least, threshold = set(), 2, 0.2
    for i, g in dense(values).items():
        heat = plain(g, 2.0)
        for k, cells in enumerate(flood(heat / (heat.max() or 1) > threshold, False), 1):
            y, x = np.array(cells).T
            if len(cells) >= least:
                want.add((i, k, len(cells), x.min(), y.min(), np.ptp(x) + 1, np.ptp(y) + 1))
    cols = ("image_id", "region", "area", "x", "y", "w", "h")
    for side in (17, 64):
        assert {tuple(r[c] for c in cols) for r in heatmap.hot_regions(heatmap.smooth_tiles(values, sizes, 2.0, side), threshold, least).collect()} == want
    assert len(want) > 8


def spiral(n):
    """One path that winds through every tile, and a blob apart from it."""
    m = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    m[0, 0] = True
    turned = 0
    while turned < 2:
        a, b = y + dy, x + dx
        ahead = (a + dy, b + dx)
        free = 0 <= a < n and 0 <= b < n and not m[a, b] and not (0 <= ahead[0] < n and 0 <= ahead[1] < n and m[ahead])
        if free:
            y, x, turned = a, b, 0
            m[y, x] = True
        else:
            dy, dx, turned = dx, -dy, turned + 1
    return m


def test_largest_component_by_tiles(spark):
    r = np.random.RandomState(5)
    masks = {1: r.rand(130, 90) < 0.3, 2: r.rand(130, 90) < 0.45, 3: np.zeros((9, 9), bool), 4: spiral(60)}
    masks[3][[0, 0, 8, 8], [0, 1, 7, 8]] = True  # a tie
    rows = [(k, int(y) - 40, int(x) - 30, f"{y}") for k, m in masks.items() for y, x in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, "g int, y int, x int, note string")
    want = set()
    for k, m in masks.items():
        parts = flood(m, True)
        best = max(parts, key=len)  # the first of the largest
        want |= {(k, y - 40, x - 30, f"{y}") for y, x in best}
    for side in (64, 11):
        got = heatmap.largest_component(df, "g", side)
        assert got.columns == df.columns and {tuple(x) for x in got.collect()} == want
    assert heatmap.largest_component(df.where("false"), "g").count() == 0


def test_localize_and_no_values(spark, values, sizes):
    none = values.where("false")
    assert heatmap.hot_regions(heatmap.smooth_tiles(none, sizes)).count() == 0
    assert all(max(r["heat"]) == 0 for r in heatmap.smooth(none, sizes).collect())
    kind = "image_id string, src_x int, src_y int, patch_size int"
    m = spark.createDataFrame([("a", x, 60, 8) for x in range(40, 100, 8)] + [("a", 150, 10, 8)], kind)
    got = {r["image_id"]: r for r in heatmap.localize(m, sizes).collect()}
    assert (got["a"]["x"], got["a"]["y"], got["a"]["w"], got["a"]["h"], got["a"]["area"]) == (40, 60, 64, 8, 512) and got["b"]["area"] == 0


def test_blur_kernel_is_the_same_in_parts():
    r = np.random.RandomState(1)
    g = r.rand(3, 50)
    assert np.allclose(K.gaussian_blur(g, 2.0), plain(g, 2.0), atol=1e-12)  # mirrored more than once
    assert (K.gaussian_blur(g, 0) == g).all()
