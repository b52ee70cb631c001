"""The merge forest against peaks of whole grids."""

import numpy as np
import pytest

from fragmatch.operators import hough, peaks
from fragmatch.plans import engine
from fragmatch.sources.rasters import from_array

CELL = "g string, x int, y int, weight double"


def whole(grid):
    """All peaks of a grid with a rim of ground, by their places in the grid."""
    padded = np.pad(grid, 1)
    got = [(a - 1, b - 1, p) for a, b, w, p in hough.superlevel_peaks(padded) if w > 0 and p > 0]
    return got


def told(df):
    return sorted((r["x"], r["y"], r["persistence"]) for r in df.collect())


@pytest.mark.parametrize("density,levels,side", [(0.6, None, 8), (0.9, None, 16), (0.25, None, 5), (1.0, 6, 8), (0.7, 3, 4)])
def test_random_grids(spark, density, levels, side):
    r = np.random.RandomState(int(density * 100))
    grids = {}
    for g in ("p", "q"):
        v = r.rand(61, 50) * 10
        v = np.ceil(v / 10 * levels) if levels else v
        grids[g] = np.where(r.rand(61, 50) < density, v, 0.0)
    rows = [(g, int(x) - 20, int(y) + 7, float(v[x, y])) for g, v in grids.items() for x, y in zip(*np.nonzero(v))]
    df = spark.createDataFrame(rows, CELL).repartition(8)
    found = peaks.persistent(df, side)
    for g, v in grids.items():
        want = [(a - 20, b + 7, p) for a, b, p in whole(v)]
        got = told(found.where(found["g"] == g))
        plain = lambda rows: sorted(round(p, 9) for *_, p in rows if p > 0)
        assert plain(got) == plain(want) and len(plain(want)) > 20
        if levels is None:  # heights differ, so that places are known
            assert np.allclose(np.array(sorted(want)), np.array([x for x in got if x[2] > 0]))
        else:
            assert got == told(peaks.persistent(df.where(df["g"] == g), 1000))  # ties, by tiles or not


def test_saddles_along_tile_edges_and_rings(spark):
    # a ring of 5 around a pit, two towers on it, one tower alone, all across tiles of 4
    rows = [("a", x, y, 5.0) for x in range(12) for y in range(12) if x in (0, 11) or y in (0, 11)]
    rows = [(g, x, y, 9.0 if (x, y) == (3, 0) else 8.0 if (x, y) == (11, 8) else w) for g, x, y, w in rows] + [("a", 5, 5, 3.0)]
    got = [p for *_, p in told(peaks.persistent(spark.createDataFrame(rows, CELL), 4)) if p > 0]
    assert sorted(got) == [3.0, 3.0, 9.0]


def test_ranked_by_plane_and_cut(spark):
    rows = [("a", 3 * k, 0, float(k + 1)) for k in range(40)] + [("b", 0, 0, 2.0), ("b", 50, 50, 2.0), ("b", 90, 0, 1.0)]
    df = spark.createDataFrame(rows, CELL)
    got = peaks.strongest(peaks.persistent(df, 8), df, 2.0, 5).collect()
    assert sorted((r["peak"], r["persistence"]) for r in got if r["g"] == "a") == [(k, 40.0 - k) for k in range(5)]
    assert sorted((r["peak"], r["x"], r["y"]) for r in got if r["g"] == "b") == [(0, 0, 0), (1, 50, 50)]
    assert peaks.persistent(df.where("false"), 8).count() == 0


def test_a_plane_wider_than_any_tile(spark):
    df = spark.createDataFrame([("a", k, 0, 1.0 + (k % 7 == 0)) for k in range(700)] + [("a", 2_000_000_000, -2_000_000_000, 4.0)], CELL)
    got = [p for *_, p in told(peaks.persistent(df, 16)) if p > 0]
    assert sorted(got) == [1.0] * 99 + [2.0, 4.0]


def test_bayes_peaks_belong_to_their_source_image(spark):
    from fragmatch.config import Config

    r = np.random.RandomState(9)
    target = r.rand(44, 40, 3) * 0.8
    sources = {"one": target[5:17, 8:20], "two": target[20:32, 3:15], "none": r.rand(12, 12, 3)}
    result = engine.match_bayes(from_array(spark, sources), from_array(spark, {"t": target}), Config(), sizes=(4,), k=2, distance=0.2)
    found = {}
    for p in result.hypotheses.collect():
        found.setdefault(p["src_image"], []).append((p["peak"], p["dx"], p["dy"]))
    assert found["one"][0] == (0, 8.0, 4.0) or found["one"][0] == (0, 8.0, 6.0)
    best = {}
    for m in result.matches.collect():
        best.setdefault(m["src_image"], []).append((m["tgt_x"] - m["src_x"], m["tgt_y"] - m["src_y"]))
    near = lambda ms, dx, dy: np.mean([abs(a - dx) <= 1 and abs(b - dy) <= 1 for a, b in ms])
    assert near(best["one"], 8, 5) > 0.9 and near(best["two"], 3, 20) > 0.9 and len(best["one"]) >= 60
