"""Ratio test, RANSAC and hulls against planted transforms and brute force; logging."""

import io
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmatch import cli, log
from fragmatch.functions import exprs as X
from fragmatch.operators import geometry


def test_ratio(spark):
    rows = [(1, 1, 10, 0.5), (1, 2, 11, 1.0), (2, 1, 12, 0.56), (2, 2, 13, 1.0), (2, 3, 14, 1.1), (3, 1, 15, 0.1), (4, 1, 16, 0.5625), (4, 2, 17, 1.0)]
    df = spark.createDataFrame(rows, "q long, rank int, t long, dist double")
    assert {(x["q"], x["t"]) for x in geometry.ratio_test(df).collect()} == {(1, 10), (2, 12)}  # 3 has no second, 4 is at the ratio


TRUE = {"x": (1.2, 0.4, 30.0, -12.0), "y": (-0.7, 0.1, 400.0, 80.0), "hot": (0.9, -0.9, 5.0, 5.0)}


@pytest.fixture(scope="module")
def matches(spark):
    r = np.random.RandomState(0)
    rows = []
    for name, (a, b, c, d) in TRUE.items():
        n = 4000 if name == "hot" else 120
        s = r.rand(n, 2) * 300
        t = np.stack([a * s[:, 0] - b * s[:, 1] + c, b * s[:, 0] + a * s[:, 1] + d], axis=1) + 0.3 * r.randn(n, 2)
        out = r.rand(n) < 0.7
        t[out] = r.rand(out.sum(), 2) * 700 - 200
        rows += [(name, "t", *map(float, (*p, *q)), bool(o)) for p, q, o in zip(s, t, out)]
    rows += [("few", "t", 0.0, 0.0, 1.0, 1.0, True), ("few", "t", 9.0, 1.0, 10.0, 2.0, True), ("same", "t", *[5.0] * 4, True)] + [("same", "t", *[5.0] * 4, True)] * 8 + [("x", "t", None, 1.0, 1.0, 1.0, True)]
    return spark.createDataFrame(rows, "src_image string, image_id string, sx double, sy double, tx double, ty double, out boolean")


def test_planted_transforms_are_recovered(spark, matches, monkeypatch):
    monkeypatch.setattr(geometry, "PART_ROWS", 500)  # the hot pair is dealt to several tasks
    told = []
    for parts in (1, 7):
        models, inliers = geometry.similarity(matches.repartition(parts), ["src_image", "image_id"])
        told.append(sorted((x["src_image"], *(round(x[c], 9) for c in "abcd"), x["inliers"], x["matches"]) for x in models.collect()))
        count = {x["src_image"]: x["count"] for x in inliers.groupBy("src_image").count().collect()}
    assert told[0] == told[1]
    got = {x[0]: x for x in told[0]}
    assert got.keys() == TRUE.keys()  # two matches are too few, and equal ones say nothing
    corners = np.array([[0, 0], [300, 0], [0, 300], [300, 300]])
    for name, (a, b, c, d) in TRUE.items():
        at = lambda m: np.stack([m[0] * corners[:, 0] - m[1] * corners[:, 1] + m[2], m[1] * corners[:, 0] + m[0] * corners[:, 1] + m[3]], axis=1)
        assert np.abs(at(got[name][1:5]) - at((a, b, c, d))).max() < 1
        good = matches.where((F.col("src_image") == name) & ~F.col("out")).count()
        assert good <= got[name][5] == count[name] < good * 1.1 + 3


def test_no_matches(spark, matches):
    models, inliers = geometry.similarity(matches.where("false"), ["src_image", "image_id"])
    assert models.count() == inliers.count() == 0 and models.columns[:2] == ["src_image", "image_id"]


def test_hull_and_fill(spark):
    r = np.random.RandomState(1)
    groups = {1: r.randint(0, 40, (300, 2)), 2: np.array([[0, 0], [9, 3], [2, 7]]), 3: np.array([[1, 1], [4, 4], [2, 2]]), 4: np.array([[6, 6]]), 5: np.array([[-5, -5], [5, -5], [5, 5], [-5, 5], [0, 0]])}
    df = spark.createDataFrame([(g, float(x), float(y)) for g, p in groups.items() for x, y in p], "g int, tx double, ty double").repartition(5)
    corners = geometry.hull(df, ["g"])
    got = {}
    for x in geometry.fill(corners, ["g"]).collect():
        got.setdefault(x["g"], set()).add((x["x"], x["y"]))
    for g, p in groups.items():
        # in the hull: on the inner side of every line through two points that has all points on one side
        lines = [(q, s) for q in p for s in p if tuple(q) != tuple(s) and all((s[0] - q[0]) * (z[1] - q[1]) - (s[1] - q[1]) * (z[0] - q[0]) >= 0 for z in p)]
        box = [(x, y) for x in range(p[:, 0].min(), p[:, 0].max() + 1) for y in range(p[:, 1].min(), p[:, 1].max() + 1)]
        want = {(x, y) for x, y in box if all((s[0] - q[0]) * (y - q[1]) - (s[1] - q[1]) * (x - q[0]) >= 0 for q, s in lines)}
        assert got[g] == want
    assert corners.where("g = 5").count() == 4


def test_logging():
    out = io.StringIO()
    log.setup("info", stream=out)
    log.get("engine").info("one")
    log.get("engine").debug("two")
    log.setup("ERROR", "%(message)s", out)
    log.get("engine").info("three")
    log.get("engine").error("four")
    assert "fragmatch.engine - INFO - one" in out.getvalue() and "two" not in out.getvalue() and "three" not in out.getvalue() and out.getvalue().endswith("four\n")
    assert len(logging.getLogger("fragmatch").handlers) == 1
    with pytest.raises(ValueError):
        log.setup("loud")


def test_self_test_command():
    assert cli.main(["--log-level", "error", "test", "--only", "test_no_such_test_anywhere"]) == 5  # none collected
    with pytest.raises(SystemExit):
        cli.main(["--log-level", "loud", "version"])


def test_hellinger_distances(spark):
    r = np.random.RandomState(2)
    h = r.rand(5, 8) * 10
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(h)] + [(5, None), (6, [0.0, 0.0])], "id long, h array<double>").select("id", X.root_normalised("h").alias("v"))
    got = {x["id"]: x["v"] for x in rows.collect()}
    share = h / h.sum(axis=1, keepdims=True)
    for i in range(5):
        for j in range(5):
            assert np.sum((np.array(got[i]) - np.array(got[j])) ** 2) == pytest.approx(2 - 2 * np.sqrt(share[i] * share[j]).sum(), abs=1e-6)
    assert got[5] is None and got[6] == [0.0, 0.0]


def test_pairs_may_be_called_pair_and_have_any_number(spark):
    r = np.random.RandomState(7)
    rows = []
    for p in (-5, 3, 1 << 40):
        for x, y in r.randint(0, 500, (12, 2)).tolist():
            rows.append((p, float(x), float(y), x + p % 50, y - p % 30))
    df = spark.createDataFrame([(p, x, y, float(u), float(v)) for p, x, y, u, v in rows], "pair long, sx double, sy double, tx double, ty double").repartition(5)
    models, inliers = geometry.similarity(df, ["pair"])
    assert {(m["pair"], round(m["c"]), round(m["d"]), m["inliers"], m["matches"]) for m in models.collect()} == {(p, p % 50, -(p % 30), 12, 12) for p in (-5, 3, 1 << 40)}
    assert sorted(tuple(i) for i in inliers.select("pair", "sx", "sy").collect()) == sorted((p, x, y) for p, x, y, _, _ in rows)


def test_a_match_near_by_chance_does_not_move_the_fit(spark):
    r = np.random.RandomState(8)
    rows = [(1, float(x), float(y), 0.5 * x - 0.5 * y + 7, 0.5 * x + 0.5 * y - 9) for x, y in r.randint(0, 500, (60, 2)).tolist()]
    rows.append((1, 900.0, 900.0, 7 + 2.5, 900.0 - 9))  # 2.5 pixels off, and far out
    models, inliers = geometry.similarity(spark.createDataFrame(rows, "i long, sx double, sy double, tx double, ty double"), ["i"])
    m = models.first()
    assert np.allclose([m["a"], m["b"], m["c"], m["d"]], [0.5, 0.5, 7, -9], atol=1e-9) and m["inliers"] == inliers.count() == 61
