import importlib
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(str(x) for x in r) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


CORE = [n for n in entry.core.SQL]


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


@pytest.mark.parametrize("name", [n for n in entry.core.QUERIES if n not in entry.core.SQL and n not in ("match_chi2", "match_regions")])
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_heatmap_smooth_against_brute_force(spark, db):
    got = {tuple(r) for r in entry.queries()["heatmap_smooth"](spark, SF).select("image_id", "area", "x", "y", "w", "h").collect()}
    sql = entry.oracle_sql()["heatmap_raw"]
    points = db.sql(sql).df()
    assert len(points) > 1400  # of 1,500 orders, some on one pixel
    kernel = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    kernel = np.outer(kernel, kernel) / kernel.sum() ** 2
    want = set()
    for image, rows in points.groupby("image_id"):
        grid = np.zeros((2060, 2060))
        grid[rows["y"] + 1000, rows["x"] + 1000] = rows["value"]
        wide = np.pad(grid, 8, "symmetric")
        heat = np.zeros((2060 + 32, 2060 + 32))
        for y, x in zip(*np.nonzero(wide)):
            heat[y : y + 17, x : x + 17] += wide[y, x] * kernel
        heat = heat[16:-16, 16:-16]
        hot = set(zip(*(c.tolist() for c in np.nonzero(heat > 0.5 * heat.max()))))
        while hot:
            part, todo = set(), [hot.pop()]
            while todo:
                y, x = todo.pop()
                part.add((y, x))
                for near in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if near in hot:
                        hot.remove(near)
                        todo.append(near)
            if len(part) >= 9:
                ys, xs = zip(*part)
                want.add((image, len(part), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    assert got == want and len({w[0] for w in want}) == 5


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_llm_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("fragmatch.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("fragmatch.llm", "corpus_pipeline") or name.startswith("fragmatch.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    import fragmatch

    monkeypatch.delattr(fragmatch, "llm", raising=False)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    alone = importlib.import_module("__spark_entry__")
    assert alone.llm is None and not [n for n in alone.queries() if n.startswith("op")] and set(alone.oracle_sql()) <= set(alone.queries())
