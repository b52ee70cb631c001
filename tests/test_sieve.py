"""Targets that are sifted while they are cut."""

import numpy as np
from pyspark.sql import functions as F

from fragmatch import queries
from fragmatch.functions import kernels as K
from fragmatch.operators import knn, patches
from fragmatch.plans import engine

SMALL = "/root/testdata/sf0.001"


def test_a_sieve_lets_the_nearest_pass_with_ties_and_little_else():
    r = np.random.RandomState(5)
    flat = lambda n: K.photometric(r.rand(n, 4, 4, 3))  # noqa: E731 - 32 axes of 48
    q, t = flat(700), flat(5000)
    t[40:60] = t[2000:2020] = q[:20]
    t[3000] = np.nan
    for k, limit in ((1, 0.9), (3, 1.2), (2, np.inf), (2, 0.0)):
        sieve = knn.Sieve(q, k, limit)
        kept = np.concatenate([sieve(t[at : at + 1500]) for at in range(0, len(t), 1500)])
        d = ((q[:, None, :] - t[None]) ** 2).sum(axis=2)
        far = np.minimum(np.sort(np.where(np.isnan(d), np.inf, d), axis=1)[:, k - 1], limit)
        assert kept[(d <= far[:, None]).any(axis=0)].all() and not kept[3000]
        if np.isfinite(limit):
            assert not kept[~(d <= limit).any(axis=0)].any()
    assert not knn.Sieve(np.zeros((0, 0)), 2, 0.5)(t).any() and knn.Sieve(q, 2, 0.5)(t[:0]).shape == (0,)


def test_targets_that_are_not_indexed_give_the_matches_of_an_index(spark):
    cfg = queries.config(stride=2)
    index = engine.index(queries._docs(spark, SMALL), cfg, K.photometric)
    plain = engine.match(queries._passages(spark, SMALL), index, queries.config(), K.photometric).matches
    found = engine.match(queries._passages(spark, SMALL), engine.Unindexed(queries._docs(spark, SMALL), cfg), queries.config(), K.photometric).matches
    columns = ["src_image", "image_id", "src_idx", "tgt_idx", "rank", "dist", "probability", "match_ord"]
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert rows(plain) and rows(found) == rows(plain)


def test_only_patches_near_a_source_leave_the_pass_that_cuts_them(spark, monkeypatch):
    left = []
    monkeypatch.setattr(engine, "save", lambda df, save=engine.save: left.append((set(df.columns), save(df))) or left[-1][1])
    docs = queries._docs(spark, SMALL)
    queries.match_chi2(spark, SMALL)
    every = patches.explode(docs, 4, 2, queries.ENTROPY, columns=("image_id", "patch_idx")).count()
    sifted = [df for names, df in left if {"descriptor", "orig_x"} <= names]
    assert len(sifted) == 1 and 0 < sifted[0].count() < every / 4
    assert sifted[0].where(F.size("descriptor") != 48).count() == 0
