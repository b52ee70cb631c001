"""Faults that were found and mended: long words, repeated and unlike vectors, copies on small sources."""

import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmatch.llm import embdedup, linededup, pii


@pytest.mark.parametrize("letter", ["a", "漢"])
def test_instances_of_a_very_long_word_take_linear_time(letter):
    text = letter * 1_000_000 + " 1 x@y z" + letter * 300_000 + "2" + letter * 300_000
    began = time.time()
    found = list(pii._marked(text))
    assert time.time() - began < 2
    assert [(s, len(w)) for s, w in found] == [(1_000_001, 1), (1_000_003, 3), (1_000_007, 600_002)]


def test_strings_with_digits_equal_a_plain_split():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab1@ \n é-") for _ in range(rng.randint(0, 40)))
        want, at = [], 0
        for token in text.split():
            at = text.index(token, at)
            if any(c in "0123456789@" for c in token):
                want.append((at, token))
            at += len(token)
        assert list(pii._marked(text)) == want


def plain_links(rows, least=0.98):
    """(id, links, component, kept) per row; every row is a vector of its own."""
    fine = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ok = [k for k, (i, v, y) in enumerate(rows) if i is not None and y is not None and fine(v)]
    links, up = Counter(), {k: k for k in ok}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(ok, 2):
        (_, u, x), (_, v, y) = rows[a], rows[b]
        if x == y and len(u) == len(v) and embdedup.cosines(np.array([u]), np.array([v]))[0] >= least:
            links[a] += 1
            links[b] += 1
            up[find(b)] = find(a)
    low = {}
    for k in ok:
        low[find(k)] = min(low.get(find(k), rows[k][0]), rows[k][0])
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = low[find(k)] if k in up else i
        out.append((i, links[k], c, c == i if i is not None else True))
    return out


def test_embedding_dedup_of_repeated_rows_ids_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "INTERVAL", 16)
    r = np.random.RandomState(3)
    rows = []
    for dim, n in ((16, 120), (3, 60), (40, 30), (1, 8)):
        centre = r.randn(6, dim)
        for _ in range(n):
            rows.append((len(rows), (centre[r.randint(6)] + 0.05 * r.randn(dim)).tolist(), int(r.randint(2))))
    rows += [rows[0], rows[0], rows[130], (5, rows[9][1], 1), (5, rows[9][1], 1), (5, rows[40][1], 0), (0, rows[1][1], 1), (900, None, 1), (900, None, 1), (None, rows[3][1], 1), (901, rows[3][1], None), (902, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = Counter(tuple(x) for x in embdedup.near_vectors(df).collect())
    assert got == Counter(plain_links(rows)) and sum(got.values()) == len(rows)


@pytest.mark.parametrize("copies,pages", [(2, 4), (3, 4), (10, 4), (2, 40), (3, 40), (10, 40)])
def test_the_stage_leaves_copies_to_the_next_one(spark, copies, pages):
    text = lambda k: "\n".join(f"line {k} {j}" for j in range(6)) + "\nfoot of the site"
    rows = [(k, text(k), "site") for k in range(pages)] + [(100 + k, "\n".join(f"copied {j}" for j in range(6)), "site") for k in range(copies)]
    out = {x["doc_id"]: x["text"] for x in linededup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()}
    assert len(out) == pages + copies and not any("foot" in t for t in out.values())
    assert len({out[100 + k] for k in range(copies)}) == 1 and out[100].count("copied") == 6


def test_the_pipeline_keeps_one_of_each_group_of_copies(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abdefgiklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    prose = lambda n=70: "\n".join(" ".join(rng.choices(vocabulary, k=n // 7)) for _ in range(7))
    rows = []
    for s, (pages, copies) in enumerate(itertools.product((4, 40), (2, 3, 10))):
        group = prose()
        rows += [(len(rows) + k, prose() if k < pages else group, "en", f"site{s}") for k in range(pages + copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    of = {}
    for i, t, _, _ in rows:
        of.setdefault(t, set()).add(i)
    assert all(len(ids & kept) == 1 for ids in of.values())


def test_equal_rows_are_packed_in_many_groups(spark):
    from fragmatch.llm import packing

    rows = spark.createDataFrame([(None, np.arange(700, dtype="<u4").tobytes())] * 400, "doc_id long, ids binary").repartition(4)
    out = packing.pack(rows, 16).collect()
    assert len({x["sequence_id"] >> 32 for x in out}) == 16 and sum(x["length"] for x in out) == 400 * 700
