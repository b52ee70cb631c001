"""Mixing, sort-means and spelling variants against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmatch.llm import centroids, mixing, spelling

DOCS = "doc_id long, source string, text string"


# ---- mixing


def plain_targets(sizes: dict, weights: dict, most=3) -> dict:
    """Clamp whatever is above, share the rest again."""
    out, clamped = {}, set()
    while True:
        left = Fraction(sum(sizes.values()) - sum(most * sizes[s] for s in clamped))
        free = sum(w for s, w in weights.items() if s not in clamped)
        for s in sizes:
            out[s] = Fraction(most * sizes[s]) if s in clamped else left * weights[s] / free
        over = {s for s in sizes if out[s] > most * sizes[s]}
        if not over:
            return out
        clamped |= over


def plain_mix(rows, seed=mixing.SEED):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    targets = plain_targets(sizes, weights)
    out = []
    for s in order:
        mine = sorted(((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, size(t)) for i, z, t in rows if z == s))
        goal = int(targets[s] + Fraction(1, 2))
        whole, rest = divmod(goal, sizes[s]) if sizes[s] else (0, 0)
        for _, i, n in mine:
            more = min(n, rest)
            rest -= more
            out.append((None if i == -1 else i, n, sizes[s], float(targets[s]), whole * n + more))
    return out


def corpus(seed, n=300, sources=9):
    rng = random.Random(seed)
    rows = [(k, rng.choice([*"ZYXabcé"[:sources], None, "src0", "src0", "src0"]), " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 40])))) for k in range(n)]
    return rows + [(n, "small", "one"), (n + 1, "small", None), (n + 2, "quiet", None), (n + 3, "quiet", " \t\n\x0b\f\r "), (None, None, "a b"), (None, None, "a b"), (7, "src0", "x y z"), (7, "src0", "x y z")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_equals_plain_water_filling(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, DOCS)
    got = [tuple(r) for r in mixing.mix(docs).select("id", "size", "source_size", "target", "taken").collect()]
    assert Counter(got) == Counter(plain_mix(rows))
    again = [tuple(r) for r in mixing.mix(docs.repartition(5)).select("id", "size", "source_size", "target", "taken").collect()]
    assert Counter(again) == Counter(got)


def test_mixing_meets_targets_and_keeps_to_epochs(spark):
    rows = corpus(3)
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert target["quiet"] == 0 and target["small"] == 3  # clamped


def test_clamping_takes_few_rounds_and_holds_for_many_sources(spark):
    rng = random.Random(4)
    sizes = {f"s{k:04}": int(2 ** rng.uniform(0, 40)) for k in range(600)}
    weights = {s: rng.choice([1, 2, 3, 1000]) for s in sizes}
    table = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size long, weight long")
    want = plain_targets(sizes, weights)
    got = {r["source"]: r["target"] for r in mixing.fill(table).collect()}
    assert all(got[s] == pytest.approx(float(want[s]), rel=1e-12) for s in sizes)


def test_mixing_with_own_weights_empty_tables_and_repetitions(spark):
    docs = spark.createDataFrame([(1, "a", "x " * 10), (2, "b", "y " * 10), (3, None, "z " * 20)], DOCS)
    w = spark.createDataFrame([("a", 1), ("b", 3), (None, 4)], "source string, weight long")
    mixed = mixing.mix(docs, weights=w)
    assert {r["id"]: r["taken"] for r in mixed.collect()} == {1: 5, 2: 15, 3: 20}
    reps = {(r["id"], r["epoch"]): r["words"] for r in mixing.repetitions(mixed).collect()}
    assert reps == {(1, 0): 5, (2, 0): 10, (2, 1): 5, (3, 0): 20}
    assert mixing.mix(docs.limit(0)).count() == 0
    odd = docs.select("doc_id", "source", "text", F.lit(1).alias("size"), F.lit(2).alias("target"), F.lit(3).alias("at"), F.lit(4).alias("h"))
    assert mixing.mix(odd).count() == 3


def test_mixing_counts_words_of_long_texts_without_lists(spark):
    docs = spark.createDataFrame([(1, "a", "ab " * 1_000_000), (2, "a", "c" * 2_000_000), (3, "a", "    x\x1cy ")], DOCS)
    assert {r["id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: 1_000_000, 2: 1, 3: 2}


def test_mixing_sql(spark, tmp_path):
    docs = spark.createDataFrame(corpus(5), DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(mixing.OP12_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = mixing.op12_mixing(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_mixing_plan_is_native(spark):
    plan = mixing.mix(spark.createDataFrame(corpus(6, 20), DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan.split("Physical Plan")[-1])


# ---- centroids


def plain_kmeans(rows, dim=64, k=8, rounds=10, seed=3):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [min((gap(v, c), j) for j, c in enumerate(at)) for _, v in kept]
    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v), (_, j) in zip(kept, nearest()):
            groups[j].append(v)
        for j, vs in groups.items():
            at[j] = [sum(c) // len(vs) for c in zip(*vs)]
    return [(i, j, d) for (i, _), (d, j) in zip(kept, nearest())], at


def cloud(seed, n, dim):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim))
    rows = [(k, (centre[k % 5] + rng.normal(size=dim) * 0.3).tolist()) for k in range(n)]
    odd = [(n, None), (n + 1, [None] * dim), (n + 2, [float("nan")] * dim), (n + 3, [float("inf")] * dim), (n + 4, [1.0] * (dim + 1)), (n + 5, []), (n + 6, [0.0] * dim), (None, [0.5] * dim)]
    return rows + odd + rows[:20] + [(3, rows[9][1])]


@pytest.mark.parametrize("dim,k", [(64, 8), (2, 8), (1, 3)])
def test_sort_means_equals_plain_rounds(spark, dim, k):
    rows = cloud(dim, 150, dim)
    if dim == 1:
        rows = [(i, [round(v[0]) * 1.0] if v and v[0] is not None and np.isfinite(v[0]) else v) for i, v in rows]  # many ties
    members, centres = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=dim, k=k, rounds=4)
    want, at = plain_kmeans(rows, dim, k, 4)
    assert Counter(map(tuple, members.collect())) == Counter(want)
    table = {r["cluster"]: r for r in centres.collect()}
    assert [table[j]["centroid"] for j in range(len(at))] == at
    assert all(table[j]["inertia"] == sum(d for _, c, d in want if c == j) for j in range(len(at)))


def test_sort_means_needs_no_right_start_and_skips_distances():
    rng = np.random.default_rng(8)
    at = rng.integers(-1000, 1000, (12, 16))
    v = at[rng.integers(0, 12, 4000)] + rng.integers(-40, 40, (4000, 16))
    far = ((v[:, None] - at[None]) ** 2).sum(axis=2)
    plain = far.argmin(axis=1)
    c, d, first = centroids.assign(v, np.zeros(len(v), np.int32), at)
    assert (c == plain).all() and (d == far.min(axis=1)).all()
    c, d, again = centroids.assign(v, c, at)
    assert (c == plain).all() and again == len(v) < first  # each vector is measured once


def test_sort_means_few_rows_none_and_out_of_reach(spark):
    kind = "vec_id long, embedding array<float>, cluster string, v int"
    members, centres = centroids.cluster(spark.createDataFrame([(1, [0.5, 1.0], "x", 1)], kind), dim=2)
    assert [tuple(r) for r in members.collect()] == [(1, 0, 0)] and centres.count() == 1
    members, centres = centroids.cluster(spark.createDataFrame([], kind), dim=2)
    assert members.count() == centres.count() == 0
    with pytest.raises(Exception, match="in magnitude"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0], "x", 1)], kind), dim=2)[0].collect()


def test_centroids_query_and_sql(spark, tmp_path):
    rows = [r for r in cloud(9, 120, 64) if r[0] is None or r[0] != 3]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.sql(centroids.OP11_SQL.replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'"))
    got = centroids.op11_centroids(spark, str(tmp_path))
    names = got.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert centroids.op11_centroids(spark, f"{tmp_path}/none").count() == 0


# ---- spelling


def plain_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_apart(a, b):
    """Exactly one insertion, deletion or replacement."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n):
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelled(seed, docs=60):
    rng = random.Random(seed)
    base = ["abababab", "aaaaaaaa", "aaaaaaaaa", "Überraschung", "ÀÉÎõüÿ×÷", "letterpress", "letterprass", "lettrepress", "gemeinde", "gemeinden", "gemeindes"]
    base += ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 10))) for _ in range(60)]
    weights = [rng.choice([1, 1, 20, 400]) for _ in base]
    rows = []
    for k in range(docs):
        picked = [w.upper() if rng.random() < 0.1 else w for w in rng.choices(base, weights, k=120)]
        rows.append((k, rng.choice([" ", ", ", "1", "\n"]).join(picked)))
    return rows + [(docs, None), (docs + 1, ""), (docs + 2, "... 123 "), (None, "gemeinde gemeinde"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spelling_equals_plain(spark, seed):
    rows = spelled(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in spelling.variants(spelling.counts(docs)).collect()]
    want = plain_variants(plain_counts(rows))
    assert Counter(got) == Counter(want)
    assert any(r[1] for r in want)


def test_forms_are_followed_to_the_last(spark):
    chain = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20_000), ("aabbbbb", 200_000), ("zzzzzzz", 3), ("aaaaaac", 20)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert all(got[w]["root"] == "aabbbbb" for w, _ in chain[:6]) and got["zzzzzzz"]["root"] == "zzzzzzz"
    assert got["aaaaaaa"]["form"] == "aaaaaab"  # as frequent as aaaaaac, and smaller
    assert sorted(map(tuple, got.values())) == sorted(plain_variants(dict(chain)))


def test_spelling_of_very_long_runs_and_texts(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    other = long[:77_777] + "z" + long[77_778:]
    docs = spark.createDataFrame([(None, f"{long} {other} {long[1:]}"), (None, f"{other} {long} {long[1:]} " + "wortwort " * 100_000)], "doc_id long, text string")
    got = {r["word"]: r for r in spelling.variants(spelling.counts(docs)).collect()}
    assert {len(w) for w in got} == {8, 199_999, 200_000} and got["wortwort"]["n"] == 100_000
    assert (got[long]["n_near"], got[other]["n_near"], got[long[1:]]["n_near"]) == (2, 1, 1)


def test_segments_and_tables_change_nothing(spark, monkeypatch):
    rows = spelled(6, 10)
    for i, text in rows:
        want = [r for r in re.findall("[A-Za-zÀ-ÿ]+", (text or "").encode().lower().decode()) if len(r) >= 7]
        monkeypatch.setattr(spelling, "_SEGMENT", 13)
        assert list(spelling.runs(text or "", 7)) == want


def test_spelling_empty_and_clashing_names(spark):
    kind = "doc_id long, text string, word string, n long, id string"
    assert spelling.variants(spelling.counts(spark.createDataFrame([], kind))).count() == 0
    rows = [(1, "abcdefgh abcdefgh", "w", 5, "x")]
    assert [r["word"] for r in spelling.variants(spelling.counts(spark.createDataFrame(rows, kind))).collect()] == [r[0] for r in plain_variants(plain_counts([(1, rows[0][1])]))]
