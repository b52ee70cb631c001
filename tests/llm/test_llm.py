"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmatch.llm import ann, bpe, embdedup, langid, linededup, minhash, packing, pii, substring, urlfilter

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    rows = [(k, t, more.get("lang", {}).get(k, "en"), more.get("source", "s"), len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def words():
    r = np.random.RandomState(0)
    return ["".join(r.choice(list("abcdefgh"), r.randint(1, 8))) for _ in range(400)]


def prose(words, r, n):
    return " ".join(r.choice(words, n))


# -- 1 -------------------------------------------------------------------------------------


def test_langid(spark):
    r = np.random.RandomState(1)
    stems = {"en": ["the", "and", "ing", "of", "tion"], "de": ["der", "und", "sch", "ung", "ü"], "fr": ["eau", "que", "é", "oi", "ment"]}
    rows = [(k, " ".join("".join(r.choice(stems[g], 2)) for _ in range(12)), g) for k, g in enumerate(r.choice(list(stems), 600))]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "de"), (1002, "", None), (1003, "the and " * 60000, "en"), (1003, "the and " * 60000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    model = langid.learned(df)
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    held = [x for x in got if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 and x["text"] and x["doc_id"] < 1000]
    assert np.mean([x["lang_pred"] == x["lang"] for x in held]) > 0.97
    by = {x["doc_id"]: x for x in got}
    assert [by[k]["lang_pred"] for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    assert all(0 <= x["score"] <= 1 for x in got)
    none = langid.train(df.where("false"))
    assert langid.predict(df.limit(3), none).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(df.where("false"), model).count() == 0


def test_langid_scores_equal_a_plain_sum(spark):
    df = spark.createDataFrame([(1, "abc abd", "x"), (2, "xyz xyy", "y")], "doc_id long, text string, lang string")
    model = langid.train(df)
    import pyarrow as pa

    texts = pa.array(["abx", None, "b"])
    buckets, at = langid.grams(texts)
    assert np.diff(at).tolist() == [6, 0, 1]  # 3 + 2 + 1 n-grams, none, one
    like = np.array([model.weights[buckets[:6]].sum(0) + model.prior])
    p = np.exp(like - like.max()) / np.exp(like - like.max()).sum()
    _, score = langid.score(texts, model)
    assert score[0] == pytest.approx(p.max(), rel=1e-5)


def plain_grams(text):
    """The buckets of a text's n-grams, one by one."""
    out, cps = [], [ord(c) if c.isalpha() else 32 for c in text.lower()]
    mult, mask = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), (1 << 32) - 1
    for n in (1, 2, 3):
        for at in range(len(cps) - n + 1):
            h = 0
            for k in range(n):
                h = ((h ^ (cps[at + k] + k + 1)) * mult[k]) & mask
                h ^= h >> 15
            out.append(h >> (32 - langid.BUCKET_BITS))
    return out


def test_langid_training_and_scores_against_plain_counts(spark):
    import math

    r = np.random.RandomState(2)
    stems = {"a": ["the", "ing", "ÉÀ"], "b": ["sch", "ung", "漢"], "c": ["eau", "que", "😀x"]}
    rows = [(k, " ".join("".join(r.choice(stems[g], 2)) for _ in range(r.randint(1, 9))) + ("!" if k % 3 else ""), g) for k, g in enumerate(r.choice(list(stems), 90))]
    rows += [(200, None, "a"), (201, "the ing", None), (202, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, docs_of = defaultdict(Counter), Counter()
    for k, t, g in rows:
        if t is not None and g is not None and zlib.crc32(str(k).encode()) % 5:
            counts[g].update(plain_grams(t))
            docs_of[g] += 1
    size = 1 << langid.BUCKET_BITS
    got = langid.predict(df, langid.learned(df)).collect()
    for x in got:
        t = x["text"]
        if not t or not any(c.isalpha() for c in t):
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        like = {g: math.log(docs_of[g] / sum(docs_of.values())) + sum(math.log((c[b] + langid.SMOOTHING) / (sum(c.values()) + size * langid.SMOOTHING)) for b in plain_grams(t)) for g, c in counts.items()}
        best = max(sorted(like), key=like.get)
        assert x["lang_pred"] == best
        assert x["score"] == pytest.approx(1 / sum(math.exp(v - like[best]) for v in like.values()), rel=1e-3)


def test_stage_rejects_foreign_mixed_and_noise_texts(spark):
    r = np.random.RandomState(21)
    stems = {"en": ["the", "and", "ing", "of", "tion"], "de": ["der", "und", "sch", "ung", "ü"], "fr": ["eau", "que", "é", "oi", "ment"]}

    def text(g, n):
        return " ".join("".join(r.choice(stems[g], 2)) for _ in range(n))

    rows = [(k, text(g, r.randint(4, 60)), g) for k, g in enumerate(r.choice(list(stems), 600))]
    rows += [(1000 + k, f"{text(a, 60)} {text(b, 60)}", a) for k, (a, b) in enumerate(itertools.permutations(stems, 2))]
    rows += [(2000, "Все люди рождаются свободными и равными в своем достоинстве", "en"), (2001, "人人生而自由在尊严和权利上一律平等", "de"), (2002, "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar", "fr")]
    rows += [(3000 + k, "".join(r.choice(list("qwertyuiopasdfghjklzxcvbnm   "), 200)), "en") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = langid.stage(spark, df, "")
    assert kept.columns == df.columns
    assert {x["doc_id"] for x in kept.collect()} == set(range(600))


# -- 2 -------------------------------------------------------------------------------------

ODD = [" ", "  ", "\n", "a", "B", "\t", "é", "'s", "1", "!", "\x1c", "\x85", "\xa0", "ß", "the", "<|endoftext|>", "\u3000", "漢", "½", "\r", "😀", "́", "\x00", "Σ", "İ", "12"]


@pytest.mark.parametrize("path,make", [(BYTE, bpe.Transducer), (WORD, packing.WordTokenizer)])
def test_encoders_equal_the_library(path, make):
    from tokenizers import Tokenizer

    ours, theirs, r = make(path), Tokenizer.from_file(path), np.random.RandomState(5)
    texts = ["".join(r.choice(ODD, r.randint(0, 14))) for _ in range(1500)] + ["a" * 9000, "ab" * 4000 + " " * 3000 + "x", "-" * 5000]
    got = ours.encode_batch(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, repr(t[:60])
        if make is bpe.Transducer:
            assert "".join(ours.decode(g)) == theirs.decode(np.frombuffer(g, "<u4").tolist(), skip_special_tokens=False) == t


def test_streaming_emits_early_and_the_same():
    t, r = bpe.Transducer(BYTE), np.random.RandomState(6)
    m = t.merger
    assert 1 < m.lookahead < 5000
    word = "".join(r.choice(list("abehinrst"), 20000)).encode()
    whole = np.frombuffer(m.merge([word], ends=False)[0], "<u4").tolist()
    seen, out = [], []
    chunks = (seen.append(k) or word[k : k + 500] for k in range(0, len(word), 500))
    for part in m.stream(chunks):
        out += part.tolist()
        assert sum(len(m.bytes_of[i]) for i in out) <= (len(seen)) * 500
    assert out == whole and len(seen) == 40


@pytest.mark.parametrize("path,make", [(BYTE, bpe.Transducer), (WORD, packing.WordTokenizer)])
def test_every_id_comes_from_the_streaming_step(monkeypatch, path, make):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "SEGMENT", 40)
    monkeypatch.setattr(bpe, "MEMO", 0)
    tool, theirs, r = make(path), Tokenizer.from_file(path), np.random.RandomState(28)
    tool.merger.window = tool.merger.lookahead + 8  # windows that many words of these texts outgrow
    made, inside, step, merge = [], [], tool.merger.stable, tool.merger.merge

    def stable(windows, ends):
        assert all(len(w) <= 2 * tool.merger.window + tool.merger.lookahead + 200 for w in windows)
        inside.append(1)
        out, used = step(windows, ends)
        inside.pop()
        made.extend(len(o) // 4 for o in out)
        return out, used

    def merged(*args):
        assert inside
        return merge(*args)

    monkeypatch.setattr(tool.merger, "stable", stable)
    monkeypatch.setattr(tool.merger, "merge", merged)
    texts = ["".join(r.choice(ODD, r.randint(100, 900))) for _ in range(40)]
    texts += ["".join(r.choice(list("abehinrst"), 6000)), "x" * 5000 + "." + "漢" * 3000, "word " * 50 + "-" * 4000 + " end", " " * 4000 + "a"]
    for t in texts:
        parts = [np.frombuffer(ids, "<u4").tolist() for _, ids in tool.stream([t])]
        assert [i for p in parts for i in p] == theirs.encode(t, add_special_tokens=False).ids, repr(t[:60])
        assert len(parts) > 1
    alone = "".join(r.choice(list("abehinrst"), 9000))  # one pre-token, emitted bit by bit
    made.clear()
    assert len(tool.encode(alone)) // 4 == sum(made) == len(theirs.encode(alone, add_special_tokens=False).ids)
    assert max(made) < sum(made) / 4
    tool.memo = bpe.Memo()
    words = [alone, "a", alone[:4000], "", alone[::-1]]  # the same among words that are read side by side
    assert tool.merger.words([w.encode() for w in words]) == [tool.encode(w) for w in words]


def test_bpe_digests_of_long_texts(spark):
    texts = ["é漢 the " * 60000, "x" * 300000, " " * 200000, "😀" * 50000 + "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(BYTE)
    for x in bpe.digests(df, BYTE).collect():
        ids = theirs.encode(texts[x["doc_id"]], add_special_tokens=False).ids
        assert (x["n_tokens"], x["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert x["decoded_sha256"] == hashlib.sha256(texts[x["doc_id"]].encode()).hexdigest()


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, "ab c"), (1, "ab c"), (None, None), (3, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = bpe.encode_decode(df, BYTE).collect()
    assert [x["decoded"] for x in got if x["doc_id"] == 1] == ["ab c"] * 2 and all(x["decoded"] == (x["text"] or "") for x in got)
    rows = {x["doc_id"]: x for x in bpe.digests(df, BYTE).collect()}
    assert rows[None]["n_tokens"] == 0 and rows[3]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(df.where("false"), BYTE).count() == 0


# -- 3 -------------------------------------------------------------------------------------


def test_passages_inside_sentences(spark, words):
    r = np.random.RandomState(22)
    shared = [prose(words, r, 60) for _ in range(6)]
    texts = [prose(words, r, 20) + " " + shared[k % 6] + " " + prose(words, r, 20) for k in range(18)] + [prose(words, r, 80) for _ in range(10)]
    rows = {x["doc_id"]: x for x in substring.drop_repeats(docs(spark, texts)).collect()}
    assert all(rows[k]["clean_text"] == texts[k] for k in (*range(6), *range(18, 28)))
    assert all(rows[k]["removed"] and len(rows[k]["clean_text"].split()) <= 88 for k in range(6, 18))


def test_substring_dedup_against_brute_force(spark, words):
    r = np.random.RandomState(2)
    shared = prose(words, r, 60) + "."
    texts = [prose(words, r, 30) + ". " + (shared if k % 3 == 0 else "") + "\n" + prose(words, r, 12) + "." for k in range(30)]
    texts += [texts[0], None, "", "Short one. Short one.", prose(words, r, 20000)]
    df = docs(spark, texts).withColumn("clean_text", F.lit(1))
    df = df.unionAll(df.where("doc_id = 3"))
    rows = {x["doc_id"]: x for x in substring.drop_repeats(df).collect()}
    order = sorted((k, s, e, d) for k, t in enumerate(texts) if t for s, e, d in substring.units(t))
    seen, gone = set(), defaultdict(list)
    for k, s, e, d in order:
        if d in seen:
            gone[k].append((s, e))
        seen.add(d)
    assert sum(len(substring.units(t or "")) for t in texts) > 200
    for k, t in enumerate(texts):
        gone[k] = substring.merged(sorted(set(gone[k])))
        assert [tuple(g) for g in rows[k]["removed"]] == gone[k]
        cut, at = "", 0
        for s, e in gone[k]:
            cut, at = cut + t[at:s], e
        assert rows[k]["clean_text"] == (None if t is None else cut + t[at:])
    assert shared in rows[0]["clean_text"] and all(shared not in rows[k]["clean_text"] for k in range(3, 30, 3))
    assert rows[33]["clean_text"] == texts[33] and rows[30]["clean_text"].strip() == ""
    assert substring.drop_repeats(df.where("false")).count() == 0


def test_every_word_of_a_repeated_passage_of_sentences_goes(spark, words):
    r = np.random.RandomState(23)
    short = [" ".join(prose(words, r, n).capitalize() + "." for n in (3, 5, 2, 6, 4)) for _ in range(3)]  # no sentence of 8 words
    lists = ["\n".join(prose(words, r, n) for n in (2, 3, 4, 1, 5)) for _ in range(3)]  # no line of 8 words
    tails = [prose(words, r, 31) + "." for _ in range(3)]
    inside = [prose(words, r, 100) for _ in range(3)]
    texts = [f"{prose(words, r, 9)}.\n{p}\n{prose(words, r, 9)}." for _ in range(2) for p in short + lists + tails]
    texts += [prose(words, r, 20) + " " + p + " " + prose(words, r, 20) for _ in range(2) for p in inside]
    rows = {x["doc_id"]: x for x in substring.drop_repeats(docs(spark, texts)).collect()}
    for k in (*range(9), *range(18, 21)):
        assert rows[k]["clean_text"] == texts[k]
    for k in range(9, 18):
        assert rows[k]["clean_text"].split() == (texts[k].split("\n")[0] + " " + texts[k].split("\n")[-1]).split()
    for k in range(21, 24):  # only what lies before the first and after the last cut may stay: no patch between
        gone = rows[k]["removed"]
        assert all(a["end"] == b["start"] for a, b in zip(gone, gone[1:])) and len(rows[k]["clean_text"].split()) >= 40
    for t in texts:  # every place is in a unit
        assert substring.merged(sorted((s, e) for s, e, _ in substring.units(t)))[0][0] == 0
        assert max(e for _, e, _ in substring.units(t)) == len(t)
    assert sum(len(rows[k]["clean_text"].split()) - 40 for k in range(21, 24)) <= 75  # of 300 words


def test_short_repeated_lines_stay_and_long_runs_go(spark, words):
    r = np.random.RandomState(24)
    site = [prose(words, r, 9) + "." for _ in range(2)]
    two = " ".join(site)
    texts = [f"{prose(words, r, 30)}.\n{site[k % 2]}\n{prose(words, r, 30)}." for k in range(6)]
    texts += [f"{prose(words, r, 30)}.\n{two}\n{prose(words, r, 30)}." for _ in range(2)]
    rows = {x["doc_id"]: x for x in substring.drop_repeats(docs(spark, texts)).collect()}
    assert all(rows[k]["clean_text"] == texts[k] and not rows[k]["removed"] for k in range(6))
    assert two not in rows[7]["clean_text"] and len(rows[7]["clean_text"].split()) == 60
    assert substring.long_runs("a b c d", [(0, 2), (2, 4), (6, 7)], 2) == [(0, 2), (2, 4)]


# -- 4 -------------------------------------------------------------------------------------


def test_ann(spark):
    r = np.random.RandomState(3)
    v = r.randn(900, 12)
    v[50] = v[51] = v[52]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [1.0] * 11 + [None]), (None, [1.0] * 12), (2080, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    by = defaultdict(list)
    for x in sorted(got, key=lambda x: (x["query_id"], x["rank"])):
        by[x["query_id"]].append(x)
        assert x["score"] == pytest.approx(float(v[x["query_id"]] @ v[x["vec_id"]]), abs=1e-12)
    assert set(by) == set(range(0, 900, 20))
    hit = 0
    for q, near in by.items():
        assert [x["rank"] for x in near] == list(range(1, 21)) and q not in [x["vec_id"] for x in near]
        keys = [(-x["score"], x["vec_id"]) for x in near]
        assert keys == sorted(keys)
        s = v @ v[q]
        s[q] = -np.inf
        hit += len({x["vec_id"] for x in near} & set(np.lexsort((np.arange(900), -s))[:20].tolist()))
    assert hit / (20 * len(by)) >= 0.9
    few = ann.search(df.where("vec_id < 8"), F.col("vec_id") == 0)
    assert few.count() == 7
    assert ann.search(df.where("false"), F.lit(True)).count() == 0


def test_perturbations_come_in_order_and_none_is_left_out():
    r = np.random.RandomState(30)
    for m, most in ((0, 5), (1, 3), (3, 27), (5, 243), (6, 40), (9, 300)):
        walls = ann.wall_distances(r.randn(4, m) * 3)
        steps, score = ann.perturbations(walls, most)
        for i in range(4):
            plain = sorted((sum(walls[i, k, d + 1] for k, d in enumerate(p)), p) for p in itertools.product((-1, 0, 1), repeat=m))
            assert np.allclose(score[i], [s for s, _ in plain[:most]]) and len({tuple(x) for x in steps[i].tolist()}) == min(most, 3**m)
            assert np.allclose([sum(walls[i, k, d + 1] for k, d in enumerate(p)) for p in steps[i].tolist()], score[i])
    assert [ann.make_hasher(n, 4, 1.0).m for n in (100, 5 * 10**6, 10**8, 10**11)] == [0, 8, 10, 15]


def test_ann_keeps_the_fitted_recall_by_fewer_projections(monkeypatch):
    monkeypatch.setattr(ann, "WIDTH", 0.4)  # most neighbours are more than one cell away
    v = np.random.RandomState(31).randn(500, 8)
    h = ann.fit(ann.make_hasher(64 * 4**4, 8, np.linalg.norm(v, axis=1).max()), v, 10)
    near = np.argsort(-(v[:100] @ v.T) + 1e9 * np.eye(100, 500), axis=1)[:, :10]
    cells, probes = np.floor(h.cells(v, False)), h.probed(v[:100])
    hit = [any(h.key(cells[t], t)[n] in probes[i, t] for t in range(ann.TABLES)) for i in range(100) for n in near[i]]
    assert np.mean(hit) >= 0.93


def test_ann_with_many_projections_hot_copies_and_repeated_ids(spark, monkeypatch):
    r = np.random.RandomState(32)
    centre = r.randn(40, 24)
    v = centre[r.randint(0, 40, 1600)] + 0.15 * r.randn(1600, 24)
    v[::3] = 1.5 * v[0]  # a third are copies
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    df = spark.createDataFrame([*rows, *rows[:50]], "vec_id long, embedding array<double>")
    make, made = ann.make_hasher, []
    monkeypatch.setattr(ann, "make_hasher", lambda n, *a: made.append(make(64 * 4**9, *a)) or made[0])
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    monkeypatch.setattr(ann, "BLOCK", 64)
    fitted, real = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: fitted.append(real(*a)) or fitted[0])
    by = defaultdict(list)
    for x in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        by[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    assert made[0].m == 9 and fitted[0].m >= 8 and fitted[0].probes < 3**8
    assert set(by) == set(range(0, 1600, 20))
    hit = 0
    for q, near in by.items():
        near.sort()
        assert [n for n, _, _ in near] == list(range(1, 21)) and len({i for _, i, _ in near} - {q}) == 20
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1600), -np.round(s, 9)))[:20].tolist()
        hit += len({i for _, i, _ in near} & set(want))
        if q % 3 == 0:
            assert [i for _, i, _ in near] == [i for i in range(0, 66, 3) if i != q][:20]
    assert hit / (20 * len(by)) >= 0.9
    monkeypatch.undo()
    two = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in ann.search(two, F.col("vec_id") == 20).collect()] == [(20, 1, 1, 2.0)]


# -- 5 -------------------------------------------------------------------------------------

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(t):
    out = []
    for kind, name in enumerate(FORMS):
        for m in re.finditer(FORMS[name], t):
            d = re.sub("[^0-9]", "", m.group())
            ok = name == "email" or name == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or name == "card" and 12 <= len(d) <= 19 and pii.luhn(d) or name == "phone" and 9 <= len(d) <= 15
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = np.random.RandomState(4)
    bits = ["a@b.c", "@", "x.y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (988) 555-2485", "+", "1", "22", ".", "-", " ", "é", "@b", "a@b", ".com", "4111111111111111", "\n", "(", "x@y.z@w.v"]
    for _ in range(4000):
        t = "".join(r.choice(bits, r.randint(0, 12)))
        assert pii.base_spans(t) == plain_spans(t), repr(t)
    assert pii.base_spans("a" * 300000) == [] and pii.base_spans("1" * 300000 + "@") == []


def test_pii_rows_and_discovery(spark):
    def card(k):
        d = f"{4000000000000 + 7919 * k}00"
        return next(d + str(c) for c in range(10) if pii.luhn(d + str(c)))

    texts = [f"please charge card {card(k)} today k" for k in range(12)] + ["please charge card 4000000000001237 today k", None, "", "a@b.co at 1.2.3.4", "nothing here"]
    df = docs(spark, texts)
    rows = {x["doc_id"]: x for x in pii.spans(df.unionAll(df.where("doc_id = 15"))).collect()}
    for k, t in enumerate(texts):
        told = ",".join(f"{pii.KINDS[x]}:{s}:{e}" for s, x, e in plain_spans(t or ""))
        assert rows[k]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(rows[k]["spans"].split(","))
    assert rows[12]["n_card"] == 0 and rows[12]["spans"] == "card:19:35"  # its check digit is wrong, its context tells
    assert (rows[15]["n_email"], rows[15]["n_ip"]) == (1, 1)
    red = {x["doc_id"]: x["text"] for x in pii.redact(df).collect()}
    assert red[12] == "please charge card <card> today k" and red[13] is None and red[15] == "<email> at <ip>" and red[16] == "nothing here"
    assert pii.spans(df.where("false")).count() == 0


def _card(k):
    d = f"{4000000000000 + 7919 * k}00"
    d = next(d + str(c) for c in range(10) if pii.luhn(d + str(c)))
    return " ".join(d[i : i + 4] for i in range(0, 16, 4))


def test_pii_discovers_numbers_with_spaces(spark):
    texts = [f"please charge card {_card(k)} today k" for k in range(12)] + [f"my phone number +1 (988) 555-{2000 + k} please" for k in range(12)]
    texts += ["please charge card 4000 0000 0000 1237 today k", "my phone number 017 555 7713 please", "my phone number (017) 555-7713 please", "room 12 has 3 beds and 4 lamps"]
    df = docs(spark, texts)
    rows = {x["doc_id"]: x["spans"] for x in pii.spans(df).collect()}
    assert [rows[k] for k in range(24, 28)] == ["card:19:38", "phone:16:28", "phone:16:30", ""]
    red = {x["doc_id"]: x["text"] for x in pii.redact(df).collect()}
    assert [red[k] for k in (24, 25, 26)] == ["please charge card <card> today k", "my phone number <phone> please", "my phone number <phone> please"]


def test_pii_discovery_reaches_the_fixed_point(spark):
    texts = [f"please charge card {_card(k).replace(' ', '')} today k" for k in range(12)]
    wrong = [str(4000000000000000 + 10 * k) for k in range(40)]
    texts += [f"please charge card {w} today k" for w in wrong if not pii.luhn(w)]
    texts += [f"call desk {99000000000000 + k} now" for k in range(2)]  # no seeds there
    assert len(texts) > 12 + 12 + 2
    rows = {x["doc_id"]: x["spans"] for x in pii.spans(docs(spark, texts)).collect()}
    assert all(rows[k] == "card:19:35" for k in range(12, len(texts) - 2))
    assert all(rows[k] == "" for k in range(len(texts) - 2, len(texts)))


def test_pii_discovered_instances_support_further_patterns(spark):
    wrong = [w for w in (str(4000000000000000 + 10 * k) for k in range(400)) if not pii.luhn(w)]
    texts = [f"please charge card {_card(k).replace(' ', '')} today k" for k in range(12)]
    texts += [f"please charge card {w} today k" for w in wrong[:8]]  # first round
    texts += [f"ship for account {w} soon q" for w in wrong[:14]]  # 8 of these are known by then: second round
    texts += [f"refund into wallet {w} again z" for w in wrong[9:20]]  # 5 of these by then: third round
    texts += [f"lot number batch {w} in store" for w in wrong[30:60]] + [f"lot number batch {w} in store" for w in wrong[:3]]  # too few
    rows = {x["doc_id"]: x["spans"] for x in pii.spans(docs(spark, texts)).collect()}
    assert all(rows[k] == f"card:{texts[k].index('4')}:{texts[k].index('4') + 16}" for k in range(12 + 8 + 14 + 11))
    assert not any(rows[k] for k in range(45, len(texts)))


def plain_patterns(pairs, min_seeds, min_score):
    """The graph by dictionaries, scored by plain rounds."""
    trusted = {(i, k) for _, i, k, seed in pairs if seed}
    while True:
        support = defaultdict(set)
        for p, i, k, _ in pairs:
            if (i, k) in trusted:
                support[p, k].add(i)
        score = {pk: 0.0 for pk, s in support.items() if len(s) >= min_seeds}
        for _ in range(4000):
            trust = defaultdict(float)
            for p, i, k, seed in pairs:
                if not seed and (p, k) in score:
                    trust[i, k] = max(trust[i, k], score[p, k])
            score = {pk: (lambda own: sum(1.0 if (i, pk[1]) in trusted and (pk[0], i, pk[1]) in own else trust[i, pk[1]] if (pk[0], i, pk[1]) in own else 0.0 for i in {i for p, i, _, _ in pairs if p == pk[0]}) / (len({i for p, i, _, _ in pairs if p == pk[0]}) + pii.PRIOR))({(p, i, k) for p, i, k, _ in pairs}) for pk in score}
        good = {pk for pk, x in score.items() if x >= min_score - 1e-6}
        new = trusted | {(i, k) for p, i, k, seed in pairs if not seed and (p, k) in good}
        if new == trusted:
            return good
        trusted = new


def test_pii_graph_against_brute_force(spark):
    r = np.random.RandomState(25)
    pairs = set()
    for _ in range(60):
        p, i = int(r.randint(0, 6)), int(r.randint(0, 25))
        pairs.add((p, i, int(i % 3 if i < 20 else -1), bool(i < 9)))
    frame = spark.createDataFrame(sorted(pairs), "pattern long, instance long, kind int, seed boolean")
    for need, least in ((1, 0.3), (2, 0.2), (2, 0.35)):
        got = {tuple(x) for x in pii.trusted_patterns(frame, need, least).collect()}
        assert got == plain_patterns(sorted(pairs), need, least)


def test_pii_long_words_zeros_and_names(spark):
    import time

    texts = ["0" * 5000 + "1.2.3.4", "é" * 200000 + " 4000000000001237 " + "x" * 200000, "a@b.co," * 40000, "é4111111111111111" * 20000]
    began = time.time()
    assert pii.base_spans(texts[0])[0] == (0, 1, 5007) and len(pii.base_spans(texts[2])) == 40000
    for t in texts:
        around = pii._Context(t, base := pii.base_spans(t))
        assert sum(len(around.patterns(s, e)) for s, _, e in base) >= 0
    assert time.time() - began < 20
    df = docs(spark, ["me@x.org", texts[0], None]).withColumn("_extra", F.lit(4)).withColumn("extra", F.lit(5)).withColumn("h", F.lit(6)).withColumn("kind", F.lit(7))
    got = pii.redact(df)
    assert got.columns == df.columns and {x["doc_id"]: (x["text"], x["_extra"], x["h"]) for x in got.collect()} == {0: ("<email>", 4, 6), 1: ("<ip>", 4, 6), 2: (None, 4, 6)}


# -- 6 -------------------------------------------------------------------------------------


def plain_components(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(k) for k in range(len(texts))]


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_against_brute_force(spark, words, size):
    r = np.random.RandomState(6)
    base = [list(r.choice(words, n)) for n in (40, 80, 150)]
    texts = []
    for b in base:
        for _ in range(45):
            w = list(b)
            for k in r.choice(len(w), r.randint(0, max(2, len(w) // 12)), replace=False):
                w[k] = str(r.choice(words))
            texts.append(" ".join(w).upper() if r.rand() < 0.2 else "\t".join(w))
    texts += [prose(words, r, n) for n in (1, 1, 2, 3, 5, 30)] + ["one", "ONE", None, "", " \n", "x" * 300, prose(words, r, 9000)]
    n, comp = plain_components(texts, size, 80)
    df = docs(spark, texts).withColumn("n", F.lit("mine"))
    got = {x["id"]: x for x in minhash.near_duplicates(df, size=size).collect()}
    assert [got[k]["n_shingles"] for k in range(len(texts))] == n
    assert [got[k]["component_id"] for k in range(len(texts))] == comp
    assert all(x["kept"] == (x["component_id"] == x["id"]) for x in got.values())
    assert minhash.near_duplicates(df.where("false"), size=size).count() == 0


def test_minhash_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(((x["id"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]


# -- 7 -------------------------------------------------------------------------------------


def test_urls_against_rules(spark):
    r = np.random.RandomState(7)
    hosts, paths = ["example.com", "WWW.example.com", "a.www.example.com", "x.net", "net", "notexample.com", "com", "", "example.com:80", "m.x.net."], ["", "/", "/en/", "/en", "/en/x/y", "/es/?q", "/fr/#t", "/EN/", "?x=/en/", "#/en/"]
    urls = ["http://" + h + p for h in hosts for p in paths] + [None, "", "example.com/en/", "://", "a://b://c/en/", "http://example.com/en/" + "a/" * 20000, "http://x.net/es/\n/x"]
    rows = [(k, u) for k, u in enumerate(urls)] + [(0, urls[0])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(5)).withColumn("verdict_x", F.lit(1))
    got = urlfilter.judge(df).collect()
    assert len(got) == len(rows)
    for x in got:
        u = x["url"]
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host, path = "", ""
        if rest is not None:
            m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
            host, path = re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == (host, path, best[1], best[2]), u
    table = spark.createDataFrame([tuple(y) for y in urlfilter.RULES], "rule_host string, rule_path string, verdict string")
    assert urlfilter.judge(df, table).where("verdict = 'block'").count() == sum(y["verdict"] == "block" for y in got)
    assert urlfilter.judge(df.where("false")).count() == 0 and r is not None


def test_urls_join_on_the_prefix_alone(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://www.example.com/en/x")], "page_id long, url string")
    plan = urlfilter.judge(df)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert len(joins) >= 1 and all("sha2" not in x and "digest" not in x for x in joins) and "sha2" in plan
    real = F.crc32  # all prefixes meet, and only digests tell rules apart
    monkeypatch.setattr(urlfilter.F, "crc32", lambda c: F.pmod(real(c), F.lit(1)))
    got = urlfilter.judge(df).collect()[0]
    assert (got["rule"], got["verdict"]) == ("www.example.com/en/", "allow")


def test_urls_any_rules_and_clashing_names(spark):
    r = np.random.RandomState(27)
    hosts, bits = ["a.com", "b.a.com", "com", "x.b.a.com", "org"], ["", "/", "/p", "/p/", "/p/q", "/p/qq", "/p/q/", "/?", "/pp/q/r"]
    rules = [(h, p, str(r.choice(["allow", "block"]))) for h in hosts for p in bits if r.rand() < 0.5 and "?" not in p] + [("org", None, "block")]
    urls = [f"http://{h}{p}" for h in [*hosts, "y.x.b.a.com", "org.", "aorg"] for p in [*bits, "/p/q/r/s", "/pq", "/p/qq/" + "a" * 3000]]
    names = ("digest", "prefix", "rule_len", "_row", "row", "expr", "page", "best", "v")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    got = urlfilter.judge(df, rules)
    assert got.columns == [*df.columns, "host", "path", "rule", "verdict"]
    for x in got.collect():
        fits = [(len(h + p), h + p, v) for h, p, v in rules if p is not None and (x["host"] == h or x["host"].endswith("." + h)) and x["path"].startswith(p)]
        top = max(fits, default=(0, None, "allow"))
        assert (x["rule"] is None) == (not fits) and (x["rule"] is None or len(x["rule"]) == top[0]) and [x[n] for n in names] == list(range(len(names)))
        assert x["verdict"] in {v for n, _, v in fits if n == top[0]} | ({"allow"} if not fits else set())
    assert urlfilter.judge(df, []).where("verdict <> 'allow'").count() == 0


# -- 8 -------------------------------------------------------------------------------------


def test_embedding_dedup_against_brute_force(spark):
    r = np.random.RandomState(8)
    centre = r.randn(12, 16)
    v = np.concatenate([centre[r.randint(0, 12, 260)] + 0.12 * r.randn(260, 16), r.randn(40, 16)])
    v[10] = v[11] = v[12]
    v[13] = 3 * v[10]
    label = [int(x) if x < 3 else None for x in r.randint(0, 4, 300)]
    label[10:14] = [1] * 4
    rows = [(k, x.tolist(), y) for k, (x, y) in enumerate(zip(v, label))] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("inf")] * 16, 1), (503, [1.0] * 15 + [None], 1), (504, [1.0], 1), (None, v[10].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(0))
    got = {x["id"]: x for x in embdedup.near_vectors(df).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links, up = Counter(), list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(300), 2):
        if label[a] is not None and label[a] == label[b] and u[a] @ u[b] >= 0.98:
            links[a] += 1
            links[b] += 1
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert len(links) > 50
    for k in range(300):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (links[k], find(k), find(k) == k)
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (500, 501, 502, 503, 504)) and got[None]["component_id"] is None
    assert embdedup.near_vectors(df.where("false")).count() == 0


def test_no_link_below_the_threshold(spark):
    a = np.array([1.0, 0.0])
    angle = np.arccos(0.98)
    near = [np.array([np.cos(x), np.sin(x)]) for x in (angle - 1e-9, angle + 1e-9, angle, angle + 4e-16, angle - 4e-16)]
    rows = [(10 * k + j, (f * x).tolist(), k) for k, b in enumerate(near) for j, (f, x) in enumerate(((1.0, a), (3.0, b)))]
    rows += [(100, [1e200, 0.0], 9), (101, [1e200, 1e190], 9), (102, [1e-200, 1e-200], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x["id"]: x["n_links"] for x in embdedup.near_vectors(df).collect()}
    for k, b in enumerate(near):
        c = 3 * float(b[0])
        assert got[10 * k] == got[10 * k + 1] == int(c / np.sqrt(1.0 * (9 * b[0] ** 2 + 9 * b[1] ** 2)) >= 0.98) or abs(c / 3 - 0.98) < 1e-15
    assert got[0] == 1 and got[10] == 0 and (got[100], got[101], got[102]) == (1, 1, 0)


# -- 9 -------------------------------------------------------------------------------------


def test_line_dedup_against_brute_force(spark, words):
    r = np.random.RandomState(9)
    rows = []
    for k in range(90):
        lines = [prose(words, r, 6) for _ in range(4)] + (["Boiler plate"] if k % 4 == 0 else []) + ([" Boiler plate\t"] if k % 9 == 0 else []) + ["", "rare"] * (k % 30 == 0)
        rows.append((k, "\n".join(lines), "big" if k < 60 else "small" if k < 70 else None))
    rows += [(100, None, "big"), (101, "", "big"), (102, "Boiler plate\n" * 3000 + "x", "big"), (5, rows[5][1], "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lines", F.lit(1)).withColumn("host", F.lit("h"))
    got = sorted(((x["doc_id"], x["text"], x["_removed"]) for x in linededup.drop_boilerplate(df).collect()), key=str)
    pages, seen = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        seen.update({(s, x.strip(" \t\r")) for x in (t or "").split("\n") if x.strip(" \t\r")})
    bad = {key for key, n in seen.items() if n > 1 and n > pages[key[0]] * 0.1}
    assert ("big", "Boiler plate") in bad and (None, "Boiler plate") in bad and ("small", "Boiler plate") in bad
    want = []
    for k, t, s in rows:
        kept = [x for x in (t or "").split("\n") if (s, x.strip(" \t\r")) not in bad]
        want.append((k, None if t is None else "\n".join(kept), 0 if t is None else t.count("\n") + 1 - len(kept)))
    assert got == sorted(want, key=str)
    assert linededup.drop_boilerplate(df.where("false")).count() == 0


def test_line_dedup_names_small_hosts_and_stage(spark):
    rows = [(k, f"own {k}\nfoot" if k < 4 else "foot", f"s{k // 6}", k) for k in range(6)] + [(6, "one\nand", "s1", 0), (7, "one\nand", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _bp_lines long")
    df = df.withColumn("_bp_host", F.lit("x")).withColumn("bad", F.lit(1)).withColumn("row", F.lit(2)).withColumn("n", F.lit(3)).withColumn("_removed", F.lit("mine"))
    got = linededup.drop_boilerplate(df, removed="gone")
    assert got.columns == [*df.columns, "gone"]
    out = {x["doc_id"]: x for x in got.collect()}
    assert [out[k]["text"] for k in range(8)] == ["own 0", "own 1", "own 2", "own 3", "", "", "", ""] and out[6]["gone"] == 2
    assert all(x["_removed"] == "mine" and x["_bp_host"] == "x" and x["n"] == 3 and x["_bp_lines"] == (x["doc_id"] if x["doc_id"] < 6 else 0) for x in out.values())
    kept = linededup.stage(spark, df, "")
    assert kept.columns == df.columns
    assert {x["doc_id"]: x["text"] for x in kept.collect()} == {0: "own 0", 1: "own 1", 2: "own 2", 3: "own 3", 6: "one\nand", 7: "one\nand"}
    with_size = linededup.stage(spark, df.withColumn("n_chars", F.lit(1).cast("long")), "")
    assert sorted(x["n_chars"] for x in with_size.collect()) == [5, 5, 5, 5, 7, 7]


# -- 10 ------------------------------------------------------------------------------------


def test_place_is_full_and_gapless():
    r = np.random.RandomState(10)
    for _ in range(30):
        sizes = r.randint(0, 100, r.randint(0, 60)).tolist()
        rows = packing.place(sizes, 100)
        fill, parts = defaultdict(list), defaultdict(list)
        for k, start, n, s, offset in rows:
            fill[s].append((offset, n))
            parts[k].append((start, n))
        assert len(fill) == -(-sum(sizes) // 100)
        for p in fill.values():
            at = 0
            for offset, n in sorted(p):
                assert offset == at and n > 0
                at += n
            assert at <= 100
        for k, n in enumerate(sizes):
            at = 0
            for start, m in sorted(parts[k]):
                assert start == at
                at += m
            assert at == n


def test_place_takes_the_cheapest_sequence_with_room():
    r = np.random.RandomState(13)
    for n in (40, 1800):
        sizes = np.minimum(np.exp(r.normal(6, 1, n)).astype(int), 9000).tolist()
        room = packing.SEQUENCE
        count = -(-sum(sizes) // room)
        used, spent = [0] * count, [0.0] * count
        want = []
        for k in sorted((k for k in range(n) if sizes[k]), key=lambda k: (-sizes[k], k)):
            fits = [(spent[s], s) for s in range(count) if used[s] + sizes[k] <= room]
            start = 0
            for s in [min(fits)[1]] if fits else sorted((s for s in range(count) if used[s] < room), key=lambda s: (used[s], spent[s], s)):
                take = min(sizes[k] - start, room - used[s])
                if take:
                    want.append((k, start, take, s, used[s]))
                    used[s] += take
                    spent[s] += packing.cost(take)
                    start += take
        assert packing.place(sizes, room) == want


def test_packing_rows(spark, words):
    from tokenizers import Tokenizer

    r = np.random.RandomState(11)
    texts = [prose(words, r, n) for n in r.randint(1, 900, 60)] + [prose(words, r, 12000), None, "", "A b"]
    df = docs(spark, texts).withColumn("key", F.lit(1))
    df = df.unionAll(df.where("doc_id = 63")).unionAll(df.where("doc_id = 62").withColumn("doc_id", F.lit(None).cast("long")))
    rows = packing.pack(df, 2, WORD).collect()
    tool = Tokenizer.from_file(WORD)
    want = Counter()
    for x in df.collect():
        want[x["doc_id"], tuple(tool.encode(x["text"] or "", add_special_tokens=False).ids + [2])] += 1
    by = defaultdict(list)
    for x in rows:
        ids = np.frombuffer(x["ids"], "<u4")
        assert len(ids) == x["length"] and zlib.crc32(x["ids"]) == x["ids_crc32"]
        by[x["doc_id"]].append((x["start"], x["length"], ids.tolist(), x["doc_tokens"]))
    for (k, ids), copies in want.items():
        if copies == 1:
            assert [i for _, _, p, _ in sorted(by[k]) for i in p] == list(ids) and all(n == len(ids) for *_, n in by[k])
    assert len(by[63]) == 2 and len(by[None]) == 1
    fill = defaultdict(list)
    for x in rows:
        fill[x["sequence_id"]].append((x["offset"], x["length"]))
    for p in fill.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 4096
    assert sum(4096 - sum(n for _, n in p) for p in fill.values()) < 2 * 4096
    assert packing.pack(df.where("false"), 1, WORD).count() == 0
    same = packing.pack(df, 2, WORD, with_ids=False).drop("ids").collect()
    assert Counter((x["doc_id"], x["start"], x["length"], x["ids_crc32"]) for x in same) == Counter((x["doc_id"], x["start"], x["length"], x["ids_crc32"]) for x in rows)


# -- pipeline ------------------------------------------------------------------------------


def test_pipeline(spark, words, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = np.random.RandomState(12)
    texts = [prose(words, r, 60) + ".\n" + ("Same line here" if k % 2 else prose(words, r, 5)) for k in range(50)]
    texts += [texts[3], "12 34", None, prose(words, r, 50) + " me@mail.example.com"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {x["doc_id"] for x in rows}
    assert kept == set(range(54)) - {50, 51, 52}
    from tokenizers import Tokenizer

    back = Tokenizer.from_file(WORD)
    told = {x["doc_id"]: back.decode(np.frombuffer(x["ids"], "<u4").tolist()[:-1]) for x in rows if x["length"] == x["doc_tokens"]}
    assert "email" in told[53] and "mail" not in told[53].replace("email", "")
    assert not any("same</w>line" in t for t in told.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "pii", "packing"]


def test_pipeline_on_an_empty_table_and_without_n_chars(spark, words, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = np.random.RandomState(14)
    texts = [prose(words, r, 60) + ".\nSame line here" for _ in range(40)] + ["Same line here", None]
    df = docs(spark, texts)
    for name, rows in (("empty", df.where("false")), ("full", df), ("bare", df.drop("n_chars")), ("more", df.withColumn("gone", F.lit(1)).withColumn("typical", F.lit(2)).withColumn("_extra", F.lit(3)).withColumn("removed", F.lit(4)))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    run = lambda name: sorted(tuple(x) for x in corpus_pipeline.run(spark, f"{tmp_path}/{name}").drop("ids").collect())
    assert run("empty") == []
    full = run("full")
    assert {x[0] for x in full} == set(range(40)) and run("bare") == full and run("more") == full
    stages = spark.read.parquet(f"{tmp_path}/more/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, stages, f"{tmp_path}/more")
        assert out.columns == stages.columns
        stages = spark.createDataFrame(out.collect(), out.schema)
