"""Substring dedup against rules stated in plain words, without the module's own units."""

import random
import re

import pytest

from fragmatch.llm import substring


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    stock = [line(n) for n in (8, 9, 11, 14, 15, 20, 30, 8, 8, 5, 3)]
    texts = []
    for _ in range(40):
        lines = [line(rng.randint(2, 25)) for _ in range(rng.randint(1, 6))]
        for _ in range(rng.randint(0, 3)):
            at, k = rng.randint(0, len(lines)), rng.randint(0, len(stock) - 1)
            lines[at:at] = stock[k : k + rng.randint(1, 2)]
        texts.append("\n".join(x.capitalize() if rng.random() < 0.2 else x for x in lines))
    return [*texts, texts[3], "", stock[0], stock[0] + "\n" + stock[0]]


def gone_words(text, removed):
    """Whether each word is cut, by its place."""
    return [any(g["start"] <= m.start() < g["end"] for g in removed) for m in re.finditer(r"\w+", text)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("min_run", [0, 15])
def test_what_must_go_and_what_must_stay(spark, seed, min_run):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {x["doc_id"]: x for x in substring.drop_repeats(df, min_run=min_run).collect()}
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    lines, windows = {}, {}
    for d, t in enumerate(texts):
        at = 0
        for k in range(len(words[d]) - 7):  # eight words in a row: where they are first
            windows.setdefault(tuple(words[d][k : k + 8]), (d, k))
        for x in t.split("\n"):
            n = len(x.split())
            lines.setdefault(x.lower(), []).append((d, at, n))
            at += n
    must_go = must_stay = 0
    for d, t in enumerate(texts):
        cut = gone_words(t, rows[d]["removed"])
        assert len(cut) == len(words[d])
        # a word may go only in eight words in a row that stand somewhere before
        may = [False] * len(cut)
        for k in range(len(cut) - 7):
            if windows[tuple(words[d][k : k + 8])] != (d, k):
                may[k : k + 8] = [True] * 8
        assert not any(c and not m for c, m in zip(cut, may))
        must_stay += sum(not m for m in may)
        # a whole line of eight words or more that stands somewhere before goes; with min_run, lines in a row with so many words, or the whole text
        repeated, at = [], 0
        for x in t.split("\n"):
            n = len(x.split())
            repeated.append((at, n, n >= 8 and lines[x.lower()][0][:2] != (d, at)))
            at += n
        run = []
        for place, n, again in [*repeated, (at, 0, False)]:
            if again:
                run.append((place, n))
                continue
            total = sum(m for _, m in run)
            if run and (total >= min_run or total == len(cut)):
                must_go += total
                assert all(cut[run[0][0] : run[-1][0] + run[-1][1]])
            run = []
        kept = "".join(c for k, c in enumerate(t) if not any(g["start"] <= k < g["end"] for g in rows[d]["removed"]))
        assert rows[d]["clean_text"] == kept
    assert must_go > 150 and must_stay > 1000
