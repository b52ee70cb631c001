"""Substring dedup by hashing pieces of sentences, joined to units of enough words.

Every text is cut into pieces at line ends and after sentence ends, and within
sentences before anchor words: those whose hash is the smallest among the
``REACH`` words on either side in the sentence, so that a passage inside a
longer sentence has cuts of its own. A unit runs from a cut to the first one
``MIN_WORDS`` words or more away, forwards and backwards, so that short pieces
are joined to their neighbours and every word of a text of that many words is
in a unit. Cuts in a sentence depend on that sentence alone: a repeated
sentence, line or run of sentences of ``MIN_WORDS`` words is made of repeated
units. Units are normalised (lower case, words only) and digested; digests are
grouped globally for the smallest rank (document, then position), and every
other occurrence is removed where repeated units that touch each other make a
run of ``MIN_RUN`` words: a shorter one, such as one sentence or one line of a
site, may recur by chance or on purpose, unless it is a whole text. Removed and kept parts keep their
offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.llm.arrow import plus, slices
from fragmatch.plans.scratch import drop, save

MIN_WORDS = 8
#: Words that repeated units which touch each other must have in all.
MIN_RUN = 15
#: An anchor's hash is the smallest of so many words on either side.
REACH = 6
_UNIT = re.compile(r"[^\n]*?(?<![.!?])[.!?]++(?=\s|\Z)\s*|[^\n]+\n?|\n")
_WORD = re.compile(r"\w+")


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=12).digest()


def _pieces(text: str) -> tuple[list[str], list[int], list[int]]:
    """The words of ``text``, and for each cut its place in code points and the words before it.

    Every piece between cuts has a word; white space and marks alone go to the piece before.
    """
    words: list[str] = []
    starts, ends = [], []
    place, count = [0], [0]
    for m in _UNIT.finditer(text):
        n = len(words)
        for w in _WORD.finditer(text, m.start(), m.end()):
            words.append(w.group().lower())
            starts.append(w.start())
        if len(words) == n:
            if n:
                place[-1] = m.end()
            continue
        ends.append((n, len(words)))
        place.append(m.end())
        count.append(len(words))
    if not words:
        return words, [0], [0]
    place[-1] = len(text)
    if max(b - a for a, b in ends) > 2 * REACH:
        hashes = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
        near = np.ones(len(words), bool)
        for k in range(1, REACH + 1):
            near[k:] &= hashes[k:] < hashes[:-k]
            near[:-k] &= hashes[:-k] <= hashes[k:]
        for a, b in ends:
            near[a : a + REACH] = False
            near[max(a, b - REACH) : b] = False
        at = np.flatnonzero(near).tolist()
        both = sorted([*zip(count, place), *((k, starts[k]) for k in at)])
        count, place = [c for c, _ in both], [p for _, p in both]
    return words, place, count


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the units of ``text``, in code points, without repeated spans."""
    words, place, count = _pieces(text)
    if len(words) < min_words:
        return []
    spans, last = [], len(count) - 1
    to = 0
    for a in range(last):  # forwards
        while to <= last and count[to] - count[a] < min_words:
            to += 1
        if to > last:
            break
        spans.append((a, to))
    seen = set(spans)
    at = 0
    for b in range(1, last + 1):  # backwards
        while count[b] - count[at + 1] >= min_words:
            at += 1
        if count[b] - count[at] >= min_words and (at, b) not in seen:
            spans.append((at, b))
    return [(place[a], place[b], _digest(words[count[a] : count[b]])) for a, b in spans]


def merged(spans) -> list[tuple[int, int]]:
    """Sorted (start, end) spans without overlaps."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def long_runs(text: str, spans: list[tuple[int, int]], min_run: int = MIN_RUN) -> list[tuple[int, int]]:
    """Those of sorted ``spans`` that, with the ones they touch, hold ``min_run`` words of ``text`` or all of it."""
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    for span in [*spans, (len(text) + 1, len(text) + 1)]:
        if run and span[0] != run[-1][1]:
            if (run[0][0] == 0 and run[-1][1] == len(text)) or sum(1 for _ in _WORD.finditer(text, run[0][0], run[-1][1])) >= min_run:
                out += run
            run = []
        run.append(span)
    return out


def _digests(min_words: int):
    def run(batches):
        for part in slices(batches, "text"):
            ids, hs, starts, ends, digests = [], [], [], [], []
            for i, h, t in zip(part["id"].to_pylist(), part["h"].to_pylist(), part["text"].to_pylist()):
                for s, e, d in units(t or "", min_words):
                    ids.append(i)
                    hs.append(h)
                    starts.append(s)
                    ends.append(e)
                    digests.append(d)
            both = np.frombuffer(b"".join(digests), np.dtype([("d1", "<i8"), ("d2", "<i4")]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(both["d1"].copy()), pa.array(both["d2"].copy())], names=["id", "h", "start", "end", "d1", "d2"])

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, h, gone): per text (by id and hash) the spans of units that occur earlier.

    Digests are grouped with map-side minima, so that a unit which a third of
    all texts share costs each task one row; the leads are saved, so that Spark
    can split the rows of such a unit in the join.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).where("id is not null")
    found = save(rows.mapInArrow(_digests(min_words), "id long, h long, start int, end int, d1 long, d2 int"))
    rank = F.struct("id", "h", "start")
    first = save(found.groupBy("d1", "d2").agg(F.min(rank).alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = found.join(first, ["d1", "d2"]).where(rank > F.col("lead")).select("id", "h", "start", "end")
    gone = save(later.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("gone")))
    drop(found, first)
    return gone


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with ``clean_text`` and ``removed``, an array of (start, end) in the original text.

    The earliest occurrence by (id, text hash, start) stays, and so do runs of
    repeated units under ``min_run`` words that are not the whole text. Null texts give a null clean
    text; rows with a null id lose nothing; identical rows count as one
    document and keep and lose the same. Columns of the new names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("clean_text", "removed")]
    found = repeats(docs, id_col, text, min_words)
    on = (docs[id_col].cast("long") == found["id"]) & (F.xxhash64(docs[text]) == found["h"])
    joined = docs.join(found, on, "left").select(*[docs[c] for c in keep], F.coalesce(found["gone"], F.array().cast("array<struct<start:int,end:int>>")).alias("removed"))

    names = joined.columns

    def run(batches):
        for part in slices(batches, text):
            out, spans = [], []
            for t, gone in zip(part[text].to_pylist(), part["removed"].to_pylist()):
                cut = long_runs(t, merged((g["start"], g["end"]) for g in gone), min_run) if gone else []
                if t is not None and cut:
                    bits, at = [], 0
                    for s, e in cut:
                        bits.append(t[at:s])
                        at = e
                    t = "".join([*bits, t[at:]])
                out.append(t)
                spans.append([{"start": s, "end": e} for s, e in cut])
            told = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*[told if c == "removed" else part[c] for c in names], pa.array(out, pa.string())], names=[*names, "clean_text"])

    return joined.mapInArrow(run, plus(joined.schema, clean_text="string"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    told = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return drop_repeats(docs).select("doc_id", F.size("removed").cast("long").alias("n_removed"), told.alias("removed_spans"), "clean_text")
