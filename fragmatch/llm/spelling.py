"""Spelling variants by a symmetric-delete join.

Every distinct word emits itself and its distinct single deletions as 64-bit
polynomial hashes, worked out for all its places at once by running sums, with
the places whose deletion gives that string. Words meet by an equi-join on the
hash, and only where one is the other's deletion, or where both lack a character
at one place: so the words that share a deletion are not paired with each other
beyond real neighbours. The strings themselves confirm the distance of exactly
one. Each word's most frequent neighbour is its form, if frequent enough, and
forms are followed by joins that double the length of the path.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.llm.arrow import release, slices
from fragmatch.plans.scratch import drop, save

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
#: One in so many runs of a document loses a code point.
LOSS = 31
#: A task's table of counts is emptied at so many words.
HELD = 100_000
_SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = "A-Za-zÀ-ÿ"


def runs(text: str, least: int):
    """Maximal runs of letters with at least ``least`` code points, A-Z lower-cased, a segment of the text at a time."""
    find, rest = re.compile(f"[{_LETTER}]{{{least},}}"), re.compile(f"[{_LETTER}]*")
    at = 0
    while at < len(text):
        end = rest.match(text, min(len(text), at + _SEGMENT)).end()  # a run is never cut
        # bytes lower-case ASCII only
        yield from find.findall(text[at:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
        at = end


def thinned(run: str, start: int) -> str:
    """``run`` without one code point, if its CRC-32 (from that of what stands before it) is divisible by ``LOSS``."""
    h = zlib.crc32(run.encode("utf-8", "surrogatepass"), start)
    if h % LOSS:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words of at least ``least_length`` code points and ``least_count`` occurrences.

    Null and empty texts have none. Rows with a null id keep their runs whole.
    Repeated rows count as often as they come. Tasks count before anything is shuffled.
    """

    def run(batches):
        held: dict[str, int] = {}

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in slices(batches, "text"):
            for key, body in zip(batch["id"].to_pylist(), batch["text"]):
                start = None if key is None else zlib.crc32(f"{key}:".encode())
                mine: dict[str, int] = {}
                for found in runs(body.as_py() or "", least_length):
                    mine[found] = mine.get(found, 0) + 1
                    if len(mine) >= HELD:  # a long text: what it has so far; a run thins alike wherever it stands
                        yield from _poured(mine, held, start, least_length, out)
                yield from _poured(mine, held, start, least_length, out)
        if held:
            yield out()
        release()

    found = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _poured(mine: dict, held: dict, start: int | None, least: int, out):
    """Adds a document's counts to the task's; yields that table when it is full."""
    for word, n in mine.items():
        if start is not None:
            word = thinned(word, start)
            if len(word) < least:
                continue
        held[word] = held.get(word, 0) + n
    mine.clear()
    if len(held) >= HELD:
        yield out()


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's index, hash, first and last place) of every word itself (places -1) and of its distinct single deletions."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    place = np.arange(len(codes)) - first[owner]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max(initial=0)), _BASE)]), dtype=np.uint64)
    here, left = (codes + np.uint64(1)) * power[place], (codes + np.uint64(1)) * power[np.maximum(place - 1, 0)]
    sums = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
    a, b = sums(here), sums(left)
    whole = a[first + size] - a[first]
    at = np.arange(len(codes))
    lacking = (a[at] - a[first[owner]]) + (b[(first + size)[owner]] - b[at + 1])
    # equal neighbours: deleting either gives the same string
    begins = np.ones(len(codes), bool)
    begins[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(begins)
    ends = np.concatenate([starts[1:], [len(codes)]]) - 1 if len(starts) else starts
    word = np.concatenate([np.arange(len(words)), owner[starts]])
    lo = np.concatenate([np.full(len(words), -1), place[starts]])
    hi = np.concatenate([np.full(len(words), -1), place[ends] if len(starts) else place[:0]])
    return word, np.concatenate([whole, lacking[starts]]).view(np.int64), lo, hi


def neighbours(words: DataFrame) -> DataFrame:
    """(a, b) of rows (id, word): each unordered pair of words that differ by exactly one inserted, deleted or replaced code point, once.

    ``words`` has distinct words and ids and is read more than once, so that it should be a saved table.
    """

    def run(batches):
        for batch in slices(batches, "word", 1 << 18):
            word, key, lo, hi = keys(batch["word"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(word)), pa.array(key), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["id", "key", "lo", "hi"])

    emitted = save(words.select("id", "word").mapInArrow(run, "id long, key long, lo int, hi int"))
    a, b = (emitted.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "lo", "hi")]) for s in "ab")
    own = (F.col("a_lo") < 0) | (F.col("b_lo") < 0)
    both = (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))
    met = a.join(b, (a["key"] == b["key"]) & (F.col("a_id") < F.col("b_id")) & (own | both))
    met = met.select("a_id", "a_lo", "b_id", "b_lo")
    for s in "ab":
        w = words.select(F.col("id").alias(f"{s}_id"), F.col("word").alias(f"{s}_word"))
        met = met.join(w, f"{s}_id")
    bare = lambda s: F.when(F.col(f"{s}_lo") < 0, F.col(f"{s}_word")).otherwise(
        F.concat(F.substr(F.col(f"{s}_word"), F.lit(1), F.col(f"{s}_lo")), F.substr(F.col(f"{s}_word"), F.col(f"{s}_lo") + 2))
    )
    return met.where(bare("a") == bare("b")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of rows (word, n) with distinct words.

    ``form`` is the near word of the largest n (ties: the smallest in the order
    of code points), if that is at least ``ratio`` (above 1) times the word's,
    else null. ``root`` follows forms to the last; n grows on the way, so there
    is no circle and a path has at most log(largest n) / log(ratio) steps.
    """
    words = save(counted.select("word", "n").withColumn("id", F.monotonically_increasing_id()))
    pairs = save(neighbours(words))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both.join(words.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("word").alias("w")), "b")
    near = side.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "w", "b")).alias("top"))
    joined = words.join(near, words["id"] == near["a"], "left").withColumn("top_n", -F.col("top.m"))
    fits = F.coalesce(F.col("top_n") >= F.col("n") * ratio, F.lit(False))
    formed = save(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(fits, c).alias(x) for x, c in (("form", F.col("top.w")), ("form_n", F.col("top_n")), ("next", F.col("top.b")))]))
    drop(pairs)

    # who has a form, and where its path leads so far; each round doubles the steps
    way = save(formed.where("next is not null").select("id", "next"))
    while True:
        on = way.select(F.col("id").alias("next"), F.col("next").alias("after"))
        if way.join(on, "next", "left_semi").isEmpty():
            break
        was, way = way, save(way.join(on, "next", "left").select("id", F.coalesce("after", "next").alias("next")))
        drop(was)
    last = way.join(words.select(F.col("id").alias("next"), F.col("word").alias("root")), "next").select("id", "root")
    return formed.join(last, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
