"""MinHash near-duplicate detection with tensored banding.

A document's set holds 64-bit hashes of its word shingles. ``COLLECTIONS``
small collections of ``ROWS`` minhashes are computed, and each pair of
collections forms the key of one table: 12 collections of 2 minhashes give 66
tables of 4 minhashes each from 24 minhashes instead of 264. At a similarity
of 0.8 two sets miss every table with a probability of 1e-4, at 0.9 of 2e-7.

Exact copies of a set are folded first. In each bucket of each table all
members are compared with the bucket's smallest one, which makes as many
candidates as there are members. The members of buckets that are then still
in several components are joined exactly by a prefix filter, so that no bucket
is capped and none emits all its pairs. Every link is confirmed on full sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragmatch.llm.arrow import slices, unused, utf8
from fragmatch.operators.components import components
from fragmatch.plans.scratch import drop, save

COLLECTIONS, ROWS = 12, 2
#: Words and hashes take many times their text's memory, so texts are taken in small parts.
PART_BYTES = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = _rng.integers(0, 1 << 63, (COLLECTIONS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply) that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, and len + 1 offsets.

    A word is a run of bytes other than space and 0x09-0x0D, A-Z lower-cased.
    A word's hash is the sum of its bytes' random values times rising powers
    of an odd number, taken as differences of running sums and shifted back.
    """
    raw = _LOWER[raw]
    space = _SPACE[raw]
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~space
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    width = end - begin
    h = np.zeros(len(begin), np.uint64)
    longest = int(width.max()) if len(width) else 0
    if longest <= 64:
        live = np.arange(len(begin))
        at = begin.copy()
        while len(live):
            h[live] = (h[live] + _BYTE[raw[at[live]]]) * _BASE
            at[live] += 1
            live = live[at[live] < end[live]]
    else:
        value = _BYTE[raw]
        for k, (b, e) in enumerate(zip(begin.tolist(), end.tolist())):
            if e - b > 64:
                powers = np.multiply.accumulate(np.full(e - b, _BASE, np.uint64))[::-1]
                h[k] = (value[b:e] * powers).sum(dtype=np.uint64)
        short = np.flatnonzero(width <= 64)
        at, live = begin.copy(), short
        while len(live):
            h[live] = (h[live] + value[at[live]]) * _BASE
            at[live] += 1
            live = live[at[live] < end[live]]
    return _mix(h ^ width.astype(np.uint64)), np.searchsorted(begin, off)


def _cuts(raw: np.ndarray, limit: int) -> list[int]:
    """Where to part a long text: about every ``limit`` bytes, at white space."""
    out, at = [0], limit
    while at < len(raw):
        gap = next((lo + int(np.argmax(s)) for lo in range(at, len(raw), limit) if (s := _SPACE[raw[lo : lo + limit]]).any()), len(raw))
        out.append(gap)
        at = gap + limit
    return out if out[-1] == len(raw) else [*out, len(raw)]


def _long_set(raw: np.ndarray, size: int) -> np.ndarray:
    """The set of one long text: words and then shingles are hashed a part at a time, parts of shingles sharing ``size`` - 1 words."""
    cuts = _cuts(raw, PART_BYTES)
    words = np.concatenate([word_hashes(raw[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:])])
    if len(words) < size:
        return _shingles(words, np.array([0, len(words)]), size)[0]
    step = PART_BYTES // 4
    some = [_shingles(w := words[k : k + step + size - 1], np.array([0, len(w)]), size)[0] for k in range(0, len(words) - size + 1, step)]
    return np.unique(np.concatenate(some))


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and len + 1 offsets."""
    if len(off) == 2 and len(raw) > 2 * PART_BYTES:
        values = _long_set(raw, size)
        return values, np.array([0, len(values)])
    return _shingles(*word_hashes(raw, off), size)


def _shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, from the hashes of the texts' words."""
    count = np.diff(at)
    parts = np.zeros(len(words), np.uint64)
    for k in range(size):  # up to ``size`` words from each start, as far as the text goes
        shifted = np.zeros(len(words), np.uint64)
        shifted[: len(words) - k] = words[k:]
        parts = parts * np.uint64(0xD6E8FEB86659FD93) + shifted
    full = _mix(parts)
    owner = np.repeat(np.arange(len(count)), count)
    left = at[1:][owner] - np.arange(len(words))
    keep = left >= size
    short = np.flatnonzero((count > 0) & (count < size))
    extra = count[short].astype(np.uint64)
    for k in range(size - 1):  # arrays, so that products wrap around
        some = count[short] > k
        extra[some] = extra[some] * np.uint64(0xD6E8FEB86659FD93) + words[at[short[some]] + k]
    owner = np.concatenate([owner[keep], short])
    values = np.concatenate([full[keep], _mix(extra)])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], np.searchsorted(owner[first], np.arange(len(count) + 1))


def minhashes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, collections x rows) minima of the sets that are not empty."""
    out = np.zeros((len(at) - 1, len(_SEEDS)), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for k, (a, b) in enumerate(_SEEDS):
            h = (values ^ b) * a
            h ^= h >> np.uint64(32)
            out[full, k] = np.minimum.reduceat(h * _BASE, at[full])
    return out


def table_keys(mins: np.ndarray) -> np.ndarray:
    """(texts, tables) keys: each pair of collections makes one table."""
    parts = np.zeros((len(mins), COLLECTIONS), np.uint64)
    for k in range(ROWS):
        parts = _mix(parts * _BASE + mins[:, k::ROWS])
    pairs = list(combinations(range(COLLECTIONS), 2))
    return np.stack([_mix(parts[:, i] * _BASE + parts[:, j] + np.uint64(t)) for t, (i, j) in enumerate(pairs)], axis=1)


def _signatures(size: int):
    """Per text: set size, a 128-bit digest of the set, and minhashes."""

    def run(batches):
        for part in slices(batches, "text", PART_BYTES):
            values, at = shingle_sets(*utf8(part["text"]), size)
            n = np.diff(at)
            sums = np.zeros((len(n), 2), np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                sums[full, 0] = np.add.reduceat(_mix(values), at[full])
                sums[full, 1] = np.add.reduceat(_mix(values ^ _BASE), at[full])
            mins = [m.tobytes() if k else None for m, k in zip(minhashes(values, at), n)]
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(n.astype(np.int64)), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), pa.array(mins, pa.binary())], names=["id", "n", "h1", "h2", "mins"])

    return run


def _keys(batches):
    tables = COLLECTIONS * (COLLECTIONS - 1) // 2
    for batch in batches:
        mins = np.frombuffer(b"".join(batch["mins"].to_pylist()), np.uint64).reshape(-1, len(_SEEDS))
        yield pa.RecordBatch.from_arrays([pa.array(table_keys(mins).ravel().view(np.int64)), pa.array(np.repeat(batch["id"].to_numpy(zero_copy_only=False), tables))], names=["key", "id"])


#: Bits of the filter that keeps texts without candidates from being read twice: 16 for each, from 2 MB up to 64 MB.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 29


def _sets_of(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, n, words): full sets of at least the texts whose id is among ``ids``.

    A bitmap of hashed ids goes along with the scan, of a size that follows
    their number up to a bound; what it lets through by chance is never asked
    for.
    """
    spark = rows.sparkSession
    ids = ids.distinct()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    parts = ids.select(bit("id").alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    width = 32768
    table = np.zeros((bits // width + 2, width // 8), np.uint8)
    for r in parts.collect():  # bits / 32768 + 1 rows at most
        table[r["k"]] = np.frombuffer(bytes(r["m"]), np.uint8)
    held = spark.sparkContext.broadcast(table)
    numbered = rows.where("id is not null").select("id", "text", F.bitmap_bucket_number(bit("id")).cast("int").alias("k"), F.bitmap_bit_position(bit("id")).cast("int").alias("at"))

    def run(batches):
        for batch in batches:
            k, at = batch["k"].to_numpy(), batch["at"].to_numpy()
            some = np.flatnonzero(held.value[k, at >> 3] >> (at & 7).astype(np.uint8) & 1)
            for part in slices(iter([batch.take(pa.array(some))]), "text", PART_BYTES):
                values, ends = shingle_sets(*utf8(part["text"]), size)
                sets = [values[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.diff(ends).astype(np.int64)), pa.array(sets, pa.binary())], names=["id", "n", "words"])

    return numbered.mapInArrow(run, "id long, n long, words binary")


def _confirm(percent: int):
    """Rows (a, b, sa, sb) whose sets' similarity is at least ``percent`` / 100."""

    def run(batches):
        for batch in batches:
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            ok = np.zeros(len(a), bool)
            for k in range(len(a)):
                x, y = np.frombuffer(batch["sa"][k].as_buffer(), np.uint64), np.frombuffer(batch["sb"][k].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link; each pair's sets are fetched by two equi-joins."""
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("words").alias("sb")), "b")
    with_a = with_b.join(sets.select(F.col("id").alias("a"), F.col("words").alias("sa")), "a")
    return with_a.select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``.

    Links are pairs of sets of ``size``-word shingles with a similarity of
    ``percent`` / 100 or more. A text with fewer words is one shingle; one
    without words, or null, has an empty set and links with nothing.
    ``component_id`` is the smallest id that links reach. Ids should be unique;
    of rows with one id all count, under that id. A row with a null id gets
    null as its component, links nothing and is kept.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    base = save(rows.mapInArrow(_signatures(size), "id long, n long, h1 long, h2 long, mins binary"))
    full = base.where("n > 0 and id is not null")
    # saved before they are joined, so that Spark can split a large group's rows
    classes = save(full.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    member = save(full.select("id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    one = full.select("id", "mins").join(member.select(F.col("a").alias("id")), "id", "left_anti")
    keys = one.mapInArrow(_keys, "key long, id long")
    leads = keys.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count("*").alias("m")).where("last <> lead")
    leads = save(leads.select("key", "lead", "m"))
    shared = save(keys.join(leads, "key"))
    star = save(shared.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    sets = save(_sets_of(rows, shared.select("id"), size))
    links = save(_verified(star, sets, percent))
    links = _follow_up(shared, sets, links, percent)
    comp = components(member.unionAll(links))
    drop(classes, member, leads, shared, star, sets)
    out = base.select("id", "n").join(comp, base["id"] == comp["node"], "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _tokens(batches):
    for batch in batches:
        for part in slices(iter([batch]), "words", 8 << 20):
            sets = [np.frombuffer(w, np.int64) for w in part["words"].to_pylist()]
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([part["id"].take(take), part["n"].take(take), part["c"].take(take), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["id", "n", "c", "token"])


def _follow_up(shared: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between members of open buckets, those whose members the stars left in several components.

    An exact join over the members' full sets, by prefix filtering: with tokens
    ordered by rarity, two sets of the similarity share one among their first
    n - ceil(percent n / 100) + 1 tokens, and its places bound what they can
    share. Only pairs in different components count (by two steps along links,
    which may part a component but never joins two), and of each token's rows
    those outside its largest component are compared with the others; so a
    large group of near copies in one component, or in which no two are alike
    enough, makes few candidates. No pair of members that links is left out.
    """
    up = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))  # a leads b and is smaller
    top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
    comp = save(up.join(top, "up", "left").select("node", F.coalesce("top", "up").alias("component")))
    here = shared.where("m > 2").select("key", "id")
    here = here.join(comp, here["id"] == comp["node"], "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    opened = here.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    members = save(here.join(opened, "key").select("id", "c").distinct())
    tokens = save(sets.join(members, "id").select("id", "n", "c", "words").mapInArrow(_tokens, "id long, n long, c long, token long"))
    common = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("f", F.lit(1)), "token"))
    ranked = tokens.join(common, "token", "left").withColumn("r", order)
    prefix = ranked.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & F.col("f").isNotNull()).select("token", "id", "n", "c", "r")
    prefix = save(prefix)
    sizes = prefix.groupBy("token", "c").agg(F.count("*").alias("k"))
    big = sizes.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("big"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    rows = save(prefix.join(big, "token"))
    x, y = rows.where("c <> big").alias("x"), rows.alias("y")
    n1, n2 = F.col("x.n"), F.col("y.n")
    most = F.least(n1 - F.col("x.r") + 1, n2 - F.col("y.r") + 1)
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.big")) | (F.col("y.id") < F.col("x.id")))
    on = on & (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * most >= percent * (n1 + n2))
    pairs = save(x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    return links.unionAll(_verified(pairs, sets, percent))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, size=2).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, 0.8)."""
    gone = unused(docs.columns, "gone")
    found = save(near_duplicates(docs).where("not kept").select(F.col("id").alias(gone)).distinct())
    return docs.join(found, docs["doc_id"] == found[gone], "left_anti")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_distinct(list_transform(generate_series(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1])) END AS grams FROM w
), n AS (SELECT doc_id, len(grams) AS n FROM s
), g AS (SELECT doc_id, unnest(grams) AS gram FROM s
), both_in AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM both_in JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), best AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(low, n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(low, n.doc_id)) AS kept
FROM n LEFT JOIN best ON n.doc_id = best.a
"""
