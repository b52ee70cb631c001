"""Personal data: fixed forms, and bootstrapped contextual extraction.

Base identifiers (email, ip, card, phone) are found by their forms and serve
as seeds. The words around seeds and around other number-like or address-like
strings ("instances") are lexical patterns. Spark scores the bipartite graph of
patterns and instances to the fixed point: a pattern is as good as the share of
its instances, a new instance as its best pattern. Patterns of a high score that
enough different seeds support discover instances that no fixed form allows,
such as a card number whose check digit is wrong. What is discovered joins the
seeds, so that the contexts it is found in elsewhere can become patterns too,
until a round discovers nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.llm.arrow import slices, unused
from fragmatch.plans.scratch import drop, save

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 5
MIN_SCORE = 0.9
#: Weight of unseen evidence against a pattern.
PRIOR = 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NO_DIGIT = re.compile(r"[^0-9]+")
#: Numbers that white space or brackets part, as the forms of cards and phones allow; no part of a word.
_RUN = re.compile(r"(?<![^\s\"'\[{<:=#,;])[+(]{0,2}[0-9](?:[\x20().-]*[0-9])*\)?(?![\w@+-]|\.\w)")
_STRING = re.compile(r"\S+")
_TRIM = ".,;:!?()[]{}\"'*#&%$|<>="


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@``: the run before it and the domain after it, so that long runs are read once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base identifiers of ``text``, in order."""
    out = []
    if _ANY.search(text) is None:
        return out
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _marked(text: str) -> Iterator[tuple[int, str]]:
    """(start, string) of the strings between white space that hold a digit or ``@``: found from that character, so that long words are read once."""
    m = _ANY.search(text)
    while m:
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        token = _STRING.match(text, start)
        yield start, token.group()
        m = _ANY.search(text, token.end())


def _shapes(token: str) -> list[int]:
    """Kinds that a string outside the fixed forms may be an instance of."""
    digits = sum(c.isdigit() for c in token)
    out = []
    if "@" in token[1:-1]:
        out.append(0)
    if token.count(".") == 3 and digits >= 4 and all(p.isdigit() for p in token.split(".")):
        out.append(1)
    if digits >= 12 and all(c.isdigit() or c == "-" for c in token):
        out.append(2)
    if 7 <= digits <= 15 and all(c.isdigit() or c in "+-().-" for c in token):
        out.append(3)
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


class _Context:
    """The words of a text: strings between white space, cut where base identifiers begin and end, which stand for their kind.

    Every word is then next to few spans, however long the text or the word.
    """

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.text, self.start, self.end, self.name = text, [], [], []
        at = 0
        for s, kind, e in [*base, (len(text), -1, len(text))]:
            for m in _STRING.finditer(text, at, max(at, s)):
                self._put(m.start(), m.end(), None)
            if kind >= 0 and s >= at:
                self._put(s, e, f"<{KINDS[kind]}>")
            at = max(at, e)

    def _put(self, start: int, end: int, name: str | None) -> None:
        self.start.append(start)
        self.end.append(end)
        self.name.append(name)

    def _word(self, k: int, lo: int, hi: int) -> str:
        return self.name[k] or self.text[max(lo, self.start[k]) : min(hi, self.end[k])].strip(_TRIM).lower()

    def patterns(self, start: int, end: int) -> list[int]:
        """Hashes of the patterns around a span: two words before, and one on either side."""
        k = bisect_left(self.start, start)
        before = [self._word(i, 0, start) for i in range(max(0, k - 2), k)]
        k = bisect_right(self.end, end)
        after = self._word(k, end, len(self.text)) if k < len(self.end) else ""
        out = []
        if len(before) == 2 and all(before):
            out.append(_hash(f"2 {before[0]} {before[1]}"))
        if before and before[-1] and after:
            out.append(_hash(f"1 {before[-1]} {after}"))
        return out


def _runs(text: str) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, shapes) of cards and phones that are written as several strings."""
    for m in _RUN.finditer(text):
        start, end, run = m.start(), m.end(), m.group()
        if run[0] == "(" and ")" not in run:
            start += 1
        if run[-1] == ")" and "(" not in run:
            end -= 1
        run = text[start:end]
        if " " not in run or any(1 in _shapes(x.strip(_TRIM)) for x in run.split()):
            continue
        digits = sum(c.isdigit() for c in run)
        shapes = [2] if 12 <= digits <= 19 and all(c.isdigit() or c in " -" for c in run) else []
        if 7 <= digits <= 15:
            shapes.append(3)
        if shapes:
            yield start, end, shapes


def _instances(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, shapes) of numbers in several strings, and of other strings with a digit or ``@``, that no base span touches."""
    spans, k = sorted((s, e) for s, _, e in base), 0
    runs = []
    for start, end, shapes in _runs(text):
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k == len(spans) or spans[k][0] >= end:
            runs.append((start, end))
            yield start, end, shapes
    spans, k = sorted(spans + runs), 0
    for at, token in _marked(text):
        bare = token.strip(_TRIM)
        if not bare:
            continue
        start = at + token.index(bare)
        end = start + len(bare)
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k < len(spans) and spans[k][0] < end:
            continue
        yield start, end, _shapes(bare)


def _edges(batches):
    """One row for each pattern of each seed (kind, seed) and of each other instance (no kind)."""
    for part in slices(batches, "text"):
        rows: dict[str, list] = {c: [] for c in ("id", "h", "pattern", "instance", "kind", "seed", "start", "end")}

        def put(*values, rows=rows):
            for c, v in zip(rows, values):
                rows[c].append(v)

        for i, h, text in zip(part["id"].to_pylist(), part["h"].to_pylist(), part["text"].to_pylist()):
            if text is None or _ANY.search(text) is None:
                continue
            base = base_spans(text)
            around = _Context(text, base)
            for s, kind, e in base:
                for p in around.patterns(s, e):
                    put(i, h, p, _hash(text[s:e]), kind, True, s, e)
            for s, e, shapes in _instances(text, base):
                for p in around.patterns(s, e):
                    for kind in shapes or [-1]:
                        put(i, h, p, _hash(text[s:e]), kind, False, s, e)
        yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()))], names=list(rows))


def _scores(graph: DataFrame) -> DataFrame:
    """(pattern, for_kind, score) at the fixed point, for rows (pattern, instance, for_kind, sure, like)."""
    score = save(graph.select("pattern", "for_kind").distinct().withColumn("score", F.lit(0.0)))
    while True:
        # What no other pattern trusts more has the pattern's own score: solved for it, a round ends where plain rounds would
        # come near only. Scores rise to the fixed point and reach it, those of the best patterns first.
        trust = graph.where("like").join(score, ["pattern", "for_kind"]).groupBy("instance", "for_kind").agg(F.max("score").alias("trust"))
        weighed = graph.join(score, ["pattern", "for_kind"]).join(trust, ["instance", "for_kind"], "left")
        sure, like = F.col("sure"), F.col("like") & ~F.col("sure")
        own = like & (F.col("trust") <= F.col("score"))
        value = F.when(sure, F.lit(1.0)).when(like & ~own, F.col("trust")).otherwise(F.lit(0.0))
        solved = F.sum(value) / (F.count("*") + F.lit(PRIOR) - F.count_if(own))
        was, both = score, save(weighed.groupBy("pattern", "for_kind").agg(solved.alias("new"), F.max("score").alias("former")))
        moved = both.where(F.col("new") > F.col("former") + 1e-9).limit(1).count()
        score = save(both.select("pattern", "for_kind", F.col("new").alias("score"))) if moved else both.select("pattern", "for_kind", F.col("new").alias("score"))
        drop(was, *([both] if moved else []))
        if not moved:
            return score


def trusted_patterns(pairs: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """(pattern, kind) of high confidence, for the saved rows (pattern, instance, kind, seed).

    Round by round, what trusted patterns find joins the seeds: it supports
    further patterns, and counts for them in full. Nothing ever leaves, so that
    the rounds end, at the first one that finds nothing new.
    """
    good = accepted = None
    found = 0
    while True:
        known = pairs.withColumn("sure", F.col("seed"))
        if accepted is not None:
            mine = accepted.select(F.col("instance").alias("_i"), F.col("kind").alias("_k"))
            known = pairs.join(mine, (pairs["instance"] == mine["_i"]) & (pairs["kind"] == mine["_k"]), "left")
            known = known.select(*[pairs[c] for c in pairs.columns], (F.col("seed") | F.col("_i").isNotNull()).alias("sure"))
        supported = known.where("sure").groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("seeds")).where(F.col("seeds") >= min_seeds)
        candidates = save(supported.select("pattern", F.col("kind").alias("for_kind")))  # for one kind each or for several
        if not candidates.head(1):
            return candidates.select("pattern", F.col("for_kind").alias("kind"))
        graph, same = known.join(candidates, "pattern"), F.col("kind") == F.col("for_kind")
        graph = save(graph.groupBy("pattern", "instance", "for_kind").agg(F.max(F.col("sure") & same).alias("sure"), F.max(~F.col("seed") & same).alias("like")))  # an instance counts once
        good = save(_scores(graph).where(F.col("score") >= min_score).select("pattern", F.col("for_kind").alias("kind")))
        drop(graph, candidates)
        was, accepted = accepted, save(pairs.where("not seed and kind >= 0").join(good, ["pattern", "kind"]).select("instance", "kind").distinct())
        if was is not None:
            drop(was)
        before, found = found, accepted.count()
        if found == before:
            drop(accepted)
            return good


def discover(rows: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """(id, h, extra): spans "start kind end" that high-confidence patterns find, per text.

    ``rows`` has id, h (a hash of the text) and text. The result reads saved
    tables and has a row only for texts with such spans.
    """
    edges = save(rows.mapInArrow(_edges, "id long, h long, pattern long, instance long, kind int, seed boolean, start int, end int"))
    pairs = save(edges.select("pattern", "instance", "kind", "seed").distinct())
    good = trusted_patterns(pairs, min_seeds, min_score)
    found = edges.where("not seed and kind >= 0").join(good, ["pattern", "kind"]).select("id", "h", "start", "kind", "end").distinct()
    out = save(found.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("extra")))
    drop(edges, pairs, good)
    return out


def with_extra(docs: DataFrame, id_col: str, text: str, extra: str = "_extra") -> DataFrame:
    """``docs`` with ``extra``, the discovered spans of each text (null: none).

    Texts are matched by id and hash, so repeated rows get the same spans. The
    discovered spans are a saved table: Spark broadcasts it if its size allows
    and else shuffles.
    """
    h = F.xxhash64(F.col(text))
    found = discover(docs.select(F.col(id_col).cast("long").alias("id"), h.alias("h"), F.col(text).alias("text")))
    on = docs[id_col].cast("long").eqNullSafe(found["id"]) & (F.xxhash64(docs[text]) == found["h"])
    return docs.join(found, on, "left").select(*[docs[c] for c in docs.columns], found["extra"].alias(extra))


def _all_spans(text: str, extra: list | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    if not extra:
        return base, base
    return base, sorted({*base, *((x["start"], x["kind"], x["end"]) for x in extra)})


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of base spans by kind, the digest of the base spans, and all spans.

    A null text counts as empty. Ids may be null or repeated.
    """

    def run(batches):
        for part in slices(batches, "text"):
            counts, sums, told = [[], [], [], []], [], []
            for t, extra in zip(part["text"].to_pylist(), part["_extra"].to_pylist()):
                base, everything = _all_spans(t or "", extra)
                for k in range(4):
                    counts[k].append(sum(b[1] == k for b in base))
                sums.append(hashlib.sha256(_told(base).encode()).hexdigest())
                told.append(_told(everything))
            yield pa.RecordBatch.from_arrays([part["doc_id"], *[pa.array(c, pa.int64()) for c in counts], pa.array(sums, pa.string()), pa.array(told, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return with_extra(rows, "doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets.

    Overlapping spans are replaced as one, by the kind of the first. Null texts
    stay null; all other columns pass unchanged, whatever their names.
    """
    cols = docs.columns
    more = unused(cols, "_extra")

    def run(batches):
        for part in slices(batches, text):
            out = []
            for t, extra in zip(part[text].to_pylist(), part[more].to_pylist()):
                if t is not None:
                    done, end, bits = 0, -1, []
                    for s, k, e in _all_spans(t, extra)[1]:
                        if s < end:
                            end = max(end, e)
                            done = end
                            continue
                        bits += [t[done:s], f"<{KINDS[k]}>"]
                        done = end = e
                    t = "".join([*bits, t[done:]]) if bits else t
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else part[c] for c in cols], names=cols)

    return with_extra(docs, id_col, text, more).mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data in their texts replaced."""
    out = redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
