"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows where they lie
and adds the sparse counts up by one aggregation; the log-probability matrix
(buckets x languages) is broadcast, and batches are scored in numpy as one
sparse matrix of n-gram positions against that matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.llm.arrow import plus, slices, unused

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
#: The classifier is fitted on about so many rows of each language at most, chosen by a hash of the row.
TRAIN_ROWS = 4000
SMOOTHING = 0.5
#: What a text's mean log-likelihood per n-gram may lack, the share of the usual margin it needs, and the spread of one n-gram.
DROP, LEAST_MARGIN, SPREAD = 1.0, 0.35, 4.0
#: n-grams take about 50 times their text's memory, so texts are taken in small parts.
PART_BYTES = 1 << 19
_LETTER = regex.compile(r"\p{L}")
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.array([chr(i).isalpha() for i in range(0x10000)])
    return _alpha


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``texts`` and len + 1 offsets; nulls have none.

    Letters are lower-cased, everything else counts as a space, and runs of
    spaces as they are; a separator that belongs to no n-gram parts the rows.
    """
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    size = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    cp = np.frombuffer("\0".join(low.to_pylist() + [""] * (1 if len(low) else 0)).encode("utf-32-le"), np.uint32)
    start = np.concatenate([[0], np.cumsum(size + 1)])
    letter = (cp >= 0x10000) | _letters()[np.minimum(cp, 0xFFFF)]
    cp = np.where(letter, cp, np.uint32(32))
    owner_end = np.zeros(len(cp), bool)
    owner_end[start[1:] - 1] = True
    ok = ~owner_end
    parts, keeps = [], []
    h = np.zeros(len(cp), np.uint32)
    valid = ok
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            h = h[:-1]
            valid = valid[:-1] & ok[n - 1 :]
        h = (h ^ (cp[n - 1 :] + np.uint32(n))) * _MULT[n - 1]
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            parts.append(h >> np.uint32(32 - BUCKET_BITS))
            keeps.append(valid)
    width = len(cp)
    table = np.zeros((width, len(parts)), np.int32)
    mask = np.zeros((width, len(parts)), bool)
    for k, (p, v) in enumerate(zip(parts, keeps)):
        table[: len(p), k], mask[: len(v), k] = p, v
    counts = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])
    return table[mask], counts[start]


def _signed(text: str, limit: int):
    """(sign, part): parts that overlap by all but one character of the longest n-gram, and these overlaps to take off again.

    Every n-gram is in one part more than in overlaps, so that sums over a long text need one part at a time.
    """
    lap = max(ORDERS) - 1
    for at in range(0, len(text), limit):
        yield 1, text[at : at + limit + lap]
        if at + limit < len(text):
            yield -1, text[at + limit : at + limit + lap]


def _is_long(texts: pa.Array) -> bool:
    """A slice with one text, of more characters than are taken at once."""
    return len(texts) == 1 and texts[0].is_valid and len(texts[0].as_py()) > PART_BYTES


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray  # (buckets, languages), log probabilities
    prior: np.ndarray
    usual: np.ndarray  # (languages, languages), mean log probability of an n-gram of the first by the second


def _count(batches):
    """Sparse n-gram counts of a partition by language."""
    held: dict[str, np.ndarray] = {}
    for part in slices(batches, "text", PART_BYTES):
        if _is_long(part["text"]):
            mine = held.setdefault(part["lang"][0].as_py(), np.zeros(1 << BUCKET_BITS, np.int64))
            for sign, piece in _signed(part["text"][0].as_py(), PART_BYTES):
                mine += sign * np.bincount(grams(pa.array([piece]))[0], minlength=1 << BUCKET_BITS)
            continue
        buckets, at = grams(part["text"])
        langs = np.array(part["lang"].to_pylist(), object)
        owner = np.repeat(np.arange(len(langs)), np.diff(at))
        for lang in set(langs):
            mine = buckets[(langs == lang)[owner]]
            held.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))[:] += np.bincount(mine, minlength=1 << BUCKET_BITS)
    for lang, counts in held.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])


def train(rows: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on ``rows``, all of which may be learned from.

    Rows with a null text or language are left out. Of each language about
    ``train_rows`` rows count, drawn by a hash of the text, so that fitting
    costs the same at every size. Without any row there are no languages.
    """
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    total = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count("*")).collect()}
    if not total:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), np.zeros((0, 0)))
    share = F.create_map([x for k, v in total.items() for x in (F.lit(k), F.lit(min(1.0, train_rows / v)))])
    drawn = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20)) < share[F.col("lang")] * F.lit(float(1 << 20))
    counted = rows.where(drawn).mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(total)
    table = np.zeros((1 << BUCKET_BITS, len(langs)))
    at = {k: i for i, k in enumerate(langs)}
    for r in counted.toLocalIterator():  # at most buckets x languages rows
        table[r[1], at[r[0]]] = r[2]
    weights = np.log(table + SMOOTHING) - np.log((table + SMOOTHING).sum(axis=0))
    n = np.array([total[k] for k in langs], float)
    usual = table.T @ weights / np.maximum(table.sum(axis=0), 1)[:, None]
    return Model(langs, weights.astype(np.float32), np.log(n / n.sum()), usual)


def _likelihoods(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) log-likelihoods, and the number of n-grams of each text."""
    if _is_long(texts):
        like, count = np.zeros((1, len(model.langs))), np.zeros(1, np.int64)
        for sign, piece in _signed(texts[0].as_py(), PART_BYTES):
            more, n = _plain_likelihoods(pa.array([piece]), model)
            like, count = like + sign * more, count + sign * n
        return like, count
    return _plain_likelihoods(texts, model)


def _plain_likelihoods(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    buckets, at = grams(texts)
    like = np.zeros((len(texts), len(model.langs)))
    full = np.flatnonzero(np.diff(at))
    for k in range(len(model.langs)):
        if len(full):
            like[full, k] = np.add.reduceat(model.weights[:, k][buckets], at[full], dtype=np.float64)
    return like, np.diff(at)


def _typical(like: np.ndarray, count: np.ndarray, model: Model) -> np.ndarray:
    """Whether a text is as likely by its best language as that language's texts are, and as far from the others.

    Both are means per n-gram, so that they don't grow with a text's length.
    The best language's may lie ``DROP`` below the usual one, and the margin to
    any other at ``LEAST_MARGIN`` of the usual one; few n-grams vary more.
    """
    if not model.langs:
        return np.zeros(len(like), bool)
    mean = like / np.maximum(count, 1)[:, None]
    best, rows = (like + model.prior).argmax(axis=1), np.arange(len(like))
    own, usual = mean[rows, best], np.diag(model.usual)[best]
    slack = SPREAD / np.sqrt(np.maximum(count, 1))
    apart = own[:, None] - mean >= LEAST_MARGIN * (usual[:, None] - model.usual[best]) - slack[:, None]
    apart[rows, best] = True
    return (count > 0) & (own >= usual - DROP - slack) & apart.all(axis=1)


def _posterior(texts: pa.Array, like: np.ndarray, model: Model) -> tuple[list[str], np.ndarray]:
    named = np.array([bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    like = like + model.prior
    best = like.argmax(axis=1)
    post = 1 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.langs[b] if ok else "und" for b, ok in zip(best, named)], np.where(named, post, 0.0)


def score(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """The best language and its posterior for each text; ``und`` and 0 without letters."""
    return _posterior(texts, _likelihoods(texts, model)[0], model)


def predict(df: DataFrame, model: Model, text: str = "text", lang_col: str = "lang_pred", score_col: str = "score", typical_col: str | None = None) -> DataFrame:
    """``df`` with the predicted language and its posterior, 0 to 1, appended.

    A ``typical_col`` tells whether the text is one of that language: the
    posterior compares the languages only, and is near 1 for most long texts.

    Null texts and texts without a letter get ``und`` and 0. All other columns
    pass unchanged; columns of the new names are replaced. Ties go to the
    language that sorts first.
    """
    keep = [c for c in df.columns if c not in (lang_col, score_col, typical_col)]
    df = df.select(*keep)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches, text, PART_BYTES):
            like, count = _likelihoods(part[text], held.value)
            langs, scores = _posterior(part[text], like, held.value)
            out = {lang_col: pa.array(langs, pa.string()), score_col: pa.array(scores)}
            if typical_col:
                out[typical_col] = pa.array(_typical(like, count, held.value))
            yield pa.RecordBatch.from_arrays([*part.columns, *out.values()], names=[*keep, *out])

    schema = plus(df.schema, **{lang_col: "string", score_col: "double"}, **({typical_col: "boolean"} if typical_col else {}))
    return df.mapInArrow(run, schema)


#: Whether a row is held out from training; one without a doc_id is not held out, and not learned from either.
HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, false)"


def learned(docs: DataFrame) -> Model:
    """The model of the rows of ``docs`` outside the held-out fifth."""
    return train(docs.where(~F.expr(HELD_OUT) & F.col("doc_id").isNotNull()))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "text")
    return predict(rows, learned(docs)).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Documents in a learned language, told with a posterior of ``least`` or more.

    Rejected: null texts, texts without a letter, texts between languages, and
    texts that are not like those of any learned language.
    """
    lang, score_, typical = names = [unused(docs.columns, n) for n in ("lang_told", "score_told", "typical")]
    told = predict(docs, learned(docs), lang_col=lang, score_col=score_, typical_col=typical)
    return told.where((F.col(lang) != "und") & (F.col(score_) >= least) & F.col(typical)).drop(*names)
