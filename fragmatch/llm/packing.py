"""Cost-balanced packing of token sequences.

Attention costs a linear and a quadratic part of a piece's length. Documents
are tokenised where they lie; what is longer than a sequence gives full
sequences at once, and the remainders are dealt by a hash into groups of about
``GROUP_BYTES`` bytes of text. Within a group, pieces go by descending length to the
sequence of the lowest cost so far that has room; a piece that fits into none
is cut to fill what is left. A group has as many sequences as its tokens need,
so that its padding is less than one sequence.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.llm.arrow import release, slices
from fragmatch.llm.bpe import Encoder, Memo

#: The split pattern of this tokenizer; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SEQUENCE = 4096
END_ID = 2
GROUP_BYTES = 6 << 20
#: Texts tokenised at once: of more of them, more pieces are equal.
PART_BYTES = 8 << 20
#: The same, and the table of recent pieces, where memory is short.
LOW_BYTES, LOW_MEMO = 1 << 20, 30_000
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False


class WordTokenizer(Encoder):
    """Ids of the word-end vocabulary: normal form C, lower case, white space dropped."""

    pattern = PATTERN
    safe = re.compile(r"[ \n\t\r]")

    def _clean(self, part: str) -> str:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        return part.lower()

    def _cut(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raws = [s.encode() for s in segments]
        raw = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
        inside = _WORD_BYTE[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False))  # a word's first byte and the one after it, in turn; the last is a space
        end = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]).astype(np.int64)
        return raw[inside], edge[1::2] - edge[::2], np.diff(np.searchsorted(edge[::2], end))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cost(n: int) -> float:
    """What attention over a piece of ``n`` tokens costs."""
    return LINEAR * n + QUADRATIC * n * n


def place(sizes: list[int], room: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Deal pieces into sequences: (piece, start in it, length, sequence, offset) rows.

    By descending size, ties by position, each to the sequence with the lowest
    cost (ties: the first) among those with room; there are as many sequences
    as the tokens need. What fits nowhere is cut to fill the emptiest ones.
    Empty pieces take no part.
    """
    order = sorted((k for k, n in enumerate(sizes) if n > 0), key=lambda k: (-sizes[k], k))
    count = -(-sum(sizes) // room)
    used, out = [0] * count, []
    by_cost = [(0.0, s) for s in range(count)]
    tight: list[tuple[int, float, int]] = []  # (used, cost, sequence) of those without room for a piece so far
    for k in order:
        n, start = sizes[k], 0
        while tight and tight[0][0] + n <= room:  # pieces get shorter
            _, c, s = heapq.heappop(tight)
            heapq.heappush(by_cost, (c, s))
        while by_cost and used[by_cost[0][1]] + n > room:
            c, s = heapq.heappop(by_cost)
            if used[s] < room:
                heapq.heappush(tight, (used[s], c, s))
        if by_cost:
            c, s = heapq.heappop(by_cost)
            out.append((k, 0, n, s, used[s]))
            used[s] += n
            heapq.heappush(by_cost, (c + cost(n), s))
            continue
        while n:
            _, c, s = heapq.heappop(tight)
            take = min(n, room - used[s])
            out.append((k, start, take, s, used[s]))
            used[s] += take
            start, n = start + take, n - take
            if used[s] < room:
                heapq.heappush(tight, (used[s], c + cost(take), s))
    return out


PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(ids: list[bytes], with_ids: bool) -> list[pa.Array]:
    """Per row: tokens, checksums of its full sequences and of the ids that are still to place, and these (or all) ids."""
    step = 4 * SEQUENCE
    whole = [len(i) // step * step for i in ids]
    full = [[zlib.crc32(i[k : k + step]) for k in range(0, w, step)] for i, w in zip(ids, whole)]
    rest = ids if with_ids else [i[w:] for i, w in zip(ids, whole)]
    mark = [zlib.crc32(i[w:]) for i, w in zip(ids, whole)]
    return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(mark, pa.int64()), pa.array(rest, pa.binary())]


def _fill(with_ids: bool):
    """The pieces of one group of rows."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["nokey", "key", "total"], kind="stable").reset_index(drop=True)
        rest, total = pdf["rest"].tolist(), pdf["total"].to_numpy()
        rows, sequence = [], 0
        for k, crcs in enumerate(pdf["full"]):
            for j, crc in enumerate(crcs):
                ids = rest[k][j * SEQUENCE * 4 : (j + 1) * SEQUENCE * 4] if with_ids else None
                rows.append((k, j * SEQUENCE, SEQUENCE, ids, int(crc), sequence, 0))
                sequence += 1
        whole = (total // SEQUENCE * SEQUENCE).tolist()
        for k, start, n, s, offset in place((total % SEQUENCE).tolist()):
            at = (start + (whole[k] if with_ids else 0)) * 4
            ids = rest[k][at : at + 4 * n]
            rows.append((k, whole[k] + start, n, ids if with_ids else None, zlib.crc32(ids), sequence + s, offset))
        out = pd.DataFrame(rows, columns=["k", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"])
        for name, source in (("key", "key"), ("nokey", "nokey"), ("doc_tokens", "total")):
            out[name] = pdf[source].to_numpy()[out["k"].to_numpy(dtype=int)]
        out["sequence_id"] = out["sequence_id"].astype("int64") + (int(pdf["group"].iloc[0]) << 32)
        return out[["key", "nokey", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return fill


def pack(rows: DataFrame, groups: int, path: str | None = None, key: str = "doc_id", with_ids: bool = True, end_id: int = END_ID, keep: bool = True) -> DataFrame:
    """Pieces of every row of ``rows`` and their place, as ``PIECES``.

    ``rows`` has ``key`` and either ``ids`` (little-endian 32-bit integers) or,
    with the ``path`` of a vocabulary, ``text``, which is tokenised on the way
    and ended by ``end_id``; a null text counts as empty. Each id of each row
    lies in exactly one piece; repeated rows are packed as often as they come,
    and a null key stays null. Rows without ids give no piece. ``ids`` of
    pieces is null unless ``with_ids``. Sequences are at most 4096 tokens
    long and gapless; a group's padding is less than one sequence. ``groups``
    should follow the input; each is packed in one task. Unless ``keep``,
    texts are tokenised in smaller parts, and workers give up the tokenizer
    after each task, and its memory with it.
    """
    column = "text" if path else "ids"
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        tool = tokenizer(path) if path else None
        if tool and not keep:
            tool.memo = Memo(LOW_MEMO)
        seen: dict[tuple, int] = {}
        for part in slices(batches, column, PART_BYTES if keep else LOW_BYTES):
            if tool:
                ids = [i + end for i in tool.encode_batch([t or "" for t in part["text"].to_pylist()])]
            else:
                ids = part["ids"].to_pylist()
            done = _cut(ids, with_ids)
            # which of a task's equal rows it is: they are dealt apart, and the same way in whatever order they come
            copy = []
            for row in zip(part["key"].to_pylist(), done[0].to_pylist(), done[2].to_pylist()):
                copy.append(seen.get(row, 0))
                seen[row] = copy[-1] + 1
            yield pa.RecordBatch.from_arrays([part["key"], part["nokey"], *done, pa.array(copy, pa.int64())], names=["key", "nokey", "total", "full", "mark", "rest", "copy"])
        if not keep:
            tokenizer.cache_clear()
            release()

    named = rows.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"), F.col(key).isNull().alias("nokey"), column)
    named = named if path else named.where("ids is not null")
    dealt = named.mapInArrow(cut, "key long, nokey boolean, total long, full array<long>, mark long, rest binary, copy long")
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("key", "total", "mark", "copy"), F.lit(groups)).cast("int")).drop("mark", "copy")
    out = dealt.groupBy("group").applyInPandas(_fill(with_ids), PIECES.replace("doc_id long", "key long, nokey boolean"))
    return out.select(F.when(~F.col("nokey"), F.col("key")).alias("doc_id"), *[c.split()[0] for c in PIECES.split(", ")[1:]])


def pieces(docs: DataFrame, with_ids: bool = False, keep: bool = True) -> DataFrame:
    """Packed pieces of (doc_id, text) rows, in about a group for each ``GROUP_BYTES`` of text."""
    import public_tokenizers

    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    return pack(docs, max(1, -(-total // GROUP_BYTES)), public_tokenizers.path("word_bpe_49k.json"), with_ids=with_ids, keep=keep)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, with their ids, of all documents that are left.

    Workers keep no tokenizer: they live on beside those of the next run's stages.
    """
    return pieces(docs, with_ids=True, keep=False)
