"""Byte-level BPE as a bounded-lookahead streaming transducer.

A merge can only be undone by text to its right through a chain of merges of
strictly falling rank, each of which starts with a token on the right edge of
the piece before it. The longest such chain, in bytes, is the merge list's
sufficient lookahead: tokens that end that many bytes before the end of what
has been read are stable and can be emitted. Every pre-token is read through a
window of constant size, many of them side by side, and every id comes from
the one step that emits what is stable. Texts are read in segments, so that
what is held besides a text is of constant size too. Decoding runs the tokens'
bytes through an incremental UTF-8 state machine as they come.

Pieces between single spaces recur, so a bounded table in front of the
transducer keeps what it gave for recent ones.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.llm.arrow import plus, slices

#: The split pattern of this tokenizer family; a fixed value.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Recent pieces whose ids are kept, in each of two generations, and the longest of them in bytes.
MEMO = 250_000
MEMO_BYTES = 64
#: Texts are read in segments of about so many characters.
SEGMENT = 1 << 16
_NONE = 1 << 30


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right of a token that can still change it, at most."""
    right: dict[bytes, bytes] = {}
    chain: dict[bytes, int] = {}
    most = 1
    for left, tail in merges:  # by rank: a chain's later merges come earlier in the list
        below, edge = 0, tail
        while edge is not None:
            below = max(below, chain.get(edge, 0))
            edge = right.get(edge)
        reach = len(tail) + below
        chain[left] = max(chain.get(left, 0), reach)
        right.setdefault(left + tail, tail)
        most = max(most, reach)
    return most


class Memo:
    """The ids of recent short pieces: about 2 x ``most`` of them, and a batch's.

    Two generations: as the young one is full it becomes the old one, and what
    is asked for again moves up, so that frequent pieces stay.
    """

    def __init__(self, most: int | None = None) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.most = MEMO if most is None else most

    def turn(self) -> None:
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young


class Merger:
    """The merge list of one vocabulary, applied to single words or to many at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.char = byte_chars()
        to_byte = {c: b for b, c in self.char.items()}
        raw = lambda s: bytes(to_byte[c] for c in s.removesuffix(self.suffix))
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = self.ids
        first = np.array([ids[self.char[b]] for b in range(256)], np.int64)
        last = np.array([ids[self.char[b] + self.suffix] for b in range(256)], np.int64)
        self.first, self.last = first, last
        keys = np.array([(ids[a] << 17) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.lookahead = lookahead([(raw(a), raw(b)) for a, b in pairs])
        self.window = 2 * self.lookahead + 64
        self.bytes_of = {i: raw(t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, or ``_NONE``."""
        key = (a << 17) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.key_rank[at], _NONE)

    def merge(self, words: list[bytes], ends) -> list[bytes]:
        """Token ids of each word, by rank and then from the left, in lockstep over words.

        Ids are little-endian 32-bit integers. ``ends``, for all or for each:
        whether the last byte ends a word. Words of like length share a matrix, so that padding stays small.
        """
        out = [b""] * len(words)
        ends = np.broadcast_to(ends, len(words))
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        at = 0
        while at < len(order):
            to = at + max(1, min(8192, (1 << 18) // int(size[order[min(at + 8192, len(order)) - 1]])))
            rows = order[at:to]
            at += len(rows)
            n = size[rows]
            width = int(n[-1])
            raw = np.frombuffer(b"".join([words[r] for r in rows]), np.uint8)
            cols = np.arange(width)
            tokens = np.full((len(rows), width), -1, np.int64)
            tokens[cols < n[:, None]] = self.first[raw]
            closed = np.flatnonzero(ends[rows])
            tokens[closed, n[closed] - 1] = self.last[raw[np.cumsum(n)[closed] - 1]]
            rank = np.full((len(rows), width), _NONE, np.int32)
            rank[:, :-1] = self.ranks(tokens[:, :-1], tokens[:, 1:])
            done = np.full((len(rows), width), -1, np.int64)
            live = np.arange(len(rows))
            while len(live):
                pos = rank.argmin(axis=1)
                best = rank[np.arange(len(live)), pos]
                going = best < _NONE
                if not going.all():
                    done[live[~going]] = tokens[~going]
                    tokens, rank, live, pos, best = tokens[going], rank[going], live[going], pos[going], best[going]
                    if not len(live):
                        break
                row = np.arange(len(live))
                tokens[row, pos] = self.made[best]
                gone = cols[None, :-1] > pos[:, None]
                tokens[:, :-1] = np.where(gone, tokens[:, 1:], tokens[:, :-1])
                rank[:, :-1] = np.where(gone, rank[:, 1:], rank[:, :-1])
                tokens[:, -1], rank[:, -1] = -1, _NONE
                nxt = np.minimum(pos + 1, width - 1)
                rank[row, pos] = np.where(pos + 1 < width, self.ranks(tokens[row, pos], tokens[row, nxt]), _NONE)
                some = np.flatnonzero(pos > 0)
                rank[some, pos[some] - 1] = self.ranks(tokens[some, pos[some] - 1], tokens[some, pos[some]])
            mask = done >= 0
            flat = done[mask].astype("<u4").tobytes()
            end = (4 * np.cumsum(mask.sum(axis=1))).tolist()
            for r, lo, hi in zip(rows.tolist(), [0, *end], end):
                out[r] = flat[lo:hi]
        return out

    def stable(self, windows: list[bytes], ends: np.ndarray) -> tuple[list[bytes], dict[int, int]]:
        """The transducer's step: ids of each window that nothing to its right can change.

        ``ends``: whether the pre-token ends with the window; then all are
        stable. For the other windows also the bytes that their ids stand for.
        """
        out, used = self.merge(windows, ends), {}
        for k in np.flatnonzero(~ends).tolist():
            ids = np.frombuffer(out[k], "<u4")
            end = np.cumsum([len(self.bytes_of[i]) for i in ids.tolist()])
            n = int(np.searchsorted(end, len(windows[k]) - self.lookahead - 1, side="right"))
            out[k], used[k] = out[k][: 4 * n], int(end[n - 1]) if n else 0
        return out, used

    def stream(self, chunks: Iterator[bytes]) -> Iterator[np.ndarray]:
        """Ids of one pre-token that arrives in ``chunks``, as soon as they are stable.

        Holds a window of constant size, whatever comes.
        """
        held = b""
        for chunk in chunks:
            for at in range(0, len(chunk), self.window):
                held += chunk[at : at + self.window]
                if len(held) > self.window + 1:
                    (ids,), used = self.stable([held], np.array([False]))
                    held = held[used[0] :]
                    if ids:
                        yield np.frombuffer(ids, "<u4")
        (ids,), _ = self.stable([held], np.array([True]))
        yield np.frombuffer(ids, "<u4")

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian 32-bit integers, all read side by side."""
        left, size = words, 2 * self.window
        going, parts, out = range(len(left)), {}, []
        while left:
            more = np.array([len(w) > size for w in left], bool)
            some = np.flatnonzero(more).tolist()
            windows = [w[:size] for w in left] if some else left
            ids, used = self.stable(windows, ~more)
            out = out or ids
            for k, x in enumerate(ids) if parts else zip(some, [ids[k] for k in some]):
                parts.setdefault(going[k], []).append(x)
            going, left = [going[k] for k in some], [left[k][used[k] :] for k in some]
        for k, x in parts.items():
            out[k] = b"".join(x)
        return out


class Encoder:
    """Texts to ids: cut into pieces that can be encoded apart, each new one split into pre-tokens."""

    pattern: str
    #: Where a text can be cut.
    safe: re.Pattern

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.split = regex.compile(self.pattern)
        self.memo = Memo()

    def _clean(self, part: str) -> str:
        """A text between special tokens as it is to be split."""
        return part

    def _cut(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of segments: their bytes end to end, the length of each, and how many each segment has."""
        raise NotImplementedError

    def _segments(self, text: str) -> Iterator[str | list[str] | Iterator[bytes]]:
        """A text in segments of about ``SEGMENT`` characters; as a list of pre-tokens where it can't be cut near.

        A longer pre-token comes alone, as a stream of bytes.
        """
        m = self.merger
        for part in m.cut.split(text) if m.cut and any(s in text for s in m.special) else [text]:
            if part in m.special:
                yield [part]
                continue
            part, at = self._clean(part), 0
            while len(part) - at > 2 * SEGMENT:
                if found := self.safe.search(part, at + SEGMENT, at + 2 * SEGMENT):
                    yield part[at : found.start()]
                    at = found.start()
                    continue
                held, begin = [], at
                for token in self.split.finditer(part, at):
                    s, at = token.span()
                    if at - s > SEGMENT:
                        yield held
                        held = []
                        yield (part[k : min(k + 4096, e)].encode() for e in (at,) for k in range(s, e, 4096))
                    else:
                        held.append(token.group())
                    if at - begin >= SEGMENT:
                        break
                else:
                    at = len(part)
                yield held
            yield part[at:] if at else part

    def _new(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that the young generation doesn't know."""
        m, young, old = self.merger, self.memo.young, self.memo.old
        out = {w: v for w in pieces if (v := old.get(w)) is not None}
        words, several = [], {}
        for w in pieces:
            if w in out:
                continue
            c = w.decode()
            if c.isalpha() or c[:1] == " " and c[1:].isalpha():
                words.append(w)
            elif c[-1:] in _MARKS and (c[:-1].isalpha() or c[:1] == " " and c[1:-1].isalpha()):
                several[w] = w[:-1], w[-1:]
            elif c in m.special:
                out[w] = np.array([m.special[c]], "<u4").tobytes()
            else:
                several[w] = [p.encode() for p in self.split.findall(c)]
        parts = {p for ps in several.values() for p in ps}
        known = {p: v for p in parts if (v := out.get(p) or young.get(p) or old.get(p)) is not None}
        words += parts - known.keys() - set(words)
        known.update(zip(words, m.words(words)))
        get = known.__getitem__
        for w, ps in several.items():
            out[w] = b"".join(map(get, ps))
        known.update(out)
        return known

    def _ids(self, items: list[str | list[str]]) -> list[bytes]:
        """Ids of segments and of lists of pre-tokens; equal pieces are looked up once."""
        self.memo.turn()
        young = self.memo.young
        segments, lists = [k for k, x in enumerate(items) if isinstance(x, str)], [k for k, x in enumerate(items) if not isinstance(x, str)]
        data, size, count = self._cut([items[k] for k in segments])
        if lists:
            tokens = [[p.encode() for p in items[k]] for k in lists]
            data = np.concatenate([data, np.frombuffer(b"".join(p for ps in tokens for p in ps), np.uint8)])
            size = np.concatenate([size, np.array([len(p) for ps in tokens for p in ps], np.int64)])
            count = np.concatenate([count, [len(ps) for ps in tokens]])
        offset = np.concatenate([[0], np.cumsum(size)])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        found = list(map(young.get, words))
        if missing := [w for w, f in zip(words, found) if f is None]:
            new = self._new(missing)
            found = [new[w] if f is None else f for w, f in zip(words, found)]
            young.update(new)
            for w in new:
                if len(w) > MEMO_BYTES:
                    del young[w]
        ids = pa.array(found, pa.large_binary()).take(pieces.indices)
        end = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        flat = ids.buffers()[2]
        at = end[np.concatenate([[0], np.cumsum(count)]).astype(np.int64)].tolist()
        out = [b""] * len(items)
        for k, lo, hi in zip([*segments, *lists], at, at[1:]):
            if hi > lo:
                out[k] = flat[lo:hi].to_pybytes()
        return out

    def stream(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(text, ids) in the order of each text, as little-endian 32-bit integers, as soon as they are stable."""
        live = [(k, self._segments(t)) for k, t in enumerate(texts)]
        while live:
            owners, lists, going = [], [], []
            for k, segments in live:
                segment = next(segments, None)
                if segment is None:
                    continue
                going.append((k, segments))
                if isinstance(segment, str | list):
                    owners.append(k)
                    lists.append(segment)
                else:
                    for ids in self.merger.stream(segment):
                        yield k, ids.tobytes()
            yield from zip(owners, self._ids(lists))
            live = going

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for k, ids in self.stream(texts):
            out[k].append(ids)
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


_UNSAFE = re.compile(r" \s|\s ")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_MARKS = frozenset(".,;:!?")
_utf8 = codecs.getincrementaldecoder("utf-8")


class Transducer(Encoder):
    """Encoder and decoder of one byte-level vocabulary."""

    pattern = PRETOKEN
    safe = _SAFE

    def __init__(self, path: str):
        super().__init__(path)
        names = [self.merger.bytes_of.get(i, b"") for i in range(max(self.merger.bytes_of) + 1)]
        self.name_len = np.array([len(b) for b in names], np.int64)
        self.name_at = np.concatenate([[0], np.cumsum(self.name_len)])
        self.name_raw = np.frombuffer(b"".join(names), np.uint8)

    def _segments(self, text: str) -> Iterator[str | list[str] | Iterator[bytes]]:
        """A single space between two other characters always starts a pre-token:
        there a text can be cut, but not next to more white space.
        """
        for segment in super()._segments(text):
            if isinstance(segment, str) and _UNSAFE.search(segment):
                first, *rest = _SAFE.split(segment)
                yield [x for x in (first, *[" " + w for w in rest]) if x]
            else:
                yield segment

    def _cut(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raws = [s.encode() for s in segments]
        raw = np.frombuffer(b"".join(raws), np.uint8)
        end = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        begins = raw == 32
        begins[end[:-1][end[:-1] < len(raw)]] = True
        at = np.flatnonzero(begins)
        return raw, np.diff(at, append=len(raw)), np.diff(np.searchsorted(at, end))

    def text_of(self, machine: codecs.IncrementalDecoder, ids: bytes) -> str:
        """What ``machine``, which holds an unfinished character at most, reads in the bytes of ``ids``."""
        part = np.frombuffer(ids, "<u4").astype(np.int64)
        part = part[part < len(self.name_len)]
        n = self.name_len[part]
        end = np.cumsum(n)
        where = np.repeat(self.name_at[part] - (end - n), n)
        return machine.decode(self.name_raw[where + np.arange(len(where))].tobytes())

    def decode(self, ids: bytes, step: int = 1 << 16) -> Iterator[str]:
        """Text of ``ids`` in parts. Ids outside the vocabulary give nothing."""
        machine = _utf8("replace")
        for at in range(0, len(ids), 4 * step):
            yield self.text_of(machine, ids[at : at + 4 * step])
        yield machine.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (binary, little-endian 32-bit) and ``decoded`` appended.

    A null text counts as empty: no ids, empty decoded text. Columns of the
    two new names are replaced; all others pass unchanged.
    """
    keep = [c for c in df.columns if c not in ("ids", "decoded")]
    df = df.select(*keep)

    def run(batches):
        tool = transducer(path)
        for part in slices(batches, text):
            ids = tool.encode_batch([t or "" for t in part[text].to_pylist()])
            back = ["".join(tool.decode(i)) for i in ids]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=[*keep, "ids", "decoded"])

    return df.mapInArrow(run, plus(df.schema, ids="binary", decoded="string"))


def digests(df: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, text): counts and digests of what ``encode_decode`` gives.

    The digests are fed by the ids as the transducer emits them, so that no
    text's ids or decoded text are held whole. Nulls as in ``encode_decode``; doc_id may be null
    or repeated.
    """

    def run(batches):
        tool = transducer(path)
        for part in slices(batches, "text"):
            texts = [t or "" for t in part["text"].to_pylist()]
            n, machines = [0] * len(texts), [_utf8("replace") for _ in texts]
            seen, read = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            for k, ids in tool.stream(texts):
                n[k] += len(ids) // 4
                seen[k].update(ids)
                for at in range(0, len(ids), 4 * SEGMENT):
                    read[k].update(tool.text_of(machines[k], ids[at : at + 4 * SEGMENT]).encode())
            for machine, h in zip(machines, read):
                h.update(machine.decode(b"", True).encode())
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in seen], pa.string()), pa.array([h.hexdigest() for h in read], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
