"""Byte-level BPE with a hierarchical-bitmap rank queue.

Pairs that can merge wait in one bucket for each merge rank; a bucket holds positions of the linked list of
parts. A bitmap has a bit for each bucket that isn't empty, a second level a bit for each word of the first,
so that two find-first-set steps give the lowest rank. Entries whose pair has changed since are skipped when
they come up. A pre-token of n bytes takes O(n log n) steps, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_column, map_arrow, parts, table

#: Pre-tokens of up to CACHED_CHARS characters are kept with their ids, about CACHED of them in each of two
#: generations. Characters of text that are split at once (a longer text alone), pre-tokens that go through the
#: queue at once, and parts from which the linked list is held in arrays.
CACHED, CACHED_CHARS, STEP_CHARS, QUEUED, LONG = 200_000, 48, 1 << 19, 4096, 1 << 20

_UNICODE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters, digits and white space below U+0250; with the punctuation that CLOSED names, what Latin texts consist of.
_LETTERS, _DIGITS, _BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\x0b\x0c\r\x85\xa0"
CLOSED = "\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac"
_BEYOND = re.compile(f"[^{CLOSED}]").search
#: What the split pattern is for such texts; plain classes are faster than Unicode properties.
_LATIN_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_BLANKS}{_LETTERS}{_DIGITS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"


class RankQueue:
    """Encoder of pre-tokens by merge ranks.

    The pre-tokens of a call lie in one linked list, with a mark between them that no token holds, so each is
    merged by itself, in the order of its own ranks; a step of the queue serves all that wait at a rank.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.ids = {t: r.to_bytes(4, "little") for t, r in ranks.items()}
        self.shift = max(4, ((max(ranks.values(), default=0) + 1).bit_length() + 1) // 2)
        self.low = [0] * (1 << self.shift)
        self.single = [bytes([b]) for b in range(256)]
        self.mark = b"\xff\xff"
        while any(self.mark in t for t in ranks):
            self.mark += b"\xff"

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        rank_of, token, shift, low, high = self.ranks.get, self.token, self.shift, self.low, 0
        mask, single, part, starts = (1 << shift) - 1, self.single, [self.mark], []
        whole = list(map(self.ids.get, pieces))
        for piece in (p for p, x in zip(pieces, whole) if x is None):
            starts.append(len(part))
            part.extend(map(single.__getitem__, piece))
            part.append(self.mark)
        n = len(part)
        wide = (lambda x: array("q", x)) if n > LONG else list
        after, before = wide(range(1, n + 1)), wide(range(-1, n - 1))
        #: The rank at which the part at i merges with the next one; None: not at all, or i is part of another.
        wait = list(map(rank_of, map(bytes.__add__, part, itertools.islice(part, 1, None))))
        wait.append(None)
        buckets: dict[int, list[int]] = {}
        for i, r in enumerate(wait):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    low[r >> shift] |= 1 << (r & mask)
                    high |= 1 << (r >> shift)
        while high:
            w = (high & -high).bit_length() - 1
            bits = low[w]
            first = bits & -bits
            r = (w << shift) + first.bit_length() - 1
            low[w] = bits = bits ^ first
            if not bits:
                high ^= 1 << w
            bucket = buckets.pop(r)
            bucket.sort()
            merged, lower = token[r], False
            for at, i in enumerate(bucket, 1):
                if wait[i] != r:
                    continue  # stale: a part of this pair has grown since
                part[i] = merged
                j = after[i]
                wait[j] = None
                j = after[i] = after[j]
                before[j] = i
                wait[i] = s = rank_of(merged + part[j])
                if s is not None:
                    if s in buckets:
                        buckets[s].append(i)
                    else:
                        buckets[s] = [i]
                        low[s >> shift] |= 1 << (s & mask)
                        high |= 1 << (s >> shift)
                    lower = s < r
                k = before[i]
                wait[k] = s = rank_of(part[k] + merged)
                if s is not None:
                    if s in buckets:
                        buckets[s].append(k)
                    else:
                        buckets[s] = [k]
                        low[s >> shift] |= 1 << (s & mask)
                        high |= 1 << (s >> shift)
                    lower = lower or s < r
                if lower and at < len(bucket):  # a lower rank has come up, and goes before the rest of this one
                    buckets[r] = bucket[at:]
                    low[w] |= first
                    high |= 1 << w
                    break
        ids, at = self.ids, iter(starts)
        for p, piece in enumerate(pieces):
            if whole[p] is None:
                i, found = next(at), []
                end = i + len(piece)
                while i < end:
                    found.append(ids[part[i]])
                    i = after[i]
                whole[p] = b"".join(found)
        return whole


class Codec:
    """Texts to ids and back, by a rank file and a split pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.ranks, self._queue = ranks, None
        self.split = regex.compile(pattern).findall
        self.split_latin = re.compile(_LATIN_PATTERN).findall if pattern == _UNICODE_PATTERN else self.split
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @property
    def queue(self) -> RankQueue:
        """Made when it is needed: workers that only decode don't hold it."""
        if self._queue is None:
            self._queue = RankQueue(self.ranks)
        return self._queue

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of all these pre-tokens into young; those that it hasn't go through the queue together."""
        new = pieces.difference(self.young)
        known = {p for p in new if p in self.old}
        self.young.update((p, self.old[p]) for p in known)
        new = list(new - known)
        for s in range(0, len(new), QUEUED):
            some = new[s : s + QUEUED]
            self.young.update(zip(some, self.queue.encode([p.encode() for p in some])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out, s = [], 0
        while s < len(texts):
            e, size = s + 1, len(texts[s])
            while e < len(texts) and size + len(texts[e]) <= STEP_CHARS:
                size += len(texts[e])
                e += 1
            split = [(self.split if _BEYOND(t) else self.split_latin)(t) for t in texts[s:e]]
            pieces = set().union(*split)
            self._learn(pieces)
            out += [b"".join(map(self.young.__getitem__, x)) for x in split]
            for p in pieces:
                if len(p) > CACHED_CHARS:
                    del self.young[p]
            if len(self.young) > CACHED:
                self.young, self.old = {}, self.young
            s = e
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The codec of this Python worker, built once."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def _map(df: DataFrame, keep: list[str], given: str, gives: list[tuple[str, T.DataType]], rank_file: bytes, pattern: str, of) -> DataFrame:
    """keep, and the columns that of(codec, values) returns for a slice of rows."""
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t in gives)])
    shared = df.sparkSession.sparkContext.broadcast(rank_file)  # a vocabulary of bounded size
    arrow = {T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in parts(batches, 256):
            columns = of(own, as_column(batch, "__in").to_pylist())
            made = [pa.array(x, arrow[t]) for x, (_, t) in zip(columns, gives)]
            yield pa.RecordBatch.from_arrays([*(as_column(batch, c) for c in keep), *made], [*keep, *(n for n, _ in gives)])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{given}`").alias("__in"))
    return map_arrow(rows, run, schema)


def encode(docs: DataFrame, rank_file: bytes, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, n_tokens, ids (binary: little-endian unsigned 32-bit): whole texts encoded without special tokens.

    Null and empty texts give no ids. Special tokens' strings are ordinary text.
    """

    def of(own: Codec, texts: list[str | None]):
        ids = own.encode([t or "" for t in texts])
        return [len(x) // 4 for x in ids], ids

    return _map(docs, keep, text_col, [("n_tokens", T.LongType()), ("ids", T.BinaryType())], rank_file, pattern, of)


def decode(encoded: DataFrame, rank_file: bytes, pattern: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """keep, decoded (binary): the bytes of the tokens; null ids count as none."""

    def of(own: Codec, ids: list[bytes | None]):
        return ([own.decode(x or b"") for x in ids],)

    return _map(encoded, keep, ids_col, [("decoded", T.BinaryType())], rank_file, pattern, of)


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256: texts encoded, the ids decoded again, and digests of both.

    What encode() and decode() do, in one pass: ids and decoded bytes of a row don't leave the worker. Null and
    empty texts give no ids and the digests of nothing; an empty table gives no rows; repeated rows are all returned.
    """

    def of(own: Codec, texts: list[str | None]):
        ids = own.encode([t or "" for t in texts])
        digest = lambda x: hashlib.sha256(x).hexdigest()
        return [len(x) // 4 for x in ids], [digest(x) for x in ids], [digest(own.decode(x)) for x in ids]

    gives = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _map(docs, keep, text_col, gives, rank_file, pattern, of)


def public_vocabulary() -> tuple[bytes, str]:
    """Rank file and split pattern of the public tokenizer that the queries use."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of ids and of decoded bytes, by the public vocabulary, as round_trip() gives them.

    Other columns of docs aren't read, whatever their names.
    """
    return round_trip(docs, *public_vocabulary(), ["doc_id"])


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
