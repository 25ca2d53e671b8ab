"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte spans. Every adjacent pair that is a merge
puts its left position into the bucket of its rank; a two-level bitmap of
non-empty buckets gives the lowest rank by find-first-set, and the bucket (a
heap) its leftmost position. A merge joins two spans and enters the two new
pairs; entries whose pair has changed are stale and skipped. The cost is
n log n for a pre-token of n bytes, so very long ones are safe.

Distinct pre-tokens are encoded once per worker, in a cache of a fixed size.
Ranks may be of any size: the bitmap's upper level grows as far as they do.

Nulls: a null text is an empty one, with no tokens; a null doc_id is returned as it
is. Repeated rows are encoded once each. Ties: of equal ranks the leftmost pair
goes first. Texts of any length are encoded whole, each in one task. Only the columns
doc_id and text are read, so others can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Ranks of a bitmap's word: 256.
WORD_SHIFT, WORD_MASK = 8, 255
BIT = [1 << k for k in range(1 << WORD_SHIFT)]
#: Distinct pre-tokens that a worker remembers, of at most 64 characters each.
CACHE = 1_500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    buckets holds the positions of a rank (one, or a heap of several), words and
    top the bitmap of ranks whose bucket isn't empty. The queue's two operations
    stand in line: they run some twenty times for each distinct pre-token.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    get, bit = ranks.get, BIT
    pair = [get(piece[i : i + 2]) for i in range(n)]  # the rank of the pair that starts here, None for none
    pair[-1] = None
    buckets: dict[int, int | list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    new = list(zip(pair, range(n), strict=True))
    while True:
        for rank, i in new:
            if rank is None:
                continue
            if rank in buckets:
                held = buckets[rank]
                if held.__class__ is int:
                    buckets[rank] = [held, i] if held < i else [i, held]
                else:
                    heapq.heappush(held, i)
            else:
                buckets[rank] = i
                word = rank >> WORD_SHIFT
                words[word] = words.get(word, 0) | bit[rank & WORD_MASK]
                top |= 1 << word
        if not top:
            break
        word = (top & -top).bit_length() - 1  # find-first-set, on both levels
        bits = words[word]
        rank = (word << WORD_SHIFT) + (bits & -bits).bit_length() - 1
        i = buckets[rank]
        if i.__class__ is list and len(held := i) > 1:
            i = heapq.heappop(held)
        else:
            if i.__class__ is list:
                i = i[0]
            del buckets[rank]
            bits &= bits - 1
            words[word] = bits
            if not bits:
                top &= top - 1
        if pair[i] != rank:
            new = ()  # a stale entry
            continue
        mid = after[i]
        end = after[mid]
        after[i], pair[mid] = end, None
        if end < n:
            before[end] = i
            pair[i] = right = get(piece[i : after[end]])
        else:
            pair[i] = right = None
        if (left := before[i]) >= 0:
            pair[left] = rank = get(piece[left:end])
            new = (rank, left), (right, i)
        else:
            new = ((right, i),)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Cache(dict):
    """What `make` gives for a pre-token; emptied when full, so that a worker's memory is bounded."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        found = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = found
        return found


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = load_ranks(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.name_of = {i: str(i) for i in self.bytes_of}
        self.find = regex.compile(pattern).findall
        self.ids = _Cache(lambda piece: encode_piece(piece.encode(), self.ranks))
        self.known = _Cache(self._known)
        self.decoded: dict[str, bytes] = {}

    def _known(self, piece: str) -> str:
        """The ids as decimal text."""
        return ",".join([self.name_of[i] for i in encode_piece(piece.encode(), self.ranks)])

    def encode(self, text: str) -> list[int]:
        return [i for p in self.find(text) for i in self.ids[p]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode_text(self, names: str) -> bytes:
        """decode() for decimal ids joined by commas."""
        return b"".join(map(self.by_name.__getitem__, names.split(","))) if names else b""

    @property
    def by_name(self) -> dict[str, bytes]:
        if not self.decoded:
            self.decoded = {self.name_of[i]: b for i, b in self.bytes_of.items()}
        return self.decoded


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary: the bytes the ids stand for)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for x in batches:
            ids = [c.encode(t) for t in _texts(x)]
            made = [pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i) for i in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([x.column(0), *made], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256: encode_documents without moving the ids."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        known = c.known.__getitem__
        for x in batches:
            n, ids_hex, decoded_hex = [], [], []
            for t in _texts(x):
                names = ",".join(map(known, c.find(t)))
                n.append(names.count(",") + 1 if names else 0)
                ids_hex.append(hashlib.sha256(names.encode()).hexdigest())
                decoded_hex.append(hashlib.sha256(c.decode_text(names)).hexdigest())
            made = [pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())]
            yield pa.RecordBatch.from_arrays([x.column(0), *made], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
