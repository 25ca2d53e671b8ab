"""Context-tree weighting over bytes.

A text is its UTF-8 bytes and an end symbol (0xFF, which UTF-8 never holds). A
byte is eight binary decisions; each decision has a context tree over the last
DEPTH bytes, with a Krichevsky-Trofimov estimator at every node, from the empty
context to the full one. A node's weighted probability is half its estimator's
and half the product of its children's:  Pw = (Pe + prod Pw(child)) / 2.  The
block probability Pe depends on counts alone, so the tree is built by grouped
sums, bottom up, and gives exact mixing weights for all depths. Scoring uses the
trained tree as it stands: the mixture along a context's path, top down.

How it runs: documents are bundled into chunks of about CHUNK_BYTES; a longer text
is cut at white space into pieces that carry their context bytes. A chunk's distinct
(DEPTH + 1)-byte grams with their training counts are dealt to buckets: by the hash
of their last two context bytes, and within that by the third one's where the corpus
is so large that two bytes don't part it finely enough. Chunks' grams of a bucket are
merged level by level, a bounded number at a time, so a frequent context costs its
distinct grams and not its occurrences. Buckets give the sums of their depth-2 nodes;
those are added up by node, and what depth 1 gets of them, at most 256 * 255 rows, is
the top of the tree, which is small by its construction and is broadcast. The merged
bucket, with its depth-2 nodes, then answers every chunk with the log probabilities
of just its grams, a bounded number of chunks at a time, and chunks add them up by
document. So what is gathered grows with the corpus, no table of the corpus is
broadcast, and a gram in a third of all documents is one entry a chunk.

A gram's log10 probability is answered in 32-bit floats: a score is exact to about
seven digits.

Nulls: a null text is an empty one; a document without an id is scored and not
trained on. Repeated rows are trained on and scored as often as they stand. An
empty table gives an empty result, and without training text every decision has
probability 1/2. A text of any length is scored whole; a single word longer than a
chunk is a piece by itself. Ties don't arise. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, mix64, pieces_of, release, ship
from .words import SPACE, buffer, word_hashes

DEPTH = 5
END = 0xFF
CHUNK_BYTES, CHUNK_DOCS = 5 << 20, 60_000
#: Bytes of text a bucket stands for, and grams that a task merges or answers at a time.
BUCKET_BYTES, TASK_GRAMS = 16 << 20, 3_000_000
#: Bytes of a row's blob that holds a part of a chunk's texts.
PAGE = 1 << 20
HALF = np.log(0.5)


def packed_grams(raw: np.ndarray, offsets: np.ndarray, before: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """For every byte and end of every text one sorted uint64: five context bytes, the last one uppermost, the byte, and 16 bits of the text's place.

    before: DEPTH context bytes of each text (ends, if it isn't a piece of one); last: whether its end is here.
    """
    n = np.diff(offsets)
    docs = len(n)
    padded = np.full(int(n.sum()) + docs * (DEPTH + 1), END, dtype=np.uint8)
    keep = np.ones(len(padded), dtype=bool)
    begin = offsets[:-1] + np.arange(docs) * (DEPTH + 1)  # each text: DEPTH bytes of context, its bytes, an end
    for k in range(DEPTH):
        keep[begin + k] = False
        if before is not None:
            padded[begin + k] = before[:, k]
    body = keep.copy()
    body[begin + DEPTH + n] = False
    padded[body] = raw
    del body
    more = np.ones(docs, dtype=np.int64) if last is None else last.astype(np.int64)
    keep[(begin + DEPTH + n)[more == 0]] = False
    doc = np.repeat(np.arange(docs, dtype=np.uint16), n + more)
    out, done = np.empty(len(doc), dtype=np.uint64), 0
    for a in range(DEPTH, len(padded), 1 << 20):  # a million places at a time: the temporaries stay small
        b = min(len(padded), a + (1 << 20))
        key = padded[a:b].astype(np.uint64) << np.uint64(16)
        for back in range(1, DEPTH + 1):
            key |= padded[a - back : b - back].astype(np.uint64) << np.uint64(64 - 8 * back)
        key = key[keep[a:b]]
        out[done : done + len(key)] = key | doc[done : done + len(key)]
        done += len(key)
    out.sort()
    return out


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.empty(len(keys), dtype=bool)
    new[0] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of these counts: ln G(a+1/2) G(b+1/2) / (pi G(a+b+1))."""
    return _half(zeros) + _half(ones) - _whole(zeros + ones)


def _sum_table(n: int, step: float) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(n) + step))])


_HALF_TABLE, _WHOLE_TABLE = _sum_table(1 << 16, 0.5), _sum_table(1 << 16, 1.0)


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _half(n: np.ndarray) -> np.ndarray:
    """ln (1/2)(3/2)...(n-1/2) = ln G(n+1/2) - ln G(1/2)."""
    small = n < 1 << 16
    return np.where(small, _HALF_TABLE[np.where(small, n, 0)], _stirling(np.maximum(n, 1) + 0.5) - 0.5 * np.log(np.pi))


def _whole(n: np.ndarray) -> np.ndarray:
    small = n < 1 << 16
    return np.where(small, _WHOLE_TABLE[np.where(small, n, 0)], _stirling(np.maximum(n, 1) + 1.0))


def decisions(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted nodes at full depth and their counts of 0 and 1. grams: 48 bits, the byte lowest. A node: 40 bits of context, 8 of decision (the bits so far under a leading 1)."""
    context, byte = grams >> np.uint64(8) << np.uint64(8), grams & np.uint64(255)
    nodes, zeros, ones = [], [], []
    for b in range(8):
        node = context | np.uint64(1 << b) | byte >> np.uint64(8 - b)
        bit = (byte >> np.uint64(7 - b)) & np.uint64(1)
        at = _runs(node)  # grams are sorted, so equal nodes stand together
        n1 = np.add.reduceat(counts * bit.astype(np.int64), at)
        n = np.add.reduceat(counts, at)
        nodes.append(node[at])
        zeros.append(n - n1)
        ones.append(n1)
    node = np.concatenate(nodes)
    order = np.argsort(node, kind="stable")
    return node[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


def fold(node: np.ndarray, depth: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nodes one depth up (the oldest of `depth` context bytes goes) and the sums of values."""
    keep = ~np.uint64((1 << (8 * (DEPTH - depth + 2))) - 1) | np.uint64(255)
    up = node & keep
    order = np.argsort(up, kind="stable")
    up = up[order]
    at = _runs(up)
    return up[at], *[np.add.reduceat(v[order], at) for v in values]


class Level:
    """A depth of the tree: sorted nodes, the share of a node's own estimator in its mixture, and its probability of a 1."""

    def __init__(self, node, zeros, ones, own, weighted) -> None:
        self.node = node
        self.one = (ones + 0.5) / (zeros + ones + 1.0)
        self.weight = np.exp(HALF + own - weighted) if weighted is not None else np.ones(len(node))

    def find(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and probability of a 1; a node never seen has 1/2 for both."""
        if not len(self.node):
            return np.full(len(node), 0.5), np.full(len(node), 0.5)
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        hit = self.node[at] == node
        return np.where(hit, self.weight[at], 0.5), np.where(hit, self.one[at], 0.5)


def subtree(grams: np.ndarray, counts: np.ndarray, top: int = 2) -> tuple[list[Level], tuple]:
    """Levels from `top` to DEPTH of sorted grams with positive counts; and of depth top: node, zeros, ones, log Pw."""
    node, zeros, ones = decisions(grams, counts)
    weighted = log_kt(zeros, ones)
    levels = [Level(node, zeros, ones, None, None)]
    for depth in range(DEPTH, top, -1):
        node, zeros, ones, below = fold(node, depth, zeros, ones, weighted)
        own = log_kt(zeros, ones)
        weighted = np.logaddexp(HALF + own, HALF + below)
        levels.append(Level(node, zeros, ones, own, weighted))
    return levels[::-1], (node, zeros, ones, weighted)


def crown(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[Level]:
    """Depths 0 and 1, from depth-1 nodes with the sums of their counts and of their children's log Pw."""
    own = log_kt(zeros, ones)
    weighted = np.logaddexp(HALF + own, HALF + below)
    one = Level(node, zeros, ones, own, weighted)
    node, zeros, ones, below = fold(node, 1, zeros, ones, weighted)
    own = log_kt(zeros, ones)
    return [Level(node, zeros, ones, own, np.logaddexp(HALF + own, HALF + below)), one]


def log10_of(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context. levels: depths 0 to DEPTH."""
    context, byte = grams >> np.uint64(8) << np.uint64(8), grams & np.uint64(255)
    out = np.zeros(len(grams))
    for b in range(8):
        node = context | np.uint64(1 << b) | byte >> np.uint64(8 - b)
        at = _runs(node)
        own, spread = node[at], np.diff(np.append(at, len(node)))
        left, p = np.ones(len(at)), np.zeros(len(at))
        for depth, level in enumerate(levels):
            mask = ~np.uint64((1 << (8 * (DEPTH - depth + 1))) - 1) | np.uint64(255)
            weight, one = level.find(own & mask)
            if depth == DEPTH:
                weight = np.ones(len(at))
            p += left * weight * one
            left = left * (1 - weight)
        one = np.repeat(p, spread)
        bit = ((byte >> np.uint64(7 - b)) & np.uint64(1)).astype(bool)
        out += np.log10(np.where(bit, one, 1 - one))
    return out


#: Stands for the end of a text among the hashes of words.
END_WORD = np.uint64(0x656E64206F662061)
GRAMS, WORDS, PAGES = 0, 1, 2


def _pack(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, ...: these compress."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + values.itemsize.to_bytes(1, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(memoryview(blob)[9:], n * width, "zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


class Chunk:
    """Texts, or pieces of texts, and how they lie in one buffer. row: a number for the pieces of one text, -1 for a whole text."""

    ARRAYS = (("ids", "<i8"), ("nulls", "?"), ("held", "?"), ("row", "<i8"), ("last", "?"), ("offsets", "<i8"), ("before", "u1"), ("raw", "u1"))

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)
        self.before = self.before.reshape(-1, DEPTH)

    def save(self) -> list[bytes]:
        """A compressed buffer, in pages."""
        blobs = [np.ascontiguousarray(getattr(self, name), dtype).tobytes() for name, dtype in self.ARRAYS]
        head = np.array([len(b) for b in blobs], "<i8").tobytes()
        whole = head + b"".join(blobs)
        packed = len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)
        return [packed[at : at + PAGE] for at in range(0, len(packed), PAGE)]

    @classmethod
    def load(cls, pages: list[bytes]) -> Chunk:
        packed = b"".join(pages)
        whole = pa.decompress(memoryview(packed)[8:], int.from_bytes(packed[:8], "little"), "zstd")
        at, arrays = 8 * len(cls.ARRAYS), {}
        for (name, dtype), size in zip(cls.ARRAYS, np.frombuffer(whole, "<i8", len(cls.ARRAYS)).tolist(), strict=True):
            arrays[name] = np.frombuffer(memoryview(whole)[at : at + size], dtype)
            at += size
        return cls(**arrays)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct grams, where each begins among all sorted ones, and the text of every one of these."""
        packed = packed_grams(self.raw, self.offsets, self.before, self.last)
        doc = packed.astype(np.uint16)
        packed >>= np.uint64(16)
        at = _runs(packed)
        return packed[at], at, doc

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of words and ends."""
        texts = pa.LargeStringArray.from_buffers(len(self.ids), pa.py_buffer(self.offsets), pa.py_buffer(self.raw))
        hashes, ends = word_hashes(texts)
        whole = np.flatnonzero(self.last).astype(np.uint16)
        doc = np.concatenate([np.repeat(np.arange(len(self.ids), dtype=np.uint16), np.diff(ends)), whole])
        keys = np.concatenate([hashes, np.full(len(whole), END_WORD)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = _runs(keys)
        return keys[at], at, doc[order]

    def of(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.grams() if kind == GRAMS else self.words()


def _cuts(raw: np.ndarray, size: int) -> list[int]:
    """Where a text's pieces of at most `size` bytes begin: each but the first after white space."""
    out, n = [0], len(raw)
    while n - out[-1] > size:
        a = out[-1] + 1
        to = out[-1] + size
        while True:  # back from the full size; then, within a word longer than that, onward
            spaces = np.flatnonzero(SPACE[raw[a:to]])
            if len(spaces):
                at = a + int(spaces[-1 if to == out[-1] + size else 0]) + 1
                break
            if to >= n:
                return out
            a, to = to, min(n, to + size)
        if at >= n:
            break
        out.append(at)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Chunk]:
    """Chunks of about `size` bytes. batches: doc_id, text, held out."""
    held: list[tuple[pa.Array, ...]] = []
    total = 0

    def made(ids: pa.Array, out: pa.Array, raw: np.ndarray, offsets: np.ndarray, **more) -> Chunk:
        n = len(ids)
        whole = {"row": np.full(n, -1), "last": np.ones(n, bool), "before": np.full(n * DEPTH, END, np.uint8)}
        return Chunk(ids=ids.fill_null(0).to_numpy(zero_copy_only=False), nulls=ids.is_null().to_numpy(zero_copy_only=False), held=out.to_numpy(zero_copy_only=False), offsets=offsets, raw=raw, **(whole | more))

    def flush() -> Iterator[Chunk]:
        if held:
            ids, texts, out = (pa.chunked_array(c) for c in zip(*held, strict=True))
            held.clear()
            raw, offsets = buffer(texts)
            yield made(ids, out, raw, offsets)

    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        at = 0
        for i, more in enumerate(n.tolist()):
            if total + more > size or sum(len(h[0]) for h in held) + i - at >= CHUNK_DOCS:
                if at < i:
                    held.append(tuple(c.slice(at, i - at) for c in batch.columns))
                yield from flush()
                at, total = i, 0
            if more > size:
                ids, texts, out = (c.slice(i, 1) for c in batch.columns)
                raw, _ = buffer(texts)
                cuts, row = [*_cuts(raw, size), len(raw)], np.array([int.from_bytes(os.urandom(7))])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    before = raw[max(0, a - DEPTH) : a]
                    before = np.concatenate([np.full(DEPTH - len(before), END, np.uint8), before])
                    yield made(ids, out, raw[a:b], np.array([0, b - a]), row=row, last=np.array([b == len(raw)]), before=before)
                at = i + 1
            else:
                total += more
        if at < batch.num_rows:
            held.append(tuple(c.slice(at) for c in batch.columns))
    yield from flush()


def _bucket(keys: np.ndarray, kind: int, buckets: int, splits: int) -> np.ndarray:
    """Grams by their last two context bytes and, within, by the one before; words by their hash."""
    if kind == WORDS:
        return (mix64(keys) % np.uint64(buckets * splits)).astype(np.int64)
    own = mix64(keys >> np.uint64(32)) % np.uint64(buckets)
    return (own * np.uint64(splits) + mix64((keys >> np.uint64(24)) & np.uint64(255)) % np.uint64(splits)).astype(np.int64)


PARTS = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64())])
_PARTS = "kind int, bucket long, chunk long, keys binary, counts binary, n long"


def _deal(buckets: int, splits: int, size: int):
    """Of every chunk its pages (bucket: the page's number), and its distinct grams and words by bucket with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            number = int.from_bytes(os.urandom(7))
            pages = chunk.save()
            yield pa.RecordBatch.from_pylist([{"kind": PAGES, "bucket": k, "chunk": number, "keys": p} for k, p in enumerate(pages)], schema=PARTS)
            del pages
            release()
            for kind in (GRAMS, WORDS):
                keys, at, doc = chunk.of(kind)
                counts = np.add.reduceat(~chunk.held[doc], at, dtype=np.uint32) if len(at) else np.zeros(0, np.uint32)
                del at, doc
                to = _bucket(keys, kind, buckets, splits)
                order = np.argsort(to, kind="stable")
                to = to[order]
                cuts = [*_runs(to).tolist(), len(to)]
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    own = order[a:b]
                    rows.append({"kind": kind, "bucket": int(to[a]), "chunk": number, "keys": _pack_keys(keys[own]), "counts": _pack(counts[own]), "n": b - a})
                yield pa.RecordBatch.from_pylist(rows, schema=PARTS)
                del keys, counts, to, order, rows
                release()

    return run


def _counts(blob: bytes) -> np.ndarray:
    return _unpack(blob, "<u4" if blob[8] == 4 else "<i8").astype(np.int64)


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys that training has, with the sums of their counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = _runs(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _merge(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
    """One row of several chunks' keys of a bucket."""
    keys, counts = [], []
    for k, c in zip(x["keys"], x["counts"], strict=True):
        c, k = _counts(c), _unpack_keys(k)
        keys.append(k[c > 0])
        counts.append(c[c > 0])
    keys, counts = _sum(keys, counts)
    release()
    return pd.DataFrame({"kind": [key[0]], "bucket": [key[1]], "chunk": [key[2]], "keys": [_pack_keys(keys)], "counts": [_pack(counts)], "n": [len(keys)]}).astype({"kind": "int32"})


def _tasks(rows: DataFrame, most: int) -> DataFrame:
    """How many tasks a bucket's rows are dealt to, each of about `most` keys: kind, bucket, tasks, rows."""
    sizes = rows.groupBy("kind", "bucket").agg(F.sum("n").alias("all"), F.count("*").alias("rows"))
    return sizes.select("kind", "bucket", F.greatest(F.lit(1).cast("long"), F.least(F.ceil(F.col("all") / most), F.floor(F.col("rows") / 2))).alias("tasks"), "rows")


def merged(parts: DataFrame, most: int = TASK_GRAMS) -> DataFrame:
    """One row a kind and bucket, with the training's keys and counts. Tasks merge about `most` keys, level by level: rows of a bucket at least halve each time."""
    rows = parts
    while True:
        tasks = durable(_tasks(rows, most))
        level = rows.join(tasks.drop("rows"), ["kind", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("chunk"), F.col("tasks")))
        rows = durable(level.drop("tasks").groupBy("kind", "bucket", "chunk").applyInPandas(_merge, _PARTS))
        if tasks.where("tasks > 1").isEmpty():
            return rows


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Depth-2 nodes of merged buckets, with their counts and the sums of their children's log Pw."""
    for x in batches:
        for bucket, k, c in zip(x["bucket"], x["keys"], x["counts"], strict=True):
            if len(keys := _unpack_keys(k)):
                _, state = subtree(keys, _counts(c), 3)
                node, zeros, ones, below = fold(state[0], 3, *state[1:])
                yield pd.DataFrame({"bucket": np.full(len(node), bucket), "node": node.view(np.int64), "zeros": zeros, "ones": ones, "below": below})
                release()


def _bundle(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
    """The depth-2 nodes of a bucket in one row."""
    x = x.iloc[np.argsort(x["node"].to_numpy().view(np.uint64))]
    return pd.DataFrame({"own": [key[0]], **{c: [_pack(x[c].to_numpy())] for c in ("node", "zeros", "ones", "below")}})


def _second(node: bytes, zeros: bytes, ones: bytes, below: bytes) -> tuple[np.ndarray, ...]:
    """node, zeros, ones, log of the own estimate and log Pw of depth 2."""
    node, zeros, ones, below = (_unpack(b, t) for b, t in ((node, np.uint64), (zeros, np.int64), (ones, np.int64), (below, np.float64)))
    own = log_kt(zeros, ones)
    return node, zeros, ones, own, np.logaddexp(HALF + own, HALF + below)


def _first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Depth-1 nodes of bundles, with their counts and the sums of their children's log Pw."""
    for x in batches:
        for row in x[["node", "zeros", "ones", "below"]].itertuples(index=False):
            node, zeros, ones, _, weighted = _second(*row)
            node, zeros, ones, below = fold(node, 2, zeros, ones, weighted)
            yield pd.DataFrame({"node": node.view(np.int64), "zeros": zeros, "ones": ones, "below": below})


_NO_LEVEL = (np.zeros(0, np.uint64), *[np.zeros(0)] * 2, None, None)


def _answer(top):
    """Each chunk's answers of a bucket: log10 probabilities of its grams, or the training counts of its words."""

    def run(key: tuple, asked: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return pd.DataFrame({"chunk": [], "kind": [], "bucket": [], "answer": []})
        each = [_unpack_keys(k) for k in asked["keys"]]
        every = np.unique(np.concatenate(each))
        tree = trees.iloc[0] if len(trees) else None
        keys, counts = (_unpack_keys(tree["keys"]), _counts(tree["counts"])) if tree is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if key[0] == GRAMS:
            levels = subtree(keys, counts, 3)[0] if len(keys) else [Level(*_NO_LEVEL)] * (DEPTH - 2)
            second = Level(*_second(*tree[["node", "zeros", "ones", "below"]])) if tree is not None and tree["node"] is not None else Level(*_NO_LEVEL)
            found = log10_of(every, [*top.value, second, *levels]).astype("<f4")
        else:
            at = np.minimum(np.searchsorted(keys, every), max(0, len(keys) - 1))
            found = np.where(keys[at] == every, counts[at], 0) if len(keys) else np.zeros(len(every), np.int64)
            found = found.astype("<u4" if found.max(initial=0) < 1 << 32 else "<i8")
        out = [_pack(found[np.searchsorted(every, k)]) for k in each]
        release()
        return pd.DataFrame({"chunk": asked["chunk"].to_numpy(), "kind": key[0], "bucket": asked["bucket"].to_numpy(), "answer": out})

    return run


def _finish(buckets: int, splits: int, n: int, v: int):
    def run(_, pages: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        chunk, got = Chunk.load(pages.sort_values("bucket")["keys"].tolist()), {}
        docs = len(chunk.ids)
        for kind in (GRAMS, WORDS):
            keys, at, doc = chunk.of(kind)
            mine = answers[answers["kind"] == kind].sort_values("bucket")
            values = np.empty(len(keys))
            parts = [_unpack(b, "<f4") if kind == GRAMS else _counts(b) for b in mine["answer"]]
            if parts:
                values[np.argsort(_bucket(keys, kind, buckets, splits), kind="stable")] = np.concatenate(parts)
            del keys, parts
            values = np.repeat(values, np.diff(np.append(at, len(doc))))
            if kind == GRAMS:
                got["score"] = np.bincount(doc, weights=values, minlength=docs)
            else:
                got["base_score"] = np.bincount(doc, weights=np.log10((values + 1) / (n + v + 1)), minlength=docs)
                got["n_tokens"] = np.bincount(doc, minlength=docs)
                got["n_known"] = np.bincount(doc, weights=values > 0, minlength=docs).astype(np.int64)
            del values, doc, at
            release()
        ids = pd.array(chunk.ids, dtype="Int64")
        ids[chunk.nulls] = pd.NA
        out = pd.DataFrame({"row": chunk.row, "doc_id": ids, "held_out": chunk.held, "n_bytes": np.diff(chunk.offsets), "train_tokens": n, **got})
        release()
        return out

    return run


RESULT = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, task_grams: int = TASK_GRAMS, splits: int | None = None) -> DataFrame:
    """Trains on the rows where held_out is false and scores all: RESULT, score being log10 of the text's probability.

    base_score is that of a word unigram model with one added to every count; n_known counts tokens seen in training.
    splits: into how many the grams of two context bytes are dealt; by default 1 up to 4,096 buckets' worth of text.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(True)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    buckets = min(4096, pieces_of(size, bucket_bytes, least=12))
    splits = splits or min(256, pieces_of(size, bucket_bytes * 4096))
    parts = durable(rows.mapInArrow(_deal(buckets, splits, chunk_bytes), _PARTS))
    asked = parts.where(f"kind <> {PAGES}")
    trees = merged(asked, task_grams)
    n, v = trees.where(f"kind = {WORDS}").select("n", "counts").mapInPandas(_totals, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    nodes = trees.where(f"kind = {GRAMS}").select("bucket", "keys", "counts").mapInPandas(_nodes, "bucket long, node long, zeros long, ones long, below double")
    nodes = nodes.groupBy(F.floor(F.col("bucket") / splits).alias("own"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    bundles = durable(nodes.groupBy("own").applyInPandas(_bundle, "own long, node binary, zeros binary, ones binary, below binary"))
    sums = bundles.mapInPandas(_first, "node long, zeros long, ones long, below double")
    top = sums.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).toPandas()  # at most 256 * 255 rows
    node, zeros, ones, below = (top[c].to_numpy() for c in top.columns)
    node = node.view(np.uint64)
    order = np.argsort(node)
    shared = spark.sparkContext.broadcast(crown(*(a[order] for a in (node, zeros, ones, below))) if len(node) else [Level(*_NO_LEVEL)] * 2)
    # a bucket asked for more than a task's grams is answered in several tasks, each with the bucket
    tasks = durable(_tasks(asked, task_grams).select("kind", "bucket", "tasks"))
    asked = asked.join(tasks, ["kind", "bucket"]).select("kind", "bucket", F.pmod(F.xxhash64("chunk"), "tasks").alias("task"), "chunk", "keys")
    trees = trees.join(tasks, ["kind", "bucket"]).withColumn("own", F.when(F.col("kind") == GRAMS, F.floor(F.col("bucket") / splits))).join(bundles, "own", "left")
    trees = trees.select("kind", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), "keys", "counts", "node", "zeros", "ones", "below")
    by = ["kind", "bucket", "task"]
    answers = asked.groupBy(*by).cogroup(trees.groupBy(*by)).applyInPandas(_answer(shared), "chunk long, kind int, bucket long, answer binary")
    pages = parts.where(f"kind = {PAGES}").select("chunk", "bucket", "keys")
    found = pages.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_finish(buckets, splits, n or 0, v or 0), f"row long, {RESULT}")
    # texts of several pieces: their pieces' sums
    found = durable(found)
    sums = [F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "n_known")] + [F.max("train_tokens").alias("train_tokens"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score")]
    cut = found.where("row >= 0").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    return found.where("row < 0").unionByName(cut).drop("row")


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All training tokens, and distinct ones."""
    for x in batches:
        yield pd.DataFrame({"n": [sum(int(_counts(c).sum()) for c in x["counts"])], "v": [int(x["n"].sum())]})


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.col("score") * -np.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
