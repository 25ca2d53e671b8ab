"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Documents become token pieces of at most `capacity` ids. Each partition packs its
pieces best-fit (longest first, into the open bin with the least room that
suffices) and emits nearly full bins. Underfull bins are items of the next round:
fewer, larger groups best-fit them again, and so on up the tree until one group
holds what is left. Two bins over half full never meet, so of those only as many
come along as there are others, the emptiest (each of the others meets one of them
if it meets any); the rest is emitted. A group has at most one bin of half or less,
so few are left after a round. A group never holds more than `group_bins` bins on
average, so no task grows with the input.

Ids are those of the library's plain call: special tokens' strings in a text become
their ids, unless they are to be text.

Nulls: a null text is an empty one, whose only token is the closing id 0. A row
with a null doc_id is packed as any other. Repeated rows are packed once each; a
row repeated more often than a group has items is dealt to groups by its place in the
table, so that it makes no hot group. Ties: of items of one size the first in its group goes first, of bins with
equal room the latest. Texts of any length are read whole. An empty table gives an
empty result. Columns of items named as the results (sequence_id, offset) are
replaced, names that begin with _p_ are reserved, others are kept.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, pieces_of, release, ship

END_ID = 0
#: Distinct words that a worker remembers, and their characters.
CACHE, CACHE_CHARACTERS = 400_000, 16_000_000
#: Lower-case letters that no normalisation parts or joins with punctuation: Latin, Greek and Cyrillic ones.
LETTER = r"a-z\x{df}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3f5}\x{400}-\x{481}\x{48a}-\x{52f}"


ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class WordMerger:
    """BPE of many short words side by side: a row of ids for each word; every round merges each row's lowest-ranked pair, the leftmost first."""

    WIDTH = 24
    NONE = np.int32(1 << 30)

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in pairs], dtype=np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these stand for themselves, the rest follow from 256
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        suffix = model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[letter[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[letter[b] + suffix] for b in range(256)], dtype=np.int32)
        keys, self.bits = left << 32 | right, 18
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, self.NONE, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # open addressing: the first of those that want a free slot gets it
            free = np.flatnonzero(self.keys[slot[todo]] == -1)
            _, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free[first]]
            self.keys[slot[won]], self.ranks[slot[won]] = keys[won], won
            todo = np.setdiff1d(todo, won)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where it isn't a merge; a negative id is none."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(keys)
        out = np.full(len(keys), self.NONE, dtype=np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        while len(open_):
            held = self.keys[slot[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.ranks[slot[open_[same]]]
            open_ = open_[~same & (held != -1)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has. Words: 1 to WIDTH bytes."""
        n = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(n)
        width = int(n.max())
        ids = np.full((len(words), width + 1), -1, dtype=np.int32)
        ids[np.repeat(np.arange(len(words)), n), np.arange(len(raw)) - np.repeat(ends - n, n)] = self.inner[raw]
        ids[np.arange(len(words)), n - 1] = self.last[raw[ends - 1]]
        ranks = np.full((len(words), width + 1), self.NONE, dtype=np.int32)
        ranks[:, :width] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width)
        done_ids, done_rows, rows = [], [], np.arange(len(words))
        column = np.arange(width + 1)
        while len(rows):
            at = ranks.argmin(1)
            r = ranks[np.arange(len(rows)), at]
            over = r == self.NONE
            if over.any():
                done_ids.append(ids[over])
                done_rows.append(rows[over])
                rows, ids, ranks, at, r = rows[~over], ids[~over], ranks[~over], at[~over], r[~over]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            move = np.minimum(column + (column > at[:, None]), width)
            ids = np.take_along_axis(ids, move, 1)
            ids[:, width] = -1
            ids[each, at] = self.merged[r]
            ranks = np.take_along_axis(ranks, move, 1)
            ranks[:, width] = self.NONE
            ranks[each, at] = self.rank(ids[each, at], ids[each, np.minimum(at + 1, width)])
            before = at > 0
            ranks[each[before], at[before] - 1] = self.rank(ids[each[before], at[before] - 1], ids[each[before], at[before]])
        rows = np.concatenate(done_rows)
        ids = np.concatenate(done_ids)[np.argsort(rows, kind="stable")]
        there = ids >= 0
        return ids[there].astype(np.uint32), there.sum(1)


class WordTokenizer:
    """Ids of many texts. The tokenizer drops white space and never merges across it, nor from a letter into the punctuation after it,
    so distinct words are encoded once, in a cache of a fixed size: lower-case words of letters by WordMerger, others by the library.
    A text that holds a special token's string, in whatever case, goes to the library whole."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = special_as_text
        special = [t.content for t in self.t.get_added_tokens_decoder().values()]
        self.special = "|".join(re.escape(s.translate(ASCII_LOWER)) for s in special if s and not special_as_text)
        self.merger = WordMerger(path)
        self.empty()

    def empty(self) -> None:
        self.number: dict[str, int] = {}
        self.characters = 0
        self.size, self.first, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _add(self, words: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.characters += sum(map(len, words))
        self.first = np.concatenate([self.first, np.cumsum(size) - size + len(self.ids)])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers in the cache of distinct words."""
        if len(self.number) + len(words) > CACHE or self.characters > CACHE_CHARACTERS:
            self.empty()
        new = [w for w in words if w not in self.number]
        plain, other = [], []
        for w in new:
            fast = w.isalpha() and (w.isascii() or (max(w) < "\u0530" and unicodedata.is_normalized("NFC", w))) and w.lower() == w and len(raw := w.encode()) <= WordMerger.WIDTH
            plain.append((w, raw)) if fast else other.append(w)
        plain.sort(key=lambda p: len(p[1]))  # words of one length share a narrow matrix
        for at in range(0, len(plain), 5_000):
            part = plain[at : at + 5_000]
            ids, size = self.merger.encode([raw for _, raw in part])
            self._add([w for w, _ in part], size, ids)
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            ids = [e.ids for e in self.t.encode_batch_fast(part, add_special_tokens=False)]
            self._add(part, np.array([len(x) for x in ids], dtype=np.int64), np.fromiter(chain.from_iterable(ids), dtype=np.uint32))
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END_ID after each text, and where each text's ids end."""
        whole = pc.fill_null(texts, "")
        lower = pc.ascii_lower(whole)
        if not self.special:
            return self._by_word(lower)
        by_library = pc.match_substring_regex(lower, self.special)
        ids, ends = self._by_word(pc.if_else(by_library, "", lower))
        at = np.flatnonzero(by_library.to_numpy(zero_copy_only=False))
        if not len(at):
            return ids, ends
        found = [np.array(self.t.encode(whole[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in at]
        parts = np.split(ids, ends[at] - 1)  # before the END_ID of each of these texts
        more = np.zeros(len(ends), np.int64)
        more[at] = [len(f) for f in found]
        return np.concatenate([x for pair in zip(parts, [*found, ids[:0]], strict=True) for x in pair]), ends + np.cumsum(more)

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.replace_substring_regex(texts, rf"([{LETTER}])([.,;:!?]+)([ \n]|$)", r"\1 \2\3")
        words = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(words.flatten())
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        known = np.append(self.numbers(coded.dictionary.to_pylist()), -1)
        index = known[np.insert(coded.indices.to_numpy().astype(np.int64), offsets[1:], len(known) - 1)]
        each, first, ids = np.append(self.size, 1)[index], np.append(self.first, len(self.ids))[index], np.append(self.ids, np.uint32(END_ID))
        ends = np.cumsum(each)
        out = ids[np.repeat(first - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        return out, ends[offsets[1:] + np.arange(len(texts))]


_TOKENIZERS: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    key = path, special_as_text
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordTokenizer(*key)
    return _TOKENIZERS[key]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, ids (array of int) of each piece.

    special_as_text: whether special tokens' strings are ordinary text.
    """
    ship(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, special_as_text)
        for batch in batches:
            docs, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // (4 << 20), prepend=-1)).tolist()
            for at, to in zip(cuts, [*cuts[1:], len(docs)], strict=True):  # about 4 MB of text at a time
                ids, ends = t.texts(texts.slice(at, to - at))
                rows, begin = [], 0
                for doc, end in zip(docs[at:to], ends.tolist(), strict=True):
                    for k, p in enumerate(range(begin, end, capacity)):
                        part = ids[p : min(end, p + capacity)]
                        rows.append((doc, k, p - begin, len(part), zlib.crc32(part.astype("<u4").tobytes())) + ((part.astype(np.int32),) if with_ids else ()))
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            release()

    names = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, names)


def best_fit(fills: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing. For each item its bin and its place there, and the number of bins."""
    order = np.argsort(-fills, kind="stable")
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: there is an open bin with room r
    bins, places, n = [0] * len(fills), [0] * len(fills), 0
    sizes = fills.tolist()
    for i in order.tolist():
        size = sizes[i]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = capacity, n
            n += 1
        bins[i], places[i] = b, capacity - room
        if left := room - size:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return np.array(bins, dtype=np.int64), np.array(places, dtype=np.int64), n


def _round(level: int, capacity: int, names: list[str]):
    """Best-fits one group: single items at level 0, later the bins that the rows already lie in. Columns of the items pass as they are."""

    def run(x: pa.Table) -> pa.Table:
        fill = x["_p_fill"].to_numpy()
        if level == 0:
            item, fills = np.arange(len(fill)), fill
        else:
            _, first, item = np.unique(x["sequence_id"].to_numpy(), return_index=True, return_inverse=True)
            fills = fill[first]
        bins, places, n = best_fit(fills, capacity)
        full = np.bincount(bins, weights=fills, minlength=n).astype(np.int64)
        made = {
            "sequence_id": (np.int64(level) << 56) + (x["_p_group"].to_numpy() << 28) + bins[item],
            "offset": x["offset"].to_numpy() + places[item],
            "_p_fill": full[bins[item]],
        }
        return pa.table([pa.array(made[c]) if c in made else x[c] for c in names], names=names)

    return run


def _emptiest(bins: DataFrame, n: int) -> DataFrame:
    """About n of the bins with the least fill (of those with the last fill that is needed a share by hash)."""
    last, before, at = 0, 0, 0
    for fill, count in sorted((r["_p_fill"], r["count"]) for r in bins.groupBy("_p_fill").count().collect()):  # at most capacity rows
        last, before, at = fill, at, at + count
        if at >= n:
            break
    share = -(-(min(n, at) - before) * (1 << 20) // max(1, at - before))
    return bins.where((F.col("_p_fill") < last) | ((F.col("_p_fill") == last) & (F.pmod(F.xxhash64("sequence_id"), F.lit(1 << 20)) < share)))


def pack(items: DataFrame, capacity: int = 2048, slack: int = 2, local_items: int = 25_000, group_bins: int = 100_000) -> DataFrame:
    """items (with a long column length, at most capacity) with sequence_id (long) and offset (long, gapless from 0)."""
    ship(items.sparkSession)
    items = items.drop("sequence_id", "offset")
    columns = items.columns
    schema = ", ".join([f"`{c}` {t}" for c, t in items.dtypes] + ["sequence_id long", "offset long", "_p_fill long"])
    results = [*columns, "sequence_id", "offset", "_p_fill"]
    rows = items.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(0).cast("long"), "_p_fill": F.col("length"), "_p_key": F.xxhash64(*columns), "_p_row": F.monotonically_increasing_id()})
    done, level = None, 0
    rows = durable(rows)
    bins = rows.count()
    each = local_items
    # rows that are repeated more often than a group has items are dealt by their place in the table, others by what they hold
    often = rows.groupBy("_p_key").count().where(F.col("count") > local_items).select("_p_key", F.lit(True).alias("_p_often"))
    rows = rows.join(often, "_p_key", "left")
    first = F.when(F.col("_p_often"), F.xxhash64("_p_row", F.lit(level))).otherwise(F.xxhash64(*columns, F.lit(level)))
    while True:
        groups = pieces_of(bins, each)
        key = F.pmod(first if level == 0 else F.xxhash64("sequence_id", F.lit(level)), F.lit(groups)).cast("long")
        out = durable(rows.withColumn("_p_group", key).drop("_p_row", "_p_key", "_p_often").groupBy("_p_group").applyInArrow(_round(level, capacity, results), schema))
        if groups == 1:
            done = out if done is None else done.unionByName(out)
            break
        under = out.where((F.col("_p_fill") < capacity - slack) & (F.col("offset") == 0)).select("sequence_id", "_p_fill").distinct()
        roomy = F.col("_p_fill") * 2 <= capacity
        few = under.where(roomy).count()
        more = _emptiest(under.where(~roomy), few)
        open_bins = durable(under.where(roomy).unionByName(more).select("sequence_id"))
        part = out.join(open_bins, "sequence_id", "left_anti")
        done = part if done is None else done.unionByName(part)
        if not few:
            break
        rows = out.join(open_bins, "sequence_id", "left_semi").select(out.columns)
        bins, each, level = open_bins.count(), group_bins, level + 1
    return done.select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    return pack(token_pieces(docs, path, capacity), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
