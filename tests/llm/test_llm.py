"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from windgrid.llm import bpe, chat, ctw, graph, mixing, neardup, packing, quality, sharding, topk, toxicity, whitening, winnow
from windgrid.llm.words import shingle_sets, word_hashes

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = "the of and ing tion er an re ha un über é ñ ou 12 . ,".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    w = text.split(" ")
    for k in range(len(w)):
        if rng.random() < share:
            w[k] = "edit" + str(rng.randint(0, 10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [None, "", " \n\t", "one", "two words", "ÀÉ Mixed CASE text here", "a" * 5000, prose(rng, 20_000), "x\x85y z \x1cq", "👍🏽 é café ﬁ"]
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(60)] + [base] * 5 + [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.05])) for _ in range(40)]
    out = [(i * 3 - 5, t, rng.choice(["en", None]), rng.choice(["s1", "http://h.org/a/b", "s2", None]), 0) for i, t in enumerate(texts)]
    return [*out, out[20], out[20], (None, "no id at all", "en", "s1", 1), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep int, cluster int, severity string, keep string, _k int, shard string, sequence_id string, host string"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3, "z", "q", "h") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    ids = [r[0] for r in rows if r[0] is not None]
    return spark.createDataFrame([(i, i % 2 if i % 5 else None, int(i % 7 == 0)) for i in ids], "doc_id long, quality int, toxic int")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOW))


def test_word_hashes_and_shingles(rows):
    texts = [r[1] for r in rows]
    h, ends = word_hashes(pa.array(texts, pa.string()))
    assert np.diff(ends).tolist() == [len(words(t)) for t in texts]
    seen: dict[str, int] = {}
    for w, x in zip((w for t in texts for w in words(t)), h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    for t, s in zip(texts, shingle_sets(pa.array(texts, pa.string())), strict=True):
        w = words(t)
        assert len(s) == (len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0)


def test_sharding(docs, rows, empty):
    out = sharding.shard_documents(docs).toPandas()
    assert len(out) == len(rows)
    assert out.groupby("shard").slot.apply(sorted).map(lambda s: s == list(range(len(s)))).all()
    assert out.groupby(out.key.map(bytes)).shard.nunique().max() == 1
    assert sorted(out["size"]) == sorted(len((r[1] or "").encode()) + 1 for r in rows)
    assert Counter(out.text_crc32) == Counter(zlib.crc32((r[1] or "").encode()) for r in rows)
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_placement_is_the_heap_rule(seed):
    import heapq

    rng = np.random.default_rng(seed)
    sizes = sorted(zip(rng.choice(2000, 12, replace=False) + 1, rng.integers(1, 400, 12), strict=True), reverse=True)
    heap, expected = [(0, s) for s in range(5)], []
    for size, n in sizes:
        took = [0] * 5
        for _ in range(n):
            at, s = heap[0]
            took[s] += 1
            heapq.heapreplace(heap, (at + int(size), s))
        expected.append(took)
    assert [t.tolist() for t in sharding.place([(int(a), int(b)) for a, b in sizes], 5)] == expected


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack_documents(docs, path).toPandas()
    t = Tokenizer.from_file(path)
    expected = Counter()
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(0, len(ids), 2048):
            expected[r[0], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += 1
    got = Counter((None if pd.isna(x.doc_id) else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in out.itertuples())
    assert got == expected
    out = out.sort_values(["sequence_id", "offset"])
    assert ((out.groupby("sequence_id").length.cumsum() - out.length) == out.offset).all()
    fills = out.groupby("sequence_id").length.sum()
    assert fills.max() <= 2048 and len(fills) == -(-int(fills.sum()) // 2048)
    assert packing.pack_documents(empty, path).count() == 0


def test_word_tokenizer_equals_the_plain_call():
    """Default flags: every letter before punctuation, special strings in any case and place, random Unicode."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, mine = Tokenizer.from_file(path), packing.WordTokenizer(path)
    rng = random.Random(11)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}. a{c}!? {c}b " for c in every[k : k + 500]) for k in range(0, 0x30000, 500)]
    odd = ["İ.", "İ", "क़.", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "a", "Z", ".", "'s", "'RE", " ", "\n", "\x85", "\u0301", "é", "Σ", "ς.", "ß", "ﬁ", "12", "한", "的", "<|", "|>", "\x00"]
    texts += ["".join(rng.choices(odd, k=rng.randint(0, 12))) for _ in range(3000)] + ["".join(rng.choices(every[: rng.choice([256, 1500, 0x3000, len(every)])], k=rng.randint(0, 20))) for _ in range(3000)]
    texts += ["", None, "x" * 100_000, "<|endoftext|>" * 50, "a<|endoftext|>B"]
    for tokens, flag in ((mine, False), (packing.WordTokenizer(path, special_as_text=True), True)):
        t.encode_special_tokens = flag
        ids, ends = tokens.texts(pa.array(texts))
        for text, a, b in zip(texts, [0, *ends[:-1]], ends, strict=True):
            assert ids[a:b].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 0], repr(text)[:200]
    assert 49407 in mine.texts(pa.array(["a<|endoftext|>"]))[0] and [x.tolist() for x in mine.texts(pa.array([], pa.string()))] == [[], []]


def test_packing_clashing_columns_and_repeated_rows(spark):
    items = spark.createDataFrame([(1, 900, 5, "x")] * 700 + [(2, 100, 6, "y")] * 50, "id int, length long, sequence_id int, offset string")
    out = packing.pack(items, local_items=50, group_bins=50)
    assert out.columns == ["id", "length", "sequence_id", "offset"]
    out = out.toPandas()
    assert len(out) == 750 and out.groupby("sequence_id").length.sum().max() <= 2048 and out.sequence_id.nunique() <= 1.02 * 350 + 2


def test_packing_rounds(spark):
    """Groups far smaller than the table: the tree merges their underfull bins."""
    rng = random.Random(1)
    items = spark.createDataFrame([(i, rng.randint(1, 2048)) for i in range(3000)], "id long, length long")
    out = packing.pack(items, local_items=1000, group_bins=400).toPandas()
    fills = out.groupby("sequence_id").length.sum()
    assert len(out) == 3000 and fills.max() <= 2048 and len(fills) <= 1.02 * -(-fills.sum() // 2048) + 2
    same = packing.pack(spark.range(500).withColumn("length", F.lit(1500).cast("long")), local_items=50, group_bins=50)
    assert same.select("sequence_id").distinct().count() == 500


def test_packing_finds_the_few_bins_that_meet(spark):
    """Few small bins among many over half full ones, in many groups: each meets the one that has room for it, or others like it."""
    lengths = [1500] * 2000 + [1400] * 5 + [600] * 5
    items = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    out = packing.pack(items, local_items=50, group_bins=50).toPandas()
    fills = out.groupby("sequence_id").length.sum()
    assert sorted(out.id) == list(range(2010)) and len(fills) == 2005 and fills.max() == 2000
    out = out.sort_values(["sequence_id", "offset"])
    assert ((out.groupby("sequence_id").length.cumsum() - out.length) == out.offset).all()


def brute_components(pairs: list[tuple]) -> dict:
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for i, t in pairs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(docs, rows, empty):
    out = neardup.near_duplicates(docs).toPandas()
    assert len(out) == len(rows)
    expected = brute_components([(r[0], r[1]) for r in rows if r[0] is not None])
    named = out[out.doc_id.notna()]
    assert {int(x.doc_id): (x.n_shingles, int(x.component_id)) for x in named.itertuples()} == expected
    assert (named.kept == (named.doc_id == named.component_id)).all() and out[out.doc_id.isna()].kept.all()
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_unite_a_repeated_id(spark):
    """A doc_id with two texts is one document: it links what either is linked with, and has one component."""
    rng = random.Random(4)
    a, b, d = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (2, b), (5, a), (5, b), (5, ""), (5, None), (7, d), (8, None), (9, ""), (9, d + " more"), (9, d + " more")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    got = {(r["doc_id"], r["component_id"]) for r in out}
    assert got == {(1, 1), (2, 1), (5, 1), (7, 7), (8, 8), (9, 7)}


@pytest.mark.parametrize("center", [True, False])
def test_near_duplicates_large_cluster(spark, monkeypatch, center):
    """A cluster of several blocks gives the components that all pairs give; also where members are linked through one text only."""
    rng = random.Random(3)
    base = prose(rng, 150)
    shares = [0.0, 0.004, 0.01, 0.02] if center else [0.012, 0.02, 0.03]
    pairs = [(i, edited(rng, base, rng.choice(shares))) for i in range(160)] + [(1000 + i, prose(rng, 40)) for i in range(20)]
    pairs += [(2000 + i, edited(rng, base, 0.01) + " " + prose(rng, 10 * i)) for i in range(12)]
    monkeypatch.setattr(neardup, "BLOCK", 32)
    monkeypatch.setattr(neardup, "HUBS", 2)
    out = neardup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).toPandas()
    expected = brute_components(pairs)
    assert {int(x.doc_id): (x.n_shingles, int(x.component_id)) for x in out.itertuples()} == expected


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)] + [(500, 500)]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent: dict[int, int] = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    lone = {500} | {a for a, b in edges if a == b}
    assert {k: v for k, v in out.items()} == {k: root(k) for k in parent if k in out} and set(parent) - set(out) <= lone


def test_ctw_matches_a_plain_tree(docs, rows):
    """Sequential context-tree weighting over the same texts gives the same counts and mixing weights."""
    sample = [(k, t) for k, t in enumerate(["abcabcabd", "abracadabra", "", "zz"])]

    def context(data: list[int], k: int) -> tuple:
        return tuple(data[k - 1 - j] if k - 1 - j >= 0 else 255 for j in range(ctw.DEPTH))

    counts: dict[tuple, list[int]] = {}
    for _, t in sample[:3]:
        data = [*t.encode(), 255]
        for k, byte in enumerate(data):
            for b in range(8):
                node, bit = (1 << b) | byte >> (8 - b), byte >> (7 - b) & 1
                for d in range(ctw.DEPTH + 1):
                    counts.setdefault((node, context(data, k)[:d]), [0, 0])[bit] += 1

    def kt(a: int, b: int) -> float:
        p, n = 1.0, [0, 0]
        for bit in [0] * a + [1] * b:
            p *= (n[bit] + 0.5) / (sum(n) + 1)
            n[bit] += 1
        return p

    children: dict[tuple, list[tuple]] = {}
    for node, c in counts:
        if c:
            children.setdefault((node, c[:-1]), []).append((node, c))

    def weighted(key: tuple) -> float:
        own = kt(*counts[key])
        if len(key[1]) == ctw.DEPTH:
            return own
        return 0.5 * own + 0.5 * float(np.prod([weighted(c) for c in children[key]]))

    def predict(node: int, c: tuple) -> float:
        left, p = 1.0, 0.0
        for d in range(ctw.DEPTH + 1):
            key = (node, c[:d])
            n0, n1 = counts.get(key, [0, 0])
            w = (0.5 * kt(n0, n1) / weighted(key) if key in counts else 0.5) if d < ctw.DEPTH else 1.0
            p += left * w * (n1 + 0.5) / (n0 + n1 + 1)
            left *= 1 - w
        return p

    expected = []
    for _, t in sample:
        data, s = [*t.encode(), 255], 0.0
        for k, byte in enumerate(data):
            for b in range(8):
                p = predict((1 << b) | byte >> (8 - b), context(data, k))
                s += np.log10(p if byte >> (7 - b) & 1 else 1 - p)
        expected.append(s)
    spark = docs.sparkSession
    out = ctw.score(spark.createDataFrame(sample, "doc_id long, text string"), F.col("doc_id") == 3).orderBy("doc_id").toPandas()
    assert np.allclose(out.score, expected, rtol=1e-5)


def test_ctw_tables(docs, rows, empty):
    out = ctw.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).toPandas()
    assert len(out) == len(rows) and out.doc_id.isna().sum() == 2
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter(w for r in rows if not held(r[0]) for w in [*words(r[1]), None])
    n, v = sum(train.values()), len(train)
    expected = Counter()
    for r in rows:
        w = [*words(r[1]), None]
        expected[r[0], len(w), sum(x in train for x in w), round(sum(np.log10((train[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
    assert Counter((None if pd.isna(x.doc_id) else int(x.doc_id), x.n_tokens, x.n_known, round(x.base_score, 4)) for x in out.itertuples()) == expected
    assert (out.score < 0).all() and (out.train_tokens == n).all()
    assert ctw.score(empty, F.lit(False)).count() == 0


def test_ctw_in_many_pieces(docs, rows, empty):
    """Small chunks, a text of several pieces, a split of every context and merges in levels change nothing; nor does one context in a third of all text."""
    spark = docs.sparkSession
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    hot = [(k, "ab" * 40 + str(k)) for k in range(60)] + [(100, "one" * 400 + " " + prose(random.Random(3), 300)), (101, None)]
    for df in (docs.select("doc_id", "text"), spark.createDataFrame(hot, "doc_id long, text string")):
        key = ["doc_id", "n_bytes", "score"]
        one = ctw.score(df, held).toPandas().sort_values(key, ignore_index=True)
        many = ctw.score(df, held, chunk_bytes=700, task_grams=500, splits=3).toPandas().sort_values(key, ignore_index=True)
        assert len(one) == df.count()
        assert one.drop(columns=["score", "base_score"]).equals(many.drop(columns=["score", "base_score"]))
        assert np.allclose(one.score, many.score, rtol=1e-6) and np.allclose(one.base_score, many.base_score)
    assert ctw.score(empty, F.lit(False), splits=2).count() == 0
    out = ctw.score(spark.createDataFrame(hot, "doc_id long, text string"), F.lit(True)).toPandas()  # nothing to learn from: 1/2 a decision
    assert np.allclose(out.score, -(out.n_bytes + 1) * 8 * np.log10(2)) and (out.train_tokens == 0).all()


def test_ctw_cuts():
    raw = lambda t: np.frombuffer(t, np.uint8)
    assert ctw._cuts(raw(b"aa bb cc dd"), 4) == [0, 3, 6, 9]
    assert ctw._cuts(raw(b"aaaaaaaaaaaa bb"), 4) == [0, 13]
    assert ctw._cuts(raw(b"a aaaaaaaaaa "), 4) == [0, 2] and ctw._cuts(raw(b""), 4) == [0] and ctw._cuts(raw(b"a" * 50), 4) == [0]


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    odd = ["<s>", r"<\s>", r"<\\/s>[\INST]", "<<s>", None, "", "a\nb", "\\", "<", "[/INST", "</s", said, "😀é"]
    rng = random.Random(4)
    rows = [(c, k, rng.choice(["user", "assistant", "system", None, "<s>tool"]), rng.choice(odd)) for c in range(40) for k in range(rng.randint(1, 6))]
    rows += [(100, 0, "user", "hi"), (100, 1, "assistant", "yo"), (101, 1, "user", "b"), (101, 0, "system", "a"), (101, 2, "assistant", "c"), (None, None, "user", None), (7, 0, "user", "x"), (7, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"turns": F.lit(1), "state": F.lit(2)})
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in out.withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    by: dict = {}
    for c, k, role, text in rows:
        by.setdefault(c, []).append((k if k is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns)
        assert [(t["role"], t["text"]) for t in got[c]["back"]] == [t[1:] for t in turns]
        assert [t["loss"] for t in got[c]["back"]] == [t[1] == "assistant" for t in turns]
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert got[100]["valid"] and got[101]["valid"] and not got[7]["valid"]
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_bpe_pieces(tiktoken_encoding):
    enc, ranks = tiktoken_encoding
    rng = random.Random(1)
    for k in range(300):
        piece = "a" * rng.randint(1, 3000) if k % 10 == 0 else "".join(rng.choices("aàbié😀ztñ", k=rng.randint(1, 300)))
        assert bpe.encode_piece(piece.encode(), ranks) == enc._core_bpe.encode_single_piece(piece.encode())


def test_bpe_documents(docs, rows, empty, tiktoken_encoding):
    enc, _ = tiktoken_encoding
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    expected = Counter()
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        expected[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in bpe.digest_documents(docs, path, pattern).collect())
    assert got == expected
    full = bpe.encode_documents(docs, path, pattern).collect()
    assert Counter(bytes(r["decoded"]) for r in full) == Counter((r[1] or "").encode() for r in rows)
    assert bpe.digest_documents(empty, path, pattern).count() == 0


def brute_print(spark, texts: list[str]) -> list[list[tuple[int, int]]]:
    """Winnowing in plain Python: the rolling recurrence over the tokens' hashes, and the rightmost least of each window."""
    split = [re.findall(r"(?<!\S)\S{1,24}(?!\S)|\S", t, re.ASCII) for t in texts]
    distinct = sorted({w for s in split for w in s})
    hashed = spark.createDataFrame([(w,) for w in distinct] or [("",)], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    known, mask = {r["w"]: r["h"] & (1 << 64) - 1 for r in hashed}, (1 << 64) - 1
    rot = lambda x, n: (x << n | x >> 64 - n) & mask
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    short = {tuple(s) for s in split if 0 < len(s) < winnow.K}
    whole = {}
    for s in short:
        lits = F.array(*[F.xxhash64(F.lit(w)) for w in s])
        whole[s] = spark.range(1).select(F.xxhash64(lits)).first()[0]
    out = []
    for s in split:
        if len(s) < winnow.K:
            out.append([(whole[tuple(s)], 0)] if s else [])
            continue
        h, state = [], 0
        for i, w in enumerate(s):
            state = rot(state, 1) ^ known[w] ^ (rot(known[s[i - winnow.K]], winnow.K) if i >= winnow.K else 0)
            if i >= winnow.K - 1:
                h.append(signed(state))
        at = []
        for j in range(max(1, len(h) - winnow.W + 1)):
            window = h[j : j + winnow.W]
            p = j + max(k for k, x in enumerate(window) if x == min(window))
            if p not in at:
                at.append(p)
        out.append([(h[p], p) for p in at])
    return out


def test_winnowing(spark, docs, rows, empty):
    """Every row's neighbour, edited text, both fingerprints and likenesses against plain Python."""
    out = winnow.compare_edits(docs).toPandas()
    low = lambda i: -(1 << 63) if i is None else i
    tie = {r["t"]: r["h"] for r in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").distinct().select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-low(r[0]), tie[r[1]]))
    following = [*order[1:], order[0]]
    edited_texts = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), (_, n) in zip(order, following, strict=True)]
    prints, edited_prints = brute_print(spark, [t for _, t in order]), brute_print(spark, edited_texts)

    def like(a: list, b: list) -> float:
        a, b = ({h for h, _ in x} for x in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    want = Counter()
    for k, (i, t) in enumerate(order):
        following_print = prints[(k + 1) % len(order)]
        want[i, len(t), edited_texts[k], tuple(prints[k]), tuple(edited_prints[k]), round(like(prints[k], edited_prints[k]), 9), round(like(prints[k], following_print), 9)] += 1
    flat = lambda p: tuple((x["hash"], x["position"]) for x in p)
    got = Counter((None if pd.isna(x.doc_id) else int(x.doc_id), x.n_chars, x.edited, flat(x.print), flat(x.edited_print), round(x.near_edited, 9), round(x.near_next, 9)) for x in out.itertuples())
    assert got == want
    assert winnow.compare_edits(empty).count() == 0


def test_next_row_over_many_ranges(spark):
    """Ids far apart, beyond what a double holds, and repeated ones; ranges of a few rows."""
    rng = random.Random(12)
    ids = [rng.choice([0, 1 << 62, -(1 << 60)]) + rng.randint(0, 50) for _ in range(300)] + [5] * 40 + [None, None]
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, v int")
    out = winnow.with_next(df, "id", ["v"], F.col("v"), rows_each=7).collect()
    low = lambda i: -(1 << 63) if i is None else i
    order = sorted(range(len(ids)), key=lambda k: (-low(ids[k]), k))
    assert {r["v"]: r["next_v"] for r in out} == dict(zip(order, [*order[1:], order[0]], strict=True))


def test_winnowing_rule(spark):
    """Minimum of each window, the rightmost of ties, with its position."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("a b c d".split(), k=rng.randint(0, 60))) for _ in range(30)] + ["a " * 50, "q" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    g = winnow.grams(F.coalesce("t", F.lit("")))
    for r in df.select("t", g.alias("gh"), winnow.positions(winnow.fingerprint(F.col("t"))).alias("p")).collect():
        h, want = r["gh"], []
        for j in range(max(1, len(h) - winnow.W + 1) if h else 0):
            window = h[j : j + winnow.W]
            at = j + max(k for k, x in enumerate(window) if x == min(window))
            if at not in want:
                want.append(at)
        assert r["p"] == want


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(size=(400, 8)) * 20)
    v[100:200] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (950, [1.0, 2.0]), (5, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumns({"id": F.lit(1), "pivot": F.lit(2), "rank": F.lit(3)})
    out = topk.top_k(df.drop("label"), "vec_id", "v", F.col("vec_id") % 50 == 0).toPandas()
    fine = [(i, np.pad(np.array(x), (0, 8 - len(x)))) for i, x in rows if x is not None and all(y is not None and np.isfinite(y) for y in x)]
    expected = set()
    for q, x in fine:
        if q % 50 == 0:
            best = sorted(((-float(x @ y), i) for i, y in fine if i != q))[:5]
            expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in out.itertuples(index=False)} == expected
    assert topk.top_k(df.limit(0), "vec_id", "v", F.lit(True)).count() == 0
    huge = df.select("vec_id", "v").unionByName(spark.createDataFrame([(1000, [1e200] * 8)], "vec_id long, v array<double>"))  # its squared norm overflows
    assert {tuple(r) for r in topk.top_k(huge, "vec_id", "v", F.col("vec_id") % 50 == 0).collect()} == expected


def test_top_k_opens_few_annuli_where_vectors_have_structure(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8)) * 100
    tight = [(i, (centres[i % 20] / np.linalg.norm(centres[i % 20]) * 100 + rng.normal(size=8) * 0.5).tolist()) for i in range(4000)]
    loose = [(i, rng.normal(size=64).tolist()) for i in range(1000)]
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "TASK_BLOCKS", 2)
    for rows, most in ((tight, 0.4), (loose, 1.01)):
        index = topk.Index(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v", F.col("vec_id") % 50 == 0)
        assert 0 < index.opened_share(5) < most
        m = np.array([r[1] for r in rows])
        scores = m[::50] @ m.T
        scores[np.arange(len(scores)), np.arange(0, len(rows), 50)] = -np.inf
        want = {(50 * q, k + 1, int(j)) for q, s in enumerate(scores) for k, j in enumerate(np.lexsort((np.arange(len(s)), -s))[:5])}
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in index.top_k(5).collect()} == want


def test_top_k_query_leaves_out_what_is_not_finite(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(120, 4)).astype(np.float32))]
    bad = [[float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [float("-inf"), 1.0, 1.0, 1.0], [None, 1.0, 1.0, 1.0], None]
    rows = vectors + [(1000 + 25 * i, x) for i, x in enumerate(bad)]  # candidates, and every other one a query
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in topk.query(spark, str(tmp_path)).collect()}
    whole = {i: np.floor(256 * np.array(x)) for i, x in vectors}
    expected = set()
    for q in range(0, 120, 50):
        best = sorted((-int(whole[q] @ y), i) for i, y in whole.items() if i != q)[:5]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == expected


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        t = prose(rng, rng.randint(20, 120)).split(" ")
        toxic = i % 6 == 0
        for _ in range(rng.randint(3, 6) if toxic else 0):
            t.insert(rng.randint(0, len(t)), rng.choice(["vileword", "nastything", "grimstuff", "foulones"]))
        rows.append((i, " ".join(t), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, toxic int").unionByName(spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 4 == 0], "doc_id long, toxic int"))
    out = toxicity.score(docs, toxicity.fit(docs, labels)).toPandas().set_index("doc_id")
    wrong = sum(out.toxic[r[0]] != bool(r[2]) for r in rows)
    assert wrong <= 3
    assert out[out.toxic].severity.mean() > out[~out.toxic].severity.mean()
    assert all((np.diff(p) <= 1e-12).all() for p in out.p_grade)


def test_toxicity_counts_by_one_rule_of_length():
    """A text repeated m times: each number grows with every repeat, evenly and without a bend, towards LONG times its rate."""
    text, vocabulary = "vile words and more " * 10, pa.array(["vile", "wor*"])
    x = toxicity.counts(pa.array([(text * m).strip() for m in range(1, 200)]), vocabulary)
    n = 40 * np.arange(1, 200)
    for column, rate in ((0, 1 / 4), (1, 1 / 4), (2, 1 / toxicity.UNIT)):
        assert np.allclose(x[:, column], rate * n * toxicity.LONG / (toxicity.LONG + n))
    assert (np.diff(x, axis=0) > 0).all() and (np.diff(x, 2, axis=0) < 0).all() and (x[:, 0] < toxicity.LONG / 4).all()
    empty, none = toxicity.counts(pa.array(["", None]), vocabulary).tolist()  # one empty word each
    assert empty == none and empty[:2] == [0.0, 0.0]


def test_toxicity_edges(docs, rows, labels, empty, spark):
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.count() == len(rows) and out.where("toxic IS NULL").count() == 0
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)))
    assert none.where("toxic").count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_ordinal_fit_orders_cuts():
    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, (2000, 3)).astype(float)
    z = x @ [1.5, 0.5, 0.0] + rng.logistic(size=2000)
    w, cuts = toxicity.fit_ordinal(x, np.digitize(z, [1.0, 3.0, 5.0]), 4)
    assert (np.diff(cuts) > 0).all() and np.allclose(w, [1.5, 0.5, 0.0], atol=0.25) and np.allclose(cuts, [1, 3, 5], atol=0.4)


def test_quality_edges(docs, rows, labels, empty):
    out = quality.classify(docs, labels)
    assert out.count() == len(rows) and out.where("quality IS NULL OR keep IS NULL").count() == 0
    assert quality.classify(docs, labels.limit(0)).where("NOT keep").count() == 0
    assert quality.classify(empty, labels).count() == 0


def test_quality_shrinks_sparse_sites(spark):
    """A site's posterior lies between its own mean and the global one, nearer to the latter with fewer rows."""
    scored = spark.createDataFrame([("good", "a", 0.95)] * 200 + [("bad", "a", 0.1)] * 200 + [("new", "a", 0.1)] * 2 + [("mid", "b", 0.6)] * 50, "host string, path string, p_text double")
    out = {r["host"]: r for r in quality.rate_sites(scored).collect()}
    overall = out["good"]["p_all"]
    assert 0.1 < out["bad"]["p_site"] < out["new"]["p_site"] < overall < out["good"]["p_site"] < 0.95


def test_quality_on_planted_forms(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        t = prose(rng, 80)
        poor = i % 5 == 0
        rows.append((i, " ".join(w + "%%%" for w in t.split(" ")) if poor else t, "s", "en", int(not poor)))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 3], "doc_id long, quality int")
    out = quality.classify(docs, labels).toPandas().set_index("doc_id")
    assert all(out.keep[r[0]] == bool(r[4]) for r in rows)


@pytest.fixture(scope="module")
def sf(tmp_path_factory, docs, labels):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def test_sharding_query_is_the_heap_rule(spark, sf, rows):
    """Loads of all shards equal those of the plain heap over groups of equal texts; slots are gapless; copies stay together."""
    import heapq

    out = sharding.query(spark, sf).toPandas()
    size = Counter()
    for r in rows:
        size[r[1] or ""] += len((r[1] or "").encode()) + 1
    heap = [(0, s) for s in range(16)]
    for n in sorted(size.values(), reverse=True):
        at, s = heap[0]
        heapq.heapreplace(heap, (at + n, s))
    assert Counter(out.groupby("shard")["size"].sum().to_dict()) == Counter({s: at for at, s in heap if at})
    assert Counter(zip([None if pd.isna(x) else int(x) for x in out.doc_id], out["size"], out.text_crc32, strict=True)) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot)
    assert (out.groupby("text_crc32").shard.nunique() == 1).all() and (out.law == "bytes").all() and out.grown_shard.isna().all()


def test_sharding_clashing_columns_and_hot_rows(spark):
    df = spark.createDataFrame([("a", 5, 1, "x", 2)] * 300 + [("b", 5, 1, "x", 2), ("c", 900, 1, None, 2)], "key string, size long, shard int, slot string, part int")
    out = sharding.shard_groups(df, "key", "size", ["key"], 3)
    assert out.columns == ["key", "size", "part", "shard", "slot"]
    out = out.toPandas()
    assert out.groupby("key").shard.nunique().max() == 1 and out.shard.nunique() == 3 and sorted(out[out.key == "a"].slot) == list(range(300))


def brute_posteriors(p, host, path) -> tuple[np.ndarray, np.ndarray]:
    """Site posteriors and qualities in plain numpy: moments of groups for the prior's strength, shrinking to host and to all."""
    p = np.asarray(p)

    def strength(groups: list[np.ndarray], base: list[float]) -> float:
        n = np.array([len(g) for g in groups], float)
        if len(groups) < 2:
            return 50.0
        within = max(sum(((g - g.mean()) ** 2).sum() for g in groups) / n.sum(), 1e-6)
        between = sum(len(g) * (g.mean() - b) ** 2 for g, b in zip(groups, base, strict=True))
        spread = (between - len(groups) * within) / max(n.sum() - (n**2).sum() / n.sum(), 1.0)
        return min(1000.0, max(5.0, within / max(spread, 1e-9)))

    overall = p.mean()
    of = lambda keys: {k: p[[x == k for x in keys]] for k in dict.fromkeys(keys)}
    hosts, paths = of(host), of(list(zip(host, path, strict=True)))
    k = strength(list(hosts.values()), [overall] * len(hosts))
    p_host = {h: (g.sum() + k * overall) / (len(g) + k) for h, g in hosts.items()}
    k = strength(list(paths.values()), [p_host[h] for h, _ in paths])
    p_path = {hp: (g.sum() + k * p_host[hp[0]]) / (len(g) + k) for hp, g in paths.items()}
    site = np.array([p_path[hp] for hp in zip(host, path, strict=True)])
    odds = lambda x: np.clip(x, 1e-9, 1 - 1e-9) / (1 - np.clip(x, 1e-9, 1 - 1e-9))
    ratio = odds(p) * odds(site) / odds(np.array(overall))
    return site, ratio / (1 + ratio)


def test_quality_equals_plain_numpy(spark):
    rng = random.Random(21)
    places = [("a.org/x/1", "en"), ("http://a.org/y?q", "en"), ("https://b.net/x", "de"), ("b.net", "de"), ("b.net", "fr"), (None, "en"), ("solo", None)]
    rows = []
    for i in range(500):
        k = rng.choices(range(len(places)), weights=[150, 40, 60, 30, 3, 20, 1])[0]
        poor = rng.random() < (0.7 if k == 0 else 0.1)
        t = prose(rng, rng.randint(5, 60))
        rows.append((i, " ".join(w + "%$#" for w in t.split(" ")) if poor else t, *places[k], int(not poor)))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 4 == 0], "doc_id long, quality int")
    out = quality.classify(docs, labels).toPandas().sort_values("doc_id")
    host, path = [], []
    for s, lang in zip([r[2] for r in rows], [r[3] for r in rows], strict=True):
        parts = re.split("[/?#]", re.sub("^[a-z]+://", "", s), maxsplit=2) if s is not None else [None]
        host.append(parts[0])
        path.append(parts[1] if len(parts) > 1 else lang)
    model = quality.fit(docs, labels)
    p = model.p(quality.features(pa.array([r[1] for r in rows])))
    assert np.allclose(out.p_text, p, atol=1e-9)
    site, posterior = brute_posteriors(p, host, path)
    assert np.allclose(out.p_site, site, atol=1e-9) and np.allclose(out.quality, posterior, atol=1e-9) and (out.keep == (posterior >= 0.5)).all()
    bare = quality.classify(docs, labels, with_text=False)
    assert bare.columns == ["doc_id", "source", "lang", "p_text", "p_site", "quality", "keep"] and np.allclose(bare.toPandas().sort_values("doc_id").quality, posterior, atol=1e-9)


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * [1, 3, 0.2, 1]
    y = (x @ [1, -0.3, 2, 0] + rng.logistic(size=300) > 0.2).astype(float)
    m = quality.fit_logistic(x, y)
    z = np.column_stack([(x - m.mean) / m.scale, np.ones(300)])
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + 0.15 * (w[:-1] ** 2).sum() + 5e-7 * w[-1] ** 2
    assert all(loss(m.weights) <= loss(m.weights + d) for d in rng.normal(size=(200, 5)) * 0.01)


def test_ordinal_likelihood_and_probabilities(spark):
    """Graded labels: the fit is near the best penalised likelihood, and a document's probabilities are those of its counts in plain Python."""
    rng = random.Random(31)
    bad = ["vileword", "nastything", "grimstuff"]
    rows = []
    for i in range(900):
        t = prose(rng, rng.randint(20, 60)).split(" ")
        grade = rng.choice([0, 0, 0, 1, 2, 3])
        for _ in range(max(0, grade + rng.choice([-1, 0, 0, 1, 2]))):
            t.insert(rng.randint(0, len(t)), rng.choice(bad))
        rows.append((i, " ".join(t), grade))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert len(model.cuts) == 3 and (np.diff(model.cuts) > 0).all()
    out = toxicity.score(docs, model).toPandas().sort_values("doc_id")
    place = {w: k for k, w in enumerate(model.words)}
    x = np.zeros((len(rows), len(model.words) + 1))
    for k, r in enumerate(rows):
        found = [w.strip(toxicity.PUNCTUATION) for w in r[1].lower().split()]
        for w in found:
            for f in [w, *[w[:n] + "*" for n in toxicity.PREFIXES if len(w) > n]]:
                if f in place:
                    x[k, place[f]] += 1
        x[k, -1] = len(found) / toxicity.UNIT
        x[k] *= toxicity.LONG / (toxicity.LONG + len(found))  # the same rule at every length
    p = 1 / (1 + np.exp(model.cuts[None, :] - (x @ model.weights)[:, None]))
    assert np.allclose(np.stack(out.p_grade), p, atol=1e-9) and np.allclose(out.severity, p.sum(1)) and (out.toxic == (x @ model.weights >= model.reject)).all()
    grade = np.array([r[2] for r in rows])
    assert np.corrcoef(out.severity, grade)[0, 1] > 0.7

    def loss(w, cuts):
        edge = np.concatenate([[-1e9], cuts, [1e9]])
        s = x @ w
        mass = [1 / (1 + np.exp(np.clip(s - edge[grade + d], -40, 40))) for d in (1, 0)]
        return -np.log(np.maximum(mass[0] - mass[1], 1e-12)).mean() + 0.003 * (w**2).sum() / 2 / np.sqrt(len(x))

    best, step = loss(model.weights, model.cuts), np.random.default_rng(1)
    for _ in range(200):
        assert loss(model.weights + step.normal(size=len(model.weights)) * 0.02, model.cuts + step.normal(size=3) * 0.02) > best - 1e-4
    two = toxicity.fit(docs, spark.createDataFrame([(r[0], int(r[2] > 0)) for r in rows], "doc_id long, toxic int"))
    assert len(two.cuts) == 1


def test_queries_of_documents(spark, sf, rows):
    """The registered queries over a small folder, on the same rows that the operators are tested with."""
    from tokenizers import Tokenizer

    words_of = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(words_of)
    want = Counter()
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((r[0], k, zlib.crc32(ids[k * 2048 : (k + 1) * 2048].tobytes())) for k in range(-(-len(ids) // 2048)))
    none = lambda x: None if x is None else int(x)
    assert Counter((none(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in packing.query(spark, sf).collect()) == want
    near = {none(r["doc_id"]): (r["n_shingles"], none(r["component_id"])) for r in neardup.query(spark, sf).collect()}
    comps = brute_components([(r[0], r[1]) for r in rows if r[0] is not None])
    assert {k: v for k, v in near.items() if k is not None} == comps
    out = ctw.query(spark, sf).toPandas()
    assert len(out) == len(rows) and (out.held_out == out.doc_id.map(lambda i: pd.isna(i) or zlib.crc32(str(int(i)).encode()) % 7 == 2)).all()
    assert (out.bits_per_byte > 0).all() and (out.n_known <= out.n_tokens).all()
    pieces = bpe.query(spark, sf).collect()
    assert Counter(r["decoded_sha256"] for r in pieces) == Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    edits = winnow.query(spark, sf).collect()
    assert len(edits) == len(rows) and len({r["fingerprint"] for r in edits}) >= len({r[1] for r in rows if r[1] and r[1].split()})
    for module, columns in ((quality, {"p_text", "p_site", "quality", "keep"}), (toxicity, {"severity", "toxic", "p_grade"})):
        got = module.query(spark, sf)
        assert set(got.columns) == {"doc_id", *columns} and Counter(r["doc_id"] for r in got.collect()) == Counter(r[0] for r in rows)


def test_queries_of_empty_tables(spark, tmp_path, empty, labels):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for module in (ctw, sharding, packing, neardup, quality, toxicity, winnow, bpe):
        assert module.query(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_columns(spark, docs, empty, sf):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, empty):
            out = stage(spark, table, sf)
            assert out.dtypes == docs.dtypes
            assert out.exceptAll(table).count() == 0  # rows as they came
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_is_its_stages(spark, docs, rows, sf):
    """Run against the decisions of each operator, taken one after another."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    left = docs.select("doc_id", "text", "lang", "source")
    scored = toxicity.score(left, toxicity.fit(left, labels)).collect()
    left = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in scored if not r["toxic"]], left.schema)
    scored = quality.classify(left, labels).collect()
    kept = [(r["doc_id"], r["text"]) for r in scored if r["keep"]]
    comps = brute_components([x for x in kept if x[0] is not None])
    want = Counter({i: 1 for i, (_, c) in comps.items() if i == c}) + Counter(x[0] for x in kept if x[0] is None)
    out = corpus_pipeline.run(spark, sf).where("piece = 0").select("doc_id").collect()
    assert Counter(r["doc_id"] for r in out) == want


def test_pipeline_drops_copies_from_eighty_percent(spark, tmp_path):
    """Pairs of 0.80 to 0.85, which op4_neardup keeps apart, lose their copy; those just under 0.80 stay."""
    rng = random.Random(11)
    pairs, alike = [], {}
    for i in range(60):  # a tail of n other words in place of the last ones: 100 shingles in common of 100 + 2 n
        n = (10, 11, 12, 13)[i % 4]
        w = [f"w{i}x{rng.randint(0, 10**9)}" for _ in range(104 + n)]
        other = w[:104] + [f"v{i}x{rng.randint(0, 10**9)}" for _ in range(n)]
        pairs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        alike[i] = 100 / (100 + 2 * n)
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, str(tmp_path)).collect()}
    assert left == {2 * i for i in alike} | {2 * i + 1 for i, j in alike.items() if j < 0.8}
    assert neardup.near_duplicates(docs).where("kept").count() == 120


def test_pipeline_drops_rows_not_ids(spark, tmp_path):
    """Rows that share an id are judged by their texts, and so are rows without one."""
    rng = random.Random(13)
    a, b, d, e = (prose(rng, 80) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + " end"), (None, d), (None, d), (None, a), (None, e), (5, e), (6, None), (6, None), (6, ""), (7, ""), (None, ""), (None, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _row int")
    out = corpus_pipeline.drop_copies(spark, docs, str(tmp_path))
    assert out.dtypes == docs.dtypes and out.exceptAll(docs).count() == 0
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(1, a), (2, b), (None, d), (5, e), (6, None), (6, ""), (7, ""), (None, ""), (None, "")])


@pytest.mark.parametrize("name", ["op4_neardup", "op6_chat", "op10_topk", "op12_mixing"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tests.conftest import DATA
    from windgrid.llm import registry

    sf = DATA / "sf0.001"
    if not sf.exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for p in sf.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cursor = c.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in cursor.description)
    place = {d[0]: k for k, d in enumerate(cursor.description)}
    want = sorted(tuple(r[place[n]] for n in names) for r in cursor.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in registry.queries()[name](spark, str(sf)).collect()) == want


# ids beside a null


BIG = [(1 << 60) + 1, None, (1 << 60) + 3]


def test_ids_stay_exact_beside_null(spark):
    docs = spark.createDataFrame([(i, f"text number {k}") for k, i in enumerate(BIG)], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for out in (
        bpe.digest_documents(docs, path, public_tokenizers.PATTERN),
        bpe.encode_documents(docs, path, public_tokenizers.PATTERN),
        packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")),
        packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True),
    ):
        assert {r["doc_id"] for r in out.collect()} == set(BIG)


def test_pack_keeps_other_columns(spark):
    rows = [(i, 700, None if k % 2 else i, [i], "s") for k, i in enumerate(range((1 << 60) + 1, (1 << 60) + 40))]
    items = spark.createDataFrame(rows, "a long, length long, b long, c array<long>, offset string").coalesce(1)
    out = packing.pack(items, local_items=10, group_bins=10)
    assert sorted(map(tuple, out.select("a", "length", "b", "c").collect()), key=str) == sorted((r[:4] for r in rows), key=str)
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 2048 for r in full) and len(full) <= 21


def test_emptiest_of_equal_fills(spark):
    bins = spark.createDataFrame([(k, 1500 if k < 3000 else 1100) for k in range(4000)], "sequence_id long, _p_fill long")
    for n in (0, 500, 1000, 1001, 2000, 4000, 9000):
        got = packing._emptiest(bins, n).collect()
        assert abs(len(got) - min(n, 4000)) < 200
        assert n < 1000 or sum(r["_p_fill"] == 1100 for r in got) == 1000


# whitening


def brute_whitening(vectors: list, dim: int, k: int = 8):
    kept = [v for v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in [*v, *[0.0] * (dim - len(v))]] for v in kept], dtype=object)
    n, total = len(x), x.sum(0)
    centred = np.array((n * x - total).tolist(), dtype=np.float64) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - total) ** 2).sum(1).tolist(), centred @ axes[:, :k] / np.sqrt(values[:k]), values


def test_jacobi_small_eigenvalues():
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    values = np.array([10.0**-k for k in range(12)])
    got, found = whitening.jacobi(axes @ np.diag(values) @ axes.T)
    assert np.allclose(got[:8], values[:8], rtol=1e-6) and np.allclose(found.T @ found, np.eye(12), atol=1e-13)
    scaled = np.diag(10.0 ** np.arange(0, -12, -2)) @ (np.eye(6) + 0.1) @ np.diag(10.0 ** np.arange(0, -12, -2))
    got, found = whitening.jacobi(scaled)  # graded: small ones keep their relative accuracy
    assert np.abs(scaled @ found - found * got).max() < 1e-15 and got[-1] > 0
    assert np.isclose(np.prod(got), np.linalg.det(np.eye(6) + 0.1) * 10.0 ** (-4 * 15), rtol=1e-9)
    for trivial in (np.zeros((3, 3)), np.eye(2), np.ones((4, 4))):
        got, found = whitening.jacobi(trivial)
        assert np.allclose(found * got @ found.T, trivial)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(9)
    mixing_matrix = rng.normal(size=(10, 10)) * 10.0 ** -np.arange(10)[:, None].clip(0, 2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(300, 10)) @ mixing_matrix + 40)]
    rows += [((1 << 60) + 1, rows[0][1]), (None, rows[1][1]), (5, rows[5][1]), (5, rows[5][1])]
    return rows + [(900, None), (901, [1.0, None] + [0.0] * 8), (902, [float("nan")] * 10), (903, [1.0] * 9 + [float("inf")]), (904, [1e300] * 10), (905, rows[2][1][:7]), (906, [])]


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_is_brute_force(spark, vectors, parts):
    schema = "vec_id long, embedding array<double>, n int, component string, deviation int"
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors], schema).repartition(parts)
    out = whitening.whiten(df, "vec_id", "embedding")
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    kept = [(i, v) for i, v in vectors if i not in (900, 901, 902, 903, 904)]
    n, deviations, white, values = brute_whitening([v for _, v in kept], 10)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    rows = {c: sorted(((str(r["vec_id"]), r["deviation"], r["whitened"], r["explained"]) for r in got if r["component"] == c)) for c in range(1, 9)}
    for c in range(1, 9):
        want = sorted((str(i), d, w) for (i, _), d, w in zip(kept, deviations, white[:, c - 1], strict=True))
        assert [r[:2] for r in rows[c]] == [w[:2] for w in want]
        a, b = (np.array([r[2] for r in x]) for x in (rows[c], want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
        assert np.isclose(rows[c][0][3], values[c - 1] / values.sum(), rtol=1e-9)


def test_whitening_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema), "vec_id", "embedding").collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0])], schema), "vec_id", "embedding").collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, 0.0), (2, 0, None, None, 0.0)]
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 3.0]) for k in range(20)], schema), "vec_id", "embedding").collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and flat[0]["identity_error"] < 1e-12


def test_exact_deviations_beyond_a_double():
    near = np.array([[3_000_000_001, -1], [5, 7]], dtype=np.int64)
    for n, rest in ((1, [0, 0]), (2, [1, 1]), (10**6, [3, 4])):
        want = [sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in near.tolist()]
        assert whitening.exact_deviations(near, n, rest).to_pylist() == [w if w < 2**63 else None for w in want]


# mixing


def brute_mix(rows: list[tuple], share: float = 1.5, most: int = 2) -> list[tuple]:
    """(doc_id, text, source) rows: sorted (doc_id, size, source_size, target, taken)."""
    by: dict = {}
    for doc, text, source in rows:
        digest = hashlib.md5(f"{'' if doc is None else doc}|{text or ''}".encode()).hexdigest()
        by.setdefault(source, []).append((digest, doc, len(WORD.findall(text or ""))))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(x[2] for x in by[s]) for s in names}
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    while True:
        free = [s for s in names if target[s] < size[s] * most]
        held = sum(target[s] for s in names if s not in free)
        rate = (sum(size.values()) * share - held) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * rate > size[s] * most]
        for s in over or free:
            target[s] = float(size[s] * most) if over else weight[s] * rate
        if not over:
            break
    out = []
    for s in names:
        goal, start = int(target[s] + 0.5), 0
        for _, doc, n in sorted(by[s], key=lambda x: x[0]):
            out.append((doc, n, size[s], target[s], sum(min(n, max(0, goal - start - e * size[s])) for e in range(most))))
            start += n
    return sorted(out, key=str)


def test_mix_is_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_ROWS", 8)  # parts of a few rows, and a repeated row beyond them
    every = [(r[0], r[1], r[3]) for r in rows] + [(7, "the same row again", "s2")] * 60 + [(None, None, None)] * 50 + [(k, prose(random.Random(k), k), "é" if k % 2 else "Z") for k in range(30)]
    df = spark.createDataFrame([(*r, 1, 2, 3.0) for r in every], "doc_id long, text string, source string, number int, schedule int, target double").repartition(5)
    out = mixing.mix_documents(df)
    got = out.collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got), key=str) == brute_mix(every)
    at = [r["position"] for r in got if r["position"] is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert all(sum(t["words"] for t in r["takes"]) == r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix_documents(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken: Counter = Counter()
    for r in mixing.stream(out).collect():
        taken[r["source"]] += r["words"]
    for r in got:
        assert abs(taken[r["source"]] - r["target"]) <= 0.5


def test_mix_keeps_columns_and_follows_schedules(spark):
    rows = [(k, "ab"[k % 2], 10, f"{k * 7919 % 65536:04x}" * 8, "x", 5) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size int, digest string, number string, taken int")
    knots = lambda *w: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(x)).alias("weight")) for t, x in w])
    early, late = knots((0.0, 1), (0.5, 1), (0.5, 0), (1.0, 0)), knots((0.0, 0), (1.0, 2))
    out = mixing.mix(df, "source", "size", "digest", lambda number: F.when(number == 0, early).otherwise(late), share=0.8)
    got = out.collect()
    assert out.columns == ["doc_id", "source", "size", "digest", "number", "source_size", "target", "takes", "position", "taken"]
    assert {r["number"] for r in got} == {"x"} and {r["size"] for r in got} == {10}
    a = sorted((r["digest"], r["position"]) for r in got if r["source"] == "a" and r["taken"])
    b = sorted((r["digest"], r["position"]) for r in got if r["source"] == "b" and r["taken"])
    assert max(p for _, p in a) <= 0.5 and [p for _, p in a] == sorted(p for _, p in a)  # the early source ends at the middle
    target = 4000 * 0.8 / 1.5  # integrals of 1 to a half; a weight 2t has the integral t^2
    assert np.allclose([p for _, p in b], [(10 * k / target) ** 0.5 for k in range(len(b))], atol=1e-12)


def test_mix_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_documents(spark.createDataFrame([], schema)).collect() == []
    got = mixing.mix_documents(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in got) == [(1, 0.0, 0), (2, 0.0, 0)]
    got = mixing.mix_documents(spark.createDataFrame([(1, "a b c", None)], schema)).collect()
    assert [(r["target"], r["taken"], [t["words"] for t in r["takes"]]) for r in got] == [(4.5, 5, [3, 2])]


def test_toxicity_grades_of_the_given_labels(spark):
    """Labels of toxic and quality have three grades: clean, toxic, toxic and poor."""
    from tests.conftest import DATA

    sf = DATA / "sf0.01"
    if not sf.exists():
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(str(sf / f"{t}.parquet")) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert len(model.cuts) == 2 and model.cuts[0] < model.cuts[1]
    out = toxicity.score(docs, model).select("doc_id", "severity", F.col("toxic").alias("found")).join(labels, "doc_id").toPandas()
    by = out.groupby(["toxic", "quality"]).severity.mean()
    assert by[0, 1] < 0.2 and 0.7 < by[1, 1] < 1.2 < by[1, 0]
    assert (out.found == (out.toxic == 1)).mean() > 0.98
    assert len(toxicity.fit(docs, labels.drop("quality")).cuts) == 1
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0), (1, None), (3, 1), (3, 0), (None, 0)], "toxic int, quality int")
    assert [r[0] for r in rows.select(toxicity.graded(rows)).collect()] == [0, 0, 1, 2, 1, 5, 6, None]


def test_pipeline_packs_the_plain_ids(spark, sf, docs):
    """Pieces that the pipeline packs hold the plain tokenizer's ids, and ids of documents are exact."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [((1 << 60) + 1, "a first text of its own"), (None, "another one without an id"), ((1 << 60) + 3, "third text, other words at all")]
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(sf)).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows}
    crc = lambda text: zlib.crc32(np.array([*plain.encode(text, add_special_tokens=False).ids, 0], dtype="<u4").tobytes())
    assert {r["doc_id"]: r["ids_crc32"] for r in packed} == {i: crc(t) for i, t in rows}
    whole = corpus_pipeline.run(spark, sf).where("piece = 0 AND length < 2048 AND doc_id IS NOT NULL").collect()
    texts: dict = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], set()).add(crc(r["text"] or ""))
    assert whole and all(r["ids_crc32"] in texts[r["doc_id"]] for r in whole)


def test_whitening_query_on_the_given_table(spark):
    from tests.conftest import DATA

    sf = DATA / "sf0.001"
    if not sf.exists():
        pytest.skip("no test tables")
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(str(sf / "embeddings.parquet")).collect()]
    kept = [(i, v) for i, v in given if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, deviations, white, values = brute_whitening([v for _, v in kept], max(len(v) for _, v in kept))
    got = whitening.query(spark, str(sf)).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and {r["identity_error"] for r in got} == {got[0]["identity_error"]}
    assert got[0]["identity_error"] < 1e-9
    at = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(1, 9):
        a = np.array([at[i, c]["whitened"] for i, _ in kept])
        assert min(np.abs(a - white[:, c - 1]).max(), np.abs(a + white[:, c - 1]).max()) < 1e-6
        assert [at[i, c]["deviation"] for i, _ in kept] == deviations
        assert np.isclose(at[kept[0][0], c]["explained"], values[c - 1] / values.sum(), rtol=1e-9)


def test_topk_broadcasts_no_vectors(spark):
    """Copies compress to nearly nothing, so what tells sizes as written would send them through the driver."""
    rows = [(n, [float(n % 7), 1.0, float(n % 3)]) for n in range(400)]
    index = topk.Index(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v", F.col("vec_id") % 50 == 0)
    opened = index._opened(index.asked, 5, False)
    assert opened.count() > 0
    assert "Broadcast" not in opened._jdf.queryExecution().executedPlan().toString()
