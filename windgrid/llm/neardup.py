"""Near-duplicates by MinHash with tensored banding, confirmed on full sets.

A document's set holds its distinct shingles of five words. Two collections of
SIDE bands, each of BAND minhashes, give a document SIDE * SIDE table keys, one
for every pair of a left and a right band: 144 tables from 96 minhashes. A pair
at the threshold 0.85 meets in some table with probability 0.9997, and one more
closely alike still more surely. Threshold and BAND are parameters: at 0.80 a pair
meets with 0.996 by bands of 4 and with 0.9996 by bands of 3.

Equal sets are one representative. Bands that only one representative has are
dropped first (they can't meet). Each partition links the representatives of a
key to its first one and passes on one row a key, so a key that a third of all
rows share costs a row a partition. Linked representatives form candidate
clusters; within a cluster all pairs are compared on their full sets, in blocks
of at most BLOCK sets and about LOAD shingles, as a product of 0/1 matrices. A
block returns a spanning forest of its links, never all pairs. Components of
those links are the result.

A cluster of several blocks is first compared within its blocks, each of which
also gets the HUBS sets of the cluster whose bands are the most frequent ones. What
that connects is a tree, and sets of one tree need no further comparison: blocks
are then cut by tree, those of one tree never meet each other, and others only
if the sizes of their sets allow a link. So a cluster that is mostly one group
costs its size times what isn't connected to it; only a cluster whose sets are not
alike at all costs the square, in blocks over all executors.

Nulls: a null text has no set; a null doc_id is left out of the comparison and
is returned as its own component. An empty text or one without words links with
nothing. Repeated doc_ids: every row is returned with its own n_shingles; the rows
of a doc_id are one document, linked with whatever any of its texts is linked
with, in one component. Ties: the smallest doc_id names the component. Long texts
are read whole. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, mix64, pieces_of, release, ship
from .graph import components
from .words import shingle_sets

SIDE, BAND, BLOCK, NUM, DEN = 12, 4, 1024, 85, 100
#: Shingles of a block's sets, about; sets of a cluster that meet all of its blocks.
LOAD, HUBS = 2_000_000, 16
#: Rows of a partition that are linked at a time.
LOCAL = 20_000


def _chunks(batch: pa.RecordBatch, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `size` bytes of text (column 1)."""
    size_of = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(size_of) // size, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
        release()


def bands(sets: list[np.ndarray], each: int = BAND) -> np.ndarray:
    """For each non-empty set 2 * SIDE hashes of bands of `each` minhashes, the left collection first."""
    rng = np.random.default_rng(7)
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), 2 * SIDE), dtype=np.uint64)
    for band in range(2 * SIDE):
        for _ in range(each):
            a, b = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            least = np.minimum.reduceat((flat ^ b) * (a | np.uint64(1)), at)
            out[:, band] = mix64(out[:, band] * np.uint64(31) + least)
    return out


def sketches(docs: DataFrame, each: int = BAND) -> DataFrame:
    """doc_id, n_shingles, digest (of the set, binary), bands (array of 2 * SIDE longs; null for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                sets = shingle_sets(part.column(1))
                full = [s for s in sets if len(s)]
                found = iter(bands(full, each).view(np.int64)) if full else iter(())
                rows = [
                    part.column(0).to_pylist(),
                    [len(s) for s in sets],
                    [_digest(s) for s in sets],
                    [next(found) if len(s) else None for s in sets],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _first_of_keys(keys: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and each one's least rep."""
    order = np.lexsort((reps, keys))
    keys, reps = keys[order], reps[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], reps[first]


def _links_of(reps: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table keys of these reps, the least rep of each, and pairs of a rep and the least one of a key it has. A band of 0 is none."""
    all_keys, all_reps, links = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros((0, 2), np.int64)
    for a in range(SIDE):
        for b in range(SIDE):
            there = np.flatnonzero((left[:, a] != 0) & (right[:, b] != 0))
            if not len(there):
                continue
            keys = mix64(mix64(left[there, a] + np.uint64(a + 1)) ^ (right[there, b] * np.uint64(2 * b + 3)))
            own = reps[there]
            first_keys, first_reps = _first_of_keys(keys, own)
            to = first_reps[np.searchsorted(first_keys, keys)]
            links = np.unique(np.concatenate([links, np.column_stack([own, to])[own != to]]), axis=0)
            all_keys.append(first_keys)
            all_reps.append(first_reps)
    return np.concatenate(all_keys), np.concatenate(all_reps), links


def _local_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every LOCAL rows: rows (key, rep), the first rep of every table key; rows (null, rep, to), a rep and the first one of a key they share."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        reps = t["rep"].to_numpy()
        sides = []
        for name in ("left", "right"):  # (band, hash) pairs, flattened
            lists = t[name].combine_chunks()
            flat, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()) // 2
            side = np.zeros((len(reps), SIDE), np.uint64)
            side[np.repeat(np.arange(len(reps)), n), flat[0::2]] = flat[1::2].view(np.uint64)
            sides.append(side)
        keys, firsts, links = _links_of(reps, *sides)
        no_keys, no_to = pa.nulls(len(links), pa.int64()), pa.nulls(len(keys), pa.int64())
        columns = [[pa.array(keys.view(np.int64)), no_keys], [pa.array(firsts), pa.array(links[:, 0])], [no_to, pa.array(links[:, 1])]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["key", "rep", "to"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= LOCAL:
            yield flush(held)
            held = []
    if sum(b.num_rows for b in held):
        yield flush(held)


def table_bands(reps: DataFrame) -> DataFrame:
    """rep, band, hash."""
    band = reps.select("rep", F.posexplode("bands").alias("band", "hash"))
    return durable(band.withColumn("hash", F.when(F.col("hash") == 0, F.lit(1)).otherwise(F.col("hash"))))


def candidate_edges(band: DataFrame) -> DataFrame:
    """Edges a, b between representatives that meet in a table, enough to connect all that meet. band: of table_bands."""
    shared = band.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    met = band.join(shared, ["band", "hash"]).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("band", "hash"))).alias("b"))
    flat = lambda own, less: F.flatten(F.transform(F.filter("b", own), lambda s: F.array(s["band"].cast("long") - less, s["hash"])))
    met = met.select("rep", flat(lambda s: s["band"] < SIDE, 0).alias("left"), flat(lambda s: s["band"] >= SIDE, SIDE).alias("right"))
    met = met.where((F.size("left") > 0) & (F.size("right") > 0))
    local = durable(met.mapInArrow(_local_links, "key long, rep long, to long"))
    keys = local.where("key IS NOT NULL").select("key", "rep").distinct()
    first = keys.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    across = keys.join(first, "key").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    return local.where("key IS NULL").select(F.col("rep").alias("a"), F.col("to").alias("b")).unionByName(across).distinct()


def forest(sets: list[np.ndarray], rows: range, columns: range, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of rows and of columns: den * |a & b| >= num * |a | b|."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[code] > 1
    new = np.cumsum(count > 1) - 1
    code, owner = new[code[keep]], owner[keep]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    r0, r1, c0, c1 = rows.start, rows.stop, columns.start, columns.stop
    common = np.zeros((r1 - r0, c1 - c0), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    width = 1 << 13
    for low in range(0, int(new[-1]) + 1 if len(new) else 0, width):  # so many distinct shingles at a time
        a, b = np.searchsorted(code, [low, low + width])
        m = np.zeros((len(sets), min(width, int(new[-1]) + 1 - low)), dtype=np.float32)
        m[owner[a:b], code[a:b] - low] = 1
        common += m[r0:r1] @ m[c0:c1].T
    common = common.astype(np.int64)
    union = size[r0:r1, None] + size[None, c0:c1] - common
    linked = (den * common >= num * union) & (common > 0)
    part, out = np.arange(len(sets)), []  # part: which tree of the forest a set is in
    for i in range(r0, r1):
        near = np.flatnonzero(linked[i - r0]) + c0
        other = near[part[near] != part[i]]
        if len(other):
            joined, first = np.unique(part[other], return_index=True)
            out += [(i, j) for j in other[first].tolist()]
            part[np.isin(part, joined)] = part[i]
    return out


def _compare(num: int, den: int):
    """The links within each cluster of a group, or between the two blocks of a large cluster."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        for _, c in x.sort_values(["cluster", "side", "rep"], kind="stable").groupby("cluster", sort=False):
            sets = [np.frombuffer(s, dtype=np.uint64) for s in c["shingles"]]
            reps, left = c["rep"].to_numpy(), int((c["side"] == 0).sum())
            two = left < len(c)
            pairs = forest(sets, range(left), range(left, len(c)) if two else range(left), num, den)
            if pairs:
                out.append(reps[np.array(pairs)])
        both = np.concatenate(out)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the rows whose text has the representative's digest; once each."""
    seen: set[int] = set()
    for batch in batches:
        for part in _chunks(batch):
            rows = []
            for rep, cluster, digest, own in zip(part["rep"].to_pylist(), part["cluster"].to_pylist(), part["digest"].to_pylist(), shingle_sets(part["text"]), strict=True):
                if rep not in seen and _digest(own) == digest:
                    seen.add(rep)
                    rows.append((rep, cluster, len(own), own.tobytes()))
            schema = pa.schema([("rep", pa.int64()), ("cluster", pa.int64()), ("size", pa.int64()), ("shingles", pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _pieces(n, load):
    """Into how many blocks n sets with `load` shingles are cut."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(n / (BLOCK * 0.9)), F.ceil(load / LOAD))


LINKS = "a long, b long"


def _links_within(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links of clusters of one block each. sets: rep, cluster, size, shingles."""
    total = sets.agg(F.count("*").alias("n"), F.sum("size").alias("load")).first()
    tasks = max(pieces_of(total["n"], 256), pieces_of(total["load"], LOAD // 2))
    rows = sets.select(F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("task"), "cluster", F.lit(0).alias("side"), "rep", "shingles")
    return rows.groupBy("task").applyInPandas(_compare(num, den), LINKS)


def _links_across(sets: DataFrame, band: DataFrame, num: int, den: int) -> DataFrame:
    """Links of clusters of many blocks, enough to connect what is linked. sets: rep, cluster, size, shingles, pieces."""
    # blocks at random, each with the cluster's hubs
    blocked = sets.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("pieces")))
    own = band.join(sets.select("rep", "cluster"), "rep")
    weight = own.join(own.groupBy("cluster", "band", "hash").agg(F.count("*").alias("n")), ["cluster", "band", "hash"]).groupBy("cluster", "rep").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "rep"))
    hubs = weight.withColumn("place", place).where(F.col("place") <= HUBS).select("rep")
    visits = blocked.join(hubs, "rep").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).where("to <> block")
    rows = blocked.unionByName(visits.drop("block").withColumnRenamed("to", "block"))
    rows = rows.select("cluster", "block", F.lit(0).alias("side"), "rep", "shingles")
    near = durable(rows.groupBy("cluster", "block").applyInPandas(_compare(num, den), LINKS))
    # what they connect are trees; blocks of a large tree don't meet each other
    tree = durable(components(near)).select(F.col("node").alias("rep"), F.col("component").alias("tree"))
    step = float(np.log(den / num) * 1.0001)  # sizes of linked sets differ by one step at most
    known = sets.select("rep", "cluster", "size").join(tree, "rep", "left").withColumns({"tree": F.coalesce("tree", "rep"), "step": F.floor(F.log(F.col("size").cast("double")) / step)})
    large = known.groupBy("tree").agg(F.count("*").alias("n"), F.sum("size").alias("load")).where(_pieces(F.col("n"), F.col("load")) > 1).select("tree", F.lit(True).alias("large"))
    known = known.join(large, "tree", "left").withColumn("part", F.when(F.col("large"), F.col("tree")).otherwise(F.lit(-1).cast("long")))
    by = ["cluster", "part", "step"]
    groups = known.groupBy(*by).agg(_pieces(F.count("*"), F.sum("size")).alias("pieces"))
    known = durable(known.join(groups, by).select("rep", F.concat_ws(":", *by, F.pmod(F.xxhash64("rep"), F.col("pieces"))).alias("block")))
    blocks = groups.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("k")).select(*by, F.concat_ws(":", *by, "k").alias("block"))
    a, b = blocks.alias("a"), blocks.alias("b")
    apart = (F.col("a.part") != F.col("b.part")) | (F.col("a.part") == -1)
    meet = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.abs(F.col("a.step") - F.col("b.step")) <= 1) & (F.col("a.block") <= F.col("b.block")) & apart)
    meet = meet.select(F.col("a.cluster").alias("cluster"), F.col("a.block").alias("low"), F.col("b.block").alias("high"))
    sides = F.array(F.struct(F.col("low").alias("block"), F.lit(0).alias("side")), F.struct(F.col("high").alias("block"), F.lit(1).alias("side")))
    sides = F.when(F.col("low") == F.col("high"), F.slice(sides, 1, 1)).otherwise(sides)
    tasks = meet.select("cluster", F.concat_ws("|", "low", "high").alias("task"), F.inline(sides))
    rows = sets.select("rep", "shingles").join(known, "rep").join(tasks, "block").select("task", "cluster", "side", "rep", "shingles")
    return near.unionByName(rows.groupBy("task").applyInPandas(_compare(num, den), LINKS))


#: Bits of the filter that keeps texts without a candidate out of the shuffle: 4 MB, whatever the number of documents.
SLOTS = 1 << 25


def _likely(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is one of the members', and a few others (a Bloom filter of one hash); all, where members are many."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)) + 1
    bits = members.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits"))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    both = docs.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "_bucket")  # at most 1,024 rows of 4 KB
    return both.where(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0).select(*docs.columns)


def confirmed_links(docs: DataFrame, reps: DataFrame, band: DataFrame, clusters: DataFrame, num: int, den: int) -> DataFrame:
    """Links a, b between representatives of candidate clusters (node, component), enough to connect all that are linked."""
    members = reps.select("rep", "doc_id", "digest", "size").join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    members = durable(members)
    pieces = members.groupBy("cluster").agg(_pieces(F.count("*"), F.sum("size")).alias("pieces"))
    texts = _likely(docs, members).join(members.drop("size"), "doc_id").select("rep", "text", "cluster", "digest")
    sets = durable(texts.mapInArrow(_sets, "rep long, cluster long, size long, shingles binary").join(pieces, "cluster"))
    links = _links_within(sets.where("pieces = 1"), num, den)
    across = sets.where("pieces > 1")
    return links if across.isEmpty() else links.unionByName(_links_across(across, band, num, den))


def near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN, each: int = BAND) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Links are pairs with a Jaccard index of num / den at least; `each`: minhashes of a band.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = durable(sketches(docs, each))
    full, bare = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    reps = sketch.where(full).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    reps = durable(reps.withColumn("rep", F.monotonically_increasing_id()))  # written, so that a representative keeps its number
    band = table_bands(reps)
    links = confirmed_links(docs, reps, band, durable(components(candidate_edges(band))), num, den)
    # the texts of a repeated doc_id are linked by it
    several = sketch.where(full).groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    several = sketch.where(full).select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct().join(reps.select("digest", "rep"), "digest")
    shared = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("first")), "doc_id").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    found = components(links.unionByName(shared)).select(F.col("node").alias("rep"), "component")
    known = durable(reps.select("digest", "rep", "doc_id").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = known.join(least, "component").select("digest", "component_id")
    whole = sketch.where(full).join(known, "digest").select("doc_id", "n_shingles", "component_id")
    alone = sketch.where(bare).select("doc_id", "n_shingles")
    beside = whole.join(alone.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    alone = alone.join(beside, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return whole.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(least) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
