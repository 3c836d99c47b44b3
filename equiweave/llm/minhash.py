"""MinHash near-duplicate search with fast similarity sketches.

A sketch has BANDS * ROWS coordinates. In round i of the first T rounds every element of a set is
placed in one hashed bin with a value that starts with i; rounds T to 2T-1 offer every element to
bin i - T. A bin keeps its least value, so rounds stop as soon as all bins are full: large sets
take one or two rounds, small sets some more, and the last T rounds fill any bin that is left.
Estimates from such sketches have the concentration of T independent coordinates.

Steps: (1) one scan makes set size, a 128-bit set digest, the band keys and a signature, one byte of
each coordinate; (2) equal digests are one class, named by its smallest doc_id, so copies are never
paired; (3) classes that share a band key are a bucket; each is compared exactly with the smallest
class of every bucket it is in, which joins groups of copies in one pass; (4) only buckets that then
still hold classes that those links do not connect within two steps go on, each set of members once:
their signatures are compared in blocks, and members not so connected that agree in LEAST_SHARE of
the coordinates at least are near; (5) what near pairs connect is cut into blocks, and every pair of blocks compares
full shingle sets exactly, as one matrix product, giving a spanning set of confirmed links; (6)
components of the links of (3) and (5). Sharing a band key alone never puts texts into one group.

At similarity 0.75 a pair shares no band with probability (1 - 0.75**ROWS)**BANDS = 1.3e-6, and its
signatures agree in fewer than LEAST_SHARE of 250 coordinates, 4.4 deviations below 0.75, with 5e-6.

Defined cases: null text and text without words have an empty set, are linked with nothing and
stay; fewer than five words make one shingle; rows with the same doc_id count as one document; a
null doc_id links with nothing, has a null component and stays; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiweave.llm.components import components
from equiweave.llm.shared import discard, fresh, materialize, mix, rows_at_once, shingle_sets, slices, small_batches, utf8

SHINGLE_WORDS = 5
PERCENT = 75
ROWS, BANDS = 5, 50
#: Share of equal signature bytes below which a pair is not compared exactly.
LEAST_SHARE = 0.63
BLOCK, SIGNATURE_BLOCK = 128, 1024
#: Elements offered to one call, so that a sketch of a very large set stays within bounded memory.
STEP = 1 << 18
#: Columns of one dense piece of the comparison of two blocks.
DENSE = 1 << 13


def sketch(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of `size` uint64 coordinates for each non-empty set of hashes; empty sets keep the top value."""
    n = len(sets)
    full = np.full((n, size), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = full.ravel()
    counts = np.array([len(s) for s in sets], dtype=np.int64)
    open_rows = np.flatnonzero(counts)
    for i in range(2 * size):
        if not len(open_rows):
            break
        seed = np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF)
        at = np.cumsum([0, *counts[open_rows]])
        lead = np.uint64(i) << np.uint64(48)
        group = 0
        while group < len(open_rows):  # whole sets of about STEP elements
            end = max(group + 1, int(np.searchsorted(at, at[group] + STEP, "right")) - 1)
            rows = open_rows[group:end]
            hashes = mix(np.concatenate([sets[r] for r in rows]) ^ seed)
            owner = np.repeat(rows, counts[rows])
            if i < size:
                bins = ((hashes >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            else:
                bins = np.full(len(hashes), i - size)
            np.minimum.at(flat, owner * size + bins, lead | (mix(hashes) >> np.uint64(16)))
            group = end
        open_rows = open_rows[(full[open_rows] == np.iinfo(np.uint64).max).any(axis=1)]
    return full


def band_keys(sketches: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One signed 64-bit key for each band of each sketch."""
    parts = sketches.reshape(len(sketches), bands, rows)
    key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sketches), 1))
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def fingerprints(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (the set's digest), keys (empty for an empty set) and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_once(batches):
            flat, at = utf8(batch.column(1))
            for first, end, part, part_at in slices(flat, at):
                sets = shingle_sets(part, part_at, SHINGLE_WORDS)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                made = sketch(sets, rows * bands)
                keys = band_keys(made, rows, bands)[sizes > 0]
                bytes_ = np.ascontiguousarray((made & np.uint64(255)).astype(np.uint8))
                ends = np.cumsum(np.concatenate([[0], np.where(sizes > 0, bands, 0)])).astype(np.int32)
                digest = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(sizes),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())),
                        pa.array([x.tobytes() for x in bytes_], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "keys", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, signature binary")


def _joined(sets: list[np.ndarray], names: np.ndarray, left: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links between sets[:left] and sets[left:] (or within sets if left is 0) that join names not yet joined."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = uses[column] > 1  # what one set alone has is in no intersection
    row, column = row[shared], (np.cumsum(uses > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((left or len(sets), len(sets) - left), dtype=np.int64)
    for start in range(0, int((uses > 1).sum()), DENSE):
        a, b = np.searchsorted(column, [start, start + DENSE])
        dense = np.zeros((len(sets), DENSE), dtype=np.float32)
        dense[row[a:b], column[a:b] - start] = 1
        common += (dense[: left or None] @ dense[left:].T).astype(np.int64)
    union = sizes[: left or None, None] + sizes[None, left:] - common
    hits = np.argwhere(100 * common >= percent * union)
    parent = {int(x): int(x) for x in names}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in hits:
        a, b = int(names[i]), int(names[j + left])
        if (x := top(a)) != (y := top(b)):
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _confirm(table: pa.Table, percent: int) -> pa.Table:
    """Links of one pair of blocks: columns node, side (0 or 1), same (one block with itself), text."""
    order = np.argsort(table["side"].to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    names, side = table["node"].to_numpy(), table["side"].to_numpy()
    flat, at = utf8(table["text"])
    sets = [s for _, _, part, part_at in slices(flat, at) for s in shingle_sets(part, part_at, SHINGLE_WORDS)]
    same = table["same"][0].as_py()
    left = 0 if same else int((side == 0).sum())
    found = _joined(sets, names, left, percent) if same or 0 < left < len(sets) else []
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def bucket_members(classes: DataFrame, most: int) -> DataFrame:
    """key, hub (the bucket's smallest class) and node, for the buckets of classes (node, keys) with more than one class."""
    keyed = classes.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where("hub != far").select("key", "hub")
    hubs = materialize(hubs, "minhash-hubs", most)
    return materialize(keyed.join(hubs, "key").select("key", "hub", "node"), "minhash-members", 2 * most)


def _compared(texts: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links of pairs of blocks (component, i, j, node, side, same)."""
    rows = texts.join(blocks.hint("shuffle_hash"), "node").select("component", "i", "j", "node", "side", "same", "text")
    return rows.groupBy("component", "i", "j").applyInArrow(lambda table: _confirm(table, percent), "a long, b long")


def star_links(texts: DataFrame, members: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): confirmed links between classes and the hubs of their buckets."""
    ties = members.where("node != hub").select("hub", "node").distinct()
    sized = ties.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    spokes = ties.join(sized, "hub").select(F.col("hub").alias("component"), F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("i"), "node", F.lit(1).alias("side"))
    hubs = sized.select(F.col("hub").alias("component"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), F.col("hub").alias("node"), F.lit(0).alias("side"))
    blocks = hubs.unionByName(spokes).withColumn("j", F.col("i")).withColumn("same", F.lit(False))
    return _compared(texts, blocks, percent)


def roots(links: DataFrame) -> DataFrame:
    """(node, component) of links' larger ends: the smallest node within two steps down. What shares one is connected, not the other way round."""
    up = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).groupBy("node").agg(F.min("other").alias("up"))
    above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
    return up.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("component"))


def block_pairs(groups: DataFrame, block: int) -> DataFrame:
    """groups (component, node, any others) dealt into blocks, each row once for every block of its component: i <= j, side, same."""
    sized = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    rows = groups.join(sized, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return rows.withColumn("side", (F.col("own") > F.col("other")).cast("int")).withColumn("same", F.col("own") == F.col("other")).drop("n", "own", "other")


def _near(table: pa.Table, least: float) -> pa.Table:
    """(a, b): what near pairs of different components connect in one pair of blocks, each node with the first it reaches.

    table: node, root, hub, signature, side, same. A pair with the hub has been compared exactly before.
    """
    order = np.argsort(table["side"].to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    node, root, hub, side = (table[c].to_numpy() for c in ("node", "root", "hub", "side"))
    marks = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(node), -1)
    left = len(node) if table["same"][0].as_py() else int((side == 0).sum())
    right = np.arange(0 if left == len(node) else left, len(node))
    hit = np.zeros((left, len(right)), dtype=bool)
    step = max(1, (1 << 22) // max(1, marks.shape[1] * len(right)))
    for k in range(0, left, step):
        hit[k : k + step] = (marks[k : min(left, k + step), None, :] == marks[None, right, :]).sum(axis=2) >= least * marks.shape[1]
    hit &= (root[:left, None] != root[None, right]) & (hub[:left, None] != node[None, right]) & (hub[None, right] != node[:left, None])
    first = np.arange(len(node))
    while hit.any():
        own = np.minimum(first[:left], np.where(hit, first[None, right], len(node)).min(axis=1))
        other = np.minimum(first[right], np.where(hit, own[:, None], len(node)).min(axis=0))
        if (own == first[:left]).all() and (other == first[right]).all():
            break
        first[:left] = own
        first[right] = np.minimum(first[right], other)
    tied = np.flatnonzero(first != np.arange(len(node)))
    return pa.table({"a": pa.array(node[tied]), "b": pa.array(node[first[tied]])})


def near_pairs(members: DataFrame, found: DataFrame, signatures: DataFrame, least: float = LEAST_SHARE, block: int = SIGNATURE_BLOCK) -> DataFrame:
    """(a, b): classes that near pairs connect, in buckets that may hold links between components (node, component) not found yet."""
    rooted = members.join(found.select("node", F.col("component").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
    once = open_.where("low != high and n > 2").groupBy("n", "who").agg(F.min("key").alias("key")).select("key")
    rows = rooted.join(once, "key").join(signatures, "node").select(F.col("key").alias("component"), "node", "root", "hub", "signature")
    return block_pairs(rows, block).groupBy("component", "i", "j").applyInArrow(lambda table: _near(table, least), "a long, b long")


def confirmed_links(texts: DataFrame, groups: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): for each group (component, node), links that join all its documents of that similarity."""
    return _compared(texts, block_pairs(groups, block), percent)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept of each row of docs."""
    small_batches(docs.sparkSession)
    made = materialize(fingerprints(docs), "minhash-fingerprints")
    most = made.count()
    rows = made.select("doc_id", "n_shingles", "d1", "d2")
    named = made.where("n_shingles > 0 and doc_id is not null")
    sets = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    sets = materialize(sets, "minhash-classes", most)
    # Rows of one doc_id with other sets are the same document, so their classes are linked.
    shared = named.groupBy("doc_id").agg(F.countDistinct("d1", "d2").alias("n")).where("n > 1").select("doc_id")
    heads = named.join(sets.select(F.col("node").alias("doc_id"), F.col("d1").alias("c1"), F.col("d2").alias("c2")), "doc_id")
    heads = heads.where("d1 = c1 and d2 = c2").dropDuplicates(["doc_id", "d1", "d2"]).select(F.col("doc_id").alias("node"), "keys", "signature")
    members = bucket_members(heads, BANDS * most // 2)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    texts = materialize(texts.join(members.select("node").distinct().hint("shuffle_hash"), "node", "left_semi"), "minhash-texts")
    stars = materialize(star_links(texts, members), "minhash-stars", BANDS * most)
    near = near_pairs(members, roots(stars), heads.select("node", "signature"))
    groups = materialize(components(near, "minhash-near"), "minhash-groups", most)
    same = named.join(shared, "doc_id").join(sets, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    joined = components(stars.unionByName(confirmed_links(texts, groups)).unionByName(same), "minhash-links")
    known = sets.join(joined, "node", "left").where("copies > 1 or component is not null")
    known = materialize(known.select("d1", "d2", F.coalesce("component", "node").alias("found")), "minhash-known", most)
    discard(members, texts, stars, groups)
    out = rows.join(known, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document stays, all columns as they came.

    Rows that repeat a doc_id that stays all stay. A row with a null doc_id stays.
    """
    (name,) = fresh(docs, "gone")
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")
