"""N-gram Jaccard self-join by parity sketches.

A document's set is its distinct word shingles. For a size band the hashes of a set are dealt into m parts and
each part keeps the XOR of its hashes: one cell of a parity sketch. An element that two sets do not share
changes at most one cell, so the number of unequal cells is a lower bound of the symmetric difference. The
similarity bounds that difference by D, hence two similar sets of a band agree in at least m - D cells
(pigeonhole), and an equal cell is a join key. Small sets, whose cells would be small too, have half as many: then some
cell differs by one element at most, and the keys are the cell's XOR and those of the cell less one element.

m leaves room for cells that say little: empty ones, and frequent ones, whose key many sets share (one common
passage may fill a small cell). Two sets that agree in more cells than both have room for agree in one that
is rare. A set with more empty or more frequent cells than room uses those as keys too, but only against sets that
also do. m has WITNESSES - 1 cells more, so a similar pair shares as many rare keys, and pairs that share fewer
are strangers with a line in common. A set with fewer empty or frequent cells than room shares as many rare keys more with each
similar one, so pairs that share fewer than either set's cells leave are dropped as well. So no pair is lost.

Sets that share enough keys meet in a cluster. Within a cluster a finer sketch of parity bits rules out pairs
whose Hamming distance exceeds D, and the others are verified on the sets themselves. Clusters beyond
BLOCK sets, or BLOCK_SHINGLES shingles, are dealt into blocks, and pairs of blocks are compared apart; but where few sets of such a cluster share
keys (SPARSE pairs a set at most, as in a long chain), only the pairs that do are verified, so that work grows with the pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, U64, grams, in_chunks, mix, word_hashes
from .common import carried, documents, drop_stash, restored, stash
from .components import components

#: Documents of one cluster that one task compares.
BLOCK = 8192
#: And their shingles together, on average.
BLOCK_SHINGLES = 4 << 20
SKETCH_BITS = 4096
KEYS_PER_BUCKET = 1 << 20
#: A key that more sets than this share is frequent.
FREQUENT = 16
#: Rare keys that a pair shares at least.
WITNESSES = 3
#: Sets up to this size have keys for cells less one element.
SMALL = 96
#: Pairs a set in a large cluster whose pairs are verified one by one.
SPARSE = 8
#: Share of the sets of a band that may have more empty cells than there is room for.
CROWDED = 1e-4


def shingles(texts: list[str], k: int) -> list[np.ndarray]:
    """The set of each text: sorted distinct 64-bit hashes of its k-word shingles; fewer words are one shingle, none are none."""
    words, at = word_hashes([t.encode().lower() for t in texts])
    all_grams = grams(words, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(all_grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(grams(words[a:b], b - a) + U64(b - a)))
        else:
            out.append(words[:0])
    return out


def max_difference(total: int, t: int) -> int:
    """Largest symmetric difference of two sets of ``total`` elements together whose similarity is at least t %. Negative: none."""
    return total - 2 * -(-t * total // (100 + t))


@functools.cache
def bands(t: int) -> list[int]:
    """Smallest size of each band: partners lie in the same band or the next."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // t + 1)
    return out


def band_of(size: int, t: int) -> int:
    import bisect

    return bisect.bisect_right(bands(t), size) - 1


def poisson_above(mean: float, q: int) -> float:
    """Probability that a Poisson count exceeds q."""
    term = total = math.exp(-mean)
    for i in range(1, q + 1):
        term *= mean / i
        total += term
    return max(0.0, 1.0 - total)


@functools.cache
def parts_of(band: int, t: int) -> tuple[int, int, int, bool]:
    """(m, room for empty cells, room for frequent ones, whether keys allow one difference in a cell) of the join of a band with itself and the next."""
    lo, hi = bands(t)[band], bands(t)[band + 1] - 1
    top = hi + hi * 100 // t
    d = max(max_difference(s, t) for s in range(max(2, top - 3), top + 1))
    if d <= 0:  # only equal sets are similar, and they are one class
        return 0, 0, 0, False
    small = hi <= SMALL
    spoilt = d // 2 if small else d  # cells that differences can spoil
    best = None
    for room in range(max(1, lo // 3) + 1):
        often = 1 + (spoilt + WITNESSES + room) // 20
        m = spoilt + WITNESSES + room + often
        p = poisson_above(m * math.exp(-lo / m) * (1 + lo / m if small else 1), room)
        if best is None or p < best[0]:
            best = (p, (m, room, often, small))
        if p < CROWDED or p > 2 * best[0]:
            break
    return best[1]


def spare_of(size: int, band: int, little: int, t: int) -> int:
    """How many cells of a set with ``little`` ones that say little may be frequent, in the join of ``band``, so that it shares WITNESSES rare keys with each
    similar set all the same. For each fewer it shares one more."""
    m, room, _, less_one = parts_of(band, t)
    top = size + (size * 100 // t if band_of(size, t) == band else bands(t)[band + 1] - 1)
    d = max(max_difference(s, t) for s in range(max(2, top - 3), top + 1))
    return m - (d // 2 if less_one else d) - min(little, room) - WITNESSES


def keys_of(own: np.ndarray, t: int) -> list[np.ndarray]:
    """The join keys of a set, for the join of its band and for that of the band before (none before the first)."""
    return [found for found, _ in keys_and_spare(own, t)]


def keys_and_spare(own: np.ndarray, t: int) -> list[tuple[np.ndarray, int]]:
    """The join keys of a set, and how many of them may be frequent (see ``spare_of``), for both joins."""
    band, out = band_of(len(own), t), []
    for b in (band, band - 1) if band else (band,):
        m, room, _, less_one = parts_of(b, t)
        if not m:
            out.append((own[:0], 0))
            continue
        salt = U64(b + 1) << U64(40)
        one = mix(own + U64(b + 1))
        cell = (one >> U64(32)) % U64(m)
        order = np.argsort(cell, kind="stable")
        sorted_cells, one = cell[order], mix(one[order])
        starts = np.flatnonzero(np.r_[True, sorted_cells[1:] != sorted_cells[:-1]])
        parity = np.bitwise_xor.reduceat(one, starts)
        where = mix(sorted_cells[starts] + salt)
        sizes = np.diff(np.r_[starts, len(one)])
        found = [mix(parity ^ where)]
        if less_one:
            more = np.repeat(sizes > 1, sizes)
            found.append(mix((np.repeat(parity, sizes) ^ one ^ np.repeat(where, sizes))[more]))
        # cells that are empty, or are but for one element, agree without saying much: keys only where there are too many
        little = np.setdiff1d(np.arange(m, dtype=U64), sorted_cells[starts][sizes > 1] if less_one else sorted_cells[starts])
        if len(little) > room:
            found.append(mix(mix(little + salt)))
        out.append((np.unique(np.concatenate(found)), spare_of(len(own), b, len(little), t)))
    return out


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node but the roots of the graph of links x-y: the node and the smallest node of its component."""
    nodes, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = flat[: len(x)], flat[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, label[a], low)
        np.minimum.at(nxt, label[b], low)
        nxt = nxt[nxt]
        while not np.array_equal(nxt, nxt[nxt]):
            nxt = nxt[nxt]
        if np.array_equal(nxt, label):
            break
        label = nxt
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def linked(sets: list[np.ndarray], t: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among the sets that join their components: every pair that is similar is connected through them.

    With ``side`` only pairs from different sides are compared.
    """
    n = len(sets)
    order = sorted(range(n), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], dtype=np.int64)
    sketch = np.zeros((n, SKETCH_BITS // 64), dtype=U64)
    for row, i in enumerate(order):
        bits = np.bincount((sets[i] >> U64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
        sketch[row] = np.packbits(bits.astype(np.uint8)).view(U64)
    where = None if side is None else np.asarray(side)[order]
    root, out = np.arange(n), []
    for i in range(n):
        end = int(np.searchsorted(size, size[i] * 100 // t, side="right"))
        near = np.arange(i + 1, end)
        near = near[root[near] != root[i]]
        if where is not None:
            near = near[where[near] != where[i]]
        if not len(near):
            continue
        total = size[i] + size[near]
        most = total - 2 * -(-t * total // (100 + t))
        apart = np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        for j in near[apart <= most].tolist():
            if root[j] == root[i]:
                continue
            both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
            if 100 * both >= t * (int(size[i]) + int(size[j]) - both):
                out.append((order[i], order[j]))
                old, new = root[j], root[i]
                root[root == old] = new
    return out


def prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit print of each set in two halves; the first names its class in links."""
    one = np.array([mix(s + U64(7)).sum(dtype=U64) for s in sets], dtype=U64)
    two = np.array([mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) for s in sets], dtype=U64)
    sizes = np.array([len(s) for s in sets], dtype=U64)
    return mix(one + sizes).view(np.int64), two.view(np.int64)


def measured(chunks: DataFrame, k: int) -> DataFrame:
    """doc_id, tag, chunk, n_shingles and the print of the set, for each document. No shuffle."""
    id_type = chunks.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets = shingles(b.column("text").to_pylist(), k)
                one, two = prints(sets)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), b.column("chunk"), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["doc_id", "tag", "chunk", "n_shingles", "node", "print"])

    return chunks.select("doc_id", "tag", "chunk", "text").mapInArrow(run, f"doc_id {id_type}, tag long, chunk int, n_shingles long, node long, print long")


def candidate_links(chunks: DataFrame, k: int, t: int, n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, forest), and the written table that it reads: pairs of classes (nodes) that share enough rare keys, and (forest) links that connect those that share a frequent one and have too many.

    Keys leave a task in bundles, one per bucket; of the texts of a bundle with equal sets one counts, so a
    set that a third of all rows share is one entry per bundle.
    """

    def bundle(texts: list[str]) -> pa.RecordBatch:
        sets = shingles(texts, k)
        node = prints(sets)[0]
        _, first = np.unique(node, return_index=True)
        key_parts, who_parts, names, joins, rooms = [], [], [], [], []
        for i in first.tolist():
            for join, (found, spare) in enumerate(keys_and_spare(sets[i], t) if len(sets[i]) else ()):
                if not len(found):
                    continue
                key_parts.append(found)
                who_parts.append(np.full(len(found), len(names)))
                names.append(node[i])
                joins.append(join)
                rooms.append(spare)
        out: list[list] = [[] for _ in range(6)]
        if names:
            key, who = np.concatenate(key_parts), np.concatenate(who_parts)
            name, join, room = np.array(names, dtype=np.int64), np.array(joins, dtype=np.uint8), np.array(rooms, dtype=np.int32)
            bucket = (key >> U64(33)) * U64(n_buckets) >> U64(31)
            order = np.argsort(bucket, kind="stable")
            bucket, key, who = bucket[order], key[order], who[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
            for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
                own, idx = np.unique(who[a:b], return_inverse=True)
                for col, x in zip(out, (int(bucket[a]), key[a:b].tobytes(), idx.astype(np.uint16).tobytes(), name[own].tobytes(), join[own].tobytes(), room[own].tobytes()), strict=True):
                    col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "keys", "idx", "nodes", "joins", "rooms"])

    def keys(batches):
        texts, size = [], 0
        for b in batches:
            for x in b.column(0):
                texts.append(x.as_py())
                size += len(texts[-1]) + 8
                if size >= CHUNK_BYTES or len(texts) >= 30_000:
                    yield bundle(texts)
                    texts, size = [], 0
        if texts:
            yield bundle(texts)

    def runs(tbl: pa.Table) -> pa.Table:
        idx = [np.frombuffer(x.as_py(), dtype=np.uint16) for x in tbl.column("idx")]
        of = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), dtype=kind)[i] for x, i in zip(tbl.column(c), idx, strict=True)])
        key = np.concatenate([np.frombuffer(x.as_py(), dtype=U64) for x in tbl.column("keys")])
        who, join, room = of("nodes", np.int64), of("joins", np.uint8), of("rooms", np.int32)
        order = np.lexsort((who, key))
        key, who, join, room = key[order], who[order], join[order], room[order]
        # a set that several bundles saw counts once
        new = np.r_[True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])] if len(key) else np.zeros(0, dtype=bool)
        key, who, join, room = key[new], who[new], join[new], room[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]
        n = np.diff(np.r_[starts, len(key)])
        often = np.repeat(n > FREQUENT, n)
        rare = np.flatnonzero(~often)
        rare_key, second = key[rare], join[rare] == 1
        x_parts, y_parts = [rare[:0]], [rare[:0]]
        for apart in range(1, FREQUENT):
            same = np.flatnonzero((rare_key[apart:] == rare_key[:-apart]) & ~(second[apart:] & second[:-apart]))  # two sets of one band meet in its own join
            x_parts.append(rare[same])
            y_parts.append(rare[same + apart])
        x, y = np.concatenate(x_parts), np.concatenate(y_parts)
        by = np.lexsort((who[y], who[x]))
        x, y = x[by], y[by]
        a, b = who[x], who[y]
        at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        count, none = np.diff(np.r_[at, len(a)]), np.zeros(int(often.sum()), dtype=np.int32)
        return pa.table({
            "a": pa.array(np.concatenate([a[at], who[often]]), pa.int64()), "b": pa.array(np.concatenate([b[at], key[often].view(np.int64)]), pa.int64()),
            "join": pa.array(np.concatenate([np.full(len(at), -1), join[often].astype(np.int64)]), pa.int32()), "room": pa.array(np.concatenate([count, room[often].astype(np.int64)]), pa.int32()),
            "spare_a": pa.array(np.concatenate([room[x[at]], none]), pa.int32()), "spare_b": pa.array(np.concatenate([room[y[at]], none]), pa.int32()),
        })

    def shared(tbl: pa.Table) -> pa.Table:
        who, key = np.asarray(tbl.column("a")), np.asarray(tbl.column("b"))
        own = np.isin(key, key[np.asarray(tbl.column("join")) == 0])  # two sets of one band meet in its own join
        who, key = who[own], key[own]
        order = np.lexsort((who, key))
        who, key = who[order], key[order]
        same = key[1:] == key[:-1]
        a, b = forest(who[1:][same], who[:-1][same]) if same.any() else (who[:0], who[:0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blobs = chunks.select("text").mapInArrow(keys, "bucket int, keys binary, idx binary, nodes binary, joins binary, rooms binary")
    found = stash(blobs.groupBy("bucket").applyInArrow(runs, "a long, b long, join int, room int, spare_a int, spare_b int"), "ngram-keys")
    frequent = found.where("join >= 0")
    often = frequent.groupBy("a", "join").agg(F.count(F.lit(1)).alias("n"), F.max("room").alias("most"))
    crowded = often.where("n > most").select("a", "join")
    again = frequent.join(crowded, ["a", "join"]).select("a", "b", "join", F.pmod(F.xxhash64("b"), F.lit(n_buckets)).alias("bucket")).groupBy("bucket").applyInArrow(shared, "a long, b long")
    pairs = found.where("join < 0").groupBy("a", "b").agg(F.sum("room").alias("n"), F.max("spare_a").alias("spare_a"), F.max("spare_b").alias("spare_b")).where(F.col("n") >= WITNESSES)
    most = often.groupBy("a").agg(F.max("n").alias("often"))
    for c in "ab":  # a set with fewer frequent keys than it could spare shares as many rare ones more with each similar set
        pairs = pairs.join(most.select(F.col("a").alias(c), F.col("often").alias(f"often_{c}")), c, "left")
        pairs = pairs.where(F.col("n") >= WITNESSES + F.col(f"spare_{c}") - F.coalesce(f"often_{c}", F.lit(0)))
    pairs = pairs.select("a", "b")
    return pairs.withColumn("forest", F.lit(False)).unionByName(again.withColumn("forest", F.lit(True))), found


def verified_links(chunks: DataFrame, members: DataFrame, k: int, t: int) -> DataFrame:
    """(a, b): links that connect all similar classes. ``members`` (chunk, tag, node, cluster, block, n_blocks) has a text of each."""

    def fetch(docs: pa.Table, mine: pa.Table) -> pa.Table:
        of = {x["tag"]: x for x in mine.to_pylist()}
        tags = docs.column("tag").to_pylist()
        rows, done = [], set()
        for i, tag in enumerate(tags):
            if tag in of and tag not in done:
                done.add(tag)
                rows.append(i)
        out: dict[str, list] = {"cluster": [], "i": [], "j": [], "node": [], "block": [], "own": []}
        for i, s in zip(rows, shingles(docs.column("text").take(pa.array(rows, pa.int64())).to_pylist(), k) if rows else [], strict=True):
            m, data = of[tags[i]], s.tobytes()
            own = m["block"]
            for other in range(m["n_blocks"]):
                for col, x in zip(out.values(), (m["cluster"], min(own, other), max(own, other), m["node"], own, data), strict=True):
                    col.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)})

    def compare(tbl: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_py(), dtype=U64) for x in tbl.column("own")]
        node = np.asarray(tbl.column("node"))
        block = np.asarray(tbl.column("block"))
        found = linked(sets, t, block if tbl.column("i")[0].as_py() != tbl.column("j")[0].as_py() else None)
        a, b = (node[[f[s] for f in found]] if found else node[:0] for s in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sets = chunks.groupBy("chunk").cogroup(members.groupBy("chunk")).applyInArrow(fetch, "cluster long, i int, j int, node long, block int, own binary")
    return sets.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def paired_links(chunks: DataFrame, members: DataFrame, pairs: DataFrame, k: int, t: int) -> DataFrame:
    """(a, b): those of ``pairs`` that are similar. ``members`` (chunk, tag, node) has a text of each class that occurs in them."""

    def fetch(docs: pa.Table, mine: pa.Table) -> pa.Table:
        of = {x["tag"]: x["node"] for x in mine.to_pylist()}
        at = {tag: i for i, tag in enumerate(docs.column("tag").to_pylist()) if tag in of}
        sets = shingles(docs.column("text").take(pa.array(list(at.values()), pa.int64())).to_pylist(), k) if at else []
        return pa.table({"node": pa.array([of[tag] for tag in at], pa.int64()), "own": pa.array([x.tobytes() for x in sets], pa.binary())})

    def verify(batches):
        for b in batches:
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                p, q = np.frombuffer(x.as_py(), dtype=U64), np.frombuffer(y.as_py(), dtype=U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= t * (len(p) + len(q) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([c[i] for i in keep], pa.int64())], ["a", "b"])

    sets = stash(chunks.groupBy("chunk").cogroup(members.groupBy("chunk")).applyInArrow(fetch, "node long, own binary"), "ngram-sets")
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    return one.join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def near_duplicates(df: DataFrame, k: int = 5, t: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row: doc_id, tag, n_shingles, component_id, root.

    Two documents link when their sets' Jaccard similarity is at least t %; a component is what links reach. Its id is
    its smallest doc_id, nulls aside (null only if all are). Words are what white space parts, A-Z lowered. Equal sets are
    one class and link whatever the texts. A document without words has no shingles and a component to itself. ``root`` names the
    component whatever the ids (null for a document without words): components may share a component_id, where ids repeat or are null. ``tag`` is a hash of
    id and text; rows that repeat both get the same result. An empty table gives an empty result. Other columns
    are not read.
    """
    docs = documents(df, id_col, text_col)
    chunks, n_chunks = in_chunks(docs)
    chunks = chunks.select("chunk", "tag", "doc_id", "text")
    rows = stash(measured(chunks, k), "ngram-rows")
    classes = rows.where("n_shingles > 0").groupBy("node", "print").agg(F.min("doc_id").alias("low"), F.min(F.struct("chunk", "tag")).alias("rep"), F.first("n_shingles").alias("n_shingles"))
    reps = stash(classes.select("node", "print", "low", "rep.chunk", "rep.tag", "n_shingles"), "ngram-classes")
    total = reps.agg(F.sum("n_shingles")).first()[0] or 0
    candidates, keys = candidate_links(chunks, k, t, max(1, min(1 << 30, total // (2 * KEYS_PER_BUCKET)) + 32))
    candidates = stash(candidates, "ngram-pairs")
    drop_stash(keys)
    clusters = stash(components(candidates.select("a", "b")), "ngram-clusters")
    placed = clusters.join(reps.select("node", "chunk", "tag", "n_shingles"), "node")
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    sizes = stash(sizes, "ngram-sizes")
    large, found = sizes.where("n_blocks > 1"), []
    if not large.isEmpty():
        rooted = candidates.join(clusters.select(F.col("node").alias("a"), "root"), "a").join(large.select("root", F.col("n").alias("sets")), "root")
        sparse = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("pairs"), F.max("forest").alias("forest"), F.first("sets").alias("sets")).where(~F.col("forest") & (F.col("pairs") <= SPARSE * F.col("sets"))).select("root")
        sparse = stash(sparse, "ngram-sparse")
        if not sparse.isEmpty():  # only then are the texts dealt once more
            found.append(paired_links(chunks, placed.join(sparse, "root").select("chunk", "tag", "node"), rooted.join(sparse, "root").select("a", "b"), k, t))
            sizes = sizes.join(sparse, "root", "left_anti")
    members = placed.join(sizes, "root").select(
        "chunk", "tag", "node", F.col("root").alias("cluster"), F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int").alias("block"), "n_blocks"
    )
    found.append(verified_links(chunks, members, k, t))
    links = stash(functools.reduce(DataFrame.unionByName, found), "ngram-links")
    drop_stash(candidates)
    drop_stash(clusters)
    roots = components(links)
    drop_stash(links)
    named = reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = named.join(lows, "root").select("node", "print", "component_id", "root")
    out = rows.join(of_class, ["node", "print"], "left").select(
        "doc_id", "tag", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root"
    )
    return out


def one_of_each(df: DataFrame, k: int = 5, t: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the row with the smallest id stays, nulls last.

    All columns as they came, whatever their names. Documents without words, null texts among them, stay; rows that repeat id and
    text stay or go together; of equal ids the smallest hash of id and text decides. Texts count whole, however long. An empty table
    gives an empty result.
    """
    near = near_duplicates(df, k, t, id_col, text_col)
    keep = (
        near.groupBy("root", F.when(F.col("n_shingles") == 0, F.col("tag")).alias("alone"))
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")).alias("first"))
        .select(F.col("first.tag").alias("tag"))
    )
    rows = carried(df, id_col, text_col)
    own = rows.withColumn("tag", tag_of(F.col("k0"), F.coalesce("k1", F.lit(""))))
    return restored(own.join(keep.distinct(), "tag", "left_semi"), df)


def tag_of(doc_id: Column, text: Column) -> Column:
    """The tag of a row, as ``in_chunks`` gives it."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("\0")), text)


#: The query with 4 words and 85 %, by pairs of documents that share a shingle: for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], chr(10)) AS shingle
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.size + ny.size - shared)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, (SELECT min(reached) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""
