"""Repeated passages by a sparse suffix array.

Of the suffixes of all texts only those are retained that begin at a minimiser: a position whose SEED-word hash is
the least of WINDOW neighbours. SEED + WINDOW - 1 words are one passage of PASSAGE words, so every passage
of that length holds a retained suffix that its own content selects, wherever it stands. Retained suffixes
are sorted (dealt by the hash of their first words, then sorted) and neighbours compared; one that meets a neighbour
from another document is a seed of a match. Matches are then extended to the left and right of the seeds: the
passages of PASSAGE words about each seed are sorted and compared in the same way, and those that meet join
up into maximal spans. So the result is exact: a word is in a span if and only if it is in a passage of PASSAGE words
that stands in two documents.

Only hashes are shuffled, each once for a chunk, so a passage that all documents share is one entry for each chunk.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import U64, grams, in_chunks, sliding, word_hashes
from .common import SPACES, documents

PASSAGE = 50
SEED = 18
CHUNKS_PER_BUCKET = 4
LEAST_BUCKETS = 32
WORD = re.compile(rf"[^{SPACES}]+")

ASK = "bucket int, chunk int, keys binary, many binary"
ANSWER = "chunk int, bucket int, flags binary"


class Chunk:
    """The words of a chunk's documents and the places where passages can begin. Documents come in the order of their tags."""

    def __init__(self, table: pa.Table, passage: int, seed: int):
        tags = np.asarray(table.column("tag"))
        self.order = np.argsort(tags, kind="stable")
        self.tags = tags[self.order]
        self.texts = table.column("text").take(pa.array(self.order)).to_pylist()
        self.words, self.at = word_hashes([t.encode() for t in self.texts])
        n = np.diff(self.at)
        # rows that repeat id and text are one document
        self.doc = np.repeat(np.unique(self.tags, return_inverse=True)[1], n)
        self.row = np.repeat(np.arange(len(n)), n)
        left = np.repeat(self.at[1:], n) - np.arange(len(self.words))
        self.starts = left >= passage
        self.passage, self.window = passage, passage - seed + 1
        g = grams(self.words, seed)
        low = sliding(g, self.window, np.minimum)
        # a seed is the least of some window within a document; 0 stands for windows that are not
        of_window = np.where(self.starts[: len(low)], low, U64(0))
        pad = np.zeros(self.window - 1, dtype=U64)
        best = sliding(np.concatenate([pad, of_window, pad]), self.window, np.maximum)[: len(g)]
        self.seeds = np.flatnonzero((g == best) & (best != 0)) if len(low) else np.zeros(0, dtype=np.int64)
        self.seed_keys = g[self.seeds]

    def passages(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the passages that hold a flagged seed within their first words."""
        near = np.zeros(len(self.words) + 1, dtype=np.int64)
        hit = self.seeds[flags]
        np.add.at(near, np.maximum(hit - self.window + 1, 0), 1)
        np.add.at(near, hit + 1, -1)
        places = np.flatnonzero((np.cumsum(near[:-1]) > 0) & self.starts)
        return places, (grams(self.words, self.passage)[places] if len(places) else self.words[:0])


def ask(keys: np.ndarray, doc: np.ndarray, chunk: int, n_buckets: int) -> pa.Table:
    """Each key of a chunk once, and whether two documents of the chunk have it."""
    out: dict[str, list] = {"bucket": [], "chunk": [], "keys": [], "many": []}
    if len(keys):
        distinct, many = distinct_keys(keys, doc)
        bucket = bucket_of(distinct, n_buckets)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
        for a, b in zip(starts, [*starts[1:], len(distinct)], strict=True):
            for col, x in zip(out.values(), (int(bucket[a]), chunk, distinct[a:b].tobytes(), np.packbits(many[a:b]).tobytes()), strict=True):
                col.append(x)
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})


def distinct_keys(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], doc[order]
    first = np.r_[True, k[1:] != k[:-1]]
    at = np.flatnonzero(first)
    return k[at], np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at)


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets are ranges of the keys, so sorted keys have sorted buckets."""
    return (keys >> U64(33)) * U64(n_buckets) >> U64(31)


def answer(t: pa.Table) -> pa.Table:
    """For each chunk, of each of its keys in this bucket: bit 0, another document has it; bit 1, this chunk is the first that has it."""
    t = t.combine_chunks()
    parts = [np.frombuffer(x.as_py(), dtype=U64) for x in t.column("keys")]
    sizes = [len(p) for p in parts]
    chunks = np.asarray(t.column("chunk"))
    key, chunk = np.concatenate(parts), np.repeat(chunks, sizes)
    many = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=n) for x, n in zip(t.column("many"), sizes, strict=True)]).astype(bool)
    order = np.lexsort((chunk, key))
    k = key[order]
    first = np.r_[True, k[1:] != k[:-1]]
    last = np.r_[first[1:], True]
    flags = np.zeros(len(key), dtype=np.uint8)
    flags[order] = (~(first & last)).astype(np.uint8) + 2 * first.astype(np.uint8)
    flags |= many.astype(np.uint8)
    ends = np.cumsum(sizes)
    return pa.table({
        "chunk": pa.array(chunks, pa.int32()), "bucket": t.column("bucket"),
        "flags": pa.array([flags[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes, strict=True)], pa.binary()),
    })


def flags_of(keys: np.ndarray, doc: np.ndarray, got: pa.Table) -> np.ndarray:
    """The answers, put to the keys that asked, in their order."""
    if not len(keys):
        return np.zeros(0, dtype=np.uint8)
    rows = sorted(zip(got.column("bucket").to_pylist(), got.column("flags").to_pylist(), strict=True))
    flat = np.frombuffer(b"".join(f for _, f in rows), dtype=np.uint8)
    distinct, _ = distinct_keys(keys, doc)
    return flat[np.searchsorted(distinct, keys)]


def runs(places: np.ndarray, row: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(row, first word, end) of the union of passages from these places, joined where they overlap or touch within a row."""
    if not len(places):
        return []
    new = np.r_[True, (places[1:] > places[:-1] + length) | (row[1:] != row[:-1])]
    a = np.flatnonzero(new)
    b = np.r_[a[1:], len(places)] - 1
    return list(zip(row[a].tolist(), places[a].tolist(), (places[b] + length).tolist(), strict=True))


def _asked(docs: DataFrame, passage: int, seed: int, n_buckets: int) -> DataFrame:
    """docs (chunk, tag, text, ...): the answers about passages, for each chunk."""

    def seeds(t: pa.Table) -> pa.Table:
        c = Chunk(t, passage, seed)
        return ask(c.seed_keys, c.doc[c.seeds], t.column("chunk")[0].as_py(), n_buckets)

    def passages(t: pa.Table, got: pa.Table) -> pa.Table:
        if not t.num_rows:
            return ask(np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), 0, n_buckets)
        c = Chunk(t, passage, seed)
        places, keys = c.passages((flags_of(c.seed_keys, c.doc[c.seeds], got) & 1).astype(bool))
        return ask(keys, c.doc[places], t.column("chunk")[0].as_py(), n_buckets)

    # the answers about seeds travel as flags with the place of their chunk only
    seed_flags = docs.groupBy("chunk").applyInArrow(seeds, ASK).groupBy("bucket").applyInArrow(answer, ANSWER)
    asked = docs.groupBy("chunk").cogroup(seed_flags.groupBy("chunk")).applyInArrow(passages, ASK)
    flags = asked.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, flags binary")
    return flags.withColumn("kind", F.lit(1)).unionByName(seed_flags.withColumn("kind", F.lit(0)))


def _found(t: pa.Table, got: pa.Table, passage: int, seed: int) -> tuple[Chunk, list[tuple[int, int, int, bool]]]:
    """(row, first word, end, whether it stands here first) of each span of a chunk, words counted over the chunk."""
    c = Chunk(t, passage, seed)
    kind = np.asarray(got.column("kind"))
    of = lambda x: got.filter(pa.array(kind == x))
    places, keys = c.passages((flags_of(c.seed_keys, c.doc[c.seeds], of(0)) & 1).astype(bool))
    flags = flags_of(keys, c.doc[places], of(1))
    shared, doc = (flags & 1).astype(bool), c.doc[places]
    # of the documents of the first chunk that has a passage, the first in the order of tags has it first
    order = np.lexsort((doc, keys))
    k, d = keys[order], doc[order]
    lead = np.zeros(len(keys), dtype=bool)
    if len(keys):
        at = np.r_[True, k[1:] != k[:-1]]
        lead[order] = d == d[np.flatnonzero(at)][np.cumsum(at) - 1]
    first = shared & lead & ((flags & 2) > 0)
    spans = [(*s, here) for here, which in ((True, first), (False, shared & ~first)) for s in runs(places[which], c.row[places[which]], passage)]
    return c, spans


SPAN = "first boolean, start_word long, end_word long, n_words long, start_char long, end_char long"


def _char_spans(c: Chunk, spans: list) -> list[tuple[int, bool, int, int, int, int]]:
    """(row, first, start word, end word, start character, end character), counted within the document."""
    by_row: dict[int, list] = {}
    for row, a, b, here in spans:
        by_row.setdefault(row, []).append((a - int(c.at[row]), b - int(c.at[row]), here))
    out = []
    for row, own in sorted(by_row.items()):
        found = [m.span() for m in WORD.finditer(c.texts[row])]
        out += [(row, here, a, b, found[a][0], found[b - 1][1]) for a, b, here in sorted(own)]
    return out


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, seed: int = SEED) -> DataFrame:
    """One row per maximal span of words that repeats across documents: doc_id and the columns of SPAN.

    ``first`` spans hold passages that stand in this document first (in the order of a hash of id and text);
    the others are the copies that a deduplication removes. Words are what ASCII white space parts, compared exactly.
    Null, empty and short texts have no spans. Rows that repeat id and text are one document and have the same
    spans. Passages that repeat only within one document are left alone. Other columns are not read. An empty table gives no rows.
    """
    docs = documents(df, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chunks, n = in_chunks(docs)
    chunks = chunks.select("chunk", "tag", "doc_id", "text")
    got = _asked(chunks, passage, seed, max(LEAST_BUCKETS, n // CHUNKS_PER_BUCKET))

    def find(t: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "first", "start_word", "end_word", "n_words", "start_char", "end_char"]
        kinds = [pa.bool_(), *[pa.int64()] * 5]
        if not t.num_rows:
            return pa.table({c: pa.array([], k) for c, k in zip(names, [t.schema.field("doc_id").type, *kinds], strict=True)})
        c, spans = _found(t, answers, passage, seed)
        rows = _char_spans(c, spans)
        cols = list(zip(*((here, a, b, b - a, x, y) for _, here, a, b, x, y in rows), strict=True)) or [[]] * 6
        ids = t.column("doc_id").take(pa.array([int(c.order[r[0]]) for r in rows], pa.int64()))
        return pa.table({"doc_id": ids, **{n: pa.array(v, k) for n, v, k in zip(names[1:], cols, kinds, strict=True)}})

    return chunks.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(find, f"doc_id {id_type}, {SPAN}")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, seed: int = SEED) -> DataFrame:
    """``df`` with every repeated passage left where it stands first and cut elsewhere; all columns in their order.

    A cut runs from a span's first character to the next word. Documents of which no word is left go; documents without
    a word before, null texts among them, stay as they are.
    """
    # columns travel as a struct under their places, so that no name can clash
    schema, cols = df.schema, df.columns
    docs = df.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols))).alias("rest"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{text_col}`").isNull().alias("none"))
    chunks, n = in_chunks(docs)
    got = _asked(chunks.select("chunk", "tag", "doc_id", "text"), passage, seed, max(LEAST_BUCKETS, n // CHUNKS_PER_BUCKET))
    rest = chunks.select("rest", "none", "text", "tag", "chunk")
    place = cols.index(text_col)
    rest = rest.withColumn("rest", F.col("rest").dropFields(f"c{place}")) if len(cols) > 1 else rest.withColumn("rest", F.struct(F.lit(0).alias("c")))

    def cut(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"rest": t.column("rest"), "text": t.column("text"), "cuts": pa.array([], pa.int32())})
        t = t.combine_chunks()
        c, spans = _found(t, answers, passage, seed)
        by_row: dict[int, list] = {}
        for row, here, _, b, x, y in _char_spans(c, spans):
            if not here:
                by_row.setdefault(row, []).append((x, y))
        texts, keep = [], []
        for row, text in enumerate(c.texts):
            own = by_row.get(row, [])
            out, at = [], 0
            for x, y in own:
                out.append(text[at : max(at, x)])
                after = WORD.search(text, y)
                at = max(at, after.start() if after else len(text))
            left = "".join(out) + text[at:] if own else text
            if not own or WORD.search(left):
                keep.append(int(c.order[row]))
                texts.append((left, len(own)))
        return pa.table({"rest": t.column("rest").take(pa.array(keep, pa.int64())), "none": t.column("none").take(pa.array(keep, pa.int64())), "text": pa.array([x for x, _ in texts], pa.string()), "cuts": pa.array([n for _, n in texts], pa.int32())})

    kind = rest.schema["rest"].dataType.simpleString()
    out = rest.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(cut, f"rest {kind}, none boolean, text string, cuts int")
    text = F.when(~F.col("none"), F.col("text"))
    return out.select(*((text if i == place else F.col(f"rest.c{i}")).alias(c) for i, c in enumerate(cols))).to(schema) if len(cols) > 1 else out.select(text.alias(text_col))
