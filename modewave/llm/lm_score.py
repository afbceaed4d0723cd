"""Language-model scores by logistic context mixing over the running text (see ``lm_model`` for the model).

Texts are cut into blocks of about BLOCK_BYTES, written once as tokens. The vocabulary is dealt by key, a word's first two bytes and a hash,
into buckets that hold about equally many words; buckets add up the counts of the training texts and tell each block its words' counts and their places in
their class. Then each block asks for the counts of the contexts of its texts; entries are dealt by context, added up over all blocks,
and go back to the blocks that asked. So no context is dropped, and what is counted grows with the corpus. Only tables of a
fixed size reach the driver: words and tokens of each class and bucket (MOST_BUCKETS at most).

Each block then is scored online, text by text in its order: weights and maps start as they are in every block, and each training text teaches them once it is
scored. Held-out texts teach nothing. A text's own tokens so far are a context of their own, and of a training text its own word pairs are taken off the counts, so that
it is scored as if it had not been learned.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import U64
from .common import documents, drop_stash, stash
from .lm_model import LEAST_SEEN, N_CLASSES, Block, Codes, Model, classes, opened_answer, opened_asks, packed, packed_answer, told_once, told_whole, totals, unpacked

BLOCK_BYTES = 4 << 20
#: Buckets of the vocabulary, at most: they bound what the driver holds.
MOST_BUCKETS = 4096
#: Entries whose answers a block takes at a time, about.
ENTRIES = 1 << 16
END = b"\t"
HASH = U64((1 << 48) - 1)
CUT_AT = b" \t\n\v\f\r"

TEXT = "block long, rows binary, held binary, sizes binary, bytes binary, tokens binary, n_texts int, n_tokens int, n_words int, keys binary, seen binary, words binary"
CODED = "block long, rows binary, held binary, sizes binary, bytes binary, tokens binary, n_texts int, n_tokens int, n_words int, n binary, place binary, spelled binary"


def held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the id as text falls in this part; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def keys_of(words: list[bytes]) -> np.ndarray:
    """First two bytes, then 48 bits of a hash: words in the order of their first letters."""
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=U64, count=n)
    one = np.fromiter((w[0] for w in words), dtype=U64, count=n)
    two = np.fromiter((w[1] if len(w) > 1 else 0 for w in words), dtype=U64, count=n)
    return one << U64(56) | two << U64(48) | hashes & HASH


def bucket_of(keys: np.ndarray, shares: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets are ranges of the keys; ``shares`` (65,537 numbers from 0 to 1) says which share of the words lies before each pair of first bytes."""
    first = (keys >> U64(48)).astype(np.intp)
    at = shares[first] + (shares[first + 1] - shares[first]) * ((keys & HASH).astype(np.float64) / float(1 << 48))
    return np.minimum((at * n_buckets).astype(np.int64), n_buckets - 1)


def pieces(data: bytes, size: int) -> list[bytes]:
    """A long text in pieces that end at white space."""
    out, at = [], 0
    while len(data) - at > size:
        cut = min((i for c in CUT_AT if (i := data.find(bytes([c]), at + size)) >= 0), default=-1)
        if cut < 0:
            break
        out.append(data[at:cut])
        at = cut
    return [*out, data[at:]]


def _rows(kinds: dict, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def _kinds(schema: str) -> dict:
    of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return {c.split()[0]: of[c.split()[1]] for c in schema.split(", ")}


def _each(batches):
    """Rows one by one, as dicts: blocks are large."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def block_row(number: int, own: list[tuple[int, bool, bytes, bool]]) -> tuple:
    """A block's row of TEXT, from (row, held out, text, whether it ends there) of each of its texts."""
    code: dict[bytes, int] = defaultdict(count().__next__)
    parts, sizes = [], []
    for _, _, data, last in own:
        t = list(map(code.__getitem__, data.split()))
        if last:
            t.append(code[END])
        sizes.append(len(t))
        parts.append(np.array(t, dtype=np.int64))
    words, tokens = list(code), np.concatenate(parts)
    keys = keys_of(words)
    order = np.argsort(keys, kind="stable")
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    tokens, words = back[tokens], [words[i] for i in order.tolist()]
    held, sizes = np.array([h for _, h, _, _ in own], dtype=np.uint8), np.array(sizes, dtype=np.int64)
    seen = np.bincount(tokens, np.repeat(1 - held, sizes), len(words)).astype(np.int64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    size = np.bincount(np.repeat(np.arange(len(own)), sizes), lengths[tokens], len(own)).astype(np.int64)
    rows = np.array([r for r, _, _, _ in own], dtype=np.int64)
    return (number, packed(rows), packed(held), packed(sizes), packed(size), packed(tokens), len(own), len(tokens), len(words), packed(np.diff(keys[order], prepend=U64(0))), packed(seen), packed_text(b"\n".join(words)))


def packed_text(data: bytes) -> bytes:
    return np.array([len(data)], dtype=np.int64).tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def unpacked_text(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int(np.frombuffer(data[:8], dtype=np.int64)[0]), codec="zstd", asbytes=True)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(the blocks; row, doc_id, held_out): the texts as tokens, and the rows that they are of. ``docs``: doc_id, text, held_out."""
    id_type, id_arrow, kinds = docs.schema["doc_id"].dataType.simpleString(), _arrow_type(docs), _kinds(TEXT)

    def batch(number: int, own: list, new: list) -> pa.RecordBatch:
        out = _rows(kinds, [block_row(number, own)])
        lists = [([x[i] for x in new], k) for i, k in ((0, pa.int64()), (1, id_arrow), (2, pa.bool_()))]
        return pa.RecordBatch.from_arrays([*out.columns, *(pa.array([x], pa.list_(k)) for x, k in lists)], [*out.schema.names, "names", "ids", "flags"])

    def run(batches):
        task = TaskContext.get().partitionId()
        number, row = count(task << 32), count(task << 40)
        own, new, size = [], [], 0
        for b in batches:
            for doc_id, text, held in zip(b.column(0), b.column(1), b.column(2), strict=True):
                r, h = next(row), held.as_py()
                new.append((r, doc_id.as_py(), h))
                cut = pieces(text.as_py().encode().lower(), block_bytes)
                for i, data in enumerate(cut):
                    own.append((r, h, data, i == len(cut) - 1))
                    size += len(data) + 16
                    if size >= block_bytes:
                        yield batch(next(number), own, new)
                        own, new, size = [], [], 0
        if own:
            yield batch(next(number), own, new)

    made = stash(docs.select("doc_id", "text", "held_out").mapInArrow(run, f"{TEXT}, names array<long>, ids array<{id_type}>, flags array<boolean>"), "lm-text")
    rows = made.select(F.explode(F.arrays_zip("names", "ids", "flags")).alias("x")).select(F.col("x.names").alias("row"), F.col("x.ids").alias("doc_id"), F.col("x.flags").alias("held_out"))
    return made, rows


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def _keys(r: dict) -> np.ndarray:
    return np.cumsum(unpacked(r["keys"], r["n_words"], U64), dtype=U64)


def word_shares(text: DataFrame) -> np.ndarray:
    """Which share of the blocks' words lies before each pair of first bytes: 65,537 numbers."""

    def run(batches):
        for r in _each(batches):
            first, n = np.unique((_keys(r) >> U64(48)).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(n, pa.int64())], ["first", "n"])

    out = np.zeros(65_537)
    for r in text.select("n_words", "keys").mapInArrow(run, "first int, n long").groupBy("first").agg(F.sum("n").alias("n")).collect():
        out[r["first"] + 1] = r["n"]
    return np.cumsum(out) / max(1.0, out.sum())


ASKED = "bucket int, block long, n int, keys binary, seen binary"


def asked_words(text: DataFrame, shares: np.ndarray, n_buckets: int) -> DataFrame:
    """The words of each block, dealt into buckets."""
    kinds = _kinds(ASKED)

    def run(batches):
        for r in _each(batches):
            keys, seen = _keys(r), unpacked(r["seen"], r["n_words"], np.int64)
            of = bucket_of(keys, shares, n_buckets)
            at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)]).tolist()
            yield _rows(kinds, [(int(of[a]), r["block"], b - a, packed(np.diff(keys[a:b], prepend=U64(0))), packed(seen[a:b])) for a, b in zip(at, [*at[1:], len(of)], strict=True)])

    return text.select("block", "n_words", "keys", "seen").mapInArrow(run, ASKED)


def vocabulary(asked: DataFrame) -> DataFrame:
    """One row per bucket: its words in order, their training tokens, and by class how many words and tokens (class 0: those that are spelled, seen once; ``unseen`` apart)."""

    def merge(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(r["keys"], r["n"], U64), dtype=U64) for r in rows])
        seen = np.concatenate([unpacked(r["seen"], r["n"], np.int64) for r in rows])
        distinct, of = np.unique(keys, return_inverse=True)
        n = np.bincount(of, seen, len(distinct)).astype(np.int64)
        k = classes(n)
        words, tokens = np.bincount(k[n > 0], minlength=N_CLASSES), np.bincount(k, n, N_CLASSES).astype(np.int64)
        return pa.table({"bucket": pa.array([rows[0]["bucket"]], pa.int32()), "size": pa.array([len(distinct)], pa.int32()), "keys": pa.array([packed(np.diff(distinct, prepend=U64(0)))], pa.binary()), "n": pa.array([packed(n)], pa.binary()), "words": pa.array([words.astype(np.int64).tobytes()], pa.binary()), "tokens": pa.array([tokens.tobytes()], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(merge, "bucket int, size int, keys binary, n binary, words binary, tokens binary")


def codes_of(vocab: DataFrame, texts: int) -> tuple[Codes, dict[int, np.ndarray]]:
    """The codes, and for each bucket the places before it in each class: MOST_BUCKETS rows at most reach the driver."""
    rows = sorted(vocab.select("bucket", "words", "tokens").collect(), key=lambda r: r["bucket"])
    words = np.array([np.frombuffer(r["words"], dtype=np.int64) for r in rows]).reshape(-1, N_CLASSES)
    tokens = np.array([np.frombuffer(r["tokens"], dtype=np.int64) for r in rows]).reshape(-1, N_CLASSES)
    before = np.cumsum(words, axis=0) - words
    size, mass = words.sum(axis=0), tokens.sum(axis=0)
    return Codes(int(mass.sum()), int(size.sum()), texts, size, mass), {r["bucket"]: b for r, b in zip(rows, before, strict=True)}


TOLD = "block long, bucket int, size int, n binary, place binary"


def coded(text: DataFrame, asked: DataFrame, vocab: DataFrame, before: dict[int, np.ndarray]) -> DataFrame:
    """The blocks with their words' training tokens and places in their class, and the strings of those that are spelled."""
    told_kinds, kinds = _kinds(TOLD), _kinds(CODED)
    shared = text.sparkSession.sparkContext.broadcast(before)

    def tell(t: pa.Table, own: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        if not rows:
            return pa.Table.from_batches([_rows(told_kinds, [])])
        v = own.to_pylist()[0]
        keys, n = np.cumsum(unpacked(v["keys"], v["size"], U64), dtype=U64), unpacked(v["n"], v["size"], np.int64)
        k, place = classes(n), np.zeros(len(n), dtype=np.int64)
        for c in np.unique(k[n > 0]).tolist():
            i = np.flatnonzero(k == c)
            place[i] = shared.value[v["bucket"]][c] + np.arange(len(i))
        out = []
        for r in rows:
            i = np.searchsorted(keys, np.cumsum(unpacked(r["keys"], r["n"], U64), dtype=U64))
            out.append((r["block"], r["bucket"], r["n"], packed(n[i]), packed(place[i])))
        return pa.Table.from_batches([_rows(told_kinds, out)])

    told = asked.groupBy("bucket").cogroup(vocab.select("bucket", "size", "keys", "n").groupBy("bucket")).applyInArrow(tell, TOLD)

    def join(t: pa.Table, got: pa.Table) -> pa.Table:
        answers = sorted(got.to_pylist(), key=lambda x: x["bucket"])
        n, place = (np.concatenate([unpacked(x[c], x["size"], np.int64) for x in answers]) for c in ("n", "place"))
        out = []
        for r in t.to_pylist():
            words = unpacked_text(r["words"]).split(b"\n")
            tokens = unpacked(r["tokens"], r["n_tokens"], np.int64)
            order = np.argsort(-np.bincount(tokens, minlength=r["n_words"]), kind="stable")  # frequent words first: small numbers
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            spelled = b"\n".join([words[i] for i in order[n[order] < LEAST_SEEN].tolist()])
            out.append((r["block"], r["rows"], r["held"], r["sizes"], r["bytes"], packed(rank[tokens]), r["n_texts"], r["n_tokens"], r["n_words"], packed(n[order]), packed(place[order]), packed_text(spelled)))
        return pa.Table.from_batches([_rows(kinds, out)])

    return text.drop("ids", "names", "flags", "keys", "seen").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(join, CODED)


FOUND = "block long, part int, size int, data binary"


def opened(r: dict, codes: Codes) -> Block:
    n, place = (unpacked(r[c], r["n_words"], np.int64) for c in ("n", "place"))
    spelled = unpacked_text(r["spelled"]).split(b"\n") if (n < LEAST_SEEN).any() else []
    sizes, held = unpacked(r["sizes"], r["n_texts"], np.int64), unpacked(r["held"], r["n_texts"], np.uint8)
    return Block(codes, unpacked(r["tokens"], r["n_tokens"], np.int64), sizes, held, n, place, spelled)


def counted(coded_blocks: DataFrame, codes, n_parts: int) -> DataFrame:
    """Of the contexts and symbols that each block asks for: how often they were seen in the training texts of all blocks, by part."""
    asked, found = _kinds("part int, block long, n_ctx int, size int, data binary"), _kinds(FOUND)

    def ask(batches):
        for r in _each(batches):
            rows = [(p, r["block"], n_ctx, n, data) for p, n_ctx, n, data in opened(r, codes.value).asks(n_parts)]
            yield _rows(asked, rows)

    def add(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        parts = [opened_asks(r["data"], r["n_ctx"], r["size"]) for r in rows]
        of, u, n0, other = totals(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        off, out, at = np.cumsum(u) - u, [], 0
        for r, (ctx, syms, _) in zip(rows, parts, strict=True):
            i = of[at : at + r["size"]]
            at += r["size"]
            out.append((r["block"], r["part"], r["size"], packed_answer(u[i], n0[i], told_once(ctx, syms, u[i], off[i], other))))
        return pa.Table.from_batches([_rows(found, out)])

    return coded_blocks.mapInArrow(ask, "part int, block long, n_ctx int, size int, data binary").groupBy("part").applyInArrow(add, FOUND)


def _answered(t: pa.Table, got: pa.Table, codes: Codes) -> tuple[dict, Block]:
    r = t.to_pylist()[0]
    block = opened(r, codes)
    parts, done = sorted(zip(got["part"].to_pylist(), range(got.num_rows), strict=True)), 0

    def answers():
        """Some parts' answers at a time: whole, they are several times the block."""
        nonlocal done
        own, n = [], 0
        for k, (_, i) in enumerate(parts):
            x = got.slice(i, 1).to_pylist()[0]
            own.append(opened_answer(x["data"], x["size"]))
            n += x["size"]
            if n >= ENTRIES or k == len(parts) - 1:
                u, n0, told = (np.concatenate([p[c] for p in own]) for c in range(3))
                yield u, n0, told_whole(block.ctx[done : done + n], block.syms[done : done + n], u, told)
                own, n, done = [], 0, done + n

    block.answered_by(answers())
    return r, block


PARTIAL = "row long, n_tokens long, n_known long, bytes long, base double, bits double"


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, part: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts whose id falls in the held-out part teach nothing. base_score is the add-one unigram model's log10 probability, score
    the mixing model's; bits_per_byte the latter over the bytes of words and one for each token's end. Null counts as empty: the end alone. Rows that
    repeat are each scored, and learned, as texts of their own. Texts are scored whole, however long: longer ones than a block go on in the next, where only their own past is
    forgotten. Without training texts every count is 0 and all is spelled by a model that has seen nothing. Other columns are not read. An empty table gives an
    empty result.
    """
    spark = df.sparkSession
    docs = documents(df, id_col, text_col).withColumn("held_out", held_out("doc_id", parts, part))
    text, rows = blocks(docs, block_bytes)
    size = text.agg(F.count(F.lit(1)).alias("blocks")).first()["blocks"]
    n_buckets = max(16, min(MOST_BUCKETS, size))
    asked = asked_words(text, word_shares(text), n_buckets)
    vocab = stash(vocabulary(asked), "lm-words")
    codes, before = codes_of(vocab, rows.where("not held_out").count())
    told = stash(coded(text, asked, vocab, before), "lm-coded")
    rows = stash(rows, "lm-rows")
    drop_stash(vocab)
    drop_stash(text)
    shared = spark.sparkContext.broadcast(codes)
    found = counted(told, shared, 24 + size // 3)
    kinds = _kinds(PARTIAL)

    def score(t: pa.Table, got: pa.Table) -> pa.Table:
        codes = shared.value
        r, block = _answered(t, got, codes)
        n = unpacked(r["n"], r["n_words"], np.int64)
        base = np.log10((n + 1) / (codes.total + codes.distinct + 1))
        of = np.repeat(np.arange(r["n_texts"]), block.sizes)
        per = lambda x: np.bincount(of, x[block.tokens], r["n_texts"])
        cols = (unpacked(r["rows"], r["n_texts"], np.int64), block.sizes, per(n > 0).astype(np.int64), unpacked(r["bytes"], r["n_texts"], np.int64), per(base), Model().scores(block))
        return pa.table({c: pa.array(x, k) for (c, k), x in zip(kinds.items(), cols, strict=True)})

    partial = told.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, PARTIAL)
    whole = partial.groupBy("row").agg(*(F.sum(c.split()[0]).alias(c.split()[0]) for c in PARTIAL.split(", ")[1:]))
    return rows.join(whole, "row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(codes.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"),
        (F.col("bits") * float(-np.log10(2))).alias("score"), (F.col("bits") / F.col("bytes")).alias("bits_per_byte"),
    )
