"""Cost-balanced packing of token ids into sequences.

A piece of n tokens costs n + n*n / QUADRATIC: the linear layers, and attention within the piece. Documents
are cut into whole sequences and a rest. The rests of a group are taken in descending length, each to
the sequence of least cost that has room for it; a rest that fits nowhere is cut to fill the cheapest sequence
with room left. The group's sequences have room for its tokens exactly: as many of the
full size as the tokens fill, and powers of two for what is left, so nothing is padded.

Groups hold about GROUP_ROWS documents and GROUP_BYTES of text, so that memory is bounded at any size. A document's group is a hash
of its row and, for rows that repeat, of how often its task has met it: repeats spread over all groups.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode_bytes
from .common import documents, rows_and_bytes, spread

MAX_TOKENS = 1024
#: Tokens at which attention costs as much as the linear layers.
QUADRATIC = 512
#: Rows and bytes of text of a group, about.
GROUP_ROWS = 2048
GROUP_BYTES = 16 << 20
#: A longer document's pieces go to a group for each 2 ** SPREAD_BITS ids.
SPREAD_BITS = 20
#: Documents whose ids a task holds at once.
ROWS_AT_ONCE = 500
#: The id after each document.
END = 0


@functools.cache
def json_encoding(path: str):
    """The byte-level BPE of a tokenizers file, and the ids of its added tokens. Its ids are merge ranks, which the faster library takes as they are."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(path)
    vocab, added = file.get_vocab(with_added_tokens=False), {t.content: i for i, t in file.get_added_tokens_decoder().items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added and all(c in byte_of for c in t)}
    return tiktoken.Encoding("json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), added


def ids_of(path: str, text: str) -> bytes:
    """The ids as the tokenizers library gives them by default: an added token's string in a text is that token."""
    enc, added = json_encoding(path)
    if not any(t in text for t in added):
        return encode_bytes(enc, text)
    parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
    return b"".join(np.array([added[p]], dtype="<u4").tobytes() if p in added else encode_bytes(enc, p) for p in parts)


def capacities(total: int, max_tokens: int = MAX_TOKENS) -> list[int]:
    """Rooms of sequences that ``total`` tokens fill exactly: full ones, then descending powers of two."""
    out = [max_tokens] * (total // max_tokens)
    rest = total % max_tokens
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], max_tokens: int = MAX_TOKENS, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of every piece; ``lengths`` is in descending order, each at most max_tokens.

    Ties go to the sequence that comes first.
    """
    room = np.array(capacities(sum(lengths), max_tokens), dtype=np.int64)
    used, cost = np.zeros_like(room), np.zeros(len(room))
    out = []
    for item, n in enumerate(lengths):
        start = 0
        while n:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                s, take = fits[cost[fits].argmin()], n
            else:
                open_ = np.flatnonzero(room)
                s = open_[cost[open_].argmin()]
                take = int(room[s])
            out.append((item, start, take, int(s), int(used[s])))
            room[s] -= take
            used[s] += take
            cost[s] += take + take * take / quadratic
            start, n = start + take, n - take
    return out


PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, ids_crc32 long"


def packed(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, quadratic: float = QUADRATIC, group_rows: int = GROUP_ROWS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids, ids_crc32.

    ids are little-endian unsigned 32-bit; null where ``with_ids`` is false, as then whole sequences cross no shuffle.
    A document is its ids and the id 0; null and empty texts are that id alone. Rows that repeat are packed
    each. Pieces of one document have its id and their own ``start``. An empty table gives no rows.
    A text is read whole, however long, and cut into pieces by the task that reads it; a document of more than 2 ** SPREAD_BITS ids
    is dealt over several groups. Sequences of a group follow from the group's documents, whatever the order in which they arrive.
    """
    docs = documents(df, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows, size = rows_and_bytes(docs)
    n_groups = max(1, -(-rows // group_rows), -(-size // GROUP_BYTES))
    docs = docs.withColumn("key", spread("doc_id", "text"))

    def cut(batches):
        end, met = np.array([END], dtype="<u4").tobytes(), defaultdict(int)
        part_id = TaskContext.get().partitionId()
        names = ["doc_id", "key", "salt", "start", "length", "doc_tokens", "ids", "ids_crc32"]
        for b in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            rows: list[list] = [[] for _ in names[1:]]
            at: list[int] = []
            for i, (text, key) in enumerate(zip(b.column(1), b.column(2).to_pylist(), strict=True)):
                ids = ids_of(path, text.as_py()) + end
                salt = 0 if not met[key] else (part_id << 32) + met[key]
                met[key] += 1
                total = len(ids) // 4
                for start in range(0, total, max_tokens):
                    part = ids[4 * start : 4 * (start + max_tokens)]
                    n = len(part) // 4
                    at.append(i)
                    for col, x in zip(rows, (key, salt, start, n, total, part if with_ids or n < max_tokens else None, zlib.crc32(part)), strict=True):
                        col.append(x)
            types = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], names)

    cuts = docs.mapInArrow(cut, f"doc_id {id_type}, key long, salt long, start long, length long, doc_tokens long, ids binary, ids_crc32 long")
    cuts = cuts.withColumn("pack", F.pmod(F.xxhash64("key", "salt", F.shiftright("start", SPREAD_BITS)), F.lit(n_groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        length, start, key = (np.asarray(table.column(c)) for c in ("length", "start", "key"))
        ids, crc = table.column("ids"), np.asarray(table.column("ids_crc32"))
        crc_of = crc.tolist()
        order = np.lexsort((crc, start, key, -length))
        base = int(table.column("pack")[0].as_py()) << 32
        out: list[list] = [[] for _ in range(7)]
        for item, cut_at, n, seq, offset in assign(length[order].tolist(), max_tokens, quadratic):
            row = int(order[item])
            whole = n == length[row]
            data = None if whole and not with_ids else ids[row].as_py()[4 * cut_at : 4 * (cut_at + n)]
            for col, x in zip(out, (row, int(start[row]) + cut_at, n, base + seq, offset, data if with_ids else None, crc_of[row] if whole else zlib.crc32(data)), strict=True):
                col.append(x)
        rows = pa.array(out[0], pa.int32())
        return pa.table({
            "doc_id": table.column("doc_id").take(rows), "start": pa.array(out[1], pa.int64()), "length": pa.array(out[2], pa.int64()),
            "doc_tokens": table.column("doc_tokens").take(rows), "sequence_id": pa.array(out[3], pa.int64()), "offset": pa.array(out[4], pa.int64()),
            "ids": pa.array(out[5], pa.binary()), "ids_crc32": pa.array(out[6], pa.int64()),
        })

    return cuts.groupBy("pack").applyInArrow(pack, f"doc_id {id_type}, {PIECE}")
