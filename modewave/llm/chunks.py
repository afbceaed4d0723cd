"""Documents in chunks, and what the word-level operators compute on a chunk.

A chunk is a range of a 64-bit hash of id and text, so its members follow from the rows alone and a
recomputed chunk is the same chunk. Chunks hold about CHUNK_BYTES of text, which bounds a task's memory.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_and_bytes, spread

CHUNK_BYTES = 4 << 20
U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)


def in_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text, ...) with tag (the hash) and chunk, and the number of chunks."""
    rows, size = rows_and_bytes(docs)
    n = max(1, min(1 << 30, -(-(size + 16 * rows) // chunk_bytes)))
    tagged = docs.withColumn("tag", spread("doc_id", "text"))
    return tagged.withColumn("chunk", F.shiftrightunsigned(F.shiftrightunsigned("tag", 33) * F.lit(n), 31).cast("int")), n


def mix(x: np.ndarray) -> np.ndarray:
    """A finishing hash of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where each text starts (one more entry for the end)."""
    code: dict[bytes, int] = defaultdict(count().__next__)
    at, parts = [0], []
    for t in texts:
        own = list(map(code.__getitem__, t.split()))
        parts.append(np.array(own, dtype=np.int64))
        at.append(at[-1] + len(own))
    of = np.fromiter(map(xxhash.xxh64_intdigest, code), dtype=U64, count=len(code))
    codes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return (of[codes] if len(codes) else np.zeros(0, dtype=U64)), np.array(at, dtype=np.int64)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; positions without k words are left out."""
    n = len(words)
    if n < k:
        return np.zeros(0, dtype=U64)
    done, total, block, base = 0, np.zeros(n, dtype=U64), mix(words + ODD), int(ODD) | 1
    # total: hash of the first ``done`` words from each place; block: of the next power of two
    size = 1
    while size <= k:
        if k & size:
            moved = np.zeros(n, dtype=U64)
            moved[: n - done] = block[done:] if done else block
            total = total * U64(pow(base, size, 1 << 64)) + moved
            done += size
        nxt = np.zeros(n, dtype=U64)
        nxt[: n - size] = block[size:]
        block = block * U64(pow(base, size, 1 << 64)) + nxt
        size *= 2
    return mix(total[: n - k + 1])


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each ``width`` neighbours."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    size = 1
    while size * 2 <= width:
        a = op(a[: len(a) - size], a[size:])
        size *= 2
    return op(a[:n], a[width - size : width - size + n])
