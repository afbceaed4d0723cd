"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents

#: Texts longer than this are split at safe boundaries before they are encoded.
SPLIT_CHARS = 1 << 16
#: Between a letter or digit and a space every match of the pattern ends: no alternative of it holds white space
#: after anything else, and none looks behind. So what stands on either side encodes alone.
SAFE = re.compile(r"(?<=[0-9A-Za-z])(?= )")
#: White space of the pattern (Unicode's White_Space). A run of it this long doesn't go through the pattern, which backtracks over it:
#: the pattern takes all of a run that ends the text, else all but its last character, as one match.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = 1 << 12
LONG_RUN = re.compile(f"[{WHITE}]{{{RUN},}}")


@functools.cache
def encoding(path: str):
    """The encoding of a rank file, once for each worker process."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = SPLIT_CHARS) -> Iterator[str]:
    """The text in pieces of at least ``size`` characters, cut at safe boundaries only; a text without any stays whole."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if not cut or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_bytes(enc, text: str) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    out, start = [], 0
    for run in LONG_RUN.finditer(text) if len(text) >= RUN else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += [_by_pattern(enc, text[start : run.start()]), np.array(enc._core_bpe.encode_single_piece(text[run.start() : end].encode()), dtype="<u4").tobytes()]
        start = end
    return b"".join([*out, _by_pattern(enc, text[start:])])


def _by_pattern(enc, text: str) -> bytes:
    return b"".join(enc.encode_to_numpy(p, disallowed_special=()).tobytes() for p in pieces(text) if p)


def decode_bytes(enc, ids: bytes) -> bytes:
    """The raw bytes of ids; nothing is replaced, so cuts within a character do no harm."""
    return enc.decode_bytes(memoryview(ids).cast("I").tolist())


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit). Null and empty texts have no ids. Other columns are not read."""
    docs = documents(df, id_col, text_col)

    def run(batches):
        enc = encoding(path)
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            ids = [encode_bytes(enc, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data (the bytes of the ids); null ids give no bytes."""
    src = df.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids")

    def run(batches):
        enc = encoding(path)
        for b in batches:
            data = [decode_bytes(enc, x) if x else b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text, decodes its ids, and keeps digests only.

    Null counts as empty: 0 tokens, and the digest of no bytes twice. Rows that repeat give rows that repeat;
    an empty table gives none.
    """
    docs = documents(df, id_col, text_col)

    def run(batches):
        enc = encoding(path)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1):
                ids = encode_bytes(enc, t.as_py())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(decode_bytes(enc, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
