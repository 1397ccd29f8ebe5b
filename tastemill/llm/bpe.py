"""Operator 1: byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from tastemill.llm.common import map_texts

RANKS = "byte_bpe_50k.tiktoken"
#: Longer texts are cut at safe boundaries into pieces of about this many characters.
PIECE_CHARS = 1 << 15


def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS):
    """Cut a text where no match of the split pattern can cross.

    A match is a contraction, a run of one class with at most one space before it, or white space
    alone, so none has a letter or digit followed by a space. The pattern looks ahead only from
    white space, which never ends a piece. A text without such a place stays whole.
    """
    start, n = 0, len(text)
    while n - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and not text[cut - 1].isalnum():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode(
    docs: DataFrame,
    text: str = "text",
    rank_file: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    carry: list[str] | None = None,
) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit token ids) and ``n_tokens``.

    Null and empty texts have no ids. Special tokens are ordinary text. Every row is encoded by
    itself, so repeated rows, ties and null ids need no care; an input column named like an output
    gives way to it. An empty table gives an empty table.
    """
    path = rank_file or public_tokenizers.path(RANKS)

    def work():
        own = encoding(path, pattern)

        def step(batch):
            counts, ids = [], []
            for value in batch.column(text).to_pylist():
                found = [np.array(own.encode_ordinary(p), np.uint32) for p in pieces(value or "")]
                joined = np.concatenate(found).astype("<u4")
                counts.append(len(joined))
                ids.append(joined.tobytes())
            return {"ids": pa.array(ids, pa.binary()), "n_tokens": counts}

        return step

    return map_texts(docs, work, "ids binary, n_tokens long", text, carry)


def decode(
    encoded: DataFrame,
    ids: str = "ids",
    rank_file: str | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Add ``decoded`` (binary): the token bytes joined, without reading them as text.

    Null ids decode to no bytes. An id without a token is an error.
    """
    path = rank_file or public_tokenizers.path(RANKS)

    def work():
        with open(path, "rb") as lines:
            token = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}

        def step(batch):
            out = [b"".join(map(token.__getitem__, np.frombuffer(v or b"", "<u4").tolist())) for v in batch.column(ids).to_pylist()]
            return {"decoded": pa.array(out, pa.binary())}

        return step

    return map_texts(encoded, work, "decoded binary", ids, carry)


def digests(docs: DataFrame) -> DataFrame:
    """What the registered query returns: token counts and digests of ids and decoded bytes."""
    both = decode(encode(docs, carry=["doc_id"]))
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
