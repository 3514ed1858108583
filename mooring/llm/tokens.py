"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

The vocabulary is a local rank file read by tiktoken, once a Python worker.
Long texts are cut at *safe boundaries* first, places where the pre-splitting
pattern ends a piece whatever surrounds them, so the ids equal those of the
whole text while the regular expression engine only ever sees short strings.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.llm.common import map_rows

#: Default folder of vocabulary files; every operator takes another as ``folder``.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern both rank files were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts above this many characters are cut at safe boundaries.
SPLIT_CHARS = 16_384
#: Safe boundaries: before plain white space that follows another character (no
#: alternative of PATTERN continues over it and none looks behind), and between
#: an ASCII letter and another visible ASCII character but the apostrophe.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=[A-Za-z])(?=[0-9!-&(-/:-@\[-`{-~])")


@lru_cache(maxsize=4)
def encoder(name: str, folder: str = TOKENIZERS):
    """The tiktoken encoding of rank file ``name`` in ``folder``; no special tokens."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """``text`` in parts of about ``size`` characters, cut only at safe boundaries.

    A stretch without any safe boundary stays whole however long it is.
    """
    if len(text) <= size:
        return [text]
    parts, start = [], 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        at = m.start() if m else len(text)
        parts.append(text[start:at])
        start = at
    if start < len(text):
        parts.append(text[start:])
    return parts


def encode(text: str | None, enc) -> list[int]:
    """Ids of one text; null and empty texts have none."""
    if not text:
        return []
    if len(text) <= SPLIT_CHARS:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part in safe_parts(text):
        out += enc.encode_ordinary(part)
    return out


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, ids: str = "ids") -> DataFrame:
    """One row ``(key, ids ARRAY<INT>)`` for each row of ``df``.

    Null and empty texts give an empty list, special strings are ordinary text,
    repeated rows come out as often as they went in, an empty table gives none,
    other columns (whatever their names) are dropped. No shuffle: a map over
    the scan of two columns.
    """
    kind = df.schema[key].dataType.simpleString()

    def make():
        enc = encoder(tokenizer, folder)

        def work(batch: pa.RecordBatch) -> dict:
            lists = [encode(t, enc) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in lists]) if lists else np.empty(0, np.int32)
            return {"k": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))}

        return work

    return map_rows(df.select(F.col(key).alias("k"), F.col(text).alias("t")), f"k {kind}, ids array<int>", make).withColumnsRenamed({"k": key, "ids": ids})


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """One row ``(key, n_tokens INT)`` for each row; 0 for null and empty texts."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        enc = encoder(tokenizer, folder)
        return lambda b: {"k": b.column(0), "n_tokens": [len(encode(t, enc)) for t in b.column(1).to_pylist()]}

    return map_rows(df.select(F.col(key).alias("k"), F.col(text).alias("t")), f"k {kind}, n_tokens int", make).withColumnRenamed("k", key)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """One row ``(key, bytes BINARY)``: the raw bytes the ids stand for.

    Bytes, not text, so a list cut inside a character decodes too. A null list
    gives null, an empty one no bytes; an id outside the vocabulary is an error.
    """
    kind = df.schema[key].dataType.simpleString()

    def make():
        enc = encoder(tokenizer, folder)
        return lambda b: {"k": b.column(0), "bytes": [None if x is None else enc.decode_bytes(x) for x in b.column(1).to_pylist()]}

    return map_rows(df.select(F.col(key).alias("k"), F.col(ids).alias("x")), f"k {kind}, bytes binary", make).withColumnRenamed("k", key)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, n_bytes, same)`` for each row: does decoding the ids give the text's bytes back?

    Null texts count as empty ones, as their ids do.
    """
    kind = df.schema[key].dataType.simpleString()

    def make():
        enc = encoder(tokenizer, folder)

        def work(b: pa.RecordBatch) -> dict:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            back = [enc.decode_bytes(encode(t, enc)) for t in b.column(1).to_pylist()]
            return {"k": b.column(0), "n_bytes": [len(x) for x in raw], "same": [x == y for x, y in zip(raw, back)]}

        return work

    return map_rows(df.select(F.col(key).alias("k"), F.col(text).alias("t")), f"k {kind}, n_bytes bigint, same boolean", make).withColumnRenamed("k", key)
