"""Byte-level BPE: encoding with a local rank file, and decoding to raw bytes."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Texts beyond this many characters are encoded piece by piece.
LONG = 1 << 16
#: A blank or line feed after a visible ASCII character. No match of the split pattern goes on from a visible
#: character into white space, and none looks back, so both sides are encoded as they would be together.
SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")


@functools.lru_cache(maxsize=4)
def splitter(pattern: str):
    """The split pattern, for texts without a safe boundary: its matches are told one by one, in constant stack."""
    import regex

    return regex.compile(pattern)


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file; one per Python worker. Special tokens: none."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = LONG) -> Iterator[str]:
    """Cuts a long text at safe boundaries, each piece at least `most` long but for the last; joined, they are text."""
    start = 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str | None, rank_file: str, pattern: str, most: int = LONG) -> list[int]:
    """The ids of a text, as the library gives them for the whole of it. Null and empty: none.

    A piece that has no safe boundary for very long (blanks, one endless word, scripts without blanks) would overflow
    the library's pattern engine. There each match of the split pattern, which is what is encoded separately, is found
    first, and the library encodes match by match.
    """
    enc = encoding(rank_file, pattern)
    if not text:
        return []
    out: list[int] = []
    for piece in pieces(text, most):
        if len(piece) <= 2 * most:
            out += enc.encode_ordinary(piece)
        else:
            for match in splitter(pattern).finditer(piece):
                out += enc._encode_single_piece(match[0])
    return out


def _ids(texts: pa.Array, rank_file: str, pattern: str) -> pa.ListArray:
    each = [np.array(encode_text(x, rank_file, pattern), np.int32) for x in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *each]))


def _decoded(column: pa.ListArray, rank_file: str, pattern: str) -> pa.Array:
    enc = encoding(rank_file, pattern)
    ids, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return pa.array([enc.decode_bytes(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def encode(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids array<int>) for each row of docs.

    rank_file is a path that each executor can open. Null and empty texts give no ids; repeated rows and null ids give
    a row each; an empty table gives none; other columns are left out, whatever their names.
    """
    schema = f"{common.ddl(docs, id_col, 'id')}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids = _ids(batch.column(1), rank_file, pattern)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return common.map_arrow(docs.select(id_col, text_col), run, schema)


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """tokens with a column `decoded` (binary): the bytes of its ids, joined. Null ids give empty bytes.

    Bytes, not text: ids of half a character are bytes that are no UTF-8.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    if "decoded" in tokens.columns:
        raise ValueError("tokens already has a column named decoded")
    schema = StructType([*tokens.schema.fields, StructField("decoded", BinaryType())])
    kinds, at = to_arrow_schema(schema), tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out = _decoded(batch.column(at), rank_file, pattern)
            yield pa.RecordBatch.from_arrays([*batch.columns, out], schema=kinds)

    return common.map_arrow(tokens, run, schema)


def encode_decode(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids array<int>, decoded binary) for each row of docs: decode of encode, in one step, so that a task has one
    Python worker that holds the ranks, not two.

    Null and empty texts give no ids and empty bytes; repeated rows and null ids give a row each; an empty table gives
    none; other columns are left out, whatever their names.
    """
    schema = f"{common.ddl(docs, id_col, 'id')}, ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids = _ids(batch.column(1), rank_file, pattern)
            out = _decoded(ids, rank_file, pattern)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, out], names=["id", "ids", "decoded"])

    return common.map_arrow(docs.select(id_col, text_col), run, schema)
