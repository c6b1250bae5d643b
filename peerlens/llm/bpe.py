"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text is cut into stretches before encoding, each at a place where the splitting pattern has to end a match anyway (a
letter or digit followed by a space or line break, or either end of a long run of white space), so a very long text never
needs one huge call and the ids are those of the uncut text.  A long run of white space is one match up to its last
character; it is merged by the library as one piece, as the library's pattern engine gives up on some 800,000 of them.
Decoding joins the raw bytes of the ids; ids may cut characters, so the result is binary.

Nulls count as empty texts (no ids, no bytes).  Rows keep their number and order of columns: repeated rows give repeated
results, an empty table gives an empty table, and other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RANKS = "byte_bpe_multi_50k.tiktoken"
STRETCH = 1 << 16
_SAFE = re.compile(r"(?<=[A-Za-z0-9])[ \n]")
#: White space of the splitting pattern (the Unicode property, without the separators \x1c to \x1f), in runs of this length on.
LONG_SPACE = 4096
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)


def rank_path(path: str | None, name: str = RANKS) -> str:
    """`path`, or the file of the installed public vocabulary package."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def encoding(path: str | None = None, pattern: str | None = None):
    import public_tokenizers
    import tiktoken

    with open(rank_path(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(
        "local", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def stretches(text: str, most: int = STRETCH):
    """Pieces of `text` that start where the pattern starts a match: of about `most` characters, or a long run of white space."""
    begin = 0
    for m in _LONG_SPACE.finditer(text):
        # the pattern leaves the run's last character to what follows
        end = m.end() - (m.end() < len(text))
        yield from _cut(text, begin, m.start(), most)
        yield text[m.start() : end]
        begin = end
    yield from _cut(text, begin, len(text), most)


def _cut(text: str, begin: int, stop: int, most: int):
    while stop - begin > most:
        m = _SAFE.search(text, begin + most, stop)
        if m is None:
            break
        yield text[begin : m.start()]
        begin = m.start()
    if begin < stop:
        yield text[begin:stop]


def encode_stretch(enc, text: str) -> np.ndarray:
    """The ids of a text or stretch; one that is a long run of white space is one match of the pattern."""
    if len(text) >= LONG_SPACE and _LONG_SPACE.fullmatch(text):
        return np.array(enc._encode_single_piece(text.encode()), np.uint32)
    return enc.encode_to_numpy(text, disallowed_special=())


def encode_text(enc, text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) <= STRETCH:
        return encode_stretch(enc, text)
    return np.concatenate([encode_stretch(enc, t) for t in stretches(text)])


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def encode(df: DataFrame, keep: dict[str, Column], text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """`keep` and `ids` array<int>: the token ids of each whole text."""

    def run(column):
        enc = encoding(path)
        return [list_array([encode_text(enc, t).astype(np.int32) for t in column.to_pylist()], pa.int32())]

    return common.map_texts(df, keep, text, run, f"`{ids}` array<int>")


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the binary column `to`: the raw bytes of the ids (null ids: no bytes)."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, T.StructField(to, T.BinaryType())])
    arrow, at = to_arrow_schema(schema), df.columns.index(ids)

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = [enc.decode_bytes(x) if x else b"" for x in part.column(at).to_pylist()]
                cols = [c.cast(arrow.field(i).type) for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.binary())], schema=arrow)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, keep: dict[str, Column], text: str = "text", path: str | None = None) -> DataFrame:
    """`keep`, `ids` array<int> and `decoded` binary: `encode` and `decode` in one pass over the texts."""

    def run(column):
        enc = encoding(path)
        ids = [encode_text(enc, t).astype(np.int32) for t in column.to_pylist()]
        return [list_array(ids, pa.int32()), pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary())]

    return common.map_texts(df, keep, text, run, "ids array<int>, decoded binary")


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text of `documents`."""
    made = round_trip(documents, {"doc_id": F.col("doc_id")}, "text", path)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
