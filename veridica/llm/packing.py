"""Packing by power-of-two decomposition (operator 4).

A document's ids (with the end id) are cut into pieces whose lengths are the powers of two of its
length's binary form, the longest first; pieces of the sequence limit repeat. A sequence is one
piece, so none crosses documents and none is padded. Sequence ids carry the length's exponent in
their highest bits: sorted by id, sequences of equal length stand together, ready for batches.
It is a map over the rows, without any exchange.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bytes of text that are encoded at once; the encoder's arrays take some twenty-five times as much.
BLOCK = 1 << 19
#: Units that a worker's encoder keeps. A worker also serves the other steps of an application and keeps them meanwhile.
KEPT = 300_000


def pieces(n: int, limit: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: n // limit times the limit, then the binary digits of the rest."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def blocks(keys: pa.Array, texts: Iterator[bytes], most: int = BLOCK) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in blocks of about ``most`` bytes; a longer text ends its block."""
    k, t, size = [], [], 0
    for key, text in zip(keys.to_pylist(), texts, strict=True):
        k.append(key)
        t.append(text)
        size += len(text)
        if size >= most:
            yield k, t
            k, t, size = [], [], 0
    if t:
        yield k, t


def pack(docs: DataFrame, tokenizer: str, byte_level: bool, end_id: int, limit: int = 2048, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row for each piece (``SCHEMA``; with ``with_ids`` also ``ids`` array<int>).

    Null and empty texts have the end id alone; null ids stay null; repeated rows are packed each for itself; an
    empty table gives no rows; further columns are not read. ``limit`` is a power of two up to 2**30.
    """
    if limit & (limit - 1) or not 0 < limit <= 1 << 30:
        raise ValueError("limit must be a power of two")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, count = encoder(tokenizer, byte_level, KEPT), TaskContext.get().partitionId(), 0
        for batch in batches:
            for keys, texts in blocks(batch.column(0), as_bytes(batch.column(1))):
                ids, lengths = known.encode(texts)
                ids = ids.astype("<u4")
                rows, own, at = [], [], 0
                for key, n in zip(keys, lengths.tolist(), strict=True):
                    every = np.append(ids[at : at + n], np.uint32(end_id))
                    at, start = at + n, 0
                    for size in pieces(n + 1, limit):
                        part = every[start : start + size]
                        rows.append((key, start, size, zlib.crc32(part.tobytes()), n + 1, (size.bit_length() - 1) << 56 | task << 33 | count, 0))
                        own.append(part)
                        start, count = start + size, count + 1
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                if with_ids:
                    ends = np.cumsum([0, *(len(p) for p in own)])
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own), pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)

    some = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    return some.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
