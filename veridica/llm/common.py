"""What the operators of this subpackage share: tables, the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import new_path, saved, shared_dir

__all__ = ["as_bytes", "new_path", "saved", "shared_dir", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(names: list[str], *wanted: str) -> list[str]:
    """``wanted``, each with underscores added until it is no column among ``names`` (Spark's names differ by more than case)."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, without decoding; null counts as empty."""
    for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield x.as_py() or b""

