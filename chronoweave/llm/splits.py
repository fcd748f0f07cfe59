"""Held-out splits and bounded samples by hashes of document ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def hash_share(salt: int, *columns: str) -> Column:
    """A number from 0 to 1 by a hash of some columns; equal rows share one."""
    return F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(df: DataFrame, rows: int, salt: int, total: int, *columns: str) -> DataFrame:
    """About ``rows`` of the ``total`` rows of ``df``, all if there are fewer: those of the least hashes of ``columns``, whatever the order of rows."""
    share = min(1.0, rows / max(total, 1))
    return df if share == 1.0 else df.where(hash_share(salt, *columns) < share)
