"""The held-out fold by doc_id, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text leaves remainder 2 modulo 4; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) hashed from the id."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id.cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
