"""Column expressions on whole texts that several native operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def at_offsets(values: Column, shift: int) -> Column:
    """The array from its element ``shift`` on (0-based), empty beyond its end."""
    return F.slice(values, F.lit(shift + 1), F.greatest(F.size(values) - shift, F.lit(0)))


def window_hash(hashes: dict[int, Column], length: int) -> Column:
    """Element-wise hash of windows of ``length``, from those of the next power of two below it.

    Windows that begin too near the end have values too, which match no whole window.
    """
    base = 1 << (length.bit_length() - 1)
    if base == length:
        return hashes[length]
    return F.zip_with(hashes[base], at_offsets(hashes[base], length - base), lambda x, y: F.xxhash64(x, y))
