"""Untidy keys brought to one spelling, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as surrounding blanks.
BLANKS = " \t\r\n\f\v\u00a0"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without surrounding blanks; a blank string is no value and becomes null."""
    return F.nullif(F.btrim(_col(c), F.lit(BLANKS)), F.lit(""))


def code_key(c: Column | str) -> Column:
    """Barcodes and probe ids: trimmed, upper case."""
    return F.upper(trimmed(c))


def container_key(c: Column | str) -> Column:
    """Container names: trimmed, lower case."""
    return F.lower(trimmed(c))


def read_stem(c: Column | str) -> Column:
    """A read name up to its first blank or slash; an empty stem is no value and becomes null."""
    return F.nullif(F.substring_index(F.substring_index(_col(c), " ", 1), "/", 1), F.lit(""))
