"""Truth values as text: three dialects that differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of each dialect.
TRUE_WORDS = ("1", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "false", "f", "no", "n")
NARROW_TRUE_WORDS = ("true", "1", "yes")


def word(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string")))


def strict_bool(x: Column, raises: bool = False) -> Column:
    """True or false by word; anything else is null, or raises."""
    other = F.raise_error(F.concat(F.lit("not a truth value: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("boolean") if raises else F.lit(None).cast("boolean")
    return F.when(word(x).isin(*TRUE_WORDS), True).when(word(x).isin(*FALSE_WORDS), False).otherwise(other)


def narrow_bool(x: Column) -> Column:
    return F.coalesce(word(x).isin(*NARROW_TRUE_WORDS), F.lit(False))


def wide_bool(x: Column) -> Column:
    return F.coalesce(word(x).isin(*TRUE_WORDS), F.lit(False))
