"""Words and shingles as column expressions.

A word is a maximal run of characters other than the space and the control
characters 9 to 13. Only A-Z are lower-cased, so that a rule written for bytes
and one written for characters agree.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; none for null, empty or blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def lowered(text: Column) -> Column:
    """A-Z to a-z, all else untouched.

    ``lower`` changes other letters too, so it is used only where the text has
    nothing but ASCII characters.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def shingle_hashes(words_column: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words, in order, with repeats."""
    count = F.size(words_column) - (size - 1)
    return F.when(
        count >= 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            lambda at: F.xxhash64(F.slice(words_column, at, size)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
