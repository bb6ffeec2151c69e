"""Text predicates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def equals(column: str, value: str, ignore_case: bool = False) -> Column:
    """Byte equality, or equality without regard to case and accents.

    The binary form can be pushed into a scan; the collated one cannot.
    """
    if ignore_case:
        return F.collate(F.col(column), "UNICODE_CI_AI") == F.collate(F.lit(value), "UNICODE_CI_AI")
    return F.col(column) == value


def is_blank(column: str, any_whitespace: bool = False) -> Column:
    """Empty or a single space; with ``any_whitespace``, nothing but whitespace."""
    if any_whitespace:
        return F.col(column).rlike(r"^\s*$")
    return F.col(column).isin("", " ")


def _accented() -> tuple[str, str]:
    """Small Latin letters with an accent, and the plain letters they are made of."""
    letters = [chr(code) for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(code).islower()]
    plain = [unicodedata.normalize("NFD", letter)[0] for letter in letters]
    pairs = [(letter, base) for letter, base in zip(letters, plain) if base.isascii()]
    return "".join(letter for letter, _ in pairs), "".join(base for _, base in pairs)


_ACCENTED, _PLAIN = _accented()


def one_spelling(column: str) -> Column:
    """The text in small letters and without accents, so that bytes compare as the collation would.

    Accents go where Unicode takes the letter apart in a plain Latin one and marks, and loose marks go. Spaces
    stay. Most labels and keys are ASCII, and those are only lower-cased.
    """
    lowered = F.lower(F.col(column))
    bare = F.translate(F.regexp_replace(lowered, r"\p{Mn}+", ""), _ACCENTED, _PLAIN)
    return F.when(F.length(column) == F.octet_length(column), lowered).otherwise(bare)
