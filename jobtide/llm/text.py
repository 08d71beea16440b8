"""Column expressions on whole texts that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of all word and line definitions: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACES_PATTERN = r"[\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    by_letter = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(by_letter)


def words(text: Column) -> Column:
    """The words of a text; an empty array where it has none."""
    core = stripped(text)
    return F.when(core != "", F.split(core, SPACES_PATTERN)).otherwise(
        F.array().cast("array<string>")
    )


def lines(text: Column) -> Column:
    """The text cut at line feeds; an empty text is one empty line."""
    return F.split(text, "\n")


def text_hash(text: Column) -> Column:
    """Tells documents with one id but different texts apart."""
    return F.xxhash64(text)
