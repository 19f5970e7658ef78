"""String helpers whose results follow the scanner's own notion of white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without ASCII white space at either end (`trim` alone would drop spaces only)."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def lines(text: Column) -> Column:
    """The lines of a text as an array; CR LF, CR and LF end a line."""
    return F.split(text, r"\r\n|\r|\n")


def decode_source(content: Column) -> Column:
    """UTF-8 if the bytes are valid, else Latin-1; newlines become LF."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"\r\n|\r", "\n")


def decode_manifest(content: Column) -> Column:
    """UTF-8 with bad bytes replaced; newlines become LF."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n|\r", "\n")


def extension(name: Column) -> Column:
    """The lower-case suffix from the last dot on; empty if the name has none or starts with its only dot."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^./]+)$", 1))


def quoted(text: Column) -> Column:
    """The first run between quote characters of any kind, or null."""
    found = F.regexp_extract(text, "['\"`]([^'\"`]+)['\"`]", 1)
    return F.when(found != "", found)
