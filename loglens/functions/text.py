"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters of the log format (all of Unicode's, and the four
# separators U+001C..U+001F), as a character class and as a plain list.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACES = "".join(chr(c) for c in [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
])


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(text, F.lit(_SPACES))


#: A blank that isn't a single space.
_LOOSE = SPACE.replace(r"\x20", r"\x1f") + "|  "


def squeeze(text: Column) -> Column:
    """Every run of white space as one space. Few texts have to be rewritten, and asking is cheaper."""
    return F.when(text.rlike(_LOOSE), F.regexp_replace(text, SPACE + "+", " ")).otherwise(text)


def truncate(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def ellipsize(text: Column, length: int) -> Column:
    """Cut to ``length`` and mark the cut; shorter texts stay as they are."""
    return F.when(F.length(text) > length, F.concat(truncate(text, length), F.lit("..."))).otherwise(text)


def clean_caption(text: Column, length: int = 65) -> Column:
    """Drop hexadecimal constants, squeeze blanks, cut."""
    no_hex = F.regexp_replace(text, "0x[0-9a-fA-F]+", "")
    return truncate(strip(F.regexp_replace(no_hex, SPACE + "+", " ")), length)


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def mask_digits(text: Column) -> Column:
    """Replace every blank-separated token that holds a digit by a wildcard. Matching starts at token
    starts only, so a long token without digits is scanned once, and a text without digits isn't rewritten."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"(?<!\S)\S*?[0-9]\S*", "<*>")).otherwise(text)


def tokens(text: Column) -> Column:
    return F.split(text, " +")
