"""Native text expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space, and the characters from tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
GAP = f"[{SPACE}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.filter(F.split(whole(text), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words: the pieces between gaps, without the empty ones that a gap at either end leaves."""
    body = F.trim(F.translate(whole(text), "\t\n\x0b\x0c\r", "     "))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, " +"))).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.octet_length(text) == F.length(text)  # ASCII alone, which Spark lowers faster
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def single_spaced(line: Column) -> Column:
    """One space for each run of spaces in a line; most lines have only single ones."""
    odd = F.contains(line, F.lit("  "))
    for space in ("\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(line, F.lit(space))
    return F.when(odd, F.regexp_replace(line, GAP, " ")).otherwise(line)


def spaced_words(line: Column) -> Column:
    """Words of a line that is not empty and has one space between words."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
