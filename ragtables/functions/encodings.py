"""Encodings of stored files, told from patterns of their bytes, and their texts. On the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least share of two-byte units of a text in UTF-16 without a mark whose high byte is that of an alphabet from Latin to Arabic.
ALPHABET_SHARE = 0.5
FIRST_UNITS = 64

_WINDOWS = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
# Patterns over the hex digits of whole units. A pattern goes on unit by unit, so none of them starts within one.
_ALPHABET = {"UTF-16LE": "..0[0-6]", "UTF-16BE": "0[0-6].."}
_PAIR = {"UTF-16LE": "..D[89AB]..D[C-F]", "UTF-16BE": "D[89AB]..D[C-F].."}
_ALONE = {"UTF-16LE": "..D[89A-F]", "UTF-16BE": "D[89A-F].."}
_CHARACTER = {"UTF-32LE": "..(?:(?:[0-9A-CEF].|D[0-7])00|..(?:0[1-9A-F]|10))00", "UTF-32BE": "00(?:00(?:[0-9A-CEF].|D[0-7])|(?:0[1-9A-F]|10)..).."}


def _kept(digits: Column, pattern: str) -> Column:
    """The units that the group of the pattern holds."""
    return F.regexp_replace(digits, pattern, "$1")


def _whole_utf32(digits: Column, charset: str) -> Column:
    def whole(units):
        return F.regexp_replace(units, f"{_CHARACTER[charset]}|(.{{8}})", "$1") == ""

    # The first units tell other encodings apart before all are looked at.
    return (F.length(digits) % 8 == 0) & whole(F.substring(digits, 1, 8 * FIRST_UNITS)) & whole(digits)


def _whole_utf16(digits: Column, charset: str) -> Column:
    return (F.length(digits) % 4 == 0) & (_kept(digits, f"{_PAIR[charset]}|({_ALONE[charset]})|.{{4}}") == "")


def _alphabet_share(digits: Column, charset: str) -> Column:
    return F.length(_kept(digits, f"({_ALPHABET[charset]})|.{{4}}")) / F.length(digits)


def detect_encoding(content: Column) -> Column:
    """'UTF-8', 'UTF-16' or 'UTF-32' after a mark, these two with 'LE' or 'BE' without one, or 'windows-1252'; NULL for NULL.

    Valid UTF-8 without NUL bytes is UTF-8. A text in UTF-32 consists of whole characters. Of the two orders of UTF-16 that
    are well formed the one with the larger share of units from alphabets wins; it must reach ``ALPHABET_SHARE``, so
    ideographs need a mark. Whatever is left is UTF-8 if valid, else single bytes. A name of UTF-16 or UTF-32 is given only
    to bytes that decode without error. Whole files are counted, of up to 1 GB.
    """
    digits = F.hex(content)
    utf8 = F.is_valid_utf8(content.cast("string"))
    marked32 = (digits.startswith("FFFE0000") & _whole_utf32(digits, "UTF-32LE")) | (digits.startswith("0000FEFF") & _whole_utf32(digits, "UTF-32BE"))
    marked16 = (digits.startswith("FFFE") & _whole_utf16(digits, "UTF-16LE")) | (digits.startswith("FEFF") & _whole_utf16(digits, "UTF-16BE"))
    little, big = (F.when(_whole_utf16(digits, c), _alphabet_share(digits, c)).otherwise(0.0) for c in ("UTF-16LE", "UTF-16BE"))
    return (F.when(content.isNull(), F.lit(None).cast("string"))
            .when(utf8 & ~F.contains(content, F.unhex(F.lit("00"))), "UTF-8")
            .when(marked32, "UTF-32").when(marked16, "UTF-16")
            .when(_whole_utf32(digits, "UTF-32LE"), "UTF-32LE").when(_whole_utf32(digits, "UTF-32BE"), "UTF-32BE")
            .when((little >= ALPHABET_SHARE) & (little >= big), "UTF-16LE").when(big >= ALPHABET_SHARE, "UTF-16BE")
            .when(utf8, "UTF-8").otherwise("windows-1252"))


def decode_bytes(content: Column, charset: Column) -> Column:
    """Text of bytes in an encoding of :func:`detect_encoding`; marks of UTF-16 and UTF-32 go. The five bytes that
    windows-1252 leaves open stay control characters."""
    marked = F.concat(F.when(charset == "UTF-32LE", F.unhex(F.lit("FFFE0000"))).otherwise(F.unhex(F.lit("0000FEFF"))), content)
    single = F.translate(F.decode(content, "ISO-8859-1"), "".join(_WINDOWS), "".join(_WINDOWS.values()))
    return (F.when(charset == "UTF-8", content.cast("string"))
            .when(charset.isin("UTF-32LE", "UTF-32BE"), F.decode(marked, "UTF-32")).when(charset == "UTF-32", F.decode(content, "UTF-32"))
            .when(charset == "UTF-16", F.decode(content, "UTF-16"))
            .when(charset == "UTF-16LE", F.decode(content, "UTF-16LE")).when(charset == "UTF-16BE", F.decode(content, "UTF-16BE"))
            .when(charset == "windows-1252", single))
