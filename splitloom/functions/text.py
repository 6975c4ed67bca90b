"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that both Java and RE2 count as such.
BLANK = r"[ \t\n\r\f]"
BLANKS = " \t\n\r\f"
# Ends of lines that are no white space here, but before which Java's $ matches, too.
LINE_ENDS = "\u0085\u2028\u2029"

# The bytes 0x80-0x9F of windows-1252, from Python's own codec.
_HIGH = [(bytes([b]).decode("cp1252", errors="ignore"), chr(b)) for b in range(0x80, 0xA0)]
_CONTROLS = "".join(control for char, control in _HIGH if char)
_CHARACTERS = "".join(char for char, _ in _HIGH if char)
_UNDEFINED = "".join(control for char, control in _HIGH if not char)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once per row, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def cp1252_is_undefined(content: Column) -> Column:
    """True if some byte has no meaning in windows-1252."""
    return latin1(content).rlike(f"[{_UNDEFINED}]")


def decode_cp1252(content: Column) -> Column:
    """Text of windows-1252 bytes. Check cp1252_is_undefined for strictness."""
    plain = latin1(content)
    # Most texts have none of these bytes, and finding that out is the cheaper part.
    return F.when(plain.rlike(r"[\x80-\x9F]"), F.translate(plain, _CONTROLS, _CHARACTERS)).otherwise(plain)


def encode_cp1252(text: Column) -> Column:
    """Windows-1252 bytes of a text that holds only characters of that set."""
    special = text.rlike(r"[^\x00-\xFF]")
    bytewise = F.when(special, F.translate(text, _CHARACTERS, _CONTROLS)).otherwise(text)
    return F.encode(bytewise, "ISO-8859-1")


def ends_with_any(text: Column, characters: str) -> Column:
    """Is the last character one of these?"""
    found = F.lit(False)
    for character in characters:
        found = found | text.endswith(character)
    return found


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space. No text, no sentence."""
    found = F.split(strip_blanks(text), f"(?<=[.!?]){BLANK}+")
    return F.filter(found, lambda sentence: sentence != "")


def chunked(items: Column, size: int) -> Column:
    """Groups of at most `size` neighbours, each joined by one space."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(size))
    chunks = F.transform(starts, lambda start: F.array_join(F.slice(items, start, size), " "))
    return F.when(F.size(items) > 0, chunks).otherwise(F.array().cast("array<string>"))


def remap(code: Column, mapping: Mapping[str, str]) -> Column:
    """Replace known codes and leave the others."""
    result = code
    for old, new in mapping.items():
        result = F.when(code == old, F.lit(new)).otherwise(result)
    return result
