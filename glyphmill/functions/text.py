"""Column functions over text: pre-tokens, special tokens, byte forms, and small string helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern. (?U) lets \s match all white space of Unicode.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stands between pieces while a text is taken apart.
MARK = "\u0001"


def pretokens(text: Column) -> Column:
    """ARRAY<STRING> of a text's pre-tokens; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(f"(?U){PATTERN}"), F.lit(0))


def marked_pretokens(text: Column) -> Column:
    """The text with MARK behind each pre-token."""
    return F.regexp_replace(text, f"(?U){PATTERN}", f"$0{MARK}")


def any_of(specials: Sequence[str]) -> str:
    """Pattern of any special token, the longest first, so that of overlapping ones the longer is kept."""
    return "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in sorted(set(specials), key=lambda s: (-len(s), s)))


def without_specials(text: Column, specials: Sequence[str]) -> Column:
    """Pieces between special tokens, which are dropped; the text itself if there are no special tokens."""
    return F.split(text, any_of(specials), -1) if specials else F.array(text)


def with_specials(text: Column, specials: Sequence[str]) -> Column:
    """Non-empty pieces in order, special tokens among them."""
    if not specials:
        return F.filter(F.array(text), lambda x: x != "")
    marked = F.regexp_replace(text, f"({any_of(specials)})", f"{MARK}$1{MARK}")
    return F.filter(F.split(marked, MARK, -1), lambda x: x != "")


def hex_tokens(piece: Column) -> Column:
    """A byte string as '<68><69>': one token a byte. '<' and '>' are no hex digits, so that replacing is merging."""
    return F.regexp_replace(F.hex(piece.cast("binary")), "(..)", "<$1>")


def apply_merge(tokens: Column, left: str, right: str) -> Column:
    """One merge on hex tokens: left to right, without overlap."""
    return F.replace(tokens, F.lit(f"<{left}><{right}>"), F.lit(f"<{left}{right}>"))


def token_list(tokens: Column) -> Column:
    """ARRAY<STRING> of the hex of each token."""
    return F.filter(F.split(F.regexp_replace(tokens, "[<>]+", " "), " "), lambda x: x != "")


def strip(text: Column) -> Column:
    """Without white space (of Unicode) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def last_newline(text: Column) -> Column:
    """0-based place of the last newline, -1 without one."""
    at = F.locate("\n", F.reverse(text))
    return F.when(at > 0, F.length(text) - at).otherwise(-1)


def to_text(data: Column) -> Column:
    """Bytes as UTF-8, each malformed sequence replaced by U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def preview(text: Column, size: int = 100) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def char_profile(token: Column) -> dict[str, Column]:
    """Flags of a token: space at its start, any white space, letters and digits only, punctuation, long."""
    bare = F.replace(token, F.lit(" "), F.lit(""))
    return {
        "leading_space": F.startswith(token, F.lit(" ")),
        "has_space": token.rlike(r"(?U)\s"),
        "alphanumeric": bare.rlike(r"(?U)^[\p{L}\p{N}]+$"),
        "punctuation": token.rlike(r"(?U)[^\s\p{L}\p{N}]"),
        "long": F.length(token) > 20,
    }


def byte_characters() -> list[str]:
    """Printable character of each byte, by rule: visible Latin-1 stays, the rest follows U+0100 in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in visible)}
    return [chr(shifted.get(b, b)) for b in range(256)]
