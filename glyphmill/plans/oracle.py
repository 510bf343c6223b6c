"""DuckDB forms of the shared parts of the queries."""

from __future__ import annotations

from collections.abc import Sequence

WS = r" \t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def pretokens(text: str) -> str:
    """RE2 has no lookahead: the last white space of a run is first parted from the run by a mark."""
    pattern = rf"''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+"
    return rf"flatten(list_transform(string_split(regexp_replace({text}, '([{WS}])([{WS}][^{WS}])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_extract_all(x, '{pattern}')))"


def hex_tokens(piece: str) -> str:
    return rf"regexp_replace(hex(encode({piece})), '(..)', '<\1>', 'g')"


def merged(tokens: str, merges: Sequence[tuple[bytes, bytes]]) -> str:
    for a, b in merges:
        tokens = f"replace({tokens}, '<{a.hex().upper()}><{b.hex().upper()}>', '<{(a + b).hex().upper()}>')"
    return tokens


def token_list(tokens: str) -> str:
    return f"list_filter(string_split(replace(replace({tokens}, '<', ''), '>', ' '), ' '), lambda x: x <> '')"


def counts(table: str = "documents") -> str:
    return f"SELECT pretoken, count(*) AS n FROM (SELECT unnest({pretokens('text')}) AS pretoken FROM {table}) GROUP BY pretoken"


def vocabulary(tokens: Sequence[bytes]) -> str:
    """(token_id, token_hex): 256 bytes, then the given tokens."""
    more = ", ".join(f"({256 + i}, '{t.hex().upper()}')" for i, t in enumerate(tokens))
    return f"SELECT CAST(range AS INTEGER) AS token_id, printf('%02X', range) AS token_hex FROM range(256)" + (f" UNION ALL SELECT * FROM (VALUES {more})" if more else "")


def pieces(text: str, special: str) -> str:
    """Non-empty pieces around one special token, which stays as a piece."""
    return f"list_filter(string_split(replace({text}, '{special}', chr(2) || '{special}' || chr(2)), chr(2)), lambda x: x <> '')"


def encoded(text: str, merges: Sequence[tuple[bytes, bytes]], special: str | None = None) -> str:
    """List of token hex; a special token's hex is that of its bytes in angle brackets, as one token."""
    words = lambda t: f"flatten(list_transform({pretokens(t)}, lambda w: {token_list(merged(hex_tokens('w'), merges))}))"
    if special is None:
        return words(text)
    return f"flatten(list_transform({pieces(text, special)}, lambda p: CASE WHEN p = '{special}' THEN ['{special.encode().hex().upper()}'] ELSE {words('p')} END))"
