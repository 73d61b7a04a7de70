"""Tokens with their offsets; comments vanish here."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import AdqlSyntaxError

_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)"
    r"|(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)"
    r"|(?P<string>'(?:[^']|'')*')"
    r"|(?P<quoted>\"(?:[^\"]|\"\")+\")"
    r"|(?P<name>[A-Za-z_][A-Za-z0-9_$]*)"
    r"|(?P<op><>|!=|<=|>=|\|\||[-+*/%<>=(),.;])",
    re.S,
)

#: Words that can be no bare name.
RESERVED = frozenset(
    (
        "ALL AND ANY AS ASC BETWEEN BY CASE CAST CROSS DESC DISTINCT ELSE END ESCAPE EXCEPT EXISTS FALSE FROM FULL "
        "GROUP HAVING ILIKE IN INNER INTERSECT IS JOIN LEFT LIKE LIMIT NATURAL NOT NULL OFFSET ON OR ORDER OUTER "
        "QUALIFY RIGHT SELECT THEN TOP TRUE UNION USING WHEN WHERE WITH OVER PARTITION LATERAL ASOF POSITIONAL UNNEST"
    ).split()
)


@dataclass(frozen=True)
class Token:
    kind: str  # number, string, name, quoted, op, end
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            what = "Unterminated literal" if text[at] in "'\"" else f"Unexpected character {text[at]!r}"
            raise AdqlSyntaxError(what, at)
        kind = m.lastgroup
        if kind == "string":
            out.append(Token("string", m[0][1:-1].replace("''", "'"), at))
        elif kind == "quoted":
            out.append(Token("quoted", m[0][1:-1].replace('""', '"'), at))
        elif kind != "space":
            out.append(Token(kind, m[0], at))
        at = m.end()
    # What ends too early is reported where its last token stands.
    out.append(Token("end", "", out[-1].at if out else 0))
    return out
