"""Request parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..errors import InvalidParameterError
from ..output import negotiate

LANGUAGES = ("adql", "adql-2.0", "adql-2.1")


class Parameters:
    """Name-value pairs; names in any case, order kept."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.values: dict[str, list[str]] = {}
        for name, value in pairs:
            self.values.setdefault(name.strip().upper(), []).append(value)

    def every(self, name: str) -> list[str]:
        return self.values.get(name.upper(), [])

    def one(self, name: str) -> str | None:
        found = self.every(name)
        if len(found) > 1:
            raise InvalidParameterError(name.upper(), "given more than once")
        return found[0] if found else None

    def real(self, name: str, low: float, high: float) -> float:
        raw = (self.one(name) or "").strip()
        if not raw:
            raise InvalidParameterError(name, "required")
        x = number(name, raw)
        if not low <= x <= high:
            raise InvalidParameterError(name, f"must be between {low:g} and {high:g}")
        return x

    def maxrec(self) -> int | None:
        raw = (self.one("MAXREC") or "").strip()
        if not raw:
            return None
        try:
            n = int(raw)
        except ValueError:
            raise InvalidParameterError("MAXREC", f"{raw!r} is not an integer") from None
        if n < 0:
            raise InvalidParameterError("MAXREC", "must not be negative")
        return n


def number(name: str, raw: str) -> float:
    try:
        x = float(raw)
    except ValueError:
        raise InvalidParameterError(name, f"{raw!r} is not a number") from None
    if math.isnan(x):
        raise InvalidParameterError(name, "NaN is not allowed")
    return x


def numbers(name: str, raw: list[str]) -> list[float]:
    return [number(name, x) for x in raw]


@dataclass(frozen=True)
class TapRequest:
    query: str
    format: str
    maxrec: int | None = None
    runid: str | None = None
    uploads: dict[str, str] = field(default_factory=dict)  # table -> part


def tap_request(p: Parameters) -> TapRequest:
    request = p.one("REQUEST")
    if request is not None and request.strip().lower() != "doquery":
        raise InvalidParameterError("REQUEST", f"{request!r} is not doQuery")
    language = (p.one("LANG") or "").strip()
    if not language:
        raise InvalidParameterError("LANG", "required")
    if language.lower() not in LANGUAGES:
        raise InvalidParameterError("LANG", f"{language!r} is not supported; use ADQL")
    query = p.one("QUERY")
    if not (query or "").strip():
        raise InvalidParameterError("QUERY", "required")
    wanted = p.one("RESPONSEFORMAT")
    return TapRequest(
        query, negotiate(wanted if wanted is not None else p.one("FORMAT")), p.maxrec(), p.one("RUNID"), uploads(p)
    )


def uploads(p: Parameters) -> dict[str, str]:
    out: dict[str, str] = {}
    for value in p.every("UPLOAD"):
        for pair in filter(None, (x.strip() for x in value.split(";"))):
            name, comma, uri = (x.strip() for x in pair.partition(","))
            if not comma or not uri.lower().startswith("param:"):
                raise InvalidParameterError("UPLOAD", f"{pair!r} is not 'table,param:part'")
            name = name.lower()
            if not name.isidentifier():
                raise InvalidParameterError("UPLOAD", f"{name!r} is no table name")
            if name in out:
                raise InvalidParameterError("UPLOAD", f"table {name!r} is given more than once")
            out[name] = uri[len("param:") :]
    return out
