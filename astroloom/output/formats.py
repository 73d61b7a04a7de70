"""Negotiation and the six serialisations of a result."""

from __future__ import annotations

import base64
import datetime as dt
import io
import json
import math
import struct
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.csv
import pyarrow.parquet as pq

from ..errors import ServiceError, UnsupportedFormatError
from ..model import ColumnMeta

VOTABLE, VOTABLE_TD, CSV, TSV, PARQUET, JSON = "votable", "votable/td", "csv", "tsv", "parquet", "json"

# The names a client may use for each format.
ALIASES = {
    "votable": VOTABLE,
    "votable/b2": VOTABLE,
    "votable/binary2": VOTABLE,
    "application/x-votable+xml": VOTABLE,
    "application/x-votable+xml;serialization=binary2": VOTABLE,
    "votable/td": VOTABLE_TD,
    "tabledata": VOTABLE_TD,
    "application/x-votable+xml;serialization=tabledata": VOTABLE_TD,
    "csv": CSV,
    "text/csv": CSV,
    "text/csv;header=present": CSV,
    "tsv": TSV,
    "text/tab-separated-values": TSV,
    "parquet": PARQUET,
    "application/x-parquet": PARQUET,
    "application/vnd.apache.parquet": PARQUET,
    "json": JSON,
    "application/json": JSON,
}
CONTENT_TYPES = {
    VOTABLE: "application/x-votable+xml",
    VOTABLE_TD: "application/x-votable+xml;serialization=tabledata",
    CSV: "text/csv;header=present",
    TSV: "text/tab-separated-values",
    PARQUET: "application/vnd.apache.parquet",
    JSON: "application/json",
}


def negotiate(asked: str | None) -> str:
    key = "".join((asked or "").split()).lower()
    if not key:
        return VOTABLE
    if key not in ALIASES:
        raise UnsupportedFormatError(asked, sorted(CONTENT_TYPES))
    return ALIASES[key]


def content_type(kind: str) -> str:
    return CONTENT_TYPES[kind]


def serialize(table: pa.Table, kind: str, columns: Iterable[ColumnMeta] = (), overflow: bool = False) -> bytes:
    known = {c.name.lower(): c for c in columns}
    metas = [known.get(n.lower()) or ColumnMeta(n) for n in table.column_names]
    if kind in (VOTABLE, VOTABLE_TD):
        return _votable(table, metas, kind == VOTABLE, overflow)
    if kind in (CSV, TSV):
        return _delimited(table, "," if kind == CSV else "\t")
    if kind == PARQUET:
        out = io.BytesIO()
        pq.write_table(_plain(table), out, compression="snappy")
        return out.getvalue()
    return _json(table, metas)


def error_document(error: Exception | str) -> bytes:
    message = error.message if isinstance(error, ServiceError) else str(error)
    return _document(
        f'<INFO name="QUERY_STATUS" value="ERROR">{escape(_legal(message))}</INFO>', ""
    )


def _legal(text: str) -> str:
    """Without the characters that XML cannot hold."""
    return "".join(c for c in text if c in "\t\n\r" or "\x20" <= c <= "퟿" or "" <= c <= "�" or c > "￿")


# --- delimited and JSON ------------------------------------------------------------


def _text_of(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bytes):
        return v.hex()
    if isinstance(v, dict):  # a geometry value, as its numbers
        return " ".join(str(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return " ".join("" if x is None else str(x) for x in v)
    return str(v)


def _plain(table: pa.Table) -> pa.Table:
    """Structs, lists and intervals as text; all else as it is."""
    out = []
    for c in table.columns:
        t = c.type
        if pa.types.is_struct(t) or pa.types.is_map(t) or pa.types.is_interval(t) or pa.types.is_duration(t):
            out.append(pa.array([_text_of(v) for v in c.to_pylist()], pa.string()))
        else:
            out.append(c)
    return pa.Table.from_arrays(out, names=table.column_names)


def _delimited(table: pa.Table, separator: str) -> bytes:
    columns = []
    for c in table.columns:
        t = c.type
        if pa.types.is_string(t) or pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_boolean(t):
            columns.append(c)
        else:
            columns.append(pa.array([_text_of(v) for v in c.to_pylist()], pa.string()))
    out = io.BytesIO()
    # The header is written by hand: names are bare unless they need quotes.
    out.write((separator.join(_quote(n, separator) for n in table.column_names) + "\n").encode())
    if table.num_rows:
        options = pa.csv.WriteOptions(include_header=False, delimiter=separator, quoting_style="needed")
        pa.csv.write_csv(pa.Table.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))]), out, options)
    return out.getvalue()


def _quote(name: str, separator: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in f'{separator}"\n\r') else name


def _json(table: pa.Table, metas: list[ColumnMeta]) -> bytes:
    def value(v):
        if isinstance(v, float):
            return v if math.isfinite(v) else None
        if isinstance(v, bytes):
            return v.decode("utf-8", "replace")
        if isinstance(v, (list, tuple)):
            return [value(x) for x in v]
        if isinstance(v, dict):
            return {k: value(x) for k, x in v.items()}
        if v is None or isinstance(v, (bool, int, str)):
            return v
        return float(v) if hasattr(v, "as_tuple") else _text_of(v)

    head = [
        {"name": n, "datatype": _tap(t), "unit": m.unit, "ucd": m.ucd, "description": m.description}
        for n, t, m in zip(table.column_names, table.schema.types, metas, strict=True)
    ]
    columns = [[value(v) for v in c.to_pylist()] for c in table.columns]
    rows = [list(r) for r in zip(*columns, strict=True)] if columns else []
    return json.dumps({"metadata": head, "data": rows}, allow_nan=False).encode()


def _tap(t: pa.DataType) -> str:
    if pa.types.is_boolean(t):
        return "boolean"
    if t in (pa.int8(), pa.int16(), pa.uint8()):
        return "short"
    if t in (pa.int32(), pa.uint16()):
        return "int"
    if pa.types.is_integer(t):
        return "long"
    if t == pa.float32():
        return "float"
    return "double" if pa.types.is_floating(t) or pa.types.is_decimal(t) else "char"


# --- VOTable -----------------------------------------------------------------------

_CODE = {"boolean": None, "short": "h", "int": "i", "long": "q", "float": "f", "double": "d"}
_NONE = {"boolean": b"?", "short": b"\0" * 2, "int": b"\0" * 4, "long": b"\0" * 8, "float": b"\x7f\xc0\0\0", "double": b"\x7f\xf8" + b"\0" * 6}


def _document(results: str, body: str) -> bytes:
    return (
        '<?xml version="1.0" encoding="utf-8"?>\n'
        '<VOTABLE version="1.4" xmlns="http://www.ivoa.net/xml/VOTable/v1.3">\n'
        f' <RESOURCE type="results">\n  {results}\n{body} </RESOURCE>\n</VOTABLE>\n'
    ).encode()


def _votable(table: pa.Table, metas: list[ColumnMeta], binary: bool, overflow: bool) -> bytes:
    kinds, heads = [], []
    for name, t, m in zip(table.column_names, table.schema.types, metas, strict=True):
        item = t.value_type if pa.types.is_list(t) or pa.types.is_large_list(t) else t
        kind = _tap(item)
        is_list = item is not t and kind != "char"
        kinds.append((kind, is_list))
        xtype = m.xtype or ("timestamp" if pa.types.is_timestamp(t) or pa.types.is_date(t) else None)
        if pa.types.is_struct(t):
            names = [t.field(i).name for i in range(t.num_fields)]
            xtype = {("ra", "dec"): "point", ("ra", "dec", "radius"): "circle"}.get(tuple(names), xtype)
            kinds[-1] = ("struct", True) if xtype in ("point", "circle") else ("char", False)
            kind = "double" if kinds[-1][0] == "struct" else "char"
        size = "*" if kind == "char" or is_list or kinds[-1][0] == "struct" else None
        attributes = [("name", name), ("datatype", kind), ("arraysize", size), ("unit", m.unit), ("ucd", m.ucd), ("utype", m.utype), ("xtype", xtype)]
        text = " ".join(f"{k}={quoteattr(_legal(v))}" for k, v in attributes if v)
        inner = f"<DESCRIPTION>{escape(_legal(m.description))}</DESCRIPTION>" if m.description else ""
        heads.append(f"   <FIELD {text}>{inner}</FIELD>\n" if inner else f"   <FIELD {text}/>\n")
    columns = [c.to_pylist() for c in table.columns]
    data = _binary2(columns, kinds) if binary else _tabledata(columns, kinds)
    flag = '  <INFO name="QUERY_STATUS" value="OVERFLOW"/>\n' if overflow else ""
    body = "  <TABLE>\n" + "".join(heads) + f"   <DATA>\n{data}   </DATA>\n  </TABLE>\n{flag}"
    return _document('<INFO name="QUERY_STATUS" value="OK"/>', body)


def _numbers(v, kind: str):
    return list(v.values()) if kind == "struct" else list(v)


def _binary2(columns: list[list], kinds: list[tuple[str, bool]]) -> str:
    out = bytearray()
    n = len(kinds)
    for row in zip(*columns, strict=True):
        flags = bytearray((n + 7) // 8)
        cells = []
        for i, (v, (kind, is_list)) in enumerate(zip(row, kinds, strict=True)):
            if kind == "char":  # text has no null of its own: it is empty
                raw = _legal(_text_of(v) or "").encode()
                cells.append(struct.pack(">i", len(raw)) + raw)
                continue
            if v is None:
                flags[i // 8] |= 0x80 >> i % 8
                cells.append(struct.pack(">i", 0) if is_list else _NONE[kind])
                continue
            own = "double" if kind == "struct" else kind
            values = _numbers(v, kind) if is_list else [v]
            head = struct.pack(">i", len(values)) if is_list else b""
            if own == "boolean":
                cells.append(head + b"".join(b"?" if x is None else b"T" if x else b"F" for x in values))
            else:
                cells.append(head + b"".join(_NONE[own] if x is None else struct.pack(">" + _CODE[own], float(x) if own in ("float", "double") else x) for x in values))
        out += flags
        for c in cells:
            out += c
    text = base64.b64encode(bytes(out)).decode()
    return f'    <BINARY2><STREAM encoding="base64">{text}</STREAM></BINARY2>\n'


def _tabledata(columns: list[list], kinds: list[tuple[str, bool]]) -> str:
    def cell(v, kind: str, is_list: bool) -> str:
        if v is None:
            return ""
        if kind == "char":
            return escape(_legal(_text_of(v)))
        if is_list:
            return " ".join("NaN" if x is None else _number(x) for x in _numbers(v, kind))
        return _number(v)

    rows = (
        "<TR>" + "".join(f"<TD>{cell(v, *k)}</TD>" for v, k in zip(row, kinds, strict=True)) + "</TR>\n"
        for row in zip(*columns, strict=True)
    )
    return "    <TABLEDATA>\n" + "".join(rows) + "    </TABLEDATA>\n"


def _number(x) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else "+Inf" if x == math.inf else "-Inf" if x == -math.inf else repr(x)
    return str(x)
