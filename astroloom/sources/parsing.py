"""VOTable, ECSV and FITS binary tables from bytes, without further packages.

Each parser gives ``Parsed``: columns (name, TAP datatype, array flag and
metadata) and Arrow columns. Bytes come from Spark's binaryFile source, so any
file system that Spark reads will do.
"""

from __future__ import annotations

import base64
import csv
import gzip
import math
import re
import struct
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from ..errors import DiscoveryError

ARROW = {
    "boolean": pa.bool_(),
    "short": pa.int16(),
    "int": pa.int32(),
    "long": pa.int64(),
    "float": pa.float32(),
    "double": pa.float64(),
    "char": pa.string(),
}


@dataclass
class Field:
    name: str
    datatype: str
    is_array: bool = False
    unit: str | None = None
    ucd: str | None = None
    description: str | None = None
    utype: str | None = None
    xtype: str | None = None
    arraysize: str | None = None

    @property
    def arrow(self) -> pa.DataType:
        kind = ARROW[self.datatype]
        return pa.list_(kind) if self.is_array else kind


@dataclass
class Parsed:
    fields: list[Field]
    columns: list[pa.Array]
    hdu: int | None = None
    primary_key: str | None = None
    description: str | None = None
    extra: dict = field(default_factory=dict)

    def batch(self, names: list[str] | None = None) -> pa.RecordBatch:
        by_name = {f.name: c for f, c in zip(self.fields, self.columns, strict=True)}
        names = names or list(by_name)
        return pa.RecordBatch.from_arrays([by_name[n] for n in names], names)


# --- VOTable -------------------------------------------------------------------

_VOT = {
    "boolean": "boolean",
    "unsignedByte": "short",
    "short": "short",
    "int": "int",
    "long": "long",
    "float": "float",
    "double": "double",
    "char": "char",
    "unicodeChar": "char",
}
_WIDTH = {"boolean": 1, "unsignedByte": 1, "short": 2, "int": 4, "long": 8, "float": 4, "double": 8, "char": 1, "unicodeChar": 2}
_PACK = {"unsignedByte": "B", "short": "h", "int": "i", "long": "q", "float": "f", "double": "d"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_votable(raw: bytes) -> Parsed:
    if b"<!ENTITY" in raw[:65536]:
        raise DiscoveryError("VOTable with entity definitions")
    try:
        root = ET.fromstring(raw)
    except ET.ParseError as e:
        raise DiscoveryError(f"not a VOTable: {e}") from None
    table = next((e for e in root.iter() if _local(e.tag) == "TABLE"), None)
    if _local(root.tag) != "VOTABLE" or table is None:
        raise DiscoveryError("no TABLE in this VOTable")
    fields, raws = [], []
    for e in table:
        if _local(e.tag) != "FIELD":
            continue
        raw_kind = e.get("datatype", "char")
        if raw_kind not in _VOT:
            raise DiscoveryError(f"VOTable datatype {raw_kind!r} is not supported")
        size = e.get("arraysize")
        kind = _VOT[raw_kind]
        text = next((d.text for d in e if _local(d.tag) == "DESCRIPTION"), None)
        nulls = next((v.get("null") for v in e if _local(v.tag) == "VALUES"), None)
        is_array = bool(size and size != "1" and kind != "char")
        name = e.get("name") or e.get("ID") or f"col{len(fields) + 1}"
        fields.append(
            Field(name, kind, is_array, e.get("unit"), e.get("ucd"), text, e.get("utype"), e.get("xtype"), size)
        )
        raws.append((raw_kind, size, nulls))
    data = next((e for e in table if _local(e.tag) == "DATA"), None)
    rows: list[list] = []
    for form in data if data is not None else []:
        tag = _local(form.tag)
        if tag == "TABLEDATA":
            rows = [
                [_cell(td.text, *r, f.is_array) for td, r, f in zip(tr, raws, fields, strict=False)]
                for tr in form
                if _local(tr.tag) == "TR"
            ]
        elif tag in ("BINARY", "BINARY2"):
            stream = next(s for s in form if _local(s.tag) == "STREAM")
            if stream.get("href"):
                raise DiscoveryError("VOTable with an external stream")
            rows = _binary_rows(base64.b64decode(stream.text or ""), raws, fields, tag == "BINARY2")
        elif tag == "FITS":
            raise DiscoveryError("VOTable with an embedded FITS stream")
    rows = [r + [None] * (len(fields) - len(r)) for r in rows]
    columns = [pa.array([r[i] for r in rows], f.arrow) for i, f in enumerate(fields)]
    return Parsed(fields, columns)


def _scalar(text: str, kind: str):
    if kind == "boolean":
        return {"t": True, "1": True, "true": True, "f": False, "0": False, "false": False}.get(text.lower())
    if kind in ("float", "double"):
        return float(text)
    return int(text, 16) if text.lower().startswith("0x") else int(text)


def _cell(text: str | None, kind: str, size: str | None, nulls: str | None, is_array: bool):
    text = text or ""
    if kind in ("char", "unicodeChar"):
        return text
    text = text.strip()
    if not text or text == nulls or text.lower() == "null":
        return None
    if is_array:
        return [_scalar(x, kind) for x in text.split()]
    return _scalar(text, kind)


def _binary_rows(raw: bytes, raws: list, fields: list[Field], flags: bool) -> list[list]:
    out, at, n_flags = [], 0, (len(fields) + 7) // 8
    while at < len(raw):
        missing = b""
        if flags:
            missing, at = raw[at : at + n_flags], at + n_flags
        row = []
        for i, (kind, size, nulls) in enumerate(raws):
            count, text = _count(size)
            if count is None:
                (count,) = struct.unpack_from(">i", raw, at)
                at += 4
            end = at + count * _WIDTH[kind]
            if end > len(raw):
                raise DiscoveryError("VOTable binary stream ends within a row")
            block, at = raw[at:end], end
            if flags and missing[i // 8] >> (7 - i % 8) & 1:
                row.append(None)
            elif kind == "char":
                row.append(block.split(b"\0")[0].decode("utf-8", "replace"))
            elif kind == "unicodeChar":
                row.append(block.decode("utf-16-be", "replace").split("\0")[0])
            elif kind == "boolean":
                values = [{84: True, 116: True, 49: True, 70: False, 102: False, 48: False}.get(b) for b in block]
                row.append(values if fields[i].is_array else values[0])
            else:
                values = list(struct.unpack(f">{count}{_PACK[kind]}", block))
                if nulls is not None and not fields[i].is_array and str(values[0]) == nulls:
                    values = [None]
                row.append(values if fields[i].is_array else values[0])
        out.append(row)
    return out


def _count(size: str | None) -> tuple[int | None, bool]:
    """Elements of a cell, None where the cell says so itself."""
    if not size:
        return 1, False
    if "*" in size:
        return None, True
    return math.prod(int(x) for x in size.split("x")), True


# --- ECSV ------------------------------------------------------------------------

_ECSV = {
    "bool": "boolean",
    "int8": "short",
    "int16": "short",
    "uint8": "short",
    "int32": "int",
    "uint16": "int",
    "int64": "long",
    "uint32": "long",
    "uint64": "long",
    "float16": "float",
    "float32": "float",
    "float64": "double",
    "float128": "double",
    "string": "char",
}


def parse_ecsv(raw: bytes) -> Parsed:
    import yaml

    lines = raw.decode("utf-8").splitlines()
    if not lines or not re.match(r"#\s*%ECSV", lines[0]):
        raise DiscoveryError("not an ECSV file: it has no %ECSV line")
    head = []
    for line in lines[1:]:
        if not line.startswith("#"):
            break
        head.append(line[2:] if line.startswith("# ") else line[1:])
    try:
        known = yaml.safe_load("\n".join(x for x in head if x.strip() != "---")) or {}
    except yaml.YAMLError as e:
        raise DiscoveryError(f"ECSV header is not YAML: {e}") from None
    body = [x for x in lines[len(head) + 1 :] if x.strip() and not x.startswith("#")]
    rows = list(csv.reader(body, delimiter=known.get("delimiter", " "), skipinitialspace=True))
    specs = {c["name"]: c for c in known.get("datatype") or []}
    names = rows[0] if rows else list(specs)
    fields, columns = [], []
    for i, name in enumerate(names):
        spec = specs.get(name, {})
        kind = _ECSV.get(spec.get("datatype", "string"), "char")
        fields.append(Field(name, kind, False, spec.get("unit"), (spec.get("meta") or {}).get("ucd"), spec.get("description")))
        cells = [r[i] if i < len(r) else "" for r in rows[1:]]
        if kind == "char":
            values = cells
        else:
            values = [None if x == "" else _scalar(x, kind) for x in cells]
        columns.append(pa.array(values, ARROW[kind]))
    return Parsed(fields, columns, description=(known.get("meta") or {}).get("description") if isinstance(known.get("meta"), dict) else None)


# --- FITS -------------------------------------------------------------------------

BLOCK = 2880
_FITS = {"L": ("?", 1), "B": ("u1", 1), "I": (">i2", 2), "J": (">i4", 4), "K": (">i8", 8), "E": (">f4", 4), "D": (">f8", 8), "A": ("S", 1)}
_FITS_TAP = {"L": "boolean", "B": "short", "I": "short", "J": "int", "K": "long", "E": "float", "D": "double", "A": "char"}


def card_value(text: str):
    text = text.strip()
    if text.startswith("'"):
        m = re.match(r"'((?:[^']|'')*)'", text)
        return (m[1] if m else text[1:]).replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    if not text:
        return None
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E").replace("d", "e"))
        except ValueError:
            return text


def read_header(raw: bytes, at: int) -> tuple[dict, int]:
    """The cards of the header at ``at``, and where its data begins."""
    cards: dict = {}
    while True:
        block = raw[at : at + BLOCK]
        if len(block) < BLOCK:
            raise DiscoveryError("FITS header ends early")
        at += BLOCK
        for i in range(0, BLOCK, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= " and key:
                cards.setdefault(key, card_value(card[10:]))
            elif key == "CONTINUE" and cards:
                last = next(reversed(cards))
                if isinstance(cards[last], str):
                    cards[last] = cards[last].removesuffix("&") + str(card_value(card[8:]) or "")


def data_bytes(cards: dict) -> int:
    n = cards.get("NAXIS", 0)
    if not n:
        return 0
    size = math.prod(int(cards.get(f"NAXIS{k}", 0)) for k in range(1, n + 1))
    if cards.get("GROUPS") is True and cards.get("NAXIS1") == 0:
        size = math.prod(int(cards.get(f"NAXIS{k}", 0)) for k in range(2, n + 1))
    return abs(int(cards.get("BITPIX", 8))) // 8 * int(cards.get("GCOUNT", 1)) * (int(cards.get("PCOUNT", 0)) + size)


def hdus(raw: bytes) -> list[tuple[dict, int]]:
    """(cards, where the data begins) of every HDU."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if not raw.startswith(b"SIMPLE  ="):
        raise DiscoveryError("not a FITS file: no SIMPLE card")
    out, at = [], 0
    while at + BLOCK <= len(raw):
        cards, start = read_header(raw, at)
        out.append((cards, start))
        at = start + -(-data_bytes(cards) // BLOCK) * BLOCK
    return out


def parse_fits(raw: bytes, hdu: int | None = None) -> list[Parsed]:
    """Every binary table, or the one of HDU ``hdu``."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    return [
        _bintable(raw, cards, start, k)
        for k, (cards, start) in enumerate(hdus(raw))
        if str(cards.get("XTENSION", "")).strip() == "BINTABLE" and (hdu is None or k == hdu)
    ]


def _bintable(raw: bytes, cards: dict, start: int, hdu: int) -> Parsed:
    rows, width = int(cards["NAXIS2"]), int(cards["NAXIS1"])
    if start + rows * width > len(raw):
        raise DiscoveryError(f"FITS table in HDU {hdu} ends early")
    parts, fields, plans = [], [], []
    for i in range(1, int(cards.get("TFIELDS", 0)) + 1):
        m = re.match(r"(\d*)([A-Z])", str(cards.get(f"TFORM{i}", "")).strip())
        if not m or m[2] not in _FITS:
            raise DiscoveryError(f"FITS column format {cards.get(f'TFORM{i}')!r} is not supported")
        count, letter = int(m[1] or 1), m[2]
        kind, size = _FITS[letter]
        name = str(cards.get(f"TTYPE{i}") or f"col{i}")
        shape = ()
        if letter == "A":
            parts.append((f"f{i}", f"S{max(count, 1)}") if count else (f"f{i}", "S1", (0,)))
        elif count == 1:
            parts.append((f"f{i}", kind))
        else:
            parts.append((f"f{i}", kind, (count,)))
            dims = re.findall(r"\d+", str(cards.get(f"TDIM{i}", "")))
            shape = tuple(map(int, reversed(dims))) if dims and math.prod(map(int, dims)) == count else (count,)
        scale, zero = cards.get(f"TSCAL{i}", 1), cards.get(f"TZERO{i}", 0)
        tap = _FITS_TAP[letter]
        if letter in "BIJK" and (scale, zero) != (1, 0):
            unsigned = scale == 1 and zero in (-128, 1 << 15, 1 << 31, 1 << 63)
            tap = {"B": "short", "I": "int", "J": "long", "K": "long"}[letter] if unsigned else "double"
        size_text = "x".join(map(str, shape)) if shape else ("*" if letter == "A" else None)
        fields.append(
            Field(name, tap, bool(shape), cards.get(f"TUNIT{i}"), cards.get(f"TUCD{i}"), cards.get(f"TCOMM{i}"), None, None, size_text)
        )
        plans.append((letter, scale, zero, cards.get(f"TNULL{i}"), shape))
    dtype = np.dtype(parts)
    if dtype.itemsize != width:
        raise DiscoveryError(f"FITS table rows of {width} bytes, but the columns take {dtype.itemsize}")
    table = np.frombuffer(raw, dtype, rows, start)
    columns = [_fits_column(table[f"f{i}"], f, p) for i, (f, p) in enumerate(zip(fields, plans, strict=True), 1)]
    return Parsed(fields, columns, hdu)


def _fits_column(values: np.ndarray, f: Field, plan: tuple) -> pa.Array:
    letter, scale, zero, null, shape = plan
    if letter == "A":
        if values.ndim > 1:
            return pa.array([""] * len(values), pa.string())
        return pa.array([v.split(b"\0")[0].decode("ascii", "replace").rstrip() for v in values.tolist()], pa.string())
    mask = None
    if letter == "L":
        codes = values.view(np.uint8)
        mask, values = codes == 0, codes == ord("T")
    else:
        values = values.astype(values.dtype.newbyteorder("="))
        if null is not None and letter in "BIJK":
            mask = values == null
        if (scale, zero) != (1, 0):
            if f.datatype == "double" or letter in "ED":
                values = values * float(scale) + float(zero)
            else:  # unsigned integers are stored shifted
                values = values.astype(np.int64) if letter != "K" else values.astype(object)
                values = values + int(zero)
    if shape:
        kind = f.arrow
        return pa.array([v.tolist() for v in values.reshape(len(values), -1)], kind)
    if values.dtype == object:
        return pa.array([None if mask is not None and mask[i] else int(v) for i, v in enumerate(values)], f.arrow)
    return pa.array(values, mask=mask).cast(f.arrow)


PARSERS = {"votable": lambda raw: [parse_votable(raw)], "ecsv": lambda raw: [parse_ecsv(raw)], "fits": parse_fits}


def parse(kind: str, raw: bytes) -> list[Parsed]:
    try:
        return PARSERS[kind](raw)
    except DiscoveryError:
        raise
    except Exception as e:  # noqa: BLE001
        raise DiscoveryError(f"cannot be read as {kind}: {e}") from e


