"""Service descriptions: capabilities, availability, tables, examples."""

from __future__ import annotations

from html import escape as html
from xml.sax.saxutils import escape, quoteattr

from ..adql.translate import AGGREGATES, SCALARS
from ..engine import ASYNC_TIMEOUT, DEFAULT_MAXREC, HARD_MAXREC, SYNC_TIMEOUT, Engine
from ..output.formats import ALIASES, CONTENT_TYPES
from ..registry import Registry

GEOMETRY = "POINT CIRCLE POLYGON CONTAINS INTERSECTS DISTANCE COORD1 COORD2 COORDSYS".split()
_TYPES = {"short": "smallint", "int": "integer", "long": "bigint", "float": "real", "double": "double", "boolean": "boolean", "char": "char"}


def availability(up: bool = True, note: str = "") -> bytes:
    more = f"<vosi:note>{escape(note)}</vosi:note>" if note else ""
    return (
        '<?xml version="1.0" encoding="utf-8"?>\n<vosi:availability xmlns:vosi="http://www.ivoa.net/xml/VOSIAvailability/v1.0">'
        f"<vosi:available>{'true' if up else 'false'}</vosi:available>{more}</vosi:availability>\n"
    ).encode()


def capabilities(base_url: str) -> bytes:
    base = base_url.rstrip("/")

    def interface(url: str, kind: str = "vs:ParamHTTP", role: str = ' role="std"', version: str = "") -> str:
        return (
            f'<interface xsi:type="{kind}"{role}{version}><accessURL use="base">{escape(base + url)}</accessURL></interface>'
        )

    def feature(kind: str, names: list[str]) -> str:
        items = "".join(f"<feature><form>{escape(n)}</form></feature>" for n in names)
        return f'<languageFeatures type="ivo://ivoa.net/std/TAPRegExt#features-{kind}">{items}</languageFeatures>'

    formats = ""
    for kind, mime in CONTENT_TYPES.items():
        names = "".join(f"<alias>{escape(a)}</alias>" for a, k in ALIASES.items() if k == kind and "/" not in a)
        formats += f"<outputFormat><mime>{escape(mime)}</mime>{names}</outputFormat>"
    tap = (
        '<capability standardID="ivo://ivoa.net/std/TAP" xsi:type="tr:TableAccess">'
        + interface("/tap", version=' version="1.1"')
        + "<language><name>ADQL</name>"
        + '<version ivo-id="ivo://ivoa.net/std/ADQL#v2.0">2.0</version><version ivo-id="ivo://ivoa.net/std/ADQL#v2.1">2.1</version>'
        + "<description>ADQL, positions in ICRS</description>"
        + feature("adqlgeo", GEOMETRY)
        + feature("adql-string", ["LOWER", "UPPER", "ILIKE"])
        + feature("adql-common-table", ["WITH"])
        + "</language>"
        + formats
        + '<uploadMethod ivo-id="ivo://ivoa.net/std/TAPRegExt#upload-inline"/>'
        + f"<retentionPeriod><default>86400</default></retentionPeriod><executionDuration><default>{int(SYNC_TIMEOUT)}</default><hard>{int(ASYNC_TIMEOUT)}</hard></executionDuration>"
        + f'<outputLimit><default unit="row">{DEFAULT_MAXREC}</default><hard unit="row">{HARD_MAXREC}</hard></outputLimit>'
        + "</capability>"
    )
    simple = [
        ("ivo://ivoa.net/std/VOSI#capabilities", "/capabilities"),
        ("ivo://ivoa.net/std/VOSI#availability", "/availability"),
        ("ivo://ivoa.net/std/VOSI#tables-1.1", "/tables"),
        ("ivo://ivoa.net/std/DALI#examples", "/examples"),
        ("ivo://ivoa.net/std/SIA#query-2.0", "/sia2/query"),
        ("ivo://ivoa.net/std/DataLink#links-1.1", "/datalink/links"),
        ("ivo://ivoa.net/std/SODA#sync-1.0", "/soda/sync"),
    ]
    others = "".join(f'<capability standardID="{i}">{interface(u)}</capability>' for i, u in simple)
    return (
        '<?xml version="1.0" encoding="utf-8"?>\n<vosi:capabilities xmlns:vosi="http://www.ivoa.net/xml/VOSICapabilities/v1.0" '
        'xmlns:tr="http://www.ivoa.net/xml/TAPRegExt/v1.0" xmlns:vs="http://www.ivoa.net/xml/VODataService/v1.1" '
        f'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">{tap}{others}</vosi:capabilities>\n'
    ).encode()


def tables(registry: Registry) -> bytes:
    def tag(name: str, text) -> str:
        return f"<{name}>{escape(str(text))}</{name}>" if text else ""

    out = []
    for schema in sorted({t.schema for t in registry.tables.values()}):
        out.append(f"<schema><name>{escape(schema)}</name>")
        for t in sorted((t for t in registry.tables.values() if t.schema == schema), key=lambda t: t.name):
            out.append(f'<table type="base_table"><name>{escape(t.qualified)}</name>{tag("description", t.description)}{tag("utype", t.utype)}')
            for c in t.columns:
                size = f" arraysize={quoteattr(c.arraysize)}" if c.arraysize else ""
                flag = "<flag>indexed</flag>" if c.indexed else "<flag>primary</flag>" if c.name == t.primary_key else ""
                out.append(
                    f'<column std="{"true" if c.std else "false"}"><name>{escape(c.name)}</name>{tag("description", c.description)}'
                    f'{tag("unit", c.unit)}{tag("ucd", c.ucd)}{tag("utype", c.utype)}'
                    f'<dataType xsi:type="vs:VOTableType"{size}>{c.datatype}</dataType>{flag}</column>'
                )
            out.append("</table>")
        out.append("</schema>")
    return (
        '<?xml version="1.0" encoding="utf-8"?>\n<vosi:tableset xmlns:vosi="http://www.ivoa.net/xml/VOSITables/v1.0" '
        'xmlns:vs="http://www.ivoa.net/xml/VODataService/v1.1" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">'
        + "".join(out)
        + "</vosi:tableset>\n"
    ).encode()


def examples(engine: Engine, most: int = 3) -> bytes:
    """Queries for up to three tables, those with positions first."""
    own = [t for t in engine.registry.tables.values() if t.schema not in ("tap_schema", "caom", "ivoa", "service")]
    own.sort(key=lambda t: (not t.ra_column, t.qualified))
    items = []
    for t in own[:most]:
        query = f"SELECT TOP 10 * FROM {t.qualified}"
        if t.ra_column and t.dec_column:
            ra, dec = f'"{t.ra_column}"', f'"{t.dec_column}"'
            first = engine.run(
                f"SELECT TOP 1 {ra} AS a, {dec} AS d FROM {t.qualified} WHERE {ra} IS NOT NULL AND {dec} IS NOT NULL"
            ).table.to_pylist()
            if first:
                query = (
                    f"SELECT TOP 10 * FROM {t.qualified} WHERE CONTAINS(POINT('ICRS', {ra}, {dec}),"
                    f" CIRCLE('ICRS', {first[0]['a']!r}, {first[0]['d']!r}, 0.5)) = 1"
                )
        items.append(
            f'<div typeof="example" id="{html(t.qualified.replace(".", "-"))}" resource="#{html(t.qualified.replace(".", "-"))}">'
            f'<h2 property="name">{html(t.qualified)}</h2><pre property="query">{html(query)}</pre></div>'
        )
    return (
        '<!DOCTYPE html><html><head><meta charset="utf-8"/><title>Examples</title></head>'
        '<body vocab="http://www.ivoa.net/rdf/examples#">' + "".join(items) + "</body></html>"
    ).encode()


def function_names() -> list[str]:
    return sorted(SCALARS | AGGREGATES)
