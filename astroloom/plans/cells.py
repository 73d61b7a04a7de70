"""Sky cells as an equi-key for joins by distance or region.

The sky is cut into declination zones of a given height, a zone into equal cells
in right ascension, fewer towards the poles. A position is in one cell; a circle
is put into every cell that it can touch. Positions and circles then meet by an
ordinary join on the cell, and the exact predicate stays in the query.

A join by a constant radius has one height, the radius. Circles of other radii
and regions (their bounding caps) have the height of their own level, so that
each is put into a dozen cells or so, whatever its size; a position is put into
one cell of each level that occurs on the other side, six at most. Cells of the
coarse levels, and of wide radii, are salted: positions are dealt over the salts
by a hash, circles stand in all of them.

Regions meet regions as texts: each text once, however many rows have it. The
pairs of texts that meet are then an ordinary join away from the rows.
"""

from __future__ import annotations

from ..functions import sphere

#: Cell heights in degrees by level, and over how many salts a level's cells are dealt.
HEIGHTS = (180.0, 30.0, 5.0, 5 / 6, 5 / 36, 5 / 216)
SALTS = (32, 8, 1, 1, 1, 1)
#: Zones no narrower than this keep cell numbers small.
LEAST_HEIGHT = 1.0 / 60
#: From this radius on the cells of a constant radius are salted.
WIDE, WIDE_SALTS = 10.0, 16

CELL = "__sky_cell"
REGION = "__sky_region"
CAP = "__sky_cap"
CELLS = "__sky_cells"
LEVELS = "__sky_levels"
TEXT = "__sky_text"

_ZONE, _LEVEL = 100_000_000, 1_000_000_000_000


def height(radius: float) -> float:
    return max(radius * 1.0000001, LEAST_HEIGHT)


def _h(h: float | str) -> str:
    return h if isinstance(h, str) else f"{h!r}D"


def _zone(dec: str, h: float | str) -> str:
    return f"CAST(floor(({dec} + 90D) / {_h(h)}) AS BIGINT)"


def _count(zone: str, h: float | str) -> str:
    """Cells of a zone: at its edge nearer to a pole they span ``h`` at least."""
    edge = f"least(90D, greatest(abs({zone} * {_h(h)} - 90D), abs(({zone} + 1) * {_h(h)} - 90D)))"
    return f"CAST(greatest(1D, floor(360D * cos(radians({edge})) / {_h(h)})) AS BIGINT)"


def _cell(ra: str, dec: str, h: float | str) -> str:
    zone = _zone(dec, h)
    n = _count(zone, h)
    cell = f"least({n} - 1, CAST(floor(pmod(CAST({ra} AS DOUBLE), 360D) * {n} / 360D) AS BIGINT))"
    return f"({zone} * {_ZONE} + {cell})"


def touched(ra: str, dec: str, radius: str, h: float | str) -> str:
    """The cells that a circle can touch, each once."""
    return sphere.sealed(_touched, ra, dec, radius, _h(h))


def _touched(ra: str, dec: str, radius: str, h: str) -> str:
    half = (
        f"CASE WHEN abs({dec}) + {radius} >= 89.9D THEN 180D"
        f" ELSE degrees(asin(least(1D, sin(radians({radius})) / cos(radians({dec}))))) + 1e-7D END"
    )
    low, high = _zone(f"greatest(-90D, {dec} - {radius})", h), _zone(f"least(90D, {dec} + {radius})", h)
    first = "CAST(floor((a - w) * n / 360D) AS BIGINT)"
    last = "CAST(floor((a + w) * n / 360D) AS BIGINT)"
    # All cells of a zone at most; what rounds up to 360 is put into the last one.
    row = f"transform(sequence({first}, least({last}, {first} + n - 1)), k -> z * {_ZONE} + pmod(k, n))"
    zones = f"transform(sequence({low}, {high}), z -> {sphere.bind(_count('z', h), 'n', row)})"
    around = sphere.bind(f"pmod(CAST({ra} AS DOUBLE), 360D)", "a", sphere.bind(half, "w", zones))
    return f"array_distinct(flatten({around}))"


def _dealt(ra: str, dec: str, salts: int) -> str:
    return f"pmod(xxhash64({ra}, {dec}), {salts})" if salts > 1 else "0"


def _salted(cells: str, salts: str) -> str:
    """Cells in every salt from 0 to ``salts`` - 1."""
    return f"flatten(transform(sequence(0, {salts} - 1), __s -> transform({cells}, __c -> __c + __s * {_LEVEL})))"


# --- one height --------------------------------------------------------------


def _wide(radius: float) -> int:
    return WIDE_SALTS if radius >= WIDE else 1


def point_cell(ra: str, dec: str, radius: float) -> str:
    """The cell of a position, for a constant radius."""
    return f"({_cell(ra, dec, height(radius))} + {_dealt(ra, dec, _wide(radius))} * {_LEVEL})"


def circle_cells(ra: str, dec: str, radius: float) -> str:
    """The cells that a circle of a constant radius can touch."""
    cells = touched(ra, dec, f"{min(180.0, radius * 1.0000001 + 1e-7)!r}D", height(radius))
    return cells if _wide(radius) == 1 else _salted(cells, str(_wide(radius)))


# --- levels ------------------------------------------------------------------


def level_of(radius: str) -> str:
    """The finest level whose cells are as high as ``radius``; NULL where that is NULL or negative."""
    whens = " ".join(f"WHEN {radius} <= {h!r}D THEN {k}" for k, h in reversed(list(enumerate(HEIGHTS))) if k)
    return f"CASE WHEN {radius} IS NULL OR {radius} < 0D THEN NULL {whens} ELSE 0 END"


def _of_level(level: str, values: tuple) -> str:
    return f"element_at(array({', '.join(_h(v) if isinstance(v, float) else str(v) for v in values)}), {level} + 1)"


def point_keys(ra: str, dec: str, levels: str) -> str:
    """A key for each of ``levels`` (an array) that a position is in."""
    keys = [
        f"IF(array_contains({levels}, {k}), {_cell(ra, dec, h)} + ({k * 64} + {_dealt(ra, dec, SALTS[k])}) * {_LEVEL}, NULL)"
        for k, h in enumerate(HEIGHTS)
    ]
    return f"filter(array({', '.join(keys)}), __x -> __x IS NOT NULL)"


def _own(ra: str, dec: str, radius: str, level: str) -> str:
    """The unsalted keys of the cells that a circle touches at a level (a bound name)."""
    cells = touched(ra, dec, radius, _of_level(level, HEIGHTS))
    return f"transform({cells}, __c -> __c + {level} * 64 * {_LEVEL})"


def _reach(radius: str) -> str:
    """A radius with room for rounding; NULL where it is negative."""
    return f"IF({radius} >= 0, least(180D, CAST({radius} AS DOUBLE) * 1.0000001D + 1e-7D), NULL)"


def circle_keys(ra: str, dec: str, radius: str) -> str:
    """The keys of a circle whose radius is an expression, at its own level."""

    def body(ra: str, dec: str, r: str, l: str) -> str:  # noqa: E741
        keys = _salted(_own(ra, dec, r, l), _of_level(l, SALTS))
        return f"CASE WHEN {l} IS NOT NULL AND {ra} IS NOT NULL AND {dec} IS NOT NULL THEN {keys} END"

    return sphere.sealed(body, ra, dec, _reach(radius), level_of(_reach(radius)))


def levels_of_circles(source: str, radius: str) -> str:
    """The levels that a table's circles have, as one array: a scalar subquery."""
    return f"(SELECT collect_set(l) FROM (SELECT {level_of(_reach(radius))} AS l FROM {source}))"


def region_struct(region: str) -> str:
    """A region parsed once: its polygon g, bounding cap c and level l."""
    whole = f"CASE WHEN qs IS NOT NULL THEN named_struct('g', {sphere.prepare('qs')}, 'c', c, 'l', {level_of('c.radius')}) END"
    return sphere.bind(sphere.region_vectors(region), "qs", sphere.bind(sphere.cap_of("qs"), "c", whole))


def levels_of_regions(source: str, region: str) -> str:
    """The levels of a table's regions, as one array: a scalar subquery."""
    level = sphere.bind(sphere.region_vectors(region), "qs", sphere.bind(sphere.cap_of("qs"), "c", level_of("c.radius")))
    return f"(SELECT collect_set(l) FROM (SELECT {level} AS l FROM {source}))"


def parsed_once(source: str, region: str, name: str) -> str:
    """SQL of a table with a region's struct. The draw is always true: it keeps
    the optimizer from copying the whole expression into the null filters that it
    infers from the join."""
    return f"SELECT *, IF(rand(0) >= 0D, {region_struct(region)}, NULL) AS {name} FROM {source}"


def region_keys(s: str) -> str:
    """The keys of a region (its struct) for positions; one that holds nothing has none."""
    keys = _salted(_own(f"{s}.c.ra", f"{s}.c.dec", f"{s}.c.radius", f"{s}.l"), _of_level(f"{s}.l", SALTS))
    return f"CASE WHEN {s}.l IS NOT NULL AND NOT {s}.g.flat THEN {keys} END"


def region_cells(s: str, levels: str) -> str:
    """struct(key, own) of the cells that a region touches at its own level and
    at the coarser ones of the other side's regions. Two regions meet at the
    coarser of their levels."""
    all_levels = f"array_distinct(concat(array({s}.l), filter({levels}, k -> k < {s}.l)))"
    cells = f"transform({_own(f'{s}.c.ra', f'{s}.c.dec', f'{s}.c.radius', 'k')}, x -> named_struct('key', x, 'own', k = {s}.l))"
    return f"CASE WHEN {s}.l IS NOT NULL THEN flatten(transform({all_levels}, k -> {cells})) END"


def dealt_cells(cells: str, s: str) -> str:
    """Salts for regions that meet regions: at its own level a region stands in
    all of them, at a coarser one in one."""
    salts = _of_level(f"CAST(x.key DIV {64 * _LEVEL} AS INT)", SALTS)
    one = f"CAST(pmod(xxhash64({s}.c.ra, {s}.c.dec, {s}.c.radius), {salts}) AS BIGINT)"
    at = f"CASE WHEN x.own THEN sequence(0L, CAST({salts} AS BIGINT) - 1L) ELSE array({one}) END"
    return f"flatten(transform({cells}, x -> transform({at}, t -> named_struct('key', x.key + t * {_LEVEL}, 'cell', x.key, 'salt', t, 'own', x.own))))"


def first_meeting(one: str, other: str, cells: str, other_cells: str) -> str:
    """Whether this is the one cell and salt in which a pair counts: not a coarse
    cell of both, the first salt of two at home, and the least of the cells that
    both touch at this level."""
    level = f"{one}.cell DIV {64 * _LEVEL}"
    common = f"array_intersect(transform({cells}, __x -> __x.key), transform({other_cells}, __x -> __x.key))"
    return (
        f"({one}.own OR {other}.own) AND (NOT ({one}.own AND {other}.own) OR {one}.salt = 0)"
        f" AND {one}.cell = array_min(filter({common}, __x -> __x DIV {64 * _LEVEL} = {level}))"
    )


def meeting(one: str, other: str, spread: bool) -> str:
    """SQL of the pairs of texts (one, other), each once, whose regions meet.
    ``one`` and ``other`` are tables of distinct texts; ``spread`` asks for a
    shuffle by cell, as their few rows make costly tests."""
    sides = []
    for source, there in ((one, other), (other, one)):
        # A generator, as the optimizer moves no filter and copies no expression through it.
        parsed = f"SELECT * FROM {source} LATERAL VIEW explode(array({region_struct(TEXT)})) __v AS {REGION}"
        sql = f"SELECT *, {levels_of_regions(there, TEXT)} AS {LEVELS} FROM ({parsed})"
        sql = f"SELECT *, {region_cells(REGION, LEVELS)} AS {CELLS} FROM ({sql})"
        sides.append(f"(SELECT *, explode({dealt_cells(CELLS, REGION)}) AS {CELL} FROM ({sql}))")
    caps = [f"{t}.{REGION}.c" for t in ("__a", "__b")]
    apart = sphere.hav(f"{caps[0]}.ra", f"{caps[0]}.dec", f"{caps[1]}.ra", f"{caps[1]}.dec")
    tests = [f"__a.{CELL}.key = __b.{CELL}.key", f"{apart} <= {caps[0]}.radius + {caps[1]}.radius"]
    tests.append(first_meeting(f"__a.{CELL}", f"__b.{CELL}", f"__a.{CELLS}", f"__b.{CELLS}"))
    tests.append(sphere.polygons_meet(f"__a.{REGION}.g", f"__b.{REGION}.g"))
    hint = "/*+ MERGE(__b) */ " if spread else ""
    return f"SELECT {hint}__a.{TEXT} AS one, __b.{TEXT} AS other FROM {sides[0]} AS __a JOIN {sides[1]} AS __b ON {' AND '.join(tests)}"


def met(region: str, pairs: str, name: str, spread: bool) -> str:
    """SQL of a table with a copy of each row for each text that its region
    meets; a row that meets none stays, with NULL."""
    hint = "/*+ MERGE(__p) */ " if spread else ""
    return f"SELECT {hint}__t.*, __p.other AS {name} FROM {{source}} AS __t LEFT JOIN ({pairs}) AS __p ON __p.one = __t.{region}"


# --- outer joins -------------------------------------------------------------


def numbered(source: str, name: str) -> str:
    """A table as rows in one struct column, each with a number."""
    return f"(SELECT struct(*) AS {name}, monotonically_increasing_id() AS `__id_{name.strip('`')}` FROM {source})"


def whole_outer(left: str, right: str, a: str, b: str, kind: str, on: str) -> str:
    """``left`` and ``right`` (numbered, with copies of a row for several cells)
    joined by an outer join: all pairs, and one row for each row without any."""
    ia, ib = (f"`__id_{x.strip('`')}`" for x in (a, b))
    sides = {"LEFT": [(ia, ib)], "RIGHT": [(ib, ia)], "FULL": [(ia, ib), (ib, ia)]}[kind]
    windows, keep = "", "m"
    for k, (own, other) in enumerate(sides):
        part = f"PARTITION BY coalesce({own}, -1 - {other})"
        windows += f", max(m) OVER ({part}) AS m{k}, row_number() OVER ({part} ORDER BY {other}) AS n{k}"
        keep += f" OR ({other} IS NULL AND NOT m{k} AND n{k} = 1)"
    pairs = f"SELECT {a}, {b}, {ia}, {ib}, {ia} IS NOT NULL AND {ib} IS NOT NULL AS m FROM ({left}) AS __l {kind} JOIN ({right}) AS __r ON {on}"
    return f"SELECT {a}, {b} FROM (SELECT *{windows} FROM ({pairs})) WHERE {keep}"
