"""Spherical predicates as Spark SQL text: no function calls leave the JVM.

Distances are haversine, in degrees. Polygons have great-circle edges and at
most a hemisphere. A point is inside if the signed angles that the edges span
at it sum to an odd number of turns (the angle at p between a and b is
``atan2(p.(a x b), a.b - (p.a)(p.b))``), which no winding order changes; the
antipode's turns are excluded by the polygon's own side of the sphere. A polygon
whose vertices lie on one great circle contains nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

Vector = tuple[float, float, float]

#: Vertices this close to one great circle enclose nothing.
FLAT = 1e-9
#: A vertex this close to an edge (radians) touches it.
TOUCH = 1e-9


def number(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)" if not math.isfinite(x) else f"{x!r}D"


def hav(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    """Angular distance of two positions, in degrees."""
    return (
        f"(2D * degrees(asin(least(1D, sqrt(power(sin(radians(({dec2}) - ({dec1})) / 2D), 2D)"
        f" + cos(radians({dec1})) * cos(radians({dec2})) * power(sin(radians(({ra2}) - ({ra1})) / 2D), 2D))))))"
    )


def ra_separation(ra1: str, ra2: str) -> str:
    """Distance in right ascension across the 0/360 seam."""
    return f"abs(({ra1}) - ({ra2}) - 360D * round((({ra1}) - ({ra2})) / 360D))"


def ra_half_width(dec0: float, radius: float) -> float:
    """No point within ``radius`` of (., dec0) is further off in RA."""
    if abs(dec0) + radius >= 89.999:
        return 180.0
    ratio = math.sin(math.radians(radius)) / math.cos(math.radians(dec0))
    return 180.0 if ratio >= 1 else min(180.0, math.degrees(math.asin(ratio)) * (1 + 1e-9) + 1e-9)


def cone_literal(ra: str, dec: str, ra0: float, dec0: float, radius: float) -> str:
    """Within a constant cone. The declination band and, away from the seam,
    the right ascension band are plain comparisons that reach the scan."""
    low, high = max(-90.0, dec0 - radius - 1e-9), min(90.0, dec0 + radius + 1e-9)
    parts = [f"({dec}) BETWEEN {number(low)} AND {number(high)}"]
    half = ra_half_width(dec0, radius)
    if half < 180:
        left, right = (ra0 - half) % 360, (ra0 + half) % 360
        if left <= right:
            parts.append(f"(({ra}) < 0D OR ({ra}) >= 360D OR ({ra}) BETWEEN {number(left)} AND {number(right)})")
        else:
            parts.append(f"(({ra}) <= {number(right)} OR ({ra}) >= {number(left)})")
    parts.append(f"{hav(ra, dec, number(ra0), number(dec0))} <= {number(radius)}")
    return "(" + " AND ".join(parts) + ")"


def cone(ra: str, dec: str, ra0: str, dec0: str, radius: str) -> str:
    """Within a cone whose centre or radius are expressions."""
    return (
        f"(({radius}) >= 0D AND ({dec}) BETWEEN greatest(-90D, ({dec0}) - ({radius}) - 1e-9D)"
        f" AND least(90D, ({dec0}) + ({radius}) + 1e-9D) AND {hav(ra, dec, ra0, dec0)} <= ({radius}))"
    )


def unit(ra: float, dec: float) -> Vector:
    a, d = math.radians(ra), math.radians(dec)
    return math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)


def dot(a: Vector, b: Vector) -> float:
    return sum(x * y for x, y in zip(a, b, strict=True))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def bounding_cap(vertices: list[tuple[float, float]]) -> tuple[float, float, float]:
    """Centre and radius (degrees) of a cap that holds the polygon: edges of
    less than half a turn bulge over their ends by no more than the margin
    that their own half length needs."""
    vs = [unit(*v) for v in vertices]
    sums = [sum(c) for c in zip(*vs, strict=True)]
    length = math.sqrt(sum(c * c for c in sums))
    if length < 1e-9:
        return 0.0, 0.0, 180.0
    c = tuple(x / length for x in sums)
    ra, dec = math.degrees(math.atan2(c[1], c[0])) % 360, math.degrees(math.asin(max(-1.0, min(1.0, c[2]))))
    reach = max(math.degrees(math.acos(max(-1.0, min(1.0, dot(c, v))))) for v in vs)
    # A cap under a quarter turn is convex: it holds the edges with their ends.
    return ra, dec, 180.0 if reach >= 89.9 else reach + 1e-6


# --- native expressions -----------------------------------------------------
# A prepared polygon is struct(n, flat, sx, sy, sz, e): its count of vertices,
# whether they lie on one great circle, their sum, and its edges, each with its
# ends u and v, its normal n = u x v, d = u.v and q = n.n. A literal is prepared
# here, a region column once for each row (null where it is no polygon).

_EDGE = ("ux", "uy", "uz", "vx", "vy", "vz", "nx", "ny", "nz", "d", "q")


def literal_polygon(vertices: list[tuple[float, float]]) -> str:
    vs = [unit(*v) for v in vertices]
    normal = next((n for v in vs[1:] if math.sqrt(dot(n := cross(vs[0], v), n)) > 1e-12), None)
    flat = normal is None or all(abs(dot(v, normal)) / math.sqrt(dot(normal, normal)) < FLAT for v in vs)
    edges = []
    for u, v in zip(vs, vs[1:] + vs[:1], strict=True):
        n = cross(u, v)
        values = (*u, *v, *n, dot(u, v), dot(n, n))
        edges.append("named_struct(" + ", ".join(f"'{k}', {number(x)}" for k, x in zip(_EDGE, values, strict=True)) + ")")
    sums = [sum(c) for c in zip(*vs, strict=True)]
    return (
        f"named_struct('n', {len(vs)}, 'flat', {str(flat).lower()}, 'sx', {number(sums[0])}, 'sy', {number(sums[1])},"
        f" 'sz', {number(sums[2])}, 'e', array({', '.join(edges)}))"
    )


def polygon(ras: list[str], decs: list[str]) -> str:
    """A polygon whose coordinates are expressions."""
    return prepare(f"array({', '.join(vector(a, d) for a, d in zip(ras, decs, strict=True))})")


def vector(ra: str, dec: str) -> str:
    return (
        f"named_struct('x', cos(radians({dec})) * cos(radians({ra})), 'y', cos(radians({dec})) * sin(radians({ra})),"
        f" 'z', sin(radians({dec})))"
    )


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once under ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def sealed(body: Callable[..., str], *inputs: str) -> str:
    """``body`` of names that stand for the inputs: these are worked out outside
    of its lambdas, whose variables could hide a column or alias of their name."""
    struct = "named_struct(" + ", ".join(f"'i{k}', {x}" for k, x in enumerate(inputs)) + ")"
    return bind(struct, "__in", body(*(f"__in.i{k}" for k in range(len(inputs)))))


def prepare(vectors: str) -> str:
    """A prepared polygon of an array of struct(x, y, z)."""
    x, y, z = (f"(u.{a} * v.{b} - u.{b} * v.{a})" for a, b in (("y", "z"), ("z", "x"), ("x", "y")))
    edge = (
        "named_struct('ux', u.x, 'uy', u.y, 'uz', u.z, 'vx', v.x, 'vy', v.y, 'vz', v.z, 'nx', m.x, 'ny', m.y, 'nz', m.z,"
        " 'd', u.x * v.x + u.y * v.y + u.z * v.z, 'q', m.x * m.x + m.y * m.y + m.z * m.z)"
    )
    normal = f"named_struct('x', {x}, 'y', {y}, 'z', {z})"
    one = bind("get(vs, k)", "u", bind("get(vs, (k + 1) % size(vs))", "v", bind(normal, "m", edge)))
    edges = f"transform(sequence(0, size(vs) - 1), k -> {one})"
    total = [f"aggregate(es, 0D, (s, e) -> s + e.u{c})" for c in "xyz"]
    # Flat: every vertex lies on the circle of the first edge that has one.
    first = "get(filter(es, e -> e.q > 1e-24D), 0)"
    flat = bind(
        first,
        "f",
        f"f IS NULL OR forall(es, e -> abs(e.ux * f.nx + e.uy * f.ny + e.uz * f.nz) < {FLAT!r}D * sqrt(f.q))",
    )
    body = (
        f"named_struct('n', size(vs), 'flat', {flat}, 'sx', {total[0]}, 'sy', {total[1]}, 'sz', {total[2]}, 'e', es)"
    )
    return bind(vectors, "vs", bind(edges, "es", body))


def region_vectors(region: str) -> str:
    """The vertices of an STC-S ``POLYGON ICRS`` text as vectors; NULL where it
    is no such text, has an odd or too small count of numbers, or any is no number."""
    tokens = f"split(trim(regexp_replace({region}, '[ \\\\t\\\\r\\\\n]+', ' ')), ' ')"
    numbers = "transform(slice(ts, 3, greatest(size(ts) - 2, 0)), t -> try_cast(t AS DOUBLE))"
    sound = (
        "size(ts) >= 8 AND size(ts) % 2 = 0 AND upper(ts[0]) = 'POLYGON' AND upper(ts[1]) = 'ICRS'"
        " AND forall(ns, n -> n IS NOT NULL AND NOT isnan(n) AND abs(n) < 1e300D)"
    )
    pairs = f"transform(sequence(0, size(ns) DIV 2 - 1), k -> {vector('get(ns, 2 * k)', 'get(ns, 2 * k + 1)')})"
    return bind(tokens, "ts", bind(numbers, "ns", f"CASE WHEN {sound} THEN {pairs} END"))


def parse_region(region: str) -> str:
    """The prepared polygon of an STC-S text, or NULL."""
    return bind(region_vectors(region), "qs", f"CASE WHEN qs IS NOT NULL THEN {prepare('qs')} END")


def cap_of(vs: str) -> str:
    """struct(ra, dec, radius) of a cap that holds the polygon of some vertices
    (a bound name; degrees): around their sum, the whole sky where that is no use."""
    total = ", ".join(f"'{c}', aggregate({vs}, 0D, (s, v) -> s + v.{c})" for c in "xyz")
    length = "sqrt(o.x * o.x + o.y * o.y + o.z * o.z)"
    least = f"aggregate({vs}, 1D, (s, v) -> least(s, (v.x * o.x + v.y * o.y + v.z * o.z) / l))"
    cap = (
        "CASE WHEN l > 1e-9D AND m > 0.0017D THEN named_struct('ra', pmod(degrees(atan2(o.y, o.x)), 360D),"
        " 'dec', degrees(asin(greatest(-1D, least(1D, o.z / l)))),"
        " 'radius', degrees(acos(greatest(-1D, least(1D, m)))) + 1e-5D)"
        f" WHEN {vs} IS NOT NULL THEN named_struct('ra', 0D, 'dec', 0D, 'radius', 180D) END"
    )
    return bind(f"named_struct({total})", "o", bind(length, "l", bind(least, "m", cap)))


def _dot(e: str, part: str, x: str, y: str, z: str) -> str:
    return f"({e}.{part}x * {x} + {e}.{part}y * {y} + {e}.{part}z * {z})"


def inside(p: tuple[str, str, str], g: str, tag: str = "") -> str:
    """Whether a vector is in the prepared polygon ``g`` (a bound name)."""
    a, e = f"a{tag}", f"i{tag}"
    angle = f"atan2({_dot(e, 'n', *p)}, {e}.d - {_dot(e, 'u', *p)} * {_dot(e, 'v', *p)})"
    return (
        f"({g}.n >= 3 AND NOT {g}.flat AND {_dot(g, 's', *p)} > 0D"
        f" AND CAST(round(abs(aggregate({g}.e, 0D, ({a}, {e}) -> {a} + {angle})) / (2D * pi())) AS BIGINT) % 2 = 1)"
    )


_P = ("p.x", "p.y", "p.z")


def point_in_polygon(ra: str, dec: str, g: str) -> str:
    return sealed(lambda g, ra, dec: bind(g, "g", bind(vector(ra, dec), "p", inside(_P, "g"))), g, ra, dec)


def _near(c: tuple[str, str, str], e: str, radius: str) -> str:
    """Whether an edge comes within ``radius`` (radians) of a vector: its
    beginning by the chord, which keeps its digits where a cosine is flat, or
    its inner points by the distance from its great circle."""
    chord = " + ".join(f"power({x} - {e}.u{k}, 2D)" for x, k in zip(c, "xyz", strict=True))
    ends = f"({chord} <= 4D * power(sin(least(pi(), {radius}) / 2D), 2D))"
    off = _dot(e, "n", *c)
    band = f"({radius} >= pi() / 2D OR power({off}, 2D) <= power(sin({radius}), 2D) * {e}.q)"

    def triple(a: str, b: str) -> str:  # c . (a x b), a and b parts of the edge
        x, y, z = (f"({e}.{a}{i} * {e}.{b}{j} - {e}.{a}{j} * {e}.{b}{i})" for i, j in (("y", "z"), ("z", "x"), ("x", "y")))
        return f"({c[0]} * {x} + {c[1]} * {y} + {c[2]} * {z})"

    return f"({ends} OR ({e}.q > 1e-30D AND {band} AND {triple('n', 'u')} >= 0D AND {triple('v', 'n')} >= 0D))"


def circle_meets_polygon(ra0: str, dec0: str, radius: str, g: str) -> str:

    def body(g: str, ra0: str, dec0: str, radius: str) -> str:
        near = f"exists(g.e, e -> {_near(_P, 'e', f'radians({radius})')})"
        test = f"(g.n >= 3 AND ({radius}) >= 0D AND ({inside(_P, 'g')} OR {near}))"
        return bind(g, "g", bind(vector(ra0, dec0), "p", test))

    return sealed(body, g, ra0, dec0, radius)


def polygons_meet(first: str, second: str) -> str:
    """A vertex inside the other, edges that cross (the four orientations agree
    only at a crossing on the arcs' own side), or a vertex on an edge."""
    start = lambda e: (f"{e}.ux", f"{e}.uy", f"{e}.uz")
    s1, s2 = _dot("e", "n", "f.ux", "f.uy", "f.uz"), _dot("e", "n", "f.vx", "f.vy", "f.vz")
    s3, s4 = _dot("f", "n", "e.ux", "e.uy", "e.uz"), _dot("f", "n", "e.vx", "e.vy", "e.vz")
    crossing = f"exists(g.e, e -> exists(h.e, f -> {s1} * {s2} < 0D AND {s3} * {s4} < 0D AND {s1} * {s3} < 0D))"

    def touches(points: str, shape: str) -> str:
        return f"exists({points}.e, f -> exists({shape}.e, e -> {_near(start('f'), 'e', f'{TOUCH!r}D')}))"

    body = (
        f"(g.n >= 3 AND h.n >= 3 AND (exists(g.e, e -> {inside(start('e'), 'h', 'h')})"
        f" OR exists(h.e, e -> {inside(start('e'), 'g', 'g')}) OR {crossing} OR {touches('g', 'h')} OR {touches('h', 'g')}))"
    )
    return sealed(lambda first, second: bind(first, "g", bind(second, "h", body)), first, second)


# --- plain numbers (tests, pruning) ------------------------------------------


def separation(ra1: float, dec1: float, ra2: float, dec2: float) -> float:
    a, b = unit(ra1, dec1), unit(ra2, dec2)
    n = cross(a, b)
    return math.degrees(math.atan2(math.sqrt(dot(n, n)), dot(a, b)))
