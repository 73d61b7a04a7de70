"""Nested HEALPix pixels (Gorski et al. 2005): centres and bounding caps."""

from __future__ import annotations

import math

from .sphere import bind, sealed, separation

# Fixed values of the projection: ring and longitude offsets of the 12 faces.
_RING = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
_LONGITUDE = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def _face_position(face: int, x: float, y: float) -> tuple[float, float]:
    """RA, Dec (degrees) of a point of a face, x and y from 0 to 1."""
    ring = _RING[face] - x - y
    if ring < 1:
        width = ring
        z = 1 - width * width / 3
    elif ring > 3:
        width = 4 - ring
        z = width * width / 3 - 1
    else:
        width = 1.0
        z = (2 - ring) * 2 / 3
    along = (_LONGITUDE[face] * width + x - y) % 8
    ra = 0.0 if width < 1e-15 else 45.0 * along / width
    return ra % 360, math.degrees(math.asin(max(-1.0, min(1.0, z))))


def _place(order: int, pixel: int) -> tuple[int, int, int]:
    if not 0 <= pixel < 12 << 2 * order:
        raise ValueError(f"no pixel {pixel} at order {order}")
    face, rest = divmod(pixel, 1 << 2 * order)
    x = y = 0
    for bit in range(order):
        x |= (rest >> 2 * bit & 1) << bit
        y |= (rest >> 2 * bit + 1 & 1) << bit
    return face, x, y


def centre(order: int, pixel: int) -> tuple[float, float]:
    face, x, y = _place(order, pixel)
    n = 1 << order
    return _face_position(face, (x + 0.5) / n, (y + 0.5) / n)


def cap(order: int, pixel: int, steps: int = 8) -> tuple[float, float, float]:
    """A cap that holds the whole pixel: its centre, and the distance of the
    farthest of many boundary points with a margin for those in between."""
    face, x, y = _place(order, pixel)
    n = 1 << order
    ra, dec = centre(order, pixel)
    far = 0.0
    for k in range(steps + 1):
        s = k / steps
        for u, v in ((s, 0), (s, 1), (0, s), (1, s)):
            far = max(far, separation(ra, dec, *_face_position(face, (x + u) / n, (y + v) / n)))
    return ra, dec, min(180.0, far * 1.01 + 1e-6)


def pixel_of(order: int, ra: float, dec: float) -> int:
    """The nested pixel of a position."""
    z, lon = math.sin(math.radians(dec)), (ra % 360) / 90
    n = 1 << order
    if abs(z) <= 2 / 3:
        a, b = n * (0.5 + lon), n * z * 0.75
        up, down = int(a - b), int(a + b)
        fu, fd = up // n, down // n
        face = (fu | 4) if fu == fd else fu if fu < fd else fd + 8
        x, y = down % n, n - 1 - up % n
        face = face % 12 if fu == fd and face >= 12 else face
        if fu == fd:
            face = 4 if fu == 4 else fu + 4
    else:
        quarter = min(3, int(lon))
        t = lon - quarter
        # 1 - |z| loses digits next to a pole; the half angle does not.
        w = n * math.sqrt(6) * math.sin(math.radians((90 - abs(dec)) / 2))
        up, down = min(n - 1, int(t * w)), min(n - 1, int((1 - t) * w))
        if z >= 0:
            face, x, y = quarter, n - 1 - down, n - 1 - up
        else:
            face, x, y = quarter + 8, up, down
    out = face << 2 * order
    for bit in range(order):
        out |= (x >> bit & 1) << 2 * bit | (y >> bit & 1) << 2 * bit + 1
    return out


def pixel_sql(order: int, ra: str, dec: str) -> str:
    """``pixel_of`` as a Spark SQL expression: no row leaves the JVM."""
    n = 1 << order

    def body(ra: str, dec: str) -> str:
        lon = f"(pmod({ra}, 360D) / 90D)"
        a, b = f"{n}D * (0.5D + {lon})", f"{n}D * sin(radians({dec})) * 0.75D"
        belt = bind(
            f"named_struct('u', CAST(floor({a} - {b}) AS BIGINT), 'd', CAST(floor({a} + {b}) AS BIGINT))",
            "h",
            bind(
                f"named_struct('u', h.u DIV {n}, 'd', h.d DIV {n})",
                "f",
                "named_struct('f', CASE WHEN f.u = f.d THEN IF(f.u = 4, 4L, f.u + 4) WHEN f.u < f.d THEN f.u ELSE f.d + 8 END,"
                f" 'x', h.d % {n}, 'y', {n - 1} - h.u % {n})",
            ),
        )
        # 1 - |z| loses digits next to a pole; the half angle does not.
        width = f"{n * math.sqrt(6)!r}D * sin(radians((90D - abs({dec})) / 2D))"
        quarter = f"least(3L, CAST(floor({lon}) AS BIGINT))"
        cap = bind(
            f"named_struct('q', {quarter}, 't', {lon} - {quarter}, 'w', {width}, 'north', {dec} >= 0D)",
            "h",
            bind(
                f"named_struct('u', least({n - 1}L, CAST(floor(h.t * h.w) AS BIGINT)), 'd', least({n - 1}L, CAST(floor((1D - h.t) * h.w) AS BIGINT)))",
                "f",
                f"IF(h.north, named_struct('f', h.q, 'x', {n - 1} - f.d, 'y', {n - 1} - f.u), named_struct('f', h.q + 8, 'x', f.u, 'y', f.d))",
            ),
        )
        bits = "".join(
            f" + shiftleft(shiftright(p.x, {k}) & 1L, {2 * k}) + shiftleft(shiftright(p.y, {k}) & 1L, {2 * k + 1})" for k in range(order)
        )
        place = f"CASE WHEN abs(sin(radians({dec}))) <= 2D / 3D THEN {belt} ELSE {cap} END"
        return bind(place, "p", f"p.f * {1 << 2 * order}L{bits}")

    return sealed(body, f"CAST({ra} AS DOUBLE)", f"CAST({dec} AS DOUBLE)")
