"""Positional cross-match of two tables as a DataFrame operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import sphere
from ..plans import cells

KINDS = {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "full": "FULL", "outer": "FULL"}


def crossmatch(
    a: DataFrame,
    b: DataFrame,
    radius: float,
    left: str = "a",
    right: str = "b",
    position: tuple[str, str] = ("ra", "dec"),
    other_position: tuple[str, str] = ("ra", "dec"),
    how: str = "inner",
) -> DataFrame:
    """All pairs within ``radius`` degrees as two struct columns, named ``left``
    and ``right``: rows of ``a`` and of ``b``, null where an outer join (``how``:
    inner, left, right, full) finds none. Both sides are shuffled by sky cell,
    never crossed. Of an inner join the smaller side should be ``b``, whose rows
    are copied to the cells they touch; in an outer join of one side it is the
    side that may be missing. Rows without a position match nothing."""
    if not 0 < radius <= 180:
        raise ValueError("radius must be over 0 and at most 180 degrees")
    if how not in KINDS:
        raise ValueError(f"how must be one of {', '.join(KINDS)}, not {how!r}")
    one, two = f"`{left}`", f"`{right}`"
    points = [[f"{x}.`{c}`" for c in cs] for x, cs in ((one, position), (two, other_position))]
    near = f"{sphere.hav(*points[0], *points[1])} <= {float(radius)!r}D"
    on = f"__l.{cells.CELL} = __r.{cells.CELL} AND {near}"
    copied = 0 if how == "right" else 1
    sides = []
    for k, name in enumerate((one, two)):
        source = "{src}" if k == 0 else "{other}"
        rows = cells.numbered(source, name) if KINDS[how] == "FULL" else f"(SELECT struct(*) AS {name} FROM {source})"
        if k == copied:
            sides.append(f"SELECT *, explode_outer({cells.circle_cells(*points[k], radius)}) AS {cells.CELL} FROM {rows}")
        else:
            sides.append(f"SELECT *, {cells.point_cell(*points[k], radius)} AS {cells.CELL} FROM {rows}")
    if KINDS[how] == "FULL":
        query = cells.whole_outer(*sides, one, two, "FULL", on)
    else:
        query = f"SELECT {one}, {two} FROM ({sides[0]}) AS __l {KINDS[how]} JOIN ({sides[1]}) AS __r ON {on}"
    return a.sparkSession.sql(query, src=a, other=b)
