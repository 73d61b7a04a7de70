"""Queries over the driver tables, each with the SQL that gives its rows.

The tables are registered as ``base.*``; ``sky.*`` derives positions from keys
by exact arithmetic. Queries are ADQL and pass through the whole engine, but
for those that exercise sources, services or DataFrame operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import columns as sky
from .model import ColumnMeta
from .registry import Registry

TABLES = "region nation customer supplier part orders lineitem events".split()

#: name -> (source table, key, RA factor, Dec factor, further columns)
SKY = {
    "stars": ("part", "p_partkey", 7919, 104729, "p_retailprice / 100 AS mag, p_brand AS name, p_type AS kind"),
    "galaxies": ("customer", "c_custkey", 6571, 99991, "abs(c_acctbal) / 100000 AS redshift"),
    "deep": ("orders", "o_orderkey", 7919, 104729, "o_totalprice / 1000 AS flux"),
}


def _sky_sql(name: str, cast: str) -> str:
    table, key, a, b, more = SKY[name]
    return (
        f"SELECT {key} AS id, CAST(({key} * {a}) % 36000 AS {cast}) / 100 AS ra,"
        f" CAST(({key} * {b}) % 17801 AS {cast}) / 100 - 89 AS dec, {more} FROM {table}"
    )


_FOOTPRINT = (
    "SELECT c_custkey AS id, CAST((c_custkey * 7919) % 358 AS BIGINT) AS x,"
    " CAST((c_custkey * 104729) % 120 - 60 AS BIGINT) AS y FROM customer"
)
_REGION = (
    "concat('POLYGON ICRS ', CAST(x AS {s}), ' ', CAST(y AS {s}), ' ', CAST(x + 2 AS {s}), ' ', CAST(y AS {s}), ' ',"
    " CAST(x + 2 AS {s}), ' ', CAST(y + 2 AS {s}), ' ', CAST(x AS {s}), ' ', CAST(y + 2 AS {s}))"
)


_ENGINES: dict[tuple, Engine] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The session's engine for one folder, built once, as a service would."""
    key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), sf_dir)
    known = _ENGINES.get(key)
    if known is None or not spark.catalog.tableExists(known.registry.find("base.region").view):
        known = _ENGINES[key] = new_engine(spark, sf_dir)
    return known


def new_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the driver tables of one folder."""
    registry = Registry(spark)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for t, df in frames.items():
        registry.add_frame(f"base.{t}", df)
    position = {
        "ra": ColumnMeta("ra", "double", "deg", "pos.eq.ra;meta.main"),
        "dec": ColumnMeta("dec", "double", "deg", "pos.eq.dec;meta.main"),
    }
    for name, (table, *_) in SKY.items():
        df = spark.sql(_sky_sql(name, "DOUBLE").replace(f"FROM {table}", "FROM {src}"), src=frames[table])
        meta = [position.get(f.name) or c for f, c in zip(df.schema.fields, _columns(df), strict=True)]
        registry.add_frame(f"sky.{name}", df, columns=meta, ra_column="ra", dec_column="dec", primary_key="id")
    regions = spark.sql(_FOOTPRINT.replace("FROM customer", "FROM {src}"), src=frames["customer"])
    registry.add_frame(
        "sky.footprints", regions.selectExpr("id", "x", "y", _REGION.format(s="STRING") + " AS s_region")
    )
    registry.publish_schema()
    return Engine(spark, registry)


def _columns(df: DataFrame) -> list[ColumnMeta]:
    from .registry import column_of

    return [column_of(f) for f in df.schema.fields]


def _adql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).frame(text)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def adql(name: str, text: str, sql: str | None = None) -> None:
    """The same words serve as SQL where none are given."""
    QUERIES[name] = _adql(text)
    SQL[name] = with_sky(sql or text.replace("base.", ""))


def with_sky(sql: str) -> str:
    """Definitions of the sky tables that a statement names."""
    parts = [f"{n} AS ({_sky_sql(n, 'DOUBLE')})" for n in SKY if f"sky.{n}" in sql]
    if "sky.footprints" in sql:
        parts.append(f"footprints AS (SELECT id, x, y, {_REGION.format(s='VARCHAR')} AS s_region FROM ({_FOOTPRINT}) f)")
    sql = sql.replace("sky.", "")
    if not parts:
        return sql
    if sql.lstrip().upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + sql.lstrip()[5:]
    return "WITH " + ", ".join(parts) + " " + sql


def frame(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_sky(sql)
        return fn

    return register


# --- projection, filter, predicates -------------------------------------------
adql("scan_project", "SELECT n_nationkey, n_name, n_regionkey FROM base.nation")
adql(
    "alias_expr",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 5) AS net FROM base.lineitem",
)
adql("distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM base.lineitem")
adql(
    "filter_compare",
    "SELECT p_partkey, p_size FROM base.part WHERE p_size >= 10 AND p_size <> 15 AND (p_retailprice < 1200 OR p_size > 40)",
)
adql("filter_between", "SELECT p_partkey, p_size FROM base.part WHERE p_size BETWEEN 5 AND 9")
adql("filter_like", "SELECT p_partkey, p_name FROM base.part WHERE p_name LIKE '%1%' AND p_type NOT LIKE 'S%'")
adql("filter_in", "SELECT p_partkey, p_size FROM base.part WHERE p_size IN (1, 7, 19) AND p_partkey NOT IN (3, 4)")
adql("filter_null", "SELECT o_orderkey FROM base.orders WHERE o_custkey IS NOT NULL AND NOT (o_orderstatus IS NULL)")
adql("filter_not", "SELECT p_partkey FROM base.part WHERE NOT (p_size > 10)")
adql(
    "case_coalesce_cast",
    "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 1000 THEN 'low' ELSE 'high' END AS band,"
    " COALESCE(NULLIF(s_nationkey, 0), -1) AS nation, CAST(s_acctbal AS INTEGER) AS whole,"
    " s_name || '!' AS shout FROM base.supplier",
    "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 1000 THEN 'low' ELSE 'high' END AS band,"
    " COALESCE(NULLIF(s_nationkey, 0), -1) AS nation, CAST(trunc(s_acctbal) AS INTEGER) AS whole,"
    " s_name || '!' AS shout FROM supplier",
)
adql(
    "cte",
    "WITH big AS (SELECT o_custkey, o_totalprice FROM base.orders WHERE o_totalprice > 300)"
    " SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey",
)
adql(
    "scalar_subquery",
    "SELECT o_orderkey FROM base.orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM base.orders)",
)
adql(
    "derived_table",
    "SELECT t.o_orderstatus, MAX(t.total) AS highest FROM (SELECT o_orderstatus, o_totalprice AS total FROM base.orders) AS t"
    " GROUP BY t.o_orderstatus",
)
adql(
    "correlated_subquery",
    "SELECT c.c_custkey, (SELECT COUNT(*) FROM base.orders AS o WHERE o.o_custkey = c.c_custkey) AS n FROM base.customer AS c",
)
adql(
    "in_subquery",
    "SELECT c_custkey FROM base.customer WHERE c_custkey IN (SELECT o_custkey FROM base.orders WHERE o_orderstatus = 'F')",
)
adql(
    "not_exists",
    "SELECT c.c_custkey FROM base.customer AS c WHERE NOT EXISTS"
    " (SELECT 1 FROM base.orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
)
# --- joins ------------------------------------------------------------------------
adql("join_inner", "SELECT n.n_name, r.r_name FROM base.nation AS n JOIN base.region AS r ON n.n_regionkey = r.r_regionkey")
adql(
    "join_left",
    "SELECT c.c_custkey, o.o_orderkey FROM base.customer AS c LEFT JOIN base.orders AS o"
    " ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'",
)
adql(
    "join_right",
    "SELECT s.s_suppkey, n.n_name FROM base.supplier AS s RIGHT JOIN base.nation AS n ON s.s_nationkey = n.n_nationkey",
)
adql(
    "join_full",
    "SELECT s.s_suppkey, c.c_custkey FROM base.supplier AS s FULL JOIN base.customer AS c ON s.s_suppkey = c.c_custkey + 50",
)
adql("join_comma", "SELECT n.n_name, s.s_name FROM base.nation AS n, base.supplier AS s WHERE n.n_nationkey = s.s_nationkey")
adql("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM base.region AS a CROSS JOIN base.region AS b")
adql(
    "join_three_way",
    "SELECT r.r_name, COUNT(*) AS n FROM base.customer AS c JOIN base.nation AS n ON c.c_nationkey = n.n_nationkey"
    " JOIN base.region AS r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
)
adql(
    "join_using",
    "SELECT a.n_name, b.n_regionkey FROM base.nation AS a JOIN base.nation AS b USING (n_nationkey)",
)
adql("join_natural", "SELECT a.r_name FROM base.region AS a NATURAL JOIN base.region AS b")
# --- aggregates --------------------------------------------------------------------
adql(
    "agg_global",
    "SELECT COUNT(*) AS n, round(AVG(l_quantity), 6) AS mean, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi,"
    " round(SUM(l_quantity), 2) AS total FROM base.lineitem",
)
adql(
    "agg_group",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue"
    " FROM base.lineitem GROUP BY l_returnflag, l_linestatus",
)
adql("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM base.orders GROUP BY o_custkey HAVING COUNT(*) > 12")
adql(
    "agg_count_distinct",
    "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(l_partkey) AS n FROM base.lineitem GROUP BY l_returnflag",
)
adql(
    "agg_rollup",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM base.lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)",
)
adql(
    "agg_cube",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM base.lineitem GROUP BY CUBE(l_returnflag, l_linestatus)",
)
adql(
    "agg_grouping_sets",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM base.lineitem"
    " GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
)
adql(
    "agg_statistics",
    "SELECT o_orderstatus, round(STDDEV(o_totalprice), 4) AS sd, round(VAR_POP(o_totalprice), 2) AS var,"
    " round(MEDIAN(o_totalprice), 4) AS mid FROM base.orders GROUP BY o_orderstatus",
)
# --- windows ------------------------------------------------------------------------
adql(
    "win_rank",
    "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn,"
    " RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk,"
    " DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr FROM base.orders",
)
adql(
    "win_lag",
    "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev,"
    " LEAD(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS later FROM base.orders",
)
adql(
    "win_frame",
    "SELECT o_orderkey, round(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey"
    " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM base.orders",
)
# --- sort, limit ----------------------------------------------------------------------
adql(
    "top_n",
    "SELECT TOP 25 o_orderkey, o_totalprice FROM base.orders ORDER BY o_totalprice DESC, o_orderkey",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
adql(
    "order_multi_nulls",
    "SELECT TOP 40 c.c_custkey, o.o_orderkey FROM base.customer AS c LEFT JOIN base.orders AS o ON c.c_custkey = o.o_custkey"
    " AND o.o_orderstatus = 'P' ORDER BY o.o_orderkey, c.c_custkey",
    "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey"
    " AND o.o_orderstatus = 'P' ORDER BY o.o_orderkey NULLS LAST, c.c_custkey LIMIT 40",
)
adql("limit_offset", "SELECT o_orderkey FROM base.orders ORDER BY o_orderkey LIMIT 10 OFFSET 30")


@frame("maxrec_cap", "SELECT count(*) AS n, CAST(100 AS BIGINT) AS kept, true AS overflow FROM (SELECT 1 FROM orders LIMIT 101) t")
def maxrec_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = engine(spark, sf_dir).run("SELECT o_orderkey FROM base.orders", maxrec=100)
    return spark.createDataFrame(
        [(result.table.num_rows + int(result.overflow), result.table.num_rows, result.overflow)],
        "n long, kept long, overflow boolean",
    )


# --- set operations --------------------------------------------------------------------
for _name, _op in (("union_distinct", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):
    adql(
        _name,
        f"SELECT t.k FROM (SELECT n_nationkey AS k FROM base.nation {_op} SELECT s_nationkey AS k FROM base.supplier"
        " WHERE s_nationkey < 20) AS t",
    )
# --- scalar functions ---------------------------------------------------------------------
adql(
    "fn_string",
    "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, SUBSTRING(p_type, 2, 3) AS s, TRIM('  x ') AS t FROM base.part",
)
adql(
    "fn_math",
    "SELECT s_suppkey, ABS(s_acctbal) AS a, round(SQRT(ABS(s_acctbal)), 9) AS q, round(POWER(s_suppkey, 2), 9) AS p,"
    " MOD(s_suppkey, 7) AS m, round(s_acctbal / 7, 6) AS d, SIGN(s_acctbal) AS g FROM base.supplier",
    "SELECT s_suppkey, abs(s_acctbal) AS a, round(sqrt(abs(s_acctbal)), 9) AS q, round(power(s_suppkey, 2), 9) AS p,"
    " s_suppkey % 7 AS m, round(s_acctbal / 7, 6) AS d, CAST(sign(s_acctbal) AS DOUBLE) AS g FROM supplier",
)
adql(
    "fn_trig",
    "SELECT p_partkey, round(SIN(RADIANS(p_size)), 9) AS s, round(COS(RADIANS(p_size)), 9) AS c, round(TAN(RADIANS(p_size)), 9) AS t,"
    " round(ATAN2(p_size, 3), 9) AS a, round(DEGREES(ASIN(0.5)), 9) AS d, round(PI(), 9) AS pi FROM base.part",
)
adql(
    "fn_log",
    "SELECT p_partkey, round(LOG(p_retailprice), 9) AS l, round(LOG10(p_retailprice), 9) AS t, round(EXP(p_size / 50), 9) AS e FROM base.part",
    "SELECT p_partkey, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS t, round(exp(p_size / 50), 9) AS e FROM part",
)
adql(
    "fn_truncate",
    "SELECT s_suppkey, TRUNCATE(s_acctbal) AS t FROM base.supplier",
    "SELECT s_suppkey, trunc(s_acctbal) AS t FROM supplier",
)
adql(
    "fn_round_ceil_floor",
    "SELECT s_suppkey, ROUND(s_acctbal) AS r, CEILING(s_acctbal) AS c, FLOOR(s_acctbal) AS f FROM base.supplier",
)
# --- geometry --------------------------------------------------------------------------------
_HAV = (
    "(2 * degrees(asin(least(1.0, sqrt(power(sin(radians({d2} - {d1}) / 2), 2) + cos(radians({d1})) * cos(radians({d2}))"
    " * power(sin(radians({a2} - {a1}) / 2), 2)))))"
)


def hav(a1, d1, a2, d2) -> str:
    return _HAV.format(a1=a1, d1=d1, a2=a2, d2=d2) + ")"


_P = "POINT('ICRS', ra, dec)"


def _cone(name: str, ra: float, dec: float, radius: float, where: str = "{c} = 1", oracle: str = "{c}") -> None:
    c = f"CONTAINS({_P}, CIRCLE('ICRS', {ra}, {dec}, {radius}))"
    plain = f"{hav('ra', 'dec', f'CAST({ra} AS DOUBLE)', f'CAST({dec} AS DOUBLE)')} <= {radius}"
    adql(
        name,
        f"SELECT id, ra, dec FROM sky.stars WHERE {where.format(c=c)}",
        f"SELECT id, ra, dec FROM sky.stars WHERE {oracle.format(c=plain)}",
    )


_cone("geo_cone", 56.75, 24.12, 15.0)
_cone("geo_cone_seam", 0.0, 10.0, 12.0)
_cone("geo_cone_pole", 40.0, 89.0, 14.0)
_cone("geo_cone_huge", 200.0, -10.0, 179.0)
_cone("geo_cone_zero", 79.19, -55.1, 0.0)
_cone("geo_not_contains", 56.75, 24.12, 60.0, "0 = {c}", "NOT ({c})")
_cone("geo_cone_or", 56.75, 24.12, 15.0, "{c} = 1 OR mag < 10", "({c}) OR mag < 10")
adql(
    "geo_distance",
    f"SELECT id, round(DISTANCE({_P}, POINT('ICRS', 56.75, 24.12)), 6) AS d FROM sky.stars",
    f"SELECT id, round({hav('ra', 'dec', '56.75', '24.12')}, 6) AS d FROM sky.stars",
)
adql(
    "geo_coord",
    f"SELECT id, COORD1({_P}) AS a, COORD2({_P}) AS d, COORDSYS({_P}) AS s FROM sky.stars",
    "SELECT id, ra AS a, dec AS d, 'ICRS' AS s FROM sky.stars",
)


def _half_spaces(corners: list[tuple[float, float]]) -> str:
    """Inside a convex polygon: on one side of every edge's great circle."""
    from .functions.sphere import cross, unit

    x, y, z = "cos(radians(dec)) * cos(radians(ra))", "cos(radians(dec)) * sin(radians(ra))", "sin(radians(dec))"
    out = []
    for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
        n = cross(unit(*a), unit(*b))
        out.append(f"({n[0]!r} * {x} + {n[1]!r} * {y} + {n[2]!r} * {z}) > 0")
    return " AND ".join(out)


def _polygon(name: str, corners: list[tuple[float, float]]) -> None:
    numbers = ", ".join(f"{a}, {d}" for a, d in corners)
    adql(
        name,
        f"SELECT id, ra, dec FROM sky.stars WHERE CONTAINS({_P}, POLYGON('ICRS', {numbers})) = 1",
        f"SELECT id, ra, dec FROM sky.stars WHERE {_half_spaces(corners)}",
    )


_polygon("geo_point_in_polygon", [(40.0, 5.0), (75.0, 8.0), (70.0, 41.0), (38.0, 35.0)])
_polygon("geo_point_in_polygon_seam", [(350.0, -15.0), (12.0, -14.0), (15.0, 17.0), (348.0, 13.0)])
adql(
    "geo_point_in_region",
    "SELECT s.id, f.id AS footprint FROM sky.stars AS s, sky.footprints AS f"
    " WHERE CONTAINS(POINT('ICRS', s.ra, s.dec), f.s_region) = 1",
)


def _vector(a: str, d: str) -> tuple[str, str, str]:
    return f"(cos(radians({d})) * cos(radians({a})))", f"(cos(radians({d})) * sin(radians({a})))", f"sin(radians({d}))"


def _square_holds() -> str:
    """s in the square footprint f: on the inner side of its four edges."""
    p = _vector("s.ra", "s.dec")
    corners = [_vector(f"f.x + {i}", f"f.y + {j}") for i, j in ((0, 0), (2, 0), (2, 2), (0, 2))]
    tests = ["abs(s.dec - f.y - 1) < 3"]
    for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
        n = [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
        tests.append(" + ".join(f"{u} * {v}" for u, v in zip(n, p, strict=True)) + " > 0")
    tests.append(" + ".join(f"{u} * {v}" for u, v in zip(_vector("f.x + 1", "f.y + 1"), p, strict=True)) + " > 0")
    return " AND ".join(tests)


SQL["geo_point_in_region"] = with_sky(
    f"SELECT s.id, f.id AS footprint FROM sky.stars AS s, sky.footprints AS f WHERE {_square_holds()}"
)
adql(
    "geo_circle_intersects_region",
    "SELECT id FROM sky.footprints WHERE INTERSECTS(CIRCLE('ICRS', 56.75, 24.12, 15.0), s_region) = 1",
)


def _dot(a: tuple, b: tuple) -> str:
    return "(" + " + ".join(f"{u} * {v}" for u, v in zip(a, b, strict=True)) + ")"


def _cross(a: tuple, b: tuple) -> tuple[str, str, str]:
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def _boxes(source: str, keep: str) -> str:
    """SQL of the squares two degrees wide at x, y, with their corners as vectors."""
    corners = [_vector(f"x + {i}", f"y + {j}") for i, j in ((0, 0), (2, 0), (2, 2), (0, 2))]
    columns = ", ".join(f"{v} AS {c}{k}" for k, corner in enumerate(corners) for c, v in zip("abc", corner, strict=True))
    middle = ", ".join(f"{v} AS {c}m" for c, v in zip("abc", _vector("x + 1", "y + 1"), strict=True))
    return f"(SELECT {keep}, {columns}, {middle} FROM {source}) q"


_CORNERS = [(f"a{k}", f"b{k}", f"c{k}") for k in range(4)]
_EDGES = list(zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True))


def circle_meets_box(ra: float, dec: float, radius: float) -> str:
    """The centre on the inner side of all edges, a corner in the circle, or an
    edge that comes nearer than the radius between its ends."""
    p = tuple(f"({x})" for x in _vector(str(ra), str(dec)))
    inside = " AND ".join([f"{_dot(_cross(u, v), p)} >= 0" for u, v in _EDGES] + [f"{_dot(('am', 'bm', 'cm'), p)} > 0"])
    tests = [f"({inside})"] + [f"{_dot(u, p)} >= cos(radians({radius}))" for u in _CORNERS]
    for u, v in _EDGES:
        n = _cross(u, v)
        near = f"abs({_dot(n, p)}) <= sin(radians({radius})) * sqrt({_dot(n, n)})"
        tests.append(f"({near} AND {_dot(_cross(n, u), p)} >= 0 AND {_dot(_cross(v, n), p)} >= 0)")
    return " OR ".join(tests)


def polygon_meets_box(vertices: list[tuple[float, float]]) -> str:
    """Two convex polygons of one hemisphere are apart only if an edge's great
    circle of one of them has all of the other on its outer side."""
    points = [tuple(f"({x})" for x in _vector(str(a), str(d))) for a, d in vertices]
    middle = _vector(str(sum(a for a, _ in vertices) / len(vertices)), str(sum(d for _, d in vertices) / len(vertices)))
    apart = []
    for edges, others in ((_EDGES, points), (list(zip(points, points[1:] + points[:1], strict=True)), _CORNERS)):
        for u, v in edges:
            apart.append("(" + " AND ".join(f"{_dot(_cross(u, v), o)} < 0" for o in others) + ")")
    return f"{_dot(('am', 'bm', 'cm'), middle)} > cos(radians(60)) AND NOT ({' OR '.join(apart)})"


_BOXES = _boxes("sky.footprints", "id")
SQL["geo_circle_intersects_region"] = with_sky(f"SELECT id FROM {_BOXES} WHERE {circle_meets_box(56.75, 24.12, 15.0)}")
adql(
    "geo_polygon_intersects_region",
    "SELECT id FROM sky.footprints WHERE INTERSECTS(s_region, POLYGON('ICRS', 40, 5, 75, 8, 70, 41, 38, 35)) = 1",
    f"SELECT id FROM {_BOXES} WHERE {polygon_meets_box([(40, 5), (75, 8), (70, 41), (38, 35)])}",
)
adql(
    "geo_region_region",
    "SELECT a.id AS a, b.id AS b FROM sky.footprints AS a JOIN sky.footprints AS b ON a.id < b.id"
    " AND INTERSECTS(a.s_region, b.s_region) = 1",
)
# Squares on whole degrees meet if their corners are two degrees apart at most.
SQL["geo_region_region"] = with_sky(
    "SELECT a.id AS a, b.id AS b FROM sky.footprints AS a JOIN sky.footprints AS b ON a.id < b.id AND abs(a.y - b.y) <= 2"
    " AND least(abs(a.x - b.x), 360 - abs(a.x - b.x)) <= 2"
)
_MATCH = f"SELECT s.id AS star, g.id AS galaxy FROM sky.stars AS s, sky.galaxies AS g WHERE {hav('s.ra', 's.dec', 'g.ra', 'g.dec')} <= 1.0"
adql(
    "geo_crossmatch",
    "SELECT s.id AS star, g.id AS galaxy FROM sky.stars AS s JOIN sky.galaxies AS g"
    " ON CONTAINS(POINT('ICRS', s.ra, s.dec), CIRCLE('ICRS', g.ra, g.dec, 1.0)) = 1",
    _MATCH,
)


@frame("geo_crossmatch_cells", _MATCH)
def geo_crossmatch_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.crossmatch import crossmatch

    registry = engine(spark, sf_dir).registry
    found = crossmatch(registry.frame("sky.stars"), registry.frame("sky.galaxies"), 1.0, left="s", right="g")
    return found.select(F.col("s.id").alias("star"), F.col("g.id").alias("galaxy"))


@frame(
    "geo_crossmatch_left",
    f"SELECT s.id AS star, g.id AS galaxy FROM sky.stars AS s LEFT JOIN sky.galaxies AS g ON {hav('s.ra', 's.dec', 'g.ra', 'g.dec')} <= 0.4",
)
def geo_crossmatch_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.crossmatch import crossmatch

    registry = engine(spark, sf_dir).registry
    found = crossmatch(registry.frame("sky.stars"), registry.frame("sky.galaxies"), 0.4, left="s", right="g", how="left")
    return found.select(F.col("s.id").alias("star"), F.col("g.id").alias("galaxy"))


adql(
    "geo_match_full",
    "SELECT s.id AS star, g.id AS galaxy FROM sky.stars AS s FULL JOIN sky.galaxies AS g"
    " ON CONTAINS(POINT('ICRS', s.ra, s.dec), CIRCLE('ICRS', g.ra, g.dec, 0.3)) = 1",
    f"SELECT s.id AS star, g.id AS galaxy FROM sky.stars AS s FULL JOIN sky.galaxies AS g ON {hav('s.ra', 's.dec', 'g.ra', 'g.dec')} <= 0.3",
)
adql(
    "geo_match_three",
    "SELECT s.id AS star, g.id AS galaxy, f.id AS footprint FROM sky.stars AS s"
    " JOIN sky.galaxies AS g ON DISTANCE(POINT('ICRS', s.ra, s.dec), POINT('ICRS', g.ra, g.dec)) < 0.5"
    " LEFT JOIN sky.deep AS f ON CONTAINS(POINT('ICRS', g.ra, g.dec), CIRCLE('ICRS', f.ra, f.dec, 0.2)) = 1",
    f"SELECT s.id AS star, g.id AS galaxy, f.id AS footprint FROM sky.stars AS s JOIN sky.galaxies AS g"
    f" ON abs(s.dec - g.dec) < 0.51 AND {hav('s.ra', 's.dec', 'g.ra', 'g.dec')} < 0.5 LEFT JOIN sky.deep AS f"
    f" ON abs(g.dec - f.dec) < 0.21 AND {hav('g.ra', 'g.dec', 'f.ra', 'f.dec')} <= 0.2",
)


@frame(
    "geo_cone_column",
    f"SELECT id FROM sky.deep WHERE {hav('ra', 'dec', '200.0', '-30.0')} <= 8.0",
)
def geo_cone_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).registry.frame("sky.deep").where(sky.cone_contains("ra", "dec", 200.0, -30.0, 8.0)).select("id")


# --- discovery ---------------------------------------------------------------------------------
@frame(
    "detect_radec_ranges",
    "SELECT min(l_quantity) AS quantity_lo, max(l_quantity) AS quantity_hi, min(l_discount) AS discount_lo,"
    " max(l_discount) AS discount_hi, CAST(min(l_linenumber) AS DOUBLE) AS line_lo,"
    " CAST(max(l_linenumber) AS DOUBLE) AS line_hi FROM lineitem",
)
def detect_radec_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.discovery import column_ranges

    r = column_ranges(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    row = [*r["l_quantity"], *r["l_discount"], *r["l_linenumber"]]
    return spark.createDataFrame(
        [tuple(map(float, row))],
        "quantity_lo double, quantity_hi double, discount_lo double, discount_hi double, line_lo double, line_hi double",
    )


adql(
    "tap_schema_tables",
    "SELECT table_name, schema_name, table_type FROM TAP_SCHEMA.tables WHERE schema_name = 'base'",
    "SELECT 'base.' || t AS table_name, 'base' AS schema_name, 'table' AS table_type FROM (VALUES "
    + ", ".join(f"('{t}')" for t in TABLES)
    + ") v(t)",
)
adql(
    "tap_schema_columns",
    "SELECT column_name, datatype, unit, ucd, principal, column_index FROM TAP_SCHEMA.columns WHERE table_name = 'sky.galaxies'",
    "SELECT * FROM (VALUES ('id', 'long', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0, 0),"
    " ('ra', 'double', 'deg', 'pos.eq.ra;meta.main', 1, 1), ('dec', 'double', 'deg', 'pos.eq.dec;meta.main', 1, 2),"
    " ('redshift', 'double', NULL, NULL, 0, 3)) v(column_name, datatype, unit, ucd, principal, column_index)",
)


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share."""
    import os
    import tempfile

    from .shipping import shared_folder

    shared = shared_folder(spark) or os.path.join(tempfile.gettempdir(), f"astroloom-{os.getpid()}")
    return f"{shared}/catalog-{name}-{uuid.uuid4().hex}"


# --- sources: written in each format, read back through discovery ----------------------------
def _discovered(spark: SparkSession, name: str, files: dict[str, bytes]) -> Engine:
    """An engine over a folder with these files. They go through Hadoop's file
    system, so the folder may be on any store the executors see."""
    from .sources.discovery import discover

    folder = f"{work_folder(spark, name)}/{name}"
    jvm = spark._jvm
    for path, body in files.items():
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{path}")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        try:
            out.write(bytearray(body))
        finally:
            out.close()
    plain = folder.removeprefix("file:") if folder.startswith("file:/") else folder
    return Engine(spark, discover(spark, [plain.replace("//", "/") if folder.startswith("file:") else plain]))


def _nations(spark: SparkSession, sf_dir: str):
    return (
        spark.read.parquet(f"{sf_dir}/nation.parquet")
        .selectExpr("CAST(n_nationkey AS BIGINT) AS k", "n_name AS name", "n_regionkey / 2D AS half")
        .orderBy("k")
        .toArrow()
    )


_NATION_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, n_regionkey / 2.0::DOUBLE AS half FROM nation"
_META = [ColumnMeta("k", "long"), ColumnMeta("name", "char"), ColumnMeta("half", "double", "deg", "pos.eq.dec")]


def _round_trip(kind: str, ending: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .output import serialize

        body = serialize(_nations(spark, sf_dir), kind, _META)
        return _discovered(spark, f"trip_{ending}", {f"nations.{ending}": body}).frame(
            f"SELECT k, name, half FROM trip_{ending}.nations"
        )

    label = {"votable": "votable", "votable/td": "votable_td"}.get(kind, kind)
    QUERIES[f"scan_{label}_roundtrip"] = run
    SQL[f"scan_{label}_roundtrip"] = _NATION_SQL


for _kind, _ending in (("csv", "csv"), ("tsv", "tsv"), ("parquet", "parquet"), ("votable", "vot"), ("votable/td", "xml")):
    _round_trip(_kind, _ending)


@frame("scan_ecsv_roundtrip", _NATION_SQL)
def scan_ecsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = (
        "# %ECSV 1.0\n# ---\n# datatype:\n# - {name: k, datatype: int64}\n# - {name: name, datatype: string}\n"
        "# - {name: half, unit: deg, datatype: float64}\nk name half\n"
    )
    body = "".join(f'{r["k"]} "{r["name"]}" {r["half"]!r}\n' for r in _nations(spark, sf_dir).to_pylist())
    return _discovered(spark, "trip_ecsv", {"nations.ecsv": (head + body).encode()}).frame(
        "SELECT k, name, half FROM trip_ecsv.nations"
    )


def fits_table(rows: list[tuple], names: list[str], forms: list[str]) -> bytes:
    """A FITS file with one binary table (formats K, D, E, J and nA)."""
    import struct

    from .service.links import card

    width = sum(int(f[:-1]) if f[-1] == "A" else {"K": 8, "D": 8, "E": 4, "J": 4}[f[-1]] for f in forms)
    body = bytearray()
    for r in rows:
        for v, f in zip(r, forms, strict=True):
            if f[-1] == "A":
                body += str(v).encode().ljust(int(f[:-1]))[: int(f[:-1])]
            else:
                body += struct.pack(">" + {"K": "q", "D": "d", "E": "f", "J": "i"}[f[-1]], v)

    def header(cards: list[bytes]) -> bytes:
        raw = b"".join([*cards, b"END".ljust(80)])
        return raw.ljust(-(-len(raw) // 2880) * 2880)

    primary = header([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", True)])
    cards = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", width), card("NAXIS2", len(rows))]
    cards += [card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(names))]
    for i, (n, f) in enumerate(zip(names, forms, strict=True), 1):
        cards += [card(f"TTYPE{i}", n), card(f"TFORM{i}", f)]
    return primary + header(cards) + bytes(body).ljust(-(-len(body) // 2880) * 2880, b"\0")


@frame("scan_fits_roundtrip", _NATION_SQL)
def scan_fits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r["k"], r["name"], r["half"]) for r in _nations(spark, sf_dir).to_pylist()]
    body = fits_table(rows, ["k", "name", "half"], ["K", "30A", "D"])
    return _discovered(spark, "trip_fits", {"nations.fits": body}).frame("SELECT k, name, half FROM trip_fits.nations")


# --- HEALPix-partitioned tables -----------------------------------------------------------------
_SHARDED: dict[tuple, Engine] = {}


def _sharded(spark: SparkSession, sf_dir: str) -> Engine:
    """sky.stars cut into order-1 shards, and the file list of the catalog: written once."""
    from .functions import healpix
    from .sources.discovery import discover

    key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), sf_dir)
    if key in _SHARDED:
        return _SHARDED[key]
    root = f"{work_folder(spark, 'hats')}/sky/stars"
    frame_ = engine(spark, sf_dir).registry.frame("sky.stars").select("id", "ra", "dec", "mag")
    pixel = F.expr(f"CAST({healpix.pixel_sql(1, 'ra', 'dec')} AS INT)")
    frame_.withColumn("Norder", F.lit(1)).withColumn("Npix", pixel).write.partitionBy("Norder", "Npix").parquet(f"{root}/dataset")
    Path = spark._jvm.org.apache.hadoop.fs.Path
    target = Path(f"{root}/partition_info.csv")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(b"Norder,Npix\n1,0\n"))
    out.close()
    plain = root.removeprefix("file://") if root.startswith("file://") else root.removeprefix("file:")
    _SHARDED[key] = Engine(spark, discover(spark, [plain]))
    return _SHARDED[key]


def _hats(name: str, where: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _sharded(spark, sf_dir).frame(f"SELECT id, ra, dec FROM sky.stars WHERE {where}")
    SQL[name] = with_sky(f"SELECT id, ra, dec FROM sky.stars WHERE {oracle}")


_C = f"CONTAINS({_P}, CIRCLE('ICRS', 56.75, 24.12, 15))"
_PLAIN = f"{hav('ra', 'dec', '56.75', '24.12')} <= 15"
_hats("hats_pruned_cone", f"{_C} = 1 AND mag > 0", f"{_PLAIN} AND mag > 0")
_hats("hats_negated", f"{_C} = 0", f"NOT ({_PLAIN})")
_hats("hats_unpruned", f"{_C} = 1 OR mag < 10", f"{_PLAIN} OR mag < 10")


# --- image metadata and services -------------------------------------------------------------------
_PLANES = (
    "SELECT 'caom:' || c_mktsegment || '/' || c_custkey || '/2' AS plane_uri, 'caom:' || c_mktsegment || '/' || c_custkey AS obs_uri,"
    " c_custkey AS k, c_mktsegment AS collection, c_custkey / 1000.0D AS em_low, c_custkey * 2.0D AS t_low,"
    " CAST((c_custkey * 7919) % 358 AS BIGINT) AS x, CAST((c_custkey * 104729) % 120 - 60 AS BIGINT) AS y FROM customer"
)


def images(spark: SparkSession, sf_dir: str) -> Engine:
    """caom.* and ivoa.obscore over the customers: one square image each."""
    from .obscore import caom

    base_engine = engine(spark, sf_dir)
    own = Engine(spark, base_engine.registry.scoped())
    base = spark.sql(_PLANES.replace("FROM customer", "FROM {c}"), c=base_engine.registry.frame("base.customer"))
    none = "CAST(NULL AS STRING)"
    frames = {
        "observation": base.selectExpr("obs_uri", "collection", "CAST(k AS STRING) AS obs_id", f"{none} AS instrument", f"{none} AS target_name", f"{none} AS facility"),
        "plane": base.selectExpr(
            "plane_uri", "obs_uri", "2 AS calib_level", "'image' AS dataproduct_type", _REGION.format(s="STRING") + " AS s_region",
            "x + 1D AS s_ra", "y + 1D AS s_dec", "3D AS s_fov", "1D AS s_resolution", "t_low AS t_min", "t_low + 1D AS t_max", "60D AS t_exptime",
            "em_low AS em_min", "em_low + 0.5D AS em_max", "'V' AS em_filter",
        ),
        "artifact": base.selectExpr("'file:' || k AS artifact_uri", "plane_uri", "'http://x/' || k AS access_url", "'application/fits' AS content_type", "k * 1024 AS content_length", "'science' AS product_type"),
        "chunk": base.selectExpr("'c' || k AS chunk_id", "'file:' || k AS artifact_uri", "0 AS extension", "CAST(k + 1 AS INT) AS naxis1", "100 AS naxis2", f"{none} AS wcs_json").where("naxis1 % 2 = 0"),
    }
    caom.register(own.registry, frames)
    return own


_PLANE_SQL = _PLANES.replace("1000.0D", "1000.0::DOUBLE").replace("2.0D", "2.0::DOUBLE")


@frame(
    "obscore_view",
    f"SELECT plane_uri AS obs_publisher_did, collection AS obs_collection, CAST(k AS VARCHAR) AS obs_id, k AS access_estsize,"
    f" CASE WHEN (k + 1) % 2 = 0 THEN CAST(k + 1 AS BIGINT) END AS s_xel1, x + 1.0::DOUBLE AS s_ra, 'phot.flux' AS o_ucd, CAST(0 AS BIGINT) AS pol_xel"
    f" FROM ({_PLANE_SQL}) p",
)
def obscore_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).frame(
        "SELECT obs_publisher_did, obs_collection, obs_id, access_estsize, s_xel1, s_ra, o_ucd, pol_xel FROM ivoa.obscore"
    )


def _sia(name: str, pairs: list[tuple[str, str]], oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .service.params import Parameters
        from .service.search import image_search_adql

        return images(spark, sf_dir).frame(image_search_adql(Parameters(pairs))).select("obs_publisher_did")

    QUERIES[name] = run
    if oracle:
        SQL[name] = f"SELECT plane_uri AS obs_publisher_did FROM ({_PLANE_SQL}) p WHERE {oracle}"


_sia("sia_band", [("BAND", "0.2 0.3"), ("BAND", "0.9")], "(em_low <= 0.3 AND em_low + 0.5 >= 0.2) OR (em_low <= 0.9 AND em_low + 0.5 >= 0.9)")
_sia("sia_time", [("TIME", "-Inf 50"), ("COLLECTION", "BUILDING")], "t_low <= 50 AND collection = 'BUILDING'")
_sia("sia_pos_circle", [("POS", "CIRCLE 56.75 24.12 15")], "true")
SQL["sia_pos_circle"] = f"SELECT obs_publisher_did FROM {_boxes(f'({_PLANE_SQL}) p', 'plane_uri AS obs_publisher_did')} WHERE {circle_meets_box(56.75, 24.12, 15.0)}"
_sia("sia_pos_band", [("POS", "RANGE 0 360 10 90")], "y + 1 >= 10")


@frame(
    "scs_verb2",
    f"SELECT id, ra, dec FROM sky.stars WHERE {hav('ra', 'dec', '200.0', '-30.0')} <= 12.0",
)
def scs_verb2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .service.params import Parameters
    from .service.search import cone_search_adql

    own = engine(spark, sf_dir)
    p = Parameters([("RA", "200"), ("dec", "-30"), ("SR", "12"), ("VERB", "2")])
    return own.frame(cone_search_adql(own.registry.find("sky.stars"), p))


_LINKS_SQL = (
    f"SELECT plane_uri AS \"ID\", s AS semantics, CASE WHEN s = '#this' THEN k * 1024 END AS content_length FROM ({_PLANE_SQL}) p,"
    " (VALUES ('#this'), ('#preview'), ('#cutout')) v(s)"
)


def _links(spark: SparkSession, sf_dir: str, planes: str) -> DataFrame:
    from .service.links import artifacts_of, link_rows

    own = images(spark, sf_dir)
    ids = own.registry.frame("caom.plane").where(planes).select("plane_uri")
    return link_rows(artifacts_of(own, ids)).select("ID", "semantics", "content_length")


@frame("datalink_links", f"{_LINKS_SQL} WHERE k < 20")
def datalink_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for 20 planes; ``datalink_links_all`` is the whole tables."""
    return _links(spark, sf_dir, "t_min < 40")


@frame("datalink_links_all", _LINKS_SQL)
def datalink_links_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir, "true")


@frame(
    "upload_join",
    "SELECT n.n_name AS name, u.w AS w FROM nation n JOIN (VALUES (CAST(1 AS BIGINT), 0.5::DOUBLE), (3, 1.5), (5, 2.5), (7, 3.5), (99, 9.5)) u(k, w) ON n.n_nationkey = u.k",
)
def upload_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    from .output import serialize
    from .service.params import Parameters, tap_request
    from .service.tap import run_request

    table = pa.table({"k": [1, 3, 5, 7, 99], "w": [0.5, 1.5, 2.5, 3.5, 9.5]})
    pairs = [
        ("LANG", "ADQL"),
        ("UPLOAD", "mine,param:p1"),
        ("QUERY", "SELECT n.n_name AS name, u.w AS w FROM base.nation AS n JOIN tap_upload.mine AS u ON n.n_nationkey = u.k"),
    ]
    request = tap_request(Parameters(pairs))
    return spark.createDataFrame(run_request(engine(spark, sf_dir), request, {"p1": serialize(table, "votable")}).table)
