"""Joins by distance or region against all pairs, and their plans."""

import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from astroloom.engine import Engine
from astroloom.functions import columns as sky
from astroloom.functions import sphere
from astroloom.operators.crossmatch import crossmatch
from astroloom.registry import Registry


def scattered(n, seed, step=1.0):
    """Positions all over the sky, some close together, some next to a pole or the seam."""
    out = []
    x = seed
    for i in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        ra, dec = (x >> 40) / 2**24 * 360, math.degrees(math.asin(((x >> 16) & 0xFFFFFF) / 2**23 - 1))
        out.append((i, ra, dec))
        if i % 4 == 0:
            out.append((1000 + i, (ra + 0.4 * step) % 360, max(-90.0, min(90.0, dec + 0.3 * step))))
    return out + [(2001, 0.01, 89.99), (2002, 181.0, 89.9), (2003, 359.99, -0.1), (2004, 0.02, 0.1), (2005, None, 1.0), (2006, 10.0, None)]


def square(ra, dec, size):
    s = size / 2
    return f"POLYGON ICRS {(ra - s) % 360} {dec - s} {(ra + s) % 360} {dec - s} {(ra + s) % 360} {dec + s} {(ra - s) % 360} {dec + s}"


@pytest.fixture(scope="module")
def sky_engine(spark):
    r = Registry(spark)
    a, b, c = scattered(60, 1), scattered(50, 2), scattered(40, 3)
    b += [(3000 + i, ra, dec) for i, ra, dec in a[::5] if ra is not None and dec is not None]
    c += [(4000 + i, (ra + 0.2) % 360, dec) for i, ra, dec in a[::7] if ra is not None and dec is not None]
    radii = [0.001, 0.3, 2.0, 12.0, 45.0, 100.0, None, -1.0]
    sizes = [0.01, 0.4, 3.0, 20.0, 70.0]
    fields = [(i, square(ra, max(-50.0, min(50.0, dec)), sizes[k % 5])) for k, (i, ra, dec) in enumerate(x for x in scattered(40, 5) if x[1] is not None and x[2] is not None)]
    fields += [(5001, "bad"), (5002, None), (5003, "POLYGON ICRS 0 0 90 0 180 0 270 0"), (5004, "POLYGON ICRS 0 60 120 60 240 60")]
    schema = "ra double, dec double"
    r.add_frame("t.a", spark.createDataFrame(a, f"id long, {schema}"), ra_column="ra", dec_column="dec")
    r.add_frame("t.b", spark.createDataFrame([(*x, radii[k % 8]) for k, x in enumerate(b)], f"id long, {schema}, reach double"))
    r.add_frame("t.c", spark.createDataFrame(c, f"id long, {schema}"))
    r.add_frame("t.f", spark.createDataFrame(fields, "id long, s_region string"))
    r.add_frame("t.g", spark.createDataFrame(fields[::2] + fields[-4:], "id long, s_region string"))
    r.publish_schema()
    r.rows = {"a": a, "b": [(*x, radii[k % 8]) for k, x in enumerate(b)], "c": c, "f": fields, "g": fields[::2] + fields[-4:]}
    return Engine(spark, r)


def near(p, q, radius):
    if None in (p[1], p[2], q[1], q[2], radius) or radius < 0:
        return False
    return sphere.separation(p[1], p[2], q[1], q[2]) <= radius


def joined(left, right, test, how="INNER"):
    pairs = [(p[0], q[0]) for p in left for q in right if test(p, q)]
    if how in ("LEFT", "FULL"):
        pairs += [(p[0], None) for p in left if not any(test(p, q) for q in right)]
    if how in ("RIGHT", "FULL"):
        pairs += [(None, q[0]) for q in right if not any(test(p, q) for p in left)]
    return sorted(pairs, key=repr)


def answer(engine, query):
    plan = engine.frame(query)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan, plan
    return sorted((tuple(r.values()) for r in engine.run(query).table.to_pylist()), key=repr)


@pytest.mark.parametrize("how", ["INNER", "LEFT", "RIGHT", "FULL"])
@pytest.mark.parametrize("radius", [0.6, 8.0, 35.0, 120.0])
def test_constant_radius(sky_engine, how, radius):
    rows = sky_engine.registry.rows
    q = f"SELECT a.id AS x, b.id AS y FROM t.a {how} JOIN t.b ON CONTAINS(POINT('ICRS', a.ra, a.dec), CIRCLE('ICRS', b.ra, b.dec, {radius})) = 1"
    assert answer(sky_engine, q) == joined(rows["a"], rows["b"], lambda p, q: near(p, q, radius), how)


@pytest.mark.parametrize("how", ["INNER", "LEFT", "RIGHT", "FULL"])
def test_radius_of_a_column(sky_engine, how):
    rows = sky_engine.registry.rows
    q = f"SELECT a.id AS x, b.id AS y FROM t.a {how} JOIN t.b ON CONTAINS(POINT('ICRS', a.ra, a.dec), CIRCLE('ICRS', b.ra, b.dec, b.reach)) = 1"
    assert answer(sky_engine, q) == joined(rows["a"], rows["b"], lambda p, q: near(p, q, q[3]), how)
    q = f"SELECT a.id AS x, b.id AS y FROM t.b {how} JOIN t.a ON b.reach >= DISTANCE(POINT('ICRS', b.ra, b.dec), POINT('ICRS', a.ra, a.dec))"
    turned = {"LEFT": "RIGHT", "RIGHT": "LEFT"}.get(how, how)
    assert answer(sky_engine, q) == joined(rows["a"], rows["b"], lambda p, q: near(p, q, q[3]), turned)


def regions(engine, query):
    """The pairs of a query over all pairs, by the exact test alone."""
    return {tuple(r.values()) for r in engine.run(query).table.to_pylist()}


@pytest.mark.parametrize("how", ["INNER", "LEFT", "RIGHT", "FULL"])
def test_positions_in_regions(spark, sky_engine, how):
    rows = sky_engine.registry.rows
    a, f = (sky_engine.registry.frame(f"t.{x}") for x in "af")
    test = F.expr(sphere.point_in_polygon("ra", "dec", sphere.parse_region("s_region")))
    pairs = {tuple(r) for r in a.withColumnRenamed("id", "x").crossJoin(f.withColumnRenamed("id", "y")).where(test).select("x", "y").collect()}
    assert len(pairs) > 30
    q = f"SELECT a.id AS x, f.id AS y FROM t.a {how} JOIN t.f ON CONTAINS(POINT('ICRS', a.ra, a.dec), f.s_region) = 1"
    assert answer(sky_engine, q) == joined(rows["a"], rows["f"], lambda p, q: (p[0], q[0]) in pairs, how)


@pytest.mark.parametrize("how", ["INNER", "LEFT", "FULL"])
def test_regions_with_regions(sky_engine, how):
    rows = sky_engine.registry.rows
    f, g = (sky_engine.registry.frame(f"t.{x}") for x in "fg")
    test = F.expr(sphere.polygons_meet(sphere.parse_region("s"), sphere.parse_region("t")))
    pairs = {tuple(r) for r in f.toDF("x", "s").crossJoin(g.toDF("y", "t")).where(test).select("x", "y").collect()}
    assert len(pairs) > 60
    q = f"SELECT f.id AS x, g.id AS y FROM t.f {how} JOIN t.g ON INTERSECTS(f.s_region, g.s_region) = 1"
    assert answer(sky_engine, q) == joined(rows["f"], rows["g"], lambda p, q: (p[0], q[0]) in pairs, how)


@pytest.fixture(scope="module")
def repeated(spark):
    """A few regions, each in many rows, beside rows without a region."""
    r = Registry(spark)
    texts = [square(10, 0, 2), square(11, 1, 2), square(14, 0, 2), square(12.5, 0, 30), square(200, 40, 2), "bad", None]
    rows = [(i, i % 3, texts[i % 7]) for i in range(140)]
    r.add_frame("t.p", spark.createDataFrame(rows, "id long, band long, s_region string"))
    r.add_frame("t.q", spark.createDataFrame(rows[30:90], "id long, band long, s_region string"))
    r.publish_schema()
    meet = {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (0, 1), (0, 3), (1, 3), (2, 3)}
    meet |= {(y, x) for x, y in meet}
    r.rows = {"p": rows, "q": rows[30:90]}
    r.meet = lambda p, q: (p[0] % 7, q[0] % 7) in meet
    return Engine(spark, r)


MEET = "INTERSECTS(p.s_region, q.s_region) = 1"


def test_equal_regions_are_tested_once(repeated):
    """The exact test is in a join of distinct texts: no row of a table takes part."""
    q = f"SELECT p.id AS x, q.id AS y FROM t.p AS p JOIN t.p AS q ON p.id < q.id AND {MEET}"
    meet = repeated.registry.meet
    assert answer(repeated, q) == joined(*[repeated.registry.rows["p"]] * 2, lambda p, q: p[0] < q[0] and meet(p, q))
    plan = repeated.frame(q)._jdf.queryExecution().optimizedPlan().toString()
    exact = [line for line in plan.splitlines() if "Join" in line and "ATAN2" in line]
    assert len(exact) == 1 and not re.search(r"\bid#\d+L", exact[0])
    # The texts are parsed above the DISTINCT: for both sides and their levels.
    assert "regexp_replace(s_region" not in plan and plan.count("regexp_replace(__sky_text") <= 4


@pytest.mark.parametrize("how", ["INNER", "LEFT", "RIGHT", "FULL"])
@pytest.mark.parametrize("more", ["", " AND p.band = 1", " AND p.band = q.band", " AND q.id > 50 AND p.id <> q.id"])
def test_repeated_regions(repeated, how, more):
    tests = {
        "": lambda p, q: True,
        " AND p.band = 1": lambda p, q: p[1] == 1,
        " AND p.band = q.band": lambda p, q: p[1] == q[1],
        " AND q.id > 50 AND p.id <> q.id": lambda p, q: q[0] > 50 and p[0] != q[0],
    }
    rows, meet = repeated.registry.rows, repeated.registry.meet
    got = answer(repeated, f"SELECT p.id AS x, q.id AS y FROM t.p {how} JOIN t.q ON {MEET}{more}")
    assert got == joined(rows["p"], rows["q"], lambda p, q: meet(p, q) and tests[more](p, q), how)


def test_texts_of_the_wanted_rows_only(repeated):
    """Tests of one table narrow the texts; a test that needs both, or a missing row, does not."""
    rows, meet = repeated.registry.rows, repeated.registry.meet
    for source in (f"t.p JOIN t.q ON {MEET} WHERE p.id = 3 AND q.band IN (0, 1)", f"t.p, t.q WHERE {MEET} AND p.id = 3 AND q.band IN (0, 1)"):
        q = f"SELECT p.id AS x, q.id AS y FROM {source}"
        assert answer(repeated, q) == joined(rows["p"], rows["q"], lambda p, q: meet(p, q) and p[0] == 3 and q[1] in (0, 1))
        distinct = [s.split("WHERE")[1] for s in repeated.run(q).translation.sql.split("SELECT DISTINCT")[1:]]
        assert any("`id` = 3" in s for s in distinct) and any("`band` IN (0, 1)" in s for s in distinct)
    q = f"SELECT z.id AS z, p.id AS x FROM t.p AS z LEFT JOIN (t.p AS p JOIN t.q AS q ON {MEET}) ON p.id = z.id AND q.id = z.id WHERE p.id IS NULL"
    assert answer(repeated, q) == sorted(((r[0], None) for r in rows["p"] if r not in rows["q"] or r[2] in ("bad", None)), key=repr)


def test_three_tables_of_regions(repeated):
    rows, meet = repeated.registry.rows, repeated.registry.meet
    q = f"SELECT p.id AS x, q.id AS y, s.id AS z FROM t.p AS p JOIN t.q AS q ON {MEET} JOIN t.p AS s ON INTERSECTS(q.s_region, s.s_region) = 1 WHERE p.id < 14 AND s.id < 14"
    few = rows["p"][:14]
    expected = [(a[0], b[0], c[0]) for a in few for b in rows["q"] if meet(a, b) for c in few if meet(b, c)]
    assert len(expected) > 500 and answer(repeated, q) == sorted(expected, key=repr)


def test_three_tables(sky_engine):
    rows = sky_engine.registry.rows
    ab = "CONTAINS(POINT('ICRS', a.ra, a.dec), CIRCLE('ICRS', b.ra, b.dec, 3.0)) = 1"
    bc = "DISTANCE(POINT('ICRS', b.ra, b.dec), POINT('ICRS', c.ra, c.dec)) < 5.0"
    expected = sorted(
        ((p[0], q[0], s[0]) for p, q in itertools.product(rows["a"], rows["b"]) if near(p, q, 3.0) for s in rows["c"] if near(q, s, 5.0)),
        key=repr,
    )
    assert len(expected) > 10
    for source in (
        f"t.a JOIN t.b ON {ab} JOIN t.c ON {bc}",
        f"t.a, t.b, t.c WHERE {ab} AND {bc}",
        f"t.a JOIN (t.b JOIN t.c ON {bc}) ON {ab}",
        f"t.c JOIN t.b ON {bc} JOIN t.a ON {ab} WHERE a.id >= 0",
    ):
        assert answer(sky_engine, f"SELECT a.id AS x, b.id AS y, c.id AS z FROM {source}") == expected, source
    # An outer join beside an inner one.
    left = sorted(
        ((p[0], q[0], s) for p, q in itertools.product(rows["a"], rows["b"]) if near(p, q, 3.0) for s in ([s[0] for s in rows["c"] if near(q, s, 5.0)] or [None])),
        key=repr,
    )
    assert answer(sky_engine, f"SELECT a.id AS x, b.id AS y, c.id AS z FROM t.a JOIN t.b ON {ab} LEFT JOIN t.c ON {bc}") == left


def test_equal_keys_beside_cells(sky_engine):
    rows = sky_engine.registry.rows
    ab = "CONTAINS(POINT('ICRS', a.ra, a.dec), CIRCLE('ICRS', b.ra, b.dec, 3.0)) = 1"
    q = f"SELECT * FROM t.a JOIN t.b ON {ab} LEFT JOIN t.f ON f.id = a.id"
    out = sky_engine.run(q).table
    assert out.column_names == ["id", "ra", "dec", "id", "ra", "dec", "reach", "id", "s_region"]
    assert out.num_rows == len(joined(rows["a"], rows["b"], lambda p, q: near(p, q, 3.0)))


def test_copies_stay_few(spark, sky_engine):
    """No region, however large, thin or flat, has more than some dozen keys."""
    from astroloom.plans import cells

    for region in ("POLYGON ICRS 0 0 90 0 180 0 270 0", "POLYGON ICRS 0 60 120 60 240 60", square(0, 0, 70), square(359, 45, 3), square(5, 89, 0.1), "POLYGON ICRS 0 -1 179 -1 179 1 0 1"):
        df = spark.createDataFrame([(region,)], "r string").selectExpr(f"{cells.region_struct('r')} AS s")
        n = df.selectExpr(f"size({cells.region_cells('s', 'array(0, 1, 2, 3, 4, 5)')}) AS own", f"size({cells.region_keys('s')}) AS keys").first()
        assert (n.own or 0) <= 60 and (n.keys or 0) <= 200, (region, n)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("radius", [0.6, 20.0, 90.0])
def test_crossmatch(spark, sky_engine, tmp_path, how, radius):
    rows = sky_engine.registry.rows
    a, b = (sky_engine.registry.frame(f"t.{x}") for x in "ab")
    out = crossmatch(a, b, radius, left="s", right="g", how=how)
    assert out.columns == ["s", "g"]
    got = sorted((tuple(r) for r in out.select("s.id", "g.id").collect()), key=repr)
    assert got == joined(rows["a"], rows["b"], lambda p, q: near(p, q, radius), how.upper())
    out.write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == len(got)


def test_crossmatch_refuses_what_it_cannot_do(sky_engine):
    a = sky_engine.registry.frame("t.a")
    for arguments in ({"how": "cross"}, {"how": "left_anti"}, {"radius": 0.0}, {"radius": 181.0}):
        with pytest.raises(ValueError):
            crossmatch(a, a, **{"radius": 1.0, **arguments})


def test_one_true_pair(spark):
    one = spark.createDataFrame([(1, 10.0, 20.0)], "id long, ra double, dec double")
    two = spark.createDataFrame([(7, 10.0, 20.1), (8, 200.0, -20.0)], "id long, ra double, dec double")
    for how, n in (("inner", 1), ("left", 1), ("right", 2), ("full", 2)):
        assert crossmatch(one, two, 1.0, how=how).count() == n
    assert crossmatch(one, two, 1.0).where(sky.distance("a.ra", "a.dec", "b.ra", "b.dec") <= 1.0).count() == 1
