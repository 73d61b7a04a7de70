"""Spherical predicates against plain numpy, pruning against the whole."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from astroloom.adql import translate
from astroloom.functions import columns as sky
from astroloom.functions import healpix, sphere
from astroloom.operators.crossmatch import crossmatch

CENTRES = [(0, 0, 5), (180, 0, 30), (10, 89, 5), (10, -89, 5), (0, 90, 90), (0, 0, 179), (359.9, 10, 0.5), (200, -45, 0)]


def points(n=3000, seed=42):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))


@pytest.fixture(scope="module")
def cloud(spark):
    ra, dec = points()
    rows = [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec, strict=True))]
    return spark.createDataFrame(rows, "id long, ra double, dec double").cache()


def separations(ra0, dec0):
    ra, dec = points()
    return np.array([sphere.separation(a, d, ra0, dec0) for a, d in zip(ra, dec, strict=True)])


@pytest.mark.parametrize(("ra0", "dec0", "r"), CENTRES)
def test_cone_is_the_haversine_ball(cloud, ra0, dec0, r):
    found = {x.id for x in cloud.where(sky.cone_contains("ra", "dec", ra0, dec0, r)).collect()}
    d = separations(ra0, dec0)
    assert {int(i) for i in np.flatnonzero(d <= r - 1e-7)} <= found <= {int(i) for i in np.flatnonzero(d <= r + 1e-7)}
    general = {x.id for x in cloud.where(sky.cone_contains("ra", "dec", f"{ra0}D", f"{dec0}D", f"{r}D")).collect()}
    assert general == found


def test_distance(cloud):
    got = [x[0] for x in cloud.orderBy("id").select(sky.distance("ra", "dec", "56.75D", "24.12D")).collect()]
    assert np.allclose(got, separations(56.75, 24.12), atol=1e-6)


@settings(max_examples=300, deadline=None)
@given(st.floats(0, 360), st.floats(-90, 90), st.floats(0, 180), st.floats(0, 360), st.floats(-1, 1))
def test_ra_half_width_is_a_bound(ra0, dec0, r, bearing, part):
    b, d, dec = math.radians(bearing), math.radians(r * abs(part)), math.radians(dec0)
    dec1 = math.asin(max(-1, min(1, math.sin(dec) * math.cos(d) + math.cos(dec) * math.sin(d) * math.cos(b))))
    ra1 = math.degrees(math.atan2(math.sin(b) * math.sin(d) * math.cos(dec), math.cos(d) - math.sin(dec) * math.sin(dec1)))
    assert abs(ra1) <= sphere.ra_half_width(dec0, r) + 1e-6


def half_space(corners, ra, dec):
    v = np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))], 1)
    out = np.ones(len(ra), bool)
    for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
        out &= v @ np.array(sphere.cross(sphere.unit(*a), sphere.unit(*b))) > 0
    return out


POLYGONS = [
    [(359.0, -1.0), (1.0, -1.0), (1.0, 1.0), (359.0, 1.0)],
    [(0.0, 80.0), (90.0, 80.0), (180.0, 80.0), (270.0, 80.0)],
    [(40.0, 5.0), (75.0, 8.0), (70.0, 41.0), (38.0, 35.0)],
    [(100.0, -60.0), (160.0, -50.0), (130.0, 10.0)],
]


@pytest.mark.parametrize("corners", POLYGONS)
def test_polygon_of_either_winding(cloud, corners):
    ra, dec = points()
    expected = {int(i) for i in np.flatnonzero(half_space(corners, ra, dec))}
    for shape in (corners, corners[::-1], corners[2:] + corners[:2]):
        assert {x.id for x in cloud.where(sky.polygon_contains("ra", "dec", shape)).collect()} == expected


def test_flat_polygons_hold_nothing(cloud):
    assert cloud.where(sky.polygon_contains("ra", "dec", [(0, 0), (10, 0), (20, 0)])).count() == 0


@pytest.mark.parametrize(
    "text", ["", "POLYGON", "POLYGON ICRS 1 2 3 4", "POLYGON ICRS 1 2 3 4 5", "POLYGON FK5 1 2 3 4 5 6", "CIRCLE ICRS 1 2 3", "POLYGON ICRS 1 2 x 4 5 6", "POLYGON ICRS 1 2 3 4 5 NaN", None]
)
def test_bad_regions_match_nothing(spark, text):
    df = spark.createDataFrame([(text,)], "r string")
    assert df.select(F.expr(sphere.parse_region("r")).alias("v")).first().v is None
    assert df.where(sky.region_contains("1D", "2D", "r")).count() == 0


def test_region_spacing_and_case(spark):
    df = spark.createDataFrame([("  polygon  icrs 0 0\t10 0  10 10 0 10 ",)], "r string")
    assert df.where(sky.region_contains("5D", "5D", "r")).count() == 1


def dense_overlap(a, b, box):
    """Whether any of many points of the first shape's box lies in both."""
    x, y, s = box
    ra, dec = np.meshgrid(np.linspace(x, x + s, 220), np.linspace(y - 0.2, y + s + 0.2, 220))
    return bool((a(ra.ravel(), dec.ravel()) & b(ra.ravel(), dec.ravel())).any())


def test_intersections_against_sampling(spark, engine, registry):
    rng = np.random.default_rng(7)
    squares = [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(zip(rng.uniform(0, 30, 14), rng.uniform(-20, 20, 14), rng.uniform(3, 9, 14), strict=True))]
    regions = [(i, f"POLYGON ICRS {x} {y} {x + s} {y} {x + s} {y + s} {x} {y + s}") for i, x, y, s in squares]
    registry.add_frame("cats.squares", spark.createDataFrame(regions, "id long, s_region string"))

    def inside(x, y, s):
        return lambda ra, dec: half_space([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], ra, dec)

    target = [(8.0, -6.0), (24.0, -4.0), (15.0, 14.0)]
    near = lambda ra, dec: half_space(target, ra, dec)
    expected = {i for i, x, y, s in squares if dense_overlap(inside(x, y, s), near, (x, y, s))}
    got = {r["id"] for r in engine.run("SELECT id FROM cats.squares WHERE INTERSECTS(s_region, POLYGON('ICRS', 8, -6, 24, -4, 15, 14)) = 1").table.to_pylist()}
    assert got == expected
    ball = lambda ra, dec: np.array([np.sin(np.radians((dec - 3) / 2)) ** 2 + np.cos(np.radians(dec)) * np.cos(np.radians(3)) * np.sin(np.radians((ra - 12) / 2)) ** 2])[0] <= math.sin(math.radians(2.5)) ** 2  # noqa: E731, E501
    expected = {i for i, x, y, s in squares if dense_overlap(inside(x, y, s), ball, (x, y, s))}
    for shape in ("CIRCLE('ICRS', 12, 3, 5), s_region", "s_region, CIRCLE('ICRS', 12, 3, 5)"):
        got = {r["id"] for r in engine.run(f"SELECT id FROM cats.squares WHERE INTERSECTS({shape}) = 1").table.to_pylist()}
        assert got == expected
    pairs = {(r["a"], r["b"]) for r in engine.run("SELECT a.id AS a, b.id AS b FROM cats.squares a JOIN cats.squares b ON INTERSECTS(a.s_region, b.s_region) = 1").table.to_pylist()}
    plain = {(p[0], q[0]) for p in squares for q in squares if dense_overlap(inside(*p[1:]), inside(*q[1:]), p[1:])}
    assert pairs == plain
    assert engine.run("SELECT COUNT(*) AS n FROM cats.squares a JOIN cats.squares b ON INTERSECTS(a.s_region, b.s_region) = 1").table.to_pylist() == [{"n": len(plain)}]


def test_crossing_without_a_vertex_inside(spark):
    cross = f"POLYGON ICRS -1 -10 1 -10 1 10 -1 10".replace("-1 -10", "359 -10").replace("-1 10", "359 10")
    df = spark.createDataFrame([(cross, "POLYGON ICRS 350 -1 10 -1 10 1 350 1", "POLYGON ICRS 170 -1 190 -1 190 1 170 1")], "a string, b string, c string")
    a, b, c = (sphere.parse_region(x) for x in "abc")
    row = df.select(F.expr(sphere.polygons_meet(a, b)).alias("ab"), F.expr(sphere.polygons_meet(a, c)).alias("ac")).first()
    assert (row.ab, row.ac) == (True, False)


def test_region_joins(engine):
    got = engine.run("SELECT s.id, f.id AS f FROM cats.stars s, cats.footprints f WHERE CONTAINS(POINT('ICRS', s.ra, s.dec), f.s_region) = 1 ORDER BY 1")
    assert [tuple(r.values()) for r in got.table.to_pylist()] == [(1, 2), (4, 1)]
    star = engine.run("SELECT * FROM cats.stars s, cats.footprints f WHERE CONTAINS(POINT('ICRS', s.ra, s.dec), f.s_region) = 1")
    assert star.table.column_names == ["id", "ra", "dec", "mag", "name", "id", "ra", "dec", "s_region"]


@pytest.mark.parametrize("radius", [0.05, 1.0, 7.0])
def test_crossmatch_equals_all_pairs(spark, cloud, radius):
    other = cloud.where("id % 7 = 0").selectExpr("id", "pmod(ra + 0.03, 360D) AS ra", "least(90D, dec + 0.02) AS dec")
    poles = spark.createDataFrame([(10001, 10.0, 89.99), (10002, 200.0, 89.98), (10003, 0.001, -5.0), (10004, None, 1.0)], "id long, ra double, dec double")
    more = spark.createDataFrame([(20001, 190.0, 89.995), (20002, 359.999, -5.0), (20003, 1.0, None)], "id long, ra double, dec double")
    a, b = cloud.union(poles), other.union(more)
    got = {(r[0], r[1]) for r in crossmatch(a, b, radius).select("a.id", "b.id").collect()}
    plain = a.alias("a").crossJoin(b.alias("b")).where(sky.distance("a.ra", "a.dec", "b.ra", "b.dec") <= radius)
    assert got == {(r[0], r[1]) for r in plain.select("a.id", "b.id").collect()}
    assert crossmatch(a, b, radius).count() == len(got)


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_healpix_pixels_lie_in_their_caps(order):
    ra, dec = points(2000, 3)
    for a, d in zip(ra.tolist() + [0.0, 45.0, 90.0], dec.tolist() + [90.0, 0.0, -90.0], strict=True):
        c = healpix.cap(order, healpix.pixel_of(order, a, d))
        assert sphere.separation(a, d, c[0], c[1]) <= c[2]


def test_healpix_centres_round_trip():
    for order in (0, 1, 2, 4):
        for p in range(12 << 2 * order):
            assert healpix.pixel_of(order, *healpix.centre(order, p)) == p


def test_plain_comparisons_reach_the_scan(spark, tmp_path, registry, engine, cloud):
    cloud.write.parquet(str(tmp_path / "c.parquet"))
    registry.add_frame("cats.cloud", spark.read.parquet(str(tmp_path / "c.parquet")), ra_column="ra", dec_column="dec")
    df = engine.frame("SELECT id FROM cats.cloud WHERE CONTAINS(POINT('ICRS', ra, dec), CIRCLE('ICRS', 56.75, 24.12, 1.5)) = 1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(dec" in plan and "LessThanOrEqual(dec" in plan
    assert "PythonUDF" not in plan and "ArrowEval" not in plan


def test_joins_by_distance_are_equi_joins(engine):
    q = "SELECT s.id, g.galaxy_id FROM cats.stars s JOIN cats.galaxies g ON CONTAINS(POINT('ICRS', s.ra, s.dec), CIRCLE('ICRS', g.ra, g.dec, 1.0)) = 1"
    plan = engine.frame(q)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(tuple(r.values()) for r in engine.run(q).table.to_pylist()) == [(1, 1), (4, 9)]


ROWS = [(1, 56.75, 24.12), (2, 56.80, 24.14), (3, 200.0, -10.0), (4, 200.05, -10.02), (5, 100.0, -87.0), (6, 95.0, -88.0), (7, 0.3, -40.0), (8, 359.7, -40.0)]


@pytest.fixture
def sharded(spark, tmp_path):
    """A HEALPix-partitioned folder, one order for half the sky, another for the rest."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path / "cat"
    parts = {}
    for r in ROWS:
        order = 1 if r[2] > -50 else 0
        parts.setdefault((order, healpix.pixel_of(order, r[1], r[2])), []).append(r)
    (root).mkdir()
    (root / "partition_info.csv").write_text("Norder,Npix\n" + "\n".join(f"{o},{p}" for o, p in parts))
    for (order, pixel), rows in parts.items():
        folder = root / "dataset" / f"Norder={order}" / "Dir=0"
        folder.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"id": [r[0] for r in rows], "ra": [r[1] for r in rows], "dec": [r[2] for r in rows]}), folder / f"Npix={pixel}.parquet")
    return root, parts


@pytest.mark.parametrize("cone", [(56.77, 24.13, 0.1), (0, -40, 1), (97, -87.5, 2), (150, 40, 0.05), (10, 10, 100)])
def test_shard_pruning(spark, sharded, cone):
    from astroloom.engine import Engine
    from astroloom.sources.discovery import discover

    root, parts = sharded
    registry = discover(spark, [str(root)])
    table = registry.find(f"{root.parent.name.lower().replace('-', '_')}.cat") or next(t for t in registry.tables.values() if t.name == "cat")
    assert table.hats_order == 1 and len(table.shards) == len(parts)
    engine = Engine(spark, registry)
    where = f"CONTAINS(POINT('ICRS', ra, dec), CIRCLE('ICRS', {cone[0]}, {cone[1]}, {cone[2]}))"
    expected = {r[0] for r in ROWS if sphere.separation(r[1], r[2], cone[0], cone[1]) <= cone[2]}
    t = translate(f"SELECT id FROM {table.qualified} WHERE {where} = 1", registry)
    kept = len(next(iter(t.pruned.values()))[1]) if t.pruned else len(parts)
    if cone[2] < 1:
        assert kept <= 1 or cone == (150, 40, 0.05) and kept == 0
    for text in (f"{where} = 1", f"1 = {where}", f"id > 0 AND {where} = 1"):
        got = {r["id"] for r in engine.run(f"SELECT id FROM {table.qualified} WHERE {text}").table.to_pylist()}
        assert got == expected
    # In a join the cone has to name the table.
    registry.add_frame("up.mine", spark.createDataFrame([(r[0], r[1] + 0.001, r[2]) for r in ROWS], "mine long, ra double, dec double"))
    named = where.replace("ra, dec", "s.ra, s.dec", 1)
    for kind in ("JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN"):
        q = f"SELECT s.id, u.mine FROM {table.qualified} s {kind} up.mine u ON DISTANCE(POINT('ICRS', s.ra, s.dec), POINT('ICRS', u.ra, u.dec)) < 0.01 WHERE {named} = 1"
        assert {(r["id"], r["mine"]) for r in engine.run(q).table.to_pylist()} == {(i, i) for i in expected}, kind
        assert bool(translate(q, registry).pruned) == bool(t.pruned)
    registry.remove("up.mine")
    # What does not have to hold prunes nothing.
    for text, rows in ((f"{where} = 0", {r[0] for r in ROWS} - expected), (f"{where} = 1 OR id < 3", expected | {1, 2})):
        q = f"SELECT id FROM {table.qualified} WHERE {text}"
        assert not translate(q, registry).pruned
        assert {r["id"] for r in engine.run(q).table.to_pylist()} == rows


@pytest.mark.parametrize("order", [0, 1, 3, 7])
def test_healpix_pixels_as_sql(spark, order):
    ra, dec = points(3000, 7)
    rows = list(zip(ra.tolist() + [0.0, 45.0, 90.0, 359.999999, -10.0, 360.0], dec.tolist() + [90.0, 0.0, -90.0, 41.8, -41.9, 12.0], strict=True))
    df = spark.createDataFrame([(float(a), float(d)) for a, d in rows], "x double, h double")
    got = [r.p for r in df.select(F.expr(healpix.pixel_sql(order, "x", "h")).alias("p")).collect()]
    assert got == [healpix.pixel_of(order, a, d) for a, d in rows]
