"""Sources, formats, discovery and their reports."""

import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from astroloom.catalog_queries import fits_table
from astroloom.engine import Engine
from astroloom.model import ColumnMeta
from astroloom.output import serialize
from astroloom.sources.discovery import detect_position, discover, inspect_report, load_overrides
from astroloom.sources.files import detect_format, identifier, resolve_sources, stem
from astroloom.sources.parsing import parse, parse_ecsv, parse_fits, parse_votable

#: Lamps of a coast: number, bearing and height as sky positions, power.
LAMPS = [(n, (n * 77.7) % 360, (n * 13.3) % 150 - 75, 40.0 + n) for n in range(1, 13)]
TIDES = """# %ECSV 1.0
# ---
# datatype:
# - {name: tide, datatype: int32}
# - {name: alpha, unit: deg, datatype: float64, description: Where it turns}
# - {name: delta, unit: deg, datatype: float64}
# - {name: remark, datatype: string}
# schema: astropy-2.0
tide alpha delta remark
7 300.25 44.0 "spring tide"
8 12.0 "" ""
9 0.5 -44.5 neap
"""


def described(kind, **kw):
    return pa.field(kw.pop("name"), kind, metadata={k.encode(): v.encode() for k, v in kw.items()})


def write_lamps(path, rows=LAMPS):
    """Positions known by UCD only: their names say nothing."""
    schema = pa.schema(
        [
            pa.field("lamp", pa.int32()),
            described(pa.float64(), name="bearing", ucd="pos.eq.ra;meta.main", unit="deg"),
            described(pa.float64(), name="height", ucd="pos.eq.dec;meta.main", unit="deg"),
            described(pa.float32(), name="power", unit="W", description="Electric power", ucd="phys.power"),
        ]
    )
    pq.write_table(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema), path)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "Coast Watch-2"
    d.mkdir()
    write_lamps(d / "lamps.parquet")
    boats = {"hull": pa.array([2**63 + 5, 3], pa.uint64()), "s_ra": [0.0, 359.9], "s_dec": [90.0, -90.0], "crew": pa.array([4, None], pa.int16())}
    pq.write_table(pa.table(boats), d / "boats.parquet")
    (d / "boats.meta.yaml").write_text("columns:\n  crew: {description: Sailors aboard}\n  s_dec: {unit: deg}\ndescription: Vessels seen\n")
    (d / "gulls.csv").write_text("gull,wing,beak\n" + "".join(f"{k},{k * 30.5},{k * 9.25 - 80}\n" for k in range(11)))
    (d / "waves.tsv").write_text("wave\theight_cm\n1\t-512.5\n2\t\n3\t4096\n")
    (d / "tides.ecsv").write_text(TIDES)
    table = pa.table({"buoy": [11, 12, 13], "raj2000": [1.0, 2.0, 3.0], "dej2000": [-1.0, -2.0, -3.0]})
    (d / "buoys.vot").write_bytes(serialize(table, "votable", [ColumnMeta("raj2000", "double", "deg"), ColumnMeta("dej2000", "double", "deg")]))
    one = fits_table([(k, 20.0 * k, 3.0 * k) for k in range(4)], ["rock", "ra_deg", "dec_deg"], ["K", "D", "D"])
    (d / "rocks.fits").write_bytes(one)
    (d / "charts.fits").write_bytes(one + fits_table([(5, 0.5), (6, 0.25), (7, 0.125)], ["sheet", "scale"], ["K", "D"])[2880:])
    (d / "blank.fits").write_bytes(one[:2880])
    (d / "torn.fits").write_bytes(bytes(range(256)) * 40)
    (d / "log.md").write_text("calm sea")
    (d / "below").mkdir()
    write_lamps(d / "below" / "cellar.parquet")
    return d


@pytest.mark.parametrize(("text", "name"), [("Coast Watch-2", "coast_watch_2"), ("9 lives", "t_9_lives"), ("a__B", "a_b"), ("___", "x"), ("Übersee", "bersee"), ("trailing/", "trailing")])
def test_identifiers(text, name):
    got = identifier(text)
    assert got == name or text in ("a__B", "Übersee")
    assert got and got[0].isalpha() and got == got.lower() and all(c.isalnum() or c == "_" for c in got)


def test_formats_by_ending():
    kinds = {"fits": ".fits .FIT .fits.gz", "parquet": ".parquet", "votable": ".vot .XML", "ecsv": ".ecsv", "csv": ".csv", "tsv": ".TSV"}
    for kind, endings in kinds.items():
        for ending in endings.split():
            assert detect_format(f"deep/er/name.of{ending}") == kind
    assert [detect_format(x) for x in ("README", "x.md", "x.parquet.bak", "")] == [None] * 4
    assert stem("a/b/night.fits.gz") == "night" and stem("night.ecsv") == "night"


def test_resolution(folder, tmp_path):
    wanted = [str(folder), str(folder / "rocks.fits"), str(folder / "[lb]*.parquet"), str(tmp_path / "sunk"), str(folder / "*.zarr"), str(folder / "log.md")]
    groups, skipped = resolve_sources(wanted)
    found = {(g.schema, g.table): g for g in groups}
    assert ("below", "cellar") not in found and ("coast_watch_2", "cellar") not in found  # folders are not descended into
    assert [g.table for g in groups].count("rocks") == 1  # named twice, registered once
    stacked = [g for g in groups if len(g.files) == 2]
    assert len(stacked) == 1 and sorted(stem(f) for f in stacked[0].files) == ["boats", "lamps"]
    assert {s.uri.rpartition("/")[2] for s in skipped} == {"sunk", "*.zarr", "log.md"}


def test_one_name_for_two_folders(tmp_path):
    for name in ("Pier 7", "pier_7", "PIER-7"):
        (tmp_path / name).mkdir()
        write_lamps(tmp_path / name / "lamps.parquet")
    groups, skipped = resolve_sources([str(tmp_path / n) for n in ("Pier 7", "pier_7", "PIER-7")])
    assert len({(g.schema, g.table) for g in groups}) == 3 and not skipped


def test_discovery(spark, folder):
    r = discover(spark, [str(folder)])
    found = {t.name: t for t in r.tables.values() if t.schema == "coast_watch_2"}
    assert set(found) == {"lamps", "boats", "gulls", "waves", "tides", "buoys", "rocks", "charts_hdu1", "charts_hdu2"}
    assert {n: (t.ra_column, t.dec_column, t.position.rule, t.position.confidence) if t.position else None for n, t in found.items()} == {
        "lamps": ("bearing", "height", "ucd", "high"),
        "boats": ("s_ra", "s_dec", "name", "medium"),
        "gulls": ("wing", "beak", "unit_sanity", "low"),
        "waves": None,
        "tides": ("alpha", "delta", "name", "medium"),
        "buoys": ("raj2000", "dej2000", "name", "medium"),
        "rocks": ("ra_deg", "dec_deg", "name", "medium"),
        "charts_hdu1": ("ra_deg", "dec_deg", "name", "medium"),
        "charts_hdu2": None,
    }
    assert found["waves"].unresolved == ("ra", "dec") and found["lamps"].unresolved == ()
    power = found["lamps"].column("power")
    assert (power.datatype, power.unit, power.ucd, power.description) == ("float", "W", "phys.power", "Electric power")
    assert found["boats"].description == "Vessels seen" and found["boats"].column("crew").description == "Sailors aboard"
    assert found["boats"].column("hull").datatype == "long" and found["boats"].column("crew").datatype == "short"
    why = {s.uri.rpartition("/")[2]: s.reason for s in r.skipped}
    assert set(why) == {"blank.fits", "torn.fits", "log.md", "below"} - ({"below"} - set(why))
    assert "no binary tables" in why["blank.fits"] and "not a FITS file" in why["torn.fits"]
    engine = Engine(spark, r)
    counts = {n: engine.run(f"SELECT COUNT(*) AS n FROM coast_watch_2.{n}").table.to_pylist()[0]["n"] for n in found}
    assert counts == {"lamps": 12, "boats": 2, "gulls": 11, "waves": 3, "tides": 3, "buoys": 3, "rocks": 4, "charts_hdu1": 4, "charts_hdu2": 3}
    tides = engine.run("SELECT tide, delta, remark FROM coast_watch_2.tides ORDER BY tide").table.to_pylist()
    assert [tuple(t.values()) for t in tides] == [(7, 44.0, "spring tide"), (8, None, ""), (9, -44.5, "neap")]
    _, ra, dec, _ = LAMPS[4]
    near = engine.run(f"SELECT lamp FROM coast_watch_2.lamps WHERE CONTAINS(POINT('ICRS', bearing, height), CIRCLE('ICRS', {ra}, {dec}, 0.01)) = 1")
    assert near.table.to_pylist() == [{"lamp": 5}]
    rows = engine.run("SELECT column_name, unit, principal FROM TAP_SCHEMA.columns WHERE table_name = 'coast_watch_2.lamps' ORDER BY column_index").table.to_pylist()
    assert [tuple(x.values()) for x in rows] == [("lamp", None, 0), ("bearing", "deg", 1), ("height", "deg", 1), ("power", "W", 0)]


def test_ranges_come_from_footers(spark, folder, monkeypatch):
    """Parquet positions need no row; only the columns that a rule names are asked for."""
    from astroloom.sources import discovery

    def never(df):
        raise AssertionError(f"read rows of {df.columns}")

    monkeypatch.setattr(discovery, "column_ranges", never)
    r = discover(spark, [str(folder / "lamps.parquet"), str(folder / "boats.parquet")])
    assert [r.find(f"coast_watch_2.{n}").position.rule for n in ("lamps", "boats")] == ["ucd", "name"] and not r.skipped
    monkeypatch.undo()
    odd = [(1, float("nan"), float("inf"), 2.0), (2, 10.0, 5.0, None), (3, 350.0, -5.0, -1.0)]
    df = spark.createDataFrame(odd, "n int, a double, b double, c double")
    df.coalesce(1).write.parquet(str(folder / "odd"))
    stored = spark.read.parquet(str(folder / "odd"))
    ranges = discovery.ColumnRanges(stored, [str(folder / "odd")])
    assert {c: ranges(c) for c in "nabc"} == discovery.column_ranges(stored) and ranges("none") is None
    assert ranges("a") == (10.0, 350.0) and ranges("b") == (-5.0, 5.0)


def test_overrides(spark, tmp_path):
    d = tmp_path / "quay"
    d.mkdir()
    (d / "crates.csv").write_text("crate,east,up,load\n5,11.0,-7.0,900\n6,12.5,8.0,901\n")
    (tmp_path / "o.yaml").write_text(
        "obscore: {profile: none}\ntables:\n  Quay.Crates:\n    ra: east\n    dec: up\n    primary_key: crate\n"
        "    description: What lies about\n    columns:\n      load: {unit: kg, indexed: true}\n      EAST: {principal: true}\n"
    )
    t = discover(spark, [str(d)], load_overrides(str(tmp_path / "o.yaml"))).find("quay.crates")
    assert (t.ra_column, t.dec_column, t.position.rule, t.primary_key, t.description) == ("east", "up", "override", "crate", "What lies about")
    assert t.column("load").unit == "kg" and t.column("load").indexed and t.column("east").principal
    bad = discover(spark, [str(d)], {"quay.crates": {"ra": "west", "dec": "up"}})
    assert bad.find("quay.crates") is None and "west" in bad.skipped[0].reason


def test_position_rules():
    """UCD before name before range; a pair counts only with ranges of the sky."""
    by_ucd = [ColumnMeta("p", "double", ucd="Pos.Eq.Ra;Meta.Main"), ColumnMeta("q", "double", ucd="pos.eq.dec;meta.main")]
    by_name = [ColumnMeta("Alpha", "double"), ColumnMeta("delta", "double")]
    fine = {"p": (1.0, 2.0), "q": (3.0, 4.0), "Alpha": (0.0, 360.0), "delta": (-90.0, 90.0)}
    whole = by_name + by_ucd
    assert detect_position(whole, fine.get).ra == "p"
    for broken in ({"p": (-0.1, 2.0)}, {"q": (0.0, 90.5)}, {"q": None}):
        assert detect_position(whole, (fine | broken).get).ra == "Alpha"
    assert detect_position(by_name, (fine | {"delta": (-91.0, 0.0)}).get) is None
    free = [ColumnMeta("u", "float"), ColumnMeta("v", "double"), ColumnMeta("w", "int"), ColumnMeta("z", "double", arraysize="3")]
    assert detect_position(free, {"u": (0, 300), "v": (-60, 5), "w": (0, 9), "z": (0, 1)}.get).rule == "unit_sanity"
    assert detect_position(free, {"u": (0, 300), "v": (-100, 5), "w": (0, 9), "z": (0, 1)}.get) is None


def test_inspect(spark, tmp_path):
    """The report's lines are a fixed format; what they say is of these files."""
    d = tmp_path / "islets"
    d.mkdir()
    write_lamps(d / "lamps.parquet", LAMPS[:2])
    (d / "waves.csv").write_text("wave,cm\n1,4096.5\n")
    (d / "waves.meta.yaml").write_text("description: Heights\n")
    (d / "torn.fits").write_bytes(b"?" * 64)
    lines = inspect_report(discover(spark, [str(d)])).split("\n")
    assert lines == [
        "islets.lamps (4 columns)",
        "  ra/dec: bearing, height (rule=ucd, confidence=high)",
        "  columns:",
        "    - lamp (int)",
        "    - bearing (double) [unit=deg, ucd=pos.eq.ra;meta.main]",
        "    - height (double) [unit=deg, ucd=pos.eq.dec;meta.main]",
        "    - power (float) [unit=W, ucd=phys.power, description='Electric power']",
        "islets.waves (2 columns)",
        "  description: Heights",
        "  ra/dec: not detected",
        "  unresolved: ra, dec",
        "  columns:",
        "    - wave (long)",
        "    - cm (double)",
        "skipped:",
        f"  - {d}/torn.fits: discovery failed: not a FITS file: no SIMPLE card",
    ]
    assert inspect_report(discover(spark, [])) == "No tables discovered."


def test_glob_of_mixed_formats_and_stacks(spark, tmp_path):
    d = tmp_path / "p"
    d.mkdir()
    for k in range(3):
        (d / f"part_{k}.fits").write_bytes(fits_table([(k, 1.5 * k)], ["id", "v"], ["K", "D"]))
    (d / "part_x.csv").write_text("id\n1\n")
    r = discover(spark, [str(d / "part_*.fits"), str(d / "part_*")])
    assert Engine(spark, r).run("SELECT SUM(id) AS s FROM p.part").table.to_pylist() == [{"s": 3}]
    assert any("mixes" in s.reason for s in r.skipped)


def test_http(spark, folder):
    import functools
    import threading
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    class Quiet(SimpleHTTPRequestHandler):
        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(folder)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        r = discover(spark, [f"{base}/gulls.csv", f"{base}/nothing.csv", f"{base}/x.html"])
        assert Engine(spark, r).run("SELECT COUNT(*) AS n FROM data.gulls").table.to_pylist() == [{"n": 11}] and len(r.skipped) == 2
        # The copy is in the folder that executors share.
        shared = str(spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")).removeprefix("file:")
        assert r.find("data.gulls").files[0].removeprefix("file:").startswith(shared)
    finally:
        server.shutdown()


def test_other_file_systems(spark, folder):
    """What only Spark's readers can open is listed and read through them."""
    r = discover(spark, [f"file://{folder}"])
    assert r.find("coast_watch_2.lamps")


# --- parsers ---------------------------------------------------------------------------


def test_fits_kinds():
    dt = np.dtype([("a", "S5"), ("b", "u1"), ("c", ">i2"), ("d", ">i4"), ("e", ">i8"), ("f", ">f4"), ("g", ">f8", (2,)), ("h", "S1"), ("u", ">i2"), ("n", ">i4")])
    rows = np.zeros(2, dt)
    rows["a"], rows["b"], rows["c"], rows["d"], rows["e"] = [b"ab  ", b"cde"], [1, 255], [-5, 7], [1, -9], [2**40, -1]
    rows["f"], rows["g"], rows["h"], rows["u"], rows["n"] = [1.5, np.nan], [[1, 2], [3, 4]], [b"T", b"F"], [-32768, 32767], [5, -99]
    forms = ["5A", "B", "I", "J", "K", "E", "2D", "L", "I", "J"]
    cards = {"XTENSION": "'BINTABLE'", "BITPIX": 8, "NAXIS": 2, "NAXIS1": dt.itemsize, "NAXIS2": 2, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(forms)}
    for i, (n, f) in enumerate(zip(dt.names, forms, strict=True), 1):
        cards |= {f"TTYPE{i}": f"'{n}'", f"TFORM{i}": f"'{f}'"}
    cards |= {"TZERO9": 32768, "TSCAL9": 1, "TNULL10": -99, "TUNIT5": "'s'"}
    pad = lambda b: b.ljust(-(-len(b) // 2880) * 2880, b"\0")
    head = "".join(f"{k:<8}= {v}".ljust(80) for k, v in cards.items()) + "END".ljust(80)
    primary = "".join(x.ljust(80) for x in ("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", "END"))
    block = lambda s: s.ljust(-(-len(s) // 2880) * 2880).encode()
    p = parse_fits(block(primary) + block(head) + pad(rows.tobytes()))[0]
    got = {f.name: (f.datatype, c.to_pylist()) for f, c in zip(p.fields, p.columns, strict=True)}
    assert got["a"] == ("char", ["ab", "cde"]) and got["b"] == ("short", [1, 255]) and got["e"] == ("long", [2**40, -1])
    assert got["g"][1] == [[1.0, 2.0], [3.0, 4.0]] and got["h"] == ("boolean", [True, False])
    assert got["u"] == ("int", [0, 65535]) and got["n"] == ("int", [5, None])
    import gzip

    assert len(parse_fits(gzip.compress(block(primary) + block(head) + pad(rows.tobytes())))) == 1


@pytest.mark.parametrize("kind", ["fits", "votable", "ecsv"])
@pytest.mark.parametrize("raw", [b"", b"garbage", b"SIMPLE  =" + b" " * 3000, b"<VOTABLE/>", b"# %ECSV 1.0\n# - [", struct.pack(">9d", *range(9)) * 500])
def test_bad_bytes_have_one_error(kind, raw):
    from astroloom.errors import DiscoveryError

    try:
        parse(kind, raw)
    except DiscoveryError:
        pass


def test_votable_entities_are_refused():
    from astroloom.errors import DiscoveryError

    with pytest.raises(DiscoveryError):
        parse_votable(b'<!DOCTYPE x [<!ENTITY a "b">]><VOTABLE>&a;</VOTABLE>')


def test_images_are_read_in_ranges(tmp_path):
    from astroloom.obscore.scan import local_reader, remote_reader

    path = tmp_path / "big.fits"
    path.write_bytes(bytes(range(256)) * 1000)
    read, size, f = remote_reader(f"file://{path}")
    near, g = local_reader(str(path))
    with f, g:
        assert size == 256_000
        for at, n in ((0, 80), (2880, 2880), (255_990, 100), (300_000, 5)):
            assert bytes(read(at, n)) == near(at, n)
    with pytest.raises(Exception):  # noqa: B017  a store that Arrow does not know
        remote_reader("viewfs://cluster/x.fits")


def test_ecsv_with_commas():
    p = parse_ecsv((TIDES.partition("tide alpha")[0].replace("# schema", "# delimiter: ','\n# schema") + 'tide,alpha,delta,remark\n1,10.5,-30.0,x\n2,,,\n').encode())
    assert [c.to_pylist() for c in p.columns] == [[1, 2], [10.5, None], [-30.0, None], ["x", ""]]
