"""Protocols: parameters, queries, jobs, searches, images, HTTP."""

import datetime as dt
import json
import threading
import time
import xml.etree.ElementTree as ET

import numpy as np
import pyarrow as pa
import pytest

from astroloom.errors import InvalidParameterError, ServiceError, UnsupportedFormatError
from astroloom.obscore import caom, scan
from astroloom.obscore.wcs import Tan, footprint
from astroloom.output import serialize
from astroloom.service import links, search, tap, vosi
from astroloom.service.http import Service, form, server
from astroloom.service.jobs import Jobs
from astroloom.service.links import write_image
from astroloom.service.params import Parameters, TapRequest, tap_request
from astroloom.sources.parsing import hdus, parse_votable

OK = [("REQUEST", "doQuery"), ("lang", "ADQL"), ("Query", "SELECT id FROM cats.stars ORDER BY id")]


def test_parameters():
    r = tap_request(Parameters([*OK, ("FORMAT", "csv"), ("RESPONSEFORMAT", "json"), ("MAXREC", "5"), ("UPLOAD", "A,param:x;b,param:y")]))
    assert (r.format, r.maxrec, r.uploads) == ("json", 5, {"a": "x", "b": "y"})
    for bad in ([("LANG", "ADQL")], [("QUERY", "x")], [*OK, ("QUERY", "y")], [*OK, ("MAXREC", "-1")], [*OK, ("MAXREC", "x")], [*OK, ("UPLOAD", "a")], [("LANG", "SQL"), ("QUERY", "x")], [("REQUEST", "x"), *OK[1:]], [*OK, ("UPLOAD", "a,param:x"), ("UPLOAD", "A,param:y")]):
        with pytest.raises(InvalidParameterError):
            tap_request(Parameters(bad))
    with pytest.raises(UnsupportedFormatError):
        tap_request(Parameters([*OK, ("FORMAT", "doc")]))


def test_sync(spark, engine):
    log = tap.QueryLog(spark)
    r = tap.sync(engine, [*OK, ("FORMAT", "json"), ("MAXREC", "2")], log=log, token="secret")
    assert (r.status, json.loads(r.body)["data"]) == (200, [[1], [2]])
    r = tap.sync(engine, [("LANG", "ADQL"), ("QUERY", "SELECT x FROM cats.stars")], log=log)
    assert r.status == 400 and b"Unknown column" in r.body and b"ERROR" in r.body
    log.register(engine.registry)
    rows = engine.run("SELECT endpoint, row_count, status, token_hash FROM service.query_log ORDER BY started_at").table.to_pylist()
    again = tap.sync(engine, [("LANG", "ADQL"), ("FORMAT", "csv"), ("QUERY", "SELECT COUNT(*) AS n FROM service.query_log")], log=log)
    assert again.body == b"n\n2\n"
    assert [x["status"] for x in rows] == ["OK", "ERROR"] and rows[0]["row_count"] == 2 and "secret" not in str(rows)


def test_log_appends(spark, tmp_path):
    log = tap.QueryLog(spark, str(tmp_path / "log"), every=2)
    for k in range(5):
        log.record("/x", f"q{k}", "csv", None, k, 0.1)
    log.flush()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5


def test_upload(engine, spark):
    body = serialize(pa.table({"k": [1, 2, 7], "n": ["x", "y", "z"]}), "votable")
    q = [("LANG", "ADQL"), ("FORMAT", "json"), ("UPLOAD", "Mine,param:p"), ("QUERY", "SELECT s.id, u.n FROM cats.stars s JOIN TAP_UPLOAD.mine u ON s.id = u.k ORDER BY s.id")]
    assert json.loads(tap.sync(engine, q, {"p": body}).body)["data"] == [[1, "x"], [2, "y"]]
    assert tap.sync(engine, q, {}).status == 400 and tap.sync(engine, q, {"p": b"junk"}).status == 400
    assert engine.registry.find("tap_upload.mine") is None
    assert not [t for t in spark.catalog.listTables() if "tap_upload" in t.name]
    with pytest.raises(ServiceError), tap.uploaded(engine, {"m": "p"}, {"p": b"x" * (2 << 20)}, 1):
        pass


def test_cone_search(engine):
    r = search.cone_search(engine, "cats.stars", [("RA", "0"), ("DEC", "0"), ("SR", "1"), ("VERB", "3")])
    assert r.status == 200 and [c.to_pylist() for c in parse_votable(r.body).columns][0] == [4]
    assert len(parse_votable(search.cone_search(engine, "cats.stars", [("ra", "0"), ("dec", "0"), ("sr", "1")]).body).fields) == 2
    for bad in ([("RA", "0"), ("DEC", "0")], [("RA", "361"), ("DEC", "0"), ("SR", "1")], [("RA", "0"), ("DEC", "x"), ("SR", "1")], [("RA", "0"), ("DEC", "0"), ("SR", "1"), ("VERB", "4")]):
        assert search.cone_search(engine, "cats.stars", bad).status == 400
    assert search.cone_search(engine, "cats.nothing", [("RA", "0"), ("DEC", "0"), ("SR", "1")]).status == 400


@pytest.mark.parametrize(
    ("pairs", "text"),
    [
        ([], "SELECT * FROM ivoa.obscore"),
        ([("BAND", "1e-7 +Inf")], "WHERE (em_max >= 1e-07)"),
        ([("BAND", "-Inf +Inf")], "WHERE 1 = 1"),
        ([("TIME", "5"), ("POL", "I")], "(t_min <= 5.0 AND t_max >= 5.0) AND pol_states LIKE '%/I/%'"),
        ([("COLLECTION", "a"), ("COLLECTION", "b")], "(obs_collection = 'a' OR obs_collection = 'b')"),
        ([("POS", "RANGE 350 10 -5 5")], "OR INTERSECTS(POLYGON"),
        ([("POS", "RANGE 0 360 -90 90")], "WHERE 1 = 1"),
        ([("POS", "RANGE 10 20 -Inf 5")], "s_dec <= 5.0"),
    ],
)
def test_image_search_text(pairs, text):
    assert text in search.image_search_adql(Parameters(pairs))


@pytest.mark.parametrize("pairs", [[("POS", "BOX 1 2 3")], [("POS", "CIRCLE 1 2")], [("POS", "CIRCLE 1 2 nan")], [("BAND", "2 1")], [("POL", "I_")], [("COLLECTION", "a' OR 1=1")], [("POS", "POLYGON 1 2 3 4 5")], [("POS", "RANGE 1 2 5 3")]])
def test_image_search_refuses(pairs):
    with pytest.raises(InvalidParameterError):
        search.image_search_adql(Parameters(pairs))


# --- images ------------------------------------------------------------------------------


def image_file(path, crval=(200.0, -10.0), size=(100, 80), step=0.0005, **cards):
    wcs = Tan(((size[0] + 1) / 2, (size[1] + 1) / 2), crval, ((-step, 0.0), (0.0, step)))
    data = np.arange(size[0] * size[1], dtype=">f4").reshape(size[1], size[0])
    path.write_bytes(write_image(data, wcs.cards() | cards))
    return wcs, data


@pytest.fixture
def images(spark, registry, tmp_path):
    d = tmp_path / "images"
    d.mkdir()
    image_file(d / "basic.fits", TELESCOP="Hubble", INSTRUME="WFC", OBJECT="M42", FILTER="V", EXPTIME=60.0, **{"DATE-OBS": "2024-01-01T00:00:00"})
    image_file(d / "ra0.fits", (0.0, 0.0), (20, 20), 0.05)
    image_file(d / "pole.fits", (120.0, 89.95), (20, 20), 0.02)
    (d / "no_wcs.fits").write_bytes(write_image(np.zeros((10, 10), ">i2"), {}))
    (d / "corrupt.fits").write_bytes(b"junk" * 2000)
    return d, caom.attach_images(spark, registry, [str(d)], "http://h/t/x")


def test_scan(spark, images):
    found, skipped = scan.scan_images(spark, [str(images[0])])
    assert [s.uri.rpartition("/")[2] for s in skipped] == ["corrupt.fits"] and len(found) == 4
    o = {x.value("obs_id"): x for x in found}
    b = o["basic"]
    assert b.fields["facility_name"] == ("Hubble", "TELESCOP", "high") and b.fields["em_min"] == (5.0e-7, "profile:generic-fits-wcs.bands.V", "medium")
    assert b.value("t_min") == 60310.0 and b.value("t_max") == pytest.approx(60310 + 60 / 86400)
    assert b.value("s_ra") == pytest.approx(200) and b.value("s_dec") == pytest.approx(-10) and b.value("s_resolution") == pytest.approx(1.8)
    assert b.value("s_region").startswith("POLYGON ICRS ") and len(b.value("s_region").split()) == 42
    assert "s_region" in o["no_wcs"].unresolved and o["no_wcs"].value("naxis1") == 10


def test_yaml_round_trip(spark, images, tmp_path):
    found, skipped = scan.scan_images(spark, [str(images[0])])
    scan.write_yaml(found, skipped, str(tmp_path / "d.yaml"))
    again, left = scan.read_yaml(str(tmp_path / "d.yaml"))
    assert [x.__dict__ for x in again] == [x.__dict__ for x in found] and left == skipped


def test_wcs_round_trip():
    for crval in ((0.0, 0.0), (120.0, 89.95), (200.0, -60.0)):
        w = Tan((50.5, 40.5), crval, ((-0.01, 0.002), (0.001, 0.012)))
        x, y = np.meshgrid(np.linspace(1, 100, 7), np.linspace(1, 80, 7))
        back = w.pixel(*w.sky(x, y))
        assert np.allclose(back[0], x, atol=1e-6) and np.allclose(back[1], y, atol=1e-6)
        assert np.allclose(w.sky(*w.crpix)[1], crval[1])
    assert Tan.of({"CTYPE1": "RA---SIN", "CTYPE2": "DEC--SIN"}) is None
    f = footprint(Tan((10.5, 10.5), (0.0, 0.0), ((-0.05, 0), (0, 0.05))), 20, 20)
    assert len(f.vertices) == 20 and f.fov == pytest.approx(2**0.5, rel=1e-3)


def test_obscore(engine, images):
    rows = engine.run("SELECT obs_id, obs_collection, s_xel1, access_estsize, t_xel, facility_name FROM ivoa.obscore ORDER BY obs_id").table.to_pylist()
    assert [r["obs_id"] for r in rows] == ["basic", "no_wcs", "pole", "ra0"] and rows[0]["facility_name"] == "Hubble"
    table = engine.registry.find("ivoa.obscore")
    assert len(table.columns) == 30 and table.column("s_region").xtype == "adql:REGION" and table.column("s_ra").utype.startswith("obscore:")
    hits = search.image_search(engine, [("POS", "CIRCLE 359.9 0 0.2"), ("RESPONSEFORMAT", "json")])
    names = [c["name"] for c in json.loads(hits.body)["metadata"]]
    assert [r[names.index("obs_id")] for r in json.loads(hits.body)["data"]] == ["ra0"]
    pole = search.image_search(engine, [("POS", "CIRCLE 10 89.99 0.01"), ("RESPONSEFORMAT", "csv")])
    assert b"pole" in pole.body and b"basic" not in pole.body


def test_equal_planes_get_numbers():
    o = scan.Observation("a.fits", "p", {"obs_id": ("x", "s", "high"), "calib_level": (2, "s", "low")}, [])
    rows = caom.caom_rows([o, scan.Observation("b.fits", "p", o.fields, [])])
    assert len(rows["observation"]) == 1 and [r[0] for r in rows["plane"]] == ["caom:UNKNOWN/x/2", "caom:UNKNOWN/x/2-2"]


def test_links_files_and_cutouts(spark, engine, images):
    plane = engine.run("SELECT obs_publisher_did AS p FROM ivoa.obscore WHERE obs_id = 'basic'").table.to_pylist()[0]["p"]
    r = links.links(engine, [("ID", plane), ("ID", "caom:no/such")], "http://h")
    got = dict(zip([f.name for f in parse_votable(r.body).fields], [c.to_pylist() for c in parse_votable(r.body).columns], strict=True))
    assert got["semantics"] == ["#cutout", "#preview", "#this", "#this"] and "NotFoundFault" in got["error_message"][3] and b"adhoc:service" in r.body
    assert links.links(engine, []).status == 200 and links.links(engine, [("ID", "a\x01")]).status == 400
    assert links.links(engine, [("ID", str(k)) for k in range(501)]).status == 400
    image = links.preview(links.open_artifact(engine, plane))
    assert image.startswith(b"\x89PNG")
    cut = links.soda(engine, [("ID", plane), ("CIRCLE", "200 -10 0.005")])
    assert cut.status == 200
    cards, at = hdus(cut.body)[0]
    assert 20 <= cards["NAXIS1"] <= 22 and 20 <= cards["NAXIS2"] <= 22
    centre = Tan.of(cards).pixel(200.0, -10.0)
    assert abs(float(centre[0]) - (cards["NAXIS1"] + 1) / 2) <= 1
    whole = np.arange(8000, dtype=">f4").reshape(80, 100)
    part = np.frombuffer(cut.body, ">f4", cards["NAXIS1"] * cards["NAXIS2"], at).reshape(cards["NAXIS2"], cards["NAXIS1"])
    x0, y0 = (round(a - b) for a, b in zip((50.5, 40.5), (cards["CRPIX1"], cards["CRPIX2"]), strict=True))
    assert (part == whole[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]]).all()
    for pairs, status, word in (
        ([("ID", plane)], 400, b"UsageError"),
        ([("ID", plane), ("POS", "CIRCLE 20 20 1")], 400, b"UsageError"),
        ([("ID", plane), ("POS", "BOX 1 2 3")], 400, b"UsageError"),
        ([("ID", plane), ("ID", "x"), ("CIRCLE", "1 1 1")], 400, b"MultiValuedParamNotSupported"),
        ([("CIRCLE", "1 1 1")], 400, b"UsageError"),
    ):
        r = links.soda(engine, pairs)
        assert r.status == status and r.body.startswith(word)
    for shape in ("POLYGON 199.99 -10.01 200.01 -10.01 200 -9.99", "RANGE 199.99 200.01 -10.01 -9.99"):
        assert links.soda(engine, [("ID", plane), ("POS", shape)]).status == 200


def test_remote_cutout_reads_ranges(tmp_path):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    path = tmp_path / "big.fits"
    image_file(path, size=(1500, 1500))
    raw, sent = path.read_bytes(), []

    class Ranged(BaseHTTPRequestHandler):
        def do_GET(self):
            a, b = (int(x) for x in self.headers["Range"].removeprefix("bytes=").split("-"))
            body = raw[a : b + 1]
            sent.append(len(body))
            self.send_response(206 if body else 416)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Ranged)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        read = links.range_reader(f"http://127.0.0.1:{server.server_port}/big.fits")
        with path.open("rb") as f:
            own = lambda at, n: (f.seek(at), f.read(n))[1]
            assert links.cutout(read, "CIRCLE", [200.0, -10.0, 0.02]) == links.cutout(own, "CIRCLE", [200.0, -10.0, 0.02])
        assert sum(sent) < len(raw) / 4
    finally:
        server.shutdown()


def test_export(spark, engine, images):
    documents = caom.export_xml(spark, engine.registry)
    assert len(documents) == 4 and all(ET.fromstring(x).tag.endswith("Observation") for x in documents.values())


# --- jobs -----------------------------------------------------------------------------------


def wait(job, phases=("COMPLETED", "ERROR", "ABORTED"), seconds=30):
    end = time.time() + seconds
    while job.phase not in phases and time.time() < end:
        time.sleep(0.02)
    return job.phase


def test_job_states(tmp_path):
    now = [dt.datetime(2024, 1, 1, tzinfo=dt.UTC)]
    gate = threading.Event()

    def runner(job):
        gate.wait(10)
        if job.request.query == "bad":
            raise ServiceError("no good")
        return b"done"

    jobs = Jobs(None, str(tmp_path), 1, runner, lambda: now[0], queue=3)
    a, b, c = (jobs.create(TapRequest(q, "csv")) for q in ("good", "bad", "waiting"))
    assert a.phase == "PENDING"
    jobs.run(a.id)
    jobs.run(b.id)
    jobs.run(c.id)
    assert jobs.run(a.id).phase in ("QUEUED", "EXECUTING")  # again: nothing changes
    with pytest.raises(ServiceError):
        jobs.run(jobs.create(TapRequest("more", "csv")).id)
    jobs.abort(c.id)
    gate.set()
    assert wait(a) == "COMPLETED" and wait(b) == "ERROR" and wait(c) == "ABORTED"
    assert jobs.result_of(a.id)[0] == b"done" and b.error == "no good"
    with pytest.raises(InvalidParameterError):
        jobs.result_of(b.id)
    with pytest.raises(InvalidParameterError):
        jobs.run(a.id)
    assert jobs.abort(a.id).phase == "COMPLETED"
    now[0] += dt.timedelta(hours=25)
    with pytest.raises(InvalidParameterError):
        jobs.get(a.id)
    with pytest.raises(NotImplementedError):
        Jobs(None, "s3://bucket/x")
    jobs.close()


def test_abort_stops_only_its_own_query(spark, engine, tmp_path):
    engine.registry.add_frame("cats.numbers", spark.range(300_000).withColumnRenamed("id", "n"))
    jobs = Jobs(engine, str(tmp_path))
    slow = jobs.create(TapRequest("SELECT COUNT(*) AS c FROM cats.numbers a, cats.numbers b WHERE SIN(a.n + b.n) > 2", "csv"))
    quick = jobs.create(TapRequest("SELECT COUNT(*) AS c FROM cats.numbers", "csv"))
    jobs.run(slow.id)
    assert wait(slow, ("EXECUTING",)) == "EXECUTING"
    time.sleep(1)
    jobs.run(quick.id)
    jobs.abort(slow.id)
    assert wait(quick) == "COMPLETED" and jobs.result_of(quick.id)[0] == b"c\n300000\n" and slow.phase == "ABORTED"
    end = time.time() + 20
    while spark.sparkContext.statusTracker().getActiveStageIds() and time.time() < end:
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveStageIds()
    jobs.close()


# --- HTTP -------------------------------------------------------------------------------------


def test_http(engine, tmp_path):
    import urllib.error
    import urllib.request

    service = Service(engine, Jobs(engine, str(tmp_path / "r")), token="tok", uploads=str(tmp_path / "up"))
    http = server(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"
    service.base_url = f"{base}/t/tok"

    def call(path, data=None, headers=None, method=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data, headers or {}, method=method), timeout=60) as r:
                return r.status, r.read(), r.geturl()
        except urllib.error.HTTPError as e:
            return e.code, e.read(), None

    try:
        q = "LANG=ADQL&FORMAT=csv&QUERY=SELECT+id+FROM+cats.stars+WHERE+id+%3C+3+ORDER+BY+id"
        assert call("/healthz")[0] == 200 and call(f"/tap/sync?{q}")[0] == 401 and call(f"/t/nope/tap/sync?{q}")[0] == 401
        assert call(f"/t/tok/tap/sync?{q}")[1] == b"id\n1\n2\n"
        assert call("/tap/sync", q.encode(), {"Authorization": "Bearer tok", "Content-Type": "application/x-www-form-urlencoded"})[1] == b"id\n1\n2\n"
        status, body, url = call("/t/tok/tap/async", (q + "&PHASE=RUN").encode(), {"Content-Type": "application/x-www-form-urlencoded"})
        assert status == 200 and b"uws:job" in body
        job = service.jobs.get(url.rpartition("/")[2])
        assert wait(job) == "COMPLETED" and call(f"/t/tok/tap/async/{job.id}/results/result")[1] == b"id\n1\n2\n"
        assert call(f"/t/tok/tap/async/{job.id}/phase")[1] == b"COMPLETED" and call(f"/t/tok/tap/async/{job.id}", method="DELETE")[0] == 303
        for path, word in (("/capabilities", b"TableAccess"), ("/availability", b"true"), ("/tables", b"cats.stars"), ("/examples", b"CONTAINS"), ("/", b"<textarea")):
            status, body, _ = call(f"/t/tok{path}")
            assert status == 200 and word in body
        assert call("/t/tok/nothing")[0] == 404
        limit = "--X\r\nContent-Disposition: form-data; name=\"f\"; filename=\"new.csv\"\r\n\r\na,b\n1,2\n\r\n--X--\r\n".encode()
        status, body, _ = call("/t/tok/upload", limit, {"Content-Type": "multipart/form-data; boundary=X"})
        assert status == 201 and b"uploads.new" in body
        assert engine.run("SELECT a, b FROM uploads.new").table.to_pylist() == [{"a": 1, "b": 2}]
        service.down_at = dt.datetime.now(dt.UTC)
        assert call(f"/t/tok/tap/sync?{q}")[0] == 503
    finally:
        http.shutdown()
        service.jobs.close()


def test_documents_are_xml(engine):
    for raw in (vosi.capabilities("http://h/x&y"), vosi.availability(True, "a<b"), vosi.tables(engine.registry)):
        ET.fromstring(raw)
    assert form("multipart/form-data; boundary=X", b"junk") == ([], {})


def test_command_line(spark, tmp_path, capsys):
    from astroloom import cli

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "t.csv").write_text("ra,dec\n1.5,2.5\n")
    image_file(tmp_path / "d" / "i.fits", TELESCOP="X")
    assert cli.main(["inspect", str(tmp_path / "d" / "t.csv")]) == 0 and "d.t (2 columns)" in capsys.readouterr().out
    assert cli.main(["scan", str(tmp_path / "d"), "--output", str(tmp_path / "o.yaml")]) == 0 and (tmp_path / "o.yaml").exists()
    assert cli.main(["export", str(tmp_path / "d"), "--output", str(tmp_path / "x")]) == 0 and list((tmp_path / "x").glob("*.xml"))
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
