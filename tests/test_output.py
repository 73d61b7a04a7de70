"""Formats, their negotiation and their round trips."""

import datetime as dt
import io
import json
import math
import xml.etree.ElementTree as ET

import pyarrow as pa
import pyarrow.csv
import pyarrow.parquet as pq
import pytest

from astroloom.errors import UnknownTableError, UnsupportedFormatError
from astroloom.model import ColumnMeta
from astroloom.output import error_document, negotiate, serialize
from astroloom.output.files import write
from astroloom.sources.parsing import parse_votable

NS = "{http://www.ivoa.net/xml/VOTable/v1.3}"
TABLE = pa.table(
    {
        "source_id": pa.array([1, None, 3], pa.int64()),
        "ra": pa.array([10.5, None, float("nan")]),
        "name": pa.array(["a <b>", None, 'q"&,'], pa.string()),
        "ok": pa.array([True, False, None]),
        "t": pa.array([dt.datetime(2024, 1, 2, 3, 4, 5), None, None], pa.timestamp("us", "UTC")),
        "i8": pa.array([-3, None, 5], pa.int8()),
        "u16": pa.array([65535, 1, 0], pa.uint16()),
        "u32": pa.array([4294967295, 1, 0], pa.uint32()),
        "v": pa.array([[1.0, 2.0], None, []], pa.list_(pa.float64())),
        "f": pa.array([1.5, None, 2.5], pa.float32()),
    }
)
METAS = [ColumnMeta("RA", "double", "deg", "pos.eq.ra", "right <ascension>", utype="x:y"), ColumnMeta("name", "char", xtype="adql:REGION")]


def test_negotiation():
    assert negotiate(None) == negotiate("  ") == negotiate("VOTable") == negotiate("application/x-votable+xml; serialization=BINARY2") == "votable"
    assert negotiate("tabledata") == "votable/td" and negotiate("text/csv") == "csv" and negotiate("application/json") == "json"
    with pytest.raises(UnsupportedFormatError, match="parquet"):
        negotiate("xlsx")


@pytest.mark.parametrize("kind", ["votable", "votable/td"])
def test_votable(kind):
    raw = serialize(TABLE, kind, METAS, overflow=True)
    root = ET.fromstring(raw)
    resource = root.find(f"{NS}RESOURCE")
    infos = [(e.tag, e.get("value")) for e in resource]
    assert infos[0] == (f"{NS}INFO", "OK") and infos[-1] == (f"{NS}INFO", "OVERFLOW")
    fields = {f.get("name"): f for f in resource.iter(f"{NS}FIELD")}
    assert (fields["ra"].get("unit"), fields["ra"].get("ucd"), fields["ra"].get("utype")) == ("deg", "pos.eq.ra", "x:y")
    assert fields["ra"].find(f"{NS}DESCRIPTION").text == "right <ascension>" and fields["name"].get("xtype") == "adql:REGION"
    assert fields["t"].get("xtype") == "timestamp"
    assert [fields[n].get("datatype") for n in ("source_id", "i8", "u16", "u32", "ok", "f")] == ["long", "short", "int", "long", "boolean", "float"]
    got = dict(zip(TABLE.column_names, [c.to_pylist() for c in parse_votable(raw).columns], strict=True))
    assert got["source_id"] == [1, None, 3] and got["ok"] == [True, False, None] and got["i8"] == [-3, None, 5]
    assert got["u16"] == [65535, 1, 0] and got["u32"] == [4294967295, 1, 0] and got["f"] == [1.5, None, 2.5]
    assert got["ra"][:2] == [10.5, None] and math.isnan(got["ra"][2])
    assert got["name"] == ["a <b>", "", 'q"&,'] and got["t"] == ["2024-01-02T03:04:05", "", ""] and got["v"][0] == [1.0, 2.0]
    assert b"OVERFLOW" not in serialize(TABLE, kind, METAS)


def test_delimited():
    got = pyarrow.csv.read_csv(io.BytesIO(serialize(TABLE.select(["source_id", "name", "ok"]), "csv")))
    assert got.column("source_id").to_pylist() == [1, None, 3] and got.column("name").to_pylist()[2] == 'q"&,'
    assert serialize(TABLE.select(["source_id"]), "csv").split(b"\n")[0] == b"source_id"
    tsv = serialize(TABLE.select(["source_id", "t"]), "tsv").decode().splitlines()
    assert tsv[0] == "source_id\tt" and tsv[1].startswith("1\t") and "2024-01-02T03:04:05" in tsv[1]
    assert serialize(TABLE.slice(0, 0), "csv").decode().startswith("source_id,ra")


def test_parquet_and_json():
    assert pq.read_table(io.BytesIO(serialize(TABLE, "parquet"))).column("u32").to_pylist() == [4294967295, 1, 0]
    got = json.loads(serialize(TABLE, "json", METAS))
    assert got["metadata"][1] == {"name": "ra", "datatype": "double", "unit": "deg", "ucd": "pos.eq.ra", "description": "right <ascension>"}
    assert got["data"][2][1] is None and got["data"][1][0] is None and len(got["data"]) == 3


def test_geometry_values():
    t = pa.table({"p": pa.array([{"ra": 1.0, "dec": 2.0}, None], pa.struct([("ra", pa.float64()), ("dec", pa.float64())]))})
    for kind in ("votable", "votable/td"):
        raw = serialize(t, kind)
        assert b'xtype="point"' in raw and parse_votable(raw).columns[0].to_pylist()[0] == [1.0, 2.0]
    assert b"1.0 2.0" in serialize(t, "csv")


def test_errors():
    root = ET.fromstring(error_document(UnknownTableError("a<b\x01")))
    info = root.find(f"{NS}RESOURCE/{NS}INFO")
    assert info.get("value") == "ERROR" and "a<b" in info.text


def test_large_results_are_files(spark, tmp_path):
    df = spark.range(100)
    for kind in ("parquet", "csv", "json"):
        write(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 100
    with pytest.raises(UnsupportedFormatError):
        write(df, str(tmp_path / "x"), "votable")
