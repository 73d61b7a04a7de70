"""Image files to observations: every value with its source and confidence."""

from __future__ import annotations

import datetime as dt
import gzip
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession

from ..errors import DiscoveryError
from ..model import SkippedFile
from ..shipping import bounded_batches, ship
from ..sources.files import Files
from ..sources.parsing import BLOCK, data_bytes, read_header
from .wcs import Tan, footprint, region_text

ENDINGS = (".fits", ".fit", ".fits.gz")


@dataclass(frozen=True)
class Profile:
    """What a class of images has in common; bands are in metres."""

    name: str = "generic-fits-wcs"
    dataproduct_type: str = "image"
    calib_level: int = 2
    obs_collection: str = "UNKNOWN"
    # Approximate broad bands by FILTER.
    bands: dict = field(
        default_factory=lambda: {
            "U": (3.0e-7, 4.0e-7),
            "B": (4.0e-7, 5.0e-7),
            "V": (5.0e-7, 6.0e-7),
            "R": (6.0e-7, 7.0e-7),
            "I": (7.0e-7, 8.5e-7),
            "G": (4.0e-7, 7.0e-7),
            "HA": (6.5e-7, 6.6e-7),
        }
    )


def load_profile(path: str) -> Profile:
    import yaml

    with open(path) as f:
        raw = yaml.safe_load(f) or {}
    bands = {str(k).upper(): (float(v["min"]), float(v["max"])) for k, v in (raw.get("bands") or {}).items()}
    known = {k: raw[k] for k in ("name", "dataproduct_type", "calib_level", "obs_collection") if k in raw}
    return Profile(**known, **({"bands": bands} if bands else {}))


@dataclass
class Image:
    """The first HDU that holds an image, without its pixels."""

    cards: dict
    hdu: int
    naxis1: int
    naxis2: int
    data_at: int

    @property
    def wcs(self) -> Tan | None:
        return Tan.of(self.cards)


def read_image(read) -> Image:
    """``read(offset, n)`` gives bytes; only headers are asked for."""
    at, k = 0, 0
    while True:
        if k == 0 and not read(0, 30).startswith(b"SIMPLE  ="):
            raise DiscoveryError("not a FITS file: no SIMPLE card")
        raw = b""
        while True:
            block = read(at + len(raw), BLOCK)
            if len(block) < BLOCK:
                raise DiscoveryError("no image in this FITS file" if not raw else "FITS header ends early")
            raw += block
            if any(block[i : i + 8] == b"END     " for i in range(0, BLOCK, 80)):
                break
        cards, _ = read_header(raw, 0)
        start = at + len(raw)
        kind = str(cards.get("XTENSION", "IMAGE")).strip()
        sizes = [int(cards.get(f"NAXIS{i}", 0)) for i in range(1, int(cards.get("NAXIS", 0)) + 1)]
        if kind == "IMAGE" and len(sizes) >= 2 and sizes[0] > 0 and sizes[1] > 0:
            return Image(cards, k, sizes[0], sizes[1], start)
        at = start + -(-data_bytes(cards) // BLOCK) * BLOCK
        k += 1


def local_reader(path: str):
    """Range reads of a local file; a gzip file is unpacked as far as asked."""
    f = gzip.open(path, "rb") if path.lower().endswith(".gz") else open(path, "rb")

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read, f


def mjd(value) -> float | None:
    """Modified Julian date of a FITS date."""
    try:
        text = str(value).strip().rstrip("Z")
        when = dt.datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    return (when.replace(tzinfo=None) - dt.datetime(1858, 11, 17)).total_seconds() / 86400


@dataclass
class Observation:
    uri: str
    profile: str
    fields: dict  # name -> (value, source, confidence)
    unresolved: list[str]
    hdu: int = 0
    wcs_json: str | None = None
    size: int | None = None

    def value(self, name: str):
        return self.fields[name][0] if name in self.fields else None


def observe(uri: str, image: Image, profile: Profile, size: int | None = None) -> Observation:
    cards, fields, unresolved = image.cards, {}, []

    def put(name: str, value, source: str, confidence: str = "high") -> None:
        fields[name] = (value, source, confidence)

    def text(key: str) -> str | None:
        v = cards.get(key)
        return str(v).strip() or None if v is not None else None

    def real(key: str) -> float | None:
        try:
            return float(cards[key])
        except (KeyError, TypeError, ValueError):
            return None

    def first(name: str, *choices) -> None:
        """The first choice with a value; (value, source, confidence) each."""
        for value, source, confidence in choices:
            if value is not None:
                put(name, value, source, confidence)
                return
        unresolved.append(name)

    own = f"profile:{profile.name}"
    put("dataproduct_type", profile.dataproduct_type, f"{own}.dataproduct_type")
    put("calib_level", profile.calib_level, f"{own}.calib_level", "low")
    telescope = text("TELESCOP")
    first("obs_collection", (telescope, "TELESCOP", "high"), (profile.obs_collection, f"{own}.obs_collection", "low"))
    first("target_name", (text("OBJECT"), "OBJECT", "high"))
    first("instrument_name", (text("INSTRUME"), "INSTRUME", "high"))
    first("facility_name", (telescope, "TELESCOP", "high"))
    name = posixpath.basename(uri)
    stem = name[: len(name) - len(max((e for e in ENDINGS if name.lower().endswith(e)), key=len, default=""))]
    first("obs_id", (text("OBS_ID") or text("OBSID"), "OBS_ID", "high"), (stem, "filename", "medium"))
    put("naxis1", image.naxis1, "NAXIS1")
    put("naxis2", image.naxis2, "NAXIS2")
    exposure = real("EXPTIME")
    first("t_exptime", (exposure, "EXPTIME", "high"))
    first("t_min", (real("MJD-OBS"), "MJD-OBS", "high"), (mjd(cards.get("DATE-OBS")), "DATE-OBS", "high"))
    start = fields.get("t_min")
    end = start[0] + exposure / 86400 if start and exposure is not None else None
    first("t_max", (mjd(cards.get("DATE-END")), "DATE-END", "high"), (end, f"{start[1] if start else ''}+EXPTIME", "medium"))
    band_name = text("FILTER")
    first("em_filter", (band_name, "FILTER", "high"))
    band = profile.bands.get((band_name or "").upper())
    wave = real("WAVELEN")
    for i, end_name in enumerate(("em_min", "em_max")):
        first(
            end_name,
            (band[i] if band else None, f"{own}.bands.{band_name}", "medium"),
            (wave, "WAVELEN", "medium"),
        )
    wcs = image.wcs
    if wcs is None:
        unresolved += ["s_ra", "s_dec", "s_fov", "s_region", "s_resolution"]
    else:
        f = footprint(wcs, image.naxis1, image.naxis2)
        put("s_ra", f.ra, "WCS")
        put("s_dec", f.dec, "WCS")
        put("s_fov", f.fov, "WCS")
        put("s_region", region_text(f), "WCS edge-sampled footprint")
        first("s_resolution", (f.resolution * 3600 if f.resolution else None, "WCS pixel scale", "high"))
    cards_json = json.dumps(wcs.cards(), sort_keys=True) if wcs else None
    return Observation(uri, profile.name, fields, unresolved, image.hdu, cards_json, size)


def image_files(source: str, files: Files) -> list[str]:
    import fnmatch

    if any(c in source for c in "*?["):
        folder = posixpath.dirname(source)
        return [f for f in files.children(folder or ".") if fnmatch.fnmatch(posixpath.basename(f), posixpath.basename(source)) and f.lower().endswith(ENDINGS)]
    if files.is_folder(source):
        return [f for f in files.children(source) if f.lower().endswith(ENDINGS)]
    if not source.lower().endswith(ENDINGS):
        raise DiscoveryError("not a FITS file")
    return [source]


#: What a worker says of a file that it cannot open.
WHOLE = json.dumps({"whole": True})


def remote_reader(uri: str):
    """(read(at, n), size, file) of a remote file, read in ranges by Arrow."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))
    f = store.open_input_file(path)
    if f.read_at(2, 0) == b"\x1f\x8b":  # only ranges of plain files are of use
        f.close()
        raise ValueError("a compressed file is read whole")
    return (lambda at, n: f.read_at(min(n, max(0, f.size() - at)), at)), f.size(), f


def scan_images(
    spark: SparkSession, sources: list[str], profile: Profile | None = None
) -> tuple[list[Observation], list[SkippedFile]]:
    """Every image of the sources is an observation. Headers are read by the
    executors, in ranges; only remote files in a store that Arrow cannot open
    there are read whole, by Spark's reader."""
    profile, files = profile or Profile(), Files(spark)
    paths, skipped = [], []
    for s in sources:
        try:
            found = image_files(s, files)
            if not found:
                skipped.append(SkippedFile(s, "no FITS files here"))
            paths += found
        except Exception as e:  # noqa: BLE001
            skipped.append(SkippedFile(s, str(e)))
    local = [p for p in paths if files.local(p) is not None]
    remote = [p for p in paths if files.local(p) is None]

    def say(path: str, image_of) -> str:
        try:
            return json.dumps(image_of())
        except Exception as e:  # noqa: BLE001
            return json.dumps({"error": str(e)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            out = []
            names = batch.column("path").to_pylist()
            contents = batch.column("content").to_pylist() if "content" in batch.schema.names else [None] * len(names)
            for path, raw in zip(names, contents, strict=True):

                def one(path=path, raw=raw) -> dict:
                    if raw is None and "://" in path and not path.startswith("file://"):
                        try:
                            read, size, f = remote_reader(path)
                        except Exception:  # noqa: BLE001  no such store here: Spark reads the file
                            return {"whole": True}
                        with f:
                            image = read_image(read)
                    elif raw is None:
                        read, f = local_reader(path.removeprefix("file://"))
                        with f:
                            image, size = read_image(read), os.path.getsize(path.removeprefix("file://"))
                    else:
                        size = len(raw)
                        plain = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                        image = read_image(lambda at, n: plain[at : at + n])
                    return observe(path, image, profile, size).__dict__

                out.append(say(path, one))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], ["path", "said"])

    ship(spark)
    rows, said_by = [], "path string, said string"
    if paths := local + remote:
        n = min(len(paths), spark.sparkContext.defaultParallelism * 4)
        rows += spark.createDataFrame([(p,) for p in paths], "path string").repartition(n).mapInArrow(run, said_by).collect()
    if whole := [r.path for r in rows if r.said == WHOLE]:
        bounded_batches(spark)
        rows = [r for r in rows if r.said != WHOLE]
        rows += spark.read.format("binaryFile").load(whole).select("path", "content").mapInArrow(run, said_by).collect()
    observations = []
    for r in sorted(rows, key=lambda r: r.path):
        said = json.loads(r.said)
        if "error" in said:
            skipped.append(SkippedFile(r.path, said["error"]))
        else:
            said["fields"] = {k: tuple(v) for k, v in said["fields"].items()}
            observations.append(Observation(**said))
    return observations, skipped


def write_yaml(observations: list[Observation], skipped: list[SkippedFile], path: str) -> None:
    import yaml

    doc = {
        "observations": [
            {
                "uri": o.uri,
                "profile": o.profile,
                "hdu": o.hdu,
                "wcs_json": o.wcs_json,
                "size": o.size,
                "fields": {k: dict(zip(("value", "source", "confidence"), v, strict=True)) for k, v in o.fields.items()},
                "unresolved": list(o.unresolved),
            }
            for o in observations
        ],
        "skipped": [{"uri": s.uri, "reason": s.reason} for s in skipped],
    }
    with open(path, "w") as f:
        yaml.safe_dump(doc, f, sort_keys=False, allow_unicode=True)


def read_yaml(path: str) -> tuple[list[Observation], list[SkippedFile]]:
    import yaml

    with open(path) as f:
        doc = yaml.safe_load(f) or {}
    return (
        [
            Observation(
                o["uri"],
                o["profile"],
                {k: (v["value"], v["source"], v["confidence"]) for k, v in o["fields"].items()},
                o["unresolved"],
                o["hdu"],
                o["wcs_json"],
                o["size"],
            )
            for o in doc.get("observations") or []
        ],
        [SkippedFile(s["uri"], s["reason"]) for s in doc.get("skipped") or []],
    )
