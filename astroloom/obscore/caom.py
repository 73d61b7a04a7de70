"""CAOM tables of observations and the ObsCore view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import ColumnMeta, RaDecGuess, SkippedFile, TableMeta
from ..registry import Registry, column_of
from .scan import Observation, Profile, scan_images

SCHEMAS = {
    "observation": "obs_uri string, collection string, obs_id string, instrument string, target_name string, facility string",
    "plane": (
        "plane_uri string, obs_uri string, calib_level int, dataproduct_type string, s_region string, s_ra double, "
        "s_dec double, s_fov double, s_resolution double, t_min double, t_max double, t_exptime double, em_min double, "
        "em_max double, em_filter string"
    ),
    "artifact": "artifact_uri string, plane_uri string, access_url string, content_type string, content_length bigint, product_type string",
    "chunk": "chunk_id string, artifact_uri string, extension int, naxis1 int, naxis2 int, wcs_json string",
}

# Fixed values of the ObsCore standard: column, unit, UCD, utype (after "obscore:").
OBSCORE = (
    ("dataproduct_type", "", "meta.code.class", "ObsDataset.dataProductType"),
    ("calib_level", "", "meta.code;obs.calib", "ObsDataset.calibLevel"),
    ("obs_collection", "", "meta.id", "DataID.collection"),
    ("obs_id", "", "meta.id", "DataID.observationID"),
    ("obs_publisher_did", "", "meta.ref.ivoid", "Curation.publisherDID"),
    ("access_url", "", "meta.ref.url", "Access.reference"),
    ("access_format", "", "meta.code.mime", "Access.format"),
    ("access_estsize", "kbyte", "phys.size;meta.file", "Access.size"),
    ("target_name", "", "meta.id;src", "Target.name"),
    ("s_ra", "deg", "pos.eq.ra", "Char.SpatialAxis.Coverage.Location.Coord.Position2D.Value2.C1"),
    ("s_dec", "deg", "pos.eq.dec", "Char.SpatialAxis.Coverage.Location.Coord.Position2D.Value2.C2"),
    ("s_fov", "deg", "phys.angSize;instr.fov", "Char.SpatialAxis.Coverage.Bounds.Extent.diameter"),
    ("s_region", "", "pos.outline;obs.field", "Char.SpatialAxis.Coverage.Support.Area"),
    ("s_resolution", "arcsec", "pos.angResolution", "Char.SpatialAxis.Resolution.Refval.value"),
    ("s_xel1", "", "meta.number", "Char.SpatialAxis.numBins1"),
    ("s_xel2", "", "meta.number", "Char.SpatialAxis.numBins2"),
    ("t_min", "d", "time.start;obs.exposure", "Char.TimeAxis.Coverage.Bounds.Limits.StartTime"),
    ("t_max", "d", "time.end;obs.exposure", "Char.TimeAxis.Coverage.Bounds.Limits.StopTime"),
    ("t_exptime", "s", "time.duration;obs.exposure", "Char.TimeAxis.Coverage.Support.Extent"),
    ("t_resolution", "s", "time.resolution", "Char.TimeAxis.Resolution.Refval.value"),
    ("t_xel", "", "meta.number", "Char.TimeAxis.numBins"),
    ("em_min", "m", "em.wl;stat.min", "Char.SpectralAxis.Coverage.Bounds.Limits.LoLimit"),
    ("em_max", "m", "em.wl;stat.max", "Char.SpectralAxis.Coverage.Bounds.Limits.HiLimit"),
    ("em_res_power", "", "spect.resolution", "Char.SpectralAxis.Resolution.ResolPower.refVal"),
    ("em_xel", "", "meta.number", "Char.SpectralAxis.numBins"),
    ("o_ucd", "", "meta.ucd", "Char.ObservableAxis.ucd"),
    ("pol_states", "", "meta.code;phys.polarization", "Char.PolarizationAxis.stateList"),
    ("pol_xel", "", "meta.number", "Char.PolarizationAxis.numBins"),
    ("facility_name", "", "meta.id;instr.tel", "Provenance.ObsConfig.Facility.name"),
    ("instrument_name", "", "meta.id;instr", "Provenance.ObsConfig.Instrument.name"),
)

#: Where each ObsCore column comes from: p plane, o observation, a artifact, c chunk.
_SOURCES = {
    "obs_collection": "o.collection",
    "obs_id": "o.obs_id",
    "obs_publisher_did": "p.plane_uri",
    "access_url": "a.access_url",
    "access_format": "a.content_type",
    "access_estsize": "CAST(round(a.content_length / 1024) AS BIGINT)",
    "target_name": "o.target_name",
    "s_xel1": "CAST(c.naxis1 AS BIGINT)",
    "s_xel2": "CAST(c.naxis2 AS BIGINT)",
    "t_resolution": "CAST(NULL AS DOUBLE)",
    "t_xel": "CAST(1 AS BIGINT)",
    "em_res_power": "CAST(NULL AS DOUBLE)",
    "em_xel": "CAST(1 AS BIGINT)",
    "o_ucd": "'phot.flux'",
    "pol_states": "CAST(NULL AS STRING)",
    "pol_xel": "CAST(0 AS BIGINT)",
    "facility_name": "o.facility",
    "instrument_name": "o.instrument",
}


def obscore_frame(observation: DataFrame, plane: DataFrame, artifact: DataFrame, chunk: DataFrame) -> DataFrame:
    """One row for each chunk of a plane's artifact, planes without one too."""
    items = ", ".join(f"{_SOURCES.get(name, f'p.{name}')} AS {name}" for name, *_ in OBSCORE)
    return plane.sparkSession.sql(
        f"SELECT {items} FROM {{plane}} p JOIN {{observation}} o ON o.obs_uri = p.obs_uri"
        " LEFT JOIN {artifact} a ON a.plane_uri = p.plane_uri LEFT JOIN {chunk} c ON c.artifact_uri = a.artifact_uri",
        observation=observation,
        plane=plane,
        artifact=artifact,
        chunk=chunk,
    )


def caom_rows(observations: list[Observation], base_url: str = "") -> dict[str, list[tuple]]:
    """Rows of the four tables. Observations with one URI are one row, the
    first; their planes get numbered URIs where they would be equal."""
    from urllib.parse import quote

    rows: dict[str, list[tuple]] = {name: [] for name in SCHEMAS}
    seen_observations, used = set(), set()
    for o in observations:
        v = o.value
        collection, obs_id = str(v("obs_collection") or "UNKNOWN"), str(v("obs_id") or o.uri)
        obs_uri = f"caom:{collection}/{obs_id}"
        if obs_uri not in seen_observations:
            seen_observations.add(obs_uri)
            rows["observation"].append((obs_uri, collection, obs_id, v("instrument_name"), v("target_name"), v("facility_name")))
        level = v("calib_level")
        plain = f"{obs_uri}/{'unknown' if level is None else level}"
        plane_uri, n = plain, 1
        while plane_uri in used:
            n += 1
            plane_uri = f"{plain}-{n}"
        used.add(plane_uri)
        numbers = [v(x) for x in ("s_ra", "s_dec", "s_fov", "s_resolution", "t_min", "t_max", "t_exptime", "em_min", "em_max")]
        rows["plane"].append(
            (plane_uri, obs_uri, level, v("dataproduct_type"), v("s_region"), *[None if x is None else float(x) for x in numbers], v("em_filter"))
        )
        url = f"{base_url.rstrip('/')}/datalink/links?ID={quote(plane_uri, safe='')}"
        rows["artifact"].append((o.uri, plane_uri, url, "application/fits", o.size, "science"))
        rows["chunk"].append((f"{o.uri}#{o.hdu}", o.uri, o.hdu, v("naxis1"), v("naxis2"), o.wcs_json))
    return rows


def register(registry: Registry, frames: dict[str, DataFrame]) -> None:
    """caom.* and ivoa.obscore over given frames; TAP_SCHEMA follows."""
    for name, df in frames.items():
        registry.add_frame(f"caom.{name}", df, description=f"Image metadata: {name} records.")
    view = obscore_frame(**frames)
    units = {n: (unit, ucd, utype) for n, unit, ucd, utype in OBSCORE}
    columns = []
    for f in view.schema.fields:
        c, (unit, ucd, utype) = column_of(f), units[f.name]
        columns.append(
            ColumnMeta(
                f.name, c.datatype, unit or None, ucd, f.name.replace("_", " "), c.arraysize, True, False, True,
                f"obscore:{utype}", "adql:REGION" if f.name == "s_region" else None,
            )
        )
    table = TableMeta(
        "ivoa", "obscore", tuple(columns), ra_column="s_ra", dec_column="s_dec",
        position=RaDecGuess("s_ra", "s_dec", "ucd", "high"), description="ObsCore 1.1 view over the images.",
    )
    registry.add(table, view)
    registry.publish_schema()


def attach_images(
    spark: SparkSession, registry: Registry, sources: list[str], base_url: str = "", profile: Profile | None = None
) -> list[SkippedFile]:
    observations, skipped = scan_images(spark, sources, profile)
    rows = caom_rows(observations, base_url)
    register(registry, {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()})
    return skipped


def export_xml(spark: SparkSession, registry: Registry) -> dict[str, bytes]:
    """One CAOM document for each observation, from one ordered join."""
    import xml.etree.ElementTree as ET

    names = {n: registry.find(f"caom.{n}").view for n in SCHEMAS}
    rows = spark.sql(
        f"SELECT o.*, p.plane_uri, p.calib_level, p.dataproduct_type, p.s_region, p.t_min, p.t_max, p.em_min, p.em_max,"
        f" a.artifact_uri, a.content_type, a.content_length, a.product_type, c.extension, c.naxis1, c.naxis2"
        f" FROM `{names['observation']}` o JOIN `{names['plane']}` p ON p.obs_uri = o.obs_uri"
        f" LEFT JOIN `{names['artifact']}` a ON a.plane_uri = p.plane_uri"
        f" LEFT JOIN `{names['chunk']}` c ON c.artifact_uri = a.artifact_uri"
        " ORDER BY o.obs_uri, p.plane_uri, a.artifact_uri, c.extension"
    ).toLocalIterator()
    space = "http://www.opencadc.org/caom2/xml/v2.4"
    ET.register_namespace("caom2", space)

    def add(parent, tag, text=None):
        e = ET.SubElement(parent, f"{{{space}}}{tag}")
        if text is not None:
            e.text = str(text)
        return e

    out, root, now, planes, artifacts = {}, None, None, {}, {}
    done: list[tuple[str, ET.Element]] = []
    for r in rows:
        if r.obs_uri != now:
            now, planes, artifacts = r.obs_uri, {}, {}
            root = ET.Element(f"{{{space}}}Observation")
            done.append((now, root))
            add(root, "collection", r.collection)
            add(root, "observationID", r.obs_id)
            if r.target_name:
                add(add(root, "target"), "name", r.target_name)
            if r.facility:
                add(add(root, "telescope"), "name", r.facility)
            if r.instrument:
                add(add(root, "instrument"), "name", r.instrument)
            holder = add(root, "planes")
        if r.plane_uri not in planes:
            p = add(holder, "plane")
            add(p, "productID", r.plane_uri.rpartition("/")[2])
            add(p, "dataProductType", r.dataproduct_type)
            add(p, "calibrationLevel", r.calib_level)
            for tag, low, high in (("energy", r.em_min, r.em_max), ("time", r.t_min, r.t_max)):
                if low is not None and high is not None:
                    bounds = add(add(p, tag), "bounds")
                    add(bounds, "lower", repr(low))
                    add(bounds, "upper", repr(high))
            planes[r.plane_uri] = add(p, "artifacts")
        if r.artifact_uri is not None and r.artifact_uri not in artifacts:
            a = add(planes[r.plane_uri], "artifact")
            for tag, v in (("uri", r.artifact_uri), ("productType", r.product_type), ("contentType", r.content_type), ("contentLength", r.content_length)):
                if v is not None:
                    add(a, tag, v)
            artifacts[r.artifact_uri] = add(a, "parts")
        if r.extension is not None:
            add(add(artifacts[r.artifact_uri], "part"), "name", r.extension)
    for uri, element in done:
        out[uri] = ET.tostring(element, encoding="utf-8", xml_declaration=True)
    return out
