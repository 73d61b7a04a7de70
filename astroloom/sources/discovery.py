"""Tables from sources: columns, metadata, sky positions, partitions."""

from __future__ import annotations

import csv
import io
import math
import re
from collections.abc import Callable
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DiscoveryError
from ..model import ColumnMeta, RaDecGuess, SkippedFile, TableMeta, tap_type
from ..plans.shards import Shard
from ..registry import Registry
from . import tables
from .files import CONFIG_NAME, Files, SourceGroup, detect_format, resolve_sources, stem

# The UCDs and column names that mark a position.
RA_UCD, DEC_UCD = "pos.eq.ra;meta.main", "pos.eq.dec;meta.main"
RA_NAMES = ("ra", "ra_icrs", "raj2000", "ra_deg", "alpha", "s_ra")
DEC_NAMES = ("dec", "dec_icrs", "dej2000", "dec_deg", "delta", "s_dec")

Range = tuple[float, float] | None


def _in(r: Range, low: float, high: float) -> bool:
    return r is not None and low <= r[0] and r[1] <= high


def detect_position(columns: list[ColumnMeta], ranges: Callable[[str], Range]) -> RaDecGuess | None:
    """By UCD (high confidence), then name (medium), then range (low); a pair
    must have sky ranges, whichever rule found it."""

    def ask(names: list[str]) -> None:
        if isinstance(ranges, ColumnRanges):
            ranges.load(names)  # together

    def sane(ra: str | None, dec: str | None) -> bool:
        if not ra or not dec:
            return False
        ask([ra, dec])
        return _in(ranges(ra), 0, 360) and _in(ranges(dec), -90, 90)

    def by_ucd(ucd: str) -> str | None:
        return next((c.name for c in columns if (c.ucd or "").lower() == ucd), None)

    def by_name(names: tuple[str, ...]) -> str | None:
        own = {c.name.lower(): c.name for c in reversed(columns)}
        return next((own[n] for n in names if n in own), None)

    for find, ra_key, dec_key, rule, confidence in (
        (by_ucd, RA_UCD, DEC_UCD, "ucd", "high"),
        (by_name, RA_NAMES, DEC_NAMES, "name", "medium"),
    ):
        ra, dec = find(ra_key), find(dec_key)
        if sane(ra, dec):
            return RaDecGuess(ra, dec, rule, confidence)
    real = [c.name for c in columns if c.datatype in ("float", "double") and not _is_array(c)]
    ask(real)
    for ra in (c for c in real if _in(ranges(c), 0, 360)):
        for dec in (c for c in real if c != ra and _in(ranges(c), -90, 90)):
            return RaDecGuess(ra, dec, "unit_sanity", "low")
    return None


def _is_array(c: ColumnMeta) -> bool:
    return c.datatype != "char" and bool(c.arraysize) and c.arraysize != "1"


class ColumnRanges:
    """The ranges of the columns that a rule asks for, and of no others: from
    the statistics in Parquet footers, else from one aggregation over them."""

    def __init__(self, df: DataFrame, parquet: list[str] | None = None) -> None:
        self.df, self.parquet = df, parquet
        self.known: dict[str, Range] = {}
        self.numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}

    def __call__(self, name: str) -> Range:
        self.load([name])
        return self.known.get(name)

    def load(self, names: list[str]) -> None:
        wanted = [n for n in names if n in self.numeric and n not in self.known]
        if wanted and self.parquet:
            self.known |= self.footers(wanted)
        if rest := [n for n in wanted if n not in self.known]:
            self.known |= column_ranges(self.df.select(*[f"`{n}`" for n in rest]))

    def footers(self, names: list[str]) -> dict[str, Range]:
        """Smallest and largest values by Spark's aggregate push-down, which
        reads footers and no rows. Columns with values that are no numbers, or
        files without statistics, are left to the aggregation."""
        session = self.df.sparkSession.newSession()
        session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        session.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
        read = session.read.option("recursiveFileLookup", "true").parquet(*self.parquet)
        ends = [f(F.col(f"`{n}`")).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]
        try:
            row = read.agg(*ends).first()
        except (Py4JJavaError, PySparkException):
            return {}
        out: dict[str, Range] = {}
        for i, n in enumerate(names):
            low, high = row[f"lo{i}"], row[f"hi{i}"]
            if low is not None and math.isfinite(low) and math.isfinite(high):
                out[n] = (float(low), float(high))
        return out


def column_ranges(df: DataFrame) -> dict[str, Range]:
    """Smallest and largest finite value of every numeric column: one
    aggregation over the table, whatever its width."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not numeric:
        return {}
    aggregates = []
    for i, name in enumerate(numeric):
        x = F.col(f"`{name}`").cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        aggregates += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggregates).first()
    return {
        name: None if row[f"lo{i}"] is None else (row[f"lo{i}"], row[f"hi{i}"]) for i, name in enumerate(numeric)
    }


# --- metadata from outside the data -------------------------------------------


def arrow_metadata(path: str) -> dict[str, dict]:
    """unit, ucd and description of each column from a local Parquet file's
    Arrow schema, which Spark does not surface."""
    import pyarrow.parquet as pq

    out = {}
    for f in pq.ParquetFile(path).schema_arrow:
        known = {k.decode(): v.decode() for k, v in (f.metadata or {}).items()}
        out[f.name] = {k: known[k] for k in ("unit", "ucd", "description", "utype", "xtype") if k in known}
    return out


def sidecar(files: Files, path: str) -> dict:
    import yaml

    at = f"{path[: len(path) - len(path.rstrip('/').rpartition('/')[2])]}{stem(path)}.meta.yaml"
    if "://" in path and not path.startswith("file://") or not files.exists(at):
        return {}
    try:
        return yaml.safe_load(files.read_text(at)) or {}
    except yaml.YAMLError as e:
        raise DiscoveryError(f"sidecar {at} is not YAML: {e}") from None


def load_overrides(path: str | None, files: Files | None = None) -> dict:
    """The ``tables:`` block of a configuration file; other blocks are allowed."""
    import yaml

    if not path:
        return {}
    return (yaml.safe_load((files or Files()).read_text(path)) or {}).get("tables") or {}


def _update(columns: list[ColumnMeta], known: dict) -> list[ColumnMeta]:
    lower = {str(k).lower(): v or {} for k, v in (known or {}).items()}
    allowed = ("unit", "ucd", "description", "utype", "xtype", "principal", "indexed")
    return [
        replace(c, **{k: v for k, v in lower.get(c.name.lower(), {}).items() if k in allowed}) for c in columns
    ]


def apply_overrides(table: TableMeta, overrides: dict) -> TableMeta:
    """Overrides win over all that was found."""
    own = next((v for k, v in overrides.items() if str(k).lower() == table.qualified.lower()), None)
    if not own:
        return table
    table = table.with_columns(_update(list(table.columns), own.get("columns")))
    if own.get("description"):
        table = replace(table, description=own["description"])
    if own.get("primary_key"):
        table = replace(table, primary_key=own["primary_key"])
    if own.get("ra") or own.get("dec"):
        ra, dec = own.get("ra") or table.ra_column, own.get("dec") or table.dec_column
        missing = [c for c in (ra, dec) if c and not table.column(c)]
        if missing:
            raise DiscoveryError(f"override names unknown column {', '.join(missing)}")
        guess = RaDecGuess(ra, dec, "override", "override")
        table = replace(table, ra_column=ra, dec_column=dec, position=guess, unresolved=())
    return table


def _positioned(table: TableMeta, ranges: Callable[[str], Range]) -> TableMeta:
    guess = detect_position(list(table.columns), ranges)
    if guess is None:
        return replace(table, unresolved=("ra", "dec"))
    return replace(table, ra_column=guess.ra, dec_column=guess.dec, position=guess)


# --- discovery ------------------------------------------------------------------


def discover(
    spark: SparkSession, uris: list[str], overrides: dict | None = None, registry: Registry | None = None
) -> Registry:
    """Registers all tables of the sources; what cannot be read is listed as
    skipped with its reason and stops nothing."""
    registry = registry or Registry(spark)
    files = Files(spark)
    groups, skipped = resolve_sources(uris, files)
    registry.skipped += skipped
    for group in groups:
        try:
            found = discover_group(spark, group, overrides or {}, files)
        except Exception as e:  # noqa: BLE001
            registry.skipped.append(SkippedFile(", ".join(group.files), f"discovery failed: {_short(e)}"))
            continue
        for table in found:
            if table.qualified.lower() in registry.tables:
                registry.skipped.append(SkippedFile(", ".join(group.files), f"table {table.qualified} already exists"))
                continue
            try:
                registry.add(table, tables.read_files(spark, table, list(table.files)))
            except Exception as e:  # noqa: BLE001
                registry.tables.pop(table.qualified.lower(), None)
                registry.skipped.append(SkippedFile(", ".join(group.files), f"discovery failed: {_short(e)}"))
    registry.publish_schema()
    return registry


def _short(e: Exception) -> str:
    return str(e).strip().splitlines()[0][:300] if str(e).strip() else type(e).__name__


def discover_group(spark: SparkSession, group: SourceGroup, overrides: dict, files: Files) -> list[TableMeta]:
    if group.is_hats:
        return [apply_overrides(discover_hats(spark, group, files), overrides)]
    kinds = {detect_format(f) for f in group.files}
    if len(kinds) > 1:
        raise DiscoveryError("group mixes incompatible file formats")
    kind = kinds.pop()
    if kind == "parquet":
        found = [discover_parquet(spark, group, files)]
    elif kind in ("csv", "tsv"):
        found = [discover_delimited(spark, group, kind, files)]
    else:
        found = discover_parsed(spark, group, kind, files)
    return [apply_overrides(t, overrides) for t in found]


def discover_parquet(spark: SparkSession, group: SourceGroup, files: Files) -> TableMeta:
    df = spark.read.option("recursiveFileLookup", "true").parquet(*group.files)
    columns = [_column(f) for f in df.schema.fields]
    first = files.local(group.files[0])
    if first is not None:
        inner = [f for f in files.below(first) if f.endswith(".parquet")][:1] if files.is_folder(first) else [first]
        columns = _update(columns, arrow_metadata(inner[0]) if inner else {})
    known = sidecar(files, group.files[0])
    table = TableMeta(
        group.schema,
        group.table,
        tuple(_update(columns, known.get("columns"))),
        "parquet",
        tuple(group.files),
        primary_key=known.get("primary_key"),
        description=known.get("description"),
    )
    return _positioned(table, ColumnRanges(df, list(group.files)))


def _column(f: T.StructField) -> ColumnMeta:
    if isinstance(f.dataType, T.DecimalType) and (f.dataType.precision, f.dataType.scale) == (20, 0):
        return ColumnMeta(f.name, "long")  # unsigned 64 bits, cast when registered
    kind = tap_type(f.dataType)
    xtype = {T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp", T.DateType: "date"}.get(type(f.dataType))
    return ColumnMeta(f.name, kind, arraysize="*" if kind == "char" else None, xtype=xtype)


def discover_delimited(spark: SparkSession, group: SourceGroup, kind: str, files: Files) -> TableMeta:
    df = tables.read_delimited(spark, list(group.files), "," if kind == "csv" else "\t")
    if not df.columns:
        raise DiscoveryError("file has no header line")
    known = sidecar(files, group.files[0])
    columns = _update([_column(f) for f in df.schema.fields], known.get("columns"))
    table = TableMeta(
        group.schema, group.table, tuple(columns), kind, tuple(group.files),
        primary_key=known.get("primary_key"), description=known.get("description"),
    )
    return _positioned(table, ColumnRanges(df))


def discover_parsed(spark: SparkSession, group: SourceGroup, kind: str, files: Files) -> list[TableMeta]:
    seen = tables.sniff(spark, kind, list(group.files))
    errors = [x["error"] for x in seen if "error" in x]
    if errors:
        raise DiscoveryError(errors[0])
    first = seen[0]["tables"]
    if not first:
        raise DiscoveryError("no binary tables in this FITS file")
    known = sidecar(files, group.files[0])
    out = []
    for t in first:
        name = group.table if len(first) == 1 else f"{group.table}_hdu{t['hdu']}"
        columns = [
            ColumnMeta(f.name, f.datatype, f.unit, f.ucd, f.description, f.arraysize or ("*" if f.datatype == "char" else None), utype=f.utype, xtype=f.xtype)
            for f in map(tables.field_of, t["fields"])
        ]
        ranges: dict[str, Range] = {}
        for x in seen:
            for other in x["tables"]:
                if other["hdu"] == t["hdu"]:
                    for c, (low, high) in other["ranges"].items():
                        old = ranges.get(c)
                        ranges[c] = (min(low, old[0]), max(high, old[1])) if old else (low, high)
        table = TableMeta(
            group.schema, name, tuple(_update(columns, known.get("columns"))), kind, tuple(group.files),
            primary_key=known.get("primary_key"), description=known.get("description") or t.get("description"), hdu=t["hdu"],
        )
        out.append(_positioned(table, ranges.get))
    return out


def discover_hats(spark: SparkSession, group: SourceGroup, files: Files) -> TableMeta:
    """One table over all shards. Pruning needs every shard's order and pixel;
    a layout that lacks one is read whole."""
    root = group.files[0]
    inner = [f for f in files.below(root) if f.lower().endswith(".parquet")]
    if not inner:
        raise DiscoveryError("partitioned folder has no Parquet shards")
    orders = []
    if files.exists(f"{root}/partition_info.csv"):
        rows = csv.DictReader(io.StringIO(files.read_text(f"{root}/partition_info.csv")))
        orders = [int(r["Norder"]) for r in rows if (r.get("Norder") or "").strip()]
    shards = []
    for path in inner:
        order, pixel = re.search(r"Norder=(\d+)", path), re.search(r"Npix=(\d+)", path)
        if order and pixel:
            shards.append(Shard(int(order[1]), int(pixel[1]), path))
    orders = orders or [s.order for s in shards]
    if not orders:
        raise DiscoveryError("cannot determine the partition order")
    table = discover_parquet(spark, SourceGroup(group.schema, group.table, tuple(inner)), files)
    return replace(table, shards=tuple(shards) if len(shards) == len(inner) else (), hats_order=max(orders))


def inspect_report(registry: Registry) -> str:
    """A stable text about all tables and all that was skipped."""
    own = sorted((t for t in registry.tables.values() if t.schema != "tap_schema"), key=lambda t: t.qualified)
    out = [] if own else ["No tables discovered."]
    for t in own:
        out.append(f"{t.qualified} ({len(t.columns)} columns)")
        if t.description:
            out.append(f"  description: {t.description}")
        if t.hats_order is not None:
            out.append(f"  hats_order: {t.hats_order}")
        if t.position:
            out.append(f"  ra/dec: {t.ra_column}, {t.dec_column} (rule={t.position.rule}, confidence={t.position.confidence})")
        else:
            out.append("  ra/dec: not detected")
        if t.unresolved:
            out.append(f"  unresolved: {', '.join(t.unresolved)}")
        out.append("  columns:")
        for c in t.columns:
            notes = [f"{k}={v}" for k, v in (("unit", c.unit), ("ucd", c.ucd)) if v]
            notes += [f"description={c.description!r}"] if c.description else []
            out.append(f"    - {c.name} ({c.datatype})" + (f" [{', '.join(notes)}]" if notes else ""))
    if registry.skipped:
        out.append("skipped:")
        out += [f"  - {s.uri}: {s.reason}" for s in sorted(registry.skipped, key=lambda s: s.uri)]
    return "\n".join(out)


__all__ = ["CONFIG_NAME", "discover", "detect_position", "inspect_report", "load_overrides"]
