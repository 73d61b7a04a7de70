"""Files of each format as lazy DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ColumnMeta, TableMeta
from ..shipping import bounded_batches, ship
from .parsing import ARROW, Field, parse

PARSED = ("votable", "ecsv", "fits")
_SPARK = {
    "boolean": T.BooleanType(),
    "short": T.ShortType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "char": T.StringType(),
}


def spark_type(datatype: str, arraysize: str | None) -> T.DataType:
    kind = _SPARK[datatype]
    return T.ArrayType(kind) if datatype != "char" and arraysize and arraysize != "1" else kind


def read_files(spark: SparkSession, table: TableMeta, files: list[str]) -> DataFrame:
    """The rows of some of a table's files; a task for each split or file."""
    if table.format == "parquet":
        return spark.read.option("recursiveFileLookup", "true").parquet(*files)
    if table.format in ("csv", "tsv"):
        return read_delimited(spark, files, "," if table.format == "csv" else "\t", table)
    return read_parsed(spark, table.format, files, table.columns, table.hdu)


def read_delimited(spark: SparkSession, files: list[str], separator: str, table: TableMeta | None = None) -> DataFrame:
    """Types are sniffed once, at discovery; later reads know the schema.
    Whole numbers are 64 bits wide."""
    reader = spark.read.option("header", "true").option("sep", separator)
    if table is not None:
        known = T.StructType([T.StructField(c.name, _known(c)) for c in table.columns])
        return reader.schema(known).csv(files)
    df = reader.option("inferSchema", "true").csv(files)
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def _known(c: ColumnMeta) -> T.DataType:
    return {"timestamp": T.TimestampType(), "date": T.DateType()}.get(c.xtype or "", _SPARK[c.datatype])


def _whole_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """path, content: each file is one row, read by Spark on an executor. A batch
    holds small files of a few megabytes together, or one larger file."""
    ship(spark)
    bounded_batches(spark)
    return spark.read.format("binaryFile").load(list(files)).select("path", "content")


def read_parsed(
    spark: SparkSession, kind: str, files: list[str], columns: tuple[ColumnMeta, ...], hdu: int | None = None
) -> DataFrame:
    """VOTable, ECSV and FITS tables: parsed where they are read."""
    schema = T.StructType([T.StructField(c.name, spark_type(c.datatype, c.arraysize)) for c in columns])
    kinds = [pa.list_(ARROW[c.datatype]) if isinstance(f.dataType, T.ArrayType) else ARROW[c.datatype] for c, f in zip(columns, schema.fields, strict=True)]
    names = [c.name for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                for parsed in parse(kind, raw):
                    if hdu is not None and parsed.hdu != hdu:
                        continue
                    own = dict(zip((f.name for f in parsed.fields), parsed.columns, strict=True))
                    n = len(parsed.columns[0]) if parsed.columns else 0
                    arrays = [own[x].cast(k) if x in own else pa.nulls(n, k) for x, k in zip(names, kinds, strict=True)]
                    whole = pa.RecordBatch.from_arrays(arrays, names)
                    for at in range(0, n, 10_000):
                        yield whole.slice(at, 10_000)

    return _whole_files(spark, files).mapInArrow(run, schema)


def sniff(spark: SparkSession, kind: str, files: list[str]) -> list[dict]:
    """What the tables of parsed formats look like; only schemas and column
    ranges come back: path, hdu, fields, ranges or error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            paths, said = [], []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                paths.append(path)
                try:
                    out = []
                    for parsed in parse(kind, raw):
                        ranges = {}
                        for f, c in zip(parsed.fields, parsed.columns, strict=True):
                            if f.datatype in ("float", "double", "short", "int", "long") and not f.is_array:
                                finite = c.filter(pc.is_finite(c)) if f.datatype in ("float", "double") else c.drop_null()
                                if len(finite):
                                    ends = pc.min_max(finite).as_py()
                                    ranges[f.name] = [float(ends["min"]), float(ends["max"])]
                        out.append(
                            {
                                "hdu": parsed.hdu,
                                "fields": [f.__dict__ for f in parsed.fields],
                                "ranges": ranges,
                                "description": parsed.description,
                            }
                        )
                    said.append(json.dumps({"tables": out}))
                except Exception as e:  # noqa: BLE001  reported, never raised
                    said.append(json.dumps({"error": str(e)}))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(said, pa.string())], ["path", "said"])

    rows = _whole_files(spark, files).mapInArrow(run, "path string, said string").collect()
    return [{"path": r.path, **json.loads(r.said)} for r in sorted(rows, key=lambda r: r.path)]


def field_of(spec: dict) -> Field:
    return Field(**spec)
