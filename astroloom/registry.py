"""Registered tables: qualified name -> lazily built view, and TAP_SCHEMA."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import ColumnMeta, SkippedFile, TableMeta, tap_type

#: The columns of TAP_SCHEMA, S string and I int, in their order.
TAP_SCHEMA = {
    "schemas": "schema_name S, description S, utype S, schema_index I",
    "tables": "schema_name S, table_name S, table_type S, description S, utype S, table_index I",
    "columns": (
        "table_name S, column_name S, description S, unit S, ucd S, utype S, datatype S, arraysize S, xtype S, "
        "size I, principal I, indexed I, std I, column_index I"
    ),
    "keys": "key_id S, from_table S, target_table S, description S, utype S",
    "key_columns": "key_id S, from_column S, target_column S",
}


def _struct(text: str) -> T.StructType:
    kinds = {"S": T.StringType(), "I": T.IntegerType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (c.split() for c in text.split(", "))])


def size_of(column: ColumnMeta) -> int | None:
    if column.datatype == "char" and column.arraysize and column.arraysize.isdigit():
        return int(column.arraysize)
    return None


class Registry:
    """Tables by their lower-case ``schema.table``. A table's frame is built
    once, when first registered; nothing is read before a query runs."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark
        self.tag = uuid.uuid4().hex[:8]
        self.tables: dict[str, TableMeta] = {}
        self.frames: dict[str, Callable[[], DataFrame]] = {}
        self.skipped: list[SkippedFile] = []
        self.outer: Registry | None = None

    def find(self, name: str) -> TableMeta | None:
        found = self.tables.get(name.lower())
        return found or (self.outer.find(name) if self.outer else None)

    def names(self) -> list[str]:
        return sorted(self.tables) + (self.outer.names() if self.outer else [])

    def add(self, table: TableMeta, frame: DataFrame | Callable[[], DataFrame] | None = None) -> TableMeta:
        table = replace(table, tag=self.tag)
        self.tables[table.qualified.lower()] = table
        if frame is not None:
            df = frame() if callable(frame) else frame
            self.frames[table.qualified.lower()] = lambda: df
            described(df, table).createOrReplaceTempView(table.view)
        return table

    def add_frame(self, qualified: str, df: DataFrame, **known) -> TableMeta:
        """A frame as a table; column metadata comes from its fields."""
        schema, _, name = qualified.rpartition(".")
        own = known.pop("columns", None)
        columns = tuple(own) if own else tuple(column_of(f) for f in df.schema.fields)
        return self.add(TableMeta(schema, name, columns, **known), df)

    def remove(self, qualified: str) -> None:
        table = self.tables.pop(qualified.lower(), None)
        self.frames.pop(qualified.lower(), None)
        if table and self.spark is not None:
            self.spark.catalog.dropTempView(table.view)

    def scoped(self) -> Registry:
        """A registry for one request, on top of this one."""
        out = Registry(self.spark)
        out.outer = self
        return out

    def frame(self, qualified: str) -> DataFrame:
        return self.spark.table(self.find(qualified).view)

    def publish_schema(self) -> None:
        """(Re)builds TAP_SCHEMA from what is registered now."""
        for name, text in TAP_SCHEMA.items():
            struct = _struct(text)
            self.tables[f"tap_schema.{name}"] = TableMeta(
                "tap_schema",
                name,
                tuple(ColumnMeta(f.name, tap_type(f.dataType), arraysize="*" if tap_type(f.dataType) == "char" else None, std=True) for f in struct),
                tag=self.tag,
            )
        tables = [self.tables[k] for k in sorted(self.tables)]
        schemas = sorted({t.schema for t in tables})
        rows = {
            "schemas": [(s, None, None, None) for s in schemas],
            "tables": [(t.schema, t.qualified, "table", t.description, t.utype, None) for t in tables],
            "columns": [
                (
                    t.qualified,
                    c.name,
                    c.description,
                    c.unit,
                    c.ucd,
                    c.utype,
                    c.datatype,
                    c.arraysize,
                    c.xtype,
                    size_of(c),
                    int(c.principal or c.name in (t.ra_column, t.dec_column)),
                    int(c.indexed),
                    int(c.std),
                    i,
                )
                for t in tables
                for i, c in enumerate(t.columns)
            ],
            "keys": [],
            "key_columns": [],
        }
        for name, text in TAP_SCHEMA.items():
            df = self.spark.createDataFrame(rows[name], _struct(text))
            df.createOrReplaceTempView(self.tables[f"tap_schema.{name}"].view)


def column_of(f: T.StructField) -> ColumnMeta:
    known = {k: f.metadata.get(k) for k in ("unit", "ucd", "description", "arraysize", "utype", "xtype")}
    kind = tap_type(f.dataType)
    if kind == "char" and not known["arraysize"]:
        known["arraysize"] = "*"
    return ColumnMeta(f.name, kind, **known)


def described(df: DataFrame, table: TableMeta) -> DataFrame:
    """The frame with its column metadata; unsigned 64-bit values as long."""
    out = []
    for f in df.schema.fields:
        column = table.column(f.name)
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType) and f.dataType.precision == 20 and f.dataType.scale == 0:
            c = c.cast("bigint")
        out.append(c.alias(f.name, metadata=column.metadata() if column else {}))
    return df.select(*out)
