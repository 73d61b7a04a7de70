"""What is known of tables and their columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .plans.shards import Shard


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    datatype: str = "char"
    unit: str | None = None
    ucd: str | None = None
    description: str | None = None
    arraysize: str | None = None
    principal: bool = False
    indexed: bool = False
    std: bool = False
    utype: str | None = None
    xtype: str | None = None

    def metadata(self) -> dict:
        """For a StructField: Catalyst carries it through projection and alias."""
        known = {k: getattr(self, k) for k in ("unit", "ucd", "description", "arraysize", "utype", "xtype")}
        return {k: v for k, v in known.items() if v}


@dataclass(frozen=True)
class SkippedFile:
    uri: str
    reason: str


@dataclass(frozen=True)
class RaDecGuess:
    ra: str
    dec: str
    rule: str  # ucd, name, range, override
    confidence: str  # high, medium, low, override


@dataclass(frozen=True)
class TableMeta:
    schema: str
    name: str
    columns: tuple[ColumnMeta, ...]
    format: str = "service"
    files: tuple[str, ...] = ()
    ra_column: str | None = None
    dec_column: str | None = None
    position: RaDecGuess | None = None
    primary_key: str | None = None
    description: str | None = None
    utype: str | None = None
    shards: tuple[Shard, ...] = ()
    hats_order: int | None = None
    hdu: int | None = None
    unresolved: tuple[str, ...] = ()
    provenance: dict = field(default_factory=dict, hash=False, compare=False)
    #: The registry's own mark: registries of one session do not share views.
    tag: str = field(default="", compare=False)

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.name}"

    @property
    def view(self) -> str:
        return f"v{self.tag}_{self.schema}__{self.name}".lower()

    def column(self, name: str) -> ColumnMeta | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    def with_columns(self, columns: list[ColumnMeta]) -> TableMeta:
        return replace(self, columns=tuple(columns))


#: TAP datatype of each Spark type; all others are char.
_TAP = (
    (T.BooleanType, "boolean"),
    ((T.ByteType, T.ShortType), "short"),
    (T.IntegerType, "int"),
    (T.LongType, "long"),
    (T.FloatType, "float"),
    ((T.DoubleType, T.DecimalType), "double"),
)


def tap_type(kind: T.DataType) -> str:
    return next((name for kinds, name in _TAP if isinstance(kind, kinds)), "char")
