"""Large results as files that executors write side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import UnsupportedFormatError
from .formats import CSV, JSON, PARQUET, TSV


def write(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """No row passes the driver; VOTable is for results that fit a response."""
    out = df.write.mode(mode)
    if kind == PARQUET:
        out.parquet(path)
    elif kind in (CSV, TSV):
        out.option("header", "true").option("sep", "," if kind == CSV else "\t").csv(path)
    elif kind == JSON:
        out.json(path)
    else:
        raise UnsupportedFormatError(kind, [CSV, JSON, PARQUET, TSV])
