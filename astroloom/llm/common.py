"""Shared helpers of the text operators.

Words are the maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z
is lower-cased. On UTF-8 that is a byte-wise rule (every byte of a non-ASCII
character is a word byte), so one ``bytes.translate`` and one ``split`` do it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import bounded_batches, ship

#: Stands for a null id where a key is needed (joins, orders).
NULL_ID = -(2**63)

_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

WHITE = b" \t\n\x0b\x0c\r"


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, rows: int = 256) -> DataFrame:
    """``fn`` over slices of each Arrow batch; one narrow stage, nothing is
    collected. Batches are bounded in bytes, slices in rows, so a worker's memory
    is, however many long documents stand in a row."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Only on one
    machine may it be unset: then a temporary one is set."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        there = os.path.join(tempfile.gettempdir(), f"astroloom-checkpoints-{os.getpid()}")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(there)
    return there


#: Checkpoints that were made and not deleted yet.
_MADE: list[str] = []


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _MADE.append(file.get())
    return out


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def made() -> int:
    """A mark for ``sweep``."""
    return len(_MADE)


def sweep(spark: SparkSession, mark: int) -> None:
    """Deletes the checkpoints made since the mark. Only for results that are
    written: a frame that is still to run needs them."""
    while len(_MADE) > mark:
        delete(spark, _MADE.pop())


def text_key(text: Column) -> list[Column]:
    """128 bits of a text as two longs (null as empty)."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t), F.xxhash64(F.lit(0x5EED), t)]


def id_key(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NULL_ID))
