"""Runs ADQL: translate, execute under a job group, cap, time out."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .adql import Translation, translate
from .errors import QueryFailedError, QueryTimeoutError
from .model import ColumnMeta
from .registry import Registry, column_of

DEFAULT_MAXREC = 100_000
HARD_MAXREC = 10_000_000
SYNC_TIMEOUT = 300.0
ASYNC_TIMEOUT = 3600.0


def effective_maxrec(asked: int | None, default: int = DEFAULT_MAXREC, hard: int = HARD_MAXREC) -> int:
    return min(default if asked is None else asked, hard)


def memory_mb(percent: int = 75, total_bytes: int | None = None) -> int:
    """A share of the machine's memory, 128 MB at least; for spark.driver.memory."""
    if total_bytes is None:
        import os

        total_bytes = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    return max(128, total_bytes * percent // 100 // (1 << 20))


@dataclass
class Result:
    table: pa.Table
    columns: list[ColumnMeta]
    overflow: bool = False
    elapsed: float = 0.0
    translation: Translation | None = field(default=None, repr=False)


class Engine:
    def __init__(self, spark: SparkSession, registry: Registry | None = None) -> None:
        self.spark = spark
        self.registry = registry or Registry(spark)

    def frame(self, adql: str, registry: Registry | None = None, set_operations: bool = False) -> DataFrame:
        """The query as a lazy DataFrame; Catalyst plans it."""
        registry = registry or self.registry
        translation = translate(adql, registry, set_operations)
        return self._frame(translation)

    def _frame(self, translation: Translation) -> DataFrame:
        from .registry import described
        from .sources.tables import read_files

        own = uuid.uuid4().hex[:8]
        sql = translation.sql
        for view, (table, files) in translation.pruned.items():
            df = read_files(self.spark, table, files) if files else self.spark.table(table.view).limit(0)
            name = f"{view}_{own}"
            described(df, table).createOrReplaceTempView(name)
            sql = sql.replace(f"`{view}`", f"`{name}`")
        try:
            df = self.spark.sql(sql)
        except PySparkException as e:
            raise QueryFailedError(_said(e)) from None
        finally:
            for view in translation.pruned:
                self.spark.catalog.dropTempView(f"{view}_{own}")
        return df

    def run(
        self,
        adql: str,
        maxrec: int | None = None,
        timeout: float | None = SYNC_TIMEOUT,
        registry: Registry | None = None,
        group: str | None = None,
    ) -> Result:
        """The rows of a query, ``maxrec`` of them at most."""
        began = time.monotonic()
        translation = translate(adql, registry or self.registry)
        df = self._frame(translation)
        cap = effective_maxrec(maxrec)
        columns = [column_of(f) for f in df.schema.fields]
        table = self._collect(df.limit(cap + 1 if cap else 0), timeout, began, group)
        overflow = cap == 0 or table.num_rows > cap
        return Result(table.slice(0, cap), columns, overflow, time.monotonic() - began, translation)

    def _collect(self, df: DataFrame, timeout: float | None, began: float, group: str | None) -> pa.Table:
        """Own job group for each query: cancelling one leaves others alone."""
        sc = self.spark.sparkContext
        tag = group or f"query-{uuid.uuid4().hex}"
        late, done = threading.Event(), threading.Event()
        if timeout is not None:

            def stop() -> None:
                if done.wait(max(0.0, timeout - (time.monotonic() - began))):
                    return
                late.set()
                while True:  # a cancel before the job is submitted is lost
                    sc.cancelJobGroup(tag)
                    if done.wait(0.2):
                        return

            threading.Thread(target=stop, daemon=True).start()
        sc.setJobGroup(tag, "ADQL query", interruptOnCancel=True)
        try:
            out = df.toArrow()
        except Exception as e:
            if late.is_set():
                raise QueryTimeoutError(time.monotonic() - began, timeout) from None
            raise QueryFailedError(_said(e)) from None
        finally:
            done.set()
            sc.setLocalProperty("spark.jobGroup.id", None)
        if late.is_set():
            raise QueryTimeoutError(time.monotonic() - began, timeout)
        return out

    def cancel(self, group: str) -> None:
        self.spark.sparkContext.cancelJobGroup(group)


def _said(e: Exception) -> str:
    """The error's class and first line, never a stack trace."""
    name = e.getCondition() if hasattr(e, "getCondition") and e.getCondition() else type(e).__name__
    line = str(e).strip().splitlines()[0] if str(e).strip() else ""
    return f"Query failed: {name}: {line[:300]}"
