"""Synchronous queries, uploads for one request, and the query log."""

from __future__ import annotations

import contextlib
import datetime as dt
import hashlib
import threading
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..engine import SYNC_TIMEOUT, Engine, Result
from ..errors import InvalidParameterError, ServiceError, UploadTooLargeError
from ..model import ColumnMeta, TableMeta
from ..output import content_type, error_document, serialize
from ..registry import Registry
from ..sources.parsing import parse
from .params import Parameters, TapRequest, tap_request

UPLOAD_MB = 200


class QueryLog:
    """One row for each request. A failure to log never reaches a client.
    Rows gather on the driver and are appended as Parquet in batches."""

    SCHEMA = T.StructType(
        [
            T.StructField("started_at", T.TimestampType()),
            T.StructField("endpoint", T.StringType()),
            T.StructField("query", T.StringType()),
            T.StructField("response_format", T.StringType()),
            T.StructField("maxrec", T.IntegerType()),
            T.StructField("row_count", T.LongType()),
            T.StructField("elapsed_seconds", T.DoubleType()),
            T.StructField("status", T.StringType()),
            T.StructField("error", T.StringType()),
            T.StructField("token_hash", T.StringType()),
        ]
    )

    def __init__(self, spark: SparkSession, path: str | None = None, every: int = 50) -> None:
        self.spark, self.path, self.every = spark, path, every
        self.rows: list[tuple] = []
        self.lock = threading.Lock()

    def record(self, endpoint, query, fmt, maxrec, rows, elapsed, error=None, token=None, started=None) -> None:
        with contextlib.suppress(Exception):
            digest = hashlib.sha256(token.encode()).hexdigest()[:16] if token else None
            row = (started or dt.datetime.now(dt.UTC), endpoint, query, fmt, maxrec, rows, elapsed, "ERROR" if error else "OK", error, digest)
            with self.lock:
                self.rows.append(row)
                full = len(self.rows) >= self.every
            if full and self.path:
                self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = (self.rows, []) if self.path else ([], self.rows)
        if rows:
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def register(self, registry: Registry) -> None:
        with self.lock:
            rows = list(self.rows)
        df = self.spark.createDataFrame(rows, self.SCHEMA)
        if self.path:
            with contextlib.suppress(Exception):
                df = self.spark.read.schema(self.SCHEMA).parquet(self.path).unionByName(df)
        registry.add_frame("service.query_log", df, description="Requests to this service.")


@contextlib.contextmanager
def uploaded(engine: Engine, wanted: dict[str, str], parts: dict[str, bytes], limit_mb: int = UPLOAD_MB) -> Iterator[Registry]:
    """A registry with the request's own tables, under views of their own that
    go when it ends; requests do not wait for each other."""
    scope = engine.registry.scoped()
    views = []
    try:
        for name, part in wanted.items():
            if part not in parts:
                raise InvalidParameterError("UPLOAD", f"there is no part {part!r}")
            if len(parts[part]) > limit_mb << 20:
                raise UploadTooLargeError(limit_mb)
            try:
                parsed = parse("votable", parts[part])[0]
            except ServiceError as e:
                raise InvalidParameterError("UPLOAD", e.message) from None
            columns = tuple(
                ColumnMeta(f.name, f.datatype, f.unit, f.ucd, f.description, f.arraysize, utype=f.utype, xtype=f.xtype)
                for f in parsed.fields
            )
            df = engine.spark.createDataFrame(pa.Table.from_batches([parsed.batch()]))
            views.append(scope.add(TableMeta("tap_upload", name, columns), df).view)
        yield scope
    finally:
        for v in views:
            engine.spark.catalog.dropTempView(v)


class Response:
    def __init__(self, body: bytes, kind: str, status: int = 200, headers: dict | None = None) -> None:
        self.body, self.kind, self.status, self.headers = body, kind, status, headers or {}


def failed(e: Exception) -> Response:
    """Only the message of a known error reaches the client."""
    if isinstance(e, ServiceError):
        headers = {"Retry-After": "30"} if e.retry else {}
        return Response(error_document(e), content_type("votable"), e.status, headers)
    return Response(error_document("Internal error"), content_type("votable"), 500)


def run_request(engine: Engine, request: TapRequest, parts: dict[str, bytes] | None = None, timeout: float = SYNC_TIMEOUT, group: str | None = None) -> Result:
    with uploaded(engine, request.uploads, parts or {}) as scope:
        return engine.run(request.query, request.maxrec, timeout, scope, group)


def sync(engine: Engine, pairs: list[tuple[str, str]], parts: dict[str, bytes] | None = None, log: QueryLog | None = None, token: str | None = None) -> Response:
    began, request, result, error = time.monotonic(), None, None, None
    try:
        request = tap_request(Parameters(pairs))
        if log is not None and "query_log" in request.query.lower():
            log.register(engine.registry)  # what is logged by now
        result = run_request(engine, request, parts)
        body = serialize(result.table, request.format, result.columns, result.overflow)
        return Response(body, content_type(request.format))
    except Exception as e:  # noqa: BLE001
        error = e
        return failed(e)
    finally:
        if log is not None and request is not None:
            message = None if error is None else getattr(error, "message", type(error).__name__)
            log.record("/tap/sync", request.query, request.format, request.maxrec, result.table.num_rows if result else None, time.monotonic() - began, message, token)
