"""The HTTP shell: routes to the services, on the standard library's server."""

from __future__ import annotations

import datetime as dt
import hmac
import secrets
from dataclasses import dataclass, field
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qsl, unquote, urlsplit

from ..engine import Engine
from ..errors import InvalidParameterError, ServiceError, ServiceExpiredError, UnauthorizedError, UploadTooLargeError
from ..sources.discovery import discover
from ..sources.files import detect_format
from . import links, search, tap, vosi
from .jobs import Jobs, job_xml, list_xml
from .params import Parameters, tap_request
from .tap import QueryLog, Response, failed

XML = "text/xml"


@dataclass
class Service:
    engine: Engine
    jobs: Jobs
    base_url: str = "http://localhost:8000"
    token: str | None = None
    down_at: dt.datetime | None = None
    log: QueryLog | None = None
    uploads: str | None = None
    upload_mb: int = tap.UPLOAD_MB
    extra: dict = field(default_factory=dict)

    # -- access ------------------------------------------------------------------
    def admit(self, path: str, headers: dict[str, str]) -> str:
        """The path without its token prefix, if the request may pass."""
        if path == "/healthz":
            return path
        if self.down_at and dt.datetime.now(dt.UTC) >= self.down_at:
            raise ServiceExpiredError(f"Service expired at {self.down_at.isoformat()}.")
        given = None
        if path.startswith("/t/"):
            given, _, rest = path[3:].partition("/")
            path = "/" + rest
        elif headers.get("authorization", "").lower().startswith("bearer "):
            given = headers["authorization"][7:].strip()
        if self.token and not hmac.compare_digest((given or "").encode(), self.token.encode()):
            raise UnauthorizedError("This service requires a token: use /t/<token>/ or a bearer token.")
        return path

    # -- routes --------------------------------------------------------------------
    def handle(self, method: str, target: str, headers: dict[str, str] | None = None, body: bytes = b"") -> Response:
        headers = {k.lower(): v for k, v in (headers or {}).items()}
        parts = urlsplit(target)
        try:
            path = self.admit(unquote(parts.path), headers).rstrip("/") or "/"
            pairs = parse_qsl(parts.query, keep_blank_values=True)
            more, files = form(headers.get("content-type", ""), body)
            return self.route(method, path, pairs + more, files)
        except ServiceError as e:
            return failed(e)
        except Exception as e:  # noqa: BLE001
            return failed(e)

    def route(self, method: str, path: str, pairs: list[tuple[str, str]], files: dict[str, tuple[str, bytes]]) -> Response:
        blobs = {k: v[1] for k, v in files.items()}
        if path == "/healthz":
            return Response(b"ok", "text/plain")
        if path == "/":
            return self.landing()
        if path in ("/tap/sync", "/sync"):
            return tap.sync(self.engine, pairs, blobs, self.log, self.token)
        if path.startswith("/tap/async"):
            return self.asynchronous(method, path.removeprefix("/tap/async").strip("/"), pairs, blobs)
        if path.startswith("/scs/"):
            return search.cone_search(self.engine, path.removeprefix("/scs/"), pairs)
        if path == "/sia2/query":
            return search.image_search(self.engine, pairs)
        if path == "/datalink/links":
            return links.links(self.engine, pairs, self.base_url)
        if path in ("/datalink/file", "/datalink/preview"):
            return self.image(path.endswith("preview"), pairs)
        if path == "/soda/sync":
            return links.soda(self.engine, pairs)
        if path in ("/tap/capabilities", "/capabilities"):
            return Response(vosi.capabilities(self.base_url), XML)
        if path in ("/tap/availability", "/availability"):
            return Response(vosi.availability(), XML)
        if path in ("/tap/tables", "/tables"):
            return Response(vosi.tables(self.engine.registry), XML)
        if path in ("/tap/examples", "/examples"):
            return Response(vosi.examples(self.engine), "text/html")
        if path == "/upload" and method == "POST":
            return self.ingest(files)
        return Response(b"Not found", "text/plain", 404)

    def asynchronous(self, method: str, rest: str, pairs: list[tuple[str, str]], blobs: dict[str, bytes]) -> Response:
        url = f"{self.base_url.rstrip('/')}/tap/async"
        p = Parameters(pairs)
        if not rest:
            if method == "GET":
                return Response(list_xml(list(self.jobs.jobs.values()), url), XML)
            job = self.jobs.create(tap_request(p), blobs)
            if (p.one("PHASE") or "").upper() == "RUN":
                self.jobs.run(job.id)
            return Response(b"", "text/plain", 303, {"Location": f"{url}/{job.id}"})
        job_id, _, what = rest.partition("/")
        job = self.jobs.get(job_id)
        again = Response(b"", "text/plain", 303, {"Location": f"{url}/{job_id}"})
        if not what:
            if method == "DELETE" or (p.one("ACTION") or "").upper() == "DELETE":
                self.jobs.delete(job_id)
                return Response(b"", "text/plain", 303, {"Location": url})
            return Response(job_xml(job, f"{url}/{job_id}"), XML)
        if what == "phase":
            if method == "POST":
                wanted = (p.one("PHASE") or "").upper()
                if wanted == "RUN":
                    self.jobs.run(job_id)
                elif wanted == "ABORT":
                    self.jobs.abort(job_id)
                else:
                    raise InvalidParameterError("PHASE", "must be RUN or ABORT")
                return again
            return Response(job.phase.encode(), "text/plain")
        if what == "results/result":
            body, kind = self.jobs.result_of(job_id)
            return Response(body, kind)
        if what == "error":
            return Response(tap.error_document(job.error or ""), "application/x-votable+xml")
        if what == "destruction":
            if method == "POST":
                when = dt.datetime.fromisoformat((p.one("DESTRUCTION") or "").replace("Z", "+00:00"))
                self.jobs.update(job_id, destruction=when if when.tzinfo else when.replace(tzinfo=dt.UTC))
                return again
            return Response((job.destruction.isoformat() if job.destruction else "").encode(), "text/plain")
        if what == "executionduration":
            if method == "POST":
                self.jobs.update(job_id, duration=float(p.one("EXECUTIONDURATION") or 0))
                return again
            return Response(str(int(job.duration)).encode(), "text/plain")
        if what in ("parameters", "results"):
            return Response(job_xml(job, f"{url}/{job_id}"), XML)
        return Response(b"Not found", "text/plain", 404)

    def image(self, small: bool, pairs: list[tuple[str, str]]) -> Response:
        ids = links.checked_ids(Parameters(pairs))
        if len(ids) != 1:
            raise InvalidParameterError("ID", "exactly one is required")
        read = links.open_artifact(self.engine, ids[0])
        if small:
            return Response(links.preview(read), "image/png")
        blocks, at = [], 0
        while block := read(at, 1 << 20):
            blocks.append(block)
            at += len(block)
        return Response(b"".join(blocks), "application/fits")

    def ingest(self, files: dict[str, tuple[str, bytes]]) -> Response:
        """Files that come by a form become tables of the schema ``uploads``."""
        if not self.uploads:
            raise InvalidParameterError("upload", "this service takes no files")
        folder = Path(self.uploads) / "uploads"
        folder.mkdir(parents=True, exist_ok=True)
        paths = []
        for name, body in files.values():
            plain = Path(name).name
            if not plain or detect_format(plain) is None:
                raise InvalidParameterError("upload", f"{plain!r} is no recognized catalog file")
            if len(body) > self.upload_mb << 20:
                raise UploadTooLargeError(self.upload_mb)
            to = folder / f"{secrets.token_hex(4)}" / "uploads" / plain
            to.parent.mkdir(parents=True)
            to.write_bytes(body)
            paths.append(str(to))
        before = set(self.engine.registry.tables)
        discover(self.engine.spark, paths, None, self.engine.registry)
        new = sorted(set(self.engine.registry.tables) - before)
        return Response("\n".join(new).encode(), "text/plain", 201)

    def landing(self) -> Response:
        from html import escape

        rows = "".join(
            f"<li><code>{escape(t.qualified)}</code> {escape(t.description or '')}</li>"
            for t in sorted(self.engine.registry.tables.values(), key=lambda t: t.qualified)
        )
        page = (
            '<!DOCTYPE html><html><head><meta charset="utf-8"/><title>Catalogs</title></head><body><h1>Tables</h1>'
            f'<ul>{rows}</ul><form action="tap/sync" method="post"><input type="hidden" name="LANG" value="ADQL"/>'
            '<input type="hidden" name="MAXREC" value="500"/><input type="hidden" name="FORMAT" value="votable/td"/>'
            '<textarea name="QUERY" rows="6" cols="80">SELECT TOP 10 * FROM TAP_SCHEMA.tables</textarea>'
            '<button>Run</button></form><form action="upload" method="post" enctype="multipart/form-data">'
            '<input type="file" name="file" multiple="multiple"/><button>Upload</button></form></body></html>'
        )
        return Response(page.encode(), "text/html")


def form(kind: str, body: bytes) -> tuple[list[tuple[str, str]], dict[str, tuple[str, bytes]]]:
    """Fields and files of a request body: part name -> (file name, bytes)."""
    if not body:
        return [], {}
    if kind.lower().startswith("application/x-www-form-urlencoded"):
        return parse_qsl(body.decode("utf-8", "replace"), keep_blank_values=True), {}
    if not kind.lower().startswith("multipart/form-data"):
        return [], {}
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + body)
    pairs, files = [], {}
    for part in message.iter_parts() if message.is_multipart() else []:
        name = part.get_param("name", header="content-disposition")
        raw = part.get_payload(decode=True) or b""
        if part.get_filename() is not None:
            key = name if name not in files else f"{name}_{len(files)}"
            files[key] = (part.get_filename(), raw)
        elif name:
            pairs.append((name, raw.decode("utf-8", "replace")))
    return pairs, files


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    limit = (service.upload_mb << 20) + (1 << 20)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            if n > limit:
                out = failed(UploadTooLargeError(service.upload_mb))
                self.close_connection = True
            else:
                out = service.handle(self.command, self.path, dict(self.headers.items()), self.rfile.read(n) if n else b"")
            self.send_response(out.status)
            self.send_header("Content-Type", out.kind)
            self.send_header("Content-Length", str(len(out.body)))
            for k, v in out.headers.items():
                self.send_header(k, v)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(out.body)

        do_GET = do_POST = do_DELETE = do_HEAD = answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
