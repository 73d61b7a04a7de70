"""Asynchronous jobs (UWS): a thread for each running job, its own job group."""

from __future__ import annotations

import datetime as dt
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from ..engine import ASYNC_TIMEOUT, Engine
from ..errors import InvalidParameterError, ResourceLimitError, ServiceError
from ..output import content_type, serialize
from .params import TapRequest
from .tap import QueryLog, run_request

PENDING, QUEUED, EXECUTING, COMPLETED, ERROR, ABORTED, HELD, ARCHIVED, SUSPENDED, UNKNOWN = (
    "PENDING QUEUED EXECUTING COMPLETED ERROR ABORTED HELD ARCHIVED SUSPENDED UNKNOWN".split()
)
TERMINAL = frozenset((COMPLETED, ERROR, ABORTED))
MOVES = {
    PENDING: {QUEUED, ABORTED},
    QUEUED: {EXECUTING, ABORTED, ERROR},
    EXECUTING: {COMPLETED, ERROR, ABORTED},
}
KEPT_FOR = dt.timedelta(hours=24)


@dataclass
class Job:
    request: TapRequest
    parts: dict[str, bytes] = field(default_factory=dict, repr=False)
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    phase: str = PENDING
    created: dt.datetime | None = None
    started: dt.datetime | None = None
    ended: dt.datetime | None = None
    destruction: dt.datetime | None = None
    duration: float = ASYNC_TIMEOUT
    error: str | None = None
    result: str | None = None
    future: Future | None = field(default=None, repr=False)

    @property
    def group(self) -> str:
        return f"job-{self.id}"


class Jobs:
    """``runner(job)`` gives the result's bytes; ``clock`` the time: both can
    be replaced in tests."""

    def __init__(
        self,
        engine: Engine | None,
        store: str,
        most: int = 4,
        runner: Callable[[Job], bytes] | None = None,
        clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC),
        queue: int = 100,
        log: QueryLog | None = None,
    ) -> None:
        if "://" in store and not store.startswith("file://"):
            raise NotImplementedError("results are stored in a local or mounted folder")
        self.engine, self.store, self.clock = engine, Path(store.removeprefix("file://")), clock
        self.store.mkdir(parents=True, exist_ok=True)
        self.pool = ThreadPoolExecutor(most, thread_name_prefix="job")
        self.runner = runner or self._query
        self.queue, self.log = queue, log
        self.jobs: dict[str, Job] = {}
        self.lock = threading.RLock()

    def _query(self, job: Job) -> bytes:
        r, rows, error, began = job.request, None, None, time.monotonic()
        try:
            result = run_request(self.engine, r, job.parts, job.duration, job.group)
            rows = result.table.num_rows
            return serialize(result.table, r.format, result.columns, result.overflow)
        except Exception as e:
            error = getattr(e, "message", type(e).__name__)
            raise
        finally:
            if self.log is not None:
                self.log.record("/tap/async", r.query, r.format, r.maxrec, rows, time.monotonic() - began, error)

    def create(self, request: TapRequest, parts: dict[str, bytes] | None = None) -> Job:
        with self.lock:
            self.purge()
            now = self.clock()
            job = Job(request, parts or {}, created=now, destruction=now + KEPT_FOR)
            self.jobs[job.id] = job
            return job

    def get(self, job_id: str) -> Job:
        with self.lock:
            self.purge()
            if job_id not in self.jobs:
                raise InvalidParameterError("job", f"there is no job {job_id}")
            return self.jobs[job_id]

    def _move(self, job: Job, phase: str) -> bool:
        with self.lock:
            if phase not in MOVES.get(job.phase, ()):
                return False
            job.phase = phase
            return True

    def run(self, job_id: str) -> Job:
        """Running a queued or executing job again changes nothing."""
        with self.lock:
            job = self.get(job_id)
            if job.phase in (QUEUED, EXECUTING):
                return job
            if job.phase != PENDING:
                raise InvalidParameterError("PHASE", f"a job that is {job.phase} cannot run")
            if sum(j.phase in (QUEUED, EXECUTING) for j in self.jobs.values()) >= self.queue:
                raise ResourceLimitError("too many jobs are waiting")
            self._move(job, QUEUED)
            job.future = self.pool.submit(self._execute, job)
            return job

    def _execute(self, job: Job) -> None:
        with self.lock:
            if not self._move(job, EXECUTING):
                return
            job.started = self.clock()
        path = self.store / f"{job.id}.result"
        try:
            body = self.runner(job)
            with self.lock:
                if job.phase != EXECUTING:
                    return
                path.write_bytes(body)
                job.result = str(path)
                self._move(job, COMPLETED)
        except Exception as e:  # noqa: BLE001
            with self.lock:
                if self._move(job, ERROR):
                    job.error = e.message if isinstance(e, ServiceError) else f"Internal error ({type(e).__name__})"
        finally:
            with self.lock:
                job.ended = job.ended or self.clock()

    def abort(self, job_id: str) -> Job:
        """Stops this job's own work and no other's."""
        with self.lock:
            job = self.get(job_id)
            if job.phase in TERMINAL:
                return job
            running = job.phase == EXECUTING
            self._move(job, ABORTED)
            job.ended = self.clock()
            if job.future:
                job.future.cancel()
        if running and self.engine is not None:
            self.engine.cancel(job.group)
        return job

    def delete(self, job_id: str) -> None:
        job = self.abort(job_id)
        with self.lock:
            self.jobs.pop(job.id, None)
        if job.result:
            Path(job.result).unlink(missing_ok=True)

    def purge(self) -> None:
        now = self.clock()
        for job in [j for j in self.jobs.values() if j.destruction and j.destruction <= now]:
            self.jobs.pop(job.id, None)
            if job.phase == EXECUTING and self.engine is not None:
                self.engine.cancel(job.group)
            if job.result:
                Path(job.result).unlink(missing_ok=True)

    def result_of(self, job_id: str) -> tuple[bytes, str]:
        job = self.get(job_id)
        if job.phase != COMPLETED:
            raise InvalidParameterError("job", f"is {job.phase}; it has no result")
        return Path(job.result).read_bytes(), content_type(job.request.format)

    def update(self, job_id: str, destruction: dt.datetime | None = None, duration: float | None = None) -> Job:
        with self.lock:
            job = self.get(job_id)
            if destruction is not None:
                job.destruction = min(destruction, job.created + KEPT_FOR)
            if duration is not None and job.phase == PENDING:
                job.duration = min(max(0.0, duration) or ASYNC_TIMEOUT, ASYNC_TIMEOUT)
            return job

    def close(self) -> None:
        self.pool.shutdown(wait=False, cancel_futures=True)


def _time(t: dt.datetime | None) -> str:
    return t.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z" if t else ""


def _element(name: str, text: str | None) -> str:
    return f"<uws:{name}>{escape(text)}</uws:{name}>" if text else f'<uws:{name} xsi:nil="true"/>'


_SPACES = (
    'xmlns:uws="http://www.ivoa.net/xml/UWS/v1.0" xmlns:xlink="http://www.w3.org/1999/xlink" '
    'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" version="1.1"'
)


def job_xml(job: Job, url: str) -> bytes:
    r = job.request
    known = [("QUERY", r.query), ("FORMAT", r.format), ("MAXREC", None if r.maxrec is None else str(r.maxrec)), ("LANG", "ADQL")]
    parameters = "".join(f'<uws:parameter id="{k}">{escape(v)}</uws:parameter>' for k, v in known if v is not None)
    results = (
        f'<uws:results><uws:result id="result" xlink:href={quoteattr(url + "/results/result")} mime-type={quoteattr(content_type(r.format))}/></uws:results>'
        if job.phase == COMPLETED
        else "<uws:results/>"
    )
    error = (
        f'<uws:errorSummary type="fatal" hasDetail="true"><uws:message>{escape(job.error or "")}</uws:message></uws:errorSummary>'
        if job.phase == ERROR
        else ""
    )
    return (
        f'<?xml version="1.0" encoding="utf-8"?>\n<uws:job {_SPACES}><uws:jobId>{job.id}</uws:jobId>'
        + (f"<uws:runId>{escape(r.runid)}</uws:runId>" if r.runid else "")
        + '<uws:ownerId xsi:nil="true"/>'
        + f"<uws:phase>{job.phase}</uws:phase>"
        + '<uws:quote xsi:nil="true"/>'
        + f"<uws:creationTime>{_time(job.created)}</uws:creationTime>"
        + _element("startTime", _time(job.started))
        + _element("endTime", _time(job.ended))
        + f"<uws:executionDuration>{int(job.duration)}</uws:executionDuration>"
        + f"<uws:destruction>{_time(job.destruction)}</uws:destruction>"
        + f"<uws:parameters>{parameters}</uws:parameters>{results}{error}</uws:job>\n"
    ).encode()


def list_xml(jobs: list[Job], url: str) -> bytes:
    items = "".join(
        f'<uws:jobref id="{j.id}" xlink:href={quoteattr(f"{url}/{j.id}")}><uws:phase>{j.phase}</uws:phase>'
        f"<uws:creationTime>{_time(j.created)}</uws:creationTime></uws:jobref>"
        for j in sorted(jobs, key=lambda j: j.created)
    )
    return f'<?xml version="1.0" encoding="utf-8"?>\n<uws:jobs {_SPACES}>{items}</uws:jobs>\n'.encode()
