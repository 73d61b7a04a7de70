"""Command line: serve, inspect, scan, export."""

from __future__ import annotations

import argparse
import datetime as dt
import secrets
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(memory_percent: int = 75) -> SparkSession:
    """A cluster's own settings win; these are for a single machine."""
    from .engine import memory_mb

    return (
        SparkSession.builder.appName("sky-catalogs")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", f"{memory_mb(memory_percent)}m")
        .getOrCreate()
    )


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="astroloom", description="Query sky catalogs in place.")
    sub = p.add_subparsers(dest="command", required=True)
    serve = sub.add_parser("serve", help="discover tables and answer queries over HTTP")
    serve.add_argument("sources", nargs="+")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    serve.add_argument("--images", action="append", default=[])
    serve.add_argument("--overrides")
    serve.add_argument("--token", nargs="?", const="", help="protect the service; without a value one is made")
    serve.add_argument("--ttl", type=float, help="minutes until the service ends")
    serve.add_argument("--store", default=tempfile.gettempdir() + "/astroloom-results")
    serve.add_argument("--max-jobs", type=int, default=4)
    serve.add_argument("--memory-percent", type=int, default=75)
    inspect = sub.add_parser("inspect", help="show what would be served")
    inspect.add_argument("sources", nargs="*")
    inspect.add_argument("--overrides")
    scan = sub.add_parser("scan", help="read image headers into a YAML file")
    scan.add_argument("sources", nargs="+")
    scan.add_argument("--output", default="discovered.yaml")
    scan.add_argument("--profile")
    export = sub.add_parser("export", help="write CAOM documents of images")
    export.add_argument("sources", nargs="+")
    export.add_argument("--output", default="caom2")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from .obscore import caom, scan
    from .sources.discovery import discover, inspect_report, load_overrides

    spark = session(getattr(args, "memory_percent", 75))
    if args.command == "inspect":
        print(inspect_report(discover(spark, args.sources, load_overrides(args.overrides))))
        return 0
    if args.command == "scan":
        profile = scan.load_profile(args.profile) if args.profile else None
        found, skipped = scan.scan_images(spark, args.sources, profile)
        scan.write_yaml(found, skipped, args.output)
        print(f"{len(found)} images, {len(skipped)} skipped: {args.output}")
        return 0
    from .engine import Engine
    from .registry import Registry

    if args.command == "export":
        registry = Registry(spark)
        skipped = caom.attach_images(spark, registry, args.sources)
        folder = Path(args.output)
        folder.mkdir(parents=True, exist_ok=True)
        documents = caom.export_xml(spark, registry)
        for i, (_, body) in enumerate(sorted(documents.items())):
            (folder / f"observation-{i:05d}.xml").write_bytes(body)
        print(f"{len(documents)} documents, {len(skipped)} files skipped: {folder}")
        return 0
    from .service.http import Service, server
    from .service.jobs import Jobs
    from .service.tap import QueryLog

    engine = Engine(spark, discover(spark, args.sources, load_overrides(args.overrides)))
    token = None if args.token is None else args.token or secrets.token_urlsafe(16)
    base = f"http://{args.host}:{args.port}" + (f"/t/{token}" if token else "")
    if args.images:
        engine.registry.skipped += caom.attach_images(spark, engine.registry, args.images, base)
    for s in engine.registry.skipped:
        print(f"skipped {s.uri}: {s.reason}", file=sys.stderr)
    down = dt.datetime.now(dt.UTC) + dt.timedelta(minutes=args.ttl) if args.ttl else None
    log = QueryLog(spark, f"{args.store}/query_log")
    log.register(engine.registry)
    engine.registry.publish_schema()
    jobs = Jobs(engine, args.store, args.max_jobs, log=log)
    service = Service(engine, jobs, base, token, down, log, f"{args.store}/ingest")
    http = server(service, args.host, args.port)
    print(f"serving {base}/", flush=True)
    try:
        http.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        service.jobs.close()
        service.log.flush()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
