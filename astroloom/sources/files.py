"""From URIs to groups of files, each one table."""

from __future__ import annotations

import fnmatch
import os
import posixpath
import re
import tempfile
import urllib.request
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlparse

from ..model import SkippedFile
from ..shipping import shared_folder

#: extension -> format
FORMATS = {
    ".fits.gz": "fits",
    ".fits": "fits",
    ".fit": "fits",
    ".parquet": "parquet",
    ".csv": "csv",
    ".tsv": "tsv",
    ".ecsv": "ecsv",
    ".vot": "votable",
    ".xml": "votable",
}
CONFIG_NAME = "astroloom.yaml"


def detect_format(path: str) -> str | None:
    lower = path.lower()
    return next((kind for ending, kind in FORMATS.items() if lower.endswith(ending)), None)


def stem(path: str) -> str:
    name = posixpath.basename(path.rstrip("/"))
    ending = next((e for e in FORMATS if name.lower().endswith(e)), "")
    return name[: len(name) - len(ending)] if ending else name


def identifier(text: str) -> str:
    """A legal ``[a-z_][a-z0-9_]*`` name."""
    out = re.sub(r"[^a-z0-9_]+", "_", text.strip().lower()).strip("_") or "x"
    return out if re.match("[a-z_]", out) else f"t_{out}"


class Files:
    """Listing of local folders; of any other scheme through Hadoop's file
    systems; http(s) files are fetched to a local copy."""

    def __init__(self, spark=None) -> None:
        self.spark = spark
        self.fetched: dict[str, str] = {}

    def local(self, uri: str) -> str | None:
        if uri.startswith("file://"):
            return urlparse(uri).path
        return None if "://" in uri else uri

    def _hadoop(self, uri: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def fetch(self, uri: str) -> str:
        """A copy of an http(s) file that all executors can read: in the shared
        folder, or on one machine in a temporary one."""
        if uri not in self.fetched:
            name = posixpath.basename(urlparse(uri).path) or "file"
            shared = shared_folder(self.spark) if self.spark is not None else None
            with urllib.request.urlopen(uri, timeout=60) as r:
                if shared is None:
                    self.fetched[uri] = str(Path(tempfile.mkdtemp(prefix="astroloom-http-")) / name)
                    with open(self.fetched[uri], "wb") as f:
                        while block := r.read(1 << 20):
                            f.write(block)
                else:
                    to = f"{shared}/http-{uuid.uuid4().hex}/{name}"
                    fs, path = self._hadoop(to)
                    out = fs.create(path, True)
                    try:
                        while block := r.read(1 << 20):
                            out.write(bytearray(block))
                    finally:
                        out.close()
                    # "file:/x" is how Hadoop writes a local path.
                    self.fetched[uri] = to.removeprefix("file:") if to.startswith("file:/") and "://" not in to else to
        return self.fetched[uri]

    def is_folder(self, uri: str) -> bool:
        if (p := self.local(uri)) is not None:
            if not os.path.exists(p):
                raise FileNotFoundError(uri)
            return os.path.isdir(p)
        fs, path = self._hadoop(uri)
        return fs.getFileStatus(path).isDirectory()

    def children(self, uri: str) -> list[str]:
        if (p := self.local(uri)) is not None:
            return sorted(os.path.join(os.path.abspath(p), x) for x in os.listdir(p))
        fs, path = self._hadoop(uri)
        return sorted(s.getPath().toString() for s in fs.listStatus(path))

    def below(self, uri: str) -> list[str]:
        """All files under a folder."""
        if (p := self.local(uri)) is not None:
            return sorted(os.path.join(d, n) for d, _, names in os.walk(os.path.abspath(p)) for n in names)
        fs, path = self._hadoop(uri)
        it, out = fs.listFiles(path, True), []
        while it.hasNext():
            out.append(it.next().getPath().toString())
        return sorted(out)

    def exists(self, uri: str) -> bool:
        if (p := self.local(uri)) is not None:
            return os.path.exists(p)
        fs, path = self._hadoop(uri)
        return fs.exists(path)

    def read_text(self, uri: str) -> str:
        if (p := self.local(uri)) is not None:
            return Path(p).read_text()
        return "\n".join(r.value for r in self.spark.read.text(uri).toLocalIterator())


@dataclass(frozen=True)
class SourceGroup:
    schema: str
    table: str
    files: tuple[str, ...]
    is_hats: bool = False


@dataclass
class _Groups:
    found: dict[tuple[str, str], SourceGroup] = field(default_factory=dict)

    def add(self, schema: str, table: str, files: list[str], is_hats: bool = False) -> None:
        """The first source has the plain name; another one of the same name
        gets the next free number."""
        name, n = table, 1
        while (old := self.found.get((schema, name))) is not None:
            if sorted(old.files) == sorted(files):
                return
            n += 1
            name = f"{table}_{n}"
        self.found[schema, name] = SourceGroup(schema, name, tuple(files), is_hats)


def is_hats(files: Files, folder: str) -> bool:
    return any(files.exists(f"{folder.rstrip('/')}/{n}") for n in ("partition_info.csv", "_common_metadata"))


def _is_side_file(path: str) -> bool:
    name = posixpath.basename(path).lower()
    return name.endswith((".meta.yaml", ".meta.yml", ".yaml", ".yml"))


def resolve_sources(uris: list[str], files: Files | None = None) -> tuple[list[SourceGroup], list[SkippedFile]]:
    """A glob is one table, as is a HEALPix-partitioned folder; another folder
    gives a table for each data file, one level deep; a file is a table."""
    files = files or Files()
    groups, skipped = _Groups(), []
    for uri in uris:
        try:
            _resolve(uri, files, groups, skipped)
        except Exception as e:  # noqa: BLE001  one bad source never stops the others
            skipped.append(SkippedFile(uri, f"could not read source: {e}"))
    return list(groups.found.values()), skipped


def _resolve(uri: str, files: Files, groups: _Groups, skipped: list[SkippedFile]) -> None:
    root = uri.rstrip("/") or "/"
    if uri.startswith(("http://", "https://")):
        if detect_format(urlparse(uri).path) is None:
            skipped.append(SkippedFile(uri, "not a recognized catalog file"))
            return
        parent = posixpath.basename(posixpath.dirname(urlparse(uri).path))
        groups.add(identifier(parent) if parent else "data", identifier(stem(urlparse(uri).path)), [files.fetch(uri)])
        return
    if any(c in root for c in "*?["):
        folder, pattern = posixpath.split(root)
        fixed = re.split(r"[*?\[]", root)[0]
        top = posixpath.dirname(fixed)
        found = [
            f
            for f in (files.below(top or ".") if any(c in folder for c in "*?[") else files.children(folder or "."))
            if fnmatch.fnmatch(f, root if "://" in root else os.path.abspath(root)) and detect_format(f)
        ]
        if not found:
            skipped.append(SkippedFile(uri, "glob matched no recognized catalog files"))
            return
        schema = posixpath.basename(top)
        prefix = re.split(r"[*?\[]", pattern)[0].rstrip("_-. ")
        groups.add(identifier(schema) if schema else "data", identifier(prefix) if prefix else "data", found)
        return
    if not files.is_folder(root):
        path = files.local(root)
        path = os.path.abspath(path) if path is not None else root
        if detect_format(path) is None:
            skipped.append(SkippedFile(uri, "not a recognized catalog file"))
            return
        parent = posixpath.basename(posixpath.dirname(path))
        groups.add(identifier(parent) if parent else "data", identifier(stem(path)), [path])
        return
    path = files.local(root)
    path = os.path.abspath(path) if path is not None else root
    if is_hats(files, path):
        parent = posixpath.basename(posixpath.dirname(path))
        groups.add(identifier(parent) if parent else "data", identifier(posixpath.basename(path)), [path], True)
        return
    schema = identifier(posixpath.basename(path))
    for child in files.children(path):
        name = posixpath.basename(child)
        if name.startswith((".", "_")) or _is_side_file(child):
            continue
        if files.is_folder(child):
            if is_hats(files, child):
                groups.add(schema, identifier(name), [child], True)
            elif detect_format(name) == "parquet":  # a table that Spark wrote
                groups.add(schema, identifier(stem(child)), [child])
        elif detect_format(name):
            groups.add(schema, identifier(stem(child)), [child])
        else:
            skipped.append(SkippedFile(child, "unrecognized format"))
