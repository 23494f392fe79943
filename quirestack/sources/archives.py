"""Archive readers: one row a member, limits checked before members are read; unpacking stops at a limit."""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of an archive, bytes of one member, and bytes that a compressed archive unpacks to, at most; an
#: archive beyond them gives one row with an error.
MEMBERS, MEMBER_BYTES, ARCHIVE_BYTES = 10_000, 50_000_000, 400_000_000


def _safe(name: str) -> bool:
    path = posixpath.normpath(name)
    return not (path.startswith(("/", "..")) or "\x00" in name)


def _members(raw: bytes) -> list[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            found = [(i.filename, i.file_size, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir()]
            return _checked(found)
    plain = raw
    if raw[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=io.BytesIO(raw)) as z:
            plain = z.read(ARCHIVE_BYTES + 1)
        if len(plain) > ARCHIVE_BYTES:
            raise ValueError("the archive unpacks to too much")
    try:
        with tarfile.open(fileobj=io.BytesIO(plain)) as t:
            every = t.getmembers()
            if any(m.issym() or m.islnk() for m in every):
                raise ValueError("links are not read")
            found = [(m.name, m.size, lambda m=m: t.extractfile(m).read()) for m in every if m.isfile()]
            return _checked(found)
    except tarfile.ReadError:
        return [("", plain)]


def _checked(found) -> list[tuple[str, bytes]]:
    if len(found) > MEMBERS:
        raise ValueError("too many members")
    for name, size, _ in found:
        if not _safe(name):
            raise ValueError(f"unsafe path {name}")
        if size > MEMBER_BYTES:
            raise ValueError(f"{name} is too large")
    return [(name, read()) for name, _, read in found]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, content, error) of tar, gzip, zip and plain files; a bad archive is one row that says why."""

    def run(frames):
        for frame in frames:
            for p, raw in zip(frame["path"], frame["content"]):
                try:
                    rows = [(p, name, data, None) for name, data in _members(raw)]
                except (ValueError, OSError, EOFError, zipfile.BadZipFile) as e:
                    rows = [(p, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "member", "content", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary, error string")


def epub_spine(members: DataFrame) -> DataFrame:
    """(path, pos, member) of an e-book's chapters in reading order, without cover and navigation; a malformed package has none."""
    local = "{http://www.idpf.org/2007/opf}"

    def run(frames):
        for frame in frames:
            for p, name, raw in zip(frame["path"], frame["member"], frame["content"]):
                try:
                    root = ElementTree.fromstring(raw)
                except ElementTree.ParseError:
                    continue
                items = {i.get("id"): i for i in root.iter(f"{local}item")}
                order = [items[r.get("idref")] for r in root.iter(f"{local}itemref") if r.get("idref") in items]
                kept = [i.get("href") for i in order if "nav" not in (i.get("properties") or "") and "cover" not in i.get("id").lower()]
                folder = posixpath.dirname(name)
                yield pd.DataFrame({"path": [p] * len(kept), "pos": range(len(kept)), "member": [posixpath.join(folder, h) for h in kept]})

    packages = members.where(F.col("member").endswith(".opf")).select("path", "member", "content")
    return packages.mapInPandas(run, "path string, pos int, member string")
