"""Expanding archives into rows, with limits against bombs, traversal and links."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import stat
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.sources.files import SKIP_DIRS, SKIP_FILES


@dataclass(frozen=True)
class Limits:
    total_bytes: int = 20 * 2**30
    member_bytes: int = 8 * 2**30
    files: int = 20_000
    depth: int = 3
    ratio: float = 400.0


def archive_kind(data: bytes) -> str | None:
    if data[:4] == b"PK\x03\x04":
        return "zip"
    if data[257:262] == b"ustar":
        return "tar"
    for sign, opener in ((b"\x1f\x8b", gzip.open), (b"BZh", bz2.open), (b"\xfd7zXZ\x00", lzma.open)):
        if data.startswith(sign):
            try:
                with opener(io.BytesIO(data)) as f:
                    return "tar" if f.read(512)[257:262] == b"ustar" else "gzip" if sign == b"\x1f\x8b" else None
            except (OSError, EOFError, lzma.LZMAError):
                return None
    return None


def safe_path(name: str) -> str | None:
    """A member's path if it stays inside the archive and is worth having."""
    name = name.replace("\\", "/")
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if name.startswith("/") or not parts or ".." in parts or set(parts[:-1]) & set(SKIP_DIRS) or parts[-1] in SKIP_FILES or parts[-1].startswith("._"):
        return None
    return "/".join(parts)


def _office(data: bytes) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return bool({"[Content_Types].xml", "mimetype"} & set(z.namelist()[:64]))
    except zipfile.BadZipFile:
        return False


class Expansion:
    """One archive's members; sums of bytes and files run over nested archives too."""

    def __init__(self, limits: Limits) -> None:
        self.limits, self.bytes, self.count = limits, 0, 0

    def _members(self, data: bytes, kind: str) -> Iterator[tuple[str, int, int, object, str | None]]:
        """(name, size, packed size, opener, reason to skip)"""
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, i.file_size, i.compress_size, (lambda i=i: z.open(i)), "symlink" if stat.S_ISLNK(i.external_attr >> 16) else None
        else:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                for m in t:
                    if m.isreg() or m.issym() or m.islnk():
                        yield m.name, m.size, m.size, (lambda m=m: t.extractfile(m)), None if m.isreg() else "link"

    def rows(self, name: str, data: bytes, prefix: str = "", depth: int = 0) -> Iterator[tuple[str, bytes | None, str | None]]:
        """(path, content, skipped): each member, or why it was left out."""
        kind = archive_kind(data)
        if kind is None:
            yield prefix + name, None, "not an archive"
            return
        if kind == "gzip":
            with gzip.open(io.BytesIO(data)) as f:
                body, why = self._read(f, name)
            yield prefix + (name[:-3] if name.lower().endswith(".gz") else name + ".out"), body, why
            return
        for member, size, packed, opener, why in self._members(data, kind):
            rel = safe_path(member)
            if why is None:
                why = "unsafe or ignored" if rel is None else "suspicious compression ratio" if packed and size / packed > self.limits.ratio else "too large" if size > self.limits.member_bytes else None
            if why:
                yield prefix + member, None, why
                continue
            if self.count >= self.limits.files:
                yield prefix + member, None, "file count limit reached"
                return
            with opener() as f:
                body, why = self._read(f, member)
            if why:
                yield prefix + rel, None, why
                return
            if archive_kind(body) and not _office(body):
                if depth + 1 < self.limits.depth:
                    yield from self.rows(rel.rsplit("/", 1)[-1], body, prefix + rel + "/", depth + 1)
                else:
                    yield prefix + rel, None, "nested archive too deep"
                continue
            self.count += 1
            yield prefix + rel, body, None

    def _read(self, f, name: str) -> tuple[bytes | None, str | None]:
        most = min(self.limits.member_bytes, self.limits.total_bytes - self.bytes)
        body = f.read(most + 1)
        if len(body) > most:
            return None, "archive exceeds the total extraction budget"
        self.bytes += len(body)
        return body, None


def expand(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(archive, path, content, size, skipped) of rows (path, content); a broken archive gives one skipped row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                try:
                    rows += Expansion(limits).rows(path.rsplit("/", 1)[-1], data or b"")
                except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError) as e:
                    rows.append((path, None, f"broken: {e}"[:200]))
                cols = [[path] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [None if r[1] is None else len(r[1]) for r in rows], [r[2] for r in rows]]
                kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["archive", "path", "content", "size", "skipped"])

    return archives.select("path", "content").mapInArrow(run, "archive string, path string, content binary, size bigint, skipped string")
