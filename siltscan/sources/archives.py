"""Archive members as rows, under budgets.

A container's members are read in one task, since its budgets (expanded bytes, ratio, depth) run through its members in order: hot scripts
first, then scripts, markup, the rest. Nested containers are opened with the same budget. What isn't read is a row with a skip reason.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from siltscan.sources.selection import HOT, MARKUP, SCRIPT

#: The guards' defaults.
EXPANSION, RATIO, RATIO_AFTER, MEMBER, DEPTH = 256 << 20, 100, 1 << 20, 5 << 20, 2
MOST_ENTRIES = 2_000_000
HOT_PLACES = {"uploads", "cache", "tmp", "images", "img", "media", "files"}


@dataclass
class Budget:
    consumed: int
    expanded: int = 0

    def spent(self) -> bool:
        return self.expanded > EXPANSION or (self.expanded > RATIO_AFTER and self.expanded > RATIO * max(1, self.consumed))


def bucket(name: str) -> int:
    parts = name.lower().split("/")
    ext = parts[-1].rpartition(".")[2] if "." in parts[-1] else ""
    if ext in HOT and HOT_PLACES & set(parts[:-1]):
        return 0
    return 1 if ext in HOT or ext in SCRIPT else 2 if ext in MARKUP else 3


def kind_of(data: bytes) -> str | None:
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
        return "zip"
    if data[:2] == b"\x1f\x8b":
        try:
            head = zlib.decompressobj(31).decompress(data[:65536], 512)
        except zlib.error:
            return "gz"
        return "tar.gz" if _tar_header(head) else "gz"
    return "tar" if _tar_header(data[:512]) else None


def _tar_header(block: bytes) -> bool:
    if len(block) < 512 or not block[0]:
        return False
    try:
        told = int(block[148:156].split(b"\0")[0].strip() or b"0", 8)
    except ValueError:
        return False
    return told == sum(block[:148]) + 256 + sum(block[156:512])


def members(data: bytes, kind: str) -> Iterator[tuple[str, int, object]]:
    """(name, told size, open function) in scanning order."""
    if kind == "zip":
        z = zipfile.ZipFile(io.BytesIO(data))
        entries = [(i, e) for i, e in enumerate(z.infolist()[:MOST_ENTRIES]) if not e.is_dir()]
        for _, e in sorted(entries, key=lambda x: (bucket(x[1].filename), x[0])):
            yield e.filename, e.file_size, lambda e=e: z.open(e)
    elif kind in ("tar", "tar.gz"):
        with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz" if kind == "tar.gz" else "r|") as t:
            for e in t:
                if e.isfile():
                    yield e.name, e.size, lambda e=e: t.extractfile(e)
    else:
        yield "", 0, lambda: gzip.GzipFile(fileobj=io.BytesIO(data))


def explode(path: str, data: bytes, budget: Budget | None = None, depth: int = 1) -> Iterator[tuple]:
    """(container, member, idx, size, content, skip_reason, depth) rows of one container."""
    kind = kind_of(data)
    if kind is None:
        return
    budget = budget or Budget(len(data))
    idx = 0
    try:
        for name, told, opener in members(data, kind):
            idx += 1
            name = name or path.rsplit("/", 1)[-1].removesuffix(".gz")
            if budget.spent():
                yield path, name, idx, told, None, "budget", depth
                continue
            if told > MEMBER:
                yield path, name, idx, told, None, "size", depth
                continue
            try:
                body = opener().read(MEMBER + 1)
            except (OSError, EOFError, RuntimeError, NotImplementedError, zlib.error, zipfile.BadZipFile, tarfile.TarError):
                yield path, name, idx, told, None, "unreadable", depth
                continue
            budget.expanded += len(body)
            if len(body) > MEMBER:
                yield path, name, idx, told, None, "size", depth
                continue
            yield path, name, idx, len(body), body, None, depth
            if kind_of(body):
                if depth < DEPTH:
                    yield from explode(f"{path}!{name}", body, budget, depth + 1)
                else:
                    yield f"{path}!{name}", "", 0, len(body), None, "depth", depth + 1
    except (OSError, EOFError, zlib.error, zipfile.BadZipFile, tarfile.TarError):
        yield path, "", 0, len(data), None, "unreadable", depth


SCHEMA = "container string, member string, idx int, size long, content binary, skip_reason string, depth int"
KINDS = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int32()]


def explode_containers(files: DataFrame) -> DataFrame:
    """files (path, content) -> member rows; files that are no containers give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for row in explode(path or "", data.as_py() or b""):
                    rows.append(row)
                    held += len(row[4] or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
