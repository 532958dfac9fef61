"""Static decoding of nested layers: base64 (with inflate), escapes, hex strings, chr sequences and rot13."""

from __future__ import annotations

import base64
import binascii
import codecs
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

DEPTH, NESTED, TEXTY = 6, 24, 0.85
LAYERS = (
    ("base64", re.compile(r"[\"']([A-Za-z0-9+/]{16,}={0,2})[\"']")), ("escape", re.compile(r"((?:\\x[0-9a-fA-F]{2}|\\[0-7]{2,3}){4,})")),
    ("hex", re.compile(r"[\"']((?:[0-9a-fA-F]{2}){8,})[\"']")), ("chr", re.compile(r"(chr\s*\(\s*\d+\s*\)(?:\s*\.\s*chr\s*\(\s*\d+\s*\)){3,})")),
    ("rot13", re.compile(r"str_rot13\s*\(\s*[\"']([^\"']+)[\"']")),
)


def texty(raw: bytes) -> bool:
    return bool(raw) and sum(32 <= b < 127 or b in (9, 10, 13) for b in raw) / len(raw) > TEXTY


def decode(method: str, found: str) -> bytes | None:
    try:
        if method == "base64":
            raw = base64.b64decode(found + "=" * (-len(found) % 4), validate=True)
            for wbits in (-15, 15, 31):
                try:
                    return zlib.decompressobj(wbits).decompress(raw, 1 << 20)
                except zlib.error:
                    continue
            return raw
        if method == "hex":
            return bytes.fromhex(found)
        if method == "escape":
            return bytes(int(x[2:], 16) if x[1] == "x" else int(x[1:], 8) & 255 for x in re.findall(r"\\x[0-9a-fA-F]{2}|\\[0-7]{2,3}", found))
        if method == "chr":
            return bytes(int(x) & 255 for x in re.findall(r"\d+", found))
        return codecs.encode(found, "rot13").encode()
    except (binascii.Error, ValueError):
        return None


def layers(text: str, depth: int = 1, most: int = DEPTH) -> Iterator[tuple[int, str, str]]:
    """(depth, method, decoded text) of every layer that decodes to text, outermost first."""
    for method, pattern in LAYERS:
        for n, m in enumerate(pattern.finditer(text)):
            if depth > 1 and n >= NESTED:
                break
            raw = decode(method, m[1])
            if raw is not None and texty(raw) and raw.decode("latin-1") != m[1]:
                inner = raw.decode("latin-1")
                yield depth, method, inner
                if depth < most:
                    yield from layers(inner, depth + 1, most)


SCHEMA = "path string, depth int, method string, decoded string"


def decode_layers(files: DataFrame, most: int = DEPTH) -> DataFrame:
    """files (path, text) -> decoded layers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *x) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for x in layers(t, most=most)]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["path", "depth", "method", "decoded"])

    return files.select("path", "text").mapInArrow(run, SCHEMA)
