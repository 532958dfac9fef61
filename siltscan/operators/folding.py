"""Constant folding of PHP string expressions: names assembled at run time from pieces.

Literals, concatenation, `.=`, variables and pure functions are folded in the order of the source, with bounds on everything.
A folded value that is an identifier made of two or more pieces, or by a transform, is reported.
"""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from siltscan.operators.context import SENSITIVE

# Bounds.
DEPTH, VALUE, TERMS, ARGUMENTS, MOST, ITEMS = 12, 8192, 256, 8, 20, 256
TOKEN = re.compile(r"\s*(?:(\$\w+)|(\w+)\s*\(|('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(\d+)|(.))", re.DOTALL | re.ASCII)
ASSIGN = re.compile(r"\$(\w+)\s*(\.?=)(?![=>])", re.ASCII)
IDENTIFIER = re.compile(r"[A-Za-z_]\w{1,63}\Z", re.ASCII)
ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{1,2}|[0-7]{1,3}|.)", re.DOTALL)
PLAIN = {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "f": "\f", "e": "\x1b"}


@dataclass
class Value:
    text: str
    pieces: int = 1
    transforms: list[str] = field(default_factory=list)
    variables: bool = False
    items: list[str] | None = None  # of an array literal; it has no text


def implode(args: list[Value]) -> Value | None:
    """Items of the one array among the arguments, joined by the other one; every item is a piece."""
    lists, rest = [a for a in args if a.items is not None], [a for a in args if a.items is None]
    if len(lists) != 1 or len(rest) > 1:
        return None
    one, glue = lists[0], rest[0].text if rest else ""
    text = glue.join(one.items)
    return Value(text, one.pieces, one.transforms, one.variables) if len(text) <= VALUE else None


def literal(raw: str) -> str:
    body = raw[1:-1]
    if raw[0] == "'":
        return re.sub(r"\\([\\'])", r"\1", body)

    def one(m: re.Match[str]) -> str:
        e = m[1]
        if e[0] == "x" and len(e) > 1:
            return chr(int(e[1:], 16))
        if e[0] in "01234567":
            return chr(int(e, 8) & 255)
        return PLAIN.get(e, e if e in "\\$\"" else m[0])

    return ESCAPE.sub(one, body)


def _slice(s: str, start: str, length: str | None = None) -> str:
    a = int(start)
    a = max(0, len(s) + a) if a < 0 else a
    if length is None:
        return s[a:]
    n = int(length)
    return s[a : a + n] if n >= 0 else s[a:n]


def _rot(s: str) -> str:
    return codecs.encode(s, "rot13")


#: Pure functions over strings. str_ireplace is told apart by case here, as results must agree.
FUNCTIONS = {
    "strrev": lambda s: s[::-1], "strtolower": str.lower, "strtoupper": str.upper, "lcfirst": lambda s: s[:1].lower() + s[1:], "ucfirst": lambda s: s[:1].upper() + s[1:],
    "trim": lambda s, c=" \t\n\r\0\x0b": s.strip(c), "ltrim": lambda s, c=" \t\n\r\0\x0b": s.lstrip(c), "rtrim": lambda s, c=" \t\n\r\0\x0b": s.rstrip(c), "str_rot13": _rot,
    "base64_decode": lambda s: base64.b64decode(re.sub(r"\s", "", s) + "==", validate=False).decode("latin-1"), "hex2bin": lambda s: bytes.fromhex(s).decode("latin-1"),
    "chr": lambda n: chr(int(n) % 256), "str_replace": lambda a, b, s: s.replace(a, b) if a else s, "str_ireplace": lambda a, b, s: s.replace(a, b) if a else s,
    "substr": _slice, "pack": lambda f, s: bytes.fromhex(s).decode("latin-1") if f == "H*" else None, "strval": lambda s: s, "str_repeat": lambda s, n: s * int(n) if len(s) * int(n) <= VALUE else None,
}


class Folder:
    def __init__(self, text: str):
        self.text, self.env = text, {}

    def token(self, at: int) -> tuple[re.Match[str] | None, int]:
        m = TOKEN.match(self.text, at)
        return m, m.end() if m else at

    def expression(self, at: int, depth: int = 0) -> tuple[Value | None, int]:
        total, at = self.term(at, depth)
        terms = 1
        while total is not None and terms < TERMS:
            m, after = self.token(at)
            if not m or m[5] != "." or self.text[after : after + 1] == "=":
                break
            more, after = self.term(after, depth)
            if more is None or more.items is not None or total.items is not None:
                return None, after
            total = Value((total.text + more.text)[:VALUE], total.pieces + more.pieces, total.transforms + more.transforms, total.variables or more.variables)
            at, terms = after, terms + 1
        return total, at

    def term(self, at: int, depth: int) -> tuple[Value | None, int]:
        m, after = self.token(at)
        if not m or depth > DEPTH:
            return None, at
        if m[3]:
            return Value(literal(m[3])), after
        if m[4]:
            return Value(m[4]), after
        if m[1]:
            if re.match(r"\s*[(\[{]", self.text[after : after + 64]):  # called or indexed: not its value
                return None, after
            known = self.env.get(m[1][1:])
            return (Value(known.text, known.pieces, list(known.transforms), True) if known else None), after
        if m[5] == "(":
            inner, after = self.expression(after, depth + 1)
            m, end = self.token(after)
            return (inner, end) if inner and m and m[5] == ")" else (None, after)
        if m[5] == "[" or m[2] and m[2].lower() == "array":
            got, after = self.listed(after, "]" if m[5] else ")", ITEMS, depth)
            if got is None or any(v.items is not None for v in got):
                return None, after
            return Value("", sum(v.pieces for v in got), [t for v in got for t in v.transforms], any(v.variables for v in got), [v.text for v in got]), after
        if m[2] and m[2].lower() in ("implode", "join"):
            args, after = self.listed(after, ")", ARGUMENTS, depth)
            return (implode(args) if args else None), after
        if m[2] and m[2].lower() in FUNCTIONS:
            name = m[2].lower()
            args, after = self.listed(after, ")", ARGUMENTS, depth)
            if args is None or any(a.items is not None for a in args):
                return None, after
            try:
                out = FUNCTIONS[name](*(a.text for a in args))
            except (TypeError, ValueError):
                return None, after
            if out is None:
                return None, after
            return Value(out[:VALUE], sum(a.pieces for a in args), [t for a in args for t in a.transforms] + [name], any(a.variables for a in args)), after
        return None, after

    def listed(self, at: int, closer: str, most: int, depth: int) -> tuple[list[Value] | None, int]:
        """Expressions between commas up to the closing bracket; an array may end in a comma."""
        out: list[Value] = []
        while True:
            m, after = self.token(at)
            if m and m[5] == closer and (not out or closer == "]" or most == ITEMS):
                return out, after
            value, after = self.expression(at, depth + 1)
            m, at = self.token(after)
            if value is None or len(out) >= most or not m or m[5] not in (",", closer):
                return None, at
            out.append(value)
            if m[5] == closer:
                return out, at

    def assembled(self) -> Iterator[tuple[int, str, Value]]:
        """(offset, variable, value) of every assembled identifier, appends collapsed to the last."""
        held: dict[str, tuple[int, Value]] = {}
        for m in ASSIGN.finditer(self.text):
            name = m[1]
            value, _ = self.expression(m.end())
            if m[2] == "=" and name in held:
                yield held[name][0], name, held.pop(name)[1]
            if value is None or value.items is not None:
                self.env.pop(name, None)
                continue
            if m[2] == ".=":
                before = self.env.get(name)
                if before is None:
                    continue
                value = Value((before.text + value.text)[:VALUE], before.pieces + value.pieces, before.transforms + value.transforms, before.variables or value.variables)
            self.env[name] = value
            if IDENTIFIER.match(value.text) and (value.pieces >= 2 or value.transforms):
                held[name] = (held[name][0] if name in held else m.start(), value)
            else:
                held.pop(name, None)
        for name, (at, value) in held.items():
            yield at, name, value


SCHEMA = "path string, offset long, variable string, value string, pieces int, transforms array<string>, via_variables boolean, sensitive boolean, called boolean"


def dynamically_called(text: str, variable: str) -> bool:
    """Called as a function, or used as a variable's name; not constructed."""
    v = re.escape(variable)
    return bool(re.search(rf"(?<!new )\${v}\s*\(|\$\${v}\b|\{{\${v}\b", text, re.ASCII))


def assembled_strings(files: DataFrame) -> DataFrame:
    """files (path, text) -> identifiers assembled at run time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.bool_()]
        for batch in batches:
            rows = []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at, name, v in Folder(t).assembled() if t and "$" in t else ():
                    rows.append((p, len(t[:at].encode()), name, v.text, v.pieces, v.transforms, v.variables, v.text.lower().lstrip("$") in SENSITIVE, dynamically_called(t, name)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def assembled_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """OBF024 for sensitive names that are called or decoded, OBF025 for those merely split in two; at most MOST of each."""
    seen = {"OBF024": 0, "OBF025": 0}
    for at, name, v in Folder(text).assembled():
        if v.text.lower() in SENSITIVE:
            code = "OBF024" if v.transforms or v.pieces > 2 or dynamically_called(text, name) else "OBF025"
            seen[code] += 1
            if seen[code] <= MOST:
                yield code, at, at + len(name) + 1
