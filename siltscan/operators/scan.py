"""The scan: rules over texts -> findings.

One Aho-Corasick pass finds which gate literals a text holds; only the expressions whose gates pass run. Offsets, lines, columns and the windows of filters count bytes of the UTF-8 text, as files do; binary columns are read byte for byte.
The rule table is part of the task's code (about 30 kB), so a scan has no shuffle and its plan is source -> filter -> MapInArrow.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscan.functions.dialect import to_java, to_python
from siltscan.functions.signatures import RULES, SEVERITIES
from siltscan.operators import context
from siltscan.operators.analyzers import ANALYZERS, FOLDED, analyze

FINDINGS = (
    "path string, rule_code string, rule_name string, category string, severity string, original_severity string, pattern_type string, "
    "ord int, offset long, line long, col long, matched string, context string, suppressed boolean"
)
KINDS = [pa.string()] * 7 + [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
BY_CODE = {code: (name, severity) for code, name, severity, _ in RULES}
CATEGORY = re.compile(r"[A-Z]+")


#: Literals of expressions that come without a gate: any match holds one of them.
LEADS = {
    "BD011": "$", "OBF006": "$", "OBF007": "$", "OBF016": "\\", "OBF019": "(", "OBF021": "$", "OBF022": "${", "PHI008": "account|verify", "PL002": "^", "PL009": "=~",
}


def category(code: str) -> str:
    return CATEGORY.match(code)[0]


def selected(use: tuple[str, ...] = (), disable: tuple[str, ...] = ()) -> frozenset[str]:
    """Codes chosen by codes or `category:XX`; no `use` means all."""

    def hit(code: str, names: tuple[str, ...]) -> bool:
        return code in names or f"category:{category(code)}" in names

    return frozenset(c for c in BY_CODE if (not use or hit(c, use)) and not hit(c, disable))


class Plan:
    """Compiled rules: literals, gates and expressions."""

    def __init__(self, codes: frozenset[str]):
        self.codes = codes
        self.rules = [(code, [to_python(p, ci) for p, ci, _ in pats], [[frozenset(g.split("|")) for g in gates or ((LEADS[code],) if code in LEADS else ())] for _, _, gates in pats]) for code, _, _, pats in RULES if code in codes and pats]
        literals = {x for _, _, gates in self.rules for pattern in gates for gate in pattern for x in gate}
        self.automaton = ahocorasick.Automaton()
        for x in literals:
            self.automaton.add_word(x, x)
        self.automaton.make_automaton()
        self.passing = lru_cache(maxsize=4096)(self._passing)  # most texts hold the same few literals
        self.analyzers = [c for c in (*FOLDED, *ANALYZERS) if c in codes]

    def _passing(self, held: frozenset[str]) -> tuple[tuple[str, list[re.Pattern]], ...]:
        """Rules of which a text with these literals passes an expression's gates."""
        return tuple((code, patterns) for code, patterns, gates in self.rules if any(all(gate & held for gate in g) for g in gates))

    def matches(self, text: str) -> Iterator[tuple[str, int, int, int]]:
        """(rule, order, start, end) in the order of rules, expressions and places."""
        held = frozenset(x for _, x in self.automaton.iter(text.lower())) if self.rules else frozenset()
        order = 0
        for code, patterns in self.passing(held):
            for p in patterns:
                for m in p.finditer(text):
                    yield code, order, m.start(), m.end()
                    order += 1
        if self.analyzers:
            for code, a, b in analyze(text):
                if code in self.codes:
                    yield code, order, a, b
                    order += 1


@lru_cache(maxsize=8)
def plan(codes: frozenset[str]) -> Plan:
    return Plan(codes)


def excerpt(text: str, start: int, most: int = 120, lead: int = 20) -> str:
    """Folded surroundings of a match."""
    raw = text[max(0, start - lead) : max(0, start - lead) + most]
    return re.sub(r"[\t\n\r ]+", " ", raw).strip()


def annotated(finding: context.Finding) -> bool:
    """A reviewer's marker stands on the line or on the one before."""
    a = finding.text.rfind("\n", 0, finding.start) + 1
    b = finding.text.rfind("\n", 0, max(0, a - 1)) + 1 if a else 0
    end = finding.text.find("\n", finding.start)
    around = finding.text[b : len(finding.text) if end < 0 else end]
    return any(m in around for m in context.MARKERS)


def bytes_ahead(text: str) -> np.ndarray:
    """For every character, the bytes of UTF-8 before it."""
    point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    width = (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000) + 1
    return np.concatenate([[0], np.cumsum(width)])


def scan_text(p: Plan, path: str, text: str, filters: bool = True, trust: bool = False, raw: bool = False) -> Iterator[tuple]:
    ascii_only = raw or text.isascii()  # a raw text has one character per byte
    lines: list[int] | None = None
    ahead = None  # bytes ahead of each character
    for code, order, a, b in p.matches(text):
        found = context.Finding(path, text, a, text[a:b], raw)
        if filters and not context.kept(code, found):
            continue
        if lines is None:
            lines = [m.end() for m in re.finditer("\n", text)]
        line = bisect_right(lines, a)
        begin = lines[line - 1] if line else 0
        if not ascii_only and ahead is None:
            ahead = bytes_ahead(text)
        offset, col = (a, a - begin) if ascii_only else (int(ahead[a]), int(ahead[a] - ahead[begin]))
        name, severity = BY_CODE[code]
        marked = trust and annotated(found)
        yield path, code, name, category(code), "low" if marked else severity, severity, "analyzer" if code in ANALYZERS or code in FOLDED else "regex", order, offset, line + 1, col + 1, found.matched[:200], excerpt(text, a), marked


def findings(files: DataFrame, path: str = "path", text: str = "text", *, use: tuple[str, ...] = (), disable: tuple[str, ...] = (), filters: bool = True, trust: bool = False) -> DataFrame:
    """One row for every finding in a table of (path, text). A null text has none. Binary texts are read byte for byte."""
    codes = selected(use, disable)
    names = [c.split()[0] for c in FINDINGS.split(", ")]
    raw = dict(files.dtypes)[text] == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan(codes)
        for batch in batches:
            rows: list[tuple] = []
            for own, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py()
                if t:
                    rows += scan_text(p, own.as_py() or "", t.decode("latin-1") if raw else t, filters, trust, raw)
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=names)

    return files.select(F.col(path), F.col(text)).mapInArrow(run, FINDINGS)


def gated(text: Column, pattern: str, ignore_case: bool, gates: tuple[str, ...], lowered: Column | None = None) -> Column:
    """The expression as a column: literals are asked for first, inside CASE, so that their order holds."""
    hit = text.rlike(to_java(pattern, ignore_case))
    low = F.lower(text) if lowered is None else lowered
    gate: Column | None = None
    for g in gates:
        one: Column | None = None
        for literal in g.split("|"):
            c = low.contains(literal)
            one = c if one is None else one | c
        gate = one if gate is None else gate & one
    return hit if gate is None else F.when(gate, hit).otherwise(F.lit(False))


def rule_flag(text: Column, code: str) -> Column:
    """Whether any expression of a rule matches: a native column."""
    out: Column | None = None
    for own, _, _, patterns in RULES:
        if own == code:
            for pattern, ci, gates in patterns:
                c = gated(text, pattern, ci, gates)
                out = c if out is None else out | c
    if out is None:
        raise ValueError(f"{code} has no expressions")
    return out


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, F.lit(i)).otherwise(out)
    return out
