"""User-defined rules from YAML, their string, regex and heuristic patterns, and the scan that runs them.

Unknown severities, kinds and heuristics fall back to medium, string and eval_with_variable; hex, entropy and hash patterns are read but not
run, and a rule with nothing to run is left out, as is a pattern that doesn't compile. Of one rule, one finding per line is kept: the first by pattern, then by place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscan.functions.dialect import to_python
from siltscan.functions.signatures import SEVERITIES

Spans = Iterator[tuple[int, int]]


@dataclass(frozen=True)
class Pattern:
    kind: str
    value: str = ""
    ignore_case: bool = False
    least: int = 3
    length: int = 50


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str = "medium"
    category: str = ""
    patterns: tuple[Pattern, ...] = field(default=())


def base64_concat(text: str, p: Pattern) -> Spans:
    """Many assignments of long base64 literals: one finding, at the first."""
    found = list(re.finditer(r"\$\w+\s*\.?=\s*[\"'][A-Za-z0-9+/=]{50,}[\"']", text, re.ASCII))
    if len(found) >= p.least:
        yield found[0].span()


def replace_build(text: str, p: Pattern) -> Spans:
    """str_replace of something by nothing in a literal of more than 15 characters."""
    for m in re.finditer(r"str_replace\s*\(\s*[^,]+,\s*(?:''|\"\")\s*,\s*[\"']([^\"']{16,})[\"']", text):
        yield m.span()


def hex_functions(text: str, p: Pattern) -> Spans:
    """Enough quoted hex strings of which four fifths decode to identifier characters."""
    found = []
    for m in re.finditer(r"[\"']((?:[0-9a-fA-F]{2}){10,})[\"']", text):
        raw = bytes.fromhex(m[1])
        if sum(chr(b).isalnum() and b < 128 or b == 95 for b in raw) >= 0.8 * len(raw):
            found.append(m.span())
    if len(found) >= p.least:
        yield from found


def long_strings(text: str, p: Pattern) -> Spans:
    for m in re.finditer(rf"[\"'][A-Za-z0-9+/=]{{{max(100, p.length)},}}(?=[\"'])", text):
        yield m.span()


def eval_variable(text: str, p: Pattern) -> Spans:
    for m in re.finditer(r"(?<![\w>$:])(?:eval\s*\(\s*@?\$\w|assert\s*\(\s*@?\$\w+\s*(?:\)|\?\?|\?:))", text, re.ASCII):
        yield m.span()


def index_build(text: str, p: Pattern) -> Spans:
    for m in re.finditer(rf"(?:[\]}}]\.\$.{{0,25}}?){{{max(1, p.least)},}}", text, re.DOTALL):
        yield m.span()


#: Evidence of a credential harvester and its weight.
HARVEST = ((3, r"(?i)type\s*=\s*[\"']password"), (2, r"\bmail\s*\("), (1, r"\$_POST"), (1, r"(?i)<form"), (2, r"(?i)api\.telegram\.org|fwrite\s*\("))
HARVEST_LEAST = 4


def harvester(text: str, p: Pattern) -> Spans:
    hits = [(w, re.search(r, text)) for w, r in HARVEST]
    if sum(w for w, m in hits if m) >= HARVEST_LEAST:
        yield next(m for _, m in hits if m).span()


def silent(text: str, p: Pattern) -> Spans:
    """Heuristics that have never been able to match."""
    return iter(())


HEURISTICS: dict[str, Callable[[str, Pattern], Spans]] = {
    "multiple_base64_concat": base64_concat, "str_replace_function_build": replace_build, "variable_function_call": silent, "hex_encoded_functions": hex_functions,
    "goto_obfuscation": silent, "long_encoded_strings": long_strings, "eval_with_variable": eval_variable, "create_function_eval": silent,
    "array_index_string_build": index_build, "credential_harvester": harvester,
}


def load_rules(text: str) -> list[Rule]:
    out = []
    for r in (yaml.safe_load(text) or {}).get("rules") or []:
        patterns = []
        for p in r.get("patterns") or []:
            kind = str(p.get("type", "string")).lower()
            if kind in ("hex", "entropy", "hash"):
                continue
            value, flags = str(p.get("value", p.get("heuristic", ""))), str(p.get("flags", ""))
            if kind == "regex":
                try:
                    to_python(value, "i" in flags, dotall=False)
                except re.error:
                    continue
            elif kind == "heuristic":
                value = value if value in HEURISTICS else "eval_with_variable"
            else:
                kind = "string"
            patterns.append(Pattern(kind, value, "i" in flags, int(p.get("min_occurrences", 3)), int(p.get("min_string_length", 50))))
        severity = str(r.get("severity", "medium")).lower()
        if patterns:
            out.append(Rule(str(r.get("name", "")), severity if severity in SEVERITIES else "medium", str(r.get("category", "")), tuple(patterns)))
    return out


def spans(text: str, p: Pattern) -> Spans:
    if p.kind == "heuristic":
        yield from HEURISTICS[p.value](text, p)
    elif p.value:
        compiled = re.compile(re.escape(p.value), re.IGNORECASE | re.ASCII if p.ignore_case else 0) if p.kind == "string" else to_python(p.value, p.ignore_case, dotall=False)
        for m in compiled.finditer(text):
            yield m.span()


SCHEMA = "path string, rule_name string, severity string, category string, pattern_type string, line long, col long, offset long, matched string"
KINDS = [pa.string()] * 5 + [pa.int64()] * 3 + [pa.string()]


def run_rules(files: DataFrame, rules: list[Rule], path: str = "path", text: str = "text") -> DataFrame:
    """Findings of user-defined rules, one per rule and line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for rule in rules if t else ():
                    lines: set[int] = set()
                    for p in rule.patterns:
                        for a, b in spans(t, p):
                            line = t.count("\n", 0, a) + 1
                            if line not in lines:
                                lines.add(line)
                                begin = t.rfind("\n", 0, a) + 1
                                rows.append((own, rule.name, rule.severity, rule.category, p.kind, line, len(t[begin:a].encode()) + 1, len(t[:a].encode()), t[a:b][:200]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(KINDS), KINDS, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select(F.col(path), F.col(text)).mapInArrow(run, SCHEMA)
