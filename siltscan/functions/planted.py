"""Example strings of the rules' expressions, and tables that carry them.

The driver's tables hold prose, in which no rule fires. `documents` is therefore planted: one list of texts indexed by the id, the same in
Spark and in other SQL engines, puts a string that an expression matches (made from its syntax tree), or a near miss, before each text.
"""

from __future__ import annotations

import re
from functools import lru_cache

from siltscan.functions.dialect import to_python
from siltscan.functions.signatures import RULES

try:
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_parse  # type: ignore[no-redef]


def _pick(items: list) -> str:
    """A character of a class: the first of a few plain ones that it holds."""
    ranges, negate = [], False
    for op, av in items:
        name = str(op)
        if name == "NEGATE":
            negate = True
        elif name == "LITERAL":
            ranges.append((av, av))
        elif name == "RANGE":
            ranges.append(av)
    inside = [c for a, b in ranges for c in range(a, min(b, a + 3) + 1)]
    if not negate:
        return chr(inside[0])
    return next(c for c in "xa1 _-.QZ#%" if not any(a <= ord(c) <= b for a, b in ranges))


def example(tree, groups: dict[int, str]) -> str:
    """A shortest-first string of a parsed expression."""
    out = ""
    for op, av in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(av)
        elif name == "NOT_LITERAL":
            out += next(c for c in "xa1 " if ord(c) != av)
        elif name == "ANY":
            out += "x"
        elif name == "IN":
            out += _pick(av)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            out += example(av[2], groups) * av[0]
        elif name == "SUBPATTERN":
            got = example(av[3], groups)
            groups[av[0]] = got
            out += got
        elif name == "ATOMIC_GROUP":
            out += example(av, groups)
        elif name == "BRANCH":
            out += example(av[1][0], groups)
        elif name == "GROUPREF":
            out += groups[av]
    return out


@lru_cache(maxsize=1)
def samples() -> tuple[tuple[str, int, str], ...]:
    """(rule, number of its expression, string that the expression matches)."""
    out = []
    for code, _, _, patterns in RULES:
        for i, (pattern, ignore_case, _) in enumerate(patterns):
            compiled = to_python(pattern, ignore_case)
            text = example(sre_parse.parse(compiled.pattern, compiled.flags & ~re.UNICODE), {})
            for made in (text, f"\n{text}\n", f" {text} ", f";{text};"):
                if compiled.search(made) and made.isprintable() | ("\n" in made):
                    out.append((code, i, made))
                    break
    return tuple(out)


def quoted(text: str) -> str:
    """A Spark literal; dollars are escaped, because the parser replaces ${...}."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


#: Endings of the planted paths, by id: extensions and directories that location rules look at.
FOLDERS = ("app", "vendor/lib", "tests", "wp-content/plugins/revslider", "docs")
ENDINGS = (".php", ".html", ".js", ".htaccess", ".sql", ".txt", "")


def planted_columns(spark: bool) -> dict[str, str]:
    """SQL expressions of path and text over documents. Only the way of quoting differs between the engines."""

    def q(text: str) -> str:
        text = text.replace("\x00", "")
        return quoted(text) if spark else "'" + text.replace("'", "''") + "'"

    texts = [f"\n<?php {text} ?>\n" for _, _, text in samples()] + ["<?php eval(base64_encode($x)); // near miss"] * 7
    items = ", ".join(map(q, texts))
    # one literal array: a CASE of so many branches would be compiled into every use
    pick = f"element_at(array({items}), CAST(doc_id % {len(texts)} AS INT) + 1)" if spark else f"list_extract([{items}], CAST(doc_id % {len(texts)} AS INT) + 1)"
    folder = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FOLDERS))
    ending = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ENDINGS))
    kind = "STRING" if spark else "VARCHAR"
    return {
        "path": f"concat('/srv/', source, '/', CASE doc_id % {len(FOLDERS)} {folder} END, '/f', CAST(doc_id AS {kind}), CASE doc_id % {len(ENDINGS)} {ending} END)",
        "text": f"concat({pick}, coalesce(text, ''))",
    }


def planted_sql() -> str:
    """SELECT of doc_id, path, text and the other columns of documents."""
    c = planted_columns(False)
    return f"SELECT doc_id, {c['path']} AS path, {c['text']} AS text, source, lang, n_chars FROM documents"
