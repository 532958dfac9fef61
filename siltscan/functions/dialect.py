"""RE2 expressions for java.util.regex and for Python, and file globs as expressions.

RE2's classes are ASCII, `$` means the very end and `\\s` leaves out the vertical tab. The rewriter spells these out, so the three engines
agree, and makes the comment-gap group possessive, because nested stars recurse in Java.
"""

from __future__ import annotations

import re

#: Fixed value: the gap of white space and comments that rules allow between a name and its bracket.
COMMENT_GAP = r"(?:\s|/\*(?:[^*]|\*+[^*/])*\*+/)*"
SPACE = r"\t\n\f\r "
_UNIT = re.compile(r"\\x\{([0-9A-Fa-f]+)\}|\\.|\[\^?|\]|.", re.DOTALL)


def _rewrite(pattern: str, java: bool) -> str:
    pattern = pattern.replace(COMMENT_GAP, r"(?:\s|/\*(?:[^*]|\*++[^*/])*+\*++/)*+")
    out: list[str] = []
    inside = fresh = False
    for m in _UNIT.finditer(pattern):
        unit = m[0]
        if m[1]:
            out.append(f"\\x{{{m[1]}}}" if java else f"\\u{int(m[1], 16):04x}" if int(m[1], 16) < 65536 else f"\\U{int(m[1], 16):08x}")
        elif unit == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif unit == r"\S" and not inside:
            out.append(f"[^{SPACE}]")
        elif unit == r"\b" and not inside:
            out.append(r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))")
        elif unit == r"\d":
            out.append("0-9" if inside else "[0-9]")
        elif unit == r"\w":
            out.append("0-9A-Za-z_" if inside else "[0-9A-Za-z_]")
        elif not inside and unit in ("[", "[^"):
            inside = fresh = True
            out.append(unit)
            continue
        elif inside and unit == "]":
            if fresh:
                out.append(r"\]")
            else:
                inside = False
                out.append("]")
        elif inside and unit in ("[", "[^"):
            out.append("\\" + unit)
        elif inside and java and unit == "&":
            out.append(r"\&")
        elif not inside and unit == "$":
            out.append(r"\z" if java else r"\Z")
        else:
            out.append(unit)
        fresh = False
    return "".join(out)


def to_java(pattern: str, ignore_case: bool = False, dotall: bool = True) -> str:
    return f"(?{'s' if dotall else ''}d{'i' if ignore_case else ''})" + _rewrite(pattern, True)


def to_python(pattern: str, ignore_case: bool = False, dotall: bool = True) -> re.Pattern[str]:
    flags = re.ASCII | (re.DOTALL if dotall else 0) | (re.IGNORECASE if ignore_case else 0)
    rewritten = _rewrite(pattern, False)
    lead = re.match(r"\(\?([ims]+)\)", rewritten)
    if lead:  # leading flags of the expression itself
        flags |= sum({"i": re.I, "m": re.M, "s": re.S}[c] for c in lead[1])
        rewritten = rewritten[lead.end() :]
    return re.compile(rewritten, flags)


#: POSIX classes of globs.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "blank": " \\t", "cntrl": "\\x00-\\x1f\\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": "\\t\\n\\x0b\\f\\r ", "upper": "A-Z", "xdigit": "0-9A-Fa-f",
}


def glob_to_regex(glob: str) -> str:
    """An anchored expression, for Java and Python alike, of a glob whose wildcards never cross a slash."""
    out, i = ["^"], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\" and i < len(glob):
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[":
            end, body = i, []
            negate = end < len(glob) and glob[end] in "!^"
            end += negate
            start = end
            while end < len(glob) and (glob[end] != "]" or end == start):
                if glob.startswith("[:", end) and (close := glob.find(":]", end)) > 0:
                    body.append(POSIX.get(glob[end + 2 : close], ""))
                    end = close + 2
                    continue
                if glob[end] == "\\" and end + 1 < len(glob):
                    end += 1
                    body.append("\\" + glob[end] if not glob[end].isalnum() else glob[end])
                else:
                    body.append("\\" + glob[end] if glob[end] in "[]^\\&~" else glob[end])
                end += 1
            if end >= len(glob):
                out.append(r"\[")
            else:
                out.append(f"(?!/)[{'^' if negate else ''}{''.join(body)}]")
                i = end + 1
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "/_-" else c)
    return "".join([*out, "$"])
