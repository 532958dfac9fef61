"""What an .htaccess directive runs as a script: scripts, documents or data."""

from __future__ import annotations

import re

from siltscan.functions.dialect import glob_to_regex

# Fixed values.
SCRIPT = (
    "phtml", "pht", "phtm", "phps", "phar", "inc", "module", "install", "theme", "profile", "engine", "tpl", "ctp", "cgi", "fcgi", "pl",
    "pm", "py", "rb", "sh", "asp", "aspx", "ashx", "asmx", "jsp", "jspx", "cfm", "cfml", "shtml", "stm",
)
PROBES = ("x.jpg", "x.png", "x.gif", "x.txt", "x.zip", "x.sql", "x.css", "x.js", "x.ico", "x", "x.html", "x.htm", "x.php", "x.phtml", "x.cgi", "x.pl")
ORDER = ("script", "document", "data")
DIRECTIVES = re.compile(r"(?im)^[ \t]*Options\b(.*)$")


def extension_class(ext: str) -> str:
    e = ext.strip("\"'").lower().removeprefix(".")
    if re.fullmatch(r"php[0-9]*", e) or e in SCRIPT:
        return "script"
    return "document" if e in ("html", "htm") else "data"


def name_class(name: str) -> str:
    return extension_class(name.rpartition(".")[2]) if "." in name else "data"


def handler(token: str) -> str | None:
    h = token.strip("\"'").lower()
    if h.startswith("proxy:"):
        return "fpm" if "fcgi:" in h else None
    if h in ("cgi-script", "fcgid-script"):
        return "cgi"
    if h.startswith("text/") or "php-source" in h:
        return None
    return "php" if "php" in h else None


def enables_cgi(text: str) -> bool:
    """The last word on ExecCGI among Options lines."""
    on = False
    for m in DIRECTIVES.finditer(text):
        words = m[1].lower().split()
        if any(not w.startswith(("+", "-")) for w in words):
            on = False
        for w in words:
            if w.lstrip("+-") in ("execcgi", "all"):
                on = not w.startswith("-")
    return on


def widest(classes: list[str]) -> str:
    return max(classes, key=ORDER.index, default="data")


def enclosing_selector(text: str, at: int) -> tuple[str, bool] | None:
    """The Files or FilesMatch block around a place: its selector and whether it is an expression."""
    opened: list[tuple[str, bool]] = []
    for m in re.finditer(r"(?im)^[ \t]*<(/?)(FilesMatch|Files)\b[ \t]*(~?)[ \t]*([^>]*)>", text[:at]):
        if m[1]:
            del opened[-1:]
        else:
            opened.append((m[4].strip().strip("\"'"), m[2].lower() == "filesmatch" or bool(m[3])))
    return opened[-1] if opened else None


#: What RE2 doesn't compile: looking ahead or back, atomic groups, references to groups.
REFUSED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]")
SPELT = {True: re.compile(r"(?:[A-Za-z0-9_-]|\\\.)+"), False: re.compile(r"[A-Za-z0-9_.-]+")}


def spelt(selector: str, expression: bool) -> tuple[list[str], list[str]]:
    """Names that a selector writes out, and the extensions that end its alternatives."""
    names_, endings = [], []
    for m in SPELT[expression].finditer(selector):
        name = m[0].replace("\\.", ".").lower() if expression else m[0].lower()
        if "." not in name:  # a whole name, or an extension of any name
            names_ += [name, f"x.{name}"]
            continue
        names_.append(f"x{name}" if name.startswith(".") else name)
        if selector[m.end() : m.end() + 1] in ("", "$", ")", "|", '"', "'"):
            endings += [name.rpartition(".")[2]] if name[-1] != "." else []
    return names_, endings


def selector_class(selector: str, expression: bool) -> str:
    """The widest class among the names that a selector reaches; data where nothing bounds it."""
    names_, endings = spelt(selector, expression)
    if expression and REFUSED.search(selector):
        return "data"
    try:
        test = re.compile(selector if expression else glob_to_regex(selector.lower()), re.IGNORECASE)
    except re.error:
        return "data"
    return widest([extension_class(e) for e in endings] + [name_class(n) for n in (*PROBES, *names_) if test.search(n)])


def executed_class(text: str, at: int) -> str | None:
    """The class of what the directive at a place runs; None if it runs nothing."""
    end = at
    while (end := text.find("\n", end)) >= 0 and text[:end].rstrip("\r").endswith("\\"):
        end += 1
    line = re.sub(r"\\\r?\n", " ", text[at : len(text) if end < 0 else end])
    words = [w.strip("\"'") for w in re.findall(r"\"[^\"]*\"|'[^']*'|\S+", line)]
    if len(words) < 2 or (kind := handler(words[1])) is None or (kind == "cgi" and not enables_cgi(text)):
        return None
    if words[0].lower() in ("addtype", "addhandler"):
        return widest([extension_class(w) for w in words[2:]]) if len(words) > 2 else None
    if words[0].lower() in ("sethandler", "forcetype"):
        block = enclosing_selector(text, at)
        return selector_class(*block) if block else "data"
    return None


def is_access_file(name: str) -> bool:
    return name.rstrip(". ").lower() == ".htaccess"
