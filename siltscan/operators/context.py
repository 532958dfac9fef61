"""Context filters: when a finding of a rule is kept, told as data.

A rule has a list of conditions; all must hold. The same table is read by the scan kernel (plain strings) and
compiled to Spark columns by `near_column` for conditions on a window around the match.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltscan.operators import htaccess


@dataclass(frozen=True)
class Finding:
    path: str
    text: str
    start: int
    matched: str
    raw: bool = False  # a text of one character per byte

    def window(self, before: int, after: int) -> str:
        """What lies in so many bytes of UTF-8 ahead of the match's start and behind it."""
        a, b = self.text[max(0, self.start - before) : self.start], self.text[self.start : self.start + after]
        if not (self.raw or a.isascii() and b.isascii()):
            a = a.encode("utf-8", "surrogatepass")[-before:].decode("utf-8", "replace") if before else ""
            b = b.encode("utf-8", "surrogatepass")[:after].decode("utf-8", "replace")
        return a + b

    @property
    def line(self) -> str:
        a = self.text.rfind("\n", 0, self.start) + 1
        b = self.text.find("\n", self.start)
        return self.text[a : len(self.text) if b < 0 else b]

    @property
    def folders(self) -> list[str]:
        return self.path.lower().split("/")[:-1]


def extension(path: str) -> str:
    """Lower-case extension with its dot; empty where the last of dot and slashes isn't a dot."""
    m = re.search(r"\.[^./\\]*$", path.lower())
    return m[0] if m else ""


Condition = Callable[[Finding], bool]


@dataclass(frozen=True)
class Near:
    """One of `words` lies in the bytes from `before` ahead of the match to `after` past its start (or, not `wanted`, none does)."""

    before: int
    after: int
    words: tuple[str, ...]
    wanted: bool = True

    def __call__(self, f: Finding) -> bool:
        around = f.window(self.before, self.after)
        return any(w in around for w in self.words) == self.wanted


@dataclass(frozen=True)
class Matched:
    """None of `words` lies in the matched text."""

    words: tuple[str, ...]

    def __call__(self, f: Finding) -> bool:
        return not any(w in f.matched for w in self.words)


@dataclass(frozen=True)
class Line:
    """None of `words` lies on the line of the match."""

    words: tuple[str, ...]

    def __call__(self, f: Finding) -> bool:
        line = f.line
        return not any(w in line for w in self.words)


@dataclass(frozen=True)
class Folders:
    """No folder of the path has one of these names, or holds one of these fragments."""

    named: tuple[str, ...] = ()
    holding: tuple[str, ...] = ()

    def __call__(self, f: Finding) -> bool:
        return not any(x in self.named or any(h in x for h in self.holding) for x in f.folders)


@dataclass(frozen=True)
class Extension:
    """The extension is one of these (or, not `wanted`, isn't)."""

    names: tuple[str, ...]
    wanted: bool = True

    def __call__(self, f: Finding) -> bool:
        return (extension(f.path) in self.names) == self.wanted


def never(f: Finding) -> bool:
    return False


def in_comment(f: Finding) -> bool:
    """On a line that begins with * or //, or behind an unclosed /*."""
    head = f.line.lstrip(" \t")
    if head.startswith(("*", "//")):
        return True
    return f.text.rfind("/*", 0, f.start) > f.text.rfind("*/", 0, f.start)


def not_in_comment(f: Finding) -> bool:
    return not in_comment(f)


JSON_VALUE = re.compile(r'(?<!\\)(?:\\\\)*"')


def not_json_data(f: Finding) -> bool:
    """Not inside a JSON string value of a data document: the nearest unescaped quote before the match, at most 8 KiB back, follows a colon."""
    if extension(f.path) not in DATA:
        return True
    back = f.window(8192, 0)
    at = len(back)
    while (at := back.rfind('"', 0, at)) >= 0:
        if (at - len(back[:at].rstrip("\\"))) % 2 == 0:
            return not back[:at].rstrip(" \t").endswith(":")
    return True


def ascending(values: list[int], least: int) -> bool:
    return len(values) >= least and all(a < b for a, b in zip(values, values[1:], strict=False))


def mixed_chr(f: Finding) -> bool:
    return not ascending([int(x) for x in re.findall(r"chr[ \t]*\([ \t]*([0-9]+)", f.matched)], 3)


def mixed_octal(f: Finding) -> bool:
    return not ascending([int(x, 8) for x in re.findall(r"\\([0-7]{1,3})", f.matched)], 8)


def no_bundle(f: Finding) -> bool:
    """The literal that opens within 32 characters, 64 KiB of it at most, carries no bundler's marks."""
    m = re.compile(r"[\"']").search(f.text, f.start, f.start + 32)
    if not m:
        return True
    body = re.compile(rf"(?:\\.|[^\\{m[0]}])*", re.DOTALL).match(f.text, m.end(), m.end() + 65536)[0]
    return not any(w in body for w in BUNDLERS)


def alias_not_prose(f: Finding) -> bool:
    head, by, word = f.matched.lower().rpartition(" by ")
    return not by or word not in PROSE


def script_or_bare(f: Finding) -> bool:
    name = re.split(r"[/\\]", f.path)[-1]
    return "." not in name[1:] or extension(name) in SCRIPTS


def calls_twice_or_input(f: Finding) -> bool:
    return len(re.findall(r"\$[A-Za-z][0-9]?[ \t]*\([ \t]*\$[A-Za-z][0-9]?[ \t]*\)", f.text)) >= 2 or any(w in f.text for w in (*SUPERGLOBALS, "php://input"))


def hides_sensitive(f: Finding) -> bool:
    """The quoted pieces, joined and reversed, spell a sensitive name (nothing quoted: kept)."""
    pieces = re.findall(r"'((?:\\.|[^'\\])*)'|\"((?:\\.|[^\"\\])*)\"", f.matched, re.DOTALL)
    folded = "".join(re.sub(r"\\(.)", r"\1", a or b) for a, b in pieces)
    return not folded or folded[::-1].lower() in SENSITIVE


def fetch_runs(f: Finding) -> bool:
    inside = not Folders(("vendor", "vendor-prefixed"), ("revslider", "googlefonts", "google-fonts"))(f)
    return not inside or "eval" in f.window(0, 500)


def plain_control_bytes(f: Finding) -> bool:
    if f.text.startswith("\x00\x05\x16\x07") and "<?" not in f.text:
        return False
    head = f.text[:512]
    return "Generated by the protocol buffer compiler" not in head and "namespace GPBMetadata" not in head


def runs(kind: str) -> Condition:
    """The directive of an .htaccess file runs what is `kind`."""
    return lambda f: htaccess.is_access_file(re.split(r"[/\\\\]", f.path)[-1]) and htaccess.executed_class(f.text, f.start) == kind


def keylogger(f: Finding) -> bool:
    after = f.window(0, 500)
    if any(w in after for w in KEYLOG):
        return True
    takes = "String.fromCharCode" in after or ("event.key" in after and "+=" in after)
    return takes and any(w in after for w in ("new Image(", ".src =", "send("))


# The word lists of the filters.
DATA = (".html", ".htm", ".xhtml", ".json", ".log", ".csv", ".tsv", ".xml", ".txt", ".md")
BUNDLERS = ("__webpack_require__", "sourceURL=webpack", "webpack:///", "/*! ")
INSTALLERS = (
    "getcomposer.org", "raw.githubusercontent.com", "get.symfony.com", "cygwin.com", "sh.rustup.rs", "deb.nodesource.com",
    "rpm.nodesource.com", "install.python-poetry.org",
)
EXFILTRATION = (
    "DB_PASSWORD", "DB_USER", "DB_NAME", "DB_HOST", "mail(", "wp_mail(", "curl_setopt", "curl_exec", "fsockopen", "stream_socket_client",
    "base64_encode", "gzcompress", "gzdeflate", "http_build_query", 'file_get_contents("http', "file_get_contents('http",
)
GUARDS = ("403 Forbidden", "Forbidden", "Deny from all", "deny from all", "Options -Indexes", "Silence is golden", "HTTP/1.0 403", "R=404")
EMPTY_WRITES = (", '')", ', "")', ",'')", ',"")')
DIRECTIVES = (
    "AddType", "AddHandler", "SetHandler", "ForceType", "php_flag engine", "php_value", "php_admin_value", "Action ", "x-httpd-php",
    "application/x-httpd",
)
TEXT = (
    ".php", ".php0", ".php1", ".php2", ".php3", ".php4", ".php5", ".php6", ".php7", ".php8", ".phps", ".pht", ".phtm", ".phtml", ".inc",
    ".tpl", ".ctp", ".module", ".install", ".engine", ".theme", ".profile", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".vue", ".html", ".htm",
    ".xhtml", ".shtml", ".css", ".svg", ".xml", ".json", ".yml", ".yaml", ".ini", ".conf", ".cfg", ".env", ".txt", ".log", ".md",
    ".htaccess", ".htpasswd", ".pl", ".pm", ".py", ".rb", ".sh", ".bash", ".ksh", ".zsh", ".lua", ".cgi", ".c", ".cpp", ".h", ".asp",
    ".aspx", ".ashx", ".asmx", ".jsp", ".jspx", ".cfm", ".ps1", ".bat",
)
SCRIPTS = (
    ".php", ".php5", ".php7", ".php8", ".phtml", ".inc", ".module", ".install", ".theme", ".profile", ".engine", ".tpl", ".ctp",
)
KEYLOG = ("String.fromCharCode", "keyBuffer", "keyLog", "loggedKeys", "keys +=", "capturedKeys")
SOCKET_CLIENTS = ("ftp", "FTP", "_connect", "_data_", "SOCK_DGRAM", "udp", "UDP")
PROSE = (
    "identifying", "exploiting", "using", "the", "a", "an", "attackers", "hackers", "malicious", "someone", "anyone", "this", "these",
    "those", "scanning", "checking", "blocking", "monitoring", "default",
)
SUPERGLOBALS = ("$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_SERVER", "$_FILES")
DROPPERS = (
    "$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_FILES", "php://input", "base64_decode", "gzinflate", "curl_exec",
    "file_get_contents('http", 'file_get_contents("http',
)
SANITISERS = ("htmlentities", "htmlspecialchars", "strip_tags", "esc_html", "esc_attr", "wp_kses")
NATIONAL_SHOPS = (
    "amazon.cn", "amazon.ru", "alibaba.cn", "taobao.cn", "weibo.cn", "baidu.cn", "qq.cn", "163.cn", "sina.cn", "jd.cn", "read.amazon.cn",
)
API_HOSTS = (
    "googleapis.com", "api.wordpress.org", "downloads.wordpress.org", "wordpress.org", "github.com", "raw.githubusercontent.com",
    "api.github.com", "packagist.org", "getcomposer.org", "cdn.jsdelivr.net", "cdnjs.cloudflare.com", "unpkg.com", "fonts.google.com",
    "fonts.gstatic.com", "api.jquery.com", "registry.npmjs.org",
)
RSA_OID = "300d06092a864886f70d0101010500"
CONSUMERS = ("eval", "assert(", "create_function", "preg_replace", "include", "require")
SENSITIVE = frozenset((
    "eval", "assert", "create_function", "call_user_func", "call_user_func_array", "preg_replace", "preg_replace_callback", "array_map",
    "array_filter", "register_shutdown_function", "register_tick_function", "forward_static_call", "system", "exec", "shell_exec",
    "passthru", "popen", "proc_open", "pcntl_exec", "escapeshellcmd", "escapeshellarg", "expect_popen", "dl", "base64_decode",
    "base64_encode", "gzinflate", "gzuncompress", "gzdecode", "gzdeflate", "str_rot13", "convert_uudecode", "hex2bin", "bin2hex", "pack",
    "unpack", "unserialize", "urldecode", "rawurldecode", "strrev", "openssl_decrypt", "mcrypt_decrypt", "zlib_decode",
    "file_get_contents", "file_put_contents", "fopen", "fwrite", "fputs", "fread", "unlink", "rename", "copy", "mkdir", "rmdir", "chmod",
    "chown", "touch", "move_uploaded_file", "readfile", "scandir", "opendir", "readdir", "glob", "tempnam", "sys_get_temp_dir", "symlink",
    "link", "include", "include_once", "require", "require_once", "curl_init", "curl_exec", "curl_setopt", "fsockopen", "pfsockopen",
    "socket_create", "socket_connect", "stream_socket_client", "get_headers", "file", "fpassthru", "mail", "ini_set", "ini_restore",
    "error_reporting", "set_time_limit", "putenv", "getenv", "phpinfo", "extract", "parse_str", "header", "die", "exit", "_post", "_get",
    "_request", "_cookie", "_server", "_files", "_env", "_session", "globals", "http_raw_post_data", "php_uname", "wp_insert_user",
    "wp_create_user", "add_action", "add_filter", "update_option", "wp_remote_get", "wp_remote_post",
))
MARKERS = (
    "phpcs:ignore", "phpcs:disable", "@codingStandardsIgnore", "// noqa", "# noqa", "/* noqa", "// nolint", "// NOSONAR", "@SuppressWarnings",
    "// @ts-ignore", "// eslint-disable", "/* eslint-disable",
)

VENDOR = ("vendor", "vendor-prefixed")
CONDITIONS: dict[str, tuple[Condition, ...]] = {
    "RCE009": (never,),
    "PHI003": (never,),
    "SEO001": (Extension((".js",), wanted=False),),
    "DEFC006": (no_bundle,),
    "DRP002": (Matched(INSTALLERS),),
    "BD004": (Near(0, 400, EXFILTRATION),),
    "OBF036": (Extension(TEXT), Folders(("wflogs",)), plain_control_bytes),
    "SEO008": (script_or_bare,),
    "DEFC002": (Near(400, 400, GUARDS, wanted=False), Near(0, 400, EMPTY_WRITES, wanted=False)),
    "BD008": (Near(400, 400, DIRECTIVES),),
    "BD019": (runs("data"),),
    "BD020": (runs("document"),),
    "BD013": (not_in_comment, Folders(("tests", "test", "testdata", "fixtures", "fixture", ".ssh"))),
    "CRED004": (keylogger,),
    "BD005": (Line(SOCKET_CLIENTS),),
    "DEFC001": (alias_not_prose,),
    "OBF002": (mixed_chr, Folders(("vendor", "tests", "test"))),
    "OBF016": (mixed_octal,),
    "OBF009": (Near(0, 300, CONSUMERS),),
    "OBF021": (not_in_comment, calls_twice_or_input),
    "BD001": (Extension((".sql", ".gz", ".bz2", ".dump"), wanted=False),),
    "DRP008": (Near(100, 300, DROPPERS),),
    "OBF003": (Matched((RSA_OID,)), Folders(("vendor", "third-party", "third_party", "vendor-prefixed", "phpseclib", "crypt"))),
    "OBF004": (Extension((".js", ".mjs", ".cjs", ".jsx", ".json", ".map"), wanted=False),),
    "OBF010": (Folders(VENDOR, ("revslider", "revolution-slider", "layerslider", "theme-options", "redux-framework")), Near(0, 300, ("json_decode",), wanted=False)),
    "OBF011": (Folders(VENDOR, ("js_composer", "wpbakery", "visual-composer", "elementor", "divi", "beaver-builder")), Line(SANITISERS)),
    "OBF005": (hides_sensitive,),
    "CRED006": (Matched(NATIONAL_SHOPS),),
    "DRP001": (Matched(API_HOSTS), fetch_runs),
}


def kept(code: str, finding: Finding) -> bool:
    if code.startswith(("RCE", "WS", "DRP", "EXP", "BD")) and not not_json_data(finding):
        return False
    return all(c(finding) for c in CONDITIONS.get(code, ()))


def near_column(near: Near, text: Column, start: Column) -> Column:
    """A Near condition over columns, in bytes; `start` counts characters from 0."""
    at = F.octet_length(F.substring(text, F.lit(1), start)).cast("int")
    begin = F.greatest(at - near.before, F.lit(0))
    around = F.substring(F.encode(text, "UTF-8"), begin + 1, at + near.after - begin)
    hit = F.contains(around, F.lit(near.words[0].encode()))
    for w in near.words[1:]:
        hit = hit | F.contains(around, F.lit(w.encode()))
    return hit if near.wanted else ~hit


def folders_column(cond: Folders, path: Column) -> Column:
    """A Folders condition over columns."""
    parts = F.split(F.lower(path), "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    hit = F.exists(dirs, lambda d: d.isin(*cond.named) if cond.named else F.lit(False))
    if cond.holding:
        hit = hit | F.exists(dirs, lambda d: d.rlike("|".join(map(re.escape, cond.holding))))
    return ~hit
