"""Rules, dialects, filters, analyzers and folding."""

import duckdb
import pytest

from siltscan.functions.dialect import COMMENT_GAP, glob_to_regex, to_java, to_python
from siltscan.functions.planted import samples
from siltscan.functions.safetext import sanitize, truncate
from siltscan.functions.signatures import RULES
from siltscan.operators import analyzers, context, folding, htaccess, scan

PATTERNS = [(c, i, *p) for c, _, _, ps in RULES for i, p in enumerate(ps)]


def test_every_expression_compiles_and_has_an_example():
    assert len(RULES) == 140 and {(c, i) for c, i, _ in samples()} == {(c, i) for c, i, *_ in PATTERNS}
    held = scan.plan(scan.selected())
    assert all(code in {m[0] for m in held.matches(text)} for code, _, text in samples())


def test_gates_are_sound():
    text = {(c, i): t.lower() for c, i, t in samples()}
    for code, i, _, _, gates in PATTERNS:
        assert all(any(x in text[code, i] for x in g.split("|")) for g in gates), code


CASES = ["\x0b", "x\n", "émail (", "a\rb", "mail(", " eval /* x */ (", "[", "]", "$_GET", "a\x0b b"]


@pytest.mark.parametrize("pattern", [r"\s+", r"a\sb", r"\bmail", r"[^]x]", r"x$", r"[\s\d]+", r"(?i)EVAL" + COMMENT_GAP + r"\("])
def test_dialect_agrees_with_re2(pattern):
    own = to_python(pattern)
    for text in CASES + [p + "x " for p in CASES]:
        told = duckdb.execute("SELECT regexp_matches(?, ?, 's')", [text, pattern]).fetchone()[0]
        assert bool(own.search(text)) == told, (pattern, text)


def test_java_agrees_and_survives_long_comments(spark):
    from pyspark.sql import functions as F

    gap = "eval" + COMMENT_GAP + r"\("
    df = spark.createDataFrame([(t,) for t in ["eval/*" + "x*" * 50_000 + "*/(", "eval \x0b(", "eval\n("]], "t string")
    assert [r[0] for r in df.select(F.col("t").rlike(to_java(gap))).collect()] == [True, False, True]


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.php", "a.php", "a/b.php"), ("[[:digit:]]x", "1x", "ax"), ("[!a]", "b", "a"), ("a\\*", "a*", "ab"), ("[ab", "[ab", "a"), ("?", "x", "/")])
def test_globs(glob, yes, no):
    import re

    assert re.search(glob_to_regex(glob), yes) and not re.search(glob_to_regex(glob), no)


def finding(path, text, matched):
    return context.Finding(path, text, text.index(matched), matched)


@pytest.mark.parametrize(("code", "path", "text", "matched", "keep"), [
    ("RCE009", "a.php", "x", "x", False),
    ("RCE004", "a.json", '{"k": "eval($_GET[1])"}', "eval(", False),
    ("RCE004", "a.php", '{"k": "eval($_GET[1])"}', "eval(", True),
    ("BD004", "a.php", "f('wp-config.php'); mail($x)", "f(", True),
    ("BD004", "a.php", "f('wp-config.php');", "f(", False),
    ("DRP001", "vendor/a.php", "get('http://x'); eval($y)", "get(", True),
    ("DRP001", "Vendor/a.php", "get('http://x');", "get(", False),
    ("DRP001", "a/vendor", "get('http://x');", "get(", True),
    ("OBF002", "a.php", "chr(1).chr(2).chr(3)", "chr(1).chr(2).chr(3)", False),
    ("OBF002", "a.php", "chr(3).chr(2).chr(9)", "chr(3).chr(2).chr(9)", True),
    ("OBF005", "a.php", "strrev('la'.'ve')", "strrev('la'.'ve')", True),
    ("OBF005", "a.php", "strrev('zz'.'ve')", "strrev('zz'.'ve')", False),
    ("DEFC001", "a.html", "Hacked by Someone", "Hacked by Someone", False),
    ("DEFC001", "a.html", "Hacked by zed", "Hacked by zed", True),
    ("SEO008", "dir/.x", "y", "y", True),
    ("BD013", "a/tests/k.pem", "-----BEGIN", "-----BEGIN", False),
    ("BD019", "w/.htaccess", "AddHandler application/x-httpd-php .jpg", "AddHandler", True),
    ("BD019", "w/.htaccess", "AddHandler application/x-httpd-php .php5", "AddHandler", False),
    ("BD020", "w/.htaccess", "AddHandler application/x-httpd-php .html", "AddHandler", True),
])
def test_context_filters(code, path, text, matched, keep):
    assert context.kept(code, finding(path, text, matched)) is keep


def test_access_files():
    block = '<FilesMatch "\\.jpg$">\nSetHandler application/x-httpd-php\n</FilesMatch>'
    assert htaccess.executed_class(block, block.index("SetHandler")) == "data"
    assert htaccess.executed_class("AddHandler cgi-script .jpg", 0) is None
    assert htaccess.executed_class("AddHandler cgi-script .jpg\nOptions +ExecCGI\n", 0) == "data"


@pytest.mark.parametrize(("code", "hit", "miss"), [
    ("OBF041", "PNG<?php", "\x89PNG"),
    ("OBF041", "GIF<?", "GIF89a"),
    ("OBF042", "'" + analyzers.STANDARD[::-1] + "'", "'" + analyzers.STANDARD + "'"),
    ("OBF037", "\\x41\\101" * 4, "\\x41" * 12),
    ("OBF029", '$a.="QUJD";\n' * 20, '$a.="QUJD";\n' * 19),
    ("OBF036", "<?php " + "x" * 60 + "\x01\x02\x03\x04\x05\x06\x07\x08" * 2, "<?php " + "x" * 90),
    ("PHI009", "$_POST['a']; mail($t); 'a@b.com'", "$_POST['a']; mail($t);"),
    ("WS011", "class PHPMailer {} $password = 'secret1';", "class PHPMailer {} $password = 'a';"),
    ("DEFC007", "document.onkeydown = f; function f() { alert(1) }", "document.onkeydown = f; function g() { alert(1) }"),
    ("WS010", "if (!isset($_GET['k'])) { header('HTTP/1.0 404 Not Found'); die; }", "if (!isset($x)) { header('HTTP/1.0 404 Not Found'); die; }"),
    ("WS010", "if (!isset($_GET['k'])) header('HTTP/1.0 404'); exit;", "if (isset($_GET['k'])) header('HTTP/1.0 404'); exit;"),
    ("RCE015", "file_put_contents($f, $x); include $f; unlink($f);", "file_put_contents($f, $x); include $f; unlink($g);"),
    ("RCE015", "file_put_contents($f, $x); require_once($f); unlink( $f );", "file_put_contents($f, $x); include $f;" + " " * 500 + "unlink($f);"),
    ("OBF038", "/*q1-Z7;x#@9*/" * 10, "/* plain words */" * 20),
    ("OBF039", "$p = strpos($k, $s[$i]); $o .= $t[$p]; $k = " + ".".join(["'ab'"] * 6) + ";", "$p = strpos($k, $s[$i]); $o .= $t[$p];"),
    ("OBF040", "$u = 'ht' . 'tp://x.y';", "$u = 'http' . '://x.y';"),
    ("SEO008", "HTTP_USER_AGENT googlebot bingbot slurp file_get_contents('http://x'); echo", "HTTP_USER_AGENT googlebot bingbot file_get_contents('http://x'); echo"),
    ("OBF025", "$a = 'ev' . 'al';", "$a = 'ev' . 'en';"),
    ("OBF024", "$a = 'ev'.'a'.'l'; $a($x);", "$a = 'eval';"),
])
def test_analyzers(code, hit, miss):
    assert code in {c for c, _, _ in analyzers.analyze(hit)} and code not in {c for c, _, _ in analyzers.analyze(miss)}


def test_folding():
    text = "$a = \"ev\".\"al\"; $b = strrev('metsys'); $c = 'ba'; $c .= 'se64'; $c .= '_decode'; $d = str_rot13('flfgrz'); $e = unknown('x') . 'y';"
    assert [(n, v.text) for _, n, v in folding.Folder(text).assembled()] == [("a", "eval"), ("b", "system"), ("c", "base64_decode"), ("d", "system")]
    assert folding.dynamically_called("$a($x)", "a") and not folding.dynamically_called("new $a($x)", "a")


@pytest.mark.parametrize(("code", "value"), [
    ('$i = implode("", array("sy","st","em"));', "system"), ('$j = join("", ["ev", "al",]);', "eval"), ('$k = implode(array("as", "sert"), "");', "assert"), ('$l = implode(array("e", "xec"));', "exec"),
    ('$m = implode("", $x);', None), ('$n = "a" . array("b", "c");', None), ('$o = strrev(array("a", "b"));', None), ('$p = "pass" . $q("thru");', None), ('$r = implode("", array(array("a"), "b"));', None),
])
def test_array_folding(code, value):
    assert [v.text for _, _, v in folding.Folder(code).assembled()] == ([value] if value else [])


def test_windows_count_bytes():
    """A signal within so many characters but not bytes is out of reach; raw texts have one character per byte."""
    near = context.CONDITIONS["BD004"][0]
    for filler, kept in (("é" * 150, True), ("é" * 250, False), ("語" * 120, True), ("語" * 140, False), ("a" * 370, True), ("a" * 400, False)):
        text = "é" * 90 + "file_get_contents($f)" + filler + "mail($x)"
        assert near(context.Finding("a.php", text, 90, "")) == kept
        raw = text.encode().decode("latin-1")
        assert near(context.Finding("a.php", raw, 180, "", raw=True)) == kept
    before = context.CONDITIONS["BD008"][0]
    for filler, kept in (("é" * 190, True), ("é" * 200, False)):
        text = "AddType " + filler + "x"
        assert before(context.Finding("a.php", text, len(text) - 1, "")) == kept


def test_bytes_ahead():
    text = "aé語𝔘b"
    assert scan.bytes_ahead(text).tolist() == [len(text[:i].encode()) for i in range(len(text) + 1)]


def test_findings_positions_and_metamorphic_names(spark):
    text = "é\n<?php eval($_POST['x']);\n"
    rows = scan.findings(spark.createDataFrame([("a.php", text), ("b.txt", text), ("c", None), ("d", "")], "path string, text string"), use=("RCE004",)).collect()
    assert {(r.path, r.offset, r.line, r.col) for r in rows} == {(p, 9, 2, 7) for p in ("a.php", "b.txt")}
    raw = scan.findings(spark.createDataFrame([("a.php", bytearray(text.encode() + b"\xff"))], "path string, text binary"), use=("RCE004",)).collect()
    assert [(r.offset, r.line, r.col) for r in raw] == [(9, 2, 7)]


@pytest.mark.parametrize(("where", "low"), [("eval($_POST[1]); // NOSONAR", True), ("# noqa\neval($_POST[1]);", True), ("# noqa\n\neval($_POST[1]);", False)])
def test_annotations(where, low):
    p = scan.plan(frozenset({"RCE004"}))
    assert [r[4] == "low" for r in scan.scan_text(p, "a.php", where, trust=True)] == [low]
    assert [r[4] for r in scan.scan_text(p, "a.php", where)] == ["critical"]


def test_safe_text():
    assert sanitize(b"a\x00\x7f\xff\xc2\x85") == "a\\x00\\x7f\\xff\\xc2\\x85" and truncate("aéb", 2) == "a"
