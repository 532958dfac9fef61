"""Listings, user rules, archives, decoding, streams and roll-ups."""

import base64
import gzip
import io
import json
import os
import tarfile
import zipfile
import zlib

from pyspark.sql import functions as F

from siltscan.operators import corpus, decode, names, reports, rollup, scan
from siltscan.sources import archives, files, selection, yaml_rules
from siltscan.streaming import scan_stream


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def tarred(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_archives_nest_order_and_budgets():
    inner = zipped([("x.php", b"<?php")])
    outer = zipped([("readme.bin", b"b"), ("src/a.js", b"j"), ("uploads/a.php", b"<?php"), ("in.zip", inner), ("deep.zip", zipped([("in.zip", inner)]))])
    rows = list(archives.explode("a.zip", outer))
    assert [r[1] for r in rows if r[0] == "a.zip"][:2] == ["uploads/a.php", "src/a.js"]
    assert ("a.zip!in.zip", "x.php") in {r[:2] for r in rows}
    assert [r for r in rows if r[5] == "depth"]
    assert [r[5] for r in archives.explode("b.zip", zipped([("big.php", b"\0" * (archives.MEMBER + 1))]))] == ["size"]
    assert [r[1] for r in archives.explode("t.tar", tarred([("m.php", b"1")]))] == ["m.php"]
    assert [r[1] for r in archives.explode("t.tgz", tarred([("m.php", b"1")], "w:gz"))] == ["m.php"]
    assert [(r[1], r[4]) for r in archives.explode("/x/page.php.gz", gzip.compress(b"<?php"))] == [("page.php", b"<?php")]
    assert list(archives.explode("plain.txt", b"hello")) == []
    assert [r[5] for r in archives.explode("bad.zip", b"PK\x03\x04" + b"\0" * 40)] == ["unreadable"]


def test_listing_walk_and_scan(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.php").write_text("<?php eval($_POST['x']);")
    (tmp_path / "a" / "b" / "y.txt").write_text("plain")
    (tmp_path / "big.php").write_text("z" * 2000)
    listing, content = files.scan_input(spark, str(tmp_path), include=("*.php",), cap=1000)
    assert {(r.path.rsplit("/", 1)[-1], r.skip_reason) for r in listing.collect()} == {("x.php", None), ("y.txt", "not_included"), ("big.php", "size")}
    found = scan.findings(content, "path", "content")
    assert [r.rule_code for r in found.collect()] == ["RCE004"]
    totals = rollup.exit_code(rollup.summary(listing, found)).first()
    assert (totals.files_seen, totals.total_matches, totals.exit_code) == (3, 1, 1)
    os.symlink(tmp_path / "a", tmp_path / "loop")
    assert [k for _, _, k in files.walk(str(tmp_path))].count("link_not_followed") == 1
    assert {r.kind for r in files.list_tree(spark, [str(tmp_path), str(tmp_path / "none")]).collect()} == {"file", "link_not_followed", "root_missing"}


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.php").write_text("<?php eval($_POST['x']);" * i)
    q = scan_stream.scan_stream(scan_stream.read_folder(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("rule_code = 'RCE004'").count() == 3


def test_yaml_rules_default_drop_and_dedupe(spark):
    rules = yaml_rules.load_rules("rules:\n - {name: a, severity: odd, patterns: [{type: regex, value: 'x.'}, {type: string, value: XY, flags: i}]}\n - {name: b, patterns: [{type: hex, value: '00'}]}\n - {name: c, patterns: [{type: regex, value: '('}]}\n")
    assert [(r.name, r.severity) for r in rules] == [("a", "medium")]
    df = spark.createDataFrame([("p", "xy xy\nx\nXy"), ("q", None)], "path string, text string")
    assert [(r.line, r.col) for r in yaml_rules.run_rules(df, rules).collect()] == [(1, 1), (3, 1)]
    assert list(yaml_rules.spans("goto a;" * 9, yaml_rules.Pattern("heuristic", "goto_obfuscation"))) == []
    assert len(list(yaml_rules.spans("'" + "A" * 120 + "'", yaml_rules.Pattern("heuristic", "long_encoded_strings")))) == 1


def test_decoding():
    inner = base64.b64encode(b"echo 'hello there, this is text';").decode()
    packed = base64.b64encode(zlib.compress(f'eval("{inner}");'.encode())[2:-4]).decode()
    assert [(d, m) for d, m, _ in decode.layers(f"eval(gzinflate(base64_decode('{packed}')))")] == [(1, "base64"), (2, "base64")]
    assert list(decode.layers("'" + base64.b64encode(bytes(range(128, 200))).decode() + "'")) == []


def test_selection_literals_and_names(spark):
    df = spark.createDataFrame([("25MB", "7d"), ("", ""), ("3x", "5"), ("2 kb", "1H")], "s string, d string")
    got = df.select(selection.parse_size(F.col("s")), selection.parse_duration(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(25 << 20, 604800), (0, 0), (3, 5), (2048, 3600)]
    hostile = [("$(x)", ["FN001"]), ("a;b", ["FN002"]), ("a\nb", ["FN003"]), ("-x", ["FN004"]), ("..%2Fx", ["FN005"]), ("a%00", ["FN006"]), ("..", ["FN007"]), ("report (1).pdf", []), ("price $5.txt", [])]
    rows = spark.createDataFrame([("/d/" + n, c) for n, c in hostile], "p string, c array<string>").select(names.name_rules(F.col("p")).alias("got"), "c").collect()
    assert all(r.got == r.c for r in rows), rows


def test_masking():
    text = "mail john.doe1@example.com, again john.doe1@example.com or http://host-9.example.org/x"
    out = corpus.mask_text(text)
    assert len(out) == len(text) and out == corpus.mask_text(text) and "john.doe1" not in out and "host-9.example" not in out
    a, b = out.split(", again ")
    assert a.removeprefix("mail ") == b.split(" or ")[0]


def test_reports_keep_rows_without_matches(spark):
    listing = spark.createDataFrame([("a", None), ("b", "size"), ("c", None)], "path string, skip_reason string")
    found = scan.findings(spark.createDataFrame([("a", "eval($_POST['x']);")], "path string, text string"), use=("RCE004",))
    verdicts = rollup.file_verdicts(listing, found)
    rows = reports.csv_rows(verdicts, found, rollup.quarantine_plan(verdicts, "/q")).collect()
    assert tuple(rows[0].asDict()) == reports.CSV and {(r.file, r.rule, r.skipped) for r in rows} == {("a", "RCE004", False), ("b", None, True)}
    assert "RCE004" in reports.json_records(verdicts, found).where("path = 'a'").first().record
    assert [r.line for r in reports.text_lines(verdicts, found).collect()] == ["[!] a C:1"]


def test_quarantine_targets_never_meet(spark):
    v = spark.createDataFrame([("/x", True, False), ("x", True, False), ("y", False, False)], "path string, hostile_content boolean, hostile_name boolean")
    assert {r.path: r.target for r in rollup.quarantine_plan(v, "/q").collect()} == {"/x": "/q/x", "x": "/q/x.1"}


def test_json_document(spark):
    """The lines are one JSON document: records by path, the counts, and bytes only of paths that aren't shown as they are."""
    listing = spark.createDataFrame([("a", None), ("b\x01\u0085", "size"), ("c", None), ("d", None)], "path string, skip_reason string")
    found = scan.findings(spark.createDataFrame([("a", "eval($_POST['x']);"), ("d", "eval($_POST['y']);")], "path string, text string"), use=("RCE004",))
    verdicts = rollup.file_verdicts(listing, found)
    plan = rollup.quarantine_plan(verdicts, "/q")
    members = spark.createDataFrame([("z", "m", 5, None, False, False), ("z", "n", 7, "ratio", False, True)], "container string, member string, size long, skip_reason string, unreadable boolean, truncated boolean")
    records = reports.json_records(verdicts, found, plan)
    lines = [r.line for r in reports.json_document(records, reports.json_summary(verdicts, plan, members, {"linksNotFollowed": 3}, 4, ("/gone",))).collect()]
    doc = json.loads("\n".join(lines))
    assert [f["path"] for f in doc["files"]] == ["a", "b\\x01\\xc2\\x85", "d"]
    a, b, _ = doc["files"]
    assert (a["quarantinePath"], a["quarantined"], a["skipped"]) == ("/q/a", True, False) and not {"skipReason", "pathBytesHex"} & set(a)
    assert set(a["matches"][0]) == {"rule", "severity", "category", "line", "column"}
    assert b == {"path": "b\\x01\\xc2\\x85", "pathBytesHex": "6201c285", "skipped": True, "skipReason": "size", "quarantined": False, "matches": []}
    assert (doc["totalFilesScanned"], doc["filesWithMatches"], doc["filesSkipped"], doc["filesQuarantined"]) == (3, 2, {"total": 1, "size": 1, "excluded": 0, "unreadable": 0}, 2)
    assert doc["archives"]["stoppedEarly"] == 1 and doc["archives"]["membersSkipped"]["ratio"] == 1 and doc["rootsMissing"] == ["/gone"] and doc["linksNotFollowed"] == 3
    none = reports.json_document(records.limit(0), reports.json_summary(verdicts.limit(0), members=members.limit(0)))
    empty = json.loads("\n".join(r.line for r in none.collect()))
    assert empty["files"] == [] and empty["totalFilesScanned"] == 0 and "archives" not in empty
