"""Registered queries over the driver's tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan.functions.planted import planted_columns, planted_sql
from siltscan.functions.signatures import RULES
from siltscan.operators import analyzers, context, corpus, decode, folding, gates, names, reports, rollup, scan
from siltscan.sources import archives, selection, yaml_rules

TEXTS = ("documents", "pages", "conversations")
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
EXPRESSIONS = tuple(code for code, _, _, p in RULES if p)
PLANTED = planted_sql()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in fewer files than there are cores are dealt out first, because one row group is one task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and len(df.inputFiles()) < cores else df


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = planted_columns(True)
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{c['path']} AS path", f"{c['text']} AS text", "source", "lang", "n_chars")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits_sql() -> str:
    """(path, rule_code, severity, n): matches of each rule's expressions, counted by RE2."""
    parts = []
    for code, _, severity, patterns in RULES:
        if patterns:
            total = " + ".join(f"len(regexp_extract_all(text, {_q(p)}, 0, '{'si' if ci else 's'}'))" for p, ci, _ in patterns)
            parts.append(f"SELECT path, lang, '{code}' AS rule_code, '{severity}' AS severity, {total} AS n FROM t")
    return f"WITH t AS ({PLANTED}), h AS ({' UNION ALL '.join(parts)}), f AS (SELECT * FROM h WHERE n > 0)"


HITS = _hits_sql()


def _found(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return scan.findings(planted(spark, sf_dir), use=EXPRESSIONS, filters=False, **options)


@query(f"{HITS} SELECT rule_code, severity, CAST(sum(n) AS BIGINT) AS hits, count(DISTINCT path) AS files FROM f GROUP BY rule_code, severity")
def rule_hits_by_code(spark, sf_dir):
    return rollup.rule_counts(_found(spark, sf_dir))


@query(f"{HITS} SELECT coalesce(severity, 'all') AS severity, CAST(sum(n) AS BIGINT) AS hits, count(DISTINCT path) AS files FROM f GROUP BY ROLLUP (severity)")
def rule_hits_by_severity(spark, sf_dir):
    return rollup.severity_counts(_found(spark, sf_dir))


@query(f"{HITS} SELECT path, regexp_extract(rule_code, '^[A-Z]+') AS category, CAST(sum(n) AS BIGINT) AS n, min(rule_code) AS first_rule FROM f GROUP BY 1, 2")
def path_category_groups(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("path", "category").agg(F.count(F.lit(1)).alias("n"), F.min("rule_code").alias("first_rule"))


@query(f"{HITS}, k AS (SELECT path, string_agg(rule_code, '+' ORDER BY rule_code) AS ruleset FROM f GROUP BY path) SELECT ruleset, count(*) AS n FROM k GROUP BY ruleset")
def ruleset_clusters(spark, sf_dir):
    return corpus.ruleset_clusters(_found(spark, sf_dir))


@query(f"{HITS} SELECT lang, severity, CAST(sum(n) AS BIGINT) AS hits, count(DISTINCT path) AS files FROM f GROUP BY lang, severity")
def findings_by_lang_join(spark, sf_dir):
    files = planted(spark, sf_dir)
    found = scan.findings(files, use=EXPRESSIONS, filters=False)
    return found.join(files.select("path", "lang"), "path").groupBy("lang", "severity").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("path").alias("files"))


SINGLE = tuple(code for code, _, _, p in RULES if len(p) == 1)


def _first_sql() -> str:
    parts = [f"SELECT path, '{code}' AS rule_code, text, regexp_extract(text, {_q(p[0][0])}, 0, '{'si' if p[0][1] else 's'}') AS m FROM t" for code, _, _, p in RULES if len(p) == 1]
    return (
        f"WITH t AS ({PLANTED}), m AS ({' UNION ALL '.join(parts)}), h AS (SELECT path, rule_code, left(text, CAST(strpos(text, m) AS BIGINT) - 1) AS head FROM m WHERE m <> '') "
        "SELECT path, rule_code, CAST(strlen(head) AS BIGINT) AS offset, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS BIGINT) AS line FROM h"
    )


@query(_first_sql())
def first_finding_places(spark, sf_dir):
    found = scan.findings(planted(spark, sf_dir), use=SINGLE, filters=False)
    return found.groupBy("path", "rule_code").agg(F.min("offset").alias("offset"), F.min("line").alias("line"))


FLAGS = ("WS001", "BD006", "EXP001", "RCE001", "RCE004", "RCE008", "DRP005", "PL005", "SEO006", "DEFC001", "OBF006", "PHI008")


def _flags_sql() -> str:
    pats = {code: p for code, _, _, p in RULES}
    cols = ", ".join(f"CAST(count(*) FILTER (WHERE {' OR '.join(f'regexp_matches(text, {_q(p)}, {_q("si" if ci else "s")})' for p, ci, _ in pats[c])}) AS BIGINT) AS {c.lower()}" for c in FLAGS)
    return f"WITH t AS ({PLANTED}) SELECT count(*) AS files, {cols} FROM t"


@query(_flags_sql())
def gated_native_flags(spark, sf_dir):
    return planted(spark, sf_dir).agg(F.count(F.lit(1)).alias("files"), *(F.count_if(scan.rule_flag(F.col("text"), c)).alias(c.lower()) for c in FLAGS))


@query()
def findings_filtered(spark, sf_dir):
    """All rules, analyzers and context filters."""
    return scan.findings(planted(spark, sf_dir)).drop("context", "matched")


@query()
def findings_first_per_line(spark, sf_dir):
    return rollup.first_per_line(scan.findings(planted(spark, sf_dir))).select("path", "rule_code", "line", "col", "severity")


@query()
def check_groups(spark, sf_dir):
    return rollup.check_groups(scan.findings(planted(spark, sf_dir)))


INCLUDE, EXCLUDE, CAP = ("*.php", "*.js", "*.ht*", "!ext"), ("**/srv/src1/*/*", "*7.php"), 6000
VERDICT = (
    "CASE WHEN regexp_matches(path, '^[^/]*/srv/src1/[^/]*/[^/]*$') OR regexp_matches(name, '^[^/]*/srv/src1/[^/]*/[^/]*$') OR regexp_matches(name, '^[^/]*7\\.php$') THEN 'excluded' "
    "WHEN regexp_matches(name, '^[^/]*\\.(php|js)$') OR regexp_matches(name, '^[^/]*\\.ht[^/]*$') OR NOT regexp_matches(name, '^.+\\.') THEN 'accepted' ELSE 'not_included' END"
)
SELECTED = f"WITH t AS ({PLANTED}), n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM t), v AS (SELECT path, n_chars, {VERDICT} AS verdict FROM n), s AS (SELECT *, CASE WHEN verdict <> 'accepted' THEN verdict WHEN n_chars > {CAP} THEN 'size' END AS skip_reason FROM v)"


def _selected(spark, sf_dir):
    listing = planted(spark, sf_dir).select("path", F.col("n_chars").alias("length"), "text")
    return selection.select_files(listing, INCLUDE, EXCLUDE, CAP)


@query(f"{SELECTED} SELECT path, verdict, skip_reason FROM s")
def filter_verdicts(spark, sf_dir):
    return _selected(spark, sf_dir).select("path", "verdict", "skip_reason")


@query(f"{SELECTED} SELECT skip_reason, count(*) AS files FROM s WHERE skip_reason IS NOT NULL GROUP BY 1")
def skip_tally(spark, sf_dir):
    return rollup.skip_tally(_selected(spark, sf_dir))


@query(
    f"{SELECTED}, {HITS.removeprefix('WITH ').split('), h AS (', 1)[0].replace('t AS (', 't2 AS (')}), h AS ({HITS.split('), h AS (', 1)[1].replace(' FROM t UNION', ' FROM t2 UNION').replace(' FROM t)', ' FROM t2)')}, "
    "k AS (SELECT f.* FROM f JOIN s USING (path) WHERE s.skip_reason IS NULL), "
    "a AS (SELECT count(*) AS files_seen, count(*) FILTER (WHERE skip_reason IS NULL) AS files_scanned, count(*) FILTER (WHERE skip_reason IS NOT NULL) AS files_skipped FROM s), "
    "b AS (SELECT CAST(sum(n) AS BIGINT) AS total_matches, count(DISTINCT path) AS files_with_matches, "
    + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE severity = '{x}'), 0) AS BIGINT) AS {x}" for x in ("low", "medium", "high", "critical"))
    + " FROM k) SELECT *, CAST(CASE WHEN files_skipped > 0 THEN 1 WHEN total_matches > 0 THEN 2 ELSE 0 END AS INT) AS exit_code FROM a, b"
)
def scan_summary(spark, sf_dir):
    files = _selected(spark, sf_dir)
    found = scan.findings(files.where("skip_reason is null"), use=EXPRESSIONS, filters=False)
    return rollup.exit_code(rollup.summary(files, found))


KEPT_HITS = (
    f"{SELECTED}, {HITS.removeprefix('WITH ').split('), h AS (', 1)[0].replace('t AS (', 't2 AS (')}), h AS ({HITS.split('), h AS (', 1)[1].replace(' FROM t UNION', ' FROM t2 UNION').replace(' FROM t)', ' FROM t2)')}, "
    "k AS (SELECT f.* FROM f JOIN s USING (path) WHERE s.skip_reason IS NULL), c AS (SELECT path, CAST(sum(n) AS BIGINT) AS matches FROM k GROUP BY 1), "
    "v2 AS (SELECT s.path, s.skip_reason, coalesce(matches, 0) AS matches FROM s LEFT JOIN c USING (path))"
)


@query(f"{KEPT_HITS} SELECT path, skip_reason, matches, matches > 0 AS hostile_content, FALSE AS hostile_name, skip_reason IS NULL AS examined_fully, matches > 0 OR skip_reason IS NOT NULL AS worth_reporting FROM v2")
def expression_file_verdicts(spark, sf_dir):
    """file_verdicts over the rules that are expressions, without context filters."""
    files = _selected(spark, sf_dir)
    return rollup.file_verdicts(files.select("path", "skip_reason"), scan.findings(files.where("skip_reason is null"), use=EXPRESSIONS, filters=False))


@query(f"{KEPT_HITS}, q AS (SELECT path, '/quarantine/' || ltrim(path, '/') AS target FROM v2 WHERE matches > 0), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY path) AS n FROM q) SELECT path, CASE WHEN n = 1 THEN target ELSE target || '.' || (n - 1) END AS target FROM r")
def expression_quarantine_plan(spark, sf_dir):
    files = _selected(spark, sf_dir)
    found = scan.findings(files.where("skip_reason is null"), use=EXPRESSIONS, filters=False)
    return rollup.quarantine_plan(rollup.file_verdicts(files.select("path", "skip_reason"), found), "/quarantine")


@query(
    f"{KEPT_HITS} SELECT '{{\"interrupted\":false,\"totalFilesScanned\":' || count(*) FILTER (WHERE skip_reason IS NULL) || ',\"totalDirectoriesScanned\":0,\"filesWithMatches\":' || count(*) FILTER (WHERE matches > 0) "
    "|| ',\"filesWithHostileNames\":0,\"filesSkippedSize\":' || count(*) FILTER (WHERE skip_reason = 'size') || ',\"filesSkipped\":{\"total\":' || count(skip_reason) || ',\"size\":' || count(*) FILTER (WHERE skip_reason = 'size') "
    "|| ',\"excluded\":' || count(*) FILTER (WHERE skip_reason = 'excluded') || ',\"unreadable\":' || count(*) FILTER (WHERE skip_reason = 'unreadable') || '},\"directoriesUnreadable\":0,\"entriesUnreadable\":0,"
    "\"directoriesCycleSkipped\":0,\"linksNotFollowed\":0,\"filesQuarantined\":' || count(*) FILTER (WHERE matches > 0) || ',\"filesQuarantineFailed\":0,\"rootsMissing\":[],\"durationMs\":0}' AS summary FROM v2"
)
def expression_report_summary(spark, sf_dir):
    files = _selected(spark, sf_dir)
    verdicts = rollup.file_verdicts(files.select("path", "skip_reason"), scan.findings(files.where("skip_reason is null"), use=EXPRESSIONS, filters=False))
    return reports.json_summary(verdicts, rollup.quarantine_plan(verdicts, "/quarantine"))


#: Rules with one expression of fixed words, so that each match's text is found again by its words.
LONE = tuple(code for code in ("WS001", "WS004", "RCE001", "RCE004", "RCE008", "DRP005", "BD006", "EXP001", "PL005") if code in SINGLE)


def _places_sql() -> str:
    """(path, category, rule_code, line, col): places of the matches of rules with one expression whose every match is told by its first one's text."""
    parts = [f"SELECT path, '{code}' AS rule_code, text, unnest(list_distinct(regexp_extract_all(text, {_q(p[0][0])}, 0, '{'si' if p[0][1] else 's'}'))) AS m FROM t" for code, _, _, p in RULES if code in LONE]
    return (
        f"WITH t AS ({PLANTED}), m AS ({' UNION ALL '.join(parts)}), l AS (SELECT path, rule_code, m, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM m WHERE NOT contains(m, chr(10))), "
        "h AS (SELECT path, rule_code, line, strlen(left(body, CAST(strpos(body, m) AS BIGINT) - 1)) + 1 AS col FROM l WHERE contains(body, m))"
    )


@query(f"{_places_sql()} SELECT path, rule_code, CAST(line AS BIGINT) AS line, CAST(min(col) AS BIGINT) AS col FROM h GROUP BY 1, 2, 3")
def expression_first_per_line(spark, sf_dir):
    """findings_first_per_line over some rules, without context filters."""
    return rollup.first_per_line(scan.findings(planted(spark, sf_dir), use=LONE, filters=False)).select("path", "rule_code", "line", "col")


#: Access files, and what the directive in them makes run: BD019 for data, BD020 for documents, nothing for scripts.
ACCESS = (
    ('SetHandler application/x-httpd-php\n', "BD019"),
    ('ForceType application/x-httpd-php\n', "BD019"),
    ('<FilesMatch "\\.php$">\n  Require all granted\n</FilesMatch>\nSetHandler application/x-httpd-php\n', "BD019"),
    ('<FilesMatch "\\.(jpe?g|png)$">\n  SetHandler application/x-httpd-php\n</FilesMatch>\n', "BD019"),
    ('<Files "avatar.gif">\n  ForceType application/x-httpd-php\n</Files>\n', "BD019"),
    ('<Files *.mdb>\n  SetHandler application/x-httpd-php\n</Files>\n', "BD019"),
    ('<Files "index.php">\n  SetHandler application/x-httpd-php\n</Files>\n', None),
    ('<FilesMatch "^index\\.php$">\n  SetHandler application/x-httpd-php\n</FilesMatch>\n', None),
    ('<FilesMatch "^page\\.html$">\n  SetHandler application/x-httpd-php\n</FilesMatch>\n', "BD020"),
    ('<FilesMatch "\\.(html|alfa)$">\n  SetHandler application/x-httpd-php\n</FilesMatch>\n', "BD019"),
    ('<FilesMatch "^(index\\.php|avatar_[0-9]+\\.jpg)$">\n  SetHandler application/x-httpd-php\n</FilesMatch>\n', "BD019"),
    ('<FilesMatch "(?<=avatar)\\.php$">\n  SetHandler application/x-httpd-php\n</FilesMatch>\n', "BD019"),
    ('AddType application/x-httpd-php .php .phtml\n', None),
    ('AddType application/x-httpd-php .html\n', "BD020"),
    ('AddHandler application/x-httpd-php .jpg\n', "BD019"),
)


@query(f"SELECT concat('/srv/', source, '/d', doc_id, '/.htaccess') AS path, CASE doc_id % {len(ACCESS)} " + " ".join(f"WHEN {i} THEN '{code}'" for i, (_, code) in enumerate(ACCESS) if code) + " END AS rule_code FROM documents")
def access_file_handlers(spark, sf_dir):
    """What directives of access files make run, one file a document."""
    body = F.element_at(F.array(*(F.lit(t) for t, _ in ACCESS)), (F.col("doc_id") % len(ACCESS)).cast("int") + 1)
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/srv/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/.htaccess")).alias("path"), body.alias("text"))
    found = scan.findings(files, use=("BD019", "BD020")).select("path", "rule_code").distinct()
    return files.select("path").join(found, "path", "left")


@query()
def file_verdicts(spark, sf_dir):
    files = _selected(spark, sf_dir)
    return rollup.file_verdicts(files.select("path", "skip_reason"), scan.findings(files.where("skip_reason is null")))


@query()
def quarantine_plan(spark, sf_dir):
    files = _selected(spark, sf_dir)
    return rollup.quarantine_plan(rollup.file_verdicts(files.select("path", "skip_reason"), scan.findings(files.where("skip_reason is null"))), "/quarantine")


@query(f"WITH t AS ({PLANTED}) SELECT path, NOT (list_contains(list_slice(string_split(lower(path), '/'), 1, -2), 'vendor') OR list_contains(list_slice(string_split(lower(path), '/'), 1, -2), 'vendor-prefixed') OR len(list_filter(list_slice(string_split(lower(path), '/'), 1, -2), lambda x: contains(x, 'revslider'))) > 0) AS kept FROM t")
def location_prior(spark, sf_dir):
    cond = context.Folders(("vendor", "vendor-prefixed"), ("revslider",))
    return planted(spark, sf_dir).select("path", context.folders_column(cond, F.col("path")).alias("kept"))


OPEN = r"file_get_contents\s*\("
FILLER = "CASE doc_id % 4 WHEN 0 THEN repeat('é', 150) WHEN 1 THEN repeat('é', 250) WHEN 2 THEN repeat('語', 130) ELSE '' END"
WINDOW = f"WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'file_get_contents($f); ' || {FILLER} || left(coalesce(text, ''), CAST(doc_id % 90 AS INT)) || ' curl_exec($c)' WHEN 1 THEN coalesce(text, '') || ' file_get_contents ($f); mail($to)' ELSE coalesce(text, '') || ' file_get_contents($f)' || coalesce(text, '') END AS text FROM documents)"


@query(
    f"{WINDOW}, m AS (SELECT doc_id, text, regexp_extract(text, '{OPEN}') AS m FROM d), p AS (SELECT doc_id, substr(hex(encode(substr(text, strpos(text, m)))), 1, 800) AS around FROM m WHERE m <> '') SELECT doc_id, "
    + f"regexp_matches(around, '^(?:..)*(?:{'|'.join(w.encode().hex().upper() for w in context.EXFILTRATION)})') AS kept FROM p"
)
def context_window_keep(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    some = F.substring(text, F.lit(1), (F.col("doc_id") % 90).cast("int"))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("file_get_contents($f); "), F.expr(FILLER), some, F.lit(" curl_exec($c)"))).when(F.col("doc_id") % 3 == 1, F.concat(text, F.lit(" file_get_contents ($f); mail($to)"))).otherwise(F.concat(text, F.lit(" file_get_contents($f)"), text))
    d = table(spark, sf_dir, "documents").select("doc_id", body.alias("text"))
    d = d.withColumn("m", F.regexp_extract("text", scan.to_java(OPEN), 0)).where("m <> ''").withColumn("at", F.expr("instr(text, m) - 1"))
    return d.select("doc_id", context.near_column(context.CONDITIONS["BD004"][0], F.col("text"), F.col("at")).alias("kept"))


NAMED = (
    "SELECT doc_id, concat('/srv/', source, '/', CASE doc_id % 12 WHEN 0 THEN '$(id).txt' WHEN 1 THEN 'a;b.php' WHEN 2 THEN concat('x', chr(10), '.log') WHEN 3 THEN '-rf' "
    "WHEN 4 THEN '..%2fetc' WHEN 5 THEN 'a%00.php' WHEN 6 THEN '..' WHEN 7 THEN 'plain.txt' WHEN 8 THEN '`x`' WHEN 9 THEN 'C:x' WHEN 10 THEN 'a|b' ELSE 'B%5C..' END) AS path FROM documents"
)
RAISED = {
    "FN001": "contains(name, '$(') OR contains(name, '`') OR contains(name, '${')", "FN002": "regexp_matches(name, '[\";|\\\\]')", "FN003": "regexp_matches(name, '[\\x00-\\x1f]')",
    "FN004": "starts_with(name, '-')", "FN005": "regexp_matches(lower(name), '(\\.\\.|%2e%2e)(%2f|%5c|／|＼|∕|⁄|⧸|À¯)|(%2f|%5c|／|＼|∕|⁄|⧸|À¯)(\\.\\.|%2e%2e)')",
    "FN006": "contains(name, '%00')", "FN007": "name = '..' OR regexp_matches(name, '^[A-Za-z]:|^\\\\')",
}


@query(f"WITH t AS ({NAMED}), n AS (SELECT path, regexp_extract(path, '[^/]*$', 0, 's') AS name FROM t) " + " UNION ALL ".join(f"SELECT path, '{c}' AS rule_code FROM n WHERE {e}" for c, e in RAISED.items()))
def filename_rules(spark, sf_dir):
    files = spark.sql(NAMED.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return names.raise_names(files)


@query("SELECT doc_id, source || '/' || lang AS path, source AS folder, 1 AS depth, '.' || lang AS ext FROM documents")
def path_functions(spark, sf_dir):
    p = F.concat_ws("/", "source", "lang")
    d = table(spark, sf_dir, "documents").withColumn("full", F.concat(p, F.lit("."), F.col("lang")))
    return d.select("doc_id", p.alias("path"), names.folder_of(F.col("full")).alias("folder"), names.depth_of(F.col("full")).alias("depth"), names.lower_extension(F.upper("full")).alias("ext"))


@query("SELECT doc_id, CAST(doc_id % 50 AS BIGINT) * CASE doc_id % 5 WHEN 0 THEN 1048576 WHEN 1 THEN 1024 WHEN 2 THEN 1073741824 ELSE 1 END AS bytes, CAST(doc_id % 50 AS BIGINT) * CASE doc_id % 5 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 ELSE 1 END AS seconds FROM documents")
def size_and_duration_literals(spark, sf_dir):
    k = F.col("doc_id") % 5
    n = (F.col("doc_id") % 50).cast("string")
    size = F.concat(n, F.when(k == 0, "MB").when(k == 1, "kb").when(k == 2, "G").otherwise("?"))
    span = F.concat(n, F.when(k == 0, "d").when(k == 1, "h").when(k == 2, "m").otherwise("s"))
    return table(spark, sf_dir, "documents").select("doc_id", selection.parse_size(size).alias("bytes"), selection.parse_duration(span).alias("seconds"))


MEMBERS = (
    "SELECT CAST(l_orderkey AS VARCHAR) || '.zip' AS container, l_linenumber AS idx, CASE l_linenumber % 4 WHEN 0 THEN 'uploads/' WHEN 1 THEN 'src/' WHEN 2 THEN 'img/' ELSE '' END || CAST(l_partkey AS VARCHAR) || "
    "CASE l_partkey % 6 WHEN 0 THEN '.php' WHEN 1 THEN '.png' WHEN 2 THEN '.html' WHEN 3 THEN '.sql' WHEN 4 THEN '.bin' ELSE '.js' END AS name, CAST(l_quantity AS BIGINT) * 1000 AS size, l_returnflag = 'R' AND l_partkey % 6 = 0 AS hostile FROM lineitem"
)


def _members(spark, sf_dir):
    return spark.sql(MEMBERS.replace("AS VARCHAR", "AS STRING").replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


@query(f"WITH m AS ({MEMBERS}) SELECT container, name, idx, hostile, bool_or(hostile) OVER w AS container_hostile, count(*) FILTER (WHERE hostile) OVER w AS hostile_members, count(*) OVER w AS members FROM m WINDOW w AS (PARTITION BY container)")
def container_verdicts(spark, sf_dir):
    return rollup.container_verdicts(_members(spark, sf_dir)).select("container", "name", "idx", "hostile", "container_hostile", "hostile_members", "members")


STATED = (
    f"WITH m AS ({MEMBERS}), s AS (SELECT container, idx, name AS member, size, CASE CAST(size / 1000 AS BIGINT) % 9 WHEN 0 THEN 'policy' WHEN 1 THEN 'excluded' WHEN 2 THEN 'size' WHEN 3 THEN 'corrupt' END AS skip_reason, "
    "container LIKE '%77.zip' AS unreadable, container LIKE '%5.zip' AS truncated FROM m)"
)
STATISTICS = (
    ", p AS (SELECT container, max(CAST(unreadable AS INT)) AS u, max(CAST(truncated AS INT)) AS t, count(*) FILTER (WHERE skip_reason IS NULL) AS scanned, coalesce(sum(size) FILTER (WHERE skip_reason IS NULL), 0) AS bytes, "
    "count(skip_reason) AS skipped, count(*) FILTER (WHERE skip_reason IN ('size', 'corrupt')) AS unexamined FROM s GROUP BY 1)"
)


def _stated(spark, sf_dir):
    return spark.sql(STATED.replace("AS VARCHAR", "AS STRING").replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM s", lineitem=table(spark, sf_dir, "lineitem"))


@query(
    f"{STATED}{STATISTICS} SELECT container, CAST(1 - u AS BIGINT) AS archives_opened, CAST(u AS BIGINT) AS archives_unreadable, CAST(t AS BIGINT) AS archives_truncated, scanned AS members_scanned, CAST(bytes AS BIGINT) AS bytes_expanded, skipped AS members_skipped, "
    "unexamined AS members_unexamined, u > 0 OR t > 0 OR unexamined > 0 AS coverage_incomplete FROM p"
)
def archive_statistics(spark, sf_dir):
    return rollup.archive_statistics(_stated(spark, sf_dir), "container")


@query(
    f"{STATED}{STATISTICS} SELECT count(*) FILTER (WHERE u = 0) AS archives_opened, CAST(sum(u) AS BIGINT) AS archives_unreadable, CAST(sum(t) AS BIGINT) AS archives_truncated, CAST(sum(scanned) AS BIGINT) AS members_scanned, CAST(sum(bytes) AS BIGINT) AS bytes_expanded, "
    "CAST(sum(skipped) AS BIGINT) AS members_skipped, CAST(sum(unexamined) AS BIGINT) AS members_unexamined, sum(u) > 0 OR sum(t) > 0 OR sum(unexamined) > 0 AS coverage_incomplete FROM p"
)
def archive_totals(spark, sf_dir):
    return rollup.archive_statistics(_stated(spark, sf_dir))


@query(
    f"{STATED}, n AS (SELECT container, skip_reason, count(*) AS n FROM s WHERE skip_reason IS NOT NULL GROUP BY 1, 2) "
    "SELECT container, CAST(sum(n) AS BIGINT) AS skipped, string_agg(n || ' ' || skip_reason, ', ' ORDER BY n DESC, skip_reason) AS phrase FROM n GROUP BY 1"
)
def archive_skip_phrases(spark, sf_dir):
    return rollup.skip_phrase(_stated(spark, sf_dir))


INDEXED = (
    f"WITH m AS ({MEMBERS}), x AS (SELECT container, idx, CASE idx % 7 WHEN 6 THEN '__MACOSX/' || name WHEN 5 THEN 'src/' WHEN 4 THEN 'wp-config.php' ELSE name END AS name FROM m), "
    "i AS (SELECT container, idx, name, name LIKE '%.php' AS php, name LIKE '%.sql' AS sql, name = 'wp-config.php' OR name LIKE 'uploads/%.sql' AS credential, CASE WHEN name LIKE 'wp-%' OR name LIKE 'uploads/%' THEN 'wordpress' WHEN name LIKE 'img/%' THEN 'joomla' END AS platform FROM x)"
)


@query(
    f"{INDEXED}, k AS (SELECT * FROM i WHERE NOT ends_with(name, '/') AND NOT starts_with(name, '__MACOSX/')), "
    "c AS (SELECT container, name, idx, row_number() OVER (PARTITION BY container ORDER BY idx, name) AS r FROM k WHERE credential), t AS (SELECT container, string_agg(name, ',' ORDER BY idx, name) AS credentials FROM c WHERE r <= 8 GROUP BY 1), "
    "p AS (SELECT container, platform FROM (SELECT container, platform, count(*) AS n FROM k WHERE platform IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY container ORDER BY n DESC, platform) = 1), "
    "g AS (SELECT container, count(*) AS entries, count(*) FILTER (WHERE php) AS php_entries, count(*) FILTER (WHERE sql) AS sql_dumps FROM k GROUP BY 1) "
    "SELECT container, entries, php_entries, sql_dumps, coalesce(credentials, '') AS credentials, platform FROM g LEFT JOIN t USING (container) LEFT JOIN p USING (container)"
)
def archive_index_summary(spark, sf_dir):
    frame = spark.sql(INDEXED.replace("AS VARCHAR", "AS STRING").replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM i", lineitem=table(spark, sf_dir, "lineitem"))
    return rollup.index_summary(frame)


CLASSED = (
    f"WITH m AS ({MEMBERS}), c AS (SELECT *, CASE WHEN name LIKE '%.php' AND (name LIKE 'uploads/%' OR name LIKE 'img/%') THEN 'hot_script' WHEN name LIKE '%.php' OR name LIKE '%.sql' OR name LIKE '%.js' THEN 'script' "
    "WHEN name LIKE '%.html' THEN 'markup' WHEN name LIKE '%.png' THEN 'media' ELSE 'other' END AS kind FROM m)"
)


@query(f"{CLASSED} SELECT kind, count(*) AS members, CAST(sum(size) AS BIGINT) AS bytes FROM c GROUP BY kind")
def member_classes(spark, sf_dir):
    return _members(spark, sf_dir).groupBy(selection.member_class(F.col("name")).alias("kind")).agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"))


@query(f"{CLASSED} SELECT coalesce(CASE WHEN name LIKE 'src/%1.js' OR regexp_extract(name, '[^/]*$') LIKE '%1.js' THEN 'excluded' WHEN kind NOT IN ('hot_script', 'script', 'markup') THEN 'policy' WHEN size > 30000 THEN 'size' END, 'examined') AS outcome, count(*) AS members FROM c GROUP BY 1")
def member_selection(spark, sf_dir):
    got = selection.member_selection(_members(spark, sf_dir), (), ("*1.js",), 30_000)
    return got.groupBy(F.coalesce("skip_reason", F.lit("examined")).alias("outcome")).agg(F.count(F.lit(1)).alias("members"))


@query(f"{CLASSED}, f AS (SELECT container, regexp_replace(name, '/?[^/]*$', '') AS folder, kind FROM c) SELECT container, folder, count(*) FILTER (WHERE kind = 'media') AS media, count(*) FILTER (WHERE kind = 'script') AS scripts FROM f GROUP BY 1, 2 HAVING count(*) FILTER (WHERE kind = 'media') > 0 AND count(*) FILTER (WHERE kind = 'script') <= count(*) FILTER (WHERE kind = 'media')")
def asset_folders(spark, sf_dir):
    m = _members(spark, sf_dir).select("container", names.folder_of(F.col("name")).alias("folder"), selection.member_class(F.col("name")).alias("kind"))
    return rollup.asset_folders(m)


@query(f"WITH m AS ({MEMBERS}), p AS (SELECT container, CASE WHEN name LIKE 'uploads/%' THEN 'wordpress' WHEN name LIKE 'img/%' THEN 'joomla' WHEN name LIKE 'src/%' THEN 'magento' END AS platform FROM m), g AS (SELECT container, platform, count(*) AS n FROM p WHERE platform IS NOT NULL GROUP BY 1, 2) SELECT container, platform, n FROM g QUALIFY row_number() OVER (PARTITION BY container ORDER BY n DESC, platform) = 1")
def container_platform(spark, sf_dir):
    p = F.when(F.col("name").startswith("uploads/"), "wordpress").when(F.col("name").startswith("img/"), "joomla").when(F.col("name").startswith("src/"), "magento")
    return rollup.container_platform(_members(spark, sf_dir).select("container", p.alias("platform"))).select("container", "platform", "n")


@query(
    f"{CLASSED}, g AS (SELECT container, count(*) FILTER (WHERE name LIKE '%.sql') AS dumps, count(*) FILTER (WHERE kind = 'hot_script') AS scripts, max(idx) < 7 AS readable FROM c GROUP BY 1) "
    "SELECT container, 'ARC001' AS rule_code FROM g WHERE dumps > 0 UNION ALL SELECT container, 'ARC002' FROM g WHERE scripts > 0 AND readable UNION ALL SELECT container, 'ARC003' FROM g WHERE NOT readable"
)
def archive_exposure(spark, sf_dir):
    m = _members(spark, sf_dir).withColumn("kind", selection.member_class(F.col("name")))
    per = m.groupBy("container").agg(F.lit(0).alias("credentials"), F.count_if(F.col("name").endswith(".sql")).alias("dumps"), F.count_if(F.col("kind") == "hot_script").alias("scripts"), (F.max("idx") < 7).alias("readable"))
    return rollup.exposure(per)


TAG_SQL = ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), {_q(p)}) THEN '{t}' END" for t, p in corpus.SENSITIVITY)
TAGS = f"SELECT doc_id, text, list_sort(list_filter([{TAG_SQL}], lambda x: x IS NOT NULL)) AS found FROM documents"


@query(f"WITH t AS ({TAGS}) SELECT CASE WHEN len(found) = 0 THEN 'clean' ELSE array_to_string(found, '+') END AS tags, count(*) AS n FROM t GROUP BY 1")
def sensitivity_tags(spark, sf_dir):
    tags = F.array_join(corpus.sensitivity_tags(F.coalesce("text", F.lit(""))), "+")
    return table(spark, sf_dir, "documents").groupBy(tags.alias("tags")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {_q(corpus.EMAIL)}))), ' ') AS evidence FROM documents WHERE regexp_matches(text, {_q(corpus.EMAIL)})")
def sensitivity_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(corpus.EMAIL))
    return d.select("doc_id", F.array_join(corpus.sensitivity_evidence(F.col("text"), "identity"), " ").alias("evidence"))


@query(
    "WITH a AS (SELECT count(*) AS examined, count(*) FILTER (WHERE contains(html, '<script')) AS r1, count(*) FILTER (WHERE contains(html, '<script') AND contains(html, 'eval(')) AS h1, "
    f"count(*) FILTER (WHERE contains(html, '<title')) AS r2, count(*) FILTER (WHERE contains(html, '<title') AND regexp_matches(html, {_q(corpus.EMAIL)})) AS h2 FROM pages), "
    "c AS (SELECT 'script_eval' AS candidate, examined, r1 AS at_risk, h1 AS hits FROM a UNION ALL SELECT 'title_email', examined, r2, h2 FROM a) "
    "SELECT *, round(CASE WHEN at_risk > 0 THEN 100.0::DOUBLE * hits / at_risk END, 6) AS rate_pct, round(CASE WHEN hits = 0 AND at_risk > 0 THEN 300.0::DOUBLE / at_risk END, 6) AS bound_pct FROM c"
)
def candidate_population(spark, sf_dir):
    h = F.col("html")
    return corpus.population(table(spark, sf_dir, "pages"), {"script_eval": (h.contains("<script"), h.contains("eval(")), "title_email": (h.contains("<title"), h.rlike(corpus.EMAIL))})


JUDGED = "SELECT source AS family, lang AS frame, doc_id AS id, toxic = 1 AS malicious, quality = 0 AS detected FROM documents JOIN labels USING (doc_id)"


def _judged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("source").alias("family"), F.col("lang").alias("frame"), F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("malicious"), (F.col("quality") == 0).alias("detected"))


METRICS = f"WITH j AS ({JUDGED}), m AS (SELECT family, count(*) AS members, count(*) FILTER (WHERE detected) AS found FROM j WHERE malicious GROUP BY family)"


@query(f"{METRICS} SELECT *, CASE WHEN found = 0 THEN 'missed' WHEN found = members THEN 'covered' ELSE 'partial' END AS state FROM m")
def family_states(spark, sf_dir):
    return corpus.detection_metrics(_judged(spark, sf_dir))


@query(f"{METRICS} SELECT count(*) AS families, CAST(sum(members) AS BIGINT) AS members, CAST(sum(found) AS BIGINT) AS found, round(avg(found / members), 6) AS macro, round(sum(found) / sum(members), 6) AS micro FROM m")
def family_macro_micro(spark, sf_dir):
    return corpus.macro_micro(corpus.detection_metrics(_judged(spark, sf_dir)))


@query(f"WITH j AS ({JUDGED}) SELECT coalesce(frame, 'all') AS frame, count(*) AS n, count(*) FILTER (WHERE malicious) AS malicious, count(*) FILTER (WHERE malicious AND detected) AS detected FROM j GROUP BY ROLLUP (frame)")
def frame_partition(spark, sf_dir):
    return corpus.frame_partition(_judged(spark, sf_dir))


RULED = "SELECT source AS family, doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN [] WHEN source < 'src2' THEN ['A', 'B' || CAST(doc_id % 3 AS VARCHAR)] ELSE ['B' || CAST(doc_id % 3 AS VARCHAR)] END AS rules FROM documents"


@query(f"WITH r AS (SELECT family, id, unnest(rules) AS rule FROM ({RULED})), d AS (SELECT family, count(DISTINCT id) AS detected FROM r GROUP BY 1), s AS (SELECT family, rule, count(DISTINCT id) AS n FROM r GROUP BY 1, 2) SELECT family, detected FROM d WHERE detected >= 3 AND family NOT IN (SELECT s.family FROM s JOIN d ON s.family = d.family AND s.n = d.detected)")
def family_suspects(spark, sf_dir):
    b = F.concat(F.lit("B"), (F.col("doc_id") % 3).cast("string"))
    rules = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).when(F.col("source") < "src2", F.array(F.lit("A"), b)).otherwise(F.array(b))
    return corpus.family_suspects(table(spark, sf_dir, "documents").select(F.col("source").alias("family"), F.col("doc_id").alias("id"), rules.alias("rules")))


TOKENS = "SELECT doc_id, source, unnest(list_filter(list_distinct(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9_]+')), lambda x: length(x) BETWEEN 5 AND 40)) AS token FROM documents"


@query(f"SELECT token, count(*) AS df FROM ({TOKENS}) GROUP BY token")
def document_frequency(spark, sf_dir):
    return corpus.document_frequency(table(spark, sf_dir, "documents"))


@query(
    f"WITH i AS (SELECT source, token, count(*) AS n FROM ({TOKENS}) GROUP BY 1, 2), d AS (SELECT token, CAST(sum(n) AS BIGINT) AS df FROM i GROUP BY 1), m AS (SELECT source, count(*) AS members FROM documents GROUP BY 1), "
    "s AS (SELECT source, token, n, df, round(n / members * ln((SELECT count(*) FROM documents) / df), 6) AS score FROM i JOIN d USING (token) JOIN m USING (source)) "
    "SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, token) AS INT) AS rank FROM s QUALIFY rank <= 25"
)
def tfidf_markers(spark, sf_dir):
    return corpus.markers(table(spark, sf_dir, "documents"), "source")


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT d.doc_id AS id, 'item-' || CAST(b.item_id AS VARCHAR) AS name, sha256(d.text) AS sha256 FROM documents d JOIN (SELECT item_id % 5 AS item_id, min(doc_id) AS doc_id FROM benchmark, documents WHERE doc_id < 5 AND doc_id = item_id % 5 GROUP BY 1) b ON d.text = (SELECT text FROM documents x WHERE x.doc_id = b.doc_id)")
def resolve_pinned(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pinned = d.where("doc_id < 5").select(F.concat(F.lit("item-"), F.col("doc_id").cast("string")).alias("name"), F.sha2("text", 256).alias("sha256"))
    return corpus.resolve_by_digest(d.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), pinned)


@query("SELECT doc_id AS id, lang, source FROM documents WHERE source = 'src3'")
def find_cluster(spark, sf_dir):
    return corpus.find_by_cluster(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source"), "source", "src3")


@query("SELECT doc_id AS id, source FROM documents WHERE lang = 'fr'")
def find_tag(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return corpus.find_by_tag(d.select(F.col("doc_id").alias("id"), "source"), corpus.tag_rows(d, "doc_id", ("lang", "source")), "lang", "fr")


@query("SELECT DISTINCT page_id AS id FROM pages WHERE starts_with(url, 'https://') ")
def find_path_prefix(spark, sf_dir):
    return corpus.find_by_path_prefix(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path")), "https://")


@query("SELECT kind, value, count(*) AS n FROM (SELECT 'lang' AS kind, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE value IS NOT NULL GROUP BY 1, 2")
def tag_bridge(spark, sf_dir):
    return corpus.tag_rows(table(spark, sf_dir, "documents"), "doc_id", ("lang", "source")).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH t AS ({TAGS}), r AS (SELECT t.doc_id, found, quality, length(coalesce(text, '')) AS size, toxic FROM t LEFT JOIN labels USING (doc_id)), b AS ("
    "SELECT 'no_verdict' AS blocker FROM r WHERE toxic IS NULL UNION ALL SELECT 'low_quality' FROM r WHERE quality = 0 UNION ALL SELECT 'secret' FROM r WHERE list_contains(found, 'secret') UNION ALL "
    "SELECT 'identity' FROM r WHERE list_contains(found, 'identity') UNION ALL SELECT 'pii' FROM r WHERE list_contains(found, 'pii') UNION ALL SELECT 'empty' FROM r WHERE size = 0) SELECT blocker, count(*) AS n FROM b GROUP BY 1"
)
def publish_blockers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    rows = d.select(F.col("doc_id").alias("id"), F.col("toxic").alias("verdict"), "quality", corpus.sensitivity_tags(text).alias("tags"), F.length(text).alias("size"))
    return corpus.publish_blockers(rows).groupBy("blocker").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN quality = 0 AND toxic = 1 THEN 'detected_not_shippable' WHEN quality = 1 AND doc_id % 2 = 0 THEN 'rule_gap' ELSE 'unverified' END AS kind, count(*) AS n FROM labels GROUP BY 1")
def known_miss_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 0).alias("detected"), (F.col("toxic") == 0).alias("shippable"), (F.col("doc_id") % 2 == 0).alias("verified"))
    return corpus.known_miss_kind(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT source AS shard, count(*) AS expected FROM documents GROUP BY 1), f AS (SELECT source AS shard, count(*) AS actual FROM documents WHERE lang <> 'es' AND source <> 'src4' GROUP BY 1) SELECT shard, expected, actual, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unlisted' WHEN actual <> expected THEN 'differs' ELSE 'ok' END AS state FROM m FULL JOIN f USING (shard)")
def shard_census(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return corpus.census(d.groupBy(F.col("source").alias("shard")).agg(F.count(F.lit(1)).alias("expected")), d.where("lang <> 'es' and source <> 'src4'").groupBy(F.col("source").alias("shard")).agg(F.count(F.lit(1)).alias("actual")))


@query("SELECT field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS field FROM events) GROUP BY 1")
def field_census(spark, sf_dir):
    return corpus.field_census(table(spark, sf_dir, "events"), "props")


@query(
    "WITH e AS (SELECT doc_id, [CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END] AS must, doc_id % 9 = 0 AS known_miss FROM documents WHERE doc_id % 4 <> 3), o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN []::VARCHAR[] ELSE ['A', 'C'] END AS rules FROM documents WHERE doc_id % 11 <> 0), "
    "j AS (SELECT coalesce(e.doc_id, o.doc_id) AS id, coalesce(must, []) AS must, coalesce(rules, []) AS rules, coalesce(known_miss, false) AS known, o.doc_id IS NOT NULL AS seen FROM e FULL JOIN o USING (doc_id)), "
    "k AS (SELECT *, list_sort(list_filter(must, lambda x: NOT list_contains(rules, x))) AS lacking, list_sort(list_filter(rules, lambda x: NOT list_contains(must, x))) AS extra FROM j) "
    "SELECT id, CASE WHEN NOT seen THEN 'unscanned' WHEN known AND len(rules) > 0 THEN 'newly_detected' WHEN known THEN 'known_miss' WHEN len(lacking) > 0 THEN 'missed' ELSE 'detected' END AS status, array_to_string(lacking, ',') AS lacking, array_to_string(extra, ',') AS extra FROM k"
)
def golden_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    e = d.where("id % 4 <> 3").select("id", F.array(F.when(F.col("id") % 2 == 0, "A").otherwise("B")).alias("must"), (F.col("id") % 9 == 0).alias("known_miss"))
    o = d.where("id % 11 <> 0").select("id", F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"), F.lit("C"))).alias("rules"))
    return corpus.golden_status(e, o).select("id", "status", F.array_join("lacking", ",").alias("lacking"), F.array_join("extra", ",").alias("extra"))


@query("SELECT lang, source, 'only_left' AS side FROM (SELECT lang, source FROM documents EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 3 <> 0) UNION ALL SELECT lang, source, 'only_right' FROM (SELECT lang, source FROM documents WHERE doc_id % 3 <> 0 EXCEPT ALL SELECT lang, source FROM documents)")
def index_reconciliation(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return corpus.reconcile(d.select("lang", "source"), d.where("doc_id % 3 <> 0").select("lang", "source"))


@query()
def masked_documents(spark, sf_dir):
    return corpus.masked(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT CAST(0 AS BIGINT) AS leaks, count(*) AS same_length FROM documents WHERE text IS NOT NULL")
def masking_gate(spark, sf_dir):
    before = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    after = corpus.masked(before)
    both = before.join(after.select("id", F.length("text").alias("n")), "id").agg(F.count_if(F.length("text") == F.col("n")).alias("same_length"))
    return corpus.leaks_after_masking(before, after).agg(F.count(F.lit(1)).alias("leaks")).crossJoin(F.broadcast(both))


@query("SELECT count(*) AS pages, count(*) FILTER (WHERE contains(html, '<script')) AS with_script, count(*) FILTER (WHERE regexp_matches(html, '<title>[^<]*</title>')) AS with_title FROM pages")
def page_flags(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("pages"), F.count_if(h.contains("<script")).alias("with_script"), F.count_if(h.rlike(scan.to_java("<title>[^<]*</title>"))).alias("with_title"))


@query("SELECT count(*) AS rows_seen, CAST(0 AS BIGINT) AS hits FROM conversations")
def conversation_findings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), "text")
    found = scan.findings(c, use=("category:WS", "category:RCE"), filters=False).agg(F.count(F.lit(1)).alias("hits"))
    return c.agg(F.count(F.lit(1)).alias("rows_seen")).crossJoin(F.broadcast(found))


@query()
def analyzer_findings(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr(
        "concat('/srv/f', doc_id, '.php') AS path",
        "CASE doc_id % 5 WHEN 0 THEN concat('PNG', text) WHEN 1 THEN concat(text, repeat('$a .= \"QUJDREVG\";\\n', 25)) WHEN 2 THEN concat(text, repeat('\\\\x41\\\\101', 6)) "
        "WHEN 3 THEN concat(text, '$_POST[\"a\"]; mail($t); \"drop@example.com\"') ELSE text END AS text",
    )
    return scan.findings(files, use=tuple(analyzers.ANALYZERS)).select("path", "rule_code", "offset", "line", "severity")



OWN_RULES = """
rules:
  - {name: said_the, severity: low, category: prose, patterns: [{type: string, value: " the "}]}
  - {name: url_or_mail, severity: high, category: net, patterns: [{type: regex, value: '[a-z]+@[a-z]+\\.[a-z]+', flags: i}, {type: hex, value: "00"}]}
  - {name: broken, patterns: [{type: regex, value: "(("}]}
"""


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT 'said_the' AS rule_name, 'low' AS severity, doc_id FROM l WHERE contains(line, ' the ') "
    "UNION ALL SELECT 'url_or_mail', 'high', doc_id FROM l WHERE regexp_matches(line, '[a-z]+@[a-z]+\\.[a-z]+', 'i')) SELECT rule_name, severity, count(*) AS hits, count(DISTINCT doc_id) AS files FROM f GROUP BY 1, 2"
)
def yaml_rule_hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    found = yaml_rules.run_rules(d, yaml_rules.load_rules(OWN_RULES))
    return found.groupBy("rule_name", "severity").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("path").alias("files"))


HARVEST_TEXT = "CASE doc_id % 4 WHEN 0 THEN concat('<form><input type=\"password\">', coalesce(text, '')) WHEN 1 THEN concat(coalesce(text, ''), '$_POST[x]; mail ($a)') WHEN 2 THEN concat('<FORM>', coalesce(text, ''), '$_POST') ELSE coalesce(text, '') END"
HARVEST_SQL = " + ".join(f"CASE WHEN regexp_matches(t, {_q(r)}) THEN {w} ELSE 0 END" for w, r in yaml_rules.HARVEST)


@query(f"WITH d AS (SELECT doc_id, {HARVEST_TEXT} AS t FROM documents), s AS (SELECT doc_id, {HARVEST_SQL} AS score FROM d) SELECT CAST(score AS INT) AS score, score >= 4 AS flagged, count(*) AS n FROM s GROUP BY 1, 2")
def credential_harvester_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{HARVEST_TEXT} AS t")
    score = sum((F.when(F.col("t").rlike(scan.to_java(r, dotall=False) if not r.startswith("(?i)") else scan.to_java(r[4:], True, False)), w).otherwise(0) for w, r in yaml_rules.HARVEST), F.lit(0))
    return d.select(score.alias("score")).groupBy("score", (F.col("score") >= yaml_rules.HARVEST_LEAST).alias("flagged")).agg(F.count(F.lit(1)).alias("n"))


@query()
def yaml_heuristics(spark, sf_dir):
    """Every heuristic over planted texts."""
    rules = [yaml_rules.Rule(n, patterns=(yaml_rules.Pattern("heuristic", n, least=1),)) for n in yaml_rules.HEURISTICS]
    return yaml_rules.run_rules(planted(spark, sf_dir), rules).select("path", "rule_name", "line", "offset")


MARKED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('// noqa', chr(10), 'eval($_POST[1]);') WHEN 1 THEN 'eval($_POST[1]); // NOSONAR' WHEN 2 THEN concat('// noqa', chr(10), chr(10), 'eval($_POST[1]);') ELSE 'eval($_POST[1]);' END AS text FROM documents"


@query("SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 'low' ELSE 'critical' END AS severity, doc_id % 4 IN (0, 1) AS suppressed FROM documents")
def annotation_downgrade(spark, sf_dir):
    e = MARKED.removeprefix("SELECT doc_id, ").removesuffix(" AS text FROM documents").replace("$", "\\u0024")
    d = table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS path", f"{e} AS text")
    found = scan.findings(d, use=("RCE004",), trust=True)
    return found.select(F.col("path").cast("long").alias("doc_id"), "severity", "suppressed").distinct()


@query()
def assembled_identifiers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("concat('/srv/f', doc_id, '.php') AS path", "concat(coalesce(text, ''), '\\n\\u0024a = \"ev\" . \"al\"; \\u0024b = strrev(\"metsys\"); \\u0024a(\\u0024b);') AS text")
    return folding.assembled_strings(d).select("path", "offset", "variable", "value", "pieces", "sensitive", "called")


@query()
def decode_layers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("/srv/f"), F.col("doc_id")).alias("path"), F.concat(F.lit("eval('"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"[\r\n]", ""), F.lit("');")).alias("text"))
    return decode.decode_layers(d)


@query()
def archive_members(spark, sf_dir):
    """Members of planted zip containers, ten documents each."""
    import io
    import zipfile

    import pyarrow as pa

    def pack(key: tuple, tbl: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, t in sorted(zip(tbl.column("doc_id").to_pylist(), tbl.column("text").to_pylist(), strict=True)):
                z.writestr(f"uploads/{i}.php" if i % 2 else f"src/{i}.bin", t or "")
        return pa.table({"path": pa.array([f"/srv/{key[0].as_py()}.zip"]), "content": pa.array([out.getvalue()], pa.binary())})

    d = table(spark, sf_dir, "documents").select((F.col("doc_id") / 10).cast("long").alias("box"), "doc_id", "text")
    boxes = d.groupBy("box").applyInArrow(pack, "path string, content binary")
    return archives.explode_containers(boxes).select("container", "member", "idx", "size", "skip_reason", "depth")


@query()
def csv_report(spark, sf_dir):
    files = _selected(spark, sf_dir)
    found = scan.findings(files.where("skip_reason is null"))
    verdicts = rollup.file_verdicts(files.select("path", "skip_reason"), found)
    return reports.csv_rows(verdicts, found, rollup.quarantine_plan(verdicts, "/quarantine"))


@query()
def json_report(spark, sf_dir):
    files = _selected(spark, sf_dir)
    found = scan.findings(files.where("skip_reason is null"))
    return reports.json_records(rollup.file_verdicts(files.select("path", "skip_reason"), found), found)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_windowed(spark, sf_dir):
    """The windowed extension, over the table as a batch."""
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")



@query("SELECT source AS family, count(*) AS members, count(*) FILTER (WHERE ok) AS runnable, CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'none' WHEN count(*) FILTER (WHERE ok) < 3 THEN 'weak' ELSE 'enough' END AS power FROM (SELECT source, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 17 = 0) AS ok FROM documents) GROUP BY 1")
def family_rerun_power(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("family"), F.sha2("text", 256).alias("sha256"))
    return gates.rerun_power(d.select("family", "sha256"), d.where("doc_id % 17 = 0").select("sha256"))


@query("SELECT source, CAST(sum(files_total) AS BIGINT) AS files_total, CAST(sum(files_total - size_skipped - unreadable) AS BIGINT) AS files_read, CAST(sum(hits) AS BIGINT) AS hits, round(CASE WHEN sum(files_total - size_skipped - unreadable) > 0 THEN 100.0::DOUBLE * sum(hits) / sum(files_total - size_skipped - unreadable) END, 6) AS rate_pct FROM (SELECT source, doc_id % 50 AS files_total, doc_id % 3 AS size_skipped, doc_id % 2 AS unreadable, doc_id % 5 AS hits FROM documents) GROUP BY 1")
def coverage_denominators(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("source", "doc_id % 50 AS files_total", "doc_id % 3 AS size_skipped", "doc_id % 2 AS unreadable", "doc_id % 5 AS hits")
    return gates.coverage(d)


@query(
    "WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'zz' ELSE sha256(text) END AS sha256, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE n_chars END AS size, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS family, CASE WHEN doc_id % 2 = 0 THEN 'malicious' ELSE 'benign' END AS verdict, doc_id % 13 = 0 AS c2 FROM documents) "
    "SELECT id, 'digest_form' AS violation FROM r WHERE NOT regexp_full_match(sha256, '[0-9a-f]{64}') UNION ALL SELECT id, 'size_negative' FROM r WHERE size < 0 UNION ALL SELECT id, 'family_missing' FROM r WHERE verdict = 'malicious' AND family IS NULL UNION ALL SELECT id, 'benign_with_c2' FROM r WHERE verdict = 'benign' AND c2"
)
def index_invariants(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, "zz").otherwise(F.sha2("text", 256)).alias("sha256"), F.when(F.col("doc_id") % 11 == 0, -1).otherwise(F.col("n_chars")).alias("size"),
        F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("family"), F.when(F.col("doc_id") % 2 == 0, "malicious").otherwise("benign").alias("verdict"),
        F.when(F.col("doc_id") % 13 == 0, F.array(F.lit("c2"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    return gates.invariants(rows)


@query("WITH p AS (SELECT source AS folder, count(*) AS files, count(*) FILTER (WHERE toxic IS NULL) AS open, count(*) FILTER (WHERE quality = 0) AS detected FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) SELECT *, CASE WHEN open = 0 THEN 'done' WHEN detected = files THEN 'confirm' WHEN detected > 0 THEN 'mixed' ELSE 'review' END AS lane FROM p")
def queue_lanes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return gates.queue_lanes(d.select(F.col("source").alias("folder"), F.col("toxic").alias("verdict"), (F.col("quality") == 0).alias("detected")))


@query("WITH a AS (SELECT lang AS name, count(*) AS actual FROM documents GROUP BY 1), b AS (SELECT lang AS name, count(*) FILTER (WHERE lang <> 'fr' OR doc_id % 2 = 0) AS stated FROM documents WHERE lang <> 'es' GROUP BY 1) SELECT name, actual, stated FROM a FULL JOIN b USING (name) WHERE actual IS DISTINCT FROM stated")
def figure_drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    told = d.where("lang <> 'es'").groupBy(F.col("lang").alias("name")).agg(F.count_if(F.expr("lang <> 'fr' or doc_id % 2 = 0")).alias("value"))
    return gates.drift(d.groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("value")), told)


@query("SELECT family, count(*) AS members, count(DISTINCT rules) AS rulesets, count(DISTINCT rules) = 1 AS determined FROM (SELECT source AS family, doc_id, CASE WHEN source < 'src15' THEN 'A+B' || CAST(doc_id % 3 AS VARCHAR) ELSE 'A+C' END AS rules FROM documents) GROUP BY 1")
def ruleset_dispersion(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    second = F.when(F.col("source") < "src15", F.concat(F.lit("B"), (F.col("doc_id") % 3).cast("string"))).otherwise("C")
    return gates.dispersion(d.select(F.col("source").alias("family"), F.col("doc_id").alias("id"), F.explode(F.array(F.lit("A"), second)).alias("rule")))


@query("SELECT coalesce(t.doc_id, g.doc_id) AS id, 'identity' AS kind, CASE WHEN g.doc_id IS NULL THEN 'tag_only' WHEN t.doc_id IS NULL THEN 'gate_only' ELSE 'both' END AS seen_by FROM (SELECT doc_id FROM documents WHERE regexp_matches(text, '" + corpus.EMAIL + "')) t FULL JOIN (SELECT doc_id FROM documents WHERE contains(text, '@')) g ON t.doc_id = g.doc_id")
def tag_gate_reconciliation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("identity").alias("kind"))
    return gates.shape_reconciliation(d.where(F.col("text").rlike(corpus.EMAIL)).select("id", "kind"), d.where(F.col("text").contains("@")).select("id", "kind"))


@query("SELECT lang, source FROM documents WHERE doc_id % 3 = 0 EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 6 = 0")
def additive_only_violations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return gates.additive_only(d.where("doc_id % 3 = 0").select("lang", "source"), d.where("doc_id % 6 = 0").select("lang", "source"))


@query("SELECT doc_id, (doc_id % 3)::VARCHAR || '.' || (doc_id % 12)::VARCHAR || CASE WHEN doc_id % 5 = 0 THEN '-rc1' ELSE '' END AS version, lpad((doc_id % 3)::VARCHAR, 8, '0') || '.' || lpad((doc_id % 12)::VARCHAR, 8, '0') || '.00000000' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '~' END AS place FROM documents")
def version_order(spark, sf_dir):
    v = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(doc_id % 3, '.', doc_id % 12, CASE WHEN doc_id % 5 = 0 THEN '-rc1' ELSE '' END) AS version")
    return v.withColumn("place", gates.version_key(F.col("version")))


@query(
    "WITH RECURSIVE s AS (SELECT user_id AS run, event_id AS at, value AS done, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), p AS (SELECT b.run, b.n, (b.done - a.done) / (b.at - a.at) AS rate FROM s a JOIN s b ON a.run = b.run AND b.n = a.n + 1), "
    "e AS (SELECT run, n, rate AS ema FROM p WHERE n = 2 UNION ALL SELECT p.run, p.n, 0.25::DOUBLE * p.rate + 0.75::DOUBLE * e.ema FROM e JOIN p ON p.run = e.run AND p.n = e.n + 1) SELECT run, round(ema, 6) AS rate FROM e QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC) = 1"
)
def progress_rates(spark, sf_dir):
    return gates.smoothed_rates(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), F.col("value").alias("done")))


@query("SELECT source, count(*) AS documents, CAST(sum(n) AS BIGINT) AS control_bytes, count(*) FILTER (WHERE n > 0) AS with_control FROM (SELECT source, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]', '', 'g')) AS n FROM (SELECT source, CASE WHEN doc_id % 4 = 0 THEN text || chr(1) || chr(2) || chr(11) ELSE text END AS text FROM documents)) GROUP BY 1")
def control_density(spark, sf_dir):
    """The counts behind OBF036, as native columns."""
    t = F.coalesce(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\x01\x02\x0b"))).otherwise(F.col("text")), F.lit(""))
    n = F.length(t) - F.length(F.regexp_replace(t, r"[\x00-\x08\x0b\x0e-\x1f\x7f]", ""))
    return table(spark, sf_dir, "documents").select("source", n.alias("n")).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").cast("long").alias("control_bytes"), F.count_if(F.col("n") > 0).alias("with_control"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
