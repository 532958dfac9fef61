"""Reports of a scan: CSV rows, JSON records and their document, and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscan.functions.safetext import bytes_hex, display, is_plain
from siltscan.functions.signatures import SEVERITIES
from siltscan.operators.rollup import archive_statistics

#: The columns of a CSV report, by position.
CSV = (
    "file", "rule", "severity", "original_severity", "suppressed", "category", "line", "column", "quarantined", "skipped", "skip_reason",
    "quarantine_failed", "quarantine_path", "container_quarantine", "file_bytes_hex", "quarantine_path_bytes_hex",
)


def csv_rows(verdicts: DataFrame, found: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """One row per finding; files without findings that are worth reporting keep one row."""
    v = verdicts.where("worth_reporting").select("path", "skip_reason")
    if plan is None:
        v = v.withColumn("target", F.lit(None).cast("string"))
    else:
        v = v.join(plan.select("path", "target"), "path", "left")
    f = found.where(is_plain(F.col("rule_name"))).select("path", "rule_code", "severity", "original_severity", "suppressed", "category", "line", "col", "ord")
    j = v.join(f, "path", "left")
    no = F.lit(False)
    out = {
        "file": F.col("path"), "rule": F.col("rule_code"), "severity": F.col("severity"), "original_severity": F.when(F.col("severity") != F.col("original_severity"), F.col("original_severity")),
        "suppressed": F.coalesce("suppressed", no), "category": F.col("category"), "line": F.col("line"), "column": F.col("col"), "quarantined": F.col("target").isNotNull(), "skipped": F.col("skip_reason").isNotNull(),
        "skip_reason": F.col("skip_reason"), "quarantine_failed": no, "quarantine_path": F.col("target"), "container_quarantine": F.lit(None).cast("string"), "file_bytes_hex": bytes_hex(F.col("path")),
        "quarantine_path_bytes_hex": bytes_hex(F.col("target")),
    }
    return j.select(*(out[c].alias(c) for c in CSV))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').option("quote", '"').csv(path)


def json_records(verdicts: DataFrame, found: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """One JSON record per reported file, its matches in report order; none: an empty list. plan (path, target): where files were moved to.

    Keys that would say nothing are left out: bytes of a path that is shown as it is, a reason, a target, the severity of a finding that wasn't lowered. As nothing is moved,
    there is no `quarantineFailed`, and members of containers get no `containerQuarantine`."""
    lowered = F.col("suppressed")
    match = F.struct(
        "ord", F.col("rule_code").alias("rule"), "severity", F.when(lowered, F.col("original_severity")).alias("originalSeverity"), F.when(lowered, lowered).alias("suppressed"),
        "category", "line", F.col("col").alias("column"),
    )
    per = found.groupBy("path").agg(F.array_sort(F.collect_list(match)).alias("m"))  # a file's findings; caps of the rules bound them
    keep = F.coalesce(F.transform("m", lambda x: x.dropFields("ord")), F.array())
    v = verdicts.where("worth_reporting").select("path", "skip_reason")
    v = v.withColumn("target", F.lit(None).cast("string")) if plan is None else v.join(plan.select("path", "target"), "path", "left")
    skipped, moved = F.col("skip_reason").isNotNull(), F.col("target").isNotNull()
    record = F.struct(
        display("path").alias("path"), bytes_hex(F.col("path")).alias("pathBytesHex"), skipped.alias("skipped"), F.col("skip_reason").alias("skipReason"), moved.alias("quarantined"),
        display("target").alias("quarantinePath"), bytes_hex(F.col("target")).alias("quarantinePathBytesHex"), keep.alias("matches"),
    )
    return v.join(per, "path", "left").select("path", F.to_json(record).alias("record"))


#: Keys of counts that the walk makes, and reasons under which members are counted.
WALK = ("directoriesUnreadable", "entriesUnreadable", "directoriesCycleSkipped", "linksNotFollowed")
MEMBER_REASONS = ("policy", "size", "budget", "ratio", "depth", "corrupt", "excluded")


def json_summary(
    verdicts: DataFrame, plan: DataFrame | None = None, members: DataFrame | None = None, walk: dict[str, int] | None = None, directories: int = 0,
    roots_missing: tuple[str, ...] = (), interrupted: bool = False, duration_ms: int = 0,
) -> DataFrame:
    """One row: the keys that follow a report's records, as one JSON text. walk: counts under the names of WALK (none: 0).

    members, as in `rollup.archive_statistics`, give the key `archives`, only where a container was opened."""
    walk = {k: (walk or {}).get(k, 0) for k in WALK}
    reason = F.col("skip_reason")
    one = verdicts.agg(
        F.count_if(reason.isNull()).alias("scanned"), F.count_if(F.col("matches") > 0).alias("matched"), F.count_if("hostile_name").alias("named"),
        F.count("skip_reason").alias("total"), *(F.count_if(reason == r).alias(r) for r in ("size", "excluded", "unreadable")),
    )
    one = one.crossJoin(F.broadcast((verdicts.limit(0) if plan is None else plan).agg(F.count(F.lit(1)).alias("moved"))))  # one row each
    archives = F.lit(None).cast("string")
    if members is not None:
        reasons = members.agg(F.struct(*(F.count_if(reason == r).alias(r) for r in MEMBER_REASONS)).alias("r"))
        one = one.crossJoin(F.broadcast(archive_statistics(members))).crossJoin(F.broadcast(reasons))  # one row each
        names = {"archives_opened": "opened", "archives_unreadable": "unreadable", "archives_truncated": "stoppedEarly", "members_scanned": "membersScanned", "bytes_expanded": "bytesExpanded"}
        archives = F.when(F.col("archives_opened") > 0, F.struct(*(F.col(c).alias(k) for c, k in names.items()), F.col("r").alias("membersSkipped")))
    keys = [
        F.lit(interrupted).alias("interrupted"), F.col("scanned").alias("totalFilesScanned"), F.lit(directories).alias("totalDirectoriesScanned"), F.col("matched").alias("filesWithMatches"),
        F.col("named").alias("filesWithHostileNames"), F.col("size").alias("filesSkippedSize"), F.struct("total", "size", "excluded", "unreadable").alias("filesSkipped"),
        *(F.lit(walk[k]).alias(k) for k in WALK), F.col("moved").alias("filesQuarantined"), F.lit(0).alias("filesQuarantineFailed"),
        F.array(*(display(F.lit(r)) for r in roots_missing)).cast("array<string>").alias("rootsMissing"), archives.alias("archives"), F.lit(duration_ms).alias("durationMs"),
    ]
    return one.select(F.to_json(F.struct(*keys)).alias("summary"))


def json_document(records: DataFrame, summary: DataFrame) -> DataFrame:
    """Lines of one JSON document, in order: records (path, record) one to a line by path, then the keys of summary (one row).

    Lines are sorted by range, so text files written from it, joined in the order of their names, are the document. Name `records` as a table first: it is read twice."""
    first = records.agg(F.min(F.struct("path", "record")).alias("first"))
    body = records.join(F.broadcast(first)).select(F.lit(1).alias("part"), "path", F.concat(F.when(F.struct("path", "record") == F.col("first"), "").otherwise(","), "record").alias("line"))
    none = F.lit(None).cast("string").alias("path")
    head = summary.select(F.lit(0).alias("part"), none, F.lit('{"files":[').alias("line"))
    tail = summary.select(F.lit(2).alias("part"), none, F.concat(F.lit("],"), F.substring("summary", 2, 1 << 30)).alias("line"))
    return head.unionByName(body).unionByName(tail).orderBy("part", "path", "line")


def text_lines(verdicts: DataFrame, found: DataFrame) -> DataFrame:
    """[!] path C:1 H:2 - one line per file with findings."""
    counts = found.groupBy("path").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    parts = [F.when(F.col(s) > 0, F.concat(F.lit(f"{s[0].upper()}:"), F.col(s).cast("string"))) for s in reversed(SEVERITIES)]
    return counts.select("path", F.concat_ws(" ", F.lit("[!]"), F.col("path"), *parts).alias("line"))
