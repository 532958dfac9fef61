"""Roll-ups of findings, files and containers, and decisions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltscan.functions.signatures import SEVERITIES


def rule_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_code", "severity").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("path").alias("files"))


def severity_counts(found: DataFrame) -> DataFrame:
    """Findings and files by severity, with a total row."""
    return found.rollup("severity").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("path").alias("files")).select(F.coalesce("severity", F.lit("all")).alias("severity"), "hits", "files")


def first_per_line(found: DataFrame) -> DataFrame:
    """The first finding of a rule on a line: what user-defined rules report."""
    w = Window.partitionBy("path", "rule_code", "line").orderBy("ord", "offset")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def check_groups(found: DataFrame) -> DataFrame:
    """Findings by path, category and line, as a check of one file prints them."""
    return found.groupBy("path", "category", "line").agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.min("rule_code").alias("first_rule"))


def file_verdicts(files: DataFrame, found: DataFrame) -> DataFrame:
    """files (path, skip_reason) with counts and predicates: worth reporting, hostile content, hostile name, examined fully."""
    per = found.groupBy("path").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(F.col("category") != "FN").alias("content_matches"), F.count_if(F.col("category") == "FN").alias("name_matches"),
    )
    out = files.join(per, "path", "left").fillna(0, ["matches", "content_matches", "name_matches"])
    return out.select(
        *files.columns, "matches",
        (F.col("content_matches") > 0).alias("hostile_content"), (F.col("name_matches") > 0).alias("hostile_name"),
        F.col("skip_reason").isNull().alias("examined_fully"), ((F.col("matches") > 0) | F.col("skip_reason").isNotNull()).alias("worth_reporting"),
    )


def summary(files: DataFrame, found: DataFrame) -> DataFrame:
    """One row: totals of a scan, skip counts among them."""
    a = files.agg(
        F.count(F.lit(1)).alias("files_seen"), F.count_if(F.col("skip_reason").isNull()).alias("files_scanned"), F.count_if(F.col("skip_reason").isNotNull()).alias("files_skipped"),
    )
    b = found.agg(F.count(F.lit(1)).alias("total_matches"), F.countDistinct("path").alias("files_with_matches"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    return a.crossJoin(F.broadcast(b))  # one row each


def skip_tally(files: DataFrame) -> DataFrame:
    return files.where("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("files"))


def exit_code(totals: DataFrame, interrupted: Column | None = None, reader_gone: Column | None = None) -> DataFrame:
    """130 interrupted, else 1 incomplete, else 141 reader gone, else 2 findings, else 0."""
    no = F.lit(False)
    return totals.withColumn("exit_code", F.when(no if interrupted is None else interrupted, 130).when(F.col("files_skipped") > 0, 1).when(no if reader_gone is None else reader_gone, 141).when(F.col("total_matches") > 0, 2).otherwise(0))


def container_verdicts(members: DataFrame) -> DataFrame:
    """members (container, member, hostile): a hostile member condemns its container, and every member carries the container's outcome."""
    per = members.groupBy("container").agg(F.max("hostile").alias("container_hostile"), F.count_if("hostile").alias("hostile_members"), F.count(F.lit(1)).alias("members"))
    return members.join(per, "container")


def asset_folders(members: DataFrame) -> DataFrame:
    """Folders of a container that hold media, and no more scripts than media. members: (container, folder, kind)."""
    per = members.groupBy("container", "folder").agg(F.count_if(F.col("kind") == "media").alias("media"), F.count_if(F.col("kind") == "script").alias("scripts"))
    return per.where("media > 0 and scripts <= media")


#: Reasons that are the scan's own choice; a member left out for another one was meant to be read.
CHOSEN = ("policy", "excluded")


def archive_statistics(members: DataFrame, *keys: str) -> DataFrame:
    """Totals of containers (by `keys`; none: of all). members (container, member, size, skip_reason, unreadable, truncated): one row a member, a null member for
    a container that shows none. Sums of sums are right as well, so statistics of parts may be added."""
    per = members.groupBy("container", *(k for k in keys if k != "container")).agg(
        F.max("unreadable").cast("long").alias("unreadable"), F.max("truncated").cast("long").alias("truncated"),
        F.count_if(F.col("member").isNotNull() & F.col("skip_reason").isNull()).alias("members_scanned"),
        F.coalesce(F.sum(F.when(F.col("skip_reason").isNull(), F.col("size"))), F.lit(0)).alias("bytes_expanded"),
        F.count("skip_reason").alias("members_skipped"), F.count_if(F.col("skip_reason").isin(*CHOSEN)).alias("chosen"),
    )
    sums = [F.count_if(F.col("unreadable") == 0).alias("archives_opened"), F.sum("unreadable").alias("archives_unreadable"), F.sum("truncated").alias("archives_truncated"), *(F.sum(c).alias(c) for c in ("members_scanned", "bytes_expanded", "members_skipped"))]
    out = per.groupBy(*keys).agg(*sums, F.sum(F.col("members_skipped") - F.col("chosen")).alias("members_unexamined"))
    return out.withColumn("coverage_incomplete", (F.col("archives_unreadable") > 0) | (F.col("archives_truncated") > 0) | (F.col("members_unexamined") > 0))


def skip_phrase(members: DataFrame) -> DataFrame:
    """By container, members left out by reason, commonest first; ties by name."""
    n = members.where("skip_reason is not null").groupBy("container", "skip_reason").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "skip_reason", "n")))
    return n.groupBy("container").agg(F.sum("n").alias("skipped"), F.array_join(F.transform(parts, lambda p: F.concat(p["n"].cast("string"), F.lit(" "), p["skip_reason"])), ", ").alias("phrase"))


def index_summary(members: DataFrame, quoted: int = 8) -> DataFrame:
    """What an index alone shows of a container. members (container, idx, name, php, sql, credential, platform): folders and names that are
    metadata of another system are left out; of credentials the first `quoted` names are told."""
    kept = members.where(~F.col("name").endswith("/") & ~F.col("name").rlike(r"(^|/)(__MACOSX/|\._|\.DS_Store$)"))
    told = F.slice(F.array_sort(F.collect_list(F.when(F.col("credential") & (F.col("place") <= quoted), F.struct("idx", "name")))), 1, quoted)
    w = Window.partitionBy("container", "credential").orderBy("idx", "name")
    per = kept.withColumn("place", F.row_number().over(w)).groupBy("container").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if("php").alias("php_entries"), F.count_if("sql").alias("sql_dumps"),
        F.array_join(F.transform(told, lambda x: x["name"]), ",").alias("credentials"),
    )
    return per.join(container_platform(kept.select("container", "platform")).select("container", "platform"), "container", "left")


def container_platform(members: DataFrame) -> DataFrame:
    """The commonest platform of a container; the first by name among equals."""
    per = members.where("platform is not null").groupBy("container", "platform").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("container").orderBy(F.desc("n"), "platform")
    return per.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def exposure(per_container: DataFrame) -> DataFrame:
    """ARC001 for credentials or dumps, ARC002 for scripts, ARC003 for unreadable containers."""
    rules = F.array_compact(F.array(
        F.when((F.col("credentials") > 0) | (F.col("dumps") > 0), "ARC001"), F.when((F.col("scripts") > 0) & F.col("readable"), "ARC002"), F.when(~F.col("readable"), "ARC003"),
    ))
    return per_container.select("container", F.explode(rules).alias("rule_code"))


def quarantine_plan(verdicts: DataFrame, root: str) -> DataFrame:
    """Where each condemned file would go; equal targets get .1, .2, ... in order of their paths. Nothing is moved."""
    target = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(F.regexp_replace("path", "^/+", ""), r"\.\.(/|$)", "_$1"))
    bad = verdicts.where("hostile_content or hostile_name").select("path", target.alias("target"))
    w = Window.partitionBy("target").orderBy("path")
    n = F.row_number().over(w) - 1
    return bad.select("path", F.when(n == 0, F.col("target")).otherwise(F.concat("target", F.lit("."), n.cast("string"))).alias("target"))
