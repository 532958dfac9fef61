"""Corpus analytics: rates with their denominators, families, clusters, markers, tags, masks, gates."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
#: Tag -> (expression, whether the match itself is evidence).
SENSITIVITY = (
    ("identity", EMAIL), ("c2", IPV4), ("secret", r"(?i)(?:api[_-]?key|password|passwd|secret|token)[ \t]*[=:][ \t]*[^ \t\n]{6,}"),
    ("pii", r"[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{16}"), ("path", r"/(?:home|var|srv|usr)/[A-Za-z0-9_./-]+"),
    ("content", r"(?i)licen[sc]e"),
)


def find_by_cluster(rows: DataFrame, column: str, value: str) -> DataFrame:
    return rows.where(F.col(column) == value)


def find_by_tag(rows: DataFrame, tags: DataFrame, kind: str, value: str) -> DataFrame:
    """rows (id) with a tag row (id, kind, value): a semi-join, so a row with the tag twice comes once."""
    return rows.join(tags.where((F.col("kind") == kind) & (F.col("value") == value)), "id", "left_semi")


def find_by_path_prefix(paths: DataFrame, prefix: str) -> DataFrame:
    """Distinct ids whose path begins so; startswith reaches the parquet statistics."""
    return paths.where(F.col("path").startswith(prefix)).select("id").distinct()


def tag_rows(rows: DataFrame, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    """Bridge rows (id, kind, value) of scalar or list columns."""
    out = None
    kinds = dict(rows.dtypes)
    for c in columns:
        value = F.explode(c) if kinds[c].startswith("array") else F.col(c)
        part = rows.select(F.col(id_col).alias("id"), F.lit(c).alias("kind"), value.alias("value")).where("value is not null")
        out = part if out is None else out.unionByName(part)
    return out


def detection_metrics(rows: DataFrame) -> DataFrame:
    """rows (family, malicious, detected): per family counts and state, for malicious rows."""
    per = rows.where("malicious").groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.count_if("detected").alias("found"))
    state = F.when(F.col("found") == 0, "missed").when(F.col("found") == F.col("members"), "covered").otherwise("partial")
    return per.withColumn("state", state)


def macro_micro(metrics: DataFrame) -> DataFrame:
    """One row: mean of the families' rates, and the rate of all members, to six places."""
    return metrics.agg(
        F.count(F.lit(1)).alias("families"), F.sum("members").alias("members"), F.sum("found").alias("found"),
        F.round(F.avg(F.col("found") / F.col("members")), 6).alias("macro"), F.round(F.sum("found") / F.sum("members"), 6).alias("micro"),
    )


def frame_partition(rows: DataFrame) -> DataFrame:
    """rows (frame, malicious, detected) by frame, and their sum in a last row."""
    return rows.rollup("frame").agg(F.count(F.lit(1)).alias("n"), F.count_if("malicious").alias("malicious"), F.count_if(F.col("malicious") & F.col("detected")).alias("detected")).select(F.coalesce("frame", F.lit("all")).alias("frame"), "n", "malicious", "detected")


def family_suspects(rows: DataFrame, least: int = 3) -> DataFrame:
    """Families with `least` detected members that share no rule. rows: (family, id, rules array). Counts of rules replace gathered lists."""
    per = rows.where(F.size("rules") > 0).select("family", "id", F.explode(F.array_distinct("rules")).alias("rule"))
    members = per.groupBy("family").agg(F.countDistinct("id").alias("detected"))
    shared = per.groupBy("family", "rule").agg(F.countDistinct("id").alias("n")).join(members, "family").where("n = detected").select("family").distinct()
    return members.where(F.col("detected") >= least).join(shared, "family", "left_anti")


def population(rows: DataFrame, candidates: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per candidate (at risk, hit): rows examined, at risk, hits, rate in percent, and the 95 % bound where nothing hit (300 / n)."""
    aggs = [F.count(F.lit(1)).alias("examined")]
    for name, (risk, hit) in candidates.items():
        aggs += [F.count_if(risk).alias(f"{name}|risk"), F.count_if(risk & hit).alias(f"{name}|hit")]
    one = rows.agg(*aggs)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("candidate"), F.col("examined"), F.col(f"`{n}|risk`").alias("at_risk"), F.col(f"`{n}|hit`").alias("hits")) for n in candidates)))
    out = one.select(each.alias("c")).select("c.*")
    return out.withColumn("rate_pct", F.round(F.when(F.col("at_risk") > 0, 100.0 * F.col("hits") / F.col("at_risk")), 6)).withColumn("bound_pct", F.round(F.when((F.col("hits") == 0) & (F.col("at_risk") > 0), 300.0 / F.col("at_risk")), 6))


def golden_status(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """expected (id, must array, known_miss) against observed (id, rules array): detected, missed, known_miss, newly_detected, unscanned; rules that are lacking or new."""
    j = expected.join(observed.withColumn("_seen", F.lit(True)), "id", "full_outer")
    must, rules = F.coalesce("must", F.array().cast("array<string>")), F.coalesce("rules", F.array().cast("array<string>"))
    lacking, extra = F.array_sort(F.array_except(must, rules)), F.array_sort(F.array_except(rules, must))
    known = F.coalesce("known_miss", F.lit(False))
    status = (
        F.when(F.col("_seen").isNull(), "unscanned").when(known & (F.size(rules) > 0), "newly_detected").when(known, "known_miss")
        .when(F.size(lacking) > 0, "missed").otherwise("detected")
    )
    return j.select("id", status.alias("status"), lacking.alias("lacking"), extra.alias("extra"))


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, counted, both ways."""
    a = left.exceptAll(right).withColumn("side", F.lit("only_left"))
    b = right.exceptAll(left).withColumn("side", F.lit("only_right"))
    return a.unionByName(b)


def resolve_by_digest(rows: DataFrame, pinned: DataFrame) -> DataFrame:
    """rows (id, content) whose bytes equal a pinned (name, sha256): an equi-join on the digest."""
    return rows.withColumn("sha256", F.sha2("content", 256)).join(pinned, "sha256").select("id", "name", "sha256")


def sensitivity_tags(text: Column) -> Column:
    """Sorted tags of a text; `clean` if none."""
    tags = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(t)) for t, p in SENSITIVITY)))
    return F.when(F.size(tags) == 0, F.array(F.lit("clean"))).otherwise(F.array_sort(tags))


def sensitivity_evidence(text: Column, tag: str) -> Column:
    pattern = dict(SENSITIVITY)[tag]
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)))


def ruleset_clusters(found: DataFrame, id_col: str = "path") -> DataFrame:
    """Clusters of rows with the same set of rules, largest first."""
    keys = found.select(id_col, "rule_code").distinct().groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list("rule_code")), "+").alias("ruleset"))
    return keys.groupBy("ruleset").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ruleset")


def literal_tokens(text: Column, least: int = 5, most: int = 40) -> Column:
    """Distinct printable runs between marks, of bounded length."""
    return F.filter(F.array_distinct(F.split(text, r"[^A-Za-z0-9_]+")), lambda t: F.length(t).between(least, most))


def document_frequency(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.select(F.explode(literal_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def markers(rows: DataFrame, cluster: str, text: str = "text", top: int = 25) -> DataFrame:
    """Tokens of a cluster by coverage times ln(N / df); ties by token."""
    tokens = rows.select(cluster, F.explode(literal_tokens(F.col(text))).alias("token"))
    inside = tokens.groupBy(cluster, "token").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("members"))
    total = sizes.agg(F.sum("members").cast("double").alias("total"))  # one row
    counted = inside.withColumn("df", F.sum("n").over(Window.partitionBy("token")))  # a token has one row a cluster
    scored = counted.join(sizes.crossJoin(F.broadcast(total)), cluster).withColumn("score", F.round(F.col("n") / F.col("members") * F.log(F.col("total") / F.col("df")), 6))
    w = Window.partitionBy(cluster).orderBy(F.desc("score"), "token")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(cluster, "token", "n", "df", "score", "rank")


def publish_blockers(rows: DataFrame) -> DataFrame:
    """rows (id, verdict, quality, tags array, size) -> each blocker of each row; none means publishable."""
    found = F.array_compact(F.array(
        F.when(F.col("verdict").isNull(), "no_verdict"), F.when(F.col("quality") == 0, "low_quality"), F.when(F.array_contains("tags", "secret"), "secret"),
        F.when(F.array_contains("tags", "identity"), "identity"), F.when(F.array_contains("tags", "pii"), "pii"), F.when(F.col("size") == 0, "empty"),
    ))
    return rows.select("id", F.explode(found).alias("blocker"))


def known_miss_kind(rows: DataFrame) -> DataFrame:
    """rule_gap, detected_not_shippable or unverified."""
    kind = F.when(F.col("detected") & ~F.col("shippable"), "detected_not_shippable").when(F.col("verified") & ~F.col("detected"), "rule_gap").otherwise("unverified")
    return rows.withColumn("kind", kind)


def census(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """manifest (shard, expected) against found (shard, actual)."""
    j = manifest.join(found, "shard", "full_outer")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(F.col("actual") != F.col("expected"), "differs").otherwise("ok")
    return j.select("shard", "expected", "actual", state.alias("state"))


def field_census(rows: DataFrame, json_col: str) -> DataFrame:
    """How often each top-level field of JSON rows occurs."""
    return rows.select(F.explode(F.json_object_keys(json_col)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


# Masking: length-preserving and keyed by the value, so equal values stay equal.
MASKED = re.compile(rf"(?P<email>{EMAIL})|(?P<host>(?<=://)[A-Za-z0-9.-]+)|(?P<hash>\$(?:2[aby]|P)\$[./A-Za-z0-9$]{{20,}})|(?P<secret>(?<=['\"])[A-Za-z0-9+/]{{24,}}(?=['\"]))")
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def mask_value(value: str, key: str = "siltscan") -> str:
    """Letters for letters, digits for digits, marks as they are; drawn from sha256 of key and value."""
    stream, n = b"", 0
    out = []
    for c in value:
        if not stream:
            stream, n = hashlib.sha256(f"{key}|{n}|{value}".encode()).digest(), n + 1
        b, stream = stream[0], stream[1:]
        if "a" <= c <= "z":
            out.append(LETTERS[b % 26])
        elif "A" <= c <= "Z":
            out.append(LETTERS[b % 26].upper())
        elif c.isdigit() and c.isascii():
            out.append(DIGITS[b % 10])
        else:
            out.append(c)
    return "".join(out)


def mask_text(text: str, key: str = "siltscan") -> str:
    return MASKED.sub(lambda m: mask_value(m[0], key), text)


def masked(rows: DataFrame, text: str = "text", key: str = "siltscan") -> DataFrame:
    """Rows with `text` masked; a null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            new = pa.array([None if t is None else mask_text(t, key) for t in batch.column(i).to_pylist()], pa.string())
            yield batch.set_column(i, text, new)

    return rows.mapInArrow(run, rows.schema)


def mask_collisions(pairs: DataFrame) -> DataFrame:
    """pairs (original, replacement): replacements of more than one original."""
    return pairs.groupBy("replacement").agg(F.countDistinct("original").alias("originals")).where("originals > 1")


def leaks_after_masking(before: DataFrame, after: DataFrame) -> DataFrame:
    """Identifiers of (id, text) that are in the text after masking as well."""
    a = before.select("id", F.explode(sensitivity_evidence(F.col("text"), "identity")).alias("value")).distinct()
    b = after.select("id", F.explode(sensitivity_evidence(F.col("text"), "identity")).alias("value")).distinct()
    return a.join(b, ["id", "value"], "left_semi")
