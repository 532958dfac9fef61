"""Gates over a corpus index: freshness, invariants, queues, coverage, drift, and progress of a run."""

from __future__ import annotations

import base64
import binascii
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltscan.operators.corpus import mask_text


def fingerprint_table(rows: DataFrame) -> DataFrame:
    """One row (n, digest) that any change of a table's rows changes, whatever their order."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(rows.columns)])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def is_fresh(source: DataFrame, stored: DataFrame) -> bool:
    """A derived table's stored fingerprint is its source's."""
    return fingerprint_table(source).first() == stored.first()


def rerun_power(rows: DataFrame, runnable: DataFrame) -> DataFrame:
    """rows (family, sha256), runnable (sha256): members of each family that can be run again; a semi-join by digest."""
    ran = rows.join(runnable.select("sha256").distinct().withColumn("_can", F.lit(1)), "sha256", "left")
    return ran.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.count("_can").alias("runnable")).withColumn("power", F.when(F.col("runnable") == 0, "none").when(F.col("runnable") < 3, "weak").otherwise("enough"))


def coverage(rows: DataFrame) -> DataFrame:
    """rows (source, files_total, size_skipped, unreadable, hits): files really read, and the rate over those; null where nothing was read."""
    read = F.sum("files_total") - F.sum("size_skipped") - F.sum("unreadable")
    out = rows.groupBy("source").agg(F.sum("files_total").alias("files_total"), read.alias("files_read"), F.sum("hits").alias("hits"))
    return out.withColumn("rate_pct", F.round(F.when(F.col("files_read") > 0, 100.0 * F.col("hits") / F.col("files_read")), 6))


def invariants(rows: DataFrame) -> DataFrame:
    """rows (id, sha256, size, family, verdict, tags): each violated invariant of each row."""
    broken = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest_form"), F.when(F.coalesce(F.col("size"), F.lit(-1)) < 0, "size_negative"),
        F.when((F.col("verdict") == "malicious") & F.col("family").isNull(), "family_missing"), F.when((F.col("verdict") == "benign") & F.array_contains("tags", "c2"), "benign_with_c2"),
    ))
    return rows.select("id", F.explode(broken).alias("violation"))


def duplicate_digests(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def queue_lanes(rows: DataFrame) -> DataFrame:
    """rows (folder, verdict, detected): folders of a quarantine queue in lanes."""
    per = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("verdict").isNull()).alias("open"), F.count_if("detected").alias("detected"))
    lane = F.when(F.col("open") == 0, "done").when(F.col("detected") == F.col("files"), "confirm").when(F.col("detected") > 0, "mixed").otherwise("review")
    return per.withColumn("lane", lane)


def drift(figures: DataFrame, told: DataFrame) -> DataFrame:
    """figures (name, value) against what a document tells (name, value): those that differ or stand on one side."""
    j = figures.withColumnRenamed("value", "actual").join(told.withColumnRenamed("value", "stated"), "name", "full_outer")
    return j.where(~F.col("actual").eqNullSafe(F.col("stated")))


def additive_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that a change took away; empty for a change that only adds."""
    return old.exceptAll(new)


def dispersion(found: DataFrame) -> DataFrame:
    """found (family, id, rule): distinct rule sets of a family against its members."""
    sets = found.groupBy("family", "id").agg(F.array_join(F.array_sort(F.collect_set("rule")), "+").alias("ruleset"))
    return sets.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("ruleset").alias("rulesets")).withColumn("determined", F.col("rulesets") == 1)


def shape_reconciliation(tags: DataFrame, gates: DataFrame) -> DataFrame:
    """tags (id, kind) against gates (id, kind): what only one of them saw."""
    j = tags.distinct().withColumn("t", F.lit(True)).join(gates.distinct().withColumn("g", F.lit(True)), ["id", "kind"], "full_outer")
    return j.select("id", "kind", F.when(F.col("g").isNull(), "tag_only").when(F.col("t").isNull(), "gate_only").otherwise("both").alias("seen_by"))


LAYER = re.compile(r"(?<=[\"'])[A-Za-z0-9+/]{24,}={0,2}(?=[\"'])")


def mask_layers(text: str, key: str = "siltscan") -> str:
    """Masks inside base64 literals too; a literal that doesn't encode back to itself is left alone."""

    def one(m: re.Match[str]) -> str:
        try:
            raw = base64.b64decode(m[0], validate=True)
            inner = raw.decode("ascii")
        except (binascii.Error, UnicodeDecodeError):
            return m[0]
        if base64.b64encode(raw).decode() != m[0]:
            return m[0]
        return base64.b64encode(mask_text(inner, key).encode()).decode()

    return LAYER.sub(one, text)


def version_key(version: Column) -> Column:
    """Orders dotted versions; a pre-release comes before its release."""
    core = F.regexp_extract(version, r"^v?([0-9.]+)", 1)
    numbers = F.transform(F.slice(F.concat(F.split(core, r"\."), F.array(F.lit("0"), F.lit("0"), F.lit("0"))), 1, 3), lambda x: F.lpad(x, 8, "0"))
    return F.concat(F.array_join(numbers, "."), F.when(version.contains("-"), "").otherwise("~"))


def smoothed_rates(samples: DataFrame, alpha: float = 0.25) -> DataFrame:
    """samples (run, at, done): the exponential moving average of each run's rate, as a fold over its ordered samples."""
    pairs = samples.withColumn("rate", (F.col("done") - F.lag("done").over(Window.partitionBy("run").orderBy("at"))) / (F.col("at") - F.lag("at").over(Window.partitionBy("run").orderBy("at"))))
    per = pairs.where("rate is not null").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("at", "rate"))).alias("r"))
    ema = F.aggregate(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), F.element_at("r", 1)["rate"], lambda acc, x: F.lit(alpha) * x["rate"] + F.lit(1 - alpha) * acc)
    return per.select("run", F.round(ema, 6).alias("rate"))
