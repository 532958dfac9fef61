"""File-name rules FN001-FN007 and path functions, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators in disguise beside a dot-dot.
LOOKALIKES = ("／", "＼", "∕", "⁄", "⧸", "À¯", "%2f", "%5c")


def final_component(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def depth_of(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def lower_extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./\\]*)$", 1)


def has_no_extension(path: Column) -> Column:
    return ~final_component(path).rlike(r"^.+\.")


def name_rules(path: Column) -> Column:
    """Array of the codes that a path's name raises, in order."""
    name = final_component(path)
    low = F.lower(name)
    looks = F.lit(False)
    for t in LOOKALIKES:
        q = F.lit(t)
        for near in ("..", "%2e%2e"):
            looks = looks | low.contains(F.concat(F.lit(near), q)) | low.contains(F.concat(q, F.lit(near)))
    rules = [
        ("FN001", name.contains("$(") | name.contains("`") | name.contains("${")),
        ("FN002", name.rlike(r'[";|\\]')),
        ("FN003", name.rlike(r"[\x00-\x1f]")),
        ("FN004", name.startswith("-")),
        ("FN005", looks),
        ("FN006", low.contains("%00")),
        ("FN007", name.rlike(r"^\.\.$|^\.\.\\|\\\.\.\\|\\\.\.$|^\\|^[A-Za-z]:")),
    ]
    return F.array_compact(F.array(*(F.when(cond & (F.length(name) > 0), code) for code, cond in rules)))


def raise_names(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(name_rules(F.col("path"))).alias("rule_code"))
