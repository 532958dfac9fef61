"""Which rows of a listing are examined: globs, caps, literals of sizes and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscan.functions.dialect import glob_to_regex
from siltscan.operators.names import final_component, has_no_extension

#: Factors of size and duration units.
SIZE_UNITS = {"B": 1, "K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30, "T": 1 << 40, "TB": 1 << 40}
DURATION_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def glob_matches(path: Column, glob: str) -> Column:
    """`!ext` means no extension. A glob is tried on the name, and on the whole path only if it holds `**`."""
    if glob == "!ext":
        return has_no_extension(path)
    pattern = glob_to_regex(glob)
    hit = final_component(path).rlike(pattern)
    return hit | path.rlike(pattern) if "**" in glob else hit


def any_glob(path: Column, globs: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | glob_matches(path, g)
    return out


def verdict(path: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """excluded first; then accepted, if nothing or something included matches; else not_included."""
    accepted = any_glob(path, include) if include else F.lit(True)
    return F.when(any_glob(path, exclude), "excluded").when(accepted, "accepted").otherwise("not_included")


CONTAINERS = r"\.(zip|jar|war|tar|tgz|tar\.gz|gz|tbz2|phar)$"


def select_files(listing: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), cap: int = 0, containers: bool = True) -> DataFrame:
    """listing (path, length, ...) with `verdict` and `skip_reason` (null: examined). Works on metadata columns alone, so no content is read for what is skipped."""
    v = verdict(F.col("path"), include, exclude)
    oversize = F.lit(False) if cap == 0 else F.col("length") > cap
    if containers:
        oversize = oversize & ~F.lower("path").rlike(CONTAINERS)
    return listing.withColumn("verdict", v).withColumn("skip_reason", F.when(F.col("verdict") != "accepted", F.col("verdict")).when(oversize, "size"))


def parse_size(text: Column) -> Column:
    """'25MB' -> bytes; empty is 0, an unknown unit counts as bytes."""
    number = F.regexp_extract(text, r"^\s*([0-9]+)", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*[0-9]+\s*([A-Za-z]*)", 1))
    factor = F.lit(1)
    for u, f in SIZE_UNITS.items():
        factor = F.when(unit == u, F.lit(f)).otherwise(factor)
    return F.when(number == "", F.lit(0)).otherwise(number.cast("long")) * factor.cast("long")


def parse_duration(text: Column) -> Column:
    """'7d' -> seconds; an unknown unit counts as seconds."""
    number = F.regexp_extract(text, r"^\s*([0-9]+)", 1)
    unit = F.lower(F.regexp_extract(text, r"^\s*[0-9]+\s*([A-Za-z]?)", 1))
    factor = F.lit(1)
    for u, f in DURATION_UNITS.items():
        factor = F.when(unit == u, F.lit(f)).otherwise(factor)
    return F.when(number == "", F.lit(0)).otherwise(number.cast("long")) * factor.cast("long")


# Classes of archive members.
HOT = ("php", "php3", "php4", "php5", "php7", "php8", "phtml", "pht", "phar", "inc", "cgi", "pl", "py", "sh", "asp", "aspx", "jsp")
SCRIPT = ("js", "mjs", "ts", "rb", "lua", "htaccess", "ini", "sql", "tpl", "module", "install")
MARKUP = ("html", "htm", "xml", "css", "svg", "json", "txt", "md", "yml", "yaml")
MEDIA = ("png", "jpg", "jpeg", "gif", "webp", "ico", "mp3", "mp4", "woff", "woff2", "ttf", "pdf")
CREDENTIALS = ("wp-config.php", "configuration.php", "settings.php", "local.xml", "env.php", ".env", "parameters.yml", "database.php")


def member_class(name: Column) -> Column:
    """hot scripts in writable places first, other scripts, markup, media, other."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]*)$", 1))
    hot_place = F.exists(F.split(F.lower(name), "/"), lambda p: p.isin("uploads", "cache", "tmp", "images", "img", "media", "files"))
    return (
        F.when(ext.isin(*HOT) & hot_place, "hot_script").when(ext.isin(*HOT, *SCRIPT), "script").when(ext.isin(*MARKUP), "markup")
        .when(ext.isin(*MEDIA), "media").otherwise("other")
    )


def member_selection(members: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...], cap: int, exhaustive: bool = False) -> DataFrame:
    """members (name, size): patterns, then policy (only code unless exhaustive), then size."""
    v = verdict(F.col("name"), include, exclude)
    code = member_class(F.col("name")).isin("hot_script", "script", "markup")
    return members.withColumn("skip_reason", F.when(v != "accepted", v).when(F.lit(not exhaustive) & ~code, "policy").when(F.col("size") > cap, "size"))
