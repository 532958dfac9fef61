"""Files as rows: a recursive listing whose content is read only for what is selected."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan.sources.selection import select_files


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content (binary). Spark leaves out `content` where it isn't used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "content")


def scan_input(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), cap: int = 25 << 20) -> tuple[DataFrame, DataFrame]:
    """The listing with its verdicts, and the content of what is examined. Two plans over one source: the first reads no content."""
    files = read_files(spark, root)
    listing = select_files(files.drop("content"), include, exclude, cap)
    return listing, select_files(files, include, exclude, cap).where("skip_reason is null").select("path", "content")


def pre_count(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def walk(root: str, follow: bool = False) -> Iterator[tuple[str, int, str]]:
    """(path, size, kind) of a local tree, files of a folder before its subfolders; kinds file, link_not_followed, unreadable. A folder that is its own ancestor is not entered again."""
    stack = [(root, frozenset())]
    while stack:
        folder, above = stack.pop()
        try:
            info = os.stat(folder)
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            yield folder, 0, "unreadable"
            continue
        me = (info.st_dev, info.st_ino)
        if me in above:
            continue
        below = []
        for e in entries:
            try:
                if e.is_symlink() and not follow:
                    if os.path.exists(e.path):
                        yield e.path, 0, "link_not_followed"
                elif e.is_dir(follow_symlinks=follow):
                    below.append((e.path, above | {me}))
                elif e.is_file(follow_symlinks=follow):
                    yield e.path, e.stat(follow_symlinks=follow).st_size, "file"
            except OSError:
                yield e.path, 0, "unreadable"
        stack += reversed(below)


def list_tree(spark: SparkSession, roots: list[str], follow: bool = False) -> DataFrame:
    """A listing of local trees with their kinds; a missing root is a row of kind root_missing."""
    rows = [r for root in roots for r in (walk(root, follow) if os.path.isdir(root) else [(root, 0, "root_missing")])]
    return spark.createDataFrame(rows, "path string, length long, kind string")


def is_container(content: Column) -> Column:
    """zip or gzip by their first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return head.isin("504B0304", "504B0506", "504B0708") | head.startswith("1F8B")
