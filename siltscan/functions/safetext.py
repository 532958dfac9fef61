"""Texts that can be printed: escapes of control bytes and of invalid UTF-8, and truncation that splits nothing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BAD = re.compile("[\x00-\x1f\x7f\x80-\x9f\udc80-\udcff]")


def sanitize(raw: bytes) -> str:
    r"""C0, DEL, C1 and bytes that aren't UTF-8 as \xNN."""

    def one(m: re.Match[str]) -> str:
        c = ord(m[0])
        return f"\\x{c - 0xDC00:02x}" if c >= 0xDC80 else "".join(f"\\x{b:02x}" for b in m[0].encode())

    return BAD.sub(one, raw.decode("utf-8", "surrogateescape"))


def truncate(text: str, most: int) -> str:
    """At most `most` UTF-8 bytes, no character split."""
    return text.encode()[:most].decode("utf-8", "ignore")


def is_plain(text: Column) -> Column:
    """No control characters: what names of rules and categories must be."""
    return ~text.rlike(r"[\x00-\x1f\x7f-\x9f]")


def bytes_hex(text: Column) -> Column:
    """The bytes of a path whose display loses something; null where it doesn't."""
    return F.when(~is_plain(text) | text.contains("\ufffd"), F.lower(F.hex(F.encode(text, "UTF-8"))))


def display(text: Column | str) -> Column:
    r"""`sanitize` as a column: C0, DEL and C1 as \xNN; other texts come as they are."""
    c = F.col(text) if isinstance(text, str) else text
    shown = F.transform(F.split(c, ""), lambda x: F.when(is_plain(x), x).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-8"))), "(..)", r"\\x$1")))
    return F.when(is_plain(c), c).otherwise(F.array_join(shown, ""))
