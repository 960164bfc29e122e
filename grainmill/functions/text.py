r"""Text functions as column expressions, with the semantics of Python's ``str``.

Java's ``\s`` and ``trim`` know fewer blanks than Python, so the class of white space is spelled
out once here and used in all patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python counts as white space, as a class body.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The characters at which Python splits lines.
LINE_ENDS = r"\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def newlines(c: Column | str) -> Column:
    r"""``\r\n`` and ``\r`` as ``\n``."""
    return F.regexp_replace(column(c), r"\r\n?", "\n")


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(column(c), f"^[{WS}]+", ""), f"[{WS}]+\\z", "")


def word_count(c: Column | str) -> Column:
    """Number of runs of characters other than white space; null for null."""
    return F.regexp_count(column(c), F.lit(f"[^{WS}]+")).cast("int")


def lines_split(c: Column | str) -> Column:
    """Lines as ``str.splitlines`` counts them, on text with normalised newlines."""
    c = column(c)
    ended = F.regexp_count(c, F.lit(f"[{LINE_ENDS}]"))
    open_end = (c != "") & ~c.rlike(f"[{LINE_ENDS}]\\z")
    return (ended + open_end.cast("int")).cast("int")


def lines_read(c: Column | str) -> Column:
    """Lines as ``readlines`` counts them, on text with normalised newlines."""
    c = column(c)
    return (F.regexp_count(c, F.lit("\n")) + ((c != "") & ~c.endswith("\n")).cast("int")).cast("int")


def lines_counted(c: Column | str) -> Column:
    """Line breaks plus one."""
    return (F.regexp_count(column(c), F.lit("\n")) + 1).cast("int")


def suffix(name: Column | str) -> Column:
    """The suffix of a file name: from its last dot on, unless the dot begins or ends the name."""
    return F.regexp_extract(column(name), r"(?s)\A.+(\.[^.]+)\z", 1)


def pieces(c: Column | str, size: int = 4096) -> Column:
    """The text in pieces of ``size`` characters; an empty text has none."""
    c = column(c)
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length(c) / size).cast("int") - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))
    return F.when(F.length(c) > 0, cut).when(c.isNotNull(), F.array().cast("array<string>"))
