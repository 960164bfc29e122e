"""Chunks as plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: Characters that a Python literal may have to escape, besides tab and line breaks.
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


@arrow_udf(StringType())
def _repr(v):
    import pyarrow as pa

    return pa.array([None if s is None else repr(s) for s in v.to_pylist()], pa.string())


def python_repr(c: Column) -> Column:
    """A string as Python writes it; null as ``None``.

    Rows without unprintable characters, nearly all, stay in the JVM.
    """
    bare = F.regexp_replace(c, "[\n\t\r]", "")
    esc = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for ch, name in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        esc = F.replace(esc, F.lit(ch), F.lit(name))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    fast = F.when(double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.when(c.isNull(), F.lit("None")).when(bare.rlike(UNPRINTABLE), _repr(c)).otherwise(fast)


def format_chunk(mode: str = "compat") -> Column:
    """The text of a chunk, from type, name, docstring, code, header, content and comments.

    Missing names and codes print ``None``, missing contents nothing. In ``compat`` mode what has
    no text form of its own (sections, whole pages and sheets) prints as a mapping; in
    ``strict`` mode as its header and content.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit("None"))
    content = F.coalesce("content", F.lit(""))
    doc = F.when(F.coalesce("docstring", F.lit("")) != "", F.concat(F.lit("\nDocstring:\n"), F.col("docstring"))).otherwise("")
    coded = lambda title: F.concat(F.lit(f"{title}: "), none("name"), doc, F.lit("\nCode:\n"), none("code"))
    said = F.array_join(F.transform(F.coalesce("comments", F.array()), lambda c: F.concat(F.lit("Line "), c["line"].cast("string"), F.lit(": "), F.coalesce(c["text"], F.lit("None")))), "\n")
    if mode == "strict":
        other = F.concat(F.when(F.col("header").isNotNull(), F.concat("header", F.lit("\n"))).otherwise(""), content)
    else:
        first = F.when(F.col("type").isNull(), F.concat(F.lit("{'header': "), python_repr(F.col("header")))).otherwise(F.concat(F.lit("{'type': "), python_repr(F.col("type"))))
        other = F.concat(F.lit("Unknown chunk type:\n"), first, F.lit(", 'content': "), python_repr(content), F.lit("}"))
    kind = F.col("type")
    return (
        F.when(kind == "function", coded("Function"))
        .when(kind == "class", coded("Class"))
        .when(kind == "comments", F.concat(F.lit("Comments:\n"), said))
        .when(kind == "file", F.concat(F.lit("File: "), none("name"), F.lit("\nContent:\n"), content))
        .when(kind == "html_script", F.concat(F.lit("HTML Script:\n"), content))
        .when(kind == "html_style", F.concat(F.lit("HTML Style:\n"), content))
        .when(kind == "css_rule", F.concat(F.lit("CSS Rule:\n"), content))
        .otherwise(other)
    )
