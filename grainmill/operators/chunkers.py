"""Chunkers: from the text of a file to its chunks.

All but the one for Python are column expressions. Input has ``name``, ``suffix`` and ``text``
(normalised newlines); a chunker gives an array of structs, and ``chunk`` explodes the array of
the chunker that the suffix asks for.
"""

from __future__ import annotations

import ast
import io
import logging
import tokenize
import warnings
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrowmap import map_batches
from ..functions.library import DOCUMENTATION, SUBDIRS

log = logging.getLogger(__name__)

CHUNK = (
    "struct<type:string,name:string,docstring:string,code:string,header:string,content:string,"
    "methods:array<struct<name:string>>,comments:array<struct<type:string,line:int,text:string>>>"
)
FIELDS = ["type", "name", "docstring", "code", "header", "content", "methods", "comments"]

#: Patterns that say what a chunk is.
SECTION = r"(?dm)(?=^#)"
SCRIPT = r"(?isu)<script[^>]*>(.*?)</script>"
STYLE = r"(?isu)<style[^>]*>(.*?)</style>"
RULE = r"(@[^{]+\{[^}]*\}|\{[^{}]*\})"


def subdir(suffix: Column) -> Column:
    """The output folder of a suffix, ``other`` where it has none."""
    pairs = [F.lit(x) for kv in SUBDIRS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[suffix], F.lit("other"))


def is_documentation(name: Column) -> Column:
    return name.isin(*DOCUMENTATION)


def _chunk(**given: Column) -> Column:
    return F.struct(*(given.get(f, F.lit(None)).alias(f) for f in FIELDS)).cast(CHUNK)


def markdown(text: Column) -> Column:
    """Sections that begin at lines with ``#`` in front; what stands before the first is one if it isn't blank."""
    parts = F.filter(F.split(text, SECTION, -1), lambda p: p != "")
    head = lambda p: F.when(p.startswith("#"), X.strip(F.substring_index(p, "\n", 1)))
    body = lambda p: F.when(p.startswith("#"), F.when(F.contains(p, F.lit("\n")), F.substring(p, F.instr(p, "\n") + 1, F.length(p))).otherwise("")).otherwise(p)
    made = F.transform(parts, lambda p: _chunk(header=head(p), content=body(p)))
    return F.filter(made, lambda c: c["header"].isNotNull() | (X.strip(c["content"]) != ""))


def html(text: Column, mode: str = "compat") -> Column:
    """All script bodies, then all style bodies; the whole page if it has neither.

    ``strict`` drops empty bodies and adds the text that readers of the page see.
    """
    of = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda b: _chunk(type=F.lit(kind), content=X.strip(b)))
    found = F.concat(of("html_script", SCRIPT), of("html_style", STYLE))
    page = F.array(_chunk(type=F.lit("html"), content=text))
    if mode == "strict":
        found = F.filter(found, lambda c: c["content"] != "")
        seen = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SCRIPT, " "), STYLE, " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
        seen = X.strip(F.regexp_replace(seen, f"[{X.WS}]+", " "))
        return F.when(F.size(found) > 0, F.concat(F.filter(F.array(_chunk(type=F.lit("html"), content=seen)), lambda c: c["content"] != ""), found)).otherwise(page)
    return F.when(F.size(found) > 0, found).otherwise(page)


def css(text: Column, mode: str = "compat") -> Column:
    """Blocks in braces, cut as the pattern finds them; the whole sheet if there is none. ``strict`` keeps selectors."""
    mark = F.when(F.contains(text, F.lit("\ue000")), F.lit("\ue001")).otherwise(F.lit("\ue000"))
    cut = F.regexp_replace(text, F.lit(RULE), F.concat(mark, F.lit("$1"), mark) if mode == "compat" else F.concat(F.lit("$1"), mark))
    parts = F.filter(F.split(cut, mark, F.lit(-1)), lambda p: F.contains(p, F.lit("{")) & (X.strip(p) != ""))
    made = F.transform(parts, lambda p: _chunk(type=F.lit("css_rule"), content=X.strip(p)))
    return F.when(F.size(made) > 0, made).otherwise(F.array(_chunk(type=F.lit("css"), content=text)))


def whole(name: Column, text: Column) -> Column:
    return F.array(_chunk(type=F.lit("file"), name=name, content=text))


class Segments:
    """Source text of syntax nodes: the text is encoded and its lines are found once for all nodes."""

    def __init__(self, source: str):
        self.raw = source.encode()
        ends = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 10) + 1
        self.begins = [0, *ends.tolist()]

    def of(self, node: ast.AST) -> str:
        begin, end = self.begins[node.lineno - 1] + node.col_offset, self.begins[node.end_lineno - 1] + node.end_col_offset
        return self.raw[begin:end].decode()


def parsed(source: str) -> ast.Module | None:
    """The syntax tree of a module, null if there is none."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            log.info("a Python file has no syntax tree: %s", e)
            return None


#: Where statements hold statements, in the order of a node's fields.
BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def definitions(tree: ast.Module, kinds: tuple[type, ...]) -> Iterator[ast.AST]:
    """Classes and functions of the given kinds, one level of the tree after the other. Definitions are statements, so expressions are not looked into."""
    level: list[ast.AST] = [tree]
    while level:
        yield from (n for n in level if isinstance(n, (ast.ClassDef, *kinds)))
        level = [child for n in level for block in BLOCKS for child in getattr(n, block, ())]


def comment_list(source: str) -> list[dict]:
    """The comments of a module in order, without their marks; what the tokeniser stops at leaves none."""
    if "#" not in source:
        return []
    try:
        held = [t for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError) as e:
        log.info("comments of a Python file can't be read: %s", e)
        return []
    return [{"type": "comment", "line": t.start[0], "text": t.string.lstrip("#").strip()} for t in held]


def python_chunks(source: str, asyncs: bool = False) -> list[tuple]:
    """Functions and classes of a module by depth in the tree, then its comments.

    What can't be parsed gives nothing; comments that can't be read leave the rest. ``asyncs``:
    coroutines count as functions too.
    """
    tree = parsed(source)
    if tree is None:
        return []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef) if asyncs else (ast.FunctionDef,)
    text, out = Segments(source), []
    for node in definitions(tree, functions):
        methods = [{"name": n.name} for n in node.body if isinstance(n, functions)] if isinstance(node, ast.ClassDef) else None
        out.append(("function" if methods is None else "class", node.name, ast.get_docstring(node), text.of(node), None, None, methods, None))
    said = comment_list(source)
    return [*out, ("comments", *[None] * 6, said)] if said else out


def python(files: DataFrame, mode: str = "compat") -> DataFrame:
    """``files`` (any columns and ``text``) with ``chunks`` in place of ``text``, through Arrow batches."""
    keep = [c for c in files.columns if c != "text"]
    asyncs = mode == "strict"

    def make():
        def each(*columns):
            for *row, source in zip(*columns):
                yield (*row, [dict(zip(FIELDS, c)) for c in python_chunks(source, asyncs)] if source is not None else [])

        return each

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema), f"chunks array<{CHUNK}>"])
    return map_batches(files.select(*keep, "text"), make, schema)


#: What makes the array of chunks of a file, by suffix: a function of ``(name, text, mode)`` as columns.
Builder = Callable[[Column, Column, str], Column]
BUILDERS: dict[str, Builder] = {
    ".md": lambda name, text, mode: markdown(text),
    ".markdown": lambda name, text, mode: markdown(text),
    ".html": lambda name, text, mode: html(text, mode),
    ".css": lambda name, text, mode: css(text, mode),
}


def register(suffix: str, build: Builder | None) -> None:
    """Let ``build`` make the chunks of files with ``suffix``, or with null go back to what is built in.

    ``build`` gives an array of structs with the fields of a chunk, some may be missing:
    ``chunk_struct`` makes one. Python's chunker is a parser, not a column, and can be replaced too.
    """
    if not suffix.startswith("."):
        raise ValueError("a suffix begins with a dot")
    if build is None:
        EXTRA.pop(suffix, None)
    else:
        EXTRA[suffix] = build


EXTRA: dict[str, Builder] = {}
chunk_struct = _chunk


def chunked(files: DataFrame, mode: str = "compat", keep: list[str] | None = None) -> DataFrame:
    """``files`` with the array ``chunks`` and the number of ``lines``.

    ``files`` has name, suffix and text, whose newlines need not be normalised; a null text gives
    no chunks and 0 lines. Python files alone go through Python workers.
    """
    keep = keep or [c for c in files.columns if c != "text"]
    rows = files.withColumn("text", X.newlines("text"))
    t, s = F.col("text"), F.col("suffix")
    lines = F.when(s == ".py", X.lines_split(t)).when(s.isin(".md", ".markdown"), X.lines_read(t)).otherwise(X.lines_counted(t))
    rows = rows.withColumn("lines", F.coalesce(lines, F.lit(0)))
    made = whole(F.col("name"), t)
    for ending, build in (BUILDERS | EXTRA).items():
        made = F.when(s == ending, build(F.col("name"), t, mode).cast(f"array<{CHUNK}>")).otherwise(made)
    parser = F.lit(".py" not in EXTRA) & F.coalesce(s == ".py", F.lit(False))
    of_python = python(rows.where(parser).select(*keep, "lines", "text"), mode)
    others = rows.where(~parser).select(*keep, "lines", F.when(t.isNotNull(), made).otherwise(F.array().cast(f"array<{CHUNK}>")).alias("chunks"))
    return of_python.unionByName(others)


def chunk(files: DataFrame, mode: str = "compat") -> DataFrame:
    """One row for each chunk: the columns of ``files`` but text, ``lines``, ``chunk_idx``, ``subdir`` and the fields of a chunk."""
    rows = chunked(files, mode)
    keep = [c for c in rows.columns if c not in ("chunks", *FIELDS)]
    out = rows.select(*(F.col(c).alias(f"_{c}") for c in keep), F.posexplode("chunks").alias("chunk_idx", "c"))
    return out.select(*(F.col(f"_{c}").alias(c) for c in keep), "chunk_idx", subdir(F.col("_suffix")).alias("subdir"), *(F.col(f"c.{f}").alias(f) for f in FIELDS))
