"""Ignore rules, size limit and skipped folders as predicates on listed paths."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_FILES = (".gitignore", ".dockerignore")


def rule_regex(line: str) -> tuple[str, bool] | None:
    """A rule as a pattern over relative paths, and whether it takes paths back in; null for blanks and comments."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    elif line.startswith(("\\#", "\\!")):
        line = line[1:]
    folder = line.endswith("/") and not line.endswith("\\/")
    body = line.rstrip("/") if folder else line
    if not body:
        return None
    anchored = "/" in body
    body = body.removeprefix("/")
    prefix = "" if anchored else "(?:.+/)?"
    deep = body.endswith("/**")
    if deep:
        body = body[:-3]
    out, i = [], 0
    while i < len(body):
        ch = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:.+/)?")
            i += 3
            continue
        if ch == "*":
            while i + 1 < len(body) and body[i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[" and (end := _class_end(body, i)) > 0:
            inner = body[i + 1 : end]
            no = inner[0] in "!^"
            inner = (inner[1:] if no else inner).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"(?!/)[{'^' if no else ''}{inner}]")
            i = end
        elif ch == "\\" and i + 1 < len(body):
            i += 1
            out.append(re.escape(body[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    tail = "/.+" if folder or deep else "(?:/.*)?"
    return rf"(?s)\A{prefix}{''.join(out)}{tail}\z", negated


def _class_end(body: str, at: int) -> int:
    first = at + 2 if body[at + 1 : at + 2] in ("!", "^") else at + 1
    return body.find("]", first + 1) if first < len(body) else -1


def load_rules(root: str, extra: Iterable[str]) -> list[str]:
    """Lines of the ignore files at the root, then ``extra``."""
    lines: list[str] = []
    for name in IGNORE_FILES:
        path = os.path.join(root, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                lines += f.readlines()
    return [*lines, *extra]


def ignored(path: Column, rules: Iterable[str]) -> Column:
    """Does the last rule that matches a path leave it out?"""
    out = F.lit(False)
    for regex, negated in filter(None, map(rule_regex, rules)):
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def in_skipped_folder(path: Column, names: Iterable[str]) -> Column:
    """Is any folder above the file named like one of ``names``?"""
    parents = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(parents, lambda s: s.isin(*names)) if (names := list(names)) else F.lit(False)


def too_large(size: Column, limit: int) -> Column:
    return size > F.lit(limit)
