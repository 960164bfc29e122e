import pytest
from pyspark.sql import functions as F

from grainmill.operators.ignore import ignored, in_skipped_folder, rule_regex

CASES = [
    (["*.log"], {"a.log": 1, "x/a.log": 1, "a.log/b": 1, "a.logs": 0}),
    (["docs/"], {"docs/a": 1, "docs": 0, "x/docs/b": 1}),
    (["/a.txt"], {"a.txt": 1, "x/a.txt": 0}),
    (["x/*.c"], {"x/a.c": 1, "y/x/a.c": 0, "x/y/a.c": 0}),
    (["**/v/**"], {"v/a": 1, "q/v/a/b": 1, "v": 0}),
    (["a/**/b"], {"a/b": 1, "a/x/y/b": 1, "ab": 0}),
    (["a?c"], {"abc": 1, "a/c": 0}),
    (["[ab].py"], {"a.py": 1, "c.py": 0}),
    (["[!ab].py"], {"a.py": 0, "c.py": 1}),
    (["\\#x", "\\!y"], {"#x": 1, "!y": 1}),
    (["", "# note", "  "], {"a": 0}),
    (["*.md", "!keep.md"], {"a.md": 1, "keep.md": 0, "x/keep.md": 0}),
    (["doc/", "!doc/a.md"], {"doc/a.md": 0, "doc/b.md": 1}),
    ([".git"], {".git/config": 1, ".gitignore": 0}),
    (["a b\\ "], {"a b ": 1, "a b": 0}),
]


@pytest.mark.parametrize("rules, paths", CASES)
def test_rules(spark, rules, paths):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r[0]: r[1] for r in df.select("path", ignored(F.col("path"), rules)).collect()}
    assert got == {p: bool(v) for p, v in paths.items()}


def test_no_rule():
    assert rule_regex("/") is None and rule_regex("!") is None


def test_skipped_folders(spark):
    df = spark.createDataFrame([(p,) for p in ("node_modules/a", "x/node_modules/a/b", "node_modules", "xnode_modules/a")], "path string")
    got = [r[0] for r in df.select(in_skipped_folder(F.col("path"), ["node_modules"])).collect()]
    assert got == [True, True, False, False]
    assert not df.select(in_skipped_folder(F.col("path"), [])).first()[0]
