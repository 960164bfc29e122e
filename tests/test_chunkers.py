import re
import random

import pytest
from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.operators import chunkers

BOX = '# top\nimport os\n\nclass Box:\n    """A box."""\n    def size(self):\n        return 1  ## two\n\n@cache\ndef area(w):\n    """Area.\n\n    More.\n    """\n    return w\n\nasync def later():\n    def inner(): pass\n'
NOTES = 'intro\n# One\r\nalpha "q"\n```\n# not code\n```\n## Two'
SITE = "p, a {\n  margin: 0;\n}\n@media print {\n  b { color: blue; }\n  i { top: 1px; }\n}\n"


def chunks(spark, name, text, mode="compat"):
    suffix = "." + name.rsplit(".", 1)[1] if "." in name else ""
    df = spark.createDataFrame([(1, name, suffix, text)], "seq int, name string, suffix string, text string")
    lines = chunkers.chunked(df, mode).first()["lines"]
    return [r.asDict(recursive=True) for r in chunkers.chunk(df, mode).orderBy("chunk_idx").collect()], lines


def test_python(spark):
    got, lines = chunks(spark, "box.py", BOX)
    assert lines == 18
    assert [(c["type"], c["name"], c["docstring"]) for c in got] == [("class", "Box", "A box."), ("function", "area", "Area.\n\nMore."), ("function", "size", None), ("function", "inner", None), ("comments", None, None)]
    assert got[0]["code"] == 'class Box:\n    """A box."""\n    def size(self):\n        return 1' and got[0]["methods"] == [{"name": "size"}]
    assert got[1]["code"].startswith("def area(w):") and got[2]["code"] == "def size(self):\n        return 1"
    assert [(c["line"], c["text"]) for c in got[4]["comments"]] == [(1, "top"), (7, "two")]
    assert [c["name"] for c in chunks(spark, "box.py", BOX, "strict")[0]][:3] == ["Box", "area", "later"]


@pytest.mark.parametrize("text, lines", [("def f(:\n", 1), ("\ufeffx = 1\n", 1), ("x = '\0'\n", 1), (None, 0), ("import os\n", 1), ("", 0)])
def test_python_without_chunks(spark, text, lines):
    assert chunks(spark, "x.py", text) == ([], lines)


def test_markdown(spark):
    got, lines = chunks(spark, "notes.md", NOTES)
    assert lines == 7
    assert [(c["header"], c["content"]) for c in got] == [(None, "intro\n"), ("# One", 'alpha "q"\n```\n'), ("# not code", "```\n"), ("## Two", "")]


def test_markdown_against_model(spark):
    rnd = random.Random(5)
    values = ["".join(rnd.choices(["#", "a", " ", "\n", "\x85", "\u2028", "\x1c"], k=rnd.randint(0, 20))) for _ in range(800)]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for s, got in df.select("s", chunkers.markdown(F.col("s")).alias("c")).collect():
        want, header, body = [], None, ""
        for line in re.findall(r"[^\n]*\n|[^\n]+", s):
            if line.startswith("#"):
                if header or body.strip():
                    want.append((header, body))
                header, body = line.strip(), ""
            else:
                body += line
        if header or body.strip():
            want.append((header, body))
        assert [(c["header"], c["content"]) for c in got] == want


def test_html(spark):
    got, _ = chunks(spark, "page.html", "<SCRIPT src=a></SCRIPT><style>\nx\n</style><script>b</script>")
    assert [(c["type"], c["content"]) for c in got] == [("html_script", ""), ("html_script", "b"), ("html_style", "x")]
    assert [(c["type"], c["content"]) for c in chunks(spark, "page.html", "<p>hi</p>")[0]] == [("html", "<p>hi</p>")]
    strict, _ = chunks(spark, "page.html", "<p>hi <b>you</b></p><script src=a></script><style>\nx\n</style>", "strict")
    assert [(c["type"], c["content"]) for c in strict] == [("html", "hi you"), ("html_style", "x")]


def test_css(spark):
    got, lines = chunks(spark, "site.css", SITE)
    assert lines == 8 and [c["content"] for c in got] == ["{\n  margin: 0;\n}", "@media print {\n  b { color: blue; }", "{ top: 1px; }"]
    assert [c["content"] for c in chunks(spark, "x.css", "a { b { c } d")[0]] == ["a { b", "{ c }"]
    assert [c["type"] for c in chunks(spark, "x.css", "no rules")[0]] == ["css"]
    assert [c["content"] for c in chunks(spark, "x.css", "p { x\ue000 }")[0]] == ["{ x\ue000 }"]
    assert [c["content"] for c in chunks(spark, "x.css", "p { x }", "strict")[0]] == ["p { x }"]


def test_router(spark):
    for name, sub in (("a.js", "javascript"), ("A.java", "java"), ("a.cpp", "cpp"), ("a.bin", "other"), ("Makefile", "other"), ("X.PY", "other")):
        got, lines = chunks(spark, name, "x\n")
        assert [(c["type"], c["name"], c["content"], c["subdir"]) for c in got] == [("file", name, "x\n", sub)] and lines == 2
    assert chunks(spark, "bad.txt", None) == ([], 0)


def test_extra_columns_that_clash(spark):
    df = spark.createDataFrame([("a.txt", ".txt", "x", "mine", 7)], "name string, suffix string, text string, type string, lines int")
    got = chunkers.chunk(df.drop("lines")).first()
    assert got["type"] == "file" and got["content"] == "x"


def test_empty_table(spark):
    df = spark.createDataFrame([], "seq int, name string, suffix string, text string")
    assert chunkers.chunk(df).count() == 0


def test_registry(spark):
    chunkers.register(".ini", lambda name, text, mode: F.transform(F.split(text, "\n"), lambda t: chunkers.chunk_struct(type=F.lit("line"), name=name, content=t)))
    try:
        got, _ = chunks(spark, "a.ini", "x\ny")
        assert [(c["type"], c["name"], c["content"]) for c in got] == [("line", "a.ini", "x"), ("line", "a.ini", "y")]
    finally:
        chunkers.register(".ini", None)
    assert chunks(spark, "a.ini", "x\ny")[0][0]["type"] == "file"
    with pytest.raises(ValueError):
        chunkers.register("ini", None)


def test_segments_of_a_large_module():
    source = "".join(f"class C{n}:\n    def f(self, ü='é'):\n        return {n}\n" for n in range(3000))
    got = chunkers.python_chunks(source)
    assert len(got) == 6000 and got[-1][3] == "def f(self, ü='é'):\n        return 2999"


@pytest.mark.parametrize("source", ["(" * 5000, "x = " + "-" * 100000 + "1", "def f(): pass\n\x0cdef g(): pass\n"])
def test_hard_sources(source):
    assert [c[1] for c in chunkers.python_chunks(source)] == (["f", "g"] if source.startswith("def") else [])
