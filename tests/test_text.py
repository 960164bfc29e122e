import random

import pytest
from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.functions.formatting import format_chunk, python_repr
from grainmill.functions.library import compute_file_hash, is_documentation_file, load_json, read_file_in_chunks, save_json

ALPHABET = ["a", "b", " ", "\n", "\r", "\t", "#", "é", "\x85", "\u2028", "\x1c", "\u00a0", "\u3000", "'", '"', "\\", "\u200b", "𝔘", ".", "{", "}", "中", "\x00", "\x7f"]


def texts(n, seed, alphabet=ALPHABET):
    rnd = random.Random(seed)
    return [None, "", " ", *("".join(rnd.choices(alphabet, k=rnd.randint(0, 24))) for _ in range(n))]


def column(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, s string")


def test_words_strip_and_lines(spark):
    values = texts(1500, 1)
    u = X.newlines("s")
    got = column(spark, values).select("s", X.word_count("s"), X.strip("s"), u, X.lines_split(u), X.lines_read(u), X.lines_counted(u)).collect()
    for s, words, stripped, norm, split, read, counted in got:
        if s is None:
            assert (words, stripped, norm, split, read, counted) == (None,) * 6
            continue
        n = s.replace("\r\n", "\n").replace("\r", "\n")
        assert words == len(s.split()) and stripped == s.strip() and norm == n
        assert split == len(n.splitlines()) and counted == n.count("\n") + 1
        assert read == n.count("\n") + (n != "" and not n.endswith("\n"))


def test_repr(spark):
    values = texts(1500, 2)
    for s, r in column(spark, values).select("s", python_repr(F.col("s"))).collect():
        assert r == repr(s)


@pytest.mark.parametrize("name, suffix", [("a.py", ".py"), (".gitignore", ""), ("a.tar.gz", ".gz"), ("a.", ""), ("A.PY", ".PY"), (".a.py", ".py"), ("Makefile", ""), ("", "")])
def test_suffix(spark, name, suffix):
    assert column(spark, [name]).select(X.suffix("s")).first()[0] == suffix


def test_pieces(spark):
    values = texts(60, 3)
    for s, p in column(spark, values).select("s", X.pieces("s", 5)).collect():
        assert p == (None if s is None else [s[i : i + 5] for i in range(0, len(s), 5)])


SCHEMA = "type string, name string, docstring string, code string, header string, content string, comments array<struct<type:string,line:int,text:string>>"


def test_format(spark):
    rows = [
        ("function", "f", "Says.", "def f(): pass", None, None, None),
        ("function", None, "", None, None, None, None),
        ("class", "C", None, "class C: pass", None, None, None),
        ("comments", None, None, None, None, None, [("comment", 3, "x"), ("comment", 4, None)]),
        ("file", "a.js", None, None, None, "x", None),
        ("html_script", None, None, None, None, None, None),
        ("html_style", None, None, None, None, "s", None),
        ("css_rule", None, None, None, None, "{}", None),
        (None, None, None, None, "# H", "it's\n", None),
        (None, None, None, None, None, "a\"'", None),
        ("html", None, None, None, None, "<p>", None),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, SCHEMA).select(format_chunk()).collect()]
    assert got == [
        "Function: f\nDocstring:\nSays.\nCode:\ndef f(): pass", "Function: None\nCode:\nNone", "Class: C\nCode:\nclass C: pass", "Comments:\nLine 3: x\nLine 4: None",
        "File: a.js\nContent:\nx", "HTML Script:\n", "HTML Style:\ns", "CSS Rule:\n{}",
        f"Unknown chunk type:\n{ {'header': '# H', 'content': chr(105) + 't' + chr(39) + 's' + chr(10)} }", f"Unknown chunk type:\n{ {'header': None, 'content': 'a' + chr(34) + chr(39)} }",
        f"Unknown chunk type:\n{ {'type': 'html', 'content': '<p>'} }",
    ]
    strict = [r[0] for r in spark.createDataFrame(rows, SCHEMA).select(format_chunk("strict")).collect()]
    assert strict[8] == "# H\nit's\n" and strict[10] == "<p>"


def test_library(tmp_path):
    p = tmp_path / "x.json"
    save_json({"a": "b"}, str(p), "test")
    assert load_json(str(p), "test") == {"a": "b"} and load_json(str(tmp_path / "no"), "test") == {}
    p.write_text("{")
    assert load_json(str(p), "test") == {}
    save_json({}, str(tmp_path / "no" / "x"), "test")  # logged, not raised
    assert len(compute_file_hash(str(p))) == 32 and compute_file_hash(str(tmp_path / "no")) is None
    assert is_documentation_file("a/README.md") and not is_documentation_file("a/readme.md")
    p.write_text("äbcdefg", encoding="utf-8")
    assert list(read_file_in_chunks(str(p), 3)) == ["äbc", "def", "g"]
