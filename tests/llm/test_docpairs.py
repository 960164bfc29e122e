import ast

import pytest

from grainmill.llm import docpairs as D

SCHEMA = "seq long, chunk_idx int, type string, name string, docstring string, code string, line int, tok string"
CLASS = '''class Box(Base):
    """Holds things."""

    # Counts what is inside
    # without opening it.
    @property
    def count(self):
        return len(self.x)

    # total = a.b(c)
    def plain(self, a=(1, {"k": ")"})):
        x = """not a docstring"""
        return "# no comment"

    async def later(
        self,
        b: int,
    ) -> str:
        \'\'\'Waits for the end.\'\'\'
        def inner(): "Adds both numbers."
        def nothing(): pass

    def below(self):
        # reads it twice because the first may fail
        return 1

    def todo(self):
        """TODO: write the documentation for this function later"""

    def name_only(self):
        """Name only."""

    def skeleton(self):
        """
        Args:
            a:

        Returns:
        """

    def marked(self):
        r"""TODO: the caller keeps a few of them open"""
'''


def rows(spark, *codes):
    return spark.createDataFrame([(n, 0, "class" if c and c.startswith("class") else "function", "f", None, c, 1, "t") for n, c in enumerate(codes)], SCHEMA)


def test_class(spark):
    got = {r["func_name"] for r in D.documented(rows(spark, CLASS)).collect()}
    assert got == {"count", "later", "inner", "below", "marked"}


def test_pairs(spark):
    got = {r["func_name"]: (r["code"], r["doc"]) for r in D.pairs(rows(spark, CLASS)).collect()}
    assert got["count"] == ("def count(self):\n        return len(self.x)", "Counts what is inside\nwithout opening it.")
    assert got["later"][1] == "Waits for the end." and got["later"][0].endswith("def nothing(): pass") and got["later"][0].startswith("async def later(")
    assert got["inner"] == ('def inner(): "Adds both numbers."', "Adds both numbers.")
    assert got["below"][0].endswith("return 1")


@pytest.mark.parametrize("doc", ["", "   ", "...", "-----", "TODO", "@todo", "TBD", "N/A", "FIXME: document", "Docstring.", "No description.", "pass", "Add scale.", "add_scale", "AddScale...", ":param x:\n:return:", "Args:\n\nReturns:"])
def test_says_nothing(spark, doc):
    assert D.documented(rows(spark, f'def add_scale(x):\n    """{doc}"""\n    return x')).count() == 0


@pytest.mark.parametrize("doc", ["Undo last step.", "Sum of squares.", "Raises on overflow.", "ファイルはもう一度隣のフォルダにコピーします", "TODO: keeps the totals", "Adds.\n\nArgs:\n    x: what to add"])
def test_says_something(spark, doc):
    assert D.documented(rows(spark, f'def add_scale(x):\n    """{doc}"""\n    return x')).count() == 1


def test_edges(spark):
    odd = rows(spark, None, "", "def", 'def broken(:\n    """Says it.', "def f():\r\n    'Says a thing.'\r\n    return 1", "x = " + "(" * 2000)
    assert sorted(tuple(r) for r in D.documented(odd.unionByName(odd)).collect()) == [(4, "f")]
    assert D.documented(odd.limit(0)).count() == 0 and D.pairs(odd.limit(0)).count() == 0
    bare = spark.createDataFrame([(1, 0, "function", "f", "Says a thing.", None, 1, "t"), (None, 0, "function", "g", "Says.", "def g(): pass", 1, "t")], SCHEMA)
    assert [tuple(r) for r in D.documented(bare).collect()] == [(1, "f")]


def test_against_the_syntax_tree(spark):
    import inspect

    import textwrap as module

    source = inspect.getsource(module)
    tree = ast.parse(source)
    codes = [ast.get_source_segment(source, n) for n in tree.body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
    want = {n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef) and ast.get_docstring(n)}
    got = {r["func_name"] for r in D.documented(rows(spark, *codes)).collect()}
    assert want - got == set()


def test_languages_with_braces(spark):
    js = """import x from 'y';
/**
 * Adds two numbers and checks {them}.
 * @param a first
 */
export async function add(a, b = ";") { if (a) { return "}" } // }
  return a + b; }
// Says hello to everyone
// in two lines.
const hello = (name) => { return `hi ${name}`; };
/* TODO */ function empty() {}
/** Loop of the caller. */ for (const q of z) { q(); }
class A {
  // Keeps the last value.
  keep(v) { this.v = v; }
  none() { return 1 }
}
"""
    java = "class B {\n  /** Reads all of it. */\n  @Override\n  public <T> List<T> read(Map<String, T> m) throws IOException {\n    while (true) { m.x(); }\n  }\n}\n"
    c = "#include <a.h>\n/* Frees the buffer\n * and its parts. */\nstatic int *drop(struct s *p)\n{\n  free(p); /* } */\n  return 0;\n}\nint x;\n"
    rows = [(1, 0, "a.js", "file", js), (1, 0, "a.js", "file", js), (2, 0, "B.java", "file", java), (3, 0, "c.c", "file", c), (4, 0, "d.py", "file", c), (5, 0, "e.js", "file", None), (6, 0, "f.js", "file", ""), (7, 0, None, "file", js)]
    df = spark.createDataFrame(rows, "seq long, chunk_idx int, path string, type string, content string")
    got = {(r["seq"], r["func_name"]): (r["code"], r["doc"]) for r in D.brace_pairs(df).collect()}
    assert set(got) == {(1, "add"), (1, "hello"), (1, "keep"), (2, "read"), (3, "drop")}
    assert got[1, "add"][0].startswith("export async function add(a") and got[1, "add"][0].endswith("return a + b; }") and got[1, "add"][1].startswith("Adds two numbers and checks {them}.")
    assert got[1, "hello"] == ("const hello = (name) => { return `hi ${name}`; }", "Says hello to everyone\n in two lines.")
    assert got[1, "keep"] == ("keep(v) { this.v = v; }", "Keeps the last value.") and got[2, "read"][1] == "Reads all of it." and got[2, "read"][0].endswith("m.x(); }\n  }")
    assert got[3, "drop"] == ("static int *drop(struct s *p)\n{\n  free(p); /* } */\n  return 0;\n}", "Frees the buffer\nand its parts.")
