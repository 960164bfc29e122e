import random

import pytest

from grainmill.llm import generated as G
from grainmill.llm import natlang as N
from grainmill.llm import parsecheck as P

VALID = [
    (".py", "def f():\n    '''\n<<<<<<< not a conflict\n'''\n    return {1: [2]}\n"), (".py", ""), (".py", "\ufeffx = 1\n"), (".py", "x = '#'  # (\n"),
    (".js", "import { a } from './b';\n/*\n<<<<<<< ours\n*/\nconst f = (a, b = 1) => { return a / b; };\nlet r = /[/\"]{2}/g, t = `x ${f({})} }`;\nx = {a: 1, 'b': 2, ...c};\nif (a) b(); else c()\nfor (const q of z) {}\n"),
    (".js", "#!/usr/bin/env node\nclass A { #x = 1; static async *g() { yield this.#x } get y() { return 1 } }\n"), (".js", "a && (b = c === 3 ? \"x\" : null); !function (o) { o.a = 1 }(this);"),
    (".ts", "export class A<T> implements B { private x?: number; constructor(readonly a: string[] = []) {} m<K extends keyof T>(k: K): T[K] { return this.x! as any; } }\nconst u: Map<string, number> = new Map();\ntype Q = { a: 1 } | null;\n"),
    (".java", "package a.b;\nimport java.util.List;\n@Override\npublic class A extends B<C> {\n  static final int[] T = {1, 2,};\n  /** { */ private int f(long a, String... b) throws E { for (int i = 0; i < 3; i++) { x += a[i] * 2; } switch (q) { case 1: y = 2; break; default: z = 'c'; } return a > 0 ? 1 : -1; }\n}\n"),
    (".c", "#include <stdio.h>\n#define M(a) \\\n  ((a) + \"\nstatic const unsigned char t[] = { 0x01, 0xff };\nint f(char *a, int (*g)(void)) { struct s *p = (struct s *)a; if (*a == '\\'') return p->x; printf(\"%d\" \"x\", 1); do { a++; } while (*a); return -1; }\n"),
    (".cpp", "#include <map>\ntemplate <class T> struct A : public B { A() : x(1) {} ~A() = default; bool operator==(const A& o) const { return x == o.x; } std::map<int, int> m; private: int x = 0; };\nauto s = R\"(a \" b)\"; auto l = [&](auto a) { return a; };\n"),
    (".json", '{"a": [1, 2.5e3, true, null, "x\\u00e9\\n"]}'), (".json", "7"),
]
INVALID = [
    (".py", "def f(:\n", "premature end"), (".py", "def f(:)\n", "grammar"), (".py", "x = (1,\n", "premature end"), (".py", "x = 1)\n", "unbalanced delimiter"), (".py", 'x = """a\n', "unterminated literal"), (".py", "<<<<<<< HEAD\nx = 1\n=======\n", "conflict marker"),
    (".py", "x =\n", "grammar"), (".js", "function f() {\n  a(1;\n}", "unbalanced delimiter"), (".js", "function f() {\n  a(1);\n", "premature end"), (".js", "let a = 'x;\n", "unterminated literal"), (".js", "let a = `x ${b}", "unterminated literal"),
    (".js", "a = 1;\n=======\nb = 2;\n", "conflict marker"), (".js", "def f(a):\n    return a\n", "grammar"), (".js", "#!/bin/sh\nset -e\nfor f in a/*.b; do c $f; done\n", "grammar"), (".js", "a = 1 = ;", "grammar"), (".js", "/* x", "unterminated literal"),
    (".ts", "<!doctype html>\n<html><body>\n</body></html>\n", "grammar"), (".ts", "let a = “x”;", "foreign character"), (".java", "class A {\n  int f() { return 1; }\n", "premature end"), (".java", "import os\nx = 1\n", "grammar"),
    (".java", "a:\n  b: true\n  c: [1, 2]\n", "grammar"), (".c", "int f() { return (1; }", "unbalanced delimiter"), (".c", "class A { public: int x; };", "grammar"), (".c", "int f() {\n  x = 1\n  y = 2;\n}", "grammar"), (".cpp", "int f() { return 1; } }", "unbalanced delimiter"),
    (".json", "", "premature end"), (".json", "{'a': 1}", "foreign character"), (".json", '{"a": 1,}', "grammar"), (".json", '{"a": 1', "premature end"), (".json", '{"a" 1}', "grammar"), (".json", "a,b\nc,d\n", "foreign character"), (".json", "NaN", "foreign character"),
    (".json", '{\n>>>>>>> x\n"a": 1}', "conflict marker"), (".json", '{"a": "x', "unterminated literal"),
]


@pytest.mark.parametrize("suffix, text", VALID)
def test_valid(suffix, text):
    assert P.fault(text, suffix) is None


@pytest.mark.parametrize("suffix, text, why", INVALID)
def test_invalid(suffix, text, why):
    assert P.fault(text, suffix) == why


@pytest.mark.parametrize("suffix, text", [(".js", "function f(a) { if (a[0]) { return (a + 1); } }\n"), (".java", "class A { int f(int[] a) { if (a[0] > 1) { return (a[1] + 1); } return 2; } }\n"), (".c", "int f(int a[]) { if (a[0]) { return (a[1] + 1); } return 2; }\n")])
def test_a_lost_or_added_bracket_is_found(suffix, text):
    assert P.fault(text, suffix) is None
    for i, ch in enumerate(text):
        if ch in "()[]{}":
            assert P.fault(text[:i] + text[i + 1 :], suffix) and P.fault(text[:i] + ch + text[i:], suffix)


FILE = "seq long, chunk_idx int, repo string, path string, type string, content string, suffix string, fault string"


def test_invalid_files(spark):
    rows = [(1, 0, "r", "a.py", "file", "x = (", "", ""), (1, 0, "r", "a.py", "file", "x = (", "", ""), (2, 0, "r", "b.py", "file", "x = 1", "", ""), (3, 0, "s", "c.json", "file", "{", "", ""), (4, 0, "s", "d.md", "file", "{", "", ""), (5, 0, None, "e.py", "file", None, "", ""), (6, 0, "r", None, "file", "(", "", ""), (7, 0, "r", "f.py", "function", "(", "", "")]
    df = spark.createDataFrame(rows, FILE)
    assert sorted(r["seq"] for r in P.invalid(df).collect()) == [1, 3]
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid"], r["rate"]) for r in P.rates(df).collect()}
    assert rates == {("r", "python"): (2, 1, 0.5), ("s", "json"): (1, 1, 1.0), (None, "python"): (2, 1, 0.5), (None, "json"): (1, 1, 1.0)}
    assert P.invalid(df.limit(0)).count() == 0


CHUNK = "seq long, chunk_idx int, repo string, path string, type string, name string, docstring string, code string, content string, comments array<struct<type:string,line:int,text:string>>, lang string"


def chunk(seq, path, kind="file", code=None, content=None, doc=None, comments=None, repo="r", idx=0):
    return (seq, idx, repo, path, kind, None, doc, code, content, comments and [("comment", n, t) for n, t in comments], "x")


TALK = {
    "de": "der Puffer wird nicht mehr sortiert weil sonst Daten fehlen", "fr": "la liste est relue avant la fusion sans aucun message", "es": "la tabla se guarda antes de la union cuando falta el archivo",
    "it": "la lista viene copiata nella cartella prima della fusione", "nl": "de lijst wordt later opnieuw gelezen voordat de volgende ronde begint", "pl": "ten plik zostaje najpierw posortowana gdy brakuje pliku",
    "en": "the second pass keeps every open row until the queue is empty", "ru": "эта таблица проверяется только один раз", "ko": "파일은 다시 합치기 전에 미리 정렬합니다", "ja": "ファイルはもう一度隣のフォルダにコピーします", "zh": "这个数值总是会在读取之后立即清空",
}


def test_languages(spark):
    rows = [chunk(n, "a.js", content=f"// {t}\nlet x = call(1);\n") for n, t in enumerate(TALK.values())]
    rows += [chunk(50 + n, "b.py", "function", code=f'def f():\n    """{t}"""\n    x = 1') for n, t in enumerate(TALK.values())]
    rows += [
        chunk(100, "c.py", "comments", comments=[(1, "der Puffer wird nicht"), (2, "mehr sortiert weil sonst Daten fehlen")]),
        chunk(101, "d.py", "function", code='def f():\n    x = ("la liste est relue avant "\n        "la fusion sans aucun message")'),
        chunk(102, "e.js", content='log("\\u044d\\u0442\\u0430 \\u0442\\u0430\\u0431\\u043b\\u0438\\u0446\\u0430 \\u043f\\u0440\\u043e\\u0432\\u0435\\u0440\\u044f\\u0435\\u0442\\u0441\\u044f \\u0442\\u043e\\u043b\\u044c\\u043a\\u043e \\u043e\\u0434\\u0438\\u043d");'),
        chunk(103, "f.css", "css_rule", content="{ /* the second pass keeps every open row */ a: b }"),
        chunk(104, "g.py", "function", code='def f():\n    x = "SELECT a, b, c FROM d WHERE e = 1 AND f"\n    # odd = mantle.seal(ramp, a, b, c)\n    y = "tool --all the things now please"\n    z = "/a/b c"\n    # too short here'),
        chunk(105, "h.md", content="the second pass keeps every open row until the queue is empty"),
        chunk(106, "i.py", content=None), chunk(107, None, content="// x"), chunk(108, "j.js", content=""),
    ]
    df = spark.createDataFrame(rows, CHUNK)
    got = {}
    for r in N.languages(df.unionByName(df)).collect():
        got.setdefault(r["seq"], set()).add(r["lang"])
    for n, lang in enumerate(TALK):
        assert got.get(n) == {lang} == got.get(50 + n), lang
    assert got[100] == {"de"} and got[101] == {"fr"} and got[102] == {"ru"} and got[103] == {"en"}
    assert not {104, 105, 106, 107, 108} & set(got)
    shares = {(r["seq"], r["lang"]): r["share"] for r in N.shares(df).collect()}
    assert 0.5 < shares[0, "de"] < 1
    assert N.languages(df.limit(0)).count() == 0


@pytest.mark.parametrize("suffix, text", [
    (".c", "#if 0\nit's off {\n#endif\nint x;\n"), (".c", "#if 0\n{\n#else\nint y;\n#endif\n"), (".c", "# if 0 // off\n# if A\n(\n# endif\n# elif B\nint b;\n# endif\n"),
    (".cpp", "#ifdef A\nvoid f(int a) {\n#else\nvoid f(long a) {\n#endif\n}\n"),
    (".c", "#ifndef H\n#define H\n#if A\nint a;\n#elif B\nint b;\n#else\nint c;\n#endif\n#endif\n"),
    (".c", 'void f(void) { int x; asm volatile("mov %0, 1" : "=r"(x) : "r"(x) : "memory"); }\n'),
    (".java", "class A { int x; <T> void m(T t) {} }\n"), (".js", "<!-- hide\nlet a = 1;\n--> end\n"), (".json", "[" * 100000 + "]" * 100000),
])
def test_valid_at_the_edge(suffix, text):
    assert P.fault(text, suffix) is None


@pytest.mark.parametrize("suffix, text", [
    (".c", "#ifdef A\nint x;\n"), (".c", "int x;\n#endif\n"), (".c", "int x;\n#else\n"), (".c", "#if 0\n<<<<<<< ours\n#endif\nint x;\n"), (".c", "#if 1\nint x(;\n#endif\n"),
    *((".json", t) for t in ("[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", "1 2", "{1:2}", "", "[", '{"a":}', "[,1]", ":", '{"a":1]')),
    (".py", "x = " + "-" * 100000 + "1"), (".py", "(" * 500 + ")" * 500),
])
def test_invalid_at_the_edge(suffix, text):
    assert P.fault(text, suffix)


@pytest.mark.parametrize("seed", range(5))
def test_json_against_a_parser(seed):
    import json

    def none(name):
        raise ValueError(name)

    rnd = random.Random(seed)
    for _ in range(5000):
        t = "".join(rnd.choices(["[", "]", "{", "}", ",", ":", '"a"', "1", "null", " ", "-", "01", '"', "NaN"], k=rnd.randint(1, 7)))
        try:
            json.loads(t, parse_constant=none)
            valid = True
        except ValueError:
            valid = False
        assert valid == (P.fault(t, ".json") is None), t


def test_held_out_and_shares(spark):
    told = [
        ("de", "die Tabelle {} wird nicht sortiert wenn der Speicher {} fehlt"), ("fr", "la table {} est vide avant la fin pour les lignes {}"),
        ("en", "the table {} gets sorted before every run and the rows {} stay"),
    ]
    rnd, rows = random.Random(2), []
    for n in range(240):
        lang, form = told[n % 3]
        extra = {"de": "Eintrag Zeile Puffer Verbindung".split(), "fr": "entrée colonne tampon lecture".split(), "en": "entry column buffer reading".split()}[lang]
        rows.append(chunk(n, f"x{n}.js", content=f"let someValue = otherName({n});\n// {form.format(rnd.choice(extra), rnd.choice(extra))}.\n"))
    df = spark.createDataFrame(rows, CHUNK)
    got = {r["lang"]: r for r in N.held_out(df, part=3).collect()}
    assert set(got) == {"de", "fr", "en"} and all(r["right"] == 1 and r["right_without"] >= 0.9 for r in got.values())
    twice = "// the planner checks every page before the next run begins.\n"
    one = [chunk(900, "a.go", content="x := 1\n" + twice + "y := 2\n" + twice), chunk(901, "b.yaml", content="# the planner checks every page before the next run begins.\na: 1\n"), chunk(902, "c.sql", content="-- the planner checks every page before the next run begins.\nSELECT 1")]
    both = df.unionByName(spark.createDataFrame(one, CHUNK)).unionByName(spark.createDataFrame(one, CHUNK))
    shares = {r["seq"]: r for r in N.shares(both).where("seq >= 900").collect()}
    assert {k: (r["lang"], r["sentences"]) for k, r in shares.items()} == {900: ("en", 2), 901: ("en", 1), 902: ("en", 1)} and shares[900]["share"] > 0.8
    assert N.languages(both).where("seq >= 900").count() == 0  # other suffixes than those that are asked for


def body(seed):
    rnd = random.Random(seed)
    return "\n".join(f"function {''.join(rnd.choices('abcdefghijk', k=8))}({rnd.randint(1, 999)}) {{ return {''.join(rnd.choices('lmnopqr', k=9))}; }}" for _ in range(12))


def test_not_handwritten(spark):
    copy, own = body(1), body(2)
    rows = [
        *(chunk(n, f"src/x{n}/lib.js", content=f"// {n}\n{copy}", repo=f"r{n}") for n in range(3)),
        chunk(10, "src/own.js", content=own), chunk(11, "src/own2.js", content=own),
        chunk(12, "a.js", content="// Code generated by tool. DO NOT EDIT.\nlet a = 1;"), chunk(13, "b.js", content='emit("// Code generated by tool. DO NOT EDIT.");\nlet a = 1;'),
        chunk(14, "c.py", "comments", comments=[(1, "Fichier produit par outil, ne pas modifier à la main")]), chunk(15, "d.py", "comments", comments=[(1, "Reads files that are generated elsewhere")]),
        chunk(16, "e.js", content="t&&(l=v===48?1:null);" * 40), chunk(17, "f.js", content="module.exports = [\n" + "1, 2, 3, 4, 5, 6, 7, 8, 9,\n" * 30 + "];"), chunk(18, "g-lock.json", content='{"lockVersion": 1}'),
        chunk(19, "h.js", content='const x = "' + "1,2," * 60 + '";\n' + own), chunk(20, "i.c", content="/*! lib v1.14.7 | MIT */\nint x;"), chunk(21, None, content=None), chunk(22, "src/vendor_portal/minify.js", content="let a = 1;"),
        *(chunk(40 + n, f"s{n}.css", "css_rule", content="{ /* " + "the same long remark about nothing in particular stands here " * 4 + f"*/ width: {n}{n}7px; padding: {n * 7}em; margin: {n}91%; color: #{n}f{n}e{n}d; }}", repo=f"r{n}") for n in range(4)),
        chunk(50, "short.js", content='const x = "' + "31,52," * 200 + '";\nlet y = f(x, 1);\n' + own[:700]),
    ]
    files = spark.createDataFrame([(30, "r", "node_modules/a/b.js"), (31, "r", "x/y_pb2.py"), (32, "r", "src/vendor_portal/a.py"), (33, "r", "z.js.map"), (34, None, None), (35, "r", "lib\\vendor\\q.c"), (30, "r", "node_modules/a/b.js")], "seq long, repo string, path string")
    skipped = spark.createDataFrame([("r", "/srv/r/x/y_pb2.py"), (None, None)], "repo string, path string")
    df = spark.createDataFrame(rows, CHUNK)
    got = {r["seq"]: r["signs"] for r in G.not_handwritten(files, df.unionByName(df), skipped).collect()}
    assert set(got) == {0, 1, 2, 12, 14, 16, 17, 18, 20, 30, 31, 33, 35}
    assert got[0] == ["recurs in other repositories"] and got[16] == ["minified"] and got[17] == ["data"] and got[20] == ["banner of a library"] and got[31] == ["name of a made file", "skipped by path"]
    assert G.not_handwritten(files.limit(0), df.limit(0), skipped.limit(0)).count() == 0


def test_recurring_in_unrelated_repositories(spark):
    """Copies in any folder and of any suffix, also edited a little; not in forks, in one other repository only, or of little text."""
    lib, fork, pair = body(5), body(6), body(7)
    edited = lib.replace("function", "/* kept */ function", 2) + "\nlet more = 1;"
    rows = [
        *(chunk(n, f"src/m{n}/a.js", content=lib, repo=f"r{n}") for n in range(3)), chunk(3, "deep/in/b.rs", content=edited.upper(), repo="r3"),
        *(chunk(10 + n, "app/main.js", content=fork, repo=f"f{n}") for n in range(4)),
        chunk(20, "p.js", content=pair, repo="r0"), chunk(21, "q.js", content=pair, repo="r1"), chunk(22, "r.js", content=pair, repo="r1"),
        *(chunk(30 + n, f"s{n}.js", content="export default { name: 'x', value: 1, list: [1, 2, 3] };", repo=f"r{n}") for n in range(4)),
    ]
    df = spark.createDataFrame(rows, CHUNK)
    files = df.select("seq", "repo", "path").union(spark.range(90).selectExpr("1000 + id", "concat('f', id % 3)", "concat('app/part', id div 3, '.js')"))
    files = files.union(spark.sql("select 2000 + id, 'f3', concat('app/part', id, '.js') from range(30)"))
    got = {r["seq"]: r["signs"] for r in G.not_handwritten(files, df).collect()}
    assert got == dict.fromkeys(range(4), ["recurs in other repositories"])
    assert G.families(files).where("repo like 'f%'").select("family").distinct().count() == 1
    assert G.not_handwritten(files, df, rate=0.9).count() == 0  # few repositories of all


def test_tokens():
    same = ["x = f(1, 'a')  # says", "X=f(22,\"b c\")"]
    assert G.tokens(same[0], suffix="py").tolist() == G.tokens(same[1], suffix="py").tolist()
    assert len(G.tokens("a /* b */ // c\n d", suffix="js")) == 2 and len(G.tokens("#include <a>", suffix="c")) == 5
    assert G.fingerprints("").tolist() == [] and len(G.fingerprints("a b " * 500)) == 1


def test_code_counts_cover_whole_texts(spark, tmp_path):
    import base64

    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(bytes([n])).decode()} {n}\n" for n in range(256)))
    text = "a = 1\n" * 35 + "t = 'word " + "x" * 60 + " word'\nzzz(zz)\n"
    cols = "seq long, chunk_idx int, path string, type string, code string, content string, docstring string, comments array<struct<type:string,line:int,text:string>>"
    rows = N.counts(N.extracted(spark.createDataFrame([(1, 0, "a.py", "file", text, None, None, None)], cols), str(path)), str(path)).collect()
    assert {chr(r["token"]): r["n"] for r in rows if r["class"] == N.CODE and r["token"] >= 0} == {" ": 38, "a": 35, "t": 1, "z": 5}


def test_lock_files_with_a_long_head():
    text = '{"name": "x", "about": "' + "word " * 200 + '", "lockfileVersion": 3, "a": {"resolved": "u", "integrity": "v"}}'
    assert G.signs("file", text, None, "json") == "lock file"
