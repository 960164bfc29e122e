import json
import os

import pytest

from grainmill import cli
from grainmill.config import RunConfig, interpolated, load_yaml_config
from grainmill.plans.pipeline import Pipeline
from grainmill.sources import listing

NAMES = ["a.py", "__init__.py", "_p/x.py", ".hid", ".github/w.yml", "sp ace.md", "br[1].md", "cu{a,b}.md", "k=v/z.py", "pkg/__init__.py", "e.txt", "h#x.md", "pc%20t.md"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for n in NAMES:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("" if n == "e.txt" else "def f():\n    '''Says.'''\n" if n.endswith(".py") else "# T\nbody\n")
    return root


def run(spark, root, out, **options):
    tables = Pipeline(spark, RunConfig(str(root), str(out), **options)).run()
    with open(out / "metadata.json") as f, open(out / "hashes.json") as g:
        return tables, json.load(f), json.load(g)


def test_listing(spark, tree):
    got = listing.listing(spark, str(tree)).where("not is_dir").orderBy("seq").collect()
    assert [r["path"] for r in got] == sorted(NAMES)
    listing.register(spark)
    read = spark.read.format("tree").load(str(tree))
    assert {r["path"]: r["error"] for r in read.collect()} == dict.fromkeys(NAMES)


def test_listing_by_subtrees(spark, tree, monkeypatch):
    want = listing.listing(spark, str(tree)).orderBy("seq").drop("seq").collect()
    monkeypatch.setattr(listing, "SUBTREES", 2)
    near, open_ = listing.subtrees(str(tree), enough=2)
    assert open_ and len(near) < len(want)
    monkeypatch.setattr(listing.subtrees, "__defaults__", (frozenset(), 2))
    assert listing.listing(spark, str(tree)).orderBy("seq").drop("seq").collect() == want
    assert listing.listing(spark, str(tree), frozenset(["pkg"])).where("path like 'pkg%'").count() == 0


def test_two_runs(spark, tree, tmp_path):
    out = tmp_path / "out"
    (tree / "bad.js").write_bytes(b"\x80")
    (tree / "bad.txt").write_bytes(b"\x80")
    (tree / "big.txt").write_text("x" * 500)
    (tree / ".gitignore").write_text("*.log\n")
    (tree / "x.log").write_text("x")
    tables, meta, hashes = run(spark, tree, out, max_file_size=400)
    paths = {p["path"] for p in meta["processed_files"]}
    assert paths == {*NAMES, "bad.txt", ".gitignore"} == set(hashes)
    reasons = {p["path"]: p["reason"] for p in meta["skipped_files"]}
    assert reasons[str(tree / "big.txt")] == "File exceeds size limit" and reasons[str(tree / "bad.js")].startswith("Error processing file: 'utf-8' codec") and len(reasons) == 2
    assert meta["summary"]["total_files_processed"] == 15
    assert meta["summary"]["total_words"] == sum(p["words"] for p in meta["processed_files"])
    text = (out / "remaining" / "chunk_0.txt").read_text()
    assert len(text.split()) == meta["summary"]["total_words"] and text.endswith("\n\n")
    (tree / "a.py").write_text("def g(): pass\n")
    _, meta, hashes2 = run(spark, tree, out, max_file_size=400)
    assert [p["path"] for p in meta["processed_files"]] == ["a.py"] and hashes2["a.py"] != hashes["a.py"]
    assert (out / "remaining" / "chunk_0.txt").read_text() == "Function: g\nCode:\ndef g(): pass\n\n"
    _, meta, _ = run(spark, tree, out, max_file_size=400)
    assert meta["processed_files"] == [] and meta["summary"] == {"total_files_processed": 0, "total_words": 0}


def test_small_files_and_modes(spark, tmp_path):
    root, out = tmp_path / "t", tmp_path / "t" / "out"
    (root / "node_modules").mkdir(parents=True)
    (root / "node_modules" / "m.js").write_text("a b")
    (root / "n.md").write_text("# H\nfour words are here\n")
    _, meta, _ = run(spark, root, out, max_words=7)
    assert {p["path"] for p in meta["processed_files"]} == {"node_modules/m.js", "n.md"}
    assert (out / "javascript" / "chunk_0.txt").exists() or (out / "markdown" / "chunk_0.txt").exists()
    _, meta, hashes = run(spark, root, tmp_path / "o2", mode="strict")
    assert "node_modules/m.js" not in hashes and "n.md" in hashes
    assert {"path": "node_modules/m.js", "reason": "Left out by a rule"} in meta["skipped_files"]
    (root / "k.js").write_text("a b c")
    run(spark, root, tmp_path / "o3", mode="strict")
    assert (tmp_path / "o3" / "javascript" / "chunk_0.txt").read_text() == "File: k.js\nContent:\na b c\n\n"
    assert (tmp_path / "o3" / "markdown" / "chunk_0.txt").read_text() == "# H\nfour words are here\n\n\n"


def test_state_as_tables(spark, tree, tmp_path):
    out = tmp_path / "out"
    first = Pipeline(spark, RunConfig(str(tree), str(out), state="parquet")).run()
    assert first["processed"].count() == len(NAMES) and not (out / "hashes.json").exists()
    (tree / "a.py").write_text("def g(): pass\n")
    again = Pipeline(spark, RunConfig(str(tree), str(out), state="parquet")).run()
    assert [r["path"] for r in again["processed"].collect()] == ["a.py"] and again["skipped"].count() == len(NAMES) - 1
    assert spark.read.parquet(str(out / "metadata" / "processed_files")).count() == 1
    Pipeline(spark, RunConfig(str(tree), str(out), state="parquet")).run()
    assert sorted(p.name for p in (out / "hashes").iterdir()) == ["run=1", "run=2"]


def test_interpolation(monkeypatch):
    monkeypatch.setenv("WORDS_OF", "7")
    got = interpolated({"base": "/x", "a": {"b": 3}, "repo_path": "${base}/t", "max_words": "${a.b}", "l": ["${oc.env:WORDS_OF}", "${oc.env:NOT_THERE,d}"]})
    assert got["repo_path"] == "/x/t" and got["max_words"] == 3 and got["l"] == ["7", "d"]
    for bad in ({"a": "${b}", "b": "${a}"}, {"a": "${no}"}, {"a": "${oc.env:NOT_THERE}"}):
        with pytest.raises(ValueError):
            interpolated(bad)


def test_empty_tree(spark, tmp_path):
    (tmp_path / "t").mkdir()
    _, meta, hashes = run(spark, tmp_path / "t", tmp_path / "o")
    assert meta == {"processed_files": [], "skipped_files": [], "summary": {"total_files_processed": 0, "total_words": 0}} and hashes == {}


def test_config(tmp_path):
    c = RunConfig("x", skip_patterns=[], skip_dirs=None)
    assert c.skip_patterns == [".git"] and c.skip_dirs == ["node_modules", "__pycache__"] and os.path.isabs(c.repo_path)
    assert c.override(max_words=5, verbose=None).max_words == 5
    with pytest.raises(ValueError):
        RunConfig("x", mode="other")
    with pytest.raises(FileNotFoundError):
        load_yaml_config(str(tmp_path / "no.yaml"))
    (tmp_path / "c.yaml").write_text("a: [")
    with pytest.raises(ValueError):
        load_yaml_config(str(tmp_path / "c.yaml"))
    (tmp_path / "c.yaml").write_text("repo_path: x\nmax_words: 9\nunknown: 1\n")
    assert RunConfig.of(load_yaml_config(str(tmp_path / "c.yaml"))).max_words == 9


def test_command_line(tmp_path, monkeypatch, spark):
    monkeypatch.chdir(tmp_path)
    assert cli.main([]) == 1
    assert cli.main(["--repo-path", "no"]) == 1
    (tmp_path / "f").write_text("x")
    assert cli.main(["--repo-path", "f"]) == 1
    (tmp_path / "config.yaml").write_text("max_words: 50\n")
    assert cli.main([]) == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("hello")
    (tmp_path / "config.yaml").write_text("repo_path: t\noutput_dir: o\n")
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    assert cli.main(["--max-words", "5", "--verbose"]) == 0
    assert (tmp_path / "o" / "remaining" / "chunk_0.txt").read_text() == "File: a.txt\nContent:\nhello\n\n"
