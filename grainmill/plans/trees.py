"""Queries over a tree of files: documents are written as files, and runs over them come back as tables."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..config import RunConfig
from ..functions.library import load_json
from ..functions.text import word_count
from ..operators import chunkers
from ..session import scratch, shipped
from ..sources import listing
from ..sources.tables import table
from .pipeline import Pipeline

MAX_WORDS, MAX_SIZE = 900, 4000
#: Files of the root: an ignore file, one that no reader takes, one whose reader gives up, one for its own rule.
GITIGNORE = "# built\n*.cfg\n!*_clamp.cfg\n/typescript/*_b*\n"
DOCKERIGNORE = "*.log\n"
EXTRA = {".gitignore": GITIGNORE.encode(), ".dockerignore": DOCKERIGNORE.encode(), "bad.js": b"\x80", "bad.txt": b"\x80", "x.log": b"x"}

_held: dict[tuple[str, str], str] = {}


def tree(spark: SparkSession, d: str) -> str:
    """A folder with ``tree`` below it: a file for each document with a text, in a folder named like its language. Written once for a session."""
    key = spark.sparkContext.applicationId, d
    if key not in _held:
        base = scratch(spark, "tree").removeprefix("file://").removeprefix("file:")
        root = os.path.join(base, "tree")
        os.makedirs(root)
        for name, raw in EXTRA.items():
            with open(os.path.join(root, name), "wb") as f:
                f.write(raw)
        name = F.coalesce(F.substring_index("path", "/", -1), F.lit("unnamed"))
        rows = table(spark, d, "documents").where("text is not null").select(F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("_"), name).alias("rel"), "text", "doc_id")

        def write(batches):
            for batch in batches:
                for rel, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    target = os.path.join(root, rel)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(target, "w", encoding="utf-8", newline="") as f:
                        f.write(text)
                yield pa.RecordBatch.from_arrays([batch.column(0)], names=["rel"])

        shipped(rows).select("rel", "text").mapInArrow(write, "rel string").write.format("noop").mode("overwrite").save()
        _held[key] = base
    return _held[key]


def tree_listing(spark, d):
    """Every entry of the tree, folders included."""
    return listing.listing(spark, f"{tree(spark, d)}/tree").select("path", "name", "suffix", "is_dir", "size")


def read_back(spark: SparkSession, d: str) -> DataFrame:
    """The tree's files with text and hash from the ``tree`` source."""
    listing.register(spark)
    return spark.read.format("tree").load(f"{tree(spark, d)}/tree")


def tree_source(spark, d):
    rows = read_back(spark, d)
    return rows.select("path", "name", "suffix", "size", "hash", F.coalesce(F.length("text"), F.lit(-1)).cast("bigint").alias("chars"), F.col("error").isNotNull().alias("failed"))


def _by_command(spark: SparkSession, d: str) -> str:
    """The output folder of a run by the command line: options from YAML, state from an earlier run, in which some files are as they were and some changed."""
    base = tree(spark, d)
    out = f"{base}/out"
    if not os.path.exists(f"{out}/metadata.json"):
        os.makedirs(out)
        known = read_back(spark, d).where("text is not null and suffix <> '' and length(name) % 3 <> 0")
        same = known.select("path", F.when(F.length("name") % 3 == 1, F.col("hash")).otherwise(F.lit("0" * 32)).alias("hash"))
        with open(f"{out}/hashes.json", "w", encoding="utf-8") as f:
            json.dump({"gone/x.py": "1" * 32, **{r["path"]: r["hash"] for r in same.toLocalIterator()}}, f)
        with open(f"{base}/run.yaml", "w", encoding="utf-8") as f:
            f.write(f"base: {base}\nrepo_path: ${{base}}/tree\noutput_dir: ${{base}}/other\nmax_words: {MAX_WORDS}\nskip_patterns: [.git, 'c/*_k*.c']\n")
        if cli.main(["--config-file", f"{base}/run.yaml", "--output-dir", out, "--max-file-size", str(MAX_SIZE)]):
            raise RuntimeError("the run failed")
    return out


def _mapping(spark: SparkSession, path: str) -> dict:
    return load_json(path, "output of a run")


def tree_processed(spark, d):
    """``processed_files`` of a run; chunks and words of Python files, which SQL can't tell, are -1."""
    rows = _mapping(spark, f"{_by_command(spark, d)}/metadata.json")["processed_files"]
    held = spark.createDataFrame([(r["path"], r["size"], r["lines"], r["chunks"], r["words"]) for r in rows], "path string, size bigint, lines bigint, chunks bigint, words bigint")
    told = lambda c: F.when(F.col("path").endswith(".py"), F.lit(-1)).otherwise(F.col(c)).cast("bigint").alias(c)
    return held.select("path", "size", "lines", told("chunks"), told("words"))


def tree_skipped(spark, d):
    """``skipped_files`` of a run, paths below the tree, reasons without what the decoder says."""
    rows = _mapping(spark, f"{_by_command(spark, d)}/metadata.json")["skipped_files"]
    root = f"{os.path.realpath(tree(spark, d))}/tree/"
    return spark.createDataFrame([(r["path"].removeprefix(root), r["path"].startswith("/"), r["reason"].partition(": ")[0]) for r in rows], "path string, absolute boolean, reason string")


def tree_hashes(spark, d):
    """The state after a run."""
    return spark.createDataFrame(list(_mapping(spark, f"{_by_command(spark, d)}/hashes.json").items()), "path string, hash string")


def tree_summary(spark, d):
    """The summary of a run against its own rows, and what the log of entries counts."""
    held = _mapping(spark, f"{_by_command(spark, d)}/metadata.json")
    s = held["summary"]
    whole = s["total_words"] == sum(r["words"] for r in held["processed_files"])
    return spark.createDataFrame([(s["total_files_processed"], whole)], "files bigint, words_add_up boolean")


def tree_texts(spark, d):
    """Output files of a run that leaves out what has a chunker of its own, with their text; metadata and state are tables."""
    base = tree(spark, d)
    out = f"{base}/texts"
    config = RunConfig(f"{base}/tree", out, max_words=MAX_WORDS, max_file_size=1 << 30, skip_patterns=["*.py", "*.md", "*.markdown", "*.html", "*.css", "bad.*"], state="parquet")
    named = Pipeline(spark, config).run()["files"]
    texts = spark.read.text(out, wholetext=True, recursiveFileLookup=True, pathGlobFilter="chunk_*.txt").select(F.input_file_name().alias("at"), F.col("value").alias("text"))
    texts = texts.select(F.regexp_extract("at", r"([^/]+/chunk_\d+\.txt)$", 1).alias("rel_file"), F.md5(F.encode("text", "UTF-8")).alias("hash"), word_count("text").alias("said"))
    return named.join(texts, "rel_file").select("rel_file", "words", "chunks", "said", "hash")


#: A module with all that the chunker for Python tells apart, files that give nothing, and what comes out of them.
MODULES = {
    "box.py": '# top\nimport os\n\nclass Box:\n    """A box."""\n    def size(self):\n        return 1  ## two\n\n@cache\ndef area(w):\n    """Area.\n\n    More.\n    """\n    return w\n\nasync def later():\n    def inner(): pass\n',
    "order.py": "class A:\n    def m(self):\n        def inner(): return 'ü'\n\ndef f(): ''\n\nif f:\n    def h(x=(1,\n        2)): return {\n            x}\n",
    "nested.py": "class A:\n    'Outer.'\n    class B:\n        def x(self): pass\n        async def y(self): pass\n    def z(self): pass\n",
    "text.py": "s = '''\ndef no(): pass\n# no\n'''\nx = 1 #yes # and\n#\n",
    "broken.py": "def f(:\n",
    "marked.py": "\ufeffx = 1\n",
    "null.py": "x = '\0'\n",
    "plain.py": "import os\n",
    "empty.py": "",
}
WANTED = [
    ("box.py", 0, "class", "Box", "A box.", 'class Box:\n    """A box."""\n    def size(self):\n        return 1', "size", None, 18),
    ("box.py", 1, "function", "area", "Area.\n\nMore.", 'def area(w):\n    """Area.\n\n    More.\n    """\n    return w', None, None, 18),
    ("box.py", 2, "function", "size", None, "def size(self):\n        return 1", None, None, 18),
    ("box.py", 3, "function", "inner", None, "def inner(): pass", None, None, 18),
    ("box.py", 4, "comments", None, None, None, None, "1:top\n7:two", 18),
    ("order.py", 0, "class", "A", None, "class A:\n    def m(self):\n        def inner(): return 'ü'", "m", None, 10),
    ("order.py", 1, "function", "f", "", "def f(): ''", None, None, 10),
    ("order.py", 2, "function", "m", None, "def m(self):\n        def inner(): return 'ü'", None, None, 10),
    ("order.py", 3, "function", "h", None, "def h(x=(1,\n        2)): return {\n            x}", None, None, 10),
    ("order.py", 4, "function", "inner", None, "def inner(): return 'ü'", None, None, 10),
    ("nested.py", 0, "class", "A", "Outer.", "class A:\n    'Outer.'\n    class B:\n        def x(self): pass\n        async def y(self): pass\n    def z(self): pass", "z", None, 6),
    ("nested.py", 1, "class", "B", None, "class B:\n        def x(self): pass\n        async def y(self): pass", "x", None, 6),
    ("nested.py", 2, "function", "z", None, "def z(self): pass", None, None, 6),
    ("nested.py", 3, "function", "x", None, "def x(self): pass", None, None, 6),
    ("text.py", 0, "comments", None, None, None, None, "5:yes # and\n6:", 6),
]


def python_modules(spark, d):
    """The chunker for Python over the fixed modules."""
    rows = spark.createDataFrame([(n, ".py", t) for n, t in MODULES.items()], "name string, suffix string, text string")
    rows = chunkers.chunk(rows.withColumnRenamed("name", "file").withColumn("name", F.col("file")))
    said = F.array_join(F.transform("comments", lambda c: F.concat(c["line"].cast("string"), F.lit(":"), c["text"])), "\n")
    return rows.select("file", "chunk_idx", "type", "name", "docstring", "code", F.array_join(F.transform("methods", lambda m: m["name"]), ",").alias("methods"), said.alias("said"), "lines")


def python_again(spark, d):
    """Functions and classes of the table chunked once more: the first chunk of each is the chunk itself.

    Docstrings are compared where the table has one, methods in classes.
    """
    rows = table(spark, d, "chunks").where("type in ('function', 'class') and code is not null").dropDuplicates(["seq", "chunk_idx"])
    files = rows.select("seq", F.col("chunk_idx").alias("idx"), F.col("docstring").alias("doc"), F.lit("x.py").alias("name"), F.lit(".py").alias("suffix"), F.col("code").alias("text"))
    first = chunkers.chunk(files).where("chunk_idx = 0")
    said = F.when(F.col("doc").isNotNull(), F.col("docstring")).alias("docstring")
    return first.select("seq", F.col("idx").alias("chunk_idx"), "type", "name", said, "code", F.array_join(F.transform("methods", lambda m: m["name"]), ",").alias("methods"))


QUERIES = [tree_listing, tree_source, tree_processed, tree_skipped, tree_hashes, tree_summary, tree_texts, python_modules, python_again]
