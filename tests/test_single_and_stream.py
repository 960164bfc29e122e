from grainmill.plans.single import FileChunker
from grainmill.streaming.incremental import chunk_stream


def test_files_on_disk(spark, tmp_path, caplog):
    c = FileChunker(spark)
    p = tmp_path / "sample.py"
    p.write_text('\ndef f():\n    """Says."""\n    return 1\n\n# last\n')
    got, lines = c.chunk_file(str(p))
    assert lines == 6 and got[0] == {"type": "function", "name": "f", "docstring": "Says.", "code": 'def f():\n    """Says."""\n    return 1'}
    assert got[1]["comments"] == [{"type": "comment", "line": 6, "text": "last"}]
    assert c.texts(str(p))[1] == "Comments:\nLine 6: last"
    bad = tmp_path / "bad.txt"
    bad.write_bytes(b"\x80")
    assert c.chunk_file(str(bad)) == ([], 0) and "bad.txt" in caplog.text
    assert c.chunk_file(str(tmp_path / "none.md")) == ([], 0)
    assert (c.subdir("a/b.markdown"), c.subdir("x.tsx")) == ("markdown", "other")


def test_stream(spark, tmp_path):
    schema = "path string, name string, suffix string, text string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("x/a.md", "a.md", ".md", "# A\nx")], schema).write.parquet(src)
    run = lambda: chunk_stream(spark, src, schema, out, str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("x/b.md", "b.md", ".md", "# B\n# C")], schema).write.mode("append").parquet(src)
    run()
    run()
    got = spark.read.parquet(out)
    assert sorted((r["path"], r["header"]) for r in got.collect()) == [("x/a.md", "# A"), ("x/b.md", "# B"), ("x/b.md", "# C")]
