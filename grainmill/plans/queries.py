"""Queries over the tables of a folder, for the driver, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.formatting import format_chunk
from ..functions.library import DOCUMENTATION, SUBDIRS
from ..operators import changes, chunkers, ignore, metadata, packing, state
from ..session import scratch
from ..sources.tables import table
from . import trees

#: Rules and limits of the queries.
RULES = ["*.env", "docs/", "!docs/**/*.md", "/tools/*/*.c", "**/vendor/**", "[ab]*_*.yaml", "node_modules/", "*.min.css"]
SKIP_DIRS = ["node_modules", "dist", "build"]
MAX_SIZE = 10 * 1024 * 1024
MAX_WORDS = 400


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files; of rows with the same id one."""
    rows = table(spark, d, "documents", "doc_id", "path", "text", "lang")
    name = F.substring_index("path", "/", -1)
    return rows.select("doc_id", "path", name.alias("name"), X.suffix(name).alias("suffix"), "text", "lang")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, each once."""
    return table(spark, d, "chunks").dropDuplicates(["seq", "chunk_idx"])


def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count("text").alias("words"))


def line_counts(spark, d):
    u = X.newlines("text")
    return table(spark, d, "documents").select("doc_id", X.lines_split(u).alias("split"), X.lines_read(u).alias("read"), X.lines_counted(u).alias("counted"))


def stripped(spark, d):
    return table(spark, d, "documents").select("doc_id", X.strip("text").alias("stripped"))


def file_md5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("hash"))


def text_pieces(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.pieces("text", 4096)).alias("idx", "piece"))


def file_routes(spark, d):
    s = X.suffix("name")
    return table(spark, d, "files").select("seq", "name", s.alias("suffix"), chunkers.subdir(s).alias("subdir"), chunkers.is_documentation(F.col("name")).alias("is_doc")).distinct()


def ignored_files(spark, d):
    return table(spark, d, "files", "seq", "path").distinct().where(ignore.ignored(F.col("path"), RULES))


def pruned_files(spark, d):
    return table(spark, d, "files", "seq", "path").distinct().where(ignore.in_skipped_folder(F.col("path"), SKIP_DIRS))


def large_files(spark, d):
    return table(spark, d, "files", "seq", "path", "size").where(ignore.too_large(F.col("size"), MAX_SIZE)).distinct()


def markdown_sections(spark, d):
    rows = _documents(spark, d).where("lang = 'markdown' and text is not null")
    return rows.select("doc_id", F.posexplode(chunkers.markdown(X.newlines("text"))).alias("idx", "c")).select("doc_id", "idx", "c.header", "c.content")


def html_chunks(spark, d):
    rows = _documents(spark, d).where("lang = 'html' and text is not null")
    return rows.select("doc_id", F.posexplode(chunkers.html(X.newlines("text"))).alias("idx", "c")).select("doc_id", "idx", "c.type", "c.content")


def css_rules(spark, d):
    rows = _documents(spark, d).where("lang = 'css' and text is not null")
    return rows.select("doc_id", F.posexplode(chunkers.css(X.newlines("text"))).alias("idx", "c")).select("doc_id", "idx", "c.type", "c.content")


def python_chunks(spark, d):
    rows = chunkers.chunk(_documents(spark, d).where("lang = 'python'").withColumn("suffix", F.lit(".py")))
    return rows.select("doc_id", "chunk_idx", "type", "name", "docstring", "code", F.array_join(F.transform("methods", lambda m: m["name"]), ",").alias("methods"), "comments", "lines")


def file_chunks(spark, d):
    """All documents but Python through the router."""
    rows = _documents(spark, d).where("text is not null and (suffix is null or suffix <> '.py')")
    return chunkers.chunk(rows.select("doc_id", "name", "suffix", "text")).where("type = 'file'").select("doc_id", "chunk_idx", "subdir", "name", "content", "lines")


def chunk_texts(spark, d):
    """Chunks that have a form of their own, as text."""
    rows = _chunks(spark, d).where("type in ('function', 'class', 'comments', 'file', 'html_script', 'html_style', 'css_rule')")
    f = format_chunk()
    return rows.select("seq", "chunk_idx", f.alias("formatted"), X.word_count(f).alias("words"))


def section_texts(spark, d):
    """Chunks that print as a mapping, as text."""
    f = format_chunk()
    return _chunks(spark, d).where("type is null or type in ('html', 'css')").select("seq", "chunk_idx", f.alias("formatted"), X.word_count(f).alias("words"))


def strict_texts(spark, d):
    f = format_chunk("strict")
    return _chunks(spark, d).where("type is null").select("seq", "chunk_idx", f.alias("formatted"), X.word_count(f).alias("words"))


def _sized(spark, d):
    """Words of the text that each chunk prints as."""
    return _chunks(spark, d).select("seq", "chunk_idx", "subdir", X.word_count(format_chunk()).cast("bigint").alias("words"))


def pack_bins(spark, d):
    return packing.next_fit(_sized(spark, d), MAX_WORDS, ["seq", "chunk_idx"])


def pack_files(spark, d):
    sized = _sized(spark, d)
    bins = packing.next_fit(sized, MAX_WORDS, ["seq", "chunk_idx"]).join(sized.select("seq", "chunk_idx", "subdir"), ["seq", "chunk_idx"])
    return packing.files(bins, ["seq", "chunk_idx"])


def file_metadata(spark, d):
    """Figures of every file: chunks and words, and size and lines of the latest entry in the log, -1 if there is none."""
    files = changes.latest(table(spark, d, "files")).select("seq", "repo", "path")
    path = changes.relative_path(F.col("path"), F.col("repo")).alias("path")
    logged = table(spark, d, "processed").select("repo", path, "run_id", "logged_at", "size", "lines").groupBy("repo", "path").agg(F.max(F.struct("run_id", "logged_at", "size", "lines")).alias("r"))
    held = files.join(logged.select("repo", "path", "r.size", "r.lines"), ["repo", "path"], "left")
    out = metadata.per_file(held, _sized(spark, d).select("seq", "words"), ["seq"])
    return out.select("seq", "repo", "path", "chunks", "words", F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("lines", F.lit(-1)).alias("lines"))


def run_summary(spark, d):
    sized = _sized(spark, d)
    per = sized.groupBy("seq").agg(F.sum("words").alias("words"))
    return metadata.summary(per)


def entry_count(spark, d):
    return metadata.entries(table(spark, d, "files", "seq").distinct())


def _state(spark, d):
    """The last saved hash of each path of a repository, whatever its run."""
    rows = table(spark, d, "hashes").select(F.concat_ws(":", "repo", "path").alias("path"), "run_id", "hash")
    return rows.groupBy("path").agg(F.max(F.struct("run_id", "hash")).alias("r")).select("path", "r.hash")


def _listed(spark, d):
    rows = changes.latest(table(spark, d, "files")).where("hash is not null")
    return rows.select(F.concat_ws(":", "repo", "path").alias("path"), "hash", "seq")


def changed_files(spark, d):
    return state.changed(_listed(spark, d), _state(spark, d)).select("seq", "path", "hash")


def unchanged_files(spark, d):
    return state.unchanged(_listed(spark, d), _state(spark, d)).select("seq", "path", "hash")


def state_upsert(spark, d):
    return state.upsert(_state(spark, d), _listed(spark, d))


def comment_lines(spark, d):
    rows = _chunks(spark, d).where("type = 'comments'")
    return rows.select("seq", "chunk_idx", F.array_join(F.transform("comments", lambda c: F.concat(F.lit("Line "), c["line"].cast("string"), F.lit(": "), c["text"])), "\n").alias("joined"))


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, d, n) for n in ("files", "hashes", "processed", "runs"))


def p2_found(spark, d):
    """All tables taken into the change log of a new folder and processed by its batches."""
    files, hashes, processed, runs = _tables(spark, d)
    held = changes.ChangedFiles(spark, scratch(spark, "changes"))
    held.deliver(files, hashes, processed, "tables")
    return held.pending(runs).select("seq")


def p2_committed(spark, d):
    return changes.committed(*_tables(spark, d)[1:])


def p2_replayed(spark, d):
    """The listing in three deliveries, whose times lie across each other, by batches of which one is lost before its result is written and one after it."""
    folder = scratch(spark, "changes")
    log = changes.ChangeLog(spark, f"{folder}/log")
    run = changes.ChangeRun(spark, f"{folder}/sink", log, changes.KEY, ["listed_us", "seq", "hash"])
    files = table(spark, d, "files").where("seq is not null and hash is not null and listed_at is not null")
    rows = files.select(
        "seq", "repo", changes.relative_path(F.col("path"), F.col("repo")).alias("path"), changes.hash_key(F.col("hash")).alias("hash"),
        F.unix_micros(F.col("listed_at").cast("timestamp")).alias("listed_us"),
    )
    for n in range(3):
        delivery = rows.where(F.pmod(F.xxhash64("seq", "listed_us", "hash"), F.lit(3)) == n)  # the three together are all rows
        log.append(delivery, f"part{n}")
        log.append(delivery, f"part{n}")  # a delivery that comes again counts once
        if n:
            plan = run.plan()
            if n == 2:
                run.write(plan, run.rows(plan))
        while run.run(lambda batch: batch):
            pass
    run.compact()
    return run.result().select("repo", "path", "seq", "hash", "listed_us")


QUERIES = [
    p2_found, p2_committed, p2_replayed, word_counts, line_counts, stripped, file_md5, text_pieces, file_routes, ignored_files, pruned_files, large_files,
    markdown_sections, html_chunks, css_rules, python_chunks, file_chunks, chunk_texts, section_texts, strict_texts, pack_bins, pack_files,
    file_metadata, run_summary, entry_count, changed_files, unchanged_files, state_upsert, comment_lines, *trees.QUERIES,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_NL = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
_STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^[{X.WS}]+', ''), '[{X.WS}]+$', '')"
_WORDS = lambda c: f"CAST(len(regexp_extract_all({c}, '[^{X.WS}]+')) AS INTEGER)"
_COUNT = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_SUFFIX = lambda c: f"regexp_extract({c}, '(?s)^.+(\\.[^.]+)$', 1)"
_SUBDIR = lambda s: f"CASE {s} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUBDIRS.items()) + " ELSE 'other' END"
_ONCE = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY seq, chunk_idx ORDER BY loaded_at) = 1)"
_REL = (
    "regexp_replace(CASE WHEN regexp_matches(p, '^([A-Za-z]:)?/') AND instr(p, '/' || repo || '/') > 0 THEN substring(p, instr(p, '/' || repo || '/') + length(repo) + 2) ELSE p END, '^(\\./)+', '')"
)
_SLASHED = "regexp_replace(replace(path, '\\', '/'), '/{2,}', '/', 'g')"
_LATEST = f"""
latest AS (
  SELECT seq, repo, {_REL} AS path, hash, listed_at FROM (
    SELECT seq, repo, {_SLASHED} AS p, nullif(lower(trim(hash)), '') AS hash, listed_at FROM files WHERE seq IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY seq ORDER BY listed_at DESC NULLS LAST, nullif(lower(trim(hash)), '') DESC NULLS LAST, repo DESC NULLS LAST, path DESC NULLS LAST) = 1))
"""
_COMMITTED = f"""
log AS (SELECT run_id, repo, {_REL} AS path, nullif(lower(trim(hash)), '') AS hash, saved_at FROM (SELECT *, {_SLASHED} AS p FROM hashes) WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'ok')),
done AS (SELECT DISTINCT run_id, repo, {_REL} AS path FROM (SELECT *, {_SLASHED} AS p FROM processed)),
held AS (
  SELECT repo, path, hash, run_id AS "offset" FROM log WHERE EXISTS (SELECT 1 FROM done d WHERE d.run_id = log.run_id AND d.repo = log.repo AND d.path = log.path)
  QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY run_id DESC, saved_at DESC NULLS LAST, hash DESC NULLS LAST) = 1)
"""
_STATE = "state AS (SELECT concat_ws(':', repo, path) AS path, hash FROM hashes QUALIFY row_number() OVER (PARTITION BY concat_ws(':', repo, path) ORDER BY run_id DESC, hash DESC NULLS LAST) = 1)"
_LISTED = "listed AS (SELECT concat_ws(':', repo, path) AS path, hash, seq FROM latest WHERE hash IS NOT NULL)"
_BINS = """
sized AS (SIZED),
numbered AS (SELECT *, row_number() OVER (ORDER BY seq, chunk_idx) AS i, sum(words) OVER (ORDER BY seq, chunk_idx ROWS UNBOUNDED PRECEDING) AS upto FROM sized),
starts AS (
  SELECT CAST(0 AS BIGINT) AS bin, CAST(1 AS BIGINT) AS i, CAST(0 AS HUGEINT) AS base
  UNION ALL
  SELECT s.bin + 1, n.i, n.upto - n.words FROM starts s, LATERAL (SELECT i, upto, words FROM numbered WHERE i > s.i AND upto - s.base > LIMIT_ ORDER BY i LIMIT 1) n),
binned AS (SELECT n.seq, n.chunk_idx, n.subdir, n.words, s.bin FROM numbered n ASOF JOIN starts s ON n.i >= s.i)
"""
_DOC = lambda title: f"'{title}: ' || coalesce(name, 'None') || CASE WHEN coalesce(docstring, '') <> '' THEN chr(10) || 'Docstring:' || chr(10) || docstring ELSE '' END || chr(10) || 'Code:' || chr(10) || coalesce(code, 'None')"
_ESC = lambda c: f"replace(replace(replace(replace({c}, '\\', '\\\\'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r')"
_REPR = lambda c: f"""CASE WHEN {c} IS NULL THEN 'None' WHEN contains({c}, '''') AND NOT contains({c}, '"') THEN '"' || {_ESC(c)} || '"' ELSE '''' || replace({_ESC(c)}, '''', '\\''') || '''' END"""
_FORMATTED = f"""
CASE type WHEN 'function' THEN {_DOC('Function')} WHEN 'class' THEN {_DOC('Class')}
WHEN 'comments' THEN 'Comments:' || chr(10) || coalesce(array_to_string(list_transform(comments, lambda c: 'Line ' || c.line || ': ' || coalesce(c.text, 'None')), chr(10)), '')
WHEN 'file' THEN 'File: ' || coalesce(name, 'None') || chr(10) || 'Content:' || chr(10) || coalesce(content, '')
WHEN 'html_script' THEN 'HTML Script:' || chr(10) || coalesce(content, '') WHEN 'html_style' THEN 'HTML Style:' || chr(10) || coalesce(content, '')
WHEN 'css_rule' THEN 'CSS Rule:' || chr(10) || coalesce(content, '') END
"""
_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
_SCRIPT, _STYLE, _RULE = "(?is)<script[^>]*>(.*?)</script>", "(?is)<style[^>]*>(.*?)</style>", chunkers.RULE
_PLAIN = "CASE WHEN header IS NOT NULL THEN header || chr(10) ELSE '' END || coalesce(content, '')"
_MAPPED = "'Unknown chunk type:' || chr(10) || CASE WHEN type IS NULL THEN '{''header'': ' || (" + _REPR("header") + ") ELSE '{''type'': ' || (" + _REPR("type") + ") END || ', ''content'': ' || (" + _REPR("coalesce(content, '')") + ") || '}'"

_BODIES = f"list_concat(list_transform(regexp_extract_all(u, '{_SCRIPT}', 1), lambda b: 'HTML Script:' || chr(10) || {_STRIP('b')}), list_transform(regexp_extract_all(u, '{_STYLE}', 1), lambda b: 'HTML Style:' || chr(10) || {_STRIP('b')}))"
_LONE = lambda kind: f"['Unknown chunk type:' || chr(10) || '{{''type'': ''{kind}'', ''content'': ' || ({_REPR('u')}) || '}}']"
_HTML_TEXTS = f"CASE WHEN len({_BODIES}) > 0 THEN {_BODIES} ELSE {_LONE('html')} END"
_RULES = f"list_transform(list_filter(string_split(regexp_replace(u, '{_RULE}', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)), lambda p: contains(p, '{{') AND {_STRIP('p')} <> ''), lambda p: 'CSS Rule:' || chr(10) || {_STRIP('p')})"
_CSS_TEXTS = f"CASE WHEN len({_RULES}) > 0 THEN {_RULES} ELSE {_LONE('css')} END"
#: Sections: a mark before each line that begins one, then header and body of each part.
_PARTS = "list_filter(string_split(substring(replace(chr(10) || u, chr(10) || '#', chr(10) || chr(57344) || '#'), 2), chr(57344)), lambda p: p <> '')"
_HEAD, _BODY = _STRIP("split_part(p, chr(10), 1)"), "CASE WHEN contains(p, chr(10)) THEN substring(p, instr(p, chr(10)) + 1) ELSE '' END"
_RARE = lambda c: f"regexp_replace({c}, '[\\x0b\\x0c\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '_', 'g')"  # noqa: E731  blanks that print as escapes, which split no words
_MD_TEXTS = f"list_transform(list_filter({_PARTS}, lambda p: starts_with(p, '#') OR {_STRIP('p')} <> ''), lambda p: 'Unknown chunk type:' || chr(10) || '{{''header'': ' || CASE WHEN starts_with(p, '#') THEN ({_REPR(_RARE(_HEAD))}) ELSE 'None' END || ', ''content'': ' || CASE WHEN starts_with(p, '#') THEN ({_REPR(_RARE(_BODY))}) ELSE ({_REPR(_RARE('p'))}) END || '}}')"
_SIZED = f"SELECT seq, chunk_idx, subdir, CAST({_WORDS('formatted')} AS BIGINT) AS words FROM (SELECT seq, chunk_idx, subdir, coalesce({_FORMATTED}, {_MAPPED}) AS formatted FROM {_ONCE})"
_PACKED = _BINS.replace("SIZED", _SIZED).replace("LIMIT_", str(MAX_WORDS))
#: The tree: a file for each document; rules of the ignore files, which hold in either run.
_TREE = f"""
docs AS (SELECT coalesce(lang, 'none') || '/' || doc_id || '_' || coalesce({_NAME}, 'unnamed') AS path, doc_id || '_' || coalesce({_NAME}, 'unnamed') AS name, text, octet_length(encode(text)) AS size, md5(text) AS hash, length(text) AS chars FROM documents WHERE text IS NOT NULL),
extra(path, size, hash, chars) AS (VALUES ('.gitignore', {len(trees.GITIGNORE)}, md5({_QUOTED(trees.GITIGNORE)}), {len(trees.GITIGNORE)}), ('.dockerignore', 6, md5({_QUOTED(trees.DOCKERIGNORE)}), 6), ('bad.js', 1, '8d39dd7eef115ea6975446ef4082951f', NULL), ('bad.txt', 1, '8d39dd7eef115ea6975446ef4082951f', NULL), ('x.log', 1, md5('x'), 1)),
tree AS (SELECT path, name, size, hash, chars, text FROM docs UNION ALL SELECT path, path, size, hash, chars, CASE path WHEN '.gitignore' THEN {_QUOTED(trees.GITIGNORE)} WHEN '.dockerignore' THEN {_QUOTED(trees.DOCKERIGNORE)} WHEN 'x.log' THEN 'x' END FROM extra),
ruled AS (SELECT *, {_SUFFIX('name')} AS suffix FROM tree WHERE NOT CASE WHEN ends_with(path, '.log') THEN true WHEN regexp_matches(path, '^typescript/[^/]*_b[^/]*$') THEN true WHEN ends_with(path, '_clamp.cfg') THEN false ELSE ends_with(path, '.cfg') END)
"""
_COMMAND = f"""{_TREE},
read AS (SELECT *, {_NL} AS u, suffix <> '' AND text IS NOT NULL AND length(name) % 3 = 1 AS known FROM ruled WHERE NOT regexp_matches(path, '^c/[^/]*_k[^/]*\\.c$')),
kept AS (SELECT * FROM read WHERE size <= {trees.MAX_SIZE}), done AS (SELECT * FROM kept WHERE NOT known AND path <> 'bad.js')
"""

ORACLES: dict[str, str] = {
    "p2_found": f"WITH {_LATEST}, {_COMMITTED} SELECT l.seq FROM latest l LEFT JOIN held h ON l.repo = h.repo AND l.path = h.path WHERE l.hash IS NOT NULL AND (h.hash IS NULL OR h.hash <> l.hash)",
    "p2_committed": f"WITH {_COMMITTED} SELECT * FROM held",
    "p2_replayed": f"""WITH log AS (SELECT DISTINCT repo, {_REL} AS path, seq, nullif(lower(trim(hash)), '') AS hash, epoch_us(listed_at) AS listed_us FROM (SELECT *, {_SLASHED} AS p FROM files) WHERE seq IS NOT NULL AND hash IS NOT NULL AND listed_at IS NOT NULL)
SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY listed_us DESC, seq DESC, hash DESC) = 1""",
    "word_counts": f"SELECT doc_id, {_WORDS('text')} AS words FROM documents",
    "line_counts": f"""SELECT doc_id, CAST({_COUNT('u', f'[{X.LINE_ENDS}]')} + CASE WHEN u <> '' AND NOT regexp_matches(u, '[{X.LINE_ENDS}]$') THEN 1 ELSE 0 END AS INTEGER) AS split,
CAST({_COUNT('u', chr(92) + 'n')} + CASE WHEN u <> '' AND NOT ends_with(u, chr(10)) THEN 1 ELSE 0 END AS INTEGER) AS read, CAST({_COUNT('u', chr(92) + 'n')} + 1 AS INTEGER) AS counted FROM (SELECT doc_id, {_NL} AS u FROM documents)""",
    "stripped": f"SELECT doc_id, {_STRIP('text')} AS stripped FROM documents",
    "file_md5": "SELECT doc_id, md5(text) AS hash FROM documents",
    "text_pieces": "SELECT doc_id, CAST(i AS INTEGER) AS idx, array_to_string(list_slice(string_split(text, ''), i * 4096 + 1, i * 4096 + 4096), '') AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(length(text) / 4096.0) AS BIGINT) - 1)) AS i FROM documents WHERE length(text) > 0)",
    "file_routes": f"SELECT DISTINCT seq, name, {_SUFFIX('name')} AS suffix, {_SUBDIR(_SUFFIX('name'))} AS subdir, name IN ({', '.join(repr(n) for n in DOCUMENTATION)}) AS is_doc FROM files",
    "ignored_files": """SELECT DISTINCT seq, path FROM files WHERE CASE
WHEN regexp_matches(path, '(^|/)[^/]*\\.min\\.css(/|$)') THEN true WHEN regexp_matches(path, '(^|/)node_modules/.') THEN true WHEN regexp_matches(path, '(^|/)[ab][^/]*_[^/]*\\.yaml(/|$)') THEN true
WHEN regexp_matches(path, '(^|/)vendor/.') THEN true WHEN regexp_matches(path, '^tools/[^/]*/[^/]*\\.c(/|$)') THEN true WHEN regexp_matches(path, '^docs/(.+/)?[^/]*\\.md(/|$)') THEN false
WHEN regexp_matches(path, '(^|/)docs/.') THEN true WHEN regexp_matches(path, '(^|/)[^/]*\\.env(/|$)') THEN true ELSE false END""",
    "pruned_files": "SELECT DISTINCT seq, path FROM files WHERE len(list_filter(string_split(path, '/')[:-2], lambda s: s IN ('node_modules', 'dist', 'build'))) > 0",
    "large_files": f"SELECT DISTINCT seq, path, size FROM files WHERE size > {MAX_SIZE}",
    "markdown_sections": f"""WITH lines AS (SELECT doc_id, i, l, CASE WHEN i < n THEN l || chr(10) ELSE l END AS whole, sum(CASE WHEN starts_with(l, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (
  SELECT doc_id, unnest(string_split(u, chr(10))) AS l, generate_subscripts(string_split(u, chr(10)), 1) AS i, len(string_split(u, chr(10))) AS n FROM (SELECT doc_id, {_NL} AS u FROM documents WHERE lang = 'markdown' AND text IS NOT NULL))),
sections AS (SELECT doc_id, s, min(i) AS i, max(CASE WHEN starts_with(l, '#') THEN {_STRIP('l')} END) AS header, coalesce(string_agg(CASE WHEN NOT starts_with(l, '#') THEN whole END, '' ORDER BY i), '') AS content FROM lines GROUP BY doc_id, s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS idx, header, content FROM sections WHERE header IS NOT NULL OR {_STRIP('content')} <> ''""",
    "html_chunks": f"""WITH found AS (SELECT doc_id, u, list_concat(list_transform(regexp_extract_all(u, '{_SCRIPT}', 1), lambda b: {{'type': 'html_script', 'content': {_STRIP('b')}}}), list_transform(regexp_extract_all(u, '{_STYLE}', 1), lambda b: {{'type': 'html_style', 'content': {_STRIP('b')}}})) AS c
  FROM (SELECT doc_id, {_NL} AS u FROM documents WHERE lang = 'html' AND text IS NOT NULL)),
made AS (SELECT doc_id, CASE WHEN len(c) > 0 THEN c ELSE [{{'type': 'html', 'content': u}}] END AS c FROM found)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, c[i].type AS type, c[i].content AS content FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM made)""",
    "css_rules": f"""WITH cut AS (SELECT doc_id, u, list_transform(list_filter(string_split(regexp_replace(u, '{_RULE}', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)), lambda p: contains(p, '{{') AND {_STRIP('p')} <> ''), lambda p: {{'type': 'css_rule', 'content': {_STRIP('p')}}}) AS c
  FROM (SELECT doc_id, {_NL} AS u FROM documents WHERE lang = 'css' AND text IS NOT NULL)),
made AS (SELECT doc_id, CASE WHEN len(c) > 0 THEN c ELSE [{{'type': 'css', 'content': u}}] END AS c FROM cut)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, c[i].type AS type, c[i].content AS content FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM made)""",
    "file_chunks": f"""SELECT doc_id, CAST(0 AS INTEGER) AS chunk_idx, {_SUBDIR('suffix')} AS subdir, name, u AS content, CAST({_COUNT('u', chr(92) + 'n')} + 1 AS INTEGER) AS lines
FROM (SELECT doc_id, {_NL} AS u, {_NAME} AS name, {_SUFFIX(_NAME)} AS suffix FROM documents WHERE text IS NOT NULL) WHERE coalesce(suffix, '') NOT IN ('.py', '.md', '.markdown', '.html', '.css')""",
    "chunk_texts": f"SELECT seq, chunk_idx, formatted, {_WORDS('formatted')} AS words FROM (SELECT seq, chunk_idx, {_FORMATTED} AS formatted FROM {_ONCE} WHERE type IN ('function', 'class', 'comments', 'file', 'html_script', 'html_style', 'css_rule'))",
    "section_texts": f"SELECT seq, chunk_idx, formatted, {_WORDS('formatted')} AS words FROM (SELECT seq, chunk_idx, {_MAPPED} AS formatted FROM {_ONCE} WHERE type IS NULL OR type IN ('html', 'css'))",
    "strict_texts": f"SELECT seq, chunk_idx, formatted, {_WORDS('formatted')} AS words FROM (SELECT seq, chunk_idx, {_PLAIN} AS formatted FROM {_ONCE} WHERE type IS NULL)",
    "pack_bins": f"WITH RECURSIVE {_PACKED} SELECT seq, chunk_idx, words, bin FROM binned",
    "pack_files": f"""WITH RECURSIVE {_PACKED}, per AS (SELECT bin, arg_min(subdir, (seq, chunk_idx)) AS first, sum(words)::BIGINT AS words, count(*) AS chunks FROM binned GROUP BY bin),
placed AS (SELECT bin, coalesce(lead(first) OVER (ORDER BY bin), 'remaining') AS subdir, words, chunks FROM per)
SELECT bin, subdir, CAST(row_number() OVER (PARTITION BY subdir ORDER BY bin) - 1 AS INTEGER) AS file_idx, subdir || '/chunk_' || (row_number() OVER (PARTITION BY subdir ORDER BY bin) - 1) || '.txt' AS rel_file, words, chunks FROM placed""",
    "file_metadata": f"""WITH {_LATEST}, sized AS ({_SIZED}), per AS (SELECT seq, count(*) AS chunks, sum(words)::BIGINT AS words FROM sized GROUP BY seq),
logged AS (SELECT repo, {_REL} AS path, run_id, logged_at, size, lines FROM (SELECT *, {_SLASHED} AS p FROM processed)),
last AS (SELECT * FROM logged QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY run_id DESC NULLS LAST, logged_at DESC NULLS LAST, size DESC NULLS LAST, lines DESC NULLS LAST) = 1)
SELECT f.seq, f.repo, f.path, coalesce(p.chunks, 0) AS chunks, coalesce(p.words, 0) AS words, coalesce(l.size, -1) AS size, CAST(coalesce(l.lines, -1) AS INTEGER) AS lines FROM latest f LEFT JOIN per p USING (seq) LEFT JOIN last l ON f.repo = l.repo AND f.path = l.path""",
    "run_summary": f"SELECT count(DISTINCT seq) AS total_files_processed, coalesce(sum(words), 0)::BIGINT AS total_words FROM ({_SIZED})",
    "tree_listing": f"""WITH {_TREE} SELECT path, name, {_SUFFIX('name')} AS suffix, false AS is_dir, CAST(size AS BIGINT) AS size FROM tree
UNION ALL SELECT DISTINCT regexp_extract(path, '^[^/]*'), regexp_extract(path, '^[^/]*'), '', true, CAST(0 AS BIGINT) FROM docs""",
    "tree_source": f"WITH {_TREE} SELECT path, name, {_SUFFIX('name')} AS suffix, CAST(size AS BIGINT) AS size, hash, CAST(coalesce(chars, -1) AS BIGINT) AS chars, chars IS NULL AS failed FROM tree",
    "tree_processed": f"""WITH {_COMMAND}, chunked AS (
  SELECT path, size, suffix, u, CASE WHEN u IS NULL THEN 0 WHEN suffix = '.py' THEN {_COUNT('u', f'[{X.LINE_ENDS}]')} + CASE WHEN u <> '' AND NOT regexp_matches(u, '[{X.LINE_ENDS}]$') THEN 1 ELSE 0 END
    WHEN suffix IN ('.md', '.markdown') THEN {_COUNT('u', chr(92) + 'n')} + CASE WHEN u <> '' AND NOT ends_with(u, chr(10)) THEN 1 ELSE 0 END ELSE {_COUNT('u', chr(92) + 'n')} + 1 END AS lines,
    CASE WHEN u IS NULL THEN [] WHEN suffix = '.html' THEN {_HTML_TEXTS} WHEN suffix = '.css' THEN {_CSS_TEXTS} WHEN suffix IN ('.md', '.markdown') THEN {_MD_TEXTS} WHEN suffix = '.py' THEN NULL
    ELSE ['File: ' || name || chr(10) || 'Content:' || chr(10) || u] END AS texts FROM done)
SELECT path, CAST(size AS BIGINT) AS size, CAST(lines AS BIGINT) AS lines, CAST(coalesce(len(texts), -1) AS BIGINT) AS chunks, CAST(coalesce(list_sum(list_transform(texts, lambda t: {_WORDS('t')})), CASE WHEN texts IS NOT NULL THEN 0 ELSE -1 END) AS BIGINT) AS words FROM chunked""",
    "tree_skipped": f"""WITH {_COMMAND} SELECT path, true AS absolute, 'File exceeds size limit' AS reason FROM read WHERE size > {trees.MAX_SIZE}
UNION ALL SELECT path, false, 'Unchanged file (hash match)' FROM kept WHERE known UNION ALL SELECT path, true, 'Error processing file' FROM kept WHERE path = 'bad.js'""",
    "tree_hashes": f"""WITH {_COMMAND} SELECT path, hash FROM done
UNION ALL SELECT path, CASE WHEN length(name) % 3 = 1 THEN hash ELSE repeat('0', 32) END FROM tree WHERE text IS NOT NULL AND {_SUFFIX('name')} <> '' AND length(name) % 3 <> 0 AND path NOT IN (SELECT path FROM done)
UNION ALL SELECT 'gone/x.py', repeat('1', 32)""",
    "tree_summary": f"WITH {_COMMAND} SELECT count(*) AS files, true AS words_add_up FROM done",
    "tree_texts": f"""WITH RECURSIVE {_TREE},
whole AS (SELECT row_number() OVER (ORDER BY encode(path)) AS seq, 0 AS chunk_idx, {_SUBDIR('suffix')} AS subdir, 'File: ' || name || chr(10) || 'Content:' || chr(10) || {_NL} AS formatted FROM ruled WHERE text IS NOT NULL AND suffix NOT IN ('.py', '.md', '.markdown', '.html', '.css')),
{_BINS.replace('SIZED', f"SELECT seq, chunk_idx, subdir, formatted, CAST({_WORDS('formatted')} AS BIGINT) AS words FROM whole").replace('LIMIT_', str(trees.MAX_WORDS))},
per AS (SELECT bin, arg_min(b.subdir, b.seq) AS first, sum(b.words)::BIGINT AS words, count(*) AS chunks, string_agg(formatted || chr(10) || chr(10), '' ORDER BY b.seq) AS text FROM binned b JOIN whole USING (seq) GROUP BY bin),
placed AS (SELECT bin, coalesce(lead(first) OVER (ORDER BY bin), 'remaining') AS subdir, words, chunks, text FROM per)
SELECT subdir || '/chunk_' || (row_number() OVER (PARTITION BY subdir ORDER BY bin) - 1) || '.txt' AS rel_file, words, chunks, {_WORDS('text')} AS said, md5(text) AS hash FROM placed""",
    "python_modules": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else _QUOTED(v) for v in row) + ")" for row in trees.WANTED) + ") AS t(file, chunk_idx, type, name, docstring, code, methods, said, lines)",
    "python_again": f"""SELECT seq, chunk_idx, type, regexp_extract(code, '^(?:def|class)[ ]+([A-Za-z0-9_]+)', 1) AS name, docstring, code, CASE WHEN type = 'class' THEN array_to_string(list_transform(methods, lambda m: m.name), ',') END AS methods FROM {_ONCE} WHERE type IN ('function', 'class') AND code IS NOT NULL""",
    "entry_count": "SELECT count(DISTINCT seq) AS entries FROM files",
    "changed_files": f"WITH {_LATEST}, {_LISTED}, {_STATE} SELECT seq, path, hash FROM listed l WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.path = l.path AND s.hash = l.hash)",
    "unchanged_files": f"WITH {_LATEST}, {_LISTED}, {_STATE} SELECT seq, path, hash FROM listed l WHERE EXISTS (SELECT 1 FROM state s WHERE s.path = l.path AND s.hash = l.hash)",
    "state_upsert": f"WITH {_LATEST}, {_LISTED}, {_STATE} SELECT path, hash FROM state s WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.path = s.path) UNION ALL SELECT path, hash FROM listed",
    "comment_lines": f"SELECT seq, chunk_idx, array_to_string(list_transform(comments, lambda c: 'Line ' || c.line || ': ' || c.text), chr(10)) AS joined FROM {_ONCE} WHERE type = 'comments'",
}
