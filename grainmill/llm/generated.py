"""Generated, minified and vendored source files (problem 6).

One pass over the chunks lexes every text into tokens, normalised: words in lower case, one token
for all numbers and one for all literals, no comments and no white space. Runs of ``K`` tokens
are hashed and winnowed, the least hash of every ``WINDOW`` runs kept. A fingerprint recurs if it
is found in other repositories unrelated to the file's own, and a file whose fingerprints largely
recur is a copy. Forks are no unrelated repositories: those that have most of their paths in
common count as one. Fingerprints are counted by repository first, so that one that a third of
all rows holds is combined before the shuffle.

The same pass yields signs that a file carries in itself: a generator's mark in a comment line of
its own, a library's banner, text without blanks on very long lines, mostly data, the form of a
lock or map file. Files without content are judged by path. Each sign has its own name.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowmap import map_batches
from ..session import stage
from .spans import _rolling, _sliding_min

#: Tokens of a run, runs of which one is kept.
K, WINDOW = 12, 16
#: Other unrelated repositories in which a fingerprint recurs: this many at least, and this part of all.
OTHERS, RATE = 2, 1e-4
#: Share of a file's fingerprints that recur in a copy, and how many a file has at least to be judged by them.
SHARE, LEAST = 0.8, 12
#: Parts that a join on fingerprints is spread over, besides the fingerprints.
SALTS = 8
#: Share of data from which on a file is a blob of data.
DATA_SHARE = 0.68
#: Share of white space below which, and length of a line from which on, text is minified.
BLANKS, LONG = 0.1, 300
#: Suffixes of files that signs are looked for in; fingerprints are made of all.
SOURCE = ("py", "js", "ts", "jsx", "tsx", "mjs", "cjs", "java", "c", "h", "cc", "cpp", "hpp", "css", "html")

#: Folders that hold other people's code or built files.
FOLDERS = r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|vendors|vendored|third[_-]?party|extern|externals?|Pods|deps|dist|build|site-packages)/"
#: Names that tools give to what they make, and names of copies of a library's release.
NAMES = (
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|yarn\.lock|go\.sum|[^/]*[._-]lock(?:file)?(?:\.(?:json|ya?ml|toml))?)$"
    r"|\.map$|[._-](?:min|prod)\.[a-z]+$|[._-]bundle\.[a-z]+$|\.chunk\.[a-z]+$"
    r"|_pb2(?:_grpc)?\.pyi?$|\.pb\.[a-z.]+$|[._](?:gen|generated|g|designer|autogen)\.[a-z]+$"
    r"|(?:^|/)[A-Za-z]\w*-v?\d+[._]\d+[._]\d+(?:[-._][^/]*)?\.[a-z]+$"
)
#: How a generator's mark begins, in several languages.
MARK = re.compile(
    r"(?i)(?:code (?:auto-?)?generated by\b|auto-?generated\b|<auto-?generated|@(?:auto-?)?generated\b|machine[- ]generated\b|automatically (?:generated|created|produced)\b"
    r"|this (?:file|code|source|module) (?:was|is|has been) (?:automatically |auto-?|machine[- ])?(?:generated|produced|created)\b|generated (?:by|from|with|using|automatically|code|file)\b"
    r"|do not (?:edit|modify|change)\b.*\bre-?generate|(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)\b|diese datei wurde\b.*\b(?:generiert|erzeugt)|generiert (?:von|durch|aus)\b"
    r"|fichier (?:produit|généré|genere|créé|cree) (?:par|automatiquement)\b|(?:code )?généré (?:par|automatiquement)\b|(?:archivo|fichero|código|codigo) generado\b|generado (?:automáticamente|automaticamente|por)\b"
    r"|(?:arquivo|ficheiro|código|codigo) gerado\b|gerado (?:automaticamente|por)\b|(?:file|codice) generato\b|generato (?:automaticamente|da)\b|(?:automatisch )?gegenereerd (?:door|uit)\b|(?:dit bestand is )?automatisch gegenereerd"
    r"|(?:plik |kod )?wygenerowan\w+|(?:файл |код )?(?:автоматически )?сгенерирован|создан автоматически|автоматически создан|.{0,12}(?:自动生成|自動生成)|.{0,12}자동(?:으로)? ?생성|(?:bu dosya )?otomatik (?:olarak )?(?:oluştur|üretil|olustur|uretil))"
)
BANNER = re.compile(r"\s*(?:/\*!?|//!?|#|\"\"\"|'''|<!--)\s*!?\s*@?[\w./-]+ v?\d+\.\d+(?:\.\d+)?\S* (?:\||-|\(c\)|–)\s*(?:\(c\)|MIT|BSD|Apache|ISC|GPL|LGPL|MPL|Unlicense|zlib|license|licence)", re.I)
BANNER_TEXT = re.compile(r"!?\s*@?[\w./-]+ v?\d+\.\d+(?:\.\d+)?\S* (?:\||-|–)\s*(?:MIT|BSD|Apache|ISC|GPL|LGPL|MPL|Unlicense|zlib)\b", re.I)
LEAD = re.compile(r"^[ \t]*(?://+|#+|/\*+!?|\*+|<!--|--|;+|%+)[ \t]*(?P<said>\S[^\n]*)", re.M)
DATA = re.compile(r"(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?)[uUlLfF]*\s*,\s*){8,}|[A-Za-z0-9+/=_-]{64,}|(?:\\x[0-9a-fA-F]{2}|\\\d{3}){8,}|(?:[0-9a-fA-F]{2}\s+){16,}")


_STR = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
MARKUP = re.compile(r"<!--[\s\S]*?(?:-->|\Z)")
#: Comments and literals, which normalised text is without.
ASIDE = {
    "py": re.compile(rf"#[^\n]*|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|{_STR}"),
    "css": re.compile(r"/\*[\s\S]*?(?:\*/|\Z)"),
    "c": re.compile(rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z)|{_STR}"),
}


def without_asides(text: str, kind: str | None, suffix: str) -> str:
    """Source text with a quotation mark in place of each comment and literal; of markup without its comments."""
    if text.lstrip()[:1] == "<":
        return MARKUP.sub("", text)
    return ASIDE["py" if suffix == "py" else "css" if suffix == "css" or kind == "html_style" else "c"].sub('"', text)


def signs(kind: str | None, text: str | None, comments: list[dict] | None, suffix: str) -> str | None:
    """What a chunk says about how its file came to be, or null."""
    if comments:
        for c in comments:
            said = (c or {}).get("text") or ""
            if MARK.match(said):
                return "mark of a generator"
            if (c.get("line") or 0) <= 3 and BANNER_TEXT.match(said):
                return "banner of a library"
    if not text or suffix not in SOURCE and suffix not in ("json", "yaml", "lock", "map"):
        return None
    if kind in ("function", "class"):
        return None
    if suffix in ("json", "yaml", "lock", "map"):
        if re.search(r"\"?(?:lockfileVersion|lockVersion|lockfile_version)\"?\s*:", text) and text.count("integrity") + text.count("resolved") > 1:
            return "lock file"
        if "\"mappings\"" in text and "\"sources\"" in text and re.search(r"\"version\"\s*:\s*3", text):
            return "map file"
        return None
    if kind == "file":
        if BANNER.match(text):
            return "banner of a library"
        for m in LEAD.finditer(text):
            if MARK.match(m["said"]):
                return "mark of a generator"
        if sum(len(m.group()) for m in DATA.finditer(text)) >= DATA_SHARE * len(text):
            return "data"
    if len(text) >= LONG and max(map(len, text.split("\n"))) >= LONG and kind in ("file", "html_script", "html_style", "css_rule", "css"):
        bare = without_asides(text, kind, suffix)
        if len(bare) >= LONG and max(map(len, bare.split("\n"))) >= LONG and len(bare) - sum(map(len, bare.split())) < BLANKS * len(bare):
            return "minified"
    return None


_LITERAL = r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?"
_REST = r"|\d[\w.]*|[^\W\d]\w*|[^\s\w]"
#: Tokens by language: with ``#`` before a comment, with ``/*`` alone, with both kinds of slashes.
TOKENS = {
    "#": re.compile(rf"#[^\n]*|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|{_LITERAL}{_REST}"),
    "css": re.compile(rf"/\*[\s\S]*?(?:\*/|\Z)|{_LITERAL}{_REST}"),
    "c": re.compile(rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z)|{_LITERAL}{_REST}"),
}
HASHED = ("py", "rb", "sh", "bash", "yaml", "yml", "toml", "ini", "cfg", "conf", "properties", "env", "r", "pl", "mk", "cmake")
COMMENTS = ("//", "/*", "<!-")


class Codes(dict):
    """The number of each token: 1 for numbers, 2 for literals, 0 for comments, of others a hash."""

    def __init__(self, hashed: bool):
        super().__init__()
        self.hashed = hashed

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first in "\"'`":
            return 2  # not remembered: literals are many
        if first == "#" and self.hashed and len(token) > 1 or len(token) > 1 and token[:3].startswith(COMMENTS):
            return 0
        code = self[token] = 0 if first == "#" and self.hashed else 1 if first.isdigit() else zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) | 4
        return code


@lru_cache(maxsize=2)
def _codes(hashed: bool) -> Codes:
    return Codes(hashed)


def tokens(text: str, kind: str | None = "file", suffix: str = "js") -> np.ndarray:
    """The normalised tokens of a text as numbers."""
    how = "#" if suffix in HASHED else "css" if suffix == "css" or kind == "html_style" else "c"
    codes = _codes(how == "#")
    if len(codes) > 1 << 19:
        codes.clear()
    got = np.fromiter(map(codes.__getitem__, TOKENS[how].findall(text)), np.uint32)
    return got[got > 0]


def fingerprints(text: str, kind: str | None = "file", suffix: str = "js") -> np.ndarray:
    """The winnowed hashes of a text, each once."""
    points = tokens(text, kind, suffix)
    if len(points) < K:
        return np.empty(0, np.int64)
    h = _rolling(points, K)
    return np.unique(_sliding_min(h, min(WINDOW, len(h)))).view(np.int64)


EVIDENCE = "seq bigint, chunk_idx int, repo string, sign string, print bigint, prints int"


def evidence(chunks: DataFrame) -> DataFrame:
    """A row for each sign of a chunk (``sign``), each of its fingerprints (``print``), and how many it has (``prints``)."""

    def make():
        def each(seqs, idxs, repos, paths, kinds, texts, comments):
            for seq, idx, repo, path, kind, text, said in zip(seqs, idxs, repos, paths, kinds, texts, comments):
                suffix = (path or "").rpartition(".")[2]
                sign = signs(kind, text, said, suffix)
                if sign:
                    yield seq, idx, repo, sign, None, None
                if text:
                    held = fingerprints(text, kind, suffix).tolist()
                    if held:
                        yield seq, idx, repo, None, None, len(held)
                        for p in held:
                            yield seq, idx, repo, None, p, None

        return each

    rows = chunks.where("seq is not null").select("seq", "chunk_idx", "repo", "path", "type", F.coalesce("code", "content").alias("text"), "comments")
    return map_batches(rows, make, EVIDENCE)


def by_path(*tables: DataFrame) -> DataFrame:
    """``(seq, sign)`` of every file whose path says enough; each table has seq and path."""
    path = F.regexp_replace("path", r"\\", "/")
    sign = F.when(path.rlike(FOLDERS), "folder of others' code").when(path.rlike(NAMES), "name of a made file")
    parts = [t.select("seq", sign.alias("sign")).where("sign is not null and seq is not null") for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def families(files: DataFrame) -> DataFrame:
    """``(repo, family)``: repositories that are copies of each other get the same family, as likely as a path of either is one of both.

    The family is the least hash of the paths of a repository. Unrelated repositories have few
    paths in common; those of forks are nearly the same.
    """
    return files.where("path is not null").groupBy(F.coalesce("repo", F.lit("")).alias("repo")).agg(F.min(F.xxhash64("path")).alias("family"))


def recurring(found: DataFrame, related: DataFrame, others: int = OTHERS, rate: float = RATE, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``(seq)`` of every file of the evidence whose fingerprints largely recur in other, unrelated repositories."""
    prints = found.where("print is not null")
    repo = F.coalesce("repo", F.lit("")).alias("repo")
    least_of = related.agg(F.greatest(F.lit(others), F.ceil(F.count_distinct("family") * F.lit(rate))).alias("others"))
    per = prints.groupBy("print", repo).agg(F.lit(1).alias("one")).join(related, "repo", "left").groupBy("print", F.coalesce("family", F.xxhash64("repo")).alias("family")).agg(F.lit(1).alias("one"))
    known = per.groupBy("print").agg(F.count("*").alias("n")).crossJoin(F.broadcast(least_of)).where("n > others").select("print")  # one row
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = prints.select("seq", "chunk_idx", "print", F.pmod(F.xxhash64("seq", "chunk_idx"), F.lit(SALTS)).cast("int").alias("salt"))
    hits = mine.join(known, ["print", "salt"]).select("seq", "chunk_idx", "print").distinct().groupBy("seq").agg(F.count("*").alias("hits"))
    sizes = found.where("prints is not null").groupBy("seq", "chunk_idx").agg(F.max("prints").alias("n")).groupBy("seq").agg(F.sum("n").alias("n"))
    return hits.join(sizes, "seq").where((F.col("hits") >= share * F.col("n")) & (F.col("n") >= least)).select("seq")


def not_handwritten(files: DataFrame, chunks: DataFrame, skipped: DataFrame | None = None, others: int = OTHERS, rate: float = RATE, share: float = SHARE) -> DataFrame:
    """``(seq, signs)`` of every file that was not written by hand, ``signs`` sorted.

    ``files(seq, repo, path)``, ``chunks`` (seq, chunk_idx, repo, path, type, code, content,
    comments) and ``skipped(repo, path)``, whose paths may be absolute or use other separators; a
    skipped path counts through the file it names. Null texts and paths say nothing; files with
    null repo count as one repository; repeated rows count once; very long texts are read whole.
    """
    found = stage(evidence(chunks), "evidence")
    own = found.where("sign is not null").select("seq", "sign")
    copies = recurring(found, families(files.select("repo", "path")), others, rate, share).withColumn("sign", F.lit("recurs in other repositories"))
    paths = by_path(files.select("seq", "path"), chunks.select("seq", "path"))
    rows = own.unionByName(copies).unionByName(paths)
    if skipped is not None:
        from ..operators.changes import relative_path

        named = skipped.select("repo", relative_path(F.col("path"), F.col("repo")).alias("path")).distinct()
        named = named.where(F.col("path").rlike(FOLDERS) | F.col("path").rlike(NAMES))
        rows = rows.unionByName(files.select("seq", "repo", "path").join(named, ["repo", "path"], "left_semi").select("seq", F.lit("skipped by path").alias("sign")))
    return rows.where("seq is not null").groupBy("seq").agg(F.sort_array(F.collect_set("sign")).alias("signs"))
