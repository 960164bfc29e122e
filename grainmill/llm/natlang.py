"""Natural language hidden in source code (problem 5).

1. Comments, docstrings and string literals are lexed out of every chunk and cut into sentences;
   comments over several lines and literals put together from pieces are joined, escapes are
   read. The source around them, broken into the words of its identifiers, makes the code class.
2. Sentences with words of a short list for just one language are the labelled rows. They give
   unigram counts over the subwords of a public tokenizer's vocabulary, and a prior, for each
   language; the identifiers give the counts of the code class, candidates without a label its
   prior. Vocabulary and languages bound the table of counts, whatever the size of the corpus.
3. Every sentence, labelled or not, gets the class with the greatest posterior. What goes to the
   code class is no sentence. Scripts that belong to one language decide by themselves.
   ``held_out`` measures the classifier on labelled sentences it hasn't seen, without the words
   that labelled them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowmap import map_batches
from ..session import shipped, stage
from .tokenize import vocabulary

SUFFIXES = (".py", ".js", ".ts", ".java", ".c", ".cpp", ".css", ".html")
#: How comments are marked in files of each suffix, those of ``SUFFIXES`` and others.
KINDS = {
    **dict.fromkeys((".py", ".pyi", ".yaml", ".yml", ".toml", ".sh", ".env", ".ini", ".cfg", ".conf", ".rb", ".pl", ".r"), "py"),
    **dict.fromkeys((".js", ".jsx", ".mjs", ".ts", ".tsx", ".java", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".go", ".rs", ".kt", ".swift", ".scala", ".php", ".json", ".html", ".xml", ".vue"), "c"),
    **dict.fromkeys((".css", ".scss"), "css"), **dict.fromkeys((".sql", ".lua", ".hs"), "sql"),
}
CODE = "code"
#: Words, or characters of scripts written without blanks, that make a sentence.
WORDS, SIGNS = 5, 10
#: Share of the parts between blanks that are plain words in a sentence.
MOSTLY = 0.6

#: Common words of languages in Latin script, without marks; some belong to several.
SEEDS = {
    "en": "the and every before when until this because which without from after this that",
    "de": "der die das wird und nicht wenn weil oder eine erst nach den obwohl",
    "fr": "le la les est une avant pour sans qui des quand apres dans meme",
    "es": "el la se una los antes sin para porque cuando hasta aunque siempre cada",
    "pt": "os nao uma antes para porque quando ate embora sempre cada mais",
    "it": "il la viene una prima della per che quando anche senza questo questa nella",
    "nl": "de het wordt een niet voordat omdat als ook zodat deze naar nog eerst",
    "pl": "jest zostaje nie przed gdy poniewaz zeby nawet ta ten kazdy od po tylko",
    "tr": "bu bir her once sonra icin kadar degil hemen olan ile daha cok dosya",
    "sv": "och att det som inte innan eftersom nar utan efter varje den blir alltid",
    "cs": "je se pred kdyz protoze kazdy nebo tento bez jeste pro aby ktery vzdy",
    "ro": "este si nu pentru inainte cand fara dupa fiecare acest daca sau din care",
    "id": "yang dan tidak untuk sebelum ketika karena setelah dari ini setiap dengan adalah akan",
}
#: Scripts that decide by themselves, by what the name of a letter begins with.
SCRIPTS = {"HANGUL": "ko", "HIRAGANA": "ja", "KATAKANA": "ja", "CJK": "zh", "CYRILLIC": "ru", "GREEK": "el", "ARABIC": "ar", "HEBREW": "he", "DEVANAGARI": "hi", "THAI": "th"}

_STR = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`"
_TRIPLE = r"\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''"
#: A triple-quoted literal that the text ends in.
_OPEN = r"\"\"\"[\s\S]*\Z|'''[\s\S]*\Z"
LEX = {
    "py": re.compile(rf"(?P<c>#[^\n]*(?:\n[ \t]*#[^\n]*)*)|(?P<s>(?:{_TRIPLE}|{_OPEN}|{_STR})(?:[ \t]*(?:\+|\\)?\s*[rRbBuUfF]{{0,2}}(?:{_TRIPLE}|{_STR}))*)"),
    "c": re.compile(rf"(?P<c>//[^\n]*(?:\n[ \t]*//[^\n]*)*)|(?P<b>/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z))|(?P<s>(?:{_STR})(?:\s*\+?\s*(?:{_STR}))*)"),
    "css": re.compile(r"(?P<b>/\*[\s\S]*?(?:\*/|\Z))"),
    "sql": re.compile(rf"(?P<c>--[^\n]*(?:\n[ \t]*--[^\n]*)*)|(?P<b>/\*[\s\S]*?(?:\*/|\Z))|(?P<s>(?:{_STR}))"),
}
PIECE = re.compile(rf"{_TRIPLE}|{_OPEN}|{_STR}")
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|([nrt])|(\n)|(.))|&#(\d{2,7});|&#[xX]([0-9a-fA-F]{2,6});|\\([0-9a-fA-F]{4,6}) ?")
STOP = re.compile(r"(?<=[.!?…])[\"')\]]{0,3}\s+(?=\S)|[。！？]+|\n[ \t]*\n|(?<=[;:])\s*\n")
#: Lines that are no part of a sentence: tags of documentation, items of its sections, examples, rules.
LINE = re.compile(r"\s*(?:@\w+\b.*|:\w+[^:]*:.*|(?:args?|arguments|parameters?|returns?|raises?|yields?|examples?|notes?)\s*:\s*|(?!(?:todo|note|fixme|xxx|nb|hack|warning|important)\b)\*{0,2}(?-i:[a-z_])\w*\s*(?:\([^)]*\))?:\s+\S.*|>>>.*|\.\.\. .*|!?/\S.*|[-=~*#_/\\]{2,}\s*|-----.*)$", re.I)
MARKER = re.compile(r"^\W*(?:(?:todo|fixme|xxx|nb|note|hack|warning|important)\b\W+)*", re.I)
#: What a sentence doesn't hold: characters and sequences, words it doesn't begin with, and patterns by a character that they need.
NEVER = ("{", "}", "<", ">", "://", "==", "!=", "&&", "||", "::", ");")
QUERY = frozenset("SELECT INSERT UPDATE CREATE DELETE ALTER DROP WITH MERGE GRANT".split())
PATTERNS = [
    (ch, re.compile(p))
    for ch, p in (("(", r"\w\("), ("=", r"\b\w+\s*(?:[-+*/%|&^])?=\s*\S"), ("_", r"\w_\w"), ("$", r"\$\w"), (" -", r"\s--?\w"), ("%", r"%\w\b.*%\w"))
]


def codelike(s: str) -> bool:
    """Does a text look like code, a query, a command or a path?"""
    if s[-1] == ";" or s[0] in "$>%/~" or s[:2] == "./":
        return True
    for x in NEVER:
        if x in s:
            return True
    if s.partition(" ")[0] in QUERY:
        return True
    return any(ch in s and p.search(s) for ch, p in PATTERNS)


PURE = re.compile(r"(?:^|(?<=\s))[(\"'“‘«¿¡]*[^\W\d_]+(?:['’-][^\W\d_]+)*[)\"'”’».,;:!?…]*(?=\s|$)")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        for g in (1, 2, 3, 4, 9, 10):
            if m[g]:
                n = int(m[g], 16)
                return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "
        if m[8]:
            return chr(int(m[8])) if int(m[8]) < 0x110000 and not 0xD800 <= int(m[8]) < 0xE000 else " "
        return {"n": "\n", "r": "\n", "t": " "}.get(m[5], "") if m[5] else "" if m[6] else m[7] or ""

    return ESCAPE.sub(one, text) if "\\" in text or "&#" in text else text


def units(text: str, how: str, around: list[str] | None = None) -> Iterator[str]:
    """Comments and literals of a source text, without their marks; ``around`` gets the source around them."""
    last = 0
    for m in chain(LEX[how].finditer(text), (None,)):
        if around is not None:
            around.append(text[last : m.start() if m else len(text)])
        if not m:
            return
        last, t = m.end(), m.group()
        if len(t) < SIGNS or t.isascii() and len(t.split(None, WORDS - 1)) < WORDS and "\\" not in t and "&#" not in t:
            continue
        if m.lastgroup == "c":
            yield re.sub(r"(?m)^[ \t]*(?:#+[:!]?|//+[/!]?|--+)", "", t)
        elif m.lastgroup == "b":
            yield re.sub(r"(?m)^[ \t]*\*+", "", re.sub(r"\A(?:/\*+!?|<!--)|(?:\*+/|-->)\Z", "", t))
        else:
            parts = []
            for p in PIECE.findall(t):
                parts.append(p[3:-3] if p[:3] in ('"""', "'''") and len(p) >= 6 else p[1:-1])
            yield re.sub(r"\$?\{[^{}\n]{0,60}\}", " ", unescape("".join(parts)))


def sentences(unit: str) -> Iterator[str]:
    """Sentences of a comment or literal that are long enough and don't look like code."""
    lines = [x for x in unit.replace("\r", "").split("\n")]
    if len(lines) > 1:
        unit = "\n".join("" if LINE.match(x) or (y := x.strip()) and codelike(y) else x for x in lines)
    for s in STOP.split(unit):
        parts = s.split()
        wide = 0 if s.isascii() else len(WIDE.findall(s))
        if wide < SIGNS and len(parts) < WORDS:
            continue
        s = " ".join(parts)
        if s[0] in "!?" or s[:9].isupper() or ":" in s[:12] or s[:3].upper() in ("NB ", "XXX", "TOD", "NOT", "HAC", "FIX", "WAR", "IMP"):
            s = MARKER.sub("", s)
        if not s or codelike(s):
            continue
        if wide >= SIGNS or len(WORD.findall(s)) >= WORDS:
            yield s


def script(s: str) -> str | None:
    """The language of a sentence by its script, or null for Latin script."""
    if s.isascii():
        return None
    found = Counter()
    latin = 0
    for ch in s:
        if ch.isalpha():
            if ch < "\u0250":
                latin += 1
            else:
                found[SCRIPTS.get(unicodedata.name(ch, "").split(" ")[0].split("-")[0])] += 1
    found.pop(None, None)
    if not found:
        return None
    if found["ja"] and found["ja"] + found["zh"] >= found.most_common(1)[0][1]:
        found["ja"] += found.pop("zh", 0)
    lang, n = found.most_common(1)[0]
    if lang == "ru" and re.search(r"[іїєґІЇЄҐ]", s) and not re.search(r"[ыэъЫЭЪ]", s):
        lang = "uk"
    return lang if n * 2 >= latin else None


def plain(word: str) -> str:
    """A word in lower case without marks."""
    w = word.lower()
    if w.isascii():
        return w
    w = w.replace("ı", "i").replace("ł", "l").replace("ß", "ss").replace("ø", "o").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def mostly_words(s: str) -> bool:
    return len(PURE.findall(s)) >= max(WORDS - 1, MOSTLY * len(s.split()))


@lru_cache(maxsize=1)
def _seeds() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for lang, words in SEEDS.items():
        for w in words.split():
            out[w] = (*out.get(w, ()), lang)
    return out


def seeded(words: list[str]) -> str | None:
    """The one language whose common words a sentence has, at least two and more than any other has."""
    held, votes = _seeds(), Counter()
    for w in words:
        for lang in held.get(w, ()):
            votes[lang] += 1
    top = votes.most_common(2)
    if not top or top[0][1] < 2 or len(top) > 1 and top[1][1] >= top[0][1]:
        return None
    return top[0][0]


@lru_cache(maxsize=2)
def subwords(path: str):
    """A function from a word to the ids of its subwords, with a memory."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("subwords", pat_str=r"\s*\S+", mergeable_ranks=ranks, special_tokens={})

    @lru_cache(maxsize=1 << 18)
    def of(word: str) -> tuple[int, ...]:
        return tuple(enc.encode_ordinary(" " + word))

    return of


def broken(name: str) -> list[str]:
    """The words of an identifier."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]


def extracted(chunks: DataFrame, path: str, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """``(seq, chunk_idx, text, token, n)``: sentences with how often each stands in a chunk, and for the code class the counts of subwords of all identifiers, summed within each batch."""

    def make():
        of = subwords(path)

        def each(seqs, idxs, paths, kinds, texts, docs, comments):
            words: Counter = Counter()
            for seq, idx, path, kind, text, doc, said in zip(seqs, idxs, paths, kinds, texts, docs, comments):
                how = KINDS[path[path.rfind(".") :]]
                got: Counter = Counter()
                if said:
                    block: list[str] = []
                    last = None
                    for c in said:
                        line, t = c.get("line"), c.get("text") or ""
                        if last is None or line != last + 1:
                            got.update(sentences("\n".join(block)))
                            block = []
                        block.append(t)
                        last = line
                    got.update(sentences("\n".join(block)))
                if doc and not text:
                    got.update(sentences(doc))
                if text:
                    how = "css" if kind in ("css_rule", "html_style", "css") else how
                    around: list[str] | None = [] if kind not in ("css_rule", "html_style") else None
                    for u in units(text, how, around):
                        got.update(sentences(u))
                    words.update(broken(" ".join(around or ())))
                for s, n in got.items():
                    yield seq, idx, s, None, n
            total: Counter = Counter()
            for w, n in words.items():
                for t in of(w):
                    total[t] += n
            for t, n in total.items():
                yield None, None, None, t, n

        return each

    suffix = F.regexp_extract("path", r"(\.[^./\\]+)$", 1)
    rows = chunks.where(F.col("seq").isNotNull() & suffix.isin(*(set(suffixes) & set(KINDS)))).select("seq", "chunk_idx", "path", "type", F.coalesce("code", "content").alias("text"), "docstring", "comments")
    return map_batches(rows, make, "seq bigint, chunk_idx int, text string, token int, n bigint")


def label(text: str) -> tuple[str | None, list[str]] | None:
    """The language that seed words give a candidate in Latin script, and its words; null for what is no candidate."""
    if script(text) is not None or not mostly_words(text):
        return None
    words = [plain(w) for w in WORD.findall(text)]
    return seeded(words), words


def counts(found: DataFrame, path: str) -> DataFrame:
    """``(class, token, n)``: unigram counts of subwords by language and for code, summed within tasks first; token -1 counts candidates, labelled by language or not."""

    def run(batches):
        import pyarrow as pa

        of, total = subwords(path), Counter()
        for batch in batches:
            words: dict[str, Counter] = {}
            for text in batch.column(0).to_pylist():
                held = label(text)
                if held:
                    total[held[0] or CODE, -1] += 1
                    if held[0]:
                        words.setdefault(held[0], Counter()).update(held[1])
            for lang, ws in words.items():
                for w, n in ws.items():
                    for t in of(w):
                        total[lang, t] += n
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["class", "token", "n"])

    said = shipped(found).where("text is not null").select("text").mapInArrow(run, "class string, token int, n bigint")
    code = found.where("token is not null").select(F.lit(CODE).alias("class"), "token", "n")
    return said.unionByName(code).groupBy("class", "token").agg(F.sum("n").alias("n"))


class Model:
    """Posterior of classes under unigram counts, with additive smoothing."""

    def __init__(self, rows: list[tuple[str, int, int]], path: str, smooth: float = 0.1, size: int = 50256):
        self.path, self.classes = path, sorted({r[0] for r in rows} | {CODE, "en"})
        at = {c: k for k, c in enumerate(self.classes)}
        table: dict[int, np.ndarray] = {}
        total, met = np.zeros(len(self.classes)), np.ones(len(self.classes))
        for c, t, n in rows:
            if t < 0:
                met[at[c]] += n
                continue
            table.setdefault(t, np.zeros(len(self.classes)))[at[c]] += n
            total[at[c]] += n
        self.none = np.log(smooth / (total + smooth * size))
        self.table = {t: np.log((v + smooth) / (total + smooth * size)) for t, v in table.items()}
        self.prior = np.log(met / met.sum())
        self.words: dict[str, np.ndarray] = {}

    def best(self, words: list[str]) -> str:
        """The class with the greatest posterior."""
        return self.classes[int(np.argmax(sum((self.word(w) for w in words), self.prior)))]

    def word(self, w: str) -> np.ndarray:
        if w not in self.words:
            if len(self.words) > 1 << 18:
                self.words.clear()
            self.words[w] = sum((self.table.get(t, self.none) for t in subwords(self.path)(w)), np.zeros(len(self.classes)))
        return self.words[w]

    def classify(self, sentence: str) -> str | None:
        """The language of a sentence, null for the code class."""
        by_script = script(sentence)
        if by_script:
            enough = len(WIDE.findall(sentence)) >= SIGNS if by_script in ("zh", "ja") else len(WORD.findall(sentence)) >= WORDS
            return by_script if enough else None
        words = [plain(w) for w in WORD.findall(sentence)]
        if len(words) < WORDS or not mostly_words(sentence):
            return None
        best = self.best(words)
        return None if best == CODE else best


def classified(chunks: DataFrame, path: str | None = None, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """``(seq, chunk_idx, lang, text, n)`` of every sentence in comments, docstrings and literals, with how often it stands in the chunk.

    Files with other suffixes, null and empty texts hold none; repeated chunks give equal rows;
    very long texts are read whole; other columns are not read.
    """
    path = path or vocabulary("byte_bpe_multi_50k.tiktoken")
    found = stage(extracted(chunks, path, suffixes), "sentences")
    shared = _trained(found, path)

    def make():
        model = _model(shared.value, path, id(shared))

        def each(seqs, idxs, texts, ns):
            for seq, idx, text, n in zip(seqs, idxs, texts, ns):
                lang = model.classify(text)
                if lang:
                    yield seq, idx, lang, text, n

        return each

    return map_batches(found.where("text is not null").select("seq", "chunk_idx", "text", "n"), make, "seq bigint, chunk_idx int, lang string, text string, n bigint")


def _trained(found: DataFrame, path: str):
    """The counts, sent to all tasks: at most the vocabulary times the classes."""
    return found.sparkSession.sparkContext.broadcast([tuple(r) for r in counts(found, path).collect()])


def held_out(chunks: DataFrame, path: str | None = None, part: int = 5) -> DataFrame:
    """``(lang, sentences, right, right_without)`` on a ``part``-th of the labelled sentences, by a model of the others.

    ``right_without``: the words of all seed lists are taken out of the sentence first.
    """
    path = path or vocabulary("byte_bpe_multi_50k.tiktoken")
    found = stage(extracted(chunks, path), "sentences")
    kept_out = F.pmod(F.xxhash64("text"), F.lit(part)) == 0
    shared = _trained(found.where("token is not null").unionByName(found.where(F.col("text").isNotNull() & ~kept_out)), path)

    def make():
        model = _model(shared.value, path, id(shared))

        def each(texts):
            for text in texts:
                held = label(text)
                if held and held[0]:
                    rest = [w for w in held[1] if w not in _seeds()]
                    if rest:
                        yield held[0], int(model.best(held[1]) == held[0]), int(model.best(rest) == held[0])

        return each

    rows = map_batches(found.where(F.col("text").isNotNull() & kept_out).select("text").distinct(), make, "lang string, a int, b int")
    return rows.groupBy("lang").agg(F.count("*").alias("sentences"), F.avg("a").alias("right"), F.avg("b").alias("right_without"))


_held: dict = {}


def _model(rows, path: str, key: int) -> Model:
    if _held.get("key") != (key, path, len(rows)):
        _held.clear()
        _held.update(key=(key, path, len(rows)), model=Model(rows, path))
    return _held["model"]


def languages(chunks: DataFrame, path: str | None = None) -> DataFrame:
    """``(seq, lang)`` of every file and language it holds a sentence of, distinct."""
    return classified(chunks, path).select("seq", "lang").distinct()


def shares(chunks: DataFrame, path: str | None = None, suffixes: Iterable[str] = tuple(KINDS)) -> DataFrame:
    """``(seq, lang, sentences, chars, share)`` of every file whose comments are known how to find.

    A sentence counts as often as it stands there; a chunk delivered twice counts once. ``share``
    is the part of the characters of the file's chunks.
    """
    said = classified(chunks, path, suffixes).groupBy("seq", "chunk_idx", "lang", "text").agg(F.max("n").alias("n"))
    said = said.groupBy("seq", "lang").agg(F.sum("n").alias("sentences"), F.sum(F.col("n") * F.length("text")).alias("chars"))
    sizes = chunks.where("seq is not null").dropDuplicates(["seq", "chunk_idx"]).groupBy("seq").agg(
        F.sum(F.coalesce(F.length(F.coalesce("code", "content")), F.lit(0)) + F.coalesce(F.aggregate("comments", F.lit(0), lambda a, c: a + F.coalesce(F.length(c["text"]), F.lit(0))), F.lit(0))).alias("size")
    )
    return said.join(sizes, "seq").withColumn("share", F.when(F.col("size") > 0, F.least(F.lit(1.0), F.col("chars") / F.col("size"))).otherwise(F.lit(0.0))).drop("size")
