"""Source files that do not parse (problem 7).

A lexer for each language reads the text once with a pushdown stack of open delimiters. It finds
merge-conflict markers outside comments and literals, unterminated literals and comments,
delimiters that do not match, text that ends inside a delimiter, characters the language does not
have, and neighbouring tokens that no statement of the language has (which is how a file with the
suffix of another language shows). Of conditional groups of the preprocessor one branch is read.
JSON is parsed whole by its pushdown automaton, at any depth; what the lexer for Python passes is
then parsed by Python's own parser. The other languages stay lexical: a file that breaks a rule of
types or of deep syntax alone passes.
"""

from __future__ import annotations

import ast
import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowmap import map_batches

#: Suffixes and the names of their languages.
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".c": "c", ".cpp": "cpp", ".json": "json"}

CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?: [^\n]*)?(?=\n|\Z)|={7}(?=\r?\n|\Z)")
CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}"}

_PY = re.compile(
    r"(?P<c>#[^\n]*)|(?P<l>[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*'))"
    r"|(?P<b>[()\[\]{}])|(?P<q>\"\"\"|'''|[\"'])|(?P<n>\n)|(?P<w>[^\n\"'#()\[\]{}rRbBuUfF]+|[rRbBuUfF]+)", re.S
)


def lex_python(text: str) -> str | None:
    stack: list[str] = []
    at, fresh = 0, True
    while at < len(text):
        if fresh and text[at] in "<>=|" and CONFLICT.match(text, at):
            return "conflict marker"
        m = _PY.match(text, at)
        kind, t = m.lastgroup, m.group()
        if kind == "b":
            if t in "([{":
                stack.append(t)
            elif not stack or CLOSES[stack.pop()] != t:
                return "unbalanced delimiter"
        elif kind == "q":
            return "unterminated literal"
        fresh = kind == "n"
        at = m.end()
    return "premature end" if stack else None


_JSON = re.compile(r"[ \t\r\n]*(?:(?P<l>\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4})*\")|(?P<w>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true|false|null)|(?P<b>[\[\]{}])|(?P<p>[,:])|(?P<q>\")|(?P<x>[^ \t\r\n]))")


#: What may come next in JSON: a value; a value or the end of an array; a name or the end of an object; a name; the colon; a comma or the end; nothing.
VALUE, ITEM, MEMBER, NAME, COLON, COMMA, DONE = range(7)


def lex_json(text: str) -> str | None:
    """JSON by a pushdown automaton, without recursion."""
    stack: list[str] = []
    at, end, want = 0, len(text.rstrip(" \t\r\n")), VALUE
    while at < end:
        m = _JSON.match(text, at)
        kind, t = m.lastgroup, m[m.lastgroup]
        at = m.end()
        if kind == "q":
            return "unterminated literal"
        if kind == "x":
            begin = m.start("x")
            return "conflict marker" if (begin == 0 or text[begin - 1] == "\n") and CONFLICT.match(text, begin) else "foreign character"
        if t in ("]", "}"):
            if not stack or CLOSES[stack[-1]] != t:
                return "unbalanced delimiter"
            if want not in (COMMA, ITEM if t == "]" else MEMBER):
                return "grammar"
            stack.pop()
        elif kind == "p":
            if want != (COLON if t == ":" else COMMA) or not stack:
                return "grammar"
            want = VALUE if t == ":" or stack[-1] == "[" else NAME
            continue
        elif kind == "l" and want in (MEMBER, NAME):
            want = COLON
            continue
        elif want not in (VALUE, ITEM):
            return "grammar"
        elif t in ("[", "{"):
            stack.append(t)
            want = ITEM if t == "[" else MEMBER
            continue
        want = COMMA if stack else DONE
    return None if want == DONE else "premature end"


def exact(text: str) -> str | None:
    """What Python's parser has against a text that its lexer passed; nesting that is too deep for it is a fault, as it is where it counts brackets."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (RecursionError, MemoryError):
        return "too deep"
    except (SyntaxError, ValueError):
        return "grammar"
    return None


def _words(s: str) -> frozenset[str]:
    return frozenset(s.split())


#: Reserved words and words that may stand before another word.
JAVA = _words(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto "
    "if implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while record sealed permits non yield var module requires exports when true false null"
)
C = _words(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed "
    "sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Atomic _Static_assert _Noreturn _Thread_local _Alignas "
    "_Generic bool true false nullptr typeof constexpr static_assert thread_local alignas alignof __attribute__ __inline __extension__ __restrict asm"
)
CPP = C | _words(
    "class namespace template typename public private protected virtual override final new delete this throw try catch using operator friend explicit "
    "mutable const_cast static_cast dynamic_cast reinterpret_cast decltype noexcept concept requires co_await co_return co_yield export import module "
    "and or not xor wchar_t char8_t char16_t char32_t consteval constinit typeid"
)
JS = _words(
    "async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in "
    "instanceof let new of return set static super switch this throw try typeof var void while with yield as true false null enum using accessor"
)
TS = JS | _words(
    "abstract declare implements interface is keyof module namespace never override private protected public readonly type unique infer asserts satisfies global require out"
)
KEYWORDS = {".java": JAVA, ".c": C, ".cpp": CPP, ".js": JS, ".ts": TS}
#: Words whose right neighbour is no operand of theirs, so that a word or value may follow them anywhere.
STATEMENTS = _words("return if for while switch break continue case default do else throw try catch finally goto var let const")
PARENS = _words("if for while switch catch")
#: Words that begin definitions in other languages.
FOREIGN = {
    ".java": _words("function def elif fn func fun let const typedef struct namespace using template include"),
    ".c": _words("function def elif fn func fun let class package import public private namespace using template interface"),
    ".cpp": _words("function def elif fn func fun let package interface"),
    ".js": _words("def elif fn func fun package public private protected struct typedef namespace interface int void"),
    ".ts": _words("def elif fn func fun package struct typedef int"),
}
_STR = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
_OPS = (
    r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|->\*|<=>|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|->|::|\*\*|[-+*/%=<>!~?:;,.&|^@]"
)
_TOKEN = re.compile(
    r"[ \t\r\f\v ]*(?:(?P<w>[A-Za-z_$ª-῿Ⰰ-ￜ\U00010000-\U0003ffff][\w$]*(?:\.[A-Za-z_$][\w$]*)*)|(?P<n>\.?\d(?:[eEpP][+-]|[\w.]|'\w)*)|(?P<e>\n)"
    rf"|(?P<s>\"\"\"[\s\S]*?\"\"\"|{_STR})|(?P<c>//(?:[^\n\\]|\\\n?)*|/\*[\s\S]*?\*/)|(?P<b>[()\[\]{{}}])|(?P<t>`)|(?P<u>/\*|[\"'])|(?P<o>{_OPS})|(?P<h>#)|(?P<x>[\s\S])|\Z)"
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_RAW = re.compile(r"\"([^()\\\s]{0,16})\(")
_DIRECTIVE = re.compile(r"(?:[^\n\\]|\\[\s\S])*")
BINARY = frozenset("= == === != !== + - / % | || ^ += -= *= /= %= &= |= ^= <= >= ?? ** <<= >>= >>>= **= &&= ||= ??= => . ?. -> ::".split())
#: Binary operators that no operand begins with.
INFIX = frozenset("= == === != !== % | || ^ += -= *= /= %= &= |= ^= <= >= ?? ** <<= >>= >>>= **= &&= ||= ??= ?. ->".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split())


_CONDITION = re.compile(r"#[ \t]*(?P<word>ifdef|ifndef|if|elifdef|elifndef|elif|else|endif)\b(?P<rest>[^\n]*)")
_NEVER = re.compile(r"[ \t]*\(?[ \t]*(?:0|false)[ \t]*\)?[ \t]*(?:/[/*].*)?\r?$")


def past_group(text: str, at: int) -> tuple[int, str] | str:
    """Where the next directive of the same condition stands after ``at``, and its word; groups inside are passed over. Text: what is wrong in between."""
    depth = 0
    while (at := text.find("\n", at)) >= 0:
        at += 1
        if text[at : at + 1] and text[at] in "<>=|" and CONFLICT.match(text, at):
            return "conflict marker"
        begin = at
        while begin < len(text) and text[begin] in " \t":
            begin += 1
        m = _CONDITION.match(text, begin)
        if not m:
            continue
        if m["word"].startswith("if"):
            depth += 1
        elif depth:
            depth -= m["word"] == "endif"
        else:
            return begin, m["word"]
    return "premature end"


def lex_braces(text: str, suffix: str) -> str | None:
    """The lexer of the languages with braces."""
    keywords, foreign = KEYWORDS[suffix], FOREIGN[suffix]
    script, native, strict = suffix in (".js", ".ts"), suffix in (".c", ".cpp"), suffix in (".c", ".cpp", ".java")
    stack: list[tuple[str, str, bool, int]] = []  # opener, token before it, of a statement's head or block, questions open
    kind, prev, before, line_end = "", ";", "", False  # of the last token; a line break since
    kind2 = ""  # of the one before
    block = True  # the last closing bracket ended a block or a head
    runs = 0  # words on end
    questions = declared = 0
    conditions: list[bool] = []  # of the preprocessor: was a branch read
    match, at, n = _TOKEN.match, 0, len(text)
    if script and text.startswith("#!"):
        at = text.find("\n")
        if at < 0:
            return None
    if text.startswith(("<<<<<<<", "=======", ">>>>>>>")) and CONFLICT.match(text):
        return "conflict marker"
    while at < n:
        m = match(text, at)
        k = m.lastgroup
        if k is None:
            break
        at = m.end()
        if k == "e":
            line_end = True
            if at < n and text[at] in "<>=|" and CONFLICT.match(text, at):
                return "conflict marker"
            continue
        if k == "c":
            if "\n" in m["c"]:
                line_end = True
            continue
        t = m[k]
        operand = kind in ("w", "n", "s") and prev not in STATEMENTS or prev in (")", "]") and not block
        if k == "h":
            begin = m.start("h")
            if native and not text[text.rfind("\n", 0, begin) + 1 : begin].strip():
                at = _DIRECTIVE.match(text, begin).end()
                m = _CONDITION.match(text, begin)
                if m:  # of each condition the first branch is read that isn't switched off
                    word, skip = m["word"], False
                    if word.startswith("if"):
                        skip = bool(word == "if" and _NEVER.match(m["rest"]))
                        conditions.append(not skip)
                    elif not conditions:
                        return "unbalanced delimiter"
                    elif word == "endif":
                        conditions.pop()
                    else:
                        skip = conditions[-1] or word == "elif" and bool(_NEVER.match(m["rest"]))
                        conditions[-1] = conditions[-1] or not skip
                    if skip:
                        found = past_group(text, begin)
                        if isinstance(found, str):
                            return found
                        at = found[0]
                continue
            if script and re.compile(r"#[A-Za-z_$]").match(text, begin) and (prev in (".", "?.", "{", "}", ";", "static", "get", "set", "async") or line_end):
                continue
            return "foreign character"
        if k == "x":
            return "foreign character"
        if k == "u":
            return "unterminated literal"
        if k == "s":
            if suffix == ".cpp" and prev in ("R", "LR", "uR", "UR", "u8R") and t[0] == '"' and (raw := _RAW.match(text, m.start("s"))):
                close = text.find(f"){raw[1]}\"", raw.end())
                if close < 0:
                    return "unterminated literal"
                at = close + len(raw[1]) + 2
                kind = kind2 = ""
                operand = False
            elif t.startswith('"""') and suffix != ".java":
                at, t = m.start("s") + 2, '""'
            elif suffix == ".java" and t[0] == "'" and not re.fullmatch(r"'(?:[^\\]|\\(?:u+\w{4}|[0-7]{1,3}|.))'", t):
                return "unterminated literal"
            if operand and not line_end and not (kind == "w" and (prev in keywords or native)) and not (kind == "s" and native):
                return "grammar"
        elif k == "t":
            if not script:
                return "foreign character"
            part = _TEMPLATE.match(text, at)
            if not part:
                return "unterminated literal"
            at = part.end()
            if part[1] == "${":
                stack.append(("${", prev, False, questions))
                questions = 0
                kind2, kind, before, prev, line_end, block, runs = kind, "o", prev, "(", False, True, 0
                continue
            k, t = "s", "`"
        elif k == "n":
            if operand and not line_end and not (kind == "w" and prev in keywords):
                return "grammar"
        elif k == "w":
            head = t.partition(".")[0]
            if kind in ("n", "s") and not line_end and t not in keywords and not (kind == "s" and native):
                return "grammar"
            if t in foreign and at < n and re.compile(r"[ \t]+[A-Za-z_$]").match(text, at) and (prev in (";", "{", "}") or line_end):
                return "grammar"
            if prev in BINARY and prev not in ("=>", "->", "::", ".", "?.") and t in STATEMENTS and t != "default":
                return "grammar"
            if t in PARENS and not (prev in (".", "?.") or script and prev in ("{", ",")) and not re.compile(r"[ \t\r\n]*(?:\(|await\b|constexpr\b|/[/*]|:)").match(text, at) and not (t == "catch" and re.compile(r"\s*\{").match(text, at)):
                return "grammar"
            if kind == "w" and not line_end:
                runs += 1
                plain, plain_before = head not in keywords, prev.partition(".")[0] not in keywords
                if script and plain and plain_before:
                    return "grammar"
                if not script and plain and plain_before and kind2 == "w" and before not in keywords and before != "":
                    return "grammar"
            else:
                runs = 0
            if strict and line_end and stack and stack[-1][0] == "{" and stack[-1][2] and operand and prev != "\n" and not declared:
                if kind == "w" and (before == "@" or prev in keywords or t in ("extends", "implements", "throws", "permits")) or prev.isupper() or t in ("const", "noexcept", "override", "final", "instanceof", "throws", "implements", "extends", "requires"):
                    pass
                elif not (kind == "w" and kind2 != "w" and before in (";", "{", "}", ":", "")) or prev not in keywords:
                    if not (prev == ")" and (suffix == ".cpp" or block)):
                        return "grammar"
            if suffix == ".java" and line_end and not stack and operand and kind == "w" and before != "@" and prev not in keywords and t not in ("extends", "implements", "permits") and prev != "\n":
                return "grammar"
        elif k == "b":
            if t in "([{":
                if t == "{":
                    of = prev in (")", ";", "{", "}", "else", "do", "try", "finally", "=>", ":", "->", "catch") or kind in ("w",) or prev == ">" or prev == "]"
                    if prev in ASSIGN or prev in ("(", ",", "[", "return", "?", "in", "of", "default") or prev == ":" and questions:
                        of = False
                    if prev in ("let", "const", "var", "import", "export", "from", "type") and script:
                        of = False
                    if kind == "w" and before in ("enum",) or prev == "]" and strict or kind == "w" and prev == "enum":
                        of = False
                    if suffix == ".c" and kind == "w" and kind2 == "w" and prev not in keywords and before not in keywords:
                        return "grammar"
                    stack.append((t, prev, of, questions))
                    questions = 0
                else:
                    operands = native and stack and stack[-1][0] == "(" and stack[-1][1] in ("asm", "__asm__", "__asm", "volatile", "__volatile__", "goto", "inline")
                    if t == "(" and kind in ("n", "s") and not line_end and prev != "`" and not operands:
                        return "grammar"
                    stack.append((t, prev, t == "(" and kind == "w" and prev in ("if", "for", "while", "switch", "catch", "with", "synchronized"), questions))
                    questions = 0
                kind2, kind, before, prev, line_end, runs, declared = kind, "b", prev, t, False, 0, 0
                continue
            if not stack:
                return "unbalanced delimiter"
            opener, opened_by, of, questions = stack.pop()
            if CLOSES[opener] != t:
                return "unbalanced delimiter"
            if prev in BINARY and not (prev in ("=", "==", "!=", "<=", ">=", "+", "-", "/", "%", "|", "^", "||") and (before == "[" or before == "operator")) and not (prev == "/" and script) and not (prev == "." and kind2 == "n"):
                return "grammar"
            if t == "}" and opener == "{" and of and strict and kind in ("w", "n", "s") and prev not in keywords and not (suffix == ".java" and opened_by not in (")", "else", "do", "try", "finally", "->")) and not (native and opened_by not in (")", "else", "do")) :
                return "grammar"
            if t == ")" and prev == "," and suffix != ".js" and suffix != ".ts":
                return "grammar"
            if opener == "${":
                part = _TEMPLATE.match(text, at)
                if not part:
                    return "unterminated literal"
                at = part.end()
                if part[1] == "${":
                    stack.append(("${", prev, False, questions))
                    questions = 0
                    kind2, kind, before, prev, line_end, block, runs = kind, "o", prev, "(", False, True, 0
                    continue
                kind2, kind, before, prev, line_end, block, runs = kind, "s", prev, "`", False, False, 0
                continue
            block = of
            kind2, kind, before, prev, line_end, runs = kind, "b", prev, t, False, 0
            continue
        else:  # an operator
            begin = m.start("o")
            if suffix == ".js" and (text.startswith("<!--", begin) or text.startswith("-->", begin) and (line_end or prev == ";" and kind == "")):  # comments in the manner of pages
                at = text.find("\n", begin)
                if at < 0:
                    at = n
                continue
            if t == "/" and script and not operand and prev != "}":
                r = _REGEX.match(text, m.start("o"))
                if not r:
                    return "unterminated literal"
                at, k, t = r.end(), "s", "/"
                kind2, kind, before, prev, line_end, block, runs = kind, "s", prev, "/x/", False, False, 0
                continue
            if t in INFIX or t == "/" and not script:
                if prev in ("(", ";", ",") and not (t == "|" and script) or prev in BINARY and prev != "operator" and not (prev == "=" and t == "|" and suffix == ".ts") and not (prev == "=>" and t in ("|",)):
                    return "grammar"
                if prev == "{" and t != "|" or prev == "[" and not (native and t in ("=",)):
                    return "grammar"
                if prev == "}" and block and t in ASSIGN and (strict or kind == "b"):
                    return "grammar"
                if t in ASSIGN and (kind in ("n", "s") or prev == ")" and (script or suffix == ".java")) and not (kind == "s" and prev != "`" and (suffix == ".ts" or stack and stack[-1][0] == "{" and not stack[-1][2])) and not (prev == ")" and suffix == ".ts"):
                    return "grammar"
                if not script and t in ("===", "!==", "=>", "??", "**", "?."):
                    if not (native and t == "**"):
                        return "grammar"
            elif t == "," and (prev in (",", "(", ";") and not (script and stack and stack[-1][0] == "[")) and not (prev in (",", "(") and script and stack and stack[-1][0] == "["):
                return "grammar"
            elif t == ";" and prev in BINARY and not (prev == "/" and script) and not (prev == "." and kind2 == "n"):
                return "grammar"
            elif t == "," and prev in BINARY and prev not in ("=>",) and before != "operator":
                return "grammar"
            elif t == "?" and not (suffix == ".ts" and re.compile(r"\s*[:,)=;]").match(text, at)):
                questions += 1
            elif t == ":":
                if questions:
                    questions -= 1
                elif strict and not stack and kind == "w" and (suffix != ".cpp" or before in (";", "}", "")) and prev not in ("public", "private", "protected"):
                    return "grammar"
                elif suffix == ".js" and stack and stack[-1][0] == "(" and kind == "w" and stack[-1][1] not in ("for",):
                    return "grammar"
                elif suffix == ".js" and declared and stack[-1:] and stack[-1][2] and kind == "w":
                    return "grammar"
                elif prev == ")" and not block and not stack and not (suffix == ".cpp") and suffix != ".ts":
                    return "grammar"
                elif prev == ")" and strict and suffix != ".cpp" and stack and stack[-1][0] == "{" and re.compile(r"[ \t]*\n").match(text, at) and not re.search(r"\bcase\b|\bdefault\b", text[text.rfind("\n", 0, m.start("o")) + 1 : at]):
                    return "grammar"
            elif t == "::" and suffix == ".c" or t in ("=>",) and strict:
                return "grammar"
            elif t == "@" and native:
                return "foreign character"
            elif t == "<" and prev in (";",) and kind in ("", "o") and suffix not in (".ts", ".java"):
                return "grammar"
        if k == "w" and t in ("let", "const", "var") and script:
            declared = 1
        elif t in (";", "=") or k == "w" and line_end:
            declared = 0
        kind2, kind, before, prev, line_end, block = kind, k, prev, t, False, False
    if stack or conditions:
        return "premature end"
    if prev in BINARY and not (prev == "/" and script):
        return "premature end"
    if strict and kind in ("w", "n", "s") and prev not in ("\n",) and not (native and prev.isupper()):
        return "premature end"
    return None


def fault(text: str, suffix: str) -> str | None:
    """Why a text is not valid in the language of its suffix, or null. Empty text is valid except as JSON."""
    text = text.removeprefix("﻿")
    if suffix == ".py":
        return lex_python(text) or exact(text)
    if suffix == ".json":
        return lex_json(text)
    return lex_braces(text, suffix)


def check(chunks: DataFrame) -> DataFrame:
    """``(seq, repo, suffix, fault)`` of every file kept in one ``file`` chunk, ``fault`` null if it parses.

    Files of other suffixes, rows without ``seq`` and null contents are left out; a file
    delivered twice comes once; empty texts parse in all languages but JSON; text of any length
    is read whole; other columns are not read.
    """
    suffix = F.regexp_extract("path", r"(\.[^./\\]+)$", 1)
    rows = chunks.where("type = 'file' and content is not null and seq is not null").select("seq", "repo", suffix.alias("suffix"), "content").where(F.col("suffix").isin(*LANGUAGES))

    def make():
        def each(seqs, repos, suffixes, texts):
            for seq, repo, s, text in zip(seqs, repos, suffixes, texts):
                yield seq, repo, s, fault(text, s)

        return each

    return map_batches(rows, make, "seq bigint, repo string, suffix string, fault string").distinct()


def invalid(chunks: DataFrame) -> DataFrame:
    """``(seq)`` of every file that does not parse."""
    return check(chunks).where("fault is not null").select("seq").distinct()


def rates(chunks: DataFrame) -> DataFrame:
    """``(repo, language, files, invalid, rate)``, with null as ``repo`` where all repositories are counted."""
    languages = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    rows = check(chunks).groupBy("seq", "repo", "suffix").agg(F.max(F.col("fault").isNotNull().cast("int")).alias("bad"))
    rows = rows.withColumn("language", languages[F.col("suffix")])
    per = rows.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum("bad").alias("invalid"))
    whole = per.groupBy("language").agg(F.sum("files").alias("files"), F.sum("invalid").alias("invalid")).withColumn("repo", F.lit(None).cast("string"))
    return per.unionByName(whole).withColumn("rate", F.col("invalid") / F.col("files")).select("repo", "language", "files", "invalid", "rate")
