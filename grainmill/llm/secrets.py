"""Credentials written out in source code (problem 1).

1. Every text is scanned once for literals in places where credentials stand, whatever they look
   like. They go into a corpus-wide index of literals.
2. The index counts the owners (repositories) of every literal. Values that many owners share are
   placeholders and are suppressed, long ones and ones of an issuer's form too.
3. Of the rare values those with the structure of a credential are confirmed.
4. Every whole text is scanned again for the confirmed values, so that a secret is also found in
   places that say nothing about it. Of each value one gram of six bytes routes: texts that may
   hold it, by a filter of fixed size, are joined with the values of the gram and read by an
   automaton of them, so neither the driver nor any task holds all confirmed values.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowmap import map_batches

#: Owners from which on a value counts as a placeholder.
OWNERS = 4

REDACTED = "REDACTED"

#: Words that name a credential when they end a name.
NAMES = (
    "password passwd passwort pwd pw pass passphrase passcode kennwort contrasena contraseña clave mot_de_passe motdepasse senha haslo "
    "hasło wachtwoord parola heslo salasana losenord lösenord sifre şifre secret secrets token tokens apikey credential credentials "
    "authorization authz bearer"
).split()

#: Words before "key" that make it the name of a credential.
KEYS = (
    "api access signing sign encryption encrypt decrypt secret auth private master service storage account deploy client shared app "
    "session bot hook webhook license jwt aes hmac crypto admin root db ssh host"
).split()

_TAIL = r"(?:_?\d+|_(?:prod|production|dev|stage|staging|test|live|main|old|new|value|val|string|str|default))*"
NAME = re.compile(
    rf"(?:(?:^|_)(?:{'|'.join(NAMES)}|(?:{'|'.join(KEYS)})_?key)|password|passwd|passwort|passphrase|secret|apikey|accesskey|token|"
    rf"(?:root|db|admin|smtp|ftp|ssh|sql|user|my|mail)(?:pw|pwd|pass)){_TAIL}$"
)

#: Contents of a placeholder.
PLACEHOLDER = re.compile(
    r"(?is)(?:(.)\1*|x[x-]+|change[-_ ]?(?:me|this|it)?|dummy\w*|replace[-_ ]?(?:me|this|with\b.*)?|redacted|placeholder\w*|examples?|sample\w*|"
    r"test(?:ing)?|todo|tbd|fixme|none|null|nil|undefined|true|false|secret|password|passwd|token|access_token|admin|root|user|"
    r"(?:your|my|insert|enter|put|some|the|fake|mock)[-_ ].*|.*[-_ ](?:here|placeholder|goes[-_ ]here)|.*example.*|<.*>|\[.*\]|\(.*\)|"
    r"foo|bar|baz|foobar|123456?7?8?9?0?|abc\w{0,3}|qwerty|n/?a|empty|unset|default|hidden|masked|removed|xxx.*|\*\*\*.*|\.\.\..*)"
)
REFERENCE = re.compile(
    r"^\{[\w.]*\}$|\$\{|\$\(|\{\{|\}\}|<%|%\(|#\{|^\$\w+$|^%\w+%$|^@\w+|\bvault[:/]|\bsecrets?[:/]|\bssm[:/]|^arn:|\benviron\b|\bgetenv\b|process\.env|"
    r"^(?:env|file|ref|kms|keyring|secret|secretsmanager)[:/]"
)
UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
HASHED = re.compile(r"\$(?:2[abxy]?|5|6|1|argon2\w*|pbkdf2\w*|scrypt)\$|(?i:sha\d*|md5|pbkdf2\w*|bcrypt|argon2\w*)[-:$]")

#: Forms that name their issuer, whatever stands around them.
ISSUED = (
    r"AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|"
    r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{35}|SG\.[\w-]{16,}\.[\w-]{16,}|npm_[A-Za-z0-9]{30,}|"
    r"[a-z]{3}[-_]live_[A-Za-z0-9]{20,40}|[a-z]{3}[-_](?=[A-Za-z0-9]{0,30}\d)(?=[A-Za-z0-9]{0,30}[A-Z])(?=[A-Za-z0-9]{0,30}[a-z])[A-Za-z0-9]{20,40}"
)
_ISSUED = re.compile(rf"(?<![\w./+-])(?:{ISSUED})(?![\w/+=-])")

#: Forms of values that stand on their own in a comment.
_CODE = r"[A-Z0-9]{5}(?:-[A-Z0-9]{5}){3,}"
_WORDS = r"[a-z]+-[a-z]+-[a-z]+-\d{3}"
_WORDED = r"[A-Z][a-z]+[^\w\s][A-Z][a-z]+\d{2}|[a-z]+\d{4}[^\w\s]"
STANDING = re.compile(rf"(?:{ISSUED}|{_CODE}|{_WORDS}|{_WORDED}|[0-9a-f]{{32,64}}|(?=\S*\d)(?=\S*[a-z])(?=\S*[A-Z])[A-Za-z0-9+/_-]{{10,}}={{0,2}})")

_STR = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
_PIECES = rf"(?:{_STR})(?:\s*(?:\+|\.|\\\n)?\s*(?:{_STR}))*"
PIECE = re.compile(_STR)
MORE = re.compile(rf"\s*(?:(?:\+|\.|\\\n)\s*)?(?:{_STR})")

#: A name, an assignment and a literal, perhaps in pieces; or a bare value.
ASSIGN = re.compile(
    rf"(?<![\w.À-ž-])[-.\d]*+(?P<name>[A-Za-z_À-ž][\w.À-ž-]*+)[\"'\]]*\s*(?::\s*[\w\[\]<>., |]{{1,300}}?(?==)|\[\d*\])?\s*(?:=>|:=|\?=|=(?!=)|:(?!:))"
    rf"(?:\s*(?:[({{\[]\s*)?[rRbBuUfL@]{{0,2}}(?P<lit>{_PIECES})|[ \t]*(?P<bare>[^\s\"'`,;(){{}}\[\]<>#][^\s\"'`,;(){{}}\[\]<>]*(?![^\s,;]*[(\[])))"
)
PAIR = re.compile(rf"[\"'](?P<name>[A-Za-z_][\w.-]*)[\"']\s*\]?\s*[,)]\s*(?:or\s*|\?\?\s*|\|\|\s*)?(?P<lit>{_PIECES})")
CALL = re.compile(
    rf"\b(?:login|log_in|logIn|sign_?in|signIn|connect|open_?session|openSession|authenticate|auth|basic_?auth|set_?credentials|setCredentials|"
    rf"bind|credentials)\(\s*(?P<who>{_STR})\s*,\s*(?P<lit>{_PIECES})"
)
URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'`<>]*:(?P<val>[^\s\"'`<>]+)@(?=[\w.\[-])")
HEAD = re.compile(r"\b(?P<how>Bearer|Basic|bearer|basic)\s+(?P<val>[A-Za-z0-9+/=._~-]{8,})")
FLAG = re.compile(
    r"(?<![\w-])--?(?:password|passwd|passphrase|pass|token|auth-token|access-token|api-?key|apikey|api_key|secret|client-secret|access-key|secret-key)"
    r"[ =]+(?P<val>[^\s\"'`]+)"
)
USER = re.compile(r"(?<![\w-])(?:-[uU]|--user)[ =]?(?P<who>[\w.@-]+):(?P<val>[^\s\"'`]+)")
SQL = re.compile(r"(?i)\b(?:identified\s+(?:\w+\s+\w+\s+)?by|(?:with\s+)?(?:encrypted\s+)?password)\s+\\?(?P<q>['\"])(?P<val>[^'\"\\]+)\\?(?P=q)")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
BODY = re.compile(r"(?:[\s\"'`+\\>#*/|]|\\[nr])*[A-Za-z0-9+/]{16,}")
END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: A line of a key, with what stands before it, and one that a cut leaves short.
KEY_LINE = re.compile(r"(?:\\[nr]|[\s\"'`\\>#*|,;+.]|/(?=[/*\s]))*(?=[A-Za-z]*[A-Z0-9+/])[A-Za-z0-9+/]{16,}={0,2}(?![\w(.=:\[-])")
KEY_REST = re.compile(r"(?:\\[nr]|[\s\"'`\\>#*|,;+.]|/(?=[/*\s]))*(?:[A-Za-z0-9+/]{1,15}={1,2}(?![\w=])|[A-Za-z0-9+/]{1,15}(?=\\[nr]|\s*[\"'`]|\s*\Z))")
COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|>|<!--|;)[^\S\n]?(?P<said>.*)$|(?<=[\s;{}])(?:#|//)\s(?P<after>[^\"'\n]*)$", re.M)
RUN = re.compile(r"\S*")
SAYS = re.compile(
    r"(?i)\b(?:key|token|secret|pw|pwd|pass|password|passwd|passphrase|passwort|kennwort|credentials?|creds?|login|log in)\b|\buse\s+\S+\s+(?:on|for|in|at)\b"
)
#: What a line with a credential holds, in lower case; the second form is the exact one.
HINTS = (
    "pass kennwort pwd pw contrase senha haslo hasło wachtwoord parola heslo salasana losenord lösenord sifre şifre clave secret token key "
    "auth bearer basic credential login log_in connect( session( signin( sign_in( bind( :// identified akia asia ghp_ gho_ ghu_ ghs_ ghr_ "
    "github_pat glpat xox eyj _live_ _test_ -live_ aiza sg. npm_"
).split() + [" -u ", "use "]
TRIGGER = re.compile(
    r"(?<!com)pass(?!e[dr]|ing)|kennwort|pwd|pw\b|contrase|senha|has[lł]o|wachtwoord|parola|heslo|salasana|l[oö]senord|[sş]ifre|\bclave|secret|token|key|auth|"
    r"bearer|basic |credential|login|log_in|connect\(|session\(|sign_?in\(|bind\(|://|identified|akia|asia[a-z0-9]{16}|gh[pousr]_|github_pat|glpat-|xox|eyj|"
    r"[_-](?:live|test)_|aiza|sg\.|npm_| -u |--user|\buse \S+ (?:on|for|in|at)\b"
)
#: Bytes of the gram that routes a confirmed value, the bits of the filter of grams as a power of two, and bytes of text looked at at once.
GRAM, FILTER_BITS, BLOCK = 6, 26, 1 << 20

#: Characters from which on a line is looked at in stretches around its triggers, and how far these begin before and go on after one. What begins in a stretch is read to its end.
LONG_LINE, AROUND = 2000, 600

BARE_SUFFIXES = (".env", ".yaml", ".yml", ".ini", ".cfg", ".conf", ".toml", ".properties", ".txt", ".md", ".sh")


def words_of(name: str) -> str:
    """A name in lower case with underscores between its words."""
    return re.sub(r"[.\-\s]+", "_", re.sub(r"(?<=[a-zà-ž0-9])(?=[A-Z])", "_", name)).strip("_").lower()


def is_name(name: str) -> bool:
    return bool(NAME.search(words_of(name)))


def mixed(value: str) -> bool:
    """Does a value look made up rather than written: digits, symbols or changing case?"""
    if re.search(r"\d", value) and re.search(r"[A-Za-z]", value):
        return not (re.fullmatch(r"[A-Za-z_]+\d", value) and named(value))
    if re.search(r"[^\w\s./:,@-]", value) and re.search(r"[A-Za-z]", value):
        return " " not in value
    return len(re.findall(r"[a-z][A-Z]", value)) >= 2 and not named(value) and " " not in value


def named(value: str) -> bool:
    """Is a value made of words like an identifier, whose words are not short?"""
    if re.search(r"(?i)[bcdfghjklmnpqrstvwxz]{5}", value):
        return False
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", value)
    return sum(map(len, words)) >= 3.5 * len(words)


def is_candidate(value: str) -> bool:
    """Can a literal go into the index: one word of some length?"""
    return len(value) >= 4 and not re.search(r"\s", value)


def is_value(value: str) -> bool:
    """Has a rare literal in the place of a credential the structure of one?"""
    return (
        len(value) >= 6
        and not re.search(r"\s", value)
        and not PLACEHOLDER.fullmatch(value)
        and not REFERENCE.search(value)
        and not UUID.fullmatch(value)
        and not HASHED.match(value)
        and not re.match(r"[a-z]+://|data:|/[a-z0-9_.-]+(?:/[a-z0-9_.-]+)*/?$|\.{1,2}/", value)
        and mixed(value)
    )


def strength(value: str) -> int:
    """2 for a value only its issuer or chance makes, 1 for one that people may share."""
    return 2 if _ISSUED.fullmatch(value) or len(value) >= 20 else 1


def joined(pieces: str) -> str:
    return "".join(m.group()[1:-1] for m in PIECE.finditer(pieces))


def basic(value: str) -> bool:
    """Is a value user and password in base 64?"""
    try:
        said = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode()
    except (binascii.Error, ValueError):
        return False
    who, colon, word = said.partition(":")
    return bool(colon and who and len(word) >= 4 and not PLACEHOLDER.fullmatch(word) and not REFERENCE.search(word))


def regions(text: str) -> Iterator[tuple[int, int, int, int]]:
    """``(begin, end, line, reach)`` of every line with a trigger; ``line`` is where it ends, ``reach`` takes in two lines more, for values that follow or go on there.

    Of a very long line come the stretches around its triggers; what begins before ``end`` is
    read to its end, however far that is.
    """
    low = text.lower()
    if len(low) != len(text):  # some letters grow when made small
        low = "".join(c if len(c) == 1 else "?" for c in map(str.lower, text))
    lines: dict[int, int] = {}
    for hint in HINTS:
        at = low.find(hint)
        while at >= 0:
            begin, end = low.rfind("\n", 0, at) + 1, low.find("\n", at)
            end = len(low) if end < 0 else end
            if begin not in lines and TRIGGER.search(low, begin, end):
                lines[begin] = end
            at = low.find(hint, end)
    for begin, end in sorted(lines.items()):
        reach = end
        for _ in range(2):
            reach = text.find("\n", reach + 1)
            if reach < 0:
                reach = len(text)
                break
        if end - begin <= LONG_LINE:
            yield begin, end, end, reach
            continue
        last = begin
        for m in TRIGGER.finditer(low, begin, end):
            if m.start() >= last:
                first, last = max(begin, last, m.start() - AROUND), min(end, m.end() + AROUND)
                while first > begin and (low[first - 1].isalnum() or low[first - 1] in "_.-"):  # a name is not cut
                    first -= 1
                yield first, last, end, reach


def key_end(text: str, at: int) -> int:
    """The end of a private key whose BEGIN line ends at ``at``: its END, or where there is none before the next BEGIN the end of its lines."""
    end, other = END.search(text, at), PRIVATE.search(text, at)
    if end and not (other and other.start() < end.start()):
        return end.end()
    while m := KEY_LINE.match(text, at):
        at = m.end()
    rest = KEY_REST.match(text, at)
    return rest.end() if rest else at


def pieces(m: re.Match, text: str) -> str:
    """The literal of a match in ``text``, with the pieces that follow it however far they go."""
    at = m.end("lit")
    while more := MORE.match(text, at):
        at = more.end()
    return text[m.start("lit") : at]


def literals(text: str, suffix: str = "") -> Iterator[tuple[int, int, str, bool, bool]]:
    """``(begin, end, value, whole, structured)`` of every literal in the place of a credential, pieces over any number of lines together.

    ``whole`` is false where the value stands in pieces; ``structured`` says whether it looks
    like a credential. The same value may come twice. A private key has an empty value.
    """
    if "PRIVATE KEY" in text:
        for m in PRIVATE.finditer(text):
            if BODY.match(text, m.end()):
                yield m.start(), key_end(text, m.end()), "", True, True
    said = -1
    for begin, end, line, reach in regions(text):
        for found in _in_line(text, begin, end, line, reach, suffix):
            if is_candidate(found[2]):
                yield found
        if line != said:
            said = line
            yield from _in_comments(text, text.rfind("\n", 0, begin) + 1, line)


def _in_line(text: str, begin: int, end: int, line: int, reach: int, suffix: str) -> Iterator[tuple[int, int, str, bool, bool]]:
    """Literals that begin from ``begin`` to ``end`` of a line that ends at ``line``; assigned ones may go on up to ``reach``."""

    def matches(pattern: re.Pattern, upto: int) -> Iterator[re.Match]:
        for m in pattern.finditer(text, begin, upto):
            if m.start() > end:
                return
            yield m

    for m in matches(ASSIGN, reach):
        name, lit, bare = m["name"], m["lit"], m["bare"]
        if lit is not None:
            lit = pieces(m, text)
            value = joined(lit)
            single = len(PIECE.findall(lit)) == 1
            if not HEAD.match(value) and (is_name(name) or not single and _ISSUED.fullmatch(value)):
                yield m.start("lit") + 1, m.start("lit") + len(lit) - 1, value, single, is_name(name) and is_value(value) or not single and bool(_ISSUED.fullmatch(value))
        elif suffix in BARE_SUFFIXES and is_name(name):
            yield m.start("bare"), m.end("bare"), bare, True, is_value(bare)
    for pattern in (PAIR, CALL):
        for m in matches(pattern, reach):
            if is_name(m["name"] if pattern is PAIR else m["who"][1:-1]) == (pattern is PAIR):
                value = joined(lit := pieces(m, text))
                yield m.start("lit") + 1, m.start("lit") + len(lit) - 1, value, len(PIECE.findall(lit)) == 1, is_value(value)
    for pattern in (URL, FLAG, USER, SQL):
        for m in matches(pattern, line):
            value = m["val"]
            yield m.start("val"), m.end("val"), value, True, not PLACEHOLDER.fullmatch(value) and not REFERENCE.search(value) and (pattern is URL or mixed(value))
    for m in matches(HEAD, line):
        value = m["val"].rstrip(".")
        yield m.start("val"), m.start("val") + len(value), value, True, basic(value) if m["how"].lower() == "basic" else is_value(value)
    for m in matches(_ISSUED, line):
        yield m.start(), m.end(), m.group(), True, not PLACEHOLDER.fullmatch(m.group())


def _in_comments(text: str, begin: int, end: int) -> Iterator[tuple[int, int, str, bool, bool]]:
    """Words that look like credentials in the comments of a line."""
    for m in COMMENT.finditer(text, begin, end):
        part = "said" if m["said"] is not None else "after"
        if SAYS.search(m[part]):
            for t in re.finditer(r"[^\s=:\"'`,;()<>]+(?:[=:][^\s=:\"'`,;()<>]+)*={0,2}", m[part]):
                value, at = t.group().rstrip("."), t.start()
                cut = re.match(r"(?:\w+[=:])+(?=.{6})", value)
                if cut and (is_name(cut.group()[:-1]) or cut.group().lower() in ("key=", "key:")):
                    value, at = value[cut.end() :], at + cut.end()
                if is_value(value) and (STANDING.fullmatch(value) or random_looking(value)):
                    yield m.start(part) + at, m.start(part) + at + len(value), value, True, True


def random_looking(value: str) -> bool:
    """A word with a symbol, and with digits or changing case, that is no path, call or address."""
    return (
        bool(re.search(r"[^\w.:/-]", value))
        and not re.search(r"[(){}\[\]<>]|://|->", value)
        and bool(re.search(r"\w.*[^\w.:/-].*\w", value))
        and (bool(re.search(r"\d", value)) or len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", value)) >= 2)
    )


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


INDEX = "seq bigint, chunk_idx int, repo string, line_no int, value string, structured boolean"


def index(chunks: DataFrame) -> DataFrame:
    """The index of literals, a row for each value and line; private keys have an empty value."""

    def make():
        def scan(seqs, idxs, repos, paths, texts):
            for seq, idx, repo, path, text in zip(seqs, idxs, repos, paths, texts):
                if not text:
                    continue
                dot = (path or "").rfind(".")
                seen: dict[tuple[int, str], bool] = {}
                for begin, _, value, _, structured in literals(text, path[dot:] if path and dot >= 0 else ""):
                    row = line_of(text, begin), value
                    seen[row] = seen.get(row, False) or structured
                for (line, value), structured in seen.items():
                    yield seq, idx, repo, line, value, structured

        return scan

    rows = chunks.select("seq", "chunk_idx", "repo", "path", F.coalesce("code", "content").alias("text")).where("text is not null and seq is not null and chunk_idx is not null")
    return map_batches(rows, make, INDEX)


def owned(found: DataFrame) -> DataFrame:
    """``(value, owners, structured)``: every literal of the index with its number of owners.

    Rows come distinct by value and owner before they meet, so that a value that a third of all
    rows hold is counted in parts.
    """
    held = found.where("value is not null and value <> ''")
    per = held.groupBy("value", F.coalesce("repo", F.lit("")).alias("repo")).agg(F.max("structured").alias("structured"))
    return per.groupBy("value").agg(F.count("*").alias("owners"), F.max("structured").alias("structured"))


def confirmed(found: DataFrame, owners: int = OWNERS) -> DataFrame:
    """The values of the index that are credentials, ``(value)``: with fewer than ``owners`` owners, and structured at one place at least."""
    return owned(found).where((F.col("owners") < owners) & F.col("structured")).select("value")


def stands(text: str, begin: int, end: int) -> bool:
    """Is ``text[begin:end]`` a value of its own there, not part of a longer word or of an identifier?

    Letters or digits on either side make it another value. Beside an underline a long or issued
    value still counts, as no identifier is made of it; a short one may be part of a name.
    """
    value, before, after = text[begin:end], text[begin - 1 : begin] if begin else "", text[end : end + 1]
    if before.isalnum() and value[0].isalnum() or after.isalnum() and value[-1].isalnum():
        return False
    return "_" not in (before, after) or strength(value) >= 2


def grams(value: str) -> dict[int, int]:
    """The grams of a value, ``GRAM`` bytes as a number, with how plain they look: the less, the more kinds and changes of characters."""
    raw, out = value.encode(), {}
    kinds = ["a" if 97 <= c < 123 else "A" if 65 <= c < 91 else "0" if 48 <= c < 58 else "-" for c in raw]
    for k in range(len(raw) - GRAM + 1):
        part = kinds[k : k + GRAM]
        out[int.from_bytes(raw[k : k + GRAM], "little")] = -4 * len(set(part)) - sum(a != b for a, b in zip(part, part[1:]))
    return out


def anchored(values: DataFrame) -> DataFrame:
    """``(value, gram)``: by value the gram that the fewest values share, of those the least plain.

    Null for one that isn't looked for elsewhere: one shorter than a gram, and a short word, name
    or number, which only its place made a credential.
    """

    def make():
        def each(values):
            for v in values:
                held = grams(v) if len(v) >= GRAM and (mixed(v) or strength(v) >= 2) else {}
                yield from ((v, g, plain) for g, plain in held.items()) if held else ((v, None, 0),)

        return each

    held = map_batches(values, make, "value string, gram bigint, plain int")
    shared = held.where("gram is not null").groupBy("gram").agg(F.count("*").alias("n"))
    return held.join(shared, "gram", "left").groupBy("value").agg(F.min(F.struct("n", "plain", "gram")).alias("r")).select("value", F.col("r.gram").alias("gram"))


def _bits(held, k: int):
    """The places of grams in the filter by its ``k``-th hash."""
    return (held * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[k])) >> np.uint64(64 - FILTER_BITS)


def _held(words, held, k: int):
    """Which grams the filter holds by its ``k``-th hash."""
    at = _bits(held, k)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def gram_filter(anchors: DataFrame):
    """A Bloom filter of the grams, as words of 64 bits; its size doesn't grow with them."""
    def make():
        def each(grams):
            held, out = np.array(grams, np.uint64), {}
            for k in range(3):
                for at in _bits(held, k).tolist():
                    out[at >> 6] = out.get(at >> 6, 0) | 1 << (at & 63)
            for word, bits in out.items():
                yield word, bits - (1 << 64) if bits >> 63 else bits

        return each

    rows = map_batches(anchors.where("gram is not null").select("gram"), make, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def in_filter(words, raws: list[bytes]) -> dict[int, set[int]]:
    """The grams of texts that the filter holds, by the number of the text; some that stand over two texts may be among them."""
    buffer, out = b"".join(raws) + b"\0\0", {}
    ends = np.cumsum([len(r) for r in raws])
    for a in range(0, len(buffer) - 7, BLOCK):
        n = min(BLOCK, len(buffer) - 7 - a)
        held = np.ndarray((n,), "<u8", buffer, a, (1,)) & np.uint64((1 << 8 * GRAM) - 1)
        at = np.flatnonzero(_held(words, held, 0))
        for k in (1, 2):
            at = at[_held(words, held[at], k)]
        for text, gram in zip(np.searchsorted(ends, at + a, "right").tolist(), held[at].tolist()):
            out.setdefault(text, set()).add(gram)
    return out


def rescan(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """All places ``(seq, chunk_idx, line_no, value)`` of confirmed values in whole texts.

    A text whose grams meet the filter goes to the values of these grams by a join; an automaton
    of the values routed there reads it from end to end.
    """
    from ..session import stage

    shared = chunks.sparkSession.sparkContext.broadcast(gram_filter(anchors))

    def make_candidates():
        def scan(seqs, idxs, texts):
            first, raws, size = 0, [], 0
            for k, text in enumerate(texts):
                raws.append(text.encode())
                size += len(raws[-1])
                if size >= BLOCK or k + 1 == len(texts):
                    for at, held in in_filter(shared.value, raws).items():
                        yield seqs[first + at], idxs[first + at], sorted(held), texts[first + at]
                    first, raws, size = k + 1, [], 0

        return scan

    rows = chunks.select("seq", "chunk_idx", F.coalesce("code", "content").alias("text")).where("text is not null and seq is not null and chunk_idx is not null")
    texts = stage(map_batches(rows, make_candidates, "seq bigint, chunk_idx int, grams array<bigint>, text string"), "candidates")
    routed = texts.select("seq", "chunk_idx", F.explode("grams").alias("gram")).join(anchors.where("gram is not null"), "gram").groupBy("seq", "chunk_idx").agg(F.collect_set("value").alias("values"))

    def make():
        import ahocorasick

        def scan(seqs, idxs, texts, values):
            automaton = ahocorasick.Automaton()
            for v in {v for vs in values for v in vs}:
                automaton.add_word(v, v)
            automaton.make_automaton()
            for seq, idx, text in zip(seqs, idxs, texts):
                lines = None
                for end, value in automaton.iter(text):
                    at = end - len(value) + 1
                    if stands(text, at, end + 1):
                        lines = lines or [m.start() for m in re.finditer("\n|\\Z", text)]
                        yield seq, idx, bisect.bisect_left(lines, at) + 1, value

        return scan

    return map_batches(texts.select("seq", "chunk_idx", "text").join(routed, ["seq", "chunk_idx"]), make, "seq bigint, chunk_idx int, line_no int, value string")


def find(chunks: DataFrame, owners: int = OWNERS) -> DataFrame:
    """``(seq, chunk_idx, line_no, value)`` of every credential in ``code``, or else ``content``.

    A private key has an empty ``value``. Rows come distinct: chunks delivered twice count once.
    Null and empty texts, and rows without a key, hold none; very long texts are scanned whole;
    other columns are not read.
    """
    from ..session import stage

    found = stage(index(chunks), "literals")
    values = stage(anchored(confirmed(found, owners)), "values")
    by_place = found.where("value <> '' and structured").select("seq", "chunk_idx", "line_no", "value").join(values.select("value"), "value", "left_semi")
    keys = found.where("value = ''").select("seq", "chunk_idx", "line_no", "value")
    columns = ["seq", "chunk_idx", "line_no", "value"]
    return by_place.select(columns).unionByName(keys).unionByName(rescan(chunks, values)).distinct()


def redact_text(text: str, values: list[str], suffix: str = "") -> str:
    """``text`` with every confirmed value replaced, quotes, line breaks and all other text kept."""
    wanted, spans = set(values), []
    for begin, end, value, whole, _ in literals(text, suffix):
        if value in wanted and value:
            if whole:
                spans.append((begin, end))
            else:
                spans += [(begin - 1 + m.start() + 1, begin - 1 + m.end() - 1) for m in PIECE.finditer(text[begin - 1 : end + 1])]
        elif not value and "" in wanted:
            head = text.index("-----", begin + 5) + 5
            tail = text.rfind("-----END", head, end)
            least = r"[A-Za-z0-9+/=]{4,}" if tail > 0 else r"[A-Za-z0-9][A-Za-z0-9+/=]*"
            spans += [(head + m.start(), head + m.end()) for m in re.finditer(rf"(?<!\\){least}|(?<=\\[nr]){least}", text[head : tail if tail > 0 else end])]
    for value in sorted(wanted - {""}, key=len, reverse=True):
        at = text.find(value)
        while at >= 0:
            if stands(text, at, at + len(value)):
                spans.append((at, at + len(value)))
            at = text.find(value, at + 1)
    out, last = [], 0
    for a, b in sorted(set(spans), key=lambda x: (x[0], -x[1])):
        if a >= last:
            out += [text[last:a], REDACTED]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(chunks: DataFrame, owners: int = OWNERS) -> DataFrame:
    """``(seq, chunk_idx, redacted)`` of every chunk with a credential: its text with all of them replaced."""
    values = find(chunks, owners).groupBy("seq", "chunk_idx").agg(F.collect_set("value").alias("values"))
    rows = chunks.select("seq", "chunk_idx", "path", F.coalesce("code", "content").alias("text")).dropDuplicates(["seq", "chunk_idx"])
    held = rows.join(values, ["seq", "chunk_idx"]).select("seq", "chunk_idx", "path", "text", "values")

    def make():
        def each(seqs, idxs, paths, texts, values):
            for seq, idx, path, text, vs in zip(seqs, idxs, paths, texts, values):
                yield seq, idx, redact_text(text, vs, path[path.rfind(".") :] if path and "." in path else "")

        return each

    return map_batches(held, make, "seq bigint, chunk_idx int, redacted string")
