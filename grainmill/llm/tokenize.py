"""Encoding of texts with a byte-level BPE vocabulary (problem 8).

All texts of an Arrow batch are laid end to end as one array of code points, and their classes
are the symbols of a small automaton that splits as the vocabulary's pattern does. Each symbol is
a transition function; the functions and all their compositions form a finite monoid, whose
elements are numbered once. The states at all places come from an associative scan over these
numbers by doubling, two compositions of the whole array at a time; it ends when every
composition is constant, after two steps, as the automaton forgets all but four characters.
Boundaries are then looked up by state and class, without a regular expression, and the slices
between them go through a cache of merged pieces. Their offsets can be kept, so that any part of
a text can be found in its ids and decoded.
"""

from __future__ import annotations

import heapq
import importlib
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shipped

#: Code points of the White_Space property, without the blank.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

#: Pieces that a worker keeps merged; the cache is emptied beyond that number.
CACHE = 1 << 20

#: Characters that are encoded at once.
BLOCK = 1 << 20

#: A rank beyond all ranks.
NEVER = 1 << 30

#: Places of the table of short pieces, as a power of two; the factor that spreads them; masks of the low 0 to 8 bytes.
TABLE_BITS = 18
MIX = np.uint64(0x9E3779B97F4A7C15)
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def vocabulary(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Path of a vocabulary file: in ``folder``, else in the installed package of public ones."""
    if folder:
        return f"{folder}/{name}"
    try:
        return importlib.import_module("public_tokenizers").path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class CodePointClasses:
    """Class of every code point; unassigned ones are asked of the library's own splitter."""

    def __init__(self, probe: Callable[[str], int]):
        self.table = np.full(0x110000, 255, np.uint8)
        self.probe = probe

    def of(self, points: np.ndarray) -> np.ndarray:
        got = self.table[points]
        unknown = got == 255
        if unknown.any():
            for c in np.unique(points[unknown]).tolist():
                self.table[c] = self.classify(c)
            got = self.table[points]
        return got

    def classify(self, c: int) -> int:
        if c == 0x20:
            return BLANK
        if c in WHITE:
            return SPACE
        kind = unicodedata.category(chr(c))
        if kind == "Cn":
            return self.probe(chr(c))
        return {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)


#: States: at the start of a text; in a piece of letters, numbers, other signs; after a blank, after other white space; after an apostrophe that begins a piece, after its r, v or l; after a whole ending.
STATES = START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, AFTER_SPACE, MARKED, MARKED_R, MARKED_V, MARKED_L, ENDED = range(11)
#: Symbols: classes of code points, and those that endings are made of.
SYMBOLS = OTHER, LETTER, NUMBER, SPACE, BLANK, APOSTROPHE, ALONE, R, V, L, E = range(11)


def next_state(state: int, symbol: int) -> int:
    """The automaton of the splitting pattern."""
    if symbol in (SPACE, BLANK):
        return AFTER_SPACE if symbol == SPACE else AFTER_BLANK
    if symbol == NUMBER:
        return IN_NUMBERS
    if symbol == OTHER:
        return IN_OTHERS
    if symbol == APOSTROPHE:  # it begins a piece unless a blank or other signs take it in
        return IN_OTHERS if state in (IN_OTHERS, AFTER_BLANK, MARKED) else MARKED
    if state == MARKED:
        return {ALONE: ENDED, R: MARKED_R, V: MARKED_V, L: MARKED_L}.get(symbol, IN_LETTERS)
    if (state, symbol) in ((MARKED_R, E), (MARKED_V, E), (MARKED_L, L)):
        return ENDED
    return IN_LETTERS


class Monoid:
    """All compositions of the automaton's transition functions, numbered: ``product[a, b]`` is first a, then b."""

    def __init__(self):
        functions = [tuple(next_state(s, x) for s in STATES) for x in SYMBOLS]
        functions += [(f[START],) * len(STATES) for f in functions]  # the first symbol of a text, whatever was before
        number = {f: k for k, f in enumerate(dict.fromkeys(functions))}
        self.symbol = np.array([number[f] for f in functions], np.uint8)
        known = list(number)
        for f in known:  # grows while it is read
            for g in functions:
                for h in (tuple(g[s] for s in f), tuple(f[s] for s in g)):
                    if h not in number:
                        number[h] = len(number)
                        known.append(h)
        self.product = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], np.uint8)
        self.constant = np.array([f[0] if len(set(f)) == 1 else 255 for f in known], np.uint8)

    def states(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The state after each symbol: an inclusive scan by doubling, until all compositions are constant."""
        held = self.symbol[symbols + np.where(first, np.uint8(len(SYMBOLS)), np.uint8(0))]
        reach = 1
        while True:
            state = self.constant[held]
            if reach >= len(held) or not (state == 255).any():
                return state
            held[reach:] = self.product[held[:-reach], held[reach:]]
            reach *= 2


@lru_cache(maxsize=1)
def monoid() -> Monoid:
    return Monoid()


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The symbols of ASCII characters that have one of their own; 255 for others."""
    out = np.full(128, 255, np.uint8)
    for chars, symbol in (("'", APOSTROPHE), ("stmd", ALONE), ("r", R), ("v", V), ("l", L), ("e", E)):
        for ch in chars:
            out[ord(ch)] = symbol
    return out


@lru_cache(maxsize=1)
def _begins() -> np.ndarray:
    """Does a piece begin at a symbol, by the state before it: yes, no, or 2 where what follows decides."""
    out = np.zeros((len(STATES), len(SYMBOLS)), np.uint8)
    kind = {IN_LETTERS: "l", IN_NUMBERS: "n", IN_OTHERS: "o", MARKED_R: "l", MARKED_V: "l", MARKED_L: "l"}
    for s in STATES:
        for x in SYMBOLS:
            white, sign = x in (SPACE, BLANK), "n" if x == NUMBER else "o" if x in (OTHER, APOSTROPHE) else "l"
            if s == START:
                out[s, x] = 1
            elif white:
                out[s, x] = 2 if s in (AFTER_SPACE, AFTER_BLANK) else 1
            elif s == AFTER_BLANK:
                out[s, x] = 0
            elif s == MARKED:
                out[s, x] = 0 if x in (ALONE, OTHER, APOSTROPHE) else 2 if x in (R, V, L) else 1
            elif next_state(s, x) == ENDED:
                out[s, x] = 0
            else:
                out[s, x] = kind.get(s) != sign
    return out


def boundaries(points: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a piece begins. ``first``: True at the first character of each text."""
    n = len(points)
    special = _letters()[np.where(points < 128, points, 0)]
    symbols = np.where((special != 255) & (points < 128), special, classes)
    state = monoid().states(symbols, first)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = START, state[:-1]
    before[first] = START
    begins = _begins()[before, symbols]
    open_ = np.flatnonzero(begins == 2)
    if len(open_):
        after = np.minimum(open_ + 1, n - 1)
        inside = (open_ + 1 < n) & ~first[after]
        follow = symbols[after]
        white = (symbols[open_] == SPACE) | (symbols[open_] == BLANK)
        # the last white space before text is cut off; letters after an apostrophe are kept if they make a whole ending
        dark = inside & (follow != SPACE) & (follow != BLANK)
        ending = inside & (follow == np.where(symbols[open_] == L, L, E))
        begins[open_] = np.where(white, dark, ~ending)
    return begins.astype(bool)


class Pieces(dict):
    """Numbers of the pieces met so far; a new one is merged when it is first looked up."""

    def __init__(self, merge: Callable[[str], list[int]]):
        super().__init__()
        self.merge, self.ids, self.offsets, self.held = merge, [], [0], (np.empty(0, np.int32), np.zeros(1, np.int64))

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.ids += self.merge(piece)
        self.offsets.append(len(self.ids))
        return number

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and the offset of each."""
        flat, offset = self.held
        if len(offset) < len(self.offsets):
            self.held = flat, offset = (
                np.concatenate([flat, np.array(self.ids[len(flat) :], np.int32)]),
                np.concatenate([offset, np.array(self.offsets[len(offset) :], np.int64)]),
            )
        return flat, offset


class Encoder:
    """Ids of texts. ``path``: a byte-level BPE vocabulary in JSON, of vocab and merges."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        vocab = {bytes(map(back.__getitem__, t)): i for t, i in model["vocab"].items() if all(ch in back for ch in t)}
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(map(back.__getitem__, x)) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.pairs[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.bytes = {i: t for t, i in vocab.items()}
        self.path = path
        self.forget()
        self._splitter = None
        self.classes = CodePointClasses(self.probe)

    def forget(self) -> None:
        self.cache = Pieces(self.merge)
        self.table_words, self.table_numbers = np.zeros(1 << TABLE_BITS, np.uint64), np.full(1 << TABLE_BITS, -1, np.int32)

    def probe(self, ch: str) -> int:
        """Class of an unassigned code point as the library's splitter sees it."""
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_file(self.path).pre_tokenizer
        split = lambda s: len(self._splitter.pre_tokenize_str(s))
        if split("a" + ch) == 1:
            return LETTER
        if split("1" + ch) == 1:
            return NUMBER
        return OTHER if split("!" + ch) == 1 else SPACE

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: the pair of least rank, leftmost first, is merged until none is left."""
        ids = [self.single[b] for b in piece.encode("utf-8", "replace")]
        pairs = self.pairs
        if len(ids) < 2:
            return ids
        if len(ids) <= 48:
            ranks = [pairs[p][0] if p in pairs else NEVER for p in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < NEVER:
                k = ranks.index(best)
                ids[k : k + 2] = [pairs[ids[k], ids[k + 1]][1]]
                del ranks[k]
                if k:
                    ranks[k - 1] = pairs[p][0] if (p := (ids[k - 1], ids[k])) in pairs else NEVER
                if k < len(ranks):
                    ranks[k] = pairs[p][0] if (p := (ids[k], ids[k + 1])) in pairs else NEVER
            return ids
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(hit[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (hit := pairs.get((ids[k], ids[k + 1])))]
        heapq.heapify(queue)
        while queue:
            _, k, a, b = heapq.heappop(queue)
            r = right[k]
            if ids[k] != a or r < 0 or ids[r] != b:
                continue
            ids[k], ids[r] = pairs[a, b][1], -1
            right[k] = right[r]
            if right[r] >= 0:
                left[right[r]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y >= 0 and (hit := pairs.get((ids[x], ids[y]))):
                    heapq.heappush(queue, (hit[0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def pieces(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """All texts end to end, the offsets at which pieces begin, and the number of pieces before each text."""
        whole = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        if not whole:
            return whole, np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(points), bool)
        first[(ends - lengths)[lengths > 0]] = True
        starts = np.flatnonzero(boundaries(points, self.classes.of(points), first))
        return whole, starts, np.searchsorted(starts, np.concatenate([[0], ends]))

    def numbers(self, whole: str, starts: np.ndarray) -> np.ndarray:
        """The number of each piece.

        A piece of at most eight ASCII characters is one 64-bit word, looked up with all others
        in a direct-mapped table; longer ones, those of other characters and those whose place
        another piece holds go through the dictionary.
        """
        n = len(whole)
        ends = np.append(starts[1:], n)
        length = ends - starts
        raw = np.zeros(n + 8, np.uint8)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = (points == 0) | (points > 127)
        raw[:n] = np.where(wide, 0, points)
        foreign = np.zeros(n + 1, np.int32)
        np.cumsum(wide, out=foreign[1:])
        short = np.flatnonzero((length <= 8) & (foreign[ends] == foreign[starts]))
        words = np.ndarray((n,), "<u8", raw.data, 0, (1,))[starts[short]] & MASKS[length[short]]
        place = ((words * MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = np.full(len(starts), -1, np.int32)
        out[short] = np.where(self.table_words[place] == words, self.table_numbers[place], -1)
        cache = self.cache
        left = np.flatnonzero(out[short] < 0)
        if len(left):
            fresh, back = np.unique(words[left], return_inverse=True)
            known = np.fromiter((cache[w.to_bytes(8, "little").rstrip(b"\0").decode()] for w in fresh.tolist()), np.int32, len(fresh))
            out[short[left]] = known[back]
            self.table_words[place[left]], self.table_numbers[place[left]] = words[left], known[back]
        left = np.flatnonzero(out < 0)
        out[left] = np.fromiter((cache[whole[a:b]] for a, b in zip(starts[left].tolist(), ends[left].tolist())), np.int32, len(left))
        return out

    def encode(self, texts: list[str | None], offsets: bool = False) -> tuple[np.ndarray, ...]:
        """All ids end to end as int32, and the offsets of each text's ids; null counts as empty.

        ``offsets``: also, for each id, the character of its text at which its piece begins.

        Texts are laid end to end in blocks of ``BLOCK`` characters, a longer one by itself,
        which bounds the arrays whatever the size of the batch.
        """
        cuts, size = [0], 0
        for k, t in enumerate(texts):
            n = len(t) if t else 0
            if size and size + n > BLOCK:
                cuts.append(k)
                size = 0
            size += n
        cuts.append(len(texts))
        parts = [self._encode(texts[a:b], offsets) for a, b in zip(cuts, cuts[1:])]
        if len(parts) == 1:
            return parts[0]
        base = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        ends = [p[1][1:] + b for p, b in zip(parts, base)]
        held = np.concatenate([p[0] for p in parts]), np.concatenate([[0], *ends])
        return (*held, np.concatenate([p[2] for p in parts])) if offsets else held

    def _encode(self, texts: list[str | None], offsets: bool = False) -> tuple[np.ndarray, ...]:
        whole, starts, at = self.pieces([t or "" for t in texts])
        if not whole:
            return (np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int32))[: 3 if offsets else 2]
        if len(self.cache) > CACHE:
            self.forget()
        numbers = self.numbers(whole, starts)
        flat, offset = self.cache.arrays()
        length = (offset[1:] - offset[:-1])[numbers]
        sizes = np.concatenate([[0], np.cumsum(length)])
        where = np.repeat(offset[numbers] - sizes[:-1], length)
        where += np.arange(len(where))
        if not offsets:
            return flat[where], sizes[at]
        begins = np.cumsum([0, *(len(t or "") for t in texts)])[:-1]
        own = starts - np.repeat(begins, np.diff(at))
        return flat[where], sizes[at], np.repeat(own, length).astype(np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")

    def decode_part(self, ids: list[int], offsets: list[int], begin: int, end: int) -> str:
        """Characters ``begin`` to ``end`` of a text from its ids and their offsets: only the pieces that reach into the part are decoded."""
        a = max(0, bisect_right(offsets, begin) - 1)
        a = bisect_left(offsets, offsets[a]) if offsets else 0
        b = bisect_left(offsets, end)
        return self.decode(ids[a:b])[begin - offsets[a] : end - offsets[a]] if a < b else ""


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; it stays between tasks."""
    return Encoder(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """Token ids of every row: ``(id_col, ids array<int>)``, one row for each row of ``df``.

    ``offsets`` adds ``offsets array<int>``: for each id the character at which its piece begins.
    Null and empty texts give an empty list; a null id stays null; repeated rows are each
    encoded; other columns of ``df`` are not read; an empty table gives an empty table.
    """
    path = path or vocabulary()
    names = [id_col, "ids", "offsets"][: 3 if offsets else 2]

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            if batch.num_rows:
                ids, at, *places = enc.encode(batch.column(1).to_pylist(), offsets)
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (ids, *places)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=names)

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    more = ", offsets array<int>" if offsets else ""
    return shipped(rows).mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>{more}")


def decode(df: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """``(id_col, text)`` from ``ids``: the way back. Null ids give a null text."""
    path = path or vocabulary()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    rows = df.select(F.col(id_col), "ids")
    return shipped(rows).mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, text string")


def count(df: DataFrame, text_col: str = "text", path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of ``text_col`` as a last column; the text is left out.

    Null and empty texts have no tokens. A column of ``df`` that is named like the new one is
    replaced.
    """
    path = path or vocabulary()
    keep = [c for c in df.columns if c not in (text_col, name)]

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            if batch.num_rows:
                _, at = enc.encode(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(at))], names=[*keep, name])

    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), f"`{name}` bigint"])
    return shipped(rows).mapInArrow(run, schema)
