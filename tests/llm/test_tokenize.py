import random

import pytest

from grainmill.llm import tokenize as T

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = ["'", "s", "t", " ", "  ", "\n", "re", "'ll", "x", "1", "é", "中", "\t", "!", "'ve", "\u3000", "\x85", "\x1c", "d", "m", "\U0001e5f6", "\u1c89", "<|endoftext|>", "\x00", "\u00a0", "abcdefghij", "😀"]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(T.vocabulary())
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encoded(texts):
    ids, at = T.Encoder(T.vocabulary()).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_random_texts(reference):
    rnd = random.Random(1)
    texts = [None, "", *("".join(rnd.choices(ALPHABET, k=rnd.randint(0, 14))) for _ in range(20000))]
    assert encoded(texts) == reference(texts)


def test_long_pieces(reference):
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("abcXYZ", k=n)) for n in (47, 48, 49, 50, 300, 3000)] + ["a" * 2000, " " * 3000 + "x", "\n" * 70]
    assert encoded(texts) == reference(texts)


def test_decoding():
    e = T.Encoder(T.vocabulary())
    for s in ("", "Hello  world\n", "naïve 中文 😀's", "\x00\x85"):
        assert e.decode(e.encode([s])[0].tolist()) == s


def test_cache_is_emptied(monkeypatch, reference):
    monkeypatch.setattr(T, "CACHE", 3)
    e = T.Encoder(T.vocabulary())
    for _ in range(3):
        ids, at = e.encode(["one two three four five six"])
    assert ids.tolist() == reference(["one two three four five six"])[0]


def test_blocks(monkeypatch, reference):
    rnd = random.Random(3)
    texts = [None, "", *("".join(rnd.choices(ALPHABET, k=rnd.randint(0, 60))) for _ in range(300)), ""]
    monkeypatch.setattr(T, "BLOCK", 64)
    assert encoded(texts) == reference(texts)
    assert encoded([]) == [] and encoded([None]) == [[]]


def test_table(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b", 9), (3, "a b", 9), (None, "x", 9)], "doc_id long, text string, ids int")
    rows = sorted(T.encode(df).collect(), key=repr)
    assert len(rows) == 5 and [r["ids"] for r in rows if r["doc_id"] in (1, 2)] == [[], []]
    assert T.encode(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert T.encode(df.limit(0)).count() == 0
    counted = T.count(df.withColumnRenamed("ids", "n_tokens"))
    assert counted.columns == ["doc_id", "n_tokens"] and sorted(r["n_tokens"] for r in counted.collect()) == [0, 0, 1, 2, 2]


def test_scan_against_single_steps():
    import numpy as np

    m, rnd = T.monoid(), random.Random(4)
    for n in (1, 2, 3, 7, 500):
        symbols = np.array(rnd.choices([*T.SYMBOLS, *[T.APOSTROPHE, T.R, T.E] * 3], k=n), np.uint8)
        first = np.array([k == 0 or rnd.random() < 0.1 for k in range(n)])
        state, want = T.START, []
        for x, f in zip(symbols.tolist(), first.tolist()):
            state = T.next_state(T.START if f else state, x)
            want.append(state)
        assert m.states(symbols, first).tolist() == want
    assert len(m.constant) < 100


def test_offsets_find_any_part(spark):
    rnd = random.Random(5)
    texts = [None, "", "naïve 中文 😀's we'll", *("".join(rnd.choices(ALPHABET, k=rnd.randint(0, 40))) for _ in range(200))]
    e = T.Encoder(T.vocabulary())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in T.encode(df, offsets=True).collect():
        t = texts[r["doc_id"]] or ""
        assert len(r["ids"]) == len(r["offsets"]) and e.decode(r["ids"]) == t
        a = rnd.randint(0, len(t))
        b = rnd.randint(a, len(t))
        assert e.decode_part(r["ids"], r["offsets"], a, b) == t[a:b]
    assert {r["doc_id"]: r["text"] for r in T.decode(T.encode(df)).collect()} == {k: t or "" for k, t in enumerate(texts)}
