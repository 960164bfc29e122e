import random

import numpy as np
import pytest

from grainmill.llm import spans as S


def brute(docs, span):
    held = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            held.setdefault(t[i : i + span], set()).add(d)
    pairs = {(a, b) for ds in held.values() for a in ds for b in ds if a < b}
    cover = {}
    for d, t in docs:
        got = np.zeros(len(t or ""), bool)
        for i in range(len(t or "") - span + 1):
            if len(held[t[i : i + span]]) > 1:
                got[i : i + span] = True
        cover[d] = max(int(got.sum()), cover.get(d, 0))
    return pairs, cover


def made(seed, n=40, span=12):
    rnd = random.Random(seed)
    alphabet = rnd.choice(["ab", "abcdefgh", "aé中😀 \n"])
    parts = ["".join(rnd.choices(alphabet, k=rnd.randint(3, 40))) for _ in range(12)] + ["a" * 60, "ab" * 30]
    docs = [(k, "".join(rnd.choices(parts, k=rnd.randint(0, 4))) + "".join(rnd.choices(alphabet, k=rnd.randint(0, 15)))) for k in range(n)]
    return docs + [(100, None), (101, ""), (102, docs[0][1]), (103, docs[0][1])]


@pytest.mark.parametrize("seed, bucket", [(1, 64), (2, 2), (3, 64), (4, 3), (5, 2)])
def test_against_brute_force(spark, seed, bucket):
    docs = made(seed)
    pairs, cover = brute(docs, 12)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got, _ = S.shared_spans(df, span=12, bucket=bucket)
    assert sorted(tuple(r) for r in got.collect()) == sorted(pairs)
    rows = {r["doc_id"]: r["shared_chars"] for r in S.shared_share(df, span=12, bucket=bucket).collect()}
    assert rows == cover


def test_full_length(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choices("abcdefghijklmnop \n", k=n))
    both, almost, run = word(200), word(199), "x" * 5000
    docs = [(1, word(300) + both + word(50)), (2, both + word(10)), (3, "A" + almost + "B"), (4, "C" + almost + "D"), (5, "y" + run), (6, "z" + run[:210] + "q"), (7, run[:199])]
    got, _ = S.shared_spans(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2), (5, 6)]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, digest string")
    pairs, _ = S.shared_spans(empty)
    assert pairs.count() == 0 and S.shared_share(empty).count() == 0
    same = spark.createDataFrame([(None, "a" * 300, "x"), (1, "a" * 300, "x"), (1, "a" * 300, "x"), (2, "a" * 300, "y")], "doc_id long, text string, key string")
    assert [tuple(r) for r in S.shared_spans(same)[0].collect()] == [(1, 2)]


def test_runs_of_blocks():
    texts = ["abc" * 50, "", "x" * 10, "é" * 200 + "abc" * 50]
    doc, key, begin, n = S.runs_of(texts, 20, 10)
    assert set(doc.tolist()) == {0, 3}
    assert [n[doc == d].sum() for d in (0, 3)] == [131, 331]  # every window is in one run
    alone = S.runs_of([texts[0]], 20, 10)
    assert set(alone[1].tolist()) <= set(key[doc == 3].tolist())


def test_long_texts_in_parts(monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choices("abc", k=500))
    whole = S.runs_of([text], 20, 10)
    monkeypatch.setattr(S, "BLOCK", 64)
    got = {}
    for ids, texts, begins in S._blocks([7, None, 8], [text, "x" * 50, None], 20):
        doc, key, place, n = S.runs_of(texts, 20, 10)
        for d, k, p, c in zip(doc.tolist(), key.tolist(), place.tolist(), n.tolist()):
            for i in range(c):
                got[begins[d] + p + i] = k
    want = {p + i: k for k, p, c in zip(*(x.tolist() for x in whole[1:])) for i in range(c)}
    assert got == want


@pytest.mark.parametrize("bucket", [2048, 20000])
def test_one_span_in_very_many_records_stays_linear(spark, bucket):
    head = "".join(random.Random(1).choices("abcdefghij klmnop", k=260))
    n = 10000
    df = spark.range(n).selectExpr("id as doc_id", f"concat('{head}', repeat(sha2(cast(id as string), 256), 2)) as text")
    members, _ = S.shared_groups(df, bucket=bucket)
    rows = members.groupBy("set_id").count().collect()
    assert max(r["count"] for r in rows) == n and sum(r["count"] for r in rows) < 40 * n
    assert S.shared_share(df, bucket=bucket).where("shared_chars between 260 and 280").count() == n
    got = S.representatives(df, bucket=bucket)
    assert got.where(f"with_id = 0 and records = {n}").count() == n
