import random

import pytest

from grainmill.operators.packing import files, next_fit, numbered, summarise

ORDER = ["seq", "chunk_idx"]


def model(words, limit):
    out, current, number, any_ = [], 0, 0, False
    for w in words:
        if current + w > limit and any_:
            current, number = 0, number + 1
        any_ = True
        current += w
        out.append(number)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_against_model(spark, seed):
    rnd = random.Random(seed)
    limit = rnd.choice([1, 7, 10, 40, 1000])
    words = [rnd.choice([0, 1, 2, 3, 5, 9, 12, 30]) for _ in range(rnd.choice([0, 1, 5, 60, 300]))]
    rows = [(n // 4, n % 4, w) for n, w in enumerate(words)]
    got = next_fit(spark.createDataFrame(rows, "seq long, chunk_idx int, words int"), limit, ORDER, blocks=rnd.choice([1, 3, 7])).orderBy(*ORDER).collect()
    assert [r["bin"] for r in got] == model(words, limit)


@pytest.mark.parametrize("seed", range(200))
def test_blocks_compose(seed):
    import numpy as np

    rnd = random.Random(seed)
    limit = rnd.choice([1, 3, 10, 25])
    blocks = [[rnd.choice([0, 1, 2, 5, 11]) for _ in range(rnd.randint(1, 12))] for _ in range(rnd.randint(1, 5))]
    want = model([w for b in blocks for w in b], limit)
    inside, number, begun, got = 0, 0, False, []
    for b in blocks:
        words = np.array(b)
        got += numbered(words, limit, inside, number, begun).tolist()
        rows = summarise(words, limit)
        if not begun:
            inside, number, begun = rows[-1][1], number + rows[-1][2] - 1, True
        else:
            hit = next(r for r in rows if inside <= r[0])
            inside, number = (inside + hit[1] if hit[3] else hit[1]), number + hit[2]
        assert number == got[-1]
    assert got == want


def test_names(spark):
    words, subs = [4, 3, 5, 12, 2, 2], ["python", "python", "markdown", "css", "css", "html"]
    df = spark.createDataFrame([(n, 0, w, s) for n, (w, s) in enumerate(zip(words, subs))], "seq long, chunk_idx int, words int, subdir string")
    bins = next_fit(df, 10, ORDER).join(df.select(*ORDER, "subdir"), ORDER)
    assert [r["bin"] for r in bins.orderBy("seq").collect()] == [0, 0, 1, 2, 3, 3]
    assert [r["rel_file"] for r in files(bins, ORDER).orderBy("bin").collect()] == ["markdown/chunk_0.txt", "css/chunk_0.txt", "css/chunk_1.txt", "remaining/chunk_0.txt"]


def test_nulls(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, -4), (3, 0, 5)], "seq long, chunk_idx int, words int")
    assert {r["bin"] for r in next_fit(df, 5, ORDER).collect()} == {0}
