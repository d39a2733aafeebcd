import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import similar
from tidemark.operators.similar import ngram_links


def vector(text):
    text = " ".join((text or "").lower().split())
    out = {}
    for i in range(len(text) - 2):
        b = int(hashlib.md5(text[i:i + 3].encode()).hexdigest(), 16) % 256
        out[b] = out.get(b, 0) + 1
    return out


def by_hand(rows, least):
    vectors = [(i, vector(t)) for i, t in rows]
    out = []
    for k, (i, v) in enumerate(vectors):
        if v:
            cosines = [sum(n * w.get(b, 0) for b, n in v.items()) / math.sqrt(sum(n * n for n in v.values()) * sum(n * n for n in w.values()))
                       for j, (_, w) in enumerate(vectors) if j != k and w]
            near = [c for c in cosines if c >= least]
            out.append((str(i), len(near), round(max(near), 9) if near else None))
    return sorted(out, key=str)


def result(spark, rows, least, **options):
    links, work = ngram_links(spark.createDataFrame(rows, "id string, text string").repartition(3), "id", "text", least, **options)
    return sorted(((str(r.id), r.n_links, r.nearest and round(r.nearest, 9)) for r in links.collect()), key=str), work.toPandas()


def texts(seed, n):
    r = random.Random(seed)
    base = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(30)) for _ in range(6)]
    out = []
    for k in range(n):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 1, 3, 10])):
            words[r.randrange(len(words))] = f"x{r.randrange(999)}"
        out.append((f"t{k}", " ".join(words)))
    return out + [("none", None), ("empty", ""), ("ab", "ab"), ("abc", "ABC"), ("abc2", " abc "), (None, "abc abd"), ("t0", out[0][1])]


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("least", [0.6, 0.9])
def test_links_equal_all_pairs(spark, block, least):
    rows = texts(1, 120)
    assert result(spark, rows, least, block=block)[0] == by_hand(rows, least)


def test_a_large_group_of_copies_is_one_vector(spark):
    rows = [(f"c{i}", "the very same words once more") for i in range(3000)] + [("d", "the very same words once morf"), ("e", "nothing of that")]
    got, work = result(spark, rows, 0.9)
    assert {x[1] for x in got} == {0, 3000} and len(got) == 3002
    assert work["pairs"].sum() == 3 and work["rows"].sum() == 3 and work["linked"].sum() == 1


def test_bounds_spare_products(spark):
    rows = [(f"{k}{i}", " ".join(f"{k * 3}{i % 7}{k}" for _ in range(4))) for k in "abcdefghij" for i in range(30)]
    _, work = result(spark, rows, 0.9)
    assert 0 < work["pairs"].sum() and work["compared"].sum() < work["pairs"].sum() / 2


def test_empty(spark):
    assert result(spark, [], 0.9)[0] == []


def block_table(counts, own, copies):
    counts = np.asarray(counts)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * 256), pa.array(counts.astype(np.int32).ravel()))
    packed = next(similar._pack(iter([pa.RecordBatch.from_arrays([pa.array(range(len(counts))), lists], names=["key", "_counts"])])))
    return pa.table({"own": pa.array(own, pa.int32()), "node": pa.array(range(len(counts)), pa.int64()), "copies": pa.array(copies, pa.int64()),
                     "tf": packed.column(1)})


def block_by_hand(counts, own, copies, least):
    counts, own = np.asarray(counts, np.int64), np.asarray(own)
    square = (counts * counts).sum(axis=1).astype(float)
    cosine = (counts @ counts.T).astype(float) / np.sqrt(np.outer(square, square))
    hit = cosine >= least
    if len(set(own)) > 1:
        hit &= own[:, None] != own
    np.fill_diagonal(hit, False)
    return {k: (int((hit[k] * np.asarray(copies)).sum()), float(cosine[k][hit[k]].max())) for k in np.flatnonzero(hit.any(axis=1)).tolist()}


def linked(table, least, j):
    out = similar._block_links(least)((pa.scalar(0), pa.scalar(j)), table)
    return {r["node"]: (r["links"], r["nearest"]) for r in out.to_pylist() if r["node"] is not None}, out.to_pylist()[-1]


@pytest.mark.parametrize("two", [False, True])
@pytest.mark.parametrize("least", [0.5, 0.9])
def test_block_links_equal_whole_numbers(two, least, monkeypatch):
    monkeypatch.setattr(similar, "COLUMNS", 100)  # several products
    r = np.random.default_rng(5)
    base = r.poisson(3, (6, 256)) * r.integers(0, 2, (6, 256))
    counts = base[r.integers(0, 6, 700)] * r.integers(1, 4, (700, 1)) + r.poisson(r.choice([0.02, 0.3, 3], (700, 1)), (700, 256))
    counts[::50] = counts[::50] * 300 + 1  # wider than a byte
    counts[1::50] = counts[::50]
    counts[1::50, 7] += 1  # all but copies: nearest ones that single precision cannot tell apart
    counts[2::50] = counts[::50]
    counts[2::50, 9] += 2
    copies, own = r.choice([1, 1, 1, 2, 9], 700), r.integers(0, 2, 700) if two else np.zeros(700, int)
    got, summary = linked(block_table(counts, own, copies), least, int(two))
    assert same_links(got, block_by_hand(counts, own, copies, least))
    assert summary["linked"] <= summary["compared"] <= summary["pairs"]


def same_links(got, wanted):
    return got.keys() == wanted.keys() and all(got[k][0] == wanted[k][0] and abs(got[k][1] - wanted[k][1]) < 1e-15 for k in got)


def test_cosines_at_the_threshold_are_whole_numbers():
    counts = np.zeros((6, 256), int)
    counts[0, 0] = 1
    counts[1:, :2] = [(3, 4), (30001, 40001), (29999, 40000), (300000, 400000), (299999, 400000)]
    got, _ = linked(block_table(counts, [0, 1, 1, 1, 1, 1], [1] * 6), 0.6, 1)
    assert set(got) == {0, 1, 2, 4} and got[0] == (3, 30001 / math.sqrt(30001 ** 2 + 40001 ** 2))


def test_counts_of_any_width(spark):
    rows = [("a", "a" * 70000), ("b", "a" * 300 + "b"), ("c", "a" * 300), ("d", "aaaa"), ("e", "ab" * 400), ("f", "xyz")]
    assert result(spark, rows, 0.9)[0] == by_hand(rows, 0.9)


def test_vectors_are_sent_to_few_blocks(spark):
    """Every vector goes to each block once, so their number, not only the products, sets what is shuffled."""
    rows = spark.range(40000).selectExpr("id", "md5(cast(id as string)) as text")
    links, work = ngram_links(rows, "id", "text", 0.9)
    done = work.toPandas()
    assert links.count() == 40000 and done["rows"].sum() > 39990
    assert done["pairs"].sum() == done["rows"].sum() * (done["rows"].sum() - 1) // 2
    assert len(done) < 150
