import math
import tracemalloc

import numpy as np
import pytest

import tidemark.llm.scan_index as scan_index
from tidemark.llm.scan_index import fit_index, nearest_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, list string, d string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def by_hand(rows, asked, k):
    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    out = set()
    for q in {i for i, _ in asked if i is not None}:
        best = {}
        for i, v in asked:
            if i == q and good(v):
                for j, w in rows:
                    if j is not None and j != q and good(w) and len(w) == len(v):
                        a, b = np.float32(v).astype(float), np.float32(w).astype(float)
                        best[j] = min(best.get(j, math.inf), float(np.sqrt(((b - a) ** 2).sum())))
        for rank, (s, j) in enumerate(sorted((s, j) for j, s in best.items())[:k]):
            out.add((q, rank + 1, j, round(s, 9)))
    return out


def result(spark, rows, asked, k=10, all_lists=False):
    vectors, queries = table(spark, rows), table(spark, asked)
    index = fit_index(vectors, k)
    if all_lists:
        index.probes = {d: len(c) for d, c in index.centroids.items()}
    out = nearest_vectors(vectors, queries, index, k)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def cloud(seed, n, dim=48, centres=6, spread=0.5):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, dim))
    v = c[r.integers(0, centres, n)] + spread * r.standard_normal((n, dim))
    return [(i, [float(x) for x in np.float32(row)]) for i, row in enumerate(v)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(1, 30, dim=3) + [
        (100, None), (101, []), (102, [0.0] * 3), (103, [nan] * 3), (104, [1.0, None, 2.0]), (105, [inf, 1.0, 1.0]), (106, [1.0, 0.0]), (107, [1.0, 0.0]),
        (108, [2.0, 0.0]), (107, [1.0, 0.0]), (107, [5.0, 5.0]), (None, [1.0, 0.0]), (109, [1e30, 1.0, 1.0]), (110, [4.0] * 5)]
    assert result(spark, rows, rows, all_lists=True) == by_hand(rows, rows, 10)


def test_copies_tie_and_hot_lists_are_parted(spark, monkeypatch):
    monkeypatch.setattr(scan_index, "PART", 16)
    monkeypatch.setattr(scan_index, "ASKED", 3)
    rows = cloud(2, 120)
    rows += [(1000 + 3 * k, rows[0][1]) for k in range(100)]  # a third and more are one vector
    asked = [r for r in rows if r[0] % 10 == 0]
    want = by_hand(rows, asked, 10)
    got = result(spark, rows, asked)
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)
    of = {q for q, _, _, s in want if s == 0}
    assert of and {g for g in got if g[0] in of} == {w for w in want if w[0] in of}


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_recall(spark, spread):
    rows = cloud(3, 3000, spread=spread)
    asked = rows[::60]
    want, got = by_hand(rows, asked, 10), result(spark, rows, asked)
    near = {(q, j) for q, _, j, _ in want}
    assert len(got) == len(want) and len({(q, j) for q, _, j, _ in got} & near) >= 0.9 * len(near)


def test_fewer_candidates_than_asked_for(spark):
    rows = cloud(4, 7)
    assert result(spark, rows, rows) == by_hand(rows, rows, 10)
    assert result(spark, [], []) == set() and result(spark, rows, []) == set() and result(spark, [], rows) == set()


def test_early_tests_abandon_most_candidates():
    rows = np.array([v for _, v in cloud(5, 2000, dim=64, centres=1, spread=1.0)])
    near = rows[0] + 0.05 * np.random.default_rng(1).standard_normal((20, 64))
    every = np.concatenate([rows, near])
    blocks = [np.ascontiguousarray(every[:, c:c + 16]) for c in range(0, 64, 16)]
    left = scan_index._adaptive(blocks, rows[0], np.arange(len(every)) != 0, math.inf, 10, 64)
    assert len(left) < 100
    exact = np.sqrt(((every - rows[0]) ** 2).sum(1))
    exact[0] = np.inf
    assert set(np.argsort(exact)[:10]) <= set(left)


def test_no_table_has_a_row_for_each_query_and_list(spark, monkeypatch):
    made = {}

    def kept(df, label, store=scan_index.stored):
        out = store(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(scan_index, "stored", kept)
    rows = cloud(7, 1600, spread=3.0)  # 40 lists, nearly all probed
    asked = rows[::2]
    assert len({q for q, *_ in result(spark, rows, asked)}) == len(asked)
    assert max(made.values()) <= len(asked) * 10 * 2


def test_fitting_holds_few_distances_at_a_time():
    x = np.random.default_rng(8).standard_normal((4096, 8))
    tracemalloc.start()
    scan_index._nearest(x, x)
    scan_index._probes(np.tile(x, (3, 1)), x[:64], 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # 2,048 rows of 4,096 distances take 67 MB


def test_repeated_rows_leave_room_for_other_candidates(spark):
    rows = cloud(6, 200, dim=20) * 12
    asked = rows[:200:5]
    want, got = by_hand(rows[:200], asked, 10), result(spark, rows, asked, all_lists=True)
    assert len(got) == len(want) and len(got & want) >= 0.98 * len(want)


def test_blocks_of_queries_and_many_tiles(spark, monkeypatch):
    for name, value in (("BLOCK", 1 << 12), ("TILE", 64), ("PART", 32), ("ASKED", 5)):
        monkeypatch.setattr(scan_index, name, value)
    rows = [(i, [x + 1000 for x in v]) for i, v in cloud(9, 400, dim=40)]  # far from zero, near to each other
    asked = rows[::4]
    want, got = by_hand(rows, asked, 10), result(spark, rows, asked, all_lists=True)
    assert len(got) == len(want) and len(got & want) >= 0.98 * len(want)


@pytest.mark.parametrize("centres, followed", [(40, True), (1, False)])
def test_a_tile_finds_the_nearest(centres, followed, monkeypatch):
    rows = np.float32([v for _, v in cloud(10, 3000, dim=64, centres=centres, spread=0.1)])
    asks, calls = rows[:150], []
    follow = scan_index._Tile._follow
    monkeypatch.setattr(scan_index._Tile, "_follow", lambda self, *a: calls.append(1) or follow(self, *a))
    far = np.sqrt(((asks[:, None].astype(float) - rows[None].astype(float)) ** 2).sum(2))
    far[np.arange(150), np.arange(150)] = np.inf
    order = np.argsort(far, axis=1)[:, :10]
    bound = np.take_along_axis(far, order, 1)[:, -1]
    index = scan_index.Index({64: np.linalg.qr(np.random.default_rng(1).standard_normal((64, 64)))[0]}, {64: np.zeros((2, 64))}, {64: 2})
    for b in (bound * 1.02, np.full(150, np.inf)):
        tile = scan_index._Tile(index, 64, 10, False, 40)
        tile.asks = [(np.zeros(150, int), np.arange(150), np.arange(150), np.full(150, np.inf), b, asks)]
        for i in range(0, 3000, 700):
            tile.meet(1, np.arange(i, min(3000, i + 700)), rows[i:i + 700])
        right = [set(a) == set(c) for a, c in zip(tile.best, order)]
        assert np.mean(right) >= 0.95
        assert bool(calls) == followed or not np.isfinite(b).all()
