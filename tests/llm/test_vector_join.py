import math

import numpy as np
import pytest

import tidemark.llm.vector_join as vector_join
from tests.llm.samples import Sets
from tidemark.llm.vector_join import vector_groups

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, node string"


def by_hand(rows, least=0.93):
    ok, groups, links = [], Sets(), {}
    for k, (i, v, label) in enumerate(rows):
        good = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
        ok.append(np.array(v, np.float32).astype(float) if good else None)
        groups.top(k)
        links[k] = 0
        for j in range(k):
            if good and ok[j] is not None and rows[j][2] == label and len(rows[j][1]) == len(v):
                a, b = ok[j], ok[k]
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    groups.join(j, k)
                    links[k] += 1
                    links[j] += 1
    least_id = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least_id[groups.top(k)] = min(i, least_id.get(groups.top(k), i))
    return sorted(((i, links[k], least_id.get(groups.top(k)), i == least_id.get(groups.top(k))) for k, (i, _, _) in enumerate(rows)), key=str)


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    out = vector_groups(df)
    assert out.columns == ["vec_id", "embedding", "label", "node", "n_links", "component_id", "kept"]
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=str)


def cloud(seed, n, dim=12, spread=0.35, centres=5):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, dim))
    v = c[r.integers(0, centres, n)] + spread * r.standard_normal((n, dim)) * r.random((n, 1))
    return [(int(i), [float(x) for x in np.float32(row)], int(i % 3)) for i, row in enumerate(v)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(1, 60) + [
        (100, None, 1), (101, [], 1), (102, [0.0] * 12, 1), (103, [nan] * 12, 1), (104, [1.0, None], 1), (105, [inf, 1.0], 1),
        (106, [1.0, 0.0], None), (107, [1.0, 0.0], 1), (108, [2.0, 0.0], 1), (109, [1.0, 0.0, 0.0], 1), (110, [1.0, 0.0], 1),
        (111, [1e30, 0.0], 1), (112, [-1.0, 0.0], 1), (107, [1.0, 0.0], 1), (107, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (None, [0.5, -9.0], 1),
    ]
    assert result(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("seed, spread", [(2, 0.25), (3, 0.6)])
def test_cells_and_blocks(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(vector_join, "CELL", 12)
    monkeypatch.setattr(vector_join, "BLOCK", 7)
    rows = cloud(seed, 240, spread=spread)
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(40)]
    assert result(spark, rows) == by_hand(rows)


def test_empty_table(spark):
    assert result(spark, []) == []
