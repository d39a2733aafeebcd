"""The trees' scores against a walk from node to node, over the stored model."""

import math
import random

from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.operators import model


def test_scores_equal_a_walk_through_the_stored_nodes(spark, tmp_path):
    r = random.Random(6)
    names = ["symbol", "date", *model.INPUTS, model.LABEL]
    rows = []
    for k in range(400):
        x = [None if r.random() < 0.05 else r.uniform(-1, 1) for _ in model.INPUTS]
        rows.append((f"s{k % 20}", day(k // 20), *x, (x[0] or 0) * 2 - (x[3] or 0) * (x[1] or 0) + r.uniform(-0.1, 0.1)))
    types = "symbol string, date date, " + ", ".join(f"{c} double" for c in names[2:])
    table = spark.createDataFrame(rows, types)
    fitted = model.fit(table, max_iter=4)
    fitted.write().save(str(tmp_path / "model"))
    trees = {}
    for n in spark.read.parquet(str(tmp_path / "model" / "data")).collect():
        trees.setdefault(n.treeID, {})[n.nodeData.id] = n.nodeData
    weights = {w[0]: w[2] for w in spark.read.parquet(str(tmp_path / "model" / "treesMetadata")).collect()}  # tree, metadata, weight

    def walk(nodes, x):
        node = nodes[0]
        while node.leftChild >= 0:
            node = nodes[node.leftChild if x[node.split.featureIndex] <= node.split.leftCategoriesOrThreshold[0] else node.rightChild]
        return node.prediction

    got = {(s.symbol, s.date): s.score for s in model.score(fitted, table).collect()}
    assert len(trees) == 4 and len(got) == 400
    for row in rows:
        x = [v or 0.0 for v in row[2:-1]]
        assert math.isclose(got[row[0], row[1]], sum(weights[t] * walk(nodes, x) for t, nodes in trees.items()), abs_tol=1e-9)


def test_rank_ic_of_scores_equals_pandas(spark):
    r = random.Random(7)
    rows = [(f"s{k}", day(d), r.uniform(0, 1) if k % 3 else 0.5, r.uniform(-1, 1)) for d in range(6) for k in range(12)]
    df = spark.createDataFrame(rows, "symbol string, date date, score double, label double")
    got = {x.date: x.rank_ic for x in model.model_rank_ic(df).collect()}
    frame = df.toPandas()
    want = {d: g["score"].rank().corr(g["label"].rank()) for d, g in frame.groupby("date")}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)
    assert model.model_rank_ic(df.where(F.lit(False))).collect() == []


def test_fit_reads_its_rows_once(spark):
    r = random.Random(8)
    names = ["symbol", "date", *model.INPUTS, model.LABEL]
    rows = [(f"s{k % 5}", day(k // 5), *[r.uniform(-1, 1) for _ in names[2:]]) for k in range(60)]
    table = spark.createDataFrame(rows, "symbol string, date date, " + ", ".join(f"{c} double" for c in names[2:]))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    model.fit(table.mapInArrow(counted, table.schema), max_iter=2)
    assert read.value == 60
