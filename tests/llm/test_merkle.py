import hashlib

import pytest

from tests.llm.samples import documents, odd_documents
from tidemark.llm.merkle import fold, leaf_of, merkle_manifest, siblings

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and for each leaf the (left, right) texts level by level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for path, k in zip(paths, at):
            run = level[k - k % 8:k - k % 8 + 8]
            path.append(("".join(run[:k % 8]), "".join(run[k % 8 + 1:])))
        level, at = [digest("".join(level[i:i + 8])) for i in range(0, len(level), 8)], [k // 8 for k in at]
    return level[0], paths


def by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = tree([built[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), built[g][1]):
            out.append((x[3][0], x[2], built[g][0], root, tuple(path + top)))
    return sorted(out, key=str)


def result(df, group="lang"):
    rows = merkle_manifest(df, FIELDS, group, "doc_id").collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in rows), key=str)


def rows_of(df):
    return [tuple(r[c] for c in FIELDS) for r in df.collect()]


def test_odd_rows_and_clashing_names(spark):
    df = documents(spark, odd_documents(), clashing=("g", "digest", "pos", "leaf", "path", "at", "n"))
    assert result(df) == by_hand(rows_of(df))


@pytest.mark.parametrize("sizes", [
    {"en": 1}, {"en": 8, None: 1}, {"en": 9, "": 3, None: 2, "é": 64, "z": 65}, {"en": 512, "de": 513}, {f"l{i}": 2 for i in range(70)}, {"en": 4200, "fr": 5},
])
def test_sizes(spark, sizes):
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 10007, None if i % 11 == 0 else f"s{i}", lang, None if i % 5 == 0 else i, None if i % 13 == 0 else f"Tëxt {i}"))
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert result(df) == by_hand(rows)


def test_empty_table(spark):
    assert result(documents(spark, [])) == []


def test_a_path_proves_its_own_leaf_only(spark):
    from pyspark.sql import functions as F

    df = documents(spark, [(i, f"text {i} " * (100_000 if i == 3 else 1)) for i in range(100)])
    made = merkle_manifest(df.withColumn("other", leaf_of([F.upper("text")])), FIELDS, "lang", "doc_id", keep=["doc_id", "other"])
    rows = made.select("root", fold(F.col("leaf"), F.col("path")).alias("own"), fold(F.col("other"), F.col("path")).alias("changed"),
                       (F.length(siblings(F.col("path"))) % 64).alias("odd")).collect()
    assert len(rows) == 100 and all(r.own == r.root and r.changed != r.root and r.odd == 0 for r in rows)
