import hashlib
import random
from fractions import Fraction

import pytest

import tidemark.llm.mixing as mixing
from tidemark.llm.mixing import leaf_budgets, mix_sources

LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2, "fr": 1, "xx": 0}}
SCHEMA = "doc_id long, text string, domain string, lang string, source string, epoch string, bucket string"


def water(children, budget):
    """children: name -> (weight, capacity). Whole shares by filling the smallest first."""
    able = {k: c for k, (w, c) in children.items() if w > 0}
    given, left = {k: 0 for k in children}, min(budget, sum(able.values()))
    while able:
        total = sum(children[k][0] for k in able)
        full = [k for k in able if Fraction(able[k], children[k][0]) <= Fraction(left, total)]
        if not full:
            for k in able:
                given[k] = children[k][0] * left // total
            break
        k = min(full, key=lambda k: (Fraction(able[k], children[k][0]), k))
        given[k] = able.pop(k)
        left -= given[k]
    return given


def shares_by_hand(leaves, budget):
    """leaves: (domain, lang, source) -> capacity."""
    def weight(level, value):
        return WEIGHTS.get(level, {}).get(value, 1)

    def below(path):
        depth = len(path)
        if any(weight(LEVELS[d], v) == 0 for d, v in enumerate(path)):
            return 0
        if depth == len(LEVELS):
            return leaves[path]
        return sum(below(path + (v,)) for v in sorted({p[depth] for p in leaves if p[:depth] == path}))

    out = {}

    def down(path, budget):
        depth = len(path)
        if depth == len(LEVELS):
            out[path] = budget
            return
        values = sorted({p[depth] for p in leaves if p[:depth] == path})
        for v, given in water({v: (weight(LEVELS[depth], v), below(path + (v,))) for v in values}, budget).items():
            down(path + (v,), given)

    down((), budget)
    return out


def key(epoch, doc_id, seed=17):
    return int(hashlib.md5(f"{seed}:{epoch}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:15], 16)


def by_hand(rows, percent, epochs):
    groups = {}
    for i, text, *path in rows:
        groups.setdefault(tuple(p or "" for p in path), []).append((i, -(-len((text or "").encode()) // 4)))
    total = {p: sum(t for _, t in g) for p, g in groups.items()}
    shares = shares_by_hand({p: t * epochs for p, t in total.items()}, sum(total.values()) * percent // 100)
    out = []
    for path, group in groups.items():
        if not total[path]:
            continue
        whole, rest = divmod(shares[path], total[path])
        out += [(i, path, e) for e in range(1, whole + 1) for i, _ in group]
        if whole < epochs:
            order = {}
            for i, t in group:
                order.setdefault(key(whole + 1, i), []).append((i, t))
            used = 0
            for k in sorted(order):
                used += sum(t for _, t in order[k])
                if used > rest:
                    break
                out += [(i, path, whole + 1) for i, _ in order[k]]
    return sorted(out, key=str)


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        domain, lang = ("a", "en") if hot else (r.choice("abc"), r.choice(["en", "fr", "de", "xx", None]))
        rows.append((i, "é" * r.randrange(1, 300), domain, lang, "s0" if hot else r.choice(["s1", "s2", "s3", None])))
    return rows + [(None, "text of no one", "a", "en", "s1"), (5, "again five", "a", "en", "s1"), (n, None, "b", "fr", "s1"), (n + 1, "", "c", "de", "s9"), (n + 2, None, None, None, None)]


@pytest.mark.parametrize("percent, epochs, seed", [(60, 2, 1), (5, 1, 2), (100, 1, 3), (100, 3, 4), (150, 2, 5), (0, 2, 6)])
def test_mix(spark, monkeypatch, percent, epochs, seed):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = corpus(240, seed)
    df = spark.createDataFrame([(*r, "old", "kept") for r in rows], SCHEMA).repartition(3)
    out = mix_sources(df, LEVELS, WEIGHTS, percent, epochs)
    assert set(out.columns) == set(df.columns) and dict(out.dtypes)["epoch"] == "bigint"
    got = sorted(((r.doc_id, (r.domain or "", r.lang or "", r.source or ""), r.epoch) for r in out.collect()), key=str)
    assert got == by_hand(rows, percent, epochs)


def test_shortages_go_to_siblings_first(spark):
    leaves = {("a", "en", "s0"): 10, ("a", "en", "s1"): 1000, ("a", "fr", "s0"): 1000, ("b", "en", "s0"): 1000}
    df = spark.createDataFrame([(*p, c) for p, c in leaves.items()], "domain string, lang string, source string, capacity long")
    got = {(r.domain, r.lang, r.source): r.share for r in leaf_budgets(df, LEVELS, WEIGHTS, 400).collect()}
    assert got == {("a", "en", "s0"): 10, ("a", "en", "s1"): 190, ("a", "fr", "s0"): 100, ("b", "en", "s0"): 100}
    assert got == shares_by_hand(leaves, 400)


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA), LEVELS, WEIGHTS).count() == 0


def test_large_tables_of_leaves_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", -1)
    rows = corpus(100, 9)
    df = spark.createDataFrame([(*r, "old", "kept") for r in rows], SCHEMA)
    got = sorted(((r.doc_id, (r.domain or "", r.lang or "", r.source or ""), r.epoch) for r in mix_sources(df, LEVELS, WEIGHTS).collect()), key=str)
    assert got == by_hand(rows, 60, 2)
