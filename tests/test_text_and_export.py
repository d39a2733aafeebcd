import hashlib
import math

import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.functions import text as text_functions
from tidemark.functions.text import char_ngram_tf, cosine_of_pairs, strip_think
from tidemark.operators.export import dense_vectors

TEXTS = {"a": "Momentum  of 5 Days\tand more", "b": "momentum of 20 days and more", "c": "量能萎縮 反轉 α", "d": "ab", "e": "", "f": "Momentum of 5 days and more"}


def vector(text):
    counts = [0.0] * 256
    squeezed = " ".join(text.lower().split())
    for i in range(max(0, len(squeezed) - 2)):
        counts[int(hashlib.md5(squeezed[i:i + 3].encode()).hexdigest(), 16) % 256] += 1
    norm = math.sqrt(sum(c * c for c in counts)) or 1.0
    return [c / norm for c in counts]


def test_ngram_vectors(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    got = {}
    for r in char_ngram_tf(df, ["id"], "text").collect():
        got.setdefault(r.id, [0.0] * 256)[r.bucket] = r.weight
    assert set(got) == {"a", "b", "c", "f"}
    for key, weights in got.items():
        assert max(abs(x - y) for x, y in zip(weights, vector(TEXTS[key]))) < 1e-12


def test_cosine(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    pairs = spark.createDataFrame([("a", "f"), ("a", "b"), ("a", "c"), ("a", "d"), ("a", "f")], "l string, r string")
    got = {(r.l, r.r): r.cosine for r in cosine_of_pairs(pairs, char_ngram_tf(df, ["id"], "text"), "l", "r", "id").collect()}
    for (l, r), cosine in got.items():
        assert abs(cosine - sum(x * y for x, y in zip(vector(TEXTS[l]), vector(TEXTS[r])))) < 1e-12
    assert abs(got[("a", "f")] - 1) < 1e-12


def test_strip_think(spark):
    df = spark.createDataFrame([("<think>a\nb</think>x<think>c</think>y",), ("<think>open",)], "t string")
    assert [r[0] for r in df.select(strip_think(F.col("t"))).collect()] == ["xy", "<think>open"]


def test_dense_vectors(make_bars):
    bars = make_bars({"2330": [1.0, 2.0], "abcd": [5.0]}, dates={"2330": [day(0), day(2)], "abcd": [day(1)]})
    got = {(r.symbol, r.field): r for r in dense_vectors(bars).collect()}
    close = got[("2330", "close")].vector
    assert len(got) == 12 and len(close) == 3 and close[0] == 1.0 and math.isnan(close[1]) and close[2] == 2.0
    assert math.isnan(got[("ABCD", "close")].vector[0]) and got[("ABCD", "close")].start_index == 0


def test_symbols_that_differ_in_case_are_one(make_bars):
    bars = make_bars({"ab": [1.0, 2.0], "AB": [3.0, None], "c": [5.0, 6.0]}, volumes={"AB": [10, 20]})
    got = {(r.symbol, r.field): list(r.vector) for r in dense_vectors(bars).collect()}
    assert set(s for s, _ in got) == {"AB", "C"} and all(len(v) == 2 for v in got.values())
    assert got["AB", "close"] == [3.0, 2.0] and got["C", "close"] == [5.0, 6.0]


def test_texts_may_cross_the_pieces_that_are_counted_at_a_time(monkeypatch):
    monkeypatch.setattr(text_functions, "PIECE", 7)
    texts = ["abc" * 9, "x 量能 αβγ yz", "abc", "aaaaaaa", "abcabcab"]
    batch = pa.record_batch({"id": pa.array(["a", "b", None, "a", None]), "text": pa.array(texts)})
    for n in (2, 3, 4):
        out, = text_functions._count_grams(["id"], n)([batch])
        for key, counts in zip(out["id"].to_pylist(), out["_counts"].to_pylist(), strict=True):
            want = [0] * 256
            for t in (t for t, k in zip(texts, batch["id"].to_pylist()) if k == key):
                for i in range(len(t) - n + 1):
                    want[int(hashlib.md5(t[i:i + n].encode()).hexdigest(), 16) % 256] += 1
            assert counts == want
        assert out["id"].to_pylist() == ["a", "b", None]


def test_ngrams_of_repeated_keys_add_up(spark):
    mixed = "Ünï " + "ab cd " * 5 + "量能 αβγ" + " zz" * 9
    rows = [("a", mixed), ("a", "abcd"), (None, "abc abc"), (None, mixed), ("b", "ab"), ("c", None)]
    for n in (2, 3, 4):
        want = {}
        for key, value in rows:
            squeezed = " ".join((value or "").lower().split())
            for i in range(len(squeezed) - n + 1):
                at = key, int(hashlib.md5(squeezed[i:i + n].encode()).hexdigest(), 16) % 256
                want[at] = want.get(at, 0) + 1
        found = char_ngram_tf(spark.createDataFrame(rows, "id string, text string").repartition(3), ["id"], "text", n)
        assert {(r.id, r.bucket): r.tf for r in found.collect()} == want
        assert found.count() == len(want)


def test_ngrams_are_counted_before_the_shuffle(spark):
    plan = char_ngram_tf(spark.createDataFrame([("a", "abc")], "id string, text string"), ["id"], "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and plan.count("Generate") == 1 and "Window" not in plan
