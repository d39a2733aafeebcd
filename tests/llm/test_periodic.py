import random

import pytest

from tests.llm.samples import WORD, documents, odd_documents
from tidemark.llm.periodic import collapse_runs, runs_of


def by_hand(words, least_length=6, least_periods=4):
    """For each period the maximal stretches of words that far apart equal, without those that have a smaller period."""
    n, out = len(words), []
    for q in range(1, n // least_periods + 1):
        s = 0
        while s + q < n:
            t = s
            while t + q < n and words[t] == words[t + q]:
                t += 1
            length = t - s + q
            if t > s and length >= max(least_length, least_periods * q):
                part = words[s:s + length]
                if all(part[p:] != part[:-p] for p in range(1, q)):
                    out.append((s, length, q))
            s = t + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("least_length, least_periods", [(6, 4), (2, 2), (6, 3), (1, 4), (9, 2)])
def test_runs_of_small_alphabets(seed, least_length, least_periods):
    r, docs = random.Random(seed), []
    for _ in range(150):
        words = [r.randrange(r.choice([1, 2, 3, 20])) for _ in range(r.randrange(40))]
        if r.random() < 0.5:
            words += ([r.randrange(3) for _ in range(r.randrange(1, 7))] * 12)[:r.randrange(2, 50)] + [r.randrange(3) for _ in range(5)]
        docs.append(words)
    assert runs_of(docs, least_length, least_periods) == [by_hand(d, least_length, least_periods) for d in docs]


def test_fibonacci_words_have_no_fourth_power():
    x, y = "a", "ab"
    while len(y) < 3000:
        x, y = y, y + x
    assert runs_of([list(y)]) == [[]] and runs_of([list(y[:400])], 2, 2) == [by_hand(list(y[:400]), 2, 2)]


def test_documents(spark):
    texts = odd_documents() + [
        (30, "x y " * 7 + "x"), (31, "a a a a a"), (32, "a a a a a a"), (33, "p q r s " * 3 + "t " + "p q r s " * 4), (34, "intro " + "é ü " * 4 + "é outro"),
        (35, "one two three " * 400_000)]
    df = documents(spark, texts, clashing=("runs", "found", "row"))
    out = collapse_runs(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "found", "row", "n_words", "runs", "collapsed"]
    got = sorted(((str(r.doc_id), r.text or "", r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()))
    want = []
    for i, t in texts:
        words = WORD.findall(t or "")
        runs = [(0, len(words), 3)] if i == 35 else by_hand(words) if len(words) < 5000 else []
        want.append((str(i), t or "", len(words), runs, collapsed(words, runs)))
    assert got == sorted(want)


def test_empty_table(spark):
    assert collapse_runs(documents(spark, [])).collect() == []


def test_planted_runs(spark):
    import zlib

    from tidemark.llm.queries import with_planted_run

    texts = [(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 40))) for i in range(400)] + [(None, "a b c"), (7, None)]
    got = {(r.doc_id, r.text) for r in with_planted_run(documents(spark, texts)).collect()}
    want = set()
    for i, t in texts:
        h, words = zlib.crc32(str(i).encode()), (t or "").split()
        if i is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(words[:a] + [words[a + (k - a) % p] for k in range(a, n)])
        want.add((i, t))
    assert got == want
