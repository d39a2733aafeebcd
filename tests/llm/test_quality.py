import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.samples import WORD, documents, odd_documents, prose
from tidemark.llm import quality_net
from tidemark.llm.labelled import held_out, learning_rows
from tidemark.llm.quality_net import CHUNK, Net, _gradients, cut_chunks, fit_quality_net, score_quality, score_texts
from tidemark.llm.quality_trees import FEATURES, document_statistics, fit_quality_trees, grow, judge_quality


def counts_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:k] for k, x in enumerate(lines)), len(covered))


TEXTS = odd_documents() + [(90, "a b c a b c x"), (91, "l\nl\n \nl \n l\n\nl"), (92, "#*$%&|<>!? é中"), (93, "x x x"), (94, "a b\na b\n" * 40)]


def test_counts():
    texts = [t for _, t in TEXTS if t is None or len(t) < 20000]
    counts, features = document_statistics(pa.array(texts, pa.string()))
    got = list(zip(*(counts[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [counts_by_hand(t) for t in texts]
    assert features.shape == (len(texts), len(FEATURES)) and np.isfinite(features).all()


def corpus(n):
    """Prose, and junk of symbols, shouting and repeats."""
    r, out = random.Random(5), []
    for k in range(n):
        words = prose(k, 120)
        bad = k % 4 == 0
        if bad:
            words = [w + "&&&" if k % 8 else w.upper() + "!!" for w in words] if k % 3 else words[:3] * 40
        out.append((k, " ".join(words) + ("\n" if r.random() < 0.5 else "."), 0 if bad else 1))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus(400)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 5] + [(None, 1, 0), (7, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_learning_rows(spark, learned):
    rows, docs, labels = learned
    got = learning_rows(docs, labels, 100).collect()
    assert len(got) <= 100 and {r.quality for r in got} == {0, 1}
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
    out = {r.doc_id: r.h for r in docs.select("doc_id", held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in out.items())


def test_net_learns(spark, learned):
    rows, docs, labels = learned
    net = fit_quality_net(docs, labels)
    scored = {r.doc_id: r.score for r in score_quality(docs, net).collect()}
    test = [(scored[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((s >= 0.3) == (q == 1) for s, q in test)
    assert len(test) > 50 and right / len(test) > 0.85 and all(0 <= s <= 1 for s in scored.values())


def test_net_odd_rows(spark):
    net = Net.fresh(1)
    df = documents(spark, TEXTS, clashing=("score",))
    out = score_quality(df, net)
    assert sorted(out.columns) == sorted(df.columns)
    rows = out.collect()
    again = {(r.doc_id, r.text): r.score for r in rows}
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and abs(again[r.doc_id, r.text] - r.score) < 1e-6 for r in rows)
    assert score_quality(df.limit(0), net).count() == 0
    assert {r.score for r in score_quality(df, None).collect()} == {0.5}


def test_no_labels(spark, learned):
    _, docs, labels = learned
    assert fit_quality_net(docs, labels.where("quality = 1")) is None and fit_quality_trees(docs, labels.limit(0)) is None


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 7, 8, 511, 512, 513, 960, 961, 5000):
        body = np.arange(n).astype(np.uint8)
        chunks, places = cut_chunks(body)
        assert chunks.shape[1] == CHUNK and (places > 0).all()
        if n:
            assert chunks[-1][min(n, CHUNK) - 1] == body[-1] and chunks[0][0] == body[0]
        if n > CHUNK:
            assert b"".join([chunks[0].tobytes()] + [c.tobytes() for c in chunks[1:]]).count(b"") > 0
            at = [int(np.flatnonzero([np.array_equal(body[s:s + CHUNK], c) for s in range(n - CHUNK + 1)])[0]) for c in chunks]
            assert at[0] == 0 and max(np.diff(at)) <= CHUNK - 8
    long = np.frombuffer(("x" * 3000 + "&&&&&&&" * 200).encode(), np.uint8)
    net = Net.fresh(2)
    whole = score_texts(net, [long, long[:10]], at_once=3)
    assert np.allclose(whole, score_texts(net, [long, long[:10]], at_once=500), atol=1e-6)


def test_every_byte_counts_and_scores_equal_a_direct_convolution():
    net = Net.fresh(4)
    r = np.random.default_rng(5)
    for n in (1, 7, 8, 9, 100, 101, 510, 511, 512, 513, 1500):
        body = r.integers(32, 120, n).astype(np.uint8)
        other = body.copy()
        other[-1] = 0 if n < 3 else (body[-1] + 37) % 90 + 32
        assert score_texts(net, [body])[0] != score_texts(net, [other])[0], n
        best = np.full(quality_net.UNITS, 0.0)
        starts = [0] if n <= CHUNK else [*range(0, n - CHUNK, quality_net.STEP), n - CHUNK]
        for s in starts:
            chunk = np.zeros(CHUNK, np.uint8)
            chunk[:min(n, CHUNK)] = body[s:s + CHUNK]
            seen = []
            for at in range(0, CHUNK - quality_net.WIDTH + 1, quality_net.STRIDE):
                if at == 0 or s + at + quality_net.WIDTH - quality_net.STRIDE < n:  # a place that looks at a new byte of the text
                    window = np.concatenate([quality_net.CODES[b] for b in chunk[at:at + quality_net.WIDTH]]).astype(np.float64)
                    seen.append(np.maximum(window @ net.filters + net.filter_bias, 0))
            seen = np.array(seen)
            pooled = np.concatenate([seen.mean(axis=0), np.sqrt((seen ** 2).mean(axis=0) + 1e-6)])
            best = np.maximum(best, np.maximum(pooled @ net.units + net.unit_bias, 0))
        assert abs(score_texts(net, [body])[0] - 1 / (1 + np.exp(-(best @ net.last + net.last_bias[0])))) < 1e-5, n


def test_gradients():
    net = Net(*(v.astype(np.float64) for v in Net.fresh(3).values()))
    r = np.random.default_rng(1)
    chunks, places = r.integers(32, 120, (5, CHUNK)).astype(np.uint8), np.array([253, 253, 100, 253, 7])
    owner, labels, weight = np.array([0, 0, 1, 2, 2]), np.array([1, 0, 1]), np.ones(3)

    def loss():
        best = np.zeros((3, quality_net.UNITS))
        np.maximum.at(best, owner, quality_net._chunk_units(net, chunks, places))
        p = 1 / (1 + np.exp(-(best @ net.last + net.last_bias[0])))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = _gradients(net, chunks, places, owner, labels, weight)
    for value, grad in zip(net.values(), grads):
        flat = value.reshape(-1)
        for k in r.integers(0, flat.size, 3):
            old = flat[k]
            flat[k] = old + 1e-4
            up = loss()
            flat[k] = old - 1e-4
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-4 - grad.reshape(-1)[k]) < 2e-2 * max(1, abs(grad.reshape(-1)[k]))


def test_trees_learn_and_judge(spark, learned):
    rows, docs, labels = learned
    trees = fit_quality_trees(docs, labels)
    got = {r.doc_id: r for r in judge_quality(docs, trees).collect()}
    for i, t, q in rows:
        r = got[i]
        counts = counts_by_hand(t)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*counts, failed)
        assert r.kept == (not failed and r.score >= 0.3)
    test = [(got[i].kept, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(k == (q == 1) for k, q in test) / len(test) > 0.9


def test_judge_odd_rows(spark):
    df = documents(spark, TEXTS, clashing=("kept", "score", "n_words"))
    out = judge_quality(df, None)
    assert out.count() == len(TEXTS) and not out.where("text is null").where("kept or not base_failed").count()
    assert len(set(out.columns)) == len(out.columns) and judge_quality(df.limit(0), None).count() == 0


def test_trees_keep_to_their_directions():
    r = np.random.default_rng(0)
    x = r.random((600, 3))
    y = ((x[:, 0] + 0.3 * r.standard_normal(600) < 0.5) ^ (x[:, 1] > 0.8)).astype(int)
    trees = grow(x, y, [-1, 1, 0], trees=25)
    for f, sign in ((0, -1), (1, 1)):
        for _ in range(40):
            row = np.repeat(r.random((1, 3)), 50, axis=0)
            row[:, f] = np.linspace(0, 1, 50)
            assert (sign * np.diff(trees.probability(row)) >= -1e-12).all()
    slow = []
    for v in x[:20]:
        total = 0.0
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if v[trees.feature[node]] <= trees.limit[node] else trees.right[node]
            total += trees.value[node]
        slow.append(1 / (1 + np.exp(-total)))
    assert np.allclose(slow, trees.probability(x[:20]))
