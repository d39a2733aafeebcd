import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.samples import documents, odd_documents
from tidemark.llm import grammar
from tidemark.llm.packing import pack_documents, plan_sequences
from tidemark.llm.token_store import read_document, read_tokens, write_tokens
from tidemark.llm.tokens import TextEncoder

files = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
ODD = [
    "", " ", "\n", "a", " a", "a ", "a\nb", "a\n\nb c", "a \n b", "it's  we'll\tgo", "x y z", "a\u0085b c", "q\x1cr s", "﻿a b",
    "tail\n", "\nhead of it", "<|endoftext|> in text", "a <|endoftext|>\nb", "<|startoftext|>x y", "Σας ΟΔΟΣ ΟΔΟΣ. Ünï é ́x", "中文 字 \U0001f600‍\U0001f600 ok",
    "1234 56,7 8", "A" * 3000 + " b", "a\r\nb\rc d", "  two  spaces  ", "x y z", "don't DON'T ’s", "a\x00b c\x00",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    library, own = tokenizers.Tokenizer.from_file(files.path(name)), TextEncoder(files.path(name))
    r = random.Random(1)
    bits = ["a", "The", " ", " ", "\n", "'s", "1", ".", "é", "\t", "中", "!!", "<|", " ", "ly"]
    texts = ODD + [" ".join(r.choice(ODD) for _ in range(4)) for _ in range(60)] + ["".join(r.choice(bits) for _ in range(40)) for _ in range(300)]
    for _ in range(2):  # the second time from memory
        ids, ends = own.encode(texts)
        for k, text in enumerate(texts):
            assert ids[ends[k]:ends[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_is_bounded(monkeypatch):
    import tidemark.llm.tokens as tokens

    monkeypatch.setattr(tokens, "MOST_WORDS", 5)
    own = TextEncoder(files.path("word_bpe_49k.json"))
    for k in range(6):
        first = own.encode([f"word{k} other{k} text{k}"])[0].tolist()
        assert first == TextEncoder(files.path("word_bpe_49k.json")).encode([f"word{k} other{k} text{k}"])[0].tolist()
    assert own.known <= 9


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_forgotten_within_a_call_are_learned_again(name, monkeypatch):
    import tidemark.llm.tokens as tokens

    monkeypatch.setattr(tokens, "MOST_WORDS", 20)
    library, own = tokenizers.Tokenizer.from_file(files.path(name)), TextEncoder(files.path(name))
    old = " ".join(f"old{k}word" for k in range(18))
    own.encode([old])
    for k in range(4):  # known words beside new ones, beyond the bound each time
        texts = [old, f"new{k} " + old + " " + " ".join(f"other{k}x{j}" for j in range(5)), old]
        ids, ends = own.encode(texts)
        for j, text in enumerate(texts):
            assert ids[ends[j]:ends[j + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_and_fit(seed):
    r, capacity = random.Random(seed), [7, 64, 2048][seed % 3]
    counts = {r.randint(1, capacity): r.randint(1, 50) for _ in range(r.randint(1, 200))}
    plan = plan_sequences(counts, capacity)
    used = Counter()
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= capacity
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)


def test_plan_finds_singles_pairs_and_triples():
    plan = plan_sequences({100: 2, 70: 3, 30: 3, 60: 1, 25: 1, 15: 1, 50: 2, 20: 3, 10: 3}, 100)
    total = sum(times * sum(lengths) for times, lengths in plan)
    assert sum(times for times, _ in plan) == -(-total // 100)
    assert plan_sequences({}, 10) == []
    with pytest.raises(ValueError):
        plan_sequences({11: 1}, 10)


def test_packing(spark):
    texts = odd_documents()
    path = files.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = pack_documents(documents(spark, texts, clashing=("piece", "length", "task", "rank")), path, capacity=256).collect()
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k, s, tuple(ids[s:s + 256])) for k, s in enumerate(range(0, len(ids), 256))]
    got = [(r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str) and all(r.length == len(g[3]) for r, g in zip(rows, got))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 256) + 2
    assert pack_documents(documents(spark, []), path).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_grammar_round_trip(seed):
    r = np.random.default_rng(seed)
    parts = [r.integers(0, 6, r.integers(1, 300)) if k % 3 else np.full(r.integers(1, 200), 4) for k in range(40)]
    ids, ends = np.concatenate(parts).astype(np.uint32), np.cumsum([len(p) for p in parts])
    symbols, rules, symbol_ends = grammar.compress(ids, ends, 10, rounds=5, most_rules=60, least=4)
    assert len(rules) and len(symbols) < len(ids) / 2
    assert (grammar.expand(symbols, rules, 10) == ids).all() and grammar.lengths(symbols, rules, 10).sum() == len(ids)
    for k, part in enumerate(parts):
        own = symbols[symbol_ends[k - 1] if k else 0:symbol_ends[k]]
        assert (grammar.expand(own, rules, 10) == part).all()


def test_pairs_are_replaced_until_none_is_frequent():
    import inspect

    limits = {k: inspect.signature(write_tokens).parameters[k].default for k in ("rounds", "most_rules", "least")}
    r = np.random.default_rng(9)
    words = [r.integers(0, 900, r.integers(2, 40)) for _ in range(60)]
    parts = [np.concatenate([words[k] for k in r.integers(0, 60, 30)]) for _ in range(300)]
    ids, ends = np.concatenate(parts).astype(np.uint32), np.cumsum([len(p) for p in parts])
    symbols, rules, symbol_ends = grammar.compress(ids, ends, 900, **limits)
    pairs = Counter()
    for a, b in zip([0, *symbol_ends[:-1]], symbol_ends):
        pairs.update(zip(symbols[a:b - 1].tolist(), symbols[a + 1:b].tolist()))
    assert max(pairs.values()) < limits["least"]
    assert (grammar.expand(symbols, rules, 900) == ids).all()


def test_grammar_of_little():
    for ids in ([], [5], [5, 5], [1, 2, 3]):
        ids = np.array(ids, np.uint32)
        symbols, rules, ends = grammar.compress(ids, np.array([len(ids)]), 10, 3, 10, 1)
        assert (grammar.expand(symbols, rules, 10) == ids).all() and ends[-1] == len(symbols)


def test_token_files(spark, tmp_path):
    texts = odd_documents()
    path = files.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    out = str(tmp_path / "tokens")
    write_tokens(documents(spark, texts, clashing=("shard", "ids")), out, path, shard_ids=3000, least=4)
    rows = sorted(read_tokens(spark, out).collect(), key=lambda r: r.start)
    ordered = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    at = 0
    assert len(rows) == len(ordered)
    for r, (i, t) in zip(rows, ordered):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    shards = [r.asDict() for r in spark.read.parquet(out).collect()]
    assert len(shards) > 2 and any(len(s["rules"]) for s in shards)
    known = {r.start: r.ids for r in rows}
    for s in shards[:2]:
        for k in range(s["n_docs"]):
            assert read_document(s, k).astype("<u4").tobytes() in known.values()


def test_no_documents(spark, tmp_path):
    out = str(tmp_path / "none")
    write_tokens(documents(spark, []), out, files.path("byte_bpe_50k.json"))
    assert read_tokens(spark, out).count() == 0


def test_long_texts_are_encoded_a_few_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    import tidemark.llm.packing as packing
    from tidemark.llm.packing import ENCODED_BYTES, ENCODED_ROWS, _cut_pieces

    sizes = []

    class Encoder(TextEncoder):
        def encode(self, texts):
            sizes.append((len(texts), sum(len(t.as_py() or "") for t in texts)))
            return super().encode(texts)

    own = Encoder(files.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "encoder", lambda path: own)
    monkeypatch.setattr(packing.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 3})()))
    texts = ["some words " * 10_000] * 30 + ["a b", None, ""] * 200 + ["x" * (ENCODED_BYTES + 5), "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    pieces = pa.Table.from_batches(_cut_pieces("", 2048, 0)([batch])).to_pylist()
    assert all(n <= ENCODED_ROWS and (size <= ENCODED_BYTES or n == 1) for n, size in sizes) and sum(n for n, _ in sizes) == len(texts)
    plain = TextEncoder(files.path("word_bpe_49k.json"))
    for k in (0, 29, 30, 31, 32, 630, 631):
        ids = b"".join(p["ids"] for p in pieces if p["doc_id"] == k)
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode([texts[k]])[0].tolist(), 0]
    places = Counter(p["length"] for p in pieces)
    assert all(sorted(p["place"] for p in pieces if p["length"] == x) == list(range(n)) for x, n in places.items())


def test_pipeline_hands_texts_to_python_in_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    import corpus_pipeline

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["bytes"])

    before = spark.conf.get(corpus_pipeline.BATCH)
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(corpus_pipeline.BATCH, before)
            with pytest.raises(Exception):
                stage(spark, None, "")  # the setting comes first
            assert docs.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0] <= 10_000_000, name
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)
