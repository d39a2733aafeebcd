"""Words that a sum rule over their bytes or a power series cannot tell apart, through the operators that hash words."""

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.samples import documents
from tidemark.llm.wordhash import PIECE, hash_spans, hash_windows, text_buffer, word_hashes, word_starts, words_of


def twins(size: int, a: str = "a", b: str = "b") -> tuple[str, str]:
    """Thue-Morse words of ``size`` letters and the same with the letters exchanged."""
    signs = [bin(i).count("1") & 1 for i in range(size)]
    return "".join(b if s else a for s in signs), "".join(a if s else b for s in signs)


@pytest.mark.parametrize("size", [64, 1024, 2048, 4096])
def test_twins_differ_for_each_seed(size):
    body, borders = text_buffer(pa.array(list(twins(size))))
    for hashes in word_hashes(body, word_starts(body, borders), (0, 1, 2, 3)):
        assert hashes[0] != hashes[1]


def test_a_hash_hangs_on_the_word_alone():
    words = ["x" * n for n in (1, 63, 64, 65, 200)] + ["Abc", "aBC", "é", "b" * (PIECE + 5)]
    texts = [" ".join(words), "  ".join(reversed(words)) + " " * 70, *words, None, ""]
    hashes, borders = words_of(pa.array(texts))
    one = hashes[borders[0]:borders[1]]
    assert len(set(one.tolist())) == len(words) and (hashes[borders[1]:borders[2]][::-1] == one).all()
    assert (hashes[borders[2]:] == one).all()
    low, _ = words_of(pa.array(texts), lower=True)
    assert low[5] == low[6] and one[5] != one[6]


def test_spans_of_equal_words_have_equal_hashes():
    r = np.random.default_rng(1)
    words = r.integers(0, 2, 400).astype(np.uint64)
    first = np.repeat(np.arange(300), 3)
    after = first + np.tile([1, 50, 97], 300)
    seen = {}
    for a, b, h in zip(first, after, hash_spans(words, first, after).tolist()):
        assert seen.setdefault(h, tuple(words[a:b])) == tuple(words[a:b])
    assert len(seen) == len({tuple(words[a:b]) for a, b in zip(first, after)})
    assert (hash_windows(words, 50) == hash_spans(words, np.arange(351), np.arange(351) + 50)).all()
    x, y = (np.array([1 if c == "a" else 2 for c in t], np.uint64) for t in twins(2048))
    assert hash_spans(x, np.array([0]), np.array([2048])) != hash_spans(y, np.array([0]), np.array([2048]))


def test_encoder_gives_each_twin_its_ids():
    import public_tokenizers

    from tidemark.llm.tokens import TextEncoder

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        own = TextEncoder(public_tokenizers.path(name))
        for size in (1024, 2048, 4096):
            pair = list(twins(size))
            ids, borders = own.encode(pair)
            for k, text in enumerate(pair):
                assert ids[borders[k]:borders[k + 1]].tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_counts_and_sets_tell_twins_apart(spark):
    from tidemark.llm.ngram_join import ngram_groups
    from tidemark.llm.quality_trees import document_statistics
    from tidemark.llm.substrings import remove_repeats

    x, y = twins(1024)
    counts, _ = document_statistics(pa.array([f"p q {x} p q {y}", f"p q {x} p q {x}"]))
    assert counts["n_repeat_words"].tolist() == [0, 6]
    tail = " ".join(f"w{i}" for i in range(40))
    head = " ".join(f"v{i}" for i in range(20))
    texts = [(1, f"{head} {x} {tail}"), (2, f"{head} {y} {tail}"), (3, f"{head} {x} {tail}")]
    got = {r.doc_id: r.n_removed for r in remove_repeats(documents(spark, texts)).collect()}
    assert got == {1: 0, 2: 0, 3: 61}
    pair = [(1, f"{x} a b"), (2, f"{y} a b"), (3, f"{x} a b")]
    groups = {r.doc_id: r.component_id for r in ngram_groups(documents(spark, pair), 3, 90).collect()}
    assert groups == {1: 1, 2: 2, 3: 1}
