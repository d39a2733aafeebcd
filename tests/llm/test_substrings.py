import numpy as np
import pyarrow as pa
import pytest

from tests.llm.samples import WORD, documents, edited, odd_documents, prose
from tidemark.llm.recompress import FAR, anchors, parse
from tidemark.llm.substrings import remove_repeats
from tidemark.llm.wordhash import words_of


def by_hand(texts, window=50):
    """doc_id, kept text, words, removed; one row per input row."""
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in texts]
    for i, words in split:
        for k in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[k:k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, " ".join(w for k, w in enumerate(words) if k not in gone), len(words), len(gone)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in df.collect()), key=str)


def test_odd_documents(spark):
    texts = odd_documents()
    assert result(remove_repeats(documents(spark, texts))) == by_hand(texts)


def test_other_windows_and_more_rounds(spark):
    texts = odd_documents()
    assert result(remove_repeats(documents(spark, texts), window=12, rounds=5)) == by_hand(texts, 12)


def test_copies_and_common_passages(spark):
    base, passage = prose(3, 220), prose(4, 55)
    texts = [(i, " ".join(edited(base, i, i % 7))) for i in range(60)]
    texts += [(100 + i, " ".join(prose(50 + i, 30) + passage[i % 5:] + prose(90 + i, 30))) for i in range(40)]
    assert result(remove_repeats(documents(spark, texts))) == by_hand(texts)


def test_a_document_repeats_what_an_earlier_one_has_in_part(spark):
    base, line = prose(21, 260, 4000), prose(22, 52, 4000)
    texts = [(1, " ".join(prose(23, 40) + base[100:160] + prose(24, 40))), (2, " ".join(base + base))]
    texts += [(3, " ".join(prose(25, 30) + line[1:] + prose(26, 30))), (4, " ".join((line + prose(27, 9)) * 4))]
    texts += [(5, " ".join(base[60:200])), (2, " ".join(prose(28, 30) + base))]
    got = result(remove_repeats(documents(spark, texts)))
    assert got == by_hand(texts) and {n for i, _, _, n in got if i == 2} == {60, 120}


def test_other_columns_stay_and_clashing_names_are_replaced(spark):
    texts = odd_documents()
    df = documents(spark, texts, clashing=("row", "n_words", "ranges", "name", "first"))
    out = remove_repeats(df)
    assert set(out.columns) == set(df.columns) | {"n_removed"}
    assert {r["row"] for r in out.collect()} == {"kept as it is"} and result(out) == by_hand(texts)


def test_empty_table(spark):
    assert result(remove_repeats(documents(spark, []))) == []


@pytest.mark.parametrize("seed", range(4))
def test_equal_windows_are_stood_for_by_equal_names(seed):
    r = np.random.default_rng(seed)
    passage = prose(seed, 70, 12)
    texts = [" ".join(prose(seed * 10 + k, int(r.integers(0, 40)), 12) + passage + prose(seed * 10 + k + 5, 40, 12)) for k in range(6)]
    words, borders = words_of(pa.array(texts))
    symbols = parse(words, borders, 3)
    seen = {}
    for i in range(6):
        for s in range(borders[i], borders[i + 1] - 49):
            at = anchors(symbols, np.array([s]), 50)[0]
            if at >= 0:
                assert symbols["lo"][at] >= s and symbols["hi"][at] <= s + 50 < FAR
            key = words[s:s + 50].tobytes()
            name = int(symbols["name"][at]) if at >= 0 else None
            assert seen.setdefault(key, name) == name
