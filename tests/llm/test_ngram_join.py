import pytest

import tidemark.llm.ngram_join as ngram_join
from tests.llm.samples import WORD, Sets, documents, edited, folded, odd_documents, prose
from tidemark.llm.ngram_join import drop_near_duplicates, ngram_groups


def by_hand(texts, width, percent):
    rows = []
    for i, t in texts:
        w = WORD.findall(folded(t))
        rows.append((i, frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    groups = Sets()
    for x, (_, a) in enumerate(rows):
        groups.top(x)
        for y in range(x):
            b = rows[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                groups.join(x, y)
    least = {}
    for x, (i, a) in enumerate(rows):
        if a and i is not None:
            top = groups.top(x)
            least[top] = min(i, least.get(top, i))
    return sorted(((i, len(a), least.get(groups.top(x), i) if a else i) for x, (i, a) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_odd_documents(spark, width, percent):
    texts = odd_documents()
    assert result(ngram_groups(documents(spark, texts), width, percent)) == by_hand(texts, width, percent)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_large_groups_of_near_copies(spark, monkeypatch, width, percent):
    """Long lists, blocks of several parts and groups that are linked only through others."""
    monkeypatch.setattr(ngram_join, "SMALL_LIST", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "LED_LIST", 4)
    base, line = prose(3, 150), prose(4, 12)
    texts = [(i, " ".join(edited(base, i, i % 9))) for i in range(90)]
    texts += [(200 + i, " ".join(line + prose(300 + i, 25))) for i in range(60)]
    texts += [(300 + i, " ".join(prose(5, 200)[i:i + 120])) for i in range(0, 60, 2)]
    assert result(ngram_groups(documents(spark, texts), width, percent)) == by_hand(texts, width, percent)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", -1)
    texts = odd_documents()
    assert result(ngram_groups(documents(spark, texts), 5, 80)) == by_hand(texts, 5, 80)
    left = drop_near_duplicates(documents(spark, texts))
    assert left.count() == kept_rows(texts)


def kept_rows(texts):
    """Groups of rows with words, and the distinct (doc_id, text) rows without."""
    rows = by_hand(texts, 5, 80)
    with_words = {c for i, n, c in rows if n and c is not None}
    without = {(i, t or "") for i, t in texts if not WORD.findall(t or "")}
    return len(with_words) + len(without)


def test_one_row_of_each_group_stays(spark):
    texts = odd_documents()
    df = documents(spark, texts, clashing=("rid", "node", "component_id", "first"))
    left = drop_near_duplicates(df)
    assert left.columns == df.columns
    rows = left.collect()
    assert len(rows) == kept_rows(texts) and {r.rid for r in rows} == {"kept as it is"}
    ids = [r.doc_id for r in rows if r.text and WORD.findall(r.text)]
    assert set(ids) == {c for i, n, c in by_hand(texts, 5, 80) if n and c is not None}


def test_empty_table(spark):
    empty = documents(spark, [])
    assert result(ngram_groups(empty)) == [] and drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("edits, percent", [(4, 80), (9, 70)])
def test_pairs_grow_with_a_group_not_with_its_square(spark, monkeypatch, edits, percent):
    """Near copies of one text, far enough from each other (9 edits) that copies link with the text alone."""
    base, counted = prose(31, 300, 4000), {}
    stored = ngram_join.stored

    def counting(df, label):
        out = stored(df, label)
        counted[label] = counted.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", counting)
    texts = [(i, " ".join(edited(base, 100 + i, edits if i else 0))) for i in range(500)]
    groups = {r.component_id for r in ngram_groups(documents(spark, texts), 5, percent).collect()}
    assert groups == {0}
    assert counted["near"] + counted["pairs"] < 12 * len(texts)
