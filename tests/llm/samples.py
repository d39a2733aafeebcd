"""Small inputs with every odd case, shared by the tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, words: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{int(words * r.random() ** 2)}" for _ in range(n)]


def edited(words: list[str], seed: int, edits: int) -> list[str]:
    r, out = random.Random(seed), list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10 ** 6)}"
    return out


def odd_documents() -> list[tuple]:
    """doc_id, text: nulls, empty and blank texts, runs, copies, near copies, shared passages, a long text, repeated rows."""
    passage = prose(1, 60)
    base, junk = prose(2, 300), ["spam"] * 200
    texts = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(edited(base, 3, 2))), (4, " ".join(edited(base, 4, 3))),
        (5, " ".join(prose(5, 80) + passage + prose(6, 70))), (6, " ".join(prose(7, 20) + passage)), (7, "\n".join(passage[:50])),
        (8, " ".join(passage[:49])), (9, None), (10, ""), (11, " \t\n"), (12, "one"), (13, "one two"), (14, "One  TWO"),
        (15, " ".join(junk)), (16, " ".join(junk[:120])), (17, "ab ba " * 90), (18, "ba ab " * 60), (None, " ".join(base)),
        (None, None), (19, "Zoë 中文字  x\x1cy \U0001f600 " * 30), (20, " ".join(prose(8, 9000))),
        (21, " ".join(prose(8, 9000)[100:4000] + prose(9, 50))), (22, "a\tb\x0bc\x0cd\re\nf " * 12),
    ]
    return texts + [texts[5], texts[0], (4, "another text under a known id"), (7, "\n".join(passage[:50]))]


def documents(spark, texts, clashing=()):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOC)
    for name in clashing:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("kept as it is"))
    return df.repartition(3)


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


class Sets:
    """Union-find over hashable items."""

    def __init__(self):
        self.up = {}

    def top(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
