"""Secrets in whole texts: fixed patterns, and strings that nothing around them explains."""

from __future__ import annotations

import random
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import give_back, ship

KINDS = ("assign", "access", "hex", "novel")  # the order of spans that start together
# The patterns the spans are defined by.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 and more: what a longest run with a length test gives
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEY_PART = re.compile(r"[A-Za-z0-9+/_=-]+")
CONTEXT = re.compile(r"key|pass|pwd|auth|bearer|credential|private|secret|token|signature|cookie", re.I | re.A)
JOINT = re.compile(r"""[\s"'`+,;.>#*|\\()]*""")  # what may stand between the lines of one key
MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]+)-----")
AROUND = 1024
LEAST_NOVEL, NOVEL_SHARE = 20, 0.8
# What code around a secret is made of: words, calls and names that are no secrets however long they are.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 authorization authentication authenticate bearer basic "
    "credentials credential private_key public_key secret_key access_key api_key client_id client_secret session_id request "
    "response configuration environment application service account administrator password username database connection string "
    "function return import export class public static const value default parameter argument implementation "
    "interface abstract exception handler controller repository transaction management BEGIN END PRIVATE PUBLIC KEY CERTIFICATE "
    "https://www.example.com/path/index.html?query=value&page=1 application/json content-type user-agent localhost 127.0.0.1 "
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and without overlap in each kind; a match too short is dropped."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def marginal_bytes(candidate: str, around: str) -> int:
    """How many bytes ``candidate`` adds once the text around it and the identifiers are known."""
    known = zstandard.ZstdCompressionDict((IDENTIFIERS + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=19, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(packer.compress(candidate.encode())) - len(packer.compress(b""))


def alone_bytes(candidate: str) -> int:
    """What ``candidate`` costs without the dictionaries: the packed size of its letters in a random order, at most its length.

    Packing reaches the alphabet's entropy on longer strings, so a random one is not measured by its
    length; the other order keeps those that repeat themselves from looking random.
    """
    letters = list(candidate)
    random.Random(0).shuffle(letters)
    packer = zstandard.ZstdCompressor(level=19, write_checksum=False, write_content_size=False, write_dict_id=False)
    return min(len(packer.compress("".join(letters).encode())) - len(packer.compress(b"")), len(candidate))


def novel_spans(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Strings in a sensitive context that stay large beside the dictionaries; none overlaps a base span.

    A candidate is 20 or more characters of a key alphabet with letters and digits, with a sensitive word in the
    1,024 characters before or after it; candidates with nothing but space, quotes and the like between them
    have one context, that of the run. It is reported if it adds ``NOVEL_SHARE`` of what it costs alone,
    without the runs of hex digits in it that are base spans. What stands between BEGIN and END
    marks of one label with a sensitive word is one candidate, short last lines and line ends included.
    Other copies of a candidate explain nothing; ``find_spans`` reports all copies of a reported string.
    """
    taken = sorted(taken)
    blocks = [b for b in _blocks(text) if _novel(text, *b)] if "-----BEGIN " in text else []
    for start, end in blocks:
        yield from ((s, e, "novel") for s, e in _outside(start, end, taken))
    starts = [s for s, _ in blocks]
    for run in _runs(text):
        first, last = run[0][0], run[-1][1]
        if not CONTEXT.search(text, max(0, first - AROUND), first) and not CONTEXT.search(text, last, last + AROUND):
            continue
        for start, end in run:
            word, k = text[start:end], bisect_right(starts, start) - 1
            if word.isalpha() or not any(c.isdigit() for c in word) or not any(c.isalpha() for c in word):
                continue
            if (k >= 0 and start < blocks[k][1]) or any(s < end and start < e and kind != "hex" for s, e, kind in taken):
                continue
            parts = list(_outside(start, end, taken))
            if sum(e - s for s, e in parts) >= LEAST_NOVEL and _novel(text, start, end):
                yield from ((s, e, "novel") for s, e in parts)


def _novel(text: str, start: int, end: int) -> bool:
    """Whether the key characters of a stretch stay large beside the text around it, without its own copies, and the identifiers."""
    word = "".join(KEY_PART.findall(text, start, end))
    own = {m.group() for m in CANDIDATE.finditer(text, start, end)}
    reach = AROUND + max(map(len, own))  # so that a copy on the border is seen whole
    before, after = _without(own, text[max(0, start - reach):start]), _without(own, text[end:end + reach])
    around = before[-AROUND:] + "\n" + after[:AROUND]
    return marginal_bytes(word, around) >= NOVEL_SHARE * alone_bytes(word)


def _without(own: set[str], text: str) -> str:
    if len(own) == 1:
        return text.replace(*own, "\n")
    return CANDIDATE.sub(lambda m: "\n" if m.group() in own else m.group(), text)


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Candidates in groups that adjoin."""
    run: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        if run and not JOINT.fullmatch(text, run[-1][1], m.start()):
            yield run
            run = []
        run.append(m.span())
    if run:
        yield run


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Bodies between a BEGIN and the END mark that follows, both of one label with a sensitive word; they hold a candidate."""
    begin = None
    for m in MARK.finditer(text):
        if begin and m.group(1) == "END" and m.group(2) == begin.group(2) and CONTEXT.search(m.group(2)) \
                and CANDIDATE.search(text, begin.end(), m.start()):
            body = text[begin.end():m.start()]
            yield m.start() - len(body.lstrip()), begin.end() + len(body.rstrip())
        begin = m if m.group(1) == "BEGIN" else None


def _outside(start: int, end: int, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """What base spans, in order, leave of a candidate."""
    for s, e, _ in taken:
        if s < end and start < e:
            if start < s:
                yield start, s
            start = max(start, e)
    if start < end:
        yield start, end


def _copies(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Where novel strings stand once more, in longer candidates or far from any sensitive word too."""
    words = {text[s:e] for s, e, k in spans if k == "novel" and e - s >= LEAST_NOVEL}
    taken, found = sorted((s, e) for s, e, _ in spans), []
    for word in sorted(words, key=lambda w: (-len(w), w)):
        at = text.find(word)
        while at >= 0:
            end = at + len(word)
            k = bisect_right(taken, (at, len(text)))
            if not (k and taken[k - 1][1] > at) and not (k < len(taken) and taken[k][0] < end):
                insort(taken, (at, end))
                found.append((at, end, "novel"))
            at = text.find(word, end)
    return found


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind; positions count code points."""
    if not text:
        return []
    spans = base_spans(text)
    spans += novel_spans(text, spans)
    spans += _copies(text, spans)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Add secret_spans, an array of (kind, start, end), to ``docs`` (text and others; a column of that name is replaced).

    Start and end count code points of the whole text, the end is exclusive; spans are ordered by start,
    then kind. Kinds assign, access and hex are the fixed patterns; the method adds novel. Null and
    empty texts have none. Every row is judged by itself, so repeated rows have equal spans; an
    empty table gives an empty table. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    return docs.withColumn("secret_spans", _spans_of()("text"))


def _spans_of():
    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": s, "end": e} for s, e, k in find_spans(t.as_py())] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
    return spans


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str | None:
    """``text`` with ``mark`` in place of each group of spans that overlap."""
    if not spans or text is None:
        return text
    out, at, end = [], 0, -1
    for s, e, _ in sorted(spans):
        if s >= end:
            out += [text[at:s], mark]
        end = max(end, e)
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in text replaced by ``mark``; all rows and other columns stay as they are."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        out = pa.array([redact(t, find_spans(t), mark) for t in (x.as_py() for x in texts)], pa.string())
        give_back()
        return out

    return docs.withColumn("text", redacted("text"))
