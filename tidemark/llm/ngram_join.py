"""Documents whose word n-gram sets overlap: an exact Jaccard self-join by blocked sparse products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import components, give_back, ship, stored
from tidemark.llm.wordhash import U, chain, mix, words_of

SMALL_LIST = 64  # documents of an n-gram that are paired one by one
BLOCK = 256  # documents of one side of a block of the product
LED_LIST = 16  # documents from which on a list is held against leaders first
NEAREST_ROUNDS = 3  # rounds in which documents of long lists are united with their nearest ones only
MOST_BITS = 1 << 15  # of a set's bitmap
FREQUENT = 200_000  # n-grams put last in the order; only speed hangs on them
BROADCAST_IDS = 500_000


def row_key() -> Column:
    """What tells rows apart here: doc_id and text. Rows that agree in both are one."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def ngram_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of texts whose word n-gram sets have a Jaccard similarity of ``percent`` / 100 or more.

    ``docs`` has doc_id and text; other columns are not looked at. Returns a row per row of ``docs``:
    rid (``row_key``), doc_id, n_shingles, component_id, first (whether the row has the
    smallest doc_id of its group, the smallest rid among equal ones). A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; the set holds
    the distinct ``width``-word shingles, or the whole sequence where there are fewer words. Null,
    empty and wordless texts have an empty set, link with nothing and are their own component.
    component_id is the smallest doc_id reachable by links; a document without links has its
    own, also if null. Repeated rows have equal sets and so one component (and one rid: all of
    them are first or none); rows that share a doc_id but not the text are told apart, and a
    null doc_id comes after all others. An empty table gives an empty table.

    Method: the product of the document by n-gram incidence with its transpose, never whole.
    Equal sets are one row of it. Sets of sizes a <= b can link only if a >= s b and if they share one
    of the first (1 - s) n + 1 n-grams of any fixed order, so only these columns of a row are
    multiplied (frequent n-grams last, the rest by hash); the documents of a column are a list. Groups need one link per
    member, so lists of 16 documents and more are first held against one document each (the one that a hash puts first, which is the same one in
    most lists of a group), then against that one's nearest partner; in long lists then each document against its nearest one. Only lists that still hold several groups are
    multiplied: up to 64 documents pair by pair between groups, with overlaps accumulated over all lists, longer ones
    block by block, documents of a list's largest group among themselves excepted. Every pair is cut by a bound from the
    sizes (the parity bitmap of a set differs in no more bits than the sets in elements) and the rest
    is verified on whole sets, for each document its nearest partner before the others.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("rid", row_key())
    frequent = _frequent(rows, width)
    facts = stored(rows.select("rid", "doc_id", "text").mapInArrow(
        _incidence(width, percent, frequent),
        "rid long, doc_id long, n long, f1 long, f2 long, head array<long>, bits binary"), "sets")
    nodes = stored(facts.where("n > 0").groupBy("f1", "f2", "n").agg(
        F.min("rid").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")), "nodes")
    repeated = not facts.groupBy("rid").agg(F.count("*").alias("times")).where("times > 1").isEmpty()
    once = (lambda df: df.dropDuplicates(["rid"])) if repeated else (lambda df: df)  # rows that agree in doc_id and text
    # one row for each distinct set and n-gram of its head, without n-grams that one set alone has
    heads = (once(facts.select("rid", "n", "head").join(nodes.select(F.col("node").alias("rid")), "rid"))
             .select(F.col("rid").alias("node"), F.col("n").cast("int").alias("n"), F.posexplode("head").alias("place", "token")))
    often = stored(heads.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1"), "often")
    lists = stored(heads.join(often, "token"), "lists")
    bits = stored(once(facts.select("rid", "bits").join(lists.select(F.col("node").alias("rid")).distinct(), "rid"))
                  .withColumnRenamed("rid", "node"), "bits")

    verified = lambda pairs: _verified(rows, once, pairs, width, percent)
    bounded = lambda pairs: _bounded(pairs, bits, percent)

    led = lists.where(F.col("docs") >= LED_LIST)
    lead = stored(led.groupBy("token").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias("l")).select(
        "token", F.col("l.node").alias("x"), F.col("l.n").alias("nx")), "leaders")
    near = stored(bounded(_pairs(led.join(lead, "token"), percent).distinct()), "near")
    groups = _united(None, verified(near.select("a", "b")))

    ends = near.select(F.col("a").alias("x"), "apart", F.col("b").alias("y"), F.col("nb").alias("ny")).union(
        near.select("b", "apart", "a", "na"))
    best = ends.groupBy("x").agg(F.min(F.struct("apart", "y", "ny")).alias("to")).select("x", F.col("to.y").alias("y"), F.col("to.ny").alias("ny"))
    seconds = lead.join(best, "x").select("token", F.col("y").alias("x"), F.col("ny").alias("nx"))
    more = _between(_pairs(_open(led, groups).join(seconds, "token"), percent).distinct(), groups)
    again = stored(bounded(more.join(near.select("a", "b"), ["a", "b"], "left_anti")), "near")
    groups = _united(groups, verified(again.select("a", "b")))

    for _ in range(NEAREST_ROUNDS):
        left = stored(_open(_longest(_open(lists.where(F.col("docs") > SMALL_LIST), groups)), groups), "open")
        if left.isEmpty():
            break
        near = _cells(left, bits).groupBy("token", "i", "j").applyInArrow(_bounded_block(percent, nearest=True), "a long, b long, apart int")
        links = verified(_nearest(stored(near, "near")))
        if links.isEmpty():
            break
        groups = _united(groups, links)

    left = stored(_open(lists, groups), "open")
    if not left.isEmpty():
        near = bounded(_able_pairs(left, percent)).select("a", "b", "apart")
        near = stored(near.union(_cells(left, bits).groupBy("token", "i", "j").applyInArrow(
            _bounded_block(percent), "a long, b long, apart int")).distinct(), "near")
        groups = _united(groups, verified(_nearest(near)))
        groups = _united(groups, verified(_between(near, groups).select("a", "b")))

    labelled = nodes.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("least").alias("head"))
    classes = labelled.join(least, "component").select("f1", "f2", "n", "head")
    return facts.select("rid", "doc_id", "f1", "f2", "n").join(classes, ["f1", "f2", "n"], "left").select(
        "rid", "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        F.coalesce(F.col("head.rid") == F.col("rid"), F.lit(True)).alias("first"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all its columns, that are first in their group (``ngram_groups``).

    Of rows that agree in doc_id and text one stays, whatever their other columns hold.
    """
    groups = ngram_groups(docs, width, percent)
    gone = stored(groups.where("not first").select("rid").distinct(), "gone")
    twice = stored(groups.where("first").groupBy("rid").agg(F.count("*").alias("times")).where("times > 1").select("rid"), "twice")
    small = (F.broadcast if gone.count() <= BROADCAST_IDS else lambda df: df)
    left = docs.withColumn("_rid", row_key()).join(small(gone.withColumnRenamed("rid", "_rid")), "_rid", "left_anti")
    if twice.isEmpty():
        return left.drop("_rid")
    again = left.join(twice.withColumnRenamed("rid", "_rid"), "_rid", "left_semi").dropDuplicates(["_rid"])
    return left.join(twice.withColumnRenamed("rid", "_rid"), "_rid", "left_anti").union(again).drop("_rid")


def _shingles(words: np.ndarray, borders: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, ascending."""
    n = len(words)
    full = mix(words)
    for k in range(1, width):
        full = chain(full[: max(n - k, 0)], words[k:])
    out = []
    for i in range(len(borders) - 1):
        a, b = int(borders[i]), int(borders[i + 1])
        if b - a >= width:
            out.append(np.unique(full[a:b - width + 1]))
        elif b > a:
            whole = np.array([width * 1000 + b - a], U)
            for k in range(a, b):
                whole = chain(whole, words[k:k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, U))
    return out


def _slices(batches, rows: int):
    """Batches of few rows: what a task holds at a time stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    give_back()


def _frequent(rows: DataFrame, width: int) -> np.ndarray:
    """The n-grams that most documents of a batch have in common, FREQUENT of them at most.

    Only n-grams met twice in 2048 rows are counted, and of a row the half with the smaller hashes,
    which can stand early in the order: it is an order, right whatever it is, and no link hangs on it.
    """
    def run(batches):
        for batch in _slices(batches, 2048):
            sets = _shingles(*words_of(batch.column(0), lower=True), width)
            if sets:
                early = np.concatenate([s[: len(s) // 2] for s in sets])  # ascending: the half that comes first
                token, count = np.unique(early, return_counts=True)
                many = count > 1
                yield pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(count[many])], ["token", "times"])

    counted = rows.select("text").mapInArrow(run, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    top = counted.orderBy(F.desc("times"), "token").limit(FREQUENT).select("token").toArrow()
    return np.sort(np.asarray(top.column(0).combine_chunks() if len(top) else np.zeros(0)).astype(np.int64).view(U))


def _needed(na, nb, percent: int):
    """The least overlap at which sets of these sizes link."""
    return -(-percent * (na + nb) // (100 + percent))


def _bitmap(values: np.ndarray) -> bytes:
    """Parity of the number of elements at each of 4 n or more places (a power of two, MOST_BITS at most)."""
    size = min(1 << max(8, int(len(values) * 4 - 1).bit_length()), MOST_BITS)
    odd = np.bincount((values >> U(5)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _incidence(width: int, percent: int, frequent: np.ndarray):
    def run(batches):
        for batch in _slices(batches, 512):
            sets = _shingles(*words_of(batch.column(2), lower=True), width)
            n, f1, f2, heads, maps = [], [], [], [], []
            for values in sets:
                n.append(len(values))
                f1.append(int(np.bitwise_xor.reduce(mix(values))) if len(values) else 0)
                f2.append(int(np.add.reduce(mix(values + U(77)))) if len(values) else 0)
                if not len(values):
                    heads.append(np.zeros(0, np.int64))
                    maps.append(b"")
                    continue
                most = len(values) - -(-percent * len(values) // 100) + 1
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
                    late = frequent[at] == values
                    values = np.concatenate([values[~late], values[late]])
                heads.append(values[:most].view(np.int64))
                maps.append(_bitmap(values))
            lengths = np.cumsum([0] + [len(h) for h in heads])
            flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n, pa.int64()),
                pa.array(np.array(f1, U).view(np.int64)), pa.array(np.array(f2, U).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat)), pa.array(maps, pa.binary()),
            ], ["rid", "doc_id", "n", "f1", "f2", "head", "bits"])
    return run


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) from rows of lists that meet a document x, as far as the sizes allow a link."""
    met = met.where(f"node <> x and 100 * least(n, nx) >= {percent} * greatest(n, nx)")
    first = F.col("node") < F.col("x")
    return met.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"),
                      F.when(first, F.col("n")).otherwise(F.col("nx")).alias("na"), F.when(first, F.col("nx")).otherwise(F.col("n")).alias("nb"))


def _united(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after ``links``; of ``groups`` only the components that they join are walked again."""
    if groups is None:
        return components(links)
    joins = stored(_between(links, groups).select("ga", "gb").distinct(), "joins")
    if joins.isEmpty():
        return groups
    over = components(joins.select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    kept = groups.join(over.select(F.col("id").alias("component"), F.col("component").alias("over")), "component", "left").select(
        "id", F.coalesce("over", "component").alias("component"))
    return stored(kept.union(over.join(groups, "id", "left_anti").select("id", "component")), "groups")


def _open(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The lists that hold several groups, with the group of each row."""
    rows = lists.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    several = rows.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("token")
    return rows.join(several, "token")


def _longest(lists: DataFrame) -> DataFrame:
    """Of the lists of each document the longest one: (token, node, n, place, docs)."""
    best = lists.groupBy("node").agg(F.max(F.struct("docs", "token")).alias("top")).select("node", F.col("top.token").alias("token"))
    rows = lists.select("token", "node", "n", "place").join(best, ["node", "token"])
    return rows.join(rows.groupBy("token").agg(F.count("*").alias("docs")), "token").withColumn("docs", F.greatest("docs", F.lit(SMALL_LIST + 1)))


def _nearest(near: DataFrame) -> DataFrame:
    """(a, b): each document and the nearest of its partners."""
    ends = near.select(F.col("a").alias("v"), F.struct("apart", "b").alias("to")).union(
        near.select(F.col("b").alias("v"), F.struct("apart", F.col("a").alias("b")).alias("to")))
    return ends.groupBy("v").agg(F.min("to").alias("to")).select(
        F.least("v", "to.b").alias("a"), F.greatest("v", "to.b").alias("b")).distinct()


def _bounded(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bound on their bitmaps leaves, with the number of bits they are apart."""
    left, right = (bits.select(F.col("node").alias(x), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "a_bits", "b_bits").mapInArrow(
        _bounded_pairs(percent), "a long, b long, na int, nb int, apart int")


def _able_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): pairs of different groups that share a short list and whose sizes leave room for the overlap they need.

    Overlaps are accumulated over the short lists. In the common order, whatever else two sets share is
    behind the last n-gram counted, or in a long list: that bounds the overlap.
    """
    short = lists.where(F.col("docs") <= SMALL_LIST)
    x, y = (short.select("token", F.col("node").alias(e), F.col("n").alias(f"n{e}"), F.col("place").alias(f"p{e}"), F.col("group").alias(f"g{e}")) for e in "ab")
    able = (F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    met = x.join(y.withColumnRenamed("token", "t"), (F.col("token") == F.col("t")) & able)
    pairs = met.groupBy("a", "b").agg(
        F.min("na").alias("na"), F.min("nb").alias("nb"), F.count("*").alias("common"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    long = stored(lists.where(F.col("docs") > SMALL_LIST).groupBy("node").agg(F.count("*").alias("more")), "long")
    for end in "ab":
        pairs = pairs.join(long.select(F.col("node").alias(end), F.col("more").alias(f"m{end}")), end, "left")
    room = F.col("common") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0))) + F.least(
        F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    needed = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    return pairs.where(room >= needed).select("a", "b", "na", "nb")


def _folded(raw: bytes, size: int) -> np.ndarray:
    """A bitmap brought to ``size`` bytes: places modulo the smaller size, parities added."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(-1, size), axis=0)


def _most_apart(na, nb, percent: int):
    return na + nb - 2 * _needed(na, nb, percent)


def _bounded_pairs(percent: int):
    def run(batches):
        for batch in _slices(batches, 1024):
            na, nb = np.asarray(batch.column(2)).astype(np.int64), np.asarray(batch.column(3)).astype(np.int64)
            apart = np.zeros(len(na), np.int32)
            for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = x.as_py(), y.as_py()
                size = min(len(x), len(y))
                apart[k] = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
            keep = pa.array(np.flatnonzero(apart <= _most_apart(na, nb, percent)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(keep) for c in range(4)), pa.array(apart).take(keep)], ["a", "b", "na", "nb", "apart"])
    return run


def _between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different groups, with these as ga and gb."""
    x = groups.select(F.col("id").alias("a"), F.col("component").alias("ga"))
    y = groups.select(F.col("id").alias("b"), F.col("component").alias("gb"))
    both = pairs.join(x, "a", "left").join(y, "b", "left").withColumns({"ga": F.coalesce("ga", "a"), "gb": F.coalesce("gb", "b")})
    return both.where("ga <> gb").select(*pairs.columns, "ga", "gb")


def _cells(lists: DataFrame, bits: DataFrame) -> DataFrame:
    """Blocks of the product for long lists.

    Rows outside the list's largest group meet all rows; rows of that group meet only the others.
    """
    long = lists.where(F.col("docs") > SMALL_LIST).select("token", "node", "n", "docs", "group")
    sizes = long.groupBy("token", "group").agg(F.count("*").alias("size"))
    main = sizes.groupBy("token").agg(F.max(F.struct("size", "group")).alias("main"), F.sum("size").alias("docs"))
    main = main.where("main.size < docs").select("token", F.col("main.group").alias("main"), (F.col("docs") - F.col("main.size")).alias("others"))
    rows = long.join(main, "token").withColumn("other", F.col("group") != F.col("main"))
    other_blocks = F.ceil(F.col("others") / BLOCK).cast("int")
    main_blocks = F.ceil((F.col("docs") - F.col("others")) / BLOCK).cast("int")
    place = F.pmod(F.xxhash64("node"), F.when(F.col("other"), other_blocks).otherwise(main_blocks)).cast("int")
    # blocks of the others are 0 .. o - 1, those of the largest group o .. o + m - 1
    rows = rows.withColumn("o", other_blocks).withColumn("m", main_blocks).withColumn(
        "own", F.when(F.col("other"), place).otherwise(place + F.col("o")))
    meets = F.when(F.col("other"), F.sequence(F.lit(0), F.col("o") + F.col("m") - 1)).otherwise(F.sequence(F.lit(0), F.col("o") - 1))
    spread = rows.join(bits, "node").withColumn("with", F.explode(meets))
    return spread.select("token", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
                         "own", "node", "n", "group", "bits")


def _bounded_block(percent: int, nearest: bool = False):
    """The pairs of one block that the size bound leaves; a row's bitmap is held against those of the other side.

    With ``nearest`` only the nearest partner of each row of either side.
    """
    def run(key, block):
        i, j = key[1].as_py(), key[2].as_py()
        own = np.asarray(block["own"])
        node, n, group = (np.asarray(block[c]).astype(np.int64) for c in ("node", "n", "group"))
        raw = block["bits"].to_pylist()
        sizes = np.array([len(r) for r in raw])
        found_a, found_b, found_apart = [node[:0]], [node[:0]], [np.zeros(0, np.int64)]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for a_size in np.unique(sizes[left]):
            for b_size in np.unique(sizes[right]):
                a, b, size = left[sizes[left] == a_size], right[sizes[right] == b_size], int(min(a_size, b_size))
                y = np.stack([_folded(raw[k], size) for k in b]).view(U)
                for k in a:
                    able = (100 * np.minimum(n[k], n[b]) >= percent * np.maximum(n[k], n[b])) & (group[k] != group[b])
                    if able.any():
                        at = b[able]
                        apart = np.bitwise_count(y[able] ^ _folded(raw[k], size).view(U)).sum(axis=1, dtype=np.int64)
                        hit = apart <= _most_apart(n[k], n[at], percent)
                        found_a.append(np.full(int(hit.sum()), node[k]))
                        found_b.append(node[at[hit]])
                        found_apart.append(apart[hit])
        a, b, apart = np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_apart)
        if nearest and len(a):
            order = np.argsort(apart, kind="stable")
            first = np.concatenate([order[np.unique(side[order], return_index=True)[1]] for side in (a, b)])
            a, b, apart = (c[np.unique(first)] for c in (a, b, apart))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "apart": apart.astype(np.int32)})
    return run


def _verified(rows: DataFrame, once, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets; texts travel rather than sets, which are larger and don't compress."""
    pairs = stored(pairs, "pairs")
    wanted = stored(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct(), "wanted")
    few = F.broadcast if pairs.count() <= BROADCAST_IDS else (lambda df: df)  # 16 bytes a pair; beyond, joins are shuffled
    texts = stored(once(rows.join(few(wanted), "rid").select("rid", "text")), "texts")
    x, y = (texts.select(F.col("rid").alias(c), F.col("text").alias(f"{c}_text")) for c in "ab")
    return stored(x.join(few(pairs), "a").join(y, "b").select("a", "b", "a_text", "b_text").mapInArrow(
        _linked(width, percent), "a long, b long"), "links")


def _linked(width: int, percent: int):
    def run(batches):
        for batch in _slices(batches, 128):
            sets = [_shingles(*words_of(batch.column(k), lower=True), width) for k in (2, 3)]
            keep = []
            for k, (x, y) in enumerate(zip(*sets)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])
    return run
