"""Nearest neighbours by an inverted file whose lists are scanned a block of dimensions at a time."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemark.llm.tables import give_back, ship, stored

SAMPLE = 20_000  # vectors of one length that an index is fitted on, drawn by hash
MOST_LISTS = 4096  # centroids of one length
CHECKS = 200  # sampled vectors on which the number of probed lists is chosen
COVER = 0.99  # share of their nearest neighbours that these lists must hold
PART = 4096  # vectors of one part of a list
ASKED = 1024  # queries that meet a part at a time
TILES = 64  # tiles that the parts are dealt to, at least
TILE = 1 << 20  # vectors of a tile, where that makes more tiles
BLOCK = 1 << 26  # bytes of the queries that meet a tile in one task
PIECE = 1 << 19  # numbers of one product
COLUMNS = 16  # dimensions between two tests
DOUBT = 2.1  # a candidate goes when its distance is beyond the bound by that many deviations
SPARSE = 8  # pairs are followed one by one where one in so many is left


@dataclass
class Index:
    """Of each vector length: a rotation, centroids (rotated) and the number of lists that a query probes."""

    rotations: dict[int, np.ndarray]
    centroids: dict[int, np.ndarray]
    probes: dict[int, int]


def usable(column: str):
    """Neither null nor empty nor zero, all components known and finite."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def fit_index(vectors: DataFrame, k: int = 10, column: str = "embedding", vec_id: str = "vec_id") -> Index:
    """Centroids by Lloyd's rounds on at most ``SAMPLE`` vectors of each length, drawn by a hash of id and vector.

    The number of lists is the root of the number of vectors (``MOST_LISTS`` at most). The number of probes is the
    least for which the probed lists hold ``COVER`` of the ``k`` nearest sampled neighbours of ``CHECKS`` sampled vectors. Rotations are
    random and orthogonal with a fixed seed, so fitting twice gives the same index. Only usable vectors count.
    """
    rows = vectors.where(usable(column)).select(F.col(vec_id).alias("id"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.withColumn("d", F.size("v"))
    sizes = {r.d: r.n for r in rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(64).collect()}
    index = Index({}, {}, {})
    for d, n in sizes.items():  # other lengths have one list
        share = min(1.0, SAMPLE / n)
        drawn = rows.where((F.col("d") == d) & (F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
        drawn = drawn.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
        sample = np.asarray(drawn.flatten(), np.float64).reshape(-1, d)
        if len(sample) < 4:
            continue
        generator = np.random.default_rng(11)
        rotation = np.linalg.qr(generator.standard_normal((d, d)))[0]
        sample = sample @ rotation
        lists = max(1, min(MOST_LISTS, int(math.sqrt(n)), len(sample) // 4))
        index.rotations[d], index.centroids[d] = rotation, _lloyd(sample, lists, generator)
        index.probes[d] = _probes(sample, index.centroids[d], k)
    return index


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out, both = (x * x).sum(1)[:, None] + (y * y).sum(1), x @ y.T
    both *= 2
    out -= both
    return np.maximum(out, 0, out=out)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    step = min(2048, _rows_of(len(centroids)))
    return np.concatenate([_squares(x[i:i + step], centroids).argmin(1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _rows_of(columns: int) -> int:
    """Rows of a table with so many columns that is held at a time."""
    return max(1, PIECE // max(1, columns))


def _lloyd(x: np.ndarray, lists: int, generator, rounds: int = 8) -> np.ndarray:
    centroids = x[generator.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        home = _nearest(x, centroids)
        count = np.bincount(home, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids


def _probes(x: np.ndarray, centroids: np.ndarray, k: int) -> int:
    home, needed, step = _nearest(x, centroids), [], _rows_of(len(x))
    for i in range(0, min(CHECKS, len(x)), step):
        asked = x[i:min(i + step, CHECKS)]
        far = _squares(asked, x)
        far[np.arange(len(asked)), i + np.arange(len(asked))] = np.inf
        near = np.argsort(far, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
        place = np.argsort(np.argsort(_squares(asked, centroids), axis=1, kind="stable"), axis=1, kind="stable")
        needed.append(np.take_along_axis(place, home[near], axis=1).ravel())
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, math.ceil(COVER * len(needed)) - 1)]) + 1


def nearest_vectors(vectors: DataFrame, queries: DataFrame, index: Index, k: int = 10, column: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` found for each row of ``queries``, nearest first.

    Both have ``vec_id`` and ``column``; other columns are not looked at. Nearness is the Euclidean distance of the
    original vectors in double precision, ties go to the smaller vec_id. A row with the query's own vec_id is no candidate. Vectors that are null,
    empty, zero or hold null or non-finite components, rows without vec_id, and candidates of another length than the
    query's take no part; a query without candidates has no rows. Rows repeated in ``vectors`` are one candidate, and a
    vec_id with two vectors is a candidate at its nearer one; a query repeated with another vector asks with both,
    and its rows rank what either finds. Fewer than ``k`` candidates are all returned. Empty tables give an empty one.

    Method. Every vector belongs to the list of its nearest centroid; a list is cut in parts of ``PART`` vectors, by
    hash, and the parts are dealt to tiles. A query probes the lists of its nearest centroids, first one for a bound, then the others (at
    least as many as hold ``k`` + 1 vectors for sure). It goes once to each tile that holds such a list, with the distance of its
    farthest centroid, so no row is made for a query and a list; a task holds one block of queries, and the vectors pass by in the order of their lists. A
    part is turned by the random rotation and read ``COLUMNS`` dimensions at a time: after t of D dimensions a candidate's partial square
    distance, times D / t, estimates the whole one, and the candidate is abandoned when the estimate exceeds the bound by
    ``DOUBT`` / sqrt(t) of it (the hypothesis that it is among the k nearest is rejected). Where the first test leaves too many pairs of
    a part and its queries to follow each, their whole distances are one product. What is left is measured on the original vectors.
    """
    ship(vectors.sparkSession)
    rows, asked = (df.where(usable(column) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), _plain(df, column).alias("v"))
                   for df in (vectors, queries))
    members = stored(rows.mapInArrow(_homes(index), "id long, v binary, d int, list int"), "members")
    sizes = stored(members.groupBy("d", "list").agg(F.count("*").alias("n")), "sizes")
    parts = F.ceil(F.col("n") / PART).cast("int")
    n, cut = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(parts), F.lit(0))).first()
    tiles = max(1, min(cut, max(TILES, -(-n // TILE))))
    lists = sizes.withColumn("parts", parts).withColumn(
        "tiles", F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: _tile(i, tiles))))
    held: dict[int, np.ndarray] = {}
    dealt: dict[int, np.ndarray] = {}
    for r in lists.where(F.col("d").isin([int(d) for d in index.centroids])).select("d", "list", "n", "tiles").toLocalIterator():  # a row per centroid
        held.setdefault(r.d, np.zeros(len(index.centroids[r.d]), np.int64))[r.list] = r.n
        dealt.setdefault(r.d, np.zeros((len(index.centroids[r.d]), tiles), bool))[r.list, r.tiles] = True
    asks = asked.dropDuplicates(["id", "v"]).mapInArrow(
        _probed(index, held, dealt, k), "id long, v binary, d int, first int, reach double, others array<int>")
    asks = stored(asks.withColumn("ask", F.monotonically_increasing_id()), "asks")
    weight = F.sum(F.length("v").cast("long"))
    blocks = asks.groupBy("d", F.col("first").alias("list")).agg(weight.alias("weight")).withColumn("all", F.sum("weight").over(Window.partitionBy("d")))
    lists = lists.join(blocks.select("d", F.col("all")).distinct(), "d").join(blocks.select("d", "list", "weight"), ["d", "list"], "left")
    lists = stored(lists.select(  # a row per centroid, and per other length; blocks of the first pass, none where no query begins, and of the second
        "d", "list", "parts", "tiles", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(name) for c, name in (("weight", "blocks_0"), ("all", "blocks_1")))), "lists")
    where = F.broadcast(lists.select("d", F.col("list").alias("first"), "tiles", "blocks_0", "blocks_1"))
    asks = asks.join(where, ["d", "first"]).withColumn("place", F.xxhash64("id", "v"))
    asks = asks.select("*", *(F.pmod("place", F.col(f"blocks_{i}")).cast("int").alias(f"block_{i}") for i in (0, 1)))
    members = members.join(F.broadcast(lists.select("d", "list", "parts", "blocks_0", "blocks_1")), ["d", "list"]).select(
        _tile(F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"), tiles).alias("tile"), "blocks_0", "blocks_1", "d", "list", "id", "v")
    first = stored(_scanned(members, asks.withColumn("tile", F.explode("tiles")).withColumn("bound", F.lit(float("inf"))), index, k, True), "first")
    bound = _best(first, k).groupBy("ask").agg(F.when(F.count("*") == k, F.max("score")).alias("bound"))
    others = asks.join(bound, "ask", "left").withColumn("tile", F.explode("others")).withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    second = _scanned(members, others, index, k, False)
    found = first.union(second).repartition("qid").groupBy("qid", "id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("qid").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def _plain(df: DataFrame, column: str):
    """The vectors as single precision where they are stored so, else as double precision."""
    kind = df.select(column).schema[0].dataType
    return F.col(column).cast("array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>")


def _tile(part, tiles: int):
    return F.pmod(F.xxhash64("d", "list", part), F.lit(tiles)).cast("int")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("ask").orderBy("score", "id")
    return found.groupBy("ask", "id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _lengths(column: pa.Array):
    """(length, places, matrix) for each vector length of a batch of arrays."""
    ends = np.asarray(column.value_lengths())
    for d in np.unique(ends):
        at = np.flatnonzero(ends == d)
        yield int(d), at, np.asarray(column.take(pa.array(at)).flatten()).reshape(len(at), int(d))


def _homes(index: Index):
    def run(batches):
        for batch in batches:
            raw, home = np.empty(batch.num_rows, object), np.zeros(batch.num_rows, np.int32)
            size = np.zeros(batch.num_rows, np.int32)
            for d, at, v in _lengths(batch.column(1)):
                size[at] = d
                if d in index.centroids:
                    home[at] = _nearest(v.astype(np.float64) @ index.rotations[d], index.centroids[d])
                raw[at] = [x.tobytes() for x in v]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw.tolist(), pa.binary()), pa.array(size), pa.array(home)], ["id", "v", "d", "list"])
        give_back()
    return run


def _probed(index: Index, held: dict[int, np.ndarray], dealt: dict[int, np.ndarray], k: int):
    """For each query its first list, the square distance of the farthest centroid it probes, and the tiles of its other lists; empty lists are passed over."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for d, places, all_v in _lengths(batch.column(1)):
                step = _rows_of(len(held[d])) if d in held else len(places)
                for i in range(0, len(places), step):
                    at, v = places[i:i + step], all_v[i:i + step]
                    first, reach, others = np.zeros(len(at), np.int32), np.full(len(at), np.inf), np.zeros((len(at), 0), bool)
                    if d in held:
                        far = _squares(v.astype(np.float64) @ index.rotations[d], index.centroids[d])
                        far[:, held[d] == 0] = np.inf
                        order = np.argsort(far, axis=1, kind="stable")
                        enough = (np.cumsum(held[d][order], axis=1) <= 2 * k).sum(1) + 1
                        upto = np.minimum(np.maximum(index.probes[d], enough), (held[d] > 0).sum())
                        first = order[:, 0].astype(np.int32)
                        reach = far[np.arange(len(at)), order[np.arange(len(at)), upto - 1]]
                        probed = np.zeros(far.shape, np.float32)
                        np.put_along_axis(probed, order, (np.arange(far.shape[1]) < upto[:, None]).astype(np.float32), axis=1)
                        probed[np.arange(len(at)), first] = 0
                        others = probed @ dealt[d].astype(np.float32) > 0
                    ends = np.concatenate([[0], np.cumsum(others.sum(1))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at)), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(np.full(len(at), d, np.int32)), pa.array(first),
                         pa.array(reach), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(others)[1].astype(np.int32)))],
                        ["id", "v", "d", "first", "reach", "others"])
        give_back()
    return run


def _scanned(members: DataFrame, asks: DataFrame, index: Index, k: int, first: bool) -> DataFrame:
    """(ask, qid, id, score): the best ``k`` of each tile for each query that goes there, in the first list of the query or in its others.

    A tile meets each block of the queries in one task; neither a large list nor a much asked one is one tile or one block.
    """
    turn = "0" if first else "1"
    rows = members.where(F.col(f"blocks_{turn}") > 0).select(
        "tile", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{turn}") - 1)).alias("block"), "d", F.lit(1).alias("kind"), "list", "id", "v",
        F.lit(None).cast("long").alias("ask"), F.lit(None).cast("double").alias("reach"), F.lit(None).cast("double").alias("bound"))
    who = asks.select("tile", F.col(f"block_{turn}").alias("block"), "d", F.lit(0).alias("kind"), F.col("first").alias("list"), "id", "v", "ask", "reach", "bound")
    both = who.union(rows).repartition("tile", "block").sortWithinPartitions("tile", "block", "d", "kind", "list")
    return both.mapInArrow(_scan(index, k, first, PART, ASKED), "ask long, qid long, id long, score double")


def _scan(index: Index, k: int, first: bool, most: int, portion: int):
    def run(batches):
        tile = key = None
        for batch in batches:
            names = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            at = np.stack([np.asarray(names[c]) for c in ("tile", "block", "d", "kind", "list")])
            at[4, at[3] == 0] = -1  # queries stand together, whatever their first list
            starts = np.flatnonzero(np.concatenate([[True], (at[:, 1:] != at[:, :-1]).any(0)])) if batch.num_rows else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                here = tuple(at[:3, start])
                if here != key:
                    if tile:
                        yield from tile.found()
                    key, tile = here, _Tile(index, int(at[2, start]), k, first, portion)
                if at[3, start] == 0:
                    tile.ask(batch.slice(start, end - start))
                elif tile.asks:
                    for i in range(start, end, most):
                        some = batch.slice(i, min(most, end - i))
                        tile.meet(int(at[4, start]), np.asarray(some.column(5)), _matrix(some.column(6), tile.d))
        if tile:
            yield from tile.found()
        tile = None
        give_back()
    return run


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of ``d`` dimensions, in the precision that they have."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * d * len(column) else np.float64).reshape(-1, d)


def _without_copies(v: np.ndarray, ids: np.ndarray, k: int):
    """Of each vector the rows of the ``k`` + 1 smallest ids: no query finds more of them, its own among them."""
    _, kind = np.unique(np.ascontiguousarray(v).view(f"V{v.itemsize * v.shape[1]}").ravel(), return_inverse=True)
    kind = kind.ravel()
    order = np.lexsort((ids, kind))
    fresh = np.concatenate([[True], np.diff(kind[order]) != 0])
    order = order[fresh | np.concatenate([[True], np.diff(ids[order]) != 0])]
    fresh = np.concatenate([[True], np.diff(kind[order]) != 0])
    since = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    order = np.sort(order[since <= k])
    return v[order], ids[order]


class _Tile:
    """A block of queries and the best ``k`` that each has met so far; the vectors of a tile pass by."""

    def __init__(self, index: Index, d: int, k: int, first: bool, portion: int):
        self.d, self.k, self.first, self.portion = d, k, first, portion
        self.rotation, self.centroids = index.rotations.get(d), index.centroids.get(d)
        self.asks, self.ready = [], False

    def ask(self, batch: pa.RecordBatch) -> None:
        numbers = [np.array(batch.column(i)) for i in (4, 5, 7, 8, 9)]
        self.asks.append((*numbers, _matrix(batch.column(6), self.d)))

    def _open(self) -> None:
        if self.ready:
            return
        self.home, self.ids, self.number, self.reach, self.bound, self.exact = (
            np.concatenate([x[i] for x in self.asks]) for i in range(6))
        self.asks = [True]
        self.norm = np.concatenate([(v * v).sum(1) for v in self._doubles()])
        self.score = np.full((len(self.ids), self.k), np.inf)
        self.best = np.full((len(self.ids), self.k), np.iinfo(np.int64).max)
        self.ready = True

    def _doubles(self):
        """The queries in double precision, some at a time."""
        step = _rows_of(self.d)
        return (self.exact[i:i + step].astype(np.float64) for i in range(0, len(self.exact), step))

    def _turn(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return v if self.rotation is None else v @ self.rotation

    def meet(self, place: int, ids: np.ndarray, v: np.ndarray) -> None:
        """Compare vectors of the list ``place`` with the queries that probe it in this pass."""
        self._open()
        if self.first:
            who = np.flatnonzero(self.home == place)
        else:
            centre = self.centroids[place]
            c = centre @ centre
            back = 2 * (self.rotation @ centre)
            far = self.norm + c - np.concatenate([v @ back for v in self._doubles()])
            who = np.flatnonzero((far <= self.reach * (1 + 1e-9) + 1e-12 * (self.norm + c)) & (self.home != place))
        if not len(who):
            return
        v, ids = _without_copies(v, ids, self.k)
        k = self.k + len(ids) - len(np.unique(ids))  # so many rows hold k ids
        v, turned = v.astype(np.float64), self._turn(v)
        if self.first:
            blocks = [np.ascontiguousarray(turned[:, c:c + COLUMNS]) for c in range(0, self.d, COLUMNS)]
            for i in range(0, len(who), self.portion):
                some = who[i:i + self.portion]
                kept, pairs = [], 0
                for q, asked in zip(some, self._turn(self.exact[some])):
                    left = _adaptive(blocks, asked, ids != self.ids[q], math.inf, k, self.d)
                    kept.append((np.full(len(left), q), left))
                    pairs += len(left)
                    if pairs > PIECE or q == some[-1]:
                        self._measure(*(np.concatenate(x) for x in zip(*kept)), ids, v)
                        kept, pairs = [], 0
            return
        turned = turned - centre
        for i in range(0, len(who), self.portion):
            some = who[i:i + self.portion]
            self._portion(some, turned, self._turn(self.exact[some]) - centre, ids, v, k)

    def _portion(self, who: np.ndarray, turned: np.ndarray, turned_asks: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> None:
        width, most = min(COLUMNS, self.d), (turned * turned).sum(1).max()
        size = (turned_asks * turned_asks).sum(1) + most
        kind = np.float32 if 1e-25 < size.min() and size.max() < 1e30 else np.float64
        margin = (self.d + 8) * 2.4e-7 * size  # more than single precision can be wrong by
        bound = self.bound[who]
        early = (_limit(bound, width, self.d) * (width / self.d) + margin).astype(kind)[:, None]
        step, seen = max(1, PIECE // len(who)), width
        rows, asks = _factors(turned, turned_asks, seen, kind)
        for at in range(0, len(ids), step):
            near = np.minimum(bound, self.score[who].max(1))
            partial = asks @ rows[at:at + step].T
            if seen < self.d:
                left = ~(partial > early)
                if np.count_nonzero(left) * SPARSE > left.size:  # too many to follow: from here on whole distances
                    seen = self.d
                    rows, asks = _factors(turned, turned_asks, seen, kind)
                    partial = asks @ rows[at:at + step].T
            if seen < self.d:
                q, r = np.divmod(np.flatnonzero(left), left.shape[1])
                q, r = self._follow(q, r + at, turned, turned_asks, bound)
            else:
                last = near * near * (1 + 1e-9) + margin + 1e-300
                free = np.flatnonzero(~np.isfinite(near))
                if len(free) and partial.shape[1] > k + 1:  # the nearest of these rows, one may be the query's own
                    last[free] = np.partition(partial[free], k, axis=1)[:, k] + 2 * margin[free]
                q, r = np.divmod(np.flatnonzero(~(partial > last.astype(kind)[:, None])), partial.shape[1])
                r = r + at
            self._measure(who[q], r, ids, v)

    def _follow(self, q: np.ndarray, r: np.ndarray, turned: np.ndarray, turned_asks: np.ndarray, bound: np.ndarray):
        """The pairs that no test rejects, ``COLUMNS`` dimensions at a time."""
        partial = np.zeros(len(q))
        for c in range(0, self.d, COLUMNS):
            partial += ((turned[r, c:c + COLUMNS] - turned_asks[q, c:c + COLUMNS]) ** 2).sum(1)
            seen = min(self.d, c + COLUMNS)
            keep = ~(partial * (self.d / seen) > _limit(bound[q], seen, self.d))
            q, r, partial = q[keep], r[keep], partial[keep]
        return q, r

    def _measure(self, q: np.ndarray, r: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Take the pairs of queries and rows (in the order of the queries) into what the queries have met."""
        step = max(1, PIECE // self.d)
        for i in range(0, len(q), step):
            a, b = q[i:i + step], r[i:i + step]
            score = np.sqrt(((v[b] - self.exact[a].astype(np.float64)) ** 2).sum(axis=1))
            able = (ids[b] != self.ids[a]) & (score <= np.minimum(self.score[a].max(1), self.bound[a]))
            a, b, score = a[able], ids[b[able]], score[able]
            order = np.lexsort((b, score, a))
            a, b, score = a[order], b[order], score[order]
            while len(a):  # one row of each query at a time
                now = np.concatenate([[True], a[1:] != a[:-1]])
                self._insert(a[now], b[now], score[now])
                a, b, score = a[~now], b[~now], score[~now]
                able = score <= self.score[a].max(1)
                a, b, score = a[able], b[able], score[able]

    def _insert(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        had, were = self.score[q], self.best[q]
        same = were == ids[:, None]
        worst = np.where(had == had.max(1)[:, None], were, np.iinfo(np.int64).min).argmax(1)
        place, line = np.where(same.any(1), same.argmax(1), worst), np.arange(len(q))
        old, who = had[line, place], were[line, place]
        better = (score < old) | (score == old) & (ids < who)
        self.score[q[better], place[better]] = score[better]
        self.best[q[better], place[better]] = ids[better]

    def found(self):
        if not self.ready:
            return
        step = max(1, 65536 // self.k)
        for i in range(0, len(self.ids), step):
            best, score = self.best[i:i + step], self.score[i:i + step]
            q, j = np.nonzero(best != np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.number[i:i + step][q]), pa.array(self.ids[i:i + step][q]), pa.array(best[q, j]), pa.array(score[q, j])],
                ["ask", "qid", "id", "score"])


def _limit(bound: np.ndarray, seen: int, d: int) -> np.ndarray:
    """Estimated square distances beyond this are rejected."""
    slack = 1 + 1e-9 if seen == d else (1 + DOUBT / math.sqrt(seen)) ** 2
    return slack * bound * bound * (1 + 1e-9) + 1e-300


def _factors(rows: np.ndarray, asks: np.ndarray, seen: int, kind) -> list[np.ndarray]:
    """Of rows and of queries, factors whose product is the square distance over the first ``seen`` dimensions."""
    out = []
    for x, scale in ((rows[:, :seen], -2), (asks[:, :seen], 1)):
        size, one = (x * x).sum(1)[:, None], np.ones((len(x), 1))
        out.append(np.hstack([scale * x, size, one] if scale < 0 else [x, one, size]).astype(kind))
    return out


def _adaptive(blocks: list[np.ndarray], query: np.ndarray, able: np.ndarray, bound: float, k: int, d: int) -> np.ndarray:
    """Places of the candidates that no test rejects; all that may be among the ``k`` nearest within ``bound``."""
    left = np.flatnonzero(able)
    partial, seen = np.zeros(len(left)), 0
    for block in blocks:
        width = block.shape[1]
        part = block[left] if len(left) < len(block) else block
        partial = partial + ((part - query[seen:seen + width]) ** 2).sum(axis=1)
        seen += width
        if len(left) <= k:
            continue
        if not math.isfinite(bound):  # the k that look nearest give a first bound: their distance in full
            some = left[np.argpartition(partial, k - 1)[:k]]
            bound = math.sqrt(max(sum(((b[some] - query[i * COLUMNS:i * COLUMNS + b.shape[1]]) ** 2).sum(axis=1) for i, b in enumerate(blocks))))
        slack = 1 + 1e-9 if seen == d else (1 + DOUBT / math.sqrt(seen)) ** 2
        keep = partial * (d / seen) <= slack * bound * bound * (1 + 1e-9) + 1e-300
        left, partial = left[keep], partial[keep]
    return left
