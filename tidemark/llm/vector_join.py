"""Near-duplicate vectors: an exact range join in the metric of the unit sphere."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import components, ship, stored

CELL = 32  # vectors a cell should get at least; else the root of its label's
BLOCK = 4000  # vectors on either side of one block of a cell
STRIPE = 512  # rows of a block that are multiplied at a time
MOST_PIVOTS = 2000  # of all labels; bounds the pivot table, larger cells are split into more blocks
SLACK = 1e-9


def vector_groups(vectors: DataFrame, least_cosine: float = 0.93) -> DataFrame:
    """Add n_links, component_id and kept: vectors of one label linked by cosine >= ``least_cosine``.

    ``vectors`` has vec_id, embedding (array of float or double) and label; other columns are kept
    (those three names are replaced). Cosines are in double precision. Vectors that are null, empty,
    zero, hold null or non-finite components or have a null label link with nothing, and
    vectors of different lengths never link. n_links counts the other rows linked directly,
    copies included; component_id is the smallest vec_id reachable by links (itself included);
    kept says whether that is the row's own vec_id (a null vec_id: true if alone). Repeated rows are
    vectors like others; a vec_id given twice with different vectors is two vectors.
    An empty table gives an empty table.

    Method. On unit vectors cosine >= c means a distance of at most r = sqrt(2 - 2c). Equal vectors are one
    weighted vector. Pivots are drawn by hash for each label; a vector's home is the cell of its
    nearest pivot. If x (home p) and y (home q) are within r, the triangle inequality puts y
    within 2r of the border between p and q: d(y,p) <= d(y,q) + 2r, and within R_p + r of p, where R_p is
    the radius of p's cell; y visits the cells for which both hold (and the like bound on
    its distance from the bisecting plane). So each vector meets all its partners in its home
    cell, and cells join by themselves. A cell is dealt to tasks in blocks of rows; vectors
    within r/2 of their pivot link with each other for sure and are summed, not compared.
    """
    ship(vectors.sparkSession)
    radius = math.sqrt(2 - 2 * least_cosine)
    key = F.xxhash64("label", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    valid = (F.col("label").isNotNull() & (F.size("embedding") > 0) & finite
             & F.exists("embedding", lambda x: x != 0))
    names = [c for c in vectors.columns if c not in ("n_links", "component_id", "kept")]
    rows = vectors.select(*names, F.when(F.coalesce(valid, F.lit(False)), key).alias("_node"))
    nodes = stored(rows.where("_node is not null").groupBy("_node").agg(
        F.count("*").alias("copies"), F.min("vec_id").cast("long").alias("least"), F.first("label").alias("label"),
        F.first("embedding").cast("array<double>").alias("v")).withColumnRenamed("_node", "node")
        .withColumn("space", F.concat_ws(":", F.col("label").cast("string"), F.size("v"))), "vectors")
    pivots = _pivots(nodes)
    homes = stored(nodes.select("node", "copies", "space", "v").mapInArrow(
        _find_home(pivots), "node long, copies long, space string, v binary, home int, away double"), "homes")
    core = F.col("away") <= radius / 2 - SLACK
    shape = homes.groupBy("space", "home").agg(
        F.max("away").alias("radius"), F.count("*").alias("n"), F.sum(F.when(core, F.col("copies"))).alias("core_copies"),
        F.min(F.when(core, F.col("node"))).alias("core_node"))
    shape = stored(shape, "cells")
    radii = {(r.space, r.home): r.radius for r in shape.select("space", "home", "radius").collect()}  # a row per pivot
    members = stored(homes.mapInArrow(
        _visits(pivots, radii, radius), "node long, copies long, space string, v binary, home boolean, core boolean, cell int"), "members")
    blocks = _blocks(members).groupBy("space", "cell", "i", "j").applyInArrow(
        _join_block(least_cosine), "kind int, a long, b long")
    found = stored(blocks, "block-links")
    of_core = homes.where(core).join(shape, ["space", "home"]).select(
        F.col("node"), (F.col("core_copies") - F.col("copies")).alias("links"), "core_node")
    links = found.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("links")).union(
        of_core.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("kind = 1").select("a", "b").union(
        of_core.where("node <> core_node").select(F.col("node").alias("a"), F.col("core_node").alias("b"))))
    labelled = nodes.select("node", "least", "copies").join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    result = labelled.join(least, "component").join(links, "node", "left").select(
        F.col("node").alias("_node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    out = rows.join(result, "_node", "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return out.select(*names, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").cast("long").eqNullSafe(component).alias("kept"))


def _pivots(nodes: DataFrame) -> dict[str, np.ndarray]:
    """Pivots per label and length, drawn by hash: about as many as vectors to a cell, MOST_PIVOTS in all."""
    sizes = nodes.groupBy("space").agg(F.count("*").alias("n")).withColumn("share", 1 / F.greatest(F.lit(float(CELL)), F.sqrt("n")))
    sizes = stored(sizes.where(f"n > {CELL}"), "spaces")
    wanted = sizes.agg(F.sum(F.col("n") * F.col("share"))).first()[0] or 0
    part = min(1.0, MOST_PIVOTS / 2 / max(wanted, 1))
    drawn = nodes.join(sizes, "space").where(
        F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 30)) < F.col("share") * F.lit(part * (1 << 30))).select("space", "v", "node")
    out: dict[str, list] = {}
    for row in drawn.orderBy("node").limit(MOST_PIVOTS).collect():
        v = np.array(row.v)
        out.setdefault(row.space, []).append(v / _norm(v[None])[0])
    return {k: np.stack(v) for k, v in out.items()}


def _norm(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1)
    return top * np.sqrt(((v / top[:, None]) ** 2).sum(axis=1))


def _dense(column) -> np.ndarray:
    """Vectors of one length, kept as the bytes of their doubles, as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[borders[0]:borders[-1]].view(np.float64).reshape(len(column), -1)


def _by_space(spaces: pa.Array):
    """The rows of each label and length in a batch."""
    values = np.asarray(spaces.to_pylist(), dtype=object)
    for space in sorted(set(values.tolist())):
        yield space, np.flatnonzero(values == space)


def _find_home(pivots: dict[str, np.ndarray]):
    """Without pivots of its own, a label has one cell around its first axis."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            home, away, raw = np.zeros(n, np.int32), np.zeros(n), np.empty(n, dtype=object)
            for space, at in _by_space(batch.column(2)):
                own = batch.column(3).take(pa.array(at))
                v = np.asarray(own.flatten(), dtype=np.float64).reshape(len(at), -1)
                u = v / _norm(v)[:, None]
                p = pivots.get(space)
                if p is None:
                    p = np.eye(1, u.shape[1])
                far = np.sqrt(np.maximum(2 - 2 * (u @ p.T), 0))
                home[at], away[at] = far.argmin(axis=1), far.min(axis=1)
                raw[at] = [x.tobytes() for x in v]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(raw.tolist(), pa.binary()), pa.array(home), pa.array(away)],
                [*batch.schema.names[:3], "v", "home", "away"])
    return run


def _visits(pivots: dict[str, np.ndarray], radii: dict[tuple[str, int], float], r: float):
    """A row for the home cell of each vector and one for each cell that it visits."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            home, away = np.asarray(batch.column(4)), np.asarray(batch.column(5))
            at_all, cell_all = [np.arange(n)], [home]
            for space, at in _by_space(batch.column(2)):
                p = pivots.get(space)
                if p is None or len(p) < 2:
                    continue
                v = _dense(batch.column(3).take(pa.array(at)))
                u = v / _norm(v)[:, None]
                own, mine = home[at], away[at]
                far = np.sqrt(np.maximum(2 - 2 * (u @ p.T), 0))
                reach = np.array([radii.get((space, c), -10.0) for c in range(len(p))])
                between = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[own]
                plane = (far ** 2 - mine[:, None] ** 2) / np.maximum(2 * between, 1e-12)
                goes = (far <= mine[:, None] + 2 * r + SLACK) & (far <= reach + r + SLACK) & ((plane <= r + SLACK) | (between < 1e-6))
                goes[np.arange(len(at)), own] = False
                who, cell = np.nonzero(goes)
                at_all.append(at[who])
                cell_all.append(cell.astype(np.int32))
            at, cell = np.concatenate(at_all), np.concatenate(cell_all)
            is_home = np.zeros(len(at), bool)
            is_home[:n] = True
            rows = pa.RecordBatch.from_arrays(batch.columns[:4], batch.schema.names[:4]).take(pa.array(at))
            inner = is_home & (away[at] <= r / 2 - SLACK)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(is_home), pa.array(inner), pa.array(cell.astype(np.int32))],
                [*rows.schema.names, "home", "core", "cell"])
    return run


def _blocks(members: DataFrame) -> DataFrame:
    """Block (i, j) of a cell holds part i of its home vectors (side 0) and part j of all its vectors (side 1)."""
    sizes = members.groupBy("space", "cell").agg(
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("p"), F.ceil(F.count("*") / BLOCK).cast("int").alias("q"))
    rows = members.join(sizes.where("p > 0"), ["space", "cell"])
    place = F.xxhash64("node", F.lit("block"))
    home = rows.where("home").withColumn("i", F.pmod(place, F.col("p")).cast("int")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    every = rows.withColumn("j", F.pmod(place, F.col("q")).cast("int")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    columns = ["space", "cell", "i", "j", "node", "copies", "v", "core"]
    return home.select(*columns, F.lit(0).alias("side")).union(every.select(*columns, F.lit(1).alias("side")))


def _join_block(least_cosine: float):
    """Of one block: (0, node, copies it links with) and (1, a, b) links that span its groups."""
    def run(key, table):
        side = np.asarray(table["side"])
        node, copies, core = np.asarray(table["node"]), np.asarray(table["copies"]), np.asarray(table["core"])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        kinds, first, second = [], [], []
        if len(left) and len(right):
            values = _dense(table["v"])
            values = values / np.abs(values).max(axis=1)[:, None]
            length = np.sqrt((values * values).sum(1))
            for i in range(0, len(left), STRIPE):
                some = left[i:i + STRIPE]
                cosine = (values[some] @ values[right].T) / (length[some][:, None] * length[right])
                link = (cosine >= least_cosine) & (node[some][:, None] != node[right]) & ~(core[some][:, None] & core[right])
                counts = (link * copies[right]).sum(axis=1)
                has = np.flatnonzero(counts)
                kinds.append(np.zeros(len(has), np.int32))
                first.append(node[some][has])
                second.append(counts[has])
                a, b = _spanning(link, node[some], node[right])
                kinds.append(np.ones(len(a), np.int32))
                first.append(a)
                second.append(b)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"kind": join(kinds, np.int32), "a": join(first, np.int64), "b": join(second, np.int64)})
    return run


def _spanning(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its group in the block) that keep the block's groups together."""
    rows, columns = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    link, ids, at = link[np.ix_(rows, columns)], *np.unique(np.concatenate([left[rows], right[columns]]), return_inverse=True)
    low = np.arange(len(ids))
    x, y = at[: len(rows)], at[len(rows):]
    high = len(ids)
    while True:
        before = low.copy()
        np.minimum.at(low, x, np.where(link, low[y], high).min(axis=1))
        np.minimum.at(low, y, np.where(link, low[x][:, None], high).min(axis=0))
        low = low[low]
        if (low == before).all():
            break
    moved = np.flatnonzero(low != np.arange(len(ids)))
    return ids[moved], ids[low[moved]]
