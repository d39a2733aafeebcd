"""A Merkle manifest of a table: leaves by group, a root for each group, a root over the groups, a path for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import stored

FAN = 8  # nodes hashed into one
LEVELS = 3  # levels that one round builds
BLOCK = FAN ** LEVELS  # nodes of a block: bounds what one row and one task hold
HEX = 64  # characters of a digest


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row: of each value ``-`` if null, else its UTF-8 byte count, ``:`` and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to: level by level the digest of its run, the leaf between its siblings."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path as one hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def merkle_manifest(rows: DataFrame, fields: list[str], group: str, order: str, keep: list[str] | None = None) -> DataFrame:
    """(``keep`` columns, leaf, subroot, root, path) for each row of ``rows``.

    A leaf is ``leaf_of`` the ``fields``. In each ``group`` leaves ascend by ``order``, and while several
    nodes remain, every 8 consecutive ones become the digest of their hex texts; what remains is the
    group's subroot. Subroots ascend by the group's text (bytewise) and lead to root in the same way.
    path lists for each level up to root the hex texts left and right of the row's own node in its run (empty ones too);
    ``fold`` goes along it and ``siblings`` joins it.

    Nulls: a null field is the leaf's ``-``; a null group is a group of its own and the first one, null
    ``order`` values come first. Rows equal in ``order`` ascend by leaf, so repeated rows are leaves next to each other.
    An empty table gives an empty table. Columns of any names may stand in ``rows``; only ``keep`` (default:
    ``order``) comes out, and must not hold leaf, subroot, root or path. Texts are hashed where they are
    read; only digests and ``keep`` are shuffled.

    Method. Rows are placed by one range shuffle on (group, order): a task numbers its rows, and one row per task and
    group gives each number its start. Every 512 consecutive nodes are a block, one row that keeps each of its levels as one hex
    text; parents are digests of fixed-width pieces of that text and the siblings of a node the pieces
    beside it. The digests of blocks are the nodes of the next round, until a group has one block; then
    the groups' roots are placed and built alike. Paths are handed down from block to block.
    """
    keep = [order] if keep is None else keep
    held = F.struct(*[F.col(c) for c in keep])
    name = F.col(group).cast("string")
    leaves = rows.select(F.coalesce(F.concat(F.lit("+"), name), F.lit("")).alias("g"), F.col(order).alias("o"),
                         leaf_of([F.col(c) for c in fields]).alias("digest"), held.alias("held"))
    rounds = _rounds(_placed(leaves, ["o", "digest"]).select("g", "pos", "n", "digest", "held"))
    tops = rounds[0].where(F.col("n") <= BLOCK).select("g", "digest")
    for blocks in rounds[1:]:
        tops = tops.union(blocks.where(F.col("n") <= BLOCK).select("g", "digest"))
    tops = stored(tops, "subroots").select(F.lit("").alias("g"), F.col("g").alias("o"), "digest", F.struct(F.col("g").alias("of")).alias("held"))
    trunk = _rounds(_placed(tops, ["o"]).select("g", "pos", "n", "digest", "held"))
    above = _handed_down(trunk, trunk[-1].select("g", F.lit("").alias("subroot"), F.col("digest").alias("root"), _no_path()))
    above = above.select(F.col("held.of").alias("g"), F.col("digest").alias("subroot"), "root", "path")
    return _handed_down(rounds, above).select("held.*", F.col("digest").alias("leaf"), "subroot", "root", "path")


def _no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>").alias("path")


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add pos (from 0) and n, the place in the group g by ``order`` and the group's size."""
    placed = stored(nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn(
        "at", F.monotonically_increasing_id()), "placed").withColumn("task", F.shiftright("at", 33))
    starts = placed.groupBy("g", "task").agg(F.count("*").alias("rows"), F.min("at").alias("least"))
    tasks = Window.partitionBy("g")  # a row per task
    before = tasks.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("g", "task", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("least")).alias("shift"),
                           F.sum("rows").over(tasks).alias("n"))
    return placed.join(starts, ["g", "task"]).withColumn("pos", F.col("at") + F.col("shift"))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of each round; a group's last round has one block."""
    rounds, most = [], None
    while True:
        blocks = _blocks(nodes)
        rounds.append(blocks)
        most = blocks.agg(F.max("n")).first()[0]
        if (most or 0) <= BLOCK:
            return rounds
        nodes = blocks.where(F.col("n") > BLOCK).select(
            "g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), "digest", F.lit(None).cast("string").alias("held"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, block, n, nodes, level0, …, digest): a row per 512 consecutive nodes, with the hex text of each level."""
    blocks = nodes.groupBy("g", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest", "held"))).alias("nodes"))
    blocks = blocks.withColumn("level0", F.array_join("nodes.digest", "").cast("binary"))
    for k in range(LEVELS):
        blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("n") > FAN ** k, _parents(F.col(f"level{k}"))))
    digest = F.coalesce(*[F.col(f"level{k}") for k in range(LEVELS, -1, -1)]).cast("string")
    return stored(blocks.withColumn("digest", digest), "blocks")


def _parents(level: Column) -> Column:
    width = FAN * HEX
    last = F.floor((F.length(level) - 1) / width).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256))
    return F.array_join(pieces, "").cast("binary")


def _beside(own: Column, k: int) -> Column:
    """What stands left and right of a node's ancestor of level ``k`` in its run."""
    at = F.shiftright(own, 3 * k)
    place = at.bitwiseAND(FAN - 1)
    level = F.col(f"level{k}")
    left = F.substring(level, (at - place) * HEX + 1, place * HEX)
    right = F.substring(level, (at + 1) * HEX + 1, (FAN - 1 - place) * HEX)
    return F.when(F.col("n") > FAN ** k, F.struct(left.cast("string").alias("left"), right.cast("string").alias("right")))


def _handed_down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first round (g, digest, held) with subroot, root and path; ``above`` has them for each group."""
    for k in range(len(rounds) - 1, -1, -1):
        blocks = rounds[k].withColumnRenamed("digest", "own")
        here = blocks.where(F.col("n") <= BLOCK).join(above, "g")
        if k + 1 < len(rounds):
            here = here.unionByName(blocks.where(F.col("n") > BLOCK).join(given, ["g", "block"]))
        beside = lambda x: F.filter(F.array(*[_beside((x["pos"] % BLOCK).cast("int"), i) for i in range(LEVELS)]), lambda s: s.isNotNull())
        each = F.transform("nodes", lambda x: F.struct(x["pos"].alias("pos"), x["digest"].alias("digest"), x["held"].alias("held"), beside(x).alias("beside")))
        nodes = here.select("g", "subroot", "root", F.col("path").alias("rest"), F.explode(each).alias("x"))
        nodes = nodes.select("g", "subroot", "root", "x.pos", "x.digest", "x.held", F.concat("x.beside", "rest").alias("path"))
        given = nodes.select("g", F.col("pos").alias("block"), "subroot", "root", "path")
    return nodes
