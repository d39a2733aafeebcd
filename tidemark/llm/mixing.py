"""Mixing sources to target weights: budgets down a tree of groups, then seeded prefixes of the leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import stored

KEY_BITS = 60
BUCKET_ROWS = 1000
BROADCAST_LEAVES = 100_000
BIG = "decimal(38,0)"


def estimated_tokens() -> Column:
    """A token for each four bytes begun; null texts have none."""
    return F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long")


def epoch_key(epoch: Column, seed: int) -> Column:
    """The place of a row in an epoch's order: 60 bits of md5 over seed, epoch and doc_id."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(int(weight))).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int) -> DataFrame:
    """Add ``share``, the tokens each leaf is to give, to ``leaves`` (the level columns and capacity).

    From the root down, a node's budget goes to its children by weight. A child that holds less
    than its part gives all it holds, and its siblings take over the rest by weight; only what no sibling
    can hold was left to the ancestors' siblings, because a node never gets more than all
    below it hold. All in whole numbers: parts are rounded down, a weight of 0 gets nothing.
    """
    paths = [levels[:k] for k in range(len(levels) + 1)]
    for depth, level in enumerate(levels):
        leaves = leaves.withColumn(f"_w{depth}", _weight(level, weights))
    usable = " AND ".join(f"_w{d} > 0" for d in range(len(levels)))
    leaves = leaves.withColumn("_able", F.when(F.expr(usable), F.col("capacity")).otherwise(0).cast(BIG))
    above = None
    for depth, level in enumerate(levels):
        nodes = leaves.groupBy(*paths[depth + 1], f"_w{depth}").agg(F.sum("_able").alias("able"))
        if above is None:
            nodes = nodes.withColumn("given", F.least(F.sum("able").over(Window.partitionBy()), F.lit(int(budget)).cast(BIG)))
        else:
            nodes = nodes.join(above, paths[depth])
        nodes = nodes.withColumn("w", F.col(f"_w{depth}").cast(BIG))
        parent = Window.partitionBy(*paths[depth])
        order = parent.orderBy(F.when(F.col("w") > 0, F.col("able").cast("double") / F.col("w").cast("double")).otherwise(F.lit(float("inf"))), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.withColumn("_filled", F.coalesce(F.sum("able").over(before), F.lit(0)).cast(BIG)).withColumn(
            "_open", F.sum("w").over(rest).cast(BIG))
        full = (F.col("w") > 0) & (F.col("able") * F.col("_open") <= F.col("w") * (F.col("given") - F.col("_filled")))
        nodes = nodes.withColumn("_full", full)
        held = F.sum(F.when(F.col("_full"), F.col("able")).otherwise(0)).over(parent).cast(BIG)
        weight = F.sum(F.when(~F.col("_full"), F.col("w")).otherwise(0)).over(parent).cast(BIG)
        nodes = nodes.withColumn("_held", held).withColumn("_weight", weight)
        part = F.when(F.col("_full"), F.col("able")).when(
            (F.col("w") > 0) & (F.col("_weight") > 0), F.floor(F.col("w") * (F.col("given") - F.col("_held")) / F.col("_weight"))).otherwise(0)
        above = nodes.select(*paths[depth + 1], part.cast(BIG).alias("given"))
    return leaves.drop("_able", *[f"_w{d}" for d in range(len(levels))]).join(
        above.withColumnRenamed("given", "share"), levels).withColumn("share", F.col("share").cast("long"))


def mixing_plan(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], percent: int, most_epochs: int, seed: int,
                tokens: Column | None = None) -> DataFrame:
    """A row per leaf: levels, whole (epochs taken whole), last_key (keys up to it are taken of the next epoch; -1: none).

    A leaf's share is met epoch by epoch; every epoch has its own seeded order, and of the last one the longest
    prefix is taken whose tokens fit. Rows with one key are taken together. The prefix is found on sums
    of buckets of keys, so that a large leaf is not ordered in one place: one scan of slim columns, sums per bucket, and a
    window over the bucket in which the budget ends.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]
    tokens = estimated_tokens() if tokens is None else tokens
    slim = stored(docs.select(F.col("doc_id"), *names, tokens.alias("tokens")), "mix-rows")
    leaves = slim.groupBy(*levels).agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"))
    leaves = stored(leaves.withColumn("capacity", F.col("tokens") * most_epochs), "mix-leaves")
    total = leaves.agg(F.sum("tokens").alias("t")).first().t or 0
    shares = leaf_budgets(leaves, levels, weights, int(total) * percent // 100)
    plan = shares.where("tokens > 0").selectExpr(*levels, "`rows`", "share div tokens as whole", "share % tokens as remainder")
    bits = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.col("rows") / BUCKET_ROWS)))).cast("int")
    plan = stored(plan.withColumn("bits", bits), "mix-plan")
    keyed = slim.join(_small(plan), levels).where(f"whole < {most_epochs}").withColumn("key", epoch_key(F.col("whole") + 1, seed)).withColumn(
        "bucket", F.expr(f"shiftright(key, {KEY_BITS} - bits)"))
    sums = keyed.groupBy(*levels, "bucket").agg(F.sum("tokens").alias("t"), F.first("remainder").alias("remainder"))
    running = Window.partitionBy(*levels).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("t").over(running))
    ends = stored(sums.where("upto > remainder").groupBy(*levels).agg(
        F.min("bucket").alias("end"), F.min_by(F.col("upto") - F.col("t"), "bucket").alias("before")), "mix-ends")
    inside = keyed.join(_small(ends), levels).where("bucket = end")
    in_bucket = Window.partitionBy(*levels).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(in_bucket))
    last = inside.where("upto <= remainder").groupBy(*levels).agg(F.max("key").alias("inner"))
    edge = ends.join(plan.select(*levels, "bits"), levels).select(
        *levels, F.expr(f"shiftleft(cast(end as bigint), {KEY_BITS} - bits) - 1").alias("edge"))
    out = plan.join(edge, levels, "left").join(last, levels, "left").select(
        *levels, "whole", F.coalesce(F.greatest("edge", "inner"), F.when(F.col("whole") < most_epochs, F.lit((1 << KEY_BITS) - 1)).otherwise(F.lit(-1))).alias("last_key"))
    return stored(out, "mix")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_LEAVES else df


def mix_sources(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], percent: int = 60, most_epochs: int = 2, seed: int = 17,
                tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that make up a mix, one for each epoch in which a row is taken (long column ``epoch``, from 1).

    ``docs`` has doc_id, text and the columns named in ``levels`` (root to leaf, for example domain,
    lang, source); all columns are kept, an ``epoch`` is replaced. ``weights``: for each level whole
    numbers per value, 1 where none is given. The mix is to have ``percent`` of all tokens
    (``tokens``, by default ``estimated_tokens``); a row is taken ``most_epochs`` times at most. Null
    level values are the group '' and null texts have no tokens; leaves without tokens give
    nothing. Rows that share a doc_id are taken together. An empty table gives an empty table.
    Texts are never shuffled: a row is kept by its own key and its leaf's last one.
    """
    plan = mixing_plan(docs, levels, weights, percent, most_epochs, seed, tokens).select(
        *[F.col(c).alias(f"_leaf_{c}") for c in levels], F.col("whole").alias("_whole"), F.col("last_key").alias("_last"))
    names = [c for c in docs.columns if c != "epoch"]
    own = [F.coalesce(docs[c].cast("string"), F.lit("")) == F.col(f"_leaf_{c}") for c in levels]
    condition = own[0]
    for c in own[1:]:
        condition = condition & c
    next_epoch = F.col("_whole") + 1
    taken = F.when(epoch_key(next_epoch, seed) <= F.col("_last"), next_epoch).otherwise(F.col("_whole"))
    out = docs.select(*names).join(_small(plan), condition).withColumn("_taken", taken).where("_taken > 0")
    return out.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_taken").cast("long"))).alias("epoch"))
