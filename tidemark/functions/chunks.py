"""Scans and as-of joins over keys whose history does not fit one task.

A range shuffle on (key, time) cuts the rows into parts; a part holds a stretch of the history of one key, or several short
histories. Inside a part plain windows do the work, and one small row per (key, part) carries it over the
borders, so a key that holds most of the rows is as many tasks as it is parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.session import store_intermediate

PART = "_part"
FIRST = Window.unboundedPreceding


def cut_in_parts(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``df`` with the number of its part, stored as a table. Parts are ranges of (key, order); rows equal in both are dealt out by a hash."""
    hashed = [c for c, kind in df.dtypes if not kind.startswith("map")]
    return store_intermediate(df.repartitionByRange(*key, *order, F.xxhash64(*hashed)).withColumn(PART, F.spark_partition_id()), "parts")


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` of ``column`` (a name) over the rows of a key so far, the row itself included.

    Kinds: sum, count, product, max, min and last (each over the values that are set), previous (the value of the row
    before, set or not) and linear, the recurrence y = ``factor`` * y' + ``column`` from 0, where ``factor`` is a column or a number;
    a null column or factor takes no step.
    """

    kind: str
    column: str
    factor: str | float = 1.0


def scan(parts: DataFrame, key: list[str], order: list[str], scans: dict[str, Scan]) -> DataFrame:
    """Add the running values ``scans`` (name -> what) to ``parts``, a table from :func:`cut_in_parts`; the result is one too.

    Associative scans in two levels: inside (key, part), then over one summary row per (key, part). ``order`` should
    be unique within a key; rows that tie come in any order, the same one for all scans of a call.
    """
    inside = Window.partitionBy(*key, PART).orderBy(*order)
    so_far = inside.rowsBetween(FIRST, 0)
    linear = {out: s for out, s in scans.items() if s.kind == "linear"}
    local = parts
    if linear:
        local = _recurrences(local, key, order, linear)
    local = local.withColumn("_at", F.row_number().over(inside))
    local = local.withColumns({f"_own_{out}": _inside(s, inside, so_far) for out, s in scans.items() if s.kind != "linear"})
    local = store_intermediate(local, "scan")
    ends = []
    for out, s in scans.items():
        if s.kind == "linear":
            ends += [F.max_by(f"_a_{out}", "_at").alias(f"_a_{out}"), F.max_by(f"_b_{out}", "_at").alias(f"_b_{out}")]
        elif s.kind == "previous":
            ends.append(F.max_by(F.struct(s.column), "_at").alias(f"_end_{out}"))
        else:
            ends.append(F.max_by(f"_own_{out}", "_at").alias(f"_end_{out}"))
    ends = local.groupBy(*key, PART).agg(*ends)
    earlier = Window.partitionBy(*key).orderBy(PART).rowsBetween(FIRST, -1)  # a row per part of a key
    carried = {f"_in_{out}": _before(s, F.col(f"_end_{out}"), earlier) for out, s in scans.items() if s.kind != "linear"}
    ends = ends.withColumns(carried) if carried else ends
    if linear:
        ends = ends.withColumns({f"_in_{out}": _carried_in(out, earlier) for out in linear})
    names = [f"_in_{out}" for out in scans]
    joined = local.join(ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col(PART).alias("_p"), *names),
                        _same(key) & (F.col(PART) == F.col("_p")), "left")
    kept = [c for c in parts.columns if c not in scans]
    return joined.select(*kept, *[_joined(out, s).alias(out) for out, s in scans.items()])


def _same(key: list[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(key):
        out = out & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return out


def _inside(s: Scan, inside: WindowSpec, so_far: WindowSpec) -> Column:
    x = F.col(s.column)
    plain = {"sum": F.sum, "count": F.count, "product": F.product, "max": F.max, "min": F.min}
    if s.kind in plain:
        return plain[s.kind](x).over(so_far)
    if s.kind == "last":
        return F.last(x, ignorenulls=True).over(so_far)
    if s.kind == "previous":
        return F.lag(F.struct(x)).over(inside)  # a struct: the row before may hold null
    raise ValueError(f"unknown kind of scan: {s.kind}")


def _before(s: Scan, end: Column, earlier: WindowSpec) -> Column:
    fold = {"sum": F.sum, "count": F.sum, "product": F.product, "max": F.max, "min": F.min}
    return fold[s.kind](end).over(earlier) if s.kind in fold else F.last(end, ignorenulls=True).over(earlier)


def _joined(out: str, s: Scan) -> Column:
    own, before = F.col(f"_own_{out}"), F.col(f"_in_{out}")
    if s.kind == "linear":
        return F.col(f"_a_{out}") * F.coalesce(before, F.lit(0.0)) + F.col(f"_b_{out}")
    if s.kind in ("sum", "product"):
        both = own + before if s.kind == "sum" else own * before
        return F.coalesce(both, own, before)
    if s.kind == "count":
        return own + F.coalesce(before, F.lit(0))
    if s.kind in ("max", "min"):
        return F.greatest(own, before) if s.kind == "max" else F.least(own, before)
    if s.kind == "last":
        return F.coalesce(own, before)
    return F.coalesce(own, before)[s.column]


def _carried_in(out: str, earlier: WindowSpec) -> Column:
    """The recurrence at the end of the parts before: their (a, b) one after another."""
    steps = F.collect_list(F.struct(F.col(f"_a_{out}").alias("a"), F.col(f"_b_{out}").alias("b"))).over(earlier)
    return F.aggregate(steps, F.lit(0.0), lambda y, s: s["a"] * y + s["b"])


def _recurrences(parts: DataFrame, key: list[str], order: list[str], linear: dict[str, Scan]) -> DataFrame:
    """Add _a_ and _b_ of each recurrence: its value in a part is a * (value before the part) + b."""
    inputs = {}
    for out, s in linear.items():
        inputs[f"_x_{out}"] = F.col(s.column).cast("double")
        inputs[f"_f_{out}"] = (F.col(s.factor) if isinstance(s.factor, str) else F.lit(s.factor)).cast("double")
    ready = parts.withColumns(inputs).withColumn("_at", F.row_number().over(Window.partitionBy(*key, PART).orderBy(*order)))
    fields = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes) + "".join(f", _a_{o} double, _b_{o} double" for o in linear)
    names = parts.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        columns = {c: table[c] for c in names}
        for out in linear:
            x, f = np.asarray(table[f"_x_{out}"].to_numpy()), np.asarray(table[f"_f_{out}"].to_numpy())
            known = np.asarray(table[f"_x_{out}"].is_valid()) & np.asarray(table[f"_f_{out}"].is_valid())
            a, b, a_all, b_all = 1.0, 0.0, [], []
            for ok, factor, value in zip(known.tolist(), f.tolist(), x.tolist()):
                if ok:
                    a, b = factor * a, factor * b + value
                a_all.append(a)
                b_all.append(b)
            columns[f"_a_{out}"], columns[f"_b_{out}"] = pa.array(a_all, pa.float64()), pa.array(b_all, pa.float64())
        return pa.table(columns)

    return ready.groupBy(*key, PART).applyInArrow(run, fields)


def long_rsi(df: DataFrame, key: list[str], order: list[str], price: str, n: int = 14) -> DataFrame:
    """``rsi_n`` as :func:`tidemark.operators.features.add_rsi` has it, for keys with any number of rows."""
    parts = scan(cut_in_parts(df, key, order), key, order, {"_prior": Scan("previous", price)})
    move = F.col(price) - F.col("_prior")
    parts = parts.withColumns({"_up_move": F.greatest(move, F.lit(0.0)), "_down_move": F.greatest(-move, F.lit(0.0)), "_move": move})
    known = F.col("_move").isNotNull()
    parts = parts.withColumn("_known", known.cast("int"))
    parts = scan(parts, key, order, {"_step": Scan("sum", "_known")})
    first = F.col("_step") == 1
    weight = F.when(known, F.when(first, F.lit(1.0)).otherwise(F.lit(1.0 / n)))
    parts = parts.withColumns({"_f": F.when(known, F.when(first, F.lit(0.0)).otherwise(F.lit(1.0 - 1.0 / n))),
                               "_u": weight * F.col("_up_move"), "_d": weight * F.col("_down_move")})
    parts = scan(parts, key, order, {"_up": Scan("linear", "_u", "_f"), "_down": Scan("linear", "_d", "_f")})
    rsi = F.lit(100.0) * F.try_divide(F.col("_up"), F.col("_up") + F.col("_down"))
    return parts.withColumn(f"rsi_{n}", F.coalesce(F.when(known, rsi), F.lit(50.0))).select(*[c for c in df.columns if c != f"rsi_{n}"], f"rsi_{n}")


def long_equity(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """equity (running product of 1 + return), its running peak and drawdown, for keys with any number of rows."""
    parts = cut_in_parts(df.withColumn("_growth", 1 + F.coalesce(F.col(value), F.lit(0.0))), key, order)
    parts = scan(parts, key, order, {"equity": Scan("product", "_growth")})
    parts = scan(parts, key, order, {"peak": Scan("max", "equity")})
    kept = [c for c in df.columns if c not in ("equity", "peak", "drawdown")]
    return parts.withColumn("drawdown", 1 - F.try_divide("equity", "peak")).select(*kept, "equity", "peak", "drawdown")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], direction: str = "backward",
              tolerance: Column | None = None, strict: bool = False, tiebreak: list[str] | None = None) -> DataFrame:
    """Add ``take`` of the nearest row of ``right`` to each row of ``left``: same ``by``, ``on`` not later (backward) or not earlier (forward).

    ``strict`` leaves out rows of equal ``on``. ``tolerance`` is the largest distance (an interval, or a number for numeric ``on``);
    beyond it, and without a match, ``take`` is null. Among right rows of one ``on`` the one that ``tiebreak`` (default: the taken columns) puts last counts. Rows of either side
    whose ``on`` or ``by`` is null match nothing. ``take`` must not stand in ``left`` but for names given there: those are replaced.

    Both sides go through one range shuffle on (by, on), each row of ``left`` then takes the last right row of its part before it, or the
    one that the parts before hand down.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, got {direction!r}")
    back = direction == "backward"
    kept = [c for c in left.columns if c not in take]
    usable = F.col(on).isNotNull()
    for c in by:
        usable = usable & F.col(c).isNotNull()
    ties = tiebreak or take
    one = right.where(usable).groupBy(*by, on).agg(F.max(F.struct(*ties, *[c for c in take if c not in ties])).alias("_best"))
    events = one.select(*by, on, F.lit(None).alias("_row"), F.struct(F.col(on).alias("_on"), *[F.col(f"_best.{c}").alias(c) for c in take]).alias("_event"))
    kind = events.schema["_event"].dataType
    rows = left.select(*by, on, F.struct(*kept).alias("_row"), F.lit(None).cast(kind).alias("_event"))
    events = events.withColumn("_row", F.col("_row").cast(rows.schema["_row"].dataType))
    # events of a time stand before its rows where equality counts, and behind them where it does not (forward: the other way round)
    first = strict != back
    side = F.when(F.col("_row").isNull(), F.lit(0 if first else 1)).otherwise(F.lit(1 if first else 0))
    axis = rows.where(usable).union(events).withColumn("_side", side)
    hashed = F.xxhash64(*by, on, "_side", "_row", "_event") if not _has_map(axis) else F.xxhash64(*by, on, "_side")
    axis = store_intermediate(axis.repartitionByRange(*by, on, "_side", hashed).withColumn(PART, F.spark_partition_id()), "axis")
    inside = Window.partitionBy(*by, PART).orderBy(on, "_side")
    frame = inside.rowsBetween(FIRST, 0) if back else inside.rowsBetween(0, Window.unboundedFollowing)
    near = (F.last if back else F.first)("_event", ignorenulls=True).over(frame)
    ends = axis.where(F.col("_event").isNotNull()).groupBy(*by, PART).agg((F.max_by if back else F.min_by)("_event", on).alias("_end"))
    parts = axis.select(*by, PART).distinct().join(ends, [*by, PART], "left")
    along = Window.partitionBy(*by).orderBy(PART)  # a row per part of a key
    other = (F.last("_end", ignorenulls=True).over(along.rowsBetween(FIRST, -1)) if back
             else F.first("_end", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)))
    handed = parts.select(*by, PART, other.alias("_handed")).where(F.col("_handed").isNotNull())
    met = axis.withColumn("_near", near).where(F.col("_row").isNotNull()).join(handed, [*by, PART], "left").select(
        "_row", F.coalesce("_near", "_handed").alias("_near"))
    fits = F.lit(True)
    if tolerance is not None:
        own = F.col(f"_row.{on}")
        fits = (F.col("_near._on") >= own - tolerance) if back else (F.col("_near._on") <= own + tolerance)
    joined = met.select("_row.*", *[F.when(fits, F.col(f"_near.{c}")).alias(c) for c in take])
    rest = left.where(~F.coalesce(usable, F.lit(False))).select(*kept, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take])
    return joined.unionByName(rest)


def _has_map(df: DataFrame) -> bool:
    return any("map<" in kind for _, kind in df.dtypes)
