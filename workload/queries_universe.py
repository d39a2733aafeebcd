"""Universe, listing history, plans, streaming twins and text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import chunks
from tidemark.functions.text import char_ngram_tf, cosine_of_pairs, strip_think
from tidemark.operators import coverage, listing, universe
from tidemark.operators.calendar import calendar
from tidemark.operators.similar import ngram_links
from tidemark.session import intermediate_folder, store_intermediate
from tidemark.streaming import bars as streaming
from tidemark.streaming import corrections
from workload.queries_bars import d
from workload.oracle_views import VIEWS
from workload.registry import query
from workload.tables import Tables

# -- universes -----------------------------------------------------------------


@query("universe_code_first_n", f"""
SELECT date, instrument, {d('close')} FROM v_bars
WHERE instrument IN (SELECT DISTINCT instrument FROM v_bars ORDER BY instrument LIMIT 20)""")
def universe_code_first_n(t: Tables) -> DataFrame:
    return universe.UniverseSpec.code_first_n(20).slice(t.bars).select("date", "instrument", "close")


PIT = """
WITH grid AS (SELECT i.instrument, c.date, c.di FROM (SELECT DISTINCT instrument FROM v_panel) i, v_cal c),
cells AS (SELECT g.*, coalesce(p.close > 0 AND p.volume > 0, false) AS tradable,
    CASE WHEN p.close > 0 AND p.volume > 0 THEN p.close * p.volume END AS amount
  FROM grid g LEFT JOIN v_panel p USING (instrument, date)),
means AS (SELECT *, avg(amount) OVER (PARTITION BY instrument ORDER BY di ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS m,
    sum(CAST(tradable AS INT)) OVER (PARTITION BY instrument ORDER BY di) AS listed FROM cells),
ranked AS (SELECT *, rank() OVER (PARTITION BY di ORDER BY m DESC) + (count(*) OVER (PARTITION BY di, m) - 1) / 2.0 AS rk
  FROM means WHERE m IS NOT NULL),
pit AS (SELECT date, di, instrument, rk FROM ranked WHERE rk <= 30 AND listed >= 20 AND tradable)"""
VIEWS["v_pit"] = PIT + " SELECT date, instrument FROM pit"


@query("pit_eligibility", PIT + " SELECT date, di, instrument, round(rk, 6) + 0.0 AS liquidity_rank FROM pit")
def pit_eligibility(t: Tables) -> DataFrame:
    return universe.pit_eligibility(t.stored_panel, 30, 12, 20)


@query("pit_universe_sizes", PIT + """,
sizes AS (SELECT c.di, count(p.di) AS n FROM v_cal c LEFT JOIN pit p USING (di) WHERE (c.di - 1) % 4 = 0 GROUP BY c.di)
SELECT min(n) AS size_min, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS size_median, max(n) AS size_max FROM sizes""")
def pit_universe_sizes(t: Tables) -> DataFrame:
    eligible = universe.pit_eligibility(t.stored_panel, 30, 12, 20)
    return universe.universe_sizes(eligible, t.calendar, 4)


@query("top_liquid", f"""
WITH m AS (SELECT reverse(symbol) AS symbol, name, avg(turnover_twd) AS a, count(DISTINCT date) AS n FROM v_quotes
  WHERE close >= 95 AND volume_shares > 0 AND reverse(symbol) NOT LIKE '00%' GROUP BY 1, 2)
SELECT CAST(row_number() OVER (ORDER BY a DESC, symbol) - 1 AS INTEGER) AS rank, symbol, name, round(a, 4) + 0.0 AS avg_turnover_twd,
       n AS sampled_days FROM m ORDER BY a DESC, symbol LIMIT 50""")
def top_liquid(t: Tables) -> DataFrame:
    """Codes are read backwards, so that some of them have the fund prefix and most have not."""
    quotes = t.quotes.withColumnRenamed("date", "source_date").withColumn("symbol", F.reverse("symbol"))
    top = universe.top_liquid(quotes, n=50, min_price=95.0)
    return top.withColumn("avg_turnover_twd", F.round("avg_turnover_twd", 4))


@query("market_counts", "SELECT market, count(*) AS n FROM v_instruments GROUP BY market")
def market_counts(t: Tables) -> DataFrame:
    return universe.market_counts(t.instruments)


# -- listing history -------------------------------------------------------------

SPELLS = """
WITH o AS ({rows}),
s AS (SELECT *, sum(CAST(coalesce(brk, false) AS INT)) OVER (PARTITION BY symbol ORDER BY seen_date) AS seg FROM o)
SELECT symbol, arg_max(name, seen_date) AS name, min(seen_date) AS first_seen, max(seen_date) AS last_seen, count(*) AS n_days
FROM s GROUP BY symbol, seg"""
BY_GAP = SPELLS.format(rows="""SELECT *, seen_date - lag(seen_date) OVER (PARTITION BY symbol ORDER BY seen_date) > 60 AS brk
  FROM v_seen""")
ASOF = """SELECT s.symbol, s.name, s.seen_date, max(e.delist_date) AS event_date FROM v_seen s
  LEFT JOIN v_delist e ON e.symbol = s.symbol AND e.delist_date <= s.seen_date GROUP BY 1, 2, 3"""
BY_EVENT = SPELLS.format(rows=f"""SELECT *, event_date IS DISTINCT FROM lag(event_date) OVER k AND lag(seen_date) OVER k IS NOT NULL AS brk
  FROM ({ASOF}) WINDOW k AS (PARTITION BY symbol ORDER BY seen_date)""")
ACTIVE = "SELECT symbol FROM v_instruments, v_horizon WHERE snapshot_date >= d + 3"
CANDIDATES = f"""SELECT symbol, name, first_seen, last_seen, n_days FROM ({BY_EVENT}), v_horizon
  WHERE last_seen < d - 90 AND symbol NOT IN ({ACTIVE})"""


@query("asof_delisting", ASOF)
def asof_delisting(t: Tables) -> DataFrame:
    return listing.latest_event_asof(t.seen, t.delistings).select("symbol", "name", "seen_date", "event_date")


@query("listing_intervals", BY_GAP)
def listing_intervals(t: Tables) -> DataFrame:
    return listing.listing_intervals(t.seen, gap_days=60)


@query("listing_intervals_events", BY_EVENT)
def listing_intervals_events(t: Tables) -> DataFrame:
    return listing.listing_intervals(t.seen, delistings=t.delistings)


@query("active_symbols", ACTIVE)
def active_symbols(t: Tables) -> DataFrame:
    return listing.active_symbols(t.instruments, F.date_add(t.horizon, 5), within_days=2)


@query("delisted_candidates", CANDIDATES)
def delisted_candidates(t: Tables) -> DataFrame:
    active = listing.active_symbols(t.instruments, F.date_add(t.horizon, 5), within_days=2)
    intervals = listing.listing_intervals(t.seen, delistings=t.delistings)
    return listing.delisted_candidates(intervals, t.horizon, active)


@query("merge_delisted", f"""
SELECT symbol, name, delist_date, 'twse_terminated' AS source FROM v_delist WHERE symbol NOT IN ({ACTIVE})
UNION ALL
SELECT DISTINCT symbol, name, CAST(NULL AS DATE), 'mi_index_sampling' FROM ({BY_GAP}), v_horizon
WHERE last_seen < d - 30 AND symbol NOT IN ({ACTIVE}) AND symbol NOT IN (SELECT symbol FROM v_delist)""")
def merge_delisted(t: Tables) -> DataFrame:
    active = listing.active_symbols(t.instruments, F.date_add(t.horizon, 5), within_days=2)
    sampled = listing.delisted_candidates(listing.listing_intervals(t.seen, gap_days=60), t.horizon, active, 30)
    return listing.merge_delisted(t.delistings, sampled, active)


SPANS = "SELECT symbol, min(date) AS a, max(date) AS b FROM v_bars GROUP BY symbol"
SEGMENTS = """SELECT symbol, CAST(y AS INTEGER) AS year, greatest(a, make_date(y, 1, 1)) AS seg_start, least(b, make_date(y, 12, 31)) AS seg_end
  FROM (SELECT *, unnest(range(year(a), year(b) + 1)) AS y FROM ({0}) WHERE a <= b)"""


def _spans(t: Tables) -> DataFrame:
    return t.bars.groupBy("symbol").agg(F.min("date").alias("start"), F.max("date").alias("end"))


@query("year_segments", SEGMENTS.format(SPANS))
def year_segments(t: Tables) -> DataFrame:
    return listing.year_segments(_spans(t)).select("symbol", "year", "seg_start", "seg_end")


@query("month_plan", f"""
SELECT symbol, CAST(m AS DATE) AS month, greatest(a, CAST(m AS DATE)) AS probe_start, least(b, last_day(m)) AS probe_end
FROM (SELECT *, unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM ({SPANS}))""")
def month_plan(t: Tables) -> DataFrame:
    return listing.month_plan(_spans(t)).select("symbol", "month", "probe_start", "probe_end")


@query("monthly_sample", """
SELECT m.month, min(CASE WHEN c.date < m.month + 12 THEN c.date END) AS sample_date
FROM (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month FROM v_cal) m
LEFT JOIN v_cal c ON date_trunc('month', c.date) = m.month GROUP BY m.month""")
def monthly_sample(t: Tables) -> DataFrame:
    span = t.calendar.agg(F.min(F.trunc("date", "month")).alias("start"), F.max("date").alias("end"))
    return listing.monthly_sample_dates(t.calendar, listing.month_plan(span))


@query("sample_history", "SELECT symbol, name, seen_date FROM v_seen")
def sample_history(t: Tables) -> DataFrame:
    return t.seen


PLAN = """SELECT w."table", s.symbol, s.year, s.seg_start, s.seg_end
FROM ({segments}) s, (SELECT unnest(['daily', 'institutional']) AS "table") w
WHERE NOT EXISTS (SELECT 1 FROM ({have}) h WHERE h."table" = w."table" AND h.symbol = s.symbol AND h.year = s.year)"""
HAVE = """SELECT 'daily' AS "table", symbol, year(date) AS year FROM v_second WHERE trade_count >= 5
  UNION ALL SELECT 'institutional', symbol, year(date) FROM v_inst WHERE foreign_buy >= 100000"""


def _stored_years(t: Tables) -> DataFrame:
    daily = listing.existing_years("daily", t.second_source.where(F.col("trade_count") >= 5))
    flows = listing.existing_years("institutional", t.institutional.where(F.col("foreign_buy") >= 100000))
    return daily.unionByName(flows)


@query("backfill_plan", PLAN.format(segments=SEGMENTS.format(SPANS), have=HAVE))
def backfill_plan(t: Tables) -> DataFrame:
    return listing.backfill_plan(_spans(t), ["daily", "institutional"], _stored_years(t))


@query("backfill_plan_delisted", PLAN.format(segments=SEGMENTS.format(f"""
SELECT s.symbol, s.a, least(s.b, e.delist_date) AS b FROM ({SPANS}) s JOIN v_delist e USING (symbol)
WHERE e.delist_date >= DATE '1998-01-01'"""), have=HAVE))
def backfill_plan_delisted(t: Tables) -> DataFrame:
    spans = listing.clip_at_delisting(_spans(t), t.delistings, start=F.to_date(F.lit("1998-01-01")))
    return listing.backfill_plan(spans, ["daily", "institutional"], _stored_years(t))


@query("calendar", "SELECT date, di FROM v_cal")
def trading_calendar(t: Tables) -> DataFrame:
    return calendar(t.bars)


# -- ticks ---------------------------------------------------------------------

def _bars_sql(unit: str) -> str:
    return f"""
SELECT symbol, {unit} AS date, {d('arg_min(price, timestamp)', 'open')}, {d('max(price)', 'high')},
       {d('min(price)', 'low')}, {d('arg_max(price, timestamp)', 'close')}, sum(size_shares)::BIGINT AS volume_shares,
       {d('sum(price * size_shares)', 'turnover_twd')}, count(*) AS trade_count FROM v_ticks GROUP BY 1, 2"""


@query("hourly_bars", _bars_sql("date_trunc('hour', timestamp)"))
def hourly_bars(t: Tables) -> DataFrame:
    return streaming.ticks_to_bars(t.ticks, "1 hour")


@query("tick_to_bars", _bars_sql("time_bucket(INTERVAL 5 MINUTE, timestamp)"))
def tick_to_bars(t: Tables) -> DataFrame:
    return streaming.ticks_to_bars(t.ticks, "5 minutes")


@query("revised_bars", _bars_sql("date_trunc('hour', timestamp)"))
def revised_bars(t: Tables) -> DataFrame:
    """The last revisions of a stream's hour bars: ticks in six deliveries in no order of time, the stream stopped half way and started again."""
    folder = f"{intermediate_folder(t.spark)}/revised-{uuid.uuid4().hex}"
    ticks = store_intermediate(t.ticks.select("symbol", "timestamp", "price", "size_shares", F.pmod(F.xxhash64("event_id"), F.lit(6)).alias("delivery")), "ticks")
    # State lies on disk: a store for every core is enough, and each costs some tenths of a second in every batch.
    settings = {"spark.sql.streaming.stateStore.providerClass": corrections.STATE_STORE,
                "spark.sql.shuffle.partitions": str(t.spark.sparkContext.defaultParallelism)}
    before = {key: t.spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        t.spark.conf.set(key, value)
    try:
        for half in (0, 1):
            for delivery in range(3 * half, 3 * half + 3):
                ticks.where(F.col("delivery") == delivery).drop("delivery").write.mode("append").parquet(f"{folder}/in")
            stream = t.spark.readStream.schema(ticks.drop("delivery").schema).parquet(f"{folder}/in")
            bars = corrections.correcting_bars(stream, "60 days").writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress")
            bars = bars.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={i}"))
            bars.trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            t.spark.conf.set(key, value)
    newest = corrections.newest_revisions(t.spark.read.parquet(f"{folder}/out").drop("batch"))
    return newest.where("level = 'hour'").drop("level", "revision")


@query("user_sessions", f"""
WITH o AS (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) >= INTERVAL 2 HOUR AS brk FROM v_ticks),
s AS (SELECT *, sum(CAST(coalesce(brk, false) AS INT)) OVER (PARTITION BY symbol ORDER BY timestamp) AS seg FROM o)
SELECT symbol, min(timestamp) AS session_start, max(timestamp) AS session_end, count(*) AS n, {d('sum(price)', 'total')}
FROM s GROUP BY symbol, seg""")
def user_sessions(t: Tables) -> DataFrame:
    return streaming.sessions(t.ticks, 2 * 3600)


# -- text ----------------------------------------------------------------------

THINK = """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<think>' || role || chr(10) || text || '</think>' || text ELSE text END AS text
  FROM conversations"""


@query("strip_think", f"""
SELECT conv_id, turn, regexp_replace(text, '<think>.*?</think>', '', 'gs') AS text FROM ({THINK})""")
def strip_reasoning(t: Tables) -> DataFrame:
    """Even turns get a reasoning block in front (the texts have none)."""
    block = F.concat(F.lit("<think>"), "role", F.lit("\n"), "text", F.lit("</think>"), "text")
    marked = t.raw("conversations").withColumn("text", F.when(F.col("turn") % 2 == 0, block).otherwise(F.col("text")))
    return marked.select("conv_id", "turn", strip_think(F.col("text")).alias("text"))


SQUEEZE = r"trim(regexp_replace(lower({0}), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


def _grams(source: str, key: str) -> str:
    return f"""SELECT {key}, bucket, count(*) AS tf FROM (
  SELECT {key}, CAST('0x' || right(md5(substring(s, unnest(range(1, length(s) - 1)), 3)), 2) AS INTEGER) AS bucket
  FROM (SELECT {key}, {SQUEEZE.format('text')} AS s FROM {source}) WHERE length(s) >= 3) GROUP BY ALL"""


@query("char_ngram_tf", f"""
WITH g AS ({_grams('documents', 'doc_id')})
SELECT doc_id, bucket, tf, {d('tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id))', 'weight')} FROM g""")
def ngram_vectors(t: Tables) -> DataFrame:
    return char_ngram_tf(t.raw("documents"), ["doc_id"], "text")


TURNS = "(SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS id, text FROM conversations)"


@query("ngram_similar_pairs", f"""
WITH g AS ({_grams(TURNS, 'id')}),
v AS (SELECT id, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM g),
p AS (SELECT a.conv_id, a.turn, CAST(a.conv_id AS VARCHAR) || '/' || CAST(a.turn AS VARCHAR) AS l,
    CAST(b.conv_id AS VARCHAR) || '/' || CAST(b.turn AS VARCHAR) AS r
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2),
c AS (SELECT p.conv_id, p.turn, coalesce(sum(x.w * y.w), 0.0) AS cosine FROM p LEFT JOIN v x ON x.id = p.l
  LEFT JOIN v y ON y.id = p.r AND y.bucket = x.bucket GROUP BY 1, 2)
SELECT conv_id, turn, {d('cosine')} FROM c WHERE cosine >= 0.75""")
def ngram_similar_pairs(t: Tables) -> DataFrame:
    """Each turn against the speaker's next turn in the same conversation."""
    turns = t.raw("conversations").select(
        "conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("id"),
        F.concat_ws("/", "conv_id", F.col("turn") + 2).alias("next_id"), "text",
    )
    pairs = turns.select("conv_id", "turn", "id", "next_id").join(
        turns.select(F.col("id").alias("next_id")), "next_id", "left_semi"
    )
    vectors = char_ngram_tf(turns, ["id"], "text")
    return cosine_of_pairs(pairs, vectors, "id", "next_id", "id").where(F.col("cosine") >= 0.75).select(
        "conv_id", "turn", "cosine"
    )


@query("ngram_near_pairs", f"""
WITH g AS ({_grams(TURNS, 'id')}),
s AS (SELECT id, sum(tf * tf)::DOUBLE AS sq FROM g GROUP BY id),
c AS (SELECT a.id AS l, b.id AS r, sum(a.tf * b.tf)::DOUBLE AS dot FROM g a JOIN g b ON a.bucket = b.bucket AND a.id < b.id GROUP BY ALL),
p AS (SELECT l, r, dot / sqrt(x.sq * y.sq) AS cosine FROM c JOIN s x ON x.id = l JOIN s y ON y.id = r WHERE dot / sqrt(x.sq * y.sq) >= 0.9),
e AS (SELECT l AS id, cosine FROM p UNION ALL SELECT r, cosine FROM p)
SELECT s.id, count(cosine) AS n_links, {d('max(cosine)', 'nearest')} FROM s LEFT JOIN e USING (id) GROUP BY s.id""")
def ngram_near_pairs(t: Tables) -> DataFrame:
    """Every turn against every other one: how many are close to it, and how close the closest is."""
    turns = t.raw("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    return ngram_links(turns, "id", "text", 0.9)[0]


@query("coverage_gaps", """
WITH s AS (SELECT symbol, min(date) AS a, max(date) AS b FROM v_bars GROUP BY symbol)
SELECT s.symbol, c.date FROM s JOIN v_cal c ON c.date BETWEEN a AND b WHERE NOT EXISTS (FROM v_bars x WHERE x.symbol = s.symbol AND x.date = c.date)""")
def coverage_gaps(t: Tables) -> DataFrame:
    """Days without a bar, from the bitmaps of three deliveries."""
    rows = t.bars.select("symbol", "date", F.pmod(F.xxhash64("symbol", "date"), F.lit(3)).alias("delivery"))
    parts = [store_intermediate(coverage.coverage(rows.where(F.col("delivery") == k), ["symbol"]), "coverage") for k in range(3)]
    return coverage.missing_days(coverage.merged_coverage(parts, ["symbol"]), ["symbol"], t.calendar.select("date"))


# -- long histories ------------------------------------------------------------

HOT_TICKS = """(SELECT CASE WHEN user_id % 2 = 0 THEN 'HOT' ELSE CAST(user_id AS VARCHAR) END AS symbol, ts AS timestamp, event_id, event_type,
  value AS price, ((event_id * 7919) % 201 - 100) / 100000.0 AS ret FROM events)"""


def hot_ticks(t: Tables) -> DataFrame:
    """Ticks of which one symbol has half."""
    return t.raw("events").select(
        F.when(F.col("user_id") % 2 == 0, "HOT").otherwise(F.col("user_id").cast("string")).alias("symbol"), F.col("ts").alias("timestamp"),
        "event_id", "event_type", F.col("value").alias("price"), ((F.col("event_id") * 7919 % 201 - 100) / F.lit(100000.0)).alias("ret"))


@query("long_rsi", f"""
WITH m AS (SELECT symbol, event_id, row_number() OVER o - 1 AS i, price - lag(price) OVER o AS m FROM {HOT_TICKS} WINDOW o AS (PARTITION BY symbol ORDER BY timestamp, event_id)),
s AS (SELECT *, (i - 1) // 500 AS b, (i - 1) % 500 AS pos, CASE WHEN i = 1 THEN 1.0 ELSE 1.0 / 14 END * pow(14.0 / 13, (i - 1) % 500) AS w FROM m WHERE i > 0),
own AS (SELECT *, sum(greatest(m, 0) * w) OVER k * pow(13.0 / 14, pos) AS u, sum(greatest(-m, 0) * w) OVER k * pow(13.0 / 14, pos) AS v
  FROM s WINDOW k AS (PARTITION BY symbol, b ORDER BY i)),
ends AS (SELECT symbol, b + 1 AS b, arg_max(u, pos) AS u0, arg_max(v, pos) AS v0 FROM own GROUP BY symbol, b),
y AS (SELECT symbol, event_id, u + coalesce(u0, 0) * pow(13.0 / 14, pos + 1) AS up, v + coalesce(v0, 0) * pow(13.0 / 14, pos + 1) AS down FROM own LEFT JOIN ends USING (symbol, b))
SELECT m.symbol, m.event_id, {d('CASE WHEN i = 0 OR up + down = 0 THEN 50.0 ELSE 100.0 * up / (up + down) END', 'rsi_14')}
FROM m LEFT JOIN y ON y.symbol = m.symbol AND y.event_id = m.event_id""")
def long_rsi(t: Tables) -> DataFrame:
    """Wilder's means by a recurrence in parts; a mean has forgotten what lies 500 ticks back, which the SQL leaves out."""
    return chunks.long_rsi(hot_ticks(t), ["symbol"], ["timestamp", "event_id"], "price").select("symbol", "event_id", "rsi_14")


@query("long_equity", f"""
SELECT symbol, event_id, {d('equity')}, {d('peak')}, {d('1 - equity / peak', 'drawdown')} FROM (
  SELECT symbol, event_id, timestamp, equity, max(equity) OVER (PARTITION BY symbol ORDER BY timestamp, event_id) AS peak FROM (
    SELECT *, product(1 + ret) OVER (PARTITION BY symbol ORDER BY timestamp, event_id) AS equity FROM {HOT_TICKS}))""")
def long_equity(t: Tables) -> DataFrame:
    return chunks.long_equity(hot_ticks(t), ["symbol"], ["timestamp", "event_id"], "ret").select("symbol", "event_id", "equity", "peak", "drawdown")


@query("asof_quotes", f"""
WITH q AS (SELECT symbol, timestamp, max(event_id) AS quote_id FROM {HOT_TICKS} WHERE event_type = 'view' GROUP BY ALL)
SELECT t.symbol, t.event_id, CASE WHEN q.timestamp >= t.timestamp - INTERVAL 6 HOURS THEN quote_id END AS quote_id
FROM {HOT_TICKS} t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.timestamp > q.timestamp WHERE event_type <> 'view'""")
def asof_quotes(t: Tables) -> DataFrame:
    """The last quote strictly before each tick, at most six hours old."""
    ticks = hot_ticks(t)
    quotes = ticks.where("event_type = 'view'").select("symbol", "timestamp", F.col("event_id").alias("quote_id"))
    trades = ticks.where("event_type <> 'view'").select("symbol", "timestamp", "event_id")
    joined = chunks.asof_join(trades, quotes, ["symbol"], "timestamp", ["quote_id"], tolerance=F.expr("INTERVAL 6 HOURS"), strict=True)
    return joined.select("symbol", "event_id", "quote_id")
