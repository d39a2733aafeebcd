"""Sources, store, quality, features and adjustment."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import adjust, changes, features, quality, reconcile
from tidemark.operators.export import dense_vectors
from tidemark.operators.paged import SortedPages
from tidemark.sources import exchange, lists, vendor
from tidemark.session import intermediate_folder, store_intermediate
from tidemark.sources.store import PanelStore, latest_rows, scan
from tidemark.sources.versions import VersionedTable
from workload.registry import query
from workload.tables import Tables


def d(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0 AS {name or expression}"


# -- scans and store ---------------------------------------------------------

@query("scan_filter", f"""
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS ship_date, {d('l_extendedprice')}
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-06-30'
  AND l_returnflag IN ('A', 'R')""")
def scan_filter(t: Tables) -> DataFrame:
    rows = scan(t.raw("lineitem"), ["A", "R"], F.lit("1996-01-01").cast("timestamp_ntz"),
                F.lit("1996-06-30").cast("timestamp_ntz"), date="l_shipdate", symbol="l_returnflag")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("ship_date"),
                       "l_extendedprice")


@query("upsert_latest", f"""
SELECT symbol, date, coalesce(s.market, b.market) AS market,
       round(coalesce(s.close, b.close), 6) + 0.0 AS close, coalesce(s.volume_shares, b.volume_shares) AS volume_shares
FROM v_bars b FULL OUTER JOIN v_second s USING (symbol, date)""")
def upsert_latest(t: Tables) -> DataFrame:
    merged = latest_rows([t.daily, t.second_source], ["symbol", "date"])
    return merged.select("symbol", "date", "market", "close", "volume_shares")


@query("reference_upsert", """
SELECT i.symbol, i.name, i.market, i.industry, CASE WHEN d.symbol IS NULL THEN i.status ELSE 'delisted' END AS status,
       d.delist_date, i.snapshot_date
FROM v_instruments i LEFT JOIN v_delist d USING (symbol)""")
def reference_upsert(t: Tables) -> DataFrame:
    update = t.instruments.drop("delist_date").join(t.delistings.select("symbol", "delist_date"), "symbol")
    update = update.withColumn("status", F.lit("delisted"))
    return latest_rows([t.instruments, update], ["symbol"]).drop("list_date")


@query("store_upsert_roundtrip", f"""
SELECT symbol, date, coalesce(s.market, b.market) AS market,
       round(coalesce(s.close, b.close), 6) + 0.0 AS close, coalesce(s.volume_shares, b.volume_shares) AS volume_shares
FROM v_bars b FULL OUTER JOIN v_second s USING (symbol, date)""")
def store_upsert_roundtrip(t: Tables) -> DataFrame:
    """Two upserts through the store's files, then a read."""
    store = PanelStore(t.spark, f"{intermediate_folder(t.spark)}/store-{uuid.uuid4().hex}")
    store.write("daily", t.daily)
    store.write("daily", t.second_source.select(*t.daily.columns))
    return store.read("daily").select("symbol", "date", "market", "close", "volume_shares")


@query("store_reference_roundtrip", """
SELECT i.symbol, i.name, i.market, i.industry, CASE WHEN d.symbol IS NULL THEN i.status ELSE 'delisted' END AS status,
       d.delist_date, i.snapshot_date
FROM v_instruments i LEFT JOIN v_delist d USING (symbol)""")
def store_reference_roundtrip(t: Tables) -> DataFrame:
    store = PanelStore(t.spark, f"{intermediate_folder(t.spark)}/store-{uuid.uuid4().hex}")
    store.write_reference("instrument", t.instruments, ["symbol"])
    update = t.instruments.drop("delist_date").join(t.delistings.select("symbol", "delist_date"), "symbol")
    store.write_reference("instrument", update.withColumn("status", F.lit("delisted")).select(*t.instruments.columns), ["symbol"])
    return store.read("instrument").drop("list_date")


BATCHES = 20
BATCH_OF = "(trade_count * 7 + month(date) + CAST(right(symbol, 2) AS INTEGER)) % 20"
#: A row comes in its own batch, and again, dearer by 1, in every fifth one after that.
DELIVERED = f"""SELECT symbol, date, close + (CAST({{upto}} AS INTEGER) - 1 - b) // 5 AS close, b + 5 * ((CAST({{upto}} AS INTEGER) - 1 - b) // 5) AS batch
FROM (SELECT *, {BATCH_OF} AS b FROM v_bars) WHERE b < {{upto}}"""


@query("store_versions", f"""
SELECT 'two back' AS state, symbol, date, round(close, 6) + 0.0 AS close, batch FROM ({DELIVERED.format(upto=BATCHES - 2)})
UNION ALL SELECT 'compacted', symbol, date, round(close, 6) + 0.0, batch FROM ({DELIVERED.format(upto=BATCHES)})""")
def store_versions(t: Tables) -> DataFrame:
    """Twenty deliveries, most rows in several of them; the state two versions back, and the newest after compaction."""
    rows = store_intermediate(t.bars.select("symbol", "date", "close", F.expr(BATCH_OF).alias("first")), "deliveries")
    table = VersionedTable(t.spark, f"{intermediate_folder(t.spark)}/versions-{uuid.uuid4().hex}", ["symbol", "date"], buckets=4)
    for batch in range(BATCHES):
        due = rows.where((F.col("first") <= batch) & ((batch - F.col("first")) % 5 == 0))
        table.upsert(due.select("symbol", "date", (F.col("close") + F.floor((batch - F.col("first")) / 5)).alias("close"), F.lit(batch).alias("batch")))
    newest = table.latest()
    table.compact()
    return table.read(newest - 2).withColumn("state", F.lit("two back")).unionByName(table.read().withColumn("state", F.lit("compacted")))


@query("sql_group_latest", f"""
SELECT market, symbol, max(date) AS last_date, {d('arg_max(close, date)', 'last_close')}, count(*) AS n
FROM v_bars GROUP BY market, symbol""")
def sql_group_latest(t: Tables) -> DataFrame:
    t.daily.createOrReplaceTempView("daily_bars")
    return t.spark.sql(
        "SELECT market, symbol, max(date) AS last_date, max_by(close, date) AS last_close, count(*) AS n "
        "FROM daily_bars GROUP BY market, symbol"
    )


@query("apply_changes", f"""
WITH first_bars AS (SELECT * FROM v_bars WHERE trade_count >= 2),
ops AS (
  SELECT symbol, date, 1 AS seq, 'insert' AS op, close FROM v_bars WHERE open <= close
  UNION ALL SELECT symbol, date, 2, 'replace', close + 1 FROM v_bars WHERE high > close
  UNION ALL SELECT symbol, date, 3, 'delete', NULL FROM v_bars WHERE low = close
  UNION ALL SELECT symbol, date, 4, 'replace', close + 2 FROM v_bars WHERE open > close
  UNION ALL SELECT symbol, date, 5, 'insert', close + 3 FROM v_bars WHERE open > 103
),
keys AS (SELECT b.symbol, b.date, s.close AS c0,
   max(CASE WHEN seq = 1 THEN o.close END) c1, max(CASE WHEN seq = 2 THEN o.close END) c2,
   bool_or(coalesce(seq = 3, false)) d3, max(CASE WHEN seq = 4 THEN o.close END) c4,
   max(CASE WHEN seq = 5 THEN o.close END) c5
  FROM v_bars b LEFT JOIN first_bars s USING (symbol, date) LEFT JOIN ops o USING (symbol, date)
  GROUP BY b.symbol, b.date, s.close),
s1 AS (SELECT *, coalesce(c0, c1) AS v1 FROM keys),
s2 AS (SELECT *, CASE WHEN v1 IS NOT NULL THEN coalesce(c2, v1) END AS v2 FROM s1),
s3 AS (SELECT *, CASE WHEN d3 THEN NULL ELSE v2 END AS v3 FROM s2),
s4 AS (SELECT *, CASE WHEN v3 IS NOT NULL THEN coalesce(c4, v3) END AS v4 FROM s3)
SELECT symbol, date, {d('coalesce(v4, c5)', 'close')} FROM s4 WHERE coalesce(v4, c5) IS NOT NULL""")
def apply_changes(t: Tables) -> DataFrame:
    state = t.bars.where(F.col("trade_count") >= 2).select("symbol", "date", "close")
    return changes.apply_changes(state, _change_log(t))


def _change_log(t: Tables) -> DataFrame:
    """Up to five ordered changes per bar, decided by its prices."""
    steps = [
        (1, "insert", F.col("open") <= F.col("close"), F.col("close")),
        (2, "replace", F.col("high") > F.col("close"), F.col("close") + 1),
        (3, "delete", F.col("low") == F.col("close"), F.lit(None).cast("double")),
        (4, "replace", F.col("open") > F.col("close"), F.col("close") + 2),
        (5, "insert", F.col("open") > 103, F.col("close") + 3),
    ]
    each = F.array_compact(F.array(*[
        F.when(holds, F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), value.alias("close")))
        for seq, op, holds, value in steps
    ]))
    return t.bars.select("symbol", "date", F.inline(each))


@query("change_status", """
WITH first_bars AS (SELECT * FROM v_bars WHERE trade_count >= 2),
ops AS (
  SELECT symbol, date, 1 AS seq, 'insert' AS op FROM v_bars WHERE open <= close
  UNION ALL SELECT symbol, date, 2, 'replace' FROM v_bars WHERE high > close
  UNION ALL SELECT symbol, date, 3, 'delete' FROM v_bars WHERE low = close
  UNION ALL SELECT symbol, date, 4, 'replace' FROM v_bars WHERE open > close
  UNION ALL SELECT symbol, date, 5, 'insert' FROM v_bars WHERE open > 103
),
before AS (
  SELECT o.*, coalesce((SELECT arg_max(p.op = 'insert', p.seq) FROM ops p
     WHERE p.symbol = o.symbol AND p.date = o.date AND p.seq < o.seq AND p.op <> 'replace'), s.symbol IS NOT NULL) AS e
  FROM ops o LEFT JOIN first_bars s USING (symbol, date))
SELECT op, CASE op WHEN 'insert' THEN CASE WHEN e THEN 409 ELSE 201 END
                   WHEN 'replace' THEN CASE WHEN e THEN 200 ELSE 404 END
                   ELSE CASE WHEN e THEN 204 ELSE 404 END END AS status, count(*) AS n
FROM before GROUP BY 1, 2""")
def change_status(t: Tables) -> DataFrame:
    state = t.bars.where(F.col("trade_count") >= 2).select("symbol", "date", "close")
    return changes.change_status(state, _change_log(t)).groupBy("op", "status").agg(F.count(F.lit(1)).alias("n"))


@query("bars_page", f"""
SELECT symbol, date, {d('close')}, volume_shares, (SELECT count(*) FROM v_bars WHERE date <= DATE '2000-12-31') AS total
FROM v_bars WHERE date <= DATE '2000-12-31' ORDER BY date DESC, symbol LIMIT 100 OFFSET 50""")
def bars_page(t: Tables) -> DataFrame:
    rows = changes.page(t.daily, limit=100, offset=50, end="2000-12-31")
    return rows.select("symbol", "date", "close", "volume_shares", "total")


@query("bars_page_by_key", f"""
SELECT symbol, date, {d('close')} FROM (SELECT * FROM v_bars ORDER BY date DESC, symbol LIMIT 200 OFFSET (SELECT count(*) // 2 FROM v_bars))""")
def bars_page_by_key(t: Tables) -> DataFrame:
    """The page in the middle of the table: found by its offset in the zone index, then the next one by the key of its last row."""
    pages = SortedPages.build(t.daily, f"{intermediate_folder(t.spark)}/pages-{uuid.uuid4().hex}", 32)
    first = pages.at(100, pages.total() // 2)
    last = first.orderBy("date", F.col("symbol").desc()).first()
    return first.union(pages.after((last.date, last.symbol), 100)).select("symbol", "date", "close")


# -- vendor payloads -----------------------------------------------------------

def _json(**fields) -> F.Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


@query("normalize_bars", f"""
SELECT symbol, market, date, {d('CASE WHEN open > 0 THEN open ELSE close END', 'open')}, {d('high')}, {d('low')},
       {d('close')}, volume_shares, {d('turnover_twd')}, trade_count, 'finmind' AS source
FROM v_dirty WHERE close > 0""")
def normalize_bars(t: Tables) -> DataFrame:
    """OTC rows come under the second set of field names, volumes in lots with separators."""
    lots = F.format_number(F.col("volume_shares") / 1000, 0)
    old = _json(stock_id=F.col("symbol"), date=F.col("date"), open=F.col("open"), max=F.col("high"),
                min=F.col("low"), close=F.col("close"), Trading_Volume=lots,
                Trading_money=F.col("turnover_twd"), Trading_tickets=F.col("trade_count"))
    new = _json(symbol=F.col("symbol"), trade_date=F.col("date"), open_price=F.col("open").cast("string"),
                high=F.col("high"), low=F.col("low"), close_price=F.col("close"), volume=lots,
                amount=F.col("turnover_twd").cast("decimal(20,2)"), trade_count=F.col("trade_count"))
    raw = t.dirty.select("market", F.when(F.col("market") == "OTC", new).otherwise(old).alias("payload"))
    return vendor.normalize_price_rows(raw, volume_unit="lots")


@query("normalize_instruments", """
SELECT s.symbol, s.name, CASE s.s_nationkey % 4 WHEN 0 THEN 'TSE' WHEN 1 THEN 'OTC' WHEN 2 THEN 'EMG' ELSE 'otc2' END AS market,
       n.n_name AS industry, CAST(NULL AS DATE) AS list_date, CAST(NULL AS DATE) AS delist_date, 'active' AS status,
       CASE WHEN s.s_acctbal < 0 THEN NULL ELSE i.snapshot_date END AS snapshot_date
FROM v_suppliers s JOIN v_instruments i USING (symbol) JOIN nation n ON n.n_nationkey = s.s_nationkey""")
def normalize_instruments(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("twse", "tpex", "emerging", "otc2")])
    rows = t.suppliers.join(t.instruments.select("symbol", "industry", "snapshot_date"), "symbol")
    payload = _json(
        industry_category=F.col("industry"), stock_id=F.col("symbol"), stock_name=F.col("name"),
        type=F.element_at(kinds, F.col("s_nationkey") % 4 + 1),
        date=F.when(F.col("s_acctbal") < 0, "None").otherwise(F.col("snapshot_date").cast("string")),
    )
    return vendor.normalize_instruments(rows.select(payload.alias("payload")))


@query("normalize_institutional", f"""
SELECT symbol, date, {d('foreign_buy')}, {d('foreign_sell')}, {d('investment_trust_buy')},
       {d('investment_trust_sell')}, {d('dealer_buy + investment_trust_buy', 'dealer_buy')}, {d('dealer_sell')},
       'finmind' AS source FROM v_inst""")
def normalize_institutional(t: Tables) -> DataFrame:
    payload = _json(
        stock_id=F.col("symbol"), date=F.col("date"),
        Foreign_Investor_buy=F.col("foreign_buy"), Foreign_Investor_sell=F.col("foreign_sell"),
        Investment_Trust_buy=F.col("investment_trust_buy"), Investment_Trust_sell=F.col("investment_trust_sell"),
        Dealer_self_buy=F.col("dealer_buy"), Dealer_Hedging_buy=F.col("investment_trust_buy"),
        Dealer_sell=F.when(F.col("dealer_sell") > 0, F.col("dealer_sell")),
    )
    return vendor.normalize_institutional(t.institutional.select(payload.alias("payload")))


@query("normalize_margin", f"""
SELECT symbol, date, {d('margin_balance')}, {d('margin_buy')}, {d('margin_sell')}, {d('short_balance')},
       {d('short_sell')}, {d('short_cover')}, 'finmind' AS source FROM v_margin""")
def normalize_margin(t: Tables) -> DataFrame:
    fields = {vendor_name: F.col(name) / 1000 for name, vendor_name in vendor.MARGIN_FIELDS.items()}
    payload = _json(stock_id=F.col("symbol"), date=F.col("date"), **fields)
    return vendor.normalize_margin(t.margin.select(payload.alias("payload")))


def _roc(separator: str) -> F.Column:
    parts = [F.lpad((F.year("date") - 1911).cast("string"), 3, "0"), F.date_format("date", "MM"), F.date_format("date", "dd")]
    return F.concat_ws(separator, *parts)


@query("month_tables", f"""
SELECT symbol, 'TSE' AS market, date, {d('open')}, {d('high')}, {d('low')}, {d('close')},
       volume_shares, {d('turnover_twd')}, trade_count, 'twse' AS source
FROM v_dirty WHERE NOT (month(date) = 2 AND market = 'OTC')""")
def month_tables(t: Tables) -> DataFrame:
    """One payload per symbol and month; February of OTC symbols is delivered with a bad status."""
    def text(name: str) -> F.Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("--"))

    cells = F.array(
        _roc("/"), F.format_number("volume_shares", 0), F.format_number("turnover_twd", 2),
        text("open"), text("high"), text("low"), text("close"), F.lit("0"), text("trade_count"),
    )
    rows = t.dirty.select("symbol", "market", F.trunc("date", "month").alias("m"), cells.alias("row"))
    months = rows.groupBy("symbol", "market", "m").agg(F.collect_list("row").alias("data"))
    bad = (F.month("m") == 2) & (F.col("market") == "OTC")
    payload = _json(
        stat=F.when(bad, "no data").otherwise("OK"),
        fields=F.array(*[F.lit(h) for h in exchange.MONTH_HEADER]), data=F.col("data"),
    )
    return exchange.normalize_month_tables(months.select("symbol", payload.alias("payload")))


def _snapshot_payload() -> F.Column:
    def text(name: str) -> F.Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("--"))

    return _json(
        Date=_roc(""), Code=F.col("symbol"), Name=F.col("symbol"), TradeVolume=F.format_number("volume_shares", 0),
        TradeValue=F.format_number("turnover_twd", 2), OpeningPrice=text("open"), HighestPrice=text("high"),
        LowestPrice=text("low"), ClosingPrice=text("close"), Change=F.lit("0"), Transaction=text("trade_count"),
    )


@query("snapshot_normalize", f"""
SELECT symbol, 'TSE' AS market, date, {d('open')}, {d('high')}, {d('low')}, {d('close')},
       volume_shares, {d('turnover_twd')}, trade_count, 'twse' AS source FROM v_dirty""")
def snapshot_normalize(t: Tables) -> DataFrame:
    return exchange.normalize_snapshot(t.dirty.select(_snapshot_payload().alias("payload")))


@query("snapshot_problems", """
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS missing_fields, count(*) FILTER (WHERE trade_count = 1) AS bad_dates,
       count(*) FILTER (WHERE open = high) AS bad_numbers,
       (SELECT count(*) - count(DISTINCT (symbol, CASE WHEN trade_count = 1 THEN DATE '1900-01-01' ELSE date END))
        FROM v_bars) AS duplicates
FROM v_bars""")
def snapshot_problems(t: Tables) -> DataFrame:
    """Week rows with a single trade get an unreadable date, rows that open at the high an unreadable price."""
    broken = t.bars.withColumn("payload", _snapshot_payload())
    broken = broken.withColumn("payload", F.when(
        F.col("trade_count") == 1, F.regexp_replace("payload", r'"Date":"\d+"', '"Date":"2024-01"')
    ).otherwise(F.col("payload")))
    broken = broken.withColumn("payload", F.when(
        F.col("open") == F.col("high"), F.regexp_replace("payload", r'"OpeningPrice":"', '"OpeningPrice":"x')
    ).otherwise(F.col("payload")))
    return exchange.snapshot_problems(broken.select("payload"))


@query("market_report", f"""
SELECT symbol, name, {d('close')}, volume_shares, {d('turnover_twd')}, strftime(date, '%Y-%m-%d') AS source_date
FROM v_quotes WHERE length(symbol) = 4""")
def market_report(t: Tables) -> DataFrame:
    """A week's report in parts of a thousand codes; the quote table is nested in odd years, at the top level in even ones."""
    row = F.array("symbol", "name", F.format_number("volume_shares", 0), F.format_number("turnover_twd", 2),
                  F.col("close").cast("string"))
    header = F.array(*[F.lit(h) for h in (exchange.CODE, exchange.NAME, exchange.VOLUME, exchange.TURNOVER, exchange.CLOSE)])
    part = F.floor(F.col("symbol").cast("long") / 1000)
    days = t.quotes.groupBy("date", part.alias("part")).agg(F.collect_list(row).alias("data"))
    other = F.struct(F.array(F.lit("x")).alias("fields"), F.array(F.array(F.lit("1"))).alias("data"))
    flat = _json(stat=F.lit("OK"), fields=header, data=F.col("data"))
    nested = _json(stat=F.lit("OK"), tables=F.array(other, F.struct(header.alias("fields"), F.col("data"))))
    payloads = days.select(
        F.col("date").cast("string").alias("iso_date"), "part",
        F.explode(F.array(
            F.struct(F.lit(1).alias("priority"), F.lit('{"stat":"no data"}').alias("payload")),
            F.struct(F.lit(2).alias("priority"), F.when(F.year("date") % 2 == 1, nested).otherwise(flat).alias("payload")),
        )).alias("r"),
    )
    return exchange.parse_market_reports(payloads.select("iso_date", "part", "r.*"))


@query("hourly_normalize", f"""
WITH h AS (SELECT symbol, date_trunc('hour', timestamp) AS date, arg_min(price, timestamp) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, timestamp) AS close, count(*) AS n FROM v_ticks GROUP BY 1, 2)
SELECT symbol, 'TSE' AS market, date, {d('open')}, {d('high')}, {d('low')}, {d('close')},
       CASE WHEN n = 1 THEN 0 ELSE n END AS volume_shares, CAST(NULL AS DOUBLE) AS turnover_twd,
       CAST(NULL AS BIGINT) AS trade_count, 'yfinance' AS source
FROM h WHERE NOT (n = 1 AND close < 5) AND NOT (n = 2 AND open < 5)""")
def hourly_normalize(t: Tables) -> DataFrame:
    """Hours with one cheap tick lose their close, hours with two and a cheap first tick open at zero."""
    hours = t.ticks.groupBy("symbol", F.window("timestamp", "1 hour").alias("w")).agg(
        F.min_by("price", "timestamp").alias("o"), F.max("price").alias("High"), F.min("price").alias("Low"),
        F.max_by("price", "timestamp").alias("c"), F.count(F.lit(1)).alias("n"),
    )
    nan = F.lit(float("nan"))
    raw = hours.select(
        "symbol", F.lit("TSE").alias("market"), F.col("w.start").alias("ts"), "High", "Low",
        F.when((F.col("n") == 2) & (F.col("o") < 5), 0.0).otherwise(F.col("o")).alias("Open"),
        F.when((F.col("n") == 1) & (F.col("c") < 5), nan).otherwise(F.col("c")).alias("Close"),
        F.when(F.col("n") == 1, nan).otherwise(F.col("n").cast("double")).alias("Volume"),
    )
    return vendor.normalize_hourly_history(raw)


@query("parse_delisted", "SELECT symbol, name, delist_date FROM v_delist")
def parse_delisted(t: Tables) -> DataFrame:
    """Official text lines, with and without the era prefix, among heading and blank lines."""
    era = F.when(F.col("name").endswith("1"), "").otherwise("民國")
    line = F.concat(
        F.lit('"'), era, (F.year("delist_date") - 1911).cast("string"), F.lit("年"),
        F.month("delist_date").cast("string"), F.lit("月"), F.dayofmonth("delist_date").cast("string"),
        F.lit('日","'), F.col("name"), F.lit('","'), F.col("symbol"), F.lit('"'),
    )
    texts = t.delistings.select(F.concat(F.lit("終止上市公司\n\n"), line, F.lit("\n說明\n")).alias("text"))
    return lists.parse_delisted_text(texts)


@query("dense_export", """
WITH days AS (SELECT count(*) AS n FROM v_cal),
cells AS (SELECT b.symbol, b.date, c.di, f.field, CAST(CAST(CASE f.field WHEN 'open' THEN b.open WHEN 'high' THEN b.high
    WHEN 'low' THEN b.low WHEN 'close' THEN b.close WHEN 'volume' THEN b.volume_shares ELSE round(b.turnover_twd) END
    AS FLOAT) AS BIGINT) AS v
  FROM v_bars b JOIN v_cal c USING (date), (SELECT unnest(['open', 'high', 'low', 'close', 'volume', 'turnover']) AS field) f),
grid AS (SELECT s.symbol, s.field, s.first_date, s.last_date, c.di
  FROM (SELECT symbol, field, min(date) AS first_date, max(date) AS last_date FROM cells GROUP BY 1, 2) s, v_cal c)
SELECT g.symbol, g.field, 0 AS start_index, g.first_date, g.last_date,
       string_agg(coalesce(CAST(v AS VARCHAR), 'nan'), ',' ORDER BY g.di) AS series
FROM grid g LEFT JOIN cells x ON x.symbol = g.symbol AND x.field = g.field AND x.di = g.di GROUP BY 1, 2, 3, 4, 5""")
def dense_export(t: Tables) -> DataFrame:
    vectors = dense_vectors(t.daily.withColumn("turnover_twd", F.round("turnover_twd")))
    text = F.transform("vector", lambda x: F.when(F.isnan(x), "nan").otherwise(x.cast("long").cast("string")))
    return vectors.withColumn("series", F.array_join(text, ",")).drop("vector")


# -- quality -------------------------------------------------------------------

ISSUE = "symbol, date, '{0}' AS check, {1} AS field, round(CAST({2} AS DOUBLE), 6) + 0.0 AS value"


@query("clean_bars", f"""
SELECT symbol, date, {d('open')}, {d('high')}, {d('low')}, {d('close')}, volume_shares
FROM v_dirty WHERE open > 0 AND high > 0 AND low > 0 AND close > 0""")
def clean_bars(t: Tables) -> DataFrame:
    return quality.clean_bars(t.dirty).select("symbol", "date", "open", "high", "low", "close", "volume_shares")


NONPOSITIVE = " UNION ALL ".join(
    f"SELECT {ISSUE.format('ohlc_nonpositive', repr(p), p)} FROM v_dirty WHERE {p} IS NULL OR {p} <= 0"
    for p in ("open", "high", "low", "close")
)
INCONSISTENT = f"""
SELECT {ISSUE.format('ohlc_inconsistent', "'high_low'", 'greatest(greatest(open, close) - high, low - least(open, close))')}
FROM v_dirty
WHERE greatest(open, close) - high > greatest(0.06, greatest(open, close) * 0.002)
   OR low - least(open, close) > greatest(0.06, greatest(open, close) * 0.002)"""
GAPS = f"""
SELECT {ISSUE.format('date_gap', "'date'", 'days')} FROM (
  SELECT *, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS days FROM v_dirty) WHERE days > 15"""
JUMPS = f"""
SELECT {ISSUE.format('price_jump', "'close'", 'close')} FROM (
  SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS move FROM v_dirty)
WHERE abs(move) > 0.15"""
SPIKES = f"""
SELECT {ISSUE.format('volume_spike', "'volume_shares'", 'volume_shares')} FROM (
  SELECT *, quantile_cont(volume_shares, 0.5) OVER w AS med, count(*) OVER w AS have,
         least(20, count(*) OVER (PARTITION BY symbol)) AS need
  FROM v_dirty WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
WHERE have >= need AND med > 0 AND volume_shares > med * 3"""


@query("quality_nonpositive", NONPOSITIVE)
def quality_nonpositive(t: Tables) -> DataFrame:
    return quality.nonpositive_prices(t.dirty)


@query("quality_ohlc", INCONSISTENT)
def quality_ohlc(t: Tables) -> DataFrame:
    return quality.inconsistent_ohlc(t.dirty)


@query("quality_gap", GAPS)
def quality_gap(t: Tables) -> DataFrame:
    return quality.date_gaps(t.dirty)


@query("quality_jump", JUMPS)
def quality_jump(t: Tables) -> DataFrame:
    return quality.price_jumps(t.dirty)


@query("quality_volume_spike", SPIKES)
def quality_volume_spike(t: Tables) -> DataFrame:
    return quality.volume_spikes(t.dirty, factor=3.0)


@query("quality_report", f"""
SELECT "check", field, count(*) AS n, min(date) AS first_date, max(date) AS last_date, {d('sum(value)', 'total')}
FROM ({NONPOSITIVE} UNION ALL {INCONSISTENT} UNION ALL {GAPS} UNION ALL {JUMPS} UNION ALL {SPIKES}) GROUP BY 1, 2""")
def quality_report(t: Tables) -> DataFrame:
    issues = quality.quality_report(t.dirty, volume_factor=3.0)
    return issues.groupBy("check", "field").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum(F.round("value", 6)).alias("total"),
    )


@query("validate_bars", """
WITH c AS (SELECT symbol, date,
  CASE WHEN NOT regexp_matches(symbol, '^[0-9A-Z]{4,12}$') THEN 'symbol' END AS e1,
  CASE WHEN market <> 'TSE' THEN 'market' END AS e2,
  CASE WHEN high < greatest(open, high, low, close) THEN 'high' END AS e3,
  CASE WHEN low > least(open, high, low, close) THEN 'low' END AS e4
  FROM v_dirty)
SELECT symbol, date, array_to_string(list_filter([e1, e2, e3, e4], lambda x: x IS NOT NULL), ',') AS errors
FROM c WHERE coalesce(e1, e2, e3, e4) IS NOT NULL""")
def validate_bars(t: Tables) -> DataFrame:
    _, rejected = quality.split_by_contract(t.dirty)
    return rejected.select("symbol", "date", F.array_join("errors", ",").alias("errors"))


@query("duplicate_keys", """
SELECT l_suppkey, date, count(*) AS n FROM v_trades GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(t: Tables) -> DataFrame:
    return quality.duplicate_keys(t._trades, ["l_suppkey", "date"])


# -- reconciliation --------------------------------------------------------------

PAIRS = """
SELECT b.symbol, b.date, f.field, CASE f.field WHEN 'close' THEN b.close ELSE b.volume_shares END AS a,
       CASE f.field WHEN 'close' THEN s.close ELSE s.volume_shares END AS b
FROM v_bars b JOIN v_second s USING (symbol, date), (SELECT unnest(['close', 'volume_shares']) AS field) f"""
BEYOND = "abs(a - b) / nullif(abs(a), 0) > 0.005 OR (a = 0 AND abs(a - b) > 0.005)"


@query("compare_sources", f"""
SELECT symbol, date, field, {d('a', 'primary')}, {d('b', 'secondary')}, {d('abs(a - b)', 'error')}
FROM ({PAIRS}) WHERE {BEYOND}""")
def compare_sources(t: Tables) -> DataFrame:
    return reconcile.compare_sources(t.bars, t.second_source)


@query("compare_summary", f"""
SELECT count(*) AS checked, count(*) FILTER (WHERE {BEYOND}) AS mismatches, false AS passed FROM ({PAIRS})""")
def compare_summary(t: Tables) -> DataFrame:
    return reconcile.compare_summary(t.bars, t.second_source)


INST_FIELDS = reconcile.INSTITUTIONAL_FIELDS


@query("institutional_mismatch", f"""
SELECT symbol, date, 'institutional_' || field || '_mismatch' AS check, {d('a', 'primary')}, {d('b', 'secondary')} FROM (
{" UNION ALL ".join(f"SELECT p.symbol, p.date, '{f}' AS field, p.{f} AS a, q.{f} AS b FROM v_inst p JOIN v_inst2 q USING (symbol, date)" for f in INST_FIELDS)})
WHERE {BEYOND}""")
def institutional_mismatch(t: Tables) -> DataFrame:
    return reconcile.institutional_mismatches(t.institutional, t.institutional_second)


@query("panel_strays", f"""
WITH p AS (SELECT * FROM v_panel), s AS (SELECT * FROM v_second WHERE right(symbol, 1) <> '3' AND month(date) <> 7),
j AS (SELECT max(abs(p.close - s.close)) AS c, CAST(max(abs(p.volume - s.volume_shares)) AS DOUBLE) AS v FROM p JOIN s USING (instrument, date))
SELECT 'close_equal' AS check, CAST(NULL AS VARCHAR) AS sample, {d('c', 'measure')} FROM j
UNION ALL SELECT 'volume_equal', NULL, {d('v', 'measure')} FROM j
UNION ALL (SELECT 'instruments_in_store', instrument, NULL FROM (SELECT DISTINCT instrument FROM p) WHERE instrument NOT IN (SELECT instrument FROM s) ORDER BY 2 LIMIT 5)
UNION ALL (SELECT 'dates_in_store', CAST(date AS VARCHAR), NULL FROM (SELECT DISTINCT date FROM p) WHERE date NOT IN (SELECT date FROM s) ORDER BY 2 LIMIT 3)""")
def panel_strays(t: Tables) -> DataFrame:
    store = t.second_source.where("right(symbol, 1) <> '3' AND month(date) <> 7")
    return reconcile.panel_strays(t.panel, store)


@query("verify_panel", """
WITH p AS (SELECT p.date, p.instrument, p.close, p.volume, CASE WHEN b.trade_count = 1 AND p.factor < 0.9 THEN 1.0 ELSE p.factor END AS factor
           FROM v_panel p JOIN v_bars b USING (instrument, date)),
s AS (SELECT instrument, date, close AS s_close, volume_shares AS s_volume FROM v_second),
j AS (SELECT p.*, s_close, s_volume FROM p LEFT JOIN s USING (instrument, date)),
w AS (SELECT *, close * factor / nullif(lag(close * factor) OVER k, 0) - 1 AS r,
        close <= 0 OR coalesce(lag(close) OVER k <= 0, false) OR coalesce(lead(close) OVER k <= 0, false) AS z,
        factor >= 0.99 AND lag(factor) OVER k < 0.9 AND lead(factor) OVER k < 0.9 AS hole
      FROM p WINDOW k AS (PARTITION BY instrument ORDER BY date)),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE s_close IS NULL) AS unmatched,
        count(*) FILTER (WHERE abs(close - s_close) > 1e-9) AS cd, count(*) FILTER (WHERE abs(volume - s_volume) > 0.5) AS vd,
        count(*) FILTER (WHERE close <= 0) AS zc, count(*) FILTER (WHERE close IS NULL) AS nc, max(factor) AS fmax,
        max(date) - min(date) AS span,
        (SELECT count(*) FROM (SELECT DISTINCT instrument FROM p) WHERE instrument NOT IN (SELECT instrument FROM s)) AS xi,
        (SELECT count(*) FROM (SELECT DISTINCT date FROM p) WHERE date NOT IN (SELECT date FROM s)) AS xd,
        (SELECT count(*) FROM w WHERE hole) AS holes,
        (SELECT count(*) FROM w WHERE abs(r) > 0.6 AND NOT z) AS jumps FROM j)
SELECT u.check, u.status, round(CAST(u.measure AS DOUBLE), 6) + 0.0 AS measure FROM t, LATERAL (VALUES
  ('unique_date_instrument', 'pass', 0), ('unique_instrument_date', 'pass', 0), ('key_order', 'pass', 0),
  ('date_span_days', 'pass', span),
  ('instruments_in_store', CASE WHEN xi > 0 THEN 'fail' ELSE 'pass' END, xi),
  ('dates_in_store', CASE WHEN xd > 0 THEN 'fail' ELSE 'pass' END, xd),
  ('rows_in_store', CASE WHEN unmatched > 0 THEN 'fail' ELSE 'pass' END, unmatched),
  ('close_equal', CASE WHEN cd > 0 THEN 'fail' ELSE 'pass' END, cd),
  ('volume_equal', CASE WHEN vd > 0 THEN 'fail' ELSE 'pass' END, vd),
  ('no_zero_close', CASE WHEN zc > 0 THEN 'fail' ELSE 'pass' END, zc),
  ('no_null_close', CASE WHEN nc > 0 THEN 'fail' ELSE 'pass' END, nc),
  ('no_factor_hole', CASE WHEN holes > 0 THEN 'fail' ELSE 'pass' END, holes),
  ('no_adjusted_jump', CASE WHEN jumps = 0 THEN 'pass' WHEN jumps < n * 0.002 THEN 'warn' ELSE 'fail' END, jumps),
  ('factor_range', 'pass', fmax)) u("check", status, measure)""")
def verify_panel(t: Tables) -> DataFrame:
    """The panel with factor holes on single-trade weeks, against the second source."""
    counts = t.bars.select("instrument", "date", "trade_count")
    holed = t.stored_panel.join(counts, ["instrument", "date"]).withColumn(
        "factor", F.when((F.col("trade_count") == 1) & (F.col("factor") < 0.9), 1.0).otherwise(F.col("factor"))
    )
    return reconcile.verify_panel(holed, t.second_source)


# -- features ------------------------------------------------------------------

W = "OVER (PARTITION BY symbol ORDER BY date)"


def _full(function: str, column: str, n: int, key: str = "symbol") -> str:
    frame = f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {frame} = {n} THEN {function}({column}) {frame} END"


@query("returns", f"""
SELECT symbol, date, {d(f'close / nullif(lag(close, 1) {W}, 0) - 1', 'return_1d')},
       {d(f'close / nullif(lag(close, 5) {W}, 0) - 1', 'return_5d')},
       {d(f'close / nullif(lag(close, 20) {W}, 0) - 1', 'return_20d')} FROM v_bars""")
def returns(t: Tables) -> DataFrame:
    out = t.bars
    for n in (1, 5, 20):
        out = features.add_returns(out, n=n)
    return out.select("symbol", "date", "return_1d", "return_5d", "return_20d")


@query("sma", f"""
SELECT symbol, date, {d(_full('avg', 'close', 5), 'sma_5')}, {d(_full('avg', 'close', 20), 'sma_20')} FROM v_bars""")
def sma(t: Tables) -> DataFrame:
    return features.add_sma(features.add_sma(t.bars, window=5), window=20).select("symbol", "date", "sma_5", "sma_20")


def _rsi(source: str) -> str:
    return f"""
SELECT symbol, date, CASE WHEN i = 0 OR up + down = 0 THEN 50.0 ELSE 100.0 * up / (up + down) END AS rsi_14 FROM (
  SELECT symbol, date, i, sum(g * w) OVER k * pow(13.0 / 14, i) AS up, sum(l * w) OVER k * pow(13.0 / 14, i) AS down FROM (
    SELECT symbol, date, i, greatest(m, 0) AS g, greatest(-m, 0) AS l,
           CASE WHEN i = 1 THEN 1.0 ELSE 1.0 / 14 END * pow(14.0 / 13, i) AS w FROM (
      SELECT symbol, date, row_number() {W} - 1 AS i, close - lag(close) {W} AS m FROM {source}))
  WINDOW k AS (PARTITION BY symbol ORDER BY date))"""


@query("rsi", f"SELECT symbol, date, {d('rsi_14')} FROM ({_rsi('v_bars')})")
def rsi(t: Tables) -> DataFrame:
    return features.add_rsi(t.bars).select("symbol", "date", "rsi_14")


@query("volume_ratio", f"""
SELECT symbol, date, {d(f"volume_shares / nullif({_full('avg', 'volume_shares', 20)}, 0)", 'volume_ratio_20')} FROM v_bars""")
def volume_ratio(t: Tables) -> DataFrame:
    return features.add_volume_ratio(t.bars, window=20).select("symbol", "date", "volume_ratio_20")


@query("volatility", f"""
SELECT symbol, date, {d(_full('stddev_samp', 'r', 20), 'volatility_20d')}
FROM (SELECT symbol, date, close / nullif(lag(close) {W}, 0) - 1 AS r FROM v_bars)""")
def volatility(t: Tables) -> DataFrame:
    return features.add_volatility(features.add_returns(t.bars)).select("symbol", "date", "volatility_20d")


@query("label_forward", f"SELECT symbol, date, {d(f'lead(close) {W} / nullif(close, 0) - 1', 'label_ret_1f')} FROM v_dirty")
def label_forward(t: Tables) -> DataFrame:
    return features.add_label(t.dirty).select("symbol", "date", "label_ret_1f")


FLOWS = """SELECT symbol, date, (foreign_buy - foreign_sell) / 1000 AS foreign_net_lots,
       (investment_trust_buy - investment_trust_sell) / 1000 AS trust_net_lots,
       (foreign_buy + investment_trust_buy + dealer_buy - foreign_sell - investment_trust_sell - dealer_sell) / 1000 AS tii_net_lots
  FROM v_inst"""
MARGINS = f"""SELECT symbol, date, margin_balance / nullif(lag(margin_balance) {W}, 0) - 1 AS margin_change_pct,
       short_balance / nullif(lag(short_balance) {W}, 0) - 1 AS short_change_pct,
       short_balance / nullif(margin_balance, 0) AS margin_short_ratio FROM v_margin"""


@query("features_flow_join", f"""
SELECT symbol, date, {d('foreign_net_lots')}, {d('trust_net_lots')}, {d('tii_net_lots')},
       {d('foreign_net_lots * 1000 / nullif(volume_shares, 0)', 'foreign_net_ratio')}
FROM v_bars LEFT JOIN ({FLOWS}) USING (symbol, date)""")
def features_flow_join(t: Tables) -> DataFrame:
    return features.attach_institutional(t.bars, t.institutional).select("symbol", "date", *features.FLOW_COLUMNS)


@query("margin_change", f"""
SELECT symbol, date, {d('margin_change_pct')}, {d('short_change_pct')}, {d('margin_short_ratio')} FROM ({MARGINS})""")
def margin_change(t: Tables) -> DataFrame:
    return features.margin_changes(t.margin)


@query("ml_features", f"""
WITH base AS (SELECT symbol, date, close, volume_shares, turnover_twd,
    close / nullif(lag(close, 1) {W}, 0) - 1 AS return_1d, close / nullif(lag(close, 5) {W}, 0) - 1 AS return_5d,
    close / nullif(lag(close, 20) {W}, 0) - 1 AS return_20d, {_full('avg', 'close', 5)} AS s5,
    {_full('avg', 'close', 20)} AS s20, volume_shares / nullif({_full('avg', 'volume_shares', 20)}, 0) AS volume_ratio_20,
    {_full('avg', 'turnover_twd', 20)} AS turnover_mean_20, lead(close) {W} / nullif(close, 0) - 1 AS label_ret_1f
  FROM v_bars),
f AS (SELECT *, {_full('stddev_samp', 'return_1d', 20)} AS volatility_20d, s5 / nullif(s20, 0) AS ma5_ma20_ratio,
    close / nullif(s20, 0) - 1 AS close_vs_ma20 FROM base)
SELECT symbol, date, {d('close')}, {d('return_1d')}, {d('return_5d')}, {d('return_20d')}, {d('rsi_14')},
  {d('ma5_ma20_ratio')}, {d('close_vs_ma20')}, {d('volatility_20d')}, {d('volume_ratio_20')},
  {d('turnover_mean_20')}, {d('foreign_net_lots')}, {d('trust_net_lots')}, {d('tii_net_lots')},
  {d('foreign_net_lots * 1000 / nullif(volume_shares, 0)', 'foreign_net_ratio')}, {d('margin_change_pct')},
  {d('short_change_pct')}, {d('margin_short_ratio')}, {d('label_ret_1f')}
FROM f JOIN ({_rsi('v_bars')}) USING (symbol, date) LEFT JOIN ({FLOWS}) USING (symbol, date)
LEFT JOIN ({MARGINS}) USING (symbol, date)""")
def ml_features(t: Tables) -> DataFrame:
    return features.ml_features(t.bars, t.institutional, t.margin)


# -- adjustment ----------------------------------------------------------------

@query("dividend_factor", f"SELECT instrument, date, {d('close')}, {d('factor')} FROM v_bars JOIN v_factor USING (instrument, date)")
def dividend_factor(t: Tables) -> DataFrame:
    return adjust.with_dividend_factor(t.bars, t.dividends).select("instrument", "date", "close", "factor")


@query("panel_build", f"""
SELECT date, instrument, {d('open')}, {d('close')}, {d('high')}, {d('low')}, {d('volume')}, {d('factor')} FROM v_panel""")
def panel_build(t: Tables) -> DataFrame:
    return t.panel


@query("adjusted_prices", f"""
SELECT date, instrument, {d("CASE WHEN close > 0 AND close * factor > 0 THEN close * factor END", 'adj')},
       {d("CASE WHEN close > 0 AND close * factor > 0 THEN close END", 'raw')}
FROM (SELECT b.date, b.instrument, b.close, round(f.factor, 6) AS factor FROM v_dirty b JOIN v_factor f USING (instrument, date))""")
def adjusted_prices(t: Tables) -> DataFrame:
    prices = t.dirty.select("instrument", "date", F.col("close").alias("_dirty"))
    panel = t.panel.join(prices, ["instrument", "date"]).withColumn("close", F.col("_dirty"))
    return adjust.adjusted_prices(panel).select("date", "instrument", "adj", "raw")


SPLITS = """SELECT instrument, date, CASE WHEN volume_shares >= 150000 THEN 0.93 ELSE 0.97 END AS ratio
  FROM v_bars WHERE trade_count >= 5"""


@query("back_adjust", f"""
SELECT b.instrument, b.date, round(b.close * exp(coalesce(sum(ln(e.ratio)), 0)), 2) + 0.0 AS back_adjusted
FROM v_bars b LEFT JOIN ({SPLITS}) e ON e.instrument = b.instrument AND e.date > b.date GROUP BY b.instrument, b.date, b.close""")
def back_adjust(t: Tables) -> DataFrame:
    """Weeks with many trades count as capital changes."""
    events = t.bars.where(F.col("trade_count") >= 5).select(
        "instrument", "date", F.when(F.col("volume_shares") >= 150000, 0.93).otherwise(0.97).alias("ratio")
    )
    return adjust.back_adjusted_close(t.bars, events).select("instrument", "date", "back_adjusted")


@query("forward_adjust", """
SELECT instrument, date, round(close - sum(CASE WHEN volume_shares >= 120000 THEN 0.5 ELSE 0 END)
       OVER (PARTITION BY instrument ORDER BY date), 2) + 0.0 AS forward_adjusted FROM v_bars""")
def forward_adjust(t: Tables) -> DataFrame:
    """Weeks with a large volume pay half a unit."""
    paid = t.bars.where(F.col("volume_shares") >= 120000).select("instrument", "date", F.lit(0.5).alias("cash"))
    return adjust.forward_adjusted_close(t.bars, paid).select("instrument", "date", "forward_adjusted")


@query("factor_ffill", f"""
WITH k AS (SELECT b.instrument, b.date, CASE WHEN b.trade_count >= 4 THEN f.factor END AS known
  FROM v_bars b JOIN v_factor f USING (instrument, date))
SELECT instrument, date, {d('''coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(known IGNORE NULLS) OVER (PARTITION BY instrument
    ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1.0)''', 'factor')} FROM k""")
def factor_ffill(t: Tables) -> DataFrame:
    """The external map knows only weeks with four or more trades."""
    full = adjust.with_dividend_factor(t.bars, t.dividends)
    known = full.where(F.col("trade_count") >= 4).select("instrument", "date", "factor")
    return adjust.with_filled_factor(t.bars, known).select("instrument", "date", "factor")
