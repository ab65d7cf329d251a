"""Bars, timeline, plans, upserts and quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.base import (
    SQL_BARS,
    SQL_DENSE,
    SQL_FILLED,
    bars,
    ctes_panel,
    day,
    panel,
    rd,
    sql_rd,
    sql_trades,
    table,
    with_ctes,
)
from tidemark.config import QualityRules
from tidemark.operators import ingest as I
from tidemark.operators import quality as Q
from tidemark.operators import timeline as T
from tidemark.session import stored
from tidemark.sources.bars import make_bars
from tidemark.sources.tables import enforce_schema

QUERIES, SQL = {}, {}
PRICES = ["open", "high", "low", "close"]
RUN_DATE = dt.date(2001, 12, 1)


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


SQL_OHLC = ", ".join(f"{sql_rd(c)} AS {c}" for c in PRICES)


def bar_columns(df, first="date"):
    return df.select("symbol", day(first), *[rd(c).alias(c) for c in PRICES], "volume")


@query(
    "bars_daily",
    with_ctes(
        [sql_trades("supplier"), SQL_BARS],
        f"SELECT symbol, CAST(date AS VARCHAR) AS date, {SQL_OHLC}, volume FROM bars",
    ),
)
def bars_daily(spark, sf):
    return bar_columns(bars(spark, sf, "supplier"))


SQL_EVENT_BARS = """SELECT event_type AS symbol, {bucket} AS bar,
  arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2"""


def event_bars(spark, sf, interval):
    return make_bars(
        table(spark, sf, "events"),
        symbol="event_type",
        ts="ts",
        price="value",
        quantity=F.lit(1),
        tie_break=["event_id"],
        interval=interval,
    )


def _event_query(name, interval, bucket):
    sql = with_ctes(
        [f"bars AS ({SQL_EVENT_BARS.format(bucket=bucket)})"],
        f"SELECT symbol, strftime(bar, '%Y-%m-%d %H:%M:%S') AS bar, {SQL_OHLC}, volume FROM bars",
    )

    @query(name, sql)
    def run(spark, sf):
        out = event_bars(spark, sf, interval)
        return out.select(
            "symbol",
            F.date_format("bar", "yyyy-MM-dd HH:mm:ss").alias("bar"),
            *[rd(c).alias(c) for c in PRICES],
            "volume",
        )


_event_query("bars_hourly", "1h", "date_trunc('hour', ts)")
_event_query("bars_15m", "15m", "time_bucket(INTERVAL 15 MINUTE, ts)")
_event_query("bars_weekly", "1wk", "CAST(date_trunc('week', ts) AS TIMESTAMP)")


@query(
    "calendar_densify",
    with_ctes(
        ctes_panel("supplier"),
        f"SELECT symbol, CAST(date AS VARCHAR) AS date, {SQL_OHLC}, "
        "CAST(volume AS DOUBLE) AS volume FROM dense",
    ),
)
def calendar_densify(spark, sf):
    dense = bar_columns(T.densify(bars(spark, sf, "supplier")))
    return dense.withColumn("volume", F.col("volume").cast("double"))


@query(
    "schema_enforcement",
    with_ctes(
        [sql_trades("supplier"), SQL_BARS],
        """SELECT symbol, count(*) AS n_rows, count(TRY_CAST(volume AS BIGINT)) AS n_volume,
       count(TRY_CAST(date AS DATE)) AS n_date,
       CAST(sum(CASE WHEN volume IS NOT NULL AND TRY_CAST(volume AS BIGINT) IS NULL
                THEN 1 ELSE 0 END) AS BIGINT) AS n_failed
FROM (SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(close AS VARCHAR) AS close,
      CASE WHEN volume > 40 THEN 'many' ELSE CAST(volume AS VARCHAR) END AS volume FROM bars) raw
GROUP BY symbol""",
    ),
)
def schema_enforcement(spark, sf):
    raw = bars(spark, sf, "supplier").select(
        F.col("date").cast("string").alias("date"),
        "symbol",
        "open",
        "high",
        "low",
        F.col("close").cast("string").alias("close"),
        F.when(F.col("volume") > 40, "many").otherwise(F.col("volume").cast("string")).alias("volume"),
    )
    return (
        enforce_schema(raw)
        .groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("volume").alias("n_volume"),
            F.count("date").alias("n_date"),
            F.count_if("_cast_failed").alias("n_failed"),
        )
    )


@query(
    "forward_fill",
    with_ctes(
        [*ctes_panel("supplier"), SQL_FILLED],
        f"SELECT symbol, CAST(date AS VARCHAR) AS date, {SQL_OHLC}, volume FROM filled",
    ),
)
def forward_fill(spark, sf):
    return bar_columns(T.forward_fill(panel(spark, sf, "supplier")).dropna("any"))


@query(
    "calendar_parts",
    with_ctes(
        [*ctes_panel(), SQL_FILLED],
        """SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(year(date) AS INTEGER) AS year,
  CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) AS INTEGER) AS day_of_week,
  CAST(dayofyear(date) AS INTEGER) AS day_of_year FROM filled""",
    ),
)
def calendar_parts(spark, sf):
    df = T.filled_panel(panel(spark, sf))
    return df.select("symbol", day(), "year", "month", "day_of_week", "day_of_year")


@query(
    "horizon_filter",
    with_ctes(
        [sql_trades(), SQL_BARS],
        """SELECT symbol, CAST(date AS VARCHAR) AS date, volume FROM bars
WHERE date >= (SELECT max(date) FROM bars) - 1960""",
    ),
)
def horizon_filter(spark, sf):
    return T.within_horizon(bars(spark, sf), 1960).select("symbol", day(), "volume")


# --- plans and metadata ------------------------------------------------------------------


def tickers(spark, sf):
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.col("s_name").alias("name"),
    )


def metadata(spark, sf):
    """Suppliers with a positive balance are known; poor ones are not active."""
    s = table(spark, sf, "supplier").where("s_acctbal >= 0")
    return s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.date_add(F.lit(dt.date(2001, 9, 1)), F.col("s_nationkey") * 4).alias("last_ingestion"),
        F.date_add(F.lit(dt.date(2001, 8, 31)), F.col("s_nationkey") * 4).alias(
            "max_date_recorded"
        ),
        F.when(F.col("s_acctbal") < 1000, "data_quality_issue").otherwise("active").alias("status"),
    )


SQL_META = """tickers AS (SELECT 'S' || s_suppkey AS symbol FROM supplier),
meta AS (SELECT 'S' || s_suppkey AS symbol, DATE '2001-09-01' + s_nationkey * 4 AS last_ingestion,
       DATE '2001-08-31' + s_nationkey * 4 AS max_date_recorded,
       CASE WHEN s_acctbal < 1000 THEN 'data_quality_issue' ELSE 'active' END AS status
       FROM supplier WHERE s_acctbal >= 0),
plans AS (SELECT t.symbol, CASE WHEN m.symbol IS NULL THEN 'max' END AS period,
       m.last_ingestion + 1 AS start
       FROM tickers t LEFT JOIN meta m ON m.symbol = t.symbol
       WHERE m.symbol IS NULL OR m.status = 'active')"""


@query(
    "collection_plan",
    with_ctes(
        [SQL_META], "SELECT symbol, period, strftime(start, '%Y-%m-%d') AS start FROM plans"
    ),
)
def collection_plan(spark, sf):
    return I.collection_plan(tickers(spark, sf), metadata(spark, sf))


@query(
    "skipped_tickers",
    with_ctes(
        [SQL_META], "SELECT symbol, status FROM meta WHERE status <> 'active'"
    ),
)
def skipped_tickers(spark, sf):
    return I.skipped_tickers(tickers(spark, sf), metadata(spark, sf))


@query(
    "plan_validation",
    """WITH p AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS symbol, o_custkey,
    CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN 'P' THEN strftime(o_orderdate, '%d.%m.%Y') END AS start,
    CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d')
         WHEN '2-HIGH' THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') END AS "end",
    CASE o_orderpriority WHEN '5-LOW' THEN '1d' WHEN '2-HIGH' THEN '4h' END AS "interval",
    CASE o_orderpriority WHEN '3-MEDIUM' THEN 'max' WHEN '4-NOT SPECIFIED' THEN '7y'
         END AS period FROM orders),
d AS (SELECT *, CAST(try_strptime(start, '%Y-%m-%d') AS DATE) AS sd,
             CAST(try_strptime("end", '%Y-%m-%d') AS DATE) AS ed FROM p)
SELECT symbol, concat_ws(',',
  CASE WHEN start IS NULL AND "end" IS NULL AND "interval" IS NULL AND period IS NULL
       THEN 'no_parameter' END,
  CASE WHEN start IS NULL AND period IS NULL THEN 'start_or_period_required' END,
  CASE WHEN start IS NOT NULL AND period IS NOT NULL THEN 'start_and_period' END,
  CASE WHEN "end" IS NOT NULL AND period IS NOT NULL THEN 'end_and_period' END,
  CASE WHEN sd >= ed THEN 'start_not_before_end' END,
  CASE WHEN start IS NOT NULL AND "end" IS NOT NULL AND "interval" IS NOT NULL
       THEN 'interval_with_start_and_end' END,
  CASE WHEN start IS NOT NULL AND sd IS NULL THEN 'start_format' END,
  CASE WHEN "end" IS NOT NULL AND ed IS NULL THEN 'end_format' END,
  CASE WHEN "interval" = '4h' THEN 'unknown_interval' END,
  CASE WHEN period = '7y' THEN 'unknown_period' END) AS violations FROM d""",
)
def plan_validation(spark, sf):
    o = table(spark, sf, "orders")
    when = lambda c, pairs: F.coalesce(
        *[F.when(F.col(c) == k, v) for k, v in pairs], F.lit(None).cast("string")
    )
    stamp = lambda d, f="yyyy-MM-dd": F.date_format(d, f)
    d = F.col("o_orderdate")
    plans = o.select(
        F.col("o_orderkey").cast("string").alias("symbol"),
        when("o_orderstatus", [("F", stamp(d)), ("P", stamp(d, "dd.MM.yyyy"))]).alias("start"),
        when(
            "o_orderpriority",
            [("1-URGENT", stamp(F.date_add(d, 10))), ("2-HIGH", stamp(F.date_sub(d, 1)))],
        ).alias("end"),
        when("o_orderpriority", [("5-LOW", F.lit("1d")), ("2-HIGH", F.lit("4h"))]).alias("interval"),
        when(
            "o_orderpriority", [("3-MEDIUM", F.lit("max")), ("4-NOT SPECIFIED", F.lit("7y"))]
        ).alias("period"),
    )
    checked = I.validate_plans(plans)
    return checked.select("symbol", F.concat_ws(",", "violations").alias("violations"))


@query(
    "metadata_upsert",
    with_ctes(
        [
            SQL_META,
            """upd AS (SELECT 'S' || s_suppkey AS symbol, DATE '2001-10-15' AS last_ingestion,
       CAST(NULL AS DATE) AS max_date_recorded, 'collection_issue' AS status FROM supplier),
both_ AS (SELECT *, 0 AS src FROM meta UNION ALL SELECT *, 1 AS src FROM upd)""",
        ],
        """SELECT symbol, CAST(last_ingestion AS VARCHAR) AS last_ingestion,
  CAST(max_date_recorded AS VARCHAR) AS max_date_recorded, status FROM both_
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY last_ingestion DESC, src DESC) = 1""",
    ),
)
def metadata_upsert(spark, sf):
    updates = I.initial_metadata(tickers(spark, sf), dt.date(2001, 10, 15))
    out = I.upsert_metadata(metadata(spark, sf), updates)
    return out.select("symbol", day("last_ingestion"), day("max_date_recorded"), "status")


@query(
    "history_upsert",
    with_ctes(
        [
            sql_trades("supplier"),
            SQL_BARS,
            """hist AS (SELECT *, 0 AS src FROM bars WHERE date <= DATE '1999-06-30'
  UNION ALL
  SELECT symbol, date, open, high * 1.01, low, low, volume + 1, 1 AS src FROM bars
  WHERE date >= DATE '1999-01-01')""",
        ],
        f"""SELECT symbol, CAST(date AS VARCHAR) AS date, {SQL_OHLC}, volume FROM hist
QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY src DESC) = 1""",
    ),
)
def history_upsert(spark, sf):
    b = bars(spark, sf, "supplier")
    old = b.where(F.col("date") <= F.lit("1999-06-30").cast("date"))
    new = b.where(F.col("date") >= F.lit("1999-01-01").cast("date")).select(
        "date",
        "symbol",
        "open",
        (F.col("high") * 1.01).alias("high"),
        "low",
        F.col("low").alias("close"),
        (F.col("volume") + 1).alias("volume"),
    )
    return bar_columns(I.upsert_history(old, new))


def mixed_bars(spark, sf):
    """Bars with every kind of defect: rich suppliers have several rows per day,
    poor ones a unit price that jumps more than tenfold. Stored, as the queries read them several times."""
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    t = li.join(part, li.l_partkey == part.p_partkey).join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    price = F.when(F.col("s_acctbal") < 2000, F.col("l_extendedprice") / F.col("l_quantity"))
    t = t.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        F.when(F.col("s_acctbal") > 8000, F.col("l_returnflag")).otherwise("").alias("part"),
        F.coalesce(price, F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("price"),
        F.struct("l_shipdate", *[c for c in _TIES]).alias("ord"),
        "l_quantity",
    )
    mixed = (
        t.groupBy("symbol", "date", "part")
        .agg(
            F.min_by("price", "ord").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "ord").alias("close"),
            F.sum("l_quantity").cast("long").alias("volume"),
        )
        .drop("part")
    )
    return stored(mixed, "mixed-bars")


_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_suppkey"]

SQL_MIXED = """mixed AS (
  SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
         CASE WHEN s_acctbal > 8000 THEN l_returnflag ELSE '' END AS part,
         CASE WHEN s_acctbal < 2000 THEN l_extendedprice / l_quantity
              ELSE p_retailprice * (1 - l_discount) END AS price,
         l_quantity AS qty,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity,
             l_suppkey) AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
mbars AS (SELECT symbol, date, arg_min(price, ord) AS open, max(price) AS high,
       min(price) AS low, arg_max(price, ord) AS close, CAST(sum(qty) AS BIGINT) AS volume
       FROM mixed GROUP BY symbol, date, part)"""


def sql_quality(source: str) -> str:
    return f"""chg AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc
       FROM {source} WHERE close IS NOT NULL),
ext AS (SELECT symbol, count(*) FILTER (WHERE abs(close / pc - 1) > 10.0) AS n_ext
       FROM chg GROUP BY symbol),
qual AS (SELECT d.symbol, count(*) AS total_rows_checked,
       count(*) FILTER (WHERE open <= 0) + count(*) FILTER (WHERE high <= 0)
         + count(*) FILTER (WHERE low <= 0) + count(*) FILTER (WHERE close <= 0) AS n_pos,
       count(*) FILTER (WHERE high < low - 1e-8) AS n_hl,
       count(*) FILTER (WHERE volume < 0) AS n_vol,
       count(*) FILTER (WHERE open > high + 1e-8 OR open < low - 1e-8)
         + count(*) FILTER (WHERE close > high + 1e-8 OR close < low - 1e-8) AS n_rel,
       max(n_ext) AS n_ext
       FROM {source} d JOIN ext e ON e.symbol = d.symbol GROUP BY d.symbol)"""


# the plan's start date decides which bars a known symbol delivers
SQL_STATUS = """planned AS (SELECT b.* FROM mbars b JOIN plans p ON p.symbol = b.symbol
       WHERE p.start IS NULL OR b.date >= p.start),
dup AS (SELECT symbol, max(n) AS n, max(date) AS newest FROM
       (SELECT symbol, date, count(*) AS n FROM planned GROUP BY symbol, date) GROUP BY symbol),
bars AS (SELECT b.* FROM planned b JOIN dup d ON d.symbol = b.symbol WHERE d.n = 1)"""

SQL_STATUS_ROWS = """stat AS (SELECT p.symbol, DATE '2001-12-01' AS last_ingestion,
  CASE WHEN d.symbol IS NULL THEN 'collection_issue' WHEN d.n > 1 THEN 'data_issue'
       WHEN q.n_pos + q.n_hl + q.n_vol + q.n_rel + q.n_ext > 0 THEN 'data_quality_issue'
       ELSE 'active' END AS status, d.newest
  FROM plans p LEFT JOIN dup d ON d.symbol = p.symbol LEFT JOIN qual q ON q.symbol = p.symbol)"""

CTES_STATUS = [SQL_META, SQL_MIXED, SQL_STATUS, SQL_DENSE, sql_quality("dense"), SQL_STATUS_ROWS]


@query(
    "symbol_status",
    with_ctes(
        CTES_STATUS,
        """SELECT symbol, CAST(last_ingestion AS VARCHAR) AS last_ingestion, status,
  CASE WHEN status = 'active' THEN CAST(newest AS VARCHAR) END AS max_date_recorded FROM stat""",
    ),
)
def symbol_status(spark, sf):
    plans = I.collection_plan(tickers(spark, sf), metadata(spark, sf))
    out = I.symbol_status(plans, I.planned_rows(mixed_bars(spark, sf), plans), RUN_DATE)
    return out.select("symbol", day("last_ingestion"), "status", day("max_date_recorded"))


@query(
    "collection_summary",
    with_ctes(
        [
            *CTES_STATUS,
            """acc AS (SELECT d.* FROM dense d JOIN stat s ON s.symbol = d.symbol
       WHERE s.status = 'active'),
old AS (SELECT symbol, date FROM mbars WHERE date <= DATE '2001-09-30'),
tot AS (SELECT DISTINCT symbol, date FROM (SELECT symbol, date FROM old
        UNION ALL SELECT symbol, date FROM acc))""",
        ],
        """SELECT (SELECT count(*) FROM plans) AS tickers_processed,
  (SELECT count(*) FROM stat WHERE status = 'active') AS successful_collections,
  (SELECT count(*) FROM acc) AS new_records, (SELECT count(*) FROM tot) AS total_records,
  (SELECT count(DISTINCT symbol) FROM acc) AS symbols_updated, 'success' AS status""",
    ),
)
def collection_summary(spark, sf):
    from tidemark.plans.collect import collect

    source = mixed_bars(spark, sf)
    history = source.where(F.col("date") <= F.lit("2001-09-30").cast("date"))
    return collect(
        tickers(spark, sf), metadata(spark, sf), source, history, RUN_DATE
    ).summary


# --- quality -------------------------------------------------------------------------------

SQL_UNIT = """trades AS (
  SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice / l_quantity AS price, l_quantity AS qty,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity,
             l_suppkey) AS ord FROM lineitem)"""


def unit_price_panel(spark, sf):
    """Daily bars of price per unit, which jumps: the failing fixture."""
    li = table(spark, sf, "lineitem")
    b = make_bars(
        li,
        symbol=F.concat(F.lit("S"), F.col("l_suppkey").cast("string")),
        ts="l_shipdate",
        price=F.col("l_extendedprice") / F.col("l_quantity"),
        quantity="l_quantity",
        tie_break=_TIES,
    )
    return T.densify(b, unique=True)


CTES_UNIT = [SQL_UNIT, SQL_BARS, SQL_DENSE, sql_quality("dense")]


@query(
    "quality_report",
    with_ctes(
        CTES_UNIT,
        """SELECT symbol, CAST(n_pos + n_hl + n_vol + n_rel + n_ext = 0 AS INTEGER) AS is_valid,
  concat_ws(',', CASE WHEN n_pos > 0 THEN 'price_positivity' END,
    CASE WHEN n_hl > 0 THEN 'high_low_consistency' END,
    CASE WHEN n_vol > 0 THEN 'volume_non_negative' END,
    CASE WHEN n_rel > 0 THEN 'ohlc_relationships' END,
    CASE WHEN n_ext > 0 THEN 'extreme_price_movements' END) AS failed_checks,
  total_rows_checked, n_pos + n_hl + n_vol + n_rel + n_ext AS rows_with_issues,
  CAST(n_ext AS INTEGER) AS n_warnings FROM qual""",
    ),
)
def quality_report(spark, sf):
    r = Q.quality_report(unit_price_panel(spark, sf))
    return r.select(
        "symbol",
        F.col("is_valid").cast("int").alias("is_valid"),
        F.concat_ws(",", "failed_checks").alias("failed_checks"),
        "total_rows_checked",
        "rows_with_issues",
        F.size("warnings").alias("n_warnings"),
    )


@query(
    "quality_gate",
    with_ctes(
        [
            # read several times below, so worked out once
            SQL_MIXED.replace("mbars AS (", "mbars AS MATERIALIZED ("),
            """once AS (SELECT symbol FROM (SELECT symbol, date, count(*) AS n FROM mbars
       GROUP BY symbol, date) GROUP BY symbol HAVING max(n) = 1),
bars AS MATERIALIZED (SELECT b.* FROM mbars b JOIN once u ON u.symbol = b.symbol)""",
            SQL_DENSE.replace("dense AS (", "dense AS MATERIALIZED ("),
            sql_quality("dense"),
        ],
        f"""SELECT d.symbol, CAST(d.date AS VARCHAR) AS date, {SQL_OHLC}, CAST(d.volume AS DOUBLE) AS volume
FROM dense d JOIN qual q ON q.symbol = d.symbol WHERE n_pos + n_hl + n_vol + n_rel + n_ext = 0""",
    ),
)
def quality_gate(spark, sf):
    """All rows that pass the gate, whole."""
    kept = bar_columns(Q.quality_gate(T.densify(mixed_bars(spark, sf))))
    return kept.withColumn("volume", F.col("volume").cast("double"))


@query(
    "quality_summary",
    with_ctes(
        CTES_UNIT,
        """SELECT symbol, CASE WHEN n_pos + n_hl + n_vol + n_rel + n_ext = 0 THEN 'PASSED'
  ELSE 'FAILED' END AS verdict, CAST(4 + CASE WHEN n_ext > 0 THEN 2 + least(n_ext, 3)
  ELSE 0 END + CASE WHEN n_ext > 3 THEN 1 ELSE 0 END AS INTEGER) AS n_lines FROM qual""",
    ),
)
def quality_summary(spark, sf):
    s = Q.quality_summary(Q.quality_report(unit_price_panel(spark, sf)))
    return s.select(
        "symbol",
        F.when(F.col("summary").contains("PASSED"), "PASSED").otherwise("FAILED").alias("verdict"),
        F.size(F.split("summary", "\n")).alias("n_lines"),
    )


# every check fails somewhere: signs, highs and lows, volumes and opens are bent on some days of
# the month, of all symbols or of every fifth one
_BENT = {"close": 3, "swap": 7, "volume": 11, "open": 15}
_TURN = {"close": 0, "swap": 1, "volume": 2, "open": 3}


def bent_panel(spark, sf):
    df = unit_price_panel(spark, sf)
    number = F.substring("symbol", 2, 20).cast("int") % 5
    on = lambda what: (
        (F.dayofmonth("date") == _BENT[what]) & ((number == _TURN[what]) | (number == 4))
    )
    return df.withColumns(
        {
            "close": F.when(on("close"), -F.col("close")).otherwise(F.col("close")),
            "high": F.when(on("swap"), F.col("low")).otherwise(F.col("high")),
            "low": F.when(on("swap"), F.col("high")).otherwise(F.col("low")),
            "volume": F.when(on("volume"), -F.col("volume")).otherwise(F.col("volume")),
            "open": F.when(on("open"), F.col("high") * 2).otherwise(F.col("open")),
        }
    )


def _sql_bent(what: str) -> str:
    number = "CAST(substr(symbol, 2) AS INTEGER) % 5"
    return f"day(date) = {_BENT[what]} AND ({number} = {_TURN[what]} OR {number} = 4)"


SQL_BENT = f"""bent AS MATERIALIZED (SELECT symbol, date,
  CASE WHEN {_sql_bent("open")} THEN high * 2 ELSE open END AS open,
  CASE WHEN {_sql_bent("swap")} THEN low ELSE high END AS high,
  CASE WHEN {_sql_bent("swap")} THEN high ELSE low END AS low,
  CASE WHEN {_sql_bent("close")} THEN -close ELSE close END AS close,
  CASE WHEN {_sql_bent("volume")} THEN -volume ELSE volume END AS volume FROM dense)"""


@query(
    "quality_checks",
    with_ctes(
        [SQL_UNIT, SQL_BARS, SQL_DENSE, SQL_BENT, sql_quality("bent")],
        """SELECT symbol, n_pos AS n_price_positivity, n_hl AS n_high_low_consistency,
  n_vol AS n_volume_non_negative, n_rel AS n_ohlc_relationships,
  n_ext AS n_extreme_price_movements, total_rows_checked,
  concat_ws(',', CASE WHEN n_pos > 0 THEN 'price_positivity' END,
    CASE WHEN n_hl > 0 THEN 'high_low_consistency' END,
    CASE WHEN n_vol > 0 THEN 'volume_non_negative' END,
    CASE WHEN n_rel > 0 THEN 'ohlc_relationships' END,
    CASE WHEN n_ext > 0 THEN 'extreme_price_movements' END) AS failed_checks FROM qual""",
    ),
)
def quality_checks(spark, sf):
    panel = bent_panel(spark, sf)
    counts = Q.quality_counts(panel, QualityRules()).drop("_present", "_warnings", "total_rows_checked")
    failed = Q.quality_report(panel).select(
        "symbol", "total_rows_checked", F.concat_ws(",", "failed_checks").alias("failed_checks")
    )
    return counts.join(failed, "symbol")
