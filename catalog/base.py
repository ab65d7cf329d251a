"""Inputs shared by the queries, and the same inputs as SQL.

The tables hold no quotes, so trades stand in for them: a line item is a
trade at `p_retailprice * (1 - l_discount)`, its supplier (fine panel) or the
supplier's nation (dense panel) is the symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import add_returns, finish, prepare
from tidemark.config import FeatureParams
from tidemark.operators.models import HistoricalQuantiles
from tidemark.operators.splits import with_holdout_split
from tidemark.operators.timeline import densify
from tidemark.session import checkpoint
from tidemark.sources.bars import make_bars

TAUS = [0.1, 0.25, 0.5, 0.75, 0.9]
FRACTIONS = (0.6, 0.1, 0.2, 0.1)
MID_DATE = "1998-06-01"
P = FeatureParams()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rd(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison. The tiny offset keeps exact ties away from the rounding edge."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + 3.7e-10, digits) + 0.0


def sql_rd(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 3.7e-10, {digits}) + 0.0"


def day(c: str = "date") -> Column:
    return F.col(c).cast("string").alias(c)


def trades(spark: SparkSession, sf: str, kind: str = "nation") -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_shipdate",
    )
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    out = li.join(part, li.l_partkey == part.p_partkey)
    if kind == "nation":
        sup = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
        out = out.join(sup, out.l_suppkey == sup.s_suppkey)
        symbol = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
    else:
        symbol = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    return out.withColumn("symbol", symbol).withColumn(
        "price", F.col("p_retailprice") * (1 - F.col("l_discount"))
    )


TIE_BREAK = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_extendedprice",
    "l_quantity",
    "l_suppkey",
]


def bars(spark: SparkSession, sf: str, kind: str = "nation") -> DataFrame:
    return make_bars(
        trades(spark, sf, kind),
        symbol="symbol",
        ts="l_shipdate",
        price="price",
        quantity="l_quantity",
        tie_break=TIE_BREAK,
    )


def panel(spark: SparkSession, sf: str, kind: str = "nation") -> DataFrame:
    return densify(bars(spark, sf, kind), unique=True)


def returns(spark: SparkSession, sf: str, kind: str = "nation") -> DataFrame:
    df = add_returns(prepare(panel(spark, sf, kind), P), P)
    return finish(
        df,
        ["symbol", "date", "close", "volume", "log_returns_d", "log_returns_ratio", "y_log_returns"],
    )


def split_returns(spark: SparkSession, sf: str) -> DataFrame:
    labelled = returns(spark, sf).select("symbol", "date", "log_returns_d", "y_log_returns")
    # read twice: once for the dates, once for the rows
    labelled = checkpoint(labelled.where("y_log_returns is not null"))
    return with_holdout_split(labelled, fractions=FRACTIONS)


def forecasts(spark: SparkSession, sf: str, group: str | None = "symbol") -> DataFrame:
    """Baseline forecasts (fit on train and val) on the rows of cal and test."""
    rows = split_returns(spark, sf)
    fitted = HistoricalQuantiles(TAUS, group).fit(
        rows.where("split in ('train', 'val')"), "y_log_returns"
    )
    return fitted.predict(rows.where("split in ('cal', 'test')"))


# --- the same inputs as SQL ------------------------------------------------------------


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def sql_trades(kind: str = "nation") -> str:
    if kind == "nation":
        symbol, extra = "'N' || s_nationkey", "JOIN supplier ON l_suppkey = s_suppkey"
    else:
        symbol, extra = "'S' || l_suppkey", ""
    return f"""trades AS (
  SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS date,
         p_retailprice * (1 - l_discount) AS price, l_quantity AS qty,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity,
             l_suppkey) AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey {extra})"""


SQL_BARS = """bars AS (
  SELECT symbol, date, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, ord) AS close, CAST(sum(qty) AS BIGINT) AS volume
  FROM trades GROUP BY symbol, date)"""

SQL_DENSE = """cal AS (
  SELECT symbol, CAST(unnest(generate_series(mn, mx, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT symbol, min(date) AS mn, max(date) AS mx FROM bars GROUP BY symbol)),
dense AS (
  SELECT c.date, c.symbol, b.open, b.high, b.low, b.close, b.volume
  FROM cal c LEFT JOIN bars b ON b.symbol = c.symbol AND b.date = c.date)"""

SQL_FILLED = """filled AS (
  SELECT symbol, date, last_value(open IGNORE NULLS) OVER w AS open,
         last_value(high IGNORE NULLS) OVER w AS high,
         last_value(low IGNORE NULLS) OVER w AS low,
         last_value(close IGNORE NULLS) OVER w AS close,
         last_value(volume IGNORE NULLS) OVER w AS volume
  FROM dense
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

SQL_RETS = """rets AS (
  SELECT *, close * volume AS dv,
         row_number() OVER w - 1 AS k,
         ln(close) - lag(ln(close), 1) OVER w AS r,
         lead(ln(close), 3) OVER w - ln(close) AS y,
         lag(ln(close), 9) OVER w - lag(ln(close), 15) OVER w AS rr,
         lag(close, 1) OVER w AS pc
  FROM filled WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def ctes_panel(kind: str = "nation") -> list[str]:
    return [sql_trades(kind), SQL_BARS, SQL_DENSE]


def ctes_rets(kind: str = "nation") -> list[str]:
    return [*ctes_panel(kind), SQL_FILLED, SQL_RETS]


SQL_SPLIT = """lab AS (SELECT symbol, date, r, y FROM rets WHERE y IS NOT NULL),
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
         FROM (SELECT DISTINCT date FROM lab)),
cuts AS (SELECT
  max(CASE WHEN i = CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) - 1 THEN date END) AS c1,
  max(CASE WHEN i = CAST(floor(n * (CAST(0.6 AS DOUBLE) + CAST(0.1 AS DOUBLE))) AS BIGINT) - 1
      THEN date END) AS c2,
  max(CASE WHEN i = CAST(floor(n * (CAST(0.6 AS DOUBLE) + CAST(0.1 AS DOUBLE)
      + CAST(0.2 AS DOUBLE))) AS BIGINT) - 1 THEN date END) AS c3
  FROM days),
seg AS (SELECT l.*, CASE WHEN date <= c1 THEN 'train' WHEN date <= c2 THEN 'val'
               WHEN date <= c3 THEN 'cal' ELSE 'test' END AS s FROM lab l, cuts),
b AS (SELECT min(date) FILTER (WHERE s = 'val') - 5 AS v0,
             max(date) FILTER (WHERE s = 'val') + 10 AS v1,
             min(date) FILTER (WHERE s = 'cal') - 5 AS k0,
             max(date) FILTER (WHERE s = 'cal') + 10 AS k1,
             min(date) FILTER (WHERE s = 'test') - 5 AS t0,
             max(date) FILTER (WHERE s = 'test') + 10 AS t1 FROM seg),
splits AS (SELECT symbol, date, r, y, CASE
    WHEN s = 'train' AND ((date < v1 AND date + 5 > v0) OR (date < k1 AND date + 5 > k0)
                          OR (date < t1 AND date + 5 > t0)) THEN 'purged'
    WHEN s IN ('val', 'cal') AND date < t1 AND date + 5 > t0 THEN 'purged'
    ELSE s END AS split FROM seg, b)"""


def sql_forecasts(group: str | None = "symbol") -> str:
    levels = "[" + ", ".join(str(t) for t in TAUS) + "]"
    if group:
        fit = f"""fit AS (SELECT symbol, quantile_cont(y, {levels}) AS q FROM splits
      WHERE split IN ('train', 'val') GROUP BY symbol),
ovr AS (SELECT quantile_cont(y, {levels}) AS q FROM splits WHERE split IN ('train', 'val')),"""
        src = (
            "SELECT s.symbol, s.date, s.r, s.y, s.split, coalesce(f.q, g.q) AS q "
            "FROM splits s LEFT JOIN fit f ON f.symbol = s.symbol, ovr g"
        )
    else:
        fit = f"""ovr AS (SELECT quantile_cont(y, {levels}) AS q FROM splits
      WHERE split IN ('train', 'val')),"""
        src = "SELECT s.symbol, s.date, s.r, s.y, s.split, g.q AS q FROM splits s, ovr g"
    return f"""{fit}
fc AS (SELECT symbol, date, r, y, split, q, q[1] AS q1, q[2] AS q2, q[3] AS q3, q[4] AS q4,
              q[5] AS q5 FROM ({src}) WHERE split IN ('cal', 'test'))"""


def ctes_forecasts(group: str | None = "symbol") -> list[str]:
    return [*ctes_rets(), SQL_SPLIT, sql_forecasts(group)]
