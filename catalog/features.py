"""Panel features, one query per group, plus the assembled table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import P, ctes_rets, day, panel, rd, returns, sql_rd, table, with_ctes  # noqa: F401
from tidemark.operators import features as FE

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _w(name, n):
    return f"{name} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(expr, x, n, w):
    """Value only when the n-row frame is complete."""
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {expr} END"


#: Marks a quotient of any size: rounded in units of its own size, as a small divisor magnifies both.
SIZED = "sized"


def sized(c):
    size = F.abs(c)
    unit = F.when(size < 1e3, 1.0).when(size < 1e6, 1e3).when(size < 1e9, 1e6).otherwise(1e9)
    return rd(F.col(c) / unit, 4) * unit


def sql_sized(c):
    unit = (
        f"(CASE WHEN abs({c}) < 1e3 THEN 1e0 WHEN abs({c}) < 1e6 THEN 1e3 "
        f"WHEN abs({c}) < 1e9 THEN 1e6 ELSE 1e9 END)"
    )
    return f"({sql_rd(f'{c} / {unit}', 4)}) * {unit}"


def rounded(df, spec, keys=("symbol", "date")):
    """Keys plus rounded columns; spec maps a column to its digits, (digits, factor) or SIZED."""
    out = []
    for c, d in spec.items():
        if d == SIZED:
            out.append(sized(c).alias(c))
            continue
        digits, factor = d if isinstance(d, tuple) else (d, 1.0)
        out.append(rd(F.col(c) * factor if factor != 1.0 else F.col(c), digits).alias(c))
    return df.select("symbol", day(), *out)


def sql_rounded(src, spec):
    cols = []
    for c, d in spec.items():
        if d == SIZED:
            cols.append(f"{sql_sized(c)} AS {c}")
            continue
        digits, factor = d if isinstance(d, tuple) else (d, 1.0)
        cols.append(f"{sql_rd(f'{c} * {factor}' if factor != 1.0 else c, digits)} AS {c}")
    return f"SELECT symbol, CAST(date AS VARCHAR) AS date, {', '.join(cols)} FROM {src}"


def feature_query(name, ctes, src, spec, build):
    @query(name, with_ctes(ctes, sql_rounded(src, spec)))
    def run(spark, sf):
        return rounded(build(spark, sf), spec)


def group(name, extra=()):
    return lambda spark, sf: FE.feature_group(panel(spark, sf), name, P, extra=tuple(extra))


# --- returns -----------------------------------------------------------------------------

feature_query(
    "returns_target",
    [*ctes_rets(), "o AS (SELECT symbol, date, r AS log_returns_d, y AS y_log_returns,"
     " rr AS log_returns_ratio, dv AS dollar_volume FROM rets)"],
    "o",
    {"log_returns_d": 9, "y_log_returns": 9, "log_returns_ratio": 9, "dollar_volume": 2},
    lambda spark, sf: FE.feature_group(panel(spark, sf), "basic", P, extra=("dollar_volume",)),
)

SQL_UPDN = """ud AS (SELECT *, CASE WHEN r > 0 THEN r ELSE 0.0 END AS up,
  CASE WHEN r < 0 THEN -r ELSE 0.0 END AS dn FROM rets)"""

SQL_STRENGTH = f"""st AS (SELECT symbol, date,
  {full("avg(r) OVER w / (stddev_samp(dn) OVER w + 1e-8)", "r", 12, "w")} AS sortino_ratio,
  {full("sum(r) OVER w / (stddev_samp(r) OVER w + 1e-8)", "r", 12, "w")} AS sharpe_ratio_proxy
  FROM ud WINDOW {_w("w", 12)})"""

feature_query(
    "sortino_sharpe",
    [*ctes_rets(), SQL_UPDN, SQL_STRENGTH],
    "st",
    {"sortino_ratio": 6, "sharpe_ratio_proxy": 6},
    group("basic"),
)

SQL_MOMENTUM = f"""mo AS (SELECT symbol, date,
  {full("sum(r) OVER w15", "r", 15, "w15")} - {full("sum(r) OVER w9", "r", 9, "w9")}
    AS long_short_momentum,
  {full("(sum(up) OVER w15 - sum(dn) OVER w15) / (sum(up) OVER w15 + sum(dn) OVER w15 + 1e-8) * 100",
        "up", 15, "w15")} AS cmo
  FROM ud WINDOW {_w("w15", 15)}, {_w("w9", 9)})"""

feature_query(
    "momentum_cmo",
    [*ctes_rets(), SQL_UPDN, SQL_MOMENTUM],
    "mo",
    {"long_short_momentum": 9, "cmo": 6},
    group("momentum"),
)

SQL_LIQUIDITY = f"""lq0 AS (SELECT *, abs(r) / (dv + 1e-8) AS imp FROM rets),
lq AS (SELECT symbol, date, {full("avg(imp) OVER w9", "imp", 9, "w9")} AS amihud_illiq,
  dv / ({full("avg(dv) OVER w15", "dv", 15, "w15")} + 1e-12) AS turnover_proxy
  FROM lq0 WINDOW {_w("w15", 15)}, {_w("w9", 9)})"""

feature_query(
    "liquidity",
    [*ctes_rets(), SQL_LIQUIDITY],
    "lq",
    {"amihud_illiq": (3, 1e9), "turnover_proxy": 6},
    group("liquidity"),
)

# --- statistics ----------------------------------------------------------------------------


def _sql_moments(n):
    w = f"w{n}"
    m, m2, m3 = (f"avg(r{'' if k == 1 else k}) OVER {w}" for k in (1, 2, 3))
    varies = f"count(r) OVER {w} = {n} AND max(r) OVER {w} > min(r) OVER {w}"
    skew = (
        f"({m3} - 3 * {m} * {m2} + 2 * pow({m}, 3)) / pow({m2} - pow({m}, 2), 1.5)"
    )
    return (
        f"CASE WHEN {varies} THEN kurtosis_pop(r) OVER {w} END AS k{n}, "
        f"CASE WHEN {varies} THEN {skew} END AS s{n}, "
        f"CASE WHEN count(r) OVER {w} = {n} THEN (r - avg(r) OVER {w}) "
        f"/ (stddev_samp(r) OVER {w} + 1e-8) END AS z{n}"
    )


SQL_STATS = f"""pw AS (SELECT *, r * r AS r2, r * r * r AS r3 FROM rets),
sm AS (SELECT symbol, date, {_sql_moments(15)}, {_sql_moments(9)}
  FROM pw WINDOW {_w("w15", 15)}, {_w("w9", 9)}),
ss AS (SELECT symbol, date, k15 AS long_kurtosis, k9 AS short_kurtosis, s15 AS long_skew,
  s9 AS short_skew, z15 AS long_zscore, z9 AS short_zscore,
  k15 / (k9 + 1e-8) AS kurtosis_ratio,
  s15 / (s9 + 1e-8) AS skew_ratio,
  z15 / (z9 + 1e-8) AS zscore_ratio FROM sm)"""

_PARTS = ["long_kurtosis", "short_kurtosis", "long_skew", "short_skew", "long_zscore", "short_zscore"]


_stats = group("statistical", _PARTS)

feature_query(
    "stat_moments",
    [*ctes_rets(), SQL_STATS],
    "ss",
    {**{c: 6 for c in _PARTS[:4]}, "kurtosis_ratio": SIZED, "skew_ratio": SIZED},
    _stats,
)
feature_query(
    "zscore",
    [*ctes_rets(), SQL_STATS],
    "ss",
    {**{c: 6 for c in _PARTS[4:]}, "zscore_ratio": SIZED},
    _stats,
)

SQL_AUTOCORR = f"""ac0 AS (SELECT symbol, date, r * r AS a,
  lag(r * r, 3) OVER (PARTITION BY symbol ORDER BY date) AS b FROM rets),
ac1 AS (SELECT symbol, date, CASE WHEN count(b) OVER w3 = 3 AND max(a) OVER w3 > min(a) OVER w3
    AND max(b) OVER w3 > min(b) OVER w3 THEN corr(a, b) OVER w3 END AS c
  FROM ac0 WINDOW {_w("w3", 3)}),
ac AS (SELECT symbol, date, CASE WHEN c IS NULL OR isnan(c) THEN 0.0
  ELSE greatest(least(c, 1.0), -1.0) END AS autocorr_r2 FROM ac1)"""

feature_query(
    "autocorr_r2", [*ctes_rets(), SQL_AUTOCORR], "ac", {"autocorr_r2": 6}, group("statistical")
)

SQL_IQR = f"""iq AS (SELECT symbol, date, CASE WHEN count(r) OVER w12 = 12 THEN
  list_sort(list(r) OVER w12)[11] - list_sort(list(r) OVER w12)[2] END AS iqr_vol
  FROM rets WINDOW {_w("w12", 12)})"""

feature_query("iqr_vol", [*ctes_rets(), SQL_IQR], "iq", {"iqr_vol": 9}, group("statistical"))

# --- exponentially weighted ------------------------------------------------------------------


def _q(span):
    return f"(1 - CAST(2 AS DOUBLE) / {span + 1})"


def _sql_ewm(span, x, alias):
    """Weighted mean by its definition: a self-join on the row distance."""
    return (
        f"sum(o.{x} * pow({_q(span)}, e.k - o.k)) / sum(pow({_q(span)}, e.k - o.k)) AS {alias}"
    )


SQL_RSI = f"""rs0 AS (SELECT e.symbol, e.date, {_sql_ewm(12, "up", "u")}, {_sql_ewm(12, "dn", "d")}
  FROM ud e JOIN ud o ON o.symbol = e.symbol AND o.k <= e.k GROUP BY e.symbol, e.date),
rsi AS (SELECT symbol, date, 100 - 100 / (1 + u / (d + 1e-8)) AS rsi_ewm FROM rs0)"""

feature_query("rsi_ewm", [*ctes_rets(), SQL_UPDN, SQL_RSI], "rsi", {"rsi_ewm": 6}, group("basic"))


def _sql_ewm_var(span, p):
    w = f"pow({_q(span)}, e.k - o.k)"
    return (
        f"sum(o.r * {w}) / sum({w}) AS m{p}, sum(o.r * o.r * {w}) / sum({w}) AS s{p}, "
        f"sum({w}) AS w{p}, sum(pow({_q(span)}, 2 * (e.k - o.k))) AS v{p}"
    )


SQL_VOL = f"""ev AS (SELECT e.symbol, e.date, e.k, {_sql_ewm_var(15, "l")}, {_sql_ewm_var(9, "s")}
  FROM rets e JOIN rets o ON o.symbol = e.symbol AND o.k <= e.k
  WHERE e.r IS NOT NULL AND o.r IS NOT NULL GROUP BY e.symbol, e.date, e.k),
es AS (SELECT symbol, date, k,
  CASE WHEN k = 1 THEN 0.0 ELSE sqrt(greatest(sl - ml * ml, 0) * wl * wl / (wl * wl - vl)) END AS lv,
  CASE WHEN k = 1 THEN 0.0 ELSE sqrt(greatest(ss - ms * ms, 0) * ws * ws / (ws * ws - vs)) END AS sv
  FROM ev),
vo AS (SELECT f.symbol, f.date, f.k, lag(lv) OVER w AS long_vol_ewm, lag(sv) OVER w AS short_vol_ewm
  FROM rets f LEFT JOIN es ON es.symbol = f.symbol AND es.k = f.k
  WINDOW w AS (PARTITION BY f.symbol ORDER BY f.date)),
vf AS (SELECT symbol, date, long_vol_ewm, short_vol_ewm,
  CASE WHEN short_vol_ewm <> 0 THEN long_vol_ewm / short_vol_ewm + 1e-8 END AS vol_ratio,
  {full("stddev_samp(short_vol_ewm) OVER w15", "short_vol_ewm", 15, "w15")} AS vol_of_vol_ewm,
  long_vol_ewm / (lag(long_vol_ewm, 15) OVER w + 1e-8) AS vol_expansion
  FROM vo WINDOW w AS (PARTITION BY symbol ORDER BY date), {_w("w15", 15)})"""


_vol = group("volatility", ("long_vol_ewm", "short_vol_ewm"))

feature_query(
    "ewm_volatility",
    [*ctes_rets(), SQL_VOL],
    "vf",
    {"long_vol_ewm": 7, "short_vol_ewm": 7, "vol_ratio": SIZED},
    _vol,
)
feature_query(
    "vol_features",
    [*ctes_rets(), SQL_VOL],
    "vf",
    {"vol_of_vol_ewm": 7, "vol_expansion": SIZED},
    _vol,
)
SQL_RISK = """ra AS (SELECT mo.symbol, mo.date, long_short_momentum / (long_vol_ewm + 1e-8) AS risk_adj_momentum
  FROM mo JOIN vf ON vf.symbol = mo.symbol AND vf.date = mo.date)"""

feature_query(
    "risk_adj_momentum",
    [*ctes_rets(), SQL_UPDN, SQL_MOMENTUM, SQL_VOL, SQL_RISK],
    "ra",
    {"risk_adj_momentum": SIZED},
    group("momentum"),
)

# --- channels ----------------------------------------------------------------------------------


def _mid(n):
    return full(f"(max(high) OVER w{n} + min(low) OVER w{n}) / 2", "high", n, f"w{n}")


SQL_CHANNEL = f"""ch0 AS (SELECT *, {_mid(6)} AS tenkan, {_mid(9)} AS kijun, {_mid(12)} AS span_b_now,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
  FROM rets WINDOW {_w("w6", 6)}, {_w("w9", 9)}, {_w("w12", 12)}),
ch1 AS (SELECT *, (tenkan + kijun) / 2 AS span_a_now FROM ch0),
ch2 AS (SELECT *, greatest(span_a_now, span_b_now) AS cloud_top_now,
    least(span_a_now, span_b_now) AS cloud_bot_now,
    lag(span_a_now, 9) OVER w AS la, lag(span_b_now, 9) OVER w AS lb,
    {full("avg(tr) OVER w6", "tr", 6, "w6")} + 1e-8 AS atr
  FROM ch1 WINDOW w AS (PARTITION BY symbol ORDER BY date), {_w("w6", 6)}),
ch AS (SELECT *, (close - cloud_top_now) / atr AS price_above_cloud_atr,
    (cloud_bot_now - close) / atr AS price_below_cloud_atr,
    (tenkan - kijun) / atr AS tenkan_kijun_spread_atr,
    abs(span_a_now - span_b_now) / atr AS cloud_thickness_atr,
    (close - greatest(la, lb)) / atr AS price_vs_lead_top_atr,
    (close - least(la, lb)) / atr AS price_vs_lead_bot_atr FROM ch2)"""

CTES_CHANNEL = [*ctes_rets(), SQL_CHANNEL]
_LINES = ["tenkan", "kijun", "span_a_now", "span_b_now", "cloud_top_now", "cloud_bot_now"]

feature_query(
    "channel_lines", CTES_CHANNEL, "ch", {c: 6 for c in _LINES}, group("channel", _LINES)
)

_ATR = ["price_above_cloud_atr", "price_below_cloud_atr", "tenkan_kijun_spread_atr",
        "cloud_thickness_atr", "price_vs_lead_top_atr", "price_vs_lead_bot_atr"]


feature_query(
    "channel_atr", CTES_CHANNEL, "ch", {"atr": 6, **{c: SIZED for c in _ATR}}, group("channel")
)

_SLOPES = {"tenkan_slope": "tenkan", "kijun_slope": "kijun", "span_a_slope": "span_a_now",
           "span_b_slope": "span_b_now", "cloud_top_slope": "cloud_top_now",
           "cloud_bot_slope": "cloud_bot_now"}
feature_query(
    "channel_slopes",
    [*CTES_CHANNEL, "sl AS (SELECT symbol, date, "
     + ", ".join(f"({x} - lag({x}, 6) OVER w) / 6 AS {n}" for n, x in _SLOPES.items())
     + " FROM ch WINDOW w AS (PARTITION BY symbol ORDER BY date))"],
    "sl",
    {c: 6 for c in _SLOPES},
    group("channel"),
)

SQL_REGIME = f"""rg0 AS (SELECT *, CAST(close > cloud_top_now AS INTEGER) AS above_cloud,
    CAST(close >= cloud_bot_now AND close <= cloud_top_now AS INTEGER) AS between_cloud,
    CAST(close < cloud_bot_now AS INTEGER) AS below_cloud,
    CAST(tenkan > kijun AND lag(tenkan) OVER w <= lag(kijun) OVER w AS INTEGER) AS tenkan_cross_up,
    CAST(tenkan < kijun AND lag(tenkan) OVER w >= lag(kijun) OVER w AS INTEGER) AS tenkan_cross_dn,
    CAST(close > cloud_top_now AND lag(close) OVER w <= lag(cloud_top_now) OVER w AS INTEGER)
      AS price_break_up,
    CAST(close < cloud_bot_now AND lag(close) OVER w >= lag(cloud_bot_now) OVER w AS INTEGER)
      AS price_break_dn,
    CAST((span_a_now - span_b_now) * (lag(span_a_now) OVER w - lag(span_b_now) OVER w) < 0 AS INTEGER)
      AS twist_event
  FROM ch WINDOW w AS (PARTITION BY symbol ORDER BY date)),
rgm AS (SELECT *, {full("avg(above_cloud) OVER w9", "above_cloud", 9, "w9")} AS above_cloud_persist,
    {full("avg(below_cloud) OVER w9", "below_cloud", 9, "w9")} AS below_cloud_persist,
    {full("sum(twist_event) OVER w9", "twist_event", 9, "w9")} AS twist_recent,
    tenkan_kijun_spread_atr * above_cloud AS bull_strength,
    (kijun - tenkan) / atr * below_cloud AS bear_strength
  FROM rg0 WINDOW {_w("w9", 9)})"""
CTES_REGIME = [*CTES_CHANNEL, SQL_REGIME]
_STRENGTH = ["bull_strength", "bear_strength"]

feature_query(
    "channel_regime",
    CTES_REGIME,
    "rgm",
    {
        **{c: 6 for c in ("above_cloud", "between_cloud", "below_cloud", "above_cloud_persist",
                          "below_cloud_persist")},
        **{c: SIZED for c in _STRENGTH},
    },
    group("channel"),
)
feature_query(
    "channel_crosses",
    CTES_REGIME,
    "rgm",
    {c: 0 for c in ["tenkan_cross_up", "tenkan_cross_dn", "price_break_up", "price_break_dn"]},
    group("channel"),
)
feature_query(
    "channel_twist", CTES_REGIME, "rgm", {"twist_event": 0, "twist_recent": 0}, group("channel")
)

# --- the whole table ------------------------------------------------------------------------------

# all 56 columns
_QUOTIENTS = ["kurtosis_ratio", "skew_ratio", "zscore_ratio", "risk_adj_momentum", "vol_ratio", "vol_expansion",
              *_ATR, *_STRENGTH]
TABLE = {
    **{c: 6 for c in ("open", "high", "low", "close")},
    **{c: 0 for c in ("volume", "year", "month", "day_of_week", "day_of_year")},
    **{c: 9 for c in ("log_returns_d", "log_returns_ratio", "y_log_returns", "iqr_vol")},
    **{c: 6 for c in ("rsi_ewm", "sortino_ratio", "sharpe_ratio_proxy", "turnover_proxy", "cmo")},
    "amihud_illiq": (3, 1e9),
    "autocorr_r2": 6,
    "long_short_momentum": 9,
    "vol_of_vol_ewm": 7,
    **{c: 6 for c in (*_SLOPES, "above_cloud_persist", "below_cloud_persist", "atr")},
    **{
        c: 0
        for c in ("above_cloud", "between_cloud", "below_cloud", "tenkan_cross_up",
                  "tenkan_cross_dn", "price_break_up", "price_break_dn", "twist_event",
                  "twist_recent")
    },
    **{c: SIZED for c in _QUOTIENTS},
}
SQL_SLOPES = (
    "sl AS (SELECT symbol, date, "
    + ", ".join(f"({x} - lag({x}, 6) OVER w) / 6 AS {n}" for n, x in _SLOPES.items())
    + " FROM ch WINDOW w AS (PARTITION BY symbol ORDER BY date))"
)
SQL_TABLE = f"""ft AS (SELECT a.symbol, a.date, a.open, a.high, a.low, a.close, a.volume,
  year(a.date) AS year, month(a.date) AS month, isodow(a.date) AS day_of_week,
  dayofyear(a.date) AS day_of_year, a.r AS log_returns_d, a.rr AS log_returns_ratio,
  a.y AS y_log_returns, rsi.rsi_ewm, st.sortino_ratio, st.sharpe_ratio_proxy, lq.amihud_illiq,
  lq.turnover_proxy, ac.autocorr_r2, iq.iqr_vol, mo.long_short_momentum, mo.cmo, vf.vol_of_vol_ewm,
  {", ".join(f"sl.{c}" for c in _SLOPES)}, g.above_cloud, g.between_cloud, g.below_cloud,
  g.above_cloud_persist, g.below_cloud_persist, g.tenkan_cross_up, g.tenkan_cross_dn,
  g.price_break_up, g.price_break_dn, g.twist_event, g.twist_recent, g.atr,
  ss.kurtosis_ratio, ss.skew_ratio, ss.zscore_ratio, ra.risk_adj_momentum, vf.vol_ratio, vf.vol_expansion,
  {", ".join(f"g.{c}" for c in [*_ATR, *_STRENGTH])}
  FROM rets a JOIN st USING (symbol, date) JOIN lq USING (symbol, date)
  JOIN ac USING (symbol, date) JOIN iq USING (symbol, date) JOIN mo USING (symbol, date)
  JOIN vf USING (symbol, date) JOIN rgm g USING (symbol, date) JOIN sl USING (symbol, date)
  JOIN rsi USING (symbol, date) JOIN ss USING (symbol, date) JOIN ra USING (symbol, date))"""
CTES_TABLE = [
    # every group reads these, so they are worked out once
    *[c.replace("rets AS (", "rets AS MATERIALIZED (", 1) for c in CTES_REGIME],
    SQL_UPDN, SQL_STRENGTH, SQL_LIQUIDITY, SQL_AUTOCORR, SQL_IQR, SQL_MOMENTUM, SQL_VOL, SQL_RSI,
    SQL_STATS, SQL_RISK, SQL_SLOPES, SQL_TABLE,
]

feature_query(
    "feature_table", CTES_TABLE, "ft", TABLE,
    lambda spark, sf: FE.build_features(panel(spark, sf), P),
)


def _assembled(spark, sf):
    from tidemark.session import checkpoint

    p = checkpoint(panel(spark, sf))
    parts = ("basic", "liquidity", "statistical", "momentum", "volatility", "channel")
    return FE.assemble_features(*[FE.feature_group(p, g, P) for g in parts])


feature_query("feature_assembly_join", CTES_TABLE, "ft", TABLE, _assembled)
