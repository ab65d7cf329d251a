"""Technical features of a panel, computed in one shuffle.

`prepare` sorts each symbol once (fill, drop, row number, target) and cuts it
into chunks with a run-up. Every feature group then adds columns over the
same (symbol, chunk) window, so `build_features` runs all groups over one
exchange and never joins. Each group is also usable alone; `assemble_features`
joins separately computed group tables on (symbol, date).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import ChannelParams, FeatureParams
from tidemark.functions import windows
from tidemark.functions.scalars import sdiv
from tidemark.functions.windows import (
    Ewm,
    PanelWindow,
    Series,
    correlation,
    ewm_weight,
    moments_from_sums,
    rolling,
    std_from_sums,
    with_chunks,
)
from tidemark.operators.timeline import filled_panel, within_horizon

EPS = 1e-8
_BY_SYMBOL = PanelWindow(("symbol",), "date")
_BY_CHUNK = PanelWindow(("symbol", "_chunk"), "date")

GROUP_COLUMNS = {
    "basic": [
        "log_returns_d",
        "log_returns_ratio",
        "y_log_returns",
        "rsi_ewm",
        "sortino_ratio",
        "sharpe_ratio_proxy",
    ],
    "liquidity": ["amihud_illiq", "turnover_proxy"],
    "statistical": ["kurtosis_ratio", "skew_ratio", "zscore_ratio", "autocorr_r2", "iqr_vol"],
    "momentum": ["long_short_momentum", "cmo", "risk_adj_momentum"],
    "volatility": ["vol_ratio", "vol_of_vol_ewm", "vol_expansion"],
    "channel": [
        "tenkan_slope",
        "kijun_slope",
        "span_a_slope",
        "span_b_slope",
        "cloud_top_slope",
        "cloud_bot_slope",
        "above_cloud",
        "between_cloud",
        "below_cloud",
        "above_cloud_persist",
        "below_cloud_persist",
        "tenkan_cross_up",
        "tenkan_cross_dn",
        "price_break_up",
        "price_break_dn",
        "twist_event",
        "twist_recent",
        "bull_strength",
        "bear_strength",
        "tenkan_kijun_spread_atr",
        "price_above_cloud_atr",
        "price_below_cloud_atr",
        "cloud_thickness_atr",
        "price_vs_lead_top_atr",
        "price_vs_lead_bot_atr",
        "atr",
    ],
}
BASE_COLUMNS = [
    "symbol",
    "date",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "year",
    "month",
    "day_of_week",
    "day_of_year",
]
FEATURE_TABLE = BASE_COLUMNS + [c for cols in GROUP_COLUMNS.values() for c in cols]


def prepare(panel: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Filled panel with log close, target and chunk columns.

    The target looks ahead, so it is taken here, before chunking. The chunk
    run-up covers every look-back that follows.
    """
    filled = filled_panel(panel).withColumn("_ln", F.ln("close"))
    ahead = filled.withColumn(
        "y_log_returns", _BY_SYMBOL.lead("_ln", p.horizon) - F.col("_ln")
    ).withColumn("_pos", F.row_number().over(_BY_SYMBOL.spec) - 1)
    size = windows.chunks_for(p.spans, p.look_back)
    chunked = with_chunks(ahead, "_pos", size)
    # row number inside the chunk, the clock of the EWM weights
    start = F.greatest(F.col("_chunk") * size.rows - size.run_up, F.lit(0))
    return chunked.withColumn("_k", F.col("_pos") - start)


def finish(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop the run-up rows and internal columns."""
    return df.where(~F.col("_run_up")).select(*columns)


def add_returns(df: DataFrame, p: FeatureParams) -> DataFrame:
    """Dollar volume, daily log return, lagged log difference and the true range."""
    w = _BY_CHUNK
    df = df.withColumns(
        {
            "dollar_volume": F.col("close") * F.col("volume"),
            "log_returns_d": F.col("_ln") - w.lag("_ln", 1),
            "log_returns_ratio": w.lag("_ln", p.short_window) - w.lag("_ln", p.long_window),
            "_prev_close": w.lag("close"),
            "_u_basic": ewm_weight(p.basic_window),
            "_u_long": ewm_weight(p.long_window),
            "_u_short": ewm_weight(p.short_window),
        }
    )
    r = F.col("log_returns_d")
    return df.withColumns(
        {
            # the missing first return counts as neither gain nor loss
            "_gain": F.when(r > 0, r).otherwise(F.lit(0.0)),
            "_loss": F.when(r < 0, -r).otherwise(F.lit(0.0)),
            "_true_range": F.greatest(
                F.col("high") - F.col("low"),
                F.abs(F.col("high") - F.col("_prev_close")),
                F.abs(F.col("low") - F.col("_prev_close")),
            ),
        }
    )


# --- rolling series each group needs -------------------------------------------


def _return_powers(*windows: int) -> dict[str, Series]:
    r = F.col("log_returns_d")
    return {
        "_r1": Series(r, windows),
        "_r2": Series(r * r, windows),
        "_r3": Series(r * r * r, windows),
        "_r4": Series(r * r * r * r, windows),
    }


def strength_series(p: FeatureParams) -> dict[str, Series]:
    r, loss, n = F.col("log_returns_d"), F.col("_loss"), p.basic_window
    return {
        "_b1": Series(r, (n,)),
        "_b2": Series(r * r, (n,)),
        "_l1": Series(loss, (n,)),
        "_l2": Series(loss * loss, (n,)),
    }


def momentum_series(p: FeatureParams) -> dict[str, Series]:
    r = F.col("log_returns_d")
    return {
        "_m": Series(r, (p.short_window, p.long_window)),
        "_gains": Series(F.col("_gain"), (p.long_window,)),
        "_losses": Series(F.col("_loss"), (p.long_window,)),
    }


def liquidity_series(p: FeatureParams) -> dict[str, Series]:
    impact = sdiv(F.abs("log_returns_d"), F.col("dollar_volume") + EPS)
    return {
        "_impact": Series(impact, (p.short_window,)),
        "_dv": Series(F.col("dollar_volume"), (p.long_window,)),
    }


def statistics_series(p: FeatureParams) -> dict[str, Series]:
    r = F.col("log_returns_d")
    return {
        **_return_powers(p.short_window, p.long_window),
        "_rl": Series(r, (2 * p.horizon, p.iqr_window), "list"),
    }


def channel_series(c: ChannelParams) -> dict[str, Series]:
    lines = (c.p1, c.p2, c.p3)
    return {
        "_hi": Series(F.col("high"), lines, "max"),
        "_lo": Series(F.col("low"), lines, "min"),
        "_tr": Series(F.col("_true_range"), (c.atr_n,)),
    }


# --- columns computed from the rolled series -----------------------------------


def ewm_columns(p: FeatureParams) -> dict[str, Column]:
    """Running EWM sums: RSI and the two return deviations (before their one-row lag)."""
    gain = Ewm(_BY_CHUNK, p.basic_window, "_u_basic").mean(F.col("_gain"))
    loss = Ewm(_BY_CHUNK, p.basic_window, "_u_basic").mean(F.col("_loss"))
    r = F.col("log_returns_d")
    return {
        "rsi_ewm": 100.0 - 100.0 / (1.0 + gain / (loss + EPS)),
        "_long_std": Ewm(_BY_CHUNK, p.long_window, "_u_long").std(r),
        "_short_std": Ewm(_BY_CHUNK, p.short_window, "_u_short").std(r),
    }


def strength_columns(p: FeatureParams) -> dict[str, Column]:
    """Sortino: mean over loss deviation; Sharpe proxy: sum over deviation."""
    n = p.basic_window
    s1, s2 = F.col(f"_b1_{n}"), F.col(f"_b2_{n}")
    loss_std = std_from_sums(F.col(f"_l1_{n}"), F.col(f"_l2_{n}"), n)
    return {
        "sortino_ratio": s1 / n / (loss_std + EPS),
        "sharpe_ratio_proxy": s1 / (std_from_sums(s1, s2, n) + EPS),
    }


def lagged_volatility(p: FeatureParams) -> dict[str, Column]:
    """EWM deviations known the day before. The lag stays inside the symbol."""
    w = _BY_CHUNK
    return {
        "long_vol_ewm": w.lag("_long_std"),
        "short_vol_ewm": w.lag("_short_std"),
        "_long_vol_before": w.lag("_long_std", 1 + p.long_window),
    }


def volatility_series(p: FeatureParams) -> dict[str, Series]:
    v = F.col("short_vol_ewm")
    return {"_v1": Series(v, (p.long_window,)), "_v2": Series(v * v, (p.long_window,))}


def volatility_columns(p: FeatureParams) -> dict[str, Column]:
    n = p.long_window
    return {
        # the constant is added to the quotient, as the feature is defined
        "vol_ratio": sdiv(F.col("long_vol_ewm"), F.col("short_vol_ewm")) + EPS,
        "vol_of_vol_ewm": std_from_sums(F.col(f"_v1_{n}"), F.col(f"_v2_{n}"), n),
        "vol_expansion": F.col("long_vol_ewm") / (F.col("_long_vol_before") + EPS),
    }


def momentum_columns(p: FeatureParams) -> dict[str, Column]:
    """Long minus short momentum, the Chande oscillator, momentum per unit of volatility."""
    n = p.long_window
    gains, losses = F.col(f"_gains_{n}"), F.col(f"_losses_{n}")
    spread = F.col(f"_m_{n}") - F.col(f"_m_{p.short_window}")
    return {
        "long_short_momentum": spread,
        "cmo": (gains - losses) / (gains + losses + EPS) * 100.0,
        "risk_adj_momentum": spread / (F.col("long_vol_ewm") + EPS),
    }


def liquidity_columns(p: FeatureParams) -> dict[str, Column]:
    """Amihud illiquidity and turnover against its own average."""
    mean_dv = F.col(f"_dv_{p.long_window}") / p.long_window
    return {
        "amihud_illiq": F.col(f"_impact_{p.short_window}") / p.short_window,
        "turnover_proxy": sdiv(F.col("dollar_volume"), mean_dv + 1e-12),
    }


def statistics_parts(p: FeatureParams) -> dict[str, Column]:
    """Kurtosis, skewness and z-score over both windows, before their ratios."""
    out = {}
    for name, n in (("long", p.long_window), ("short", p.short_window)):
        s1, s2, s3, s4 = (F.col(f"_r{k}_{n}") for k in (1, 2, 3, 4))
        out[f"{name}_skew"], out[f"{name}_kurtosis"] = moments_from_sums(s1, s2, s3, s4, n)
        out[f"{name}_zscore"] = (F.col("log_returns_d") - s1 / n) / (
            std_from_sums(s1, s2, n) + EPS
        )
    sorted_returns = F.sort_array(F.col(f"_rl_{p.iqr_window}"))
    rank = lambda tau: int((p.iqr_window - 1) * tau + 0.5)
    recent = F.col(f"_rl_{2 * p.horizon}")
    # a missing return in the window sorts first, so the first element tells
    complete = F.get(sorted_returns, F.lit(0)).isNotNull()
    iqr = F.get(sorted_returns, F.lit(rank(0.90))) - F.get(sorted_returns, F.lit(rank(0.10)))
    squares = [F.pow(F.get(recent, F.lit(i)), F.lit(2.0)) for i in range(2 * p.horizon)]
    out["iqr_vol"] = F.when(complete, iqr)
    out["_corr_r2"] = correlation(squares[: p.horizon], squares[p.horizon :])
    return out


def statistics_columns() -> dict[str, Column]:
    ratio = lambda m: sdiv(F.col(f"long_{m}"), F.col(f"short_{m}") + EPS)
    corr = F.col("_corr_r2")
    bounded = F.greatest(F.least(corr, F.lit(1.0)), F.lit(-1.0))
    return {
        "kurtosis_ratio": ratio("kurtosis"),
        "skew_ratio": ratio("skew"),
        "zscore_ratio": ratio("zscore"),
        # greatest/least skip NULL, so a missing correlation must be caught first
        "autocorr_r2": F.when(corr.isNull(), F.lit(0.0)).otherwise(bounded),
    }


def channel_lines(c: ChannelParams) -> list[dict[str, Column]]:
    """Mid-range lines, then the cloud edges and the padded average true range."""
    mid = lambda n: (F.col(f"_hi_{n}") + F.col(f"_lo_{n}")) / 2
    return [
        {"tenkan": mid(c.p1), "kijun": mid(c.p2), "span_b_now": mid(c.p3)},
        {"span_a_now": (F.col("tenkan") + F.col("kijun")) / 2},
        {
            "cloud_top_now": F.greatest("span_a_now", "span_b_now"),
            "cloud_bot_now": F.least("span_a_now", "span_b_now"),
            "atr": F.col(f"_tr_{c.atr_n}") / c.atr_n + EPS,
        },
    ]


def channel_distances(c: ChannelParams) -> dict[str, Column]:
    """Price, line and cloud distances in units of the true range; the lead cloud is p2 rows old."""
    w, close, atr = _BY_CHUNK, F.col("close"), F.col("atr")
    lead_a, lead_b = w.lag("span_a_now", c.p2), w.lag("span_b_now", c.p2)
    return {
        "price_above_cloud_atr": (close - F.col("cloud_top_now")) / atr,
        "price_below_cloud_atr": (F.col("cloud_bot_now") - close) / atr,
        "tenkan_kijun_spread_atr": (F.col("tenkan") - F.col("kijun")) / atr,
        "cloud_thickness_atr": F.abs(F.col("span_a_now") - F.col("span_b_now")) / atr,
        "price_vs_lead_top_atr": (close - F.greatest(lead_a, lead_b)) / atr,
        "price_vs_lead_bot_atr": (close - F.least(lead_a, lead_b)) / atr,
    }


def channel_signals(c: ChannelParams) -> dict[str, Column]:
    """Slopes, regime flags, crossings, breakouts and the twist of the cloud."""
    w, n = _BY_CHUNK, c.slope_window
    close, top, bot = F.col("close"), F.col("cloud_top_now"), F.col("cloud_bot_now")
    tenkan, kijun = F.col("tenkan"), F.col("kijun")
    flag = lambda cond: cond.cast("byte")
    slope = lambda x: (F.col(x) - w.lag(x, n)) / n
    span_diff = F.col("span_a_now") - F.col("span_b_now")
    return {
        "tenkan_slope": slope("tenkan"),
        "kijun_slope": slope("kijun"),
        "span_a_slope": slope("span_a_now"),
        "span_b_slope": slope("span_b_now"),
        "cloud_top_slope": slope("cloud_top_now"),
        "cloud_bot_slope": slope("cloud_bot_now"),
        "above_cloud": flag(close > top),
        "between_cloud": flag((close >= bot) & (close <= top)),
        "below_cloud": flag(close < bot),
        "tenkan_cross_up": flag((tenkan > kijun) & (w.lag("tenkan") <= w.lag("kijun"))),
        "tenkan_cross_dn": flag((tenkan < kijun) & (w.lag("tenkan") >= w.lag("kijun"))),
        "price_break_up": flag((close > top) & (w.lag("close") <= w.lag("cloud_top_now"))),
        "price_break_dn": flag((close < bot) & (w.lag("close") >= w.lag("cloud_bot_now"))),
        "twist_event": flag(
            span_diff * (w.lag("span_a_now") - w.lag("span_b_now")) < 0
        ),
    }


def persistence_series(c: ChannelParams) -> dict[str, Series]:
    n = (c.persist_window,)
    return {
        x: Series(F.col(x).cast("double"), n) for x in ("above_cloud", "below_cloud", "twist_event")
    }


def persistence_columns(c: ChannelParams) -> dict[str, Column]:
    n = c.persist_window
    return {
        "above_cloud_persist": F.col(f"above_cloud_{n}") / n,
        "below_cloud_persist": F.col(f"below_cloud_{n}") / n,
        "twist_recent": F.col(f"twist_event_{n}"),
        "bull_strength": F.col("tenkan_kijun_spread_atr") * F.col("above_cloud"),
        "bear_strength": (F.col("kijun") - F.col("tenkan")) / F.col("atr") * F.col("below_cloud"),
    }


# --- assembly --------------------------------------------------------------------


def add_groups(
    df: DataFrame, p: FeatureParams, groups: set[str], channel: ChannelParams | None = None
) -> DataFrame:
    """All columns of the named groups on a frame from `add_returns`.

    The groups share two rolling passes: one over the raw series and one over
    the series derived from it (lagged volatility, regime flags).
    """
    w, c = _BY_CHUNK, channel or p.channel
    needs_vol = bool({"volatility", "momentum"} & groups)
    first: dict[str, Series] = {}
    if needs_vol or "basic" in groups:
        df = df.withColumns(ewm_columns(p))
    if needs_vol:
        df = df.withColumns(lagged_volatility(p))
    for name, series in (
        ("basic", strength_series),
        ("momentum", momentum_series),
        ("liquidity", liquidity_series),
        ("statistical", statistics_series),
    ):
        if name in groups:
            first.update(series(p))
    if "channel" in groups:
        first.update(channel_series(c))
    if first:
        df = rolling(df, w, first)
    if "basic" in groups:
        df = df.withColumns(strength_columns(p))
    if "momentum" in groups:
        df = df.withColumns(momentum_columns(p))
    if "liquidity" in groups:
        df = df.withColumns(liquidity_columns(p))
    if "statistical" in groups:
        df = df.withColumns(statistics_parts(p)).withColumns(statistics_columns())
    second: dict[str, Series] = {}
    if "channel" in groups:
        for level in channel_lines(c):
            df = df.withColumns(level)
        df = df.drop(*[f"{n}_{k}" for n, s in first.items() for k in s.windows])
        df = df.withColumns({**channel_distances(c), **channel_signals(c)})
        second.update(persistence_series(c))
    if "volatility" in groups:
        second.update(volatility_series(p))
    if second:
        df = rolling(df, w, second)
    if "channel" in groups:
        df = df.withColumns(persistence_columns(c))
    if "volatility" in groups:
        df = df.withColumns(volatility_columns(p))
    return df


def build_features(
    panel: DataFrame, p: FeatureParams = FeatureParams(), *, apply_horizon: bool = False
) -> DataFrame:
    """The whole feature table of a panel with one row per (symbol, date)."""
    if apply_horizon:
        panel = within_horizon(panel, p.past_horizon)
    df = add_groups(add_returns(prepare(panel, p), p), p, set(GROUP_COLUMNS))
    return finish(df, FEATURE_TABLE)


def returns_table(panel: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Daily return and target only, the narrow input of splits, baselines and drift checks."""
    df = add_returns(prepare(panel, p), p)
    return finish(df, ["symbol", "date", "log_returns_d", "y_log_returns"])


def feature_group(
    panel: DataFrame,
    name: str,
    p: FeatureParams = FeatureParams(),
    *,
    channel: ChannelParams | None = None,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """One group's columns keyed by (symbol, date), plus named intermediate columns."""
    if name not in GROUP_COLUMNS:
        raise ValueError(f"unknown group {name!r}")
    df = add_groups(add_returns(prepare(panel, p), p), p, {name}, channel)
    base = BASE_COLUMNS if name == "basic" else ["symbol", "date"]
    return finish(df, [*base, *GROUP_COLUMNS[name], *extra])


def assemble_features(*tables: DataFrame) -> DataFrame:
    """Inner join of group tables on (symbol, date); keys missing anywhere are dropped.

    For tables that come from different jobs. All joins share one key, so each
    side is shuffled once.
    """
    return reduce(lambda a, b: a.join(b, ["symbol", "date"], "inner"), tables)
