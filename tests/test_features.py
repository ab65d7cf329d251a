import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import random_walk
from tidemark.config import ChannelParams, FeatureParams
from tidemark.functions import windows
from tidemark.functions.windows import PanelWindow, Series, rolling
from tidemark.operators import features as FE

P = FeatureParams()


def collect(df):
    return df.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)


@pytest.fixture
def two(make_panel):
    return make_panel({"A": random_walk(1, 120), "B": random_walk(2, 120)})


def expected(closes):
    """The main features of one symbol, in pandas."""
    c = pd.Series(closes)
    r = np.log(c).diff()
    up, dn = r.clip(lower=0).fillna(0), (-r).clip(lower=0).fillna(0)
    rs = up.ewm(span=12).mean() / (dn.ewm(span=12).mean() + 1e-8)
    vol = r.ewm(span=9).std()
    vol.iloc[1] = 0.0
    vol = vol.shift(1)
    z = lambda n: (r - r.rolling(n).mean()) / (r.rolling(n).std() + 1e-8)
    a = r.rolling(15)
    m = a.mean()
    m2 = a.apply(lambda x: ((x - x.mean()) ** 2).mean())
    return pd.DataFrame(
        {
            "log_returns_d": r,
            "y_log_returns": np.log(c).shift(-3) - np.log(c),
            "rsi_ewm": 100 - 100 / (1 + rs),
            "sharpe_ratio_proxy": r.rolling(12).sum() / (r.rolling(12).std() + 1e-8),
            "sortino_ratio": r.rolling(12).mean() / (dn.rolling(12).std() + 1e-8),
            "vol_of_vol_ewm": vol.rolling(15).std(),
            "zscore_ratio": z(15) / (z(9) + 1e-8),
            "cmo": (up - dn).rolling(15).sum() / ((up + dn).rolling(15).sum() + 1e-8) * 100,
            "long_skew": a.apply(lambda x: ((x - x.mean()) ** 3).mean()) / m2**1.5 + 0 * m,
        }
    )


def test_features_match_pandas(two):
    got = collect(FE.build_features(two))
    stats = collect(FE.feature_group(two, "statistical", extra=("long_skew",)))
    got["long_skew"] = stats["long_skew"]
    for symbol, seed in (("A", 1), ("B", 2)):
        mine = got[got.symbol == symbol].reset_index(drop=True)
        want = expected(random_walk(seed, 120))
        for c in want:
            np.testing.assert_allclose(mine[c].astype(float), want[c], rtol=1e-6, atol=1e-9, err_msg=c)
    assert list(got.columns)[:-1] == FE.FEATURE_TABLE
    assert len(FE.FEATURE_TABLE) == 56


def test_no_leak_between_symbols_or_from_the_future(two):
    full = collect(FE.build_features(two))
    alone = collect(FE.build_features(two.where("symbol = 'A'")))
    pd.testing.assert_frame_equal(full[full.symbol == "A"].reset_index(drop=True), alone)
    cut = collect(FE.build_features(two.where(F.col("date") < F.lit("2023-03-15"))))
    head = full.merge(cut[["symbol", "date"]], on=["symbol", "date"])
    features = [c for c in FE.FEATURE_TABLE if c != "y_log_returns"]
    pd.testing.assert_frame_equal(head[features], cut[features])


def test_groups_join_to_the_whole_table(two):
    parts = [FE.feature_group(two, g) for g in FE.GROUP_COLUMNS]
    joined = collect(FE.assemble_features(*parts).select(*FE.FEATURE_TABLE))
    pd.testing.assert_frame_equal(joined, collect(FE.build_features(two)))
    fewer = FE.assemble_features(parts[0], parts[1].where("symbol = 'A'"))
    assert fewer.count() == 120


@pytest.mark.parametrize(
    "p",
    [
        FeatureParams(1),
        FeatureParams(3),
        FeatureParams(20),
        FeatureParams(5, short=3, long=10),
        FeatureParams(2, short=2, long=3, channel_windows=ChannelParams(5, 10, 15, 5, 3, 5)),
    ],
    ids=["h1", "h3", "h20", "h5-3-10", "h2-2-3"],
)
def test_ewm_of_any_window_and_length_of_symbol(make_panel, monkeypatch, p):
    """EWM columns match pandas on a long symbol, and shorter chunks change no feature."""
    size = windows.chunks_for(p.spans, p.look_back)
    n = max(1500, size.rows // 2)
    closes = random_walk(5, n)
    panel = make_panel({"A": closes, "B": random_walk(6, 300)})
    columns = ["symbol", "date", "rsi_ewm", "short_vol_ewm", "long_vol_ewm", "vol_of_vol_ewm"]
    volatility = ["vol_ratio", "vol_expansion"]

    def built():
        df = FE.add_groups(FE.add_returns(FE.prepare(panel, p), p), p, set(FE.GROUP_COLUMNS))
        return collect(FE.finish(df, [*columns, *volatility, "cmo", "atr", "iqr_vol"]))

    whole = built()
    shorter = windows.Chunks(size.run_up + 7, size.run_up)
    monkeypatch.setattr(windows, "chunks_for", lambda *_: shorter)
    chunked = built()
    monkeypatch.undo()
    pd.testing.assert_frame_equal(whole, chunked, rtol=1e-8, atol=1e-12)

    r = np.log(pd.Series(closes)).diff()
    up, down = r.clip(lower=0).fillna(0), (-r).clip(lower=0).fillna(0)
    mean = lambda x: x.ewm(span=p.basic_window).mean()

    def deviation(span):
        std = r.ewm(span=span).std()
        std.iloc[1] = 0.0
        return std.shift(1)

    want = {
        "rsi_ewm": 100 - 100 / (1 + mean(up) / (mean(down) + 1e-8)),
        "short_vol_ewm": deviation(p.short_window),
        "long_vol_ewm": deviation(p.long_window),
        "vol_of_vol_ewm": deviation(p.short_window).rolling(p.long_window).std(),
    }
    mine = whole[whole.symbol == "A"].reset_index(drop=True)
    for c, x in want.items():
        np.testing.assert_allclose(mine[c].astype(float), x, rtol=1e-6, atol=1e-9, err_msg=c)
    assert np.isfinite(mine[volatility].iloc[2 * p.long_window + 3 :].astype(float)).all().all()


def test_spans_too_far_apart_are_refused():
    with pytest.raises(ValueError):
        windows.chunks_for([3, 500], 20)
    assert windows.chunks_for([1], 20).run_up == 20


def test_flat_prices_give_no_errors(make_panel):
    got = collect(FE.build_features(make_panel({"A": [100.0] * 40})))
    last = got.iloc[-1]
    assert last.autocorr_r2 == 0.0 and last.sharpe_ratio_proxy == 0.0 and last.cmo == 0.0
    assert pd.isna(last.vol_ratio) and pd.isna(last.kurtosis_ratio)
    assert last.between_cloud in (0, 1)


def test_dollar_volume_and_short_history(spark, make_panel):
    got = collect(FE.feature_group(make_panel({"A": [100.0, 105.0, 102.0]}), "basic", extra=("dollar_volume",)))
    assert list(got.dollar_volume) == [100.0 * 1000, 105.0 * 1001, 102.0 * 1002]
    assert pd.isna(got.log_returns_d[0]) and got.log_returns_d[1] > 0 > got.log_returns_d[2]
    assert got.sharpe_ratio_proxy.isna().all()


def test_rolling_handles_missing_rows_and_any_window(spark):
    x = [1.0, 4.0, None, 2.0, 8.0, 5.0, 7.0, 1.0, 3.0, 9.0]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)], "symbol string, date int, x double")
    spec = {"s": Series(F.col("x"), (2, 5)), "m": Series(F.col("x"), (3,), "max"), "l": Series(F.col("x"), (4,), "min")}
    got = rolling(df, PanelWindow(), spec).toPandas().sort_values("date")
    p = pd.Series(x, dtype=float)
    for c, want in {"s_2": p.rolling(2).sum(), "s_5": p.rolling(5).sum(), "m_3": p.rolling(3).max(), "l_4": p.rolling(4).min()}.items():
        np.testing.assert_allclose(got[c].astype(float), want, err_msg=c)


def test_one_exchange_for_all_features(two):
    plan = FE.build_features(two)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1
    assert "Join" not in plan and "Python" not in plan
