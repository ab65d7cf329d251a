"""Parameters of every stage, as frozen dataclasses.

Windows are derived from one forecast horizon, so changing `horizon` rescales
the whole feature set consistently.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# File layout of the ticker and metadata files.
TICKER_COLUMNS = ["Symbol", "Name", "Country", "IPO Year", "Sector", "Industry"]
METADATA_COLUMNS = ["symbol", "last_ingestion", "max_date_recorded", "status"]
BAR_COLUMNS = ["date", "symbol", "open", "high", "low", "close", "volume"]
PRICE_COLUMNS = ["open", "high", "low", "close"]

# The accepted bar intervals and look-back periods of a collection plan.
INTERVALS = ["1m", "2m", "5m", "15m", "30m", "60m", "90m", "1h", "1d", "5d", "1wk", "1mo", "3mo"]
PERIODS = ["1d", "5d", "1mo", "3mo", "6mo", "1y", "2y", "5y", "10y", "ytd", "max"]

# Model inputs, by group, with the number of principal components kept per group.
FEATURE_GROUPS = {
    "FINANCIAL_FEATURES": (
        3,
        ["log_returns_d", "log_returns_ratio", "rsi_ewm", "sortino_ratio", "sharpe_ratio_proxy"],
    ),
    "LIQUIDITY_FEATURES": (1, ["amihud_illiq", "turnover_proxy"]),
    "STATISTICAL_FEATURES": (
        4,
        ["kurtosis_ratio", "skew_ratio", "zscore_ratio", "autocorr_r2", "iqr_vol"],
    ),
    "MOMENTUM_INDICATORS_FEATURES": (1, ["long_short_momentum", "cmo", "risk_adj_momentum"]),
    "VOLATILITY_MEASURES_FEATURES": (1, ["vol_ratio", "vol_of_vol_ewm", "vol_expansion"]),
    "ICHIMOKU_SLOPE_FEATURES": (
        4,
        [
            "tenkan_slope",
            "kijun_slope",
            "span_a_slope",
            "span_b_slope",
            "cloud_top_slope",
            "cloud_bot_slope",
        ],
    ),
    "ICHIMOKU_POSITIONAL_FEATURES": (
        3,
        [
            "above_cloud",
            "between_cloud",
            "below_cloud",
            "above_cloud_persist",
            "below_cloud_persist",
        ],
    ),
    "ICHIMOKU_CROSSOVER_FEATURES": (
        3,
        [
            "tenkan_cross_up",
            "tenkan_cross_dn",
            "price_break_up",
            "price_break_dn",
            "twist_event",
            "twist_recent",
        ],
    ),
    "ICHIMOKU_STRENGTH_FEATURES": (1, ["bull_strength", "bear_strength"]),
    "ICHIMOKU_ATR_FEATURES": (
        2,
        [
            "tenkan_kijun_spread_atr",
            "price_above_cloud_atr",
            "price_below_cloud_atr",
            "cloud_thickness_atr",
            "price_vs_lead_top_atr",
            "price_vs_lead_bot_atr",
        ],
    ),
}
PASSTHROUGH_FEATURES = ["month", "day_of_week", "day_of_year", "atr"]
GROUPED_FEATURES = [c for _, cols in FEATURE_GROUPS.values() for c in cols]
MODEL_FEATURES = (
    ["symbol", "month", "day_of_week", "day_of_year"] + GROUPED_FEATURES + ["atr"]
)


@dataclass(frozen=True)
class ChannelParams:
    p1: int = 6
    p2: int = 9
    p3: int = 12
    atr_n: int = 6
    slope_window: int = 6
    persist_window: int = 9


@dataclass(frozen=True)
class FeatureParams:
    """Window lengths in rows. Those not given are derived from the forecast horizon."""

    # fixed values
    horizon: int = 3
    past_horizon: int = 7 * 280
    short: int | None = None
    long: int | None = None
    channel_windows: ChannelParams | None = None

    @property
    def short_window(self) -> int:
        return 3 * self.horizon if self.short is None else self.short

    @property
    def long_window(self) -> int:
        return 5 * self.horizon if self.long is None else self.long

    @property
    def basic_window(self) -> int:
        return (self.short_window + self.long_window) // 2

    @property
    def iqr_window(self) -> int:
        return 4 * self.horizon

    @property
    def channel(self) -> ChannelParams:
        h = self.horizon
        return self.channel_windows or ChannelParams(2 * h, 3 * h, 4 * h, 2 * h, 2 * h, 3 * h)

    @property
    def spans(self) -> list[int]:
        """Of the exponentially weighted columns."""
        return [self.basic_window, self.long_window, self.short_window]

    @property
    def look_back(self) -> int:
        """Rows that no chain of frames and lags reaches beyond."""
        c = self.channel
        frames = 2 * self.long_window + self.short_window + self.basic_window + self.iqr_window
        return frames + c.p1 + c.p2 + c.p3 + c.atr_n + c.slope_window + c.persist_window + 8


@dataclass(frozen=True)
class QualityRules:
    """Which checks run on a symbol, with their tolerances."""

    required_columns: bool = True
    price_positivity: bool = True
    high_low_consistency: bool = True
    volume_non_negative: bool = True
    ohlc_relationships: bool = True
    extreme_price_movements: bool = True
    max_daily_price_change_ratio: float = 10.0
    min_required_data_points: int = 1
    on_failure: str = "exclude"
    price_tolerance: float = 1e-8

    def __post_init__(self) -> None:
        if self.on_failure not in ("exclude", "warn"):
            raise ValueError("on_failure must be 'exclude' or 'warn'")
        if self.max_daily_price_change_ratio <= 0 or self.price_tolerance <= 0:
            raise ValueError("ratio and tolerance must be positive")
        if self.min_required_data_points < 1:
            raise ValueError("min_required_data_points must be at least 1")


@dataclass(frozen=True)
class BoostParams:
    """Boosted trees for several quantiles."""

    # fixed values
    quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)
    rounds: int = 1_000
    learning_rate: float = 0.02
    depth: int = 5
    l2: float = 20.0
    borders: int = 255
    temperature: float = 0.5
    patience: int = 80
    seed: int = 1
    #: Of the mergeable quantile sketches: ranks are off by at most a part in so many.
    accuracy: int = 10_000

    def __post_init__(self) -> None:
        if not 1 <= self.borders <= 255:
            raise ValueError("bins of a feature must fit in a byte")
        if self.depth < 1 or self.learning_rate <= 0 or self.l2 < 0:
            raise ValueError("depth and learning rate must be positive, l2 not negative")


@dataclass(frozen=True)
class ModelParams:
    """Quantile model, split and calibration settings."""

    quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)
    target: str = "y_log_returns"
    target_coverage: float = 0.8
    time_span: int = 7 * 28
    fractions: tuple[float, float, float, float] = (0.6, 0.1, 0.2, 0.1)
    split_horizon_days: int = 5
    num_trees: int = 20
    tree_step: int = 5
    max_depth: int = 5
    max_bins: int = 64
    min_instances: int = 20
    sketch_accuracy: int = 10_000
    seed: int = 1
    features: list[str] = field(default_factory=lambda: list(MODEL_FEATURES))

    @property
    def alpha(self) -> float:
        return round(1.0 - self.target_coverage, 12)

    @property
    def quantile_indices(self) -> dict[str, int]:
        return {"LOW": 0, "MID": len(self.quantiles) // 2, "HIGH": len(self.quantiles) - 1}
