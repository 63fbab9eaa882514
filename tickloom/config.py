"""Operator settings. Every value is folded into the plan as a literal."""

from __future__ import annotations

from dataclasses import dataclass


# Defaults that results depend on.
@dataclass(frozen=True)
class CotSettings:
    short_ratio_threshold: float = 0.20
    anomaly_multiplier: float = 3.0
    volatility_window: int = 20
    change_lookback: int = 8


@dataclass(frozen=True)
class VolumePriceSettings:
    volume_spike_threshold: float = 5.0
    price_drop_threshold: float = -0.03
    lookback_window: int = 20
    contamination: float = 0.05
    trees: int = 200
    sample_rows: int = 256


@dataclass(frozen=True)
class ProfileSettings:
    num_bins: int = 50
    value_area_pct: float = 0.70
    lookback: int = 40


@dataclass(frozen=True)
class BankSettings:
    concentration_threshold: float = 0.50
    usd_strength_window: int = 10
    usd_strength_threshold: float = 0.02


@dataclass(frozen=True)
class StudySettings:
    stop_loss: float = 0.05
    take_profit: float = 0.10
    commission_pct: float = 0.001
    slippage_pct: float = 0.0005
    atr_multiplier: float = 3.0
    horizon: int = 60


@dataclass(frozen=True)
class RiskSettings:
    atr_period: int = 14
    atr_multiplier: float = 3.0
    risk_per_trade: float = 0.02
    max_position_pct: float = 0.25
    kelly_fraction: float = 0.5
    max_drawdown_pct: float = 0.15
    recovery_threshold: float = 0.05


@dataclass(frozen=True)
class CombinerSettings:
    sma_fast: int = 50
    sma_slow: int = 200
    trend_weight: float = 0.70
    shield_weight: float = 0.30
    manipulation_danger: float = -0.35
    extreme_danger: float = -0.55
    cot_weight: float = 0.40
    vp_weight: float = 0.35
    bank_weight: float = 0.25
    smc_weight: float = 0.45
    wyckoff_weight: float = 0.40
    debate_weight: float = 0.35
    real_flow_weight: float = 0.50
    qmf_weight: float = 0.25
    rsi_period: int = 14
    rsi_overbought: float = 75.0
    rsi_oversold: float = 25.0
    adx_threshold: float = 20.0
    buy_threshold: float = 0.45
    sell_threshold: float = -0.45
    require_real_flow: bool = True


@dataclass(frozen=True)
class SmcSettings:
    impulse_multiplier: float = 1.5
    ob_lookback: int = 3
    ob_max_zones: int = 5
    fvg_min_size_pct: float = 0.002
    fvg_fill_threshold: float = 0.90
    fvg_max_zones: int = 5
    liq_tolerance_pct: float = 0.3
    liq_max_pools: int = 3
    score_threshold: float = 0.25


@dataclass(frozen=True)
class WyckoffSettings:
    tr_lookback: int = 60
    tr_atr_ratio: float = 0.6
    tr_min_touches: int = 3
    spring_penetration: float = 0.005
    spring_max_penetration: float = 0.03
    spring_volume_ratio: float = 0.8
    spring_recovery_bars: int = 3
    sos_volume_multiplier: float = 1.5
    sos_spread_percentile: float = 75.0
    stopping_vol_multiplier: float = 2.0
    stopping_spread_percentile: float = 30.0
    no_supply_vol_ratio: float = 0.5
    shakeout_drop_pct: float = -0.02
    shakeout_recovery_pct: float = 0.01
    evr_lookback: int = 20
    lps_pullback_atr_mult: float = 1.0
    lps_volume_ratio: float = 0.7
    ma_long_period: int = 200
    score_smoothing: int = 5


@dataclass(frozen=True)
class StochasticSettings:
    k_period: int = 14
    d_period: int = 3
    slowing: int = 3
    overbought: float = 80.0
    oversold: float = 20.0


@dataclass(frozen=True)
class ForecastSettings:
    horizons: tuple[int, ...] = (1, 21, 42, 63, 126)
    train_rows: int | None = None
    min_rows: int = 50
    confidence_threshold: float = 0.25
