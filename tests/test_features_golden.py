"""Feature contract: names, order hash and golden values of the deterministic 60-bar snapshot."""

import math

from pyspark.sql import functions as F

from tickloom.operators import features83

FIRST, SECOND = "S01", "S00"     # the reference symbols' places in the snapshot
HASH = "2dc278b4353585fe22503233187e12832cabfd67e2a2e58f4cd683ee6f3b9454"

# The added features of the first symbol on the snapshot built below (tolerance 1e-12).
GOLDEN = {
    "breakdown_proxy_12": 0.0,
    "breakdown_proxy_24": 0.0,
    "btc_trend_proxy": 1.0,
    "btc_volatility_12": 0.002312912106761548,
    "close_below_rolling_low_12": 0.0,
    "close_below_rolling_low_24": 0.0,
    "close_vs_ema_12": -0.001740518566665905,
    "close_vs_ema_24": -0.003654325631913813,
    "close_vs_ema_48": -0.006897938663653513,
    "close_vs_ema_6": -0.0007739946483242832,
    "consecutive_green_count": 0.0,
    "consecutive_red_count": 60.0,
    "distance_to_rolling_high_12": 0.005179154799425872,
    "distance_to_rolling_high_24": 0.009097981913653698,
    "distance_to_rolling_low_12": 0.0007041558691756401,
    "distance_to_rolling_low_24": 0.0007041558691756401,
    "downside_momentum_6": -0.0019231749082233573,
    "ema_slope_24": -0.0009584803671177644,
    "ema_slope_6": -0.0009465187022508204,
    "eth_trend_proxy": 1.0,
    "eth_volatility_12": 0.0023930485935927245,
    "exhaustion_down_proxy": 0.005537210325058586,
    "extension_down_proxy": 0.003654325631913813,
    "failed_breakdown_proxy": 1.0,
    "fake_breakdown_risk_proxy": 1.0,
    "high_vol_regime_proxy": 0.0,
    "high_wick_reclaim_risk_proxy": 0.0,
    "immediate_reversal_risk_proxy": 0.0,
    "low_room_to_fall_risk_proxy": 1.0,
    "low_vol_regime_proxy": 1.0,
    "overextended_down_risk_proxy": 0.0,
    "rebound_risk_proxy": 0.0,
    "rolling_range_std_12": 4.2716641232875746e-05,
    "rolling_range_std_24": 4.152572683787197e-05,
    "room_to_fall_proxy_24": 0.0007041558691756401,
    "squeeze_plus_reclaim_risk_proxy": 0.0,
    "squeeze_risk_proxy_causal": 0.0,
    "trend_compression": 0.002893134526864239,
    "trend_stack_long": 0.0,
    "trend_stack_short": 1.0,
    "upside_momentum_6": 0.0,
    "volatility_compression_12_24": 0.997839418915713,
    "volume_spike_12": 0.0,
    "volume_trend_12": 0.011352885525070855,
}


# The constants of the 60-bar input that the golden values belong to.
def snapshot():
    rows, step = [], 5 * 60 * 1_000_000
    for s in range(11):
        base, drift = 10.0 + 3.0 * s, (s - 5) * 0.00008
        for i in range(60):
            o = base * (1.0 + drift * i)
            c = o * (1.0 + drift + ((i % 5) - 2) * 0.00003)
            rows.append((f"S{s:02d}", i * step, o, max(o, c) * 1.001, min(o, c) * 0.999, c, 1000.0 + 10 * s + i))
    return rows


SCHEMA = "symbol string, ts long, open double, high double, low double, close double, volume double"


def test_names_and_hash():
    assert len(features83.NAMES_V1) == 39 and len(features83.NAMES_V2) == 44
    assert features83.names_hash() == HASH


def test_golden_values(frame):
    d = features83.features(frame(snapshot(), SCHEMA), FIRST, SECOND, block=16)
    last = d.filter(F.col("symbol") == FIRST).orderBy("ts").collect()[-1].asDict()
    off = {k: (last[k], v) for k, v in GOLDEN.items() if not math.isclose(last[k], v, rel_tol=0.0, abs_tol=1e-12)}
    assert not off


def test_future_bars_do_not_change_the_past(frame):
    rows = snapshot()
    cut = 55 * 5 * 60 * 1_000_000
    wild = [(s, t, o * 3, h * 9, l / 2, c * 5, v * 7) if t > cut else (s, t, o, h, l, c, v) for s, t, o, h, l, c, v in rows]
    a, b = (sorted(tuple(r) for r in features83.features(frame(x, SCHEMA), FIRST, SECOND).filter(f"ts <= {cut}").collect()) for x in (rows, wild))
    assert a == b and len(a) == 11 * 9
