"""Sequential kernels and structure logic against plain loops over small series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import collect, to_bars, walk
from tickloom.config import SmcSettings, VolumePriceSettings
from tickloom.functions import series
from tickloom.operators import elliott, flow, joins, ml, retests, risk, smc


@pytest.fixture(scope="module")
def noisy():
    return pd.concat([walk(260, s, f"S{s}", vol=0.03) for s in range(4)], ignore_index=True)


def swing_flags(g):
    n = len(g)
    hi, lo = g.high.to_numpy(), g.low.to_numpy()
    sh, sl = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(3, n - 3):
        sh[i] = hi[i] == hi[i - 3:i + 4].max() and hi[i] > hi[i - 1] and hi[i] > hi[i + 1]
        sl[i] = lo[i] == lo[i - 3:i + 4].min() and lo[i] < lo[i - 1] and lo[i] < lo[i + 1]
    return sh, sl


@pytest.mark.parametrize("block", [32, 2048])
def test_structure_breaks_follow_the_fold(spark, noisy, block, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", block)
    got = collect(smc.market_structure(to_bars(spark, noisy)), "symbol", "bar_no")
    for sym, g in noisy.groupby("symbol"):
        g = g.reset_index(drop=True)
        sh, sl = swing_flags(g)
        level_h = level_l = direction = None
        want = []
        for i in range(1, len(g)):
            level_h = g.high[i] if sh[i] else level_h
            level_l = g.low[i] if sl[i] else level_l
            if level_h is not None and g.close[i] > level_h:
                want.append((i, "choch" if direction == "bear" else "bos_bull"))
                direction, level_h = "bull", None
            elif level_l is not None and g.close[i] < level_l:
                want.append((i, "choch" if direction == "bull" else "bos_bear"))
                direction, level_l = "bear", None
        mine = got[got.symbol == sym]
        have = [(int(r.bar_no), k) for r in mine.itertuples() for k in ("bos_bull", "bos_bear", "choch") if getattr(r, f"smc_{k}")]
        assert have == want
        minor_h = minor_l = None
        idm_bull, idm_bear = [], []
        for i in range(5, len(g)):
            minor_l = g.low[i - 1] if sl[i - 1] else minor_l
            minor_h = g.high[i - 1] if sh[i - 1] else minor_h
            if direction == "bull" and minor_l is not None and g.low[i] < minor_l:
                idm_bull.append(i)
                minor_l = None
            elif direction == "bear" and minor_h is not None and g.high[i] > minor_h:
                idm_bear.append(i)
                minor_h = None
        assert list(mine.bar_no[mine.smc_idm_bull]) == idm_bull and list(mine.bar_no[mine.smc_idm_bear]) == idm_bear


def test_liquidity_pools(spark, noisy):
    cfg = SmcSettings(liq_tolerance_pct=2.0)
    got = collect(smc.liquidity_pools(to_bars(spark, noisy), cfg, keep=0), "symbol", "direction", "first_no")
    rows = []
    for sym, g in noisy.groupby("symbol"):
        g = g.reset_index(drop=True)
        for side, flags, price in (("Buy-side", swing_flags(g)[0], g.high), ("Sell-side", swing_flags(g)[1], g.low)):
            pts = [(i, price[i]) for i in np.flatnonzero(flags)]
            used = set()
            for a, (i, p) in enumerate(pts):
                if a in used:
                    continue
                members = [a] + [b for b in range(a + 1, len(pts)) if b not in used and abs(pts[b][1] - p) / p <= 0.02]
                used.update(members[1:])
                if len(members) < 2:
                    continue
                level, last = np.mean([pts[m][1] for m in members]), max(pts[m][0] for m in members)
                after = g.close[last + 1:]
                if not ((after > level).any() if side == "Buy-side" else (after < level).any()):
                    rows.append((sym, side, i, level, len(members), last))
    want = pd.DataFrame(rows, columns=["symbol", "direction", "first_no", "level", "touches", "bar_no"])
    assert len(want) > 3
    for c in ("symbol", "direction", "first_no", "touches", "bar_no"):
        assert list(got[c]) == list(want[c]), c
    np.testing.assert_allclose(got["level"], want["level"])


@pytest.mark.parametrize("tick,tol", [(0.0, 0.003), (0.1, 0.003), (1.0, 0.02)])
def test_equal_levels_of_crowded_prices(spark, tick, tol):
    rng = np.random.default_rng(int(tick * 10))
    price = 100 + 5 * rng.random(900)
    price = np.round(price / tick) * tick if tick else price
    got = collect(smc.equal_levels(spark.createDataFrame(pd.DataFrame({"symbol": "A", "direction": "Buy-side", "bar_no": np.arange(900) * 2, "price": price})).repartition(5), tol), "first_no")
    free, want = list(range(900)), []
    while free:
        first = free[0]
        taken = [k for k in free if abs(price[k] - price[first]) / price[first] <= tol]
        free = [k for k in free if k not in set(taken)]
        if len(taken) > 1:
            want.append((2 * first, len(taken), 2 * max(taken), price[taken].mean()))
    assert len(want) >= 2 and [tuple(r) for r in got[["first_no", "touches", "bar_no"]].itertuples(index=False)] == [w[:3] for w in want]
    np.testing.assert_allclose(got["level"], [w[3] for w in want])


@pytest.mark.parametrize("block", [None, 16])
def test_retests_by_zone_order(spark, noisy, block):
    """Claims from the first two zones of each bar equal claiming zone by zone in creation order."""
    bars = to_bars(spark, noisy)
    obs = smc.order_blocks(bars)
    got = collect(smc.retest_entries(bars, obs, block=block), "symbol", "bar_no")
    blocks = obs.where("direction = 'Bullish'").orderBy("impulse_no").toPandas()
    from tickloom.operators.indicators import stochastic

    stoch = collect(stochastic(bars), "symbol", "bar_no")
    want = []
    for sym, g in noisy.groupby("symbol"):
        g = g.reset_index(drop=True)
        ok = (stoch[stoch.symbol == sym].stoch_status != "OVERBOUGHT").to_numpy()
        o, h, l, c = (g[k].to_numpy() for k in ("open", "high", "low", "close"))
        zones = [("FVG", l[i], h[i - 2], i) for i in range(2, len(g)) if l[i] > h[i - 2] and (l[i] - h[i - 2]) / c[i] >= 0.002]
        zones += [("OB", z.top, z.bottom, z.bar_no) for z in blocks[blocks.symbol == sym].itertuples()]
        claimed = set()
        for kind, top, bottom, born in zones:
            last, count = -999, 0
            for p in range(born + 1, len(g)):
                loose = c[p] >= o[p] or c[p] >= top or min(o[p], c[p]) - l[p] >= 0.3 * max(h[p] - l[p], 1e-9)
                if p not in claimed and ok[p] and l[p] <= top and h[p] >= bottom and c[p] >= bottom and loose and p - last >= 2:
                    last, count = p, count + 1
                    claimed.add(p)
                    want.append((sym, p, kind, round(top, 6), count))
    have = [(r.symbol, r.bar_no, r.zone_type, round(r.zone_top, 6), r.retest_no) for r in got.itertuples()]
    assert len(want) > 20 and sorted(have) == sorted(want)
    assert got["quality"].between(0, 10).all() and (got.loc[got.quality >= 7, "grade"] == "BEST").all()


@pytest.mark.parametrize("tile", [5, 256])
def test_pair_moments_by_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    days = pd.date_range("2019-01-01", periods=900, freq="D")
    base = rng.normal(0, 0.01, 900)
    wide = pd.DataFrame({f"S{k}": base * (k % 3) + rng.normal(0.0005, 0.01, 900) for k in range(17)}, index=days).mask(rng.random((900, 17)) < 0.2)
    rows = wide.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="ret").dropna()
    df = spark.createDataFrame(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = joins.pairwise(df, tile=tile).toPandas().set_index(["a", "b"])
    corr, cov, n = wide.corr(), wide.cov(), wide.notna().astype(int).T @ wide.notna().astype(int)
    assert len(got) == 17 * 18 // 2 and all(a <= b for a, b in got.index)
    for (a, b), r in got.iterrows():
        np.testing.assert_allclose([r["corr"], r["cov"], r["days"]], [corr.loc[a, b], cov.loc[a, b], n.loc[a, b]], rtol=1e-9)
    few = joins.pairwise(df, tile=tile, least=0.4).toPandas()
    assert set(zip(few.a, few.b)) == {(a, b) for (a, b), r in got.iterrows() if a == b or abs(r["corr"]) >= 0.4} and 17 < len(few) < 153


def test_ranks_of_equal_scores(spark):
    """Nine in ten rows have one score; ranges split them by symbol, and all three orders come out."""
    from tickloom.operators import scanner

    rng = np.random.default_rng(5)
    n = 3000
    labels = list(scanner.SHORT_ORDER)
    pdf = pd.DataFrame({"symbol": [f"S{k:05d}" for k in rng.permutation(n)], "market": rng.choice(["VN", "TW", "US"], n, p=[0.8, 0.1, 0.1]), "short_rating": rng.choice(labels, n),
                        "composite_score": np.where(rng.random(n) < 0.9, 50.0, np.round(rng.random(n) * 100, 1))})
    got = collect(scanner.ranks(spark.createDataFrame(pdf).repartition(5)), "symbol")
    pdf["so"] = pdf.short_rating.map(scanner.SHORT_ORDER)
    best = pdf.sort_values(["composite_score", "symbol"], ascending=[False, True])
    best["rank"] = np.arange(1, n + 1)
    best["market_rank"] = best.groupby("market").cumcount() + 1
    short = best.sort_values(["so", "composite_score", "symbol"], ascending=[True, False, True])
    short["short_rank"] = np.arange(1, n + 1)
    want = short.sort_values("symbol").reset_index(drop=True)
    for c in ("rank", "market_rank", "short_rank"):
        assert list(got[c]) == list(want[c]), c


def claimed_in_turn(bars: pd.DataFrame, zones: list[tuple]) -> list[tuple]:
    """Zone by zone: the bars that it takes and no earlier zone has, two apart at least."""
    low, high, close, sure, pos = (bars[c].to_numpy() for c in ("low", "high", "close", "confirmed", "bar_no"))
    free, out = np.ones(len(bars), dtype=bool), []
    for kind, born, top, bottom in zones:
        fits = free & (pos > born) & (low <= top) & (high >= bottom) & (close >= bottom) & (sure | (close >= top))
        last, count = -999, 0
        for k in np.flatnonzero(fits):
            if pos[k] - last >= 2:
                last, count = pos[k], count + 1
                free[k] = False
                out.append((int(pos[k]), kind, top, bottom, count))
    return sorted(out)


@pytest.mark.parametrize("seed,tick", [(1, 0.0), (2, 1.0), (3, 0.25)])
def test_claims_of_crowded_prices(spark, monkeypatch, seed, tick):
    """Prices that stay in a narrow range, many zones over each other, chains of neighbours over block ends."""
    monkeypatch.setattr(retests, "STRETCH", 300)
    monkeypatch.setattr(retests, "AT_ONCE", 7)
    rng = np.random.default_rng(seed)
    n = 1500
    mid = 100 + 6 * np.sin(np.arange(n) / 90) + np.cumsum(rng.normal(0, 0.15, n))
    pdf = pd.DataFrame({"symbol": "A", "bar_no": np.arange(n), "n_bars": n, "low": mid - rng.exponential(0.6, n), "high": mid + rng.exponential(0.6, n), "confirmed": rng.random(n) < 0.5})
    if tick:
        pdf["low"], pdf["high"] = np.floor(pdf.low / tick) * tick, np.ceil(pdf.high / tick) * tick
    pdf["close"] = pdf.low + (pdf.high - pdf.low) * rng.choice([0.0, 0.3, 1.0, 0.7], n)
    at = np.sort(rng.choice(n, 260, replace=False))
    bottom = pdf.low.to_numpy()[at] - rng.choice([0.0, 0.25, 0.5, 3.0], 260)
    gaps = pd.DataFrame({"symbol": "A", "born": at, "top": bottom + rng.choice([0.25, 0.5, 1.0, 4.0], 260), "bottom": bottom})
    late = pd.DataFrame({"symbol": "A", "turn": [5, 6, 7], "born": [900, 20, 400], "top": [101.0, 99.0, 104.0], "bottom": [100.0, 97.0, 90.0]})
    d = pdf[rng.random(n) < 0.9]
    want = claimed_in_turn(d, [("FVG", *z) for z in gaps[["born", "top", "bottom"]].itertuples(index=False)] + [("OB", *z) for z in late[["born", "top", "bottom"]].itertuples(index=False)])
    found = retests.first_two_zones(spark.createDataFrame(d), spark.createDataFrame(gaps), spark.createDataFrame(late), block=64)
    got = collect(retests.claims(found, block=64), "bar_no")
    assert len(want) > 300 and max(w[4] for w in want) > 5
    assert [tuple(r) for r in got[["bar_no", "zone_type", "zone_top", "zone_bottom", "retest_no"]].itertuples(index=False)] == want


def test_few_zones_are_kept_in_a_cell(spark, monkeypatch):
    """Gaps of a price that swings in one range: what a cell (here of 25 ticks) keeps does not grow with their number."""
    monkeypatch.setattr(retests, "CELL", 0.0025)
    kept = []
    for n in (400, 4000):
        rng = np.random.default_rng(n)
        bottom = np.round(100 + rng.random(n) * 2, 2)
        gaps = spark.createDataFrame(pd.DataFrame({"symbol": "A", "born": np.arange(n) * 9, "top": np.round(bottom * 1.004, 2), "bottom": bottom}))
        kept.append(retests.cell_zones(gaps).groupBy("cell").count().agg({"count": "max"}).first()[0])
    assert kept[1] < 2 * kept[0] and kept[1] < 120


@pytest.mark.parametrize("block,threshold", [(None, 0.08), (4, 0.08), (7, 0.02), (50, 0.3)])
def test_zigzag(spark, noisy, block, threshold):
    """Blocks of any length give the pivots of the plain loop."""
    got = collect(elliott.zigzag(to_bars(spark, noisy), threshold, 10_000, block), "symbol", "pivot_no")
    for sym, g in noisy.groupby("symbol"):
        g = g.reset_index(drop=True)
        pivots, ref, kind = [], g.high[0], None
        for i in range(1, len(g)):
            new = "H" if g.high[i] > ref * (1 + threshold) else "L" if g.low[i] < ref * (1 - threshold) else None
            if new:
                ref = g.high[i] if new == "H" else g.low[i]
                if new == kind:
                    pivots[-1] = (i, ref, new)
                else:
                    pivots.append((i, ref, new))
                kind = new
        mine = got[got.symbol == sym]
        assert [(r.bar_no, r.kind) for r in mine.itertuples()] == [(i, k) for i, _, k in pivots]
        np.testing.assert_allclose(mine.price, [p for _, p, _ in pivots])
        assert list(mine.pivot_no) == list(range(1, len(pivots) + 1))


def test_hrp_weights(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.01, (400, 1))
    x = np.hstack([base + rng.normal(0, 0.002, (400, 2)), rng.normal(0, 0.02, (400, 2)), rng.normal(0, 0.005, (400, 1))])
    names = list("abcde")
    rows = pd.DataFrame([(i, n, float(x[i, k])) for i in range(400) for k, n in enumerate(names)], columns=["ts", "symbol", "ret"])
    pairs = joins.pairwise(spark.createDataFrame(rows)).withColumn("portfolio_id", F.lit("p"))
    w = collect(risk.hrp_weights(pairs), "symbol").set_index("symbol")["weight"]
    assert abs(w.sum() - 1) < 1e-9 and (w > 0).all()
    assert w["e"] > w["c"] and w["e"] > w["d"]
    two = collect(risk.hrp_weights(pairs.where("a IN ('c', 'e') AND b IN ('c', 'e')")), "symbol").set_index("symbol")["weight"]
    v = x.var(axis=0, ddof=1)
    np.testing.assert_allclose(two["c"], v[4] / (v[2] + v[4]), rtol=1e-6)


def test_rolling_profile(spark, walks):
    from tickloom.operators.profile import rolling_profile

    got = collect(rolling_profile(to_bars(spark, walks)), "symbol", "bar_no")
    g = walks[walks.symbol == "A"].reset_index(drop=True)
    mine = got[got.symbol == "A"].reset_index(drop=True)
    assert mine.poc_price[:20].isna().all() and (mine.inside_va[:20] == 0).all()
    for i in (20, 57, 111, 299):
        c, v = g.close[i - 19:i + 1].to_numpy(), g.volume[i - 19:i + 1].to_numpy()
        edges = np.linspace(c.min(), c.max(), 11)
        k = np.clip(np.digitize(c, edges) - 1, 0, 9)
        vol = np.bincount(k, v, 10)
        poc = int(vol.argmax())
        lo = hi = poc
        total = vol[poc]
        while total < 0.7 * vol.sum() and hi - lo < 9:
            down, up = (vol[lo - 1] if lo > 0 else 0), (vol[hi + 1] if hi < 9 else 0)
            if down >= up and lo > 0:
                lo, total = lo - 1, total + down
            else:
                hi, total = hi + 1, total + up
        assert abs(mine.poc_price[i] - (edges[poc] + edges[poc + 1]) / 2) < 1e-6
        assert mine.inside_va[i] == int(edges[lo] <= c[-1] <= edges[hi + 1])


def test_anomaly_forest_finds_spikes(spark):
    pdf = walk(600, 8)
    spikes = [150, 300, 450]
    pdf.loc[spikes, "volume"] = 5000.0
    pdf.loc[spikes, ["close", "low"]] *= 0.7
    cfg = VolumePriceSettings(trees=60)
    d = flow.volume_price_detector(to_bars(spark, pdf))
    scored = collect(ml.anomaly_scores(d, ml.anomaly_forest(d, cfg=cfg), cfg=cfg), "bar_no")
    assert scored.loc[spikes, "vp_ml_anomaly"].all()
    assert 0 < scored["vp_ml_anomaly"].mean() < 0.10
    assert scored["vp_ml_score"].dropna().between(-1, 0).all()


def test_forecast_band_and_report(spark, walks):
    from tickloom.config import ForecastSettings

    cfg = ForecastSettings(horizons=(1,))
    table, names = ml.feature_table(to_bars(spark, walks).withColumn("market", F.lit("US")), horizons=(1,))
    table = table.cache()
    models = ml.train(table, names, cfg, trees=3, depth=2)
    f = ml.forecast(table.where("bar_no = n_bars - 1"), models, cfg).toPandas()
    assert (f.ai_lower_1d <= f.ai_target_1d).all() and (f.ai_target_1d <= f.ai_upper_1d).all() and f.ai_confidence.between(0, 1).all()
    r = ml.fit_report(table, models, names).toPandas()
    assert list(r["rank"]) == list(range(1, len(names) + 1)) and r["importance"].is_monotonic_decreasing
