"""Swings, zones, structure breaks, retests and the structure signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import smc
from tickloom.plans import sqlkit as q
from tickloom.plans.registry import KEY, Registry, fix, rounded, sel
from tickloom.sources.driver_tables import bars_daily, derived_table

R = Registry()


def smc_table(s, d):
    return derived_table(s, d, "smc_signals", lambda: smc.smc_signals(bars_daily(s, d)))


def state(s, d):
    return smc.smc_state(smc_table(s, d))


SW = f"""sw AS (SELECT *, coalesce(high = max(high) OVER {q.rows(-3, 3)} AND high > {q.lag('high')} AND high > {q.lead('high')} AND bar_no BETWEEN 3 AND n_bars - 4, false) AS swing_high,
 coalesce(low = min(low) OVER {q.rows(-3, 3)} AND low < {q.lag('low')} AND low < {q.lead('low')} AND bar_no BETWEEN 3 AND n_bars - 4, false) AS swing_low FROM bars)"""
R.add("w22_swing_points", lambda s, d: smc.swings(bars_daily(s, d)).select(*KEY, "swing_high", "swing_low"), q.sql([q.DAILY, SW], "SELECT symbol, ts, swing_high, swing_low FROM sw"))

_lags = ", ".join(f"{q.lag(c, k)} AS {c}{k}" for k in (1, 2, 3) for c in ("open", "high", "low", "close", "bar_no"))
OB = [f"o0 AS (SELECT *, {q.TR} AS tr, close - {q.lag('close')} AS mv, {_lags}, low AS ml1, min(low) OVER {q.rows(-1, 0)} AS ml2, min(low) OVER {q.rows(-2, 0)} AS ml3, high AS mh1, max(high) OVER {q.rows(-1, 0)} AS mh2, max(high) OVER {q.rows(-2, 0)} AS mh3 FROM bars)",
      f"o1 AS (SELECT *, {q.mean('tr', 14, 1)} * 1.5 AS lim FROM o0)"]


def _ob(direction, op, move, col, agg, cmp):
    k = " ".join(f"WHEN close{i} {op} open{i} THEN {i}" for i in (1, 2, 3))
    pick = lambda c: "CASE k " + " ".join(f"WHEN {i} THEN {c}{i}" for i in (1, 2, 3)) + " END"
    return (f"(SELECT symbol, '{direction}' AS direction, {pick('high')} AS top, {pick('low')} AS bottom, {pick('bar_no')} AS bar_no, least({move} / lim, 1.0) AS strength, bar_no AS impulse_no, "
            f"{pick(agg)} {cmp} {pick(col)} AS mit FROM (SELECT *, CASE {k} END AS k FROM o1) WHERE k IS NOT NULL AND {move} >= lim AND bar_no >= 5 AND bar_no <= n_bars - 2)")


OB.append("ob AS (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY impulse_no DESC) AS rn FROM (" + _ob("Bullish", "<", "mv", "high", "ml", "<=") + " UNION ALL " + _ob("Bearish", ">", "(-mv)", "low", "mh", ">=") + ") WHERE NOT mit)")
R.add("p1_order_blocks", lambda s, d: smc.order_blocks(bars_daily(s, d)).select("symbol", "direction", "top", "bottom", "bar_no", fix("strength", 6).alias("strength")),
      q.sql([q.DAILY, *OB], f"SELECT symbol, direction, top, bottom, bar_no, {q.fix('strength', 6)} AS strength FROM ob WHERE rn <= 5"))
FVG = [f"g0 AS (SELECT *, {q.lag('high', 2)} AS h2, {q.lag('low', 2)} AS l2, min(low) OVER ({q.P} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ll, max(high) OVER ({q.P} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hh FROM bars)",
       """g1 AS (SELECT symbol, 'Bullish' AS direction, low AS top, h2 AS bottom, bar_no - 1 AS bar_no, bar_no AS born_no, close, coalesce((low - ll) / (low - h2), 0) AS fp FROM g0 WHERE low > h2
 UNION ALL SELECT symbol, 'Bearish', l2, high, bar_no - 1, bar_no, close, coalesce((hh - high) / (l2 - high), 0) FROM g0 WHERE high < l2)""",
       "g2 AS (SELECT *, greatest(0, least(1, fp)) AS filled_pct FROM g1 WHERE (top - bottom) / close >= 0.002)",
       "fvg AS (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY born_no DESC) AS rn FROM g2 WHERE filled_pct < 0.9)"]
R.add("p2_fair_value_gaps", lambda s, d: smc.fair_value_gaps(bars_daily(s, d)).select("symbol", "direction", "top", "bottom", "bar_no", fix("filled_pct", 6).alias("filled_pct")),
      q.sql([q.DAILY, *FVG], f"SELECT symbol, direction, top, bottom, bar_no, {q.fix('filled_pct', 6)} AS filled_pct FROM fvg WHERE rn <= 5"))
R.add("p2_all_gaps", lambda s, d: smc.fair_value_gaps(bars_daily(s, d), keep=0).groupBy("symbol", "direction").agg(F.count(F.lit(1)).alias("n"), fix(F.sum("filled_pct"), 4).alias("filled")),
      q.sql([q.DAILY, *FVG], f"SELECT symbol, direction, count(*) AS n, {q.fix('sum(filled_pct)', 4)} AS filled FROM g2 GROUP BY symbol, direction"))
# Retests: the first two zones that fit a bar, in order; then bar by bar, since a zone rests one bar after it took one.
_rc, _rl = q.chain("bars", *q.STOCH_LAYERS, prefix="rt")
RETEST = [*_rc, f"rf AS (SELECT *, close >= open AS bull_close, least(open, close) - low >= greatest(high - low, 1e-9) * 0.30 AS reject, {q.mean('volume', 20, 1)} AS vm, coalesce(close / {q.lag('close', 10)} - 1, 0) AS r10 FROM {_rl} WHERE n_bars >= 30)",
          """rz AS (SELECT symbol, 0 AS kind, born_no AS turn, born_no AS born, top, bottom FROM g2 WHERE direction = 'Bullish'
 UNION ALL SELECT symbol, 1, impulse_no, bar_no, top, bottom FROM ob WHERE direction = 'Bullish' AND rn <= 5)""",
          "rn2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY kind, turn) AS z FROM rz)",
          """rk AS (SELECT b.symbol, b.bar_no, z, row_number() OVER (PARTITION BY b.symbol, b.bar_no ORDER BY z) AS k FROM rf b JOIN rn2 USING (symbol)
 WHERE stoch_status <> 'OVERBOUGHT' AND born < b.bar_no AND low <= top AND high >= bottom AND close >= bottom AND (bull_close OR reject OR close >= top))""",
          "r2 AS (SELECT symbol, bar_no, min(z) FILTER (k = 1) AS z1, min(z) FILTER (k = 2) AS z2, row_number() OVER (PARTITION BY symbol ORDER BY bar_no) AS n FROM rk WHERE k <= 2 GROUP BY symbol, bar_no)",
          """rw AS (SELECT symbol, n, bar_no, z1 AS z FROM r2 WHERE n = 1 UNION ALL
 SELECT r2.symbol, r2.n, r2.bar_no, CASE WHEN rw.bar_no = r2.bar_no - 1 AND rw.z = r2.z1 THEN r2.z2 ELSE r2.z1 END FROM rw JOIN r2 ON r2.symbol = rw.symbol AND r2.n = rw.n + 1)""",
          "ry AS (SELECT rw.symbol, rw.bar_no, kind, top, bottom, row_number() OVER (PARTITION BY rw.symbol, rw.z ORDER BY rw.bar_no) AS retest_no FROM rw JOIN rn2 ON rn2.symbol = rw.symbol AND rn2.z = rw.z)"]
_RULES = [("retest_no = 1", 2, "FIRST_RETEST"), ("retest_no = 2", 1, "SECOND_RETEST"), ("retest_no > 2", -1, "LATE_RETEST"), ("close >= top", 2, "RECLAIM_TOP"), ("close < top AND close >= (top + bottom) / 2", 1, "MID_RECLAIM"),
          ("bull_close", 2, "BULL_CLOSE"), ("(close - low) / greatest(high - low, 1e-9) >= 0.55", 1, "STRONG_CLOSE"), ("reject", 1, "WICK_REJECT"), ("stoch_k <= 40", 2, "STOCH_LOW"), ("stoch_k > 40 AND stoch_k <= 70", 1, "STOCH_OK"),
          ("volume >= greatest(vm, 1) * 0.80", 1, "VOL_OK"), ("(top - bottom) / close >= 0.005", 1, "WIDE_FVG"), ("above <= 0.03", 1, "NEAR_ZONE"), ("above > 0.08", -2, "CHASE"), ("stoch_k >= 75", -1, "STOCH_HIGH"),
          ("r10 >= 0.30", -2, "HOT_RUN"), ("r10 >= 0.20 AND r10 < 0.30", -1, "RUN_EXTENDED")]
RETEST += ["rq AS (SELECT b.*, ry.kind, ry.top, ry.bottom, ry.retest_no, greatest(b.close - ry.top, 0) / b.close AS above FROM ry JOIN rf b USING (symbol, bar_no))",
           "rg AS (SELECT *, greatest(0, least(10, " + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in _RULES) + ")) AS quality, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, _, n in _RULES) + ") AS factors FROM rq)",
           "re AS (SELECT *, CASE WHEN quality >= 7 THEN 'BEST' WHEN quality >= 5 THEN 'GOOD' ELSE 'RAW' END AS grade, (quality >= 7 AND retest_no <= 2 AND above <= 0.04 AND stoch_k <= 72 AND r10 < 0.25)::INT AS tactical FROM rg)"]
RETESTS = ["RECURSIVE " + q.DAILY, *OB, *FVG, *RETEST]


def retests(s, d):
    return derived_table(s, d, "smc_retests", lambda: smc.retest_entries(bars_daily(s, d), smc.order_blocks(bars_daily(s, d))))


# Equal levels: the first free swing point takes all later free ones near it.
POOLS = [SW, """pp AS (SELECT symbol, 'Buy-side' AS direction, bar_no, high AS price FROM sw WHERE swing_high AND n_bars >= 20 UNION ALL SELECT symbol, 'Sell-side', bar_no, low FROM sw WHERE swing_low AND n_bars >= 20)""",
         "pl AS (SELECT symbol, direction, list({'n': bar_no, 'p': price} ORDER BY bar_no) AS free FROM pp GROUP BY symbol, direction)",
         """pr AS (SELECT symbol, direction, NULL::STRUCT(n BIGINT, p DOUBLE)[] AS taken, free FROM pl UNION ALL
 SELECT symbol, direction, list_filter(free, lambda x: abs(x.p - free[1].p) / free[1].p <= 0.003), list_filter(free, lambda x: abs(x.p - free[1].p) / free[1].p > 0.003) FROM pr WHERE len(free) > 0)""",
         "pc AS (SELECT symbol, direction, list_avg(list_transform(taken, lambda x: x.p)) AS level, len(taken) AS touches, list_max(list_transform(taken, lambda x: x.n)) AS bar_no, taken[1].n AS first_no FROM pr WHERE len(taken) >= 2)",
         "pn AS (SELECT symbol, high AS lh, low AS ll, close AS lc, bar_no AS ln FROM bars WHERE bar_no = n_bars - 1)",
         """pe AS (SELECT pc.*, CASE WHEN direction = 'Buy-side' THEN lh > level AND level > lc ELSE bar_no < ln AND ll < level AND level < lc END AS is_sweep_event, lc,
 row_number() OVER (PARTITION BY symbol, direction ORDER BY first_no DESC) AS r FROM pc JOIN pn USING (symbol)
 WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = pc.symbol AND b.bar_no > pc.bar_no AND CASE WHEN pc.direction = 'Buy-side' THEN b.close > pc.level ELSE b.close < pc.level END))""",
         "pool AS (SELECT * FROM pe WHERE r <= 3)"]
R.add("p3_liquidity_pools", lambda s, d: smc.liquidity_pools(bars_daily(s, d)).select("symbol", "direction", fix("level", 4).alias("level"), "touches", "bar_no", "is_sweep_event"),
      q.sql(["RECURSIVE " + q.DAILY, *POOLS], f"SELECT symbol, direction, {q.fix('level', 4)} AS level, touches, bar_no, is_sweep_event FROM pool"))
STR = [SW,
       f"s0 AS (SELECT *, CASE WHEN swing_high THEN high END AS sh, CASE WHEN swing_low THEN low END AS sl, CASE WHEN bar_no >= 5 AND {q.lag('swing_high')} THEN {q.lag('high')} END AS mh, CASE WHEN bar_no >= 5 AND {q.lag('swing_low')} THEN {q.lag('low')} END AS ml FROM sw)",
       "s1 AS (SELECT *, " + ", ".join(f"count({c}) OVER {q.RUN} AS seg_{c}, last_value({c} IGNORE NULLS) OVER {q.RUN} AS lvl_{c}" for c in ("sh", "sl", "mh", "ml")) + " FROM s0)",
       """brk AS (SELECT symbol, min(bar_no) AS bar_no, 'bull' AS k FROM s1 WHERE close > lvl_sh AND bar_no >= 1 GROUP BY symbol, seg_sh UNION ALL SELECT symbol, min(bar_no), 'bear' FROM s1 WHERE close < lvl_sl AND bar_no >= 1 GROUP BY symbol, seg_sl)""",
       "trn AS (SELECT *, lag(k) OVER (PARTITION BY symbol ORDER BY bar_no) AS pk, last_value(k) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM brk)",
       "fd AS (SELECT DISTINCT symbol, fin FROM trn)",
       "gb AS (SELECT symbol, min(bar_no) AS bar_no FROM s1 WHERE low < lvl_ml GROUP BY symbol, seg_ml)", "gs AS (SELECT symbol, min(bar_no) AS bar_no FROM s1 WHERE high > lvl_mh GROUP BY symbol, seg_mh)",
       """st0 AS (SELECT s1.*, coalesce(t.k = 'bull' AND (t.pk IS NULL OR t.pk = 'bull'), false) AS smc_bos_bull, coalesce(t.k = 'bear' AND (t.pk IS NULL OR t.pk = 'bear'), false) AS smc_bos_bear, coalesce(t.pk <> t.k, false) AS smc_choch,
 gb.bar_no IS NOT NULL AND coalesce(fd.fin = 'bull', false) AS smc_idm_bull, gs.bar_no IS NOT NULL AND coalesce(fd.fin = 'bear', false) AS smc_idm_bear,
 coalesce(s1.bar_no >= 5 AND low < lvl_ml AND close > lvl_ml, false) AS smc_sweep_bull, coalesce(s1.bar_no >= 5 AND high > lvl_mh AND close < lvl_mh, false) AS smc_sweep_bear
 FROM s1 LEFT JOIN trn t ON t.symbol = s1.symbol AND t.bar_no = s1.bar_no LEFT JOIN fd ON fd.symbol = s1.symbol LEFT JOIN gb ON gb.symbol = s1.symbol AND gb.bar_no = s1.bar_no LEFT JOIN gs ON gs.symbol = s1.symbol AND gs.bar_no = s1.bar_no)""",
       f"stx AS (SELECT *, sum(smc_bos_bull::INT) OVER {q.back(20)} AS nb, sum(smc_bos_bear::INT) OVER {q.back(20)} AS ns FROM st0)",
       "str AS (SELECT *, CASE WHEN nb > ns THEN 'Bullish' WHEN ns > nb THEN 'Bearish' ELSE 'Ranging' END AS smc_structure FROM stx)"]
FLAGS = {"p4_structure_breaks": ["smc_bos_bull", "smc_bos_bear", "smc_choch"], "p5_inducement": ["smc_idm_bull", "smc_idm_bear"], "p6_liquidity_sweeps": ["smc_sweep_bull", "smc_sweep_bear"], "w33_structure_majority": ["smc_structure"]}
for name, cols in FLAGS.items():
    R.add(name, lambda s, d, cols=cols: smc.market_structure(bars_daily(s, d)).select(*KEY, *cols), q.sql([q.DAILY, *STR], f"SELECT symbol, ts, {', '.join(cols)} FROM str"))
R.add("w32_first_hit_per_segment", lambda s, d: smc.market_structure(bars_daily(s, d)).where("smc_bos_bull OR smc_bos_bear OR smc_choch").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_breaks"), F.max("ts").alias("last_break")),
      q.sql([q.DAILY, *STR], "SELECT symbol, count(*) AS n_breaks, max(ts) AS last_break FROM str WHERE smc_bos_bull OR smc_bos_bear OR smc_choch GROUP BY symbol"))
_lagged = lambda c, k: f"lag({c}, {k}) OVER ({q.P})"
CAUSAL = [SW,
          f"s0 AS (SELECT *, CASE WHEN {_lagged('swing_high', 3)} THEN {_lagged('high', 3)} END AS sh, CASE WHEN {_lagged('swing_low', 3)} THEN {_lagged('low', 3)} END AS sl, CASE WHEN bar_no >= 5 AND {_lagged('swing_high', 4)} THEN {_lagged('high', 4)} END AS mh, CASE WHEN bar_no >= 5 AND {_lagged('swing_low', 4)} THEN {_lagged('low', 4)} END AS ml FROM sw)",
          *STR[2:4], "trn AS (SELECT *, lag(k) OVER (PARTITION BY symbol ORDER BY bar_no) AS pk FROM brk)", *STR[6:8],
          f"""cz AS (SELECT s1.symbol, s1.ts, s1.bar_no, t.k, t.pk, last_value(t.k IGNORE NULLS) OVER (PARTITION BY s1.symbol ORDER BY s1.bar_no ROWS UNBOUNDED PRECEDING) AS dr, gb.bar_no IS NOT NULL AS g1, gs.bar_no IS NOT NULL AS g2
 FROM s1 LEFT JOIN trn t ON t.symbol = s1.symbol AND t.bar_no = s1.bar_no LEFT JOIN gb ON gb.symbol = s1.symbol AND gb.bar_no = s1.bar_no LEFT JOIN gs ON gs.symbol = s1.symbol AND gs.bar_no = s1.bar_no)"""]
R.add("p4_structure_causal", lambda s, d: smc.market_structure(bars_daily(s, d), mode="causal").select(*KEY, "smc_bos_bull", "smc_bos_bear", "smc_choch", "smc_idm_bull", "smc_idm_bear"),
      q.sql([q.DAILY, *CAUSAL], "SELECT symbol, ts, coalesce(k = 'bull' AND (pk IS NULL OR pk = 'bull'), false) AS smc_bos_bull, coalesce(k = 'bear' AND (pk IS NULL OR pk = 'bear'), false) AS smc_bos_bear, coalesce(pk <> k, false) AS smc_choch, g1 AND coalesce(dr = 'bull', false) AS smc_idm_bull, g2 AND coalesce(dr = 'bear', false) AS smc_idm_bear FROM cz"))
_w = lambda tbl, dr, wt: f"coalesce((SELECT sum(CASE WHEN s.close BETWEEN z.bottom AND z.top THEN {wt} ELSE 0 END) FROM {tbl} z WHERE z.symbol = s.symbol AND z.direction = '{dr}' AND z.rn <= 5), 0)"
SCORE = [*OB, *FVG, *STR,
         f"sc0 AS (SELECT s.*, {_w('ob', 'Bullish', 'z.strength')} * 0.30 - {_w('ob', 'Bearish', 'z.strength')} * 0.30 + {_w('fvg', 'Bullish', '1 - z.filled_pct')} * 0.20 - {_w('fvg', 'Bearish', '1 - z.filled_pct')} * 0.20 + smc_bos_bull::INT * 0.20 - smc_bos_bear::INT * 0.20 AS b FROM str s)",
         "sc1 AS (SELECT *, (CASE WHEN smc_choch THEN b * -0.5 ELSE b END + smc_idm_bull::INT * 0.25 - smc_idm_bear::INT * 0.25 + smc_sweep_bull::INT * 0.35 - smc_sweep_bear::INT * 0.35)::DOUBLE AS s0 FROM sc0)",
         f"sc AS (SELECT *, greatest(-1, least(1, {q.mean('s0', 5, 1)})) AS smc_score FROM sc1)"]
R.add("p7_structure_score", lambda s, d: smc_table(s, d).select(*KEY, fix("smc_score", 6).alias("smc_score")), q.sql([q.DAILY, *SCORE], f"SELECT symbol, ts, {q.fix('smc_score', 6)} AS smc_score FROM sc"))
_in = lambda tbl, dr: f"EXISTS (SELECT 1 FROM {tbl} z WHERE z.symbol = b.symbol AND z.direction = '{dr}' AND z.rn <= 5 AND b.close BETWEEN z.bottom AND z.top)"
MEMBER = f"{_in('ob', 'Bullish')} AS smc_in_bull_ob, {_in('ob', 'Bearish')} AS smc_in_bear_ob, {_in('fvg', 'Bullish')} AS smc_in_bull_fvg, {_in('fvg', 'Bearish')} AS smc_in_bear_fvg"
for name in ("p8_zone_membership", "j10_zone_range_join"):
    R.add(name, lambda s, d: smc_table(s, d).select(*KEY, "smc_in_bull_ob", "smc_in_bear_ob", "smc_in_bull_fvg", "smc_in_bear_fvg"), q.sql([q.DAILY, *OB, *FVG], f"SELECT symbol, ts, {MEMBER} FROM bars b"))
R.add("p8_nearest_pools", lambda s, d: smc.nearest_pools(bars_daily(s, d), smc.liquidity_pools(bars_daily(s, d))).select("symbol", fix("smc_near_buy_liq", 6).alias("near_buy"), fix("smc_near_sell_liq", 6).alias("near_sell")),
      q.sql(["RECURSIVE " + q.DAILY, *POOLS], "SELECT pn.symbol, " + ", ".join(f"{q.fix(f'coalesce(min(abs(level - pn.lc) / pn.lc) FILTER (direction = {chr(39)}{side}{chr(39)}), 1.0)', 6)} AS {c}" for side, c in (("Buy-side", "near_buy"), ("Sell-side", "near_sell"))) + " FROM pn LEFT JOIN pool USING (symbol) GROUP BY pn.symbol"))
R.add("p9_retest_entries", lambda s, d: retests(s, d).select(*KEY, "zone_type", "zone_top", "zone_bottom", "retest_no"),
      q.sql(RETESTS, "SELECT symbol, ts, CASE WHEN kind = 0 THEN 'FVG' ELSE 'OB' END AS zone_type, top AS zone_top, bottom AS zone_bottom, retest_no FROM re"))
R.add("p10_retest_quality", lambda s, d: retests(s, d).select(*KEY, "quality", "grade", "factors", "tactical"), q.sql(RETESTS, "SELECT symbol, ts, quality, grade, factors, tactical FROM re"))
SIGNAL = [*RETESTS, *[c for c in STR], *SCORE[len(OB) + len(FVG) + len(STR):], *POOLS[1:],
          f"sq AS (SELECT sc.*, {_in('ob', 'Bullish').replace('b.', 'sc.')} AS in_bull, {_in('ob', 'Bearish').replace('b.', 'sc.')} AS in_bear, st.stoch_status, re.kind AS rkind FROM sc JOIN {_rl} st USING (symbol, bar_no) LEFT JOIN re USING (symbol, bar_no))",
          """sb AS (SELECT *, CASE WHEN in_bull AND smc_structure = 'Bullish' AND smc_score >= 0.25 AND stoch_status <> 'OVERBOUGHT' THEN 'BULL_OB' WHEN smc_bos_bull AND smc_score >= 0 AND stoch_status <> 'OVERBOUGHT' THEN 'BOS_BULL'
 WHEN rkind IS NOT NULL AND smc_structure <> 'Bearish' THEN CASE WHEN rkind = 0 THEN 'BULL_FVG_RETEST' ELSE 'BULL_OB_RETEST' END END AS buy FROM sq)""",
          """s6 AS (SELECT *, CASE WHEN smc_choch THEN 'CHOCH' WHEN in_bear AND smc_structure = 'Bearish' AND smc_score <= -0.25 AND stoch_status <> 'OVERSOLD' THEN 'BEAR_OB' WHEN buy IS NOT NULL THEN buy
 WHEN smc_bos_bear AND smc_score <= 0 AND stoch_status <> 'OVERSOLD' THEN 'BOS_BEAR' END AS c0 FROM sb)""",
          "s7 AS (SELECT *, CASE WHEN (c0 IS NULL OR c0 = 'CHOCH') AND smc_idm_bull THEN 'IDM_BULL' WHEN (c0 IS NULL OR c0 = 'CHOCH') AND smc_idm_bear THEN 'IDM_BEAR' ELSE c0 END AS c1 FROM s6)",
          "pv AS (SELECT symbol, bool_or(is_sweep_event AND direction = 'Sell-side') AS up, bool_or(is_sweep_event AND direction = 'Buy-side') AS down FROM pool GROUP BY symbol)",
          "s8 AS (SELECT s7.symbol, ts, CASE WHEN n_bars < 30 THEN 'INSUFFICIENT_DATA' WHEN bar_no = n_bars - 1 AND pv.up THEN 'LIQ_SWEEP_BULL' WHEN bar_no = n_bars - 1 AND pv.down THEN 'LIQ_SWEEP_BEAR' ELSE coalesce(c1, '') END AS smc_reason FROM s7 LEFT JOIN pv USING (symbol))"]
R.add("p11_structure_signal", lambda s, d: smc_table(s, d).select(*KEY, "smc_signal", "smc_reason"),
      q.sql(SIGNAL, """SELECT symbol, ts, smc_reason, CASE WHEN smc_reason IN ('BULL_OB', 'BOS_BULL', 'BULL_FVG_RETEST', 'BULL_OB_RETEST', 'IDM_BULL', 'LIQ_SWEEP_BULL') THEN 1
 WHEN smc_reason IN ('BEAR_OB', 'BOS_BEAR', 'IDM_BEAR', 'LIQ_SWEEP_BEAR') THEN -1 ELSE 0 END AS smc_signal FROM s8"""))
CONF_LAYERS = q.STOCH_LAYERS
_c, _l = q.chain("bars", *CONF_LAYERS, prefix="cf")
ZALL = "za AS (SELECT symbol, 'OB' AS kind, direction, top, bottom, impulse_no AS seq FROM ob WHERE rn <= 5 UNION ALL SELECT symbol, 'FVG', direction, top, bottom, born_no FROM fvg WHERE rn <= 5)"
R.add("p12_entry_confirmation", lambda s, d: smc.entry_confirmation(state(s, d)).withColumn("stoch_k", fix("stoch_k", 1)),
      q.sql([q.DAILY, *OB, *FVG, ZALL, *_c, f"ls AS (SELECT * FROM {_l} WHERE bar_no = n_bars - 1)",
             "z AS (SELECT za.*, stoch_k, stoch_status, CASE WHEN direction = 'Bullish' THEN stoch_status = 'OVERBOUGHT' ELSE stoch_status = 'OVERSOLD' END AS bl, CASE WHEN direction = 'Bullish' THEN stoch_status = 'OVERSOLD' OR stoch_crossover ELSE stoch_status = 'OVERBOUGHT' OR stoch_crossunder END AS go FROM za JOIN ls USING (symbol))"],
            f"SELECT symbol, kind AS zone_type, direction, top, bottom, {q.fix('round(stoch_k, 1)', 1)} AS stoch_k, NOT bl AS stoch_confirmed, CASE WHEN bl THEN 'WAIT' WHEN go THEN CASE WHEN direction = 'Bullish' THEN 'BUY' ELSE 'SELL' END ELSE 'CAUTION' END AS action FROM z"))
LASTC = "lc AS (SELECT symbol, close AS c FROM bars WHERE bar_no = n_bars - 1)"
R.add("p14_open_gaps", lambda s, d: smc.open_gaps(state(s, d)).select("symbol", "direction", "top", "bottom", fix("distance_pct", 4).alias("distance_pct")),
      q.sql([q.DAILY, *FVG, LASTC, "z AS (SELECT f.symbol, direction, top, bottom, born_no, abs((top + bottom) / 2 - c) / c * 100 AS dp FROM fvg f JOIN lc USING (symbol) WHERE rn <= 5)", "y AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dp, born_no) AS r FROM z)"],
            f"SELECT symbol, direction, top, bottom, {q.fix('dp', 4)} AS distance_pct FROM y WHERE r <= 6"))
R.add("p18_demand_zones", lambda s, d: smc.demand_zones(state(s, d)).select("symbol", "zone_type", "top", "bottom", fix("distance_pct", 4).alias("distance_pct")),
      q.sql([q.DAILY, *OB, *FVG, ZALL, LASTC, "z AS (SELECT za.symbol, kind, top, bottom, seq, (c - top) / c * 100 AS dp FROM za JOIN lc USING (symbol) WHERE direction = 'Bullish' AND top < c)", "y AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY dp, seq) AS r FROM z)"],
            f"SELECT symbol, kind AS zone_type, top, bottom, {q.fix('dp', 4)} AS distance_pct FROM y WHERE r <= 3"))
R.add("p19_entry_history", lambda s, d: smc.entry_history(retests(s, d)).select(*KEY, "quality", "grade", "tactical"),
      q.sql([*RETESTS, "rh AS (SELECT *, max(tactical) OVER (PARTITION BY symbol) AS ht, max((quality >= 7)::INT) OVER (PARTITION BY symbol) AS hq FROM re)",
             "rr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_no DESC) AS r FROM rh WHERE CASE WHEN ht = 1 THEN tactical = 1 WHEN hq = 1 THEN quality >= 7 ELSE true END)"],
            "SELECT symbol, ts, quality, grade, tactical FROM rr WHERE r <= 60"))
R.add("u6_zone_rows", lambda s, d: smc_table(s, d).where("bar_no = n_bars - 1").select("symbol", F.explode("zones").alias("z")).groupBy("symbol", "z.kind", "z.direction").agg(F.count(F.lit(1)).alias("n")),
      q.sql([q.DAILY, *OB, *FVG, ZALL], "SELECT symbol, kind, direction, count(*) AS n FROM za GROUP BY ALL"))

QUERIES, ORACLES = R.queries, R.oracles
