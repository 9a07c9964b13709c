"""Independent SQL for every registered query, for DuckDB over the same Parquet tables.

Written in the direct form (window functions, range joins, joins of halves) rather than the
form the Spark code uses, so that agreement says something about both.
"""

from __future__ import annotations

# The result columns, written out here so that a wrong list in the engine is found (fixed values).
RESULT_COLUMNS = {
    "option_chain": """
        symbol strike right expiration dte bid ask last close mid delta gamma theta vega
        implied_vol open_interest volume underlying_price""".split(),
    "spreads": """
        symbol expiration right strategy underlying_price spread_ratio short_strike
        pct_to_short_strike short_mid short_delta long_strike pct_to_long_strike long_mid
        long_delta credit width max_profit max_loss credit_yield ROC breakeven
        pct_to_breakeven dte net_delta net_gamma net_theta net_vega""".split(),
    "iron_condors": """
        symbol expiration put_short_strike put_long_strike call_short_strike call_long_strike
        put_credit call_credit total_credit put_width call_width max_profit max_loss
        spread_ratio credit_yield ROC lower_breakeven upper_breakeven underlying_price
        pct_to_lower_breakeven pct_to_upper_breakeven dte net_delta net_gamma net_theta
        net_vega""".split(),
    "strangles": """
        symbol expiration underlying_price put_strike call_strike put_mid call_mid
        total_premium lower_breakeven upper_breakeven breakeven_width pct_to_put_strike
        pct_to_call_strike pct_to_lower_breakeven pct_to_upper_breakeven ROC dte net_delta
        net_gamma net_theta net_vega put_delta call_delta put_implied_vol
        call_implied_vol""".split(),
    "iron_butterflies": """
        symbol expiration dte atm_strike put_wing_strike call_wing_strike wing_width
        short_put_mid short_call_mid long_put_mid long_call_mid total_credit max_profit
        max_loss spread_ratio credit_yield ROC lower_breakeven upper_breakeven
        underlying_price pct_to_atm_strike pct_to_lower_breakeven pct_to_upper_breakeven
        short_put_delta long_put_delta short_call_delta long_call_delta atm_put_iv
        atm_call_iv""".split(),
    "calendars": """
        symbol right strike near_expiration far_expiration near_dte far_dte dte_gap near_mid
        far_mid net_debit approx_max_profit approx_ROC theta_differential iv_differential
        underlying_price pct_to_strike near_delta far_delta near_iv far_iv near_theta
        far_theta""".split(),
    "expected_move": """
        symbol expiration dte underlying_price atm_call_strike atm_put_strike atm_call_mid
        atm_put_mid expected_move expected_move_contract move_pct upper_bound lower_bound
        avg_atm_iv""".split(),
    "max_pain": """
        symbol expiration dte underlying_price max_pain_strike call_pain put_pain total_pain
        pct_from_underlying""".split(),
}

SYMBOL = """'SYM' || CASE WHEN {key} < 10000
    THEN lpad(CAST({key} AS VARCHAR), 4, '0') ELSE CAST({key} AS VARCHAR) END"""

CHAIN = f"""
raw AS (
  SELECT *, 50e0 + ((l_suppkey * 37) % 400) * 0.5e0 AS u,
    CAST(16 + 14 * (l_linenumber - 1) AS INTEGER) AS dte,
    CASE WHEN l_orderkey % 2 = 0 THEN 'C' ELSE 'P' END AS rt
  FROM lineitem),
struck AS (
  SELECT *, floor(u / 2.5e0) * 2.5e0 + 2.5e0 * ((l_partkey % 13) - 6) AS strike FROM raw),
latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY l_suppkey, l_linenumber, strike, rt
      ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey DESC, l_extendedprice DESC,
        l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC
    ) AS place FROM struck) WHERE place = 1),
valued AS (
  SELECT *,
    CASE WHEN rt = 'C' THEN greatest(u - strike, 0e0) ELSE greatest(strike - u, 0e0) END
      AS intrinsic,
    u * dte * 0.0008e0 / (1e0 + 10e0 * abs(strike - u) / u) * (1e0 + l_tax) AS tv,
    (l_returnflag = 'R' AND l_discount >= 0.09e0) AS unquoted
  FROM latest),
quote AS (
  SELECT *,
    CASE WHEN unquoted THEN -1e0 ELSE floor((intrinsic + tv) * 98e0 + 0.5e0) / 100e0 END AS bid,
    CASE WHEN unquoted THEN -1e0 ELSE floor((intrinsic + tv) * 102e0 + 0.5e0) / 100e0 END AS ask,
    CASE WHEN l_quantity <= 40e0
      THEN floor((intrinsic + tv) * 100e0 + 0.5e0) / 100e0 END AS last,
    CASE WHEN l_tax < 0.07e0
      THEN floor((intrinsic + tv) * 99e0 + 0.5e0) / 100e0 END AS close
  FROM valued),
chain AS (
  SELECT {SYMBOL.format(key="l_suppkey")} AS symbol,
    DATE '2026-04-17' + 14 * (l_linenumber - 1) AS expiration,
    strike, rt AS "right", bid, ask, last, close,
    CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2e0
      WHEN last > 0 THEN last WHEN close > 0 THEN close END AS mid,
    CASE WHEN l_tax < 0.08e0 THEN CASE WHEN rt = 'C' THEN 0.5e0 + 0.5e0 * ((u - strike) / u)
      ELSE 0.5e0 + 0.5e0 * ((u - strike) / u) - 1e0 END END AS delta,
    CASE WHEN l_tax < 0.08e0 THEN 1e0 / (u + 10e0 * abs(strike - u)) END AS gamma,
    CASE WHEN l_tax < 0.08e0 THEN -tv / dte END AS theta,
    CASE WHEN l_tax < 0.08e0 THEN 0.01e0 * tv END AS vega,
    CASE WHEN l_tax < 0.08e0 THEN 0.2e0 + l_discount END AS implied_vol,
    l_quantity * 10e0 AS open_interest, l_quantity AS volume,
    u AS underlying_price, dte
  FROM quote)"""

VALID = "valid AS (SELECT * FROM chain WHERE mid IS NOT NULL)"

SPREADS = """
pairs AS (
  SELECT s.*, l.strike AS ls, l.mid AS lm, l.delta AS ld, l.gamma AS lg, l.theta AS lt,
    l.vega AS lv, s.strike AS ss, s.underlying_price AS u,
    s.mid - l.mid AS np, abs(s.strike - l.strike) AS w
  FROM valid s JOIN valid l ON s.symbol = l.symbol AND s.expiration = l.expiration
    AND s."right" = l."right" AND s.strike <> l.strike
  WHERE CASE WHEN s."right" = 'P' THEN s.strike <= s.underlying_price
    ELSE s.strike >= s.underlying_price END),
pnl AS (
  SELECT *, CASE WHEN np >= 0 THEN np ELSE w + np END AS mp,
    CASE WHEN np >= 0 THEN w - np ELSE abs(np) END AS ml,
    CASE WHEN np >= 0 THEN CASE WHEN "right" = 'P' THEN ss - np ELSE ss + np END
      ELSE CASE WHEN "right" = 'P' THEN ls + np ELSE ls - np END END AS be
  FROM pairs),
all_spreads AS (
  SELECT symbol, expiration, "right",
    CASE WHEN "right" = 'P' AND ss > ls THEN 'Put Credit Spread'
      WHEN "right" = 'P' AND ss < ls THEN 'Put Debit Spread'
      WHEN "right" = 'C' AND ss < ls THEN 'Call Credit Spread'
      WHEN "right" = 'C' AND ss > ls THEN 'Call Debit Spread' ELSE 'Unknown' END AS strategy,
    u AS underlying_price, abs(np) / w * 100 AS spread_ratio,
    ss AS short_strike, abs(u - ss) / u * 100 AS pct_to_short_strike, mid AS short_mid,
    delta AS short_delta, ls AS long_strike, abs(u - ls) / u * 100 AS pct_to_long_strike,
    lm AS long_mid, ld AS long_delta, np * 100 AS credit, w AS width, mp * 100 AS max_profit,
    ml * 100 AS max_loss, CASE WHEN ml > 0 THEN mp / ml * 100 END AS credit_yield,
    abs(np) / ss * 100 AS "ROC", be AS breakeven, abs(u - be) / u * 100 AS pct_to_breakeven,
    dte, delta - ld AS net_delta, gamma - lg AS net_gamma, theta - lt AS net_theta,
    vega - lv AS net_vega
  FROM pnl),
spreads AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, expiration, "right",
      least(short_strike, long_strike), greatest(short_strike, long_strike)
      ORDER BY credit DESC, short_strike) AS mirror
    FROM all_spreads WHERE max_profit > 0 AND max_loss > 0) WHERE mirror = 1)"""

CONDORS = """
best_side AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, expiration, "right"
      ORDER BY spread_ratio DESC, width, short_strike, long_strike) AS place
    FROM spreads WHERE strategy LIKE '%Credit%') WHERE place = 1),
both_sides AS (
  SELECT p.symbol, p.expiration, p.short_strike AS ps, p.long_strike AS pl,
    c.short_strike AS cs, c.long_strike AS cl, p.credit AS pc, c.credit AS cc,
    p.credit + c.credit AS total, p.width AS pw, c.width AS cw,
    greatest(p.width, c.width) * 100 AS wide, p.underlying_price AS u, p.dte,
    p.short_strike - p.credit / 100 AS lo, c.short_strike + c.credit / 100 AS hi,
    p.net_delta + c.net_delta AS net_delta, p.net_gamma + c.net_gamma AS net_gamma,
    p.net_theta + c.net_theta AS net_theta, p.net_vega + c.net_vega AS net_vega
  FROM best_side p JOIN best_side c ON p.symbol = c.symbol AND p.expiration = c.expiration
  WHERE p."right" = 'P' AND c."right" = 'C'),
iron_condors AS (
  SELECT symbol, expiration, ps AS put_short_strike, pl AS put_long_strike,
    cs AS call_short_strike, cl AS call_long_strike, pc AS put_credit, cc AS call_credit,
    total AS total_credit, pw AS put_width, cw AS call_width, total AS max_profit,
    wide - total AS max_loss, total / wide * 100 AS spread_ratio,
    CASE WHEN wide - total > 0 THEN total / (wide - total) * 100 END AS credit_yield,
    total / 100 / ((ps + cs) / 2) * 100 AS "ROC", lo AS lower_breakeven,
    hi AS upper_breakeven, u AS underlying_price,
    abs(u - lo) / u * 100 AS pct_to_lower_breakeven,
    abs(u - hi) / u * 100 AS pct_to_upper_breakeven, dte,
    net_delta, net_gamma, net_theta, net_vega
  FROM both_sides)"""

BUTTERFLIES = """
atm AS (
  SELECT symbol, expiration, strike FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, expiration
      ORDER BY abs(strike - underlying_price), strike) AS place
    FROM (SELECT DISTINCT symbol, expiration, strike, underlying_price FROM valid))
  WHERE place = 1),
put_wings AS (
  SELECT s.symbol, s.expiration, s.strike AS k, l.strike AS wing, s.mid AS sm, l.mid AS lm,
    s.strike - l.strike AS w, s.underlying_price AS u, s.dte, s.delta AS sd, l.delta AS ld,
    s.implied_vol AS iv
  FROM valid s JOIN atm USING (symbol, expiration, strike)
  JOIN valid l ON s.symbol = l.symbol AND s.expiration = l.expiration AND l.strike < s.strike
  WHERE s."right" = 'P' AND l."right" = 'P'),
call_wings AS (
  SELECT s.symbol, s.expiration, s.strike AS k, l.strike AS wing, s.mid AS sm, l.mid AS lm,
    l.strike - s.strike AS w, s.delta AS sd, l.delta AS ld, s.implied_vol AS iv
  FROM valid s JOIN atm USING (symbol, expiration, strike)
  JOIN valid l ON s.symbol = l.symbol AND s.expiration = l.expiration AND l.strike > s.strike
  WHERE s."right" = 'C' AND l."right" = 'C'),
flies AS (
  SELECT p.symbol, p.expiration, p.dte, p.k, p.wing AS pwing, c.wing AS cwing, p.w, p.u,
    p.sm AS psm, c.sm AS csm, p.lm AS plm, c.lm AS clm, p.sd AS psd, p.ld AS pld,
    c.sd AS csd, c.ld AS cld, p.iv AS piv, c.iv AS civ, (p.sm - p.lm) + (c.sm - c.lm) AS t
  FROM put_wings p JOIN call_wings c ON p.symbol = c.symbol AND p.expiration = c.expiration
    AND p.k = c.k AND p.w = c.w),
iron_butterflies AS (
  SELECT symbol, expiration, dte, k AS atm_strike, pwing AS put_wing_strike,
    cwing AS call_wing_strike, w AS wing_width, psm AS short_put_mid, csm AS short_call_mid,
    plm AS long_put_mid, clm AS long_call_mid, t * 100 AS total_credit, t * 100 AS max_profit,
    (w - t) * 100 AS max_loss, t / w * 100 AS spread_ratio,
    t * 100 / ((w - t) * 100) * 100 AS credit_yield, t / k * 100 AS "ROC",
    k - t AS lower_breakeven, k + t AS upper_breakeven, u AS underlying_price,
    abs(u - k) / u * 100 AS pct_to_atm_strike,
    abs(u - (k - t)) / u * 100 AS pct_to_lower_breakeven,
    abs(u - (k + t)) / u * 100 AS pct_to_upper_breakeven, psd AS short_put_delta,
    pld AS long_put_delta, csd AS short_call_delta, cld AS long_call_delta,
    piv AS atm_put_iv, civ AS atm_call_iv
  FROM flies WHERE t > 0 AND (w - t) * 100 > 0)"""

STRANGLES = """
put_call AS (
  SELECT p.symbol, p.expiration, p.underlying_price AS pu, c.underlying_price AS cu,
    p.strike AS ps, c.strike AS cs, p.mid AS pm, c.mid AS cm, p.mid + c.mid AS t, p.dte,
    p.strike - (p.mid + c.mid) AS lo, c.strike + (p.mid + c.mid) AS hi,
    p.delta + c.delta AS net_delta, p.gamma + c.gamma AS net_gamma,
    p.theta + c.theta AS net_theta, p.vega + c.vega AS net_vega, p.delta AS put_delta,
    c.delta AS call_delta, p.implied_vol AS put_implied_vol, c.implied_vol AS call_implied_vol
  FROM valid p JOIN valid c ON p.symbol = c.symbol AND p.expiration = c.expiration
  WHERE p."right" = 'P' AND c."right" = 'C' AND p.strike < p.underlying_price
    AND c.strike > c.underlying_price AND p.mid + c.mid > 0),
strangles AS (
  SELECT symbol, expiration, pu AS underlying_price, ps AS put_strike, cs AS call_strike,
    pm AS put_mid, cm AS call_mid, t * 100 AS total_premium, lo AS lower_breakeven,
    hi AS upper_breakeven, hi - lo AS breakeven_width,
    abs(pu - ps) / pu * 100 AS pct_to_put_strike, abs(cu - cs) / cu * 100 AS pct_to_call_strike,
    abs(pu - lo) / pu * 100 AS pct_to_lower_breakeven,
    abs(cu - hi) / cu * 100 AS pct_to_upper_breakeven, t / ((ps + cs) / 2) * 100 AS "ROC", dte,
    net_delta, net_gamma, net_theta, net_vega, put_delta, call_delta, put_implied_vol,
    call_implied_vol
  FROM put_call)"""

CALENDARS = """
calendars AS (
  SELECT n.symbol, n."right", n.strike, n.expiration AS near_expiration,
    f.expiration AS far_expiration, n.dte AS near_dte, f.dte AS far_dte,
    f.dte - n.dte AS dte_gap, n.mid AS near_mid, f.mid AS far_mid,
    (f.mid - n.mid) * 100 AS net_debit, n.mid * 100 AS approx_max_profit,
    n.mid * 100 / ((f.mid - n.mid) * 100) * 100 AS "approx_ROC",
    n.theta - f.theta AS theta_differential, n.implied_vol - f.implied_vol AS iv_differential,
    n.underlying_price, abs(n.underlying_price - n.strike) / n.underlying_price * 100
      AS pct_to_strike,
    n.delta AS near_delta, f.delta AS far_delta, n.implied_vol AS near_iv,
    f.implied_vol AS far_iv, n.theta AS near_theta, f.theta AS far_theta
  FROM valid n JOIN valid f ON n.symbol = f.symbol AND n."right" = f."right"
    AND n.strike = f.strike AND n.expiration < f.expiration AND f.dte >= n.dte + 7
  WHERE f.mid - n.mid > 0)"""

EXPECTED_MOVE = """
atm_contracts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, expiration, "right"
      ORDER BY abs(strike - underlying_price), strike) AS place FROM valid) WHERE place = 1),
expected_move AS (
  SELECT c.symbol, c.expiration, c.dte, c.underlying_price, c.strike AS atm_call_strike,
    p.strike AS atm_put_strike, c.mid AS atm_call_mid, p.mid AS atm_put_mid,
    c.mid + p.mid AS expected_move, (c.mid + p.mid) * 100 AS expected_move_contract,
    (c.mid + p.mid) / c.underlying_price * 100 AS move_pct,
    c.underlying_price + (c.mid + p.mid) AS upper_bound,
    c.underlying_price - (c.mid + p.mid) AS lower_bound,
    (c.implied_vol + p.implied_vol) / 2 AS avg_atm_iv
  FROM atm_contracts c JOIN atm_contracts p ON c.symbol = p.symbol
    AND c.expiration = p.expiration
  WHERE c."right" = 'C' AND p."right" = 'P')"""

MAX_PAIN = """
held AS (SELECT * FROM chain WHERE open_interest > 0),
candidate AS (
  SELECT DISTINCT symbol, expiration, strike, underlying_price, dte FROM held),
call_pain AS (
  SELECT k.symbol, k.expiration, k.strike, k.underlying_price, k.dte,
    sum((k.strike - c.strike) * c.open_interest) AS call_pain
  FROM candidate k JOIN held c ON c.symbol = k.symbol AND c.expiration = k.expiration
    AND c.strike < k.strike
  WHERE c."right" = 'C' GROUP BY ALL),
put_pain AS (
  SELECT k.symbol, k.expiration, k.strike,
    sum((p.strike - k.strike) * p.open_interest) AS put_pain
  FROM candidate k JOIN held p ON p.symbol = k.symbol AND p.expiration = k.expiration
    AND p.strike > k.strike
  WHERE p."right" = 'P' GROUP BY ALL),
max_pain_curve AS (
  SELECT c.symbol, c.expiration, c.dte, c.underlying_price, c.strike AS candidate_strike,
    c.call_pain, coalesce(p.put_pain, 0e0) AS put_pain,
    c.call_pain + coalesce(p.put_pain, 0e0) AS total_pain
  FROM call_pain c LEFT JOIN put_pain p USING (symbol, expiration, strike)),
max_pain AS (
  SELECT symbol, expiration, dte, underlying_price, candidate_strike AS max_pain_strike,
    call_pain, put_pain, total_pain,
    (candidate_strike - underlying_price) / underlying_price * 100 AS pct_from_underlying
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, expiration
    ORDER BY total_pain, candidate_strike) AS place FROM max_pain_curve) WHERE place = 1)"""

VENUES = f"""
symbols AS (
  SELECT s_suppkey AS key, {SYMBOL.format(key="s_suppkey")} AS symbol,
    50e0 + ((s_suppkey * 37) % 400) * 0.5e0 AS u FROM supplier),
listing AS (
  SELECT symbol, u, key, CASE WHEN key % 10 = 3 THEN 'REGIONAL' ELSE 'MAIN' END AS exchange,
    CASE WHEN key % 10 = 3 THEN 2 ELSE 1 END AS step FROM symbols
  UNION ALL SELECT symbol, u, key, 'ALT', 2 FROM symbols),
preferred AS (
  SELECT * FROM listing
  WHERE exchange = CASE WHEN key % 10 = 3 THEN 'ALT' ELSE 'MAIN' END),
listed_expiration AS (
  SELECT symbol, DATE '2026-04-17' + CAST(14 * i AS INTEGER) AS expiration
  FROM preferred, range(0, 7) r(i) WHERE i % step = 0),
listed_strike AS (
  SELECT symbol, u, floor(u / 2.5e0) * 2.5e0 + 2.5e0 * (i - 6) AS strike
  FROM preferred, range(0, 13) r(i) WHERE i % step = 0),
universe AS (
  SELECT e.symbol, e.expiration, k.strike, t.rt AS "right"
  FROM listed_expiration e JOIN listed_strike k ON e.symbol = k.symbol,
    (VALUES ('C'), ('P')) t(rt)
  WHERE e.expiration BETWEEN DATE '2026-04-01' + 15 AND DATE '2026-04-01' + 75
    AND k.strike BETWEEN k.u * (1 - 0.2e0) AND k.u * (1 + 0.2e0))"""

STRATEGIES = ",".join(
    [VALID, SPREADS, CONDORS, BUTTERFLIES, STRANGLES, CALENDARS, EXPECTED_MOVE, MAX_PAIN]
)
CTES = f"WITH {CHAIN},{STRATEGIES},{VENUES}"


def quoted(columns: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in columns)


def dataset(name: str, where: str = "") -> str:
    return f"{CTES} SELECT {quoted(RESULT_COLUMNS[name])} FROM {TABLE_OF.get(name, name)} {where}"


TABLE_OF = {"option_chain": "chain"}

KEY = 'symbol, expiration, strike, "right"'

LIMITS = "spread_ratio >= 25 AND credit_yield >= 30"

NUMERIC = [
    "strike", "bid", "ask", "last", "close", "mid", "delta", "gamma", "theta", "vega",
    "implied_vol", "open_interest", "volume", "underlying_price", "dte",
]

DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS "min",
    round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75,
    CAST(max({c}) AS DOUBLE) AS "max" FROM chain"""
    for c in NUMERIC
)

NULLS = " UNION ALL ".join(
    f"""SELECT '{name}' AS dataset, '{c}' AS "column", count(*) AS null_count
    FROM {TABLE_OF.get(name, name)} WHERE "{c}" IS NULL"""
    for name, columns in RESULT_COLUMNS.items()
    for c in columns
)

SIZES = " UNION ALL ".join(
    f"""SELECT '{name}' AS dataset, count(*) AS n_rows, {len(columns)} AS n_columns
    FROM {TABLE_OF.get(name, name)}"""
    for name, columns in RESULT_COLUMNS.items()
)


def board(
    name: str, table: str, metric: str, strikes: list[str], where: str = "",
    expirations: tuple[str, ...] = ("expiration",), right: str = "NULL",
) -> str:
    padded = strikes + ["NULL"] * (4 - len(strikes))
    ties = ["symbol", *expirations, *(['"right"'] if right != "NULL" else []), *strikes]
    far = expirations[1] if len(expirations) > 1 else "NULL"
    columns = ", ".join(f"CAST({s} AS DOUBLE) AS strike_{i}" for i, s in enumerate(padded, 1))
    return f"""SELECT * FROM (SELECT '{name}' AS board, CAST(row_number() OVER (
      ORDER BY {metric} DESC NULLS LAST, {", ".join(ties)}) AS INTEGER) AS place,
    {metric} AS metric, symbol, {expirations[0]} AS expiration, CAST({far} AS DATE)
    AS far_expiration, CAST({right} AS VARCHAR) AS "right", {columns} FROM {table} {where})
    WHERE place <= 10"""


TOP = " UNION ALL ".join(
    [
        board("credit", "spreads", "spread_ratio", ["short_strike", "long_strike"],
              "WHERE strategy LIKE '%Credit%'", right='"right"'),
        board("debit", "spreads", "spread_ratio", ["short_strike", "long_strike"],
              "WHERE strategy LIKE '%Debit%'", right='"right"'),
        board("condors", "iron_condors", "spread_ratio", [
            "put_short_strike", "put_long_strike", "call_short_strike", "call_long_strike"]),
        board("butterflies", "iron_butterflies", "spread_ratio",
              ["atm_strike", "put_wing_strike", "call_wing_strike"]),
        board("strangles", "strangles", "total_premium", ["put_strike", "call_strike"]),
        board("calendars", "calendars", "theta_differential", ["strike"],
              expirations=("near_expiration", "far_expiration"), right='"right"'),
    ]
)

QUALITY = ", ".join(
    f"""count(*) FILTER ({c} IS NULL) AS {c}_null,
    count(*) FILTER ({c} IS NULL) / count(*) * 100 AS {c}_null_pct"""
    for c in ("bid", "ask", "mid", "delta", "close")
)


# The chain with expirations five days apart and open interest missing here and there.
WEEKLY = """
weekly AS (
  SELECT symbol, strike, "right", bid, ask, last, close, mid, delta, gamma, theta, vega,
    implied_vol, volume, underlying_price, CAST(16 + 5 * ((dte - 16) // 14) AS INTEGER) AS dte,
    DATE '2026-04-01' + CAST(16 + 5 * ((dte - 16) // 14) AS INTEGER) AS expiration,
    CASE CAST(strike * 2e0 + dte AS INTEGER) % 3 WHEN 0 THEN 0e0 WHEN 1 THEN open_interest END
      AS open_interest
  FROM chain)"""


def of_weekly(name: str, ctes: str) -> str:
    own = ctes.replace(" FROM chain ", " FROM weekly ")
    valid = VALID.replace(" FROM chain ", " FROM weekly ")
    return f"WITH {CHAIN},{WEEKLY},{valid},{own} SELECT {quoted(RESULT_COLUMNS[name])} FROM {name}"


LISTING_TIES = """
entries AS (
  SELECT symbol, key, exchange, list_sort(list(DISTINCT strftime(
      DATE '2026-04-17' + CAST(14 * i AS INTEGER), '%Y%m%d')) FILTER (i < 7)) AS expirations,
    list_sort(list(DISTINCT floor(u / 2.5e0) * 2.5e0 + 2.5e0 * (i - 6))) AS strikes
  FROM listing, range(0, 13) r(i) WHERE i % step = 0 GROUP BY symbol, key, exchange),
ties AS (
  SELECT symbol, exchange, expirations, strikes FROM entries
  UNION ALL SELECT symbol, exchange,
    CASE WHEN exchange = 'ALT' THEN expirations[2:4] ELSE expirations[1:3] END, strikes
    FROM entries WHERE key % 3 = 0
  UNION ALL SELECT symbol, NULL, expirations[1:1], strikes FROM entries WHERE key % 5 = 0),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY coalesce(exchange <> 'MAIN', true),
    exchange IS NULL, exchange, expirations, strikes) AS place FROM ties)"""

POLL_TIES = """
polls AS (
  SELECT symbol, 1 AS poll, CASE WHEN key % 2 <> 0 THEN u END AS price FROM symbols WHERE key % 11 <> 0
  UNION ALL SELECT symbol, 2, CASE WHEN key % 2 = 0 THEN u ELSE u + 0.25e0 END FROM symbols
    WHERE key % 11 <> 0
  UNION ALL SELECT symbol, 3, u + 0.5e0 FROM symbols WHERE key % 11 <> 0
  UNION ALL SELECT symbol, 2, u - 1e0 FROM symbols WHERE key % 4 = 0 AND key % 11 <> 0
  UNION ALL SELECT symbol, 1, u - 2e0 FROM symbols WHERE key % 4 = 1 AND key % 11 <> 0
  UNION ALL SELECT symbol, NULL, 1e0 FROM symbols WHERE key % 7 = 0)"""

REASON = """CASE WHEN strike % 25 = 0 AND "right" = 'C' THEN 'unreadable'
    WHEN strike % 25 = 5 AND "right" = 'P' THEN 'symbol missing'
    WHEN strike % 25 = 10 AND "right" = 'P' THEN 'unreadable'
    WHEN strike % 25 = 15 AND "right" = 'C' THEN 'underlying_price missing' END"""


def with_shown_rows(sql: dict[str, str]) -> dict[str, str]:
    counts = (
        f"SELECT '{name}' AS screen, count(*) AS n_rows FROM ({own})"
        for name, own in sql.items()
        if name.startswith("screen_")
    )
    return sql | {"shown_rows": " UNION ALL ".join(counts)}


def oracle_sql() -> dict[str, str]:
    quotes = quoted([c for c in RESULT_COLUMNS["option_chain"] if c != "underlying_price"])
    snapshot = f"{CTES} SELECT {quotes} FROM chain"
    return with_shown_rows({
        "chain_snapshot": snapshot,
        "live_chain": snapshot,
        "live_state": snapshot,
        "symbol_universe": f"""SELECT DISTINCT {SYMBOL.format(key="(s_suppkey + d)")} AS symbol
            FROM supplier, (VALUES (0), (1)) t(d)""",
        "preferred_listing": f"""{CTES} SELECT symbol, exchange,
            CAST((SELECT count(*) FROM range(0, 7) r(i) WHERE i % step = 0) AS INTEGER)
              AS n_expirations,
            '20260417' AS first_expiration, '20260710' AS last_expiration,
            CAST((SELECT count(*) FROM range(0, 13) r(i) WHERE i % step = 0) AS INTEGER)
              AS n_strikes,
            floor(u / 2.5e0) * 2.5e0 - 15e0 AS low_strike,
            floor(u / 2.5e0) * 2.5e0 + 15e0 AS high_strike FROM preferred""",
        "preferred_listing_ties": f"""{CTES},{LISTING_TIES} SELECT symbol, exchange,
            CAST(len(expirations) AS INTEGER) AS n_expirations,
            list_min(expirations) AS first_expiration, list_max(expirations) AS last_expiration,
            CAST(len(strikes) AS INTEGER) AS n_strikes, list_min(strikes) AS low_strike,
            list_max(strikes) AS high_strike FROM picked WHERE place = 1""",
        "dte_window": f"""{CTES} SELECT symbol, expiration FROM listed_expiration
            WHERE expiration BETWEEN DATE '2026-04-01' + 30 AND DATE '2026-04-01' + 58""",
        "strike_band": f"""{CTES} SELECT symbol, strike, u AS underlying_price
            FROM listed_strike
            WHERE strike BETWEEN u * (1 - 0.1e0) AND u * (1 + 0.1e0)""",
        "contract_universe": f"{CTES} SELECT {KEY} FROM universe",
        "listed_contracts": f"""{CTES} SELECT {KEY} FROM universe
            INTERSECT SELECT {KEY} FROM chain""",
        "underlying_price": f"{CTES} SELECT symbol, u AS underlying_price FROM symbols",
        "underlying_price_ties": f"""{CTES},{POLL_TIES} SELECT symbol, price AS underlying_price
            FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY poll NULLS LAST, price)
              AS place FROM polls WHERE price IS NOT NULL) WHERE place = 1""",
        "vendor_price": f"""{CTES} SELECT {KEY}, CASE WHEN bid > 0 AND ask > 0
              THEN (bid + ask) / 2e0 WHEN volume <= 20 THEN strike / 4e0 END AS mid FROM chain
            WHERE (bid > 0 AND ask > 0) OR volume <= 20""",
        "clean_numbers": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
            CASE WHEN l_linenumber = 1 OR l_quantity > 40 THEN NULL
              WHEN l_returnflag = 'R' THEN -1e0
              WHEN l_linestatus = 'O' THEN l_quantity END AS number,
            CASE WHEN l_linenumber = 1 OR l_quantity > 40 OR l_returnflag = 'R' THEN NULL
              WHEN l_linestatus = 'O' THEN l_quantity END AS number_or_null FROM lineitem""",
        "best_price": f"{CTES} SELECT {KEY}, mid FROM valid",
        "flatten_greeks": f"""{CTES} SELECT {KEY}, delta, gamma, theta, vega, implied_vol
            FROM chain""",
        "expiry_dte": f"""{CTES} SELECT symbol, strike, "right",
            strftime(expiration, '%Y%m%d') AS expiry_text, expiration, dte FROM chain""",
        "oi_volume_by_right": f"{CTES} SELECT {KEY}, open_interest, volume FROM chain",
        "chain": dataset("option_chain", "WHERE mid IS NOT NULL"),
        "scan_chain": dataset(
            "option_chain",
            f"WHERE mid IS NOT NULL AND ({KEY}) IN (SELECT ({KEY}) FROM universe)",
        ),
        "vertical_spreads": dataset("spreads"),
        "dataset_roundtrip": dataset("spreads"),
        "vertical_spreads_repeated": dataset("spreads"),
        "iron_condors": dataset("iron_condors"),
        "live_scan": dataset("iron_condors"),
        "iron_butterflies": dataset("iron_butterflies"),
        "strangles": dataset("strangles"),
        "calendars": dataset("calendars"),
        "calendars_weekly": of_weekly("calendars", CALENDARS),
        "expected_move": dataset("expected_move"),
        "symbol_rerun": dataset("expected_move"),
        "typed_read": dataset("option_chain", f"WHERE ({REASON}) IS NULL"),
        "refused_rows": f"""{CTES} SELECT reason, count(*) AS n_rows
            FROM (SELECT {REASON} AS reason FROM chain) WHERE reason IS NOT NULL GROUP BY reason""",
        "max_pain": dataset("max_pain"),
        "max_pain_sparse": of_weekly("max_pain", MAX_PAIN),
        "max_pain_curve": f"{CTES} SELECT * FROM max_pain_curve",
        "max_pain_curve_all": f"""{CTES} SELECT k.symbol, k.expiration, k.dte,
            k.underlying_price, k.strike AS candidate_strike,
            coalesce(c.call_pain, 0e0) AS call_pain, coalesce(p.put_pain, 0e0) AS put_pain,
            coalesce(c.call_pain, 0e0) + coalesce(p.put_pain, 0e0) AS total_pain
            FROM candidate k LEFT JOIN call_pain c USING (symbol, expiration, strike)
            LEFT JOIN put_pain p USING (symbol, expiration, strike)""",
        "filter_choices": f"""{CTES}
            SELECT DISTINCT 'symbol' AS "column", symbol AS choice FROM chain
            UNION ALL SELECT DISTINCT 'expiration', CAST(expiration AS VARCHAR) FROM chain
            UNION ALL SELECT DISTINCT 'right', "right" FROM chain
            UNION ALL SELECT DISTINCT 'strategy', strategy FROM spreads""",
        "screen_credit": dataset(
            "spreads",
            f"""WHERE strategy LIKE '%Credit%' AND {LIMITS} AND pct_to_short_strike >= 5
            AND pct_to_long_strike >= 5""",
        ),
        "screen_debit": dataset("spreads", "WHERE strategy LIKE '%Debit%'"),
        "screen_condors": dataset("iron_condors", f"WHERE {LIMITS}"),
        "screen_butterflies": dataset("iron_butterflies", f"WHERE {LIMITS}"),
        "screen_strangles": dataset("strangles"),
        "screen_calendars": dataset("calendars", """WHERE "right" = 'P'"""),
        "screen_chosen": dataset("calendars", """WHERE "right" = 'P'
            AND symbol IN (SELECT symbol FROM expected_move WHERE move_pct >= 10)"""),
        "screen_expected_move": dataset("expected_move"),
        "screen_max_pain": dataset("max_pain"),
        "screen_chain": dataset("option_chain"),
        "quote_quality": f"""{CTES} SELECT count(*) AS total, {QUALITY},
            count(*) FILTER (bid IS NULL) / count(*) > 0.5 AS bids_mostly_missing,
            count(*) FILTER (close IS NULL) / count(*) < 0.5 AS close_available FROM chain""",
        "chain_describe": f"{CTES} {DESCRIBE}",
        "strategy_counts": f"{CTES} SELECT strategy, count(*) AS n FROM spreads GROUP BY strategy",
        "top10_by_strategy": f"{CTES} {TOP}",
        "top10_of_chain": f"{CTES} {TOP}",
        "null_profile": f"{CTES} SELECT * FROM ({NULLS}) WHERE null_count > 0",
        "null_profile_read": f"{CTES} SELECT * FROM ({NULLS}) WHERE null_count > 0",
        "dataset_sizes": f"{CTES} {SIZES}",
        "dataset_sizes_read": f"{CTES} {SIZES}",
        "scan_counts": f"{CTES} SELECT dataset, n_rows FROM ({SIZES})",
        "chain_preview": dataset("option_chain", f"ORDER BY {KEY} LIMIT 10"),
    })
