"""Small option chains: hand-written ones with known results, and random ones."""

from __future__ import annotations

import random
from datetime import date, timedelta

EXPIRY = date(2026, 5, 15)


def contract(strike, right, mid, delta=None, gamma=None, theta=None, vega=None, iv=None,
             oi=None, *, symbol="TEST", expiration=EXPIRY, dte=44, underlying=100.0, **more):
    return {
        "symbol": symbol, "expiration": expiration, "strike": float(strike), "right": right,
        "mid": mid, "delta": delta, "gamma": gamma, "theta": theta, "vega": vega,
        "implied_vol": iv, "open_interest": oi, "underlying_price": underlying, "dte": dte,
        **more,
    }


OTM = [
    contract(95, "P", 1.60, -0.30, 0.03, -0.05, 0.15, 0.25, 500.0),
    contract(90, "P", 0.90, -0.18, 0.02, -0.03, 0.10, 0.23, 300.0),
    contract(85, "P", 0.40, -0.08, 0.01, -0.01, 0.05, 0.22, 200.0),
    contract(105, "C", 1.50, 0.30, 0.03, -0.05, 0.15, 0.25, 600.0),
    contract(110, "C", 0.80, 0.18, 0.02, -0.03, 0.10, 0.23, 350.0),
    contract(115, "C", 0.35, 0.08, 0.01, -0.01, 0.05, 0.22, 180.0),
]
OTM_ITM = [
    *OTM,
    contract(105, "P", 5.50, -0.82, 0.02, -0.04, 0.12, 0.25, 150.0),
    contract(95, "C", 5.50, 0.82, 0.02, -0.04, 0.12, 0.25, 150.0),
]
STRANGLE = [
    OTM[0],
    contract(92, "P", 1.00, -0.20, 0.02, -0.03, 0.10, 0.23, 300.0),
    OTM[3],
    contract(108, "C", 0.90, 0.20, 0.02, -0.03, 0.10, 0.23, 350.0),
]
BUTTERFLY = [
    OTM[0],
    contract(100, "P", 3.10, -0.50, 0.05, -0.08, 0.20, 0.28, 800.0),
    contract(100, "C", 2.90, 0.50, 0.05, -0.08, 0.20, 0.26, 750.0),
    OTM[3],
]
NEAR = {"expiration": date(2026, 5, 16), "dte": 45}
FAR = {"expiration": date(2026, 6, 19), "dte": 79}
CALENDAR = [
    contract(105, "C", 1.50, theta=-0.06, iv=0.27, **NEAR),
    contract(105, "C", 2.40, theta=-0.04, iv=0.25, **FAR),
    contract(95, "P", 1.40, theta=-0.05, iv=0.26, **NEAR),
    contract(95, "P", 2.20, theta=-0.03, iv=0.24, **FAR),
]
ANALYTICS = [
    contract(95, "P", 1.60, iv=0.25, oi=500.0),
    contract(100, "P", 3.10, iv=0.28, oi=800.0),
    contract(105, "P", 5.70, iv=0.27, oi=300.0),
    contract(100, "C", 2.90, iv=0.26, oi=750.0),
    contract(105, "C", 1.50, iv=0.25, oi=600.0),
    contract(95, "C", 5.40, iv=0.27, oi=280.0),
]


def random_chain(seed: int, symbols: int = 3, expirations: int = 4, strikes: int = 14):
    """Unique contracts with stale quotes, missing mids, Greeks and interest, and ties."""
    rng = random.Random(seed)
    rows = []
    for s in range(symbols):
        underlying = rng.choice([50.0, 73.75, 100.0, 101.25])
        for e in range(expirations):
            expiration = date(2026, 4, 17) + timedelta(days=rng.choice([3, 7, 14]) + 14 * e)
            dte = (expiration - date(2026, 4, 1)).days
            for k in range(strikes):
                for right in "CP":
                    if rng.random() < 0.15:
                        continue
                    strike = 40.0 + 2.5 * k * rng.choice([1, 2])
                    greeks = [None] * 5 if rng.random() < 0.2 else [
                        round(rng.uniform(-1, 1), 3) for _ in range(5)
                    ]
                    rows.append(contract(
                        strike, right,
                        None if rng.random() < 0.1 else rng.randrange(1, 1200) / 100,
                        *greeks,
                        rng.choice([None, 0.0, 10.0, 20.0, 250.0]),
                        symbol=f"S{s}", expiration=expiration, dte=dte, underlying=underlying,
                    ))
    unique = {(r["symbol"], r["expiration"], r["strike"], r["right"]): r for r in rows}
    return list(unique.values())


def rows_of(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def keyed(rows, *key):
    result = {tuple(r[k] for k in key): r for r in rows}
    assert len(result) == len(rows), "key is not unique"
    return result
