"""Inputs with hand-computed results."""

import numpy as np

from tickframe.schemas import BRONZE_KLINE

H = 1704067200000  # 2024-01-01 00:00 UTC

BAR_1 = ("BTCUSDT", "1h", H, "51300.00", "51800.00", "51100.00", "51500.00", "100.00",
         H + 3599999, "5130000.00", 1000, "50.00", "2565000.00")
BAR_2 = ("BTCUSDT", "1h", H + 3600000, "51500.00", "52100.00", "51400.00", "51900.00", "200.00",
         H + 7199999, "10260000.00", 2000, "100.00", "5130000.00")

TRADE_TEXT = ('{"e":"trade","E":1720000000000,"s":"BTCUSDT","t":908172,"p":"712000.00","q":"0.001",'
              '"b":111,"a":222,"T":1720000000000,"m":false}')
KLINE_TEXT = ('{"e":"kline","E":1720000000000,"s":"BTCUSDT","k":{"t":1720000000000,"T":1720000059999,'
              '"s":"BTCUSDT","i":"1m","o":"712000.00","c":"712100.00","h":"712200.00","l":"711900.00",'
              '"v":"10.5","n":150,"x":false,"q":"7477050.00"}}')


def bronze(spark, *bars):
    return spark.createDataFrame(list(bars), BRONZE_KLINE)


def walk(n, seed=42):
    """Prices of a random walk around 100."""
    return (np.random.RandomState(seed).randn(n).cumsum() + 100).tolist()


def series(spark, prices_by_symbol, interval="1m", gaps=None, step=60000):
    """Bars of given closes; ``gaps`` maps a position to extra minutes before it."""
    out = []
    for symbol, prices in prices_by_symbol.items():
        t = H
        for i, p in enumerate(prices):
            t += step * (1 + (gaps or {}).get(i, 0))
            out.append((symbol, interval, t, float(p), float(i % 7)))
    return spark.createDataFrame(out, "symbol string, interval string, open_time long, close double, volume double")


def ema_loop(x, n):
    a, out = 2 / (n + 1), []
    for v in x:
        out.append(v if not out else a * v + (1 - a) * out[-1])
    return out


def rsi_loop(x, n=14):
    if len(x) <= n:
        return [50.0] * len(x)
    ups = [max(b - a, 0) for a, b in zip(x, x[1:])]
    downs = [max(a - b, 0) for a, b in zip(x, x[1:])]
    up, down = sum(ups[:n]) / n, sum(downs[:n]) / n
    out = [50.0] * n
    for i in range(n, len(x)):
        if i > n:
            up += (ups[i - 1] - up) / n
            down += (downs[i - 1] - down) / n
        out.append(100.0 if down == 0 else 100 - 100 / (1 + up / down))
    return out


def macd_loop(x, fast=12, slow=26, signal=9):
    line = [a - b for a, b in zip(ema_loop(x, fast), ema_loop(x, slow))]
    trigger = ema_loop(line, signal)
    return line, trigger
