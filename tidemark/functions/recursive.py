"""Indicators that each value's predecessor decides: exponential averages, MACD, RSI, smoothing, decomposition.

A series is one group (a key and its ordered values), so groups are as long as a calendar; they run in the
Arrow workers, and series are independent of each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ema(x: np.ndarray, span: int) -> np.ndarray:
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def macd(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema(x, 12) - ema(x, 26)
    signal = ema(line, 9)
    return line, signal, line - signal


def rsi(x: np.ndarray, period: int = 14) -> np.ndarray:
    """Wilder's index; 50 up to the first full period, 100 where there are no losses."""
    out = np.full(len(x), 50.0)
    if len(x) <= period + 1:
        return out
    moves = np.diff(x)
    gain, loss = np.maximum(moves, 0), np.maximum(-moves, 0)
    up, down = gain[:period].mean(), loss[:period].mean()
    for i in range(period, len(moves)):
        up, down = (up * (period - 1) + gain[i]) / period, (down * (period - 1) + loss[i]) / period
        out[i + 1] = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
    return out


def holt_winters(x: np.ndarray, horizon: int = 7, period: int = 7, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.2) -> np.ndarray:
    """Additive trend and season on the last 90 values; a plain repeat of the last value for short series."""
    x = x[-90:]
    if len(x) < 2 * period:
        return np.repeat(x[-1] if len(x) else np.nan, horizon)
    level, trend = x[:period].mean(), (x[period : 2 * period].mean() - x[:period].mean()) / period
    season = list(x[:period] - level)
    for i in range(period, len(x)):
        before = level
        level = alpha * (x[i] - season[i - period]) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        season.append(gamma * (x[i] - level) + (1 - gamma) * season[i - period])
    return np.array([level + (h + 1) * trend + season[len(x) - period + h % period] for h in range(horizon)])


def arima_forecast(x: np.ndarray, horizon: int = 7, p: int = 2, q: int = 2, longest: int = 365) -> np.ndarray:
    """ARIMA(p, 1, q) on logarithms of the last values: innovations from a long autoregression, then least squares on p lags and q innovations.

    Not the exact maximum likelihood. A short or constant series repeats its last value.
    """
    x = np.log(np.maximum(x[-longest:], 1))
    d = np.diff(x)
    long, most = 10, max(p, q)
    if len(d) < 4 * long or not d.std():
        return np.repeat(np.exp(x[-1]) if len(x) else np.nan, horizon)
    lags = lambda v, n, start: np.column_stack([v[start - k - 1 : len(v) - k - 1] for k in range(n)])
    wide = np.column_stack([np.ones(len(d) - long), lags(d, long, long)])
    shocks = np.zeros(len(d))
    shocks[long:] = d[long:] - wide @ np.linalg.lstsq(wide, d[long:], rcond=None)[0]
    start = long + most
    rows = np.column_stack([np.ones(len(d) - start), lags(d, p, start), lags(shocks, q, start)])
    coef = np.linalg.lstsq(rows, d[start:], rcond=None)[0]
    last, noise, out, at = list(d[::-1][:p]), list(shocks[::-1][:q]), [], x[-1]
    for _ in range(horizon):
        step = float(np.clip(coef[0] + coef[1 : 1 + p] @ last + coef[1 + p :] @ noise, -0.5, 0.5))
        at += step
        out.append(at)
        last, noise = [step, *last[:-1]], [0.0, *noise[:-1]]
    return np.exp(np.array(out))


def vmd(x: np.ndarray, modes: int = 3, alpha: float = 2000.0, tolerance: float = 1e-7, rounds: int = 500) -> np.ndarray:
    """Variational mode decomposition by alternating updates in the frequency domain, as published; modes by row."""
    n = len(x)
    half = n // 2
    mirrored = np.concatenate([x[:half][::-1], x, x[n - half :][::-1]])
    t = len(mirrored)
    freqs = np.arange(t) / t - 0.5
    f = np.fft.fftshift(np.fft.fft(mirrored))
    f[: t // 2] = 0
    u, omega, lam = np.zeros((modes, t), complex), np.arange(modes) * 0.5 / modes, np.zeros(t, complex)
    for _ in range(rounds):
        before = u.copy()
        for k in range(modes):
            u[k] = (f - u.sum(0) + u[k] - lam / 2) / (1 + alpha * (freqs - omega[k]) ** 2)
            power = np.abs(u[k, t // 2 :]) ** 2
            omega[k] = (freqs[t // 2 :] @ power) / max(power.sum(), 1e-300)
        if np.sum(np.abs(u - before) ** 2) / t < tolerance:
            break
    full = np.zeros((modes, t), complex)
    full[:, t // 2 :] = u[:, t // 2 :]
    full[:, 1 : t // 2 + 1][:, ::-1] = np.conj(u[:, t // 2 : t // 2 + t // 2])
    signal = np.real(np.fft.ifft(np.fft.ifftshift(full, axes=-1), axis=-1))
    return signal[:, half : half + n]


def loess(y: np.ndarray, width: int, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local lines through the `width` nearest of the points 0, 1, ...: tricube weights times the points' own; values at given places."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else at
    own = np.ones(n) if weights is None else weights
    k = min(width, n)
    first = np.clip(np.round(at).astype(int) - k // 2, 0, n - k)
    near = first[:, None] + np.arange(k)
    far = np.abs(near - at[:, None])
    reach = far.max(axis=1, keepdims=True) * (1 if width <= n else 1 + (width - n) / (2 * n)) + 1e-12
    w = np.clip(1 - (far / reach) ** 3, 0, None) ** 3 * own[near]
    total = w.sum(axis=1)
    total = np.where(total > 0, total, 1)
    mx, my = (w * near).sum(axis=1) / total, (w * y[near]).sum(axis=1) / total
    dx = near - mx[:, None]
    spread = (w * dx * dx).sum(axis=1)
    slope = np.where(spread > 1e-9, (w * dx * y[near]).sum(axis=1) / np.where(spread > 1e-9, spread, 1), 0)
    return my + slope * (at - mx)


def stl(x: np.ndarray, period: int = 7, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and residual by the published procedure: loess of each phase and of the trend, with robustness weights."""
    n = len(x)
    if n < 2 * period:
        return x.copy(), np.zeros(n), np.zeros(n)
    odd = lambda v: int(v) + (int(v) % 2 == 0)
    width, low = odd(np.ceil(1.5 * period / (1 - 1.5 / seasonal))), odd(period)
    mean = lambda v, k: np.convolve(v, np.ones(k) / k, "valid")
    trend, season, own = np.zeros(n), np.zeros(n), np.ones(n)
    for turn in range(outer + 1):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * period)
            for phase in range(period):
                part = (x - trend)[phase::period]
                cycle[phase::period][: len(part) + 2] = loess(part, seasonal, own[phase::period], np.arange(-1.0, len(part) + 1))
            level = loess(mean(mean(mean(cycle, period), period), 3), low)
            season = cycle[period : period + n] - level
            trend = loess(x - season, width, own)
        rest = x - trend - season
        scale = 6 * np.median(np.abs(rest))
        if turn == outer or scale <= 1e-12:
            break
        own = np.clip(1 - (np.abs(rest) / scale) ** 2, 0, None) ** 2
    return trend, season, x - trend - season


def indicators(series: DataFrame, key: str = "species", order: str = "at", value: str = "p") -> DataFrame:
    """Each series with ema7, ema30, macd, signal, hist and rsi14."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[value].to_numpy(float)
        line, signal, hist = macd(x)
        return pdf.assign(ema7=ema(x, 7), ema30=ema(x, 30), macd=line, signal=signal, hist=hist, rsi14=rsi(x))[[key, order, "ema7", "ema30", "macd", "signal", "hist", "rsi14"]]

    kind = series.schema[order].dataType.simpleString()
    return series.groupBy(key).applyInPandas(work, f"{key} string, {order} {kind}, ema7 double, ema30 double, macd double, signal double, hist double, rsi14 double")


def forecasts(series: DataFrame, horizon: int = 7, key: str = "species", order: str = "at", value: str = "p") -> DataFrame:
    """The next values of each series by smoothing, by autoregression and as repeated, with a band for the first."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        smooth, auto = holt_winters(x, horizon), arima_forecast(x, horizon)
        h = np.arange(1, horizon + 1)
        spread = 1.28 * np.diff(x[-90:]).std() * np.sqrt(h) if len(x) > 2 else np.zeros(horizon)
        return pd.DataFrame({key: pdf[key].iloc[0], "step": h, "naive": x[-1], "holt_winters": smooth, "low": smooth - spread, "high": smooth + spread, "arima": auto})

    return series.groupBy(key).applyInPandas(work, f"{key} string, step long, naive double, holt_winters double, low double, high double, arima double")


def decomposed(series: DataFrame, key: str = "species", order: str = "at", value: str = "p", modes: int = 3) -> DataFrame:
    """Each series with its trend, season and residual, and the residual's variational modes as an array."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        trend, season, rest = stl(pdf[value].to_numpy(float))
        parts = vmd(rest, modes) if len(rest) >= 16 else np.tile(rest / modes, (modes, 1))
        return pd.DataFrame({key: pdf[key].to_numpy(), order: pdf[order].to_numpy(), "trend": trend, "season": season, "residual": rest, "modes": list(parts.T)})

    kind = series.schema[order].dataType.simpleString()
    return series.groupBy(key).applyInPandas(work, f"{key} string, {order} {kind}, trend double, season double, residual double, modes array<double>")


#: The search's grid: numbers of modes, and penalties.
MODES, ALPHAS = tuple(range(3, 9)), tuple(range(500, 5001, 500))


def searched(parts: DataFrame, modes=MODES, alphas=ALPHAS, rounds: int = 500, key: str = "species", order: str = "at") -> DataFrame:
    """Of each series' residual (as `decomposed` gives it) the modes and penalty that give it back best: a task for each series and candidate."""
    grid = parts.sparkSession.createDataFrame([(k, float(a)) for k in modes for a in alphas], "n_modes int, alpha double")
    rows = parts.select(key, order, "residual").crossJoin(F.broadcast(grid))  # the grid: a few rows

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)["residual"].to_numpy(float)
        k, alpha = int(pdf["n_modes"].iloc[0]), float(pdf["alpha"].iloc[0])
        error = float(np.mean((vmd(x, k, alpha, rounds=rounds).sum(0) - x) ** 2)) if len(x) >= 16 else 0.0
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n_modes": [k], "alpha": [alpha], "error": [error]})

    tried = rows.groupBy(key, "n_modes", "alpha").applyInPandas(work, f"{key} string, n_modes int, alpha double, error double")
    best = F.min_by(F.struct("n_modes", "alpha", "error"), F.struct("error", "n_modes", "alpha")).alias("x")
    return tried.groupBy(key).agg(best, F.count("*").alias("tried")).select(key, "x.*", "tried")
