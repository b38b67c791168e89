"""Local regression and one seasonal-trend pass (Cleveland et al. 1990) on a stretch of a series.

The stretch may be the whole series or a block with a halo. ``n`` is always the
length of the whole series, because the smoother's choice between a local line
and a local mean depends on it.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 22


def smooth_at(y: np.ndarray, at: np.ndarray, left: np.ndarray, width: int, span: int, n: int,
              weights: np.ndarray | None) -> np.ndarray:
    """Local linear fits at positions ``at`` over windows ``left .. left+width-1``; NaN without weight.

    ``span`` is the nominal window; when it exceeds the data the bandwidth grows with it.
    """
    out = np.empty(len(at))
    step = max(1, CHUNK // width)
    for a in range(0, len(at), step):
        x, lo = at[a:a + step, None], left[a:a + step, None]
        pos = lo + np.arange(width)
        h = np.maximum(x - lo, lo + width - 1 - x) + max(span - n, 0) // 2
        dist = np.abs(pos - x)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(dist <= 0.001 * h, 1.0, (1 - (dist / h) ** 3) ** 3)
        w = np.where(dist <= 0.999 * h, w, 0.0)
        if weights is not None:
            w = w * weights[pos]
        total = w.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = w / total
            mid = (w * pos).sum(1, keepdims=True)
            c = (w * (pos - mid) ** 2).sum(1, keepdims=True)
            tilt = 1 + (x - mid) / c * (pos - mid)
            line = (h > 0) & (np.sqrt(c) > 0.001 * (n - 1))
            fit = (np.where(line, w * tilt, w) * y[pos]).sum(1)
        out[a:a + step] = np.where(total[:, 0] > 0, fit, np.nan)
    return out


def smooth(y: np.ndarray, span: int, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Local fit at every point of ``y``; a point without any weight keeps its value."""
    size = len(y)
    width = min(span, size)
    i = np.arange(size)
    left = np.clip(i - (span + 1) // 2 + 1, 0, size - width) if span < size else np.zeros(size, int)
    fit = smooth_at(y, i.astype(float), left, width, span, n, weights)
    return np.where(np.isnan(fit), y, fit)


def _average(x: np.ndarray, width: int) -> np.ndarray:
    return np.convolve(x, np.ones(width) / width, "valid") if width < 32 else (
        np.subtract(*(lambda s: (s[width:], s[:-width]))(np.r_[0.0, np.cumsum(x)])) / width)


def _cycles(y: np.ndarray, period: int, span: int, n: int, first: int,
            weights: np.ndarray | None) -> np.ndarray:
    """Smoothed cycle-subseries with one extra cycle at both ends (length + 2 periods)."""
    out = np.empty(len(y) + 2 * period)
    for j in range(period):
        sub = y[j::period]
        w = None if weights is None else weights[j::period]
        k = len(sub)
        if not k:
            continue
        whole = (n - 1 - (first + j) % period) // period + 1
        fit = smooth(sub, span, whole, w)
        width = min(span, k)
        ends = smooth_at(sub, np.array([-1.0, float(k)]), np.array([0, k - width]), width, span, whole, w)
        ends = np.where(np.isnan(ends), fit[[0, -1]], ends)
        out[j::period][:k + 2] = np.r_[ends[0], fit, ends[1]]
    return out


def odd(x: float) -> int:
    k = int(np.ceil(x))
    return k + 1 if k % 2 == 0 else k


def spans(period: int, seasonal: int = 7) -> tuple[int, int, int]:
    """Windows of the seasonal, trend and low-pass smoothers."""
    return seasonal, odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period + 1)


def reach(period: int, passes: int = 2) -> int:
    """Rows on either side that can change a value within ``passes`` inner passes."""
    seasonal, trend, low = spans(period)
    return passes * ((seasonal // 2 + 2) * period + period + 2 + low + trend)


def season_and_trend(y: np.ndarray, trend: np.ndarray, weights: np.ndarray | None, period: int, n: int,
                     first: int = 0, passes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Inner loop: ``passes`` updates of the seasonal and the trend component."""
    ns, nt, nl = spans(period)
    season = np.zeros(len(y))
    for _ in range(passes):
        cycles = _cycles(y - trend, period, ns, n, first, weights)
        low = _average(_average(_average(cycles, period), period), 3)
        season = cycles[period:-period] - smooth(low, nl, n)
        trend = smooth(y - season, nt, n, weights)
    return season, trend


def robust_weights(resid: np.ndarray, median_abs: float) -> np.ndarray:
    """Bisquare weights around six times the median absolute residual."""
    r, top = np.abs(resid), 6.0 * median_abs
    with np.errstate(divide="ignore", invalid="ignore"):
        w = (1 - (r / top) ** 2) ** 2
    return np.where(r <= 0.001 * top, 1.0, np.where(r <= 0.999 * top, w, 0.0))
