"""Published tables for unit-root and stationarity tests."""

from __future__ import annotations

import numpy as np

from plumbline.functions.tails import normal_cdf

# MacKinnon (1994) approximate p-values, one variable.
# Per regression: smallest and largest statistic, switch point, and the
# polynomials (ascending powers) below and above the switch point.
ADF_P = {
    "c": dict(low=-18.83, high=2.74, switch=-1.61,
              small=[2.1659, 1.4412, 0.038269],
              large=[1.7339, 0.93202, -0.12745, -0.010368]),
    "ct": dict(low=-16.18, high=0.70, switch=-2.89,
               small=[3.2512, 1.6047, 0.049588],
               large=[2.5261, 0.61654, -0.37956, -0.060285]),
}

# MacKinnon (2010) critical values, coefficients of 1/n powers 0..3.
ADF_CRITICAL = {
    "c": {"1%": [-3.43035, -6.5393, -16.786, -79.433],
          "5%": [-2.86154, -2.8903, -4.234, -40.040],
          "10%": [-2.56677, -1.5384, -2.809, 0.0]},
    "ct": {"1%": [-3.95877, -9.0531, -28.428, -134.155],
           "5%": [-3.41049, -4.3904, -9.036, -45.374],
           "10%": [-3.12705, -2.5856, -3.925, -22.380]},
}

# Kwiatkowski, Phillips, Schmidt and Shin (1992), table 1.
KPSS_P = [0.10, 0.05, 0.025, 0.01]
KPSS_CRITICAL = {"c": [0.347, 0.463, 0.574, 0.739], "ct": [0.119, 0.146, 0.176, 0.216]}

# Zivot and Andrews (1992), tables 2 to 4, asymptotic quantiles.
ZA_P = [0.01, 0.025, 0.05, 0.10, 0.50, 0.90, 0.95, 0.975, 0.99]
ZA_CRITICAL = {
    "c": [-5.34, -5.02, -4.80, -4.58, -3.75, -2.99, -2.77, -2.56, -2.32],
    "t": [-4.93, -4.67, -4.42, -4.11, -3.23, -2.48, -2.31, -2.17, -1.97],
    "ct": [-5.57, -5.30, -5.08, -4.82, -3.98, -3.25, -3.06, -2.91, -2.72],
}


def adf_p_value(stat: float, regression: str) -> float:
    t = ADF_P[regression]
    if not np.isfinite(stat):
        return float("nan")
    if stat > t["high"]:
        return 1.0
    if stat < t["low"]:
        return 0.0
    poly = t["small"] if stat <= t["switch"] else t["large"]
    return float(normal_cdf(np.polynomial.polynomial.polyval(stat, poly)))


def adf_critical(regression: str, n: int) -> dict[str, float]:
    return {level: float(np.polynomial.polynomial.polyval(1.0 / n, b))
            for level, b in ADF_CRITICAL[regression].items()}


def za_p_value(stat: float, model: str) -> float:
    return float(np.interp(stat, ZA_CRITICAL[model], ZA_P)) if np.isfinite(stat) else float("nan")


def za_critical(model: str) -> dict[str, float]:
    table = dict(zip(ZA_P, ZA_CRITICAL[model], strict=True))
    return {"1%": table[0.01], "5%": table[0.05], "10%": table[0.10]}
