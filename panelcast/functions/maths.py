"""Arithmetic features (MTH1-MTH9).  Division is NULL-safe; NaN / inf never appear."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and normalisers of the two air-quality index proxies,
# the CO scale of the gas index, rain / inversion thresholds, compass labels.
AQI_WEIGHTS = {"pm25": 0.5, "pm10": 0.3, "o3": 0.2}
AQI_NORMALISERS = {"pm25": 55.5, "pm10": 150.0, "o3": 235.0}
CO_SCALE = 100.0
INVERSION_RANGE = 8.0
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_positive(c) -> Column:
    """Natural log; 0 and negatives -> NULL (MTH1; numpy gives -inf / NaN)."""
    c = _c(c)
    return F.when(c > 0, F.ln(c))


def safe_ratio(a, b) -> Column:
    """a / b with 0 denominator -> NULL (MTH2)."""
    return F.try_divide(_c(a), _c(b))


def ratio_eps(a, b, eps: float = 1e-5) -> Column:
    """a / (b + eps) (MTH2 variant)."""
    return F.try_divide(_c(a), _c(b) + F.lit(eps))


def aqi_weighted(pm25, pm10, o3) -> Column:
    """0.5 pm25 + 0.3 pm10 + 0.2 o3 (MTH3, feature-engineering definition)."""
    return (_c(pm25) * AQI_WEIGHTS["pm25"] + _c(pm10) * AQI_WEIGHTS["pm10"] + _c(o3) * AQI_WEIGHTS["o3"])


def aqi_normalised(pm25, pm10, o3) -> Column:
    """(pm25/55.5 + pm10/150 + o3/235) / 3 (MTH3, forecast-time definition)."""
    return (_c(pm25) / AQI_NORMALISERS["pm25"] + _c(pm10) / AQI_NORMALISERS["pm10"]
            + _c(o3) / AQI_NORMALISERS["o3"]) / 3


def gas_index(so2, co, no2) -> Column:
    """so2 + co / 100 + no2 (MTH4)."""
    return _c(so2) + _c(co) / CO_SCALE + _c(no2)


def gas_index_mean(so2, no2) -> Column:
    """(so2 + no2) / 2 (MTH4 variant)."""
    return (_c(so2) + _c(no2)) / 2


def pm_total(pm25, pm10) -> Column:
    return _c(pm25) + _c(pm10)


def above(c, threshold) -> Column:
    """``c > threshold`` as 0/1, NULL -> 0 (MTH5 spike flag, RUL3 parts)."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce((_c(c) > t).cast("int"), F.lit(0))


def rainy(precip) -> Column:
    """precip > 0 as 0/1; NULL -> 0 (MTH6)."""
    return above(precip, 0)


def heat_index(temp, humidity, wind=None) -> Column:
    """temp + 0.5 humidity (- 0.1 wind) (MTH6)."""
    h = _c(temp) + _c(humidity) * 0.5
    return h - _c(wind) * 0.1 if wind is not None else h


def feels_like(temp, wind) -> Column:
    return _c(temp) - _c(wind) * 0.5


def diurnal_range(tmax, tmin) -> Column:
    return _c(tmax) - _c(tmin)


def inversion_flag(tmax, tmin, threshold: float = INVERSION_RANGE) -> Column:
    """diurnal range > 8 as 0/1; NULL -> 0 (pandas ``(NaN > 8).astype(int)`` is 0)."""
    return above(diurnal_range(tmax, tmin), threshold)


def interaction(a, b, scale: float = 1.0) -> Column:
    """a * b / scale (MTH7: temp x humidity / 100, rain x wind)."""
    return _c(a) * _c(b) / F.lit(scale)


def compass_8(deg) -> Column:
    """8-way compass label, right-closed 45-degree sectors starting at -22.5 (MTH8).

    Values above 337.5 wrap by -360; 22.5 -> N, 22.6 -> NE, 337.5 -> NW, 360 -> N;
    below -22.5, above 697.5 and NULL -> NULL.  ``get`` (not ``element_at``)
    keeps a NULL index NULL.
    """
    d = _c(deg).cast("double")
    adj = F.when(d > 337.5, d - 360).otherwise(d)
    idx = F.greatest(F.ceil((adj - 22.5) / 45).cast("int"), F.lit(0))
    ok = (adj >= -22.5) & (adj <= 337.5)
    return F.when(ok, F.get(F.array(*[F.lit(x) for x in COMPASS]), idx))


def clip_lower(c, lo: float = 0.0) -> Column:
    """max(c, lo) keeping NULL (MTH9).  Not ``greatest``: it would turn NULL into lo."""
    c = _c(c)
    return F.when(c < lo, F.lit(lo)).otherwise(c)


def clip(c, lo, hi) -> Column:
    """Clip to [lo, hi] keeping NULL (IMP5 / IMP9)."""
    c = _c(c)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c < lo, lo).when(c > hi, hi).otherwise(c)
