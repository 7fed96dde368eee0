"""Energy balance, risk, money and distance formulas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattlens import schema as S


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def clamp01(x) -> Column:
    return clamp(x)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def safe_div(a, b) -> Column:
    """``a / b``, with a divisor of at most 1e-9 in size taken as 1e-9."""
    b = _c(b)
    return _c(a) / F.when(F.abs(b) > S.EPSILON, b).otherwise(F.lit(S.EPSILON))


# ---- energy balance -------------------------------------------------------------
def unexplained_loss(energy_in, metered, technical) -> Column:
    """Signed residual. ``metered`` may be one column, several, or an array column via ``array_total``."""
    if isinstance(metered, (list, tuple)):
        total = F.lit(0.0)
        for m in metered:
            total = total + _c(m)
    else:
        total = _c(metered)
    return _c(energy_in) - total - _c(technical)


def array_total(values) -> Column:
    return F.aggregate(_c(values), F.lit(0.0), lambda acc, v: acc + v)


def unexplained_loss_ratio(unexplained, energy_in) -> Column:
    return _c(unexplained) / F.greatest(_c(energy_in), F.lit(S.EPSILON))


def loss_value(kwh, price: float = S.PRICE_EUR_PER_KWH) -> Column:
    return _c(kwh) * F.lit(float(price))


def inspection_priority(probability, value, confidence, cost: float = S.INSPECTION_COST_EUR, factor=1.0) -> Column:
    return _c(probability) * _c(value) * _c(confidence) * _c(factor) - F.lit(float(cost))


# ---- risk -----------------------------------------------------------------------
def risk_score(components: Mapping[str, Column | str] | None = None, strict: bool = False) -> Column:
    """Weighted sum of the five components, 0-100, rounded to 4 places.

    ``strict`` fails the job on a component outside [0, 1]; it is off by default
    because an assertion keeps the optimizer from folding the expression.
    """
    components = components or {name: name for name in S.RISK_WEIGHTS}
    total = None
    for name, weight in S.RISK_WEIGHTS.items():
        value = _c(components[name])
        if strict:
            message = F.concat(F.lit(f"{name} must be in [0, 1], got "), value.cast("string"))
            value = F.when(value.between(0.0, 1.0), value).otherwise(F.raise_error(message).cast("double"))
        term = F.lit(weight) * value
        total = term if total is None else total + term
    # By way of nine places: floating-point noise in the sum must not decide a tie.
    return F.round(F.round(F.lit(100.0) * total, 9), 4)


def risk_tier(score, contiguous: bool = False) -> Column:
    """Tier label. Bands are inclusive whole numbers, so 29.5 lies between two of
    them and comes out CRITICAL; ``contiguous=True`` closes those gaps instead."""
    s = clamp(score, 0.0, 100.0)
    out = None
    for label, low, high in S.RISK_TIERS:
        hit = (s < high + 1) if contiguous else s.between(float(low), float(high))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(_c(score).isNotNull(), out.otherwise("CRITICAL"))


def tier_order(tier) -> Column:
    out = None
    for rank, label in enumerate(S.TIER_NAMES):
        hit = _c(tier) == label
        out = F.when(hit, rank) if out is None else out.when(hit, rank)
    return out


def baseline_deviation(recent_mean, baseline_annual) -> Column:
    """(recent·8760 − baseline) / baseline; null without a positive baseline."""
    b = _c(baseline_annual)
    ratio = (_c(recent_mean) * F.lit(float(S.HOURS_PER_YEAR)) - b) / b
    return F.when(b > 0, F.round(ratio, 6))


def spatial_context(baseline, recent_mean, stored_annualized=None, stored_deviation=None) -> dict[str, Column]:
    """Annualised use and deviation for display; stored values win over recomputed ones."""
    b, mean = _c(baseline), _c(recent_mean)
    annualized = mean * F.lit(float(S.HOURS_PER_YEAR))
    if stored_annualized is not None:
        annualized = F.coalesce(_c(stored_annualized), annualized)
    deviation = F.when(b > 0, (annualized - b) / b)
    if stored_deviation is not None:
        deviation = F.coalesce(_c(stored_deviation), deviation)
    return {
        "recent_annualized_kwh": F.round(annualized, 2),
        "baseline_deviation_ratio": F.round(deviation, 4),
    }


# Fixed texts: readers of the queue match on them.
ACTION_DIAGNOSTICS = "Run meter diagnostics before any fraud escalation."
ACTION_INSPECT = "Schedule a field inspection to verify metering and connection integrity."
ACTION_MONITOR = "Monitor; re-evaluate on next scoring cycle."


def recommended_action(anomaly, supervised, tier) -> Column:
    return (
        F.when((_c(anomaly) >= 0.7) & (_c(supervised) < 0.4), ACTION_DIAGNOSTICS)
        .when(_c(tier).isin("HIGH", "CRITICAL"), ACTION_INSPECT)
        .otherwise(ACTION_MONITOR)
    )


# ---- space ----------------------------------------------------------------------
def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat, dlon = p2 - p1, F.radians(_c(lon2)) - F.radians(_c(lon1))
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(h))


def planar_deg_distance(lon1, lat1, lon2, lat2) -> Column:
    return F.hypot(_c(lon1) - _c(lon2), _c(lat1) - _c(lat2))


# ---- macro grid -----------------------------------------------------------------
def grid_status(load_mw, solar_mw, wind_mw) -> Column:
    return (
        F.when(_c(load_mw) > 12000, "high_demand")
        .when(_c(solar_mw) + _c(wind_mw) < 500, "low_renewables")
        .otherwise("normal")
    )


def mix_share(part_mw, solar_mw, wind_mw) -> Column:
    return F.round(_c(part_mw) / F.greatest(_c(solar_mw) + _c(wind_mw), F.lit(1.0)), 6)


# ---- open-data consumption drop -------------------------------------------------
def consumption_drop(baseline, latest, recent_hours: int) -> dict[str, Column]:
    b, l = _c(baseline), _c(latest)
    ratio = F.when(b > 0, l / b).otherwise(F.lit(1.0))
    dropped = ratio < 0.85
    return {
        "incident": F.when(dropped, "consumption_drop").otherwise(""),
        "is_ntl": dropped,
        "hourly_unexplained_kwh": F.greatest(F.lit(0.0), b - l) / F.lit(float(recent_hours)),
    }
