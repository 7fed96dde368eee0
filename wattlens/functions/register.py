"""Publish the pure formulas as SQL functions.

They are SQL-bodied functions, so Catalyst inlines them like any expression; no
Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from wattlens import schema as S

_W = S.RISK_WEIGHTS


def _tier_case() -> str:
    whens = " ".join(f"WHEN s BETWEEN {lo} AND {hi} THEN '{label}'" for label, lo, hi in S.RISK_TIERS)
    clamped = whens.replace("WHEN s ", "WHEN greatest(0D, least(100D, s)) ")
    return f"CASE WHEN s IS NULL THEN NULL {clamped} ELSE 'CRITICAL' END"


FUNCTIONS = {
    "unexplained_loss": ("e DOUBLE, m DOUBLE, t DOUBLE", "DOUBLE", "e - m - t"),
    "unexplained_loss_ratio": ("u DOUBLE, e DOUBLE", "DOUBLE", f"u / greatest(e, {S.EPSILON}D)"),
    "risk_score": (
        "p DOUBLE, a DOUBLE, g DOUBLE, n DOUBLE, s DOUBLE",
        "DOUBLE",
        "round(round(100D * ("
        f"{_W['supervised_probability']}D * p + {_W['anomaly_score']}D * a + {_W['grid_imbalance_score']}D * g"
        f" + {_W['peer_score']}D * n + {_W['spatial_score']}D * s), 9), 4)",
    ),
    "risk_tier": ("s DOUBLE", "STRING", _tier_case()),
    "loss_value": ("kwh DOUBLE", "DOUBLE", f"kwh * {S.PRICE_EUR_PER_KWH}D"),
    "inspection_priority": (
        "p DOUBLE, v DOUBLE, c DOUBLE", "DOUBLE", f"p * v * c - {S.INSPECTION_COST_EUR}D",
    ),
    "normalize_zip": ("z STRING", "STRING", "upper(replace(z, ' ', ''))"),
    "clamp01": ("x DOUBLE", "DOUBLE", "greatest(0D, least(1D, x))"),
    "sigmoid": ("x DOUBLE", "DOUBLE", "1D / (1D + exp(-x))"),
    "planar_deg_distance": ("a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE", "DOUBLE", "hypot(a - c, b - d)"),
    "haversine_km": (
        "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE",
        "DOUBLE",
        "12742D * asin(sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
