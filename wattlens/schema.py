"""Table schemas and the fixed numbers of the loss model."""

from __future__ import annotations

# ---- Fixed values: they must equal the published model for results to agree. ----
EPSILON = 1e-9
RISK_WEIGHTS = {
    "supervised_probability": 0.40,
    "anomaly_score": 0.25,
    "grid_imbalance_score": 0.20,
    "peer_score": 0.10,
    "spatial_score": 0.05,
}
RISK_TIERS = (
    ("LOW", 0, 29),
    ("WATCH", 30, 49),
    ("MEDIUM", 50, 69),
    ("HIGH", 70, 84),
    ("CRITICAL", 85, 100),
)
TIER_NAMES = tuple(t[0] for t in RISK_TIERS)
FEATURE_VERSION = "features-v1"
RECENT_HOURS = 336
BASELINE_HOURS = 504
LAST_NIGHT_HOUR = 5
HOURS_PER_YEAR = 8760
GRID_RATIO_REF = 0.12
PEER_DEV_REF = 0.70
SPATIAL_REF = 0.50
ANOMALY_Z_K = 3.0
SUPERVISED_SLOPE = 2.0
FLATLINE_DAMPING = 0.70
SOLAR_DAMPING = 0.65
TX_LO = 0.02
TX_SPAN = 0.06
TX_DROP_REF = 0.20
PRICE_EUR_PER_KWH = 0.25
INSPECTION_COST_EUR = 75.0
PRECISION_AT = 20
SEQUENCE_LENGTH = 512
SEQUENCE_EPS = 1e-8
ANOMALY_DECAY = 2.0
PEAK_COUNT = 3
MIN_ROWS, MIN_POSITIVES, MIN_NEGATIVES = 40, 5, 5
MODEL_COLUMNS = (
    "baseline_mean_kwh",
    "recent_mean_kwh",
    "drop_ratio",
    "trend",
    "night_day_ratio",
    "zero_fraction",
    "flatline",
    "anomaly_z",
    "peer_deviation",
    "grid_unexplained_ratio",
    "spatial_neighborhood_risk",
)
RATIO_BAND = (0.085, 0.115)
BALANCE_TOLERANCE_KWH = 1.0


# Table schemas as DDL text, as Spark's readers take it.
READINGS = (
    "meter_id bigint, timestamp timestamp, consumption_kwh double, voltage double, current double,"
    " power_factor double, reading_quality string, source string"
)
OPERATORS_CSV = ("name string, country_code string, timezone string, default_currency string")
REGIONS_CSV = (
    "code string, name string, region_type string, operator_name string, parent_code string"
)
ASSETS_CSV = (
    "external_id string, asset_type string, name string, operator_name string, lon string, lat string,"
    " parent_external_id string, voltage_level string, capacity_kva string"
)
CUSTOMERS_CSV = (
    "external_ref string, customer_type string, operator_name string, lon string, lat string,"
    " transformer_external_id string, feeder_external_id string, region_code string, zipcode string,"
    " baseline_annual_kwh string, building_type string, tariff_type string, incident string, is_ntl string"
)
READINGS_CSV = (
    "customer_external_ref string, timestamp string, consumption_kwh string, voltage string,"
    " power_factor string, reading_quality string, source string"
)
ASSET_ENERGY_CSV = (
    "asset_external_id string, timestamp string, energy_input_kwh string, energy_output_kwh string,"
    " reading_quality string, source string"
)
TECHNICAL_CSV = (
    "asset_external_id string, timestamp string, estimated_technical_loss_kwh string, method string,"
    " confidence string, model_version string"
)
MACRO_SERIES = (
    "timestamp timestamp, national_load_mw double, production_mix_solar double,"
    " production_mix_wind double, grid_status_flag string"
)
ANOMALY_RESULTS = (
    "customer_id bigint, anomaly_score double, reconstruction_mse double,"
    " peak_timestamps array<string>, peak_errors array<double>"
)
EXPLANATIONS = "array<struct<feature:string,label:string,contribution:double,direction:string,detail:string>>"


def field_names(ddl: str) -> list[str]:
    """Column names of a flat DDL text."""
    return [field.split()[0] for field in ddl.split(",")]
