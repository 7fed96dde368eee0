"""Queries of the balance, window, feature and scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlens import functions as fn
from wattlens import schema as S
from wattlens.operators import balance, features, moments, olap, profile, scoring
from wattlens.plans.registry import query
from wattlens.plans.views import Grid
from wattlens.session import materialize, work_path

DAY = "strftime({}, '%Y-%m-%d')"


def long(column: str) -> F.Column:
    return F.col(column).cast("bigint").alias(column)


def stamp(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def day(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd")


# ---- A3-A7, J11, J12, J18 -------------------------------------------------------
@query(
    "a3_asset_totals",
    """SELECT e.asset_id, round(e.input_total, 4) AS input_total_kwh, round(coalesce(t.technical, 0e0), 4) AS technical_total_kwh
       FROM (SELECT asset_id, sum(energy_input_kwh) AS input_total FROM v_energy GROUP BY 1) e
       LEFT JOIN (SELECT asset_id, sum(estimated_technical_loss_kwh) AS technical FROM v_technical GROUP BY 1) t USING (asset_id)""",
)
def a3(spark, d):
    g = Grid(spark, d)
    return balance.asset_totals(g.energy, g.technical).select(
        "asset_id",
        F.round("input_total_kwh", 4).alias("input_total_kwh"),
        F.round("technical_total_kwh", 4).alias("technical_total_kwh"),
    )


def reconciliation(g: Grid):
    return balance.reconcile(g.assets, g.customers, g.readings, g.energy, g.technical, g.scores)


@query(
    "a4_reconcile",
    """SELECT a.id AS transformer_id, a.name, strftime(p0, '%Y-%m-%d %H:%M:%S') AS period_start,
              strftime(p1, '%Y-%m-%d %H:%M:%S') AS period_end, round(coalesce(e, 0e0), 2) AS energy_input_kwh,
              round(coalesce(m, 0e0), 2) AS metered_output_kwh, round(coalesce(t, 0e0), 2) AS estimated_technical_loss_kwh,
              round(coalesce(e, 0e0) - coalesce(m, 0e0) - coalesce(t, 0e0), 2) AS unexplained_loss_kwh,
              round((coalesce(e, 0e0) - coalesce(m, 0e0) - coalesce(t, 0e0)) / greatest(coalesce(e, 0e0), 1e-9), 4)
                AS unexplained_loss_ratio,
              coalesce(c, 0) AS customer_count, coalesce(s.risk_tier, 'LOW') AS risk_tier,
              coalesce(s.risk_score, 0e0) AS risk_score,
              round(greatest(round(coalesce(e, 0e0) - coalesce(m, 0e0) - coalesce(t, 0e0), 6), 0e0) * 0.25e0, 2) AS estimated_loss_value,
              round(-coalesce(m, 0e0), 2) AS waterfall_metered, 4 AS waterfall_steps
       FROM v_assets a
       LEFT JOIN (SELECT asset_id, sum(energy_input_kwh) AS e, min(timestamp) AS p0, max(timestamp) AS p1
                  FROM v_energy GROUP BY 1) en ON en.asset_id = a.id
       LEFT JOIN (SELECT asset_id, sum(estimated_technical_loss_kwh) AS t FROM v_technical GROUP BY 1) te ON te.asset_id = a.id
       LEFT JOIN (SELECT transformer_id, sum(consumption_kwh) AS m FROM v_readings JOIN v_customers ON meter_id = id GROUP BY 1) me
              ON me.transformer_id = a.id
       LEFT JOIN (SELECT transformer_id, count(*) AS c FROM v_customers GROUP BY 1) cu ON cu.transformer_id = a.id
       LEFT JOIN v_scores s ON s.entity_id = a.id AND s.entity_type = 'transformer' AND s.is_current
       WHERE a.asset_type = 'transformer'""",
)
def a4(spark, d):
    out = reconciliation(Grid(spark, d))
    return out.select(
        "transformer_id",
        "name",
        stamp("period_start").alias("period_start"),
        stamp("period_end").alias("period_end"),
        "energy_input_kwh",
        "metered_output_kwh",
        "estimated_technical_loss_kwh",
        "unexplained_loss_kwh",
        "unexplained_loss_ratio",
        "customer_count",
        "risk_tier",
        "risk_score",
        "estimated_loss_value",
        F.element_at("waterfall", 2)["value"].alias("waterfall_metered"),
        F.size("waterfall").alias("waterfall_steps"),
    )


_TREND = """SELECT strftime(e.day, '%Y-%m-%d') AS day, round(e.v, 2) AS energy_input_kwh, round(coalesce(m.v, 0e0), 2) AS metered_output_kwh,
              round(coalesce(t.v, 0e0), 2) AS technical_loss_kwh,
              round(e.v - coalesce(m.v, 0e0) - coalesce(t.v, 0e0), 2) AS unexplained_loss_kwh
       FROM (SELECT date_trunc('day', timestamp) AS day, sum(energy_input_kwh) AS v FROM {energy} GROUP BY 1) e
       LEFT JOIN (SELECT date_trunc('day', timestamp) AS day, sum({metered}) AS v FROM {readings} GROUP BY 1) m USING (day)
       LEFT JOIN (SELECT date_trunc('day', timestamp) AS day, sum({technical}) AS v FROM {tech} GROUP BY 1) t USING (day)"""


def _day_text(df):
    return df.withColumn("day", day("day"))


@query(
    "a5_loss_trend",
    _TREND.format(
        energy="(SELECT * FROM v_energy WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-21' AND asset_id IN (SELECT transformer_id FROM v_customers WHERE region_id = 1))",
        metered="consumption_kwh",
        readings="(SELECT * FROM v_readings WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-21' AND meter_id IN (SELECT id FROM v_customers WHERE region_id = 1))",
        technical="estimated_technical_loss_kwh",
        tech="(SELECT * FROM v_technical WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-21' AND asset_id IN (SELECT transformer_id FROM v_customers WHERE region_id = 1))",
    ),
)
def a5(spark, d):
    g = Grid(spark, d)
    return _day_text(
        balance.loss_trend(g.energy, g.readings, g.technical, g.customers, "2024-01-05", "2024-01-20", region_id=1)
    )


@query(
    "j11_daily_balance",
    _TREND.format(energy="v_balance", metered="metered_kwh", readings="v_balance", technical="technical_kwh", tech="v_balance"),
)
def j11(spark, d):
    b = Grid(spark, d).balance
    return _day_text(
        balance.daily_balance(
            b,
            b.withColumnRenamed("metered_kwh", "consumption_kwh"),
            b.withColumnRenamed("technical_kwh", "estimated_technical_loss_kwh"),
        )
    )


@query(
    "a6_daily_sums",
    "SELECT meter_id, strftime(timestamp, '%Y-%m-%d') AS day, sum(consumption_kwh) AS kwh FROM v_readings GROUP BY 1, 2",
)
def a6(spark, d):
    return _day_text(balance.daily_sums(Grid(spark, d).readings))


_PEER_DAILY = """WITH days AS (
         SELECT meter_id, transformer_id, date_trunc('day', timestamp) AS day, sum(consumption_kwh) AS kwh
         FROM v_readings JOIN v_customers ON id = meter_id GROUP BY 1, 2, 3),
       med AS (SELECT a.meter_id, a.day, any_value(a.kwh) AS kwh, median(b.kwh) AS peers
               FROM days a LEFT JOIN days b ON b.transformer_id = a.transformer_id AND b.day = a.day AND b.meter_id <> a.meter_id
               GROUP BY 1, 2)"""


@query(
    "a7_peer_median_daily",
    _PEER_DAILY + " SELECT meter_id, strftime(day, '%Y-%m-%d') AS day, round(coalesce(peers, 0e0), 3) AS peer_median_kwh FROM med",
)
def a7(spark, d):
    g = Grid(spark, d)
    return _day_text(balance.peer_comparison(g.readings, g.customers)).select("meter_id", "day", "peer_median_kwh")


@query(
    "j18_peer_daily_join",
    _PEER_DAILY
    + """ SELECT meter_id, strftime(day, '%Y-%m-%d') AS day, round(kwh, 3) AS customer_kwh,
              round(coalesce(peers, 0e0), 3) AS peer_median_kwh, round(coalesce(peers, 0e0), 3) AS expected_kwh FROM med""",
)
def j18(spark, d):
    g = Grid(spark, d)
    return _day_text(balance.peer_comparison(g.readings, g.customers))


@query(
    "j12_readings_to_transformer",
    """SELECT r.meter_id, strftime(r.timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, consumption_kwh, c.transformer_id
       FROM v_readings r LEFT JOIN v_customers c ON c.id = r.meter_id""",
)
def j12(spark, d):
    g = Grid(spark, d)
    return balance.readings_to_transformer(g.readings, g.customers).select(
        "meter_id", stamp("timestamp").alias("timestamp"), "consumption_kwh", "transformer_id"
    )


@query(
    "a16_transformer_hourly_load",
    "SELECT transformer_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, load_kwh, unexplained_kwh FROM v_load",
)
def a16(spark, d):
    return Grid(spark, d).load.withColumn("timestamp", stamp("timestamp"))


@query(
    "a17_derive_asset_energy",
    """SELECT asset_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, energy_input_kwh, estimated_technical_loss_kwh
       FROM v_energy JOIN v_technical USING (asset_id, timestamp)""",
)
def a17(spark, d):
    g = Grid(spark, d)
    both = g.energy.join(g.technical, ["asset_id", "timestamp"])
    return both.select("asset_id", stamp("timestamp").alias("timestamp"), "energy_input_kwh", "estimated_technical_loss_kwh")


@query(
    "f28_recent_annualized_from_daily",
    """SELECT meter_id, round(avg(kwh) * 365e0, 6) AS recent_annualized_kwh FROM (
         SELECT meter_id, day, kwh, row_number() OVER (PARTITION BY meter_id ORDER BY day DESC) AS rn FROM (
           SELECT meter_id, date_trunc('day', timestamp) AS day, sum(consumption_kwh) AS kwh FROM v_readings GROUP BY 1, 2))
       WHERE rn <= 14 GROUP BY 1""",
)
def f28(spark, d):
    out = balance.recent_annualized_from_daily(Grid(spark, d).readings)
    return out.select("meter_id", F.round("recent_annualized_kwh", 6).alias("recent_annualized_kwh"))


# ---- J4, W1-W6 ------------------------------------------------------------------
@query(
    "j4_enrich_readings",
    """SELECT meter_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, consumption_kwh, hour_of_day, woningwaarde_category,
              solar_potential_flag FROM v_enriched""",
)
def j4(spark, d):
    g = Grid(spark, d)
    return olap.enrich_readings(g.readings, g.customers).select(
        "meter_id", stamp("timestamp").alias("timestamp"), "consumption_kwh", long("hour_of_day"), "woningwaarde_category", "solar_potential_flag"
    )


@query(
    "w1_rolling_14d_avg",
    "SELECT meter_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, rolling_14d_avg_kwh FROM v_rolling",
)
def w1(spark, d):
    g = Grid(spark, d)
    return olap.rolling_14d_avg(olap.enrich_readings(g.readings, g.customers)).select(
        "meter_id", stamp("timestamp").alias("timestamp"), "rolling_14d_avg_kwh"
    )


@query(
    "w2_peer_group_median",
    "SELECT meter_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, peer_group_median_kwh FROM v_rolling",
)
def w2(spark, d):
    g = Grid(spark, d)
    return olap.peer_group_median(olap.enrich_readings(g.readings, g.customers)).select(
        "meter_id", stamp("timestamp").alias("timestamp"), "peer_group_median_kwh"
    )


@query(
    "w3_latest_per_meter",
    """SELECT meter_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, consumption_kwh FROM v_readings
       QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY timestamp DESC) = 1""",
)
def w3(spark, d):
    return olap.latest_per_meter(Grid(spark, d).readings).select(
        "meter_id", stamp("timestamp").alias("timestamp"), "consumption_kwh"
    )


@query(
    "w4_daylight_drop_index",
    """SELECT meter_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp,
              CASE WHEN hour_of_day BETWEEN 8 AND 18 AND consumption_kwh < 0.5e0 * peer_group_median_kwh
                   THEN 1e0 - consumption_kwh / nullif(peer_group_median_kwh, 0e0) ELSE 0e0 END AS daylight_drop_index
       FROM v_rolling""",
)
def w4(spark, d):
    g = Grid(spark, d)
    return olap.peer_group_median(olap.enrich_readings(g.readings, g.customers)).select(
        "meter_id", stamp("timestamp").alias("timestamp"), olap.daylight_drop_index().alias("daylight_drop_index")
    )


@query("w5_olap_customer_features", "SELECT * FROM v_olap")
def w5(spark, d):
    return Grid(spark, d).olap


@query(
    "w6_trailing_sequence",
    """SELECT meter_id, count(*) AS actual_len, sum(consumption_kwh) AS total_kwh,
              string_agg(CAST(CAST(consumption_kwh AS BIGINT) AS VARCHAR), ',' ORDER BY timestamp) AS series,
              strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first_ts
       FROM (SELECT * FROM v_readings QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY timestamp DESC) <= 512)
       GROUP BY 1""",
)
def w6(spark, d):
    s = olap.trailing_sequence(Grid(spark, d).readings)
    return s.select(
        "meter_id",
        F.col("actual_len").cast("bigint").alias("actual_len"),
        F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("total_kwh"),
        F.array_join(F.transform("values", lambda v: v.cast("bigint").cast("string")), ",").alias("series"),
        stamp(F.get("timestamps", 0)).alias("first_ts"),
    )


# ---- A1, A2, W7, A21-A25, J15, U2 -----------------------------------------------
@query(
    "a1_time_index",
    "SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, idx, h AS hour, idx = n - 1 AS is_as_of FROM v_hours",
)
def a1(spark, d):
    index = features.time_index(Grid(spark, d).readings)
    last = index.select(F.max("idx")).scalar()
    return index.select(stamp("timestamp").alias("timestamp"), long("idx"), long("hour"), (F.col("idx") == last).alias("is_as_of"))


@query("w7_window_split", "SELECT idx, part, h <= 5 AS night FROM v_windows")
def w7(spark, d):
    return features.window_split(features.time_index(Grid(spark, d).readings)).select(long("idx"), "part", "night")


@query("a2_densify", "SELECT meter_id, idx, kwh AS consumption_kwh FROM v_grid")
def a2(spark, d):
    g = Grid(spark, d)
    return features.densify(g.readings, g.meters, features.time_index(g.readings)).select(
        "meter_id", long("idx"), "consumption_kwh"
    )


_STATS = [
    "mean_kwh", "std_kwh", "baseline_mean_kwh", "baseline_std_kwh", "recent_mean_kwh", "recent_std_kwh",
    "night_day_ratio", "zero_fraction",
]


def _base(spark, d):
    g = Grid(spark, d)
    return features.base_features(g.readings, g.meters)


@query("a21_customer_stats", f"SELECT meter_id, {', '.join(_STATS)} FROM v_base")
def a21(spark, d):
    return _base(spark, d).select("meter_id", *_STATS)


@query("e4_incremental_features", f"SELECT meter_id, {', '.join(_STATS)} FROM v_base")
def e4(spark, d):
    """History first, then the last three days as daily deltas; features from what is stored."""
    g, path = Grid(spark, d), work_path(spark, "moments")
    day = F.to_date("timestamp")
    last = g.readings.agg(F.max(day)).first()[0]
    age = F.datediff(F.lit(last), day)
    for part in (age > 2, age == 2, age == 1, age == 0):
        moments.refresh(path, g.readings.filter(part))
    stored, index = moments.stored_moments(spark, path), moments.stored_index(spark, path)
    return features.moment_features(stored, index, g.meters).select("meter_id", *_STATS)


@query("a22_daily_anomaly_z", "SELECT meter_id, anomaly_z FROM v_base")
def a22(spark, d):
    return _base(spark, d).select("meter_id", "anomaly_z")


@query("f6_feature_ratios", "SELECT meter_id, drop_ratio, trend, night_day_ratio, zero_fraction, flatline FROM v_base")
def f6(spark, d):
    return _base(spark, d).select("meter_id", "drop_ratio", "trend", "night_day_ratio", "zero_fraction", "flatline")


@query("a23_peer_attach", "SELECT meter_id, peer_median_recent_kwh, peer_deviation, grid_unexplained_ratio FROM v_features")
def a23(spark, d):
    return Grid(spark, d).features.select("meter_id", "peer_median_recent_kwh", "peer_deviation", "grid_unexplained_ratio")


@query(
    "a24_neighborhood_risk",
    "SELECT DISTINCT transformer_id, region_id, spatial_neighborhood_risk FROM v_features",
)
def a24(spark, d):
    g = Grid(spark, d)
    base = features.base_features(g.readings, g.meters)
    return features.neighborhood_risk(features.attach_peers(base, g.meters))


@query("a25_transformer_features", "SELECT * FROM v_tx_features")
def a25(spark, d):
    return Grid(spark, d).transformer_features


@query(
    "j15_overlay_features",
    """SELECT meter_id, f.recent_mean_kwh, CASE WHEN o.latest THEN coalesce(o.rolling_14d_avg_kwh, 0e0) END AS rolling_14d_avg_kwh,
              CASE WHEN o.latest THEN coalesce(o.peer_group_median_kwh, 0e0) END AS peer_group_median_kwh,
              CASE WHEN o.latest THEN coalesce(o.daylight_drop_index, 0e0) END AS daylight_drop_index,
              CASE WHEN o.latest THEN o.woningwaarde_category ELSE f.woningwaarde_category END AS woningwaarde_category,
              coalesce(o.solar_potential_flag, f.solar_potential_flag) AS solar_potential_flag
       FROM v_features f LEFT JOIN (SELECT *, TRUE AS latest FROM v_olap) o USING (meter_id)""",
)
def j15(spark, d):
    return Grid(spark, d).scoring_input.select(
        "meter_id", "recent_mean_kwh", "rolling_14d_avg_kwh", "peer_group_median_kwh", "daylight_drop_index",
        "woningwaarde_category", "solar_potential_flag",
    )


@query(
    "u2_union_entities",
    """SELECT 'customer' AS entity_type, meter_id AS entity_id, 'features-v1' AS feature_version, recent_mean_kwh AS key_feature FROM v_features
       UNION ALL SELECT 'transformer', transformer_id, 'features-v1', unexplained_total_kwh FROM v_tx_features""",
)
def u2(spark, d):
    g = Grid(spark, d)
    as_of = g.readings.select(F.max("timestamp")).scalar()
    out = features.union_snapshots(g.features, g.transformer_features, as_of)
    key = F.coalesce(
        F.get_json_object("features_json", "$.recent_mean_kwh"),
        F.get_json_object("features_json", "$.unexplained_total_kwh"),
    )
    return out.select("entity_type", "entity_id", "feature_version", key.cast("double").alias("key_feature"))


@query(
    "f14_baseline_deviation",
    """SELECT meter_id, CASE WHEN baseline_annual_kwh > 0 THEN
                round((recent_mean_kwh * 8760e0 - baseline_annual_kwh) / baseline_annual_kwh, 6) END AS baseline_deviation_ratio,
              round(recent_mean_kwh * 8760e0, 2) AS recent_annualized_kwh,
              CASE WHEN baseline_annual_kwh > 0 THEN
                round((recent_mean_kwh * 8760e0 - baseline_annual_kwh) / baseline_annual_kwh, 4) END AS shown_deviation
       FROM v_features""",
)
def f14(spark, d):
    shown = fn.spatial_context("baseline_annual_kwh", "recent_mean_kwh")
    return Grid(spark, d).features.select(
        "meter_id",
        "baseline_deviation_ratio",
        shown["recent_annualized_kwh"].alias("recent_annualized_kwh"),
        shown["baseline_deviation_ratio"].alias("shown_deviation"),
    )


# ---- F8-F13, W8, J17 ------------------------------------------------------------
_COMPONENTS = ["supervised_probability", "anomaly_score", "grid_imbalance_score", "peer_score", "spatial_score"]
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in [*_COMPONENTS, "confidence"])


def rounded(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query("f8_customer_components", f"SELECT meter_id, {_ROUNDED}, risk_score, risk_tier FROM v_scored")
def f8(spark, d):
    return Grid(spark, d).scored.select("meter_id", *rounded(*_COMPONENTS, "confidence"), "risk_score", "risk_tier")


@query(
    "f9_customer_components_from_ml",
    """SELECT meter_id, round(s, 6) AS supervised_probability, round(a, 6) AS anomaly_score,
              CAST(round(CAST(100e0 * (0.40e0 * s + 0.25e0 * a + 0.20e0 * grid_imbalance_score + 0.10e0 * peer_score
                + 0.05e0 * spatial_score) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS risk_score,
              round(least(1e0, greatest(0e0, 0.5e0 + 0.45e0 * s - 0.3e0 * flatline)), 6) AS confidence
       FROM (SELECT *, 1e0 / (1e0 + exp(-trend)) AS s,
                    least(1e0, greatest(0e0, greatest(1e0 - exp(-drop_ratio), flatline)
                      * CASE WHEN solar_potential_flag AND daylight_drop_index > 0.3e0 THEN 1e0 - 0.65e0 ELSE 1e0 END)) AS a
             FROM v_scored)""",
)
def f9(spark, d):
    # Stand-in model outputs taken from the features, so SQL can say the same.
    df = Grid(spark, d).scoring_input.withColumns(
        {"ml_probability": fn.sigmoid("trend"), "ml_anomaly": F.lit(1.0) - F.exp(-F.col("drop_ratio"))}
    )
    out = scoring.customer_components_from_ml(df)
    return out.select("meter_id", *rounded("supervised_probability", "anomaly_score"), "risk_score", *rounded("confidence"))


@query("f10_transformer_components", f"SELECT transformer_id, {_ROUNDED}, risk_score, risk_tier FROM v_tx_scored")
def f10(spark, d):
    out = scoring.transformer_components(Grid(spark, d).transformer_features)
    return out.select("transformer_id", *rounded(*_COMPONENTS, "confidence"), "risk_score", "risk_tier")


_SHARES = """SELECT s.*, suspicion_weight / sum(suspicion_weight) OVER (PARTITION BY s.transformer_id) AS share,
                    t.unexplained_total_kwh AS tx_loss
             FROM v_scored s JOIN v_tx_features t ON t.transformer_id = s.transformer_id"""


@query(
    "w8_attribution_share",
    f"""SELECT meter_id, round(share, 6) AS loss_attribution_share, round(greatest(0e0, share * tx_loss), 4) AS estimated_loss_kwh
        FROM ({_SHARES})""",
)
def w8(spark, d):
    g = Grid(spark, d)
    out = scoring.attribute_loss(g.scored, g.transformer_features)
    return out.select("meter_id", *rounded("loss_attribution_share"), F.round("estimated_loss_kwh", 4).alias("estimated_loss_kwh"))


_TOP4 = """SELECT meter_id, list_transform(list_slice(list_sort([
                  {'k': -round(supervised_probability, 4), 'i': 0, 'f': 'supervised_probability'},
                  {'k': -round(anomaly_score, 4), 'i': 1, 'f': 'anomaly_score'},
                  {'k': -round(grid_imbalance_score, 4), 'i': 2, 'f': 'grid_imbalance_score'},
                  {'k': -round(peer_score, 4), 'i': 3, 'f': 'peer_score'},
                  {'k': -round(spatial_score, 4), 'i': 4, 'f': 'spatial_score'}]), 1, 4), lambda x: x.f) AS top,
                flatline, solar_potential_flag, daylight_drop_index FROM v_scored"""


@query("l5_top_components", f"SELECT meter_id, array_to_string(top, ',') AS top_components FROM ({_TOP4})")
def l5(spark, d):
    top = F.transform(scoring.top_components(4), lambda e: e["feature"])
    return Grid(spark, d).scored.select("meter_id", F.array_join(top, ",").alias("top_components"))


@query(
    "f11_build_explanations",
    f"""SELECT meter_id, array_to_string(list_concat(top,
                 CASE WHEN flatline >= 1 THEN ['flatline'] ELSE [] END,
                 CASE WHEN solar_potential_flag AND daylight_drop_index > 0.3e0 THEN ['solar_potential_flag'] ELSE [] END,
                 ['loss_attribution_share']), ',') AS features, round(share, 6) AS share
        FROM ({_TOP4}) JOIN (SELECT meter_id, share FROM ({_SHARES})) USING (meter_id)""",
)
def f11(spark, d):
    g = Grid(spark, d)
    out = scoring.build_explanations(scoring.attribute_loss(g.scored, g.transformer_features))
    names = F.transform("explanations", lambda e: e["feature"])
    return out.select(
        "meter_id",
        F.array_join(names, ",").alias("features"),
        F.element_at("explanations", -1)["contribution"].alias("share"),
    )


@query("f12_attribution_from_explanations", f"SELECT meter_id, round(share, 6) AS share FROM ({_SHARES})")
def f12(spark, d):
    g = Grid(spark, d)
    out = scoring.build_explanations(scoring.attribute_loss(g.scored, g.transformer_features))
    return out.select("meter_id", fn.attribution_share("explanations").alias("share"))


# Anomaly results for the override: every meter whose reading peaked at least twice its recent mean.
_OVERRIDE = """SELECT meter_id AS customer_id, least(1e0, max(consumption_kwh) / 100000e0) AS anomaly_score
               FROM v_readings WHERE reading_quality = 'estimated' GROUP BY 1"""


def _override(g: Grid):
    return (
        g.readings.filter("reading_quality = 'estimated'")
        .groupBy(F.col("meter_id").alias("customer_id"))
        .agg(F.least(F.lit(1.0), F.max("consumption_kwh") / 100000.0).alias("anomaly_score"))
    )


_REPLACED = f"""SELECT s.meter_id, round(coalesce(o.anomaly_score, s.anomaly_score), 6) AS anomaly_score,
                  CAST(round(CAST(100e0 * (0.40e0 * supervised_probability + 0.25e0 * coalesce(o.anomaly_score, s.anomaly_score)
                        + 0.20e0 * grid_imbalance_score + 0.10e0 * peer_score + 0.05e0 * spatial_score) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS risk_score,
                  round(confidence, 6) AS confidence
           FROM v_scored s LEFT JOIN ({_OVERRIDE}) o ON o.customer_id = s.meter_id"""


def _replaced(spark, d):
    g = Grid(spark, d)
    return scoring.replace_anomaly(g.scored, _override(g)).select(
        "meter_id", *rounded("anomaly_score"), "risk_score", *rounded("confidence")
    )


@query("f13_replace_anomaly", _REPLACED)
def f13(spark, d):
    return _replaced(spark, d)


@query("j17_anomaly_override_join", _REPLACED)
def j17(spark, d):
    return _replaced(spark, d)


@query(
    "f7_clamp_and_sigmoid",
    """SELECT meter_id, round(least(1e0, greatest(0e0, trend)), 6) AS clamped, round(1e0 / (1e0 + exp(-trend)), 6) AS squashed FROM v_base""",
)
def f7(spark, d):
    return _base(spark, d).select(
        "meter_id", F.round(fn.clamp01("trend"), 6).alias("clamped"), F.round(fn.sigmoid("trend"), 6).alias("squashed")
    )


@query(
    "e2_score_entities",
    f"""SELECT 'customer' AS entity_type, meter_id AS entity_id, risk_score, risk_tier,
               round(greatest(0e0, share * tx_loss), 3) AS estimated_loss_kwh,
               round(supervised_probability * (greatest(0e0, share * tx_loss) * 0.25e0) * confidence - 75e0, 3) AS inspection_priority
        FROM ({_SHARES})
        UNION ALL
        SELECT 'transformer', transformer_id, risk_score, risk_tier, round(greatest(0e0, unexplained_total_kwh), 3),
               round(supervised_probability * (greatest(0e0, unexplained_total_kwh) * 0.25e0) * confidence - 75e0, 3)
        FROM v_tx_scored""",
)
def e2(spark, d):
    """Snapshots to published score rows in one go."""
    g = Grid(spark, d)
    stations = materialize(g.transformer_features, "transformers")
    out = scoring.score_entities(g.scoring_input, stations, F.current_timestamp())
    return out.select(
        "entity_type",
        "entity_id",
        "risk_score",
        "risk_tier",
        F.round("estimated_loss_kwh", 3).alias("estimated_loss_kwh"),
        F.round("inspection_priority", 3).alias("inspection_priority"),
    )


@query(
    "e5_customer_risk_profile",
    _PEER_DAILY
    + f""",
       daily AS (SELECT meter_id, count(*) AS n_days, strftime(min(day), '%Y-%m-%d') AS first_day,
                        round(sum(round(kwh, 3)), 3) AS customer_kwh, round(sum(round(coalesce(peers, 0e0), 3)), 3) AS peer_kwh
                 FROM med GROUP BY 1),
       lately AS (SELECT meter_id, avg(kwh) * 365e0 AS year_kwh FROM (
                    SELECT meter_id, kwh, row_number() OVER (PARTITION BY meter_id ORDER BY day DESC) AS rn FROM med)
                  WHERE rn <= 14 GROUP BY 1)
       SELECT c.id, c.external_ref, s.risk_score, s.risk_tier, s.anomaly_score, coalesce(n_days, 0) AS n_days, first_day,
              customer_kwh, peer_kwh, c.baseline_annual_kwh, round(year_kwh, 2) AS recent_annualized_kwh,
              CASE WHEN c.baseline_annual_kwh > 0 THEN round((year_kwh - c.baseline_annual_kwh) / c.baseline_annual_kwh, 4) END
                AS baseline_deviation_ratio,
              round(coalesce(h.share, 0e0), 6) AS loss_attribution_share,
              CAST(2 + CASE WHEN s.risk_tier IN ('HIGH', 'CRITICAL') THEN 1 ELSE 0 END
                   + CASE WHEN c.baseline_annual_kwh IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_notes
       FROM v_customers c JOIN v_scores s ON s.entity_id = c.id AND s.entity_type = 'customer' AND s.is_current
       LEFT JOIN daily ON daily.meter_id = c.id LEFT JOIN lately ON lately.meter_id = c.id
       LEFT JOIN (SELECT meter_id, share FROM ({_SHARES})) h ON h.meter_id = c.id""",
)
def e5(spark, d):
    g = Grid(spark, d)
    explained = scoring.build_explanations(scoring.attribute_loss(g.scored, g.transformer_features))
    days = F.col("peer_comparison")
    summed = lambda name: F.round(F.aggregate(days[name], F.lit(0.0), lambda a, x: a + x), 3)
    return profile.risk_profiles(g.customers, g.scores, g.readings, explained).select(
        "id",
        "customer.external_ref",
        "risk.risk_score",
        "risk.risk_tier",
        F.col("risk.components.anomaly_score").alias("anomaly_score"),
        F.coalesce(F.size(days), F.lit(0)).cast("long").alias("n_days"),
        F.date_format(days[0]["day"], "yyyy-MM-dd").alias("first_day"),
        summed("customer_kwh").alias("customer_kwh"),
        summed("peer_median_kwh").alias("peer_kwh"),
        "spatial_context.baseline_annual_kwh",
        "spatial_context.recent_annualized_kwh",
        "spatial_context.baseline_deviation_ratio",
        *rounded("loss_attribution_share"),
        F.size("notes").cast("long").alias("n_notes"),
    )
