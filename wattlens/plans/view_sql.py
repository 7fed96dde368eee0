"""The grid tables as SQL over the given tables, for the independent check.

Where a value can end exactly on half a unit of its last place, it is rounded as a
decimal: Spark rounds halves up in decimal, DuckDB's round works on the binary value.
"""

_NIGHT = "h <= 5"

VIEW_SQL = {
    "v_readings": """
        SELECT user_id AS meter_id, date_trunc('hour', ts) AS timestamp,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS consumption_kwh,
               CASE WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1
                    THEN 'estimated' ELSE 'good' END AS reading_quality
        FROM events GROUP BY 1, 2""",
    "v_customers": """
        SELECT c_custkey AS id, c_name AS external_ref, CAST(c_nationkey AS BIGINT) AS transformer_id,
               CAST(n_regionkey AS BIGINT) AS region_id, c_mktsegment AS customer_type,
               c_mktsegment AS woningwaarde_category,
               CAST(4800 + c_custkey % 200 AS DOUBLE) / 1000 AS lon,
               CAST(52300 + c_custkey % 150 AS DOUBLE) / 1000 AS lat,
               c_custkey % 5 = 0 AS solar_potential_flag, c_custkey % 7 = 0 AS is_ntl,
               CAST(round(c_acctbal * 100) AS BIGINT) AS cents,
               CASE WHEN c_acctbal > 0 THEN
                 CAST(1000 + CAST(round(c_acctbal * 100) AS BIGINT) % 4900 AS VARCHAR) || ' ' ||
                 CASE CAST(round(c_acctbal * 100) AS BIGINT) % 3 WHEN 0 THEN 'ab' WHEN 1 THEN 'Cd' ELSE 'EF' END
               END AS zipcode,
               CASE WHEN c_acctbal > 0 THEN CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS DOUBLE) END
                 AS baseline_annual_kwh,
               CASE WHEN c_acctbal > 0 THEN CAST(CAST(round(c_acctbal * 100) AS BIGINT) % 101 AS DOUBLE) END
                 AS street_smartmeter_perc,
               n_name AS city
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_regions": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 'R' || r_regionkey AS code,
               CASE WHEN r_regionkey = 0 THEN 'country' ELSE 'municipality' END AS region_type,
               CASE WHEN r_regionkey > 0 THEN 'R0' END AS parent_code
        FROM region""",
    "v_assets": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, 'TX-' || n_nationkey AS external_id,
               'transformer' AS asset_type, n_name AS name, 'FD-' || n_regionkey AS parent_external_id,
               CAST(n_regionkey AS BIGINT) AS region_id,
               CAST(4800 + n_nationkey * 7 AS DOUBLE) / 1000 AS lon,
               CAST(52300 + n_nationkey * 5 AS DOUBLE) / 1000 AS lat
        FROM nation
        UNION ALL
        SELECT CAST(1000 + r_regionkey AS BIGINT), 'FD-' || r_regionkey, 'feeder', r_name, NULL,
               CAST(r_regionkey AS BIGINT), CAST(4800 + r_regionkey * 35 AS DOUBLE) / 1000,
               CAST(52300 + r_regionkey * 25 AS DOUBLE) / 1000
        FROM region""",
    "v_score_base": """
        SELECT id, cents + 100000 AS k,
               CAST((cents + 100000) // 101 % 101 AS DOUBLE) / 100 AS supervised_probability,
               CAST((cents + 100000) % 101 AS DOUBLE) / 100 AS anomaly_score,
               CAST((cents + 100000) % 97 AS DOUBLE) / 100 AS grid_imbalance_score,
               CAST((cents + 100000) % 89 AS DOUBLE) / 100 AS peer_score,
               CAST((cents + 100000) % 83 AS DOUBLE) / 100 AS spatial_score,
               CAST((cents + 100000) % 5003 AS DOUBLE) AS estimated_loss_kwh
        FROM v_customers WHERE cents > 0""",
    "v_scores": """
        SELECT s.*, CASE WHEN risk_score BETWEEN 0 AND 29 THEN 'LOW' WHEN risk_score BETWEEN 30 AND 49 THEN 'WATCH'
                         WHEN risk_score BETWEEN 50 AND 69 THEN 'MEDIUM' WHEN risk_score BETWEEN 70 AND 84 THEN 'HIGH'
                         ELSE 'CRITICAL' END AS risk_tier,
               estimated_loss_kwh * 0.25e0 AS estimated_loss_value,
               supervised_probability * (estimated_loss_kwh * 0.25e0) * confidence - 75.0e0 AS inspection_priority,
               'EUR' AS currency
        FROM (
          SELECT 'customer' AS entity_type, id AS entity_id, supervised_probability, anomaly_score,
                 grid_imbalance_score, peer_score, spatial_score, estimated_loss_kwh,
                 CAST(k % 10001 AS DOUBLE) / 100 AS risk_score, 0.5e0 AS confidence,
                 TRUE AS is_current, TIMESTAMP '2024-02-01 00:00:00' AS scored_at
          FROM v_score_base
          UNION ALL
          SELECT 'customer', id, supervised_probability, anomaly_score,
                 grid_imbalance_score, peer_score, spatial_score, estimated_loss_kwh,
                 CAST(k % 7001 AS DOUBLE) / 100, 0.25e0, FALSE, TIMESTAMP '2024-01-31 00:00:00'
          FROM v_score_base
          UNION ALL
          SELECT 'transformer', CAST(n_nationkey AS BIGINT), 0.5e0, 0.5e0, 0.5e0, 0.5e0, 0.5e0,
                 CAST(n_nationkey * 100 AS DOUBLE), CAST(n_nationkey * 37 % 101 AS DOUBLE), 0.75e0, TRUE,
                 TIMESTAMP '2024-02-01 00:00:00'
          FROM nation WHERE n_nationkey <> 3
        ) s""",
    "v_balance": """
        SELECT CAST(s_nationkey AS BIGINT) AS asset_id, CAST(n_regionkey AS BIGINT) AS region_id,
               l_shipdate AS timestamp,
               CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * 100 AS DOUBLE) AS energy_input_kwh,
               CAST(CAST(round(l_extendedprice * 100) AS BIGINT)
                    * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS metered_kwh,
               CAST(CAST(round(l_extendedprice * 100) AS BIGINT)
                    * CAST(round(l_tax * 100) AS BIGINT) AS DOUBLE) AS technical_kwh
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "v_load": """
        SELECT c.transformer_id, r.timestamp, sum(consumption_kwh) AS load_kwh,
               sum(CASE WHEN reading_quality = 'estimated' THEN consumption_kwh ELSE 0e0 END) AS unexplained_kwh
        FROM v_readings r LEFT JOIN v_customers c ON r.meter_id = c.id GROUP BY 1, 2""",
    "v_energy": """
        SELECT transformer_id AS asset_id, timestamp,
               round(load_kwh * 1.04e0 + unexplained_kwh, 6) AS energy_input_kwh
        FROM v_load WHERE transformer_id IS NOT NULL""",
    "v_technical": """
        SELECT transformer_id AS asset_id, timestamp,
               round(load_kwh * 0.04e0, 6) AS estimated_technical_loss_kwh
        FROM v_load WHERE transformer_id IS NOT NULL""",
    "v_cases": """
        SELECT o_orderkey AS case_id, o_orderpriority || '-' || (o_orderkey // 500) AS mission_id, o_custkey AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'dismissed' ELSE 'queued' END AS status,
               o_orderdate AS created_at
        FROM orders""",
    # ---- the per-meter features, spelled out over the zero-filled grid ----
    "v_hours": """
        SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS idx,
               hour(timestamp) AS h, count(*) OVER () AS n
        FROM (SELECT DISTINCT timestamp FROM v_readings)""",
    "v_windows": """
        SELECT *, CASE WHEN idx < base_end THEN 'baseline' WHEN idx >= recent_start THEN 'recent' ELSE 'gap' END AS part
        FROM (SELECT *, greatest(base_end, n - 336) AS recent_start
              FROM (SELECT *, least(504, greatest(0, n - 336)) AS base_end FROM v_hours))""",
    "v_meters": """
        SELECT * FROM v_customers""",
    "v_grid": """
        SELECT m.id AS meter_id, w.idx, w.h, w.part, w.n, coalesce(r.consumption_kwh, 0e0) AS kwh
        FROM v_meters m CROSS JOIN v_windows w
        LEFT JOIN v_readings r ON r.meter_id = m.id AND r.timestamp = w.timestamp""",
    "v_stats": f"""
        SELECT meter_id, avg(kwh) AS mean_kwh, stddev_pop(kwh) AS std_kwh,
               coalesce(avg(kwh) FILTER (part = 'baseline'), avg(kwh)) AS baseline_mean,
               coalesce(stddev_pop(kwh) FILTER (part = 'baseline'), stddev_pop(kwh)) AS baseline_std,
               coalesce(avg(kwh) FILTER (part = 'recent'), 0e0) AS recent_mean,
               coalesce(stddev_pop(kwh) FILTER (part = 'recent'), 0e0) AS recent_std,
               coalesce(avg(kwh) FILTER (part = 'recent' AND {_NIGHT}), 0e0) AS night_mean,
               coalesce(avg(kwh) FILTER (part = 'recent' AND NOT {_NIGHT}), 0e0) AS day_mean
        FROM v_grid GROUP BY 1""",
    "v_zero": """
        SELECT g.meter_id, coalesce(avg(CASE WHEN g.kwh < greatest(0.05e0 * s.baseline_mean, 0.05e0) THEN 1e0 ELSE 0e0 END)
                                    FILTER (part = 'recent'), 0e0) AS zero_fraction
        FROM v_grid g JOIN v_stats s USING (meter_id) GROUP BY 1""",
    "v_days": """
        SELECT meter_id, idx // 24 AS day, avg(kwh) AS day_mean, max(n) // 24 AS days
        FROM v_grid WHERE idx < (n // 24) * 24 GROUP BY 1, 2""",
    "v_z": """
        SELECT meter_id, (base_mean - recent_mean) / greatest(base_std, 0.03e0 * base_mean, 1e-9) AS anomaly_z
        FROM (SELECT meter_id, avg(day_mean) FILTER (day < 21) AS base_mean,
                     stddev_pop(day_mean) FILTER (day < 21) AS base_std,
                     avg(day_mean) FILTER (day >= days - 14) AS recent_mean
              FROM v_days GROUP BY 1)""",
    "v_base": """
        SELECT meter_id, round(mean_kwh, 6) AS mean_kwh, round(std_kwh, 6) AS std_kwh,
               round(baseline_mean, 6) AS baseline_mean_kwh, round(baseline_std, 6) AS baseline_std_kwh,
               round(recent_mean, 6) AS recent_mean_kwh, round(recent_std, 6) AS recent_std_kwh,
               round(recent_mean / (CASE WHEN abs(baseline_mean) > 1e-9 THEN baseline_mean ELSE 1e-9 END), 6) AS drop_ratio,
               round((recent_mean - baseline_mean) /
                     (CASE WHEN abs(baseline_mean) > 1e-9 THEN baseline_mean ELSE 1e-9 END), 6) AS trend,
               round(night_mean / (CASE WHEN abs(day_mean) > 1e-9 THEN day_mean ELSE 1e-9 END), 6) AS night_day_ratio,
               round(zero_fraction, 6) AS zero_fraction,
               CASE WHEN recent_std / (CASE WHEN abs(recent_mean) > 1e-9 THEN recent_mean ELSE 1e-9 END) < 0.05e0
                         AND zero_fraction > 0.8e0 THEN 1e0 ELSE 0e0 END AS flatline,
               round(anomaly_z, 6) AS anomaly_z
        FROM v_stats JOIN v_zero USING (meter_id) JOIN v_z USING (meter_id)""",
    "v_tx_totals": """
        SELECT transformer_id, energy AS input_total_kwh, metered AS metered_total_kwh, technical AS technical_total_kwh,
               energy - metered - technical AS unexplained_total_kwh,
               (energy - metered - technical) / greatest(energy, 1e-9) AS ratio
        FROM (SELECT t.transformer_id, coalesce(e.energy, 0e0) AS energy, coalesce(m.metered, 0e0) AS metered,
                     coalesce(l.technical, 0e0) AS technical
              FROM (SELECT DISTINCT transformer_id FROM v_meters) t
              LEFT JOIN (SELECT asset_id, round(sum(energy_input_kwh), 4) AS energy FROM v_energy GROUP BY 1) e
                     ON e.asset_id = t.transformer_id
              LEFT JOIN (SELECT transformer_id, sum(consumption_kwh) AS metered
                         FROM v_readings JOIN v_customers ON meter_id = id GROUP BY 1) m USING (transformer_id)
              LEFT JOIN (SELECT asset_id, round(sum(estimated_technical_loss_kwh), 4) AS technical
                         FROM v_technical GROUP BY 1) l ON l.asset_id = t.transformer_id)""",
    "v_peer": """
        SELECT b.*, c.transformer_id, c.region_id, p.med AS peer_median,
               CASE WHEN abs(p.med) > 1e-9 THEN round((p.med - b.recent_mean_kwh) / p.med, 6)
                    ELSE (p.med - b.recent_mean_kwh) / 1e-9 END AS peer_deviation
        FROM v_base b JOIN v_meters c ON c.id = b.meter_id
        JOIN (SELECT transformer_id, median(recent_mean_kwh) AS med FROM v_base JOIN v_meters ON id = meter_id GROUP BY 1) p
          ON p.transformer_id = c.transformer_id""",
    "v_features": """
        SELECT p.* EXCLUDE (peer_median), CAST(round(CAST(p.peer_median AS DECIMAL(28, 9)), 6) AS DOUBLE) AS peer_median_recent_kwh,
               round(t.ratio, 6) AS grid_unexplained_ratio,
               round(avg(greatest(0e0, p.peer_deviation)) OVER (PARTITION BY p.transformer_id, p.region_id), 6)
                 AS spatial_neighborhood_risk,
               c.is_ntl, c.solar_potential_flag, c.woningwaarde_category, c.baseline_annual_kwh
        FROM v_peer p JOIN v_meters c ON c.id = p.meter_id JOIN v_tx_totals t ON t.transformer_id = p.transformer_id""",
    "v_tx_features": """
        SELECT f.transformer_id, count(*) AS member_count, round(max(t.ratio), 6) AS unexplained_ratio,
               round(max(t.input_total_kwh), 4) AS input_total_kwh, round(max(t.metered_total_kwh), 4) AS metered_total_kwh,
               round(max(t.technical_total_kwh), 4) AS technical_total_kwh,
               round(max(t.unexplained_total_kwh), 4) AS unexplained_total_kwh,
               round(avg(CASE WHEN drop_ratio < 0.7e0 THEN 1e0 ELSE 0e0 END), 6) AS frac_members_dropping,
               round(avg(greatest(0e0, peer_deviation)), 6) AS mean_peer_deviation,
               round(max(anomaly_z), 6) AS max_member_anomaly_z
        FROM v_features f JOIN v_tx_totals t ON t.transformer_id = f.transformer_id GROUP BY 1""",
    # ---- rolling features of the columnar step ----
    "v_enriched": """
        SELECT r.*, hour(r.timestamp) AS hour_of_day, c.woningwaarde_category, c.solar_potential_flag
        FROM v_readings r JOIN v_customers c ON r.meter_id = c.id""",
    "v_rolling": """
        SELECT *, avg(consumption_kwh) OVER (PARTITION BY meter_id ORDER BY timestamp
                     ROWS BETWEEN 335 PRECEDING AND CURRENT ROW) AS rolling_14d_avg_kwh,
               median(consumption_kwh) OVER (PARTITION BY woningwaarde_category, hour_of_day ORDER BY timestamp, meter_id
                     ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS peer_group_median_kwh
        FROM v_enriched""",
    "v_olap": """
        SELECT meter_id, rolling_14d_avg_kwh, peer_group_median_kwh,
               CASE WHEN hour_of_day BETWEEN 8 AND 18 AND consumption_kwh < 0.5e0 * peer_group_median_kwh
                    THEN 1e0 - consumption_kwh / nullif(peer_group_median_kwh, 0e0) ELSE 0e0 END AS daylight_drop_index,
               solar_potential_flag, woningwaarde_category
        FROM v_rolling QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY timestamp DESC) = 1""",
    # ---- component scores ----
    "v_scoring_input": """
        SELECT f.* EXCLUDE (solar_potential_flag), coalesce(o.daylight_drop_index, 0e0) AS daylight_drop_index,
               coalesce(o.solar_potential_flag, f.solar_potential_flag) AS solar_potential_flag
        FROM v_features f LEFT JOIN v_olap o USING (meter_id)""",
    "v_components": """
        SELECT *, CAST(round(CAST(100e0 * (0.40e0 * supervised_probability + 0.25e0 * anomaly_score + 0.20e0 * grid_imbalance_score
                                 + 0.10e0 * peer_score + 0.05e0 * spatial_score) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS risk_score,
               least(1e0, greatest(0e0, 0.45e0 + 0.5e0 * supervised_probability - 0.35e0 * flatline)) AS confidence,
               greatest(1e-6, supervised_probability) AS suspicion_weight
        FROM (
          SELECT *, least(1e0, greatest(0e0,
                     1e0 / (1e0 + exp(-2e0 * (2.2e0 * severity + 1.8e0 * greatest(0e0, peer_deviation) - 0.55e0)))
                     * (1e0 - 0.70e0 * flatline)
                     * (CASE WHEN solar_potential_flag AND (severity > 0.2e0 OR daylight_drop_index > 0.3e0)
                             THEN 1e0 - 0.65e0 ELSE 1e0 END))) AS supervised_probability,
                 least(1e0, greatest(0e0, greatest(1e0 - exp(-abs(anomaly_z) / 3e0), flatline)
                     * (CASE WHEN solar_potential_flag AND daylight_drop_index > 0.3e0 THEN 1e0 - 0.65e0 ELSE 1e0 END)))
                   AS anomaly_score,
                 least(1e0, greatest(0e0, grid_unexplained_ratio / 0.12e0)) AS grid_imbalance_score,
                 least(1e0, greatest(0e0, greatest(0e0, peer_deviation) / 0.70e0)) AS peer_score,
                 least(1e0, greatest(0e0, spatial_neighborhood_risk / 0.50e0)) AS spatial_score
          FROM (SELECT *, least(1e0, greatest(0e0, 1e0 - drop_ratio)) AS severity FROM v_scoring_input))""",
    "v_scored": """
        SELECT *, CASE WHEN risk_score BETWEEN 0 AND 29 THEN 'LOW' WHEN risk_score BETWEEN 30 AND 49 THEN 'WATCH'
                       WHEN risk_score BETWEEN 50 AND 69 THEN 'MEDIUM' WHEN risk_score BETWEEN 70 AND 84 THEN 'HIGH'
                       ELSE 'CRITICAL' END AS risk_tier
        FROM v_components""",
    "v_tx_scored": """
        SELECT *, CASE WHEN risk_score BETWEEN 0 AND 29 THEN 'LOW' WHEN risk_score BETWEEN 30 AND 49 THEN 'WATCH'
                       WHEN risk_score BETWEEN 50 AND 69 THEN 'MEDIUM' WHEN risk_score BETWEEN 70 AND 84 THEN 'HIGH'
                       ELSE 'CRITICAL' END AS risk_tier
        FROM (SELECT *, CAST(round(CAST(100e0 * (0.40e0 * supervised_probability + 0.25e0 * anomaly_score + 0.20e0 * grid_imbalance_score
                                 + 0.10e0 * peer_score + 0.05e0 * spatial_score) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS risk_score,
                     least(1e0, greatest(0e0, 0.5e0 + 0.4e0 * supervised_probability)) AS confidence
              FROM (SELECT *, least(1e0, greatest(0e0, (unexplained_ratio - 0.02e0) / 0.06e0)) AS supervised_probability,
                       least(1e0, greatest(0e0, greatest(least(1e0, greatest(0e0, unexplained_ratio / 0.12e0)),
                                           1e0 - exp(-abs(max_member_anomaly_z) / 3e0)))) AS anomaly_score,
                       least(1e0, greatest(0e0, unexplained_ratio / 0.12e0)) AS grid_imbalance_score,
                       least(1e0, greatest(0e0, frac_members_dropping / 0.20e0)) AS peer_score,
                       least(1e0, greatest(0e0, mean_peer_deviation / 0.50e0)) AS spatial_score
                    FROM v_tx_features))""",
    # ---- open-data segments: three years of street statistics per customer street ----
    "v_years": """
        SELECT y.year, replace(zipcode, ' ', '') AS postcode, external_ref AS street, city,
               CAST(CASE y.year WHEN 2024 THEN CASE WHEN cents % 11 > 0 THEN cents % 4000 + 500 END
                                WHEN 2025 THEN (cents % 4000 + 500) - cents % 300
                                WHEN 2026 THEN CASE WHEN cents % 13 > 0 THEN (cents % 4000 + 500) - cents % 1500 END END AS DOUBLE) / 4 AS sja_kwh,
               1 + cents % 40 AS connections, CAST(cents % 101 AS DOUBLE) AS smart_meter_pct
        FROM v_customers CROSS JOIN (VALUES (2024), (2025), (2026)) y(year)""",
    "v_segments": """
        SELECT upper(concat_ws('|', coalesce(postcode, ''), coalesce(street, ''), coalesce(city, ''))) AS segment_key, postcode, street, city, connections,
               sja_2024, sja_2025, sja_2026, smart_meter_pct,
               coalesce(sja_2026, sja_2025, sja_2024) AS sja_latest, coalesce(sja_2024, sja_2025, sja_2026) AS sja_baseline
        FROM (SELECT postcode, street, city, max(connections) AS connections,
                     avg(CASE WHEN year = 2024 THEN sja_kwh END) AS sja_2024,
                     avg(CASE WHEN year = 2025 THEN sja_kwh END) AS sja_2025,
                     avg(CASE WHEN year = 2026 THEN sja_kwh END) AS sja_2026, avg(smart_meter_pct) AS smart_meter_pct
              FROM v_years WHERE sja_kwh > 0 GROUP BY 1, 2, 3)""",
    "v_streets": """
        SELECT zipcode AS zipcode_from, CASE WHEN cents % 2 = 0 THEN 'Amsterdam' ELSE city END AS city,
               baseline_annual_kwh AS annual_consume,
               CASE WHEN cents % 17 = 0 THEN NULL ELSE street_smartmeter_perc END AS smartmeter_perc,
               CAST(85 + cents % 16 AS DOUBLE) AS delivery_perc,
               CASE WHEN cents % 9 = 0 THEN NULL ELSE cents % 50 END AS num_connections
        FROM v_customers""",
}
