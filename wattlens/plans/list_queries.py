"""Queries of the filter, join, ranking, summary and case operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlens import functions as fn
from wattlens import schema as S
from wattlens.operators import cases as cs
from wattlens.operators import filters, listing, lookups, zones
from wattlens.operators.lookups import Zone
from wattlens.plans.grid_queries import stamp
from wattlens.plans.registry import query
from wattlens.plans.views import Grid


# ---- P1-P15 ---------------------------------------------------------------------
_RAW = """SELECT CASE WHEN id % 13 = 0 THEN '  ' ELSE '  ' || external_ref || ' ' END AS external_ref,
                 'Op' || region_id AS operator_name, id FROM v_customers"""


@query(
    "p1_require_keys",
    f"SELECT id, trim(external_ref) AS external_ref, operator_name FROM ({_RAW}) WHERE trim(external_ref) <> '' AND operator_name IN (SELECT 'Op' || id FROM v_regions WHERE region_type = 'municipality')",
)
def p1(spark, d):
    g = Grid(spark, d)
    raw = g.customers.select(
        "id",
        F.when(F.col("id") % 13 == 0, "  ").otherwise(F.concat(F.lit("  "), "external_ref", F.lit(" "))).alias("external_ref"),
        F.concat(F.lit("Op"), "region_id").alias("operator_name"),
    )
    operators = g.regions.filter("region_type = 'municipality'").select(F.concat(F.lit("Op"), "id").alias("name"))
    return filters.require_keys(raw, ["external_ref", "operator_name"], operators).select("id", "external_ref", "operator_name")


_FLAG_SQL = """CASE CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN '0'
               WHEN 3 THEN NULL WHEN 4 THEN '1' ELSE '' END"""


def _flag_text():
    k = F.get_json_object("props", "$.k").cast("bigint") % 6
    return F.when(k == 0, "TRUE").when(k == 1, " yes ").when(k == 2, "0").when(k == 3, None).when(k == 4, "1").otherwise("")


@query(
    "p2_truthy",
    f"SELECT event_id, coalesce(lower(trim({_FLAG_SQL})) IN ('1', 'true', 'yes', 'y'), FALSE) AS flag FROM events",
)
def p2(spark, d):
    return Grid(spark, d).table("events").select("event_id", fn.truthy(_flag_text()).alias("flag"))


@query(
    "p3_customer_metadata",
    f"""SELECT event_id, '{{"source":"production_csv"' || CASE WHEN event_type = 'error' THEN ',"incident":"error"' ELSE '' END ||
          CASE WHEN coalesce({_FLAG_SQL}, '') = '' THEN ''
               WHEN lower(trim({_FLAG_SQL})) IN ('1', 'true', 'yes', 'y') THEN ',"is_ntl":true' ELSE ',"is_ntl":false' END || '}}' AS metadata
        FROM events""",
)
def p3(spark, d):
    incident = F.when(F.col("event_type") == "error", " error ").otherwise("  ")
    return Grid(spark, d).table("events").select("event_id", fn.customer_metadata(incident, _flag_text()).alias("metadata"))


_TS_TEXT = """CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
              WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
              WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'not a time' END"""


def _ts_text():
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    m = F.col("event_id") % 4
    return (
        F.when(m == 0, F.concat(iso, F.lit("Z")))
        .when(m == 1, F.concat(iso, F.lit("+02:00")))
        .when(m == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise("not a time")
    )


@query(
    "p4_parse_utc_ts",
    f"""SELECT event_id, strftime(CAST(TRY_CAST({_TS_TEXT} AS TIMESTAMPTZ) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS timestamp
        FROM events WHERE TRY_CAST({_TS_TEXT} AS TIMESTAMPTZ) IS NOT NULL""",
)
def p4(spark, d):
    parsed = Grid(spark, d).table("events").select("event_id", fn.parse_utc_ts(_ts_text()).alias("timestamp"))
    return parsed.filter(F.col("timestamp").isNotNull()).withColumn("timestamp", stamp("timestamp"))


@query(
    "p5_default_fill",
    "SELECT id, coalesce(nullif(trim(zipcode), ''), 'single') AS tariff_type, coalesce(street_smartmeter_perc, 0.8e0) AS confidence FROM v_customers",
)
def p5(spark, d):
    return Grid(spark, d).customers.select(
        "id",
        fn.default_fill("zipcode", "single").alias("tariff_type"),
        F.coalesce(fn.optional_number("street_smartmeter_perc"), F.lit(0.8)).alias("confidence"),
    )


@query(
    "p6_optional_number",
    f"SELECT event_id, TRY_CAST(nullif(trim({_FLAG_SQL}), '') AS DOUBLE) AS number FROM events",
)
def p6(spark, d):
    return Grid(spark, d).table("events").select("event_id", fn.optional_number(_flag_text()).alias("number"))


@query("p7_normalize_zip", "SELECT id, upper(replace(zipcode, ' ', '')) AS zipcode FROM v_customers")
def p7(spark, d):
    return Grid(spark, d).customers.select("id", fn.normalize_zip("zipcode").alias("zipcode"))


@query(
    "p8_time_range",
    """SELECT asset_id, strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n FROM v_balance
       WHERE timestamp >= TIMESTAMP '1996-03-01' AND timestamp < TIMESTAMP '1999-07-01' GROUP BY 1, 2""",
)
def p8(spark, d):
    rows = Grid(spark, d).balance.filter(filters.time_range("timestamp", "1996-03-01", "1999-06-30"))
    return rows.groupBy("asset_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p9_risk_filter",
    """SELECT c.id, c.external_ref, s.risk_score, s.risk_tier FROM v_customers c
       JOIN v_scores s ON s.entity_id = c.id AND s.entity_type = 'customer' AND s.is_current
       WHERE c.external_ref ILIKE '%ER#00%5%' AND s.risk_score >= 40 AND s.risk_tier = 'MEDIUM'""",
)
def p9(spark, d):
    g = Grid(spark, d)
    rows = filters.risk_filter(lookups.with_risk(g.customers, g.scores), min_risk=40, tier="MEDIUM", q="ER#00%5")
    return rows.select("id", "external_ref", "risk_score", "risk_tier")


@query(
    "p10_bbox_filter",
    "SELECT id, lon, lat FROM v_customers WHERE lon BETWEEN 4.85e0 AND 4.95e0 AND lat BETWEEN 52.32e0 AND 52.4e0",
)
def p10(spark, d):
    return filters.bbox_filter(Grid(spark, d).customers, 4.85, 52.32, 4.95, 52.4).select("id", "lon", "lat")


@query("p11_open_cases", "SELECT case_id, mission_id, status FROM v_cases WHERE status NOT IN ('resolved', 'dismissed')")
def p11(spark, d):
    return filters.open_cases(Grid(spark, d).cases).select("case_id", "mission_id", "status")


@query(
    "p12_drop_incomplete",
    "SELECT zipcode_from, annual_consume, smartmeter_perc FROM v_streets WHERE zipcode_from IS NOT NULL AND annual_consume IS NOT NULL AND smartmeter_perc IS NOT NULL",
)
def p12(spark, d):
    columns = ["zipcode_from", "annual_consume", "smartmeter_perc"]
    return filters.drop_incomplete(Grid(spark, d).streets, columns).select(*columns)


@query(
    "p13_readings_range",
    """SELECT meter_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, consumption_kwh, reading_quality FROM v_readings
       WHERE timestamp BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'""",
)
def p13(spark, d):
    rows = filters.readings_range(Grid(spark, d).readings, None, "2024-01-10 06:00:00", "2024-01-12 18:00:00")
    return rows.select("meter_id", stamp("timestamp").alias("timestamp"), "consumption_kwh", "reading_quality")


@query("p14_list_regions", "SELECT id, name, code FROM v_regions WHERE region_type = 'municipality' ORDER BY name")
def p14(spark, d):
    return filters.list_regions(Grid(spark, d).regions)


_CURRENT = "SELECT * FROM v_scores WHERE is_current AND entity_type = 'customer'"


@query(
    "p15_dto_projection",
    f"""SELECT c.id, c.external_ref, c.transformer_id, c.region_id, c.customer_type, c.baseline_annual_kwh, c.street_smartmeter_perc,
              c.lon, c.lat, s.risk_score, s.risk_tier, s.anomaly_score, s.inspection_priority
       FROM v_customers c LEFT JOIN ({_CURRENT}) s ON s.entity_id = c.id""",
)
def p15(spark, d):
    g = Grid(spark, d)
    people = listing.customer_dto(lookups.with_risk(g.customers, g.scores))
    risk = listing.risk_dto(g.scores.filter("is_current AND entity_type = 'customer'")).select(
        F.col("entity_id").alias("id"), F.col("components.anomaly_score").alias("anomaly_score"), "inspection_priority"
    )
    return people.join(risk, "id", "left").select(
        "id", "external_ref", "transformer_id", "region_id", "customer_type", "baseline_annual_kwh", "street_smartmeter_perc",
        F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"),
        "risk_score", "risk_tier", "anomaly_score", "inspection_priority",
    )


@query(
    "p15_asset_shape",
    """SELECT a.id, a.parent_external_id, a.asset_type, a.external_id, a.name, 'Point' AS shape, a.lon, a.lat, a.region_id,
              s.risk_tier, s.risk_score
       FROM v_assets a LEFT JOIN v_scores s ON s.entity_id = a.id AND s.entity_type = 'transformer' AND s.is_current""",
)
def p15_assets(spark, d):
    g = Grid(spark, d)
    at = F.col("geometry.coordinates")
    return listing.asset_dto(lookups.with_risk(g.assets, g.scores, "transformer")).select(
        "id", "parent_external_id", "asset_type", "external_id", "name", F.col("geometry.type").alias("shape"),
        at[0].alias("lon"), at[1].alias("lat"), "region_id", "risk_tier", "risk_score",
    )


# ---- J1-J3, J5-J10, J16 ---------------------------------------------------------
@query(
    "j1_resolve_fk",
    """SELECT c.id IS NOT NULL AS resolved, count(*) AS n, sum(r.consumption_kwh) AS kwh FROM v_readings r
       LEFT JOIN v_score_base c ON c.id = r.meter_id GROUP BY 1""",
)
def j1(spark, d):
    g = Grid(spark, d)
    facts = g.readings.withColumn("ref", F.format_string(" Customer#%09d", "meter_id"))
    resolved, skipped = lookups.resolve_fk(facts, g.customers.filter("cents > 0"), "ref", "external_ref")
    both = resolved.withColumn("resolved", F.lit(True)).unionByName(
        skipped.withColumn("resolved", F.lit(False)), allowMissingColumns=True
    )
    return both.groupBy("resolved").agg(F.count(F.lit(1)).alias("n"), F.sum("consumption_kwh").alias("kwh"))


@query(
    "j2_resolve_optional_fk",
    """SELECT c.id, a.id AS transformer_fk FROM v_customers c
       LEFT JOIN (SELECT * FROM v_assets WHERE asset_type = 'transformer' AND region_id <> 2) a ON a.id = c.transformer_id""",
)
def j2(spark, d):
    g = Grid(spark, d)
    facts = g.customers.select("id", F.concat(F.lit("TX-"), "transformer_id").alias("tx"))
    dim = g.assets.filter("asset_type = 'transformer' AND region_id <> 2")
    return lookups.resolve_optional_fk(facts, dim, "tx", "external_id", out="transformer_fk").select("id", "transformer_fk")


@query(
    "j3_link_parents",
    """SELECT 'asset' AS kind, a.id, p.id AS parent_id FROM v_assets a LEFT JOIN v_assets p ON p.external_id = a.parent_external_id
       UNION ALL SELECT 'region', r.id, p.id FROM v_regions r LEFT JOIN v_regions p ON p.code = r.parent_code""",
)
def j3(spark, d):
    g = Grid(spark, d)
    assets = lookups.link_parents(g.assets, "external_id", "parent_external_id")
    regions = lookups.link_parents(g.regions, "code", "parent_code")
    return assets.select(F.lit("asset").alias("kind"), "id", "parent_id").unionByName(
        regions.select(F.lit("region").alias("kind"), "id", "parent_id")
    )


@query(
    "j5_current_risk_join",
    f"SELECT c.id, s.risk_score, s.estimated_loss_kwh, s.estimated_loss_value FROM v_customers c JOIN ({_CURRENT}) s ON s.entity_id = c.id",
)
def j5(spark, d):
    g = Grid(spark, d)
    return lookups.current_risk_join(g.customers, g.scores).select("id", "risk_score", "estimated_loss_kwh", "estimated_loss_value")


@query(
    "j6_customers_with_risk",
    f"SELECT c.id, s.risk_score, s.risk_tier FROM v_customers c LEFT JOIN ({_CURRENT}) s ON s.entity_id = c.id",
)
def j6(spark, d):
    g = Grid(spark, d)
    return lookups.with_risk(g.customers, g.scores).select("id", "risk_score", "risk_tier")


@query(
    "j7_inspection_queue_join",
    f"""SELECT c.id, s.inspection_priority, r.name AS region_name FROM v_customers c JOIN ({_CURRENT}) s ON s.entity_id = c.id
        LEFT JOIN (SELECT * FROM v_regions WHERE region_type = 'municipality') r ON r.id = c.region_id""",
)
def j7(spark, d):
    g = Grid(spark, d)
    named = g.regions.filter("region_type = 'municipality'")
    return lookups.inspection_queue_join(g.customers, g.scores, named).select("id", "inspection_priority", "region_name")


@query(
    "j8_transformers_of_region",
    """SELECT 'one' AS scope, id FROM v_assets WHERE asset_type = 'transformer' AND id IN (SELECT transformer_id FROM v_customers WHERE region_id = 2)
       UNION ALL SELECT 'all', id FROM v_assets WHERE asset_type = 'transformer'""",
)
def j8(spark, d):
    g = Grid(spark, d)
    transformers = g.assets.filter("asset_type = 'transformer'")
    scopes = {"one": 2, "all": None, "none": 99}
    parts = [
        lookups.transformers_in_region(transformers, g.customers, r).select(F.lit(s).alias("scope"), "id")
        for s, r in scopes.items()
    ]
    return lookups.union_relaxed(parts)


@query(
    "j9_transformer_peers",
    f"""WITH top AS (SELECT entity_id FROM ({_CURRENT}) ORDER BY risk_score DESC, entity_id LIMIT 1)
        SELECT id FROM v_customers WHERE transformer_id = (SELECT transformer_id FROM v_customers WHERE id = (SELECT entity_id FROM top))
          AND id <> (SELECT entity_id FROM top)""",
)
def j9(spark, d):
    g = Grid(spark, d)
    top = g.scores.filter("is_current AND entity_type = 'customer'").select(
        F.max_by("entity_id", F.struct("risk_score", -F.col("entity_id")))
    )
    return lookups.transformer_peers(g.customers, top.scalar()).select("id")


HOUSING_ZONES = (
    Zone(4.82013, 52.31027, "A", 0.02), Zone(4.90041, 52.37119, "B", 0.015), Zone(4.95177, 52.34053, "C", 0.03),
    Zone(4.88031, 52.44091, "D", 0.01), Zone(4.98107, 52.40017, "E", 0.02),
)
_ZONE_ROWS = ", ".join(f"({i}, {z.lon}e0, {z.lat}e0, '{z.label}', {z.radius_deg}e0)" for i, z in enumerate(HOUSING_ZONES))


@query(
    "j10_nearest_zone",
    f"""SELECT id, label AS woningwaarde_category, dist <= radius AS solar_potential_flag FROM (
          SELECT c.id, z.label, z.radius, sqrt((c.lon - z.lon) * (c.lon - z.lon) + (c.lat - z.lat) * (c.lat - z.lat)) AS dist,
                 row_number() OVER (PARTITION BY c.id ORDER BY sqrt((c.lon - z.lon) * (c.lon - z.lon) + (c.lat - z.lat) * (c.lat - z.lat)), z.no) AS rn
          FROM v_customers c CROSS JOIN (VALUES {_ZONE_ROWS}) z(no, lon, lat, label, radius)) WHERE rn = 1""",
)
def j10(spark, d):
    label, inside = lookups.nearest_zone(HOUSING_ZONES)
    return Grid(spark, d).customers.select("id", label.alias("woningwaarde_category"), inside.alias("solar_potential_flag"))


def _near(kind: str) -> str:
    dist = "sqrt((c.lon - z.lon) * (c.lon - z.lon) + (c.lat - z.lat) * (c.lat - z.lat))"
    return f"""(SELECT c.id, z.label, {dist} <= z.radius_deg AS inside,
                       row_number() OVER (PARTITION BY c.id ORDER BY {dist}, z.zone_no) AS rn
                FROM v_customers c LEFT JOIN (SELECT id AS zone_no, lon, lat, name AS label, CAST(5 + id % 20 AS DOUBLE) / 1000 AS radius_deg
                                              FROM v_assets WHERE asset_type = '{kind}') z ON TRUE)"""


@query(
    "j10_zone_tables",
    f"""SELECT h.id, h.label AS woningwaarde_category, s.inside AS solar_potential_flag, s.label AS zonatlas_label
        FROM {_near("transformer")} h JOIN {_near("feeder")} s ON h.id = s.id AND h.rn = 1 AND s.rn = 1""",
)
def j10_tables(spark, d):
    """Two zone tables: housing value around transformers, solar potential around feeders."""
    g = Grid(spark, d)

    def table(kind: str):
        radius = ((5 + F.col("id") % 20) / 1000).alias("radius_deg")
        return g.assets.filter(F.col("asset_type") == kind).select(F.col("id").alias("zone_no"), "lon", "lat", F.col("name").alias("label"), radius)

    housing = zones.nearest_zones(g.customers, table("transformer")).select("id", F.col("label").alias("woningwaarde_category"))
    solar = zones.nearest_zones(g.customers, table("feeder"))
    solar = solar.select("id", F.col("inside").alias("solar_potential_flag"), F.col("label").alias("zonatlas_label"))
    return housing.join(solar, "id")


_HOURLY = """SELECT date_trunc('hour', ts) AS timestamp, sum(CASE WHEN {cond} THEN CAST(round(value * 100) AS BIGINT) END) AS v
             FROM events WHERE {cond} GROUP BY 1"""


MACRO_MIX = f"""SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, round(l, 4) AS national_load_mw,
               round(s / greatest(s + w, 1e0), 6) AS production_mix_solar, round(w / greatest(s + w, 1e0), 6) AS production_mix_wind,
               CASE WHEN l > 12000 THEN 'high_demand' WHEN s + w < 500 THEN 'low_renewables' ELSE 'normal' END AS grid_status_flag
        FROM (SELECT l.timestamp, l.v * 1000 / 1000e0 AS l, coalesce(s.v * 100, 0) / 1000e0 AS s, coalesce(w.v * 100, 0) / 1000e0 AS w
              FROM ({_HOURLY.format(cond="TRUE")}) l LEFT JOIN ({_HOURLY.format(cond="event_type = 'view'")}) s USING (timestamp)
              LEFT JOIN ({_HOURLY.format(cond="event_type = 'click'")}) w USING (timestamp))"""


def macro_mix(g: Grid):
    """Hourly load of all events, with two of their kinds standing in for solar and wind."""
    e = g.table("events")

    def hourly(kind: str | None, scale: int):
        rows = e if kind is None else e.filter(F.col("event_type") == kind)
        cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
        return rows.groupBy(F.date_trunc("hour", "ts").alias("timestamp")).agg((cents * scale).cast("double").alias("kwh"))

    return lookups.macro_mix(hourly(None, 1000), hourly("view", 100), hourly("click", 100))


@query("j16_macro_mix_join", MACRO_MIX)
def j16(spark, d):
    return macro_mix(Grid(spark, d)).withColumn("timestamp", stamp("timestamp"))


# ---- A8-A11, A20, A26, A28, A29 -------------------------------------------------
@query(
    "a8_tier_histogram",
    f"""SELECT t.tier, t.tier_order, coalesce(n, 0) AS count FROM (VALUES ('LOW', 0), ('WATCH', 1), ('MEDIUM', 2), ('HIGH', 3), ('CRITICAL', 4)) t(tier, tier_order)
        LEFT JOIN (SELECT risk_tier, count(*) AS n FROM ({_CURRENT}) s JOIN v_customers c ON c.id = s.entity_id WHERE c.region_id = 1 GROUP BY 1) x
          ON x.risk_tier = t.tier""",
)
def a8(spark, d):
    g = Grid(spark, d)
    return listing.tier_histogram(g.customers, g.scores, region_id=1)


@query(
    "a9_kpi_summary",
    f"""WITH s AS ({_CURRENT}),
        bal AS (SELECT (SELECT round(sum(round(energy_input_kwh, 2)), 2) FROM v_energy WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-16')
                     - (SELECT sum(consumption_kwh) FROM v_readings WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-16')
                     - (SELECT round(sum(estimated_technical_loss_kwh), 2) FROM v_technical WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-16') AS kwh)
        SELECT 'all' AS scope, (SELECT count(*) FROM v_customers) AS total_customers,
               (SELECT count(*) FROM v_assets WHERE asset_type = 'transformer') AS total_transformers,
               (SELECT round(sum(estimated_loss_kwh), 2) FROM s) AS total_unexplained_loss_kwh,
               (SELECT round(sum(estimated_loss_value), 2) FROM s) AS total_estimated_loss_value,
               (SELECT count(*) FROM s WHERE risk_tier = 'HIGH') AS high_count, (SELECT count(*) FROM s WHERE risk_tier = 'CRITICAL') AS critical_count,
               (SELECT count(*) FROM v_cases WHERE status NOT IN ('resolved', 'dismissed')) AS open_inspections,
               (SELECT strftime(min(timestamp), '%Y-%m-%d') FROM v_energy) AS period_start, (SELECT strftime(max(timestamp), '%Y-%m-%d') FROM v_energy) AS period_end
        UNION ALL
        SELECT 'period', (SELECT count(*) FROM v_customers), (SELECT count(*) FROM v_assets WHERE asset_type = 'transformer'),
               round(kwh, 2), round(round(kwh, 2) * 0.25e0, 2),
               (SELECT count(*) FROM s WHERE risk_tier = 'HIGH'), (SELECT count(*) FROM s WHERE risk_tier = 'CRITICAL'),
               (SELECT count(*) FROM v_cases WHERE status NOT IN ('resolved', 'dismissed')), '2024-01-08', '2024-01-15'
        FROM bal""",
)
def a9(spark, d):
    g = Grid(spark, d)
    tables = (g.customers, g.assets, g.scores, g.cases, g.readings, g.energy, g.technical)
    wanted = [
        "total_customers", "total_transformers", "total_unexplained_loss_kwh", "total_estimated_loss_value", "high_count",
        "critical_count", "open_inspections", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"),
        F.date_format("period_end", "yyyy-MM-dd").alias("period_end"),
    ]
    full = listing.kpi_summary(*tables).select(F.lit("all").alias("scope"), *wanted)
    part = listing.kpi_summary(*tables, start="2024-01-08", end="2024-01-15").select(F.lit("period").alias("scope"), *wanted)
    return full.unionByName(part)


@query(
    "a10_region_hotspots",
    f"""SELECT coalesce(CAST(nullif(c.region_id, 4) AS VARCHAR), 'unassigned') AS region_id, count(*) AS customer_count,
               round(sum(CAST(round(risk_score * 100) AS BIGINT)) / count(*) / 100e0, 2) AS mean_risk, round(max(risk_score), 2) AS max_risk,
               round(sum(estimated_loss_kwh), 2) AS estimated_loss_kwh, round(sum(estimated_loss_value), 2) AS estimated_loss_value
        FROM v_customers c JOIN ({_CURRENT}) s ON s.entity_id = c.id GROUP BY 1""",
)
def a10(spark, d):
    g = Grid(spark, d)
    people = g.customers.withColumn("region_id", F.nullif("region_id", F.lit(4)))
    return listing.region_hotspots(people, g.scores)


@query(
    "a11_cell_hotspots",
    f"""SELECT CAST(floor(lon / 0.03125e0) AS BIGINT) AS gx, CAST(floor(lat / 0.03125e0) AS BIGINT) AS gy,
               round(sum(CAST(round(risk_score * 100) AS BIGINT)) / count(*) / 100e0, 2) AS mean_risk, round(max(risk_score), 2) AS max_risk,
               count(*) AS customer_count, round(sum(estimated_loss_kwh), 2) AS estimated_loss_kwh,
               floor(lon / 0.03125e0) * 0.03125e0 AS min_lon, floor(lat / 0.03125e0) * 0.03125e0 + 0.03125e0 AS max_lat, 5 AS corners
        FROM v_customers c JOIN ({_CURRENT}) s ON s.entity_id = c.id WHERE risk_score >= 20 AND region_id = 3 GROUP BY ALL""",
)
def a11(spark, d):
    g = Grid(spark, d)
    out = listing.cell_hotspots(g.customers, g.scores, resolution=5, min_risk=20, region_id=3)
    return out.select(
        "gx", "gy", "mean_risk", "max_risk", "customer_count", "estimated_loss_kwh",
        F.col("polygon")[0][0].alias("min_lon"), F.col("polygon")[2][1].alias("max_lat"), F.size("polygon").alias("corners"),
    )


@query(
    "a20_quality_stats",
    f"""SELECT min(zipcode) AS min_zip, max(zipcode) AS max_zip, count(DISTINCT zipcode) AS zips, min(lon) AS min_lon, max(lon) AS max_lon,
               min(lat) AS min_lat, max(lat) AS max_lat,
               (SELECT strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') FROM v_readings) AS readings_from,
               (SELECT strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') FROM v_energy) AS energy_to,
               (SELECT count(*) FILTER (estimated_loss_kwh = 0) FROM ({_CURRENT})) AS zero_loss,
               (SELECT count(*) FROM ({_CURRENT})) AS scored, (SELECT round(avg(risk_score), 6) FROM ({_CURRENT})) AS avg_score
        FROM v_customers WHERE zipcode IS NOT NULL""",
)
def a20(spark, d):
    g = Grid(spark, d)
    return listing.quality_stats(g.customers, g.readings, g.energy, g.scores).select(
        "min_zip", "max_zip", "zips", "min_lon", "max_lon", "min_lat", "max_lat", stamp("readings_from").alias("readings_from"),
        stamp("energy_to").alias("energy_to"), "zero_loss", "scored", F.round("avg_score", 6).alias("avg_score"),
    )


@query(
    "a26_minmax_normalize",
    f"""SELECT entity_id, round(100e0 * (inspection_priority - lo) / (hi - lo), 2) AS priority_normalized
        FROM ({_CURRENT}), (SELECT min(inspection_priority) AS lo, max(inspection_priority) AS hi FROM ({_CURRENT}))""",
)
def a26(spark, d):
    rows = Grid(spark, d).scores.filter("is_current AND entity_type = 'customer'")
    return rows.select("entity_id", listing.minmax_normalize(rows, "inspection_priority").alias("priority_normalized"))


@query(
    "a28_extent",
    """SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, (min(lon) + max(lon)) / 2 AS centre_lon,
              (min(lat) + max(lat)) / 2 AS centre_lat FROM v_customers""",
)
def a28(spark, d):
    return listing.extent(Grid(spark, d).customers)


@query(
    "a29_summary_period",
    """SELECT 'trend' AS source, strftime(date_trunc('day', min(timestamp)), '%Y-%m-%d %H:%M:%S') AS period_start,
              strftime(date_trunc('day', max(timestamp)), '%Y-%m-%d %H:%M:%S') AS period_end FROM v_energy
       UNION ALL SELECT 'bounds', '2030-01-01 00:00:00', '2030-01-31 23:59:59'
       UNION ALL SELECT 'readings', strftime(min(timestamp), '%Y-%m-%d %H:%M:%S'), strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') FROM v_readings""",
)
def a29(spark, d):
    from wattlens.operators.balance import loss_trend

    g = Grid(spark, d)
    trend = loss_trend(g.energy, g.readings, g.technical, g.customers)
    later = trend.filter(F.col("day") >= "2030-01-01")
    parts = {
        "trend": listing.summary_period(trend, g.readings),
        "bounds": listing.summary_period(later, g.readings, "2030-01-01", "2030-01-31"),
        "readings": listing.summary_period(later, g.readings),
    }
    return lookups.union_relaxed(
        [
            p.select(F.lit(k).alias("source"), stamp("period_start").alias("period_start"), stamp("period_end").alias("period_end"))
            for k, p in parts.items()
        ]
    )


# ---- L1-L4, L7, L11 -------------------------------------------------------------
@query(
    "l1_ranked_customers",
    f"""SELECT c.id, c.external_ref, s.risk_score, s.risk_tier, (SELECT count(*) FROM v_customers) AS total
        FROM v_customers c LEFT JOIN ({_CURRENT}) s ON s.entity_id = c.id ORDER BY s.risk_score DESC NULLS LAST, c.id LIMIT 25 OFFSET 50""",
)
def l1(spark, d):
    g = Grid(spark, d)
    return listing.ranked_customers(g.customers, g.scores, page=3, size=25).select("id", "external_ref", "risk_score", "risk_tier", "total")


_ACTION = f"""CASE WHEN anomaly_score >= 0.7e0 AND supervised_probability < 0.4e0 THEN '{fn.ACTION_DIAGNOSTICS}'
               WHEN risk_tier IN ('HIGH', 'CRITICAL') THEN '{fn.ACTION_INSPECT}' ELSE '{fn.ACTION_MONITOR}' END"""


@query(
    "l2_inspection_queue",
    f"""WITH q AS (SELECT s.*, c.external_ref, c.region_id FROM v_customers c JOIN ({_CURRENT}) s ON s.entity_id = c.id WHERE c.region_id = 2)
        SELECT entity_id AS customer_id, external_ref, risk_score, inspection_priority, {_ACTION} AS recommended_action, r.name AS region_name,
               round(100e0 * (inspection_priority - (SELECT min(inspection_priority) FROM q)) /
                     ((SELECT max(inspection_priority) FROM q) - (SELECT min(inspection_priority) FROM q)), 2) AS priority_normalized,
               (SELECT count(*) FROM q) AS total
        FROM q LEFT JOIN v_regions r ON r.id = q.region_id ORDER BY inspection_priority DESC, entity_id LIMIT 20 OFFSET 20""",
)
def l2(spark, d):
    g = Grid(spark, d)
    return listing.inspection_queue(g.customers, g.scores, g.regions, page=2, size=20, region_id=2).select(
        "customer_id", "external_ref", "risk_score", "inspection_priority", "recommended_action", "region_name",
        "priority_normalized", "total",
    )


@query(
    "l3_downstream_customers",
    f"""SELECT c.id AS customer_id, c.external_ref, s.risk_score, s.estimated_loss_kwh,
               (SELECT count(*) FROM v_customers WHERE transformer_id = 7) AS total
        FROM v_customers c LEFT JOIN ({_CURRENT}) s ON s.entity_id = c.id WHERE c.transformer_id = 7
        ORDER BY s.risk_score DESC NULLS LAST, c.id LIMIT 30""",
)
def l3(spark, d):
    g = Grid(spark, d)
    return listing.downstream_customers(g.customers, g.scores, 7, page=1, size=30).select(
        "customer_id", "external_ref", "risk_score", "estimated_loss_kwh", "total"
    )


@query(
    "l4_list_assets",
    """SELECT a.id, a.name, s.risk_score, s.risk_tier, t.total FROM (
         SELECT * FROM v_assets WHERE asset_type = 'transformer' AND name ILIKE '%tion_1%' ORDER BY id LIMIT 10) a
       LEFT JOIN v_scores s ON s.entity_id = a.id AND s.entity_type = 'transformer' AND s.is_current
       CROSS JOIN (SELECT count(*) AS total FROM v_assets WHERE asset_type = 'transformer' AND name ILIKE '%tion_1%') t""",
)
def l4(spark, d):
    g = Grid(spark, d)
    return listing.list_assets(g.assets, g.scores, "transformer", "tion_1", page=1, size=10).select(
        "id", "name", "risk_score", "risk_tier", "total"
    )


@query(
    "f15_recommended_action",
    f"SELECT entity_id, {_ACTION} AS recommended_action FROM ({_CURRENT})",
)
def f15(spark, d):
    rows = Grid(spark, d).scores.filter("is_current AND entity_type = 'customer'")
    return rows.select("entity_id", fn.recommended_action("anomaly_score", "supervised_probability", "risk_tier").alias("recommended_action"))


# ---- W11-W13, A18, A19, L11, R1, R2 ---------------------------------------------
@query(
    "w11_case_rank",
    """SELECT mission_id, case_id, row_number() OVER (PARTITION BY mission_id ORDER BY created_at, case_id) AS priority_rank FROM v_cases""",
)
def w11(spark, d):
    return cs.case_rank(Grid(spark, d).cases).select("mission_id", "case_id", "priority_rank")


@query(
    "w12_latest_snapshot",
    """SELECT entity_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS as_of, consumption_kwh AS recent FROM (
         SELECT meter_id AS entity_id, timestamp, consumption_kwh, row_number() OVER (PARTITION BY meter_id ORDER BY timestamp DESC) AS rn
         FROM v_readings) WHERE rn = 1""",
)
def w12(spark, d):
    snaps = Grid(spark, d).readings.select(
        F.lit("customer").alias("entity_type"), F.col("meter_id").alias("entity_id"), F.col("timestamp").alias("as_of"),
        F.col("consumption_kwh").alias("recent"),
    )
    return lookups.latest_snapshot(snaps).select("entity_id", stamp("as_of").alias("as_of"), "recent")


@query(
    "w13_current_score",
    """SELECT entity_id, risk_score, strftime(scored_at, '%Y-%m-%d %H:%M:%S') AS scored_at FROM (
         SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY scored_at DESC) AS rn FROM v_scores
         WHERE is_current AND entity_type = 'customer') WHERE rn = 1""",
)
def w13(spark, d):
    return lookups.current_scores(Grid(spark, d).scores, "customer").select(
        "entity_id", "risk_score", stamp("scored_at").alias("scored_at")
    )


def case_events(g: Grid):
    return g.table("lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_shipdate").alias("happened"),
        F.col("l_linenumber").cast("bigint").alias("no"),
        F.when(F.col("l_returnflag") != "N", F.when(F.col("l_linestatus") == "O", "scheduled").otherwise("visited")).alias("status"),
        F.when(F.col("l_discount") > 0.03, F.col("l_suppkey")).alias("assigned_to"),
        F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("outcome"),
    )


_EVENTS = """SELECT l_orderkey AS case_id, l_shipdate AS happened, l_linenumber AS no,
                    CASE WHEN l_returnflag = 'R' THEN 'resolved'
                         WHEN l_returnflag <> 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'scheduled' ELSE 'visited' END END AS status,
                    CASE WHEN l_discount > 0.03e0 THEN l_suppkey END AS assigned_to,
                    CASE WHEN l_returnflag = 'R' THEN l_partkey END AS outcome FROM lineitem"""
_NEWEST = "SELECT case_id, {f} FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY happened DESC, no DESC, {f} DESC) AS rn FROM ev WHERE {f} IS NOT NULL) WHERE rn = 1"


@query(
    "a18_fold_case_events",
    f"""WITH ev AS ({_EVENTS}) SELECT c.case_id, status, assigned_to, outcome FROM (SELECT DISTINCT case_id FROM ev) c
        LEFT JOIN ({_NEWEST.format(f="status")}) USING (case_id) LEFT JOIN ({_NEWEST.format(f="assigned_to")}) USING (case_id)
        LEFT JOIN ({_NEWEST.format(f="outcome")}) USING (case_id)""",
)
def a18(spark, d):
    return cs.fold_case_events(case_events(Grid(spark, d)), ["happened", "no"], ["status", "assigned_to", "outcome"])


_MISSIONS = f"""SELECT mission_id, count(*) AS case_count, coalesce(sum(s.estimated_loss_value), 0e0) AS estimated_total_value,
                       strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS created_at
                FROM v_cases c LEFT JOIN ({_CURRENT}) s ON s.entity_id = c.customer_id GROUP BY 1"""


@query("a19_mission_rollup", _MISSIONS)
def a19(spark, d):
    g = Grid(spark, d)
    return cs.mission_rollup(g.cases, g.scores).withColumn("created_at", stamp("created_at"))


@query("l11_list_missions", _MISSIONS)
def l11(spark, d):
    g = Grid(spark, d)
    return cs.list_missions(g.cases, g.scores).withColumn("created_at", stamp("created_at"))


def _stops(g: Grid):
    people = g.customers.select(F.col("id").alias("customer_id"), "lon", "lat")
    return g.cases.select("mission_id", F.col("case_id").alias("stop_no"), "customer_id").join(people, "customer_id", "left")


_ROUTES = """WITH RECURSIVE places AS (
        SELECT mission_id, lon, lat, min(case_id) AS first_stop FROM v_cases c JOIN v_customers p ON p.id = c.customer_id GROUP BY 1, 2, 3),
      walk AS (
        SELECT mission_id, lon, lat, [first_stop] AS seen, 0e0 AS km FROM places
        QUALIFY row_number() OVER (PARTITION BY mission_id ORDER BY first_stop) = 1
        UNION ALL
        SELECT mission_id, lon, lat, seen, km FROM (
          SELECT w.mission_id, p.lon, p.lat, list_append(w.seen, p.first_stop) AS seen, w.km + leg AS km,
                 row_number() OVER (PARTITION BY w.mission_id ORDER BY round(leg, 9), p.first_stop) AS rn
          FROM walk w JOIN places p ON p.mission_id = w.mission_id AND NOT list_contains(w.seen, p.first_stop),
          LATERAL (SELECT 2 * 6371e0 * asin(sqrt(pow(sin(radians(p.lat - w.lat) / 2), 2)
                     + cos(radians(w.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - w.lon) / 2), 2))) AS leg) g)
        WHERE rn = 1)
      SELECT m.mission_id, round(coalesce(max(km), 0e0), 3) AS total_distance_km, CAST(coalesce(max(len(seen)), 0) AS INTEGER) AS places
      FROM (SELECT DISTINCT mission_id FROM v_cases) m LEFT JOIN walk USING (mission_id) GROUP BY 1"""


@query("r1_mission_routes", _ROUTES)
def r1(spark, d):
    g = Grid(spark, d)
    routes = cs.mission_routes(_stops(g))
    out = cs.route_summaries(g.cases, routes)
    return out.select("mission_id", "total_distance_km", F.size("coordinates").alias("places"))


@query(
    "r2_verify_invariants",
    """SELECT bool_and(abs(input_total_kwh - metered_total_kwh - technical_total_kwh - unexplained_total_kwh) <= 1e0) AS all_reconcile,
              count(*) FILTER (ratio BETWEEN 0.085e0 AND 0.115e0) AS in_band, count(*) AS transformers,
              (SELECT bool_and(s.risk_tier = 'CRITICAL') FROM v_scores s JOIN v_customers c ON c.id = s.entity_id
               WHERE s.is_current AND s.entity_type = 'customer' AND c.is_ntl) AS bypass_critical
       FROM v_tx_totals""",
)
def r2(spark, d):
    from wattlens.operators.features import transformer_totals

    g = Grid(spark, d)
    people = g.customers.withColumn("incident", F.when(F.col("is_ntl"), "partial_bypass"))
    totals = transformer_totals(g.stored, g.meters, *g.fed)
    return cs.verify_invariants(g.scores, people, totals)


# ---- U1-U4, L10 -----------------------------------------------------------------
@query(
    "u1_union_relaxed",
    """SELECT id, external_ref, NULL AS asset_type, lon FROM v_customers
       UNION ALL SELECT id, NULL, asset_type, lon FROM v_assets""",
)
def u1(spark, d):
    g = Grid(spark, d)
    return lookups.union_relaxed([g.customers.select("id", "external_ref", "lon"), g.assets.select("id", "asset_type", "lon")]).select(
        "id", "external_ref", "asset_type", "lon"
    )


@query(
    "u3_dedupe_keys",
    """SELECT zipcode, id, external_ref FROM (SELECT zipcode, id, external_ref, row_number() OVER (PARTITION BY zipcode ORDER BY id) AS rn
       FROM v_customers) WHERE rn = 1""",
)
def u3(spark, d):
    rows = Grid(spark, d).customers.select("zipcode", "id", "external_ref")
    return lookups.dedupe_keys(rows, ["zipcode"], ["id"])


_BUCKET = "CAST('0x' || substr(sha256(external_ref), 1, 8) AS BIGINT) / 4294967295e0 < 0.3e0"


@query(
    "u4_assert_disjoint",
    f"""SELECT count(*) AS overlap, count(*) = 0 AS disjoint FROM (
          SELECT external_ref FROM v_customers WHERE NOT ({_BUCKET}) INTERSECT SELECT external_ref FROM v_customers WHERE {_BUCKET})""",
)
def u4(spark, d):
    c = Grid(spark, d).customers
    test = fn.is_test_ref("external_ref", 0.3)
    return lookups.split_checks(c.filter(~test), c.filter(test), "external_ref", 1103, 1439)


@query(
    "l10_list_models",
    """SELECT 'scores-' || strftime(scored_at, '%Y%m%d') AS model_version, is_active, positives, 20e0 AS k FROM (
         SELECT scored_at, bool_and(is_current) AS is_active, CAST(count(*) FILTER (risk_score >= 50) AS DOUBLE) AS positives
         FROM v_scores WHERE entity_type = 'customer' GROUP BY 1)""",
)
def l10(spark, d):
    return lookups.list_models(model_runs(Grid(spark, d))).select(
        "model_version", "is_active", F.col("metrics")["positives"].alias("positives"), F.col("metrics")["k"].alias("k")
    )


@query(
    "l10_active_model",
    """SELECT 'scores-' || strftime(max(scored_at), '%Y%m%d') AS model_version, TRUE AS is_active
       FROM v_scores WHERE entity_type = 'customer' AND is_current""",
)
def l10_active(spark, d):
    return lookups.active_model(model_runs(Grid(spark, d))).select("model_version", "is_active")


def model_runs(g: Grid):
    """Each scoring run as a registered model."""
    runs = g.scores.filter("entity_type = 'customer'").groupBy("scored_at").agg(
        F.bool_and("is_current").alias("is_active"), F.count_if(F.col("risk_score") >= 50).cast("double").alias("positives")
    )
    return runs.select(
        F.concat(F.lit("scores-"), F.date_format("scored_at", "yyyyMMdd")).alias("model_version"),
        "is_active",
        F.col("scored_at").alias("trained_at"),
        F.create_map(F.lit("positives"), F.col("positives")).alias("metrics"),
        F.lit(S.PRECISION_AT).alias("k"),
    )


