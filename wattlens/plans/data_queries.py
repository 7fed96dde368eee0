"""Queries of the sources, scalar functions, open-data and sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlens import functions as fn
from wattlens import schema as S
from wattlens.operators import opendata as od
from wattlens.operators import sequences as sq
from wattlens.operators import lookups
from wattlens.plans.grid_queries import day, long, stamp
from wattlens.plans.list_queries import MACRO_MIX, macro_mix
from wattlens.plans.registry import query
from wattlens.plans.views import Grid
from wattlens.session import materialize, work_path
from wattlens.sources import files, ingest, tables


# ---- the ingest layout, derived from the grid views -----------------------------
def ingest_tables(g: Grid):
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    op = F.lit("Gridco").alias("operator_name")
    operators = g.regions.filter("region_type = 'country'").select(F.lit("Gridco").alias("name"), F.lit("NLD").alias("country_code"))
    regions = g.regions.select("code", "name", "region_type", op, "parent_code")
    assets = g.assets.select("external_id", "asset_type", "name", op, "lon", "lat", "parent_external_id")
    people = g.customers.select(
        "external_ref", "customer_type", op, "lon", "lat",
        F.concat(F.lit("TX-"), "transformer_id").alias("transformer_external_id"),
        F.concat(F.lit("FD-"), "region_id").alias("feeder_external_id"),
        F.concat(F.lit("R"), "region_id").alias("region_code"),
        "zipcode", "baseline_annual_kwh", F.when(F.col("is_ntl"), "bypass").alias("incident"), "is_ntl",
    )
    readings = g.readings.select(
        F.format_string("Customer#%09d", "meter_id").alias("customer_external_ref"),
        F.date_format("timestamp", iso).alias("timestamp"), "consumption_kwh", "reading_quality",
    )
    key = F.concat(F.lit("TX-"), "asset_id").alias("asset_external_id")
    energy = g.energy.select(key, F.date_format("timestamp", iso).alias("timestamp"), "energy_input_kwh")
    technical = g.technical.select(
        key, F.date_format("timestamp", iso).alias("timestamp"), "estimated_technical_loss_kwh", "method", "confidence"
    )
    return {
        "operators": operators, "regions": regions, "grid_assets": assets, "customers": people, "meter_readings": readings,
        "asset_energy_readings": energy, "technical_loss_estimates": technical,
    }


@query(
    "s1_read_checked_csv",
    """SELECT external_ref, customer_type, lon, lat, baseline_annual_kwh, 'TX-' || transformer_id AS transformer_external_id FROM v_customers""",
)
def s1(spark, d):
    g = Grid(spark, d)
    path = files.write_ingest_csvs({"customers": ingest_tables(g)["customers"]}, work_path(spark, "csv"))["customers"]
    raw = files.read_checked_csv(spark, path, ["external_ref", "customer_type", "operator_name", "lon", "lat"], "customers.csv", S.CUSTOMERS_CSV)
    return raw.select(
        "external_ref", "customer_type", fn.optional_number("lon").alias("lon"), fn.optional_number("lat").alias("lat"),
        fn.optional_number("baseline_annual_kwh").alias("baseline_annual_kwh"), "transformer_external_id",
    )


@query("s2_optional_source", "SELECT id, CAST(NULL AS VARCHAR) AS region_fk FROM v_customers")
def s2(spark, d):
    absent = files.optional_source(
        spark, work_path(spark, "absent") + "/regions.csv", ["code", "name", "region_type", "operator_name"], "regions.csv", S.REGIONS_CSV
    )
    people = Grid(spark, d).customers.select("id", F.concat(F.lit("R"), "region_id").alias("region_code"))
    return lookups.resolve_optional_fk(people, absent, "region_code", "code", id_column="code", out="region_fk").select("id", "region_fk")


@query(
    "s3_read_olap_parquet",
    """SELECT meter_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, consumption_kwh AS kwh_consumed FROM v_readings
       WHERE reading_quality <> 'good' AND timestamp >= TIMESTAMP '2024-01-15' AND timestamp < TIMESTAMP '2024-01-20'""",
)
def s3(spark, d):
    path = work_path(spark, "olap")
    files.export_readings_parquet(Grid(spark, d).readings, path)
    rows = files.read_olap_parquet(spark, path).filter(F.col("date").between("2024-01-15", "2024-01-19") & F.col("is_estimated"))
    return rows.select("meter_id", stamp("timestamp").alias("timestamp"), "kwh_consumed")


@query(
    "s4_export_readings_parquet",
    """SELECT meter_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, consumption_kwh AS kwh_consumed,
              reading_quality <> 'good' AS is_estimated, strftime(timestamp, '%Y-%m-%d') AS date FROM v_readings""",
)
def s4(spark, d):
    path = work_path(spark, "olap")
    files.export_readings_parquet(Grid(spark, d).readings, path)
    return files.read_olap_parquet(spark, path).select(
        "meter_id", stamp("timestamp").alias("timestamp"), "kwh_consumed", "is_estimated", F.col("date").cast("string").alias("date")
    )


@query(
    "s5_write_series_parquet",
    MACRO_MIX,
)
def s5(spark, d):
    path = work_path(spark, "series")
    files.write_series_parquet(spark, macro_mix(Grid(spark, d)), path)
    return spark.read.parquet(path).withColumn("timestamp", stamp("timestamp"))


_CONTEXT = """SELECT event_id, event_type, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events"""


@query("s6_read_json_context", f"SELECT k, count(*) AS n FROM ({_CONTEXT}) GROUP BY 1")
def s6(spark, d):
    """One list per file, 1000 objects each, with items and files the reader must drop."""
    path = work_path(spark, "context")
    block = F.floor(F.col("event_id") / 1000).alias("block")
    listed = F.concat(F.lit("["), F.array_join(F.collect_list("props"), ","), F.lit(', 7, "x"]'))
    docs = Grid(spark, d).table("events").groupBy(block).agg(listed.alias("value"))
    broken = docs.select((-1 - F.col("block")).alias("block"), F.lit("{broken").alias("value"))
    docs.unionByName(broken).repartition("block").write.partitionBy("block").text(path)
    context = files.read_json_context(spark, path, "*.txt")
    return context.groupBy(F.col("fields")["k"].cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s7_read_utilization_payload",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS timestamp, sum(CAST(round(value * 100) AS BIGINT)) * 1e0 AS kwh
       FROM events WHERE event_type <> 'signup' GROUP BY 1""",
)
def s7(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    v = F.round(F.col("value") * 100).cast("bigint").cast("string")
    kind = F.col("event_type")

    def item(time_key: str, value_key: str, quote: str = ""):
        return F.concat(F.lit(f'{{"{time_key}": "'), iso, F.lit(f'", "{value_key}": {quote}'), v, F.lit(f"{quote}}}"))

    payload = (
        F.when(kind == "view", F.concat(F.lit('{"hydra:member": ['), item("validfrom", "volume"), F.lit(', "junk"]}')))
        .when(kind == "click", F.concat(F.lit('{"member": ['), item("validFrom", "value"), F.lit("]}")))
        .when(kind == "purchase", F.concat(F.lit('{"@graph": ['), item("timestamp", "amount"), F.lit("]}")))
        .when(kind == "error", F.concat(F.lit("["), item("timestamp", "volume", '"'), F.lit(', {"volume": 5}, {"timestamp": "bad", "volume": 1}]')))
        .otherwise(F.lit('{"other": []}'))
    )
    payloads = Grid(spark, d).table("events").select(payload.alias("payload"))
    return files.read_utilization_payload(payloads).select(stamp("timestamp").alias("timestamp"), "kwh")


def write_year_files(g: Grid, folder: str) -> str:
    """Three yearly files in two dialects, with gas rows and a decimal comma."""
    def comma(c):
        return F.regexp_replace(F.col(c).cast("string"), r"\.", ",")

    for year, sep, use in ((2024, "\t", "SJI_GEMIDDELD"), (2025, ";", "SJA_GEMIDDELD"), (2026, "\t", "SJA_GEMIDDELD")):
        rows = g.years.filter(F.col("year") == year).withColumn("product", F.explode(F.array(F.lit("ELK"), F.lit("GAS"))))
        out = rows.select(
            F.col("product").alias("PRODUCTSOORT"),
            F.concat(F.substring("postcode", 1, 4), F.lit(" "), F.substring("postcode", 5, 2)).alias("POSTCODE_VAN"),
            F.concat(F.col("street"), F.lit("  ")).alias("STRAATNAAM"),
            F.col("city").alias("WOONPLAATS"),
            comma("sja_kwh").alias(use),
            F.col("connections").alias("AANSLUITINGEN_AANTAL"),
            comma("smart_meter_pct").alias("SLIMME_METER_PERC"),
        )
        out.write.option("header", True).option("sep", sep).csv(f"{folder}/kleinverbruikgegevens {year}.csv")
    return f"{folder}/*.csv"


_YEARS = "SELECT postcode, street, city, sja_kwh, connections, smart_meter_pct, year FROM v_years WHERE sja_kwh > 0"


@query("s8_read_year_csv", f"SELECT * EXCLUDE (year) FROM ({_YEARS}) WHERE year = 2025")
def s8(spark, d):
    folder = work_path(spark, "years")
    write_year_files(Grid(spark, d), folder)
    rows = files.read_year_csv(spark, f"{folder}/kleinverbruikgegevens 2025.csv")
    return rows.filter("product = 'ELK' AND sja_kwh > 0").drop("product")


@query("s9_scan_years", _YEARS)
def s9(spark, d):
    return files.scan_years(spark, write_year_files(Grid(spark, d), work_path(spark, "years")))


@query(
    "s10_write_ingest_csvs",
    """SELECT 'operators' AS file, 1 AS n UNION ALL SELECT 'regions', count(*) FROM v_regions UNION ALL SELECT 'grid_assets', count(*) FROM v_assets
       UNION ALL SELECT 'customers', count(*) FROM v_customers UNION ALL SELECT 'meter_readings', count(*) FROM v_readings
       UNION ALL SELECT 'asset_energy_readings', count(*) FROM v_energy UNION ALL SELECT 'technical_loss_estimates', count(*) FROM v_technical""",
)
def s10(spark, d):
    paths = files.write_ingest_csvs(ingest_tables(Grid(spark, d)), work_path(spark, "layout"))
    parts = [
        spark.read.option("header", True).csv(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("file"), "n")
        for name, path in paths.items()
    ]
    return lookups.union_relaxed(parts)


@query(
    "s11_upsert",
    """SELECT meter_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp,
              CAST(CASE WHEN n_new > 0 THEN new_kwh ELSE old_kwh END AS DOUBLE) AS consumption_kwh,
              CASE WHEN n_old > 0 THEN old_current ELSE new_current END AS current
       FROM (SELECT user_id AS meter_id, date_trunc('hour', ts) AS timestamp, count(*) FILTER (event_type <> 'view') AS n_old,
                    count(*) FILTER (event_type = 'view') AS n_new,
                    arg_max(CAST(round(value * 100) AS BIGINT), event_id) FILTER (event_type = 'view') AS new_kwh,
                    sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type <> 'view') AS old_kwh,
                    min(event_id) FILTER (event_type <> 'view') AS old_current,
                    arg_max(-event_id, event_id) FILTER (event_type = 'view') AS new_current
             FROM events GROUP BY 1, 2)""",
)
def s11(spark, d):
    e = Grid(spark, d).table("events").select(
        F.col("user_id").alias("meter_id"), F.date_trunc("hour", "ts").alias("timestamp"), "event_id", "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("c"),
    )
    target = e.filter("event_type <> 'view'").groupBy("meter_id", "timestamp").agg(
        F.sum("c").cast("double").alias("consumption_kwh"), F.min("event_id").alias("current")
    )
    batch = e.filter("event_type = 'view'").select(
        "meter_id", "timestamp", F.col("c").cast("double").alias("consumption_kwh"), (-F.col("event_id")).alias("current"), "event_id"
    )
    merged = tables.upsert(target, batch, ["meter_id", "timestamp"], ["consumption_kwh"], "event_id")
    return merged.withColumn("timestamp", stamp("timestamp"))


@query(
    "s12_replace_version",
    """SELECT 'v1' AS feature_version, count(*) AS n, sum(consumption_kwh) AS kwh FROM v_readings
       UNION ALL SELECT 'v2', count(*), sum(consumption_kwh) FROM v_readings WHERE reading_quality = 'good'""",
)
def s12(spark, d):
    r, path = Grid(spark, d).readings, work_path(spark, "versions")
    tables.replace_version(r.withColumn("feature_version", F.lit("v1")), path)
    tables.replace_version(r.withColumn("feature_version", F.lit("v2")), path)
    tables.replace_version(r.filter("reading_quality = 'good'").withColumn("feature_version", F.lit("v2")), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("feature_version").agg(F.count(F.lit(1)).alias("n"), F.sum("consumption_kwh").alias("kwh"))


@query(
    "s13_publish_generation",
    """SELECT is_current, count(*) AS n, sum(estimated_loss_kwh) AS kwh FROM v_scores WHERE entity_type = 'customer' GROUP BY 1""",
)
def s13(spark, d):
    people, path = Grid(spark, d).scores.filter("entity_type = 'customer'"), work_path(spark, "scores")
    tables.publish_generation(people.filter("NOT is_current"), path, "g20240131")
    tables.publish_generation(people.filter("is_current"), path, "g20240201")
    return tables.published_scores(spark, path).groupBy("is_current").agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimated_loss_kwh").alias("kwh")
    )


@query("s14_audit_append", "SELECT 'sync_readings' AS action, count(*) AS record_count FROM v_readings UNION ALL SELECT 'sync_customers', count(*) FROM v_customers")
def s14(spark, d):
    g, base = Grid(spark, d), work_path(spark, "audited")
    tables.write_audited(g.readings, f"{base}/readings", f"{base}/audit", "sync_readings")
    tables.write_audited(g.customers, f"{base}/customers", f"{base}/audit", "sync_customers")
    return spark.read.parquet(f"{base}/audit").select("action", "record_count")


_FEATURES = """SELECT c.id, risk_score, '{"type":"Feature","id":' || c.id || ',"geometry":{"type":"Point","coordinates":[' || lon || ',' || lat ||
              ']},"properties":{"customer_id":' || c.id || ',"external_ref":"' || external_ref || '","risk_tier":"' || risk_tier || '"}}' AS feature
       FROM v_customers c JOIN v_scores s ON s.entity_id = c.id AND s.entity_type = 'customer' AND s.is_current
       WHERE risk_score >= 60 AND region_id = 1"""


def risky_features(g: Grid):
    rows = lookups.current_risk_join(g.customers.filter("region_id = 1"), g.scores).filter("risk_score >= 60")
    rows = rows.withColumn("customer_id", F.col("id"))
    return files.geojson_features(rows, ["customer_id", "external_ref", "risk_tier"])


@query("s15_to_geojson", f"SELECT id, feature FROM ({_FEATURES})")
def s15(spark, d):
    return risky_features(Grid(spark, d)).select("id", "feature")


@query(
    "s15_map_document",
    f"""SELECT '{{"type":"FeatureCollection","features":[' || coalesce(string_agg(feature, ',' ORDER BY risk_score DESC, id), '') || ']}}' AS geojson
        FROM (SELECT * FROM ({_FEATURES}) ORDER BY risk_score DESC, id LIMIT 200)""",
)
def s15_document(spark, d):
    return files.geojson_document(risky_features(Grid(spark, d)), 200)


@query(
    "s18_scan_external_table",
    "SELECT meter_id, count(*) AS n, sum(consumption_kwh) AS kwh FROM v_readings WHERE meter_id IN (SELECT id FROM v_score_base) GROUP BY 1",
)
def s18(spark, d):
    # The data source named here is Parquet: no database server is at hand.
    g, path = Grid(spark, d), work_path(spark, "external")
    g.readings.write.parquet(path)
    readings = files.scan_external_table(spark, {"path": path}, "parquet")
    known = files.meter_series(readings, g.customers.filter("cents > 0"))
    return known.groupBy("meter_id").agg(F.count(F.lit(1)).alias("n"), F.sum("consumption_kwh").alias("kwh"))


@query(
    "e1_ingest_layout",
    """SELECT r.meter_id, count(*) AS n, sum(r.consumption_kwh + 1) AS kwh, 'TX-' || c.transformer_id AS transformer, c.zipcode, NULL AS reason
       FROM v_readings r JOIN v_customers c ON c.id = r.meter_id GROUP BY ALL
       UNION ALL SELECT NULL, count(*), NULL, NULL, NULL, 'unknown_key' FROM v_readings HAVING count(*) > 0""",
)
def e1(spark, d):
    """CSV layout written, read back, keyed and typed: the whole ingest path.

    Every asset and customer also stands in the files as an earlier row that the later
    one replaces, and under a second operator; every reading has an earlier version,
    and one for a meter nobody has.
    """
    tables_in = ingest_tables(Grid(spark, d))
    second = F.lit("Otherco").alias("operator_name")
    tables_in["operators"] = tables_in["operators"].unionByName(tables_in["operators"].withColumn("name", F.lit("Otherco")))
    for name, changed in (("grid_assets", "name"), ("customers", "zipcode")):
        rows = tables_in[name]
        other = rows.withColumn("operator_name", second).withColumn(changed, F.lit("else"))
        tables_in[name] = other.unionByName(rows.withColumn(changed, F.lit("early"))).unionByName(rows)
    rows = tables_in["meter_readings"].withColumn("operator_name", F.lit("Gridco"))
    later = rows.withColumn("consumption_kwh", F.col("consumption_kwh") + 1)
    lost = rows.withColumn("customer_external_ref", F.lit("nobody"))
    tables_in["meter_readings"] = rows.unionByName(later).unionByName(lost)
    paths = files.write_ingest_csvs(tables_in, work_path(spark, "layout"))

    def raw(name, required, schema):
        return files.read_checked_csv(spark, paths[name], required, f"{name}.csv", schema, ordered=True)

    ops = ingest.operators(raw("operators", ["name", "country_code"], S.OPERATORS_CSV))
    areas = ingest.regions(raw("regions", ["code", "name"], S.REGIONS_CSV), ops)
    assets = ingest.grid_assets(raw("grid_assets", ["external_id"], S.ASSETS_CSV), ops)
    people = ingest.customers(raw("customers", ["external_ref"], S.CUSTOMERS_CSV), ops, assets, areas)
    people = materialize(people, "people")
    raw_readings = raw("meter_readings", ["customer_external_ref"], f"{S.READINGS_CSV}, operator_name string")
    empty, _ = ingest.meter_readings(raw_readings.limit(0), people, ops)
    readings, _, rejects = ingest.merge_readings(empty.drop("_row"), raw_readings, people, ops)
    refused = rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    per_meter = readings.groupBy(F.col("meter_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("consumption_kwh").alias("kwh"))
    tx = assets.select(F.col("id").alias("transformer_id"), F.col("external_id").alias("transformer"))
    return per_meter.join(people, "id").join(tx, "transformer_id", "left").select(
        F.substring("external_ref", 10, 9).cast("bigint").alias("meter_id"), "n", "kwh", "transformer", "zipcode"
    ).unionByName(refused, allowMissingColumns=True)


# ---- F1-F5, F16-F29 -------------------------------------------------------------
@query("f1_unexplained_loss", "SELECT asset_id, strftime(timestamp, '%Y-%m-%d') AS day, sum(energy_input_kwh - metered_kwh - technical_kwh) AS unexplained_kwh FROM v_balance GROUP BY 1, 2")
def f1(spark, d):
    b = Grid(spark, d).balance
    rest = fn.unexplained_loss("energy_input_kwh", ["metered_kwh"], "technical_kwh")
    return b.groupBy("asset_id", day("timestamp").alias("day")).agg(F.sum(rest).alias("unexplained_kwh"))


@query(
    "f2_unexplained_loss_ratio",
    "SELECT asset_id, round((sum(energy_input_kwh) - sum(metered_kwh) - sum(technical_kwh)) / greatest(sum(energy_input_kwh), 1e-9), 8) AS ratio FROM v_balance GROUP BY 1",
)
def f2(spark, d):
    sums = Grid(spark, d).balance.groupBy("asset_id").agg(
        *[F.sum(c).alias(c) for c in ("energy_input_kwh", "metered_kwh", "technical_kwh")]
    )
    rest = fn.unexplained_loss("energy_input_kwh", "metered_kwh", "technical_kwh")
    return sums.select("asset_id", F.round(fn.unexplained_loss_ratio(rest, "energy_input_kwh"), 8).alias("ratio"))


@query(
    "f3_risk_score",
    """SELECT id, CAST(round(CAST(40 * supervised_probability + 25 * anomaly_score + 20 * grid_imbalance_score + 10 * peer_score + 5 * spatial_score
              AS DECIMAL(18, 6)), 4) AS DOUBLE) AS risk_score FROM v_score_base""",
)
def f3(spark, d):
    rows = Grid(spark, d).scores.filter("is_current AND entity_type = 'customer'")
    return rows.select(F.col("entity_id").alias("id"), fn.risk_score().alias("risk_score"))


@query("f4_risk_tier", "SELECT entity_type, entity_id, is_current, risk_tier FROM v_scores")
def f4(spark, d):
    return Grid(spark, d).scores.select("entity_type", "entity_id", "is_current", fn.risk_tier("risk_score").alias("risk_tier"))


@query(
    "f5_loss_value_and_priority",
    """SELECT entity_id, estimated_loss_kwh * 0.25e0 AS loss_value,
              supervised_probability * (estimated_loss_kwh * 0.25e0) * anomaly_score * 0.5e0 - 75e0 AS priority
       FROM v_scores WHERE is_current AND entity_type = 'customer'""",
)
def f5(spark, d):
    value = fn.loss_value("estimated_loss_kwh")
    return Grid(spark, d).scores.filter("is_current AND entity_type = 'customer'").select(
        "entity_id",
        value.alias("loss_value"),
        fn.inspection_priority("supervised_probability", value, "anomaly_score", factor=0.5).alias("priority"),
    )


_PLACED = """SELECT c.id, c.lon, c.lat, a.lon AS alon, a.lat AS alat FROM v_customers c
             JOIN v_assets a ON a.id = c.transformer_id AND a.asset_type = 'transformer'"""


def _placed(g: Grid):
    a = g.assets.filter("asset_type = 'transformer'").select(
        F.col("id").alias("transformer_id"), F.col("lon").alias("alon"), F.col("lat").alias("alat")
    )
    return g.customers.join(a, "transformer_id")


@query(
    "f16_haversine_km",
    f"""SELECT id, round(2 * 6371e0 * asin(sqrt(pow(sin((radians(alat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(alat))
              * pow(sin((radians(alon) - radians(lon)) / 2), 2))), 6) AS km FROM ({_PLACED})""",
)
def f16(spark, d):
    return _placed(Grid(spark, d)).select("id", F.round(fn.haversine_km("lon", "lat", "alon", "alat"), 6).alias("km"))


@query("f17_planar_deg_distance", f"SELECT id, round(sqrt((lon - alon) * (lon - alon) + (lat - alat) * (lat - alat)), 8) AS degrees FROM ({_PLACED})")
def f17(spark, d):
    return _placed(Grid(spark, d)).select("id", F.round(fn.planar_deg_distance("lon", "lat", "alon", "alat"), 8).alias("degrees"))


@query(
    "f18_external_ref",
    """SELECT id, 'STEDIN-' || upper(substr(sha256(upper(coalesce(zipcode, '') || '|' || trim(external_ref) || '|' || coalesce(trim(city), ''))), 1, 16)) AS ref FROM v_customers""",
)
def f18(spark, d):
    return Grid(spark, d).customers.select("id", fn.external_ref("zipcode", "external_ref", "city").alias("ref"))


def _u32(expr: str, start: int) -> str:
    return f"CAST('0x' || substr(sha256({expr}), {start}, 8) AS BIGINT)"


@query(
    "f19_hash_unit",
    f"SELECT id, {_u32('external_ref', 1)} / 4294967296e0 AS u, {_u32('external_ref', 9)} / 4294967296e0 AS v FROM v_customers",
)
def f19(spark, d):
    u, v = fn.hash_unit("external_ref")
    return Grid(spark, d).customers.select("id", u.alias("u"), v.alias("v"))


@query("f20_hash_bucket_split", f"SELECT id, {_u32('external_ref', 1)} / 4294967295e0 < 0.3e0 AS is_test FROM v_customers")
def f20(spark, d):
    return Grid(spark, d).customers.select("id", fn.is_test_ref("external_ref", 0.3).alias("is_test"))


@query(
    "f21_slug",
    """SELECT doc_id, CASE WHEN s = '' THEN 'SEG' ELSE s END AS slug FROM (
         SELECT doc_id, substr(upper(regexp_replace(regexp_replace(trim(text), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 24) AS s FROM documents)""",
)
def f21(spark, d):
    return Grid(spark, d).table("documents").select("doc_id", fn.slug("text").alias("slug"))


@query("f22_segment_key", "SELECT id, upper(concat_ws('|', coalesce(zipcode, ''), external_ref, coalesce(city, ''))) AS segment_key FROM v_customers")
def f22(spark, d):
    return Grid(spark, d).customers.select("id", fn.segment_key("zipcode", "external_ref", "city").alias("segment_key"))


@query("f23_parse_wkt_point", "SELECT id, CASE WHEN id % 10 > 0 THEN lon END AS lon, CASE WHEN id % 10 > 0 THEN lat END AS lat FROM v_customers")
def f23(spark, d):
    text = F.when(F.col("id") % 10 > 0, F.concat(F.lit("POINT( "), "lon", F.lit("  "), "lat", F.lit(")"))).otherwise("LINE(1 2)")
    lon, lat = fn.wkt_point("wkt")
    return Grid(spark, d).customers.withColumn("wkt", text).select("id", lon.alias("lon"), lat.alias("lat"))


_CENTROIDS = ", ".join(f"({k}, {lon}e0, {lat}e0)" for k, (lon, lat) in fn.PC2_CENTROIDS.items())
_LONLAT = f"""SELECT id, round(coalesce(z.lon, 4.48e0) + ({_u32("pc4", 1)} / 4294967296e0 - 0.5e0) * 0.16e0
                 + ({_u32("concat_ws('|', pc, external_ref)", 1)} / 4294967296e0 - 0.5e0) * 0.012e0, 6) AS lon,
              round(coalesce(z.lat, 51.92e0) + ({_u32("pc4", 9)} / 4294967296e0 - 0.5e0) * 0.11e0
                 + ({_u32("concat_ws('|', pc, external_ref)", 9)} / 4294967296e0 - 0.5e0) * 0.009e0, 6) AS lat
       FROM (SELECT *, upper(replace(zipcode, ' ', '')) AS pc, coalesce(substr(zipcode, 1, 4), '{fn.DEFAULT_PC4}') AS pc4 FROM v_customers) c
       LEFT JOIN (VALUES {_CENTROIDS}) z(pc2, lon, lat) ON z.pc2 = CAST(pc4 AS BIGINT) // 100"""


@query("f24_postcode_lonlat", _LONLAT)
def f24(spark, d):
    people = Grid(spark, d).customers.select("id", "zipcode", "external_ref")
    return od.approximate_positions(people, "zipcode", "external_ref", "at").select("id", "at.lon", "at.lat")


@query("f25_hour_bucket", "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour FROM events")
def f25(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return Grid(spark, d).table("events").select("event_id", stamp(fn.hour_bucket(text)).alias("hour"))


@query(
    "f26_grid_status",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice / 5 > 12000 THEN 'high_demand'
              WHEN l_quantity * 10 + l_tax * 1000 < 500 THEN 'low_renewables' ELSE 'normal' END AS flag,
              round(l_quantity * 10 / greatest(l_quantity * 10 + l_tax * 1000, 1e0), 6) AS solar_share FROM lineitem""",
)
def f26(spark, d):
    solar, wind = F.col("l_quantity") * 10, F.col("l_tax") * 1000
    return Grid(spark, d).table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        fn.grid_status(F.col("l_extendedprice") / 5, solar, wind).alias("flag"),
        fn.mix_share(solar, solar, wind).alias("solar_share"),
    )


@query(
    "f27_consumption_drop_label",
    """SELECT segment_key, CASE WHEN r < 0.85e0 THEN 'consumption_drop' ELSE '' END AS incident, r < 0.85e0 AS is_ntl,
              greatest(0e0, sja_baseline - sja_latest) / 360e0 AS hourly_unexplained_kwh
       FROM (SELECT *, CASE WHEN sja_baseline > 0 THEN sja_latest / sja_baseline ELSE 1e0 END AS r FROM v_segments)""",
)
def f27(spark, d):
    labels = fn.consumption_drop("sja_baseline", "sja_latest", 360)
    return Grid(spark, d).segments.select("segment_key", *[c.alias(n) for n, c in labels.items()])


@query(
    "f29_tier_order",
    """SELECT tier_order, count(*) AS n FROM (SELECT CASE risk_tier WHEN 'LOW' THEN 0 WHEN 'WATCH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3
              WHEN 'CRITICAL' THEN 4 END AS tier_order FROM v_scores) GROUP BY 1""",
)
def f29(spark, d):
    return Grid(spark, d).scores.groupBy(fn.tier_order("risk_tier").alias("tier_order")).agg(F.count(F.lit(1)).alias("n"))


# ---- A12-A15, J13, J14, L9, L12, Y7, Y8 -----------------------------------------
_BASELINES = """SELECT upper(replace(zipcode_from, ' ', '')) AS zipcode, round(avg(annual_consume), 6) AS baseline_annual_kwh,
                       round(avg(smartmeter_perc), 6) AS street_smartmeter_perc, bool_or(delivery_perc < 95) AS has_solar_potential
                FROM v_streets WHERE zipcode_from IS NOT NULL AND annual_consume IS NOT NULL AND smartmeter_perc IS NOT NULL GROUP BY 1"""


@query("a12_street_baselines", _BASELINES)
def a12(spark, d):
    return od.street_baselines(Grid(spark, d).streets).select(
        "zipcode", F.round("baseline_annual_kwh", 6).alias("baseline_annual_kwh"),
        F.round("street_smartmeter_perc", 6).alias("street_smartmeter_perc"), "has_solar_potential",
    )


_WEIGHTS = """SELECT upper(replace(zipcode_from, ' ', '')) AS zipcode, CAST(sum(coalesce(num_connections, 1)) AS BIGINT) AS weight
              FROM v_streets WHERE lower(city) = 'amsterdam' GROUP BY 1"""


@query("a13_zip_weights", _WEIGHTS)
def a13(spark, d):
    return od.zip_weights(Grid(spark, d).streets)


@query("a14_segment_pivot", "SELECT * FROM v_segments")
def a14(spark, d):
    return Grid(spark, d).segments


@query(
    "a15_pc4_groups",
    """SELECT substr(postcode, 1, 4) AS pc4, count(*) AS segments, arg_min(postcode, postcode || street || city) AS sample_postcode,
              arg_min(street, coalesce(postcode, '') || street || city) AS sample_street FROM v_segments GROUP BY 1""",
)
def a15(spark, d):
    return od.pc4_groups(Grid(spark, d).segments).select("pc4", "segments", "sample_postcode", "sample_street")


@query(
    "j13_zip_enrich",
    f"""SELECT c.id, coalesce(b.baseline_annual_kwh, c.baseline_annual_kwh) AS baseline_annual_kwh,
               coalesce(b.street_smartmeter_perc, c.street_smartmeter_perc) AS street_smartmeter_perc,
               coalesce(b.has_solar_potential, c.solar_potential_flag) AS solar_potential_flag
        FROM v_customers c LEFT JOIN ({_BASELINES}) b ON b.zipcode = upper(replace(c.zipcode, ' ', ''))""",
)
def j13(spark, d):
    g = Grid(spark, d)
    return od.zip_enrich(g.customers, od.street_baselines(g.streets)).select(
        "id", F.round("baseline_annual_kwh", 6).alias("baseline_annual_kwh"),
        F.round("street_smartmeter_perc", 6).alias("street_smartmeter_perc"), "solar_potential_flag",
    )


@query(
    "j14_geocode_join",
    f"""WITH rows AS (SELECT *, upper(replace(zipcode, ' ', '')) AS pc FROM v_customers),
        p AS (SELECT pc, min(lon) AS lon, min(lat) AS lat FROM rows WHERE customer_type = 'HOUSEHOLD' GROUP BY 1),
        s AS (SELECT external_ref, city, lon, lat FROM rows WHERE customer_type = 'MACHINERY'),
        a AS (SELECT substr(pc, 1, 4) AS pc4, min(lon) AS lon, min(lat) AS lat FROM rows WHERE customer_type = 'FURNITURE' GROUP BY 1)
        SELECT r.id, round(coalesce(p.lon, s.lon, a.lon, h.lon), 6) AS lon, round(coalesce(p.lat, s.lat, a.lat, h.lat), 6) AS lat,
               CASE WHEN p.lon IS NOT NULL THEN 'postcode' WHEN s.lon IS NOT NULL THEN 'street' WHEN a.lon IS NOT NULL THEN 'pc4' ELSE 'hashed' END
                 AS geocode_source
        FROM rows r LEFT JOIN p ON p.pc = r.pc LEFT JOIN s ON s.external_ref = r.external_ref AND s.city = r.city
        LEFT JOIN a ON a.pc4 = substr(r.pc, 1, 4) LEFT JOIN ({_LONLAT}) h ON h.id = r.id""",
)
def j14(spark, d):
    people = Grid(spark, d).customers
    pc = fn.normalize_zip("zipcode")

    def known(kind, segment, key):
        rows = people.filter(F.col("customer_type") == segment).groupBy(key.alias("key"))
        return rows.agg(F.min("lon").alias("lon"), F.min("lat").alias("lat")).withColumn("kind", F.lit(kind))

    lookup = lookups.union_relaxed(
        [
            known("postcode", "HOUSEHOLD", pc),
            known("street", "MACHINERY", F.concat_ws(" ", "external_ref", "city")),
            known("pc4", "FURNITURE", F.substring(pc, 1, 4)),
        ]
    )
    rows = people.select("id", F.col("zipcode").alias("postcode"), F.col("external_ref").alias("street"), "city")
    return od.geocode(rows, lookup).select("id", "lon", "lat", "geocode_source")


@query("l9_top_segments", "SELECT segment_key, connections, sja_latest FROM v_segments ORDER BY connections DESC, segment_key LIMIT 200")
def l9(spark, d):
    return od.top_segments(Grid(spark, d).segments, 200).select("segment_key", "connections", "sja_latest")


@query(
    "l12_distinct_cities",
    """SELECT DISTINCT 'STEDIN-' || substr(replace(city, '_', '-'), 1, 16) AS code, city AS name, 'municipality' AS region_type, 'STEDIN-NL' AS parent_code
       FROM v_segments UNION ALL SELECT 'STEDIN-NL', 'Stedin Netbeheer', 'country', ''""",
)
def l12(spark, d):
    return od.distinct_cities(Grid(spark, d).segments)


_HOURS = 1440
_SPLIT = 1080
_NOISE = "((({k} + idx * {step}) % 2147483647) * (({k} + idx * {step}) % 2147483647) % 2147483647 / 2147483647e0)"
_PROFILE = f"""WITH raw AS (
        SELECT segment_key, idx, sja_baseline AS b, sja_latest AS l, ts,
               greatest(0e0, (CASE WHEN idx < {_SPLIT} THEN sja_baseline ELSE sja_latest END) / 8760
                 * (1e0 + 0.15e0 * sin(2e0 * pi() * (dayofyear(ts) / 365e0)))
                 * (CASE WHEN hour(ts) < 7 OR hour(ts) > 22 THEN 0.45e0 WHEN hour(ts) BETWEEN 17 AND 21 THEN 1.1e0 ELSE 0.85e0 END)
                 * (1e0 + 0.04e0 * ({_NOISE.format(k="k1", step=1103515245)} + {_NOISE.format(k="k2", step=742938285)} - 1e0)
                    * sqrt(6e0))) AS kwh
        FROM (SELECT s.*, i.idx, TIMESTAMP '2026-06-01' - ({_HOURS} - 1 - i.idx) * INTERVAL 1 HOUR AS ts
              FROM (SELECT *, CAST(floor({_u32("segment_key", 1)} / 4294967296e0 * 2147483647) AS BIGINT) AS k1,
                           CAST(floor({_u32("segment_key", 9)} / 4294967296e0 * 2147483647) AS BIGINT) AS k2 FROM v_segments) s
              CROSS JOIN (SELECT unnest(range({_HOURS})) AS idx) i))"""


@query(
    "y7_expand_annual_profile",
    _PROFILE
    + f""", scaled AS (SELECT segment_key, idx, hour(ts) AS hour,
              round(kwh * ((b * {_SPLIT} + l * {_HOURS - _SPLIT}) / 8760 / sum(kwh) OVER (PARTITION BY segment_key)), 6) AS kwh FROM raw)
       SELECT segment_key, hour, count(*) AS n, CAST(sum(CAST(round(kwh * 1e6) AS BIGINT)) AS BIGINT) AS micro_kwh, max(kwh) AS peak FROM scaled GROUP BY 1, 2""",
)
def y7(spark, d):
    rows = od.expand_annual_profile(Grid(spark, d).segments)
    return rows.groupBy("segment_key", F.hour("timestamp").cast("bigint").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("consumption_kwh") * 1e6).cast("bigint")).alias("micro_kwh"),
        F.max("consumption_kwh").alias("peak"),
    )


@query(
    "y8_weighted_zip_assign",
    f"""WITH w AS (SELECT *, sum(weight) OVER (ORDER BY weight DESC, zipcode NULLS FIRST) AS edge, sum(weight) OVER () AS total FROM ({_WEIGHTS}) WHERE weight > 0),
        pts AS (SELECT id, CAST(floor({_u32("'42|' || id", 1)} / 4294967296e0 * (SELECT CAST(max(total) AS DOUBLE) FROM w)) AS BIGINT) AS point
                FROM v_customers WHERE zipcode IS NULL)
        SELECT c.id, coalesce(c.zipcode, x.zipcode) AS zipcode FROM v_customers c LEFT JOIN (
          SELECT pts.id, w.zipcode FROM pts JOIN w ON point >= edge - weight AND point < edge) x ON x.id = c.id""",
)
def y8(spark, d):
    g = Grid(spark, d)
    return od.assign_zipcodes(g.customers, od.zip_weights(g.streets)).select("id", "zipcode")


# ---- Y1-Y6, L7, L8, S17 ---------------------------------------------------------
_SEQ = """seq AS (SELECT meter_id, consumption_kwh AS v, timestamp, row_number() OVER (PARTITION BY meter_id ORDER BY timestamp) - 1 AS pos
                  FROM (SELECT * FROM v_readings QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY timestamp DESC) <= 512)),
          norm AS (SELECT *, (v - avg(v) OVER (PARTITION BY meter_id)) / (stddev_pop(v) OVER (PARTITION BY meter_id) + 1e-8) AS x FROM seq),
          rec AS (SELECT *, avg(x) OVER (PARTITION BY meter_id, hour(timestamp)) AS r FROM norm),
          mse AS (SELECT meter_id, sum((x - r) * (x - r)) / greatest(count(*), 1) AS reconstruction_mse FROM rec GROUP BY 1),
          sc AS (SELECT meter_id, reconstruction_mse, least(1e0, greatest(0e0, 1e0 - exp(-((reconstruction_mse - (SELECT avg(reconstruction_mse) FROM mse))
                   / ((SELECT stddev_pop(reconstruction_mse) FROM mse) + 1e-8)) / 2e0))) AS anomaly_score FROM mse),
          ranked AS (SELECT *, (x - r) * (x - r) AS err, row_number() OVER (PARTITION BY meter_id ORDER BY round((x - r) * (x - r), 10) DESC, pos) AS rk FROM rec)"""


@query(
    "y1_pad_sequence",
    f"""WITH {_SEQ} SELECT m.meter_id, p.pos, coalesce(s.v, 0e0) AS value, CASE WHEN s.v IS NULL THEN 0e0 ELSE 1e0 END AS mask
        FROM (SELECT DISTINCT meter_id FROM seq) m CROSS JOIN (SELECT unnest(range(512)) AS pos) p LEFT JOIN seq s ON s.meter_id = m.meter_id AND s.pos = p.pos""",
)
def y1(spark, d):
    seq = sq.prepared_sequences(Grid(spark, d).readings)
    pairs = F.posexplode(F.arrays_zip(F.col("padded").alias("value"), F.col("mask").alias("mask"))).alias("pos", "p")
    return seq.select("meter_id", pairs).select("meter_id", long("pos"), "p.value", "p.mask")


@query("y2_instance_normalize", f"WITH {_SEQ} SELECT meter_id, pos, round(x, 6) AS x FROM norm")
def y2(spark, d):
    seq = sq.prepared_sequences(Grid(spark, d).readings)
    return seq.select("meter_id", "actual_len", F.posexplode("x").alias("pos", "x")).filter("pos < actual_len").select(
        "meter_id", long("pos"), F.round("x", 6).alias("x")
    )


@query("y3_masked_mse", f"WITH {_SEQ} SELECT meter_id, round(reconstruction_mse, 6) AS reconstruction_mse FROM mse")
def y3(spark, d):
    errors = sq.reconstruction_errors(sq.prepared_sequences(Grid(spark, d).readings))
    return errors.select("meter_id", F.round("reconstruction_mse", 6).alias("reconstruction_mse"))


@query("y4_mse_to_anomaly", f"WITH {_SEQ} SELECT meter_id, round(anomaly_score, 6) AS anomaly_score FROM sc")
def y4(spark, d):
    return sq.sequence_anomalies(Grid(spark, d).readings).select("meter_id", F.round("anomaly_score", 6).alias("anomaly_score"))


@query(
    "l8_peak_errors",
    f"WITH {_SEQ} SELECT meter_id, rk, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, round(err, 5) AS error FROM ranked WHERE rk <= 3",
)
def l8(spark, d):
    errors = sq.reconstruction_errors(sq.prepared_sequences(Grid(spark, d).readings))
    return errors.select("meter_id", F.posexplode("peaks").alias("i", "p")).select(
        "meter_id", (F.col("i") + 1).cast("bigint").alias("rk"), F.col("p.timestamp").alias("timestamp"), F.round("p.error", 5).alias("error")
    )


@query(
    "y5_peak_explanations",
    f"""WITH {_SEQ} SELECT meter_id, rk, round(err / top, 4) AS contribution, CASE WHEN round(err / top, 4) >= 0.5 THEN 'increases' ELSE 'neutral' END AS direction
        FROM (SELECT *, max(err) OVER (PARTITION BY meter_id) AS top FROM ranked) WHERE rk <= 3""",
)
def y5(spark, d):
    errors = sq.reconstruction_errors(sq.prepared_sequences(Grid(spark, d).readings))
    return errors.select("meter_id", F.posexplode(fn.peak_explanations("peaks")).alias("i", "e")).select(
        "meter_id", (F.col("i") + 1).cast("bigint").alias("rk"), "e.contribution", "e.direction"
    )


@query("y6_reconstruct", f"WITH {_SEQ} SELECT meter_id, pos, round(r, 6) AS recon FROM rec")
def y6(spark, d):
    seq = sq.reconstruct(sq.prepared_sequences(Grid(spark, d).readings))
    return seq.select("meter_id", "actual_len", F.posexplode("recon").alias("pos", "r")).filter("pos < actual_len").select(
        "meter_id", long("pos"), F.round("r", 6).alias("recon")
    )


@query("l7_top_anomalies", f"WITH {_SEQ} SELECT meter_id AS customer_id, round(anomaly_score, 6) AS anomaly_score FROM sc ORDER BY sc.anomaly_score DESC, meter_id LIMIT 10")
def l7(spark, d):
    results = sq.anomaly_results(sq.sequence_anomalies(Grid(spark, d).readings))
    return sq.top_anomalies(results).select("customer_id", F.round("anomaly_score", 6).alias("anomaly_score"))


@query("s17_anomaly_results_json", f"WITH {_SEQ} SELECT meter_id AS customer_id, round(anomaly_score, 6) AS anomaly_score, 3 AS peaks FROM sc")
def s17(spark, d):
    path = work_path(spark, "anomalies")
    files.write_anomaly_results(sq.anomaly_results(sq.sequence_anomalies(Grid(spark, d).readings)), path)
    return files.read_anomaly_results(spark, path).select(
        "customer_id", F.round("anomaly_score", 6).alias("anomaly_score"), F.size("peak_errors").alias("peaks")
    )
