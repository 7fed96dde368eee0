"""CSV master data and readings to typed tables, with rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlens.functions import blank_to_null, customer_metadata, default_fill, optional_number, parse_utc_ts
from wattlens.operators.filters import require_keys
from wattlens.operators.lookups import link_parents, resolve_optional_fk
from wattlens.sources.tables import upsert, upsert_counts

OWNER = ("operator_id",)
READING_KEYS = ("meter_id", "timestamp")
READING_UPDATES = ("consumption_kwh", "voltage", "power_factor", "reading_quality", "source")


def _natural_id(*parts: str) -> Column:
    """Reproducible surrogate key: a hash of the natural key."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the last one in file order (``_row``, else as the table has them)."""
    numbered = rows if "_row" in rows.columns else rows.withColumn("_row", F.monotonically_increasing_id())
    others = [c for c in rows.columns if c not in keys]
    return numbered.groupBy(*keys).agg(F.max_by(F.struct(*others), "_row").alias("_r")).select(*keys, "_r.*")


def operators(raw: DataFrame) -> DataFrame:
    return _last(require_keys(raw, ["name"]), ["name"]).select(
        _natural_id("name").alias("id"),
        "name",
        F.trim("country_code").alias("country_code"),
        default_fill("timezone", "Europe/Amsterdam").alias("timezone"),
        default_fill("default_currency", "EUR").alias("default_currency"),
    )


def _owned(raw: DataFrame, key: str, ops: DataFrame) -> DataFrame:
    """Rows with a key and a known operator, with their id; of a repeated (operator, key) the last row."""
    owners = ops.select(F.col("name").alias("operator_name"), F.col("id").alias("operator_id"))
    kept = _last(require_keys(raw, [key, "operator_name"]), ["operator_name", key]).join(owners, "operator_name")
    return kept.withColumn("id", _natural_id("operator_id", key))


def regions(raw: DataFrame, ops: DataFrame) -> DataFrame:
    owned = _owned(raw, "code", ops)
    return link_parents(owned, "code", "parent_code", "parent_region_id", OWNER).select(
        "id", "operator_id", "parent_region_id", F.trim("region_type").alias("region_type"), "code", F.trim("name").alias("name")
    )


def _located(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"lon": optional_number("lon"), "lat": optional_number("lat")})


def grid_assets(raw: DataFrame, ops: DataFrame) -> DataFrame:
    owned = _owned(raw, "external_id", ops)
    rows = _located(link_parents(owned, "external_id", "parent_external_id", "parent_asset_id", OWNER))
    return rows.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        "id", "operator_id", "parent_asset_id", F.trim("asset_type").alias("asset_type"), "external_id", F.trim("name").alias("name"),
        blank_to_null("voltage_level").alias("voltage_level"), optional_number("capacity_kva").alias("capacity_kva"), "lon", "lat",
    )


def customers(raw: DataFrame, ops: DataFrame, assets: DataFrame, areas: DataFrame) -> DataFrame:
    rows = _located(_owned(raw, "external_ref", ops))
    rows = resolve_optional_fk(rows, assets, "transformer_external_id", "external_id", out="transformer_id", within=OWNER)
    rows = resolve_optional_fk(rows, assets, "feeder_external_id", "external_id", out="feeder_id", within=OWNER)
    rows = resolve_optional_fk(rows, areas, "region_code", "code", out="region_id", within=OWNER)
    return rows.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        "id", "operator_id", "external_ref", "transformer_id", "feeder_id", "region_id",
        F.trim("customer_type").alias("customer_type"),
        default_fill("tariff_type", "single").alias("tariff_type"),
        blank_to_null("building_type").alias("building_type"),
        blank_to_null("zipcode").alias("zipcode"),
        optional_number("baseline_annual_kwh").alias("baseline_annual_kwh"),
        F.lit(False).alias("solar_potential_flag"),
        "lon", "lat",
        customer_metadata("incident", "is_ntl").alias("metadata_json"),
    )


def _timed(
    raw: DataFrame, owner: DataFrame, ops: DataFrame | None, key: str, owner_key: str, out: str, amount: str
) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects with a reason).

    A file may name the operator of a key. Where it does not, the key has to belong
    to one operator only.
    """
    known = owner.groupBy(F.col(owner_key).alias("_key"), "operator_id").agg(F.min("id").alias("_id"))
    lone = known.groupBy(F.col("_key").alias("_lone")).agg(F.min("_id").alias("_only"), F.count(F.lit(1)).alias("_owners"))
    rows = raw.withColumn(key, blank_to_null(key))
    if ops is not None and "operator_name" in raw.columns:
        names = ops.select(F.col("name").alias("_name"), F.col("id").alias("_operator"))
        rows = rows.join(names, blank_to_null("operator_name") == F.col("_name"), "left").drop("_name")
    else:
        rows = rows.withColumn("_operator", F.lit(None).cast("string"))
    rows = (
        rows.join(known, (F.col(key) == F.col("_key")) & (F.col("_operator") == F.col("operator_id")), "left")
        .join(lone, F.col(key) == F.col("_lone"), "left")
        .withColumn(out, F.when(F.col("_operator").isNotNull(), F.col("_id")).when(F.col("_owners") == 1, F.col("_only")))
        .withColumns({"_ts": parse_utc_ts("timestamp"), "_amount": optional_number(amount)})
    )
    reason = (
        F.when(F.col("_operator").isNull() & (F.col("_owners") > 1), "ambiguous_key")
        .when(F.col(out).isNull(), "unknown_key")
        .when(F.col("_ts").isNull(), "bad_timestamp")
        .when(F.col("_amount").isNull(), "bad_number")
    )
    judged = rows.withColumn("reason", reason).drop("_key", "_lone", "_id", "_only", "_owners", "_operator", "operator_id")
    good = judged.filter("reason IS NULL").withColumn("timestamp", F.col("_ts")).withColumn(amount, F.col("_amount"))
    return good.drop("_ts", "_amount", "reason"), judged.filter("reason IS NOT NULL").drop("_ts", "_amount")


def meter_readings(raw: DataFrame, people: DataFrame, ops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    good, bad = _timed(raw, people, ops, "customer_external_ref", "external_ref", "meter_id", "consumption_kwh")
    return good.select(
        "meter_id", "timestamp", "consumption_kwh", *[c for c in ("_row",) if c in good.columns],
        optional_number("voltage").alias("voltage"),
        optional_number("power_factor").alias("power_factor"),
        default_fill("reading_quality", "good").alias("reading_quality"),
        default_fill("source", "ami").alias("source"),
    ), bad


def asset_energy(raw: DataFrame, assets: DataFrame, ops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    good, bad = _timed(raw, assets, ops, "asset_external_id", "external_id", "asset_id", "energy_input_kwh")
    return good.select(
        "asset_id", "timestamp", "energy_input_kwh",
        optional_number("energy_output_kwh").alias("energy_output_kwh"),
        default_fill("reading_quality", "good").alias("reading_quality"),
        default_fill("source", "scada").alias("source"),
    ), bad


def technical_loss(raw: DataFrame, assets: DataFrame, ops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    good, bad = _timed(raw, assets, ops, "asset_external_id", "external_id", "asset_id", "estimated_technical_loss_kwh")
    return good.select(
        "asset_id", "timestamp", "estimated_technical_loss_kwh",
        default_fill("method", "loss_factor").alias("method"),
        F.coalesce(optional_number("confidence"), F.lit(0.8)).alias("confidence"),
        default_fill("model_version", "tech-loss-v1").alias("model_version"),
    ), bad


def merge_readings(stored: DataFrame, raw: DataFrame, people: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(readings after the merge, counts of inserted and updated keys, rejects).

    Of repeated (meter, hour) rows the last in file order wins, over stored ones too;
    running a file again changes nothing.
    """
    numbered = raw if "_row" in raw.columns else raw.withColumn("_row", F.monotonically_increasing_id())
    good, rejects = meter_readings(numbered, people, ops)
    return upsert(stored, good, READING_KEYS, READING_UPDATES, "_row"), upsert_counts(stored, good, READING_KEYS), rejects.drop("_row")
