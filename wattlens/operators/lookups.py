"""Key resolution and entity joins."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlens.functions import blank_to_null, grid_status, mix_share, planar_deg_distance


# ---- surrogate keys -------------------------------------------------------------
def _unique(dim: DataFrame, dim_key: str, id_column: str, out: str, within: Sequence[str]) -> DataFrame:
    """(_key, *within, out) with one row per key; a key that occurs twice is an error when it is read."""
    ids = dim.filter(F.col(dim_key).isNotNull()).groupBy(F.col(dim_key).alias("_key"), *within)
    folded = ids.agg(F.min(id_column).alias(out), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.concat(F.lit(f"{dim_key} is not unique: "), F.col("_key").cast("string")))
    return folded.select("_key", *within, F.when(F.col("_n") == 1, F.col(out)).otherwise(twice).alias(out))


def _looked_up(facts: DataFrame, keys: DataFrame, key: Column, within: Sequence[str]) -> DataFrame:
    named = keys.select("_key", *[F.col(w).alias(f"_{w}") for w in within], *[c for c in keys.columns if c not in ("_key", *within)])
    match = key == F.col("_key")
    for w in within:
        match = match & (facts[w] == F.col(f"_{w}"))
    return facts.join(named, match, "left").drop("_key", *[f"_{w}" for w in within])


def resolve_fk(
    facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, id_column: str = "id", out: str = "fk_id", within: Sequence[str] = ()
):
    """(resolved rows with ``out``, skipped rows). Spark picks broadcast or merge by size.

    The key has to be unique among rows that agree in the ``within`` columns (the
    operator, say), which both sides have.
    """
    looked_up = _looked_up(facts, _unique(dim, dim_key, id_column, out, within), F.trim(F.col(fact_key)), within)
    return looked_up.filter(F.col(out).isNotNull()), looked_up.filter(F.col(out).isNull()).drop(out)


def resolve_optional_fk(
    facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, id_column: str = "id", out: str = "fk_id", within: Sequence[str] = ()
) -> DataFrame:
    """Left lookup: blank or unknown keys give null. Uniqueness as in ``resolve_fk``."""
    return _looked_up(facts, _unique(dim, dim_key, id_column, out, within), blank_to_null(fact_key), within)


def link_parents(nodes: DataFrame, key: str, parent_key: str, out: str = "parent_id", within: Sequence[str] = ()) -> DataFrame:
    """Self-join to the parent's id; the order of rows does not matter. Uniqueness as in ``resolve_fk``."""
    return _looked_up(nodes, _unique(nodes, key, "id", out, within), blank_to_null(parent_key), within)


# ---- risk -----------------------------------------------------------------------
def current_scores(scores: DataFrame, entity_type: str) -> DataFrame:
    """The newest current score of each entity."""
    rows = scores.filter(F.col("is_current") & (F.col("entity_type") == entity_type)).drop("entity_type", "is_current")
    others = [c for c in rows.columns if c != "entity_id"]
    newest = F.max_by(F.struct(*others), F.col("scored_at"))
    return rows.groupBy("entity_id").agg(newest.alias("_s")).select("entity_id", "_s.*")


def current_risk_join(entities: DataFrame, scores: DataFrame, entity_type: str = "customer") -> DataFrame:
    rows = scores.filter(F.col("is_current") & (F.col("entity_type") == entity_type))
    return entities.join(rows.drop("entity_type", "is_current"), entities["id"] == rows["entity_id"]).drop("entity_id")


def with_risk(entities: DataFrame, scores: DataFrame, entity_type: str = "customer") -> DataFrame:
    """Left join: the type and currency conditions belong to the join, not to a later filter."""
    rows = scores.filter(F.col("is_current") & (F.col("entity_type") == entity_type))
    return entities.join(rows.drop("entity_type", "is_current"), entities["id"] == rows["entity_id"], "left").drop("entity_id")


def inspection_queue_join(customers: DataFrame, scores: DataFrame, regions: DataFrame) -> DataFrame:
    names = regions.select(F.col("id").alias("region_id"), F.col("name").alias("region_name"))
    return current_risk_join(customers, scores).join(names, "region_id", "left")


def transformers_in_region(transformers: DataFrame, customers: DataFrame, region_id=None) -> DataFrame:
    """Transformers that serve the region; no region means all, an empty region means none."""
    if region_id is None:
        return transformers
    served = customers.filter((F.col("region_id") == region_id) & F.col("transformer_id").isNotNull())
    return transformers.join(served, transformers["id"] == served["transformer_id"], "left_semi")


def transformer_peers(customers: DataFrame, customer_id) -> DataFrame:
    """The other customers of one customer's transformer."""
    own = customers.filter(F.col("id") == customer_id).select(F.max("transformer_id")).scalar()
    return customers.filter((F.col("transformer_id") == own) & (F.col("id") != customer_id))


# ---- zones ----------------------------------------------------------------------
class Zone(NamedTuple):
    lon: float
    lat: float
    label: str
    radius_deg: float = 0.01


def nearest_zone(zones: Sequence[Zone], lon="lon", lat="lat") -> tuple[Column, Column]:
    """(label of the nearest zone, whether the point lies within its radius).

    Zones are a short configured list, so they become part of the expression: a
    map-side minimum without any join. The first listed zone wins ties.
    """
    if not zones:
        return F.lit(None).cast("string"), F.lit(False)
    nearest = F.array_min(
        F.array(
            *[
                F.struct(
                    planar_deg_distance(lon, lat, z.lon, z.lat).alias("distance"),
                    F.lit(i).alias("rank"),
                    F.lit(float(z.radius_deg)).alias("radius"),
                    F.lit(z.label).alias("label"),
                )
                for i, z in enumerate(zones)
            ]
        )
    )
    return nearest["label"], F.coalesce(nearest["distance"] <= nearest["radius"], F.lit(False))


# ---- macro mix ------------------------------------------------------------------
def macro_mix(load: DataFrame, solar: DataFrame, wind: DataFrame) -> DataFrame:
    """Hourly load with solar and wind shares; inputs are (timestamp, kwh) per hour."""

    def side(df: DataFrame, out: str) -> DataFrame:
        return df.select("timestamp", (F.col("kwh") / 1000.0).alias(out))

    joined = (
        side(load, "l").join(side(solar, "s"), "timestamp", "left").join(side(wind, "w"), "timestamp", "left").na.fill(0.0, ["s", "w"])
    )
    return joined.select(
        "timestamp",
        F.round("l", 4).alias("national_load_mw"),
        mix_share("s", "s", "w").alias("production_mix_solar"),
        mix_share("w", "s", "w").alias("production_mix_wind"),
        grid_status("l", "s", "w").alias("grid_status_flag"),
    )


# ---- sets -----------------------------------------------------------------------
def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing in a frame become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dedupe_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``, as a combining aggregate."""
    others = [c for c in df.columns if c not in keys]
    ranked = F.min(F.struct(*order, *[c for c in others if c not in order])).alias("_first")
    return df.groupBy(*keys).agg(ranked).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others])


def split_checks(train: DataFrame, test: DataFrame, key: str, train_as_of: int, test_as_of: int) -> DataFrame:
    """One row: number of shared keys, and whether the split is free of leakage."""
    shared = train.select(key).intersect(test.select(key))
    return shared.agg(F.count(F.lit(1)).alias("overlap")).select(
        "overlap", ((F.col("overlap") == 0) & F.lit(train_as_of < test_as_of)).alias("disjoint")
    )


def assert_disjoint(train: DataFrame, test: DataFrame, key: str, train_as_of: int, test_as_of: int) -> None:
    if train_as_of >= test_as_of:
        raise ValueError("the training cut-off has to lie before the test cut-off")
    if not train.join(test, key, "left_semi").isEmpty():
        raise ValueError("train and test share customers")


# ---- models ---------------------------------------------------------------------
def list_models(models: DataFrame) -> DataFrame:
    """Newest first, with k merged into the metrics."""
    metrics = F.map_concat("metrics", F.create_map(F.lit("k"), F.col("k").cast("double")))
    return models.withColumn("metrics", metrics).orderBy(F.desc("trained_at"), "model_version")


def active_model(models: DataFrame) -> DataFrame:
    return models.filter("is_active").orderBy(F.desc("trained_at"), "model_version").limit(1)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    others = [c for c in snapshots.columns if c not in ("entity_type", "entity_id")]
    newest = F.max_by(F.struct(*others), F.col("as_of")).alias("_s")
    return snapshots.groupBy("entity_type", "entity_id").agg(newest).select("entity_type", "entity_id", "_s.*")
