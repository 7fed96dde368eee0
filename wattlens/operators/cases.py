"""Inspection cases, missions and routes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlens.operators.balance import verify_balance
from wattlens.operators.ranking import positions


def fold_case_events(events: DataFrame, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Current state of each case: per field the newest non-null value.

    An outcome resolves the case at its own time, so it counts as a status event.
    One combining aggregate; no per-case sort.
    """
    status = F.when(F.col("outcome").isNotNull(), F.lit("resolved")).otherwise(F.col("status"))
    rows = events.withColumn("status", status)
    newest = [
        F.max(F.when(F.col(f).isNotNull(), F.struct(*order, F.col(f).alias("_v")))).alias(f) for f in fields
    ]
    folded = rows.groupBy("case_id").agg(*newest)
    return folded.select("case_id", *[F.col(f)["_v"].alias(f) for f in fields])


def mission_rollup(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """Cases, first creation and summed loss value per mission."""
    value = scores.filter("is_current AND entity_type = 'customer'").select(
        F.col("entity_id").alias("customer_id"), "estimated_loss_value"
    )
    return (
        cases.join(value, "customer_id", "left")
        .groupBy("mission_id")
        .agg(
            F.count(F.lit(1)).alias("case_count"),
            F.coalesce(F.sum("estimated_loss_value"), F.lit(0.0)).alias("estimated_total_value"),
            F.min("created_at").alias("created_at"),
        )
    )


def list_missions(cases: DataFrame, scores: DataFrame) -> DataFrame:
    return mission_rollup(cases, scores).orderBy(F.desc("created_at"), "mission_id")


def case_rank(cases: DataFrame) -> DataFrame:
    """1-based order of creation within the mission, for missions of any size."""
    ranked = positions(cases, [F.col("created_at").asc(), F.col("case_id").asc()], ["mission_id"], "_pos")
    return ranked.withColumn("priority_rank", F.col("_pos") + 1).drop("_pos")


EARTH_RADIUS_KM = 6371.0


def _distances(lon: float, lat: float, lons: np.ndarray, lats: np.ndarray) -> np.ndarray:
    dlon, dlat = np.radians(lons - lon), np.radians(lats - lat)
    h = np.sin(dlat / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * np.sin(dlon / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(h))


def _walk(places: pd.DataFrame) -> pd.DataFrame:
    """Nearest-neighbour order of one mission's places, starting from the first listed."""
    p = places.sort_values("first_stop", ignore_index=True)
    lons, lats = p["lon"].to_numpy(), p["lat"].to_numpy()
    left = np.ones(len(p), dtype=bool)
    order, legs, here = [0], [0.0], 0
    left[0] = False
    while left.any():
        candidates = np.flatnonzero(left)
        d = _distances(lons[here], lats[here], lons[candidates], lats[candidates])
        best = int(np.round(d, 9).argmin())  # equal up to rounding noise: the first listed
        here = int(candidates[best])
        order.append(here)
        legs.append(float(d[best]))
        left[here] = False
    out = p.iloc[order][["mission_id", "lon", "lat", "stops"]].reset_index(drop=True)
    out["visit"] = np.arange(len(out), dtype="int64")
    out["leg_km"] = legs
    return out


def mission_routes(stops: DataFrame) -> DataFrame:
    """Greedy route per mission: one row per place in visiting order.

    Stops at the same place are always visited together (their distance is 0), so
    they are folded before the walk: what reaches the grouped step grows with the
    places in a mission's area, not with its stops. The walk itself is sequential
    by nature; missions run in parallel. A tie goes to the place listed first. ``stops``: mission_id, stop_no, lon, lat;
    stops without coordinates are left out.
    """
    places = (
        stops.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .groupBy("mission_id", "lon", "lat")
        .agg(F.min("stop_no").alias("first_stop"), F.count(F.lit(1)).alias("stops"))
    )
    kind = places.schema["mission_id"].dataType.simpleString()
    return places.groupBy("mission_id").applyInPandas(
        _walk, f"mission_id {kind}, lon double, lat double, stops bigint, visit bigint, leg_km double"
    )


def route_summaries(missions: DataFrame, routes: DataFrame) -> DataFrame:
    """Total length and line per mission; a mission without places gets 0 km and an empty line."""
    line = F.array_sort(F.collect_list(F.struct("visit", F.array("lon", "lat").alias("point"))))
    totals = routes.groupBy("mission_id").agg(F.round(F.sum("leg_km"), 3).alias("km"), line.alias("line"))
    return missions.select("mission_id").distinct().join(totals, "mission_id", "left").select(
        "mission_id",
        F.coalesce("km", F.lit(0.0)).alias("total_distance_km"),
        F.coalesce(F.transform("line", lambda v: v["point"]), F.array().cast("array<array<double>>")).alias("coordinates"),
    )


def verify_invariants(scores: DataFrame, customers: DataFrame, transformer_snapshots: DataFrame) -> DataFrame:
    """One row of checks over labelled bypass customers and transformer balances."""
    bypass = customers.filter(F.col("incident") == "partial_bypass").select(F.col("id").alias("entity_id"))
    risk = scores.filter("is_current AND entity_type = 'customer'")
    flagged = risk.join(bypass, "entity_id", "left_semi")
    critical = flagged.select(
        F.coalesce(F.bool_and(F.col("risk_tier") == "CRITICAL"), F.lit(False))
    ).scalar()
    return verify_balance(transformer_snapshots).agg(
        F.bool_and("reconciles").alias("all_reconcile"),
        F.count_if("ratio_in_band").alias("in_band"),
        F.count(F.lit(1)).alias("transformers"),
    ).withColumn("bypass_critical", critical)
