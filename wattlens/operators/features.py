"""Per-meter and per-transformer features.

The series of a meter is zero-filled over every observed hour. That grid is never
built: sums over it equal sums over the rows present, and the number of hours comes
from the hour index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlens import schema as S
from wattlens.functions import baseline_deviation, safe_div, unexplained_loss, unexplained_loss_ratio
from wattlens.operators.balance import asset_totals, metered_totals
from wattlens.operators.ranking import group_median
from wattlens.session import materialize


SLOTS = 24  # positions of the hour index in a block


def time_index(readings: DataFrame) -> DataFrame:
    """Distinct observed hours with their 0-based index.

    Times are cut to the hour, so there is one row per hour of history (8 784 a year) and the
    ordered list is small whatever the number of meters and however fine their readings.
    """
    hours = readings.select(F.date_trunc("hour", "timestamp").alias("timestamp")).distinct().agg(F.array_sort(F.collect_list("timestamp")).alias("h"))
    return hours.select(F.posexplode("h").alias("idx", "timestamp")).select(
        "timestamp", "idx", F.hour("timestamp").alias("hour")
    )


def window_split(index: DataFrame, as_of: int | None = None) -> DataFrame:
    """Label each hour 'baseline', 'gap' or 'recent' as seen from ``as_of`` (default: the last hour)."""
    end = F.lit(as_of + 1) if as_of is not None else index.select(F.count(F.lit(1)).cast("int")).scalar()
    base_end = F.least(F.lit(S.BASELINE_HOURS), F.greatest(F.lit(0), F.col("end") - S.RECENT_HOURS))
    recent_start = F.greatest(F.col("base_end"), F.col("end") - S.RECENT_HOURS)
    part = (
        F.when(F.col("idx") < F.col("base_end"), "baseline")
        .when(F.col("idx") >= F.col("recent_start"), "recent")
        .otherwise("gap")
    )
    return (
        index.withColumn("end", end)
        .filter(F.col("idx") < F.col("end"))
        .withColumn("base_end", base_end)
        .withColumn("recent_start", recent_start)
        .withColumn("part", part)
        .withColumn("night", F.col("hour") <= S.LAST_NIGHT_HOUR)
    )


def densify(readings: DataFrame, meters: DataFrame, index: DataFrame) -> DataFrame:
    """The zero-filled grid itself, for export and as the tested definition.

    A meter's readings are brought to its one row, with their positions in the hour list; the grid
    is written out from there and is neither shuffled nor sorted. A row holds the readings of one meter.
    """
    # a meter is a few bytes that become many rows: meters are spread by count, not by size
    tasks = int(meters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = index.agg(F.array_sort(F.collect_list(F.struct("timestamp", "idx"))).alias("h"))
    listed = listed.select(F.struct("h", F.transform("h", lambda _, i: i).alias("at")).alias("hours"))
    slots = listed.select(F.posexplode("hours.h").alias("at", "slot")).select("at", F.col("slot.timestamp").alias("timestamp"))
    read = readings.select("meter_id", "timestamp", F.col("consumption_kwh").cast("double").alias("v"))
    series = read.join(F.broadcast(slots), "timestamp").groupBy("meter_id").agg(F.collect_list(F.struct("at", "v")).alias("seen"))
    hours = listed.scalar()
    grid = meters.select(F.col("id").alias("meter_id")).repartition(tasks, "meter_id").join(series, "meter_id", "left")
    kind = "array<struct<at:int,v:double>>"
    grid = grid.withColumn("seen", F.coalesce("seen", F.array().cast(kind)))
    unseen = F.arrays_zip(F.array_except(hours["at"], F.col("seen.at")), F.array().cast("array<double>")).cast(kind)
    grid = grid.select("meter_id", F.explode(F.concat("seen", unseen)).alias("x"))
    slot = F.get(hours["h"], F.col("x.at"))
    return grid.select(
        "meter_id", slot["timestamp"].alias("timestamp"), slot["idx"].alias("idx"), F.coalesce("x.v", F.lit(0.0)).alias("consumption_kwh")
    )


def _window_facts(split: DataFrame) -> Column:
    """Hour counts of the windows as one small struct (a scalar subquery)."""
    part, night = F.col("part"), F.col("night")
    return split.select(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.count_if(part == "baseline").alias("baseline"),
            F.count_if(part == "recent").alias("recent"),
            F.count_if((part == "recent") & night).alias("night"),
            F.count_if((part == "recent") & ~night).alias("day"),
        )
    ).scalar()


def _mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def _std(total: Column, squares: Column, n: Column) -> Column:
    spread = F.greatest(n * squares - total * total, F.lit(0.0))
    return F.when(n > 0, F.sqrt(spread) / n).otherwise(F.lit(0.0))


def base_features(readings: DataFrame, meters: DataFrame, as_of: int | None = None) -> DataFrame:
    """Consumption statistics per meter over the zero-filled series up to ``as_of``.

    Rows are first folded per block of 24 index positions, then per meter; both
    folds combine on the map side, so a meter with very many rows is spread out.
    """
    # The hour index needs a pass over the time column; it is tiny, so it is written once.
    # Its true size is then known and Spark broadcasts it instead of shuffling readings.
    split = window_split(materialize(time_index(readings), "hours"), as_of)
    return _statistics(_reading_blocks(readings, split), split, meters)


def moment_features(moments: DataFrame, index: DataFrame, meters: DataFrame, as_of: int | None = None) -> DataFrame:
    """The same from stored moments (``operators/moments.py``): one row per meter and block is read.

    ``meters`` may hold some of the meters only, such as those that a late delta changed. A new hour
    moves the windows of all meters, so after one all of them are due.
    """
    split = window_split(index, as_of)
    return _statistics(_moment_blocks(moments, split), split, meters)


def _reading_blocks(readings: DataFrame, split: DataFrame) -> DataFrame:
    x, part = F.col("consumption_kwh"), F.col("part")
    recent, baseline, night = part == "recent", part == "baseline", F.col("night")

    def both(name: str, cond: Column | None = None) -> list[Column]:
        v = x if cond is None else F.when(cond, x).otherwise(0.0)
        return [F.sum(v).alias(f"s_{name}"), F.sum(v * v).alias(f"q_{name}")]

    return (
        readings.withColumn("timestamp", F.date_trunc("hour", "timestamp"))
        .join(split.select("timestamp", "idx", "part", "night"), "timestamp")
        .groupBy("meter_id", F.floor(F.col("idx") / SLOTS).alias("block"))
        .agg(
            *both("all"),
            *both("baseline", baseline),
            *both("recent", recent),
            F.sum(F.when(recent & night, x).otherwise(0.0)).alias("s_night"),
            F.sum(F.when(recent & ~night, x).otherwise(0.0)).alias("s_day"),
            F.collect_list(F.when(recent, x)).alias("seen"),
        )
    )


def _moment_blocks(moments: DataFrame, split: DataFrame) -> DataFrame:
    """The same columns from stored slots, row by row; the hour facts of a block are one small row."""
    facts = split.groupBy(F.floor(F.col("idx") / SLOTS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "part", "night"))).alias("facts")
    )
    placed = F.zip_with(
        "slots", "facts", lambda v, f: F.struct(v.alias("v"), f["idx"].alias("idx"), f["part"].alias("part"), f["night"].alias("night"))
    )
    rows = moments.join(facts, "block").withColumn("z", F.filter(placed, lambda z: z["v"].isNotNull() & z["idx"].isNotNull()))

    def some(cond) -> Column:
        return F.transform("z" if cond is None else F.filter("z", cond), lambda z: z["v"])

    def total(cond=None) -> Column:
        return F.aggregate(some(cond), F.lit(0.0), lambda s, v: s + v)

    def squares(cond=None) -> Column:
        return F.aggregate(some(cond), F.lit(0.0), lambda s, v: s + v * v)

    def recent(z):
        return z["part"] == "recent"

    def baseline(z):
        return z["part"] == "baseline"

    return rows.select(
        "meter_id",
        "block",
        total().alias("s_all"),
        squares().alias("q_all"),
        total(baseline).alias("s_baseline"),
        squares(baseline).alias("q_baseline"),
        total(recent).alias("s_recent"),
        squares(recent).alias("q_recent"),
        total(lambda z: recent(z) & z["night"]).alias("s_night"),
        total(lambda z: recent(z) & ~z["night"]).alias("s_day"),
        some(recent).alias("seen"),
    )


def _statistics(blocks: DataFrame, split: DataFrame, meters: DataFrame) -> DataFrame:
    """Features per meter from its block sums."""
    facts = F.col("w")
    n_blocks = F.greatest(F.floor(F.col("w.n") / 24), F.lit(1))
    full = F.floor(F.col("w.n") / 24)
    base_days = F.least(F.lit(S.BASELINE_HOURS // 24), n_blocks)
    recent_days = F.least(F.lit(S.RECENT_HOURS // 24), n_blocks)
    whole = (F.col("block") < full) | (full == 0)
    first = whole & (F.col("block") < base_days)
    last = whole & (F.col("block") >= n_blocks - recent_days)
    sums = ["s_all", "q_all", "s_baseline", "q_baseline", "s_recent", "q_recent", "s_night", "s_day"]
    folded = (
        blocks.withColumn("w", _window_facts(split))
        .groupBy("meter_id")
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.sum(F.when(first, F.col("s_all")).otherwise(0.0)).alias("s_first"),
            F.sum(F.when(first, F.col("s_all") * F.col("s_all")).otherwise(0.0)).alias("q_first"),
            F.sum(F.when(last, F.col("s_all")).otherwise(0.0)).alias("s_last"),
            F.flatten(F.collect_list("seen")).alias("seen"),
        )
    )
    per_meter = (
        meters.select(F.col("id").alias("meter_id"))
        .join(folded, "meter_id", "left")
        .na.fill(0.0, [*sums, "s_first", "q_first", "s_last"])
        .withColumn("w", _window_facts(split))
    )
    n = F.col("w.n")
    has_base = F.col("w.baseline") > 0
    block_hours = F.when(full > 0, F.lit(24)).otherwise(n)
    c = F.col
    stats = per_meter.select(
        "meter_id",
        facts,
        "seen",
        _mean(c("s_all"), n).alias("mean"),
        _std(c("s_all"), c("q_all"), n).alias("std"),
        F.when(has_base, _mean(c("s_baseline"), c("w.baseline"))).otherwise(_mean(c("s_all"), n)).alias("b_mean"),
        F.when(has_base, _std(c("s_baseline"), c("q_baseline"), c("w.baseline")))
        .otherwise(_std(c("s_all"), c("q_all"), n))
        .alias("b_std"),
        _mean(c("s_recent"), c("w.recent")).alias("r_mean"),
        _std(c("s_recent"), c("q_recent"), c("w.recent")).alias("r_std"),
        _mean(c("s_night"), c("w.night")).alias("night_mean"),
        _mean(c("s_day"), c("w.day")).alias("day_mean"),
        (c("s_first") / (base_days * block_hours)).alias("d_mean"),
        (_std(c("s_first"), c("q_first"), base_days) / block_hours).alias("d_std"),
        (c("s_last") / (recent_days * block_hours)).alias("d_recent"),
    )
    threshold = F.greatest(F.lit(0.05) * c("b_mean"), F.lit(0.05))
    used = F.coalesce(F.size(F.filter("seen", lambda v: v >= c("threshold"))), F.lit(0))
    used = F.when(c("seen").isNull(), F.lit(0)).otherwise(used)
    zero = F.when(c("w.recent") > 0, (c("w.recent") - used) / c("w.recent")).otherwise(F.lit(0.0))
    flat = (safe_div("r_std", "r_mean") < 0.05) & (c("zero") > 0.8)
    z = (c("d_mean") - c("d_recent")) / F.greatest(c("d_std"), F.lit(0.03) * c("d_mean"), F.lit(S.EPSILON))
    return (
        stats.withColumn("threshold", threshold)
        .withColumn("zero", zero)
        .select(
            "meter_id",
            F.round("mean", 6).alias("mean_kwh"),
            F.round("std", 6).alias("std_kwh"),
            F.round("b_mean", 6).alias("baseline_mean_kwh"),
            F.round("b_std", 6).alias("baseline_std_kwh"),
            F.round("r_mean", 6).alias("recent_mean_kwh"),
            F.round("r_std", 6).alias("recent_std_kwh"),
            F.round(safe_div("r_mean", "b_mean"), 6).alias("drop_ratio"),
            F.round(safe_div(c("r_mean") - c("b_mean"), "b_mean"), 6).alias("trend"),
            F.round(safe_div("night_mean", "day_mean"), 6).alias("night_day_ratio"),
            F.round("zero", 6).alias("zero_fraction"),
            F.when(flat, 1.0).otherwise(0.0).alias("flatline"),
            F.round(z, 6).alias("anomaly_z"),
        )
    )


def attach_peers(base: DataFrame, members: DataFrame) -> DataFrame:
    """Peer median and deviation within a transformer, and the mean positive deviation per neighbourhood.

    Both group results are small next to the members and are joined back, instead of
    sorting a whole transformer in one window. A customer without a transformer has
    no peers: its deviation is 0.
    """
    linked = base.join(members.select(F.col("id").alias("meter_id"), "transformer_id", "region_id"), "meter_id")
    medians = group_median(linked, ["transformer_id"], "recent_mean_kwh", "_median")
    deviated = linked.join(medians, "transformer_id", "left").select(
        *linked.columns,
        F.round(F.round("_median", 9), 6).alias("peer_median_recent_kwh"),
        F.coalesce(
            F.round(safe_div(F.col("_median") - F.col("recent_mean_kwh"), "_median"), 6), F.lit(0.0)
        ).alias("peer_deviation"),
    )
    return deviated


def neighborhood_risk(deviated: DataFrame) -> DataFrame:
    return deviated.groupBy("transformer_id", "region_id").agg(
        F.round(F.avg(F.greatest(F.lit(0.0), "peer_deviation")), 6).alias("spatial_neighborhood_risk")
    )


def transformer_totals(readings: DataFrame, members: DataFrame, energy: DataFrame, technical: DataFrame) -> DataFrame:
    """Input, metered, technical and unexplained energy and its ratio, per transformer with members."""
    totals = asset_totals(energy, technical).withColumnRenamed("asset_id", "transformer_id")
    zero = F.lit(0.0)
    rest = unexplained_loss("input_total_kwh", "metered_total_kwh", "technical_total_kwh")
    return (
        metered_totals(readings, members)
        .join(totals, "transformer_id", "left")
        .select(
            "transformer_id",
            F.coalesce("input_total_kwh", zero).alias("input_total_kwh"),
            "metered_total_kwh",
            F.coalesce("technical_total_kwh", zero).alias("technical_total_kwh"),
        )
        .withColumn("unexplained_total_kwh", rest)
        .withColumn("ratio", unexplained_loss_ratio("unexplained_total_kwh", "input_total_kwh"))
    )


def customer_features(
    readings: DataFrame,
    members: DataFrame,
    energy: DataFrame,
    technical: DataFrame,
    as_of: int | None = None,
) -> DataFrame:
    """The full snapshot of every member.

    The base statistics need the one pass over all readings; they are written out
    (one row per meter) because four later branches read them.
    """
    base = materialize(base_features(readings, members, as_of), "base-features")
    deviated = attach_peers(base, members)
    ratio = transformer_totals(readings, members, energy, technical).select(
        "transformer_id", F.round("ratio", 6).alias("grid_unexplained_ratio")
    )
    traits = members.select(
        F.col("id").alias("meter_id"),
        "external_ref",
        "is_ntl",
        "solar_potential_flag",
        "woningwaarde_category",
        "baseline_annual_kwh",
    )
    annual = F.col("recent_mean_kwh") * float(S.HOURS_PER_YEAR)
    nearby = neighborhood_risk(deviated).select(
        F.col("transformer_id").alias("_tx"), F.col("region_id").alias("_region"), "spatial_neighborhood_risk"
    )
    same_place = F.col("transformer_id").eqNullSafe(F.col("_tx")) & F.col("region_id").eqNullSafe(F.col("_region"))
    return (
        deviated.join(nearby, same_place, "left")
        .drop("_tx", "_region")
        .join(ratio, "transformer_id", "left")
        .na.fill(0.0, ["grid_unexplained_ratio", "spatial_neighborhood_risk"])
        .join(traits, "meter_id")
        .withColumn("baseline_deviation_ratio", baseline_deviation("recent_mean_kwh", "baseline_annual_kwh"))
        .withColumn(
            "recent_annualized_kwh", F.when(F.col("baseline_deviation_ratio").isNotNull(), F.round(annual, 4))
        )
    )


def transformer_features(customer_snapshots: DataFrame, totals: DataFrame) -> DataFrame:
    grouped = (
        customer_snapshots.filter(F.col("transformer_id").isNotNull())
        .groupBy("transformer_id")
        .agg(
            F.count(F.lit(1)).alias("member_count"),
            F.round(F.avg(F.when(F.col("drop_ratio") < 0.7, 1.0).otherwise(0.0)), 6).alias("frac_members_dropping"),
            F.round(F.avg(F.greatest(F.lit(0.0), "peer_deviation")), 6).alias("mean_peer_deviation"),
            F.round(F.max("anomaly_z"), 6).alias("max_member_anomaly_z"),
        )
    )
    return grouped.join(totals, "transformer_id").select(
        "transformer_id",
        "member_count",
        F.round("ratio", 6).alias("unexplained_ratio"),
        *[
            F.round(f"{name}_total_kwh", 4).alias(f"{name}_total_kwh")
            for name in ("input", "metered", "technical", "unexplained")
        ],
        "frac_members_dropping",
        "mean_peer_deviation",
        "max_member_anomaly_z",
    )


def overlay_features(snapshots: DataFrame, olap: DataFrame) -> DataFrame:
    """Rolling features laid over the snapshots where a meter has them."""
    over = olap.select(
        "meter_id",
        F.coalesce("rolling_14d_avg_kwh", F.lit(0.0)).alias("rolling_14d_avg_kwh"),
        F.coalesce("peer_group_median_kwh", F.lit(0.0)).alias("peer_group_median_kwh"),
        F.coalesce("daylight_drop_index", F.lit(0.0)).alias("daylight_drop_index"),
        F.col("woningwaarde_category").alias("_category"),
        F.col("solar_potential_flag").alias("_solar"),
        F.lit(True).alias("_has"),
    )
    joined = snapshots.join(over, "meter_id", "left")
    has = F.col("_has")
    return (
        joined.withColumn(
            "woningwaarde_category", F.when(has, F.col("_category")).otherwise(F.col("woningwaarde_category"))
        )
        .withColumn("solar_potential_flag", F.coalesce("_solar", "solar_potential_flag"))
        .drop("_category", "_solar", "_has")
    )


def union_snapshots(customers: DataFrame, transformers: DataFrame, as_of: Column) -> DataFrame:
    """Both kinds of entity as one snapshot table, features as JSON text."""

    def rows(df: DataFrame, kind: str, key: str) -> DataFrame:
        features = F.to_json(F.struct(*[c for c in df.columns if c != key]))
        return df.select(
            F.lit(kind).alias("entity_type"),
            F.col(key).alias("entity_id"),
            as_of.alias("as_of"),
            features.alias("features_json"),
            F.lit(S.FEATURE_VERSION).alias("feature_version"),
        )

    return rows(customers, "customer", "meter_id").unionByName(rows(transformers, "transformer", "transformer_id"))
