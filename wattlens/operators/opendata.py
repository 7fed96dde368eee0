"""Street-level open data: yearly segments, postcodes, geocoding."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlens import schema as S
from wattlens.functions import DEFAULT_CENTROID, PC2_CENTROIDS, hash_unit, normalize_zip, pc4_of, segment_key, slug
from wattlens.operators.ranking import positions

PROFILE_HOURS = 1440
PROFILE_END = datetime(2026, 6, 1)


def segment_pivot(years: DataFrame, of: Sequence[int] | None = None) -> DataFrame:
    """One row per street: most connections, mean use per year, latest and baseline use.

    The years become columns; by default all that occur, a handful.
    """
    year = F.col("year")
    of = sorted(of if of is not None else [r["year"] for r in years.select("year").distinct().collect() if r["year"] is not None])
    uses = [f"sja_{y}" for y in of] or [F.lit(None).cast("double")]
    pivoted = years.groupBy("postcode", "street", "city").agg(
        F.max("connections").alias("connections"),
        *[F.avg(F.when(year == y, F.col("sja_kwh"))).alias(f"sja_{y}") for y in of],
        F.avg("smart_meter_pct").alias("smart_meter_pct"),
    )
    return pivoted.select(
        segment_key("postcode", "street", "city").alias("segment_key"),
        "*",
        F.coalesce(*reversed(uses)).alias("sja_latest"),
        F.coalesce(*uses).alias("sja_baseline"),
    ).filter(F.col("sja_latest").isNotNull())


def top_segments(segments: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` keys with most connections, each by its row with most connections."""
    order = F.struct((-F.col("connections")).alias("_c"), "postcode", "street", "city")
    others = [c for c in segments.columns if c != "segment_key"]
    best = segments.groupBy("segment_key").agg(F.min_by(F.struct(*others), order).alias("_s"))
    return best.select("segment_key", "_s.*").orderBy(F.desc("connections"), "segment_key").limit(limit)


def distinct_cities(segments: DataFrame, prefix: str = "STEDIN", root: str = "Stedin Netbeheer") -> DataFrame:
    """One municipality row per city and one root row above them."""
    cities = segments.select("city").distinct().select(
        F.concat(F.lit(f"{prefix}-"), slug("city", 16)).alias("code"),
        F.col("city").alias("name"),
        F.lit("municipality").alias("region_type"),
        F.lit(f"{prefix}-NL").alias("parent_code"),
    )
    top = cities.sparkSession.createDataFrame(
        [(f"{prefix}-NL", root, "country", "")], "code string, name string, region_type string, parent_code string"
    )
    return top.unionByName(cities).orderBy(F.col("region_type").asc(), "name")


def pc4_groups(segments: DataFrame) -> DataFrame:
    """Per four-digit postcode: the smallest segment as sample, and the number of segments."""
    sample = F.min(F.struct("postcode", "street", "city"))
    return (
        segments.withColumn("pc4", F.substring("postcode", 1, 4))
        .groupBy("pc4")
        .agg(sample.alias("s"), F.count(F.lit(1)).alias("segments"))
        .select(
            "pc4",
            F.col("s.city").alias("city"),
            F.col("s.postcode").alias("sample_postcode"),
            F.col("s.street").alias("sample_street"),
            "segments",
        )
    )


def street_baselines(streets: DataFrame) -> DataFrame:
    """Mean annual use, mean smart-meter share and any solar hint per postcode."""
    return (
        streets.select(
            normalize_zip("zipcode_from").alias("zipcode"),
            F.col("annual_consume").cast("double").alias("a"),
            F.col("smartmeter_perc").cast("double").alias("m"),
            (F.col("delivery_perc") < 95.0).alias("solar"),
        )
        .na.drop(subset=["zipcode", "a", "m"])
        .groupBy("zipcode")
        .agg(
            F.avg("a").alias("baseline_annual_kwh"),
            F.avg("m").alias("street_smartmeter_perc"),
            F.coalesce(F.bool_or("solar"), F.lit(False)).alias("has_solar_potential"),
        )
    )


def zip_weights(streets: DataFrame, city: str = "amsterdam") -> DataFrame:
    """Connections per postcode of the city, or of all rows when the city does not occur."""
    here = F.lower("city") == city.lower()
    rows = streets.select(
        normalize_zip("zipcode_from").alias("zipcode"),
        F.coalesce(F.col("num_connections").cast("bigint"), F.lit(1)).alias("weight"),
        F.coalesce(here, F.lit(False)).alias("here"),
    )
    seen = rows.select(F.coalesce(F.bool_or("here"), F.lit(False))).scalar()
    return (
        rows.filter(F.col("here") | ~seen)
        .groupBy("zipcode")
        .agg(F.sum("weight").alias("weight"))
        .orderBy(F.desc("weight"), "zipcode")
    )


def zip_enrich(customers: DataFrame, baselines: DataFrame) -> DataFrame:
    """Baseline, smart-meter share and solar flag by postcode, where the postcode matches."""
    new = baselines.select(
        F.col("zipcode").alias("_zip"),
        F.col("baseline_annual_kwh").alias("_b"),
        F.col("street_smartmeter_perc").alias("_m"),
        F.col("has_solar_potential").alias("_s"),
    )
    return (
        customers.join(new, normalize_zip("zipcode") == F.col("_zip"), "left")
        .withColumns(
            {
                "baseline_annual_kwh": F.coalesce("_b", "baseline_annual_kwh"),
                "street_smartmeter_perc": F.coalesce("_m", "street_smartmeter_perc"),
                "solar_potential_flag": F.coalesce("_s", "solar_potential_flag"),
            }
        )
        .drop("_zip", "_b", "_m", "_s")
    )


AREA_SPREAD = {"lon": 0.16, "lat": 0.11}  # degrees over which the PC4 areas of one centre are strewn
STREET_SPREAD = {"lon": 0.012, "lat": 0.009}  # and the streets of one PC4 area


def approximate_positions(rows: DataFrame, postcode: str, street: str, out: str) -> DataFrame:
    """Add ``out``, a (lon, lat) guess: the centre of the two-digit area plus two hashed offsets.

    The centres are a fixed table of some fifty rows, joined by area number; areas it
    lacks share a default centre. The first offset depends on the PC4 area, the second
    on the full postcode and the street.
    """
    centres = rows.sparkSession.createDataFrame(
        [(number, *place) for number, place in PC2_CENTROIDS.items()], "_number int, _lon double, _lat double"
    )
    pc4 = pc4_of(postcode)
    near = dict(zip(("lon", "lat"), hash_unit(pc4), strict=True))
    exact = dict(zip(("lon", "lat"), hash_unit(normalize_zip(postcode), street), strict=True))

    def placed(axis: str, default: float) -> Column:
        offsets = (near[axis] - 0.5) * AREA_SPREAD[axis], (exact[axis] - 0.5) * STREET_SPREAD[axis]
        return F.round(F.coalesce(f"_{axis}", F.lit(default)) + offsets[0] + offsets[1], 6).alias(axis)

    located = rows.withColumn("_number", F.floor(pc4.cast("int") / 100).cast("int")).join(F.broadcast(centres), "_number", "left")
    guess = F.struct(*[placed(axis, default) for axis, default in zip(("lon", "lat"), DEFAULT_CENTROID, strict=True)])
    return located.withColumn(out, guess).drop("_number", "_lon", "_lat")


def geocode(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Coordinates by full postcode, then street and city, then PC4, else the hashed position.

    ``lookup`` has kind ('postcode' | 'street' | 'pc4'), key, lon, lat; one row per key.
    """

    def side(kind: str, tag: str) -> DataFrame:
        return lookup.filter(F.col("kind") == kind).select(
            F.col("key").alias(f"_{tag}"), F.struct("lon", "lat").alias(f"_{tag}_at")
        )

    pc = normalize_zip("postcode")
    street = F.concat_ws(" ", "street", "city")
    # Only a 6-character postcode is looked up in full; only four digits count as PC4.
    full = F.when(F.length(pc) >= 6, pc)
    area = F.when(F.substring(pc, 1, 4).rlike("^[0-9]{4}$"), F.substring(pc, 1, 4))
    found = F.coalesce("_p_at", "_s_at", "_a_at")
    joined = (
        approximate_positions(rows, "postcode", "street", "_guess")
        .join(side("postcode", "p"), full == F.col("_p"), "left")
        .join(side("street", "s"), street == F.col("_s"), "left")
        .join(side("pc4", "a"), area == F.col("_a"), "left")
        .withColumn("_hit", found)
        .withColumn("_at", F.coalesce("_hit", "_guess"))
    )
    return joined.select(
        *rows.columns,
        F.round("_at.lon", 6).alias("lon"),
        F.round("_at.lat", 6).alias("lat"),
        F.when(F.col("_p_at").isNotNull(), "postcode")
        .when(F.col("_s_at").isNotNull(), "street")
        .when(F.col("_a_at").isNotNull(), "pc4")
        .otherwise("hashed")
        .alias("geocode_source"),
    )


def assign_zipcodes(customers: DataFrame, weights: DataFrame, seed: int = 42) -> DataFrame:
    """Give customers without a postcode a weighted draw from ``weights``.

    The draw is a hash of (seed, id) placed on the cumulative weights. Points and
    boundaries are sorted together and each point takes the next boundary at or
    above it; the cumulative sums come from range-partitioned totals, not one task.
    """
    weights = weights.filter("weight > 0")
    edges = positions(weights, [F.desc("weight"), F.col("zipcode").asc()], running={"edge": "weight"})
    unit, _ = hash_unit(F.lit(str(seed)), F.col("id").cast("string"))
    total = weights.select(F.sum("weight").cast("double")).scalar()
    missing = customers.filter(F.col("zipcode").isNull()).select("id", F.floor(unit * total).alias("point"))
    # Bucket b covers [b*width, (b+1)*width); an edge serves every bucket its span touches.
    width = F.greatest(F.ceil(total / 1024), F.lit(1))
    spans = edges.withColumn("start", F.col("edge") - F.col("weight")).withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("edge") - 1) / width)))
    )
    points = missing.withColumn("bucket", F.floor(F.col("point") / width))
    drawn = points.join(
        spans.select("bucket", "start", "edge", F.col("zipcode").alias("_drawn")), "bucket"
    ).filter((F.col("point") >= F.col("start")) & (F.col("point") < F.col("edge")))
    return (
        customers.join(drawn.select("id", "_drawn"), "id", "left")
        .withColumn("zipcode", F.coalesce("zipcode", "_drawn"))
        .drop("_drawn")
    )


_PRIME = (1 << 31) - 1
_STEPS = (1_103_515_245, 742_938_285)


def _hour_unit(key: Column, step: int) -> Column:
    """A number in [0, 1) from a key's hash and the hour: a quadratic congruence."""
    x = (key + F.col("idx").cast("bigint") * F.lit(step)) % F.lit(_PRIME)
    return (x * x) % F.lit(_PRIME) / F.lit(float(_PRIME))


def expand_annual_profile(segments: DataFrame, hours: int = PROFILE_HOURS, end: datetime = PROFILE_END, noise: float = 0.04) -> DataFrame:
    """Hourly rows from annual use: daily and seasonal shape, hashed noise, rescaled to the target total.

    The noise is centred on 1 with the given spread and depends only on the key and
    the hour, so a re-run gives the same rows. The key is hashed once; its hours
    follow from that by integer arithmetic.
    """
    recent_hours = max(int(hours * 0.25), S.RECENT_HOURS)
    split = hours - recent_hours
    last = F.unix_timestamp(F.lit(end).cast("timestamp"))
    # A segment is a few bytes that become many rows, so segments are spread by count,
    # not by size. Their rows then stay where they are and are made twice, once to be added up
    # and once scaled: only totals are kept and joined, hourly rows are neither sorted nor shuffled.
    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one, two = hash_unit("segment_key")
    seeds = [F.floor(unit * _PRIME).alias(name) for unit, name in ((one, "k1"), (two, "k2"))]
    annual_use = segments.select("segment_key", F.col("sja_baseline").alias("b"), F.col("sja_latest").alias("l"), *seeds)
    annual_use = annual_use.repartition(tasks, "segment_key")
    hour = F.hour("timestamp")
    diurnal = F.when((hour < 7) | (hour > 22), 0.45).when(hour.between(17, 21), 1.1).otherwise(0.85)
    seasonal = F.lit(1.0) + F.lit(0.15) * F.sin(F.lit(2.0) * F.pi() * (F.dayofyear("timestamp") / F.lit(365.0)))
    annual = F.when(F.col("idx") < split, F.col("b")).otherwise(F.col("l"))
    u, v = (_hour_unit(F.col(k), step) for k, step in zip(("k1", "k2"), _STEPS, strict=True))
    jitter = F.lit(1.0) + F.lit(noise) * (u + v - 1.0) * F.sqrt(F.lit(6.0))

    def hourly(rows: DataFrame) -> DataFrame:
        slots = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("idx")).withColumn(
            "timestamp", F.timestamp_seconds(last - (F.lit(hours - 1) - F.col("idx")) * 3600)
        )
        return slots.withColumn("kwh", F.greatest(annual / S.HOURS_PER_YEAR * seasonal * diurnal * jitter, F.lit(0.0)))

    totals = hourly(annual_use).groupBy(F.col("segment_key").alias("_key")).agg(F.sum("kwh").alias("total"))
    target = (F.col("b") * split + F.col("l") * recent_hours) / S.HOURS_PER_YEAR
    scale = F.when((F.col("total") > 0) & (target > 0), target / F.col("total")).otherwise(F.lit(1.0))
    scaled = annual_use.join(totals, F.col("segment_key").eqNullSafe(F.col("_key"))).withColumn("scale", scale)
    return hourly(scaled).select(
        "segment_key", "timestamp", "idx", F.round(F.col("kwh") * F.col("scale"), 6).alias("consumption_kwh")
    )
