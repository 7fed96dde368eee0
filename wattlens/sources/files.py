"""CSV, JSON and Parquet readers and writers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlens import schema as S
from wattlens.functions import hour_bucket

INGEST_FILES = (
    "operators", "regions", "grid_assets", "customers", "meter_readings", "asset_energy_readings", "technical_loss_estimates",
)


# ---- CSV ------------------------------------------------------------------------
def read_checked_csv(
    spark: SparkSession, path: str, required: Sequence[str], label: str, schema: str | None = None, ordered: bool = False
) -> DataFrame:
    """CSV with a header; columns are matched by name and kept as text.

    Every column of ``schema`` that the file lacks comes back null. Missing required
    columns are an error that names them, and so are part files whose headers differ.
    ``ordered`` adds ``_row``, which sorts as the rows stand in the files, by file name. It holds
    the file's number in that order, not its path: merges carry the order several times a row.
    """
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{label} missing required columns: {', '.join(missing)}")
    columns = ["*"]
    if schema is not None:
        columns = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in S.field_names(schema)]
    if not ordered:
        return df.select(*columns)
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("_at")
    rows = df.select(*columns, _plain_path(F.col("_metadata.file_path")).alias("_path"), place)
    listed = spark.createDataFrame([(f,) for f in df.inputFiles()], "_path string").select(_plain_path(F.col("_path")).alias("_path"))
    files = listed.agg(F.array_sort(F.collect_set("_path")).alias("f")).select(F.posexplode("f").alias("_file", "_path"))
    named = rows.join(F.broadcast(files), "_path", "left")
    row = F.struct(F.col("_file").alias("file"), "_at.file_block_start", "_at.n").alias("_row")
    return named.select(*[c for c in rows.columns if c not in ("_path", "_at")], row)


def _plain_path(path: Column) -> Column:
    """A path with one slash after its scheme, as the same file may be listed with more."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+:)/+", "$1/")


def optional_source(spark: SparkSession, path: str, required: Sequence[str], label: str, schema: str) -> DataFrame:
    """Like ``read_checked_csv``, but an absent file is an empty table."""
    try:
        return read_checked_csv(spark, path, required, label, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_ingest_csvs(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Write the ingest layout, one folder per table, in parallel part files."""
    unknown = set(tables) - set(INGEST_FILES)
    if unknown:
        raise ValueError(f"unknown ingest tables: {', '.join(sorted(unknown))}")
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}.csv"
        df.write.option("header", True).csv(paths[name])
    return paths


# ---- yearly open data -----------------------------------------------------------
_YEAR_TOKEN = r"([0-9]+)\.csv(?:/|$)"
_YEAR_COLUMNS = (
    "PRODUCTSOORT", "POSTCODE_VAN", "STRAATNAAM", "WOONPLAATS", "SJA_GEMIDDELD", "SJI_GEMIDDELD",
    "AANSLUITINGEN_AANTAL", "SLIMME_METER_PERC",
)


def _decimal_comma(name: str) -> Column:
    return F.regexp_replace(name, ",", ".").try_cast("double")


def _first_line(spark: SparkSession, path: str) -> str:
    """The header of one file, without reading on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def read_year_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Yearly files: decimal comma, byte-order mark, short or long rows, and either name of
    the use column. Files are grouped by their header line, so each is read with its own
    separator (the one that cuts the header into more columns) and its own column order."""
    dialects: dict[str, list[str]] = {}
    for file in _listed(spark, paths):
        dialects.setdefault(_first_line(spark, file), []).append(file)
    parts = [
        _read_dialect(spark, files, max("\t;", key=header.count)) for header, files in sorted(dialects.items()) if header
    ]
    if not parts:
        raise FileNotFoundError(f"no file with a header line in {paths}")
    return reduce(DataFrame.unionByName, parts)


def _read_dialect(spark: SparkSession, paths: list[str], separator: str) -> DataFrame:
    raw = spark.read.option("header", True).option("sep", separator).csv(paths)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    col = {c: F.col(c) if c in raw.columns else F.lit(None).cast("string") for c in _YEAR_COLUMNS}
    raw = raw.select(*[col[c].alias(c) for c in _YEAR_COLUMNS])
    return raw.select(
        F.col("PRODUCTSOORT").alias("product"),
        F.regexp_replace("POSTCODE_VAN", " ", "").alias("postcode"),
        F.trim("STRAATNAAM").alias("street"),
        F.trim("WOONPLAATS").alias("city"),
        F.coalesce(_decimal_comma("SJA_GEMIDDELD"), _decimal_comma("SJI_GEMIDDELD")).alias("sja_kwh"),
        F.coalesce(F.col("AANSLUITINGEN_AANTAL").try_cast("bigint"), F.lit(1)).alias("connections"),
        _decimal_comma("SLIMME_METER_PERC").alias("smart_meter_pct"),
    )


def _listed(spark: SparkSession, paths: str | list[str]) -> list[str]:
    return [unquote(f) for f in spark.read.text(paths).inputFiles()]


def scan_years(spark: SparkSession, pattern: str, product: str = "ELK") -> DataFrame:
    """All yearly files that ``pattern`` matches; the year ends the file's name.

    Only the file list and the header lines reach the driver. Files of one year may
    differ in dialect; files whose name does not end in a number are skipped.
    """
    by_year: dict[int, list[str]] = {}
    for f in _listed(spark, pattern):
        found = re.search(_YEAR_TOKEN, f)
        if found:
            by_year.setdefault(int(found.group(1)), []).append(f)
    if not by_year:
        raise FileNotFoundError(f"no yearly files match {pattern}")
    out = None
    for year in sorted(by_year):
        rows = read_year_csv(spark, by_year[year]).filter(F.col("product") == product).drop("product")
        rows = rows.withColumn("year", F.lit(year))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.filter(F.col("sja_kwh") > 0)


# ---- Parquet --------------------------------------------------------------------
def export_readings_parquet(readings: DataFrame, path: str) -> None:
    """Readings in the columnar layout: by date, and inside a file by meter and time.

    Rows meet by (date, meter range), so a date becomes a few large files and a hot
    date is still written by many tasks.
    """
    (
        readings.select(
            "meter_id",
            "timestamp",
            F.col("consumption_kwh").alias("kwh_consumed"),
            (F.coalesce("reading_quality", F.lit("")) != "good").alias("is_estimated"),
            F.to_date("timestamp").alias("date"),
        )
        .repartitionByRange("date", "meter_id")
        .sortWithinPartitions("date", "meter_id", "timestamp")
        .write.mode("overwrite")
        .partitionBy("date")
        .parquet(path)
    )


def read_olap_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_series_parquet(spark: SparkSession, records: DataFrame | Iterable[tuple], path: str, schema: str = S.MACRO_SERIES) -> None:
    """Write a macro series; an empty one still writes its typed columns."""
    df = records if isinstance(records, DataFrame) else spark.createDataFrame(list(records), schema)
    df.write.mode("overwrite").parquet(path)


# ---- JSON -----------------------------------------------------------------------
def read_json_context(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """Every object of every matching file, as (source_file, item text).

    A file may hold one object or a list; other items and unreadable files are
    dropped. Objects that already name a ``_source_file`` keep theirs.
    """
    files = (
        spark.read.option("wholetext", True)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .text(folder)
        .select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("body"))
    )
    items = F.when(F.col("body").startswith("["), F.from_json("body", "array<string>")).when(
        F.from_json("body", "map<string,string>").isNotNull(), F.array("body")
    )
    rows = files.select("file", F.explode(items).alias("item")).filter(F.col("item").startswith("{"))
    own = F.from_json("item", "map<string,string>")
    return rows.withColumn("fields", own).filter(F.col("fields").isNotNull()).select(
        F.coalesce(F.try_element_at("fields", F.lit("_source_file")), F.col("file")).alias("source_file"), "item", "fields"
    )


def utilization_items(payload: str) -> Column:
    """The item texts of a payload: ``hydra:member``, ``member``, ``@graph`` or a bare list."""
    text = F.trim(F.col(payload))
    fields = F.from_json(text, "map<string,string>")
    listed = F.coalesce(
        F.try_element_at(fields, F.lit("hydra:member")),
        F.try_element_at(fields, F.lit("member")),
        F.try_element_at(fields, F.lit("@graph")),
    )
    return F.from_json(F.when(text.startswith("["), text).otherwise(listed), "array<string>")


def read_utilization_payload(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Hourly energy per payload stream; unreadable items are skipped."""
    items = payloads.select(F.explode(utilization_items(payload)).alias("item")).filter(F.trim("item").startswith("{"))
    f = items.select(F.from_json("item", "map<string,string>").alias("f"))

    def get(name: str) -> Column:
        return F.try_element_at("f", F.lit(name))

    def non_blank(name: str) -> Column:
        return F.nullif(get(name), F.lit(""))

    when = F.coalesce(non_blank("validfrom"), non_blank("validFrom"), get("timestamp"))
    value = get("value")
    amount = F.coalesce(F.when(value.try_cast("double") != 0, value), get("amount"))
    return (
        f.select(hour_bucket(when).alias("timestamp"), F.coalesce(get("volume"), amount).try_cast("double").alias("kwh"))
        .na.drop()
        .groupBy("timestamp")
        .agg(F.sum("kwh").alias("kwh"))
    )


def write_anomaly_results(results: DataFrame, path: str) -> None:
    results.select(*S.field_names(S.ANOMALY_RESULTS)).write.mode("overwrite").json(path)


def read_anomaly_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.ANOMALY_RESULTS).json(path)


# ---- GeoJSON --------------------------------------------------------------------
def geojson_features(points: DataFrame, properties: Sequence[str], key: str = "id") -> DataFrame:
    """One GeoJSON feature text per point, with its score for ordering."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.col(key).alias("id"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        key, "risk_score", F.to_json(feature).alias("feature")
    )


def geojson_document(features: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` highest-scored features as one FeatureCollection text, for a map view.

    Whole layers are written as rows of ``geojson_features``; a single document is
    only for what a browser can show, so its size is an explicit argument.
    """
    top = features.orderBy(F.desc("risk_score"), features.columns[0]).limit(limit)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("risk_score")).alias("r"), F.col(features.columns[0]).alias("i"), "feature")))
    body = F.array_join(F.transform(ordered, lambda x: x["feature"]), ",")
    return top.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("geojson"))


# ---- external tables ------------------------------------------------------------
def scan_external_table(spark: SparkSession, options: Mapping[str, str], data_format: str = "jdbc") -> DataFrame:
    """A table of another system through its data source.

    For JDBC give partitionColumn, lowerBound, upperBound and numPartitions, so the
    read is split over executors instead of running through one connection.
    """
    if data_format == "jdbc" and "partitionColumn" not in options:
        raise ValueError("a JDBC scan needs partitionColumn, lowerBound, upperBound and numPartitions")
    return spark.read.format(data_format).options(**options).load()


def meter_series(readings: DataFrame, customers: DataFrame) -> DataFrame:
    """Readings of known customers only, as the sequence model reads them."""
    return readings.join(customers.select(F.col("id").alias("meter_id")), "meter_id", "left_semi")
