"""Sequence anomaly scores from a reconstruction of each meter's tail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlens import schema as S
from wattlens.functions import instance_normalize, let, masked_mse, mse_to_anomaly, pad_sequence, peak_errors, squared_errors
from wattlens.operators.olap import trailing_sequence
from wattlens.session import materialize

Reconstructor = Callable[[np.ndarray, np.ndarray], np.ndarray]


def prepared_sequences(readings: DataFrame, length: int = S.SEQUENCE_LENGTH) -> DataFrame:
    """Padded, masked and normalised tail per meter."""
    padded, mask = pad_sequence("values", length)
    return (
        trailing_sequence(readings, length)
        .select("meter_id", "timestamps", "actual_len", padded.alias("padded"), mask.alias("mask"))
        .withColumn("x", instance_normalize("padded", "mask"))
    )


def hourly_profile(x: Column, timestamps: Column) -> Column:
    """Default reconstruction: the mean of the valid values at the same hour of day.

    Built inside the row from 24 hourly means; positions past the end come back as 0.
    """
    n = F.size(timestamps)
    hours = F.transform(timestamps, F.hour)
    valid = F.arrays_zip(F.slice(x, 1, n).alias("x"), hours.alias("h"))

    def mean_at(rows: Column, h: Column) -> Column:
        same = F.filter(rows, lambda r: r["h"] == h)
        total = F.aggregate(same, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, r: F.struct(
            (a["s"] + r["x"]).alias("s"), (a["n"] + 1).alias("n")
        ))
        return let(total, lambda t: t["s"] / F.greatest(t["n"], F.lit(1)))

    means = let(valid, lambda rows: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: mean_at(rows, h)))
    body = let(means, lambda m: F.transform(timestamps, lambda t: F.get(m, F.hour(t))))
    return F.concat(body, F.array_repeat(F.lit(0.0), F.size(x) - n))


def reconstruct(sequences: DataFrame, model: Reconstructor | None = None) -> DataFrame:
    """Add ``recon``. A ``model`` maps (values, mask) matrices of a batch to a matrix;
    it runs on Arrow batches, and no batch depends on another."""
    if model is None:
        return sequences.withColumn("recon", hourly_profile(F.col("x"), F.col("timestamps")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = model(np.stack(b["x"].to_numpy()), np.stack(b["mask"].to_numpy()))
                yield pd.DataFrame({"meter_id": b["meter_id"], "recon": list(np.asarray(out, dtype=float))})

    key = sequences.schema["meter_id"].dataType.simpleString()
    made = sequences.select("meter_id", "x", "mask").mapInPandas(run, f"meter_id {key}, recon array<double>")
    return sequences.join(made, "meter_id")


def reconstruction_errors(sequences: DataFrame, model: Reconstructor | None = None) -> DataFrame:
    """Error and its three largest points per meter."""
    errors = reconstruct(sequences, model).withColumn("errors", squared_errors("x", "recon"))
    return errors.select(
        "meter_id",
        masked_mse("x", "recon", "mask").alias("reconstruction_mse"),
        peak_errors("timestamps", "errors", "mask").alias("peaks"),
    )


def score_population(errors: DataFrame) -> DataFrame:
    """Errors to [0, 1] by their z-score over the whole population, not over a batch."""
    stats = errors.select(
        F.struct(F.avg("reconstruction_mse").alias("mean"), F.stddev_pop("reconstruction_mse").alias("std"))
    ).scalar()
    return errors.withColumn("anomaly_score", mse_to_anomaly("reconstruction_mse", stats["mean"], stats["std"]))


def sequence_anomalies(readings: DataFrame, length: int = S.SEQUENCE_LENGTH, model: Reconstructor | None = None) -> DataFrame:
    """Anomaly score, error and peaks per meter; the errors are written once, then scored."""
    errors = materialize(reconstruction_errors(prepared_sequences(readings, length), model), "sequence-errors")
    return score_population(errors)


def anomaly_results(scored: DataFrame) -> DataFrame:
    """The exchange layout of anomaly results."""
    return scored.select(
        F.col("meter_id").alias("customer_id"),
        "anomaly_score",
        "reconstruction_mse",
        F.transform("peaks", lambda p: p["timestamp"]).alias("peak_timestamps"),
        F.transform("peaks", lambda p: p["error"]).alias("peak_errors"),
    )


def top_anomalies(results: DataFrame, n: int = 10) -> DataFrame:
    return results.orderBy(F.desc("anomaly_score"), "customer_id").limit(n)
