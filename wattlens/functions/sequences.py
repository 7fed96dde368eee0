"""Expressions over one meter's array of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattlens import schema as S
from wattlens.functions.formulas import _c

# Fixed texts of the peak entries.
PEAK_FEATURE = "moment_reconstruction_peak"
PEAK_LABEL = "Reconstruction anomaly peak"


def pad_sequence(values, length: int = S.SEQUENCE_LENGTH) -> tuple[Column, Column]:
    """Last ``length`` values, zero-padded on the right, and the matching 0/1 mask."""
    v = _c(values)
    kept = F.least(F.size(v), F.lit(length))
    tail = F.slice(v, F.greatest(F.size(v) - F.lit(length), F.lit(0)) + 1, F.lit(length))
    pad = F.array_repeat(F.lit(0.0), F.lit(length) - kept)
    mask = F.concat(F.array_repeat(F.lit(1.0), kept), pad)
    return F.concat(tail, pad), mask


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A column used inside a lambda is evaluated again for every element; binding it to
    a lambda variable of its own keeps such expressions linear in the array length.
    """
    return F.get(F.transform(F.array(value), body), 0)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def instance_normalize(values, mask) -> Column:
    """Masked population z-score; a sequence without valid positions is returned as is."""
    v, m = _c(values), _c(mask)

    def scaled(mean: Column, n: Column) -> Column:
        var = _sum(F.zip_with(v, m, lambda x, y: (x - mean) * (x - mean) * y)) / n
        return let(F.sqrt(var) + F.lit(S.SEQUENCE_EPS), lambda std: F.transform(v, lambda x: (x - mean) / std))

    return let(
        _sum(m), lambda n: F.when(n < 1.0, v).otherwise(let(_dot(v, m) / n, lambda mean: scaled(mean, n)))
    )


def squared_errors(values, reconstruction) -> Column:
    return F.zip_with(_c(values), _c(reconstruction), lambda a, b: (a - b) * (a - b))


def masked_mse(values, reconstruction, mask) -> Column:
    m = _c(mask)
    return _dot(squared_errors(values, reconstruction), m) / F.greatest(_sum(m), F.lit(1.0))


def mse_to_anomaly(mse, mean, std) -> Column:
    z = (_c(mse) - _c(mean)) / (_c(std) + F.lit(S.SEQUENCE_EPS))
    score = F.lit(1.0) - F.exp(-z / F.lit(S.ANOMALY_DECAY))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def peak_errors(timestamps, errors, mask, k: int = S.PEAK_COUNT) -> Column:
    """The ``k`` largest errors at valid positions, earliest first among equals.

    Errors are ranked to ten places: two values around one mean have equal errors,
    and rounding noise must not decide between them.
    """
    rows = F.zip_with(
        F.arrays_zip(_c(errors).alias("error"), _c(mask).alias("valid")),
        F.sequence(F.lit(0), F.size(_c(errors)) - 1),
        lambda e, i: F.struct(
            (-F.round(e["error"], 10)).alias("rank"), i.alias("position"), e["error"].alias("error"), e["valid"].alias("valid")
        ),
    )
    top = F.slice(F.array_sort(F.filter(rows, lambda r: r["valid"] > 0.5)), 1, k)
    ts = _c(timestamps)
    return F.transform(
        top,
        lambda r: F.struct(
            F.coalesce(F.get(ts, r["position"]).cast("string"), F.lit("unknown")).alias("timestamp"),
            r["error"].alias("error"),
        ),
    )


def peak_explanations(peaks) -> Column:
    """Explanation entries scaled by the largest of the given peaks."""
    p = _c(peaks)
    top = F.array_max(F.transform(p, lambda r: r["error"]))
    divisor = F.when(top > S.SEQUENCE_EPS, top).otherwise(F.lit(1.0))

    def entry(r: Column, divisor: Column) -> Column:
        share = F.round(r["error"] / divisor, 4)
        return F.struct(
            F.lit(PEAK_FEATURE).alias("feature"),
            F.lit(PEAK_LABEL).alias("label"),
            share.alias("contribution"),
            F.when(share >= 0.5, "increases").otherwise("neutral").alias("direction"),
            F.format_string(
                "MOMENT reconstruction error peaked at %s (point MSE=%.4f).", r["timestamp"], r["error"]
            ).alias("detail"),
        )

    return let(divisor, lambda d: F.transform(p, lambda r: entry(r, d)))


def top_entries(entries, key, n: int) -> Column:
    """The first ``n`` entries by descending ``key(entry)``; equal keys keep their order."""
    e = _c(entries)
    ranked = F.array_sort(
        F.transform(e, lambda x, i: F.struct((-key(x)).alias("k"), i.alias("i"), x.alias("entry")))
    )
    return F.transform(F.slice(ranked, 1, n), lambda r: r["entry"])


def attribution_share(explanations) -> Column:
    hit = F.filter(_c(explanations), lambda e: e["feature"] == "loss_attribution_share")
    return F.coalesce(F.get(hit, 0)["contribution"], F.lit(0.0))
