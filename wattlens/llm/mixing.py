"""Mixing sources to target weights: whole epochs first, then a weighted draw without replacement.

Defined results: null text has size 0; a null source is a source of its own and sorts last; rows
with the same key and ``doc_id`` are taken together; an empty table gives no rows; columns of the
input named like a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlens.operators.ranking import positions
from wattlens.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def readable_share(text: Column) -> Column:
    """Share of letters and blanks in the text: a quality weight between 0.05 and 1."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\s]+", ""))
    return F.greatest(F.lit(0.05), 1 - F.coalesce(odd / F.greatest(F.length(text), F.lit(1)), F.lit(1.0)))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target size per source from (source, source_size): the water level under the caps.

    Handing the excess of capped sources to the others by weight, until none is above its
    cap, ends where every uncapped source has the same target per weight. With sources
    ordered by cap per weight the capped ones are a prefix, found from running totals.
    """
    listed = positions(sizes, [F.col("source").asc_nulls_last()], out="nth")
    listed = listed.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    )
    level = (most * F.col("source_size") / F.col("weight")).alias("level")
    running = positions(
        listed.withColumn("level", level),
        [F.col("level"), F.col("nth")],
        out="_at",
        running={"_caps": "source_size", "_weights": "weight"},
    )
    everything, weight = running.agg(F.sum("source_size"), F.sum("weight")).first()
    if everything is None:
        return sizes.withColumn("target", F.lit(0.0))
    # the level if all sources before this one are capped and none from this one on
    water = (share * everything - most * (F.col("_caps") - F.col("source_size"))) / (
        weight - F.col("_weights") + F.col("weight")
    )
    at, level = (
        running.filter(F.col("level") >= water - 1e-9)
        .agg(F.min(F.struct(F.col("_at"), water.alias("water"))).alias("first"))
        .select(F.coalesce("first._at", F.lit(1 << 62)), F.coalesce("first.water", F.lit(0.0)))
        .first()
    )
    capped = F.col("_at") < at
    return (
        running.withColumn(
            "target", F.when(capped, most * F.col("source_size")).otherwise(F.col("weight") * level)
        )
        .select("source", "source_size", F.col("target").cast("double").alias("target"))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    quality: Column | None = None,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` words.

    A source whose target exceeds its size is taken whole as often as it fits. The rest of
    the target is drawn by the exponential keys ``-ln(u) / quality`` in rising order
    (Efraimidis and Spirakis): their running total of sizes, built over range partitions so
    that a hot source is spread, gives one cut per source. Texts are never shuffled: the
    cut, one row per source, is joined back and the keys are computed again from the row.
    ``u`` is a hash of the document, so reruns agree.
    """
    quality = readable_share(F.col("text")) if quality is None else quality
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    unit = (F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = docs.withColumns({"size": word_count(F.col("text")), "_key": -F.log(unit) / quality})
    units = materialize(keyed.groupBy("source", "doc_id", "_key").agg(F.sum("size").alias("size")), "units")
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = (
        source_targets(sizes, weights, share, most)
        .withColumn("_whole", F.floor((F.col("target") + 1e-6) / F.greatest("source_size", F.lit(1))))
        .withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")))
    )
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_source")  # join key without nulls
    # one row per source, written: its true size lets Spark broadcast it while it is small
    plan = materialize(plan.select(named, "source_size", "target", "_whole", "_rest"), "plan")
    ranked = positions(
        units.select(named, "doc_id", "_key", "size"),
        [F.col("_key"), F.col("doc_id")],
        ["_source"],
        running={"_upto": "size"},
    )
    cuts = (
        ranked.join(plan, "_source")
        .filter(F.col("_upto") - F.col("size") / 2 <= F.col("_rest"))
        .filter(F.col("_rest") > 0)
        .groupBy("_source")
        .agg(F.max(F.struct("_key", "doc_id")).alias("_cut"))
    )
    plan = materialize(plan.join(cuts, "_source", "left"), "cuts")
    drawn = F.coalesce(F.struct("_key", "doc_id") <= F.col("_cut"), F.lit(False))
    return (
        keyed.withColumn("_source", named)
        .join(plan, "_source")
        .withColumn("copies", F.col("_whole") + drawn.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_source", "_key", "_whole", "_rest", "_cut")
    )
