"""Queries of the evaluation, model and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlens import schema as S
from wattlens.functions import risk_tier
from wattlens.functions.sequences import PEAK_FEATURE
from wattlens.operators import evaluation as ev
from wattlens.operators import ml, scoring, sequences
from wattlens.plans.grid_queries import stamp
from wattlens.plans.registry import query
from wattlens.plans.views import Grid, cents
from wattlens.session import materialize, shared_dir, work_path
from wattlens.sources import tables
from wattlens.streaming import readings as st

# ---- W9, W10, W14, M9 -----------------------------------------------------------
_RANKED = """ranked AS (SELECT s.entity_id, s.risk_score, CAST(c.is_ntl AS BIGINT) AS label,
                    row_number() OVER (ORDER BY s.risk_score DESC, s.entity_id) AS rk,
                    sum(CAST(c.is_ntl AS BIGINT)) OVER (ORDER BY s.risk_score DESC, s.entity_id ROWS UNBOUNDED PRECEDING) AS tp,
                    sum(CAST(c.is_ntl AS BIGINT)) OVER () AS positives
             FROM v_scores s JOIN v_customers c ON c.id = s.entity_id WHERE s.is_current AND s.entity_type = 'customer')"""


def labelled(g: Grid):
    rows = g.scores.filter("is_current AND entity_type = 'customer'").select("entity_id", "risk_score")
    return rows.join(g.customers.select(F.col("id").alias("entity_id"), F.col("is_ntl").alias("label")), "entity_id")


@query("w9_average_precision", f"WITH {_RANKED} SELECT round(sum(label * (tp / rk)) / max(positives), 6) AS pr_auc FROM ranked")
def w9(spark, d):
    return ev.average_precision(labelled(Grid(spark, d)), "label", "risk_score", "entity_id").select(
        F.round("pr_auc", 6).alias("pr_auc")
    )


@query(
    "w14_pr_curve",
    f"WITH {_RANKED} SELECT entity_id, rk - 1 AS pos, round(tp / rk, 8) AS precision, round(tp / positives, 8) AS recall FROM ranked",
)
def w14(spark, d):
    curve = ev.pr_curve(labelled(Grid(spark, d)), "label", "risk_score", "entity_id")
    return curve.select("entity_id", "pos", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query(
    "w10_precision_recall_at_k",
    f"WITH {_RANKED} SELECT avg(label) AS precision_at_k, round(sum(label) / max(positives), 8) AS recall_at_k, count(*) AS k FROM ranked WHERE rk <= 20",
)
def w10(spark, d):
    out = ev.at_k(labelled(Grid(spark, d)), "label", "risk_score", "entity_id")
    return out.select("precision_at_k", F.round("recall_at_k", 8).alias("recall_at_k"), "k")


@query(
    "m9_evaluate",
    f"""WITH {_RANKED} SELECT round(sum(label * (tp / rk)) / max(positives), 4) AS pr_auc,
              round(sum(label) FILTER (rk <= 20) / 20, 4) AS precision_at_k, round(sum(label) FILTER (rk <= 20) / max(positives), 4) AS recall_at_k,
              CAST(20 AS BIGINT) AS k, CAST(max(positives) AS BIGINT) AS positives, count(*) AS n,
              round(avg(CASE WHEN (risk_score >= 50) = (label = 1) THEN 1e0 ELSE 0e0 END), 4) AS accuracy FROM ranked""",
)
def m9(spark, d):
    return ev.evaluate(labelled(Grid(spark, d)), "label", "risk_score", "entity_id").drop("primary_metric")


# ---- M1-M8, M10, A27, L6, S16 ---------------------------------------------------
_MATRIX = ", ".join(f"coalesce({c}, 0e0) AS {c}" for c in S.MODEL_COLUMNS)


@query("m1_feature_matrix", f"SELECT meter_id, {_MATRIX}, CAST(is_ntl AS DOUBLE) AS label FROM v_features")
def m1(spark, d):
    return ml.feature_matrix(Grid(spark, d).features)


@query(
    "m2_train_gate",
    """SELECT n, positives, n - positives AS negatives, n >= 40 AND positives >= 5 AND n - positives >= 5 AS trainable
       FROM (SELECT count(*) AS n, count(*) FILTER (is_ntl) AS positives FROM v_meters)""",
)
def m2(spark, d):
    return ml.train_gate(ml.feature_matrix(Grid(spark, d).features))


_Z = ", ".join(
    f"round(({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () < 1e-9 THEN 1e0 ELSE stddev_pop({c}) OVER () END), 5) AS {c}"
    for c in S.MODEL_COLUMNS
)


def _stored_matrix(spark, d, grid=None):
    return materialize(ml.feature_matrix((grid or Grid(spark, d)).features), "matrix")


@query("a27_standardize_columns", f"SELECT meter_id, {_Z} FROM v_features")
def a27(spark, d):
    z = ml.standardize(_stored_matrix(spark, d))
    return z.select("meter_id", *[F.round(c, 5).alias(c) for c in S.MODEL_COLUMNS])


def trained(spark, d, grid=None):
    """(matrix, model): the model stored for exactly this matrix, or a new one, then stored."""
    m = _stored_matrix(spark, d, grid)
    return m, tables.model_for(m, f"{shared_dir(spark)}/models", ml.fit_classifier)


# The numbers of a trained model are not SQL's; each check states what must hold of them.
@query("m3_ntl_classifier", "SELECT meter_id, CAST(is_ntl AS DOUBLE) AS label, TRUE AS in_range, TRUE AS labelled_above FROM v_features")
def m3(spark, d):
    m, model = trained(spark, d)
    out = materialize(ml.predict_probability(model, m), "probabilities")
    p, label = F.col("ml_probability"), F.col("label")
    above = out.select(F.avg(F.when(label == 1, p)) > F.avg(F.when(label == 0, p))).scalar()
    return out.select("meter_id", "label", p.between(0, 1).alias("in_range"), above.alias("labelled_above"))


@query("m4_isolation_forest", "SELECT meter_id, TRUE AS in_range, 0e0 AS least, 1e0 AS most FROM v_features")
def m4(spark, d):
    m = _stored_matrix(spark, d)
    out = ml.scaled_isolation(materialize(ml.isolation_scores(ml.fit_isolation_forest(m), m), "isolation"))
    ends = materialize(out, "scaled").select(F.struct(F.min("ml_anomaly").alias("least"), F.max("ml_anomaly").alias("most"))).scalar()
    return out.select("meter_id", F.col("ml_anomaly").between(0, 1).alias("in_range"), ends["least"].alias("least"), ends["most"].alias("most"))


_SIGNS = ", ".join(
    f"CAST(sign(CASE WHEN stddev_pop({c}) OVER () < 1e-9 THEN 0e0 ELSE round({c} - avg({c}) OVER (), 9) END) AS INTEGER) AS {c}" for c in S.MODEL_COLUMNS
)


@query("m5_importance_contributions", f"SELECT meter_id, {_SIGNS} FROM v_features")
def m5(spark, d):
    """The sign of each contribution, which is that of the standardised value; 0 weighs as its own sign."""
    m, model = trained(spark, d)
    weights = ml.importances(model)
    z = ml.standardize(m)
    made = ml.contributions(m, weights).join(z.select("meter_id", F.struct(*S.MODEL_COLUMNS).alias("z")), "meter_id")
    signs = []
    for c, w in zip(S.MODEL_COLUMNS, weights, strict=True):
        of = F.col(c) if w > 0 else F.col(f"z.{c}")
        signs.append(F.signum(F.when(F.abs(F.col(f"z.{c}")) > 1e-7, of).otherwise(0.0)).cast("int").alias(c))
    return made.select("meter_id", *signs)


_FEATURES = ", ".join(f"('{c}')" for c in S.MODEL_COLUMNS)


@query("m6_global_importances", f"SELECT feature, TRUE AS in_range, 1e0 AS total FROM (VALUES {_FEATURES}) f(feature)")
def m6(spark, d):
    m, model = trained(spark, d)
    out = materialize(ml.global_importances(ml.contributions(m, ml.importances(model))), "importances")
    total = out.select(F.round(F.sum("importance"), 9)).scalar()
    return out.select("feature", F.col("importance").between(0, 1).alias("in_range"), total.alias("total"))


@query("l6_top_abs_contributions", "SELECT meter_id, 4 AS n, TRUE AS falling, TRUE AS directed FROM v_features")
def l6(spark, d):
    m, model = trained(spark, d)
    made = ml.model_explanations(ml.contributions(m, ml.importances(model)), m)
    size = F.transform("explanations", lambda e: F.abs(e["contribution"]))
    directed = F.forall("explanations", lambda e: (e["direction"] == "increases") == ((e["contribution"] > 0) | ((e["contribution"] == 0) & (e["direction"] == "increases"))))
    return made.select("meter_id", F.size("explanations").alias("n"), (size == F.sort_array(size, asc=False)).alias("falling"), directed.alias("directed"))


_TRAIN_AS_OF, _TEST_AS_OF = 551, 719  # 46/60 and all of 720 hours


@query(
    "m7_customer_time_split",
    f"""WITH b AS (SELECT id, CAST('0x' || substr(sha256(external_ref), 1, 8) AS BIGINT) / 4294967295e0 < 0.3e0 AS is_test FROM v_meters),
        w AS (SELECT g.*, b.is_test, CASE WHEN b.is_test THEN {_TEST_AS_OF + 1} ELSE {_TRAIN_AS_OF + 1} END AS stop FROM v_grid g JOIN b ON b.id = g.meter_id)
        SELECT meter_id, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, round(avg(kwh), 6) AS mean_kwh,
               round(avg(kwh) FILTER (idx >= stop - 336), 6) AS recent_mean_kwh
        FROM w WHERE idx < stop GROUP BY meter_id, is_test""",
)
def m7(spark, d):
    g = Grid(spark, d)
    train, test = ml.customer_time_split(g.stored, g.meters, *g.fed, _TRAIN_AS_OF, _TEST_AS_OF)
    columns = ["meter_id", "mean_kwh", "recent_mean_kwh"]
    return train.select(*columns, F.lit("train").alias("part")).unionByName(test.select(*columns, F.lit("test").alias("part")))


@query(
    "m8_predict_frame",
    """SELECT meter_id, least(1e0, greatest(0e0, grid_unexplained_ratio / 0.12e0)) AS grid_imbalance_score, TRUE AS in_range, TRUE AS composed, TRUE AS tiered
       FROM v_features""",
)
def m8(spark, d):
    g = Grid(spark, d)  # its snapshots are a stage table: training and scoring read the same one
    m, model = trained(spark, d, g)
    out = ml.predict_frame(model, ml.fit_isolation_forest(m), g.features)
    parts = list(S.RISK_WEIGHTS)
    again = out.select("meter_id", "grid_imbalance_score", "risk_score", "risk_tier", *[c for c in parts if c != "grid_imbalance_score"])
    total = sum((F.col(c) * F.lit(100.0 * w) for c, w in S.RISK_WEIGHTS.items()), F.lit(0.0))
    inside = F.lit(True)
    for c in parts:
        inside = inside & F.col(c).between(0, 1)
    return again.select(
        "meter_id", "grid_imbalance_score", inside.alias("in_range"), (F.abs(total - F.col("risk_score")) < 1e-3).alias("composed"),
        (F.col("risk_tier") == risk_tier("risk_score")).alias("tiered"),
    )


@query("s16_save_load_model", "SELECT count(*) AS n, TRUE AS same, 'ntl-v1' AS model_version FROM v_features")
def s16(spark, d):
    m, model = trained(spark, d)
    base = work_path(spark, "models")
    tables.save_model(model, ml.predict_probability(model, m), {"rounds": 200.0}, base, "ntl-v1")
    loaded, metadata, stored = tables.load_model(spark, base, "ntl-v1")
    again = ml.predict_probability(loaded, m).select("meter_id", F.col("ml_probability").alias("again"))
    same = stored.join(again, "meter_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.abs(F.col("ml_probability") - F.col("again")) < 1e-12).alias("same")
    )
    return same.withColumn("model_version", metadata.select("model_version").scalar())


@query(
    "e3_model_run",
    """SELECT 'customer' AS entity_type, count(*) AS n, count(*) FILTER (id IN (SELECT meter_id FROM v_readings)) AS with_peaks,
              count(DISTINCT transformer_id) AS shared, TRUE AS tiered, TRUE AS is_current, 'run-2' AS model_version FROM v_customers
       UNION ALL SELECT 'transformer', count(DISTINCT transformer_id), 0, 0, TRUE, TRUE, 'run-2' FROM v_customers""",
)
def e3(spark, d):
    """The daily run: gate, models or heuristic, sequence anomalies, shares, explanations, publishing, registry."""
    g, base = Grid(spark, d), work_path(spark, "run")
    stations = materialize(g.transformer_features, "transformers")
    snapshots = materialize(g.scoring_input, "scoring-input")
    scored = ml.score_or_fallback(snapshots, fit=lambda m: tables.model_for(m, f"{shared_dir(spark)}/models", ml.fit_classifier))
    anomalies = materialize(sequences.sequence_anomalies(g.stored), "anomalies")
    replaced = scoring.replace_anomaly(scored, anomalies.withColumnRenamed("meter_id", "customer_id"))
    people = scoring.build_explanations(scoring.with_money(scoring.attribute_loss(replaced, stations)))
    people = materialize(scoring.append_peaks(people, anomalies), "people")
    fed = scoring.transformer_components(stations).withColumn("estimated_loss_kwh", F.greatest(F.lit(0.0), "unexplained_total_kwh"))
    made = scoring.union_scores(people, scoring.build_explanations(scoring.with_money(fed), F.lit(1.0)), F.current_timestamp())
    for generation in ("run-1", "run-2"):
        tables.publish_generation(made, f"{base}/scores", generation)
    models = spark.createDataFrame([("run-1", True)], "model_version string, is_active boolean")
    models = tables.register_model(models, models.select(F.lit("run-2").alias("model_version")))
    whole = people.groupBy("transformer_id").agg(F.sum("loss_attribution_share").alias("s")).filter(F.abs(F.col("s") - 1) < 1e-6)
    peaks = F.exists("explanations", lambda e: e["feature"] == PEAK_FEATURE)
    current = tables.published_scores(spark, f"{base}/scores").filter("is_current")
    return current.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(peaks).alias("with_peaks"),
        F.when(F.col("entity_type") == "customer", whole.select(F.count(F.lit(1))).scalar()).otherwise(F.lit(0)).alias("shared"),
        F.bool_and(F.col("risk_tier") == risk_tier("risk_score")).alias("tiered"),
        F.bool_and("is_current").alias("is_current"),
    ).withColumn("model_version", models.filter("is_active").select("model_version").scalar())


@query(
    "m10_register_model",
    """SELECT 'scores-' || strftime(scored_at, '%Y%m%d') AS model_version, FALSE AS is_active, 0 + count(*) AS n FROM v_scores
       WHERE entity_type = 'customer' AND NOT is_current GROUP BY scored_at
       UNION ALL SELECT 'scores-' || strftime(max(scored_at), '%Y%m%d'), TRUE, count(*) FROM v_scores WHERE entity_type = 'customer' AND is_current""",
)
def m10(spark, d):
    runs = Grid(spark, d).scores.filter("entity_type = 'customer'").groupBy("scored_at").agg(F.count(F.lit(1)).alias("n"))
    models = runs.select(
        F.concat(F.lit("scores-"), F.date_format("scored_at", "yyyyMMdd")).alias("model_version"), F.lit(True).alias("is_active"), "n"
    )
    return tables.register_model(models, models.filter("model_version = 'scores-20240201'"))


# ---- T1-T4 ----------------------------------------------------------------------
def _event_stream(spark, d):
    Grid(spark, d)  # pins the session to UTC
    return st.file_stream(spark, f"{d}/events.parquet")


@query(
    "t1_stream_upsert_readings",
    """SELECT user_id AS meter_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS timestamp,
              CAST(arg_max(CAST(round(value * 100) AS BIGINT), event_id) AS DOUBLE) AS consumption_kwh FROM events GROUP BY 1, 2""",
)
def t1(spark, d):
    """Three writes with the events dealt by a hash, one a micro-batch: most rows come after newer ones of their key."""
    Grid(spark, d)  # pins the session to UTC
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").alias("meter_id"), F.date_trunc("hour", "ts").alias("timestamp"),
        cents("value").cast("double").alias("consumption_kwh"), "event_id",
    )
    folder, files = st.arriving(rows, "arriving-events", 3)
    base, keys = work_path(spark, "upsert-stream"), ["meter_id", "timestamp"]
    stream = st.file_stream(spark, folder, files_per_trigger=files)
    st.upsert_stream(stream, f"{base}/table", f"{base}/state", keys, ["consumption_kwh"], "event_id", "timestamp").awaitTermination()
    return spark.read.parquet(f"{base}/table").select("meter_id", stamp("timestamp").alias("timestamp"), "consumption_kwh")


@query(
    "t2_stream_hourly_volume",
    """SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS start, kwh FROM (
         SELECT date_trunc('hour', ts) AS h, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS kwh FROM events GROUP BY 1)
       WHERE h + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)""",
)
def t2(spark, d):
    slices = _event_stream(spark, d).select(F.col("ts").cast("timestamp").alias("timestamp"), cents("value").cast("double").alias("kwh"))
    return st.run_available(st.hourly_volume(slices), "hourly").select(stamp("start").alias("start"), "kwh")


_SIDE = """SELECT date_trunc('day', timestamp) AS day, sum({c}) AS v FROM v_balance GROUP BY 1"""


@query(
    "t3_stream_daily_balance",
    f"""SELECT strftime(day, '%Y-%m-%d') AS day, e.v AS energy_input_kwh, e.v - m.v - t.v AS unexplained_kwh
        FROM ({_SIDE.format(c="energy_input_kwh")}) e JOIN ({_SIDE.format(c="metered_kwh")}) m USING (day) JOIN ({_SIDE.format(c="technical_kwh")}) t USING (day)
        WHERE day + INTERVAL 1 DAY <= (SELECT max(timestamp) - INTERVAL 1 DAY FROM v_balance)""",
)
def t3(spark, d):
    Grid(spark, d)
    price = cents("l_extendedprice")
    sides = {"energy": price * 100, "metered": price * (100 - cents("l_discount")), "technical": price * cents("l_tax")}
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_shipdate").cast("timestamp").alias("timestamp"), *[v.cast("double").alias(name) for name, v in sides.items()]
    )
    folder, files = st.arriving(rows, "arriving-lines", 3, "timestamp")
    streams = [st.file_stream(spark, folder, files_per_trigger=files).select("timestamp", F.col(name).alias("kwh")) for name in sides]
    days = st.run_available(st.daily_balance_stream(*streams), "daily")
    return days.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "energy_input_kwh", "unexplained_kwh")


@query(
    "t4_stream_flatline_alert",
    """SELECT strftime(w, '%Y-%m-%d') AS start, meter_id, count(*) AS n, sum(c) AS s, count(*) FILTER (c < 500) AS zeros,
              (CASE WHEN sum(c) / count(*) > 1e-9 THEN stddev_pop(c) / (sum(c) / count(*)) ELSE 0e0 END) < 0.05e0
                AND count(*) FILTER (c < 500) / count(*) > 0.8e0 AS flatline
       FROM (SELECT user_id AS meter_id, CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS c, ts,
                    unnest(list_transform(range(14), lambda i: date_trunc('day', ts) - i * INTERVAL 1 DAY)) AS w FROM events)
       WHERE w + INTERVAL 14 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""",
)
def t4(spark, d):
    Grid(spark, d)
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").alias("meter_id"), cents("value").cast("double").alias("kwh")
    )
    folder, files = st.arriving(rows, "arriving-readings", 3, "timestamp")
    stream = st.file_stream(spark, folder, files_per_trigger=files)
    alerts = st.run_available(st.flatline_stream(stream, near_zero=500.0), "flat")
    return alerts.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "meter_id", "n", "s", "zeros", "flatline")
