"""Queries over the test tables, each with its SQL where SQL can express it.

No audio lies in those tables, so that rows of theirs stand for clips, samples, detections and frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroframe.functions.columns import clean_numeric, interval_iou, overlap_coefficient, weighted_quantile
from hydroframe.operators import bags, clips, events, frames, grid, model, quality, spectral
from hydroframe.plans import pipeline
from hydroframe.sources import recordings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Frames of a clip at most.
MOST_FRAMES = 512
#: The clip features that lineitem's columns stand for.
CLIP_FEATURES = ["quantity", "price", "discount", "tax"]
NAMES = [f"{f}__{s}" for f in CLIP_FEATURES for s in [*bags.STATISTICS, "missing_fraction"]]
#: An artificial model: median, mean and deviation by input, coefficients by head and position.
ENCODER = [(k, n, 0.5 * k, 10.0 + k, 2.0 + k % 5) for k, n in enumerate(NAMES)]
HEADS = [(h, label, p, ((7 * p + 3 * h) % 11 - 5) / 400.0, 0.1 * h) for h, label in enumerate(model.LABELS) for p in range(2 * len(NAMES))]
#: Priorities of orders stand for sample rates; the last three were in training.
RATES = {"1-URGENT": 44100, "2-HIGH": 48000, "3-MEDIUM": 96000, "4-NOT SPECIFIED": 192000, "5-LOW": 288000}
TRAINING = (96000, 192000, 288000)
FLAGS = {"exact_clipping_min_fraction": 0.0, "near_clipping_min_fraction": 0.001, "large_dc_offset_fraction_full_scale": 0.01, "very_low_rms_dbfs": -60.0, "large_zero_fraction": 0.5, "low_tonal_component_frame_fraction": 0.01, "nonloop_long_duration_seconds": 3.0}


#: The artificial model's identity.
MODEL_ID, MODEL_TYPE, MODEL_SHA256, TRAINED_ON = "artificial", "acoustic_lr", "0" * 64, 234


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _said(code: str) -> str:
    """The SQL of a warning's code and message."""
    return f"'{code}' AS code, '{quality.MESSAGES[code]}' AS message"


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- clips from lineitem -------------------------------------------------------------------------

_CLIPS = """SELECT l_suppkey AS encounter_id, l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS price,
 CASE WHEN l_discount <> 0 THEN l_discount END AS discount, CASE WHEN l_tax <> 0.08 THEN l_tax END AS tax FROM lineitem"""


def _clips(spark, sf):
    """Discounts of 0 are null and taxes of 0.08 are NaN, so that both kinds of missing values occur."""
    tax = F.when(F.col("l_tax") == 0.08, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return _read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("encounter_id"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"), tax.alias("tax"))


@query("p3_clean_numeric", f"SELECT encounter_id, l_orderkey, l_linenumber, discount, tax FROM ({_CLIPS})")
def _(spark, sf):
    return _clips(spark, sf).select("encounter_id", "l_orderkey", "l_linenumber", clean_numeric(F.col("discount")).alias("discount"), clean_numeric(F.col("tax")).alias("tax"))


def _stat_sql(f: str) -> str:
    one = {"mean": "avg({0})", "std": "stddev_pop({0})", "minimum": "min({0})", "q25": "quantile_cont({0}, 0.25)", "median": "quantile_cont({0}, 0.5)", "q75": "quantile_cont({0}, 0.75)", "maximum": "max({0})", "missing_fraction": "1 - count({0}) / count(*)"}
    return ", ".join(f"{sql.format(f)} AS {f}__{s}" for s, sql in one.items())


_BAGS = f"SELECT encounter_id, {', '.join(map(_stat_sql, CLIP_FEATURES))} FROM ({_CLIPS}) GROUP BY encounter_id"


def _bags(spark, sf):
    return bags.bag_statistics(_clips(spark, sf), "encounter_id", CLIP_FEATURES)


@query("b1_bag_statistics", f"SELECT encounter_id, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)} FROM ({_BAGS})")
def _(spark, sf):
    return _bags(spark, sf).select("encounter_id", *[_r(n).alias(n) for n in NAMES])


@query("b5_statistic_subset", f"SELECT encounter_id, round(max(price), 6) AS price__maximum, round(quantile_cont(price, 0.5), 6) AS price__median, round(max(tax), 6) AS tax__maximum, round(quantile_cont(tax, 0.5), 6) AS tax__median FROM ({_CLIPS}) GROUP BY encounter_id")
def _(spark, sf):
    out = bags.bag_statistics(_clips(spark, sf), "encounter_id", ["price", "tax"], ("maximum", "median"), missing_fraction=False)
    return out.select("encounter_id", *[_r(c).alias(c) for c in out.columns[1:]])


_LINE = f"SELECT CASE WHEN l_returnflag = 'R' THEN 'R' END AS encounter_id, quantity, price, discount, tax FROM (SELECT l.l_returnflag, {_CLIPS[7:].replace('FROM lineitem', 'FROM lineitem l')})"


@query("b1_unbounded_bags", f"SELECT encounter_id, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)} FROM (SELECT encounter_id, {', '.join(map(_stat_sql, CLIP_FEATURES))} FROM ({_LINE}) GROUP BY encounter_id)")
def _(spark, sf):
    """Two bags that hold all clips, one of them without a name."""
    flag = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    tax = F.when(F.col("l_tax") == 0.08, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    rows = flag.select(F.when(F.col("l_returnflag") == "R", "R").alias("encounter_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"), tax.alias("tax"))
    return bags.unbounded_bag_statistics(rows, "encounter_id", CLIP_FEATURES).select("encounter_id", *[_r(n).alias(n) for n in NAMES])


_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else repr(x) for x in r) + ")" for r in rows)
_ENC = f"""enc(pos, name, median, mean, sd) AS (VALUES {_VALUES(ENCODER)}),
head(label_idx, label, pos, coef, intercept) AS (VALUES {_VALUES(HEADS)}),
bag AS ({_BAGS}),
long AS (UNPIVOT bag ON COLUMNS(* EXCLUDE (encounter_id)) INTO NAME name VALUE value),
every AS (SELECT b.encounter_id, e.*, l.value FROM bag b CROSS JOIN enc e LEFT JOIN long l ON l.encounter_id = b.encounter_id AND l.name = e.name),
encoded AS (SELECT encounter_id, 2 * pos AS pos, name, (coalesce(value, median) - mean) / sd AS value FROM every
  UNION ALL SELECT encounter_id, 2 * pos + 1, name || '__missing', CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END FROM every),
logit AS (SELECT encounter_id, label_idx, label, sum(coef * value) + first(intercept) AS x FROM encoded JOIN head USING (pos) GROUP BY ALL),
score AS (SELECT encounter_id, label_idx, label, CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END AS score FROM logit)"""


def _model(spark):
    return spark.createDataFrame(ENCODER, "pos int, name string, median double, mean double, sd double"), spark.createDataFrame(HEADS, "label_idx int, label string, pos int, coef double, intercept double")


def _encoded_bags(spark, sf):
    return model.encoded_bags(bags.long_form(_bags(spark, sf), "encounter_id"), "encounter_id", _model(spark)[0])


def _encoded(spark, sf):
    return model.encoded_rows(_encoded_bags(spark, sf), "encounter_id")


def _scores(spark, sf):
    return model.score_bags(_encoded_bags(spark, sf), "encounter_id", _model(spark)[1])


@query("m1_encode_aggregates", f"WITH {_ENC} SELECT encounter_id, pos, name, round(value, 6) AS value FROM encoded")
def _(spark, sf):
    return _encoded(spark, sf).select("encounter_id", "pos", "name", _r("value").alias("value"))


@query("m4_multilabel_scores", f"WITH {_ENC} SELECT encounter_id, label, round(score, 6) AS score FROM score")
def _(spark, sf):
    return _scores(spark, sf).select("encounter_id", "label", _r("score").alias("score"))


@query("r1_rank_labels", f"WITH {_ENC} SELECT encounter_id, label, round(score, 6) AS score, row_number() OVER (PARTITION BY encounter_id ORDER BY score DESC, label_idx) AS rank FROM score")
def _(spark, sf):
    return model.rank_labels(_scores(spark, sf), "encounter_id").select("encounter_id", "label", _r("score").alias("score"), "rank")


_EXTREMES = "extremes AS (SELECT * FROM (SELECT encounter_id, name, value, row_number() OVER (PARTITION BY encounter_id ORDER BY abs(value) DESC, pos) AS ord FROM encoded WHERE pos % 2 = 0 AND abs(value) > 6) WHERE ord <= 10)"


@query("r2_top_extremes", f"WITH {_ENC}, {_EXTREMES} SELECT encounter_id, name, round(value, 4) AS value, ord FROM extremes")
def _(spark, sf):
    return model.top_extremes(_encoded(spark, sf), "encounter_id").select("encounter_id", "name", _r("value", 4).alias("value"), "ord")


@query("q6_extrapolation", f"WITH {_ENC}, {_EXTREMES} SELECT encounter_id, 6 AS ord, {_said('aggregate_feature_extrapolation')} FROM extremes GROUP BY encounter_id")
def _(spark, sf):
    return quality.extrapolation(model.top_extremes(_encoded(spark, sf), "encounter_id")).select("encounter_id", "ord", "code", "message")


def _settings(spark):
    """The settings row as recordings.model_tables gives it, as far as predictions read it."""
    schema = "model_id string, model_type string, artifact_sha256 string, training struct<native_sample_rates_hz: array<int>, encounter_count: int>, score_semantics struct<type: string>"
    return spark.createDataFrame([(MODEL_ID, MODEL_TYPE, MODEL_SHA256, (list(TRAINING), TRAINED_ON), ("uncalibrated",))], schema)


@query("q10_assemble_prediction", f"""WITH {_ENC}, {_EXTREMES},
w AS (SELECT DISTINCT encounter_id, 'aggregate_feature_extrapolation' AS code FROM extremes),
r AS (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY score DESC, label_idx) AS rank FROM score),
t AS (SELECT encounter_id, count(*) AS clip_count, round(sum(quantity), 2) AS total_duration FROM ({_CLIPS}) GROUP BY encounter_id)
SELECT r.encounter_id, 'complete' AS status, max(CASE WHEN rank = 1 THEN label END) AS best, round(max(score), 6) AS best_score, any_value(clip_count) AS clip_count, any_value(total_duration) AS total_duration,
 string_agg(label, '>' ORDER BY rank) AS ranking, round(max(CASE WHEN label = 'Milling' THEN score END), 6) AS milling, coalesce(max(w.code), '') AS warning_codes, CASE WHEN count(w.code) > 0 THEN 'warning' ELSE 'ok' END AS quality_status,
 '{MODEL_ID}' AS model_id, '{MODEL_SHA256}' AS model_sha256, {TRAINED_ON} AS training_encounter_count, 'uncalibrated' AS score_type, '{pipeline.INTERPRETATION["scope"]}' AS scope
FROM r JOIN t USING (encounter_id) LEFT JOIN w USING (encounter_id) GROUP BY r.encounter_id""")
def _(spark, sf):
    encoded = _encoded_bags(spark, sf)
    totals = bags.bag_totals(_clips(spark, sf), "encounter_id", "quantity", "l_linenumber")
    out = pipeline.assemble_predictions(model.score_bags(encoded, "encounter_id", _model(spark)[1]), totals, quality.extrapolation(model.top_extremes(model.encoded_rows(encoded, "encounter_id"), "encounter_id")), _settings(spark))
    best = F.get("ranked", F.lit(0))
    return out.select(
        "encounter_id", "status", best["label"].alias("best"), _r(best["score"]).alias("best_score"), "clip_count", _r("total_duration", 2).alias("total_duration"), F.array_join(F.transform("ranked", lambda x: x["label"]), ">").alias("ranking"),
        _r(F.col("behavior_scores")["Milling"]).alias("milling"), F.array_join(F.transform("warnings", lambda x: x["code"]), ";").alias("warning_codes"), "quality_status", "model.model_id", F.col("model.artifact_sha256").alias("model_sha256"),
        "model.training_encounter_count", "model.score_type", "interpretation.scope",
    )


@query("q1_sparse_evidence", f"SELECT l_orderkey AS encounter_id, 1 AS ord, {_said('sparse_whistle_evidence')} FROM lineitem GROUP BY l_orderkey HAVING count(*) < 3")
def _(spark, sf):
    return quality.sparse_evidence(_read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("encounter_id"))).select("encounter_id", "ord", "code", "message")


# --- sample rates from orders --------------------------------------------------------------------

_RATE = "SELECT o_custkey AS encounter_id, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RATES.items()) + " END AS rate, o_totalprice AS price FROM orders"


def _rates(spark, sf, *others):
    table = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])
    return _read(spark, sf, "orders").select(F.col("o_custkey").alias("encounter_id"), table[F.col("o_orderpriority")].alias("sample_rate_hz"), F.col("o_totalprice").alias("price"), *others)


def _training(spark):
    return spark.createDataFrame([(x,) for x in TRAINING], "sample_rate_hz int")


@query("q2_unseen_rates", f"SELECT encounter_id, {_said('sample_rate_outside_training_regimes')}, list_sort(list(DISTINCT rate)) AS unseen FROM ({_RATE}) WHERE rate NOT IN {TRAINING} GROUP BY encounter_id")
def _(spark, sf):
    rows = _rates(spark, sf)
    told = quality.rate_warnings(rows, _training(spark))
    return told.select("encounter_id", "code", "message").join(quality.unseen_rates(rows, _training(spark)), "encounter_id")


@query("b3_bag_totals", f"SELECT encounter_id, count(*) AS clip_count, round(sum(price), 2) AS total_duration, list_sort(list(DISTINCT rate) FILTER (WHERE rate IS NOT NULL)) AS rates FROM ({_RATE}) GROUP BY encounter_id")
def _(spark, sf):
    return bags.bag_totals(_rates(spark, sf), "encounter_id", "price", "sample_rate_hz").withColumn("total_duration", _r("total_duration", 2))


@query("b3_recording_totals", f"SELECT encounter_id, count(*) AS recording_count, round(sum(price), 2) AS total_recording_duration_seconds FROM ({_RATE}) GROUP BY encounter_id")
def _(spark, sf):
    rows = _rates(spark, sf).withColumn("duration_seconds", F.col("price"))
    return bags.recording_totals(rows, "encounter_id").withColumn("total_recording_duration_seconds", _r("total_recording_duration_seconds", 2))


def _catalog(spark, sf):
    """Orders as a catalog of files; one in 50 was found to be stereo."""
    rows = _rates(spark, sf, "o_orderkey")
    return rows.select("encounter_id", F.col("o_orderkey").alias("path"), "sample_rate_hz", F.when(F.col("o_orderkey") % 50 == 0, "not mono").alias("reason"))


_CATALOG = f"SELECT o_custkey AS encounter_id, o_orderkey AS path, rate, CASE WHEN o_orderkey % 50 = 0 THEN 'not mono' END AS reason FROM ({_RATE.replace('o_totalprice AS price', 'o_orderkey, o_custkey')})"


@query("p1_admit_recordings", f"WITH c AS ({_CATALOG}) SELECT encounter_id, path, rate AS sample_rate_hz FROM c WHERE encounter_id NOT IN (SELECT encounter_id FROM c WHERE reason IS NOT NULL)")
def _(spark, sf):
    return recordings.admit_recordings(_catalog(spark, sf))[0]


@query("p2_admit_clips", f"SELECT encounter_id, path, coalesce(reason, 'sample rate too low for the tonal band') AS reason FROM ({_CATALOG}) WHERE reason IS NOT NULL OR rate / 2 < 40000")
def _(spark, sf):
    return recordings.admit_clips(_catalog(spark, sf), 40_000.0)[1]


# --- waveforms from events -----------------------------------------------------------------------

_SAMPLES = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CAST(least(32767, greatest(-32768, round_even((value - 50) * 327.67, 0))) AS INTEGER) AS x FROM events"


def _samples(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.least(F.lit(32767.0), F.greatest(F.lit(-32768.0), F.rint((F.col("value") - 50) * 327.67))).cast("int")
    return _read(spark, sf, "events").select("user_id", (F.row_number().over(order) - 1).alias("pos"), x.alias("x"))


def _waves(spark, sf):
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return _samples(spark, sf).groupBy("user_id").agg(listed.alias("samples"))


_TOTALS = f"SELECT user_id, max(pos) + 1 AS n, CAST(1 + floor((max(pos) + 1 - 16) / 8) AS BIGINT) AS a FROM ({_SAMPLES}) GROUP BY user_id"
_STARTS = f"""SELECT user_id, unnest(CASE WHEN n < 16 THEN [0::BIGINT] WHEN a <= {MOST_FRAMES} THEN [i * 8 FOR i IN range(0, a)]
 ELSE list_sort(list_distinct([CASE WHEN i = {MOST_FRAMES - 1} THEN n - 16 ELSE CAST(floor(i * ((n - 16)::DOUBLE / {MOST_FRAMES - 1})) AS BIGINT) END FOR i IN range(0, {MOST_FRAMES})])) END) AS first_sample FROM ({_TOTALS})"""


@query("g1_frame_starts", _STARTS)
def _(spark, sf):
    n = _samples(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", F.explode(frames.frame_starts(F.col("n"), 16, 8, MOST_FRAMES)).alias("first_sample"))


@query("g2_sliding_windows", f"SELECT user_id, unnest(CASE WHEN n <= 30 THEN [0::BIGINT] ELSE list_sort(list_distinct(list_concat(range(0, n - 30 + 1, 10), [n - 30]))) END) AS start_sample FROM ({_TOTALS})")
def _(spark, sf):
    n = _samples(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", F.explode(frames.sliding_windows(F.col("n"), 30, 10)).alias("start_sample"))


_FRAMES = f"""SELECT s.user_id, s.first_sample, i, coalesce(w.x, 0) AS x FROM ({_STARTS}) s CROSS JOIN range(0, 16) r(i) LEFT JOIN ({_SAMPLES}) w ON w.user_id = s.user_id AND w.pos = s.first_sample + i"""


def _frames(spark, sf):
    waves = _waves(spark, sf).select("user_id", frames.pcm_to_float(F.col("samples")).alias("samples"))
    return frames.frames(waves, "user_id", "samples", 16, 8, MOST_FRAMES)


@query("g3_frame_samples", f"SELECT user_id, first_sample, round(sum(x / 32768.0), 6) AS total, round(max(x / 32768.0), 6) AS peak, count(*) AS n FROM ({_FRAMES}) GROUP BY ALL")
def _(spark, sf):
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return _frames(spark, sf).select("user_id", "first_sample", _r(total).alias("total"), _r(F.array_max("samples")).alias("peak"), F.size("samples").cast("long").alias("n"))


@query("a2_frame_dynamics", f"""WITH f AS (SELECT user_id, first_sample, sqrt(avg((x / 32768.0) * (x / 32768.0))) AS rms FROM ({_FRAMES}) GROUP BY ALL),
q AS (SELECT user_id, quantile_cont(rms, 0.1) AS a, quantile_cont(rms, 0.5) AS b, quantile_cont(rms, 0.9) AS c, max(rms) AS m FROM f GROUP BY user_id)
SELECT user_id, round(any_value(a), 6) AS rms_q10, round(any_value(b), 6) AS rms_q50, round(any_value(c), 6) AS rms_q90,
 round(any_value(CASE WHEN a > 0 AND c > 0 THEN 10 * log10(c * c / (a * a)) END), 5) AS temporal_dynamic_db, round(avg(CASE WHEN rms < m * 0.01 THEN 1.0 ELSE 0.0 END), 6) AS low_activity_frame_fraction
FROM f JOIN q USING (user_id) GROUP BY user_id""")
def _(spark, sf):
    out = clips.frame_dynamics(_frames(spark, sf).select("user_id", clips.frame_rms(F.col("samples")).alias("rms")), "user_id")
    return out.select("user_id", *[_r(c, 5 if c.endswith("db") else 6).alias(c) for c in out.columns[1:]])


_AMPLITUDE = f"""SELECT user_id, count(*) AS sample_count, sqrt(avg((x / 32768.0) * (x / 32768.0))) AS rms_fraction, avg(x / 32768.0) AS dc_fraction, avg(CASE WHEN abs(x) >= 32767 THEN 1.0 ELSE 0.0 END) AS exact_clipping_fraction,
 avg(CASE WHEN abs(x) >= 0.99 * 32768 THEN 1.0 ELSE 0.0 END) AS near_clipping_fraction, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) AS zero_fraction FROM ({_SAMPLES}) GROUP BY user_id"""


@query("a1_amplitude_stats", f"SELECT user_id, sample_count, {', '.join(f'round({c}, 6) AS {c}' for c in ('rms_fraction', 'dc_fraction', 'exact_clipping_fraction', 'near_clipping_fraction', 'zero_fraction'))}, round(20 * log10(greatest(rms_fraction, 2.2250738585072014e-308)), 5) AS rms_dbfs FROM ({_AMPLITUDE})")
def _(spark, sf):
    out = clips.amplitude_stats(_samples(spark, sf), "user_id", "x", 0.99)
    return out.select("user_id", "sample_count", *[_r(c).alias(c) for c in out.columns if c.endswith("fraction")], _r("rms_dbfs", 5).alias("rms_dbfs"))


@query("a4_quality_flags", f"""SELECT user_id, concat_ws(';', CASE WHEN exact_clipping_fraction > 0 THEN 'exact_clipping_detected' END, CASE WHEN near_clipping_fraction >= 0.001 THEN 'near_clipping_ge_threshold' END,
 CASE WHEN abs(dc_fraction) >= 0.01 THEN 'large_dc_offset' END, CASE WHEN 20 * log10(rms_fraction) <= -60 THEN 'very_low_rms' END, CASE WHEN zero_fraction >= 0.5 THEN 'large_zero_fraction' END,
 CASE WHEN zero_fraction < 0.01 THEN 'low_tonal_component_coverage' END, CASE WHEN sample_count / 20.0 > 3 THEN 'nonloop_duration_gt_3s' END) AS flags FROM ({_AMPLITUDE})""")
def _(spark, sf):
    rows = clips.amplitude_stats(_samples(spark, sf), "user_id", "x", 0.99).withColumn("core_tonal_component_frame_fraction", F.col("zero_fraction")).withColumn("duration_seconds", F.col("sample_count") / 20.0)
    return rows.select("user_id", F.array_join(clips.quality_flags(FLAGS), ";").alias("flags"))


#: Settings of the records: frames of 16 samples every 8, as in the other queries.
AUDIT = {
    "window_seconds": 0.016, "hop_fraction": 0.5, "max_frames_per_clip": MOST_FRAMES, "tonal_smoothing_time_sigma_frames": 0.8, "tonal_smoothing_frequency_sigma_bins": 1.0, "tonal_local_baseline_width_hz": 200.0,
    "tonal_salience_threshold_db": 3.0, "core_tonal_lower_hz": 20.0, "core_tonal_upper_hz": 400.0, "tonal_minimum_duration_seconds": 0.01,
}
RECORD_RATE = 1000


@query("a5_clip_features", f"""WITH f AS (SELECT user_id, first_sample, sqrt(avg((x / 32768.0) * (x / 32768.0))) AS rms FROM ({_FRAMES}) GROUP BY ALL),
q AS (SELECT user_id, quantile_cont(rms, 0.1) AS a, quantile_cont(rms, 0.9) AS c, max(rms) AS m FROM f GROUP BY user_id),
d AS (SELECT user_id, any_value(CASE WHEN a > 0 AND c > 0 THEN 10 * log10(c * c / (a * a)) END) AS dynamic, avg(CASE WHEN rms < m * 0.01 THEN 1.0 ELSE 0.0 END) AS low FROM f JOIN q USING (user_id) GROUP BY user_id)
SELECT user_id AS path, sample_count, sample_count / 1000.0::DOUBLE AS duration_seconds, round(20 * log10(greatest(rms_fraction, 2.2250738585072014e-308)), 5) AS rms_dbfs, round(dc_fraction, 6) AS dc_fraction, round(exact_clipping_fraction, 6) AS exact_clipping_fraction,
 round(near_clipping_fraction, 6) AS near_clipping_fraction, round(zero_fraction, 6) AS zero_fraction, round(dynamic, 5) AS temporal_dynamic_db, round(low, 6) AS low_activity_frame_fraction FROM ({_AMPLITUDE}) JOIN d USING (user_id)""")
def _(spark, sf):
    """A user's samples as a clip's bytes, and the record of it from one step."""
    word = F.lpad(F.hex(F.col("x").bitwiseAND(0xFFFF)), 4, "0")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.substring(word, 3, 2), F.substring(word, 1, 2)).alias("w"))))
    bag = _samples(spark, sf).groupBy(F.col("user_id").alias("path")).agg(F.unhex(F.array_join(F.transform(listed, lambda s: s["w"]), "")).alias("pcm"), F.count(F.lit(1)).alias("sample_count"))
    out = pipeline.clip_features(bag.withColumn("sample_rate_hz", F.lit(RECORD_RATE)), RECORD_RATE, AUDIT, FLAGS | {"near_clipping_amplitude_fraction": 0.99})
    shown = ("rms_dbfs", "dc_fraction", "exact_clipping_fraction", "near_clipping_fraction", "zero_fraction", "temporal_dynamic_db", "low_activity_frame_fraction")
    return out.select("path", "sample_count", "duration_seconds", *[_r(c, 5 if c.startswith("rms") or c.endswith("db") else 6).alias(c) for c in shown])


_PAD = f"""SELECT e.event_id, e.user_id, t.n, CAST(greatest(0, floor(greatest(0.0, e.p - 2.5) * 1.0)) AS BIGINT) AS first_sample, CAST(least(t.n, ceil(least(t.n::DOUBLE, e.p + 1 + 2.5))) AS BIGINT) AS stop_sample
FROM (SELECT event_id, user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS p FROM events) e JOIN ({_TOTALS}) t USING (user_id)"""


def _padded(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _read(spark, sf, "events").select("event_id", "user_id", "value", (F.row_number().over(order) - 1).cast("double").alias("start_s"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("sample_count"))
    rows = rows.withColumn("end_s", F.col("start_s") + 1).withColumn("duration_seconds", F.col("sample_count").cast("double")).withColumn("sample_rate_hz", F.lit(1))
    return frames.pad_and_clip(rows, 2.5)


@query("e11_pad_and_clip", f"SELECT event_id, first_sample, stop_sample FROM ({_PAD}) WHERE stop_sample > first_sample")
def _(spark, sf):
    return _padded(spark, sf).select("event_id", "first_sample", "stop_sample")


@query("s10_extract_clips", f"SELECT p.event_id, count(*) AS samples, sum(CASE WHEN w.x < 0 THEN w.x + 65536 ELSE w.x END)::BIGINT AS total, sha256(string_agg(lpad(hex(CASE WHEN w.x < 0 THEN w.x + 65536 ELSE w.x END), 4, '0'), '' ORDER BY w.pos)) AS words FROM ({_PAD}) p JOIN ({_SAMPLES}) w ON w.user_id = p.user_id AND w.pos >= p.first_sample AND w.pos < p.stop_sample GROUP BY p.event_id")
def _(spark, sf):
    size = 8
    word = F.lpad(F.hex(F.col("x").bitwiseAND(0xFFFF)), 4, "0")
    low_first = F.unhex(F.concat(F.substring(word, 3, 2), F.substring(word, 1, 2)))
    chunk = F.aggregate(F.sort_array(F.collect_list(F.struct("pos", low_first.alias("b")))), F.lit(b"").cast("binary"), lambda a, s: F.concat(a, s["b"]))
    chunks = _samples(spark, sf).groupBy(F.col("user_id").alias("recording_id"), F.floor(F.col("pos") / size).alias("chunk_no")).agg(chunk.alias("pcm"))
    asked = _padded(spark, sf).select("event_id", F.col("user_id").alias("recording_id"), "first_sample", "stop_sample")
    cut = frames.extract_clips(asked, chunks, size)
    n = F.floor(F.octet_length("pcm") / 2).cast("int")
    words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.hex(F.substring("pcm", 2 * i + 2, F.lit(1))), F.hex(F.substring("pcm", 2 * i + 1, F.lit(1)))))
    out = cut.select("event_id", n.cast("long").alias("samples"), words.alias("w"))
    return out.select("event_id", "samples", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.conv(x, 16, 10).cast("long")).alias("total"), F.sha2(F.array_join("w", ""), 256).alias("words"))


# --- detections from events ----------------------------------------------------------------------

_DET = """SELECT user_id AS recording_id, event_id AS seq, epoch_us(ts) / 1e6 AS start_s, epoch_us(ts) / 1e6 + value * 600 AS end_s, (1000 + 100 * k)::DOUBLE AS fmin, (4000 + 100 * k)::DOUBLE AS fmax, 0.5::DOUBLE + (k % 50) / 100.0::DOUBLE AS confidence, event_id % 7 AS win
FROM (SELECT *, CAST(props->>'k' AS INTEGER) AS k FROM events)"""


def _detections(spark, sf):
    rows = _read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return rows.select(
        F.col("user_id").alias("recording_id"), F.col("event_id").alias("seq"), start.alias("start_s"), (start + F.col("value") * 600).alias("end_s"), (1000.0 + 100 * F.col("k")).alias("fmin_hz"), (4000.0 + 100 * F.col("k")).alias("fmax_hz"),
        (0.5 + (F.col("k") % 50) / 100.0).alias("confidence"), F.array((F.col("event_id") % 7).cast("int")).alias("windows"), F.lit(1).alias("raw_count"),
    )


_ISLANDS = f"""SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_s, confidence DESC, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (
 SELECT *, CASE WHEN start_s - max(end_s) OVER (PARTITION BY recording_id ORDER BY start_s, confidence DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.04 THEN 0 ELSE 1 END AS new FROM ({_DET}))"""


@query("e8_islands", f"SELECT recording_id, seq, island FROM ({_ISLANDS})")
def _(spark, sf):
    return events.islands(_detections(spark, sf), 0.04).select("recording_id", "seq", "island")


@query("e7_association_pairs", f"""WITH d AS ({_DET}), p AS (SELECT a.recording_id, a.seq AS seq_a, b.seq AS seq_b,
 greatest(0, least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) AS i, greatest(a.end_s, b.end_s) - least(a.start_s, b.start_s) AS u, least(a.end_s - a.start_s, b.end_s - b.start_s) AS s,
 greatest(0, least(a.fmax, b.fmax) - greatest(a.fmin, b.fmin)) / (greatest(a.fmax, b.fmax) - least(a.fmin, b.fmin)) AS f, greatest(0, greatest(a.start_s, b.start_s) - least(a.end_s, b.end_s)) AS gap
 FROM d a JOIN d b ON a.recording_id = b.recording_id AND a.seq < b.seq AND a.win <> b.win AND greatest(a.start_s, b.start_s) - least(a.end_s, b.end_s) < 1)
SELECT recording_id, seq_a, seq_b, round(2 * CASE WHEN u > 0 THEN i / u ELSE 0 END + CASE WHEN s > 0 THEN i / s ELSE 0 END + f - gap, 5) AS score FROM p
WHERE ((u > 0 AND i / u >= 0.25) OR (s > 0 AND i / s >= 0.55) OR gap <= 0.04) AND f >= 0.10""")
def _(spark, sf):
    return events.association_pairs(_detections(spark, sf)).withColumn("score", _r("score", 5))


def _merge_sql() -> str:
    """Detections of an island one after the other: each joins the best fitting event, of equals the last, or opens one."""
    both, span = "greatest(0, least(d.end_s, x.e) - greatest(d.start_s, x.s))", "(greatest(d.end_s, x.e) - least(d.start_s, x.s))"
    short, gap = "least(d.end_s - d.start_s, x.e - x.s)", "greatest(0, greatest(d.start_s, x.s) - least(d.end_s, x.e))"
    shared_f = "(greatest(0, least(d.fmax, x.hi) - greatest(d.fmin, x.lo)) / (greatest(d.fmax, x.hi) - least(d.fmin, x.lo)))"
    iou, overlap = f"(CASE WHEN {span} > 0 THEN {both} / {span} ELSE 0 END)", f"(CASE WHEN {short} > 0 THEN {both} / {short} ELSE 0 END)"
    fit = f"CASE WHEN NOT list_contains(x.wins, d.win) AND {shared_f} >= 0.10 AND ({iou} >= 0.25 OR {overlap} >= 0.55 OR {gap} <= 0.04) THEN 2 * {iou} + {overlap} + {shared_f} - {gap} END"
    one = "{'lo': fmin, 'hi': fmax, 'w': confidence}"
    opened = f"{{'s': start_s, 'e': end_s, 'lo': fmin, 'hi': fmax, 'c': confidence, 'wins': [win], 'm': [{one}], 'fc': confidence, 'fs': seq}}"

    def median(field: str) -> str:
        each = f"list_sort(list_transform(list_append(x.m, {one}), lambda q: {{'v': q.{field}, 'w': q.w}}))"
        return f"list_filter({each}, lambda q, i: list_sum(list_transform({each}[1:i], lambda y: y.w)) >= list_sum(list_transform({each}, lambda y: y.w)) / 2)[1].v"

    grown = f"{{'s': least(x.s, start_s), 'e': greatest(x.e, end_s), 'lo': {median('lo')}, 'hi': {median('hi')}, 'c': greatest(x.c, confidence), 'wins': list_append(x.wins, win), 'm': list_append(x.m, {one}), 'fc': x.fc, 'fs': x.fs}}"
    return f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY recording_id, island ORDER BY start_s, confidence DESC, seq) AS r FROM ({_ISLANDS})),
g AS (SELECT recording_id, island, r, [{opened}] AS k FROM d WHERE r = 1
 UNION ALL SELECT recording_id, island, r, CASE WHEN best IS NULL THEN list_append(k, {opened}) ELSE list_transform(k, lambda x, i: CASE WHEN i = best THEN {grown} ELSE x END) END
 FROM (SELECT *, list_sort(list_filter(list_transform(fits, lambda f, i: {{'f': f, 'i': i}}), lambda q: q.f IS NOT NULL))[-1].i AS best
  FROM (SELECT d.*, g.k, list_transform(g.k, lambda x: {fit}) AS fits FROM g JOIN d ON d.recording_id = g.recording_id AND d.island = g.island AND d.r = g.r + 1)))
SELECT recording_id, round(x.s, 6) AS start_s, round(x.e, 6) AS end_s, round(x.lo, 6) AS fmin_hz, round(x.hi, 6) AS fmax_hz, round(x.c, 6) AS confidence, list_sort(x.wins)::INTEGER[] AS windows, len(x.m) AS raw_count,
 'W' || lpad(row_number() OVER (PARTITION BY recording_id ORDER BY x.s, x.fc DESC, x.fs)::VARCHAR, 4, '0') AS event_id
FROM (SELECT recording_id, unnest(k) AS x FROM (SELECT recording_id, island, arg_max(k, r) AS k FROM g GROUP BY ALL))"""


@query("e8_merge_events", _merge_sql())
def _(spark, sf):
    out = events.merge_events(_detections(spark, sf))
    return out.withColumns({c: _r(c) for c in ("start_s", "end_s", "fmin_hz", "fmax_hz", "confidence")})


@query("e3_interval_similarity", f"""WITH d AS (SELECT *, lead(start_s) OVER w AS b0, lead(end_s) OVER w AS b1 FROM ({_DET}) WINDOW w AS (PARTITION BY recording_id ORDER BY seq))
SELECT recording_id, seq, round(CASE WHEN greatest(end_s, b1) - least(start_s, b0) > 0 THEN greatest(0, least(end_s, b1) - greatest(start_s, b0)) / (greatest(end_s, b1) - least(start_s, b0)) ELSE 0 END, 6) AS iou,
 round(CASE WHEN least(greatest(0, end_s - start_s), greatest(0, b1 - b0)) > 0 THEN greatest(0, least(end_s, b1) - greatest(start_s, b0)) / least(greatest(0, end_s - start_s), greatest(0, b1 - b0)) ELSE 0 END, 6) AS overlap, round(greatest(0, end_s - start_s), 6) AS duration_s
FROM d WHERE b0 IS NOT NULL""")
def _(spark, sf):
    w = Window.partitionBy("recording_id").orderBy("seq")
    rows = _detections(spark, sf).withColumn("b0", F.lead("start_s").over(w)).withColumn("b1", F.lead("end_s").over(w)).where("b0 IS NOT NULL")
    args = [F.col(c) for c in ("start_s", "end_s", "b0", "b1")]
    return rows.select("recording_id", "seq", _r(interval_iou(*args)).alias("iou"), _r(overlap_coefficient(*args)).alias("overlap"), _r(F.greatest(F.lit(0.0), args[1] - args[0])).alias("duration_s"))


@query("t10_weighted_quantile", f"""SELECT recording_id, min(CASE WHEN c >= 0.5 * t THEN fmin END) AS fmin_median FROM (SELECT recording_id, fmin, sum(round(100 * confidence)) OVER (PARTITION BY recording_id ORDER BY fmin ROWS UNBOUNDED PRECEDING) AS c, sum(round(100 * confidence)) OVER (PARTITION BY recording_id) AS t FROM ({_DET})) GROUP BY recording_id""")
def _(spark, sf):
    rows = _detections(spark, sf).withColumn("weight", F.rint(100 * F.col("confidence")))  # whole numbers add up alike in any order
    return weighted_quantile(rows, ["recording_id"], "fmin_hz", "weight", 0.5, "fmin_median")


@query("e13_clip_names", f"SELECT seq, 'R' || lpad(CAST(dense_rank() OVER (PARTITION BY recording_id // 100 ORDER BY recording_id) AS VARCHAR), 4, '0') || '_W' || lpad(CAST(row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS VARCHAR), 4, '0') AS clip FROM ({_DET})")
def _(spark, sf):
    rows = _detections(spark, sf)
    recordings = frames.source_index(rows.select("recording_id").distinct().withColumn("encounter_id", F.floor(F.col("recording_id") / 100)).withColumn("path", F.lpad(F.col("recording_id").cast("string"), 20, "0")), "encounter_id", "path")
    named = rows.withColumn("event_id", F.format_string("W%04d", F.row_number().over(Window.partitionBy("recording_id").orderBy("seq"))))
    return named.join(recordings, "recording_id").select("seq", frames.clip_name(F.col("source_index"), F.col("event_id")).alias("clip"))


def _boxes(spark, sf):
    """Ten samples of a recording are a window; x, y, w, h and confidence come from an event's k."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _read(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), (F.row_number().over(order) - 1).alias("pos"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("total_samples"))
    k = F.col("k")
    return rows.select(
        F.col("user_id").alias("recording_id"), "seq", F.floor(F.col("pos") / 10).cast("int").alias("window_index"), "total_samples", (k / 100.0).alias("x"), ((k * 7 % 100) / 100.0).alias("y"), (0.05 + (k % 10) / 20.0).alias("w"), (0.1 + (k % 5) / 10.0).alias("h"),
        (0.2 + (k % 50) / 70.0).alias("confidence"), (F.floor(F.col("pos") / 10) * 10).alias("start_sample"), F.least(F.lit(10), F.col("total_samples") - F.floor(F.col("pos") / 10) * 10).alias("valid_samples"), F.lit(10).alias("sample_rate_hz"), F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), F.lit(0.0).alias("f0"), F.lit(30000.0).alias("f1"),
    )


_BOX = """SELECT user_id AS recording_id, event_id AS seq, k, total, pos // 10 * 10 AS s, least(10, total - pos // 10 * 10) AS valid, k / 100.0::DOUBLE AS x, (k * 7 % 100) / 100.0::DOUBLE AS y, 0.05::DOUBLE + (k % 10) / 20.0::DOUBLE AS w, 0.1::DOUBLE + (k % 5) / 10.0::DOUBLE AS h
FROM (SELECT *, CAST(props->>'k' AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS total FROM events)"""


@query("e1_boxes_to_intervals", f"""WITH b AS (SELECT *, greatest(0, least(total - 1, s + CAST(round_even(greatest(0, least(valid / 10.0::DOUBLE, greatest(0.0, x - w / 2))) * 10, 0) AS BIGINT))) AS a, s + CAST(round_even(greatest(0, least(valid / 10.0::DOUBLE, least(1.0, x + w / 2))) * 10, 0) AS BIGINT) AS e FROM ({_BOX}))
SELECT recording_id, seq, a AS event_start, greatest(a + 1, least(total, e)) AS event_end, round(30000 - least(1.0, y + h / 2) * 30000, 4) AS fmin_hz, round(30000 - greatest(0.0, y - h / 2) * 30000, 4) AS fmax_hz FROM b""")
def _(spark, sf):
    return events.boxes_to_intervals(_boxes(spark, sf)).select("recording_id", "seq", "event_start", "event_end", _r("fmin_hz", 4).alias("fmin_hz"), _r("fmax_hz", 4).alias("fmax_hz"))


_BOUNDS = f"""SELECT recording_id, win, min(start_s) AS start_s, max(end_s) AS end_s, min(CASE WHEN a >= 0.5 * t THEN fmin END) AS fmin_hz, min(CASE WHEN b >= 0.5 * t THEN fmax END) AS fmax_hz FROM (
 SELECT *, sum(round(100 * confidence)) OVER (PARTITION BY recording_id, win ORDER BY fmin) AS a, sum(round(100 * confidence)) OVER (PARTITION BY recording_id, win ORDER BY fmax) AS b, sum(round(100 * confidence)) OVER (PARTITION BY recording_id, win) AS t FROM ({_DET})) GROUP BY recording_id, win"""


def _bounds(spark, sf):
    """A recording's detections of one window as an event; whole numbers as weights add up alike in any order."""
    rows = _detections(spark, sf).withColumn("win", F.get("windows", F.lit(0))).withColumn("confidence", F.rint(100 * F.col("confidence")))
    return events.event_bounds(rows, ["recording_id", "win"])


@query("e6_event_bounds", f"SELECT recording_id, CAST(win AS INTEGER) AS win, start_s, end_s, fmin_hz, fmax_hz FROM ({_BOUNDS})")
def _(spark, sf):
    return _bounds(spark, sf)


@query("e9_number_events", f"SELECT recording_id, CAST(win AS INTEGER) AS win, 'W' || lpad(CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_s, win) AS VARCHAR), 4, '0') AS event_id FROM ({_BOUNDS})")
def _(spark, sf):
    return events.number_events(_bounds(spark, sf), "win").select("recording_id", "win", "event_id")


_ADMITTED = f"""WITH RECURSIVE b AS (SELECT *, x - w / 2 AS x0, x + w / 2 AS x1, y - h / 2 AS y0, y + h / 2 AS y1, row_number() OVER (PARTITION BY recording_id, s ORDER BY confidence DESC, seq) AS r
 FROM (SELECT *, 0.2::DOUBLE + (k % 50) / 70.0::DOUBLE AS confidence FROM ({_BOX})) WHERE confidence >= 0.25),
g AS (SELECT recording_id, s, 0::BIGINT AS r, [{{'seq': 0::BIGINT, 'x0': 9.0::DOUBLE, 'x1': 9.0::DOUBLE, 'y0': 9.0::DOUBLE, 'y1': 9.0::DOUBLE}}] AS kept FROM b WHERE r = 1
 UNION ALL SELECT g.recording_id, g.s, b.r, CASE WHEN len(list_filter(g.kept, lambda q: greatest(0, least(q.x1, b.x1) - greatest(q.x0, b.x0)) * greatest(0, least(q.y1, b.y1) - greatest(q.y0, b.y0))
  > 0.7 * ((q.x1 - q.x0) * (q.y1 - q.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(q.x1, b.x1) - greatest(q.x0, b.x0)) * greatest(0, least(q.y1, b.y1) - greatest(q.y0, b.y0))))) > 0
  THEN g.kept ELSE list_append(g.kept, {{'seq': b.seq, 'x0': b.x0, 'x1': b.x1, 'y0': b.y0, 'y1': b.y1}}) END
 FROM g JOIN b ON b.recording_id = g.recording_id AND b.s = g.s AND b.r = g.r + 1),
ids AS (SELECT recording_id, unnest(kept).seq AS seq, unnest(kept).x0 AS x0 FROM (SELECT recording_id, s, arg_max(kept, r) AS kept FROM g GROUP BY ALL))"""


@query("e2_detections", f"""{_ADMITTED}, e AS (SELECT *, greatest(0, least(total - 1, s + CAST(round_even(greatest(0, least(valid / 10.0::DOUBLE, greatest(0.0, x0))) * 10, 0) AS BIGINT))) AS a, s + CAST(round_even(greatest(0, least(valid / 10.0::DOUBLE, least(1.0, x1))) * 10, 0) AS BIGINT) AS z FROM b)
SELECT recording_id, seq, a / 10.0::DOUBLE AS start_s, greatest(a + 1, least(total, z)) / 10.0::DOUBLE AS end_s, round(greatest(0, least(30000, 30000 - least(1.0, y1) * 30000)), 4) AS fmin_hz, round(greatest(0, least(30000, 30000 - greatest(0.0, y0) * 30000)), 4) AS fmax_hz,
 round(confidence, 6) AS confidence, [CAST(s // 10 AS INTEGER)] AS windows, 1 AS raw_count FROM e SEMI JOIN (SELECT * FROM ids WHERE x0 < 9) USING (recording_id, seq)""")
def _(spark, sf):
    """Boxes that are admitted, with their windows by a join."""
    rows = _boxes(spark, sf)
    windows = rows.select("recording_id", "window_index", "start_sample", "valid_samples", "total_samples", "sample_rate_hz", "t0", "t1", "f0", "f1").distinct()
    boxes = events.admit_boxes(rows.select("recording_id", "window_index", "seq", "x", "y", "w", "h", "confidence"))
    out = events.detections(events.boxes_to_intervals(events.windows_with_boxes(windows, boxes)), 30_000.0)
    return out.withColumns({"fmin_hz": _r("fmin_hz", 4), "fmax_hz": _r("fmax_hz", 4), "confidence": _r("confidence")})


@query("p10_admit_boxes", f"{_ADMITTED} SELECT recording_id, CAST(s // 10 AS INTEGER) AS window_index, seq, round(confidence, 6) AS confidence FROM b SEMI JOIN (SELECT * FROM ids WHERE x0 < 9) USING (recording_id, seq)")
def _(spark, sf):
    return events.admit_boxes(_boxes(spark, sf)).select("recording_id", "window_index", "seq", _r("confidence").alias("confidence"))


_STATUS = """SELECT u.user_id AS encounter_id, CASE WHEN r.user_id IS NOT NULL THEN 'failed' WHEN e.n IS NULL THEN 'no_whistles_detected' ELSE 'complete' END AS status, r.error, coalesce(e.n, 0) AS clip_count
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE value > 200 GROUP BY user_id) e USING (user_id)
LEFT JOIN (SELECT user_id, 'sample rate too low' AS error FROM events WHERE value < 0.02 GROUP BY user_id) r ON r.user_id = u.user_id"""


def _status(spark, sf):
    rows = _read(spark, sf, "events").select(F.col("user_id").alias("encounter_id"), "value")
    rejects = rows.where("value < 0.02").select("encounter_id", F.lit("sample rate too low").alias("reason"))
    return quality.encounter_status(rows, rejects, rows.where("value > 200"))


@query("q9_encounter_status", _STATUS)
def _(spark, sf):
    return _status(spark, sf)


@query("q8_empty_results", f"SELECT encounter_id, status, 'insufficient_evidence' AS quality_status, 1 AS warning_count, '{quality.EMPTY_CODE}' AS code, '{quality.EMPTY_MESSAGE}' AS message, 0 AS ranks FROM ({_STATUS}) WHERE status = 'no_whistles_detected'")
def _(spark, sf):
    first = F.get("warnings", F.lit(0))
    return quality.empty_results(_status(spark, sf)).select("encounter_id", "status", "quality_status", "warning_count", first["code"].alias("code"), first["message"].alias("message"), F.size("ranked").alias("ranks"))


@query("s9_flat_rows", f"""SELECT s.encounter_id, s.status, l.rank, l.behavior, l.score, s.clip_count AS whistle_clip_count, CASE WHEN s.status = 'complete' THEN 'ok' ELSE 'insufficient_evidence' END AS quality_status, CASE WHEN s.status = 'complete' THEN '' ELSE 'no_whistles_detected' END AS warning_codes, '{MODEL_ID}' AS model_id, '{MODEL_SHA256}' AS model_sha256
FROM ({_STATUS}) s LEFT JOIN (VALUES (1, 'Feeding', 0.75::DOUBLE), (2, 'Milling', 0.5::DOUBLE)) l(rank, behavior, score) ON s.status = 'complete' WHERE s.status <> 'failed'""")
def _(spark, sf):
    rows = _status(spark, sf).where("status <> 'failed'")
    done = F.col("status") == "complete"
    results = rows.select("encounter_id", "status", "clip_count", F.when(done, "ok").otherwise("insufficient_evidence").alias("quality_status"), F.when(done, F.array().cast("array<string>")).otherwise(F.array(F.lit("no_whistles_detected"))).alias("warning_codes"), F.lit(MODEL_ID).alias("model_id"), F.lit(MODEL_SHA256).alias("model_sha256"))
    labels = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(n).alias("label"), F.lit(s).alias("score")) for k, n, s in ((1, "Feeding", 0.75), (2, "Milling", 0.5))])
    return quality.flat_rows(results, rows.where(done).select("encounter_id", F.explode(labels).alias("x")).select("encounter_id", "x.*"))


# --- files from documents ------------------------------------------------------------------------

#: An encounter's files lie in a range of so many identifiers, so that none grows with the table.
ENCOUNTER_FILES = 50


def _files(spark, sf, encounter: Column | None = None):
    if encounter is None:
        encounter = F.concat("lang", F.lit(":"), F.floor(F.col("doc_id") / ENCOUNTER_FILES).cast("string"))
    return _read(spark, sf, "documents").select(encounter.alias("encounter_id"), F.format_string("D%08d", "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id")


_FILE = f"SELECT lang || ':' || CAST(doc_id // {ENCOUNTER_FILES} AS VARCHAR) AS encounter_id, 'D' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, sha256(text) AS sha256, doc_id FROM documents"


@query("s4_content_hash", f"SELECT path, sha256 FROM ({_FILE})")
def _(spark, sf):
    return _files(spark, sf).select("path", "sha256")


@query("p7_resolve_encounter_id", "SELECT doc_id, nullif(trim(CASE WHEN doc_id % 3 = 0 OR lang = '' OR lang IS NULL THEN source ELSE lang END), '') AS encounter_id FROM documents")
def _(spark, sf):
    given = F.when(F.col("doc_id") % 3 != 0, F.col("lang")).otherwise("")
    return _read(spark, sf, "documents").select("doc_id", bags.resolve_encounter_id(given, F.col("source")).alias("encounter_id"))


@query("b4_bag_fingerprint", f"SELECT encounter_id, sha256(string_agg(path || chr(9) || sha256 || chr(10), '' ORDER BY lower(path), path)) AS input_set_sha256 FROM ({_FILE}) GROUP BY encounter_id")
def _(spark, sf):
    return bags.bag_fingerprint(_files(spark, sf), "encounter_id", "path", "sha256")


#: A language's files are one encounter: copies may lie anywhere in the table.
_LANGUAGE_FILE = "SELECT lang AS encounter_id, 'D' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, sha256(text) AS sha256, doc_id FROM documents"


@query("q5_duplicate_content", f"SELECT encounter_id, {_said('duplicate_audio_content')}, list(path ORDER BY path) AS affected_files FROM (SELECT *, count(*) OVER (PARTITION BY encounter_id, sha256) AS n FROM ({_LANGUAGE_FILE})) WHERE n > 1 GROUP BY encounter_id")
def _(spark, sf):
    return quality.duplicate_content(_files(spark, sf, F.col("lang"))).select("encounter_id", "code", "message", "affected_files")


_FLAGGED = f"SELECT f.*, coalesce(l.toxic, 0) = 0 AS found, l.quality, l.toxic FROM ({_FILE}) f LEFT JOIN labels l USING (doc_id)"


def _flagged(spark, sf):
    rows = _files(spark, sf).join(_read(spark, sf, "labels"), "doc_id", "left")
    marks = F.filter(F.array(F.when(F.col("quality") == 0, "very_low_rms"), F.when(F.col("toxic") == 1, "large_dc_offset")), lambda x: x.isNotNull())
    return rows.select("encounter_id", "path", "sha256", (F.coalesce("toxic", F.lit(0)) == 0).alias("core_tonal_component_found"), marks.alias("quality_flags"))


@query("q3_missing_component", f"SELECT encounter_id, {_said('core_tonal_component_not_found')}, list(path ORDER BY path) AS affected_files FROM ({_FLAGGED}) WHERE NOT found GROUP BY encounter_id")
def _(spark, sf):
    return quality.missing_component(_flagged(spark, sf)).select("encounter_id", "code", "message", "affected_files")


@query("q4_flag_warnings", f"SELECT encounter_id, 'audio_quality:' || flag AS code, 'The descriptive audio-quality flag ''' || flag || ''' was raised.' AS message, list(path ORDER BY path) AS affected_files FROM (SELECT *, 'very_low_rms' AS flag FROM ({_FLAGGED}) WHERE quality = 0 UNION ALL SELECT *, 'large_dc_offset' FROM ({_FLAGGED}) WHERE toxic = 1) GROUP BY encounter_id, flag")
def _(spark, sf):
    return quality.flag_warnings(_flagged(spark, sf)).select("encounter_id", "code", "message", "affected_files")


@query("p8_clip_details", f"""SELECT encounter_id, count(*) AS clips, sha256(string_agg(path || ':' || coalesce(sha256, '') || ':' || CASE WHEN found THEN '1' ELSE '0' END || ':' || concat_ws(',', CASE WHEN quality = 0 THEN 'very_low_rms' END, CASE WHEN toxic = 1 THEN 'large_dc_offset' END), ';' ORDER BY path)) AS details FROM ({_FLAGGED}) GROUP BY encounter_id""")
def _(spark, sf):
    rows = _flagged(spark, sf).withColumns({"sample_rate_hz": F.lit(96_000), "sample_count": F.length("path"), "duration_seconds": F.length("path") / 96_000})
    told = lambda x: F.concat_ws(":", x["path"], F.coalesce(x["sha256"], F.lit("")), F.when(x["core_tonal_component_found"], "1").otherwise("0"), F.array_join(x["quality_flags"], ","))
    listed = F.transform("clip_details", told)
    return quality.clip_details(rows).select("encounter_id", F.size("clip_details").cast("long").alias("clips"), F.sha2(F.array_join(listed, ";"), 256).alias("details"))


@query("q7_quality_summary", f"""WITH f AS ({_FLAGGED}), w AS (SELECT encounter_id, 'core_tonal_component_not_found' AS code FROM f WHERE NOT found GROUP BY 1 UNION ALL SELECT encounter_id, 'audio_quality:very_low_rms' FROM f WHERE quality = 0 GROUP BY 1
 UNION ALL SELECT encounter_id, 'audio_quality:large_dc_offset' FROM f WHERE toxic = 1 GROUP BY 1 UNION ALL SELECT encounter_id, 'duplicate_audio_content' FROM (SELECT encounter_id, sha256 FROM f GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT e.encounter_id, CASE WHEN count(w.code) > 0 THEN 'warning' ELSE 'ok' END AS quality_status, count(w.code) AS warning_count FROM (SELECT DISTINCT encounter_id FROM f) e LEFT JOIN w USING (encounter_id) GROUP BY e.encounter_id""")
def _(spark, sf):
    rows = _flagged(spark, sf)
    told = quality.combine(quality.missing_component(rows), quality.flag_warnings(rows), quality.duplicate_content(rows))
    return quality.summarise(rows, told).select("encounter_id", "quality_status", "warning_count")


# --- spectra from embeddings ---------------------------------------------------------------------


@query("t5_moving_average", """WITH c AS (SELECT vec_id, i - 1 AS bin, embedding[i]::DOUBLE AS v FROM embeddings CROSS JOIN range(1, 65) r(i))
SELECT vec_id, bin, round((coalesce(sum(v) OVER (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) + greatest(0, 2 - bin) * first_value(v) OVER f + greatest(0, bin - 61) * last_value(v) OVER f) / 5, 5) AS baseline
FROM c WINDOW f AS (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(spark, sf):
    cells = _read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("bin", "v")).withColumn("v", F.col("v").cast("double"))
    return spectral.moving_average(cells, ["vec_id"], "bin", "v", 5, "baseline").select("vec_id", "bin", _r("baseline", 5).alias("baseline"))


@query("t2_remove_dc", "SELECT vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE - list_avg(embedding::DOUBLE[]), 5) AS value FROM embeddings CROSS JOIN range(1, 65) r(i)")
def _(spark, sf):
    x = frames.remove_dc(F.transform("embedding", lambda v: v.cast("double")))
    return _read(spark, sf, "embeddings").select("vec_id", F.posexplode(x).alias("pos", "value")).withColumn("value", _r("value", 5))


_GRID = "SELECT vec_id // 16 AS clip_id, vec_id % 16 AS f, i - 1 AS b, embedding[i]::DOUBLE AS v FROM embeddings CROSS JOIN range(1, 65) r(i)"


@query("t7_connected_components", """WITH RECURSIVE c AS (SELECT vec_id AS row, i - 1 AS b FROM embeddings CROSS JOIN range(1, 65) r(i) WHERE embedding[i]::DOUBLE >= 0.2::DOUBLE),
pair AS (SELECT x.row * 64 + x.b AS a, y.row * 64 + y.b AS z FROM c x CROSS JOIN range(-1, 2) d(k) JOIN c y ON y.row = x.row + d.k AND abs(x.b - y.b) <= 1),
reach(a, z) AS (SELECT row * 64 + b, row * 64 + b FROM c UNION SELECT r.a, p.z FROM reach r JOIN pair p ON p.a = r.z),
l AS (SELECT a, min(z) AS first FROM reach GROUP BY a)
SELECT dense_rank() OVER (ORDER BY first) AS component, count(*) AS cells, min(a // 64) AS first_row, max(a // 64) AS last_row, min(a % 64) AS first_bin, max(a % 64) AS last_bin FROM l GROUP BY first""")
def _(spark, sf):
    """All vectors as one grid, in tiles of few rows so that many components cross a seam."""
    rows = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("samples"))
    return grid.component_bounds(grid.label_grid(rows, 0.2, tile_rows=64))


@query("t8_component_summary", f"""WITH RECURSIVE g AS ({_GRID}), n AS (SELECT clip_id, dense_rank() OVER (PARTITION BY clip_id ORDER BY f) - 1 AS row, f, b, v, (dense_rank() OVER (PARTITION BY clip_id ORDER BY f) - 1) * 64 + b AS cell FROM g),
c AS (SELECT * FROM n WHERE v >= 0.15::DOUBLE), pair AS (SELECT x.clip_id, x.cell AS a, y.cell AS z FROM c x JOIN c y ON x.clip_id = y.clip_id AND abs(x.row - y.row) <= 1 AND abs(x.b - y.b) <= 1),
reach(clip_id, a, z) AS (SELECT clip_id, cell, cell FROM c UNION SELECT r.clip_id, r.a, p.z FROM reach r JOIN pair p ON p.clip_id = r.clip_id AND p.a = r.z),
l AS (SELECT clip_id, a AS cell, min(z) AS comp FROM reach GROUP BY ALL), k AS (SELECT c.*, l.comp FROM c JOIN l USING (clip_id, cell)),
s AS (SELECT clip_id, comp, count(DISTINCT row) AS frames, count(*) AS pixels, quantile_cont(b, 0.5) AS mid, sum(greatest(v, 0)) AS mass, quantile_cont(v, 0.5) AS median_salience, max(v) AS peak_salience, max(b)::DOUBLE AS frequency_max FROM k GROUP BY ALL HAVING count(DISTINCT row) >= 2),
o AS (SELECT *, mass * sqrt(frames) / sqrt(greatest(pixels / frames, 1)) / (1 + 0.15 * mid / 63) AS score FROM s),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, comp) AS r FROM o) WHERE r = 1),
w AS (SELECT k.clip_id, k.b::DOUBLE AS b, sum(k.v) OVER (PARTITION BY k.clip_id ORDER BY k.b) AS upto, sum(k.v) OVER (PARTITION BY k.clip_id) AS total FROM k JOIN best USING (clip_id, comp)),
q AS (SELECT clip_id, {", ".join(f"min(CASE WHEN upto >= {x} * total * (1 - 1e-12) THEN b END) AS {n}" for n, x in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95), ("q99", 0.99)))} FROM w GROUP BY clip_id),
every AS (SELECT n.clip_id, count(DISTINCT row) AS n_frames FROM n GROUP BY 1), many AS (SELECT clip_id, count(DISTINCT comp) AS candidate_count FROM l GROUP BY 1)
SELECT clip_id, best.comp IS NOT NULL AS found, coalesce(candidate_count, 0) AS candidate_count, coalesce(pixels, 0) AS pixel_count, round(coalesce(frames / n_frames, 0), 5) AS frame_fraction, round(coalesce(frames * 0.01, 0), 5) AS duration_seconds, round(score, 5) AS score,
 round(median_salience, 5) AS median_salience, round(peak_salience, 5) AS peak_salience, q05 AS frequency_q05, q50 AS frequency_q50, q95 AS frequency_q95, q99 AS frequency_q99, q95 - q05 AS bandwidth_q90, frequency_max
FROM every LEFT JOIN best USING (clip_id) LEFT JOIN q USING (clip_id) LEFT JOIN many USING (clip_id)""")
def _(spark, sf):
    rows = _read(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("clip_id"), (F.col("vec_id") % 16).alias("frame_idx"), F.col("embedding").alias("samples"))
    out = spectral.grid_summary(rows, "clip_id", 0.15, spectral.Tonal(0.01, 63.0, 0.02))
    return out.select("clip_id", "found", "candidate_count", "pixel_count", *[_r(c, 5).alias(c) for c in out.columns if c not in ("clip_id", "found", "candidate_count", "pixel_count")])


@query("t4_clip_spectrogram")
def _(spark, sf):
    """Each label's vectors are the frames of one clip; the cells of its tonal components."""
    audit = {"tonal_smoothing_time_sigma_frames": 0.8, "tonal_smoothing_frequency_sigma_bins": 1.0, "tonal_local_baseline_width_hz": 5.0, "tonal_salience_threshold_db": 3.0, "core_tonal_lower_hz": 2.0, "core_tonal_upper_hz": 30.0}
    rows = _read(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("clip_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("samples"))
    return spectral.clip_cells(rows, "clip_id", 1.0, audit).withColumn("v", _r("v", 4))
