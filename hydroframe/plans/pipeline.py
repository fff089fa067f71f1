"""From clips to scores, and from recordings to events to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.operators import audio, bags, clips, events, frames, model, quality, spectral
from hydroframe.sources.recordings import read_samples

#: Fixed texts that stand in every prediction.
INTERPRETATION = {
    "scope": "Scores describe the behavioral context of the encounter bag, not individual whistles or callers.",
    "multilabel": "Each behavior is scored independently; several contexts may co-occur.",
    "calibration": "Scores are not prospectively calibrated probabilities for a new survey.",
    "thresholds": "No universal binary threshold is supplied; operating thresholds require survey-specific validation.",
}
#: Texts of predictions without an event, and of those from whole recordings.
EMPTY_INTERPRETATION = {"scope": "The prediction unit is the encounter, not an individual animal.", "calibration": "No behavioral probability is available without an extracted whistle bag."}
CLIPS_DEPLOYMENT, RECORDINGS_DEPLOYMENT = "Scores of clips that were cut before.", "Whistle segments were cut from the recordings by a detector, and their bag was scored."
#: What predictions and manifests call themselves.
SOFTWARE = {"name": "hydroframe", "version": "0.3"}
CLIP_PREDICTION, RECORDING_PREDICTION, EXTRACTION = "clip_prediction_v1", "recording_prediction_v1", "extraction_v1"
#: What a detector gives; ``box`` numbers the boxes of a window, fewer than BOXES_A_WINDOW.
BOXES = "recording_id string, window_index int, box int, x double, y double, w double, h double, confidence double"
BOXES_A_WINDOW = 1_000_000
#: Length of a detector window; window_view has the same.
WINDOW_S = 3.0
TASK = "encounter_level_multilabel_behavioral_context_scoring"

#: The fourteen features of a clip, in order.
FEATURES = (
    "duration_seconds", "core_tonal_component_frequency_q05_hz", "core_tonal_component_frequency_q50_hz", "core_tonal_component_frequency_q95_hz", "core_tonal_component_frequency_max_hz",
    "core_tonal_component_bandwidth_q90_hz", "core_tonal_component_duration_seconds", "core_tonal_component_frame_fraction", "core_tonal_component_median_salience_db",
    "core_tonal_component_peak_salience_db", "rms_dbfs", "temporal_dynamic_db", "exact_clipping_fraction", "low_activity_frame_fraction",
)


def clip_features(bag: DataFrame, rate: int, audit: dict, flags: dict) -> DataFrame:
    """The feature record of every clip of one sample rate. ``bag``: encounter_id, path, sha256, sample_rate_hz, sample_count, pcm."""
    rows = audio.clip_records(bag, rate, audit, flags["near_clipping_amplitude_fraction"])
    rows = rows.withColumn("duration_seconds", F.col("sample_count") / F.lit(float(rate)))
    return rows.withColumn("quality_flags", clips.quality_flags(flags))


def model_identity(settings: DataFrame) -> DataFrame:
    """One row: the struct that names the model in a prediction."""
    fields = [F.col("model_id"), F.col("model_type"), F.col("artifact_sha256"), F.col("training.encounter_count").alias("training_encounter_count"), F.col("score_semantics.type").alias("score_type")]
    return settings.select(F.struct(*fields).alias("model"))


def software() -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in SOFTWARE.items()])


def _told(rows: DataFrame, settings: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds what stands alike in all predictions: names, versions, the model's identity and the texts."""
    told = F.struct(*[F.lit(texts.get(k)).cast("string").alias(k) for k in (*INTERPRETATION, "deployment")])
    rows = rows.withColumns({"schema_version": F.lit(CLIP_PREDICTION), "software": software(), "task": F.lit(TASK), "binary_decisions": F.lit(None).cast("map<string,boolean>"), "interpretation": told})
    return rows.crossJoin(F.broadcast(model_identity(settings)))  # one row


def assemble_predictions(scores: DataFrame, summary: DataFrame, warnings: DataFrame, settings: DataFrame, deployment: str = CLIPS_DEPLOYMENT) -> DataFrame:
    """The whole record of every encounter with scores: scores, ranking, input summary, quality, model identity and texts."""
    key = "encounter_id"
    ranked = model.rank_labels(scores, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "label", "score"))).alias("ranked"), model.score_pairs().alias("behavior_scores"))
    rows = summary.join(ranked, key).join(quality.summarise(summary, warnings), key).withColumn("status", F.lit("complete"))
    return _told(rows, settings, INTERPRETATION | {"deployment": deployment})


def predict_bags(features: DataFrame, encoder: DataFrame, heads: DataFrame, settings: DataFrame, details: bool = False) -> DataFrame:
    """assemble_predictions of every encounter with clips; with ``details`` the list of its clips as well.

    Every rule reads ``features``, so give a written table, lest the audio be gone through for each.
    """
    key = "encounter_id"
    encoded = model.encoded_bags(bags.long_form(bags.bag_statistics(features, key, list(FEATURES)), key), key, encoder)
    rates = settings.select(F.explode("training.native_sample_rates_hz").alias("sample_rate_hz"))
    found = quality.combine(
        quality.sparse_evidence(features), quality.rate_warnings(features, rates), quality.missing_component(features), quality.flag_warnings(features),
        quality.duplicate_content(features), quality.extrapolation(model.top_extremes(model.encoded_rows(encoded, key), key)),
    )
    summary = bags.bag_totals(features, key, "duration_seconds", "sample_rate_hz").join(bags.bag_fingerprint(features, key, "path", "sha256"), key)
    out = assemble_predictions(model.score_bags(encoded, key, heads), summary, found, settings)
    return out.join(quality.clip_details(features), key) if details else out


def with_empty(predictions: DataFrame, empty: DataFrame, settings: DataFrame) -> DataFrame:
    """Predictions and, for encounters without events (as of quality.empty_results), records with null scores, an empty ranking and their warning."""
    rows = empty.withColumns({"clip_count": F.lit(0).cast("long"), "total_duration": F.lit(0.0)})
    rows = _told(rows, settings, EMPTY_INTERPRETATION | {"deployment": "No event was found."}).drop("warning_codes")
    return predictions.unionByName(rows, allowMissingColumns=True)


def recording_predictions(predictions: DataFrame, recordings: DataFrame, status: DataFrame, detector: dict, padding: float = 0.25) -> DataFrame:
    """Predictions (with_empty) of whole recordings: their number and duration, how clips were cut, and the texts of this mode; and a row with nothing but its error for each encounter that failed.

    ``recordings``: encounter_id, duration_seconds; ``status``: as of quality.encounter_status; ``detector``: sha256 and
    confidence. Of encounters that aren't complete no scores pass.
    """
    key = "encounter_id"
    extraction = F.struct(F.lit(detector.get("sha256")).cast("string").alias("detector_sha256"), F.lit(float(detector.get("confidence", 0.25))).alias("confidence"), F.lit(float(padding)).alias("clip_padding_seconds"), F.col("clip_count").alias("whistle_clip_count"))
    rows = predictions.drop("status").join(status.where("status <> 'failed'").select(key, "status"), key).join(bags.recording_totals(recordings, key), key)
    rows = rows.withColumn("extraction", extraction).withColumn("interpretation", F.col("interpretation").withField("deployment", F.lit(RECORDINGS_DEPLOYMENT)))
    failed = status.where("status = 'failed'").select(key, "status", "error", F.lit(0).cast("long").alias("clip_count"))
    rows = rows.unionByName(failed, allowMissingColumns=True)
    return rows.withColumns({"schema_version": F.lit(RECORDING_PREDICTION), "software": software()})


def manifests(recordings: DataFrame, cut: DataFrame, status: DataFrame, detector: dict, padding: float = 0.25) -> DataFrame:
    """One row an encounter: names, status and error, detector settings, padding, its sources in order, its events with their clips in order, and their number.

    ``recordings``: encounter_id, path, sample_rate_hz, sample_count, duration_seconds, sha256; ``cut``: as of
    recordings_to_clips; ``status``: as of quality.encounter_status. Encounters without events or with an error have none.
    """
    key = "encounter_id"
    shown = ("path", "sample_rate_hz", "sample_count", "duration_seconds", "sha256")
    numbered = frames.source_index(recordings, key, "path")
    sources = numbered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_index", *shown))).alias("sources"))
    found = ("event_id", "start_s", "end_s", "fmin_hz", "fmax_hz", "confidence", "windows", "raw_count")
    audio_part = F.struct(F.col("path").alias("clip_file"), F.col("first_sample").alias("start_sample"), F.col("stop_sample").alias("end_sample_exclusive"), (F.col("first_sample") / F.col("sample_rate_hz")).alias("start_seconds"), (F.col("stop_sample") / F.col("sample_rate_hz")).alias("end_seconds"), "sha256")
    each = cut.select(key, F.struct("source_index", F.struct(*found).alias("detection"), audio_part.alias("audio")).alias("event"))
    events_of = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("event.source_index").alias("s"), F.col("event.detection.event_id").alias("e"), "event"))).alias("x")).select(key, F.transform("x", lambda x: x["event"]).alias("events"))
    rows = status.select(key, "status", "error").join(sources, key, "left").join(events_of, key, "left")
    listed = F.when(F.col("status") != "failed", F.col("events"))
    none = F.array().cast(events_of.schema["events"].dataType)
    rows = rows.withColumn("events", F.coalesce(listed, none)).withColumn("whistle_clip_count", F.size("events").cast("long"))
    told = F.struct(*[F.lit(v).alias(k) for k, v in detector.items()]) if detector else F.lit(None).cast("string")
    return rows.withColumns({"schema_version": F.lit(EXTRACTION), "software": software(), "detector": told, "clip_padding_seconds": F.lit(float(padding))})


def recordings_to_detections(recordings: DataFrame, chunks: DataFrame | None, chunk_samples: int | None, detector, stride_s: float = 1.0, confidence: float = 0.25, fmax: float = 30_000.0) -> DataFrame:
    """Windows of every recording, their spectrograms, the supplied detector's boxes, and these as detections.

    ``recordings``: recording_id, sample_rate_hz, sample_count; ``chunks``: recording_id, chunk_no, pcm, or
    none, then windows are read from the recordings' files (path, data_offset) by range.
    ``detector`` takes an iterator of pandas frames (recording_id, window_index, grid, t0, t1, f0, f1) and
    gives frames of BOXES.
    """
    length, hop = (F.greatest(F.lit(1), F.rint(x * F.col("sample_rate_hz")).cast("long")) for x in (WINDOW_S, stride_s))
    windows = recordings.select("recording_id", "sample_rate_hz", F.col("sample_count").cast("long").alias("total_samples"), length.alias("length"), F.posexplode(frames.sliding_windows(F.col("sample_count").cast("long"), length, hop)).alias("window_index", "start_sample"))
    windows = windows.withColumn("valid_samples", F.least("length", F.col("total_samples") - F.col("start_sample"))).drop("length")
    asked = windows.withColumn("first_sample", F.col("start_sample")).withColumn("stop_sample", F.col("start_sample") + F.col("valid_samples"))
    cut = read_samples(asked, recordings) if chunks is None else frames.extract_clips(asked, chunks, chunk_samples)
    boxes = events.detect_windows(spectral.window_spectrograms(cut), detector, BOXES)
    boxes = boxes.withColumn("seq", F.col("window_index").cast("long") * BOXES_A_WINDOW + F.col("box"))
    bounds = dict(zip(("t0", "t1", "f0", "f1"), map(F.lit, spectral.window_bounds()), strict=True))
    admitted = events.windows_with_boxes(windows.withColumns(bounds), events.admit_boxes(boxes, confidence))
    return events.detections(events.boxes_to_intervals(admitted), fmax)


def recordings_to_clips(recordings: DataFrame, detections: DataFrame, chunks: DataFrame | None, chunk_samples: int | None, padding: float = 0.25, merge: dict = events.MERGE) -> DataFrame:
    """Merged, padded, named and cut events of all recordings.

    ``recordings``: encounter_id, recording_id, path, sample_rate_hz, sample_count, duration_seconds;
    ``detections``: as of events.detections; ``chunks``: recording_id, chunk_no, pcm, or none, then clips are
    read from the recordings' files (path, data_offset) by range.
    """
    merged = events.merge_events(detections, merge)
    numbered = frames.source_index(recordings, "encounter_id", "path").withColumnRenamed("path", "source_path")
    padded = frames.pad_and_clip(merged.join(numbered, "recording_id"), padding)
    named = padded.withColumn("path", F.concat(frames.clip_name(F.col("source_index"), F.col("event_id")), F.lit(".wav")))
    cut = read_samples(named, recordings) if chunks is None else frames.extract_clips(named, chunks, chunk_samples)
    return cut.withColumn("sha256", F.sha2("pcm", 256)).withColumn("sample_count", F.col("stop_sample") - F.col("first_sample"))
