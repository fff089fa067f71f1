import csv
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hydroframe.operators import bags, model, quality
from hydroframe.plans import pipeline, sinks
from hydroframe.sources import recordings
from tests.test_recordings import wav

RATE = 96_000
AUDIT = {
    "window_seconds": 0.010667, "hop_fraction": 0.5, "max_frames_per_clip": 512.0, "tonal_smoothing_time_sigma_frames": 0.8, "tonal_smoothing_frequency_sigma_bins": 1.0, "tonal_local_baseline_width_hz": 2000.0,
    "tonal_salience_threshold_db": 6.0, "core_tonal_lower_hz": 2000.0, "core_tonal_upper_hz": 40_000.0, "tonal_minimum_duration_seconds": 0.05,
}
FLAGS = {
    "near_clipping_amplitude_fraction": 0.99, "exact_clipping_min_fraction": 0.0, "near_clipping_min_fraction": 0.001, "large_dc_offset_fraction_full_scale": 0.01, "very_low_rms_dbfs": -60.0, "large_zero_fraction": 0.5,
    "low_tonal_component_frame_fraction": 0.01, "nonloop_long_duration_seconds": 3.0,
}
NAMES = [f"{f}__{s}" for f in pipeline.FEATURES for s in [*bags.STATISTICS, "missing_fraction"]]
SCHEMA_ID = "model_v1"


def model_file(path, **changes):
    n = len(NAMES)
    record = {
        "schema_version": SCHEMA_ID, "model_id": "artificial", "model_type": "acoustic_lr", "label_order": list(model.LABELS),
        "feature_extraction": {"per_whistle_features": list(pipeline.FEATURES), "aggregation_statistics": list(bags.STATISTICS), "add_missing_fraction_per_feature": True, "audit": AUDIT, "descriptive_flags": FLAGS},
        "encoder": {"numeric_features": NAMES, "numeric_medians": [0.0] * n, "numeric_means": [0.0] * n, "numeric_standard_deviations": [1.0] * n, "output_feature_names": [x for name in NAMES for x in (name, name + "__missing")]},
        "classifier": {"heads": [{"kind": "logistic_regression", "coefficient": [[0.0] * (2 * n)], "intercept": [0.2 * h]} for h in range(4)]},
        "training": {"native_sample_rates_hz": [RATE], "encounter_count": 7}, "score_semantics": {"type": "uncalibrated"},
    }
    path.write_text(json.dumps(record | changes))
    return record


def recording(samples, rate=RATE, channels=1):
    fmt = np.array([1, channels], "<u2").tobytes() + np.array([rate, 2 * rate], "<u4").tobytes() + np.array([2, 16], "<u2").tobytes()
    return wav((b"fmt ", fmt), (b"data", np.asarray(samples, "<i2").tobytes()))


def tone(seconds, hz=10_000, rate=RATE):
    return (8000 * np.sin(2 * np.pi * hz * np.arange(round(seconds * rate)) / rate)).astype("<i2")


def stub(batches):
    """Two boxes that overlap in the first window of r1, nothing elsewhere."""
    for rows in batches:
        for r in rows.itertuples():
            if r.recording_id.endswith("r1.wav") and r.window_index == 0:
                yield pd.DataFrame({"recording_id": r.recording_id, "window_index": [0, 0], "box": [0, 1], "x": [0.25, 0.26], "y": [0.6, 0.6], "w": [0.1, 0.1], "h": [0.2, 0.2], "confidence": [0.6, 0.9]})


def test_recordings_to_predictions_by_a_stub_detector(spark, tmp_path):
    model_file(tmp_path / "model.json")
    encoder, heads, settings = recordings.model_tables(spark, str(tmp_path / "model.json"))
    assert model.validate_model(encoder, heads, settings, SCHEMA_ID, pipeline.FEATURES, bags.STATISTICS).count() == 0
    for encounter, name, samples in (("one", "r1", tone(3.5)), ("one", "R0", tone(0.5)), ("none", "r2", tone(0.4))):
        (tmp_path / "in" / encounter).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / encounter / f"{name}.wav").write_bytes(recording(samples))
    root = str(tmp_path / "in")
    assert [r.path.rsplit("/", 1)[1] for r in recordings.discover_recordings(spark, root).collect()] == ["r2.wav", "R0.wav", "r1.wav"]
    good, rejects = recordings.admit_recordings(recordings.recording_catalog(spark, root))
    assert rejects.count() == 0
    good = good.withColumn("recording_id", F.col("path"))
    chunks = recordings.pcm_chunks(spark, root, 20_000).withColumnRenamed("path", "recording_id")
    good.write.parquet(str(tmp_path / "good"))
    chunks.write.parquet(str(tmp_path / "chunks"))
    good, chunks = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "chunks"))
    pipeline.recordings_to_detections(good, chunks, 20_000, stub).write.parquet(str(tmp_path / "found"))
    found = spark.read.parquet(str(tmp_path / "found"))
    one = found.collect()
    assert len(one) == 1 and (one[0].confidence, one[0].windows, one[0].raw_count) == (0.9, [0], 1)
    assert abs(one[0].start_s - 0.63) < 0.02 and abs(one[0].end_s - 0.93) < 0.02 and 14_900 < one[0].fmax_hz - one[0].fmin_hz + 9_000 < 15_100
    bag = pipeline.recordings_to_clips(good, found, chunks, 20_000)
    clip = bag.collect()[0]
    assert clip.path == "R0002_W0001.wav" and len(clip.pcm) == 2 * clip.sample_count
    assert clip.pcm == tone(3.5)[clip.first_sample : clip.stop_sample].tobytes()
    # the same by ranges of the files, without chunks
    assert sorted(map(tuple, pipeline.recordings_to_detections(good, None, None, stub).collect())) == sorted(map(tuple, one))
    assert pipeline.recordings_to_clips(good, found, None, None).drop("pcm", "sha256").collect() == bag.drop("pcm", "sha256").collect()
    assert pipeline.recordings_to_clips(good, found, None, None).first().pcm == clip.pcm
    sinks.write_events_manifest(bag, str(tmp_path / "manifest"))
    assert spark.read.parquet(str(tmp_path / "manifest")).count() == 1
    assert json.loads(sinks.manifest_json(bag.drop("pcm")).first().manifest)["events"][0]["event_id"] == "W0001"
    cut = spark.read.parquet(str(tmp_path / "manifest"))
    bag = bag.select("encounter_id", "path", "sha256", "sample_rate_hz", "sample_count", "pcm")
    bag.write.parquet(str(tmp_path / "bag"))
    bag = spark.read.parquet(str(tmp_path / "bag"))
    pipeline.clip_features(bag, RATE, AUDIT, FLAGS).write.parquet(str(tmp_path / "features"))
    features = spark.read.parquet(str(tmp_path / "features"))
    out = pipeline.predict_bags(features, encoder, heads, settings, details=True)
    status = quality.encounter_status(good, rejects, bag)
    pipeline.with_empty(out, quality.empty_results(status), settings).write.parquet(str(tmp_path / "predictions"))
    every = spark.read.parquet(str(tmp_path / "predictions"))
    sinks.write_predictions_json(every, str(tmp_path / "json"))
    read = {r["encounter_id"]: r for p in (tmp_path / "json").glob("part*") for r in map(json.loads, p.read_text().splitlines())}
    assert sorted(read) == ["none", "one"]
    got = read["one"]
    assert all(abs(got["behavior_scores"][label] - 1 / (1 + math.exp(-0.2 * h))) < 1e-9 for h, label in enumerate(model.LABELS))
    assert [r["label"] for r in got["ranked"]] == list(model.LABELS)[::-1]
    assert got["model"]["model_id"] == "artificial" and got["model"]["training_encounter_count"] == 7 and len(got["model"]["artifact_sha256"]) == 64
    assert got["clip_details"][0]["core_tonal_component_found"] and got["clip_details"][0]["path"] == "R0002_W0001.wav"
    assert {"sparse_whistle_evidence"} <= {w["code"] for w in got["warnings"]} and all(w["message"] for w in got["warnings"])
    empty = read["none"]
    assert empty["warning_count"] == 1 and [w["code"] for w in empty["warnings"]] == ["no_whistles_detected"] and empty["warnings"][0]["message"] and empty["ranked"] == []
    assert {r["schema_version"] for r in read.values()} == {pipeline.CLIP_PREDICTION} and all(r["software"] == pipeline.SOFTWARE for r in read.values())
    # reruns: one encounter breaks, then is mended; others stay as they are
    detector = {"checkpoint": "stub.pt", "sha256": "0" * 64, "confidence": 0.25}
    whole = pipeline.recording_predictions(every, good, status, detector)
    place = str(tmp_path / "published")
    sinks.publish(whole, place, "first")
    rows = {r.encounter_id: r for r in sinks.published(spark, place).collect()}
    assert sorted(rows) == ["none", "one"] and {r.run_id for r in rows.values()} == {"first"}
    one_row = rows["one"]
    assert (one_row.recording_count, one_row.total_recording_duration_seconds, one_row.schema_version) == (2, 4.0, pipeline.RECORDING_PREDICTION)
    assert one_row.extraction.asDict() == {"detector_sha256": "0" * 64, "confidence": 0.25, "clip_padding_seconds": 0.25, "whistle_clip_count": 1} and one_row.interpretation.deployment == pipeline.RECORDINGS_DEPLOYMENT
    assert rows["none"].warnings[0].code == "no_whistles_detected" and rows["none"].recording_count == 1
    broken = quality.encounter_status(good, good.where("encounter_id = 'one'").selectExpr("encounter_id", "path", "'unreadable' AS reason"), bag).where("encounter_id = 'one'")
    sinks.publish(pipeline.recording_predictions(every, good, broken, detector), place, "second")
    assert [(r.encounter_id, r.run_id) for r in sinks.published(spark, place).collect()] == [("none", "first")]
    assert [(r.status, r.error) for r in spark.read.parquet(place).where("encounter_id = 'one'").collect()] == [("failed", "unreadable")]
    sinks.publish(whole.where("encounter_id = 'one'"), place, "third")
    assert sorted((r.encounter_id, r.run_id) for r in sinks.published(spark, place).collect()) == [("none", "first"), ("one", "third")]
    told = {r.encounter_id: r for r in pipeline.manifests(good, cut, status, detector).collect()}
    assert [(s.source_index, s.path.rsplit("/", 1)[1]) for s in told["one"].sources] == [(1, "R0.wav"), (2, "r1.wav")] and told["one"].whistle_clip_count == 1
    assert told["one"].events[0].audio.clip_file == "R0002_W0001.wav" and told["one"].events[0].detection.event_id == "W0001" and told["one"].detector.checkpoint == "stub.pt"
    assert (told["none"].status, told["none"].events, told["none"].whistle_clip_count, told["none"].clip_padding_seconds) == ("no_whistles_detected", [], 0, 0.25)
    assert [(r.status, r.error, r.whistle_clip_count) for r in pipeline.manifests(good, cut, broken, detector).collect()] == [("failed", "unreadable", 0)]
    assert empty["status"] == "no_whistles_detected" and empty["behavior_scores"] is None and empty["clip_count"] == 0 and empty["model"] == got["model"]
    codes = F.when(F.col("status") == "complete", F.transform("warnings", lambda w: w["code"])).otherwise(F.array(F.lit("no_whistles_detected")))
    results = every.withColumns({"warning_codes": codes, "model_id": F.col("model.model_id"), "model_sha256": F.col("model.artifact_sha256")})
    ranked = every.select("encounter_id", F.explode("ranked").alias("r")).select("encounter_id", "r.*")
    sinks.write_flat_csv(quality.flat_rows(results, ranked).coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part*")
    rows = list(csv.DictReader(part.open()))
    assert list(rows[0]) == ["encounter_id", "status", "rank", "behavior", "score", "whistle_clip_count", "quality_status", "warning_codes", "model_id", "model_sha256"]
    assert len(rows) == 5 and [r["behavior"] for r in rows if r["encounter_id"] == "none"] == [""]


def test_ready_made_clips_are_admitted_by_the_tonal_band(spark, tmp_path):
    for name, data in {"a": recording(tone(0.1)), "slow": recording(tone(0.1, rate=48_000), 48_000), "stereo": recording(tone(0.1), channels=2), "empty": recording([])}.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    catalog = recordings.recording_catalog(spark, str(tmp_path), min_rate=1, encounter_id=" bag ")
    good, rejects = recordings.admit_clips(catalog, 40_000.0)
    assert [r.encounter_id for r in good.collect()] == ["bag"]
    assert sorted(r.reason for r in rejects.collect()) == ["empty", "not mono", "sample rate too low for the tonal band"]
    assert recordings.clip_bag(spark, str(tmp_path), 20_000.0).count() == 2


def test_faulty_models_are_named(spark, tmp_path):
    path = tmp_path / "model.json"
    record = model_file(path)
    head, encoder = record["classifier"]["heads"], record["encoder"]
    cases = {
        "head kind": {"classifier": {"heads": [*head[:3], head[3] | {"kind": "tree"}]}},
        "coefficient shape": {"classifier": {"heads": [*head[:3], head[3] | {"coefficient": [[0.0]]}]}},
        "number of heads": {"classifier": {"heads": head[:3]}},
        "encoder output names": {"encoder": encoder | {"output_feature_names": encoder["output_feature_names"][::-1]}},
        "encoder lengths": {"encoder": encoder | {"numeric_means": encoder["numeric_means"][1:]}},
        "encoder missing": {"encoder": None}, "heads missing": {"classifier": None}, "schema version": {"schema_version": "other"}, "sd is not positive": {"encoder": encoder | {"numeric_standard_deviations": [0.0] * len(NAMES)}},
    }
    for k, (rule, change) in enumerate(cases.items()):
        path = tmp_path / f"model{k}.json"
        model_file(path, **change)
        broken = model.validate_model(*recordings.model_tables(spark, str(path)), SCHEMA_ID, pipeline.FEATURES, bags.STATISTICS)
        assert rule in {r.rule for r in broken.collect()}, rule
    bad = spark.createDataFrame([("e", 0, "x", float("nan")), ("e", 1, "y", 1.0)], "encounter_id string, pos int, name string, value double")
    assert [r.name for r in model.validate_encoded(bad, "encounter_id").collect()] == ["x"]
