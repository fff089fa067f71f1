"""Warnings about encounters, and their status.

Every rule gives rows (encounter_id, ord, code, message, affected_files, details); ``combine`` collects them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.functions.columns import casefolded

KEY = "encounter_id"

#: Fixed texts of the warnings.
MESSAGES = {
    "sparse_whistle_evidence": "Fewer than three whistle clips were supplied; treat score differences cautiously.",
    "sample_rate_outside_training_regimes": "At least one sample rate was not represented in the model-development cohort.",
    "core_tonal_component_not_found": "The deterministic 2--40 kHz tonal-component audit did not find a component in some clips.",
    "duplicate_audio_content": "Two or more input paths contain byte-identical audio and may overweight a whistle.",
    "aggregate_feature_extrapolation": "Some encounter aggregates are more than six training standard deviations from their means.",
}
EMPTY_CODE, EMPTY_MESSAGE = "no_whistles_detected", "No whistle was detected and no behavior score computed; this does not mean that none of the behaviors occurred."
FLAG_MESSAGE = "The descriptive audio-quality flag '%s' was raised."


def _rows(df: DataFrame, order: int, code: Column | str, files: Column | None = None, details: Column | None = None, message: Column | None = None) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    if isinstance(code, str):
        code, message = F.lit(code), F.lit(MESSAGES[code])
    return df.select(KEY, F.lit(order).alias("ord"), code.alias("code"), message.alias("message"), (none("array<string>") if files is None else files).alias("affected_files"), (none("string") if details is None else details).alias("details"))


def _files() -> Column:
    """The paths of a group in the bag's order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(casefolded(F.col("path")).alias("l"), F.col("path").alias("p")))), lambda x: x["p"])


def sparse_evidence(clips: DataFrame, least: int = 3) -> DataFrame:
    return _rows(clips.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least), 1, "sparse_whistle_evidence")


def unseen_rates(clips: DataFrame, training: DataFrame) -> DataFrame:
    """(encounter_id, unseen): the sorted sample rates that training had not."""
    new = clips.select(KEY, "sample_rate_hz").distinct().join(training, "sample_rate_hz", "left_anti")
    return new.groupBy(KEY).agg(F.sort_array(F.collect_set("sample_rate_hz")).alias("unseen"))


def rate_warnings(clips: DataFrame, training: DataFrame) -> DataFrame:
    known = training.agg(F.sort_array(F.collect_set("sample_rate_hz")).alias("training"))
    rows = unseen_rates(clips, training).crossJoin(F.broadcast(known))  # one row
    return _rows(rows, 2, "sample_rate_outside_training_regimes", None, F.to_json(F.struct(F.col("unseen").alias("observed_unseen_hz"), F.col("training").alias("training_hz"))))


def missing_component(clips: DataFrame) -> DataFrame:
    rows = clips.where(~F.col("core_tonal_component_found")).groupBy(KEY).agg(_files().alias("files"))
    return _rows(rows, 3, "core_tonal_component_not_found", F.col("files"))


def flag_warnings(clips: DataFrame) -> DataFrame:
    rows = clips.select(KEY, "path", F.explode("quality_flags").alias("flag")).groupBy(KEY, "flag").agg(_files().alias("files"))
    return _rows(rows, 4, F.concat(F.lit("audio_quality:"), "flag"), F.col("files"), None, F.format_string(FLAG_MESSAGE, "flag"))


def duplicate_content(clips: DataFrame) -> DataFrame:
    same = Window.partitionBy(KEY, "sha256")
    rows = clips.withColumn("_n", F.count(F.lit(1)).over(same)).where("_n > 1").groupBy(KEY).agg(_files().alias("files"))
    return _rows(rows, 5, "duplicate_audio_content", F.col("files"))


def extrapolation(extremes: DataFrame) -> DataFrame:
    """From top_extremes: the details list feature and standardised value, largest first."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "name", "value"))), lambda x: F.struct(x["name"].alias("feature"), x["value"].alias("standardized_value")))
    rows = extremes.groupBy(KEY).agg(F.to_json(listed).alias("d"))
    return _rows(rows, 6, "aggregate_feature_extrapolation", None, F.col("d"))


def combine(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summarise(encounters: DataFrame, warnings: DataFrame) -> DataFrame:
    """Per encounter its status, number of warnings, and the warnings in order; flags of one order by code."""
    listed = F.sort_array(F.collect_list(F.struct("ord", "code", "message", "affected_files", "details")))
    each = warnings.groupBy(KEY).agg(F.count(F.lit(1)).alias("warning_count"), listed.alias("warnings"))
    rows = encounters.select(KEY).distinct().join(each, KEY, "left")
    empty = F.array().cast(each.schema["warnings"].dataType)
    return rows.select(KEY, F.when(F.col("warning_count").isNull(), "ok").otherwise("warning").alias("quality_status"), F.coalesce("warning_count", F.lit(0)).alias("warning_count"), F.coalesce("warnings", empty).alias("warnings"))


def encounter_status(encounters: DataFrame, rejects: DataFrame, events: DataFrame) -> DataFrame:
    """failed with its reason if a recording was rejected, else no_whistles_detected or complete."""
    why = rejects.groupBy(KEY).agg(F.min("reason").alias("error"))
    counts = events.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    rows = encounters.select(KEY).distinct().join(why, KEY, "left").join(counts, KEY, "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("n").isNull(), "no_whistles_detected").otherwise("complete")
    return rows.select(KEY, status.alias("status"), "error", F.coalesce("n", F.lit(0)).alias("clip_count"))


def empty_results(status: DataFrame) -> DataFrame:
    """Encounters without events: no scores, an empty ranking and one warning, never zeros."""
    rows = status.where("status = 'no_whistles_detected'")
    none = lambda kind: F.lit(None).cast(kind)
    warning = F.struct(F.lit(0).alias("ord"), F.lit(EMPTY_CODE).alias("code"), F.lit(EMPTY_MESSAGE).alias("message"), none("array<string>").alias("affected_files"), none("string").alias("details"))
    return rows.select(
        KEY, "status", none("map<string,double>").alias("behavior_scores"), F.array().cast("array<struct<rank: int, label: string, score: double>>").alias("ranked"),
        F.lit("insufficient_evidence").alias("quality_status"), F.lit(1).alias("warning_count"), F.array(F.lit(EMPTY_CODE)).alias("warning_codes"), F.array(warning).alias("warnings"),
    )


def flat_rows(results: DataFrame, ranked: DataFrame) -> DataFrame:
    """A row for each ranked label; an encounter without scores has one row with empty label, rank and score.

    ``results``: encounter_id, status, clip_count, quality_status, warning_codes, model_id, model_sha256; ``ranked``: encounter_id, rank, label, score.
    """
    rows = results.join(ranked.select(KEY, "rank", F.col("label").alias("behavior"), "score"), KEY, "left")
    return rows.select(KEY, "status", "rank", "behavior", "score", F.col("clip_count").alias("whistle_clip_count"), "quality_status", F.concat_ws(";", "warning_codes").alias("warning_codes"), "model_id", "model_sha256")


def clip_details(clips: DataFrame) -> DataFrame:
    """Per encounter the list of its clips with hash, rate, count, duration, found and flags, in the order of the case-folded path."""
    shown = ("path", "sha256", "sample_rate_hz", "sample_count", "duration_seconds", "core_tonal_component_found", "quality_flags")
    listed = F.sort_array(F.collect_list(F.struct(casefolded(F.col("path")).alias("_l"), *shown)))
    return clips.groupBy(KEY).agg(F.transform(listed, lambda x: F.struct(*[x[c].alias(c) for c in shown])).alias("clip_details"))
