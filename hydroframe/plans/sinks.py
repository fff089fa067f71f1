"""Tables and files that results end in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_events_manifest(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").partitionBy("encounter_id").parquet(path)


def manifest_json(events: DataFrame) -> DataFrame:
    """One JSON text an encounter with its events in order."""
    fields = [c for c in events.columns if c != "encounter_id" and c != "pcm"]
    listed = F.sort_array(F.collect_list(F.struct("source_index", "event_id", *[c for c in fields if c not in ("source_index", "event_id")])))
    return events.groupBy("encounter_id").agg(F.to_json(F.struct(F.lit("extraction_v1").alias("schema_version"), listed.alias("events")), {"ignoreNullFields": "false"}).alias("manifest"))


def write_predictions_json(predictions: DataFrame, path: str) -> None:
    """Nested results; null scores stay as nulls."""
    predictions.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_flat_csv(flat: DataFrame, path: str) -> None:
    flat.write.mode("overwrite").option("header", "true").csv(path)


def publish(results: DataFrame, path: str, run_id: str) -> None:
    """Put each encounter's rows in place of those of earlier runs, and leave other encounters' as they are.

    ``results``: a row or more for every encounter of the run; one that failed has a row that says so, which
    takes the place of its earlier results. Partitions change together when the write commits.
    """
    rows = results.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("encounter_id").parquet(path)


def published(spark: SparkSession, path: str) -> DataFrame:
    """What stands published, of encounters that didn't fail."""
    return spark.read.option("mergeSchema", "true").parquet(path).where("status <> 'failed'")
