"""Recordings on disk: discovery, header catalog, rejects, range reads of samples, content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.functions.columns import casefolded
from hydroframe.operators.bags import resolve_encounter_id
from hydroframe.sources.ranges import file_headers, read_ranges

#: Least sample rate of a recording.
MIN_RATE = 80_000

def discover_recordings(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path and length of the .wav files below ``root``, the suffix in any case, by case-folded path; contents aren't read."""
    return wav_files(spark, root, recursive).orderBy(casefolded(F.col("path")), "path")


def wav_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path and length of the .wav files below ``root``; contents aren't read, and a file may have any length."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length")


def _catalog(headers: DataFrame, min_rate: int, encounter_id: str | None) -> DataFrame:
    rows = headers.withColumn("sample_count", F.floor(F.col("data_bytes") / 2)).withColumn("encounter_id", resolve_encounter_id(F.lit(encounter_id), F.element_at(F.split("path", "/"), -2)))
    reason = (
        F.when(~F.col("riff") | F.col("format").isNull(), "not a WAV file")
        .when(F.col("data_offset").isNull(), "no data chunk")
        .when(F.col("channels") != 1, "not mono")
        .when((F.col("format") != 1) | (F.col("bits") != 16), "not 16-bit PCM")
        .when(F.col("sample_rate_hz") < min_rate, "sample rate too low")
        .when(F.col("sample_count") <= 0, "empty")
    )
    duration = F.try_divide(F.col("sample_count").cast("double"), F.col("sample_rate_hz").cast("double"))
    return rows.withColumn("duration_seconds", duration).withColumn("reason", reason)


def recording_catalog(spark: SparkSession, root: str, recursive: bool = True, min_rate: int = MIN_RATE, encounter_id: str | None = None) -> DataFrame:
    """A row per recording: path, encounter_id (as given, else its folder), rate, count, duration, sha256, data_offset (the first sample's byte) and reason, null if it is admitted.

    Chunks before the data are walked over. No data chunk, not mono, not 16-bit PCM, under ``min_rate`` or empty is a reason.
    Files are read in blocks, once, for their hash.
    """
    rows = _catalog(file_headers(wav_files(spark, root, recursive)), min_rate, encounter_id)
    return rows.select("path", "encounter_id", "sample_rate_hz", "sample_count", "duration_seconds", "sha256", "data_offset", "reason")


def admit_recordings(catalog: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Admitted recordings and rejects. With ``strict`` one reject voids its whole encounter."""
    rejects = catalog.where("reason IS NOT NULL").select("encounter_id", "path", "reason")
    good = catalog.where("reason IS NULL").drop("reason")
    if strict:
        good = good.join(rejects.select("encounter_id").distinct(), "encounter_id", "left_anti")
    return good, rejects


def admit_clips(catalog: DataFrame, core_tonal_upper_hz: float) -> tuple[DataFrame, DataFrame]:
    """Ready-made clips that are admitted, and rejects: beside the catalog's reasons, half the rate must reach the tonal band's upper limit."""
    low = F.when(F.col("sample_rate_hz") / 2 < core_tonal_upper_hz, "sample rate too low for the tonal band")
    return admit_recordings(catalog.withColumn("reason", F.coalesce("reason", low)), strict=False)


def sample_ranges(rows: DataFrame) -> DataFrame:
    """Adds first_byte and n_bytes to rows with data_offset, first_sample and stop_sample of 16-bit mono files, for ranges.read_ranges."""
    return rows.withColumn("first_byte", F.col("data_offset") + 2 * F.col("first_sample")).withColumn("n_bytes", 2 * (F.col("stop_sample") - F.col("first_sample")))


def read_samples(rows: DataFrame, recordings: DataFrame) -> DataFrame:
    """Adds pcm, the samples [first_sample, stop_sample) of each row's recording, read from its file by range.

    ``rows``: recording_id, first_sample, stop_sample and others; ``recordings``: recording_id, path, data_offset.
    """
    known = recordings.select("recording_id", F.col("path").alias("_path"), F.col("data_offset").alias("_offset"))
    asked = rows.join(known, "recording_id")
    ranges = sample_ranges(asked.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col("_path").alias("path"), F.col("_offset").alias("data_offset"), "first_sample", "stop_sample"))
    return read_ranges(ranges.select("row", "path", "first_byte", "n_bytes"), "pcm").select("row.*", "pcm")


def scan_pcm(spark: SparkSession, recordings: DataFrame | list[tuple[str, int, int]], chunk_samples: int) -> DataFrame:
    """path, chunk_no, first_sample and pcm: the recordings of a table (path, sample_count, data_offset), as the catalog has them, in chunks.

    Ranges are planned and read on the executors; a recording of any length is spread over tasks. A list
    of such rows does as well.
    """
    if not isinstance(recordings, DataFrame):
        recordings = spark.createDataFrame(recordings, "path string, sample_count long, data_offset long")
    rows = recordings.where("sample_count > 0").select("path", "sample_count", "data_offset", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sample_count") - 1) / chunk_samples))).alias("chunk_no"))
    rows = rows.withColumn("first_sample", F.col("chunk_no") * chunk_samples).withColumn("stop_sample", F.least(F.col("sample_count"), F.col("first_sample") + chunk_samples))
    return read_ranges(sample_ranges(rows).select("path", "chunk_no", "first_sample", "first_byte", "n_bytes"), "pcm").drop("first_byte", "n_bytes")


def pcm_chunks(spark: SparkSession, root: str, chunk_samples: int) -> DataFrame:
    """Chunks (path, chunk_no, pcm) of all files below ``root`` that have a data chunk with samples."""
    headers = file_headers(wav_files(spark, root)).where("data_offset IS NOT NULL")
    there = F.least("data_bytes", F.col("length") - F.col("data_offset"))
    return scan_pcm(spark, headers.select("path", F.floor(there / 2).alias("sample_count"), "data_offset"), chunk_samples).select("path", "chunk_no", "pcm")


def clip_bag(spark: SparkSession, root: str, core_tonal_upper_hz: float = MIN_RATE / 2, encounter_id: str | None = None) -> DataFrame:
    """Ready-made clips: encounter_id as given or from the folder, path, rate, count, sha256 and samples, for files that are admitted.

    Each file is read once; a clip must fit a row.
    """
    good, _ = admit_clips(_catalog(file_headers(wav_files(spark, root), with_pcm=True), 1, encounter_id), core_tonal_upper_hz)
    return good.select("path", "encounter_id", "sample_rate_hz", "sample_count", "duration_seconds", "sha256", "pcm")


#: The model file's fields that are read.
MODEL_SCHEMA = """schema_version string, model_id string, model_type string, label_order array<string>,
feature_extraction struct<per_whistle_features: array<string>, aggregation_statistics: array<string>, add_missing_fraction_per_feature: boolean, audit: map<string,double>, descriptive_flags: map<string,double>>,
encoder struct<numeric_features: array<string>, numeric_medians: array<double>, numeric_means: array<double>, numeric_standard_deviations: array<double>, output_feature_names: array<string>>,
classifier struct<heads: array<struct<kind: string, coefficient: array<array<double>>, intercept: array<double>>>>,
training struct<native_sample_rates_hz: array<int>, encounter_count: int>, score_semantics struct<type: string>"""


def model_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Encoder rows, head rows and the settings row of a model file; NaN may stand unquoted in it."""
    model = spark.read.schema(MODEL_SCHEMA).option("multiLine", "true").option("allowNonNumericNumbers", "true").json(path)
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("artifact_sha256"))
    zipped = F.arrays_zip("encoder.numeric_features", "encoder.numeric_medians", "encoder.numeric_means", "encoder.numeric_standard_deviations")
    rows = model.select(F.posexplode(zipped).alias("pos", "x"))
    encoder = rows.select("pos", F.col("x.numeric_features").alias("name"), F.col("x.numeric_medians").alias("median"), F.col("x.numeric_means").alias("mean"), F.col("x.numeric_standard_deviations").alias("sd"))
    heads = model.select("label_order", F.posexplode("classifier.heads").alias("label_idx", "h"))
    heads = heads.select("label_idx", F.get("label_order", F.col("label_idx")).alias("label"), F.col("h.kind").alias("kind"), F.get("h.intercept", F.lit(0)).alias("intercept"), F.posexplode(F.get("h.coefficient", F.lit(0))).alias("pos", "coef"))
    f = "feature_extraction."
    settings = model.select("schema_version", "model_id", "model_type", f + "per_whistle_features", f + "aggregation_statistics", F.col(f + "add_missing_fraction_per_feature").alias("add_missing_fraction"), F.col(f + "audit").alias("audit"), F.col(f + "descriptive_flags").alias("flags"), "training", "score_semantics", "encoder", F.col("classifier.heads").isNotNull().alias("has_heads"))
    return encoder, heads, settings.crossJoin(digest)  # one row each
