"""Windows, frames, padded events and native-rate clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.functions.columns import casefolded


def frame_starts(n: Column, length: int, hop: int, most: int) -> Column:
    """Starts on the hop grid; beyond ``most`` frames, evenly spaced distinct starts. Short input has the one start 0."""
    available = F.lit(1) + F.floor((n - length) / hop)
    last = (n - length).cast("long")
    even = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when(i == most - 1, last).otherwise(F.floor(i * F.try_divide(last.cast("double"), F.lit(float(most - 1)))).cast("long"))))
    grid = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(available - 1, F.lit(0)).cast("long")), lambda i: i * hop)
    return F.when((n < length) | ((F.lit(most) == 1) & (available > 1)), F.array(F.lit(0).cast("long"))).when(available <= most, grid).otherwise(even)


def sliding_windows(total: Column, length: int, hop: int) -> Column:
    """Starts every hop, and one aligned with the end if the grid misses it. Short input has the one start 0."""
    last = (total - length).cast("long")
    grid = F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long")), F.lit(hop).cast("long"))
    return F.when(total <= length, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(grid, F.array(last))))


def fit_window(samples: Column, length: int) -> Column:
    """Zero-padded or cut to exactly ``length``."""
    pad = F.greatest(F.lit(length) - F.size(samples), F.lit(0))
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0).cast("double"), pad)), 1, length)


def pcm_to_float(samples: Column) -> Column:
    """Signed 16-bit samples as fractions of full scale."""
    return F.transform(samples, lambda x: x / F.lit(32768.0))


def remove_dc(samples: Column) -> Column:
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / F.size(samples)
    return F.transform(samples, lambda x: x - mean)


def frames(clips: DataFrame, key: str, samples: str, length: int, hop: int, most: int) -> DataFrame:
    """One row a frame: key, frame_idx, first_sample, samples. A clip shorter than a frame has one zero-padded frame."""
    starts = frame_starts(F.size(samples).cast("long"), length, hop, most)
    rows = clips.where(F.size(samples) > 0).select(key, F.col(samples).alias("_all"), F.posexplode(starts).alias("frame_idx", "first_sample"))
    return rows.select(key, "frame_idx", "first_sample", fit_window(F.slice("_all", (F.col("first_sample") + 1).cast("int"), length), length).alias("samples"))


def pad_and_clip(events: DataFrame, padding: float) -> DataFrame:
    """Adds first_sample and stop_sample of each padded event; events without a sample are left out.

    Needs start_s, end_s, duration_seconds, sample_rate_hz and sample_count.
    """
    start = F.greatest(F.lit(0.0), F.col("start_s") - padding)
    end = F.least(F.col("duration_seconds"), F.col("end_s") + padding)
    first = F.greatest(F.lit(0).cast("long"), F.floor(start * F.col("sample_rate_hz")))
    stop = F.least(F.col("sample_count").cast("long"), F.ceil(end * F.col("sample_rate_hz")))
    return events.withColumn("first_sample", first).withColumn("stop_sample", stop).where("stop_sample > first_sample")


def clip_name(source_index: Column, event_id: Column) -> Column:
    return F.format_string("R%04d_%s", source_index, event_id)


def source_index(rows: DataFrame, encounter: str, path: str) -> DataFrame:
    """Position of each recording in its encounter, by case-folded path."""
    return rows.withColumn("source_index", F.row_number().over(Window.partitionBy(encounter).orderBy(casefolded(F.col(path)), path)))


def extract_clips(events: DataFrame, chunks: DataFrame, chunk_samples: int) -> DataFrame:
    """Cut the samples [first_sample, stop_sample) of each event out of its recording's chunks.

    ``chunks``: recording_id, chunk_no, pcm (2 bytes a sample). Each event asks for the chunks it
    touches, so the range condition is an equality join; pieces are joined again in order.
    """
    first, stop = F.col("first_sample"), F.col("stop_sample")
    asked = events.withColumn("chunk_no", F.explode(F.sequence(F.floor(first / chunk_samples), F.floor((stop - 1) / chunk_samples))))
    both = asked.join(chunks.select("recording_id", "chunk_no", "pcm"), ["recording_id", "chunk_no"])
    begin = F.col("chunk_no") * chunk_samples
    a, b = F.greatest(first - begin, F.lit(0)), F.least(stop - begin, F.lit(chunk_samples))
    piece = F.substring(F.col("pcm"), (1 + 2 * a).cast("int"), (2 * (b - a)).cast("int"))
    keys = [c for c in events.columns]
    cut = both.withColumn("_piece", piece).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk_no", "_piece"))).alias("_pieces"))
    joined = F.aggregate("_pieces", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["_piece"]))
    return cut.withColumn("pcm", joined).drop("_pieces")
