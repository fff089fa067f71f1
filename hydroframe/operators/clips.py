"""Amplitude and frame statistics of clips, their quality flags and feature records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.functions.columns import TINY, safe_ratio_db


def amplitude_stats(samples: DataFrame, key: str, value: str, near_fraction: float) -> DataFrame:
    """Per clip over its 16-bit samples: rms, rms_dbfs, dc, clipping, near-clipping and zero fractions."""
    x = F.col(value)
    share = lambda test: F.avg(test.cast("double"))
    out = samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sqrt(F.avg((x / 32768.0) * (x / 32768.0))).alias("rms_fraction"), F.avg(x / 32768.0).alias("dc_fraction"),
        share(F.abs(x) >= 32767).alias("exact_clipping_fraction"), share(F.abs(x) >= near_fraction * 32768.0).alias("near_clipping_fraction"), share(x == 0).alias("zero_fraction"),
    )
    return out.withColumn("rms_dbfs", 20.0 * F.log10(F.greatest("rms_fraction", F.lit(TINY))))


def frame_rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.size(samples))


def frame_dynamics(frame_rows: DataFrame, key: str, rms: str = "rms") -> DataFrame:
    """Per clip: rms_q10, rms_q50, rms_q90, temporal_dynamic_db and low_activity_frame_fraction over frame RMS values.

    A frame is of low activity if under a hundredth of its clip's loudest frame.
    """
    rows = frame_rows.select(key, rms, F.max(rms).over(Window.partitionBy(key)).alias("_max"))
    low = (F.col(rms) < F.greatest(F.col("_max") * 0.01, F.lit(TINY))).cast("double")
    each = rows.groupBy(key).agg(F.percentile(rms, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.avg(low).alias("low_activity_frame_fraction"))
    q = [F.get("q", F.lit(k)) for k in range(3)]
    return each.select(key, *[c.alias(f"rms_q{n}") for c, n in zip(q, (10, 50, 90), strict=True)], safe_ratio_db(q[2] * q[2], q[0] * q[0]).alias("temporal_dynamic_db"), "low_activity_frame_fraction")


def quality_flags(flags: dict[str, float]) -> Column:
    """Flags in their fixed order, from the columns of amplitude_stats, duration_seconds and core_tonal_component_frame_fraction."""
    c = F.col
    rules = [
        (c("exact_clipping_fraction") > flags["exact_clipping_min_fraction"], "exact_clipping_detected"),
        (c("near_clipping_fraction") >= flags["near_clipping_min_fraction"], "near_clipping_ge_threshold"),
        (F.abs(c("dc_fraction")) >= flags["large_dc_offset_fraction_full_scale"], "large_dc_offset"),
        (c("rms_dbfs") <= flags["very_low_rms_dbfs"], "very_low_rms"),
        (c("zero_fraction") >= flags["large_zero_fraction"], "large_zero_fraction"),
        (c("core_tonal_component_frame_fraction") < flags["low_tonal_component_frame_fraction"], "low_tonal_component_coverage"),
        (c("duration_seconds") > flags["nonloop_long_duration_seconds"], "nonloop_duration_gt_3s"),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in rules]), lambda x: x.isNotNull())
