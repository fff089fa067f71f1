"""The feature record of clips, from their bytes in one pass."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hydroframe.functions.columns import TINY
from hydroframe.operators.spectral import SUMMARY_NAMES, Tonal, summary_values, tonal_band

AMPLITUDE = ("rms_fraction", "dc_fraction", "exact_clipping_fraction", "near_clipping_fraction", "zero_fraction", "rms_dbfs")
DYNAMICS = ("rms_q10", "rms_q50", "rms_q90", "temporal_dynamic_db", "low_activity_frame_fraction")
TONAL = {
    "found": "found", "frame_fraction": "frame_fraction", "duration_seconds": "duration_seconds", "median_salience": "median_salience_db", "peak_salience": "peak_salience_db",
    "bandwidth_q90": "bandwidth_q90_hz", "frequency_max": "frequency_max_hz", "frequency_q05": "frequency_q05_hz", "frequency_q50": "frequency_q50_hz", "frequency_q95": "frequency_q95_hz", "frequency_q99": "frequency_q99_hz",
}


def as_fractions(samples: bytes, kind: str = "<i2") -> np.ndarray:
    """Samples as fractions of full scale: unsigned numbers about the middle of their range, signed ones by its larger side, floats as they are (undefined ones 0)."""
    x = np.frombuffer(samples, kind)
    if x.dtype.kind == "f":
        return np.nan_to_num(x.astype(np.float64))
    low, high = float(np.iinfo(x.dtype).min), float(np.iinfo(x.dtype).max)
    middle, scale = ((high + low) / 2, (high - low) / 2) if x.dtype.kind == "u" else (0.0, -low)
    return (x.astype(np.float64) - middle) / scale


def starts_of(n: int, length: int, hop: int, most: int) -> np.ndarray:
    """Starts on the hop grid; beyond ``most`` frames, evenly spaced distinct starts. Short input has the one start 0."""
    available = 1 + (n - length) // hop
    if n < length or most == 1 and available > 1:
        return np.zeros(1, int)
    if available <= most:
        return np.arange(available) * hop
    last = n - length
    even = np.floor(np.arange(most) * (last / (most - 1))).astype(int)
    even[-1] = last
    return np.unique(even)


def amplitude_of(x: np.ndarray, near_fraction: float) -> list[float]:
    """AMPLITUDE of 16-bit samples."""
    share = x / 32768.0
    rms = math.sqrt(np.mean(share * share))
    size = np.abs(x.astype(np.int32))
    return [rms, float(share.mean()), float((size >= 32767).mean()), float((size >= near_fraction * 32768.0).mean()), float((x == 0).mean()), 20 * math.log10(max(rms, TINY))]


def dynamics_of(frames: np.ndarray) -> list[float | None]:
    """DYNAMICS over the root mean squares of frames."""
    rms = np.sqrt((frames * frames).mean(axis=1))
    low, middle, high = np.percentile(rms, [10, 50, 90]).tolist()
    return [low, middle, high, 10 * math.log10(high * high / (low * low)) if low > 0 and high > 0 else None, float((rms < max(rms.max() * 0.01, TINY)).mean())]


def clip_records(bag: DataFrame, rate: int, audit: dict, near_fraction: float) -> DataFrame:
    """The clips of one sample rate with AMPLITUDE, DYNAMICS and the best tonal component, and without their pcm.

    ``bag``: sample_rate_hz, sample_count, pcm (16-bit) and others. Each clip is decoded once, and amplitude,
    frames, spectra and components come from that buffer, in one step. An empty clip has nulls.
    """
    length = max(16, round(audit["window_seconds"] * rate))
    hop = max(1, round(length * audit["hop_fraction"]))
    tonal = Tonal(hop / rate, min(audit["core_tonal_upper_hz"], (length // 2) * rate / length), audit["tonal_minimum_duration_seconds"])
    own = bag.where(F.col("sample_rate_hz") == rate)
    kept = own.drop("pcm").columns
    schema = StructType.fromJson(own.drop("pcm").schema.jsonValue())
    for name in (*AMPLITUDE, *DYNAMICS):
        schema = schema.add(name, "double")
    kinds = {"found": "boolean", "candidate_count": "long", "pixel_count": "long"}
    for name in SUMMARY_NAMES:
        schema = schema.add(f"_{name}", kinds.get(name, "double"))
    arrow = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}
    added = [pa.float64()] * (len(AMPLITUDE) + len(DYNAMICS)) + [arrow[kinds.get(n, "double")] for n in SUMMARY_NAMES]

    def record(pcm: bytes | None) -> list:
        x = np.frombuffer(pcm or b"", "<i2")
        if not len(x):
            return [None] * len(added)
        fit = np.pad(as_fractions(pcm), (0, max(0, length - len(x))))
        frames = np.lib.stride_tricks.sliding_window_view(fit, length)[starts_of(len(x), length, hop, int(audit["max_frames_per_clip"]))]
        return [*amplitude_of(x, near_fraction), *dynamics_of(frames), *summary_values(*tonal_band(frames, rate / length, audit), audit["tonal_salience_threshold_db"], tonal)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = zip(*(record(x.as_py()) for x in batch["pcm"]), strict=True)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *(pa.array(c, k) for c, k in zip(made, added, strict=True))], names=schema.names)

    out = own.select(*kept, "pcm").mapInArrow(run, schema)
    prefix = "core_tonal_component_"
    renamed = [F.col(f"_{a}").alias(prefix + b) for a, b in TONAL.items()] + [F.col(f"_{n}").alias(n) for n in SUMMARY_NAMES if n not in TONAL]
    return out.select(*kept, *AMPLITUDE, *DYNAMICS, *renamed)
