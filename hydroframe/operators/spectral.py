"""Spectra, tonal salience and connected components; many clips a task, numpy inside."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.functions.columns import TINY


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def power_spectrum(frames: np.ndarray) -> np.ndarray:
    """Squared magnitude of the real spectrum of frames without their mean under a periodic Hann window."""
    frames = frames.astype(np.float32)
    frames = frames - frames.mean(axis=1, keepdims=True, dtype=np.float64).astype(np.float32)
    spectrum = np.fft.rfft(frames * hann(frames.shape[1]).astype(np.float32), axis=1)
    return np.abs(spectrum).astype(np.float64) ** 2


def _along(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sum around each element; beyond the edge the edge's element stands."""
    half = len(kernel) // 2
    pad = [(half, half) if k == axis else (0, 0) for k in range(x.ndim)]
    wide = np.pad(x, pad, mode="edge")
    return sum(w * np.take(wide, range(k, k + x.shape[axis]), axis=axis) for k, w in enumerate(kernel))


def gaussian(x: np.ndarray, sigma: float, axis: int) -> np.ndarray:
    if sigma <= 0:
        return x
    r = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    kernel = np.exp(-(r**2) / (2 * sigma**2))
    return _along(x, kernel / kernel.sum(), axis)


def tonal_salience(power: np.ndarray, bin_hz: float, audit: dict) -> np.ndarray:
    """Smoothed level in dB above its moving average along frequency, odd in width and three bins at least."""
    smooth = gaussian(10 * np.log10(power + TINY), audit["tonal_smoothing_time_sigma_frames"], 0)
    smooth = gaussian(smooth, audit["tonal_smoothing_frequency_sigma_bins"], 1)
    width = max(3, round(audit["tonal_local_baseline_width_hz"] / bin_hz))
    width += width % 2 == 0
    return smooth - _along(smooth, np.full(width, 1 / width), 1)


def label_runs(rows: list[int], edges: Iterable[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """(row, begin, stop, row and begin of the first run of its 8-connected component) of each run.

    ``rows``: numbers in ascending order; ``edges``: for each row where runs begin and stop, in turn.
    """
    up: list[int] = []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out: list[tuple[int, int, int]] = []
    before, last = [], None  # runs of the row before: begin, stop, number
    for row, edge in zip(rows, edges, strict=True):
        now, at = [], 0
        above = before if last is not None and row == last + 1 else []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            number = len(up)
            up.append(number)
            while at < len(above) and above[at][1] < a:
                at += 1
            for c, d, other in above[at:]:
                if c > b:
                    break
                i, j = find(number), find(other)  # they touch, corners included
                up[max(i, j)] = min(i, j)
            now.append((a, b, number))
            out.append((row, a, b))
        before, last = now, row
    return [(*x, *out[find(k)][:2]) for k, x in enumerate(out)]


def label_components(mask: np.ndarray) -> np.ndarray:
    """Numbers of the 8-connected components of a mask, by scan order of their first cells; 0 outside."""
    found = label_runs(list(range(len(mask))), (np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]]))) for line in mask))
    names: dict[tuple[int, int], int] = {}
    labels = np.zeros(mask.shape, np.int32)
    for row, a, b, *first in found:
        labels[row, a:b] = names.setdefault(tuple(first), len(names) + 1)
    return labels


def clip_cells(frames: DataFrame, key: str, bin_hz: float, audit: dict) -> DataFrame:
    """Cells of tonal components: key, component, frame_idx, freq_hz, v; and of each clip n_frames and n_components.

    ``frames``: key, frame_idx, samples. The clips of a partition come one after the other; each is
    held for itself. Clips without a component have one row with component 0.
    """

    return _by_clip(frames, key, lambda name, own: cells_of(name, *tonal_band(own, bin_hz, audit), audit["tonal_salience_threshold_db"]))


def tonal_band(frames: list, bin_hz: float, audit: dict) -> tuple[np.ndarray, np.ndarray]:
    """Salience of a clip's frames and frequencies of its bins, within the tonal band."""
    power = power_spectrum(np.stack(frames))
    freqs = np.arange(power.shape[1]) * bin_hz
    band = (freqs >= audit["core_tonal_lower_hz"]) & (freqs <= min(audit["core_tonal_upper_hz"], freqs[-1]))
    return tonal_salience(power, bin_hz, audit)[:, band], freqs[band]


def cells_of(name, salience: np.ndarray, freqs: np.ndarray, threshold: float) -> pd.DataFrame:
    labels = label_components(salience >= threshold)
    f, b = np.nonzero(labels)
    n = int(labels.max()) if labels.size else 0
    if not n:
        return pd.DataFrame({"clip": [name], "component": [0], "frame_idx": [None], "freq_hz": [None], "v": [None], "n_frames": [len(salience)], "n_components": [0]})
    return pd.DataFrame({"clip": name, "component": labels[f, b], "frame_idx": f, "freq_hz": freqs[b], "v": salience[f, b], "n_frames": len(salience), "n_components": n})


CELLS = "component int, frame_idx long, freq_hz double, v double, n_frames long, n_components long"


def _by_clip(frames: DataFrame, key: str, one, columns: str = CELLS) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, own = None, []
        for batch in batches:
            for k, s in zip(batch[key], batch["samples"], strict=True):
                if own and k != name:
                    yield one(name, own)
                    own = []
                name = k
                own.append(np.asarray(s))
        if own:
            yield one(name, own)

    kind = dict(frames.dtypes)[key]
    rows = frames.select(key, "frame_idx", "samples").repartition(key).sortWithinPartitions(key, "frame_idx").select(key, "samples")
    return rows.mapInPandas(run, f"clip {kind}, {columns}").withColumnRenamed("clip", key)


@dataclass(frozen=True)
class Tonal:
    """What the summary of a clip's components depends on: seconds a frame, upper limit of the band, least duration."""

    hop_s: float
    upper_hz: float
    least_duration_s: float


SUMMARY = """found boolean, candidate_count long, frame_fraction double, duration_seconds double, pixel_count long, score double, median_salience double, peak_salience double,
frequency_q05 double, frequency_q50 double, frequency_q95 double, frequency_q99 double, bandwidth_q90 double, frequency_max double"""


SUMMARY_NAMES = [x.split()[0] for x in SUMMARY.replace("\n", " ").split(", ")]


def summary_of(name, salience: np.ndarray, freqs: np.ndarray, threshold: float, tonal: Tonal) -> pd.DataFrame:
    """summary_values as one row."""
    return pd.DataFrame([[name, *summary_values(salience, freqs, threshold, tonal)]], columns=["clip", *SUMMARY_NAMES])


def summary_values(salience: np.ndarray, freqs: np.ndarray, threshold: float, tonal: Tonal) -> list:
    """SUMMARY of the best component of a clip's grid, the one with the largest score, of equals the first.

    Components with too few distinct frames don't count. A clip without one has frame fraction and
    duration 0 and nulls for the rest, and still the number of its components.
    """
    labels = label_components(salience >= threshold)
    row, column = np.nonzero(labels)
    own, v, freq = labels[row, column], salience[row, column], freqs[column]
    least = max(2, math.ceil(tonal.least_duration_s / tonal.hop_s))
    best, most = None, -np.inf
    n = int(own.max()) if len(own) else 0
    order = np.argsort(own, kind="stable")
    for cells in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if n else []:
        frames = len(np.unique(row[cells]))
        if frames >= least:
            compact = math.sqrt(frames) / math.sqrt(max(len(cells) / frames, 1.0))
            score = np.maximum(v[cells], 0).sum() * compact / (1 + 0.15 * np.median(freq[cells]) / max(tonal.upper_hz, 1.0))
            if score > most:
                best, most, best_frames = cells, score, frames
    if best is None:
        return [False, n, 0.0, 0.0, 0, *[None] * 9]
    f, w = freq[best], np.maximum(v[best], np.finfo(float).eps)
    by_freq = np.argsort(f, kind="stable")
    upto = np.cumsum(w[by_freq])
    q = [float(f[by_freq][min(np.searchsorted(upto, x * upto[-1]), len(f) - 1)]) for x in (0.05, 0.5, 0.95, 0.99)]
    return [True, n, best_frames / len(salience), best_frames * tonal.hop_s, len(best), float(most), float(np.median(v[best])), float(v[best].max()), *q, q[2] - q[0], float(f.max())]


def grid_summary(grid: DataFrame, key: str, threshold: float, tonal: Tonal) -> DataFrame:
    """summary_of each clip of ready-made grids: ``grid`` has key, frame_idx and samples, a row of the grid; the frequency is the bin."""
    return _by_clip(grid, key, lambda name, own: summary_of(name, np.stack(own).astype(float), np.arange(len(own[0]), dtype=float), threshold, tonal), SUMMARY)


def clip_summary(frames: DataFrame, key: str, bin_hz: float, audit: dict, tonal: Tonal) -> DataFrame:
    """summary_of each clip, from its frames to spectrum, salience and components in one step."""
    return _by_clip(frames, key, lambda name, own: summary_of(name, *tonal_band(own, bin_hz, audit), audit["tonal_salience_threshold_db"], tonal), SUMMARY)


def moving_average(cells: DataFrame, keys: list[str], position: str, value: str, width: int, name: str) -> DataFrame:
    """Centred average over ``width`` (odd) cells of a row, where edge cells stand for those beyond; built-in functions only."""
    half = width // 2
    order = Window.partitionBy(*keys).orderBy(position)
    near = order.rowsBetween(-half, half)
    whole = Window.partitionBy(*keys)
    rows = cells.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(whole))
    first, last = F.first(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    low, high = F.greatest(F.lit(0), half + 1 - F.col("_k")), F.greatest(F.lit(0), F.col("_k") + half - F.col("_n"))
    return rows.withColumn(name, (F.sum(value).over(near) + low * first + high * last) / width).drop("_k", "_n")


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """resample_stack of one signal; several channels are averaged first."""
    x = np.asarray(x, np.float32)
    if x.ndim == 2:
        x = x.mean(axis=1, dtype=np.float32)
    return resample_stack(x[None, :], source, target)[0]


def resample_stack(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Rational polyphase resampling of signals of one length, a row each, with a Kaiser window (beta 8.6).

    Outputs of one phase see every up-th tap, at inputs that move on by ``down``: strided windows times a few taps.
    """
    if source == target or not x.shape[1]:
        return np.asarray(x, np.float32)
    g = math.gcd(source, target)
    up, down = target // g, source // g
    most = max(up, down)
    half = 10 * most
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / most) / most * np.kaiser(2 * half + 1, 8.6)
    taps = taps / taps.sum() * up
    out = np.empty((len(x), -(-x.shape[1] * up // down)), np.float32)
    reach = half // up + 1  # inputs on either side that a tap can meet
    wide = np.pad(np.asarray(x, np.float64), ((0, 0), (reach, reach + down)))
    for first in range(min(up, out.shape[1])):
        at, phase = divmod(first * down, up)
        own = np.arange(-reach, reach + 1) * -up + phase + half  # the tap that meets each input around it
        weight = np.where((own >= 0) & (own < len(taps)), taps[np.clip(own, 0, len(taps) - 1)], 0.0)
        count = -(-(out.shape[1] - first) // up)
        windows = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis=1)[:, at :: down][:, :count]
        out[:, first::up] = windows @ weight
    return out


def window_view(samples: np.ndarray, rate: int, **settings) -> tuple[np.ndarray, float, float, float, float]:
    """window_stack of one window."""
    grids, *bounds = window_stack([samples], rate, **settings)
    return grids[0], *bounds


def window_stack(samples: list[np.ndarray], rate: int, *, window_s=3.0, target=96_000, fmax=30_000.0, frame_ms=20.0, hop_ms=2.5, top=99.7, span_db=70.0) -> tuple[np.ndarray, float, float, float, float]:
    """Detector windows of one rate as grids of levels from 0 to 1, one stack, and the bounds of their cells in time and frequency."""
    need, full = max(1, round(window_s * rate)), round(window_s * target)
    x = np.zeros((len(samples), need), np.float32)
    for row, own in zip(x, samples, strict=True):
        row[: min(need, len(own))] = np.asarray(own[:need], np.float32) / 32768
    x = resample_stack(x, rate, target)
    x = x - x.mean(axis=1, keepdims=True, dtype=np.float64).astype(np.float32)
    x = np.pad(x[:, :full], ((0, 0), (0, max(0, full - x.shape[1]))))
    length, hop = max(16, round(frame_ms * target / 1000)), max(1, round(hop_ms * target / 1000))
    nfft = 1 << (length - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, -(x.shape[1] - length) % hop)))
    w = hann(length)
    keep = np.arange(nfft // 2 + 1) * target / nfft <= fmax
    frames = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)[:, ::hop]
    grids = np.empty((len(x), int(keep.sum()), frames.shape[1]), np.float32)
    for grid, own in zip(grids, frames, strict=True):  # the spectra of one window at a time bound the memory
        db = 10 * np.log10(np.maximum(np.abs(np.fft.rfft(own * w, nfft, axis=1)[:, keep] / w.sum()) ** 2, np.finfo(np.float32).tiny))
        high = float(np.percentile(db, top))
        grid[:] = np.clip((db - high + span_db) / max(span_db, 1e-7), 0, 1).T
    step, bin_hz = hop / target, target / nfft
    t0 = length / 2 / target
    return grids, t0 - step / 2, t0 + (frames.shape[1] - 1) * step + step / 2, 0.0, min(target / 2, (keep.sum() - 1) * bin_hz + bin_hz / 2)


def window_bounds(rate: int = 96_000) -> tuple[float, float, float, float]:
    """Bounds in time and frequency of every window's grid; they hang on the settings alone."""
    return window_view(np.zeros(1, np.int16), rate)[1:]


#: Windows whose grids are made together.
STACK = 8
WINDOW_GRIDS = "recording_id string, window_index int, grid array<array<float>>, t0 double, t1 double, f0 double, f1 double"


def window_spectrograms(windows: DataFrame) -> DataFrame:
    """The grid of each row (recording_id, window_index, sample_rate_hz, pcm), with the bounds of its cells; windows of one rate are worked on in stacks."""

    def listed(stack: np.ndarray) -> pa.Array:
        count, height, width = stack.shape
        lines = pa.ListArray.from_arrays(pa.array(np.arange(count * height + 1, dtype=np.int32) * width), pa.array(stack.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * height), lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = batch["sample_rate_hz"].to_numpy(zero_copy_only=False)
            for rate in np.unique(rates):
                own = np.flatnonzero(rates == rate)
                for at in range(0, len(own), STACK):
                    rows = batch.take(pa.array(own[at : at + STACK]))
                    grids, *bounds = window_stack([np.frombuffer(x.as_buffer(), "<i2") for x in rows["pcm"]], int(rate))
                    yield pa.RecordBatch.from_arrays([rows["recording_id"], rows["window_index"], listed(grids), *[pa.array([b] * len(rows)) for b in bounds]], names=["recording_id", "window_index", "grid", "t0", "t1", "f0", "f1"])

    return windows.select(F.col("recording_id").cast("string").alias("recording_id"), F.col("window_index").cast("int").alias("window_index"), "sample_rate_hz", "pcm").mapInArrow(run, WINDOW_GRIDS)
