import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroframe.functions.columns import casefolded, clean_numeric, stable_sigmoid
from hydroframe.operators import audio, bags, events, frames, grid, model, selection, spectral

DETECTION = "recording_id string, seq long, start_s double, end_s double, fmin_hz double, fmax_hz double, confidence double, windows array<int>, raw_count int"


def test_starts(spark):
    row = lambda c: spark.range(1).select(c).first()[0]
    for (n, length, hop), want in {(10, 3, 2): [0, 2, 4, 6, 7], (9, 3, 3): [0, 3, 6], (3, 3, 1): [0], (2, 3, 1): [0]}.items():
        assert row(frames.sliding_windows(F.lit(n), length, hop)) == want
    for (n, length, hop, most), want in {(10, 4, 2, 9): [0, 2, 4, 6], (10, 4, 2, 3): [0, 3, 6], (3, 4, 2, 9): [0], (10, 4, 1, 4): [0, 2, 4, 6]}.items():
        assert row(frames.frame_starts(F.lit(n), length, hop, most)) == want


def test_two_windows_merge_and_one_window_stays_apart(spark):
    rows = [("r", 0, 0.40, 0.70, 8000.0, 11000.0, 0.8, [0], 1), ("r", 1, 0.41, 0.71, 8000.0, 11000.0, 0.9, [1], 1), ("r", 2, 0.42, 0.69, 8000.0, 11000.0, 0.7, [0], 1), ("q", 3, 5.0, 6.0, 1.0, 2.0, 0.5, [4], 1)]
    got = {r.event_id: r for r in events.merge_events(spark.createDataFrame(rows, DETECTION)).where("recording_id = 'r'").collect()}
    assert sorted(got) == ["W0001", "W0002"]
    first = got["W0001"]
    assert (first.start_s, first.end_s, first.windows, first.raw_count, first.confidence) == (0.40, 0.71, [0, 1], 2, 0.9)


def test_bag_of_one_feature(spark):
    rows = spark.createDataFrame([("e", 1.0, None), ("e", 2.0, None), ("e", 4.0, None), ("e", float("nan"), float("inf"))], "encounter_id string, x double, y double")
    r = bags.bag_statistics(rows, "encounter_id", ["x", "y"]).first()
    want = {"mean": 7 / 3, "std": math.sqrt(14 / 9), "minimum": 1, "q25": 1.5, "median": 2, "q75": 3, "maximum": 4, "missing_fraction": 0.25}
    assert all(abs(r[f"x__{k}"] - v) < 1e-12 for k, v in want.items())
    assert r.y__missing_fraction == 1 and all(r[f"y__{s}"] is None for s in bags.STATISTICS)
    with pytest.raises(ValueError):
        bags.bag_statistics(rows, "encounter_id", ["x"], ("mode",))


def test_scores_and_faulty_heads(spark):
    heads = [(h, label, p, 0.0, 0.2 * h, "logistic_regression") for h, label in enumerate(model.LABELS) for p in range(2)]
    schema = "label_idx int, label string, pos int, coef double, intercept double, kind string"
    encoded = spark.createDataFrame([("e", 0, "x", 3.0), ("e", 1, "x__missing", 0.0)], "encounter_id string, pos int, name string, value double")
    got = {r.label: r.score for r in model.linear_heads(encoded, "encounter_id", spark.createDataFrame(heads, schema)).collect()}
    assert all(abs(got[label] - 1 / (1 + math.exp(-0.2 * h))) < 1e-12 for h, label in enumerate(model.LABELS))
    assert model.validate_heads(spark.createDataFrame(heads, schema), 2).count() == 0
    bad = [(h, label, p, c, float("nan") if h == 1 else i, k) for h, label, p, c, i, k in heads]
    assert [tuple(r) for r in model.validate_heads(spark.createDataFrame(bad, schema), 2).collect()] == [("intercept is not finite", "Travelling")]


def test_columns(spark):
    r = spark.range(1).select(clean_numeric(F.lit("nan")), clean_numeric(F.lit("x")), clean_numeric(F.lit(2.5)), stable_sigmoid(F.lit(-800.0)), stable_sigmoid(F.lit(800.0))).first()
    assert list(r) == [None, None, 2.5, 0.0, 1.0]


def test_components_scan_order_and_corners():
    mask = np.array([[0, 1, 0, 0, 1], [1, 0, 0, 0, 1], [0, 0, 0, 0, 0], [1, 0, 1, 0, 0], [0, 1, 0, 0, 0]], bool)
    assert spectral.label_components(mask).tolist() == [[0, 1, 0, 0, 2], [1, 0, 0, 0, 2], [0] * 5, [3, 0, 3, 0, 0], [0, 3, 0, 0, 0]]


def test_spectra_closed_forms():
    n = 64
    tone = np.sin(2 * np.pi * 8 * np.arange(n) / n)[None, :]
    power = spectral.power_spectrum(tone)
    assert power[0].argmax() == 8 and abs(power[0, 8] - (n / 4) ** 2) < 1e-3
    flat = spectral.tonal_salience(np.ones((5, 40)), 1.0, {"tonal_smoothing_time_sigma_frames": 0.8, "tonal_smoothing_frequency_sigma_bins": 1.0, "tonal_local_baseline_width_hz": 5.0})
    assert abs(flat).max() < 1e-9
    x = np.sin(2 * np.pi * 1000 * np.arange(2880) / 288_000).astype(np.float32)
    y = spectral.resample(x, 288_000, 96_000)
    assert len(y) == 960 and abs(y[100:-100] - np.sin(2 * np.pi * 1000 * np.arange(960) / 96_000)[100:-100]).max() < 1e-2
    grid, t0, _, f0, _ = spectral.window_view(np.zeros(9600, np.int16), 96_000)
    assert grid.shape[0] == 641 and abs(t0 - 0.00875) < 1e-12 and f0 == 0.0


def test_boxes_of_a_long_recording_are_spread(spark):
    boxes = spark.range(4000).selectExpr("1L AS recording_id", "id AS seq", "CAST(id DIV 2 AS int) AS window_index", "0.5D AS x", "0.5D AS y", "0.2D AS w", "0.2D AS h", "0.3D + id % 2 * 0.1D AS confidence").repartition(4, "recording_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = events.admit_boxes(boxes).select("seq", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.seq for r in got) == list(range(1, 4000, 2))
    assert len({r.task for r in got}) > 1


def plain_merge(rows, gap=0.04, time_iou=0.25, overlap=0.55, frequency_iou=0.10):
    """Events of one recording by the rule as it is written: every detection against every cluster, all bounds anew each time."""
    clusters = []

    def median(members, column):
        every = sorted((m[column], max(1e-6, m[5])) for m in members)
        half, upto = sum(w for _, w in every) / 2, 0
        for value, w in every:
            upto += w
            if upto >= half - 1e-12:
                return value

    for d in sorted(rows, key=lambda d: (d[1], -d[5], d[0])):
        scores = []
        for k, c in enumerate(clusters):
            if {w for m in c for w in m[6]} & set(d[6]):
                continue
            a, b, f, g = min(m[1] for m in c), max(m[2] for m in c), median(c, 3), median(c, 4)
            both, span, short = max(0, min(b, d[2]) - max(a, d[1])), max(b, d[2]) - min(a, d[1]), min(b - a, d[2] - d[1])
            t, o = both / span if span > 0 else 0, both / short if short > 0 else 0
            fi = max(0, min(g, d[4]) - max(f, d[3])) / (max(g, d[4]) - min(f, d[3]))
            apart = max(0, max(a, d[1]) - min(b, d[2]))
            if (t >= time_iou or o >= overlap or apart <= gap) and fi >= frequency_iou:
                scores.append((2 * t + o + fi - apart, k))
        if scores:
            clusters[max(scores)[1]].append(d)
        else:
            clusters.append([d])
    out = [(min(m[1] for m in c), k, max(m[2] for m in c), median(c, 3), median(c, 4), max(m[5] for m in c), sorted({w for m in c for w in m[6]}), sum(m[7] for m in c)) for k, c in enumerate(clusters)]
    return [(f"W{n:04d}", s, *rest) for n, (s, _, *rest) in enumerate(sorted(out, key=lambda x: x[:2]), 1)]


def test_merged_events_equal_the_written_rule(spark):
    rng, rows = random.Random(4), []
    for recording in range(12):
        at = 0.0
        for k in range(60):
            at += rng.choice([0.0, 0.0, 0.05, 0.1, 0.3, 2.0])
            fmin = rng.choice([1000.0, 2000.0, 5000.0]) + rng.random() * 500
            rows.append((str(recording), recording * 100 + k, at, at + rng.choice([0.0, 0.1, 0.2, 0.9]), fmin, fmin + rng.choice([500.0, 3000.0]), rng.choice([0.5, 0.7, rng.random()]), rng.sample(range(6), rng.choice([1, 1, 2])), rng.randint(1, 3)))
    for sweeps in (0, 1, 3):
        got = events.merge_events(spark.createDataFrame(rows, DETECTION).repartition(5), sweeps=sweeps).collect()
        for recording in range(12):
            own = sorted((r.event_id, r.start_s, r.end_s, r.fmin_hz, r.fmax_hz, r.confidence, list(r.windows), r.raw_count) for r in got if r.recording_id == str(recording))
            assert own == plain_merge([r[1:] for r in rows if r[0] == str(recording)])


def test_bounds_of_ready_made_events(spark):
    rows = [("r", 0.0, 2.0, 10.0, 20.0, 0.2), ("r", 1.0, 3.0, 30.0, 40.0, 0.9), ("r", 1.0, 1.5, 50.0, 60.0, 0.3)]
    got = events.event_bounds(spark.createDataFrame(rows, "event string, start_s double, end_s double, fmin_hz double, fmax_hz double, confidence double"), ["event"]).first()
    assert tuple(got) == ("r", 0.0, 3.0, 30.0, 40.0)


def test_windows_meet_their_boxes(spark):
    windows = spark.createDataFrame([("r", 0, 5), ("r", 1, 6)], "recording_id string, window_index int, start_sample int")
    boxes = spark.createDataFrame([("r", 1, 7.0), ("r", 1, 8.0), ("q", 0, 9.0)], "recording_id string, window_index int, x double")
    assert sorted((r.window_index, r.start_sample, r.x) for r in events.windows_with_boxes(windows, boxes).collect()) == [(1, 6, 7.0), (1, 6, 8.0)]


def test_summary_without_and_with_components():
    tonal = spectral.Tonal(0.01, 63.0, 0.02)
    grid = np.zeros((4, 8))
    none = spectral.summary_of("c", grid, np.arange(8.0), 0.5, tonal).iloc[0]
    assert not none.found and none.duration_seconds == 0 and none.frame_fraction == 0 and none.score is None and none.candidate_count == 0
    grid[0, 2] = grid[1, 3] = 1.0
    grid[3, 7] = 9.0  # a single frame does not count
    one = spectral.summary_of("c", grid, np.arange(8.0), 0.5, tonal).iloc[0]
    assert one.found and (one.candidate_count, one.pixel_count, one.frame_fraction, one.frequency_q05, one.frequency_max) == (2, 2, 0.5, 2.0, 3.0)
    assert abs(one.score - 2 * math.sqrt(2) / (1 + 0.15 * 2.5 / 63)) < 1e-12


def plain_pairs(rows, gap_s=0.04, time_iou=0.25, overlap=0.55, frequency_iou=0.10):
    out = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and not set(a[7]) & set(b[7]):
                both, span, short = max(0, min(a[3], b[3]) - max(a[2], b[2])), max(a[3], b[3]) - min(a[2], b[2]), min(a[3] - a[2], b[3] - b[2])
                t, o = both / span if span > 0 else 0, both / short if short > 0 else 0
                f = max(0, min(a[5], b[5]) - max(a[4], b[4])) / (max(a[5], b[5]) - min(a[4], b[4]))
                gap = max(0, max(a[2], b[2]) - min(a[3], b[3]))
                if (t >= time_iou or o >= overlap or gap <= gap_s) and f >= frequency_iou:
                    out[a[0], a[1], b[1]] = 2 * t + o + f - gap
    return out


def test_pairs_of_lengths_from_a_millisecond_to_an_hour(spark):
    rng, rows = random.Random(8), []
    for k in range(700):
        start = rng.random() * 8000 if k % 3 else rng.random() * 20
        length = rng.choice([0.0, 0.001, 0.03, 0.4, 5.0, 60.0, 3600.0]) * rng.choice([1, rng.random()])
        fmin = rng.random() * 5000
        rows.append((f"r{k % 2}", k, start, start + length, fmin, fmin + 4000, 0.5, [k % 5], 1))
    rows += [("r0", 1000 + k, 64.0 * k, 64.0 * (k + 1), 10.0, 4000.0, 0.5, [100 + k], 1) for k in range(6)] + [("r1", 2000 + k, 7.5, 7.5, 10.0, 4000.0, 0.5, [k + 30], 1) for k in range(3)]
    df = spark.createDataFrame(rows, DETECTION)
    got = events.association_pairs(df).collect()
    want = plain_pairs(rows)
    assert len(got) == len(want) and all(abs(want[r.recording_id, r.seq_a, r.seq_b] - r.score) < 1e-9 for r in got)
    own, upward = events.interval_cells(df, F.col("start_s"), F.col("end_s") + 0.04)
    levels = df.select(F.ceil(F.log2(F.col("end_s") - F.col("start_s") + 0.04)).alias("k")).distinct().count()
    assert own.count() <= 2 * len(rows) and upward.count() <= 2 * levels * len(rows)
    assert max(r["count"] for r in upward.groupBy("seq").count().collect()) <= 2 * levels


def test_one_island_as_long_as_its_recording_is_spread_by_frequency(spark):
    rng, rows = random.Random(9), []
    for k in range(900):  # six bands; in the first every detection meets the next, so that no gap parts the recording
        band = k % 6
        start = 0.1 * k if band else 0.1 * k - 0.2
        fmin = 1000.0 + 3000 * band + rng.random() * 300
        rows.append(("r", k, start, start + (0.9 if band == 0 else rng.choice([0.05, 0.3])), fmin, fmin + 2000, rng.choice([0.5, 0.7]), [k // 3 % 40], 1))
    df = spark.createDataFrame(rows, DETECTION)
    assert events.islands(df, 0.04).agg(F.max("island")).first()[0] == 1
    sizes = [r["count"] for r in events.cells(df, 0.04).groupBy("cell").count().collect()]
    assert len(sizes) > 100 and max(sizes) <= 150
    got = events.merge_events(df).collect()
    assert sorted((r.event_id, r.start_s, r.end_s, r.fmin_hz, r.fmax_hz, r.confidence, list(r.windows), r.raw_count) for r in got) == plain_merge([r[1:] for r in rows])
    assert events.merge_events(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        events.merge_events(df, events.MERGE | {"frequency_iou": 0.0})


def test_quantiles_selected_by_bits_are_exact(spark):
    rng = random.Random(10)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 1.0000000000000002, 0.9999999999999999, -1.0]
    groups = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [7.0] * 500, "c": odd, "d": [float(rng.randrange(5)) for _ in range(999)], "e": [3.5], "f": [2.0**-k for k in range(900)] + [-(2.0**k) for k in range(900)], None: [1.0, 2.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("g", None)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("k", F.struct("k")).repartition(7)
    quantiles = [0.25, 0.5, 0.75, 0.0, 1.0, 0.1]
    got = {r.k.k: r.quantiles for r in selection.exact_quantiles(df, ["k"], "v", quantiles).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        own = sorted(values)
        for q, v in zip(quantiles, got[k], strict=True):
            place = (len(own) - 1) * q
            low, high = math.floor(place), math.ceil(place)
            assert v == (own[low] if low == high else (high - place) * own[low] + (place - low) * own[high]), (k, q)
    assert selection.exact_quantiles(df.where("false"), ["k"], "v", [0.5]).count() == 0


def test_statistics_of_unbounded_bags_equal_the_others(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, float("nan"), float(rng.randrange(30)), rng.random()]), None if k % 2 else 1.0) for k in range(800)] + [("z", None, float("inf"))]
    df = spark.createDataFrame(rows, "encounter_id string, a double, b double")
    for statistics in (bags.STATISTICS, ("maximum", "median"), ("mean",)):
        one = bags.bag_statistics(df, "encounter_id", ["a", "b"], statistics)
        many = bags.unbounded_bag_statistics(df, "encounter_id", ["a", "b"], statistics)
        assert one.columns == many.columns
        rounded = lambda d: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in d.collect())
        assert rounded(one) == rounded(many)


def cells_of_runs(runs):
    return {(r.row, b): r.component for r in runs.collect() for b in range(r.begin, r.stop)}


@pytest.mark.parametrize("tile_rows, share", [(1, 0.35), (4, 0.45), (7, 0.2), (100, 0.5)])
def test_components_across_seams_equal_those_of_one_piece(spark, tile_rows, share):
    rng = np.random.default_rng(tile_rows)
    mask = rng.random((60, 23)) < share
    labels = spectral.label_components(mask)
    rows = [(k, [float(x) for x in line]) for k, line in enumerate(mask)]
    got = cells_of_runs(grid.label_grid(spark.createDataFrame(rows, "row long, samples array<double>").repartition(5), 0.5, tile_rows))
    assert got == {(int(r), int(c)): int(labels[r, c]) for r, c in zip(*np.nonzero(labels))}


def test_a_snake_through_all_tiles_is_one_component_and_gaps_part(spark):
    rows = []
    for k in range(200):  # a path that turns at either side, so that the chain of seams is long
        line = [0.0] * 9
        for b in range(9) if k % 2 == 0 else [8 if k % 4 == 1 else 0]:
            line[b] = 1.0
        rows.append((k, line))
    df = spark.createDataFrame(rows, "row long, samples array<double>")
    assert set(cells_of_runs(grid.label_grid(df, 0.5, 1)).values()) == {1}
    parted = cells_of_runs(grid.label_grid(df.where("row <> 90"), 0.5, 8))
    assert {k[0] < 90: v for k, v in parted.items()} == {True: 1, False: 2}
    odd = spark.createDataFrame([(0, None), (1, [None, float("nan"), 1.0]), (2, []), (3, [1.0])], "row long, samples array<double>")
    assert cells_of_runs(grid.label_grid(odd, 0.5, 2)) == {(1, 2): 1, (3, 0): 2}
    assert grid.label_grid(df.where("false"), 0.5).count() == 0


def test_resampling_equals_the_sum_over_all_taps():
    rng = np.random.default_rng(12)
    for source, target, n in ((288_000, 96_000, 400), (96_000, 288_000, 50), (250_000, 96_000, 300), (80_000, 96_000, 120), (500, 300, 7), (7, 5, 1)):
        x = rng.normal(size=(3, n))
        g = math.gcd(source, target)
        up, down = target // g, source // g
        half = 10 * max(up, down)
        k = np.arange(-half, half + 1)
        taps = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, 8.6)
        taps = taps / taps.sum() * up
        wide = np.zeros((3, n * up))
        wide[:, ::up] = x
        want = np.stack([np.convolve(w, taps)[half : half + n * up][::down] for w in wide])
        got = spectral.resample_stack(x, source, target)
        assert got.shape == (3, -(-n * up // down)) and abs(got - want[:, : got.shape[1]]).max() < 1e-5


def test_stacks_of_windows_equal_windows_alone(spark):
    rng = np.random.default_rng(13)
    rows = [(f"r{k}", k, [96_000, 250_000][k % 2], (rng.normal(size=40_000 + 1000 * k) * 3000).astype("<i2").tobytes()) for k in range(5)]
    got = spectral.window_spectrograms(spark.createDataFrame(rows, "recording_id string, window_index int, sample_rate_hz int, pcm binary").coalesce(1)).collect()
    assert len(got) == 5
    for r in got:
        _, k, rate, pcm = rows[r.window_index]
        grid, *bounds = spectral.window_view(np.frombuffer(pcm, "<i2"), rate)
        assert np.array(r.grid).shape == grid.shape and abs(np.array(r.grid) - grid).max() < 1e-6 and [r.t0, r.t1, r.f0, r.f1] == bounds


def test_sample_formats_become_fractions():
    assert audio.as_fractions(bytes([0, 128, 255]), "<u1").tolist() == [-1.0, 0.5 / 127.5, 1.0]
    assert audio.as_fractions(np.array([0, 65535], "<u2").tobytes(), "<u2").tolist() == [-1.0, 1.0]
    assert audio.as_fractions(np.array([np.nan, 0.5], "<f8").tobytes(), "<f8").tolist() == [0.0, 0.5]
    assert audio.as_fractions(np.array([-(1 << 31), 1 << 30], "<i4").tobytes(), "<i4").tolist() == [-1.0, 0.5]
    assert audio.as_fractions(np.array([0.25, -2.0], "<f4").tobytes(), "<f4").tolist() == [0.25, -2.0]
    for n, length, hop, most in ((10, 4, 2, 9), (10, 4, 2, 3), (3, 4, 2, 9), (10, 4, 1, 4), (10, 4, 1, 1), (4, 4, 1, 1)):
        want = {(10, 4, 2, 9): [0, 2, 4, 6], (10, 4, 2, 3): [0, 3, 6], (10, 4, 1, 4): [0, 2, 4, 6]}.get((n, length, hop, most), [0])
        assert audio.starts_of(n, length, hop, most).tolist() == want


def test_records_of_clips_need_one_python_step(spark):
    audit = {"window_seconds": 0.016, "hop_fraction": 0.5, "max_frames_per_clip": 7.0, "tonal_smoothing_time_sigma_frames": 0.8, "tonal_smoothing_frequency_sigma_bins": 1.0, "tonal_local_baseline_width_hz": 200.0, "tonal_salience_threshold_db": 3.0, "core_tonal_lower_hz": 20.0, "core_tonal_upper_hz": 400.0, "tonal_minimum_duration_seconds": 0.01}
    rng = np.random.default_rng(14)
    waves = {"a": (rng.normal(size=500) * 4000).astype("<i2"), "short": np.array([5, -7], "<i2"), "silent": np.zeros(64, "<i2"), "empty": np.zeros(0, "<i2"), "loud": np.full(40, 32767, "<i2")}
    bag = spark.createDataFrame([(k, 1000, len(x), x.tobytes()) for k, x in waves.items()] + [("other", 2000, 1, b"\0\0")], "path string, sample_rate_hz int, sample_count long, pcm binary")
    out = audio.clip_records(bag, 1000, audit, 0.99)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    got = {r.path: r for r in out.collect()}
    assert got.keys() == waves.keys()
    for k, x in waves.items():
        r = got[k]
        if not len(x):
            assert r.rms_fraction is None and r.core_tonal_component_found is None
            continue
        share = x / 32768
        assert abs(r.rms_fraction - math.sqrt((share**2).mean())) < 1e-12 and abs(r.dc_fraction - share.mean()) < 1e-12
        assert (r.exact_clipping_fraction, r.zero_fraction) == ((abs(x.astype(int)) >= 32767).mean(), (x == 0).mean())
        fit = np.pad(share, (0, max(0, 16 - len(x))))
        own = np.stack([fit[s : s + 16] for s in audio.starts_of(len(x), 16, 8, 7)])
        rms = np.sqrt((own**2).mean(axis=1))
        assert abs(r.rms_q50 - np.median(rms)) < 1e-12 and abs(r.low_activity_frame_fraction - (rms < max(rms.max() / 100, 1e-307)).mean()) < 1e-12
        want = spectral.summary_values(*spectral.tonal_band(list(own), 1000 / 16, audit), 3.0, spectral.Tonal(0.008, 400.0, 0.01))
        assert r.core_tonal_component_found == want[0] and r.candidate_count == want[1] and r.core_tonal_component_frequency_q50_hz == want[9]


def test_full_case_folding_orders_as_python_does(spark):
    words = ["Straße", "STRASSE", "strasse", "ẞ", "ß", "ﬁn", "FIN", "Σίσυφος", "ΣΊΣΥΦΟΣ", "σίσυφοσ", "İ", "I", "ı", "ŉ", "ǰ", "ΐ", "և", "ẖ", "Ꭰ", "ꭰ", "Ω", "K", "ſ", "\U00010400", "z", "Ä", "ä", "", "1"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.f for r in df.select("w", casefolded(F.col("w")).alias("f")).collect()}
    assert got == {w: w.casefold() for w in words}
    ordered = [r.w for r in df.orderBy(casefolded(F.col("w")), "w").collect()]
    assert ordered == sorted(words, key=lambda w: (w.casefold(), w))
    named = frames.source_index(spark.createDataFrame([("e", x) for x in ("Strasze", "straßb", "STRASSA")], "encounter_id string, path string"), "encounter_id", "path")
    assert [r.path for r in named.orderBy("source_index").collect()] == ["STRASSA", "straßb", "Strasze"]


def test_a_detector_is_made_once_a_worker_and_sees_batches(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def make():
        import os
        import uuid

        with open(f"{seen}-made-{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass

        def detector(grids):
            with open(f"{seen}-batch-{uuid.uuid4().hex}", "w") as f:
                f.write(str(grids.shape))
            return [np.array([[g[0, 0], 0.5, 0.1, 0.2, 0.9], [0.3, 0.5, 0.1, 0.2, 0.4]][: int(g[0, 1])]).reshape(-1, 5) for g in grids]

        return detector

    rows = [("r", k, [[k / 64, float(k % 3)], [0.0, 0.0], [0.0, 0.0]]) for k in range(20)]
    df = spark.createDataFrame(rows, "recording_id string, window_index int, grid array<array<float>>").coalesce(1)
    got = events.detect_batches(df, make, (3, 2)).collect()
    assert sorted((r.window_index, r.box, r.x) for r in got) == sorted((k, b, [k / 64, 0.3][b]) for k in range(20) for b in range(k % 3))
    made, batches = list(tmp_path.glob("seen-made-*")), [x.read_text() for x in tmp_path.glob("seen-batch-*")]
    assert len(made) == len({x.name.split("-")[2] for x in made}) and sorted(batches) == ["(4, 3, 2)", "(8, 3, 2)", "(8, 3, 2)"]
