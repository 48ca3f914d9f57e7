"""Signal operators against numpy and plain-Python models on small series."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula import numbering
from undula.config import PERMISSIVE, Refinement, Rules, Weights
from undula.operators import blocks, detectors, evaluate, events, features, filters, islands, matching
from undula.operators.preprocess import baseline, clean

SCHEMA = "dataset string, channel string, sample_index long, time double, value double"


def series(spark, **named):
    rows = [(d, "FBG2", i, i / 50, None if v is None else float(v)) for d, x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


def values(df, column, dataset="a"):
    return [r[column] for r in df.filter(F.col("dataset") == dataset).orderBy("sample_index").collect()]


def noise(n, seed, std=0.002, impacts=(), s=15):
    x = np.random.default_rng(seed).normal(0, std, n)
    for p, a in impacts:
        x += a * np.exp(-((np.arange(n) - p) ** 2) / (2 * s**2))
    return x


def test_clean_fills_gaps_by_position_across_blocks(spark):
    x = [None, None, 1.0, None, None, 4.0, float("nan"), 8.0, None]
    assert values(clean(series(spark, a=x), size=3), "value") == [1, 1, 1, 2, 3, 4, 6, 8, 8]
    assert values(clean(series(spark, a=[None, None])), "value") == [None, None]


@pytest.mark.parametrize("size", [7, 1000])
def test_filters_equal_models_with_and_without_block_borders(spark, monkeypatch, size):
    x = noise(60, 1, 1.0)
    monkeypatch.setattr(blocks.with_halo, "__defaults__", (size, *blocks.with_halo.__defaults__[1:]))
    df = series(spark, a=x)
    mean = np.convolve(x, np.ones(5) / 5, "valid")
    assert values(filters.moving_average(df), "moving_average") == pytest.approx([mean[0]] * 2 + list(mean) + [mean[-1]] * 2)
    padded = np.concatenate(([0, 0], x, [0, 0]))
    assert values(filters.median(df), "median") == pytest.approx([np.median(padded[i : i + 5]) for i in range(60)])
    fit = [np.polyval(np.polyfit(np.arange(11), x[min(max(i - 5, 0), 49) : min(max(i - 5, 0), 49) + 11], 3), i - min(max(i - 5, 0), 49)) for i in range(60)]
    assert values(filters.savitzky_golay(df), "savitzky_golay") == pytest.approx(fit)
    slope = np.gradient(x, np.arange(60) / 50)
    assert values(detectors.derivative(df, size=size), "derivative") == pytest.approx(slope)


def test_slopes_at_equal_times(spark):
    rows = [("a", "FBG2", i, float(t), float(v)) for i, (t, v) in enumerate(zip([0, 0, 1, 1, 2, 2, 2, 3, 3], [1, 3, 3, 3, 5, 2, 2, 4, 1], strict=True))]
    got = values(detectors.derivative(spark.createDataFrame(rows, SCHEMA)), "derivative")
    inf, nan = float("inf"), float("nan")
    assert got == pytest.approx([inf, inf, nan, nan, -inf, nan, nan, -inf, -inf], nan_ok=True)
    with pytest.raises(Exception, match="time must not fall"):
        detectors.derivative(spark.createDataFrame([("a", "FBG2", i, t, 0.0) for i, t in enumerate([0.0, 2.0, 1.0])], SCHEMA)).collect()


def test_zero_phase_keeps_slow_and_removes_fast(spark):
    t = np.arange(400) / 50
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 20 * t)
    b, a = filters.butterworth_coefficients(4, 0.2)
    assert b.sum() / a.sum() == pytest.approx(1) and abs(np.polyval(b, np.exp(1j * np.pi * 0.2)) / np.polyval(a, np.exp(1j * np.pi * 0.2))) == pytest.approx(2**-0.5)
    y = values(filters.butterworth(series(spark, a=slow + fast, b=[1.0] * 10)), "butterworth")
    assert np.abs(np.array(y) - slow)[50:-50].max() < 0.01
    whole = filters.zero_phase(slow + fast, b, a)
    assert y == pytest.approx(list(whole), abs=1e-12)
    assert np.abs(filters.zero_phase((slow + fast)[:300], b, a)[:150] - whole[:150]).max() < 1e-12


def test_islands_equal_model(spark):
    rng = np.random.default_rng(2)
    mask = rng.random(300) < 0.5
    df = series(spark, a=np.zeros(300)).join(spark.createDataFrame([(i, bool(m)) for i, m in enumerate(mask)], "sample_index long, mask boolean"), "sample_index")
    runs, start = [], None
    for i, m in enumerate([*mask, False]):
        if m and start is None:
            start = i
        if not m and start is not None:
            runs.append((start, i - 1))
            start = None
    get = lambda d: sorted((r["start_index"], r["end_index"]) for r in d.collect())
    assert get(islands.mask_to_regions(df, size=16)) == runs
    merged = []
    for a, b in [r for r in runs if r[1] - r[0] >= 2]:
        if merged and a <= merged[-1][1] + 2 + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    assert get(islands.clean_regions(df, 3, 2)) == merged
    kept = {i for a, b in runs if b > a for i in range(a, b + 1)}
    assert {r["sample_index"] for r in islands.persistent(df, 2).filter("mask").collect()} == kept


def test_interval_expressions(spark):
    rows = spark.createDataFrame([(10, 20, 18, 30), (0, 5, 10, 12), (0, 5, 11, 12), (11, 12, 0, 4)], "a long, b long, c long, d long")
    got = rows.select(islands.overlap(*map(F.col, "abcd")).alias("o"), islands.adjacent(*map(F.col, "abcd"), 5).alias("n")).collect()
    assert [r["o"] for r in got] == pytest.approx([3 / 11, 0, 0, 0]) and [r["n"] for r in got] == [True, True, True, False]


def regions(spark, *rows):
    ranks = {"peak": 0, "threshold": 1, "derivative": 2, "change_point": 3}
    return spark.createDataFrame([("a", "FBG2", m, i, s, e, ranks[m]) for i, (m, s, e) in enumerate(rows)], "dataset string, channel string, method string, region_idx long, start_index long, end_index long, method_rank int")


def test_groups_split_at_gaps_of_support(spark):
    r = regions(spark, ("peak", 100, 130), ("peak", 220, 250), ("threshold", 104, 240), ("derivative", 102, 128), ("derivative", 222, 226), ("change_point", 500, 510))
    made = matching.numbered(matching.split_groups(matching.match_groups(r, 5), 20)).collect()
    by = {}
    for x in made:
        by.setdefault(x["event_id"], set()).add((x["method"], x["start_index"]))
    assert by == {"a-FBG2-001": {("peak", 100), ("threshold", 104), ("derivative", 102)}, "a-FBG2-002": {("peak", 220), ("derivative", 222)}, "a-FBG2-003": {("change_point", 500)}}


def test_evidence_and_weights(spark):
    row = spark.range(1).select(events.evidence(F.array(F.lit("peak"), F.lit("threshold"), F.lit("derivative"))).alias("e"), events.evidence(F.array(F.lit("other"))).alias("z")).first()
    assert row["e"] == pytest.approx(0.85) and row["z"] == 0
    for bad in (Weights(peak=-1), Weights(0, 0, 0, 0)):
        with pytest.raises(ValueError, match="weights"):
            bad.normalised()


def test_rules_give_the_first_reason(spark):
    rows = [
        ("a", 10, 11, 1.0, ["peak"]), ("b", 10, 95, 1.0, ["peak"]), ("c", 10, 20, 0.05, ["peak"]), ("d", 10, 20, 0.04, ["peak", "threshold"]),
        ("e", 10, 20, 0.06, ["peak"]), ("f", 10, 20, 1.0, ["change_point", "x"]), ("g", 10, 20, 1.0, ["peak", "threshold"]),
    ]
    df = spark.createDataFrame(rows, "event_id string, start_index long, end_index long, peak_value double, methods array<string>").selectExpr("*", "0D AS baseline_mean", "0.01D AS baseline_std", "100L AS n_samples")
    got = {r["event_id"]: r["rejection_reason"] for r in events.classify(df).collect()}
    assert got == {
        "a": "duration_below_min_samples (2 < 3)", "b": "no_confirmed_recovery (end_index=95, signal_length=100)", "c": "noise_like_event (methods=1, dev_std=5.00)",
        "d": "low_amplitude (dev_std=4.00 < 5.0)", "e": "insufficient_method_agreement (1 < 2)", "f": "evidence_below_minimum (0.150 < 0.3)", "g": None,
    }
    assert {r["event_id"] for r in events.classify(df, PERMISSIVE).filter("accepted").collect()} == {"c", "e", "f", "g"}
    flat = events.classify(df.withColumn("baseline_std", F.lit(0.0)), Rules()).filter("event_id = 'g'").first()
    assert flat["accepted"] and flat["deviation_std"] == float("inf")


@pytest.fixture(scope="module")
def scenarios(spark):
    signal = series(
        spark,
        none=noise(2000, 7), one=noise(2000, 7, impacts=[(1000, 0.05)]), three=noise(3000, 3, impacts=[(500, 0.05), (1400, 0.05), (2400, 0.05)]), near=noise(3000, 5, impacts=[(1000, 0.05), (1120, 0.05)]),
        high=noise(2000, 5, impacts=[(1500, 0.2)]),
    ).cache()
    return signal, events.cut(events.ensemble_events(signal), "events")


def test_scenarios(scenarios):
    _, found = scenarios
    accepted = {}
    for r in found.filter("accepted").orderBy("peak_index").collect():
        accepted.setdefault(r["dataset"], []).append((r["peak_index"], r["method_count"]))
        assert r["start_index"] <= r["peak_index"] <= r["end_index"]
    assert set(accepted) == {"one", "three", "near", "high"}
    for name, at in {"one": [1000], "three": [500, 1400, 2400], "near": [1000, 1120], "high": [1500]}.items():
        assert len(accepted[name]) == len(at) and all(abs(p - a) <= 30 and n >= 2 for (p, n), a in zip(accepted[name], at, strict=True))
    assert events.invariants(found).count() == found.count()


def test_features_of_scenarios(scenarios):
    signal, found = scenarios
    accepted = found.filter("accepted")
    shape = events.cut(features.shape_features(accepted, signal), "shape")
    assert shape.columns == list(features.SHAPE_COLUMNS) and shape.count() == accepted.count()
    x = {r["dataset"]: r for r in accepted.collect()}["one"]
    w = np.array(values(signal, "value", "one"))
    mu = w[:100].mean()
    part, r = w[x["start_index"] : x["end_index"] + 1], shape.filter("dataset = 'one'").first()
    t = np.arange(len(part)) / 50
    assert r["rms"] == pytest.approx(np.sqrt((part**2).mean())) and r["variance"] == pytest.approx(part.var()) and r["peak_shift"] == pytest.approx(x["peak_value"] - mu)
    assert r["signal_energy"] == pytest.approx(np.trapezoid(part**2, t)) and r["area_under_curve"] == pytest.approx(np.trapezoid(np.abs(part), t))
    assert r["max_slope"] == pytest.approx(np.abs(np.gradient(part, t)).max())
    d, _ = np.histogram(part, 20, density=True)
    assert r["entropy"] == pytest.approx(-(d[d > 0] * np.log2(d[d > 0])).sum())
    behind = w[x["end_index"] + 5 : x["end_index"] + 55]
    assert r["post_impact_level"] == pytest.approx(np.median(behind)) and r["residual_n_samples"] == 50
    many = features.multidomain_features(accepted, signal, shape)
    assert many.columns == list(features.FEATURE_COLUMNS)
    m = many.filter("dataset = 'one'").first()
    assert m["feature_status"] == "ok" and m["sampling_frequency_hz"] == pytest.approx(50)
    spectrum = np.abs(np.fft.rfft((part - part.mean()) * np.hanning(len(part))))
    assert m["spectral_energy"] == pytest.approx((spectrum**2).sum()) and m["dominant_frequency_hz"] == pytest.approx((1 + spectrum[1:].argmax()) * 50 / len(part))


def test_spectra_and_stft(spark):
    t = np.arange(100) / 50
    df = series(spark, a=np.sin(2 * np.pi * 5 * t), b=np.sin(2 * np.pi * 5 * t[:10]), c=np.ones(20))
    w = events.cut(features.event_samples(df.groupBy("dataset", "channel").agg(F.min("sample_index").alias("start_index"), F.max("sample_index").alias("end_index")).withColumn("event_id", F.col("dataset")), df), "w")
    fs = features.sampling_frequency(df)
    a = {(r["event_id"], r["k"]): r["mag"] for r in features.spectra(w).collect()}
    b = {(r["event_id"], r["k"]): r["mag"] for r in features.dft_spectra(w).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    s = {r["event_id"]: r for r in features.spectral_features(features.spectra(w), fs).collect()}
    assert s["a"]["dominant_frequency_hz"] == pytest.approx(5) and s["c"]["spectral_entropy"] is None and 0 <= s["a"]["spectral_flatness"] <= 1
    z = {r["event_id"]: r for r in features.stft_features(w, fs).collect()}
    assert abs(z["a"]["stft_peak_frequency_hz"] - 5) < 1.6 and z["b"]["stft_reason"] == "event_too_short(10<16)" and not z["b"]["stft_valid"]
    td = {r["event_id"]: r for r in features.time_features(w).collect()}
    assert td["c"]["td_skewness"] is None and td["a"]["td_crest_factor"] == pytest.approx(np.sin(0.4 * np.pi) * 2**0.5)


def test_spectra_with_gaps(spark):
    rng = np.random.default_rng(5)
    x = list(np.sin(np.arange(40) / 3) + rng.normal(0, 0.1, 40))
    gaps = [None if i in (0, 1, 7, 8, 20, 39) else float("nan") if i == 30 else v for i, v in enumerate(x)]
    df = series(spark, a=gaps, b=[None] * 20, c=[None] * 19 + [1.0], d=x)
    w = events.cut(features.event_samples(df.groupBy("dataset", "channel").agg(F.min("sample_index").alias("start_index"), F.max("sample_index").alias("end_index")).withColumn("event_id", F.col("dataset")), df), "w")
    known = [i for i, v in enumerate(gaps) if v is not None and v == v]
    y = np.interp(np.arange(40), known, [gaps[i] for i in known])
    want = np.abs(np.fft.rfft((y - y.mean()) * np.hanning(40)))
    got = {(r["event_id"], r["k"]): r["mag"] for r in features.spectra(w).collect()}
    assert [got["a", k] for k in range(21)] == pytest.approx(list(want)) and {e for e, _ in got} == {"a", "d"}
    assert {(r["event_id"], r["k"]): r["mag"] for r in features.dft_spectra(w).collect()} == pytest.approx(got, abs=1e-9)
    z = {r["event_id"]: r for r in features.stft_features(w, features.sampling_frequency(df)).collect()}
    assert z["a"]["stft_valid"] and (z["b"]["stft_reason"], z["c"]["stft_reason"]) == ("all_nan_signal", "insufficient_finite_samples")
    assert z["a"]["stft_max_energy"] == pytest.approx(features.stft_of(y, 50.0)[1])


@pytest.mark.parametrize("ranges", [2, 5])
def test_places_of_a_large_group(spark, ranges):
    rows = [("a" if i % 3 else None, (i * 7919) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, x long, i long").repartition(ranges)
    want = sorted((str(g), sum((g2, x2) < (g, x) for g2, x2, _ in [(str(a), b, c) for a, b, c in rows] if g2 == g)) for g, x in [(str(a), b) for a, b, _ in rows])
    assert sorted((str(r["g"]), r["place"]) for r in numbering.numbered(df, ["x"], ["g"]).collect()) == want
    named = df.filter("g IS NOT NULL")
    got = numbering.numbered_in(named, ["x"], ["g"], F.floor(F.col("x") / 90))
    assert sorted(("a", r["place"]) for r in got.collect()) == [w for w in want if w[0] == "a"]
    assert got.count() == named.count()


def test_peaks_equal_model(spark):
    x = np.round(noise(400, 9, 1.0), 1)  # with plateaus
    got = [(r["sample_index"], r["type"], round(r["prominence"], 9)) for r in detectors.peaks(series(spark, a=x), 100, 1.0, 5).orderBy("sample_index", "type").collect()]
    want = []
    for sign, name in ((1, "positive"), (-1, "negative")):
        y = sign * x
        top, i = [], 1
        while i < len(y) - 1:
            j = i
            while j < len(y) - 1 and y[j + 1] == y[i]:
                j += 1
            if y[i - 1] < y[i] and j < len(y) - 1 and y[j + 1] < y[i]:
                top.append((i + j) // 2)
            i = j + 1
        keep = []
        for p in sorted(top, key=lambda p: (-y[p], -p)):
            if all(abs(p - q) >= 5 for q in keep):
                keep.append(p)
        for p in keep:
            l = r = p
            while l > 0 and y[l - 1] <= y[p]:
                l -= 1
            while r < len(y) - 1 and y[r + 1] <= y[p]:
                r += 1
            prom = y[p] - max(y[l : p + 1].min(), y[p : r + 1].min())
            if prom >= x[:100].std():
                want.append((p, name, round(float(prom), 9)))
    assert got == sorted(want)


def test_refinement_equals_walk(spark):
    x = noise(500, 4, 0.01, [(250, 1.0)])
    df = series(spark, a=x)
    c = spark.createDataFrame([("a", "FBG2", "e", 150, 400)], "dataset string, channel string, event_id string, start_index long, end_index long")
    r = events.refine(c, df, baseline(df, 100), Refinement()).first()
    mu, sd = x[:100].mean(), x[:100].std()
    peak = 150 + int(np.abs(x[150:401]).argmax())
    tol = max(2 * sd, 0.2 * abs(x[peak] - mu))
    start = peak
    while start > 150 and abs(x[start - 1] - mu) > tol:
        start -= 1
    end = next((j for j in range(peak, min(400, 495) + 1) if (np.abs(x[j : j + 5] - mu) <= tol).all()), 400)
    assert (r["start_index"], r["peak_index"], r["end_index"]) == (start, start + int(np.abs(x[start : end + 1]).argmax()), end)


def test_cross_channel_support_equals_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [("d", f"c{rng.integers(3)}", str(i), float(np.round(rng.random() * 60, 1))) for i in range(80)]
    e = spark.createDataFrame(rows, "dataset string, channel string, event_id string, peak_time double")
    s = e.select("dataset", "channel", F.lit(0).alias("sample_index"), F.lit(0.0).alias("time"), F.lit(0.0).alias("value"))
    want = sum(any(o[1] != r[1] and abs(o[3] - r[3]) <= 0.5 for o in rows) for r in rows)
    assert evaluate.channel_consistency(e, s).first()["events_with_cross_channel_support"] == want


@pytest.mark.parametrize("first", [0, 115, 1_000_000])
def test_a_spread_that_equals_the_tolerance_is_within_it(spark, first):
    at = {"e1": [0, 20, 0, 20], "e2": [20, 20, 0, 0], "e3": [0, 20, 20, 0], "e4": [0, 20], "e5": [0, 20, 0, 21], "e6": [7]}
    rows = [("a", "FBG2", e, {f"m{k}": first + i for k, i in enumerate(x)}) for e, x in at.items()]
    got = evaluate.timing(spark.createDataFrame(rows, "dataset string, channel string, event_id string, method_peak_indices map<string,long>")).collect()
    spreads = [float(np.std(x)) for x in at.values() if len(x) > 1]
    assert [tuple(r) for r in got] == [(6, pytest.approx(np.mean(spreads)), 10.0, 4)]
