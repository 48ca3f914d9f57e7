"""Sources, sinks, runs, SQL functions, streaming, and the queries against their SQL."""

from __future__ import annotations

import datetime as dt
import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula import oracle, queries
from undula.functions import sql
from undula.operators import events, noise
from undula.plans import jobs, plots
from undula.sources import readers
from undula.streaming import sessions

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def recording(path, seeds, impacts, n=1500, bad_row=None, bad_cell=None):
    lines = []
    cols = []
    for seed, (p, a), base in zip(seeds, impacts, (1546.0, 1524.0, 1529.0), strict=True):
        x = np.random.default_rng(seed).normal(0, 0.002, n) + a * np.exp(-((np.arange(n) - p) ** 2) / (2 * 15.0**2))
        cols.append(base + x)
    for i in range(n):
        cells = [f"{i / 50:.6f}", "1", "1", "1", "0", *[f"{c[i]:.6f}" for c in cols]]
        if i == bad_cell:
            cells[6] = "oops"
        if i == bad_row:
            cells += ["1", "2"]
        lines.append("\t".join(cells))
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("recordings")
    recording(d / "one.txt", (10, 11, 12), ((700, 0.05), (730, 0.04), (0, 0.0)), bad_cell=900)
    recording(d / "two.txt", (20, 21, 22), ((500, 0.05), (500, 0.06), (510, 0.05)))
    recording(d / "ragged.txt", (1, 2, 3), ((500, 0.05),) * 3, bad_row=7)
    (d / "notes.md").write_text("not a recording")
    return d


def test_a_bad_file_fails_alone(spark, folder):
    raw = readers.read_raw(spark, str(folder))
    assert [r["file"] for r in readers.failed_files(raw).collect()] == ["ragged.txt"]
    made = readers.samples(raw)
    assert {(r["dataset"], r["channel"]): r["count"] for r in made.groupBy("dataset", "channel").count().collect()} == {(d, c): 1500 for d in ("one", "two") for c in ("FBG1", "FBG2", "FBG3")}
    assert made.filter("value IS NULL").count() == 1


def test_runs_write_what_they_find(spark, folder, tmp_path):
    jobs.ensemble_run(spark, str(folder), str(tmp_path / "e"))
    accepted = spark.read.option("header", True).csv(str(tmp_path / "e/accepted_events_all_datasets"))
    assert accepted.columns == list(events.COLUMNS)
    got = {(r["dataset"], r["channel"]) for r in accepted.collect()}
    assert {("one", "FBG1"), ("one", "FBG2"), ("two", "FBG1"), ("two", "FBG2"), ("two", "FBG3")} <= got and ("one", "FBG3") not in got
    summary = spark.read.option("header", True).csv(str(tmp_path / "e/summary"))
    assert summary.count() == 6 and "drift_std" in summary.columns
    assert spark.read.json(str(tmp_path / "e/events_json")).filter("accepted").count() == accepted.count()


def test_noise_and_study_runs(spark, folder, tmp_path):
    jobs.noise_run(spark, str(folder), str(tmp_path / "n"))
    assert spark.read.option("header", True).csv(str(tmp_path / "n/filter_noise")).count() == 24
    assert spark.read.option("header", True).csv(str(tmp_path / "n/failed_files")).count() == 1
    jobs.study_run(spark, str(tmp_path / "n/filtered_csv"), str(tmp_path / "s"))
    key = lambda path: sorted(map(str, readers.read_filtered(spark, str(tmp_path / path)).collect()))
    assert key("n/filtered_csv") == key("n/filtered") and len(key("n/filtered")) == 9000
    assert spark.read.option("header", True).csv(str(tmp_path / "s/detection_summary")).count() == 24
    with pytest.raises(ValueError, match="no filtered"):
        readers.read_filtered(spark, str(write(spark, tmp_path)))


def write(spark, tmp_path):
    spark.range(1).selectExpr("'a' AS dataset", "'b' AS channel", "id AS sample_index", "1D AS time").write.parquet(str(tmp_path / "t"))
    return tmp_path / "t"


def test_reports_and_plots(spark, folder, tmp_path, capsys):
    jobs.shape_run(spark, str(folder), str(tmp_path / "p"), plots_per_dataset=1)
    said = capsys.readouterr().out
    assert "Accepted events" in said and "Files that failed       : 1" in said
    assert len(spark.read.option("header", True).csv(str(tmp_path / "p/shape_features")).columns) == 25
    drawn = [f for f in os.listdir(tmp_path / "p/plots") if f.endswith(".svg")]
    assert len(drawn) == 2 and "<polyline" in (tmp_path / "p/plots" / drawn[0]).read_text()
    jobs.evaluation_run(spark, str(folder), str(tmp_path / "v"))
    said = capsys.readouterr().out
    assert "Ground truth: not available" in said and "total_accepted_events" in said and "ensemble" in said


def test_feature_run(spark, folder, tmp_path, capsys):
    jobs.features_run(spark, str(folder), str(tmp_path / "f"))
    assert "Valid STFT" in capsys.readouterr().out and any(f.startswith("histogram") for f in os.listdir(tmp_path / "f/plots"))
    features = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "f/multidomain_features"))
    assert len(features.columns) == 37 and features.count() >= 2
    assert len(spark.read.option("header", True).csv(str(tmp_path / "f/shape_features")).columns) == 25
    config = [f for f in os.listdir(tmp_path / "f/config") if f.endswith(".json")]
    assert json.loads((tmp_path / "f/config" / config[0]).read_text())["window"] == "hann"


def test_plot_windows(spark, folder):
    signal, found = events.selected(readers.samples(readers.read_raw(spark, str(folder))))
    w = plots.event_window(found.filter("accepted"), signal)
    assert w.filter("inside").count() > 0 and w.filter("NOT inside").count() > 0


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT overlap_fraction(10, 20, 18, 30) AS o, regions_adjacent(0, 5, 11, 12, 5) AS n, noise_reduction(2, 1) AS r, peak_preservation(0, 1) AS p, deviation_std(1, 0, 0) AS d, hann_weight(1, 3) AS h").first()
    assert row["o"] == pytest.approx(3 / 11) and row["n"] and row["r"] == 50 and row["p"] == 0 and row["d"] == float("inf") and row["h"] == 1


def test_stream_sessions_equal_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("d", "c", t0 + dt.timedelta(seconds=i), 5.0 if i in (3, 4, 6, 30, 31) else 0.0) for i in range(200)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "dataset string, channel string, ts timestamp, value double").write.parquet(str(src))
    limits = spark.createDataFrame([("d", "c", 0.0, 1.0)], "dataset string, channel string, mu double, threshold double")
    stream = spark.readStream.schema("dataset string, channel string, ts timestamp, value double").parquet(str(src))
    q = sessions.threshold_sessions(stream, limits, "5 seconds", "10 seconds").writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = sessions.threshold_sessions(spark.read.parquet(str(src)), limits)
    key = lambda d: sorted((r["first_ts"], r["last_ts"], r["hits"]) for r in d.collect())
    assert [k[2] for k in key(batch)] == [3, 2]
    assert set(key(spark.table("found"))) <= set(key(batch))


QUICK = "s_series p_clean f_moving_average f_savitzky_golay f_median n_noise_reduction n_filter_evaluation d_threshold d_derivative d_change_point r_islands m_support_zones m_events e_evidence t_time_domain q_spectral_features v_channel_consistency".split()


#: These need longer series.
LONG = "s_recordings s_filtered f_butterworth d_peaks m_overlap b_refine j_events a_shape a_post_level z_stft z_multidomain v_report d_study".split()


def test_every_query_has_its_sql():
    assert queries.queries().keys() == oracle.oracle_sql().keys()


@pytest.mark.parametrize("name", QUICK + LONG)
def test_query_equals_its_sql(spark, sf_dir, name):
    import duckdb

    sf_dir = "/root/testdata/sf0.01" if name in LONG else sf_dir

    con = duckdb.connect()
    for t in ("events", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf_dir)
    order = sorted(columns)
    assert sorted(got.columns) == order
    assert sorted(str([r[c] for c in order]) for r in got.collect()) == sorted(str([dict(zip(columns, r, strict=True))[c] for c in order]) for r in want.fetchall())


@pytest.fixture(scope="module")
def equal_times(tmp_path_factory):
    """Events some of which have the time of another of their type, with its value or another, behind the baselines."""
    import duckdb

    folder = tmp_path_factory.mktemp("equal_times")
    more = "SELECT event_id + 1000000 AS event_id, * EXCLUDE (event_id, value), value + event_id % 3 * 40 AS value FROM e WHERE event_id > 600 AND event_id % 25 < 3"
    duckdb.sql(f"COPY (WITH e AS (FROM '/root/testdata/sf0.001/events.parquet') SELECT event_id, * EXCLUDE (event_id, value), value FROM e UNION ALL {more}) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", "d_derivative d_derivative_regions d_study e_evidence l_methods m_events m_match_groups m_overlap m_support_zones".split())
def test_query_equals_its_sql_at_equal_times(spark, equal_times, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{equal_times}/events.parquet'")
    want = con.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, equal_times)
    rows = sorted(str([r[c] for c in columns]) for r in got.collect())
    assert rows and rows == sorted(str(list(r)) for r in want.fetchall())


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Events repeated with shifted keys: all times are there three times, those of the baselines too."""
    import duckdb

    folder = tmp_path_factory.mktemp("repeated")
    duckdb.sql(f"COPY (SELECT event_id + 1000 * k AS event_id, ts, user_id + 1000 * k AS user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet', range(3) r(k)) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", "d_derivative_regions d_study e_evidence l_methods m_events m_match_groups m_overlap m_support_zones".split())
def test_query_equals_its_sql_on_repeated_events(spark, repeated, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{repeated}/events.parquet'")
    want = con.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, repeated)
    rows = sorted(str([r[c] for c in columns]) for r in got.collect())
    # Slopes of the baselines are no numbers, so no derivative regions are found.
    assert bool(rows) == (name not in ("d_derivative_regions", "m_overlap"))
    assert rows == sorted(str(list(r)) for r in want.fetchall())


def test_derivative_equals_its_sql_at_steep_slopes(spark, tmp_path):
    """Slopes of 1e9 and more, from steps of a few microseconds, are rounded as in the SQL; some are infinite, some NaN."""
    import duckdb

    ts = "TIMESTAMP '2024-01-01' + to_microseconds((i * 7 + i % 5 * 3) // 10)"
    duckdb.sql(f"COPY (SELECT i AS event_id, {ts} AS ts, i % 40 AS user_id, 'click' AS event_type, (i * 7919 % 100003 * 13)::DOUBLE / 3 * (i % 11 // 2) AS value FROM range(20000) r(i)) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    want = {i: x for _, _, i, x in con.execute(oracle.oracle_sql()["d_derivative"]).fetchall()}
    got = {r["sample_index"]: r["derivative"] for r in queries.queries()["d_derivative"](spark, str(tmp_path)).collect()}
    shown = {str(x) for x in want.values()}
    assert {"nan", "inf", "-inf"} <= shown and sum(1e9 < abs(x) < float("inf") for x in want.values()) > 5000
    assert got.keys() == want.keys() and [i for i in want if str(got[i]) != str(want[i])] == []


@pytest.mark.skipif("RECORDINGS" not in os.environ, reason="RECORDINGS: a folder with the published recordings, tables beside it in RESULTS")
@pytest.mark.parametrize("name", ["expert7", "expert12"])
def test_published_results(spark, name):
    """What was published for the shipped recordings: selected events, counts of the ensemble, noise of the filters."""
    import csv

    rows = lambda path, key="dataset": [r for r in csv.DictReader(open(f"{os.environ['RESULTS']}/{path}")) if r[key] == name]
    samples = readers.samples(readers.read_raw(spark, os.environ["RECORDINGS"]).filter(F.col("dataset") == name))
    _, found = events.selected(samples)
    got = {r["event_id"]: r for r in events.as_table(found).collect()}
    want = rows("selected/selected_events_all_datasets.csv")
    assert len(got) == len(want) > 0
    for r in want:
        for c, v in r.items():
            x = got[r["event_id"]][c]
            assert x == pytest.approx(float(v), rel=1e-9) if isinstance(x, float) else str(x) == v, (r["event_id"], c)
    signal, every = events.ensemble(samples)
    counts = {r["channel"]: r for r in events.channel_summary(signal, every).collect()}
    for r in rows("ensemble/ensemble_summary.csv"):
        own = counts[r["channel"]]
        assert (own["candidate_events"], own["accepted_events"]) == (int(r["candidate_events"]), int(r["accepted_events"]))
        assert own["baseline_std"] == pytest.approx(float(r["baseline_std"]), rel=1e-9)
    noisy = {(r["channel"], r["filter"]): r for r in noise.experiment_noise(samples).collect()}
    for r in rows("tables/phase3_filter_evaluation.csv", "experiment"):
        assert noisy[r["channel"], r["filter"]]["filtered_noise_std"] == pytest.approx(float(r["filtered_noise_std"]), rel=1e-9)


def test_entry_without_the_training_data_part(tmp_path):
    """The entry module imports, and has the signal queries, where that part isn't there."""
    for f in ("__spark_entry__.py", "undula"):
        os.symlink(f"{ROOT}/{f}", tmp_path / f) if f.endswith(".py") else None
    (tmp_path / "undula").mkdir()
    for f in os.listdir(f"{ROOT}/undula"):
        if f not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/undula/{f}", tmp_path / "undula" / f)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'd_threshold' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q); print('ok')"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.strip() == "ok", done.stderr
