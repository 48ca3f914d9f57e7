"""The queries in plain SQL, where SQL can say them."""

from __future__ import annotations

from dataclasses import replace

from undula.config import METHODS, PERMISSIVE, Parameters, Rules
from undula.operators.filters import butterworth_coefficients, impulse_response, savgol_rows
from undula.queries import _USER, LOOSE_ALL

EV_TYPE = """SELECT 'events' AS dataset, event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS sample_index,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 1e6 AS time, value FROM events"""
EV_USER = """SELECT 'events' AS dataset, CAST(user_id AS VARCHAR) AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_index,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS time, value FROM events"""
EMB = """SELECT CAST(label AS VARCHAR) AS dataset, CAST(vec_id AS VARCHAR) AS channel, CAST(label AS VARCHAR) || '-' || CAST(vec_id AS VARCHAR) AS event_id, i - 1 AS pos, len(embedding) AS n,
  (i - 1) / 50.0::DOUBLE AS time, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""
LI_SUPP = """SELECT 'lineitem' AS dataset, CAST(l_suppkey AS VARCHAR) AS channel,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS sample_index, l_extendedprice AS value FROM lineitem"""


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def masked(source: str, n: int, k: float) -> str:
    """s: the series; m: each sample with its threshold mask."""
    return f"""s AS ({source}), b AS (SELECT channel, avg(value) AS mu, stddev_pop(value) AS sigma FROM s WHERE sample_index < {n} GROUP BY channel),
m AS (SELECT s.*, mu, sigma, abs(value - mu) > {k} * sigma AS mask FROM s JOIN b USING (channel))"""


SLOPES = """g AS (SELECT *, lag(value) OVER w AS xl, lead(value) OVER w AS xr, time - lag(time) OVER w AS hs, lead(time) OVER w - time AS hd FROM s WINDOW w AS (PARTITION BY channel ORDER BY sample_index)),
d AS (SELECT *, CASE WHEN hs IS NULL THEN (xr - value) / hd WHEN hd IS NULL THEN (value - xl) / hs ELSE (hs * hs * xr + (hd * hd - hs * hs) * value - hd * hd * xl) / (hs * hd * (hs + hd)) END AS slope FROM g)"""


def derivative_mask(source: str, n: int, k: float) -> str:
    return f"""s AS ({source}), {SLOPES}, b AS (SELECT channel, avg(slope) AS mu, stddev_pop(slope) AS sigma FROM d WHERE sample_index < {n} GROUP BY channel),
m AS (SELECT d.*, abs(slope - mu) > {k} * sigma AS mask FROM d JOIN b USING (channel))"""


def change_mask(source: str, window: int, k: float) -> str:
    return f"""s AS ({source}), f AS (SELECT *, avg(value) OVER w AS wm, stddev_pop(value) OVER w AS ws, count(*) OVER w AS wc FROM s
  WINDOW w AS (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, coalesce(wc = {window} AND ws > 0 AND abs(value - wm) / nullif(ws, 0) > {k}, false) AS mask FROM f)"""


def runs(suffix: str = "") -> str:
    """runs: maximal runs of m's mask."""
    return f"""r0{suffix} AS (SELECT channel, sample_index, sample_index - row_number() OVER (PARTITION BY channel ORDER BY sample_index) AS grp FROM m{suffix} WHERE mask),
runs{suffix} AS (SELECT channel, min(sample_index) AS start_index, max(sample_index) AS end_index FROM r0{suffix} GROUP BY channel, grp)"""


def merged(name: str, source: str, gap: int, keys: str = "channel") -> str:
    return f"""{name}_o AS (SELECT *, CASE WHEN start_index <= max(end_index) OVER (PARTITION BY {keys} ORDER BY start_index, end_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} + 1 THEN 0 ELSE 1 END AS opens FROM {source}),
{name}_g AS (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY start_index, end_index ROWS UNBOUNDED PRECEDING) AS grp FROM {name}_o),
{name} AS (SELECT {keys}, min(start_index) AS start_index, max(end_index) AS end_index FROM {name}_g GROUP BY {keys}, grp)"""


def cleaned(name: str, suffix: str, least: int, gap: int) -> str:
    return f"{runs(suffix)}, {name}_l AS (SELECT * FROM runs{suffix} WHERE end_index - start_index + 1 >= {least}), {merged(name, f'{name}_l', gap)}"


def region_rows(name: str, method: str) -> str:
    return f"SELECT 'events' AS dataset, channel, '{method}' AS method, row_number() OVER (PARTITION BY channel ORDER BY start_index) - 1 AS region_idx, start_index, end_index FROM {name}"


_T = masked(EV_TYPE, 100, 0.8)
_D = derivative_mask(EV_TYPE, 100, 0.3)
_C = change_mask(EV_TYPE, 20, 1.0)
THRESHOLD = f"WITH {_T}, {cleaned('c', '', 2, 2)} " + region_rows("c", "threshold")
DERIVATIVE = f"WITH {_D}, {cleaned('c', '', 2, 2)} " + region_rows("c", "derivative")
CHANGE = f"WITH {_C}, {cleaned('c', '', 2, 5)} " + region_rows("c", "change_point")
ISLANDS = """io AS (SELECT *, CASE WHEN start_index <= max(end_index) OVER (PARTITION BY channel ORDER BY start_index, end_index, method_rank, region_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 6 THEN 0 ELSE 1 END AS opens FROM t4),
i AS (SELECT *, sum(opens) OVER (PARTITION BY channel ORDER BY start_index, end_index, method_rank, region_idx ROWS UNBOUNDED PRECEDING) AS island FROM io)"""
ZONES = f"""cover AS (SELECT DISTINCT channel, island, method, unnest(range(start_index, end_index + 1)) AS pt FROM i),
sup AS (SELECT channel, island, pt FROM cover GROUP BY ALL HAVING count(*) >= 2),
zr AS (SELECT *, pt - row_number() OVER (PARTITION BY channel, island ORDER BY pt) AS grp FROM sup),
zones AS (SELECT channel, island, min(pt) AS start_index, max(pt) AS end_index FROM zr GROUP BY channel, island, grp)"""

MA = "CASE WHEN count(value) OVER (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 THEN avg(value) OVER (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END"
MA_FILL = "coalesce(ma, first_value(ma IGNORE NULLS) OVER (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), last_value(ma IGNORE NULLS) OVER (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"
MEDIAN = "list_sort([lag(value, 2, 0.0) OVER w, lag(value, 1, 0.0) OVER w, value, lead(value, 1, 0.0) OVER w, lead(value, 2, 0.0) OVER w])[3]"


def savgol(source: str) -> str:
    """sg: the series of `source` with the fitted value."""
    rows = savgol_rows()

    def fit(place: int) -> str:
        return " + ".join(f"{float(rows[place][k])!r} * x{k - place + 10}" for k in range(11))

    shifted = ", ".join(f"{'lag' if k < 0 else 'lead'}(value, {abs(k)}) OVER w AS x{k + 10}" for k in range(-10, 11))
    cases = " ".join(f"WHEN sample_index = {j} THEN {fit(j)} WHEN last - sample_index = {j} THEN {fit(10 - j)}" for j in range(5))
    return f"""sgx AS (SELECT *, max(sample_index) OVER (PARTITION BY channel) AS last, {shifted} FROM {source} WINDOW w AS (PARTITION BY channel ORDER BY sample_index)),
sg AS (SELECT dataset, channel, sample_index, time, value, CASE WHEN last < 10 THEN NULL {cases} ELSE {fit(5)} END AS savitzky_golay FROM sgx)"""


def butterworth(source: str, cutoff: float = 0.2) -> str:
    """bw: the series with the zero-phase low-pass, as sums over its impulse response: forward, behind what a constant would have left, and
    backward, over an odd extension of 15 samples."""
    h = ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in enumerate(impulse_response(*butterworth_coefficients(4, cutoff)).tolist()))
    return f"""h(k, h) AS (VALUES {h}), bn AS (SELECT channel, count(*) AS n, arg_min(value, sample_index) AS x0, arg_max(value, sample_index) AS xl FROM {source} GROUP BY channel),
wd AS (SELECT channel, 15 - sample_index AS j, 2 * x0 - value AS x FROM {source} JOIN bn USING (channel) WHERE sample_index BETWEEN 1 AND 15
  UNION ALL SELECT channel, sample_index + 15, value FROM {source}
  UNION ALL SELECT channel, 2 * n + 13 - sample_index, 2 * xl - value FROM {source} JOIN bn USING (channel) WHERE sample_index BETWEEN n - 16 AND n - 2),
w0 AS (SELECT channel, arg_min(x, j) AS w0, max(j) AS top FROM wd GROUP BY channel),
y1 AS (SELECT wd.channel, wd.j + h.k AS j, any_value(w0) + sum(h.h * (wd.x - w0)) AS y FROM wd JOIN w0 USING (channel) CROSS JOIN h WHERE wd.j + h.k <= top GROUP BY wd.channel, wd.j + h.k),
yl AS (SELECT channel, arg_max(y, j) AS yl FROM y1 GROUP BY channel),
y2 AS (SELECT y1.channel, y1.j - h.k AS j, any_value(yl) + sum(h.h * (y1.y - yl)) AS y FROM y1 JOIN yl USING (channel) CROSS JOIN h WHERE y1.j >= h.k GROUP BY y1.channel, y1.j - h.k),
bw AS (SELECT s.*, y2.y AS butterworth FROM {source} s JOIN y2 ON y2.channel = s.channel AND y2.j = s.sample_index + 15)"""


def all_filters(source: str) -> str:
    """fl: the series with all four; long: a row per sample and filter."""
    return f"""{savgol(source)}, {butterworth(source)}, mw AS (SELECT *, {MA} AS ma, {MEDIAN} AS median FROM {source} WINDOW w AS (PARTITION BY channel ORDER BY sample_index)),
mf AS (SELECT *, {MA_FILL} AS moving_average FROM mw),
fl AS (SELECT mf.dataset, mf.channel, mf.sample_index, mf.time, mf.value, moving_average, butterworth, savitzky_golay, median FROM mf JOIN sg USING (channel, sample_index) JOIN bw USING (channel, sample_index)),
long AS (SELECT dataset, channel, sample_index, time, value AS raw, unnest(['moving_average', 'butterworth', 'savitzky_golay', 'median']) AS filter, unnest([moving_average, butterworth, savitzky_golay, median]) AS filtered FROM fl)"""


def cleaned_values(source: str) -> str:
    """k: the series of `source`, whose column v has nulls, with the known values around; CLEAN fills them."""
    return f"""k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS lv, last_value(CASE WHEN v IS NOT NULL THEN sample_index END IGNORE NULLS) OVER b AS li, first_value(v IGNORE NULLS) OVER a AS rv,
  first_value(CASE WHEN v IS NOT NULL THEN sample_index END IGNORE NULLS) OVER a AS ri FROM {source} WINDOW b AS (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  a AS (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


CLEAN = "CASE WHEN v IS NOT NULL THEN v WHEN lv IS NULL THEN rv WHEN rv IS NULL THEN lv ELSE lv + (rv - lv) * (sample_index - li) / (ri - li) END"
SHIFTED = f"""s AS ({EV_TYPE}), v AS (SELECT dataset, channel, sample_index, time, value - avg(value) FILTER (WHERE sample_index < 100) OVER (PARTITION BY channel) AS value FROM s)"""
LONG = f"{SHIFTED}, {all_filters('v')}"
RECORDED = f"""rs AS ({EV_TYPE}), rec AS (SELECT channel AS dataset, sample_index, time, unnest(['FBG1', 'FBG2', 'FBG3']) AS fbg, unnest([value, 2 * value, CASE WHEN sample_index % 5 = 0 THEN NULL ELSE value END]) AS v FROM rs)"""
EXPERIMENT = f"""{RECORDED}, rc AS (SELECT dataset, dataset || '|' || fbg AS channel, sample_index, time, v FROM rec), {cleaned_values('rc')}, kc AS (SELECT dataset, channel, sample_index, time, {CLEAN} AS c FROM k),
v AS (SELECT dataset, channel, sample_index, time, c - avg(c) FILTER (WHERE sample_index < 100) OVER (PARTITION BY channel) AS value FROM kc), {all_filters('v')}"""

# The chain from a filtered series s to events.

PEAKS = """y AS MATERIALIZED (SELECT s.channel, sample_index, sg.sign, sg.sign * (value - mu) AS y FROM s JOIN bl USING (channel), (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) sg(sign)),
yr AS (SELECT *, sum(opens) OVER (PARTITION BY channel, sign ORDER BY sample_index ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY channel, sign ORDER BY sample_index) THEN 0 ELSE 1 END AS opens FROM y)),
lv AS (SELECT channel, sign, run, any_value(y) AS y, min(sample_index) AS lo, max(sample_index) AS hi FROM yr GROUP BY channel, sign, run),
tp AS (SELECT channel, sign, (lo + hi) // 2 AS ix, y FROM (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM lv WINDOW w AS (PARTITION BY channel, sign ORDER BY run)) WHERE a < y AND b < y),
rk AS MATERIALIZED (SELECT channel, sign, ix, row_number() OVER (PARTITION BY channel, sign ORDER BY y DESC, ix DESC) AS k FROM tp),
sp(channel, sign, k, kept) AS (SELECT channel, sign, 0::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT channel, sign FROM rk)
  UNION ALL SELECT r.channel, r.sign, r.k, CASE WHEN len(list_filter(sp.kept, lambda x: abs(x - r.ix) < @distance)) = 0 THEN list_append(sp.kept, r.ix) ELSE sp.kept END FROM sp JOIN rk r ON r.channel = sp.channel AND r.sign = sp.sign AND r.k = sp.k + 1),
kp AS (SELECT channel, sign, unnest(arg_max(kept, k)) AS ix FROM sp GROUP BY channel, sign),
hp AS (SELECT kp.channel, kp.sign, kp.ix, y.y AS h FROM kp JOIN y ON y.channel = kp.channel AND y.sign = kp.sign AND y.sample_index = kp.ix),
ed AS (SELECT hp.channel, hp.sign, hp.ix, any_value(h) AS h, max(sample_index) FILTER (WHERE sample_index < ix AND y > h) AS l, min(sample_index) FILTER (WHERE sample_index > ix AND y > h) AS r
  FROM hp JOIN y ON y.channel = hp.channel AND y.sign = hp.sign GROUP BY hp.channel, hp.sign, hp.ix),
pm AS (SELECT ed.channel, ed.sign, ed.ix, any_value(h) - greatest(min(y) FILTER (WHERE sample_index <= ix AND sample_index > coalesce(l, -1)), min(y) FILTER (WHERE sample_index >= ix AND (r IS NULL OR sample_index < r))) AS prominence
  FROM ed JOIN y ON y.channel = ed.channel AND y.sign = ed.sign GROUP BY ed.channel, ed.sign, ed.ix),
pk AS (SELECT pm.* FROM pm JOIN bl USING (channel) WHERE prominence >= @prominence * sigma)"""


def detected(p: Parameters, methods: tuple[str, ...]) -> str:
    """bl: baselines; t4: the regions of the methods."""
    d = p.detectors
    n = d.baseline_samples
    parts = [f"bl AS MATERIALIZED (SELECT channel, avg(value) FILTER (WHERE sample_index < {n}) AS mu, stddev_pop(value) FILTER (WHERE sample_index < {n}) AS sigma, count(*) AS n_samples FROM s GROUP BY channel)"]
    if "peak" in methods:
        parts += [
            PEAKS.replace("@distance", str(d.peak_distance)).replace("@prominence", str(d.prominence_multiplier)),
            f"box AS (SELECT channel, greatest(ix - {d.peak_before}, 0) AS start_index, least(ix + {d.peak_after}, n_samples - 1) AS end_index FROM pk JOIN bl USING (channel))",
            merged("pw", "box", 0),
            f"pl AS (SELECT * FROM pw WHERE end_index - start_index + 1 >= {d.min_samples})",
            merged("c_peak", "pl", d.peak_gap),
        ]
    if "threshold" in methods:
        parts += [f"m_t AS (SELECT s.channel, sample_index, abs(value - mu) > {d.threshold_multiplier} * sigma AS mask FROM s JOIN bl USING (channel))", cleaned("c_threshold", "_t", d.min_samples, d.threshold_gap)]
    if "derivative" in methods:
        parts += [
            SLOPES,
            f"db AS (SELECT channel, avg(slope) AS dm, stddev_pop(slope) AS ds FROM d WHERE sample_index < {n} GROUP BY channel)",
            f"m_d AS (SELECT d.channel, sample_index, abs(slope - dm) > {d.derivative_multiplier} * ds AS mask FROM d JOIN db USING (channel))",
            cleaned("c_derivative", "_d", max(d.min_samples, d.derivative_persistence), d.derivative_gap),
        ]
    if "change_point" in methods:
        w = d.change_point_window
        parts += [
            f"cf AS (SELECT *, avg(value) OVER w AS wm, stddev_pop(value) OVER w AS ws, count(*) OVER w AS wc FROM s WINDOW w AS (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING))",
            f"m_c AS (SELECT channel, sample_index, coalesce(wc = {w} AND ws > 0 AND abs(value - wm) / nullif(ws, 0) > {d.change_point_threshold}, false) AS mask FROM cf)",
            cleaned("c_change_point", "_c", d.min_samples, d.change_point_gap),
        ]
    rows = " UNION ALL ".join(f"SELECT channel, '{m}' AS method, {i} AS method_rank, row_number() OVER (PARTITION BY channel ORDER BY start_index) - 1 AS region_idx, start_index, end_index FROM c_{m}" for i, m in enumerate(methods))
    return ", ".join([*parts, f"t4 AS MATERIALIZED ({rows})"])


def grouped(p: Parameters, source: str = "t4") -> str:
    """evt: the regions with event_id."""
    gap, split = p.detectors.match_tolerance, p.detectors.split_min_gap
    return f"""io AS (SELECT *, CASE WHEN start_index <= max(end_index) OVER (PARTITION BY channel ORDER BY start_index, end_index, method_rank, region_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap + 1} THEN 0 ELSE 1 END AS opens FROM {source}),
i AS (SELECT *, sum(opens) OVER (PARTITION BY channel ORDER BY start_index, end_index, method_rank, region_idx ROWS UNBOUNDED PRECEDING) AS island FROM io),
{ZONES}, zc AS (SELECT *, CASE WHEN start_index - lag(end_index) OVER (PARTITION BY channel, island ORDER BY start_index) - 1 > {split} THEN 1 ELSE 0 END AS cuts FROM zones),
zk AS (SELECT *, sum(cuts) OVER (PARTITION BY channel, island ORDER BY start_index ROWS UNBOUNDED PRECEDING) AS cluster FROM zc),
cl AS (SELECT channel, island, cluster, min(start_index) AS zs, max(end_index) AS ze FROM zk GROUP BY ALL),
pick AS (SELECT i.channel, i.island, i.method, i.method_rank, i.region_idx, i.start_index, i.end_index, arg_min(cluster, {{'m': CASE WHEN i.start_index <= ze AND i.end_index >= zs THEN 0 ELSE 1 END,
  'd': CASE WHEN i.start_index <= ze AND i.end_index >= zs THEN 0 ELSE least(abs(i.start_index - ze), abs(i.end_index - zs)) END, 'c': cluster}}) AS cluster
  FROM i LEFT JOIN cl ON i.channel = cl.channel AND i.island = cl.island GROUP BY ALL),
o AS (SELECT *, min({{'r': method_rank, 'i': region_idx}}) OVER (PARTITION BY channel, island) AS first FROM pick),
kk AS (SELECT *, dense_rank() OVER (PARTITION BY channel ORDER BY first, coalesce(cluster, 0)) AS k FROM o),
evt AS MATERIALIZED (SELECT *, 'events-' || channel || '-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS event_id FROM kk),
hull AS (SELECT channel, event_id, min(start_index) AS start0, max(end_index) AS end0, list_sort(list_distinct(list(method))) AS methods FROM evt GROUP BY channel, event_id),
lr AS (SELECT channel, event_id, method, arg_max({{'s': start_index, 'e': end_index}}, region_idx) AS r FROM evt GROUP BY channel, event_id, method),
mi AS (SELECT event_id, method, arg_min(sample_index, {{'a': -abs(value), 'i': sample_index}}) AS ix FROM lr JOIN s ON s.channel = lr.channel AND sample_index BETWEEN r.s AND r.e GROUP BY event_id, method)"""


def refined(p: Parameters) -> str:
    """ag: the events of hull (channel, event_id, start0, end0, methods) with refined ends and peaks."""
    f, c = p.refinement, p.refinement.confirmation
    return f"""rw AS (SELECT hull.channel, event_id, start0, end0, mu, sigma, n_samples, sample_index AS i, time, value FROM hull JOIN bl USING (channel) JOIN s ON s.channel = hull.channel AND sample_index BETWEEN start0 AND end0 + {c - 1}),
p0 AS (SELECT event_id, arg_min({{'i': i, 'v': value}}, {{'a': -abs(value), 'i': i}}) FILTER (WHERE i <= end0) AS p FROM rw GROUP BY event_id),
rq AS (SELECT rw.*, p0.p.i AS pi, greatest({f.noise_std} * sigma, {f.recovery_ratio} * abs(p0.p.v - mu)) AS tol FROM rw JOIN p0 USING (event_id)),
rn AS MATERIALIZED (SELECT *, CASE WHEN abs(value - mu) <= tol THEN 1 ELSE 0 END AS quiet, CASE WHEN count(*) OVER w = {c} THEN sum(CASE WHEN abs(value - mu) <= tol THEN 1 ELSE 0 END) OVER w END AS run FROM rq
  WINDOW w AS (PARTITION BY event_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {c - 1} FOLLOWING)),
b2 AS (SELECT event_id, coalesce(max(i) FILTER (WHERE i < pi AND quiet = 1) + 1, any_value(start0)) AS ns, coalesce(min(i) FILTER (WHERE i >= pi AND i <= least(end0, n_samples - {c}) AND run = {c}), any_value(end0)) AS ne FROM rn GROUP BY event_id),
a2 AS (SELECT event_id, arg_min({{'i': i, 'v': value, 't': time}}, {{'a': -abs(value), 'i': i}}) AS p, min(time) AS st, max(time) AS et, any_value(ns) AS ns, any_value(ne) AS ne, any_value(tol) AS tol
  FROM rn JOIN b2 USING (event_id) WHERE i BETWEEN ns AND ne GROUP BY event_id),
ag AS (SELECT hull.*, mu, sigma, n_samples, p.i AS peak_index, p.v AS peak_value, p.t AS peak_time, st, et, ns, ne, tol FROM hull JOIN a2 USING (event_id) JOIN bl USING (channel))"""


def classified(p: Parameters, r: Rules) -> str:
    """ev: the events with evidence and reason."""
    w = p.weights.normalised()
    weight = "CASE x " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in w.items()) + " ELSE 0 END"
    shown = "CASE WHEN dev = 'inf'::DOUBLE THEN 'inf' ELSE printf('%.2f', dev) END"
    return f"""ec AS (SELECT *, CAST(len(methods) AS INTEGER) AS n_methods, least(1.0::DOUBLE, list_sum(list_transform(methods, lambda x: {weight}))) AS score, CASE WHEN sigma <= {r.flat_std} THEN 'inf'::DOUBLE ELSE abs(peak_value - mu) / sigma END AS dev FROM ag),
ev AS MATERIALIZED (SELECT *, CASE WHEN ne - ns + 1 < {r.min_duration_samples} THEN 'duration_below_min_samples (' || (ne - ns + 1) || ' < {r.min_duration_samples})'
  WHEN ne >= n_samples - {r.end_margin} THEN 'no_confirmed_recovery (end_index=' || ne || ', signal_length=' || n_samples || ')'
  WHEN n_methods <= {r.noise_like_methods} AND dev <= {r.noise_like_std} THEN 'noise_like_event (methods=' || n_methods || ', dev_std=' || {shown} || ')'
  WHEN dev < {r.min_deviation_std} THEN 'low_amplitude (dev_std=' || {shown} || ' < {r.min_deviation_std})'
  WHEN n_methods < {r.min_agreement} THEN 'insufficient_method_agreement (' || n_methods || ' < {r.min_agreement})'
  WHEN score < {r.min_evidence} THEN 'evidence_below_minimum (' || printf('%.3f', score) || ' < {r.min_evidence})' END AS reason FROM ec)"""


def events_of(series: str, p: Parameters, methods: tuple[str, ...] = METHODS, rules: Rules | None = None) -> str:
    """All CTEs from `series` (which ends with s) to ev."""
    return f"WITH RECURSIVE {series}, {detected(p, methods)}, {grouped(p)}, {refined(p)}, {classified(p, rules or p.rules)}"


USER_SIGNAL = f"us AS ({EV_USER}), {savgol('us')}, s AS MATERIALIZED (SELECT dataset, channel, sample_index, time, savitzky_golay AS value FROM sg)"
TYPE_MA = f"ts AS ({EV_TYPE}), ta AS (SELECT *, {MA} AS ma FROM ts), s AS MATERIALIZED (SELECT dataset, channel, sample_index, time, {MA_FILL} AS value FROM ta)"
FOUND = events_of(USER_SIGNAL, _USER)
USER_REGIONS = f"us AS ({EV_USER}), s AS MATERIALIZED (SELECT dataset, channel, sample_index, time, value FROM us), {detected(_USER, ('threshold',))}, rg AS MATERIALIZED (SELECT *, 'events-' || channel || '-' || CASE WHEN region_idx < 1000 THEN lpad(CAST(region_idx AS VARCHAR), 3, '0') ELSE CAST(region_idx AS VARCHAR) END AS event_id FROM t4)"


def levels(events: str, dataset: str) -> str:
    """pl2: the level behind each event (channel, event_id, a, b) of `events`, apart from samples of other events of its dataset."""
    return f"""le AS (SELECT e.event_id, e.channel, e.a, e.b, bl.n_samples, {dataset} AS ds, b + 5 AS low, least(b + 55, bl.n_samples) - 1 AS high FROM {events} e JOIN bl USING (channel)),
ln AS (SELECT le.event_id, s.value, s.sample_index AS ix, le.ds FROM le JOIN s ON s.channel = le.channel AND s.sample_index BETWEEN low AND high),
lf AS (SELECT event_id, median(value) AS level, count(*) AS k FROM ln WHERE NOT EXISTS (SELECT 1 FROM le o WHERE o.ds = ln.ds AND ln.ix BETWEEN o.a AND o.b) GROUP BY event_id),
pl2 AS (SELECT le.event_id, CASE WHEN coalesce(k, 0) >= 5 THEN level END AS level, coalesce(k, 0) AS k,
  CASE WHEN low >= n_samples THEN 'insufficient_post_impact_samples(start_past_end)' WHEN coalesce(k, 0) < 5 THEN 'insufficient_post_impact_samples(' || coalesce(k, 0) || '<5)' ELSE '' END AS why FROM le LEFT JOIN lf USING (event_id))"""


SHAPE = f"""{FOUND}, ok AS MATERIALIZED (SELECT *, ns AS a, ne AS b FROM ev WHERE reason IS NULL),
ew AS MATERIALIZED (SELECT ok.event_id, ok.channel, sample_index - ns AS pos, ne - ns + 1 AS n, time, value FROM ok JOIN s ON s.channel = ok.channel AND sample_index BETWEEN ns AND ne),
es AS (SELECT *, time - lag(time) OVER w AS hs, lead(time) OVER w - time AS hd, lag(value) OVER w AS xl, lead(value) OVER w AS xr FROM ew WINDOW w AS (PARTITION BY event_id ORDER BY pos)),
sums AS (SELECT event_id, sqrt(avg(value * value)) AS rms, max(value) - min(value) AS ptp, var_pop(value) AS var, stddev_pop(value) AS std, coalesce(sum(hs * (value * value + xl * xl) / 2), 0) AS energy, coalesce(sum(hs * (abs(value) + abs(xl)) / 2), 0) AS area,
  max(abs(CASE WHEN hs IS NULL AND hd IS NULL THEN NULL WHEN hs IS NULL THEN (xr - value) / hd WHEN hd IS NULL THEN (value - xl) / hs ELSE (hs * hs * xr + (hd * hd - hs * hs) * value - hd * hd * xl) / (hs * hd * (hs + hd)) END)) AS slope FROM es GROUP BY event_id),
eh AS (SELECT event_id, value, CASE WHEN min(value) OVER w = max(value) OVER w THEN min(value) OVER w - 0.5 ELSE min(value) OVER w END AS lo, CASE WHEN min(value) OVER w = max(value) OVER w THEN max(value) OVER w + 0.5 ELSE max(value) OVER w END AS hi, count(*) OVER w AS total FROM ew WINDOW w AS (PARTITION BY event_id)),
eb AS (SELECT event_id, least(CAST(floor((value - lo) / ((hi - lo) / 20)) AS BIGINT), 19) AS bin, count(*) / (any_value(total) * any_value((hi - lo) / 20)) AS d FROM eh GROUP BY event_id, bin),
en AS (SELECT event_id, -sum(d * log2(d)) AS entropy FROM eb GROUP BY event_id),
{levels('ok', "'events'")}, sh AS (SELECT ok.*, rms, ptp, var, std, energy, area, slope, entropy, level, k AS level_n, why FROM ok JOIN sums USING (event_id) JOIN en USING (event_id) JOIN pl2 USING (event_id))"""

MULTI = f"""{SHAPE}, sf0 AS (SELECT channel, time - lag(time) OVER (PARTITION BY channel ORDER BY sample_index) AS dt FROM s), sf AS (SELECT channel, 1 / median(dt) FILTER (WHERE dt > 0) AS fs FROM sf0 GROUP BY channel),
em AS (SELECT *, avg(value) OVER (PARTITION BY event_id) AS mean FROM ew),
td AS (SELECT event_id, count(*) AS td_n, avg(value) AS td_mean, median(value) AS td_median, stddev_pop(value) AS td_std, var_pop(value) AS td_var, sqrt(avg(value * value)) AS td_rms, min(value) AS td_min, max(value) AS td_max,
  CASE WHEN count(*) >= 3 AND stddev_pop(value) >= 1e-15 THEN avg(pow(value - mean, 3)) / pow(stddev_pop(value), 3) END AS td_skew, CASE WHEN count(*) >= 4 AND stddev_pop(value) >= 1e-15 THEN avg(pow(value - mean, 4)) / pow(var_pop(value), 2) - 3 END AS td_kurt,
  CASE WHEN sqrt(avg(value * value)) >= 1e-15 THEN max(abs(value)) / sqrt(avg(value * value)) END AS td_crest FROM em GROUP BY event_id),
ec2 AS (SELECT event_id, channel, pos, n, (value - mean) * (0.5 - 0.5 * cos(2 * pi() * pos / (n - 1))) AS v FROM em WHERE n >= 8),
sp2 AS (SELECT event_id, channel, k, n, sqrt(pow(sum(v * cos(2 * pi() * ((k * pos) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((k * pos) % n) / n)), 2)) AS mag FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM ec2) GROUP BY event_id, channel, k, n),
sq AS (SELECT *, k * fs / n AS f, mag * mag AS p FROM sp2 JOIN sf USING (channel)),
sr AS (SELECT *, sum(p) OVER (PARTITION BY event_id) AS total, sum(p) OVER (PARTITION BY event_id ORDER BY k) AS cum, sum(f * p) OVER (PARTITION BY event_id) / sum(p) OVER (PARTITION BY event_id) AS cen FROM sq),
fd AS (SELECT event_id, CAST(any_value(n) AS BIGINT) AS fd_n, arg_max(f, mag) FILTER (WHERE k >= 1) AS dom, max(mag) FILTER (WHERE k >= 1) AS dmag, max(total) AS se, -sum(p / total * log2(p / total)) FILTER (WHERE p > 0) AS sent, any_value(cen) AS scen, sqrt(sum(pow(f - cen, 2) * p) / max(total)) AS sbw,
  exp(avg(ln(p)) FILTER (WHERE p > 0)) / avg(p) AS sflat, min(f) FILTER (WHERE cum >= 0.85 * total) AS sroll FROM sr GROUP BY event_id),
zn AS (SELECT event_id, channel, pos, value, n, least(n, greatest(32, n // 4)) AS seg FROM ew WHERE n >= 16), {{STFT}},
mu2 AS (SELECT sh.*, fs, td.*, fd.*, st.* FROM sh JOIN sf USING (channel) JOIN td USING (event_id) LEFT JOIN fd USING (event_id) LEFT JOIN st USING (event_id)),
mu3 AS (SELECT *, concat_ws('; ', CASE WHEN td_n = 1 THEN 'time_domain:single_sample_event' END, CASE WHEN td_n < 8 THEN 'frequency_domain:insufficient_samples(' || td_n || '<8)' END, CASE WHEN td_n < 16 THEN 'stft:event_too_short(' || td_n || '<16)' END) AS failure FROM mu2)"""

#: From zn (event_id, channel, pos, value, n, seg) to st: the frequency and energy of the frame with the greatest magnitude.
STFT = """zs2 AS (SELECT event_id, any_value(channel) AS channel, any_value(n) AS n, any_value(seg) AS seg, any_value(seg) - least(any_value(seg) // 2, any_value(seg) - 1) AS hop FROM zn GROUP BY event_id),
zf AS (SELECT *, unnest(range(0, (n + 2 * (seg // 2) - seg + hop - 1) // hop + 1)) AS frame FROM zs2),
zj AS (SELECT zf.event_id, zf.frame, zf.seg, zf.channel, zn.pos + zf.seg // 2 - frame * hop AS j, zn.value AS v FROM zf JOIN zn ON zn.event_id = zf.event_id AND zn.pos + zf.seg // 2 - frame * hop BETWEEN 0 AND zf.seg - 1),
zw AS (SELECT *, v * (0.5 - 0.5 * cos(2 * pi() * j / seg)) AS x FROM zj),
zm AS (SELECT event_id, channel, frame, seg, k, sqrt(pow(sum(x * cos(2 * pi() * ((k * j) % seg) / seg)), 2) + pow(sum(x * sin(2 * pi() * ((k * j) % seg) / seg)), 2)) / (seg / 2.0) AS mag FROM (SELECT *, unnest(range(0, seg // 2 + 1)) AS k FROM zw) GROUP BY event_id, channel, frame, seg, k),
zt AS (SELECT event_id, any_value(channel) AS channel, any_value(seg) AS seg, arg_max({'k': k, 'f': frame}, {'m': mag, 'k': -k, 'f': -frame}) AS top FROM zm GROUP BY event_id),
st AS (SELECT zt.event_id, any_value(top.k * fs / zt.seg) AS st_freq, sum(mag * mag) AS st_energy FROM zt JOIN zm ON zm.event_id = zt.event_id AND zm.frame = top.f JOIN sf ON sf.channel = zt.channel GROUP BY zt.event_id)"""
MULTI = MULTI.replace("{STFT}", STFT)


PEAK = "arg_min({{'i': sample_index, 'v': {0}, 't': time}}, {{'a': -abs({0}), 'i': sample_index}})"
HANN = f"""w AS ({EMB}), c AS (SELECT *, (value - avg(value) OVER (PARTITION BY event_id)) * (0.5 - 0.5 * cos(2 * pi() * pos / (n - 1))) AS v FROM w),
sp AS (SELECT dataset, channel, event_id, k, n, sqrt(pow(sum(v * cos(2 * pi() * ((k * pos) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((k * pos) % n) / n)), 2)) AS mag
  FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM c) GROUP BY dataset, channel, event_id, k, n)"""
SPECTRUM = f"WITH {HANN} SELECT dataset, channel, event_id, k, {r('mag', 'mag')}, CAST(n AS BIGINT) AS n FROM sp"
MOMENTS = f"""w AS ({EMB}), mm AS (SELECT *, avg(value) OVER p AS mu, count(*) OVER p AS total FROM w WINDOW p AS (PARTITION BY event_id)),
tf AS (SELECT dataset, channel, event_id, count(*) AS td_samples, avg(value) AS td_mean, median(value) AS td_median, stddev_pop(value) AS td_std, var_pop(value) AS td_variance, sqrt(avg(value * value)) AS td_rms,
  min(value) AS td_minimum, max(value) AS td_maximum, max(value) - min(value) AS td_peak_to_peak, avg(pow(value - mu, 3)) / pow(stddev_pop(value), 3) AS td_skewness,
  avg(pow(value - mu, 4)) / pow(var_pop(value), 2) - 3 AS td_kurtosis, max(abs(value)) / sqrt(avg(value * value)) AS td_crest_factor FROM mm GROUP BY dataset, channel, event_id)"""
_TD = "mean median std variance rms minimum maximum peak_to_peak skewness kurtosis crest_factor".split()


REGIONS = f"WITH RECURSIVE s AS MATERIALIZED ({EV_TYPE}), {detected(LOOSE_ALL, METHODS)}"
METRICS = f"stddev_pop(raw) FILTER (WHERE sample_index < 100) AS a, stddev_pop(filtered) FILTER (WHERE sample_index < 100) AS b, {PEAK.format('raw')} AS pr, {PEAK.format('filtered')} AS pf"
METRIC_COLUMNS = f"{r('a', 'raw_noise_std')}, {r('b', 'filtered_noise_std')}, {r('pf.v', 'peak_value')}, {r('pf.t', 'peak_time')}, {r('coalesce(abs(pf.v) / nullif(abs(pr.v), 0), 0)', 'peak_preservation')}, {r('abs(pr.t - pf.t)', 'peak_time_error')}"


def columns(named: dict[str, str], plain: tuple[str, ...] = (), digits: int = 6) -> str:
    """Rounded expressions by name, but for those that aren't doubles."""
    return ", ".join(f"{x} AS {name}" if name in plain else r(x, name, digits) for name, x in named.items())


EVENT_ROWS = columns(
    {
        "event_id": "event_id", "dataset": "'events'", "channel": "channel", "start_index": "ns", "peak_index": "peak_index", "end_index": "ne", "start_time": "st", "peak_time": "peak_time", "end_time": "et", "peak_value": "peak_value",
        "duration": "et - st", "detection_methods": "array_to_string(methods, '|')", "method_count": "n_methods", "evidence_score": "score", "accepted": "reason IS NULL", "rejection_reason": "coalesce(reason, '')",
    },
    ("event_id", "dataset", "channel", "start_index", "peak_index", "end_index", "detection_methods", "method_count", "accepted", "rejection_reason"),
)
SHAPE_ROWS = columns(
    {
        "dataset": "'events'", "fbg": "channel", "impact_id": "event_id", "start_time": "st", "peak_time": "peak_time", "end_time": "et", "pre_impact_baseline": "mu", "peak_value": "peak_value", "peak_shift": "peak_value - mu",
        "absolute_peak_shift": "abs(peak_value - mu)", "post_impact_level": "level", "residual_shift": "level - mu", "rise_time": "peak_time - st", "recovery_time": "et - peak_time", "peak_width": "et - st", "max_slope": "slope", "rms": "rms",
        "signal_energy": "energy", "peak_to_peak": "ptp", "variance": "var", "standard_deviation": "std", "entropy": "entropy", "area_under_curve": "area", "residual_n_samples": "level_n", "residual_reason": "why",
    },
    ("dataset", "fbg", "impact_id", "residual_n_samples", "residual_reason"),
    3,
)
_ONE = "CASE WHEN td_n > 1 THEN {} END".format
MULTI_ROWS = columns(
    {
        "dataset": "'events'", "fbg": "channel", "impact_id": "event_id", "start_time": "st", "peak_time": "peak_time", "end_time": "et", "duration": "et - st", "peak_shift": "peak_value - mu", "residual_shift": "level - mu",
        "rise_time": "peak_time - st", "recovery_time": "et - peak_time", "mean": _ONE("td_mean"), "median": _ONE("td_median"), "std": _ONE("td_std"), "variance": _ONE("td_var"), "rms": _ONE("td_rms"), "minimum": _ONE("td_min"),
        "maximum": _ONE("td_max"), "peak_to_peak": _ONE("td_max - td_min"), "skewness": _ONE("td_skew"), "kurtosis": _ONE("td_kurt"), "crest_factor": _ONE("td_crest"), "sampling_frequency_hz": "fs", "num_samples": "coalesce(fd_n, 0)",
        "dominant_frequency_hz": "dom", "dominant_magnitude": "dmag", "spectral_energy": "se", "spectral_entropy": "sent", "spectral_centroid_hz": "scen", "spectral_bandwidth_hz": "sbw", "spectral_flatness": "sflat",
        "spectral_rolloff_hz": "sroll", "stft_peak_frequency_hz": "st_freq", "stft_max_energy": "st_energy", "stft_valid": "td_n >= 16", "feature_status": "CASE WHEN failure = '' THEN 'ok' ELSE 'partial' END", "failure_reason": "failure",
    },
    ("dataset", "fbg", "impact_id", "num_samples", "stft_valid", "feature_status", "failure_reason"),
)


def consistency(tolerance: float) -> str:
    """cc: of the accepted events, how many there are, and how many have one of another channel near in time."""
    return f"""oa AS MATERIALIZED (SELECT * FROM ev WHERE reason IS NULL), cx AS (SELECT a.event_id, EXISTS (SELECT 1 FROM oa b WHERE b.channel <> a.channel AND abs(b.peak_time - a.peak_time) <= {tolerance}) AS near FROM oa a),
cc AS (SELECT (SELECT count(DISTINCT channel) FROM s) AS n_channels, count(*) AS n_events, count(*) FILTER (WHERE near) AS n_near FROM cx)"""


REJECTED = "SELECT CASE WHEN starts_with(reason, 'no_confirmed_recovery') THEN reason ELSE regexp_extract(reason, '^[a-z_]+') END AS rejection_reason, count(*) AS count FROM ev WHERE reason IS NOT NULL GROUP BY 1"
REPORT = f"""{FOUND}, {consistency(0.5)}, ch AS (SELECT count(*) AS n_events, avg(et - st) AS duration_mean_s, stddev_pop(et - st) AS duration_std_s, avg(peak_value) AS peak_value_mean, max(abs(peak_value)) AS peak_value_max,
  avg(CASE WHEN sigma > 0 THEN abs(peak_value - mu) / sigma END) AS peak_dev_std_mean, avg(score) AS evidence_mean, avg(n_methods) AS method_count_mean FROM oa),
tm0 AS (SELECT event_id, stddev_pop(ix) AS sd FROM mi JOIN oa USING (event_id) GROUP BY event_id HAVING count(*) >= 2),
tm AS (SELECT (SELECT count(*) FROM oa) AS timing_n_events, avg(sd) AS timing_mean_spread_samples, median(sd) AS timing_median_spread_samples, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE sd <= 10) END AS timing_events_within_tolerance FROM tm0),
rj AS ({REJECTED}),
mt AS (SELECT 'total_accepted_events' AS metric, (SELECT count(*) FROM oa)::DOUBLE AS value UNION ALL SELECT 'total_candidate_events', (SELECT count(*) FROM ev)::DOUBLE
  UNION ALL SELECT unnest(['n_events', 'duration_mean_s', 'duration_std_s', 'peak_value_mean', 'peak_value_max', 'peak_dev_std_mean', 'evidence_mean', 'method_count_mean']),
    unnest([n_events::DOUBLE, duration_mean_s, duration_std_s, peak_value_mean, peak_value_max, peak_dev_std_mean, evidence_mean, method_count_mean]) FROM ch
  UNION ALL SELECT unnest(['timing_n_events', 'timing_mean_spread_samples', 'timing_median_spread_samples', 'timing_events_within_tolerance']), unnest([timing_n_events::DOUBLE, timing_mean_spread_samples, timing_median_spread_samples, timing_events_within_tolerance::DOUBLE]) FROM tm
  UNION ALL SELECT 'agreement_' || n_methods, count(*)::DOUBLE FROM oa GROUP BY n_methods
  UNION ALL SELECT 'rejected_' || rejection_reason, count::DOUBLE FROM rj
  UNION ALL SELECT 'cross_channel_fraction_events', n_near / n_events::DOUBLE FROM cc)"""


def best_methods() -> str:
    """Each detector's events by themselves: how many are accepted, how far out and how long they are."""
    each = []
    for m in METHODS:
        each.append(f"SELECT '{m}' AS method, * FROM ({events_of(TYPE_MA, LOOSE_ALL, (m,), PERMISSIVE)} SELECT count(*) AS n, median(dev) FILTER (WHERE dev < 'inf'::DOUBLE) AS dev, avg(CASE WHEN et - st BETWEEN 0.1 AND 3.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS plausible FROM ev WHERE reason IS NULL)")
    return f"""SELECT method, n AS accepted_events, CASE WHEN n > 0 THEN 1::BIGINT ELSE 0::BIGINT END AS datasets_covered, {r('CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', 'coverage')}, {r('coalesce(dev, 0)', 'median_dev_std')}, {r('coalesce(plausible, 0)', 'plausible_fraction')},
  {r('CASE WHEN n > 0 THEN coalesce(dev, 0) * coalesce(plausible, 0) ELSE 0.0::DOUBLE END', 'score')} FROM ({' UNION ALL '.join(each)})"""


_STUDY = replace(LOOSE_ALL, detectors=replace(LOOSE_ALL.detectors, threshold_multiplier=0.6))
STUDY = f"""WITH RECURSIVE {TYPE_MA}, {detected(_STUDY, METHODS)}, tr AS (SELECT t4.*, mu, sigma FROM t4 JOIN bl USING (channel)),
tp2 AS (SELECT tr.channel, tr.method, tr.start_index, any_value(tr.end_index) AS end_index, any_value(mu) AS mu, any_value(sigma) AS sigma, arg_min({{'i': sample_index, 'v': value, 't': time}}, {{'a': -abs(value), 'i': sample_index}}) AS p FROM tr JOIN s ON s.channel = tr.channel AND sample_index BETWEEN tr.start_index AND tr.end_index GROUP BY tr.channel, tr.method, tr.start_index),
rc AS (SELECT t.channel, t.method, t.start_index, min(sample_index) AS ix FROM tp2 t JOIN s ON s.channel = t.channel AND sample_index > p.i AND sample_index <= t.end_index WHERE abs(value - mu) <= greatest(2.0 * sigma, 0.2 * abs(p.v - mu)) GROUP BY t.channel, t.method, t.start_index),
qt AS (SELECT channel, sample_index AS ix FROM (SELECT s.channel, sample_index, count(*) OVER w AS c, max(abs(value - mu)) OVER w AS far, sigma FROM s JOIN bl USING (channel) WINDOW w AS (PARTITION BY s.channel ORDER BY sample_index ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE c = 5 AND far <= 2.0 * sigma),
qe AS (SELECT rc.channel, rc.method, rc.start_index, any_value(rc.ix) AS ix, coalesce(min(qt.ix), any_value(rc.ix)) AS stop FROM rc LEFT JOIN qt ON qt.channel = rc.channel AND qt.ix >= rc.ix GROUP BY rc.channel, rc.method, rc.start_index),
sd AS (SELECT t.*, qe.ix AS recovery, coalesce(qe.stop, t.end_index) AS stop, row_number() OVER (PARTITION BY t.channel, t.method ORDER BY t.start_index) AS number FROM tp2 t LEFT JOIN qe USING (channel, method, start_index))
SELECT 'events' AS dataset, sd.channel, sd.method, CAST(number AS INTEGER) AS impact_number, sd.start_index, {r('a.time', 'start_time')}, p.i AS peak_index, {r('p.t', 'peak_time')}, {r('p.v', 'peak_value')}, recovery AS recovery_index, {r('c.time', 'recovery_time')}, stop AS end_index, {r('b.time', 'end_time')}, {r('b.time - a.time', 'duration')}
FROM sd JOIN s a ON a.channel = sd.channel AND a.sample_index = sd.start_index JOIN s b ON b.channel = sd.channel AND b.sample_index = stop LEFT JOIN s c ON c.channel = sd.channel AND c.sample_index = recovery"""


def oracle_sql() -> dict[str, str]:
    user = masked(EV_USER, 16, 0.8)
    found = {
        "s_series": f"SELECT dataset, channel, sample_index, {r('sample_index / 50.0::DOUBLE', 'time')}, {r('value', 'value')} FROM ({LI_SUPP})",
        "p_clean": f"""WITH s AS ({EV_TYPE}), h AS (SELECT * EXCLUDE (value), CASE WHEN sample_index % 7 < 2 OR sample_index < 3 THEN NULL ELSE value END AS v FROM s),
k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS lv, last_value(CASE WHEN v IS NOT NULL THEN sample_index END IGNORE NULLS) OVER b AS li, first_value(v IGNORE NULLS) OVER a AS rv,
  first_value(CASE WHEN v IS NOT NULL THEN sample_index END IGNORE NULLS) OVER a AS ri FROM h WINDOW b AS (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  a AS (PARTITION BY channel ORDER BY sample_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT dataset, channel, sample_index, {r('time', 'time')}, {r("CASE WHEN v IS NOT NULL THEN v WHEN lv IS NULL THEN rv WHEN rv IS NULL THEN lv ELSE lv + (rv - lv) * (sample_index - li) / (ri - li) END", 'value')} FROM k""",
        "p_shift": f"""WITH s AS ({EV_TYPE}), b AS (SELECT channel, avg(value) AS baseline FROM s WHERE sample_index < 100 GROUP BY channel)
SELECT dataset, channel, sample_index, {r('baseline', 'baseline')}, {r('value - baseline', 'shift')} FROM s JOIN b USING (channel)""",
        "f_moving_average": f"WITH s AS ({EV_TYPE}), a AS (SELECT *, {MA} AS ma FROM s) SELECT dataset, channel, sample_index, {r(MA_FILL, 'moving_average')} FROM a",
        "f_savitzky_golay": f"WITH s AS ({EV_TYPE}), {savgol('s')} SELECT dataset, channel, sample_index, {r('savitzky_golay', 'savitzky_golay')} FROM sg",
        "f_butterworth": f"WITH s AS ({EV_TYPE}), {butterworth('s')} SELECT dataset, channel, sample_index, {r('butterworth', 'butterworth')} FROM bw",
        "f_median": f"WITH s AS ({EV_TYPE}) SELECT dataset, channel, sample_index, {r(MEDIAN, 'median')} FROM s WINDOW w AS (PARTITION BY channel ORDER BY sample_index)",
        "s_recordings": f"WITH {RECORDED} SELECT dataset, fbg AS channel, sample_index, {r('time', 'time')}, {r('v', 'value')} FROM rec",
        "s_filtered": f"WITH {LONG} SELECT dataset, channel, sample_index, {r('time', 'time')}, {r('moving_average', 'moving_average')}, {r('butterworth', 'butterworth')}, {r('savitzky_golay', 'savitzky_golay')}, {r('median', 'median')} FROM fl",
        "n_experiment": f"""WITH {EXPERIMENT}, z AS (SELECT dataset, channel, filter, {METRICS} FROM long GROUP BY dataset, channel, filter) SELECT {METRIC_COLUMNS}, dataset, split_part(channel, '|', 2) AS channel, filter FROM z""",
        "n_noise_reduction": f"""WITH {LONG}, z AS (SELECT dataset, channel, filter, stddev_pop(raw) AS a, stddev_pop(filtered) AS b, sqrt(avg(raw * raw)) AS c, sqrt(avg(filtered * filtered)) AS d FROM long WHERE sample_index < 100 GROUP BY ALL)
SELECT dataset, channel, filter, {r('a', 'raw_noise_std')}, {r('b', 'filtered_noise_std')}, {r('c', 'raw_noise_rms')}, {r('d', 'filtered_noise_rms')}, {r('CASE WHEN a = 0 THEN 0 ELSE (a - b) / a * 100 END', 'noise_reduction_percent')} FROM z""",
        "n_filter_evaluation": f"WITH {LONG}, z AS (SELECT dataset, channel, filter, {METRICS} FROM long GROUP BY dataset, channel, filter) SELECT {METRIC_COLUMNS}, dataset, channel, filter FROM z",
        "n_drift": f"""WITH s AS ({EV_USER}), z AS (SELECT dataset, channel, avg(value) FILTER (WHERE sample_index < 16) AS bm, stddev_pop(value) FILTER (WHERE sample_index < 16) AS bs, count(*) AS n_samples, avg(value) AS sm, stddev_pop(value) AS ss,
  min(value) AS lo, max(value) AS hi FROM s GROUP BY ALL)
SELECT dataset, channel, {r('bm', 'baseline_mean')}, {r('bs', 'baseline_std')}, n_samples, {r('sm', 'signal_mean')}, {r('ss', 'signal_std')}, {r('lo', 'signal_min')}, {r('hi', 'signal_max')},
  {r('CASE WHEN bs > 1e-12 THEN abs(sm - bm) / bs ELSE 0 END', 'drift_std')}, {r('CASE WHEN bs > 1e-12 THEN greatest(abs(lo - bm), abs(hi - bm)) / bs ELSE 0 END', 'excursion_std')} FROM z""",
        "d_threshold": THRESHOLD,
        "d_derivative": f"WITH s AS ({EV_TYPE}), {SLOPES} SELECT dataset, channel, sample_index, {r('slope', 'derivative', 3)} FROM d",
        "d_derivative_regions": DERIVATIVE,
        "d_change_point": CHANGE,
        "d_simple_impacts": f"""WITH {masked(EV_TYPE, 100, 1.5)}, {runs()}, z AS (SELECT m.channel, start_index, end_index, {PEAK.format('value')} AS p FROM runs JOIN m ON m.channel = runs.channel AND sample_index BETWEEN start_index AND end_index GROUP BY ALL)
SELECT 'events' AS dataset, channel, start_index, end_index, p.i AS peak_index, {r('p.t', 'peak_time')}, {r('p.v', 'peak_value')} FROM z""",
        "r_islands": f"WITH {_T}, {runs()} SELECT 'events' AS dataset, channel, start_index, end_index FROM runs",
        "r_persistent": f"""WITH {user}, {runs()} SELECT m.dataset, m.channel, sample_index, runs.channel IS NOT NULL AS mask FROM m LEFT JOIN (SELECT * FROM runs WHERE end_index > start_index) runs
  ON m.channel = runs.channel AND sample_index BETWEEN start_index AND end_index""",
        "m_match_groups": f"""{REGIONS}, {ISLANDS} SELECT 'events' AS dataset, channel, min(start_index) AS start_index, max(end_index) AS end_index, count(*) AS regions, array_to_string(list_sort(list_distinct(list(method))), '|') AS methods
FROM i GROUP BY channel, island""",
        "m_support_zones": f"{REGIONS}, {ISLANDS}, {ZONES} SELECT 'events' AS dataset, channel, start_index, end_index FROM zones",
        "m_events": f"{REGIONS}, {grouped(replace(LOOSE_ALL, detectors=replace(LOOSE_ALL.detectors, split_min_gap=3)))} SELECT event_id, min(start_index) AS start_index, max(end_index) AS end_index, count(*) AS regions FROM evt GROUP BY event_id",
        "m_overlap": f"""{REGIONS} SELECT a.channel, a.region_idx, b.region_idx AS other_idx, {r("CASE WHEN least(a.end_index, b.end_index) >= greatest(a.start_index, b.start_index) THEN (least(a.end_index, b.end_index) - greatest(a.start_index, b.start_index) + 1) / (least(a.end_index - a.start_index, b.end_index - b.start_index) + 1)::DOUBLE ELSE 0.0::DOUBLE END", "overlap")},
  greatest(a.start_index, b.start_index) - CASE WHEN a.start_index <= b.start_index THEN a.end_index ELSE b.end_index END - 1 <= 5 AS near
FROM t4 a JOIN t4 b ON a.channel = b.channel AND b.start_index <= a.end_index + 6 AND b.end_index >= a.start_index - 6 WHERE a.method = 'threshold' AND b.method = 'derivative'""",
        "e_evidence": f"""{REGIONS}, {ISLANDS}, e AS (SELECT channel, island, sum(w) AS score FROM (SELECT DISTINCT channel, island, method, CASE method WHEN 'peak' THEN 0.30::DOUBLE WHEN 'threshold' THEN 0.30::DOUBLE WHEN 'derivative' THEN 0.25::DOUBLE ELSE 0.15::DOUBLE END AS w FROM i) GROUP BY ALL)
SELECT 'events' AS dataset, channel, {r('score', 'evidence')}, count(*) AS groups FROM e GROUP BY channel, round(score, 6)""",
        "a_trapezoid": f"""WITH w AS ({EMB}), z AS (SELECT *, time - lag(time) OVER p AS dt, lag(value) OVER p AS x0 FROM w WINDOW p AS (PARTITION BY event_id ORDER BY pos))
SELECT dataset, channel, event_id, {r('sum(dt * (value * value + x0 * x0) / 2)', 'signal_energy')}, {r('sum(dt * (abs(value) + abs(x0)) / 2)', 'area_under_curve')} FROM z GROUP BY ALL""",
        "a_entropy": f"""WITH w AS ({EMB}), z AS (SELECT *, min(value) OVER p AS lo, (max(value) OVER p - min(value) OVER p) / 20 AS width, count(*) OVER p AS total FROM w WINDOW p AS (PARTITION BY event_id)),
h AS (SELECT dataset, channel, event_id, least(CAST(floor((value - lo) / width) AS BIGINT), 19) AS bin, count(*) / (any_value(total) * any_value(width)) AS d FROM z GROUP BY dataset, channel, event_id, bin)
SELECT dataset, channel, event_id, {r('-sum(d * log2(d))', 'entropy', 4)} FROM h GROUP BY ALL""",
        "t_time_domain": f"WITH {MOMENTS} SELECT dataset, channel, event_id, td_samples, " + ", ".join(r(f"td_{c}", f"td_{c}") for c in _TD) + ", '' AS td_reason FROM tf",
        "q_sampling_frequency": f"""WITH s AS ({EV_TYPE}), z AS (SELECT *, time - lag(time) OVER (PARTITION BY channel ORDER BY sample_index) AS dt FROM s)
SELECT dataset, channel, {r('1 / median(dt) FILTER (WHERE dt > 0)', 'fs')}, '' AS fs_reason FROM z GROUP BY ALL""",
        "q_spectrum": SPECTRUM,
        "q_dft": SPECTRUM,
        "q_spectral_features": f"""WITH {HANN}, dt AS (SELECT dataset, channel, time - lag(time) OVER (PARTITION BY event_id ORDER BY pos) AS dt FROM w), fs AS (SELECT dataset, channel, 1 / median(dt) FILTER (WHERE dt > 0) AS fs FROM dt GROUP BY ALL),
q AS (SELECT *, k * fs / n AS f, mag * mag AS p FROM sp JOIN fs USING (dataset, channel)), t AS (SELECT *, sum(p) OVER (PARTITION BY event_id) AS total, sum(p) OVER (PARTITION BY event_id ORDER BY k) AS cum, sum(f * p) OVER (PARTITION BY event_id) / sum(p) OVER (PARTITION BY event_id) AS cen FROM q)
SELECT dataset, channel, event_id, {r('any_value(fs)', 'sampling_frequency_hz', 5)}, {r('arg_max(f, mag) FILTER (WHERE k >= 1)', 'dominant_frequency_hz', 5)}, {r('max(mag) FILTER (WHERE k >= 1)', 'dominant_magnitude', 5)}, CAST(any_value(n) AS BIGINT) AS num_samples,
  {r('max(total)', 'spectral_energy', 5)}, {r('-sum(p / total * log2(p / total))', 'spectral_entropy', 5)}, {r('any_value(cen)', 'spectral_centroid_hz', 5)}, {r('sqrt(sum(pow(f - cen, 2) * p) / max(total))', 'spectral_bandwidth_hz', 5)},
  {r('exp(avg(ln(p))) / avg(p)', 'spectral_flatness', 5)}, {r('min(f) FILTER (WHERE cum >= 0.85 * total)', 'spectral_rolloff_hz', 5)} FROM t GROUP BY dataset, channel, event_id""",
        "g_histogram": f"""WITH {MOMENTS}, l AS (SELECT min(td_std) AS lo, max(td_std) AS hi, least(greatest(count(*) // 3, 5), 30) AS bins FROM tf), z AS (SELECT least(CAST(floor((td_std - lo) / ((hi - lo) / bins)) AS BIGINT), bins - 1) AS bin, lo, (hi - lo) / bins AS width FROM tf, l)
SELECT bin, {r('any_value(lo) + bin * any_value(width)', 'low')}, {r('any_value(lo) + (bin + 1) * any_value(width)', 'high')}, count(*) AS count FROM z GROUP BY bin""",
        "d_peaks": f"""{REGIONS} SELECT 'events' AS dataset, pk.channel, ix AS sample_index, {r('s.time', 'time')}, {r('s.value', 'value')}, CASE WHEN sign > 0 THEN 'positive' ELSE 'negative' END AS type, {r('prominence', 'prominence')} FROM pk JOIN s ON s.channel = pk.channel AND s.sample_index = ix""",
        "d_study": STUDY,
        "b_refine": f"""WITH RECURSIVE {USER_REGIONS}, hull AS (SELECT channel, event_id, start_index AS start0, end_index AS end0 FROM rg), {refined(_USER)}
SELECT event_id, start0 AS original_start_index, end0 AS original_end_index, ns AS start_index, peak_index, ne AS end_index, {r('peak_value', 'peak_value')}, {r('tol', 'recovery_tolerance')} FROM ag""",
        "j_events": f"{FOUND} SELECT {EVENT_ROWS} FROM ev",
        "s_events": f"{FOUND} SELECT {EVENT_ROWS} FROM ev",
        "j_summary": f"""{FOUND}, z AS (SELECT channel, avg(value) AS sm, stddev_pop(value) AS ss, min(value) AS lo, max(value) AS hi FROM s GROUP BY channel), n AS (SELECT channel, count(*) AS c, count(*) FILTER (WHERE reason IS NULL) AS a FROM ev GROUP BY channel)
SELECT 'events' AS dataset, channel, {r('mu', 'baseline_mean')}, {r('sigma', 'baseline_std')}, {r('sm', 'signal_mean')}, {r('ss', 'signal_std')}, {r('CASE WHEN sigma > 1e-12 THEN abs(sm - mu) / sigma ELSE 0 END', 'drift_std')},
  {r('CASE WHEN sigma > 1e-12 THEN greatest(abs(lo - mu), abs(hi - mu)) / sigma ELSE 0 END', 'excursion_std')}, coalesce(c, 0) AS candidate_events, coalesce(a, 0) AS accepted_events, coalesce(c, 0) - coalesce(a, 0) AS rejected_events FROM bl JOIN z USING (channel) LEFT JOIN n USING (channel)""",
        "a_shape": f"{SHAPE} SELECT {SHAPE_ROWS} FROM sh",
        "a_post_level": f"WITH RECURSIVE {USER_REGIONS}, la AS (SELECT channel, event_id, start_index AS a, end_index AS b FROM rg), {levels('la', 'e.channel')} SELECT event_id, {r('level', 'post_impact_level')}, k AS residual_n_samples, why AS residual_reason FROM pl2",
        "z_stft": f"""WITH w AS ({EMB}), sf0 AS (SELECT channel, time - lag(time) OVER (PARTITION BY event_id ORDER BY pos) AS dt FROM w), sf AS (SELECT channel, 1 / median(dt) FILTER (WHERE dt > 0) AS fs FROM sf0 GROUP BY channel), zn AS (SELECT event_id, channel, pos, value, n, least(n, greatest(32, n // 4)) AS seg FROM w), {STFT}
SELECT w.dataset, w.channel, st.event_id, {r('st_freq', 'stft_peak_frequency_hz')}, {r('st_energy', 'stft_max_energy')}, true AS stft_valid, '' AS stft_reason FROM st JOIN (SELECT DISTINCT dataset, channel, event_id FROM w) w USING (event_id)""",
        "z_multidomain": f"{MULTI} SELECT {MULTI_ROWS} FROM mu3",
        "z_summary": f"""{MULTI} SELECT count(*) AS events, count(*) FILTER (WHERE failure = '') AS ok_events, count(*) FILTER (WHERE failure <> '') AS partial_events, 0::BIGINT AS failed_events, count(*) FILTER (WHERE td_n >= 16) AS valid_stft,
  {r('avg(round(dom, 6))', 'dominant_frequency_mean')}, {r('median(round(dom, 6))', 'dominant_frequency_median')}, {r('stddev_pop(round(dom, 6))', 'dominant_frequency_std')}, {r('avg(round(se, 6))', 'spectral_energy_mean')}, {r('median(round(se, 6))', 'spectral_energy_median')}, {r('avg(round(sent, 6))', 'spectral_entropy_mean')}, {r('median(round(sent, 6))', 'spectral_entropy_median')} FROM mu3""",
        "v_report": f"{REPORT} SELECT metric, {r('value', 'value')} FROM mt",
        "v_per_channel": f"""{FOUND}, n AS (SELECT channel, count(*) AS c, count(*) FILTER (WHERE reason IS NULL) AS a FROM ev GROUP BY channel)
SELECT 'events' AS dataset, channel, coalesce(c, 0) AS candidate_events, coalesce(a, 0) AS accepted_events, coalesce(c, 0) - coalesce(a, 0) AS rejected_events FROM bl LEFT JOIN n USING (channel)""",
        "v_channel_consistency": f"{FOUND}, {consistency(30.0)} SELECT 'events' AS dataset, n_channels, n_events, n_near AS events_with_cross_channel_support, {r('n_near / n_events::DOUBLE', 'fraction_with_cross_channel_support')} FROM cc",
        "v_rejections": f"{FOUND} {REJECTED}",
        "l_methods": best_methods(),
    }
    return found
