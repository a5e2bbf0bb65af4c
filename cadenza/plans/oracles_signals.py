"""SQL for what is sequential or spectral in the library: all 213 features, and the most likely sequence of labels."""

from __future__ import annotations

from ..functions.signal import BANDS, LAGS, MAGNITUDES, PAIR_NAMES, PAIRS, SIGNALS
from ..schema import CLASSES

SAMPLES = 128


def features_sql() -> str:
    """One row for each feature of each segment. Signals are numbered as in SIGNALS; spectra are sums of cosines and sines, and
    autocorrelations are sums of products, so nothing is shared with the kernels."""
    wide = ", ".join(f"max(x) FILTER (c = {c}) AS x{c}" for c in range(6))
    ten = ["x0", "x1", "x2", "x3", "x4", "x5", "sqrt(x0 * x0 + x1 * x1 + x2 * x2)", "sqrt(x3 * x3 + x4 * x4 + x5 * x5)", "along", "sqrt(pow(x0 - along * dx, 2) + pow(x1 - along * dy, 2) + pow(x2 - along * dz, 2))"]
    long = " UNION ALL ".join(f"SELECT vec_id, i, {k} AS k, {e} AS x FROM al" for k, e in enumerate(ten))
    stats = {
        "mean": "avg(x)", "std": "stddev_pop(x)", "min": "min(x)", "max": "max(x)", "median": "quantile_cont(x, 0.5)", "p25": "quantile_cont(x, 0.25)", "p75": "quantile_cont(x, 0.75)",
        "rms": "sqrt(avg(x * x))", "mad": "avg(abs(d))", "skew": "avg(pow(d / sd, 3))", "kurt": "avg(pow(d / sd, 4)) - 3", "zcr": "avg(CAST((d < 0) <> (before < 0) AS INTEGER)) FILTER (before IS NOT NULL)",
        "jerk_mean": "avg(jump)", "jerk_std": "stddev_pop(jump)",
    }
    spectral = {"dom_freq": "arg_max(h, p) * 0.25", "dom_power": "max(p)", "spec_energy": "max(e)", "spec_entropy": "-sum(p / e * ln(p / e + 1e-12))", "spec_centroid": "sum(p * h * 0.25) / max(e)"}
    name = "CASE k " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SIGNALS)) + " END"
    parts = [f"SELECT vec_id, {name} || '_{f}' AS feature, {e} AS value FROM ds GROUP BY vec_id, k" for f, e in stats.items()]
    parts += [f"SELECT vec_id, {name} || '_{f}' AS feature, {e} AS value FROM pw GROUP BY vec_id, k" for f, e in spectral.items()]
    for m in MAGNITUDES:
        k = SIGNALS.index(m)
        parts += [f"SELECT vec_id, '{m}_band{a}-{b}Hz' AS feature, coalesce(sum(p) FILTER (h * 0.25 >= {a} AND h * 0.25 < {b}), 0) AS value FROM pw WHERE k = {k} GROUP BY vec_id" for a, b in BANDS]
        parts += [f"SELECT vec_id, '{m}_ac_peak' AS feature, max(r) AS value FROM ac WHERE k = {k} GROUP BY vec_id", f"SELECT vec_id, '{m}_ac_lag' AS feature, CAST(arg_max(lag, r) AS DOUBLE) AS value FROM ac WHERE k = {k} GROUP BY vec_id"]
    parts += [f"SELECT a.vec_id, 'corr_{n}' AS feature, avg(a.d * b.d) / greatest(stddev_pop(a.x) * stddev_pop(b.x), 1e-8) AS value FROM ds AS a JOIN ds AS b ON a.vec_id = b.vec_id AND a.i = b.i AND a.k = {x} AND b.k = {y} GROUP BY a.vec_id" for n, (x, y) in zip(PAIR_NAMES, PAIRS, strict=True)]
    parts += [f"SELECT vec_id, 'grav_{n}' AS feature, {e} AS value FROM gr" for n, e in (("mag", "size"), ("dir_x", "dx"), ("dir_y", "dy"), ("dir_z", "dz"))]
    return f"""WITH sg AS (SELECT vec_id, i, c, CAST(CAST(CAST(embedding[CAST((i * (c + 1)) % 64 + 1 AS INTEGER)] AS DOUBLE) * (1 + i / {SAMPLES}.0::DOUBLE) + CASE WHEN c = 2 THEN 1 ELSE 0 END AS FLOAT) AS DOUBLE) AS x
    FROM embeddings, range({SAMPLES}) AS t(i), range(6) AS u(c)),
wd AS (SELECT vec_id, i, {wide} FROM sg GROUP BY vec_id, i),
mn AS (SELECT vec_id, avg(x0) AS gx, avg(x1) AS gy, avg(x2) AS gz FROM wd GROUP BY vec_id),
gr AS (SELECT vec_id, sqrt(gx * gx + gy * gy + gz * gz) AS size, gx / greatest(size, 1e-8) AS dx, gy / greatest(size, 1e-8) AS dy, gz / greatest(size, 1e-8) AS dz FROM mn),
al AS (SELECT wd.*, dx, dy, dz, x0 * dx + x1 * dy + x2 * dz AS along FROM wd JOIN gr USING (vec_id)),
ln AS ({long}),
ds AS MATERIALIZED (SELECT *, greatest(sdev, 1e-8) AS sd, lag(d) OVER (PARTITION BY vec_id, k ORDER BY i) AS before, abs(x - lag(x) OVER (PARTITION BY vec_id, k ORDER BY i)) AS jump
    FROM (SELECT ln.*, x - avg(x) OVER (PARTITION BY vec_id, k) AS d, stddev_pop(x) OVER (PARTITION BY vec_id, k) AS sdev FROM ln)),
pr AS (SELECT vec_id, k, h, pow(sum(d * cos(2 * pi() * ((h * i) % {SAMPLES}) / {SAMPLES})), 2) + pow(sum(d * sin(2 * pi() * ((h * i) % {SAMPLES}) / {SAMPLES})), 2) AS p FROM ds, range(1, {SAMPLES // 2 + 1}) AS t(h) GROUP BY vec_id, k, h),
pw AS MATERIALIZED (SELECT *, greatest(sum(p) OVER (PARTITION BY vec_id, k), 1e-12) AS e FROM pr),
ac AS MATERIALIZED (SELECT a.vec_id, a.k, g.lag, sum(a.d * b.d) / greatest(sum(a.d * a.d), 1e-12) AS r FROM ds AS a, range({LAGS.start}, {LAGS.stop}) AS g(lag), ds AS b
    WHERE a.vec_id = b.vec_id AND a.k = b.k AND b.i = (a.i + g.lag) % {SAMPLES} AND a.k IN ({', '.join(str(SIGNALS.index(m)) for m in MAGNITUDES)}) GROUP BY a.vec_id, a.k, g.lag)
SELECT vec_id, feature, round(value, 4) + 0.0 AS value FROM ({' UNION ALL '.join(parts)})"""


def viterbi_sql(base: str) -> str:
    """Forwards, a run's scores are carried from segment to segment with the best state before each; backwards, the best path is read."""
    n = len(CLASSES)
    states = f"range({n})"
    evidence = f"ln(CASE WHEN j = o.y THEN 0.7 ELSE {0.3 / (n - 1)!r} END)"
    reach = f"list_transform({states}, lambda i: f.score[i + 1] + CASE WHEN i = j THEN ln(0.95::DOUBLE) ELSE ln({(1 - 0.95) / (n - 1)!r}::DOUBLE) END)"
    return f"""{base.replace('WITH ', 'WITH RECURSIVE ', 1)},
ob AS (SELECT user_id, run, ord, y, row_number() OVER (PARTITION BY user_id, run ORDER BY t_start, ord) AS n FROM rn),
fw AS (SELECT o.user_id, o.run, o.n, o.ord, o.y, list_transform({states}, lambda j: {evidence} - ln({n}::DOUBLE)) AS score, CAST(NULL AS BIGINT[]) AS back FROM ob AS o WHERE n = 1
    UNION ALL SELECT o.user_id, o.run, o.n, o.ord, o.y, list_transform({states}, lambda j: list_max({reach}) + {evidence}), list_transform({states}, lambda j: CAST(list_position({reach}, list_max({reach})) AS BIGINT) - 1)
    FROM fw AS f JOIN ob AS o ON o.user_id = f.user_id AND o.run = f.run AND o.n = f.n + 1),
bw AS (SELECT user_id, run, n, ord, y, back, CAST(list_position(score, list_max(score)) - 1 AS BIGINT) AS s FROM fw WHERE (user_id, run, n) IN (SELECT user_id, run, max(n) FROM ob GROUP BY user_id, run)
    UNION ALL SELECT f.user_id, f.run, f.n, f.ord, f.y, f.back, b.back[b.s + 1] FROM bw AS b JOIN fw AS f ON f.user_id = b.user_id AND f.run = b.run AND f.n = b.n - 1)
SELECT user_id, ord, y, CAST(s AS INTEGER) AS y_smooth FROM bw"""
