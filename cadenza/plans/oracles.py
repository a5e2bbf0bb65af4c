"""The queries' SQL, on the tables themselves. BASE builds the timeline step by step; each query reads the steps it needs."""

from __future__ import annotations

from .oracles_signals import features_sql, viterbi_sql

BASE = """
WITH seg AS (SELECT user_id, event_id AS ord, value, CAST(floor(epoch(ts)) AS BIGINT) AS win,
    CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS INTEGER) AS y FROM events),
tb AS (SELECT *, CAST(win - min(win) OVER (PARTITION BY user_id) AS DOUBLE) AS t_start, CAST(win - min(win) OVER (PARTITION BY user_id) AS DOUBLE) + 4 AS t_end FROM seg),
rn AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY t_start, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM
    (SELECT *, CASE WHEN t_start - lag(t_start) OVER (PARTITION BY user_id ORDER BY t_start, ord) > 86400 THEN 1 ELSE 0 END AS nw FROM tb)),
nb AS (SELECT *, [coalesce(lag(y, 2) OVER w, first_value(y) OVER f), coalesce(lag(y, 1) OVER w, first_value(y) OVER f), y, coalesce(lead(y, 1) OVER w, last_value(y) OVER f), coalesce(lead(y, 2) OVER w, last_value(y) OVER f)] AS near FROM rn
    WINDOW w AS (PARTITION BY user_id, run ORDER BY t_start, ord), f AS (PARTITION BY user_id, run ORDER BY t_start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ct AS (SELECT *, [len(list_filter(near, lambda x: x = 0)), len(list_filter(near, lambda x: x = 1)), len(list_filter(near, lambda x: x = 2)), len(list_filter(near, lambda x: x = 3)), len(list_filter(near, lambda x: x = 4))] AS times FROM nb),
sm AS (SELECT *, CAST(CASE WHEN times[y + 1] = list_max(times) THEN y ELSE list_position(times, list_max(times)) - 1 END AS INTEGER) AS ys FROM ct),
il AS (SELECT *, sum(nw2) OVER (PARTITION BY user_id ORDER BY t_start, ord ROWS UNBOUNDED PRECEDING) AS island FROM
    (SELECT *, CASE WHEN ys <> lag(ys) OVER u OR t_start - lag(t_end) OVER u > 86400 THEN 1 ELSE 0 END AS nw2 FROM sm WINDOW u AS (PARTITION BY user_id ORDER BY t_start, ord))),
iv AS (SELECT user_id, min(ys) AS label, CASE min(ys) WHEN 0 THEN 'Lying down' WHEN 1 THEN 'Sitting' WHEN 2 THEN 'Walking' WHEN 3 THEN 'Running' ELSE 'Bicycling' END AS activity, min(t_start) AS start_s, max(t_end) AS end_s,
    max(t_end) - min(t_start) AS duration_s, CAST(count(*) * 4.0 AS DOUBLE) AS observed_s, count(*) AS n_segments FROM il GROUP BY user_id, island),
rl AS (SELECT *, sum(nw2) OVER (PARTITION BY user_id ORDER BY t_start, ord ROWS UNBOUNDED PRECEDING) AS island FROM
    (SELECT *, CASE WHEN y <> lag(y) OVER u OR t_start - lag(t_end) OVER u > 86400 THEN 1 ELSE 0 END AS nw2 FROM tb WINDOW u AS (PARTITION BY user_id ORDER BY t_start, ord))),
rw AS (SELECT user_id, min(y) AS label, CASE min(y) WHEN 0 THEN 'Lying down' WHEN 1 THEN 'Sitting' WHEN 2 THEN 'Walking' WHEN 3 THEN 'Running' ELSE 'Bicycling' END AS activity, min(t_start) AS start_s, max(t_end) AS end_s,
    max(t_end) - min(t_start) AS duration_s, count(*) AS n_segments FROM rl GROUP BY user_id, island),
tt AS (SELECT user_id, activity, sum(duration_s) AS total_s, sum(observed_s) AS observed_s, count(*) AS n_intervals, min(start_s) AS first_start FROM iv GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, activity ORDER BY duration_s DESC, start_s) AS rank FROM iv),
cs AS (SELECT user_id, activity, string_agg(CAST(CAST(start_s AS BIGINT) AS VARCHAR) || ' to ' || CAST(CAST(end_s AS BIGINT) AS VARCHAR), ', ' ORDER BY rank) || ' (seconds from start)' AS shown FROM rk WHERE rank <= 3 GROUP BY ALL),
us AS (SELECT DISTINCT user_id FROM iv),
md AS (SELECT user_id, arg_max(activity, total_s * 1e7 - first_start) AS "leading", sum(CASE WHEN activity IN ('Lying down', 'Sitting') THEN total_s ELSE 0 END) AS static_s, sum(CASE WHEN activity NOT IN ('Lying down', 'Sitting') THEN total_s ELSE 0 END) AS dynamic_s FROM tt GROUP BY user_id)
"""
NUMBER = "CAST(CAST({0} AS BIGINT) AS VARCHAR)"
#: The parts of the per-activity questions, and the activities they name.
SEEN = "(VALUES ('lying down', 'Lying down'), ('sitting', 'Sitting'), ('walking', 'Walking'), ('running', 'Running'), ('bicycling', 'Bicycling'), ('standing in place', 'Standing in place')) AS a(part, name)"
PROBES = "probes AS (SELECT o_orderkey AS id, o_custkey % 150 AS user_id, CAST((o_orderkey * 7919) % 2500000 AS DOUBLE) AS time_s FROM orders)"


def asked(text: str, answer: str, event: str, shown: str, explanation: str = "'N/A'", more: str = "") -> str:
    return f"""{BASE} SELECT us.user_id, {text} AS query, {answer} AS answer, {event} AS activity_event, {shown} AS timestamps_text, {explanation} AS explanation
FROM us CROSS JOIN {SEEN} LEFT JOIN tt ON tt.user_id = us.user_id AND tt.activity = a.name LEFT JOIN cs ON cs.user_id = us.user_id AND cs.activity = a.name {more}"""


def moment(query: str, answer: str, event: str, shown: str, explanation: str) -> str:
    return f"""{BASE}, pr AS (SELECT us.user_id, t.t FROM us CROSS JOIN (VALUES (0), (500000), (1000000)) AS t(t)),
hit AS (SELECT pr.user_id, pr.t, arg_min(iv.activity, iv.start_s) AS activity, min(iv.start_s) AS start_s, arg_min(iv.end_s, iv.start_s) AS end_s FROM pr JOIN iv ON iv.user_id = pr.user_id AND pr.t BETWEEN iv.start_s AND iv.end_s GROUP BY ALL)
SELECT pr.user_id, {query} AS query, {answer} AS answer, {event} AS activity_event, {shown} AS timestamps_text, {explanation} AS explanation FROM pr LEFT JOIN hit ON hit.user_id = pr.user_id AND hit.t = pr.t"""


LEAD = 'md."leading"'
SPAN = "coalesce(shown, 'N/A')"
HIT_SPAN = f"{NUMBER.format('hit.start_s')} || ' to ' || {NUMBER.format('hit.end_s')} || ' (seconds from start)'"
LONGEST = f"{NUMBER.format('duration_s')} || ' s (' || {NUMBER.format('start_s')} || ' to ' || {NUMBER.format('end_s')} || ' s)'"
VEC = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT vec_id, label, CAST(i AS BIGINT) AS i, v[i + 1] AS x FROM v, range(64) AS r(i))"
DFT = VEC + """, m AS (SELECT vec_id, label, i, x - avg(x) OVER (PARTITION BY vec_id) AS d FROM e),
sp AS (SELECT vec_id, label, k, pow(sum(d * cos(2 * pi() * ((k * i) % 64) / 64)), 2) + pow(sum(d * sin(2 * pi() * ((k * i) % 64) / 64)), 2) AS power FROM m, range(1, 33) AS r(k) GROUP BY ALL)"""
QA = BASE + """, rt AS (SELECT user_id, activity, sum(duration_s) AS total_s, count(*) AS n FROM rw GROUP BY ALL),
rs AS (SELECT user_id, activity, list([start_s, end_s] ORDER BY duration_s DESC, start_s)[1:3] AS spans FROM rw GROUP BY ALL),
ps AS (SELECT user_id, activity, list([start_s, end_s] ORDER BY duration_s DESC, start_s)[1:3] AS spans FROM iv GROUP BY ALL),
pr AS (SELECT ps.user_id, ps.activity, p.pos, p.s[1] AS a0, p.s[2] AS a1 FROM ps, (SELECT user_id AS u, activity AS a, generate_subscripts(spans, 1) AS pos, unnest(spans) AS s FROM ps) AS p WHERE p.u = ps.user_id AND p.a = ps.activity),
ou AS (SELECT pr.user_id, pr.activity, pr.pos, max(CASE WHEN greatest(a1, t[2]) - least(a0, t[1]) > 0 THEN greatest(0, least(a1, t[2]) - greatest(a0, t[1])) / (greatest(a1, t[2]) - least(a0, t[1])) ELSE 0 END) AS iou
    FROM pr JOIN (SELECT user_id, activity, unnest(spans) AS t FROM rs) AS r ON r.user_id = pr.user_id AND r.activity = pr.activity GROUP BY ALL),
io AS (SELECT user_id, activity, avg(iou) AS iou FROM ou GROUP BY ALL),
qa AS (SELECT rt.user_id, rt.activity, rt.total_s, rt.n, coalesce(tt.total_s, 0) AS p_s, coalesce(tt.n_intervals, 0) AS p_n, tt.total_s IS NULL AS missing, io.iou FROM rt LEFT JOIN tt ON tt.user_id = rt.user_id AND tt.activity = rt.activity LEFT JOIN io ON io.user_id = rt.user_id AND io.activity = rt.activity),
sc AS (SELECT 'duration' AS type, abs(p_s - total_s) AS err, total_s AS num, abs(p_s - total_s) <= 0.1 * total_s AS ok FROM qa UNION ALL SELECT 'count', abs(p_n - n), n, abs(p_n - n) <= 1 FROM qa UNION ALL SELECT 'grounding', NULL, NULL, NOT missing AND coalesce(iou >= 0.5, false) FROM qa)"""
CM = BASE + ", cm AS (SELECT y AS t, ys AS p, count(*) AS n FROM sm GROUP BY ALL), tr AS (SELECT t AS y, sum(n) AS s, sum(CASE WHEN t = p THEN n ELSE 0 END) AS tp FROM cm GROUP BY t), pd AS (SELECT p AS y, sum(n) AS q FROM cm GROUP BY p)"
FILL = BASE + """, av AS (SELECT y AS label, user_id, count(*) AS n FROM seg GROUP BY ALL),
lv AS (SELECT av.label, max(l.l) AS level FROM (SELECT DISTINCT label FROM av) AS av, range(0, 1501) AS l(l) WHERE (SELECT sum(least(a.n, l.l)) FROM av AS a WHERE a.label = av.label) <= 1500 GROUP BY av.label),
bs AS (SELECT av.*, least(n, level) AS base, n > level AS more FROM av JOIN lv USING (label)),
wf AS (SELECT label, user_id, n, CAST(base + CASE WHEN more AND sum(CASE WHEN more THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY user_id) <= 1500 - sum(base) OVER (PARTITION BY label) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM bs)"""
#: Verb stems of each activity, in the order in which they are looked for.
STEMS = (("Walking", "walk|stroll"), ("Running", "run|jog|ran"), ("Sitting", "sit|sat|seated"), ("Lying down", "lie |lay |lying|laid|rest"), ("Bicycling", "cycl|bike|biking|bicycl|pedal"), ("Standing in place", "stand|stood"))
FOLDS = """WITH u AS (SELECT DISTINCT user_id FROM events), fs AS (SELECT f.f AS fold, user_id, CASE WHEN user_id % 5 = f.f THEN 'test' WHEN user_id % 5 = (f.f + 1) % 5 THEN 'val' ELSE 'train' END AS part FROM u, (VALUES (0), (1), (2), (3), (4)) AS f(f)),
pu AS (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS w FROM events GROUP BY ALL),
pt AS (SELECT fold, part, count(*) AS users, CAST(sum(n) AS BIGINT) AS segments, CAST(sum(w) AS BIGINT) AS watched FROM fs JOIN pu USING (user_id) GROUP BY ALL)"""


def interpolated(left: str, right: str, out: str) -> str:
    return f"""SELECT l.user_id, {out}, round(CASE WHEN b.t = l.t THEN b.value WHEN a.t IS NOT NULL AND b.t IS NOT NULL THEN b.value + (a.value - b.value) * ((l.t - b.t) / (a.t - b.t)) END, 5) AS value
FROM {left} AS l ASOF LEFT JOIN {right} AS b ON b.user_id = l.user_id AND b.t <= l.t ASOF LEFT JOIN {right} AS a ON a.user_id = l.user_id AND a.t >= l.t"""


ORACLES: dict[str, str] = {
    "seg_time_base": f"{BASE} SELECT user_id, ord, y, t_start, t_end FROM tb",
    "smooth_runs": f"{BASE} SELECT user_id, ord, run FROM rn",
    "mode_smooth_k5": f"{BASE} SELECT user_id, ord, ys AS y_smooth FROM sm",
    "interval_merge": f"{BASE} SELECT * FROM iv",
    "interval_min_duration": f"{BASE} SELECT * FROM iv WHERE duration_s >= 3600",
    "totals_counts": f"{BASE} SELECT user_id, activity, total_s, observed_s, n_intervals, first_start FROM tt",
    "dominant_activity": f"{BASE} SELECT md.user_id, {LEAD}, (SELECT arg_max(activity, total_s * 1e7 - first_start) FROM tt WHERE tt.user_id = md.user_id AND activity IN ('Lying down', 'Sitting')) AS leading_static FROM md",
    "activity_balance": f"{BASE} SELECT user_id, static_s, dynamic_s, static_s >= dynamic_s AS at_rest FROM md",
    "transitions": f"{BASE} SELECT * FROM (SELECT user_id, activity AS from_activity, lead(activity) OVER w AS to_activity, lead(start_s) OVER w AS at_s FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY start_s)) WHERE at_s IS NOT NULL",
    "transition_matrix": f"{BASE} SELECT from_activity, to_activity, count(*) AS n FROM (SELECT activity AS from_activity, lead(activity) OVER (PARTITION BY user_id ORDER BY start_s) AS to_activity FROM iv) WHERE to_activity IS NOT NULL GROUP BY ALL",
    "rescale_runs": "SELECT DISTINCT user_id, user_id % 10 <> 0 AS unchanged FROM events",
    "npz_round_trip": "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings",
    "augment_segments": "SELECT vec_id, CAST(768 AS INTEGER) AS n, true AS gravity_kept, true AS changed FROM embeddings",
    "degrade_segments": """SELECT vec_id, round((4 * list_sum(list_transform(range(32), lambda j: CAST(embedding[CAST(2 * j + 1 AS INTEGER)] AS DOUBLE))) - CAST(embedding[1] AS DOUBLE) / 2 + CAST(embedding[63] AS DOUBLE) / 2) / 128, 4) + 0.0 AS mean,
    true AS rate_same, true AS loss_same FROM embeddings""",
    "timeline_evidence": f"""{BASE}, sg AS (SELECT vec_id, i, c, CAST(CAST(CAST(embedding[CAST((i * (c + 1)) % 64 + 1 AS INTEGER)] AS DOUBLE) + CASE WHEN c = 2 THEN 1 ELSE 0 END AS FLOAT) AS DOUBLE) AS x FROM embeddings, range(128) AS t(i), range(6) AS u(c) WHERE vec_id < 500),
wd AS (SELECT vec_id, i, {", ".join(f"max(x) FILTER (c = {c}) AS x{c}" for c in range(6))} FROM sg GROUP BY vec_id, i),
mg AS (SELECT *, sqrt(x0 * x0 + x1 * x1 + x2 * x2) AS am, sqrt(x3 * x3 + x4 * x4 + x5 * x5) AS gm, pow(x0 - avg(x0) OVER v, 2) + pow(x1 - avg(x1) OVER v, 2) + pow(x2 - avg(x2) OVER v, 2) AS dy FROM wd WINDOW v AS (PARTITION BY vec_id)),
vs AS (SELECT vec_id, sum(am) AS a1, sum(am * am) AS a2, sum(gm) AS g1, sum(gm * gm) AS g2, sum(dy) AS dy, sum(x0) AS s0, sum(x1) AS s1, sum(x2) AS s2 FROM mg GROUP BY vec_id),
ev AS (SELECT user_id, min(ys) AS label, min(t_start) AS start_s, count(*) * 128.0::DOUBLE AS m, sum(a1) AS a1, sum(a2) AS a2, sum(g1) AS g1, sum(g2) AS g2, sum(dy) AS dy, sum(s0) AS s0, sum(s1) AS s1, sum(s2) AS s2 FROM il JOIN vs ON vec_id = ord % 500 GROUP BY user_id, island)
SELECT user_id, label, start_s, round(a1 / m, 4) AS acc_mag_mean, round(sqrt(greatest(0, a2 / m - pow(a1 / m, 2))), 4) AS acc_mag_std, round(sqrt(dy / (3 * m)), 4) AS dynamic_acc_std, round(g1 / m, 4) AS gyro_mag_mean, round(sqrt(greatest(0, g2 / m - pow(g1 / m, 2))), 4) AS gyro_mag_std, round(sqrt(s0 * s0 + s1 * s1 + s2 * s2) / m, 4) AS gravity_mag_g FROM ev""",
    "coalesce_intervals": f"""{BASE}, h AS (SELECT *, sum(nw2) OVER (PARTITION BY user_id ORDER BY t_start, ord ROWS UNBOUNDED PRECEDING) AS island FROM
    (SELECT *, CASE WHEN y <> lag(y) OVER u OR t_start - lag(t_end) OVER u > 3600 THEN 1 ELSE 0 END AS nw2 FROM tb WINDOW u AS (PARTITION BY user_id ORDER BY t_start, ord))),
hi AS (SELECT user_id, min(y) AS label, min(t_start) AS start_s, max(t_end) AS end_s, count(*) AS n_segments FROM h GROUP BY user_id, island),
hj AS (SELECT *, sum(nw3) OVER (PARTITION BY user_id ORDER BY start_s ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN label <> lag(label) OVER w OR start_s - lag(end_s) OVER w > 86400 THEN 1 ELSE 0 END AS nw3 FROM hi WINDOW w AS (PARTITION BY user_id ORDER BY start_s)))
SELECT user_id, min(label) AS label, CASE min(label) WHEN 0 THEN 'Lying down' WHEN 1 THEN 'Sitting' WHEN 2 THEN 'Walking' WHEN 3 THEN 'Running' ELSE 'Bicycling' END AS activity, min(start_s) AS start_s, max(end_s) AS end_s, max(end_s) - min(start_s) AS duration_s, CAST(sum(n_segments) * 4.0 AS DOUBLE) AS observed_s, CAST(sum(n_segments) AS BIGINT) AS n_segments FROM hj GROUP BY user_id, island""",
    "recording_span": f"{BASE} SELECT user_id, max(t_end) - min(t_start) AS span_s, count(*) AS n_segments FROM tb GROUP BY user_id",
    "top3_spans": f"{BASE} SELECT user_id, activity, CAST(rank AS INTEGER) AS rank, start_s, end_s, duration_s FROM rk WHERE rank <= 3",
    "onset": f"{BASE} SELECT user_id, activity, min(start_s) AS onset_s, arg_min(end_s, start_s) AS end_s FROM iv GROUP BY ALL",
    "longest_interval": f"{BASE} SELECT user_id, activity, start_s, end_s FROM (SELECT *, row_number() OVER (PARTITION BY user_id, activity ORDER BY duration_s DESC, start_s) AS r FROM rw) WHERE r = 1",
    "point_lookup": f"{BASE}, {PROBES}, hit AS (SELECT p.id, arg_min(iv.activity, iv.start_s) AS activity, min(iv.start_s) AS start_s, arg_min(iv.end_s, iv.start_s) AS end_s FROM probes AS p JOIN iv ON iv.user_id = p.user_id AND p.time_s BETWEEN iv.start_s AND iv.end_s GROUP BY p.id) SELECT p.id, p.user_id, p.time_s, h.activity, h.start_s, h.end_s FROM probes AS p LEFT JOIN hit AS h USING (id)",
    "nearest_lookup": f"{BASE}, {PROBES} SELECT id, user_id, time_s, activity FROM (SELECT p.id, p.user_id, p.time_s, iv.activity, row_number() OVER (PARTITION BY p.id ORDER BY CASE WHEN p.time_s BETWEEN iv.start_s AND iv.end_s THEN -1 ELSE least(abs(iv.start_s - p.time_s), abs(iv.end_s - p.time_s)) END, iv.start_s) AS r FROM probes AS p JOIN iv ON iv.user_id = p.user_id) WHERE r = 1",
    "containment_join": f"{BASE} SELECT iv.user_id, iv.start_s, count(*) AS n, avg(tb.y) AS mean_y FROM iv JOIN tb ON tb.user_id = iv.user_id AND tb.t_start >= iv.start_s AND tb.t_end <= iv.end_s WHERE n_segments > 1 GROUP BY ALL",
    "answer_duration": asked("'How long was the user ' || part || '?'", f"{NUMBER.format('coalesce(total_s, 0)')} || ' seconds'", "name", SPAN),
    "answer_count": asked("'How many times was the user ' || part || '?'", "CAST(coalesce(n_intervals, 0) AS VARCHAR)", "name", SPAN),
    "answer_comparison": f"""{BASE}, c AS (SELECT us.user_id, p.q, p.a, p.b, coalesce(x.total_s, 0) AS ta, coalesce(z.total_s, 0) AS tz FROM us CROSS JOIN (VALUES ('sitting or walking', 'Sitting', 'Walking'), ('running or bicycling', 'Running', 'Bicycling'), ('lying down or standing in place', 'Lying down', 'Standing in place')) AS p(q, a, b)
LEFT JOIN tt AS x ON x.user_id = us.user_id AND x.activity = p.a LEFT JOIN tt AS z ON z.user_id = us.user_id AND z.activity = p.b)
SELECT user_id, 'Did the user spend more time ' || q || '?' AS query, CASE WHEN ta >= tz THEN a ELSE b END AS answer, a || ', ' || b AS activity_event, a || ' = ' || {NUMBER.format('ta')} || ' seconds total, ' || b || ' = ' || {NUMBER.format('tz')} || ' seconds total' AS timestamps_text, 'N/A' AS explanation FROM c""",
    "answer_grounding": asked("'When did the user first begin ' || part || '?'", f"CASE WHEN total_s IS NULL THEN 'No' ELSE 'Yes, ' || part || ' began at ' || {NUMBER.format('first_start')} || ' seconds' END", "CASE WHEN total_s IS NULL THEN name ELSE 'Onset of ' || part END", f"coalesce({NUMBER.format('o.start_s')} || ' to ' || {NUMBER.format('o.end_s')} || ' (seconds from start)', 'N/A')", more="LEFT JOIN iv AS o ON o.user_id = tt.user_id AND o.activity = tt.activity AND o.start_s = tt.first_start"),
    "answer_verification": asked("'Was the user ' || part || '?'", "CASE WHEN total_s IS NULL THEN 'No' ELSE 'Yes' END", "name", SPAN, "CASE WHEN total_s IS NULL THEN 'No ' || part || ' was detected anywhere in the recording.' ELSE 'N/A' END"),
    "answer_verification_at": moment("'Was the user walking at ' || CAST(pr.t AS VARCHAR) || ' seconds?'", "CASE WHEN hit.activity = 'Walking' THEN 'Yes' ELSE 'No' END", "'Walking'", f"CASE WHEN hit.activity = 'Walking' THEN {HIT_SPAN} ELSE 'N/A' END", "CASE WHEN hit.activity = 'Walking' THEN 'N/A' WHEN hit.activity IS NULL THEN 'No activity was detected at ' || CAST(pr.t AS VARCHAR) || ' s.' ELSE 'At ' || CAST(pr.t AS VARCHAR) || ' s the detected activity is ' || lower(hit.activity) || ', not walking.' END"),
    "answer_identification": moment("'What activity is the user doing at ' || CAST(pr.t AS VARCHAR) || ' seconds?'", "coalesce(hit.activity, 'N/A')", "coalesce(hit.activity, 'N/A')", f"coalesce({HIT_SPAN}, 'N/A')", "'N/A'"),
    "answer_identification_overall": f"{BASE} SELECT md.user_id, 'What activity is the user doing?' AS query, {LEAD} AS answer, {LEAD} AS activity_event, shown AS timestamps_text, 'N/A' AS explanation FROM md JOIN cs ON cs.user_id = md.user_id AND cs.activity = {LEAD}",
    "answer_open_world": f"{BASE} SELECT user_id, 'Was the user mostly at rest or mostly physically active?' AS query, CASE WHEN static_s >= dynamic_s THEN 'Mostly at rest' ELSE 'Mostly physically active' END AS answer, 'Overall activity level' AS activity_event, 'N/A' AS timestamps_text, 'Static activities (lying, sitting, standing in place) account for ' || {NUMBER.format('static_s')} || ' s against ' || {NUMBER.format('dynamic_s')} || ' s of movement.' AS explanation FROM md",
    "answer_prolonged": f"""{BASE}, lg AS (SELECT user_id, activity, count(*) AS n_long, string_agg(CASE WHEN rank <= 3 THEN {NUMBER.format('start_s')} || ' to ' || {NUMBER.format('end_s')} END, ', ' ORDER BY rank) || ' (seconds from start)' AS long FROM rk WHERE duration_s >= 86400 GROUP BY ALL), r1 AS (SELECT * FROM rk WHERE rank = 1)
SELECT us.user_id, 'Was there a prolonged period of ' || part || '?' AS query, CASE WHEN n_long > 0 THEN 'Yes' ELSE 'No' END AS answer, 'Prolonged ' || part AS activity_event, CASE WHEN n_long > 0 THEN long WHEN r1.user_id IS NOT NULL THEN {NUMBER.format('start_s')} || ' to ' || {NUMBER.format('end_s')} || ' (seconds from start)' ELSE 'N/A' END AS timestamps_text,
CASE WHEN n_long > 0 THEN 'A continuous ' || part || ' interval of ' || {LONGEST} || CASE WHEN duration_s <= 86400 THEN ' reaches' ELSE ' exceeds' END || ' the 86400 s (1440 min) threshold for a prolonged period.' || CASE WHEN n_long > 1 THEN ' ' || CAST(n_long AS VARCHAR) || ' such intervals were found in total.' ELSE '' END
WHEN r1.user_id IS NOT NULL THEN 'The longest continuous ' || part || ' interval lasts ' || {LONGEST} || ', short of the 86400 s (1440 min) needed to count as prolonged.' ELSE 'No ' || part || ' interval was detected in the recording.' END AS explanation
FROM us CROSS JOIN {SEEN} LEFT JOIN lg ON lg.user_id = us.user_id AND lg.activity = a.name LEFT JOIN r1 ON r1.user_id = us.user_id AND r1.activity = a.name""",
    "answer_wheeled": f"""{BASE} SELECT us.user_id, 'Was the user using a wheeled or pedal-based mode of movement?' AS query, CASE WHEN tt.user_id IS NULL THEN 'No' ELSE 'Yes' END AS answer, CASE WHEN tt.user_id IS NULL THEN 'No wheeled or pedal-based movement' ELSE 'Unknown outdoor physical activity, consistent with cycling' END AS activity_event, {SPAN} AS timestamps_text,
CASE WHEN tt.user_id IS NULL THEN 'No segment in the recording was classified as bicycling.' ELSE CAST(n_intervals AS VARCHAR) || ' bicycling episode' || CASE WHEN n_intervals > 1 THEN 's' ELSE '' END || ' totalling ' || {NUMBER.format('total_s')} || ' s were detected; the longest runs ' || {LONGEST} || ', consistent with sustained pedal-driven movement.' END AS explanation
FROM us LEFT JOIN tt ON tt.user_id = us.user_id AND tt.activity = 'Bicycling' LEFT JOIN cs ON cs.user_id = us.user_id AND cs.activity = 'Bicycling' LEFT JOIN rk ON rk.user_id = us.user_id AND rk.activity = 'Bicycling' AND rk.rank = 1""",
    "intent_rules": """SELECT conv_id, turn, CASE WHEN contains(s, ' or ') AND (contains(s, 'more') OR contains(s, 'longer') OR contains(s, 'spend')) THEN 'comparison' WHEN starts_with(s, 'how many') OR starts_with(s, 'how often') OR contains(s, 'times') THEN 'count'
WHEN starts_with(s, 'how long') OR contains(s, 'total time') OR contains(s, 'how much time') THEN 'duration' WHEN contains(s, 'when') OR contains(s, 'begin') OR contains(s, 'start') OR contains(s, 'onset') THEN 'grounding'
WHEN starts_with(s, 'is ') OR starts_with(s, 'was ') OR starts_with(s, 'did ') OR starts_with(s, 'does ') THEN 'verification' WHEN contains(s, 'what activity') OR contains(s, 'what is') OR contains(s, 'doing') THEN 'identification' ELSE 'unsupported' END AS intent FROM (SELECT *, lower(coalesce(text, '')) AS s FROM conversations)""",
    "activity_recovery": f"""SELECT doc_id, array_to_string(CASE WHEN len(named) > 0 THEN named ELSE list_filter(stems, lambda c: c IS NOT NULL) END, ',') AS activities FROM (SELECT doc_id,
list_filter(['Lying down', 'Sitting', 'Walking', 'Running', 'Bicycling', 'Standing in place', 'Standing and moving'], lambda c: contains(s, lower(c))) AS named,
[{', '.join(f"CASE WHEN regexp_matches(s, '(?:^|[^{chr(92)}pL{chr(92)}pN_])(?:{stems})') THEN '{name}' END" for name, stems in STEMS)}] AS stems FROM (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents))""",
    "first_number": r"""SELECT conv_id, turn, TRY_CAST(nullif(regexp_extract(text, '-?\d+(?:\.\d+)?'), '') AS DOUBLE) AS number, TRY_CAST(nullif(regexp_extract(lower(text), '(\d+(?:\.\d+)?)\s*second', 1), '') AS DOUBLE) AS seconds FROM conversations""",
    "yes_no_norm": "SELECT conv_id, turn, CASE WHEN starts_with(s, 'yes') OR starts_with(s, 'likely yes') THEN 'yes' WHEN starts_with(s, 'no') THEN 'no' ELSE rtrim(s, '.') END AS yn, rtrim(lower(trim(role)), '.') AS role_norm FROM (SELECT *, lower(trim(text)) AS s FROM conversations)",
    "confusion_matrix": f"{CM} SELECT t AS y_true, p AS y_pred, n FROM cm",
    "confusion_shares": f"{CM} SELECT t AS y_true, p AS y_pred, round(n / sum(n) OVER (PARTITION BY t), 6) AS share FROM cm",
    "class_metrics": f"""{CM}, k AS (SELECT CAST(r.i AS INTEGER) AS y, coalesce(s, 0) AS s, coalesce(tp, 0) AS tp, coalesce(q, 0) AS q, (SELECT sum(n) FROM cm) AS n FROM range(7) AS r(i) LEFT JOIN tr ON tr.y = r.i LEFT JOIN pd ON pd.y = r.i)
SELECT y, CAST(s AS BIGINT) AS support, round(CASE WHEN s > 0 THEN tp / s END, 6) AS recall, round(CASE WHEN q > 0 THEN tp / q ELSE 0 END, 6) AS precision, round(CASE WHEN s > 0 THEN 2 * tp / (s + q) END, 6) AS f1, round((n - s - q + tp) / nullif(n - s, 0), 6) AS specificity, round((CASE WHEN s > 0 THEN tp / s END + (n - s - q + tp) / nullif(n - s, 0)) / 2, 6) AS balanced_accuracy, round((n - s - q + 2 * tp) / n, 6) AS accuracy FROM k""",
    "overall_metrics": f"""{CM}, k AS (SELECT coalesce(s, 0) AS s, coalesce(tp, 0) AS tp, coalesce(q, 0) AS q FROM tr FULL JOIN pd ON pd.y = tr.y), a AS (SELECT sum(tp) / sum(s) AS acc, sum(CAST(s AS DOUBLE) * q) / (sum(s) * CAST(sum(s) AS DOUBLE)) AS ch, avg(CASE WHEN s > 0 THEN 2 * tp / (s + q) END) AS f, avg(CASE WHEN s > 0 THEN tp / s END) AS b FROM k)
SELECT round(acc, 6) AS accuracy, round(f, 6) AS macro_f1, round(b, 6) AS balanced_accuracy, round((acc - ch) / (1 - ch), 6) AS kappa FROM a""",
    "interval_iou": f"{QA} SELECT user_id || '/' || activity || '/grounding' AS id, round(iou, 6) AS iou FROM qa",
    "qa_score": f"{QA}, pt AS (SELECT type, count(*) AS n, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS a FROM sc GROUP BY type) SELECT type, n, round(a, 6) AS accuracy, CAST(NULL AS DOUBLE) AS macro, CAST(NULL AS DOUBLE) AS micro FROM pt UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), NULL, round(avg(a), 6), round(sum(n * a) / sum(n), 6) FROM pt",
    "qa_errors": f"{QA} SELECT type, count(*) AS n, round(avg(err), 4) AS mae, round(avg(CASE WHEN type = 'duration' THEN err / nullif(num, 0) END), 4) AS mape, round(quantile_cont(err, 0.5), 4) AS median_abs_err FROM sc WHERE err IS NOT NULL GROUP BY type",
    "strictness_curve": f"{QA} SELECT g.g AS tolerance, count(*) AS n, round(avg(CASE WHEN err <= g.g * num THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM sc, (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) AS g(g) WHERE type = 'duration' GROUP BY ALL",
    "class_distribution": f"{BASE} SELECT y AS label, count(*) AS rows, count(DISTINCT (user_id, win)) AS windows, count(DISTINCT user_id) AS users FROM seg GROUP BY y",
    "natural_prior": f"{BASE} SELECT y, round(count(*) / sum(count(*)) OVER (), 6) AS prior FROM seg GROUP BY y",
    "water_fill_quota": f"{FILL} SELECT * FROM wf",
    "spread_pick": f"""{FILL}, r AS (SELECT s.user_id, s.y AS label, s.ord, row_number() OVER (PARTITION BY s.y, s.user_id ORDER BY s.win, s.ord) - 1 AS i, wf.n FROM seg AS s JOIN wf ON wf.label = s.y AND wf.user_id = s.user_id),
pk AS (SELECT label, user_id, CAST(CASE WHEN quota = 1 THEN 0 ELSE round_even(k.k * (n - 1) / (quota - 1), 0) END AS BIGINT) AS i FROM wf, range(0, 1501) AS k(k) WHERE k.k < quota)
SELECT r.user_id, r.label, r.ord FROM r JOIN pk ON pk.label = r.label AND pk.user_id = r.user_id AND pk.i = r.i""",
    "training_set": "SELECT CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS INTEGER) AS label, least(count(*), 1000) AS n FROM events GROUP BY ALL",
    "split_cover": f"{FOLDS} SELECT fold, part, users, segments, watched, round(100 * users / sum(users) OVER (PARTITION BY fold), 1) AS user_share, round(100 * segments / sum(segments) OVER (PARTITION BY fold), 1) AS segment_share FROM pt",
    "split_faults": "SELECT 'none' AS fault, CAST(0 AS BIGINT) AS n WHERE false",
    "user_set_ops": "SELECT CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN 'both' ELSE 'customer only' END AS kind, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL",
    "segment_slide": VEC + " SELECT vec_id, CAST(s.s AS INTEGER) AS seg_start, round(list_sum(v[s.s + 1 : s.s + 16]) / 16, 5) AS mean FROM v, range(0, 49, 8) AS s(s)",
    "dist_features": VEC + " SELECT vec_id, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, round(min(x), 5) AS low, round(max(x), 5) AS high, round(quantile_cont(x, 0.25), 5) AS p25, round(quantile_cont(x, 0.5), 5) AS median, round(quantile_cont(x, 0.75), 5) AS p75, round(sqrt(avg(x * x)), 5) AS rms FROM e GROUP BY vec_id",
    "shape_features": VEC + ", m AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY vec_id) AS d FROM e) SELECT vec_id, round(avg(d * d * d) / pow(greatest(sqrt(avg(d * d)), 1e-8), 3), 5) AS skew, round(avg(d * d * d * d) / pow(greatest(sqrt(avg(d * d)), 1e-8), 4) - 3, 5) AS kurt, round(avg(abs(d)), 5) AS mad FROM m GROUP BY vec_id",
    "zcr_jerk": VEC + ", m AS (SELECT vec_id, i, x, avg(x) OVER (PARTITION BY vec_id) AS mean, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM e) SELECT vec_id, round(avg(CASE WHEN (x < mean) <> (p < mean) THEN 1.0 ELSE 0.0 END), 5) AS zcr, round(avg(abs(x - p)), 5) AS jerk_mean, round(stddev_pop(abs(x - p)), 5) AS jerk_std FROM m WHERE p IS NOT NULL GROUP BY vec_id",
    "corr_features": VEC + ", p AS (SELECT a.vec_id, a.x AS a, b.x AS b FROM e AS a JOIN e AS b ON b.vec_id = a.vec_id AND b.i = a.i + 1 WHERE a.i % 2 = 0) SELECT vec_id, round(covar_pop(a, b) / greatest(stddev_pop(a) * stddev_pop(b), 1e-8), 5) AS corr FROM p GROUP BY vec_id",
    "spectral_features": DFT + " SELECT vec_id, CAST(arg_max(k, round(power, 8) - k * 1e-12) * 0.5 AS DOUBLE) AS dom_freq, round(sum(power), 4) AS energy, round(sum(power * k * 0.5) / greatest(sum(power), 1e-12), 4) AS centroid FROM sp GROUP BY vec_id",
    "band_energy": DFT + " SELECT vec_id, round(sum(CASE WHEN k * 0.5 >= 0.5 AND k * 0.5 < 3 THEN power ELSE 0 END), 4) AS b1, round(sum(CASE WHEN k * 0.5 >= 3 AND k * 0.5 < 8 THEN power ELSE 0 END), 4) AS b2, round(sum(CASE WHEN k * 0.5 >= 8 AND k * 0.5 < 16 THEN power ELSE 0 END), 4) AS b3 FROM sp GROUP BY vec_id",
    "autocorr_peak": DFT + """, ac AS (SELECT a.vec_id, l.l, sum(a.d * b.d) AS r FROM m AS a, range(8, 32) AS l(l), m AS b WHERE b.vec_id = a.vec_id AND b.i = (a.i + l.l) % 64 GROUP BY ALL), z AS (SELECT vec_id, greatest(sum(d * d), 1e-12) AS r0 FROM m GROUP BY vec_id)
SELECT vec_id, peak, CAST(lag AS INTEGER) AS lag FROM (SELECT ac.vec_id, round(r / r0, 6) AS peak, l AS lag, row_number() OVER (PARTITION BY ac.vec_id ORDER BY round(r / r0, 6) DESC, l) AS n FROM ac JOIN z ON z.vec_id = ac.vec_id) WHERE n = 1""",
    "gait_frequency": DFT + ", g AS (SELECT label, k, avg(sqrt(power)) AS a FROM sp WHERE k BETWEEN 1 AND 8 GROUP BY ALL) SELECT label, CAST(arg_max(k, a) * 0.5 AS DOUBLE) AS step_freq_hz, round(max(a) / sum(a), 5) AS share FROM g GROUP BY label",
    "interp_asof": f"{BASE}, l AS (SELECT user_id, ord, t_start AS t FROM tb WHERE y = 2), r AS (SELECT user_id, t_start AS t, max(value) AS value FROM tb WHERE y = 4 GROUP BY ALL) " + interpolated("l", "r", "l.ord"),
    "resample_grid": f"{BASE}, r AS (SELECT user_id, t_start AS t, max(value) AS value FROM tb GROUP BY ALL), l AS (SELECT n.user_id, CAST(d.d AS INTEGER) AS day, d.d * 86400.0::DOUBLE AS t FROM (SELECT user_id, max(t) AS last FROM r GROUP BY ALL) AS n, range(0, 400) AS d(d) WHERE d.d <= floor(n.last / 86400)) " + interpolated("l", "r", "l.day"),
    "hour_features": f"{BASE}, h AS (SELECT ord, hour(z) + minute(z) / 60.0 AS h FROM (SELECT ord, timezone('America/Los_Angeles', make_timestamptz(win * 1000000)) AS z FROM seg)) SELECT ord, round(h, 6) AS hour, round(sin(h * 2 * pi() / 24), 6) AS hour_sin, round(cos(h * 2 * pi() / 24), 6) AS hour_cos FROM h",
    "unit_decision": f"{BASE}, m AS (SELECT user_id, CAST(floor(win / 3600) AS BIGINT) AS h, quantile_cont(abs(value / 10), 0.5) AS m FROM seg GROUP BY ALL), u AS (SELECT user_id, quantile_cont(m, 0.5) AS median_mag, avg(CASE WHEN m > 0.5 AND m < 2 THEN 1.0 ELSE 0.0 END) AS in_g, avg(CASE WHEN m > 0.5 * 9.80665 AND m < 2 * 9.80665 THEN 1.0 ELSE 0.0 END) AS in_ms2 FROM m GROUP BY user_id) SELECT user_id, round(median_mag, 5) AS median_mag, round(in_g, 5) AS in_g, round(in_ms2, 5) AS in_ms2, CASE WHEN in_ms2 >= 0.4 THEN 'm/s2' WHEN in_g >= 0.4 THEN 'g' ELSE 'inconsistent' END AS unit FROM u",
    "user_znorm": "SELECT user_id, event_id AS ord, round((value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-6), 5) AS value_z FROM events WINDOW w AS (PARTITION BY user_id)",
    "outer_label_join": "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(quality, 0) > 0.5 AS quality_on, coalesce(lang, '-') AS lang FROM labels AS l FULL JOIN documents AS d ON d.doc_id = l.doc_id",
    "label_argmax": f"{BASE} SELECT user_id, ord AS \"window\", CAST(y + 1 AS INTEGER) AS label FROM seg",
    "weighted_argmax": "SELECT vec_id, CAST(list_position(w, list_max(w)) - 1 AS INTEGER) AS y_pred FROM (SELECT vec_id, [abs(embedding[1]::DOUBLE), abs(embedding[2]::DOUBLE) * 0.5, abs(embedding[3]::DOUBLE) * 2.0, abs(embedding[4]::DOUBLE) * 1.5, abs(embedding[5]::DOUBLE) * 0.25, abs(embedding[6]::DOUBLE), abs(embedding[7]::DOUBLE) * 3.0] AS w FROM embeddings)",
    "geo_mean_weights": "SELECT p_size AS y, round(exp(avg(ln(p_retailprice))), 4) AS weight FROM part GROUP BY p_size",
    "pareto_frontier": "WITH b AS (SELECT p_size AS cost, max(p_retailprice) AS gain FROM part GROUP BY p_size) SELECT cost, gain FROM (SELECT *, max(gain) OVER (ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b) WHERE m IS NULL OR gain > m + 1e-12",
}

ORACLES |= {"features_213": features_sql(), "viterbi_smooth": viterbi_sql(BASE)}

ORACLES |= {
    "window_blocks": f"""{BASE} SELECT user_id, CAST(block AS BIGINT) AS block, min(d) AS window, count(*) AS n FROM (SELECT *, sum(nb) OVER (PARTITION BY user_id ORDER BY t_start, ord ROWS UNBOUNDED PRECEDING) AS block FROM
    (SELECT *, CASE WHEN d <> lag(d) OVER (PARTITION BY user_id ORDER BY t_start, ord) THEN 1 ELSE 0 END AS nb FROM (SELECT *, CAST(floor(win / 86400) AS BIGINT) AS d FROM tb))) GROUP BY user_id, block""",
    "positional_align": f"{BASE} SELECT user_id, ord, y, ys AS y_smooth FROM sm",
    "extrapolated_top": "SELECT user_id, n AS extrapolated, rows, round(n / rows, 6) AS share FROM (SELECT user_id, count(*) AS rows, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY user_id) ORDER BY n / rows DESC, user_id LIMIT 5",
    "replay_faults": "SELECT user_id, event_id AS ord, 0 AS label, 0 AS stored_label FROM events WHERE false",
    "balanced_fold": """WITH t AS (SELECT label, CASE WHEN vec_id % 10 < 6 THEN 'real' WHEN vec_id % 10 < 8 THEN 'val' ELSE 'test' END AS kind, count(*) AS n FROM embeddings GROUP BY ALL)
SELECT label, kind, n FROM t UNION ALL SELECT label, 'changed', CAST(floor(n * 2.5) - n AS BIGINT) FROM t WHERE kind = 'real' AND floor(n * 2.5) > n""",
    "dev_measured": f"""{BASE}, nm AS (SELECT user_id, activity, round(sum(duration_s), 1) AS total_s, count(*) AS n, min(start_s) AS first, row_number() OVER (PARTITION BY user_id ORDER BY activity) AS k FROM rw GROUP BY user_id, activity),
pm AS (SELECT user_id, activity, round(sum(duration_s), 1) AS total_s, count(*) AS n, min(start_s) AS first FROM iv GROUP BY user_id, activity),
bh AS (SELECT 'p' AS s, user_id, max(CASE WHEN activity = 'Lying down' AND duration_s >= 86400 THEN 1 ELSE 0 END) AS lying, max(CASE WHEN activity = 'Bicycling' AND duration_s >= 3600 THEN 1 ELSE 0 END) AS ride,
    coalesce(sum(duration_s) FILTER (activity IN ('Lying down', 'Sitting')), 0) >= coalesce(sum(duration_s) FILTER (activity IN ('Walking', 'Running', 'Bicycling')), 0) AS rest FROM iv GROUP BY user_id
    UNION ALL SELECT 't', user_id, max(CASE WHEN activity = 'Lying down' AND duration_s >= 86400 THEN 1 ELSE 0 END), max(CASE WHEN activity = 'Bicycling' AND duration_s >= 3600 THEN 1 ELSE 0 END),
    coalesce(sum(duration_s) FILTER (activity IN ('Lying down', 'Sitting')), 0) >= coalesce(sum(duration_s) FILTER (activity IN ('Walking', 'Running', 'Bicycling')), 0) FROM rw GROUP BY user_id),
ow AS (SELECT t.user_id, p.lying AS pl, p.ride AS pr, p.rest AS pe, t.lying AS tl, t.ride AS tr, t.rest AS te FROM bh AS t JOIN bh AS p ON p.user_id = t.user_id AND p.s = 'p' WHERE t.s = 't')
SELECT nm.user_id || '_duration_' || k AS id, 'How long was the user ' || lower(nm.activity) || '?' AS query, {NUMBER.format('coalesce(pm.total_s, 0)')} || ' seconds' AS answer, nm.activity AS activity_event, {NUMBER.format('nm.total_s')} || ' seconds' AS true_answer FROM nm LEFT JOIN pm USING (user_id, activity) WHERE k <= 6
UNION ALL SELECT nm.user_id || '_count_' || k, 'How many separate times did the user ' || lower(nm.activity) || ' during the recording?', CAST(coalesce(pm.n, 0) AS VARCHAR), nm.activity, CAST(nm.n AS VARCHAR) FROM nm LEFT JOIN pm USING (user_id, activity) WHERE k <= 6
UNION ALL SELECT nm.user_id || '_grounding_' || k, 'Did the user begin ' || lower(nm.activity) || ' at any point, and if so, when?', CASE WHEN pm.first IS NULL THEN 'No' ELSE 'Yes, ' || lower(nm.activity) || ' began at ' || {NUMBER.format('pm.first')} || ' seconds' END, nm.activity,
    'Yes, ' || lower(nm.activity) || ' began at ' || {NUMBER.format('nm.first')} || ' seconds' FROM nm LEFT JOIN pm USING (user_id, activity) WHERE k <= 6
UNION ALL SELECT user_id || '_open_world_1', 'Did the user lie down for a prolonged period?', CASE WHEN pl = 1 THEN 'Likely yes' ELSE 'No' END, 'Prolonged lying down', CASE WHEN tl = 1 THEN 'Likely yes' ELSE 'No' END FROM ow
UNION ALL SELECT user_id || '_open_world_2', 'Was the user using a wheeled or pedal-based mode of movement?', CASE WHEN pr = 1 THEN 'Yes' ELSE 'No' END, CASE WHEN pr = 1 THEN 'Unknown outdoor physical activity, consistent with cycling' ELSE 'N/A' END, CASE WHEN tr = 1 THEN 'Yes' ELSE 'No' END FROM ow
UNION ALL SELECT user_id || '_open_world_3', 'Was the user mostly at rest or mostly physically active?', CASE WHEN pe THEN 'Mostly at rest' ELSE 'Mostly physically active' END, 'Overall activity level', CASE WHEN te THEN 'Mostly at rest' ELSE 'Mostly physically active' END FROM ow""",
}
