"""Event-time operators in their batch form; rulewright.streaming has the same as streaming jobs."""

OPS: dict[str, str] = {}

# fixed values: requests an hour of each bucket
LIMITS = {"feedback": 100, "batch": 10, "rules": 20, "reviews": 200}
_LIMITS = "(VALUES " + ", ".join(f"('{p}', {n})" for p, n in LIMITS.items()) + ") AS l(name, allowed)"
OPS["str_01_fixed_window"] = f"""
SELECT w.policy, w.subject, w.window_start, w.n, l.allowed, w.n > l.allowed AS over_limit, greatest(w.n - l.allowed, 0) AS refused FROM (SELECT policy, subject, date_trunc('hour', ts) AS window_start, count(*) AS n FROM request_log GROUP BY policy, subject, date_trunc('hour', ts)) w
JOIN {_LIMITS} ON l.name = w.policy"""
OPS["str_01_per_event"] = "SELECT event_id, CAST(row_number() OVER (PARTITION BY policy, subject, date_trunc('hour', ts) ORDER BY ts, event_id) AS INT) AS place, 3600 - SECONDS(ts) % 3600 AS seconds_left FROM request_log"
OPS["str_02_idempotent"] = "SELECT job_id, part_no, workspace_id, idempotency_key, rn = 1 AS accepted FROM (SELECT j.*, row_number() OVER (PARTITION BY workspace_id, idempotency_key ORDER BY created_at, job_id, part_no) AS rn FROM jobs j) x"
OPS["str_03_rates"] = "SELECT w.bucket, w.minute_start, count(*) AS n, round(count(*) / CAST(300 AS DOUBLE), 6) AS per_second FROM (SELECT bucket, SECONDS(ts) - SECONDS(ts) % 60 - 60 * o.back AS minute_start FROM request_log CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS o(back)) w GROUP BY w.bucket, w.minute_start"
# fixed values: upper edges of the duration histogram in seconds; what is above them all falls into the last
_EDGES = (0.01, 0.05, 0.1, 0.25, 0.5, 1, 2, 5, 10)
_LE = "CASE " + " ".join(f"WHEN duration <= {e} THEN CAST({e} AS DOUBLE)" for e in _EDGES) + " ELSE CAST(1e9 AS DOUBLE) END"
_HISTOGRAM = f"SELECT bucket, le, n, CAST(sum(n) OVER (PARTITION BY bucket ORDER BY le) AS BIGINT) AS cumulative, CAST(sum(n) OVER (PARTITION BY bucket) AS BIGINT) AS total FROM (SELECT bucket, {_LE} AS le, count(*) AS n FROM request_log WHERE duration IS NOT NULL GROUP BY bucket, {_LE}) h"
OPS["str_04_histogram"] = f"SELECT bucket, le, cumulative FROM ({_HISTOGRAM}) h"
# a quantile lies in the first bin that reaches it, between the bin's edges in proportion; above the last edge it is that edge
_BELOW = "CASE le " + " ".join(f"WHEN {b} THEN CAST({a} AS DOUBLE)" for a, b in zip((0, *_EDGES), _EDGES)) + " ELSE CAST(10 AS DOUBLE) END"
OPS["str_04_quantiles"] = f"""
SELECT bucket, q, round(CASE WHEN le > 10 THEN CAST(10 AS DOUBLE) ELSE {_BELOW} + (le - {_BELOW}) * (q * total - (cumulative - n)) / n END, 6) AS seconds FROM (
  SELECT h.*, p.q, row_number() OVER (PARTITION BY h.bucket, p.q ORDER BY h.le) AS rn FROM ({_HISTOGRAM}) h CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) AS p(q) WHERE h.cumulative >= p.q * h.total) x WHERE rn = 1"""
# running sums by job type in two steps: inside each month, and over the months before it, of which there is a row each
_CHANGES = "SELECT job_type, moment, date_trunc('month', moment) AS month, sum(delta) AS d FROM (SELECT job_type, created_at AS moment, 1 AS delta FROM jobs UNION ALL SELECT job_type, created_at + INTERVAL 3 DAY, -1 FROM jobs) e GROUP BY job_type, moment, date_trunc('month', moment)"
OPS["str_04_active_jobs"] = f"""
SELECT c.job_type, c.moment, CAST(c.inside + coalesce(m.before, 0) AS BIGINT) AS active FROM (SELECT job_type, moment, month, sum(d) OVER (PARTITION BY job_type, month ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM ({_CHANGES}) s) c
JOIN (SELECT job_type, month, sum(d) OVER (PARTITION BY job_type ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT job_type, month, sum(d) AS d FROM ({_CHANGES}) t GROUP BY job_type, month) u) m ON m.job_type = c.job_type AND m.month = c.month"""
