"""Ordered-state queries; the SQL twins walk the rows one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.operators import stateful
from contentflow.plans.registry import query
from contentflow.sources.views import ATTEMPTS_SQL, ITEMS_SQL


def spaced_sql(src, key, ident, ts, gap, strict):
    cmp = ">" if strict else ">="
    return f"""
ev AS (SELECT {ident} AS id, {key} AS k, epoch_us({ts}) AS t, row_number() OVER (PARTITION BY {key} ORDER BY {ts}, {ident}) AS rn FROM {src}),
walk(k, rn, id, last, accepted) AS (SELECT k, rn, id, t, true FROM ev WHERE rn = 1
 UNION ALL SELECT e.k, e.rn, e.id, CASE WHEN e.t - w.last {cmp} {gap} THEN e.t ELSE w.last END, e.t - w.last {cmp} {gap} FROM walk w JOIN ev e ON e.k = w.k AND e.rn = w.rn + 1)
SELECT id, accepted FROM walk"""


@query("I2_dedup_in_window", "WITH RECURSIVE " + ITEMS_SQL + "," + spaced_sql("items", "payload", "id", "published", 3600 * 1000000, True))
def dedup_in_window(t):
    out = stateful.dedup_in_window(t.items().select("id", "payload", "published"), "payload", "published", "id")
    return out.select("id", "accepted")


@query("I7_recheck_gate", "WITH RECURSIVE " + ITEMS_SQL + "," + spaced_sql("items", "feed", "id", "published", 300 * 1000000, False))
def recheck_gate(t):
    return stateful.recheck_gate(t.items().select("id", "feed", "published"), "feed", "published", "id").select("id", "accepted")


@query("I15_breaker_states", "WITH RECURSIVE " + ATTEMPTS_SQL + """,
ev AS (SELECT attempt_id, service, ok, epoch_us(ts) AS t, row_number() OVER (PARTITION BY service ORDER BY ts, attempt_id) AS rn FROM attempts),
walk(service, rn, attempt_id, state, failures, opened, before_state, allowed) AS (
 SELECT service, 0::BIGINT, -1::BIGINT, 'closed', 0, 0::BIGINT, 'closed', true FROM ev WHERE rn = 1
 UNION ALL
 SELECT e.service, e.rn, e.attempt_id,
  CASE WHEN w.state='open' AND e.t - w.opened < 600000000 THEN 'open' WHEN e.ok THEN 'closed' WHEN w.state='open' OR w.failures + 1 >= 2 THEN 'open' ELSE 'closed' END,
  CASE WHEN w.state='open' AND e.t - w.opened < 600000000 THEN w.failures WHEN e.ok THEN 0 WHEN w.state='open' OR w.failures + 1 >= 2 THEN 0 ELSE w.failures + 1 END,
  CASE WHEN w.state='open' AND e.t - w.opened < 600000000 THEN w.opened WHEN NOT e.ok AND (w.state='open' OR w.failures + 1 >= 2) THEN e.t ELSE w.opened END,
  w.state, NOT (w.state='open' AND e.t - w.opened < 600000000)
 FROM walk w JOIN ev e ON e.service = w.service AND e.rn = w.rn + 1)
SELECT attempt_id, before_state AS state_before, allowed, state AS state_after FROM walk WHERE rn > 0""")
def breaker_states(t):
    """Two failures open a service for ten minutes."""
    a = t.attempts().select("attempt_id", "service", "ts", "ok")
    return stateful.breaker_log(a, "service", "ts", "attempt_id", "ok", threshold=2, timeout_seconds=600).select(
        "attempt_id", "state_before", "allowed", "state_after")


@query("I16_token_bucket", "WITH RECURSIVE " + ATTEMPTS_SQL + """,
ev AS (SELECT attempt_id, service, epoch_us(ts) AS t, row_number() OVER (PARTITION BY service ORDER BY ts, attempt_id) AS rn FROM attempts),
walk(service, rn, attempt_id, tokens, last, throttled, wait_seconds) AS (
 SELECT service, 0::BIGINT, -1::BIGINT, 3.0::DOUBLE, t, false, 0.0::DOUBLE FROM ev WHERE rn = 1
 UNION ALL
 SELECT e.service, e.rn, e.attempt_id, CASE WHEN x < 1 THEN x ELSE x - 1 END, e.t, x < 1, CASE WHEN x < 1 THEN (1 - x) / 0.0005 ELSE 0 END
 FROM (SELECT w.service, e.rn, e.attempt_id, e.t, least(3.0, w.tokens + (e.t - w.last)/1000000.0 * 0.0005::DOUBLE) AS x FROM walk w JOIN ev e ON e.service = w.service AND e.rn = w.rn + 1) e)
SELECT attempt_id, round(tokens, 6) AS tokens, throttled, round(wait_seconds, 6) AS wait_seconds FROM walk WHERE rn > 0""")
def token_bucket(t):
    a = t.attempts().select("attempt_id", "service", "ts")
    out = stateful.token_bucket_log(a, "service", "ts", "attempt_id", rate=0.0005, burst=3.0)
    return out.select("attempt_id", F.round("tokens", 6).alias("tokens"), "throttled", F.round("wait_seconds", 6).alias("wait_seconds"))
