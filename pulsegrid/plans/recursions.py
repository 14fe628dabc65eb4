"""SQL of the ordered folds: what follows what is found for every row at once, and recursion goes along it."""

from __future__ import annotations


def passing(rows: str, key: str, at: str, seconds: int) -> str:
    """The head of a query that finds which rows of ``rows`` pass a throttle: ``a`` in order, ``passed`` by recursion from each to the next."""
    return f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at}, id) AS place FROM ({rows})),
        firsts AS (SELECT {key}, {at}, min(place) AS place FROM a GROUP BY ALL),
        following AS MATERIALIZED (SELECT a.{key}, a.place, f.place AS next FROM a ASOF JOIN firsts f ON a.{key} = f.{key} AND a.{at} + INTERVAL {seconds} SECOND <= f.{at}),
        passed AS (SELECT {key}, place, CAST(NULL AS BIGINT) AS before FROM a WHERE place = 1 UNION ALL SELECT f.{key}, f.next, f.place FROM passed p JOIN following f ON f.{key} = p.{key} AND f.place = p.place)"""


def throttled_sql(rows: str, key: str, at: str, seconds: int, forget: int | None = None) -> str:
    held = "coalesce(p.place - p.before - 1, 0)"
    if forget is not None:
        held = f"CASE WHEN b.{at} + INTERVAL {forget} SECOND <= a.{at} THEN 0 ELSE {held} END"
    return f"{passing(rows, key, at, seconds)} SELECT a.{key}, a.{at}, a.id, {held} AS suppressed FROM passed p JOIN a USING ({key}, place) LEFT JOIN a b ON b.{key} = p.{key} AND b.place = p.before"


def due_sql(rows: str, key: str, at: str, quiet: int = 15, most: int = 60) -> str:
    """The head of a query that finds what a debounce joins: ``builds`` (key, first place, last place, due)."""
    return f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at}, id) AS place FROM ({rows})),
        opened AS (SELECT *, coalesce({at} >= lag({at}) OVER (PARTITION BY {key} ORDER BY place) + INTERVAL {quiet} SECOND, true) AS opens FROM a),
        runs AS (SELECT *, min(place) FILTER (opens) OVER (PARTITION BY {key} ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_run, count(*) OVER (PARTITION BY {key}) AS n FROM opened),
        firsts AS (SELECT {key}, {at}, min(place) AS place FROM a GROUP BY ALL),
        following AS MATERIALIZED (SELECT r.{key}, r.place, coalesce(least(r.next_run, f.place), r.n + 1) AS next FROM runs r ASOF LEFT JOIN firsts f ON r.{key} = f.{key} AND r.{at} + INTERVAL {most} SECOND <= f.{at}),
        begun AS (SELECT {key}, place, next FROM following WHERE place = 1 UNION ALL SELECT f.{key}, f.place, f.next FROM begun b JOIN following f ON f.{key} = b.{key} AND f.place = b.next),
        builds AS (SELECT b.{key}, b.place, b.next - 1 AS last, least(z.{at} + INTERVAL {quiet} SECOND, y.{at} + INTERVAL {most} SECOND) AS due
            FROM begun b JOIN a y ON y.{key} = b.{key} AND y.place = b.place JOIN a z ON z.{key} = b.{key} AND z.place = b.next - 1)"""


CLAIMED = f"{passing('SELECT id, agent_id || chr(0) || (id % 3) AS claim, start_time FROM work WHERE abs(epoch(end_time - start_time)) <= 300', 'claim', 'start_time', 600)} SELECT a.id FROM passed JOIN a USING (claim, place)"
ALERTS = "SELECT id, user_code || '|' || event_type AS alert, signal_time FROM activity"
MARKS = "SELECT id, CAST(signal_time AS DATE) AS work_date, signal_time, CASE WHEN event_type <> 'signup' THEN user_code END AS user_code FROM activity"


REPORTS = "SELECT id, 'c' || (id % 5) AS client, signal_time, event_type IN ('view', 'click', 'error') AS idle, CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END + CASE WHEN event_type IN ('view', 'click', 'error') THEN 10 ELSE 0 END AS print FROM activity"
SENT = f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY signal_time, id) AS place FROM ({REPORTS})),
    runs AS (SELECT *, coalesce(print <> lag(print) OVER (PARTITION BY client ORDER BY place), true) AS fresh FROM a),
    ends AS (SELECT *, min(place) FILTER (fresh) OVER (PARTITION BY client ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_run, lead(place) OVER (PARTITION BY client ORDER BY place) AS next_row FROM runs),
    firsts AS (SELECT client, signal_time, min(place) AS place FROM a GROUP BY ALL),
    following AS MATERIALIZED (SELECT e.client, e.place, CASE WHEN e.idle THEN least(e.next_run, f.place) ELSE e.next_row END AS next FROM ends e ASOF LEFT JOIN firsts f ON e.client = f.client AND e.signal_time + INTERVAL 900 SECOND <= f.signal_time),
    sent AS (SELECT client, place FROM a WHERE place = 1 UNION ALL SELECT f.client, f.next FROM sent s JOIN following f ON f.client = s.client AND f.place = s.place WHERE f.next IS NOT NULL)
    SELECT a.client, a.id FROM sent JOIN a USING (client, place)"""
