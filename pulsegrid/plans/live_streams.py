"""STR: ordered folds over streams with state and timers, each beside the recursion that says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.shared import stage
from pulsegrid.streaming import live

from .bindings import Lake
from .recursions import ALERTS, CLAIMED, MARKS, SENT, due_sql, throttled_sql
from .registry import Registry
from .streams import reported

query = Registry()


class StreamLake(Lake):
    """The logical tables over ``events`` read as a stream, with a last row that lets the watermark pass all others."""

    def source(self, name: str) -> DataFrame:
        rows = super().source(name)
        if name != "events":
            return rows
        last = rows.agg(F.max("ts").alias("ts")).select(*[_end(f.name, f.dataType.simpleString()) for f in rows.schema])
        ends = stage(last, "stream_end").inputFiles()[0].rsplit("/", 1)[0]
        read = self.spark.readStream.schema(rows.schema)
        return read.parquet(f"{self.folder}/events*.parquet").unionByName(read.parquet(ends))


def _end(name: str, kind: str):
    value = F.col("ts") + F.make_dt_interval(days=F.lit(30)) if name == "ts" else F.lit("-1")
    return value.cast(kind).alias(name)


@query("str_16_stream", SENT)
def str_16_stream(t: Lake) -> DataFrame:
    """The same as a stream whose state forgets a session a quarter of an hour after it was sent."""
    rows = reported(StreamLake(t.spark, t.folder).activity)
    found = live.to_end(live.live(rows, "client", "signal_time", [F.col("id"), F.col("print"), F.col("idle")], live.Unchanged()), "sent")
    return found.where("id >= 0").select(F.col("key").alias("client"), "id")


@query("str_17_stream", CLAIMED)
def str_17_stream(t: Lake) -> DataFrame:
    """Requests that claim their nonce, as a stream whose state forgets a nonce after ten minutes."""
    requests = StreamLake(t.spark, t.folder).work
    fresh = requests.where("abs(unix_seconds(cast(start_time as timestamp)) - unix_seconds(cast(end_time as timestamp))) <= 300 or id < 0")
    keyed = fresh.withColumn("claim", F.concat_ws("\0", "agent_id", F.col("id") % 3))
    return live.to_end(live.live(keyed, "claim", "start_time", [F.col("id")], live.Claims(600)), "claims").where("id >= 0").select("id")


@query("str_18_stream", throttled_sql("activity", "user_code", "signal_time", 3600, 86_400))
def str_18_stream(t: Lake) -> DataFrame:
    """Alerts by user, one an hour, as a stream whose state forgets a user after a day."""
    found = live.to_end(live.live(StreamLake(t.spark, t.folder).activity, "user_code", "signal_time", [F.col("id")], live.Throttle(3600, 86_400)), "alerts")
    return found.where("id >= 0").select(F.col("key").alias("user_code"), F.col("at").alias("signal_time"), "id", "suppressed")


@query("str_20_stream", throttled_sql(ALERTS, "alert", "signal_time", 600, 86_400))
def str_20_stream(t: Lake) -> DataFrame:
    """Alerts by user and kind, one in ten minutes, as a stream; each says how many were held back before it."""
    alerts = StreamLake(t.spark, t.folder).activity.withColumn("alert", F.concat_ws("|", "user_code", "event_type"))
    found = live.to_end(live.live(alerts, "alert", "signal_time", [F.col("id")], live.Throttle(600, 86_400)), "alerts")
    return found.where("id >= 0").select(F.col("key").alias("alert"), F.col("at").alias("signal_time"), "id", "suppressed")


@query("str_10_stream", f"""{due_sql(MARKS, 'work_date', 'signal_time')}, joined AS (SELECT b.work_date, b.due, b.last - b.place + 1 AS marks, bool_or(a.user_code IS NULL) AS whole, list(DISTINCT a.user_code) FILTER (a.user_code IS NOT NULL) AS users
    FROM builds b JOIN a ON a.work_date = b.work_date AND a.place BETWEEN b.place AND b.last GROUP BY b.work_date, b.due, b.last, b.place)
    SELECT CAST(work_date AS VARCHAR) AS work_date, due, marks, unnest(CASE WHEN whole THEN [NULL] ELSE users END) AS user_code FROM joined""")  # fmt: skip
def str_10_stream(t: Lake) -> DataFrame:
    """When each day's summary is built and for whom: the users marked since, or all (no user) if a mark asked for that."""
    marks = StreamLake(t.spark, t.folder).activity.withColumn("work_date", F.to_date("signal_time"))
    user = F.when(F.col("event_type") != "signup", F.col("user_code")).alias("user")
    found = live.to_end(live.live(marks, "work_date", "signal_time", [user], live.Debounce(), late="1 day"), "builds")
    return found.select(F.col("key").alias("work_date"), F.col("at").alias("due"), "marks", F.col("user").alias("user_code"))


QUERIES, ORACLES = query.queries, query.oracles
