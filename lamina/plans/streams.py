"""Streams over the events table, each with the batch result as its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.plans.grouping import ISLANDS, RUNNING
from lamina.plans.registry import Tables, query
from lamina.streaming import stateful as Z
from lamina.streaming.plan import Plan, classify


def _events(t: Tables) -> DataFrame:
    return Z.file_stream(t.spark, t.folder, "events")


@query("""select event_id, upper(event_type) as kind, round(value * 2, 2) as twice from events where event_type <> 'view'""")
def stream_for_each(t: Tables) -> DataFrame:
    assert classify(["filter", "for-each"], keyed=False) is Plan.STATELESS
    out = _events(t).where("event_type <> 'view'").select("event_id", F.upper("event_type").alias("kind"), F.round(F.col("value") * 2, 2).alias("twice"))
    return Z.run_now(out)


@query("""select count(*)::bigint as n, round(sum(value), 2) as total, round(min(value), 2) as least, round(max(value), 2) as most, round(avg(value), 4) as mean from events""")
def stream_watchers(t: Tables) -> DataFrame:
    out = Z.watchers(_events(t), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.min("value"), 2).alias("least"), F.round(F.max("value"), 2).alias("most"), F.round(F.avg("value"), 4).alias("mean"))
    return Z.run_now(out, "complete")


@query("""select event_type, count(*)::bigint as n, round(sum(value), 2) as total from events group by 1""")
def stream_group_by(t: Tables) -> DataFrame:
    return Z.run_now(Z.watchers(_events(t), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), within=["event_type"]), "complete")


@query("""select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 2) as acc_after from events""")
def stream_accumulator(t: Tables) -> DataFrame:
    def step(state, row):
        total = state[0] + row.value
        return (total,), [{"event_id": row.event_id, "acc_after": total}]

    out = Z.folded(_events(t).select("event_id", "ts", "user_id", "value"), "user_id", ["ts", "event_id"], step, (0.0,), "total double", "event_id long, acc_after double")
    return Z.run_now(out).select("event_id", F.round("acc_after", 2).alias("acc_after"))


@query(RUNNING + """, b as (select user_id, min(p) as p from r where total > 300 group by 1) select r.user_id, r.event_id as stopped_at from r join b on r.user_id = b.user_id and r.p = b.p""")
def stream_iterate_break(t: Tables) -> DataFrame:
    def step(state, row):
        total, done = state
        if done:
            return state, []
        total += row.value
        return (total, total > 300), ([{"user_id": row.user_id, "stopped_at": row.event_id}] if total > 300 else [])

    out = Z.folded(_events(t).select("event_id", "ts", "user_id", "value"), "user_id", ["ts", "event_id"], step, (0.0, False), "total double, done boolean", "user_id long, stopped_at long")
    return Z.run_now(out)


@query(ISLANDS.split("select user_id, grp")[0] + """select user_id, grp::bigint as grp, min(event_type) as event_type, count(*)::bigint as n from g where grp < (select max(grp) from g h where h.user_id = g.user_id) group by user_id, grp""")
def stream_group_adjacent(t: Tables) -> DataFrame:
    """A run leaves when its key changes; each user's last run is still open when the stream ends (``stream_group_adjacent_all`` has it too)."""
    return Z.run_now(_runs(_events(t)))


def _runs(events: DataFrame, held_open: Callable[[object, tuple], list[dict]] | None = None) -> DataFrame:
    def step(state, row):
        kind, n, grp = state
        if n and kind == row.event_type:
            return (kind, n + 1, grp), []
        done = [{"user_id": row.user_id, "grp": grp, "event_type": kind, "n": n}] if n else []
        return (row.event_type, 1, grp + 1), done

    return Z.folded(events.select("event_id", "ts", "user_id", "event_type"), "user_id", ["ts", "event_id"], step, ("", 0, 0), "kind string, n long, grp long", "user_id long, grp long, event_type string, n long", held_open)


@query(ISLANDS.replace(", round(sum(value), 2) as total", ""))
def stream_group_adjacent_all(t: Tables) -> DataFrame:
    """All runs: the open one also leaves with each micro-batch, and of its rows the longest counts."""

    def held_open(user, state):
        kind, n, grp = state
        return [{"user_id": user, "grp": grp, "event_type": kind, "n": n}]

    out = Z.run_now(_runs(_events(t), held_open))
    return out.groupBy("user_id", "grp").agg(F.min("event_type").alias("event_type"), F.max("n").alias("n"))


@query("""select strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d') as day, event_type, count(*)::bigint as n from events group by 1, 2""")
def ext_event_time_windows(t: Tables) -> DataFrame:
    """Extension: daily windows of event time."""
    rows = t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""select event_id, p::bigint as pos from (select *, row_number() over (partition by user_id order by ts, event_id) as p from events) where p between 2 and 4""")
def stream_subsequence(t: Tables) -> DataFrame:
    """A slice of each user's events while they stream: the state is a position."""

    def step(state, row):
        at = state[0] + 1
        return (at,), ([{"event_id": row.event_id, "pos": at}] if 2 <= at <= 4 else [])

    out = Z.folded(_events(t).select("event_id", "ts", "user_id"), "user_id", ["ts", "event_id"], step, (0,), "at long", "event_id long, pos long")
    return Z.run_now(out)


@query("""select event_type, n, n > 1000 as many from (select event_type, count(*)::bigint as n from events group by 1)""")
def stream_branch_gate(t: Tables) -> DataFrame:
    """A condition that does not depend on the stream is decided once, before it starts."""
    source = _events(t) if t.spark.range(1).count() == 1 else _events(t).limit(0)
    counted = Z.run_now(Z.watchers(source, F.count(F.lit(1)).alias("n"), within=["event_type"]), "complete")
    return counted.withColumn("many", F.col("n") > 1000)
