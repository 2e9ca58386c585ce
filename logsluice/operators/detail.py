"""Detail views: what belongs to one event, alert or raw line, as joins by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import incidents


def event_detail(events: DataFrame, raw_logs: DataFrame, jobs: DataFrame, security: DataFrame) -> DataFrame:
    """Events with the line, job and shield verdict that they come from. raw_logs: raw_log_id, content, job_id; jobs: job_id, detected_format;
    security: raw_log_id, verdict (one row per line that is not safe)."""
    lines = raw_logs.select("raw_log_id", F.col("content").alias("raw_content"), "job_id")
    return (
        events.join(lines, "raw_log_id", "left")
        .join(jobs.select("job_id", "detected_format"), "job_id", "left")
        .join(security.select("raw_log_id", F.col("verdict").alias("shield_verdict")), "raw_log_id", "left")
        .withColumn("shield_verdict", F.coalesce("shield_verdict", F.lit("SAFE")))
    )


def related(events: DataFrame, to: DataFrame, seconds: int = 1800, top: int = 25, key: str = "event_id") -> DataFrame:
    """For each event of `to`: the nearest other events of its address within `seconds`, by distance, then key.

    Nothing is compared pair by pair, so that a busy address costs no more than its events. Of the events of one address and moment only the first top + 1 by
    key can be among anyone's nearest. In order of time the nearest of a moment are among the 2 * top + 1 rows on either side of it; an address is dealt out
    over stretches of `seconds`, each of which also sees its neighbours. Events of `to` then take the list of their moment without themselves."""
    width = seconds * 1_000_000
    moment = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = events.where("source_ip IS NOT NULL AND timestamp IS NOT NULL").select("source_ip", moment.alias("t"), F.col(key).alias("id"))
    rows = rows.withColumn("turn", F.row_number().over(W.partitionBy("source_ip", "t").orderBy("id"))).where(F.col("turn") <= top + 1)
    b = F.floor(F.col("t") / width)
    dealt = rows.withColumn("own", b).withColumn("b", F.explode(F.sequence(b - 1, b + 1)))
    around = W.partitionBy("source_ip", "b").orderBy("t", "id").rowsBetween(-2 * top - 1, 2 * top + 1)
    seen = dealt.withColumn("near", F.collect_list(F.struct("t", "id")).over(around)).where("own = b AND turn = 1")
    near = F.transform(F.filter("near", lambda x: F.abs(x["t"] - F.col("t")) <= width), lambda x: F.struct(F.abs(x["t"] - F.col("t")).alias("gap"), x["id"].alias("id")))
    lists = seen.select("source_ip", "t", F.slice(F.array_sort(near), 1, top + 1).alias("near"))
    asked = to.where("source_ip IS NOT NULL").select(F.col(key).alias("of"), "source_ip", moment.alias("t"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("of")), 1, top)
    found = asked.join(lists, ["source_ip", "t"]).select("of", F.posexplode(others).alias("nth", "x"))
    return found.select("of", F.col("x.id").alias(key), F.col("x.gap").alias("gap"), (F.col("nth") + 1).alias("nth"))


def evidence(alerts: DataFrame, events: DataFrame, security: DataFrame | None = None, window: int | str = 900, top: int = 25) -> DataFrame:
    """One row per alert (dedup_key, kind, entity, center; window: seconds, or the column with each alert's own) that has events around its center: how many,
    the nearest `top` (by distance, then event), the port and protocol that they name most, their users and hosts, and the shield verdicts of their
    lines (security: raw_log_id, verdict). Events of an alert are cut to the nearest ones task by task before they are shuffled; counts are of all."""
    known = [c for c in ("destination_port", "protocol", "raw_log_id") if c in events.columns]
    own = [window] if isinstance(window, str) else []
    near = incidents.around(alerts, events, window, ["event_id", "event_type", "username", "host", *known])
    ids = [F.col(c) for c in ("kind", "entity", "center")]
    total = near.groupBy("kind", "entity", "center", *own).agg(F.count("*").alias("events"))
    gap = F.abs(F.col("t") - F.unix_micros(F.col("center").cast("timestamp")))
    nth = F.row_number().over(W.partitionBy(*ids).orderBy("gap", "event_id"))
    kept = near.withColumn("gap", gap).withColumn("nth", nth).where(F.col("nth") <= top)
    if security is not None and "raw_log_id" in known:
        kept = kept.join(security.select("raw_log_id", "verdict").distinct(), "raw_log_id", "left")
    else:
        kept = kept.withColumn("verdict", F.lit(None).cast("string"))
    mode = lambda c: _mode(F.sort_array(F.collect_list(c)))
    none = F.lit(None)
    told = kept.groupBy(*ids).agg(
        F.transform(F.array_sort(F.collect_set(F.struct("nth", "event_id", "event_type", "gap"))), lambda x: F.struct(x["event_id"], x["event_type"], x["gap"])).alias("nearest"),
        (mode("destination_port") if "destination_port" in known else none.cast("int")).alias("port"), (mode("protocol") if "protocol" in known else none.cast("string")).alias("protocol"),
        F.sort_array(F.collect_set("username")).alias("usernames"), F.sort_array(F.collect_set("host")).alias("hosts"), F.sort_array(F.collect_set("verdict")).alias("verdicts"),
    )
    out = alerts.select("dedup_key", *ids).join(total.drop(*own), ["kind", "entity", "center"]).join(told, ["kind", "entity", "center"])
    return out.select("dedup_key", "kind", "entity", "center", "events", "nearest", "port", "protocol", "usernames", "hosts", "verdicts")


def _mode(values: Column) -> Column:
    """The most frequent of a few sorted values, the least on ties."""
    counts = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.array_min(counts)["v"]


def alerts_of(members: DataFrame, events: DataFrame, key: str = "event_id") -> DataFrame:
    """Which hits each event belongs to. members: rule_key, kind, entity, event_id."""
    return events.select(key).join(members, key).groupBy(key).agg(F.sort_array(F.collect_set("rule_key")).alias("rules"))


def verdicts_of(members: DataFrame, events: DataFrame, security: DataFrame) -> DataFrame:
    """Per hit, the distinct shield verdicts of its events' lines."""
    found = members.join(events.select("event_id", "raw_log_id"), "event_id").join(security.select("raw_log_id", "verdict"), "raw_log_id")
    return found.groupBy("kind", "entity").agg(F.sort_array(F.collect_set("verdict")).alias("verdicts"))


def busiest_target(members: DataFrame, events: DataFrame) -> DataFrame:
    """Per hit, the destination port and the protocol that its events name most (the smaller on ties), each counted by itself."""
    known = [c for c in ("destination_port", "protocol") if c in events.columns]
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in known])).alias("x")
    rows = members.join(events.select("event_id", *known), "event_id").select("kind", "entity", named).where("x.value IS NOT NULL")
    n = rows.groupBy("kind", "entity", "x.field", "x.value").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), F.when(F.col("field") == "destination_port", F.col("value").cast("long")).alias("port"), "value")
    best = n.groupBy("kind", "entity", "field").agg(F.min(order).alias("best"))
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("best.value")))
    return best.groupBy("kind", "entity").agg(pick("destination_port").cast("int").alias("port"), pick("protocol").alias("protocol"))


def listed(rows: DataFrame, order: str, limit: int = 200, descending: bool = True, **equal) -> DataFrame:
    """Rows by time for job, raw-line, security-event, audit and record lists; conditions that are None are left out."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    return rows.orderBy(by, *[c for c in rows.columns if c != order and c.endswith("id")]).limit(limit)
