"""Detection rules over events, as aggregations and joins.

Events have event_id, timestamp, source_ip, host, username, event_type, source. Hits have rule_key, severity, kind and entity (what is
named), n_events, peak, center (the middle of the window), n_hosts, n_users and reason (a text). Which events belong to a hit is a table of its own
(hit_events), so that no group is gathered into one value. The busiest window of a key is found per key and stretch of time: an entity that has a
third of all events spreads over its stretches.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAILED, PASSED, DENIED = "authentication_failure", "authentication_success", "connection_denied"


@dataclass(frozen=True)
class Rule:
    key: str
    name: str
    severity: str
    threshold: int
    window: int  # seconds
    enabled: bool = True
    distinct_hosts: int = 3


# The rules and their thresholds.
RULES = [
    Rule("RULE_1", "Multiple failed logins from same source", "high", 5, 120),
    Rule("RULE_2", "Brute-force pattern", "high", 10, 300),
    Rule("RULE_3", "Repeated auth failures across multiple hosts", "high", 3, 600),
    Rule("RULE_4", "Unusual login frequency", "medium", 20, 300),
    Rule("RULE_5", "Suspicious network connection sequence", "medium", 1, 180),
    Rule("RULE_6", "Failed auth burst followed by success", "critical", 4, 300),
    Rule("RULE_7", "Suspicious log-injection payload", "high", 1, 3600),
    Rule("RULE_8", "Abnormal event burst", "medium", 100, 60),
]
RULE = {r.key: r for r in RULES}


def busiest_window(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Per key: peak, the most events within any closed span of `seconds`, and center, the middle of the first such span.

    An event counts from its time on and no more once a span has passed, so the number at a time is a running sum: its work grows with the events, where a
    sliding frame looks at all events of a span for each of them."""
    width = seconds * 1_000_000
    t = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = events.where("timestamp IS NOT NULL").select(*keys, t.alias("t")).withColumn("b", F.floor(F.col("t") / width))
    # each stretch of one window's length also sees the stretch before it
    both = rows.select(*keys, "t", F.explode(F.array(F.struct(F.col("b").alias("b"), F.lit(True).alias("own")), F.struct((F.col("b") + 1).alias("b"), F.lit(False).alias("own")))).alias("x"))
    steps = F.explode(F.array(F.struct(F.col("t").alias("t"), F.lit(1).alias("d"), F.col("x.own").alias("own")), F.struct((F.col("t") + width + 1).alias("t"), F.lit(-1).alias("d"), F.lit(False).alias("own")))).alias("s")
    so_far = W.partitionBy(*keys, "b").orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    counted = both.select(*keys, "x.b", steps).select(*keys, "b", "s.t", "s.d", "s.own").select(*keys, "t", "own", F.sum("d").over(so_far).alias("n"))
    best = counted.where("own").groupBy(*keys).agg(F.max(F.struct(F.col("n").alias("n"), (-F.col("t")).alias("late"))).alias("best"))
    best = best.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("best.n").alias("peak"), (-F.col("best.late")).alias("last"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = rows.join(best, same).where(F.col("t").between(F.col("last") - width, F.col("last"))).groupBy(*keys, "peak", "last").agg(F.min("t").alias("low"))
    return inside.select(*keys, "peak", F.timestamp_micros(F.floor((F.col("low") + F.col("last")) / 2)).alias("center"))


def _hit(df: DataFrame, rule: Rule, kind: str, entity: str, reason: Column, severity=None, **cols) -> DataFrame:
    base = {"n_events": F.lit(None), "peak": F.lit(None), "center": F.lit(None), "n_hosts": F.lit(None), "n_users": F.lit(None), "host": F.lit(None)} | cols
    types = {"center": "timestamp", "host": "string"}
    return df.select(
        F.lit(rule.key).alias("rule_key"), (severity if severity is not None else F.lit(rule.severity)).alias("severity"), F.lit(kind).alias("kind"), F.col(entity).alias("entity"),
        *[c.cast(types.get(n, "long")).alias(n) for n, c in base.items()], F.lit(rule.window).alias("window_seconds"), reason.alias("reason"),
    )


def _by_peak(events: DataFrame, rule: Rule, keys: list[str], kind: str, reason: str) -> DataFrame:
    all_of = events.groupBy(*keys).agg(F.count("*").alias("n_events"), F.countDistinct("host").alias("n_hosts"), F.countDistinct("username").alias("n_users"))
    found = busiest_window(events, keys, rule.window).where(F.col("peak") >= rule.threshold).join(all_of, keys)
    text = F.format_string(reason.format(window=rule.window, threshold=rule.threshold), "peak", *keys)
    return _hit(found, rule, kind, keys[0], text, **{c: F.col(c) for c in ("n_events", "peak", "center", "n_hosts", "n_users")}, **({"host": F.col("host")} if "host" in keys else {}))


#: Hosts that a reason lists by name; further ones are counted.
HOSTS_LISTED = 50

# What hits say, with the peak, the entity and the host put in.
REASON = {
    "RULE_1": "%1$d failed authentication attempts from %2$s within {window}s (threshold {threshold}).",
    "RULE_2": "Sustained brute-force pattern: %1$d failures from %2$s against %3$s within {window}s.",
    "RULE_3": "%s produced authentication failures against %d distinct hosts (%s).",
    "RULE_4": "Account '%2$s' saw %1$d authentication attempts within {window}s (threshold {threshold}).",
    "RULE_5": "%s was denied at the firewall and then produced %d authentication failure(s) shortly after.",
    "RULE_6": "%d failed authentications for %s=%s were followed by a SUCCESSFUL login - possible credential compromise.",
    "RULE_7": "Security Shield flagged %d log record(s) from '%s' (%d weaponized) - %s.",
    "RULE_8": "Event burst: %1$d events from '%2$s' within {window}s (threshold {threshold}).",
}


def failed_logins(events: DataFrame, rule: Rule = RULE["RULE_1"]) -> DataFrame:
    return _by_peak(events.where((F.col("event_type") == FAILED) & F.col("source_ip").isNotNull()), rule, ["source_ip"], "source_ip", REASON["RULE_1"])


def brute_force(events: DataFrame, rule: Rule = RULE["RULE_2"]) -> DataFrame:
    rows = events.where((F.col("event_type") == FAILED) & F.col("source_ip").isNotNull()).withColumn("host", F.coalesce("host", F.lit("?")))
    return _by_peak(rows, rule, ["source_ip", "host"], "source_ip", REASON["RULE_2"])


def many_hosts(events: DataFrame, rule: Rule = RULE["RULE_3"]) -> DataFrame:
    """Failures against several hosts; the window only gives the center."""
    rows = events.where((F.col("event_type") == FAILED) & F.col("source_ip").isNotNull() & F.col("host").isNotNull())
    wide = rows.groupBy("source_ip").agg(F.count("*").alias("n_events"), F.countDistinct("host").alias("n_hosts"), F.countDistinct("username").alias("n_users"))
    wide = wide.where(F.col("n_hosts") >= rule.distinct_hosts)
    nth = F.row_number().over(W.partitionBy("source_ip").orderBy("host"))
    names = rows.select("source_ip", "host").distinct().withColumn("nth", nth).where(F.col("nth") <= HOSTS_LISTED).groupBy("source_ip").agg(F.array_join(F.sort_array(F.collect_list("host")), ", ").alias("names"))
    found = wide.join(names, "source_ip").join(busiest_window(rows, ["source_ip"], rule.window), "source_ip", "left")
    more = F.when(F.col("n_hosts") > HOSTS_LISTED, F.concat(F.lit(" and "), (F.col("n_hosts") - HOSTS_LISTED).cast("string"), F.lit(" more"))).otherwise("")
    text = F.format_string(REASON["RULE_3"], "source_ip", "n_hosts", F.concat("names", more))
    return _hit(found, rule, "source_ip", "source_ip", text, **{c: F.col(c) for c in ("n_events", "peak", "center", "n_hosts", "n_users")})


def login_frequency(events: DataFrame, rule: Rule = RULE["RULE_4"]) -> DataFrame:
    return _by_peak(events.where(F.col("event_type").isin(FAILED, PASSED) & F.col("username").isNotNull()), rule, ["username"], "username", REASON["RULE_4"])


def denied_then_failed(events: DataFrame, rule: Rule = RULE["RULE_5"]) -> DataFrame:
    """Failures within four windows after the first denial of the same address."""
    rows = events.where("source_ip IS NOT NULL AND timestamp IS NOT NULL")
    denied = rows.where(F.col("event_type") == DENIED).groupBy("source_ip").agg(F.min("timestamp").alias("first"), F.count("*").alias("peak"))
    gap = F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))
    after = rows.where(F.col("event_type") == FAILED).join(denied, "source_ip").where(gap.between(0, rule.window * 4_000_000))
    found = after.groupBy("source_ip", "first", "peak").agg(F.count("*").alias("n_events"), F.countDistinct("host").alias("n_hosts"), F.countDistinct("username").alias("n_users"))
    text = F.format_string(REASON["RULE_5"], "source_ip", "n_events")
    return _hit(found, rule, "source_ip", "source_ip", text, n_events=F.col("n_events"), peak=F.col("peak"), center=F.col("first"), n_hosts=F.col("n_hosts"), n_users=F.col("n_users"))


def failed_then_passed(events: DataFrame, rule: Rule = RULE["RULE_6"], kinds: tuple[str, ...] = ("source_ip", "username")) -> DataFrame:
    """The first success that has `threshold` failures before it, by address and by account. peak counts these failures.
    Only the first failures of a key are ranked, and everything else is sums, so no key is gathered."""
    found = []
    for kind in kinds:
        rows = events.where(F.col(kind).isNotNull() & F.col("timestamp").isNotNull() & F.col("event_type").isin(FAILED, PASSED))
        at = F.struct("timestamp", "event_id")
        nth = F.row_number().over(W.partitionBy(kind).orderBy("timestamp", "event_id"))
        failed = rows.where(F.col("event_type") == FAILED)
        ready = failed.withColumn("nth", nth).where(F.col("nth") <= rule.threshold).where(F.col("nth") == rule.threshold).select(kind, at.alias("ready"))
        passed = rows.where(F.col("event_type") == PASSED).join(ready, kind).where(at > F.col("ready")).groupBy(kind).agg(F.min(at).alias("hit"))
        fails = F.count_if((F.col("event_type") == FAILED) & (at < F.col("hit")))
        whole = rows.join(passed, kind).groupBy(kind, "hit").agg(F.count("*").alias("n_events"), fails.alias("peak"), F.countDistinct("host").alias("n_hosts"), F.countDistinct("username").alias("n_users"))
        text = F.format_string(REASON["RULE_6"], "peak", F.lit(kind), kind)
        found.append(_hit(whole, rule, kind, kind, text, n_events=F.col("n_events"), peak=F.col("peak"), center=F.col("hit.timestamp"), n_hosts=F.col("n_hosts"), n_users=F.col("n_users")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def injected(security: DataFrame, rule: Rule = RULE["RULE_7"]) -> DataFrame:
    """Shield verdicts by source; critical where any is a weapon. security: ts, source, verdict and, where known, detection_type."""
    bad = security.where("verdict <> 'SAFE'").withColumn("source", F.coalesce("source", F.lit("unknown")))
    kinds = F.array_join(F.sort_array(F.collect_set("detection_type")), ", ") if "detection_type" in bad.columns else F.lit("unknown")
    found = bad.groupBy("source").agg(F.count("*").alias("n_events"), F.count_if(F.col("verdict") == "WEAPONIZED_LOG").alias("peak"), F.min("ts").alias("center"), kinds.alias("kinds"))
    text = F.format_string(REASON["RULE_7"], "n_events", "source", "peak", "kinds")
    return _hit(found, rule, "source", "source", text, severity=F.when(F.col("peak") > 0, "critical").otherwise(rule.severity), n_events=F.col("n_events"), peak=F.col("peak"), center=F.col("center"))


def burst(events: DataFrame, rule: Rule = RULE["RULE_8"]) -> DataFrame:
    return _by_peak(events.where("source IS NOT NULL"), rule, ["source"], "source", REASON["RULE_8"])


def chosen_events(events: DataFrame, since: str | None = None) -> DataFrame:
    """The events that rules look at: those with a time since then; where no event is, those taken in since then."""
    if since is None:
        return events
    at = F.lit(since).cast("timestamp")
    recent = events.where(F.col("timestamp") >= at)
    if "ingested_at" not in events.columns or not recent.isEmpty():
        return recent
    return events.where(F.col("ingested_at") >= at)


def with_overrides(overrides: DataFrame | list[dict], rules: list[Rule] | None = None) -> list[Rule]:
    """The rules with stored changes (rule_key and any of severity, threshold, window, enabled, distinct_hosts); nulls change nothing.
    Rules are few: there is one row per rule at most."""
    rows = [r.asDict() for r in overrides.collect()] if isinstance(overrides, DataFrame) else overrides
    known = {r["rule_key"]: {k: v for k, v in r.items() if k != "rule_key" and v is not None} for r in rows}
    return [replace(r, **known.get(r.key, {})) for r in rules or RULES]


def evaluate(events: DataFrame, security: DataFrame | None = None, rules: list[Rule] | None = None, since: str | None = None) -> DataFrame:
    """The hits of all enabled rules."""
    events = chosen_events(events, since)
    if since and security is not None:
        security = security.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    made = {"RULE_1": failed_logins, "RULE_2": brute_force, "RULE_3": many_hosts, "RULE_4": login_frequency, "RULE_5": denied_then_failed, "RULE_6": failed_then_passed, "RULE_8": burst}
    found = [made[r.key](events, r) for r in rules or RULES if r.enabled and r.key in made]
    found += [injected(security, r) for r in rules or RULES if r.enabled and r.key == "RULE_7" and security is not None]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def hit_events(hits: DataFrame, events: DataFrame) -> DataFrame:
    """(rule_key, kind, entity, event_id, username, severity): the events that each hit counts."""
    kinds = F.create_map(F.lit("source_ip"), F.col("source_ip"), F.lit("username"), F.col("username"), F.lit("source"), F.col("source"))
    t = F.unix_micros(F.col("timestamp").cast("timestamp"))
    named = events.select("event_id", "event_type", "username", "host", "severity", t.alias("t"), F.explode(F.map_entries(kinds)).alias("e"))
    named = named.where("e.value IS NOT NULL").select("event_id", "event_type", "username", "host", "severity", "t", F.col("e.key").alias("kind"), F.col("e.value").alias("entity"))
    failed, tried, rule = F.col("event_type") == FAILED, F.col("event_type").isin(FAILED, PASSED), F.col("rule_key")
    late = F.col("t") - F.unix_micros("center")
    fits = (
        F.when(rule == "RULE_1", failed)
        .when(rule == "RULE_2", failed & (F.coalesce("host", F.lit("?")) == F.col("h_host")))
        .when(rule == "RULE_3", failed & F.col("host").isNotNull())
        .when(rule == "RULE_4", tried)
        .when(rule == "RULE_5", failed & late.between(0, F.col("window_seconds").cast("long") * 4_000_000))
        .when(rule == "RULE_6", tried & F.col("t").isNotNull())
        .otherwise(rule == "RULE_8")
    )
    own = hits.where("rule_key <> 'RULE_7'").select("rule_key", "kind", "entity", F.col("host").alias("h_host"), "center", "window_seconds").distinct()
    return named.join(own, ["kind", "entity"]).where(fits).select("rule_key", "kind", "entity", "event_id", "username", "severity").distinct()
