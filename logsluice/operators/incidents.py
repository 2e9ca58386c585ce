"""Correlation around entities, risk scores, incidents and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.store import cut, stored
from . import detect
from .detect import DENIED, FAILED, PASSED

# Severity ranks and points, score bands, response categories of rules, priority of entity kinds.
RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
POINTS = {"critical": 22, "high": 15, "medium": 9, "low": 4, "info": 1}
BANDS = [("critical", 85), ("high", 65), ("medium", 40), ("low", 15), ("info", 0)]
PRIORITY = {"source_ip": 0, "host": 1, "username": 2, "source": 3}


def rank_of(c: Column) -> Column:
    out = F.when(c == "info", 0)
    for name, n in list(RANK.items())[1:]:
        out = out.when(c == name, n)
    return out


def band_of(score: Column) -> Column:
    out = F.when(score >= BANDS[0][1], BANDS[0][0])
    for name, least in BANDS[1:-1]:
        out = out.when(score >= least, name)
    return out.otherwise("info")


#: Entities up to which events are matched to them by a broadcast.
MOST_NAMED = 100_000


def _of_named(rows: DataFrame, spots: DataFrame, own: list[str]) -> DataFrame:
    """rows (kind, entity, ...) of entities that spots have, once per window of the entity. Entities are few beside events; where they are not, both sides are dealt out
    by a salt too, so that a frequent entity spreads."""
    named = stored(spots.select("kind", "entity", *own).distinct(), "named")
    if named.count() <= MOST_NAMED:
        return rows.join(F.broadcast(named), ["kind", "entity"])
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(16)).cast("int")).join(named, ["kind", "entity", "salt"]).drop("salt")


def around(entities: DataFrame, events: DataFrame, window: int | str, keep: list[str]) -> DataFrame:
    """Events (their columns `keep` and t, in microseconds) within `window` seconds of each entity's center: one number for all, or the column
    of entities with each one's own (of few distinct values, such as the rules' windows). With kind, entity, center and such a window.

    Only events of the entities are dealt out, by an equi-join on entity and stretch of time (its own and both neighbours), so that frequent entities
    spread. Stretches are as long as the entity's window. An address matches source or destination."""
    own = [window] if isinstance(window, str) else []
    width = (F.col(window) if own else F.lit(window)).cast("long") * 1_000_000
    t = F.unix_micros(F.col("timestamp").cast("timestamp"))
    known = [("source_ip", "source_ip"), ("username", "username"), ("host", "host"), ("source", "source")] + ([("source_ip", "destination_ip")] if "destination_ip" in events.columns else [])
    named = F.array_distinct(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("entity")) for k, c in known]))
    rows = events.where("timestamp IS NOT NULL").select(*keep, t.alias("t"), F.explode(named).alias("n"))
    rows = rows.where("n.entity IS NOT NULL").select("*", "n.kind", "n.entity").drop("n")
    c = F.unix_micros(F.col("center").cast("timestamp"))
    spots = entities.where("center IS NOT NULL").select("kind", "entity", "center", *own, c.alias("c")).distinct()
    if own:
        spots = spots.where(F.col(window).isNotNull())
    spots = stored(spots, "spots")
    rows = _of_named(rows, spots, own).withColumn("b", F.floor(F.col("t") / width))
    at = F.floor(F.col("c") / width)
    spots = spots.withColumn("b", F.explode(F.sequence(at - 1, at + 1)))
    return spots.join(rows, ["kind", "entity", *own, "b"]).where(F.abs(F.col("t") - F.col("c")) <= width)


def correlate(entities: DataFrame, events: DataFrame, window: int | str = 900) -> DataFrame:
    """What happened around each entity: entities (kind, entity, center) against events within `window` seconds (see around).
    One row per entity and center: counts, distinct sources, hosts and users, span and worst severity."""
    own = [window] if isinstance(window, str) else []
    near = around(entities, events, window, ["source", "host", "username", "event_type", "severity"])
    n = lambda e: F.count_if(F.col("event_type") == e)
    return near.groupBy("kind", "entity", "center", *own).agg(
        F.count("*").alias("events"), F.countDistinct("source").alias("sources"), F.countDistinct("host").alias("hosts"), F.countDistinct("username").alias("users"),
        n(FAILED).alias("failed"), n(PASSED).alias("passed"), n(DENIED).alias("denied"),
        F.when(F.count("*") > 1, F.max("t") - F.min("t")).alias("span_micros"), F.max(rank_of(F.col("severity"))).alias("worst"),
    )


def timeline(entities: DataFrame, events: DataFrame, kind: str, window: int = 900) -> DataFrame:
    """The events within the window around each entity's center, one row each, with a summary text."""
    bits = F.concat_ws(" ", F.translate("event_type", "_", " "), F.concat(F.lit("from "), "source_ip"), F.concat(F.lit("on "), "host"), F.concat(F.lit("as "), "username"), F.concat(F.lit("["), "status", F.lit("]")))
    rows = events.withColumn("summary", bits)
    near = around(entities.where(F.col("kind") == kind), rows, window, ["timestamp", "event_id", "summary"])
    return near.where(F.col("kind") == kind).select("entity", "center", "timestamp", "event_id", "summary")


def risk(df: DataFrame) -> DataFrame:
    """Adds raw, score, band and factors (by points, then in the order of the checks) to rows with failed, hosts, sources, users, events,
    span_micros, worst (rank), denied, shield_verdict and success_after_failures."""
    col = F.col
    minutes = F.greatest(col("span_micros") / 60_000_000.0, F.lit(0.1))
    rate = col("events") / minutes
    worst = F.when(col("worst") == 4, 22).when(col("worst") == 3, 15).when(col("worst") == 2, 9).when(col("worst") == 1, 4).when(col("worst") == 0, 1)
    factors = [
        ("failed_authentication_volume", F.when(col("failed") > 0, F.least(F.lit(30), 3 * col("failed")))),
        ("multiple_affected_hosts", F.when(col("hosts") > 1, F.least(F.lit(16), 7 * (col("hosts") - 1)))),
        ("cross_source_correlation", F.when(col("sources") > 1, F.least(F.lit(20), 8 * (col("sources") - 1)))),
        ("time_concentration", F.when(col("span_micros").isNotNull() & (col("events") >= 3), F.when(rate >= 20, 18).when(rate >= 8, 12).when(rate >= 3, 7).otherwise(2))),
        ("event_severity", worst),
        ("multiple_targeted_accounts", F.when(col("users") > 1, F.least(F.lit(10), 3 * col("users")))),
        ("security_shield", F.when(col("shield_verdict") == "WEAPONIZED_LOG", 25).when(col("shield_verdict") == "SUSPICIOUS", 10)),
        ("successful_login_after_failures", F.when(col("success_after_failures"), 15)),
        ("repeated_blocked_connections", F.when(col("denied") >= 3, F.least(F.lit(10), col("denied")))),
    ]
    rows = F.array(*[F.struct(p.cast("int").alias("points"), F.lit(-i).alias("turn"), F.lit(n).alias("factor")) for i, (n, p) in enumerate(factors)])
    df = df.withColumn("factors", F.sort_array(F.filter(rows, lambda f: f["points"].isNotNull()), asc=False))
    df = df.withColumn("raw", F.aggregate("factors", F.lit(0), lambda s, f: s + f["points"]))
    df = df.withColumn("score", F.least(F.lit(100), F.when(F.col("raw") <= 60, F.col("raw")).otherwise(F.bround(60 + (F.col("raw") - 60) * 0.6, 0))).cast("int"))
    return df.withColumn("band", band_of(F.col("score")))


def bands(scored: DataFrame) -> DataFrame:
    """How many rows fall into each band, empty bands included."""
    spark = scored.sparkSession
    all_bands = spark.createDataFrame([(b,) for b, _ in BANDS], "band string")
    return all_bands.join(scored.groupBy("band").agg(F.count("*").alias("n")), "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


def overlaps(members: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of groups where the earlier one (by kind, then name) has at least `least` of the later one's events. members: kind, entity,
    event_id. An event is in one group of each kind at most, so the self-join grows with the events, not with their square."""
    order = F.lit(9)
    for kind, n in PRIORITY.items():
        order = F.when(F.col("kind") == kind, n).otherwise(order)
    rows = members.select(F.struct(order.alias("o"), "kind", "entity").alias("g"), "event_id").distinct()
    sizes = rows.groupBy("g").agg(F.count("*").alias("size"))
    a, b = rows.select(F.col("g").alias("a"), "event_id"), rows.select(F.col("g").alias("b"), "event_id")
    shared = a.join(b, "event_id").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return shared.join(sizes.select(F.col("g").alias("b"), "size"), "b").where(F.col("shared") >= F.lit(least) * F.col("size"))


def merged(members: DataFrame, least: float = 0.6) -> DataFrame:
    """(kind, entity, root_kind, root_entity): each group's incident. members: kind, entity, event_id.

    Kinds are taken in order. A group joins the first incident that has enough of its events, and the incident then has all of them. Groups of
    one kind share no events, so those of a kind are decided together: one join per kind with the incidents so far."""
    members = members.select("kind", "entity", "event_id").distinct()
    done = claimed = None
    for kind in PRIORITY:
        mine = members.where(F.col("kind") == kind).select("entity", "event_id")
        if claimed is None:
            home = mine.select("entity").distinct().select(F.lit(kind).alias("kind"), "entity", F.lit(kind).alias("root_kind"), F.col("entity").alias("root_entity"))
        else:
            sizes = mine.groupBy("entity").agg(F.count("*").alias("size"))
            shared = mine.join(claimed, "event_id").groupBy("entity", "root").agg(F.count("*").alias("shared")).join(sizes, "entity")
            to = shared.where(F.col("shared") >= F.lit(least) * F.col("size")).groupBy("entity").agg(F.min("root").alias("root"))
            home = sizes.join(to, "entity", "left").select(F.lit(kind).alias("kind"), "entity", F.coalesce("root.kind", F.lit(kind)).alias("root_kind"), F.coalesce("root.entity", "entity").alias("root_entity"))
        home = cut(home)
        done = home if done is None else done.unionByName(home)
        root = F.struct(_turn("root_kind").alias("turn"), F.col("root_kind").alias("kind"), F.col("root_entity").alias("entity")).alias("root")
        more = mine.join(home, "entity").select(root, "event_id")
        claimed = cut(more if claimed is None else claimed.unionByName(more).distinct())
    return done


def _turn(kind: str) -> Column:
    turn = F.lit(9)
    for k, n in PRIORITY.items():
        turn = F.when(F.col(kind) == k, n).otherwise(turn)
    return turn


# Titles by rule, and what to do by entity.
TITLE = {
    "RULE_1": "Multiple failed logins", "RULE_2": "Possible brute-force activity", "RULE_3": "Credential spraying across hosts",
    "RULE_4": "Unusual authentication frequency", "RULE_5": "Suspicious connection-then-auth sequence", "RULE_6": "Successful login after repeated failures",
    "RULE_7": "Weaponized / injection log payload detected", "RULE_8": "Abnormal event burst",
}
RESPONSE = {
    "source_ip": ("block_source_ip", "Block source IP %s at the perimeter firewall"),
    "username": ("disable_account", "Temporarily disable account %s and force credential reset"),
    "host": ("isolate_host", "Isolate host %s for investigation"),
    "source": ("review_source", "Review the '%s' log source configuration and upstream device"),
}


def _one_of(column: str, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(column))


def incident_hits(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Hits with root_kind and root_entity, and turn: their order within the incident (its own first, then as groups joined it, then by rule)."""
    at = hits.join(merged(members), ["kind", "entity"], "left").withColumn("root_kind", F.coalesce("root_kind", "kind")).withColumn("root_entity", F.coalesce("root_entity", "entity"))
    joined = (F.col("kind") != F.col("root_kind")) | (F.col("entity") != F.col("root_entity"))
    return at.withColumn("turn", F.struct(joined.alias("joined"), _turn("kind").alias("turn"), "entity", "rule_key", F.coalesce("host", F.lit("")).alias("host")))


def alerts(hits: DataFrame, events: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One alert per incident: its first worst rule, earliest center, what happened around it within three of its longest windows, risk and the
    worse of the rule's and the risk's severity. The reason says what every hit of the incident says. Incidents of a source alone are not correlated: what their hits count stands for it.

    members: detect.hit_events. Failed logins are the most that a hit counts, else those around; accounts are those of the hits' events."""
    hits = cut(hits)
    members = cut(detect.hit_events(hits, events) if members is None else members)
    named = cut(incident_hits(hits, members))
    col, group = F.col, ["root_kind", "root_entity"]
    rule = col("rule_key")
    verdict = F.when(rule == "RULE_7", F.struct("turn", F.when(col("severity") == "critical", "WEAPONIZED_LOG").otherwise("SUSPICIOUS").alias("v")))
    one = named.groupBy(*group).agg(
        F.min(F.struct((-rank_of(col("severity"))).alias("r"), "turn", rule)).alias("lead"), F.min("center").alias("center"), F.max("window_seconds").alias("window_seconds"),
        F.sort_array(F.collect_set("rule_key")).alias("rules"), F.max(rule == "RULE_6").alias("success_after_failures"),
        F.max(F.when(rule.isin("RULE_1", "RULE_2", "RULE_3"), col("n_events"))).alias("most_failed"), F.min(verdict)["v"].alias("shield_verdict"), F.count("*").alias("n_hits"),
    )
    texts = named.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("rule_key", "turn", "reason"))).alias("t"))
    texts = texts.select(*group, F.array_join("t.reason", " ").alias("reason"))
    roots = named.select("kind", "entity", "rule_key", *group).distinct()
    told = members.join(roots, ["kind", "entity", "rule_key"]).groupBy(*group).agg(
        F.countDistinct(F.when(rule != "RULE_8", col("username"))).alias("accounts"), F.countDistinct("event_id").alias("own_events"), F.max(rank_of(col("severity"))).alias("own_worst"))
    one = one.join(texts, group).join(told, group, "left").withColumnsRenamed({"root_kind": "kind", "root_entity": "entity"})
    one = cut(one.withColumn("window", 3 * col("window_seconds")))
    seen = correlate(one.where("kind <> 'source'"), events, "window")
    found = one.join(seen, ["kind", "entity", "center", "window"], "left")
    counted = {n: F.coalesce(n, F.lit(0)) for n in ("sources", "hosts", "passed", "denied")}
    alone = col("kind") == "source"
    counted["failed"] = F.coalesce(F.when(col("most_failed") > 0, col("most_failed")), col("failed"), F.lit(0))
    counted["events"] = F.when(alone, F.coalesce("own_events", F.lit(0))).otherwise(F.coalesce("events", F.lit(0)))
    counted["worst"] = F.when(alone, col("own_worst")).otherwise(col("worst"))
    counted["users"] = F.coalesce("accounts", F.lit(0))
    found = risk(found.withColumns(counted))
    worst = F.greatest(-col("lead.r"), rank_of(col("band")))
    level = F.when(worst == 4, "critical").when(worst == 3, "high").when(worst == 2, "medium").when(worst == 1, "low").otherwise("info")
    about = F.when(alone, F.concat(F.lit(" (source "), "entity", F.lit(")"))).otherwise(F.concat(F.lit(" ("), F.translate("kind", "_", " "), F.lit(" "), "entity", F.lit(")")))
    label = F.lit(None).cast("string")
    for kind, (_, text) in RESPONSE.items():
        label = F.when(col("kind") == kind, F.format_string(text, "entity")).otherwise(label)
    response = F.struct(_one_of("kind", {k: a for k, (a, _) in RESPONSE.items()}).alias("action"), label.alias("label"), col("entity").alias("target"), F.lit(False).alias("auto_execute"), col("band").alias("urgency"))
    return found.withColumn("rule_key", col("lead.rule_key")).select(
        F.concat_ws("=", "kind", "entity").alias("dedup_key"), F.concat(_one_of("rule_key", TITLE), about).alias("title"), "kind", "entity", "rule_key", "rules", level.alias("severity"),
        col("score").alias("risk_score"), "band", "factors", "center", "window_seconds", "events", "sources", "hosts", "users", "failed", "passed", "denied",
        F.concat(F.lit("Triggered rules: "), F.array_join("rules", ", "), F.lit(". Entity "), "kind", F.lit("="), "entity", F.lit(".")).alias("description"), "reason",
        response.alias("recommended_response"), F.lit("NEW").alias("status"),
    )


def alert_events(rows: DataFrame, events: DataFrame, members: DataFrame, hits: DataFrame) -> DataFrame:
    """(dedup_key, event_id): the events around each alert's center that concern its entity; for alerts of a source, the events that its hits count."""
    near = around(rows.where("kind <> 'source'").select("kind", "entity", "center", (3 * F.col("window_seconds")).alias("window")), events, "window", ["event_id"])
    roots = incident_hits(hits, members).where("root_kind = 'source'").select("kind", "entity", "rule_key", "root_kind", "root_entity").distinct()
    own = members.join(roots, ["kind", "entity", "rule_key"]).select(F.col("root_kind").alias("kind"), F.col("root_entity").alias("entity"), "event_id").distinct()
    found = near.select("kind", "entity", "event_id").unionByName(own)
    return found.join(rows.select("dedup_key", "kind", "entity"), ["kind", "entity"]).select("dedup_key", "event_id").distinct()


def upsert(old: DataFrame, new: DataFrame, key: str = "dedup_key", keep: tuple[str, ...] = ("status",)) -> DataFrame:
    """The newest payload per key; columns of `keep` stay as they were where the key was known. Keys are unique on either side."""
    cols = [c for c in new.columns if c != key]
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("o_known"))
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("n_known"))
    value = lambda c: F.when(F.col("n_known").isNull() | (F.lit(c in keep) & F.col("o_known").isNotNull()), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
    return o.join(n, key, "full_outer").select(key, *[value(c).alias(c) for c in cols])


STATUSES = ("NEW", "ACKNOWLEDGED", "INVESTIGATING", "RESOLVED", "FALSE_POSITIVE")


def set_status(rows: DataFrame, dedup_key: str, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    return rows.withColumn("status", F.when(F.col("dedup_key") == dedup_key, status).otherwise(F.col("status")))


def top_alerts(rows: DataFrame, n: int = 200, status: str | None = None, severity: str | None = None) -> DataFrame:
    if status:
        rows = rows.where(F.col("status") == status.upper())
    if severity:
        rows = rows.where(F.col("severity") == severity.lower())
    return rows.orderBy(F.desc("risk_score"), F.desc("center"), "dedup_key").limit(n)


def roll_up(rows: DataFrame) -> DataFrame:
    """Alerts by entity: number, worst score and band, last seen."""
    return rows.groupBy("kind", "entity").agg(F.count("*").alias("alerts"), F.max("risk_score").alias("max_risk"), F.max_by("band", "risk_score").alias("band"), F.max("center").alias("last_seen"))


# What to do by category.
CATEGORY = {
    "RULE_1": "BRUTE_FORCE", "RULE_2": "BRUTE_FORCE", "RULE_3": "BRUTE_FORCE", "RULE_4": "SUSPICIOUS_AUTHENTICATION", "RULE_5": "PORT_SCAN",
    "RULE_6": "SUSPICIOUS_AUTHENTICATION", "RULE_7": "SUSPICIOUS_EXECUTION", "RULE_8": "ANOMALOUS_VOLUME",
}
CATEGORY_ORDER = ["SUSPICIOUS_EXECUTION", "BRUTE_FORCE", "PORT_SCAN", "SUSPICIOUS_AUTHENTICATION", "ANOMALOUS_VOLUME"]


def recommend(rows: DataFrame) -> DataFrame:
    """Adds category, label and actions (action, target, port, protocol) to alerts (kind, entity, rules and, where known, port, protocol, host).
    Nothing is carried out: actions only describe."""
    cats = F.transform("rules", lambda r: F.element_at(F.create_map(*[x for k, v in CATEGORY.items() for x in (F.lit(k), F.lit(v))]), r))
    category = F.lit("NONE")
    for c in reversed(CATEGORY_ORDER):
        category = F.when(F.array_contains(cats, c), c).otherwise(category)
    ip = F.when(F.col("kind") == "source_ip", F.col("entity"))
    user = F.when(F.col("kind") == "username", F.col("entity"))
    host = F.coalesce(F.when(F.col("kind") == "host", F.col("entity")), F.col("host") if "host" in rows.columns else F.lit(None))
    port = F.col("port") if "port" in rows.columns else F.lit(None).cast("int")
    protocol = F.upper(F.coalesce(F.col("protocol") if "protocol" in rows.columns else F.lit(None).cast("string"), F.lit("TCP")))
    none = F.lit(None).cast("string")
    act = lambda name, target, p=None, q=None: F.struct(F.lit(name).alias("action"), target.alias("target"), (p if p is not None else F.lit(None)).cast("int").alias("port"), (q if q is not None else none).alias("protocol"))
    who = F.coalesce(user, ip)
    # The actions and the labels of each category.
    steps = {
        "BRUTE_FORCE": F.array(act("BLOCK_SOURCE", ip, F.coalesce(port, F.lit(22)), protocol), act("MONITOR_SOURCE", ip), act("INCREASE_MONITORING", F.lit("authentication"))),
        "PORT_SCAN": F.array(act("BLOCK_SOURCE", ip, port, protocol), act("INCREASE_MONITORING", F.lit("network")), act("COLLECT_EVIDENCE", ip)),
        "SUSPICIOUS_AUTHENTICATION": F.array(F.when(user.isNotNull(), act("DISABLE_ACCOUNT_SIMULATION", user)).otherwise(act("MONITOR_SOURCE", ip)), act("MONITOR_SOURCE", F.coalesce(ip, user)), act("COLLECT_EVIDENCE", who)),
        "SUSPICIOUS_EXECUTION": F.concat(F.when(host.isNotNull(), F.array(act("ISOLATE_HOST", host))).otherwise(F.array().cast("array<struct<action:string,target:string,port:int,protocol:string>>")), F.array(act("COLLECT_EVIDENCE", F.coalesce(host, F.lit("affected_systems"))), act("INCREASE_MONITORING", F.coalesce(host, F.lit("environment"))))),
        "ANOMALOUS_VOLUME": F.array(act("INCREASE_MONITORING", F.coalesce(ip, F.lit("source"))), act("MONITOR_SOURCE", ip), act("COLLECT_EVIDENCE", ip)),
    }
    labels = {
        "BRUTE_FORCE": F.lit("Block source IP"), "PORT_SCAN": F.lit("Block or closely monitor the scanning source"),
        "SUSPICIOUS_AUTHENTICATION": F.when(user.isNotNull(), F.concat(F.lit("Require step-up authentication for "), user)).otherwise(F.concat(F.lit("Monitor and rate-limit source "), ip)),
        "SUSPICIOUS_EXECUTION": F.when(host.isNotNull(), F.concat(F.lit("Isolate host "), host, F.lit(" (simulation only) and collect logs"))).otherwise("Collect logs and increase monitoring"),
        "ANOMALOUS_VOLUME": F.concat(F.lit("Increase monitoring on "), F.coalesce(ip, F.lit("the source"))),
    }
    needs_ip = F.col("category").isin("BRUTE_FORCE", "PORT_SCAN")
    df = rows.withColumn("category", category)
    df = df.withColumn("category", F.when(needs_ip & (F.col("kind") != "source_ip"), "NONE").otherwise(F.col("category")))
    label, actions = F.lit("No automated response recommendation available."), F.array().cast("array<struct<action:string,target:string,port:int,protocol:string>>")
    for c in CATEGORY_ORDER:
        label = F.when(F.col("category") == c, labels[c]).otherwise(label)
        actions = F.when(F.col("category") == c, steps[c]).otherwise(actions)
    return df.withColumns({"label": label, "actions": actions})


def simulate(recommended: DataFrame) -> DataFrame:
    """One row per action: the virtual state before and after it. Nothing real is changed."""
    rows = recommended.select(*[c for c in recommended.columns if c != "actions"], F.posexplode("actions").alias("step", "a"))
    a, block = F.col("a.action"), F.col("a.action") == "BLOCK_SOURCE"
    dest = F.concat(F.coalesce("a.protocol", F.lit("TCP")), F.coalesce(F.concat(F.lit("/"), F.col("a.port").cast("string")), F.lit("")))
    pick = lambda fw, iso, hold, mon: F.when(block, fw).when(a == "ISOLATE_HOST", iso).when(a == "DISABLE_ACCOUNT_SIMULATION", hold).otherwise(mon)
    return rows.select(
        "*", a.alias("action"), F.col("a.target").alias("target"), pick("virtual_firewall", "virtual_host_isolation", "virtual_account_hold", "virtual_monitoring").alias("simulation"),
        pick("ALLOW", "CONNECTED", "ENABLED", "baseline").alias("before"), pick("WOULD BLOCK", "WOULD ISOLATE", "WOULD DISABLE", "elevated").alias("after"),
        F.when(block, F.concat(F.lit("DENY "), F.col("a.target"), F.lit(" -> "), dest)).alias("rule"), F.lit(True).alias("simulation_only"),
    ).drop("a")
