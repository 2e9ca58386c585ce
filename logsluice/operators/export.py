"""Exports, dashboards and plain-language explanations of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .query import EventQuery, page, search, timeseries

ECS_VERSION = "1.12.0"
FEATURES = [
    "timestamp_epoch", "hour_of_day", "day_of_week", "severity_numeric", "is_error", "has_source_ip", "has_destination_ip", "source_port", "destination_port",
    "response_code", "message_length", "raw_log_length", "pii_protected", "confidence",
]


def _col(df: DataFrame, name: str, kind: str = "string"):
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def ecs(events: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, document): each event as an Elastic Common Schema document in JSON; objects without any value are left out."""
    c = lambda n, k="string": _col(events, n, k)
    some = lambda struct, *cols: F.when(F.coalesce(*[x.cast("string") for x in cols]).isNotNull(), struct)
    at = F.date_format(c("timestamp", "timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    doc = F.struct(
        at.alias("@timestamp"), F.struct(F.lit(ECS_VERSION).alias("version")).alias("ecs"),
        F.struct(c(key).alias("id"), F.lit("event").alias("kind"), F.array(F.coalesce(c("event_type"), F.lit("unknown"))).alias("category"), F.array(F.coalesce(c("action"), F.lit("info"))).alias("type"), F.coalesce(c("status"), F.lit("unknown")).alias("outcome"), c("severity").alias("severity"), c("message").alias("reason")).alias("event"),
        F.struct(c("raw_log").alias("original"), c("severity").alias("level")).alias("log"), c("message").alias("message"),
        some(F.struct(c("host").alias("name")), c("host")).alias("host"),
        some(F.struct(c("source_ip").alias("ip"), c("source_port", "int").alias("port")), c("source_ip"), c("source_port")).alias("source"),
        some(F.struct(c("destination_ip").alias("ip"), c("destination_port", "int").alias("port")), c("destination_ip"), c("destination_port")).alias("destination"),
        some(F.struct(c("protocol").alias("protocol")), c("protocol")).alias("network"),
        some(F.struct(c("username").alias("name"), c("email").alias("email")), c("username"), c("email")).alias("user"),
        some(F.struct(some(F.struct(c("http_method").alias("method")), c("http_method")).alias("request"), some(F.struct(c("response_code", "int").alias("status_code")), c("response_code")).alias("response")), c("http_method"), c("response_code")).alias("http"),
        some(F.struct(c("url").alias("original")), c("url")).alias("url"), some(F.struct(c("process").alias("name")), c("process")).alias("process"), some(F.struct(c("service").alias("name")), c("service")).alias("service"),
        F.struct(F.coalesce(c("schema_version"), F.lit("1.0")).alias("schema_version"), c("source").alias("source"), c("parser").alias("parser"), c("pii_mode").alias("pii_mode"), c("confidence", "double").alias("confidence"), F.struct(c("raw_log_id").alias("raw_log_id"), c("job_id").alias("job_id")).alias("traceability")).alias("pipeline"),
    )
    return events.select(key, F.to_json(doc).alias("document"))


def envelope(events: DataFrame, key: str = "event_id", exported_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The head of a JSON export: schema_version, exported_at, total; the documents themselves are the rows of ecs()."""
    return events.agg(F.count("*").alias("total")).select(F.lit("1.0").alias("schema_version"), F.lit(exported_at).alias("exported_at"), "total")


def envelope_page(events: DataFrame, q: EventQuery, key: str = "event_id", exported_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One row: the envelope of a page of matches (query.page, whose limit is bounded) as a JSON text with its documents in order, and the number of all matches."""
    shown = page(events, q, key)
    order = F.col("timestamp").desc_nulls_last() if q.descending else F.col("timestamp").asc_nulls_last()
    nth = shown.select(key, F.row_number().over(W.orderBy(order, key)).alias("nth"))  # of one page
    rows = ecs(shown, key).join(nth, key).agg(F.sort_array(F.collect_list(F.struct("nth", "document"))).alias("rows"))
    total = search(events, q).agg(F.count("*").alias("total"))
    head = F.concat(F.lit(f'{{"schema_version":"1.0","exported_at":"{exported_at}","total":'), F.col("total").cast("string"), F.lit(',"events":['))
    return rows.crossJoin(total).select("total", F.concat(head, F.array_join(F.transform("rows", lambda r: r["document"]), ","), F.lit("]}")).alias("envelope"))  # one row each


def features(events: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, the fourteen features, feature_vector). Only alarm words count as severities: low, medium and high are 1, critical is 4."""
    c = lambda n, k="string": _col(events, n, k)
    ts = F.coalesce(c("timestamp", "timestamp"), c("ingested_at", "timestamp"))
    up = F.upper(F.coalesce(c("severity"), F.lit("")))
    severity = F.when(up == "DEBUG", 0).when(up.isin("WARNING", "WARN"), 2).when(up.isin("ERROR", "ERR"), 3).when(up.isin("CRITICAL", "FATAL", "ALERT", "EMERGENCY"), 4).otherwise(1)
    error = (severity >= 3) | F.coalesce(F.lower(c("status")).isin("failure", "denied", "error", "blocked"), F.lit(False))
    number = lambda n: F.coalesce(c(n, "int"), F.lit(0))
    confidence = F.coalesce(c("confidence", "double"), F.lit(0.0))
    made = {
        "timestamp_epoch": F.bround(F.unix_micros(ts) / 1_000_000, 2), "hour_of_day": F.hour(ts), "day_of_week": F.weekday(ts), "severity_numeric": severity, "is_error": error.cast("int"),
        "has_source_ip": c("source_ip").isNotNull().cast("int"), "has_destination_ip": c("destination_ip").isNotNull().cast("int"), "source_port": number("source_port"),
        "destination_port": number("destination_port"), "response_code": number("response_code"), "message_length": F.char_length(F.coalesce(c("message"), F.lit(""))),
        "raw_log_length": F.char_length(F.coalesce(c("raw_log"), F.lit(""))), "pii_protected": F.coalesce(c("pii_protected", "boolean"), F.lit(False)).cast("int"), "confidence": F.when(confidence == 0, 1.0).otherwise(confidence),
    }
    return events.select(key, *[made[n].alias(n) for n in FEATURES], F.array(*[made[n].cast("double") for n in FEATURES]).alias("feature_vector"))


def explain(events: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, summary): a sentence about each event from its columns alone."""
    c = lambda n: _col(events, n)
    bit = lambda head, n, tail="": F.concat(F.lit(head), c(n), F.lit(tail))
    # The words of the sentence.
    text = F.concat_ws(
        " ", F.coalesce(F.concat(F.lit("This is a "), F.translate(c("event_type"), "_", " ")), F.lit("This log line was normalized")), bit("from the ", "source", " source"), bit("concerning host ", "host"),
        bit("for account ", "username"), bit("originating from ", "source_ip"), F.concat(F.lit("- action "), c("action"), F.lit(", outcome "), c("status")), bit("(HTTP ", "response_code", ")"),
    )
    alarm = F.when(c("severity").isin("high", "critical"), F.concat(F.lit(". Severity is "), c("severity"), F.lit(".")))
    return events.select(key, F.concat(text, F.coalesce(alarm, F.lit("."))).alias("summary"))


def overview(done: DataFrame) -> DataFrame:
    """(card, value) of processed lines: counts by disposition, events, protected events, sources and success rate. One pass over the lines."""
    n = lambda s: F.count_if(F.col("disposition") == s)
    event = F.col("disposition") == "PROCESSED"
    both = done.agg(
        F.count("*").alias("total"), n("PROCESSED").alias("processed"), n("INVALID").alias("invalid"), n("DUPLICATE").alias("duplicate"), n("QUARANTINED").alias("quarantined"), n("PROCESSED").alias("events"),
        F.count_if(event & F.coalesce("pii_protected", F.lit(False))).alias("protected"), F.countDistinct(F.when(event, F.coalesce("source_name", F.lit("unknown")))).alias("sources"),
    )
    both = both.withColumn("success_rate", F.when(F.col("total") > 0, F.bround(100.0 * F.col("processed") / F.col("total"), 1)).otherwise(0.0))
    cards = ["total", "processed", "invalid", "duplicate", "quarantined", "events", "protected", "sources", "success_rate"]
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("card"), F.col(c).cast("double").alias("value")) for c in cards])).alias("x")).select("x.*")


def processing_rates(jobs: DataFrame) -> DataFrame:
    """One row: mean and largest rate of the completed jobs that have one, to one decimal; zeros without any. jobs: status, processing_rate."""
    rates = jobs.where("status = 'COMPLETED' AND processing_rate > 0")
    zero = lambda c: F.coalesce(F.bround(c, 1), F.lit(0.0))
    return rates.agg(zero(F.avg("processing_rate")).alias("avg_rate"), zero(F.max("processing_rate").cast("double")).alias("peak_rate"))


def charts(done: DataFrame, top: int = 15) -> DataFrame:
    """(chart, label, value) of processed lines: events by source, parser, severity and type (the top ones), outcomes of lines, protected events.
    All charts are counted in one pass."""
    event = F.col("disposition") == "PROCESSED"
    named = {"source": F.coalesce("source_name", F.lit("unknown")), "parser": F.col("parser"), "severity": F.col("severity"), "event_type": F.col("event_type")}
    entry = lambda chart, label: F.struct(F.lit(chart).alias("chart"), label.cast("string").alias("label"))
    rows = [entry(f"by_{k}", F.when(event, c)) for k, c in named.items()]
    rows += [entry("outcomes", F.lower("disposition")), entry("pii", F.when(event, F.when(F.coalesce("pii_protected", F.lit(False)), "protected").otherwise("not protected")))]
    counted = done.select(F.explode(F.array(*rows)).alias("x")).where("x.label IS NOT NULL").groupBy("x.chart", "x.label").agg(F.count("*").alias("value"))
    nth = F.row_number().over(W.partitionBy("chart").orderBy(F.desc("value"), "label"))
    return counted.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")


def recent(events: DataFrame, now: str, hours: int = 168, unit: str = "hour") -> DataFrame:
    """The series of the last hours before `now`."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return timeseries(events.where(F.col("timestamp") >= since), unit)


def source_status(configured: DataFrame, events: DataFrame) -> DataFrame:
    """Configured and observed sources: (source, configured, events, last_seen)."""
    seen = events.groupBy("source").agg(F.count("*").alias("events"), F.max("timestamp").alias("last_seen"))
    known = configured.select(F.col("name").alias("source"), F.lit(True).alias("configured")).distinct()
    return known.join(seen, "source", "full_outer").select("source", F.coalesce("configured", F.lit(False)).alias("configured"), F.coalesce("events", F.lit(0)).alias("events"), "last_seen")


NODES = ["raw", "shield", "detection", "parsing", "cleaning", "extraction", "privacy", "normalization", "validation", "storage", "alerts"]


def pipeline_nodes(done: DataFrame, n_alerts: int = 0) -> DataFrame:
    """(turn, node, records): how many lines each stage handed on."""
    kept = ~F.col("quarantine") & ~F.col("duplicate")
    a = done.agg(
        F.count("*").alias("raw"), F.count_if(~F.col("quarantine")).alias("shield"), F.count_if(kept & (F.col("format") != "UNKNOWN")).alias("detection"), F.count_if(kept & (F.col("parser") != "raw")).alias("parsing"),
        F.count_if(kept).alias("cleaning"), F.count_if(kept).alias("extraction"), F.count_if(kept & F.col("pii_protected")).alias("privacy"), F.count_if(kept & F.col("event_type").isNotNull()).alias("normalization"),
        F.count_if(kept & F.col("valid")).alias("validation"), F.count_if(F.col("disposition") == "PROCESSED").alias("storage"), F.lit(n_alerts).cast("long").alias("alerts"),
    )
    return a.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("node"), F.col(n).alias("records")) for n in NODES])).alias("turn", "x")).select("turn", "x.*")


# The nodes of the pipeline's story.
STORY = {
    "sources": "Log Sources", "ingestion": "Ingestion", "detection": "Security Shield", "parsing": "Parsing", "cleaning": "Cleaning & Validation", "pii": "PII Protection",
    "normalization": "Normalization", "validation": "Validation", "correlation": "Correlation", "risk": "Risk Scoring", "alert": "Alerts",
}


def pipeline_story(done: DataFrame, alerts: DataFrame, n_sources: int = 0, n_running: int = 0, pii_mode: str = "OFF") -> DataFrame:
    """(turn, node, label, records, status): what each stage of the pipeline saw and how it fares. alerts: status, risk_score, events."""
    n = lambda c, s: F.count_if(F.col(c) == s)
    event = F.col("disposition") == "PROCESSED"
    state = lambda s: F.count_if(event & (F.col("processing_status") == s))
    a = done.agg(
        F.count("*").alias("total"), n("disposition", "PROCESSED").alias("processed"), n("disposition", "INVALID").alias("invalid"), n("disposition", "DUPLICATE").alias("duplicate"),
        F.count_if(F.col("verdict") != "SAFE").alias("unsafe"), state("ok").alias("ok"), state("error").alias("error"), F.count_if(event & F.coalesce("pii_protected", F.lit(False))).alias("protected"),
    )
    b = alerts.agg(F.count("*").alias("alerts"), n("status", "NEW").alias("new"), F.coalesce(F.bround(F.avg("risk_score"), 1), F.lit(0.0)).alias("risk"), F.count_if(F.col("events") > 1).alias("correlated"))
    c, idle = F.col, F.lit("idle")
    some = lambda x, good="ok": F.when(c(x) > 0, good).otherwise("idle")
    nodes = {
        "sources": (F.lit(n_sources), F.when((F.lit(n_sources) > 0) | (c("total") > 0), "ok").otherwise("idle")),
        "ingestion": (c("total"), F.when(F.lit(n_running) > 0, "running").otherwise(some("total"))),
        "detection": (c("total"), F.when(c("unsafe") > 0, "warn").otherwise(some("total"))),
        "parsing": (c("processed"), some("processed")),
        "cleaning": (c("invalid") + c("duplicate"), F.when(c("invalid") > 0, "warn").otherwise(some("total"))),
        "pii": (c("protected"), F.lit("warn" if pii_mode == "OFF" else "ok")),
        "normalization": (c("processed"), some("processed")),
        "validation": (c("ok"), F.when(c("error") > 0, "warn").otherwise(some("processed"))),
        "correlation": (c("correlated"), some("correlated")),
        "risk": (c("alerts"), F.when(c("risk") >= 65, "warn").otherwise(some("alerts"))),
        "alert": (c("new"), F.when(c("new") > 0, "critical").when(c("alerts") > 0, "ok").otherwise(idle)),
    }
    rows = [F.struct(F.lit(k).alias("node"), F.lit(STORY[k]).alias("label"), count.cast("long").alias("records"), status.alias("status")) for k, (count, status) in nodes.items()]
    return a.crossJoin(b).select(F.posexplode(F.array(*rows)).alias("turn", "x")).select("turn", "x.*")  # one row on either side
