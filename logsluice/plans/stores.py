"""Registered queries over what is written and read back: sources, keyed tables, template stores, indexes, sketches. Each derives what it writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.keyed import KeyedTable
from ..functions.store import shared_dir
from ..operators import detail as B
from ..operators import query as Q
from ..operators import rollups as R
from ..operators import text_index as X
from ..operators.template_store import TemplateStore
from ..sources import datasource, json_index
from ..sources.testdata import WITH_EVENTS, WITH_LINES, log_events, log_lines
from .catalog import _LINE_PATTERN, _STORE, RULES, _read, query
from . import catalog


def _new(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources ----------------------------------------------------------------------------------------------------------------------


@query(f"{WITH_LINES} SELECT event_id, content, false AS is_blank, count(*) OVER () AS lines_of_all_files FROM log_lines")
def q_logs_source(spark, sf_dir):
    """Lines written as text files and read by the "logs" source; the last numbers of the files add up to all lines."""
    path = _new(spark, "logs")
    log_lines(spark, sf_dir).select(F.concat_ws(" ", F.col("event_id").cast("string"), "content").alias("value")).write.text(path)
    lines = datasource.read_logs(spark, path)
    number = lines.groupBy("file").agg(F.max("line_number").alias("last")).agg(F.sum("last").alias("lines_of_all_files"))
    at = F.instr("content", " ")
    own = lines.select(F.substring("content", F.lit(1), at - 1).cast("long").alias("event_id"), F.substring("content", at + 1, F.length("content")).alias("content"), "is_blank")
    return own.crossJoin(number)  # one row


_DOCUMENT = 2000


@query(f"""{WITH_EVENTS} SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id // {_DOCUMENT} ORDER BY event_id) AS BIGINT) AS line_number, username, host, CAST(source_port AS BIGINT) AS source_port
FROM log_events""")
def q_json_records(spark, sf_dir):
    """Events in JSON documents of a list each, cut into records again."""
    path = _new(spark, "documents")
    # quotes, commas and brackets within the texts
    host = F.concat(F.lit('a "list", ['), "host", F.lit("] of {"))
    rows = log_events(spark, sf_dir).select((F.floor(F.col("event_id") / _DOCUMENT)).alias("doc"), F.struct("event_id", "username", host.alias("host"), F.array(F.struct("source_port")).alias("ports")).alias("e"))
    docs = rows.groupBy("doc").agg(F.sort_array(F.collect_list("e")).alias("events"))
    text = F.to_json(F.struct(F.struct("doc", F.array(F.lit("x, y"), F.lit("[")).alias("tags")).alias("meta"), "events"))
    docs.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    get = lambda p: F.get_json_object("content", p)
    host = F.substring_index(F.substring_index(get("$.host"), "[", -1), "]", 1)
    return json_index.read_json(spark, path, 1 << 16).select(
        get("$.event_id").cast("long").alias("event_id"), "line_number", get("$.username").alias("username"), host.alias("host"), get("$.ports[0].source_port").cast("long").alias("source_port"))


# --- keyed tables -----------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT user_id AS dedup_key, count(*) AS risk_score, max(event_id) AS last_event FROM events WHERE event_id % 2 = 0 GROUP BY 1),
b AS (SELECT user_id AS dedup_key, count(*) AS risk_score, max(event_id) AS last_event FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT dedup_key, coalesce(b.risk_score, a.risk_score) AS risk_score, coalesce(greatest(a.last_event, b.last_event), a.last_event, b.last_event) AS last_event,
    CASE WHEN a.dedup_key IS NULL THEN 'NEW' ELSE 'ACKNOWLEDGED' END AS status, coalesce(a.risk_score, 0) + coalesce(b.risk_score, 0) AS seen FROM a FULL JOIN b USING (dedup_key)""")
def q_alert_store(spark, sf_dir):
    """Two batches of alerts through a keyed table, the second one three times: the status stays, the newest score counts, numbers add up once."""
    e = _read(spark, sf_dir, "events")
    batch = lambda n, status: e.where(F.col("event_id") % n == 0).groupBy(F.col("user_id").alias("dedup_key")).agg(F.count("*").alias("risk_score"), F.max("event_id").alias("last_event"), F.lit(status).alias("status"), F.count("*").alias("seen"))
    table = KeyedTable(spark, _new(spark, "alerts"), "dedup_key", 16)
    changes = {"status": "old", "last_event": "max", "seen": "sum"}
    for number, rows in ((0, batch(2, "ACKNOWLEDGED")), (1, batch(3, "NEW")), (1, batch(3, "NEW")), (0, batch(2, "NEW"))):
        table.upsert(rows, "detection", number, changes)
    return table.read()


_FIRST = "event_id % 2 = 0 AND source <> 'app'"
_TOKENS = "regexp_extract_all(content, '\\S+')"
#: Templates of the first lines; the new lines that one of them fits, by the most literals; templates of the others.
_KNOWN_SQL = f"""old AS ({_STORE.replace("@@", _FIRST)} SELECT template_key, nth, pattern, string_split(pattern, ' ') AS p, len(list_filter(string_split(pattern, ' '), lambda x: x <> '<*>')) AS literals, occurrences FROM tk),
l AS (SELECT event_id, content, source, {_TOKENS} AS t FROM log_lines WHERE NOT ({_FIRST})),
f AS (SELECT event_id, template_key FROM l JOIN old ON len(l.t) = len(old.p) AND len(list_filter(list_zip(old.p, l.t), lambda z: z[1] <> '<*>' AND z[1] <> z[2])) = 0
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY literals DESC, nth) = 1),
r AS (SELECT event_id FROM l WHERE event_id NOT IN (SELECT event_id FROM f)),
n AS ({_STORE.replace("@@", "event_id IN (SELECT event_id FROM r)")} SELECT pattern, occurrences, 'TPL-' || lpad(CAST(nth + (SELECT count(*) FROM old) AS VARCHAR), CAST(greatest(4, length(CAST(nth + (SELECT count(*) FROM old) AS VARCHAR))) AS INTEGER), '0') AS template_key FROM tk)"""


@query(f"""{WITH_LINES}, {_KNOWN_SQL} SELECT template_key, old.pattern, CAST(old.occurrences + coalesce(m.n, 0) AS BIGINT) AS occurrences FROM old LEFT JOIN (SELECT template_key, count(*) AS n FROM f GROUP BY 1) m USING (template_key)
UNION ALL SELECT template_key, pattern, occurrences FROM n""")
def q_template_runs(spark, sf_dir):
    """A store after a run over some lines, and one over all: known templates count more lines and keep their keys, the others follow."""
    return _runs(spark, sf_dir).templates.read().select("template_key", "pattern", "occurrences")


@query(f"""{WITH_LINES}, {_KNOWN_SQL} SELECT event_id, template_key, content AS restored FROM f JOIN log_lines USING (event_id)""")
def q_template_known(spark, sf_dir):
    """The new lines that templates of an earlier run fit, put together again from the store."""
    from ..operators import templates as T

    store = _runs(spark, sf_dir)
    # what the second run matched to templates of the first
    first = store.first.select("template_key")
    new = log_lines(spark, sf_dir).where(f"NOT ({_FIRST})").select("event_id")
    return T.reconstruct(store.payloads().join(first, "template_key", "left_semi").join(new, "event_id", "left_semi")).select("event_id", "template_key", "restored")


def _runs(spark, sf_dir) -> TemplateStore:
    lines = log_lines(spark, sf_dir)
    store = TemplateStore(spark, _new(spark, "templates"))
    store.run(lines.where(_FIRST), 0)
    store.first = store.templates.read()
    store.run(lines, 1)
    store.run(lines, 1)
    return store


# --- indexes, sketches, evidence ----------------------------------------------------------------------------------------------------


@query(catalog.SQL["q_search_text"].replace("st-3", "user77").replace("contains(lower(host)", "contains(lower('of ' || username || ' at ' || source_ip), 'user77') OR contains(lower(host)"))
def q_search_index(spark, sf_dir):
    """A search through the postings, over texts with a message."""
    path = _new(spark, "text")
    events = log_events(spark, sf_dir).withColumn("message", F.concat(F.lit("of "), "username", F.lit(" at "), "source_ip"))
    X.write(events, path, 8)
    return X.search(spark, path, Q.EventQuery(text="USER77")).select(*catalog._KEEP)


@query(f"""{WITH_EVENTS}, h AS (SELECT date_trunc('day', ts) AS bucket, source, count(*) AS n, count(DISTINCT username) AS u, count(source_port) AS c FROM log_events GROUP BY 1, 2)
SELECT CAST(bucket AS TIMESTAMP) AS bucket, source, n, c AS ports, true AS users_fit, true AS median_fits, true AS p95_fits FROM h""")
def q_rollups(spark, sf_dir):
    """Days and sources from sketches of minutes: exact numbers, and whether distinct users and percentiles are within the stated error of a direct pass."""
    events = log_events(spark, sf_dir)
    minutes = R.sketched(events, ["source", "host"], ["username"], ["source_port"])
    days = R.merged(R.merged(minutes, ["source"], "hour"), ["source"], "day")
    days = days.select("bucket", "source", "n", F.col("c_source_port").alias("ports"), R.distinct_count("username"), R.percentile("source_port", 0.5).alias("p50"), R.percentile("source_port", 0.95).alias("p95"))
    day = F.date_trunc("day", "timestamp").alias("bucket")
    true = events.groupBy(day, "source").agg(F.count_distinct("username").alias("u"), F.count("source_port").alias("c"))
    at = lambda p: (F.count_if(F.col("source_port") < F.col(p)).alias(f"under_{p}"), F.count_if(F.col("source_port") <= F.col(p)).alias(f"upto_{p}"))
    ranks = events.withColumn("bucket", F.date_trunc("day", "timestamp")).join(days.select("bucket", "source", "p50", "p95"), ["bucket", "source"]).groupBy("bucket", "source").agg(*at("p50"), *at("p95"))
    both = days.join(true, ["bucket", "source"]).join(ranks, ["bucket", "source"])
    slack = 2 * R.ERROR * F.col("c") + 1  # ranks are whole numbers
    fits = lambda p, q: (F.col(f"under_{p}") <= q * F.col("c") + slack) & (F.col(f"upto_{p}") >= q * F.col("c") - slack)
    users = F.abs(F.col("n_username") - F.col("u")) <= 4 * 1.04 / 2 ** (R.LG_K / 2) * F.col("u") + 1
    return both.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "source", "n", "ports", users.alias("users_fit"), fits("p50", 0.5).alias("median_fits"), fits("p95", 0.95).alias("p95_fits"))


_EVIDENCE = f"""{catalog._NEAR.replace("n AS (", "unused AS (", 1)}, e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'udp' WHEN event_id % 7 > 0 THEN 'tcp' END AS protocol FROM log_events),
x AS (SELECT h.entity, h.center, e.*, abs(epoch_us(ts) - epoch_us(center)) AS gap FROM h JOIN e ON e.source_ip = h.entity WHERE abs(epoch_us(ts) - epoch_us(center)) <= 3600000000),
k AS (SELECT *, row_number() OVER (PARTITION BY entity, center ORDER BY gap, event_id) AS nth FROM x QUALIFY nth <= 25),
p AS (SELECT entity, center, destination_port AS port FROM k WHERE destination_port IS NOT NULL GROUP BY entity, center, destination_port QUALIFY row_number() OVER (PARTITION BY entity, center ORDER BY count(*) DESC, destination_port) = 1),
q AS (SELECT entity, center, protocol FROM k WHERE protocol IS NOT NULL GROUP BY entity, center, protocol QUALIFY row_number() OVER (PARTITION BY entity, center ORDER BY count(*) DESC, protocol) = 1)
SELECT 'source_ip=' || entity AS dedup_key, t.events, s.nearest, s.farthest, p.port, q.protocol, s.usernames, s.hosts, s.verdicts FROM
(SELECT entity, center, count(*) AS events FROM x GROUP BY ALL) t JOIN
(SELECT entity, center, string_agg(event_id, ',' ORDER BY nth) AS nearest, max(gap) AS farthest, string_agg(DISTINCT username, ',' ORDER BY username) AS usernames, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts,
    coalesce(string_agg(DISTINCT CASE WHEN event_id % 9 = 0 THEN 'SUSPICIOUS' WHEN event_id % 10 = 0 THEN 'WEAPONIZED_LOG' END, ',' ORDER BY CASE WHEN event_id % 9 = 0 THEN 'SUSPICIOUS' WHEN event_id % 10 = 0 THEN 'WEAPONIZED_LOG' END), '') AS verdicts FROM k GROUP BY ALL) s USING (entity, center)
LEFT JOIN p USING (entity, center) LEFT JOIN q USING (entity, center)"""


@query(_EVIDENCE)
def q_evidence(spark, sf_dir):
    """One row per incident of an address: what happened next to it."""
    events = log_events(spark, sf_dir).withColumns({"protocol": F.when(F.col("event_id") % 3 == 0, "udp").when(F.col("event_id") % 7 > 0, "tcp"), "raw_log_id": F.col("event_id")})
    verdict = F.when(F.col("event_id") % 9 == 0, "SUSPICIOUS").when(F.col("event_id") % 10 == 0, "WEAPONIZED_LOG")
    security = events.select("raw_log_id", verdict.alias("verdict")).where("verdict IS NOT NULL")
    hits = catalog.D.failed_then_passed(events, RULES["RULE_6"]).where("kind = 'source_ip'")
    alerts = hits.select(F.concat_ws("=", "kind", "entity").alias("dedup_key"), "kind", "entity", "center")
    text = lambda c: F.array_join(c, ",").alias(c)
    nearest = F.array_join(F.transform("nearest", lambda x: x["event_id"].cast("string")), ",").alias("nearest")
    return B.evidence(alerts, events, security, 3600).select("dedup_key", "events", nearest, F.element_at("nearest", -1)["gap"].alias("farthest"), "port", "protocol", text("usernames"), text("hosts"), text("verdicts"))


# --- what stages said -----------------------------------------------------------------------------------------------------------------

#: Some lines of the other kinds with a fault for each stage: an address and a port that are none, a number that is none.
_FAULTS = [("event_id % 24 = 2", "srcip=", "srcip=999."), ("event_id % 24 = 14", "dstport=22", "dstport=ssh"), ("event_id % 24 = 3", '"n":', '"statuscode":"x","n":')]


@query(f"""{catalog._MIXED_SQL}, w AS (SELECT event_id, kind, disposition, source_ip FROM x WHERE disposition NOT IN ('DUPLICATE') AND kind <> 8)
SELECT event_id, 'security_shield' AS stage, 'error' AS status, 'WEAPONIZED_LOG: log4shell, template_injection' AS message FROM w WHERE kind = 9
UNION ALL SELECT event_id, 'format_detection', 'warn', 'low-confidence format detection' FROM w WHERE kind IN (10, 11)
UNION ALL SELECT event_id, 'parsing', 'warn', 'no structured parser matched; raw fallback used' FROM w WHERE kind IN (10, 11)
UNION ALL SELECT event_id, 'cleaning', 'warn', 'source_ip: ''999.' || source_ip || ''' is not a valid IP address' FROM w WHERE event_id % 24 = 2
UNION ALL SELECT event_id, 'cleaning', 'warn', 'destination_port: ''ssh'' is not a valid port' FROM w WHERE event_id % 24 = 14
UNION ALL SELECT event_id, 'normalization', 'warn', 'response_code: ''x'' is not an integer, dropped' FROM w WHERE event_id % 24 = 3
UNION ALL SELECT event_id, 'validation', 'error', 'schema validation failed: response_code: 999 is above 599' FROM w WHERE kind = 1 AND event_id % 5 = 0""")
def q_stage_errors(spark, sf_dir):
    """What each stage said about lines that fail in it."""
    from ..operators import pipeline as L
    from ..operators import stages as S
    from ..sources.testdata import raw_logs

    lines = raw_logs(spark, sf_dir, mixed=True)
    text = F.col("content")
    for where, old, new in _FAULTS:
        text = F.when(F.expr(where.replace("event_id", "line_number")), F.replace(text, F.lit(old), F.lit(new))).otherwise(text)
    done = S.reported(L.processed(lines.withColumn("content", text), catalog.CFG))
    return S.problems(done, "line_number").withColumnRenamed("line_number", "event_id")


# --- spellings, totals, reports, previews ---------------------------------------------------------------------------------------------


@query("""SELECT event_id, '2001:db8:' || CASE WHEN event_id % 65536 = 0 THEN ':' ELSE ':' || lower(printf('%x', event_id % 65536)) END AS one, CASE WHEN user_id = 0 THEN '::' ELSE lower(printf('%x', user_id)) || '::1:0:0:' || lower(printf('%x', event_id % 7 + 1)) END AS two,
    '10.0.0.' || event_id % 200 AS three FROM events""")
def q_canonical_ip(spark, sf_dir):
    """Addresses in several spellings, each in its one spelling."""
    from ..functions.columns import canonical_ip

    e = _read(spark, sf_dir, "events")
    low = F.hex(F.col("event_id") % 65536)
    one = F.concat(F.lit("2001:0DB8:0:00:000:0000:0:"), F.lpad(low, 4, "0"))
    two = F.when(F.col("user_id") == 0, "0:0:0:0::0").otherwise(F.concat(F.hex("user_id"), F.lit(":0:0:0:1:0:0:"), F.hex(F.col("event_id") % 7 + 1)))
    return e.select("event_id", canonical_ip(one).alias("one"), canonical_ip(two).alias("two"), canonical_ip(F.concat(F.lit(" 10.0.0."), (F.col("event_id") % 200).cast("string"))).alias("three"))


@query(f"""{WITH_EVENTS}, v AS (SELECT host AS value, count(*) AS n FROM log_events GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS turn FROM v)
SELECT 0 AS turn, NULL AS value, count(*) AS n, count(DISTINCT host) AS "values" FROM log_events UNION ALL SELECT CAST(turn AS INTEGER), value, n, NULL FROM t WHERE turn <= 3""")
def q_top_sources(spark, sf_dir):
    return Q.top_with_total(log_events(spark, sf_dir), "host", 3)


@query(f"""{WITH_LINES}, s AS (SELECT unnest(['linux', 'firewall', 'nowhere']) AS source), r AS (SELECT s.source, count(event_id) AS records, CAST(coalesce(sum(strlen(content)), 0) AS BIGINT) AS original_bytes FROM s LEFT JOIN log_lines USING (source) GROUP BY 1),
t AS ({_STORE.replace("@@", "source = 'linux'")} SELECT 'linux' AS source, count(*) AS templates FROM tk UNION ALL SELECT * FROM ({_STORE.replace("@@", "source = 'firewall'")} SELECT 'firewall', count(*) FROM tk))
SELECT CAST(NULL AS VARCHAR) AS job, source, records, original_bytes, records AS reconstructable, coalesce(templates, 0) AS templates, CASE WHEN records > 0 THEN 100.0::DOUBLE ELSE 0.0 END AS reconstruction_rate, true AS lossless FROM r LEFT JOIN t USING (source)""")
def q_scope_reports(spark, sf_dir):
    from ..operators import templates as T

    done = T.reports(log_lines(spark, sf_dir), [{"source": s} for s in ("linux", "firewall", "nowhere")])
    return done.select("job", "source", "records", "original_bytes", "reconstructable", "templates", "reconstruction_rate", "lossless")


@query(f"""{WITH_EVENTS}, p AS (SELECT event_id FROM log_events WHERE host = 'host-1' ORDER BY ts DESC, event_id LIMIT 40)
SELECT (SELECT count(*) FROM log_events WHERE host = 'host-1') AS total, '1.0' AS schema_version, 40 AS listed, (SELECT string_agg(event_id, ',') FROM (SELECT event_id FROM log_events WHERE host = 'host-1' ORDER BY ts DESC, event_id LIMIT 40)) AS ids""")
def q_envelope_page(spark, sf_dir):
    from ..operators import export as E

    done = E.envelope_page(log_events(spark, sf_dir), Q.EventQuery(equal={"host": "host-1"}, limit=40))
    parsed = F.from_json("envelope", "schema_version string, total long, events array<struct<event:struct<id:string>>>")
    ids = F.transform("e.events", lambda x: x["event"]["id"])
    return done.withColumn("e", parsed).select(F.col("e.total").alias("total"), "e.schema_version", F.size(ids).alias("listed"), F.array_join(ids, ",").alias("ids"))


@query(f"""{WITH_EVENTS} SELECT event_id, field, value, value AS kept, CASE field WHEN 'source_ip' THEN split_part(value, '.', 1) || '.' || split_part(value, '.', 2) || '.x.x' ELSE left(value, 1) || '***' END AS masked
FROM (SELECT event_id, unnest(['source_ip', 'username']) AS field, unnest([source_ip, username]) AS value FROM log_events)""")
def q_privacy_preview(spark, sf_dir):
    from ..operators import normalize as N

    cfgs = {"kept": N.PiiConfig(), "masked": N.PiiConfig(mode="MASK")}
    return N.preview(log_events(spark, sf_dir).select("event_id", "source_ip", "username"), cfgs)
