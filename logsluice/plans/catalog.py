"""The registered queries of the log engine, each with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.store import cut
from ..operators import detail as B
from ..operators import detect as D
from ..operators import export as X
from ..operators import incidents as I
from ..operators import normalize as N
from ..operators import packs as K
from ..operators import parsers as P
from ..operators import pipeline as L
from ..operators import query as Q
from ..operators import shield as S
from ..operators import templates as T
from ..sources import files
from ..sources.testdata import REFERENCE, WITH_EVENTS, WITH_LINES, WITH_MIXED, dealt, log_events, log_lines, raw_logs

CFG = L.PipelineConfig(reference=REFERENCE)
HASHED = N.PiiConfig(mode="DETERMINISTIC_HASH", key="test-pii-key", kinds=("ip", "email", "username", "host"))
RULES = {k: D.Rule(k, D.RULE[k].name, D.RULE[k].severity, t, w) for k, (t, w) in {"RULE_1": (5, 86_400), "RULE_2": (3, 86_400), "RULE_3": (3, 600), "RULE_4": (2, 864_000), "RULE_5": (1, 86_400), "RULE_6": (4, 300), "RULE_8": (5, 3_600)}.items()}
SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ntz(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


# --- scan, hash, shield -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def q_content_hash(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", L.content_hash("text").alias("content_hash"))


def _screened(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    pages = _read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("content"))
    return S.screen(docs.unionByName(pages))


_TEXTS = "WITH t AS (SELECT 'document' AS kind, doc_id AS id, coalesce(text, '') AS c FROM documents UNION ALL SELECT 'page', page_id, coalesce(html, '') FROM pages)"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_FLAGS = ", ".join(f"regexp_matches(c, '{_quoted(p)}') AS {n}" for n, p, _, _ in S.CHECKS)
_VERDICT = f"""{_TEXTS}, f AS (SELECT kind, id, length(c) > 32768 AS oversize_line, regexp_matches(c, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1a\\x1c-\\x1f\\x7f]') AS dangerous_control_chars,
    regexp_matches(c, '{S.ESCAPES}') AS terminal_escape_sequence, {_FLAGS} FROM t)"""
_HIGH = "crlf_injection::INT + template_injection::INT + format_string::INT + literal_escape_seq::INT + xxe::INT + dangerous_control_chars::INT + terminal_escape_sequence::INT"


@query(f"{_VERDICT} SELECT kind, id, oversize_line, {', '.join(n for n, *_ in S.CHECKS)} FROM f")
def q_shield_flags(spark, sf_dir):
    names = ["oversize_line", *[n for n, *_ in S.CHECKS]]
    types = F.transform("indicators", lambda i: i["type"])
    return _screened(spark, sf_dir).select("kind", "id", *[F.array_contains(types, n).alias(n) for n in names])


@query(f"""{_VERDICT}, v AS (SELECT *, {_HIGH} AS high, (log4shell::INT) AS crit, oversize_line::INT AS med, (script_tag OR event_html OR sql_injection OR path_traversal OR shell_metachars) AS payload FROM f)
SELECT kind, id, CASE WHEN crit > 0 OR (high > 0 AND high + med >= 2) THEN 'WEAPONIZED_LOG' WHEN high + med > 0 OR payload THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict, high + med + crit > 0 AS quarantine FROM v""")
def q_shield_verdict(spark, sf_dir):
    return _screened(spark, sf_dir).select("kind", "id", "verdict", "quarantine")


@query("SELECT doc_id, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def q_dedup(spark, sf_dir):
    raw = _read(spark, sf_dir, "documents").select(F.lit("job").alias("job_id"), F.col("doc_id").alias("line_number"), F.col("text").alias("content"))
    return L.duplicates(raw).select(F.col("line_number").alias("doc_id"), "duplicate")


# --- parsers ------------------------------------------------------------------------------------------------------------------


def _parsed(spark, sf_dir):
    return P.parse(P.detect(log_lines(spark, sf_dir)))


def _fields(df, parser, names):
    return df.where(F.col("parser") == parser).select("event_id", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names])


def _groups(pattern, names):
    return ", ".join(f"nullif(regexp_extract(content, '{_quoted(pattern)}', {i}), '') AS {n}" for i, n in enumerate(names, 1))


@query(f"{WITH_LINES} SELECT event_id, CASE source WHEN 'linux' THEN 'LINUX_AUTH' WHEN 'firewall' THEN 'FIREWALL' WHEN 'web' THEN 'APACHE_COMBINED' ELSE 'JSON' END AS format, CAST(1.0 AS DOUBLE) AS format_confidence FROM log_lines")
def q_format_detect(spark, sf_dir):
    return P.detect(log_lines(spark, sf_dir)).select("event_id", "format", "format_confidence")


@query(f"{WITH_LINES} SELECT source, CASE source WHEN 'linux' THEN 'LINUX_AUTH' WHEN 'firewall' THEN 'FIREWALL' WHEN 'web' THEN 'APACHE_COMBINED' ELSE 'JSON' END AS format, CAST(1.0 AS DOUBLE) AS confidence FROM log_lines GROUP BY source")
def q_file_format(spark, sf_dir):
    return P.file_format(log_lines(spark, sf_dir), ["source"], order="event_id")


@query(f"""{WITH_LINES}, x AS (SELECT event_id, {_groups(P.AUTH, P.AUTH_NAMES)}, content FROM log_lines WHERE source = 'linux')
SELECT event_id, "timestamp", host, process, pid, message, regexp_extract(message, 'for (\\S+) from', 1) AS username, regexp_extract(message, 'from (\\S+) port', 1) AS source_ip,
    regexp_extract(message, 'port (\\d+)', 1) AS source_port, 'login' AS action, CASE WHEN message LIKE 'Failed%' THEN 'failure' ELSE 'success' END AS status, 'ssh' AS service FROM x""")
def q_parse_sshd(spark, sf_dir):
    return _fields(_parsed(spark, sf_dir), "linux_auth", [*P.AUTH_NAMES, "username", "source_ip", "source_port", "action", "status", "service"])


@query(f"""{WITH_LINES}, x AS (SELECT event_id, {_groups(P.APACHE, P.WEB_NAMES[:9])} FROM log_lines WHERE source = 'web')
SELECT *, 'http' AS service, 'tcp' AS protocol, CASE WHEN response_code >= '500' THEN 'high' WHEN response_code >= '400' THEN 'medium' END AS severity,
    CASE WHEN response_code >= '400' THEN 'failure' ELSE 'success' END AS status FROM x""")
def q_parse_apache(spark, sf_dir):
    return _fields(_parsed(spark, sf_dir), "apache", [*P.WEB_NAMES[:9], "service", "protocol", "severity", "status"])


@query(f"""{WITH_LINES} SELECT event_id, regexp_extract(content, 'SRC=(\\S+)', 1) AS source_ip, regexp_extract(content, 'DST=(\\S+)', 1) AS destination_ip, lower(regexp_extract(content, 'PROTO=(\\S+)', 1)) AS protocol,
    regexp_extract(content, 'SPT=(\\d+)', 1) AS source_port, regexp_extract(content, 'DPT=(\\d+)', 1) AS destination_port, 'eth0' AS in_if,
    CASE WHEN content LIKE '% DROP %' THEN 'deny' ELSE 'allow' END AS action, CASE WHEN content LIKE '% DROP %' THEN 'blocked' ELSE 'allowed' END AS status,
    CASE WHEN content LIKE '% DROP %' THEN 'medium' ELSE 'info' END AS severity, CASE WHEN content LIKE '% DROP %' THEN 'connection_denied' ELSE 'connection_allowed' END AS event_type FROM log_lines WHERE source = 'firewall'""")
def q_parse_iptables(spark, sf_dir):
    return _fields(_parsed(spark, sf_dir), "firewall", ["source_ip", "destination_ip", "protocol", "source_port", "destination_port", "in_if", "action", "status", "severity", "event_type"])


@query(f"""{WITH_LINES} SELECT event_id, json_extract_string(content, '$.ts') AS "timestamp", CASE json_extract_string(content, '$.level') WHEN 'notice' THEN 'low' WHEN 'warn' THEN 'medium' WHEN 'error' THEN 'high' ELSE 'info' END AS severity,
    json_extract_string(content, '$.logger') AS process, json_extract_string(content, '$.event') AS event_type, json_extract_string(content, '$.user') AS username,
    json_extract_string(content, '$.src_ip') AS source_ip, json_extract_string(content, '$.msg') AS message FROM log_lines WHERE source = 'app'""")
def q_parse_json(spark, sf_dir):
    return _fields(_parsed(spark, sf_dir), "json", ["timestamp", "severity", "process", "event_type", "username", "source_ip", "message"])


@query(f"{WITH_EVENTS} SELECT event_id, username, CAST(event_id % 7 AS VARCHAR) AS kv_n, CAST(coalesce(response_code, 0) AS VARCHAR) AS response_code, 'two words' AS message FROM log_events")
def q_parse_kv(spark, sf_dir):
    lines = log_events(spark, sf_dir).select("event_id", F.concat(F.lit("user="), "username", F.lit(" n="), (F.col("event_id") % 7).cast("string"), F.lit(" status="), F.coalesce("response_code", F.lit(0)).cast("string"), F.lit(' msg="two words"')).alias("content"))
    return _fields(P.parse(P.detect(lines)), "keyvalue", ["username", "kv_n", "response_code", "message"])


@query(f"""{WITH_EVENTS} SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'cef' WHEN 1 THEN 'haproxy' ELSE 'postgresql' END AS parser,
    CASE WHEN event_id % 3 < 2 THEN source_ip END AS source_ip, CASE WHEN event_id % 3 = 0 THEN 'act' || (event_id % 4) END AS action,
    CASE WHEN event_id % 3 = 2 THEN username END AS username, CASE WHEN event_id % 3 = 1 THEN '401' END AS response_code,
    CASE event_id % 3 WHEN 0 THEN 'IDS' WHEN 1 THEN 'fe' ELSE 'postgresql' END AS service FROM log_events""")
def q_pack_parse(spark, sf_dir):
    e = dealt(spark, sf_dir, log_events(spark, sf_dir).select("event_id", "ts", "source_ip", "username"))
    at, n = F.date_format("ts", "MMM dd HH:mm:ss"), F.col("event_id") % 3
    cef = F.concat(at, F.lit(" siem CEF:0|V|IDS|1|7|probe|5|src="), "source_ip", F.lit(" act=act"), (F.col("event_id") % 4).cast("string"))
    web = F.concat(at, F.lit(" lb haproxy[7]: "), "source_ip", F.lit(":5000 ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss.SSS"), F.lit('] fe be/w 1/0/1/4/6 401 17 - - ---- 8/8/0/0/0 0/0 "GET /x HTTP/1.1"'))
    pg = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC [8] "), "username", F.lit("@db FATAL:  no"))
    lines = e.select("event_id", F.when(n == 0, cef).when(n == 1, web).otherwise(pg).alias("content"))
    parsers = K.registry(K.PACKS)
    df = P.parse(P.detect(lines, parsers=parsers), parsers=parsers)
    return df.select("event_id", "parser", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("source_ip", "action", "username", "response_code", "service")])


# --- clean, extract, protect, normalise -----------------------------------------------------------------------------------------


@query(f"""{WITH_EVENTS}, x AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '999.1.1.1' ELSE source_ip END AS ip, source_port * 2 AS port FROM log_events)
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ip END AS source_ip, CASE WHEN event_id % 7 = 0 THEN ip END AS source_ip_raw,
    CASE WHEN port <= 65535 THEN CAST(port AS VARCHAR) END AS source_port, CASE WHEN port > 65535 THEN CAST(port AS VARCHAR) END AS source_port_raw, 'a b' AS note FROM x""")
def q_clean_fields(spark, sf_dir):
    ip = F.when(F.col("event_id") % 7 == 0, "999.1.1.1").otherwise(F.col("source_ip"))
    raw = F.create_map(F.lit("source_ip"), F.concat(F.lit(" "), ip), F.lit("source_port"), (F.col("source_port") * 2).cast("string"), F.lit("note"), F.lit(' "a   b" '), F.lit("none"), F.lit("  "))
    df = N.cleaned(log_events(spark, sf_dir).select("event_id", raw.alias("fields")), REFERENCE)
    return df.select("event_id", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("source_ip", "source_ip_raw", "source_port", "source_port_raw", "note")])


@query(f"""SELECT doc_id, nullif(regexp_extract(text, '{N.EMAIL}'), '') AS email, regexp_extract_all(text, '{N.ADDRESS}')[1] AS source_ip, regexp_extract_all(text, '{N.ADDRESS}')[2] AS destination_ip,
    nullif(regexp_extract(text, '{_quoted(N.URL)}'), '') AS url, nullif(regexp_extract(text, '{N.MAC}'), '') AS mac_address FROM documents""")
def q_extract_entities(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("fields"), F.lit(0.9).alias("parse_confidence"))
    return N.extracted(docs).select("doc_id", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("email", "source_ip", "destination_ip", "url", "mac_address")])


def _hmac_sql(kind: str, column: str) -> str:
    key = HASHED.key.encode().ljust(64, b"\0")
    pads = ["".join(f"\\x{b ^ p:02X}" for b in key) for p in (0x36, 0x5C)]
    inner = f"unhex(sha256('{pads[0]}'::BLOB || encode('global:{kind}:' || lower(trim({column})))))"
    return f"'{N.PREFIX[kind]}_' || upper(left(sha256('{pads[1]}'::BLOB || {inner}), 6))"


@query(f"{WITH_EVENTS} SELECT event_id, {_hmac_sql('ip', 'source_ip')} AS source_ip, {_hmac_sql('username', 'username')} AS username, {_hmac_sql('host', 'host')} AS host, 'DETERMINISTIC_HASH' AS pii_mode, true AS pii_protected FROM log_events")
def q_pii_hash(spark, sf_dir):
    return N.protect(log_events(spark, sf_dir), HASHED).select("event_id", "source_ip", "username", "host", "pii_mode", "pii_protected")


@query(f"{WITH_EVENTS} SELECT event_id, regexp_replace(source_ip, '^(\\d+\\.\\d+)\\..*$', '\\1.x.x') AS source_ip, left(username, 1) || '***' AS username, 'u***@example.org' AS email FROM log_events")
def q_pii_mask(spark, sf_dir):
    df = log_events(spark, sf_dir).withColumn("email", F.concat("username", F.lit("@example.org")))
    return N.protect(df, N.PiiConfig(mode="MASK")).select("event_id", "source_ip", "username", "email")


@query(f"""{WITH_EVENTS} SELECT event_id, date_trunc('second', ts) AS "timestamp", source_ip, username, source_port, response_code, source, CASE WHEN source = 'app' THEN 'purchase' ELSE event_type END AS event_type,
    severity, action, status, CASE WHEN source IN ('linux', 'firewall') THEN CASE WHEN source = 'linux' THEN host END END AS host FROM (SELECT event_id, ts, source_ip, CASE WHEN source = 'firewall' THEN NULL ELSE username END AS username,
    CASE WHEN source IN ('linux', 'firewall') THEN source_port END AS source_port, response_code, source, event_type, severity, action, status, host FROM log_events)""")
def q_normalize(spark, sf_dir):
    names = ("timestamp", "source_ip", "username", "source_port", "response_code", "event_type", "severity", "action", "status", "host")
    done = L.processed(raw_logs(spark, sf_dir), CFG, ("line_number", "source_name", *names))
    return done.select(F.col("line_number").alias("event_id"), _ntz("timestamp"), "source_ip", "username", "source_port", "response_code", F.col("source_name").alias("source"), "event_type", "severity", "action", "status", "host")


@query(f"""{WITH_EVENTS} SELECT event_id, CASE source WHEN 'linux' THEN 0.979 WHEN 'firewall' THEN 0.965 WHEN 'web' THEN 0.972 ELSE 0.965 END AS confidence, 'ok' AS processing_status, true AS valid FROM log_events""")
def q_confidence(spark, sf_dir):
    return L.processed(raw_logs(spark, sf_dir), CFG, ("line_number", "confidence", "processing_status", "valid")).withColumnRenamed("line_number", "event_id")


@query(f"{WITH_EVENTS} SELECT event_id, level, CASE level WHEN 'notice' THEN 'low' WHEN 'warn' THEN 'medium' WHEN 'error' THEN 'high' ELSE 'info' END AS severity FROM log_events")
def q_severity_map(spark, sf_dir):
    return log_events(spark, sf_dir).select("event_id", "level", N.severity_of(F.col("level")).alias("severity"))


_NAMES = ["Login Failed", "logon", "deny", "authentication_failure", "HTTP", "something else"]


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'authentication_failure' WHEN 1 THEN 'authentication_success' WHEN 2 THEN 'connection_denied' WHEN 3 THEN 'authentication_failure' WHEN 4 THEN 'http_request' ELSE 'something_else' END AS event_type FROM events")
def q_event_type_map(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("event_id") % 6 + 1).cast("int"))
    return _read(spark, sf_dir, "events").select("event_id", N.event_type_of(name).alias("event_type"))


@query(f"""{WITH_EVENTS} SELECT 'job-1' AS job_id, count(*) AS total_records, count(*) AS processed_records, 0 AS invalid_records, 0 AS duplicate_records, 0 AS quarantined_records FROM log_events""")
def q_job_summary(spark, sf_dir):
    return L.job_summary(L.processed(raw_logs(spark, sf_dir), CFG, L.COUNTED))


@query()
def q_trace(spark, sf_dir):
    return L.trace(raw_logs(spark, sf_dir), CFG)


# Lines of the other kinds, with what each has to become by its own definition: the SQL reads no line.
_MIXED_SQL = f"""{WITH_MIXED}, x AS (SELECT l.event_id, event_id % 12 AS kind, username, source_ip, ts, CASE WHEN event_id % 12 = 8 THEN 'INVALID' WHEN event_id % 12 = 10 AND event_id > (SELECT min(event_id) FROM log_events WHERE event_id % 12 = 10) THEN 'DUPLICATE'
    WHEN event_id % 12 = 9 THEN 'QUARANTINED' WHEN event_id % 12 = 1 AND event_id % 5 = 0 THEN 'INVALID' ELSE 'PROCESSED' END AS disposition FROM mixed_lines l JOIN log_events USING (event_id)),
y AS (SELECT event_id, disposition, CASE kind WHEN 0 THEN 'syslog' WHEN 1 THEN 'nginx' WHEN 2 THEN 'firewall' WHEN 3 THEN 'json' WHEN 10 THEN 'raw' WHEN 11 THEN 'raw' ELSE 'linux_auth' END AS parser,
    CASE kind WHEN 1 THEN 'http_request' WHEN 2 THEN 'connection_denied' WHEN 3 THEN 'authentication_failure' WHEN 4 THEN 'authentication_failure' WHEN 5 THEN 'privilege_escalation' WHEN 6 THEN 'authentication_failure'
        WHEN 7 THEN 'session_opened' ELSE 'generic' END AS event_type, CASE WHEN kind = 5 THEN 'root' WHEN kind IN (1, 3, 4, 6, 7) THEN username END AS username, CASE WHEN kind IN (1, 2, 3, 4, 6) THEN source_ip END AS source_ip,
    CASE kind WHEN 1 THEN 'medium' WHEN 2 THEN 'medium' WHEN 0 THEN 'critical' WHEN 5 THEN 'medium' END AS severity, CASE kind WHEN 1 THEN 'request' WHEN 2 THEN 'deny' WHEN 3 THEN 'login' WHEN 4 THEN 'login' WHEN 5 THEN 'sudo' WHEN 6 THEN 'login' WHEN 7 THEN 'login' END AS action FROM x)"""


@query(f"{_MIXED_SQL} SELECT event_id, disposition, CASE WHEN disposition = 'PROCESSED' THEN parser END AS parser, CASE WHEN disposition = 'PROCESSED' THEN event_type END AS event_type, CASE WHEN disposition = 'PROCESSED' THEN username END AS username, CASE WHEN disposition = 'PROCESSED' THEN source_ip END AS source_ip, CASE WHEN disposition = 'PROCESSED' THEN severity END AS severity, CASE WHEN disposition = 'PROCESSED' THEN action END AS action FROM y")
def q_mixed_lines(spark, sf_dir):
    names = ["parser", "event_type", "username", "source_ip", "severity", "action"]
    done = L.processed(raw_logs(spark, sf_dir, mixed=True), CFG, ("line_number", "disposition", *names))
    return done.select(F.col("line_number").alias("event_id"), "disposition", *[F.when(F.col("disposition") == "PROCESSED", F.col(n)).alias(n) for n in names])


@query(f"""{_MIXED_SQL} SELECT 'job-1' AS job_id, count(*) AS total_records, count(*) FILTER (disposition = 'PROCESSED') AS processed_records, count(*) FILTER (disposition = 'INVALID') AS invalid_records,
    count(*) FILTER (disposition = 'DUPLICATE') AS duplicate_records, count(*) FILTER (disposition = 'QUARANTINED') AS quarantined_records FROM y""")
def q_mixed_summary(spark, sf_dir):
    return L.job_summary(L.processed(raw_logs(spark, sf_dir, mixed=True), CFG, L.COUNTED))


@query(f"""{_MIXED_SQL}, c AS (SELECT count(*) AS total, count(*) FILTER (disposition = 'PROCESSED') AS processed, count(*) FILTER (disposition = 'INVALID') AS invalid, count(*) FILTER (disposition = 'DUPLICATE') AS duplicate,
    count(*) FILTER (disposition = 'QUARANTINED') AS quarantined FROM y)
SELECT unnest(['total', 'processed', 'invalid', 'duplicate', 'quarantined', 'events', 'protected', 'sources', 'success_rate']) AS card,
    unnest([total, processed, invalid, duplicate, quarantined, processed, 0, 1, round_even(100.0 * processed / total, 1)]::DOUBLE[]) AS value FROM c""")
def q_mixed_cards(spark, sf_dir):
    return X.overview(L.processed(raw_logs(spark, sf_dir, mixed=True), CFG, L.COUNTED))


@query(f"""{_MIXED_SQL}, e AS (SELECT 'by_parser' AS chart, parser AS label FROM y WHERE disposition = 'PROCESSED' UNION ALL SELECT 'by_event_type', event_type FROM y WHERE disposition = 'PROCESSED'
    UNION ALL SELECT 'by_severity', severity FROM y WHERE disposition = 'PROCESSED' AND severity IS NOT NULL UNION ALL SELECT 'by_source', 'mixed' FROM y WHERE disposition = 'PROCESSED' UNION ALL SELECT 'outcomes', lower(disposition) FROM y
    UNION ALL SELECT 'pii', 'not protected' FROM y WHERE disposition = 'PROCESSED') SELECT chart, label, count(*) AS value FROM e GROUP BY ALL""")
def q_charts(spark, sf_dir):
    return X.charts(L.processed(raw_logs(spark, sf_dir, mixed=True), CFG))


@query(f"""{_MIXED_SQL}, c AS (SELECT count(*) AS total, count(*) FILTER (disposition = 'PROCESSED') AS p, count(*) FILTER (disposition IN ('INVALID', 'DUPLICATE')) AS d, count(*) FILTER (disposition = 'PROCESSED' AND parser <> 'raw') AS ok FROM y),
a AS (SELECT count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS new, count(*) FILTER (event_id % 3 > 1) AS linked FROM events WHERE event_id < 500)
SELECT CAST(turn AS INTEGER) AS turn, node, records, status FROM (SELECT unnest(range(11)) AS turn, unnest(['sources', 'ingestion', 'detection', 'parsing', 'cleaning', 'pii', 'normalization', 'validation', 'correlation', 'risk', 'alert']) AS node,
    unnest([2, total, total, p, d, 0, p, ok, linked, n, new]::BIGINT[]) AS records, unnest(['ok', 'ok', 'warn', 'ok', 'warn', 'warn', 'ok', 'ok', 'ok', 'warn', 'critical']) AS status FROM c, a)""")
def q_pipeline_story(spark, sf_dir):
    alerts = _read(spark, sf_dir, "events").where("event_id < 500").select(F.when(F.col("event_id") % 2 == 0, "NEW").otherwise("RESOLVED").alias("status"), F.lit(70).alias("risk_score"), (F.col("event_id") % 3).alias("events"))
    return X.pipeline_story(L.processed(raw_logs(spark, sf_dir, mixed=True), CFG), alerts, 2).drop("label")


# --- search, facets, series -----------------------------------------------------------------------------------------------------

_KEEP = ["event_id", "source_ip", "host", "username", "event_type"]
_K = ", ".join(_KEEP)


@query(f"{WITH_EVENTS} SELECT {_K} FROM log_events WHERE contains(lower(host), 'st-3') OR contains(lower(username), 'st-3') OR contains(lower(source_ip), 'st-3')")
def q_search_text(spark, sf_dir):
    return Q.search(log_events(spark, sf_dir), Q.EventQuery(text="ST-3")).select(*_KEEP)


@query(f"{WITH_EVENTS} SELECT {_K} FROM log_events WHERE event_type = 'authentication_failure' AND host = 'host-1'")
def q_search_eq(spark, sf_dir):
    return Q.search(log_events(spark, sf_dir), Q.EventQuery(equal={"event_type": "authentication_failure", "host": "host-1", "action": None})).select(*_KEEP)


@query(f"{WITH_EVENTS} SELECT {_K} FROM log_events WHERE source_ip = '10.20.0.3' OR (event_type LIKE 'connection%' AND event_id % 5 = 2)")
def q_search_any_ip(spark, sf_dir):
    df = log_events(spark, sf_dir).withColumn("destination_ip", F.when(F.col("event_type").startswith("connection") & (F.col("event_id") % 5 == 2), "10.20.0.3"))
    return Q.search(df, Q.EventQuery(any_ip="10.20.0.3")).select(*_KEEP)


@query(f"{WITH_EVENTS} SELECT {_K} FROM log_events WHERE severity IN ('high', 'medium')")
def q_search_in(spark, sf_dir):
    return Q.search(log_events(spark, sf_dir), Q.EventQuery(within=("severity", ["high", "medium"]))).select(*_KEEP)


@query(f"{WITH_EVENTS} SELECT {_K} FROM log_events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 12:00:00'")
def q_search_time(spark, sf_dir):
    return Q.search(log_events(spark, sf_dir), Q.EventQuery(since="2024-01-05 00:00:00", until="2024-01-06 12:00:00")).select(*_KEEP)


@query(f"{WITH_EVENTS} SELECT {_K} FROM log_events WHERE source = 'linux' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20")
def q_page(spark, sf_dir):
    return Q.page(log_events(spark, sf_dir), Q.EventQuery(equal={"source": "linux"}, limit=50, offset=20)).select(*_KEEP)


@query(f"{WITH_EVENTS} SELECT {_K} FROM log_events WHERE event_id = 42")
def q_get(spark, sf_dir):
    return Q.get(log_events(spark, sf_dir), 42).select(*_KEEP)


@query(f"{WITH_EVENTS} SELECT event_id, event_type FROM log_events WHERE username = 'user3'")
def q_pseudonym_search(spark, sf_dir):
    stored = N.protect(log_events(spark, sf_dir), HASHED)
    q, _ = Q.pseudonymised(Q.EventQuery(equal={"username": "user3"}), HASHED)
    return Q.search(stored, q).select("event_id", "event_type")


@query(f"{WITH_EVENTS} SELECT source_ip AS value, count(*) AS n FROM log_events GROUP BY source_ip ORDER BY n DESC, value LIMIT 20")
def q_facet(spark, sf_dir):
    return Q.facet(log_events(spark, sf_dir), "source_ip")


_FACETS = ["severity", "host", "event_type", "source", "status", "action"]


@query(f"{WITH_EVENTS}, a AS (" + " UNION ALL ".join(f"SELECT '{n}' AS field, {n} AS value FROM log_events WHERE {n} IS NOT NULL" for n in _FACETS) + "), c AS (SELECT field, value, count(*) AS n FROM a GROUP BY field, value) SELECT field, value, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM c) WHERE r <= 20")
def q_facets_grouping_sets(spark, sf_dir):
    return Q.facets(log_events(spark, sf_dir), _FACETS)


@query(f"{WITH_EVENTS} SELECT username AS value, count(*) AS n FROM log_events GROUP BY username ORDER BY n DESC, value LIMIT 15")
def q_group_count(spark, sf_dir):
    return Q.facet(log_events(spark, sf_dir), "username", 15)


def _series(unit):
    def run(spark, sf_dir):
        return Q.timeseries(log_events(spark, sf_dir), unit)

    run.__name__ = f"q_timeseries_{unit}"
    query(f"SELECT date_trunc('{unit}', ts)::TIMESTAMP AS bucket, count(*) AS n FROM events GROUP BY 1")(run)


for _unit in ("minute", "hour", "day"):
    _series(_unit)


@query(f"{WITH_EVENTS} SELECT DISTINCT host AS value FROM log_events ORDER BY value LIMIT 200")
def q_distinct(spark, sf_dir):
    return Q.distinct_values(log_events(spark, sf_dir), "host")


# --- detection ------------------------------------------------------------------------------------------------------------------

_HIT_COLUMNS = ["rule_key", "severity", "kind", "entity", "n_events", "peak", "n_hosts", "n_users"]


def _hits(df):
    return df.select(*_HIT_COLUMNS, _ntz("center"))


def _peak_sql(rule, where, keys, kind, extra="", more=""):
    r, k = RULES[rule], ", ".join(keys)
    same = " AND ".join(f"b.{x} = c.{x}" for x in keys)
    return f"""{WITH_EVENTS}, e AS (SELECT * FROM log_events WHERE {where}), w AS (
    SELECT {k}, ts, count(*) OVER s AS n, min(ts) OVER s AS low FROM e WINDOW s AS (PARTITION BY {k} ORDER BY ts RANGE BETWEEN INTERVAL {r.window} SECONDS PRECEDING AND CURRENT ROW)),
b AS (SELECT {k}, max(n) AS peak, min(ts) FILTER (n = m) AS t, min(low) FILTER (n = m AND ts = t0) AS low FROM (SELECT *, max(n) OVER (PARTITION BY {k}) AS m, min(ts) FILTER (n = mm) OVER (PARTITION BY {k}) AS t0
    FROM (SELECT *, max(n) OVER (PARTITION BY {k}) AS mm FROM w)) GROUP BY {k}),
c AS (SELECT {k}, count(*) AS n_events, count(DISTINCT host) AS n_hosts, count(DISTINCT username) AS n_users FROM e GROUP BY {k})
SELECT '{rule}' AS rule_key, '{r.severity}' AS severity, '{kind}' AS kind, c.{keys[0]} AS entity, n_events, peak, n_hosts, n_users, {more}
    make_timestamp(CAST((epoch_us(low) + epoch_us(t)) // 2 AS BIGINT)) AS center FROM b JOIN c ON {same} WHERE {extra or f'peak >= {r.threshold}'}"""


@query(_peak_sql("RULE_1", "event_type = 'authentication_failure'", ["source_ip"], "source_ip"))
def q_rule1(spark, sf_dir):
    return _hits(D.failed_logins(log_events(spark, sf_dir), RULES["RULE_1"]))


@query(_peak_sql("RULE_2", "event_type = 'authentication_failure'", ["source_ip", "host"], "source_ip"))
def q_rule2(spark, sf_dir):
    return _hits(D.brute_force(log_events(spark, sf_dir), RULES["RULE_2"]))


@query(_peak_sql("RULE_3", "event_type = 'authentication_failure'", ["source_ip"], "source_ip", "n_hosts >= 3"))
def q_rule3(spark, sf_dir):
    return _hits(D.many_hosts(log_events(spark, sf_dir), RULES["RULE_3"]))


@query(_peak_sql("RULE_4", "event_type IN ('authentication_failure', 'authentication_success')", ["username"], "username"))
def q_rule4(spark, sf_dir):
    return _hits(D.login_frequency(log_events(spark, sf_dir), RULES["RULE_4"]))


@query(f"""{WITH_EVENTS}, d AS (SELECT source_ip, min(ts) AS center, count(*) AS peak FROM log_events WHERE event_type = 'connection_denied' GROUP BY source_ip)
SELECT 'RULE_5' AS rule_key, 'medium' AS severity, 'source_ip' AS kind, e.source_ip AS entity, count(*) AS n_events, peak, count(DISTINCT host) AS n_hosts, count(DISTINCT username) AS n_users, center
FROM log_events e JOIN d ON e.source_ip = d.source_ip WHERE event_type = 'authentication_failure' AND epoch_us(ts) - epoch_us(center) BETWEEN 0 AND {86_400 * 4_000_000} GROUP BY e.source_ip, peak, center""")
def q_rule5(spark, sf_dir):
    return _hits(D.denied_then_failed(log_events(spark, sf_dir), RULES["RULE_5"]))


def _passed_sql(kind):
    return f"""SELECT 'RULE_6' AS rule_key, 'critical' AS severity, '{kind}' AS kind, a.{kind} AS entity, n_events, peak, n_hosts, n_users, ts AS center FROM (
    SELECT * FROM (SELECT {kind}, ts, event_type, sum(CASE WHEN event_type = 'authentication_failure' THEN 1 ELSE 0 END) OVER (PARTITION BY {kind} ORDER BY ts, event_id)::BIGINT AS peak, event_id FROM au)
    WHERE event_type = 'authentication_success' AND peak >= 4 QUALIFY row_number() OVER (PARTITION BY {kind} ORDER BY ts, event_id) = 1) a
JOIN (SELECT {kind}, count(*) AS n_events, count(DISTINCT host) AS n_hosts, count(DISTINCT username) AS n_users FROM au GROUP BY {kind}) b ON a.{kind} = b.{kind}"""


_RULE6 = f"{WITH_EVENTS}, au AS (SELECT * FROM log_events WHERE event_type IN ('authentication_failure', 'authentication_success')) {_passed_sql('source_ip')} UNION ALL {_passed_sql('username')}"


@query(_RULE6)
def q_rule6(spark, sf_dir):
    return _hits(D.failed_then_passed(log_events(spark, sf_dir), RULES["RULE_6"]))


@query(f"""{_VERDICT}, v AS (SELECT *, {_HIGH} AS high, (log4shell::INT) AS crit, oversize_line::INT AS med, (script_tag OR event_html OR sql_injection OR path_traversal OR shell_metachars) AS payload FROM f),
y AS (SELECT kind, CASE WHEN crit > 0 OR (high > 0 AND high + med >= 2) THEN 1 ELSE 0 END AS weapon FROM v WHERE crit + high + med > 0 OR payload)
SELECT kind AS entity, CASE WHEN sum(weapon) > 0 THEN 'critical' ELSE 'high' END AS severity, count(*) AS n_events, sum(weapon)::BIGINT AS peak FROM y GROUP BY kind""")
def q_rule7(spark, sf_dir):
    seen = _screened(spark, sf_dir).select(F.lit(REFERENCE).cast("timestamp").alias("ts"), F.col("kind").alias("source"), "verdict")
    return D.injected(seen).select("entity", "severity", "n_events", "peak")


@query(_peak_sql("RULE_8", "true", ["source"], "source"))
def q_rule8(spark, sf_dir):
    return _hits(D.burst(log_events(spark, sf_dir), RULES["RULE_8"]))


def _entities(spark, sf_dir):
    return D.failed_then_passed(log_events(spark, sf_dir), RULES["RULE_6"]).where("kind = 'source_ip'")


_NEAR = f"""{WITH_EVENTS}, au AS (SELECT * FROM log_events WHERE event_type IN ('authentication_failure', 'authentication_success')), h AS (SELECT entity, center FROM ({_passed_sql('source_ip')})), n AS (
SELECT h.entity, h.center, count(*) AS events, count(DISTINCT source) AS sources, count(DISTINCT host) AS hosts, count(DISTINCT username) AS users,
    count(*) FILTER (event_type = 'authentication_failure') AS failed, count(*) FILTER (event_type = 'authentication_success') AS passed, count(*) FILTER (event_type = 'connection_denied') AS denied,
    CASE WHEN count(*) > 1 THEN max(epoch_us(ts)) - min(epoch_us(ts)) END AS span_micros,
    max(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END) AS worst
FROM h JOIN log_events e ON e.source_ip = h.entity WHERE abs(epoch_us(ts) - epoch_us(center)) <= 3600000000 GROUP BY h.entity, h.center)"""
_SCORE = """p AS (SELECT *, CASE WHEN failed > 0 THEN least(30, 3 * failed) ELSE 0 END + CASE WHEN hosts > 1 THEN least(16, 7 * (hosts - 1)) ELSE 0 END + CASE WHEN sources > 1 THEN least(20, 8 * (sources - 1)) ELSE 0 END
    + CASE WHEN span_micros IS NOT NULL AND events >= 3 THEN CASE WHEN events / greatest(span_micros / 60000000.0, 0.1) >= 20 THEN 18 WHEN events / greatest(span_micros / 60000000.0, 0.1) >= 8 THEN 12 WHEN events / greatest(span_micros / 60000000.0, 0.1) >= 3 THEN 7 ELSE 2 END ELSE 0 END
    + CASE worst WHEN 4 THEN 22 WHEN 3 THEN 15 WHEN 2 THEN 9 WHEN 1 THEN 4 WHEN 0 THEN 1 ELSE 0 END + CASE WHEN users > 1 THEN least(10, 3 * users) ELSE 0 END + 15 + CASE WHEN denied >= 3 THEN least(10, denied) ELSE 0 END AS raw FROM n),
s AS (SELECT *, CAST(least(100, CASE WHEN raw <= 60 THEN raw ELSE round_even(60 + (raw - 60) * 0.6, 0) END) AS INTEGER) AS score FROM p)"""
_BAND = "CASE WHEN score >= 85 THEN 'critical' WHEN score >= 65 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 15 THEN 'low' ELSE 'info' END"


@query(f"{_NEAR} SELECT * FROM n")
def q_correlate(spark, sf_dir):
    found = I.correlate(_entities(spark, sf_dir), log_events(spark, sf_dir), 3600)
    return found.select("entity", _ntz("center"), "events", "sources", "hosts", "users", "failed", "passed", "denied", "span_micros", "worst")


@query(f"""{_NEAR} SELECT h.entity, e.event_id, concat_ws(' ', replace(event_type, '_', ' '), 'from ' || source_ip, 'on ' || host, 'as ' || username, '[' || status || ']') AS summary
FROM h JOIN log_events e ON e.source_ip = h.entity WHERE abs(epoch_us(ts) - epoch_us(center)) <= 3600000000""")
def q_timeline(spark, sf_dir):
    return I.timeline(_entities(spark, sf_dir), log_events(spark, sf_dir), "source_ip", 3600).select("entity", "event_id", "summary")


def _scored(spark, sf_dir):
    found = I.correlate(_entities(spark, sf_dir), log_events(spark, sf_dir), 3600)
    return I.risk(found.withColumns({"shield_verdict": F.lit(None).cast("string"), "success_after_failures": F.lit(True)}))


@query(f"{_NEAR}, {_SCORE} SELECT entity, CAST(raw AS INTEGER) AS raw, score, {_BAND} AS band FROM s")
def q_risk(spark, sf_dir):
    return _scored(spark, sf_dir).select("entity", "raw", "score", "band")


@query(f"{_NEAR}, {_SCORE}, b AS (SELECT {_BAND} AS band FROM s) SELECT x.band, count(b.band) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) x(band) LEFT JOIN b ON x.band = b.band GROUP BY x.band")
def q_risk_bands(spark, sf_dir):
    return I.bands(_scored(spark, sf_dir))


def _members(spark, sf_dir):
    events = log_events(spark, sf_dir).withColumn("source", F.lit(None).cast("string"))
    return D.hit_events(D.failed_then_passed(events, RULES["RULE_6"]), events).select("kind", "entity", "event_id")


_OVERLAP = f"""{WITH_EVENTS}, au AS (SELECT * FROM log_events WHERE event_type IN ('authentication_failure', 'authentication_success')), h AS ({_passed_sql('source_ip')} UNION ALL {_passed_sql('username')}),
m AS (SELECT DISTINCT h.kind, h.entity, au.event_id FROM h JOIN au ON (h.kind = 'source_ip' AND au.source_ip = h.entity) OR (h.kind = 'username' AND au.username = h.entity)),
z AS (SELECT kind, entity, count(*) AS size FROM m GROUP BY ALL)
SELECT a.entity AS earlier, b.entity AS later, count(*) AS shared, any_value(z.size) AS size FROM m a JOIN m b ON a.event_id = b.event_id AND a.kind = 'source_ip' AND b.kind = 'username' JOIN z ON z.kind = b.kind AND z.entity = b.entity
GROUP BY a.entity, b.entity HAVING count(*) >= 0.6 * any_value(z.size)"""


@query(_OVERLAP)
def q_incident_overlaps(spark, sf_dir):
    return I.overlaps(_members(spark, sf_dir)).select(F.col("a.entity").alias("earlier"), F.col("b.entity").alias("later"), "shared", "size")


# Security events of the registered alerts: some lines of a source count as suspicious or as weapons.
_WEAPON, _SUSPICIOUS = "event_id % 400 = 7 AND source = 'web'", "event_id % 90 = 5"


def _sec(spark, sf_dir):
    verdict = F.when(F.expr(_WEAPON), "WEAPONIZED_LOG").when(F.expr(_SUSPICIOUS), "SUSPICIOUS").otherwise("SAFE")
    return log_events(spark, sf_dir).select(F.col("timestamp").alias("ts"), "source", verdict.alias("verdict"), F.lit("injection").alias("detection_type"))


def _hit_sql(rule, sql, reason, host="NULL"):
    return f"SELECT '{rule}' AS rule_key, severity, kind, entity, {host} AS host, n_events, center, {D.RULE[rule].window if rule not in RULES else RULES[rule].window} AS w, {reason} AS reason FROM ({sql})"


_TRIED = "event_type IN ('authentication_failure', 'authentication_success')"
_DENIED_SQL = f"""SELECT 'medium' AS severity, 'source_ip' AS kind, e.source_ip AS entity, count(*) AS n_events, d.center FROM log_events e
    JOIN (SELECT source_ip, min(ts) AS center FROM log_events WHERE event_type = 'connection_denied' GROUP BY source_ip) d ON e.source_ip = d.source_ip
    WHERE event_type = 'authentication_failure' AND epoch_us(ts) - epoch_us(center) BETWEEN 0 AND {86_400 * 4_000_000} GROUP BY e.source_ip, d.center"""
_SHIELD_SQL = f"""SELECT CASE WHEN count(*) FILTER ({_WEAPON}) > 0 THEN 'critical' ELSE 'high' END AS severity, 'source' AS kind, source AS entity, count(*) AS n_events, min(ts) AS center,
    count(*) FILTER ({_WEAPON}) AS weapons FROM log_events WHERE ({_WEAPON}) OR {_SUSPICIOUS} GROUP BY source"""
_FAILS = "event_type = 'authentication_failure'"
_HITS_SQL = " UNION ALL ".join([
    _hit_sql("RULE_1", _peak_sql("RULE_1", _FAILS, ["source_ip"], "source_ip"), "peak || ' failed authentication attempts from ' || entity || ' within 86400s (threshold 5).'"),
    _hit_sql("RULE_2", _peak_sql("RULE_2", _FAILS, ["source_ip", "host"], "source_ip", more="c.host,"), "'Sustained brute-force pattern: ' || peak || ' failures from ' || entity || ' against ' || host || ' within 86400s.'", "host"),
    _hit_sql("RULE_3", _peak_sql("RULE_3", _FAILS, ["source_ip"], "source_ip", "n_hosts >= 3"), f"entity || ' produced authentication failures against ' || n_hosts || ' distinct hosts (' || (SELECT string_agg(DISTINCT l.host, ', ' ORDER BY l.host) FROM log_events l WHERE {_FAILS} AND l.source_ip = entity) || ').'"),
    _hit_sql("RULE_4", _peak_sql("RULE_4", _TRIED, ["username"], "username"), "'Account ''' || entity || ''' saw ' || peak || ' authentication attempts within 864000s (threshold 2).'"),
    _hit_sql("RULE_5", _DENIED_SQL, "entity || ' was denied at the firewall and then produced ' || n_events || ' authentication failure(s) shortly after.'"),
    _hit_sql("RULE_6", f"{_passed_sql('source_ip')} UNION ALL {_passed_sql('username')}", "peak || ' failed authentications for ' || kind || '=' || entity || ' were followed by a SUCCESSFUL login - possible credential compromise.'"),
    _hit_sql("RULE_7", _SHIELD_SQL, "'Security Shield flagged ' || n_events || ' log record(s) from ''' || entity || ''' (' || weapons || ' weaponized) - injection.'"),
    _hit_sql("RULE_8", _peak_sql("RULE_8", "true", ["source"], "source"), "'Event burst: ' || peak || ' events from ''' || entity || ''' within 3600s (threshold 5).'"),
])
_MERGE = f"""{WITH_EVENTS}, au AS (SELECT * FROM log_events WHERE {_TRIED}), hits AS ({_HITS_SQL}),
ev AS (SELECT 'source_ip' AS kind, source_ip AS entity, * FROM log_events UNION ALL SELECT 'username', username, * FROM log_events UNION ALL SELECT 'source', source, * FROM log_events),
m AS (SELECT DISTINCT h.rule_key, h.kind, h.entity, e.event_id, e.username, e.severity FROM hits h JOIN ev e ON h.kind = e.kind AND h.entity = e.entity WHERE CASE h.rule_key WHEN 'RULE_1' THEN {_FAILS}
    WHEN 'RULE_2' THEN {_FAILS} AND coalesce(e.host, '?') = h.host WHEN 'RULE_3' THEN {_FAILS} WHEN 'RULE_4' THEN {_TRIED} WHEN 'RULE_5' THEN {_FAILS} AND epoch_us(e.ts) - epoch_us(h.center) BETWEEN 0 AND h.w::BIGINT * 4000000
    WHEN 'RULE_6' THEN {_TRIED} WHEN 'RULE_8' THEN true ELSE false END),
g AS (SELECT DISTINCT kind, entity, event_id FROM m), z AS (SELECT kind, entity, count(*) AS size FROM g GROUP BY ALL),
u1 AS (SELECT x.entity, c.entity AS root, count(*) AS shared FROM g x JOIN g c ON x.event_id = c.event_id AND x.kind = 'username' AND c.kind = 'source_ip' GROUP BY ALL),
u2 AS (SELECT u1.entity, min(root) AS root FROM u1 JOIN z ON z.kind = 'username' AND z.entity = u1.entity WHERE shared >= 0.6 * size GROUP BY u1.entity),
r1 AS (SELECT z.kind, z.entity, CASE WHEN u2.root IS NOT NULL THEN 'source_ip' ELSE z.kind END AS root_kind, coalesce(u2.root, z.entity) AS root_entity FROM z LEFT JOIN u2 ON z.kind = 'username' AND z.entity = u2.entity WHERE z.kind <> 'source'),
cl AS (SELECT DISTINCT root_kind, root_entity, event_id FROM g JOIN r1 USING (kind, entity)),
s1 AS (SELECT x.entity, root_kind, root_entity, count(*) AS shared FROM g x JOIN cl ON x.event_id = cl.event_id AND x.kind = 'source' GROUP BY ALL),
s2 AS (SELECT s1.entity, root_kind, root_entity FROM s1 JOIN z ON z.kind = 'source' AND z.entity = s1.entity WHERE shared >= 0.6 * size QUALIFY row_number() OVER (PARTITION BY s1.entity ORDER BY root_kind, root_entity) = 1),
r AS (SELECT * FROM r1 UNION ALL SELECT z.kind, z.entity, coalesce(root_kind, 'source'), coalesce(root_entity, z.entity) FROM z LEFT JOIN s2 ON z.entity = s2.entity WHERE z.kind = 'source')"""


@query(f"{_MERGE} SELECT kind, entity, root_kind, root_entity FROM r")
def q_incident_merge(spark, sf_dir):
    hits, events = _all_hits(spark, sf_dir)
    return I.merged(D.hit_events(hits, events))


def _all_hits(spark, sf_dir):
    events = log_events(spark, sf_dir)
    return cut(D.evaluate(events, _sec(spark, sf_dir), [*RULES.values(), D.RULE["RULE_7"]])), events


def _alerts(spark, sf_dir):
    return I.alerts(*_all_hits(spark, sf_dir))


_RANK = "CASE {} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 WHEN 'info' THEN 0 END"
_TITLES = "CASE rule_key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.TITLE.items()) + " END"
_ALERTS = f"""{_MERGE}, nh AS (SELECT h.*, coalesce(root_kind, h.kind) AS root_kind, coalesce(root_entity, h.entity) AS root_entity,
    (root_entity IS NOT NULL AND (h.kind <> root_kind OR h.entity <> root_entity))::INT AS joined, CASE h.kind WHEN 'source_ip' THEN 0 WHEN 'username' THEN 2 ELSE 3 END AS turn FROM hits h LEFT JOIN r ON h.kind = r.kind AND h.entity = r.entity),
lead AS (SELECT root_kind, root_entity, rule_key, {_RANK.format('severity')} AS lead_rank FROM nh
    QUALIFY row_number() OVER (PARTITION BY root_kind, root_entity ORDER BY {_RANK.format('severity')} DESC, joined, turn, entity, rule_key, coalesce(host, '')) = 1),
a AS (SELECT root_kind, root_entity, min(center) AS center, max(w) AS window_seconds, array_to_string(list_sort(list(DISTINCT rule_key)), ', ') AS rules, bool_or(rule_key = 'RULE_6') AS six,
    max(CASE WHEN rule_key IN ('RULE_1', 'RULE_2', 'RULE_3') THEN n_events END) AS most_failed, string_agg(reason, ' ' ORDER BY rule_key, joined, turn, entity, coalesce(host, '')) AS reason,
    CASE arg_min(severity, joined * 100000 + turn) FILTER (rule_key = 'RULE_7') WHEN 'critical' THEN 25 WHEN 'high' THEN 10 ELSE 0 END AS shield FROM nh GROUP BY ALL),
t AS (SELECT root_kind, root_entity, count(DISTINCT m.username) FILTER (m.rule_key <> 'RULE_8') AS users, count(DISTINCT event_id) AS own_events, max({_RANK.format('m.severity')}) AS own_worst
    FROM m JOIN (SELECT DISTINCT rule_key, kind, entity, root_kind, root_entity FROM nh) USING (rule_key, kind, entity) GROUP BY ALL),
c AS (SELECT a.root_kind, a.root_entity, count(*) AS events, count(DISTINCT source) AS sources, count(DISTINCT host) AS hosts, count(*) FILTER ({_FAILS}) AS failed, count(*) FILTER (event_type = 'connection_denied') AS denied,
    CASE WHEN count(*) > 1 THEN max(epoch_us(ts)) - min(epoch_us(ts)) END AS span_micros, max({_RANK.format('severity')}) AS worst
    FROM a JOIN ev ON ev.kind = a.root_kind AND ev.entity = a.root_entity WHERE a.root_kind <> 'source' AND abs(epoch_us(ts) - epoch_us(center)) <= 3000000::BIGINT * window_seconds GROUP BY a.root_kind, a.root_entity),
n AS (SELECT a.*, rule_key, lead_rank, coalesce(users, 0) AS users, CASE WHEN a.root_kind = 'source' THEN coalesce(own_events, 0) ELSE coalesce(c.events, 0) END AS events, coalesce(sources, 0) AS sources, coalesce(hosts, 0) AS hosts,
    coalesce(CASE WHEN most_failed > 0 THEN most_failed END, c.failed, 0) AS failed, coalesce(denied, 0) AS denied, span_micros, CASE WHEN a.root_kind = 'source' THEN own_worst ELSE worst END AS worst
    FROM a JOIN lead USING (root_kind, root_entity) LEFT JOIN t USING (root_kind, root_entity) LEFT JOIN c USING (root_kind, root_entity)),
p AS (SELECT *, CASE WHEN failed > 0 THEN least(30, 3 * failed) ELSE 0 END + CASE WHEN hosts > 1 THEN least(16, 7 * (hosts - 1)) ELSE 0 END + CASE WHEN sources > 1 THEN least(20, 8 * (sources - 1)) ELSE 0 END
    + CASE WHEN span_micros IS NOT NULL AND events >= 3 THEN CASE WHEN events / greatest(span_micros / 60000000.0, 0.1) >= 20 THEN 18 WHEN events / greatest(span_micros / 60000000.0, 0.1) >= 8 THEN 12 WHEN events / greatest(span_micros / 60000000.0, 0.1) >= 3 THEN 7 ELSE 2 END ELSE 0 END
    + CASE worst WHEN 4 THEN 22 WHEN 3 THEN 15 WHEN 2 THEN 9 WHEN 1 THEN 4 WHEN 0 THEN 1 ELSE 0 END + CASE WHEN users > 1 THEN least(10, 3 * users) ELSE 0 END + CASE WHEN six THEN 15 ELSE 0 END + shield + CASE WHEN denied >= 3 THEN least(10, denied) ELSE 0 END AS raw FROM n),
s AS (SELECT *, CAST(least(100, CASE WHEN raw <= 60 THEN raw ELSE round_even(60 + (raw - 60) * 0.6, 0) END) AS INTEGER) AS score FROM p), q AS (SELECT *, {_BAND} AS band FROM s)
SELECT root_kind || '=' || root_entity AS dedup_key, {_TITLES} || ' (' || CASE root_kind WHEN 'source_ip' THEN 'source ip ' WHEN 'username' THEN 'username ' ELSE 'source ' END || root_entity || ')' AS title, rule_key,
    ['info', 'low', 'medium', 'high', 'critical'][greatest(lead_rank, {_RANK.format('band')}) + 1] AS severity, score AS risk_score, band, center, window_seconds, events, hosts, users, failed,
    'Triggered rules: ' || rules || '. Entity ' || root_kind || '=' || root_entity || '.' AS description, reason, CASE root_kind WHEN 'source_ip' THEN 'block_source_ip' WHEN 'username' THEN 'disable_account' ELSE 'review_source' END AS response FROM q"""


@query(_ALERTS)
def q_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir).select(
        "dedup_key", "title", "rule_key", "severity", "risk_score", "band", _ntz("center"), "window_seconds", "events", "hosts", "users", "failed", "description", "reason", F.col("recommended_response.action").alias("response"),
    )


@query(f"{_NEAR}, {_SCORE} SELECT entity, score FROM s ORDER BY score DESC, center DESC, entity LIMIT 5")
def q_alerts_topk(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.col("entity").alias("dedup_key"), "entity", F.col("score").alias("risk_score"), "score", "center")
    return I.top_alerts(rows, 5).select("entity", "score")


@query("""SELECT coalesce(o.k, n.k) AS dedup_key, coalesce(n.risk, o.risk) AS risk_score, coalesce(o.status, n.status) AS status FROM
(SELECT user_id AS k, count(*) AS risk, 'ACKNOWLEDGED' AS status FROM events WHERE event_id % 2 = 0 GROUP BY user_id) o FULL JOIN (SELECT user_id AS k, max(event_id) AS risk, 'NEW' AS status FROM events WHERE event_id % 3 = 0 GROUP BY user_id) n ON o.k = n.k""")
def q_alert_upsert(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    batch = lambda n, risk, status: e.where(F.col("event_id") % n == 0).groupBy(F.col("user_id").alias("dedup_key")).agg(risk.alias("risk_score"), F.lit(status).alias("status"))
    return I.upsert(batch(2, F.count("*"), "ACKNOWLEDGED"), batch(3, F.max("event_id"), "NEW"))


@query(f"{_NEAR}, {_SCORE} SELECT entity, count(*) AS alerts, max(score) AS max_risk, {_BAND.replace('score', 'max(score)')} AS band FROM s GROUP BY entity")
def q_incidents_ui(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.lit("source_ip").alias("kind"), "entity", F.col("score").alias("risk_score"), "band", "center")
    return I.roll_up(rows).select("entity", "alerts", "max_risk", "band")


def _recommended(spark, sf_dir):
    hits = D.evaluate(log_events(spark, sf_dir), None, [RULES["RULE_5"], RULES["RULE_6"]])
    rows = hits.groupBy("kind", "entity").agg(F.sort_array(F.collect_set("rule_key")).alias("rules"))
    return I.recommend(rows)


_RECOMMEND = f"""{WITH_EVENTS}, au AS (SELECT * FROM log_events WHERE event_type IN ('authentication_failure', 'authentication_success')), six AS ({_passed_sql('source_ip')} UNION ALL {_passed_sql('username')}),
d AS (SELECT source_ip, min(ts) AS center FROM log_events WHERE event_type = 'connection_denied' GROUP BY source_ip),
five AS (SELECT DISTINCT 'source_ip' AS kind, e.source_ip AS entity FROM log_events e JOIN d ON e.source_ip = d.source_ip WHERE event_type = 'authentication_failure' AND epoch_us(ts) - epoch_us(center) BETWEEN 0 AND {86_400 * 4_000_000}),
u AS (SELECT kind, entity, 'PORT_SCAN' AS category FROM five UNION ALL SELECT kind, entity, 'SUSPICIOUS_AUTHENTICATION' FROM six WHERE (kind, entity) NOT IN (SELECT kind, entity FROM five)),
r AS (SELECT kind, entity, category, CASE WHEN category = 'PORT_SCAN' THEN 'Block or closely monitor the scanning source' WHEN kind = 'username' THEN 'Require step-up authentication for ' || entity ELSE 'Monitor and rate-limit source ' || entity END AS label FROM u)"""


@query(f"{_RECOMMEND} SELECT *, CAST(3 AS INTEGER) AS n_actions FROM r")
def q_recommend(spark, sf_dir):
    return _recommended(spark, sf_dir).select("kind", "entity", "category", "label", F.size("actions").alias("n_actions"))


@query(f"""{_RECOMMEND}, q AS (SELECT entity, unnest(CASE WHEN category = 'PORT_SCAN' THEN ['BLOCK_SOURCE', 'INCREASE_MONITORING', 'COLLECT_EVIDENCE'] WHEN kind = 'username' THEN ['DISABLE_ACCOUNT_SIMULATION', 'MONITOR_SOURCE', 'COLLECT_EVIDENCE']
    ELSE ['MONITOR_SOURCE', 'MONITOR_SOURCE', 'COLLECT_EVIDENCE'] END) AS action FROM r)
SELECT entity, action, CASE action WHEN 'BLOCK_SOURCE' THEN 'WOULD BLOCK' WHEN 'DISABLE_ACCOUNT_SIMULATION' THEN 'WOULD DISABLE' ELSE 'elevated' END AS after FROM q""")
def q_simulate(spark, sf_dir):
    return I.simulate(_recommended(spark, sf_dir)).select("entity", "action", "after")


# --- templates ------------------------------------------------------------------------------------------------------------------


@query(f"{WITH_LINES} SELECT event_id, CAST(len(regexp_extract_all(content, '\\S+')) AS INTEGER) AS n_tokens, regexp_extract_all(content, '\\S+')[1] AS first_token FROM log_lines")
def q_template_tokens(spark, sf_dir):
    return T.tokenised(log_lines(spark, sf_dir)).select("event_id", "n_tokens", F.col("tokens")[0].alias("first_token"))


_CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(token, '{_quoted(p)}') THEN '{n}'" for n, p in T.CLASSES if n not in ("ipv6", "hash")) + " WHEN regexp_matches(token, '^[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4}){3,}$') THEN 'ipv6' WHEN regexp_matches(token, '^[0-9a-fA-F]{8,}$') AND (length(token) >= 32 OR regexp_matches(token, '[a-fA-F]')) THEN 'hash' END"
_MASK_SQL = f"""{WITH_LINES}, k AS (SELECT event_id, source, content, regexp_extract_all(content, '\\S+') AS tokens FROM log_lines), e AS (SELECT event_id, len(tokens) AS n_tokens, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM k),
c AS (SELECT n_tokens, pos, token, count(*) AS c FROM e GROUP BY ALL), a AS (SELECT n_tokens, pos, sum(c) AS n, count(*) AS d, max(c) AS top, sum(CASE WHEN {_CLASS_SQL} IN {T.VARYING} THEN c ELSE 0 END) AS v FROM c GROUP BY ALL),
m AS (SELECT n_tokens, pos, NOT (v >= greatest(1.0, n * 0.5)) AND (d = 1 OR top / n >= 0.5) AS literal FROM a)"""


@query(f"{_MASK_SQL} SELECT CAST(n_tokens AS INTEGER) AS n_tokens, CAST(pos AS INTEGER) AS pos, literal FROM m")
def q_template_mask(spark, sf_dir):
    return T.anchor_masks(T.tokenised(log_lines(spark, sf_dir))).select("n_tokens", F.posexplode("mask").alias("pos", "literal"))


@query(f"""{_MASK_SQL}, l AS (SELECT e.event_id, string_agg(CASE WHEN literal THEN token ELSE '<*>' END, ' ' ORDER BY e.pos) AS pattern, count(*) FILTER (NOT literal) AS vars FROM e JOIN m ON e.n_tokens = m.n_tokens AND e.pos = m.pos GROUP BY e.event_id)
SELECT pattern, count(*) AS occurrences, CAST(max(vars) AS INTEGER) AS variable_count, min(event_id) AS first_id FROM l GROUP BY pattern""")
def q_template_mine(spark, sf_dir):
    return T.mine(log_lines(spark, sf_dir)).select("pattern", "occurrences", "variable_count", "first_id")


@query(f"{WITH_LINES} SELECT event_id, content AS restored FROM log_lines")
def q_reconstruct(spark, sf_dir):
    return T.reconstruct(T.payloads(log_lines(spark, sf_dir))).select("event_id", "restored")


@query(f"{WITH_LINES} SELECT count(*) AS records, CAST(sum(strlen(content)) AS BIGINT) AS original_bytes, count(*) AS reconstructable FROM log_lines")
def q_compress_bytes(spark, sf_dir):
    return T.accounting(log_lines(spark, sf_dir)).select("records", "original_bytes", "reconstructable")


@query()
def q_compression_report(spark, sf_dir):
    return T.accounting(log_lines(spark, sf_dir))


@query(f"""{_MASK_SQL}, l AS (SELECT e.event_id, any_value(source) AS source, string_agg(CASE WHEN literal THEN token ELSE '<*>' END, ' ' ORDER BY e.pos) AS pattern, count(*) FILTER (NOT literal) AS vars
    FROM e JOIN m ON e.n_tokens = m.n_tokens AND e.pos = m.pos JOIN k USING (event_id) GROUP BY e.event_id), t AS (SELECT pattern, count(*) AS n, max(vars) AS vars FROM l GROUP BY pattern)
SELECT count(*) AS templates, CAST(sum(n) AS BIGINT) AS occurrences, round(avg(vars), 2) AS avg_variables, (SELECT count(DISTINCT source) FROM l) AS sources FROM t""")
def q_template_summary(spark, sf_dir):
    return T.summary(T.mine(log_lines(spark, sf_dir)))


_LINE_PATTERN = f"""{_MASK_SQL}, l AS (SELECT e.event_id, any_value(source) AS source, string_agg(CASE WHEN literal THEN token ELSE '<*>' END, ' ' ORDER BY e.pos) AS pattern
    FROM e JOIN m ON e.n_tokens = m.n_tokens AND e.pos = m.pos JOIN k USING (event_id) GROUP BY e.event_id),
t AS (SELECT pattern, count(*) AS occurrences, min(event_id) AS first_id, list_sort(list(DISTINCT source)) AS sources FROM l GROUP BY pattern),
tk AS (SELECT *, 'TPL-' || CASE WHEN nth < 10000 THEN lpad(nth::VARCHAR, 4, '0') ELSE nth::VARCHAR END AS template_key FROM (SELECT *, row_number() OVER (ORDER BY first_id) AS nth FROM t))"""


@query(f"{_LINE_PATTERN} SELECT template_key, pattern, occurrences FROM tk WHERE occurrences >= 3 AND list_contains(sources, 'firewall') AND contains(lower(pattern), 'drop') ORDER BY occurrences DESC, template_key LIMIT 100")
def q_templates_listed(spark, sf_dir):
    return T.listed(T.mine(log_lines(spark, sf_dir)), 3, "firewall", "DROP").select("template_key", "pattern", "occurrences")


@query(f"{_LINE_PATTERN} SELECT template_key, CAST(nth AS INTEGER) AS nth, event_id, content FROM (SELECT tk.template_key, row_number() OVER (PARTITION BY tk.template_key ORDER BY l.event_id) AS nth, l.event_id, k.content FROM l JOIN tk USING (pattern) JOIN k ON k.event_id = l.event_id) WHERE nth <= 5")
def q_template_examples(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    return T.examples(T.payloads(lines), lines)


# The store after two runs: the lines of one source, then all lines. Templates of the first run keep their keys.
_STORE = _LINE_PATTERN.replace("FROM log_lines), e AS", "FROM log_lines WHERE @@), e AS")


@query(f"""SELECT pattern, CASE WHEN a.template_key IS NOT NULL THEN a.template_key ELSE 'TPL-' || CASE WHEN most + nth < 10000 THEN lpad((most + nth)::VARCHAR, 4, '0') ELSE (most + nth)::VARCHAR END END AS template_key, occurrences FROM (
    SELECT b.pattern, a.template_key, b.occurrences, row_number() OVER (PARTITION BY a.pattern IS NULL ORDER BY b.first_id) AS nth, (SELECT count(*) FROM ({_STORE.replace("@@", "source IN ('firewall', 'linux')")} SELECT * FROM tk)) AS most
    FROM ({_STORE.replace("@@", "true")} SELECT * FROM tk) b LEFT JOIN ({_STORE.replace("@@", "source IN ('firewall', 'linux')")} SELECT * FROM tk) a ON a.pattern = b.pattern) a""")
def q_template_store(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    first = T.mine(lines.where("source IN ('firewall', 'linux')"))
    return T.saved_templates(first, T.mine(lines)).select("pattern", "template_key", "occurrences")


# --- exports, dashboards ----------------------------------------------------------------------------------------------------------


@query(f"""{WITH_EVENTS} SELECT event_id, event_type AS category, coalesce(action, 'info') AS type, coalesce(status, 'unknown') AS outcome, source_ip AS src, CAST(response_code AS VARCHAR) AS code, host FROM log_events""")
def q_export_ecs(spark, sf_dir):
    doc = lambda p: F.get_json_object("document", p)
    return X.ecs(log_events(spark, sf_dir)).select("event_id", doc("$.event.category[0]").alias("category"), doc("$.event.type[0]").alias("type"), doc("$.event.outcome").alias("outcome"), doc("$.source.ip").alias("src"), doc("$.http.response.status_code").alias("code"), doc("$.host.name").alias("host"))


@query(f"""{WITH_EVENTS} SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(1 AS INTEGER) AS severity_numeric, CAST(coalesce(status IN ('failure', 'blocked'), false) AS INTEGER) AS is_error,
    source_port, coalesce(destination_port, 0) AS destination_port, coalesce(response_code, 0) AS response_code, 14 AS dimensions FROM log_events""")
def q_export_ml(spark, sf_dir):
    return X.features(log_events(spark, sf_dir)).select("event_id", "hour_of_day", "day_of_week", "severity_numeric", "is_error", "source_port", "destination_port", "response_code", F.size("feature_vector").alias("dimensions"))


@query("SELECT '1.0' AS schema_version, '1970-01-01T00:00:00Z' AS exported_at, count(*) AS total FROM events")
def q_export_envelope(spark, sf_dir):
    return X.envelope(log_events(spark, sf_dir))


@query(f"""{WITH_EVENTS} SELECT event_id, 'This is a ' || replace(event_type, '_', ' ') || ' from the ' || source || ' source concerning host ' || host || ' for account ' || username || ' originating from ' || source_ip
    || coalesce(' - action ' || action || ', outcome ' || status, '') || coalesce(' (HTTP ' || response_code || ')', '') || CASE WHEN severity IN ('high', 'critical') THEN '. Severity is ' || severity || '.' ELSE '.' END AS summary FROM log_events""")
def q_explain_event(spark, sf_dir):
    return X.explain(log_events(spark, sf_dir))


@query("""SELECT * FROM (SELECT unnest(['total', 'processed', 'invalid', 'duplicate', 'quarantined', 'events', 'protected', 'sources', 'success_rate']) AS card,
    unnest([n, n, 0, 0, 0, n, 0, 4, 100]::DOUBLE[]) AS value FROM (SELECT count(*) AS n FROM events))""")
def q_overview_cards(spark, sf_dir):
    return X.overview(L.processed(raw_logs(spark, sf_dir), CFG, L.COUNTED))


@query("""WITH j AS (SELECT user_id % 20 AS job, count(*) AS n, CASE WHEN (user_id % 20) % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM events GROUP BY ALL)
SELECT coalesce(round_even(avg(rate), 1), 0.0) AS avg_rate, coalesce(round_even(max(rate), 1), 0.0) AS peak_rate FROM (SELECT n / 7.0::DOUBLE - 30 AS rate FROM j WHERE status = 'COMPLETED') WHERE rate > 0""")
def q_processing_rates(spark, sf_dir):
    jobs = _read(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("job")).agg(F.count("*").alias("n"))
    jobs = jobs.select(F.when(F.col("job") % 3 == 0, "FAILED").otherwise("COMPLETED").alias("status"), (F.col("n") / F.lit(7.0) - 30).alias("processing_rate"))
    return X.processing_rates(jobs)


@query(f"{WITH_EVENTS} SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS n FROM log_events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 72 HOURS GROUP BY 1")
def q_recent(spark, sf_dir):
    return X.recent(log_events(spark, sf_dir), "2024-01-10 00:00:00", 72)


@query(f"""{WITH_EVENTS} SELECT coalesce(c.name, s.source) AS source, c.name IS NOT NULL AS configured, coalesce(events, 0) AS events, last_seen FROM (VALUES ('linux'), ('web'), ('vpn')) c(name)
FULL JOIN (SELECT source, count(*) AS events, max(ts) AS last_seen FROM log_events GROUP BY source) s ON c.name = s.source""")
def q_source_status(spark, sf_dir):
    known = spark.createDataFrame([("linux",), ("web",), ("vpn",)], "name string")
    return X.source_status(known, log_events(spark, sf_dir)).select("source", "configured", "events", _ntz("last_seen"))


@query(f"""SELECT CAST(turn AS INTEGER) AS turn, node, CASE node WHEN 'privacy' THEN 0 WHEN 'alerts' THEN 0 ELSE n END AS records FROM (SELECT unnest({X.NODES}) AS node, unnest(range({len(X.NODES)})) AS turn, n FROM (SELECT count(*) AS n FROM events))""")
def q_pipeline_nodes(spark, sf_dir):
    return X.pipeline_nodes(L.processed(raw_logs(spark, sf_dir), CFG))


@query(f"{WITH_EVENTS} SELECT source, count(*) AS n, percentile_cont(0.5) WITHIN GROUP (ORDER BY source_port)::DOUBLE AS p50, percentile_cont(0.95) WITHIN GROUP (ORDER BY source_port)::DOUBLE AS p95 FROM log_events GROUP BY source")
def q_percentiles(spark, sf_dir):
    p = F.percentile("source_port", F.array(F.lit(0.5), F.lit(0.95)))
    return log_events(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), p.alias("p")).select("source", "n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


@query("""SELECT 'r_regionkey=' || r_regionkey || ' r_name=' || CASE WHEN contains(r_name, ' ') THEN '"' || r_name || '"' ELSE r_name END AS content FROM region""")
def q_csv_logfmt(spark, sf_dir):
    return files.logfmt(_read(spark, sf_dir, "region"))


@query()
def q_simulated_source(spark, sf_dir):
    return P.parse(P.detect(files.simulated(spark, 200))).select("line_number", "parser", "content")


# --- detail views -----------------------------------------------------------------------------------------------------------------


@query(f"""{WITH_LINES} SELECT e.event_id, l.content AS raw_content, 'AUTO' AS detected_format, CASE WHEN e.event_id % 9 = 0 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS shield_verdict
FROM log_events e JOIN log_lines l ON e.event_id = l.event_id""")
def q_event_detail(spark, sf_dir):
    lines = log_lines(spark, sf_dir).select(F.col("event_id").alias("raw_log_id"), "content", F.lit("job-1").alias("job_id"))
    jobs = spark.createDataFrame([("job-1", "AUTO")], "job_id string, detected_format string")
    bad = lines.where(F.col("raw_log_id") % 9 == 0).select("raw_log_id", F.lit("SUSPICIOUS").alias("verdict"))
    events = log_events(spark, sf_dir).withColumn("raw_log_id", F.col("event_id"))
    return B.event_detail(events, lines, jobs, bad).select("event_id", "raw_content", "detected_format", "shield_verdict")


@query(f"""{WITH_EVENTS}, n AS (SELECT a.event_id AS "of", b.event_id, abs(epoch_us(b.ts) - epoch_us(a.ts)) AS gap FROM log_events a JOIN log_events b ON a.source_ip = b.source_ip AND a.event_id <> b.event_id
WHERE a.event_type = 'authentication_success' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 7200000000)
SELECT "of", event_id, gap, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY "of" ORDER BY gap, event_id) AS nth FROM n) WHERE nth <= 25""")
def q_related_events(spark, sf_dir):
    events = log_events(spark, sf_dir)
    return B.related(events, events.where("event_type = 'authentication_success'"), 7200)


@query(f"""{WITH_EVENTS}, au AS (SELECT * FROM log_events WHERE event_type IN ('authentication_failure', 'authentication_success')), h AS ({_passed_sql('source_ip')} UNION ALL {_passed_sql('username')})
SELECT DISTINCT au.event_id, 'RULE_6' AS rules FROM h JOIN au ON (h.kind = 'source_ip' AND au.source_ip = h.entity) OR (h.kind = 'username' AND au.username = h.entity)""")
def q_alerts_of_event(spark, sf_dir):
    events = log_events(spark, sf_dir)
    members = D.hit_events(D.failed_then_passed(events, RULES["RULE_6"]), events)
    return B.alerts_of(members, events).select("event_id", F.array_join("rules", ",").alias("rules"))


@query(f"""{WITH_EVENTS}, e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'udp' WHEN event_id % 7 > 0 THEN 'tcp' END AS protocol FROM log_events),
p AS (SELECT source_ip AS entity, destination_port, count(*) AS n FROM e WHERE destination_port IS NOT NULL GROUP BY ALL), q AS (SELECT source_ip AS entity, protocol, count(*) AS n FROM e WHERE protocol IS NOT NULL GROUP BY ALL),
p1 AS (SELECT entity, destination_port AS port FROM p QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, destination_port) = 1), q1 AS (SELECT entity, protocol FROM q QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, protocol) = 1)
SELECT coalesce(p1.entity, q1.entity) AS entity, port, protocol FROM p1 FULL JOIN q1 ON p1.entity = q1.entity""")
def q_busiest_target(spark, sf_dir):
    events = log_events(spark, sf_dir).withColumn("protocol", F.when(F.col("event_id") % 3 == 0, "udp").when(F.col("event_id") % 7 > 0, "tcp"))
    members = events.select(F.lit("source_ip").alias("kind"), F.col("source_ip").alias("entity"), "event_id")
    return B.busiest_target(members, events).select("entity", "port", "protocol")


@query(f"{WITH_EVENTS} SELECT event_id, 'severe' AS view FROM log_events WHERE severity IN ('high', 'critical') UNION ALL SELECT event_id, 'auth' FROM log_events WHERE event_type LIKE '%auth%'")
def q_streamed(spark, sf_dir):
    events = log_events(spark, sf_dir)
    shown = lambda v: Q.streamed(events, v).select("event_id", F.lit(v).alias("view"))
    return shown("severe").unionByName(shown("auth"))


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id, user_id LIMIT 100")
def q_listed(spark, sf_dir):
    return B.listed(_read(spark, sf_dir, "events"), "ts", 100, event_type="error", props=None).select("event_id")
