"""Rules, risk, incidents, templates, streams and the registry."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logsluice.operators import detect as D
from logsluice.operators import incidents as I
from logsluice.operators import templates as T
from logsluice.streaming import jobs

SF = "/root/testdata/sf0.001"
EVENT = "event_id long, timestamp timestamp, source_ip string, host string, username string, event_type string, source string, severity string"


def _events(spark, rows):
    base = F.lit("2026-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame(rows, EVENT.replace("timestamp timestamp", "s double"))
    return df.withColumn("timestamp", F.timestamp_micros(F.unix_micros(base) + (F.col("s") * 1_000_000).cast("long"))).drop("s")


def test_window_of_the_reference(spark):
    rows = [(i, float(s), "a", "h", "u", D.FAILED, "linux", None) for i, s in enumerate((0, 10, 20, 400, 410))]
    r = D.busiest_window(_events(spark, rows), ["source_ip"], 60).withColumn("s", F.unix_timestamp("center") % 86400).first()
    assert (r["peak"], r["s"]) == (3, 10)


def test_windows_against_two_pointers(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(4000)), rng.choice("abc"), "h", "u", D.FAILED, "linux", None) for i in range(400)]
    got = {r["source_ip"]: (r["peak"], r["c"]) for r in D.busiest_window(_events(spark, rows), ["source_ip"], 120).withColumn("c", F.unix_micros("center") % 86_400_000_000).collect()}
    for ip in "abc":
        ts, j, best = sorted(int(r[1] * 1_000_000) for r in rows if r[2] == ip), 0, (0, 0)
        for i, t in enumerate(ts):
            while t - ts[j] > 120_000_000:
                j += 1
            if i - j + 1 > best[0]:
                best = (i - j + 1, (t + ts[j]) // 2)
        assert got[ip] == best


def test_windows_take_running_sums(spark):
    rows = [(i, float(s), k, "h", "u", D.FAILED, "linux", None) for i, (k, s) in enumerate([("a", 0), ("a", 60), ("a", 60), ("a", 121), ("a", 181), ("b", 5), ("a", 59.5)])]
    found = D.busiest_window(_events(spark, rows), ["source_ip"], 60)
    got = {r["source_ip"]: (r["peak"], r["c"]) for r in found.withColumn("c", F.unix_micros("center") % 86_400_000_000).collect()}
    assert got == {"a": (4, 30_000_000), "b": (1, 5_000_000)}
    # a frame that slides looks at all rows of a span for each of its rows
    assert "RangeFrame, -" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_failures_then_success(spark):
    rows = [(i, float(i), "a", "h", f"u{i}", D.FAILED, "linux", None) for i in range(4)] + [(9, 9.0, "a", "h", "u0", D.PASSED, "linux", None), (10, 10.0, "b", "h", "u1", D.PASSED, "linux", None)]
    got = D.failed_then_passed(_events(spark, rows)).collect()
    assert [(r["kind"], r["entity"], r["peak"], r["n_events"]) for r in got] == [("source_ip", "a", 4, 5)]


def test_scenario_score(spark):
    rows = [(12, 5, 3, 3, 4, 21, 252_000_000, 3, None, True), (10, 4, 3, 0, 3, 15, 180_000_000, 3, None, True), (1, 0, 1, 0, 1, 1, None, None, None, False)]
    df = spark.createDataFrame(rows, "failed long, denied long, hosts long, users long, sources long, events long, span_micros long, worst int, shield_verdict string, success_after_failures boolean")
    assert [(r["raw"], r["score"], r["band"]) for r in I.risk(df).collect()] == [(115, 93, "critical"), (101, 85, "critical"), (3, 3, "info")]


def test_merging(spark):
    members = [("source_ip", "a", i) for i in range(10)] + [("username", "u", i) for i in range(6)] + [("username", "v", i) for i in range(5, 15)]
    got = {(r["kind"], r["entity"]): r["root_entity"] for r in I.merged(spark.createDataFrame(members, "kind string, entity string, event_id long")).collect()}
    assert got == {("source_ip", "a"): "a", ("username", "u"): "a", ("username", "v"): "v"}


def test_merging_against_groups_one_after_the_other(spark):
    """An incident has the events of whatever joined it, which later groups are compared with."""
    rng = random.Random(9)
    members = [(kind, f"{kind[0]}{rng.randrange(4)}", i) for kind in ("source_ip", "host", "username", "source") for i in range(40) if rng.random() < 0.8]
    members += [("source_ip", "x", i) for i in range(100, 106)] + [("host", "y", i) for i in range(103, 108)] + [("source", "z", i) for i in range(106, 109)]
    groups: dict = {}
    for kind, entity, i in members:
        groups.setdefault((I.PRIORITY[kind], kind, entity), set()).add(i)
    roots, want = [], {}
    for g, ids in sorted(groups.items()):
        for root in roots:
            if len(ids & root[1]) >= 0.6 * len(ids):
                root[1] |= ids
                want[g[1:]] = root[0]
                break
        else:
            roots.append([g[1:], set(ids)])
            want[g[1:]] = g[1:]
    got = {(r["kind"], r["entity"]): (r["root_kind"], r["root_entity"]) for r in I.merged(spark.createDataFrame(members, "kind string, entity string, event_id long")).collect()}
    assert got == want and want["source", "z"] == ("source_ip", "x")


def test_alerts_over_their_own_windows(spark):
    rng = random.Random(6)
    kinds = (D.FAILED, D.PASSED, D.DENIED, "generic")
    rows = [(i, float(rng.randrange(2_000_000)), rng.choice(["a", "b", "c", None]), rng.choice("hij"), rng.choice("uvw"), rng.choice(kinds), rng.choice("st"), rng.choice(["low", "high", None])) for i in range(3000)]
    events = _events(spark, rows)
    at = {"a": 1_000_000, "b": 1_000_000, "c": 500_000}
    windows = {"a": [300], "b": [300, 86_400], "c": [864_000, 600]}  # an incident takes its longest
    base = F.lit("2026-01-01 00:00:00").cast("timestamp")
    hits = [(f"RULE_{i + 1}", "low", "source_ip", e, at[e] + i, w) for e, ws in windows.items() for i, w in enumerate(ws)]
    hits = spark.createDataFrame(hits, "rule_key string, severity string, kind string, entity string, s long, window_seconds int")
    hits = hits.withColumn("center", F.timestamp_micros(F.unix_micros(base) + F.col("s") * 1_000_000)).drop("s")
    hits = hits.withColumns({"n_events": F.lit(0), "host": F.lit(None).cast("string"), "reason": F.lit("why")})
    rules = F.explode(F.array(*[F.lit(f"RULE_{i}") for i in (1, 2)])).alias("rule_key")
    members = events.where("source_ip IS NOT NULL").select(rules, F.lit("source_ip").alias("kind"), F.col("source_ip").alias("entity"), "event_id", "username", "severity")
    want = {}
    for e, ws in windows.items():
        near = [r for r in rows if r[2] == e and abs(r[1] - at[e]) <= 3 * max(ws)]
        n = lambda k: sum(r[5] == k for r in near)  # noqa: B023, E731
        want[e] = (len(near), len({r[6] for r in near}), len({r[3] for r in near}), 3, n(D.FAILED), n(D.PASSED), n(D.DENIED))
    assert want["a"][0] < 10 < want["b"][0] < want["c"][0]
    assert {r["entity"]: tuple(r)[1:] for r in I.alerts(hits, events, members).select("entity", "events", "sources", "hosts", "users", "failed", "passed", "denied").collect()} == want


def test_alerts_say_all_reasons(spark):
    rows = [(i, float(i), "a", "h", f"u{i:03}", D.FAILED, "linux", "low") for i in range(130)]
    events = _events(spark, rows)
    hits = [("RULE_1", "low", "source_ip", "a", None, 130, 3600, "all")] + [("RULE_2", "low", "source_ip", "a", f"h{i:03}", 1, 3600, f"host {i:03}") for i in range(120)]
    hits = spark.createDataFrame(hits, "rule_key string, severity string, kind string, entity string, host string, n_events int, window_seconds int, reason string")
    alert = I.alerts(hits.withColumn("center", F.lit("2026-01-01 00:01:00").cast("timestamp")), events).first()
    assert alert["reason"] == " ".join(["all"] + [f"host {i:03}" for i in range(120)])


def test_templates(spark):
    lines = [(i, "s", f"User {u} logged in from 192.0.2.{i}") for i, u in enumerate(("kim", "lee", "ana"), 1)]
    r = T.mine(spark.createDataFrame(lines, "event_id long, source string, content string")).first()
    assert (r["pattern"], r["n_tokens"], r["types"], r["signature"], r["template_key"]) == ("User <*> logged in from <*>", 6, [None, "value", None, None, None, "ipv4"], "593aebdf55bad9f342fef5b337525aea", "TPL-0001")
    p = T.payloads(spark.createDataFrame(lines, "event_id long, source string, content string")).where("event_id = 1").first()
    assert p["payload_bytes"] == 40
    hard = [(i, "s", x) for i, x in enumerate(["a  b\tc ", "  x y", "ünï 漢字 1", "tok " * 400, "k=v  k=w", "a  b\tc  ", "", None, "a b c"])]
    back = T.reconstruct(T.payloads(spark.createDataFrame(hard, "event_id long, source string, content string"))).collect()
    assert len(back) == 7 and all(r["restored"] == r["line"] for r in back)
    words = {"192.0.2.1": "ipv4", "192.0.2.1:80": "ipv4", "fe80::1": "ipv6", "08:07:13": "timestamp", "44210": "number", "-5": "number", "a@b.example": "email", "https://x.example/y": "url", "d" * 32: "hash", "sshd": None, '"q"': "quoted", "aa:bb:cc:dd:ee:ff": "mac"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.token_class(F.col("w")).alias("c")).collect()
    assert {r["w"]: r["c"] for r in got} == words


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "RESOLVED"), ("b", 2, "NEW")], "dedup_key string, risk_score int, status string")
    new = spark.createDataFrame([("a", 5, "NEW"), ("c", 3, "NEW")], "dedup_key string, risk_score int, status string")
    assert sorted(map(tuple, I.upsert(old, new).collect())) == [("a", 5, "RESOLVED"), ("b", 2, "NEW"), ("c", 3, "NEW")]


def test_streams(spark, tmp_path):
    rows = [(i, float(i), "a", "h", "u", D.FAILED, "linux", None) for i in range(5)] + [(9, 9.0, "a", "h", "u", D.PASSED, "linux", None)]
    _events(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = jobs.failed_then_passed(stream).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r)[:2] for r in spark.table("hits").collect()] == [("a", 5)]
    q = jobs.per_minute(stream).writeStream.format("memory").queryName("minutes").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("minutes").collect()) == [1, 5]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _shown(rows):
    return sorted(tuple("NULL" if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in rows)


QUICK = ["q_content_hash", "q_shield_flags", "q_shield_verdict", "q_dedup", "q_clean_fields", "q_pii_hash", "q_page", "q_facets_grouping_sets", "q_timeseries_hour", "q_rule1", "q_rule6", "q_risk", "q_template_mine", "q_recommend", "q_export_ml"]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "pages", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF), con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _shown(got.select(*columns).collect()) == _shown(want.fetchall())


def test_template_store_keeps_keys(spark):
    schema = "event_id long, source string, content string"
    one = [(i, "s", f"User {u} logged in from 192.0.2.{i}") for i, u in enumerate(("kim", "lee", "ana"), 1)]
    two = [(i, "t", f"Disk sd{i} has {i} bad blocks now ok") for i in range(10, 14)]
    first = T.mine(spark.createDataFrame(two, schema))
    second = T.mine(spark.createDataFrame(one + two, schema))
    store = {r["pattern"]: (r["template_key"], r["occurrences"], r["first_id"]) for r in T.saved_templates(first, second).collect()}
    assert store == {"Disk <*> has <*> bad blocks now ok": ("TPL-0001", 4, 10), "User <*> logged in from <*>": ("TPL-0002", 3, 1)}
    again = T.saved_templates(T.saved_templates(first, second), second)
    assert {r["pattern"]: (r["template_key"], r["occurrences"], r["first_id"]) for r in again.collect()} == store
    old, new = (spark.createDataFrame(x, "event_id long, template_key string") for x in ([(1, "TPL-0001"), (2, "TPL-0001")], [(2, "TPL-0002"), (3, "TPL-0002")]))
    assert sorted(map(tuple, T.saved_matches(old, new).collect())) == [(1, "TPL-0001"), (2, "TPL-0002"), (3, "TPL-0002")]
    lines = spark.createDataFrame([(*r, "j") for r in one + two], schema + ", job_id string")
    assert T.in_scope(lines, "j", "t").count() == 4 and T.in_scope(lines, "k").count() == 0
    none = T.accounting(T.in_scope(lines, "k")).first()
    assert (none["records"], none["original_bytes"], none["reduction_pct"], none["reconstruction_rate"], none["lossless"]) == (0, 0, 0.0, 0.0, True)
    assert T.mismatches(lines).count() == 0 and T.accounting(lines.limit(1)).first()["reduction_pct"] < 0


def test_dashboard(spark):
    from logsluice.operators import export as X
    from logsluice.operators import pipeline as L

    web = '198.51.100.{} - - [04/Mar/2026:06:07:08 +0000] "GET /x HTTP/1.1" {} 77 "-" "curl/8.0"'
    lines = [web.format(i, 200 + 100 * (i % 4)) for i in range(8)] + [web.format(1, 300), "", "${jndi:ldap://x/a}"]
    raw = spark.createDataFrame([("j", "web", i, x) for i, x in enumerate(lines)], "job_id string, source_name string, line_number long, content string")
    done = L.processed(raw.withColumn("received_at", F.lit("2026-06-01 00:00:00").cast("timestamp")))
    cards = {r["card"]: r["value"] for r in X.overview(done).collect()}
    assert cards == {"total": 11, "processed": 8, "invalid": 1, "duplicate": 1, "quarantined": 1, "events": 8, "protected": 0, "sources": 1, "success_rate": 72.7}
    shown = {(r["chart"], r["label"]): r["value"] for r in X.charts(done).collect()}
    assert shown["outcomes", "processed"] == 8 and shown["outcomes", "quarantined"] == 1 and shown["by_severity", "high"] == 0 or shown["by_parser", "apache"] == 8
    alerts = spark.createDataFrame([("NEW", 90, 3), ("RESOLVED", 50, 1)], "status string, risk_score int, events long")
    story = {r["node"]: (r["records"], r["status"]) for r in X.pipeline_story(done, alerts, 2, 0, "MASK").collect()}
    assert story["detection"] == (11, "warn") and story["cleaning"] == (2, "warn") and story["risk"] == (2, "warn") and story["alert"] == (1, "critical") and story["correlation"] == (1, "ok") and story["pii"] == (0, "ok")
    rules = D.with_overrides(spark.createDataFrame([("RULE_1", 9, None, False), ("RULE_8", None, 30, None)], "rule_key string, threshold int, window int, enabled boolean"))
    assert (rules[0].threshold, rules[0].enabled, rules[0].window, rules[7].window, rules[7].threshold) == (9, False, 120, 30, 100)
    e = _events(spark, [(1, 1.0, "a", "h", "u", D.FAILED, "linux", None)]).withColumn("ingested_at", F.lit("2030-01-01").cast("timestamp"))
    assert D.chosen_events(e, "2029-01-01").count() == 1 and D.chosen_events(e, "2031-01-01").count() == 0
