"""Keyed tables, the template store, the search index."""

import random

import pytest
from pyspark.sql import functions as F

from logsluice.functions.keyed import KeyedTable
from logsluice.operators import template_store as TS
from logsluice.operators import templates as T

ROW = "k long, n long, s string"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upserts_against_a_dictionary(spark, tmp_path):
    rng = random.Random(2)
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k", buckets=5)
    assert not table.exists()
    with pytest.raises(ValueError, match="no rows yet"):
        table.read()
    want: dict = {}
    for number in range(4):
        batch = {rng.randrange(40): (rng.randrange(9), rng.choice("xyz")) for _ in range(rng.choice([3, 12]))}
        df = spark.createDataFrame([(k, *v) for k, v in batch.items()], ROW)
        assert table.upsert(df, "w", number, {"n": "sum", "s": "old"})
        for k, (n, s) in batch.items():
            want[k] = (want[k][0] + n, want[k][1]) if k in want else (n, s)
        assert _rows(table.read()) == sorted(((k, *v) for k, v in want.items()), key=str)
        before = table.manifest()
        assert not table.upsert(df, "w", number, {"n": "sum"}) and not table.upsert(df, "w", 0) and table.manifest() == before
    key = next(iter(want))
    assert _rows(table.get(key)) == [(key, *want[key])] and table.get(10**6).count() == 0
    assert table.upsert(spark.createDataFrame([(key, 1, 2.5)], "k long, n long, more double"), "other", 0, {"n": "max"})
    got = {r["k"]: r for r in table.read().collect()}
    assert got[key]["more"] == 2.5 and got[key]["s"] == want[key][1] and got[key]["n"] == max(1, want[key][0]) and sum(r["more"] is not None for r in got.values()) == 1
    assert table.upsert(spark.createDataFrame([], ROW), "w", 99) and table.read().count() == len(want)


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k", buckets=8)
    table.upsert(spark.range(200).selectExpr("id AS k", "id AS n", "'a' AS s"), "w", 0)
    before = {p["bucket"]: p["generation"] for p in table.manifest()["places"]}
    table.upsert(spark.createDataFrame([(7, 1, "b")], ROW), "w", 1)
    after = {p["bucket"]: p["generation"] for p in table.manifest()["places"]}
    assert sum(before[b] != after[b] for b in after) == 1 and len(after) == 8
    assert [(r["bucket"], r["path"].split("/")[-2]) for r in table.superseded().collect()] == [(b, before[b]) for b in after if before[b] != after[b]]


def test_a_lost_run_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k", buckets=4)
    table.upsert(spark.range(20).selectExpr("id AS k", "id AS n", "'a' AS s"), "w", 0)
    old = _rows(table.read())
    new = spark.range(10, 30).selectExpr("id AS k", "id * 2 AS n", "'b' AS s")
    with monkeypatch.context() as m:  # the run ends after the data, before the manifest
        m.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            table.upsert(new, "w", 1)
    assert _rows(table.read()) == old
    # the run ends while tasks write
    with pytest.raises(Exception, match="too far"):
        table.upsert(new.withColumn("n", F.when(F.col("k") == 29, F.raise_error(F.lit("too far"))).otherwise(F.col("n")).cast("long")), "w", 1)
    assert _rows(table.read()) == old
    assert table.upsert(new, "w", 1) and table.read().count() == 30
    assert _rows(table.read()) == sorted([(k, k, "a") for k in range(10)] + [(k, 2 * k, "b") for k in range(10, 30)], key=str)


@pytest.mark.parametrize("rows", [[(1, 1, "a"), (1, 2, "b")], [(None, 1, "a")]])
def test_batches_need_one_row_per_key(spark, tmp_path, rows):
    with pytest.raises(ValueError, match="one row per key"):
        KeyedTable(spark, f"file://{tmp_path}/t", "k").upsert(spark.createDataFrame(rows, ROW), "w", 0)


LINES = "event_id long, source string, content string"


def _plain_match(tokens, templates):
    fits = [(-sum(x is not None for x in lits), len(k), k) for k, lits in templates.items() if len(lits) == len(tokens) and all(x is None or x == t for x, t in zip(lits, tokens, strict=True))]
    return min(fits)[2] if fits else None


def test_matching_against_trying_every_template(spark, monkeypatch):
    rng = random.Random(6)
    words = ["a", "b", "c", "d"]
    templates = {}
    for i in range(60):
        templates[f"TPL-{i + 9980:04d}"] = [rng.choice([None, None, *words]) for _ in range(rng.randint(1, 6))]
    tpl = spark.createDataFrame([(k, v, len(v)) for k, v in templates.items()], "template_key string, literals array<string>, n_tokens int").withColumn("shape", F.xxhash64("n_tokens", "literals"))
    lines = [[rng.choice(words) for _ in range(rng.randint(1, 7))] for _ in range(500)]
    df = spark.createDataFrame([(i, len(t), t) for i, t in enumerate(lines)], "row long, n_tokens int, tokens array<string>")
    want = {i: k for i, t in enumerate(lines) if (k := _plain_match(t, templates))}
    assert {r["row"]: r["template_key"] for r in TS.match(df, tpl).collect()} == want and len(want) > 100
    monkeypatch.setattr(TS, "MOST_PLACES", 0)
    assert {r["row"]: r["template_key"] for r in TS.match(df, tpl).collect()} == want


def test_later_runs_mine_new_lines_only(spark, tmp_path):
    login = lambda i: (i, "auth", f"login of user{i} from 10.0.0.{i % 200} ok")
    disk = lambda i: (i, "disk", f"disk  sda{i} is {i % 90}% full ")
    frame = lambda rows: spark.createDataFrame(rows, LINES)
    store = TS.TemplateStore(spark, f"file://{tmp_path}/store")
    first = [login(i) for i in range(30)] + [(99, "auth", "   ")]
    assert store.run(frame(first), 1) and not store.run(frame(first), 1)
    one = {r["template_key"]: r for r in store.templates.read().collect()}
    assert [(r["template_key"], r["occurrences"], r["pattern"]) for r in one.values()] == [("TPL-0001", 30, "login of <*> from <*> ok")]
    more = first + [login(i) for i in range(100, 120)] + [disk(i) for i in range(200, 230)]
    assert store.run(frame(more), 2)
    two = {r["template_key"]: r for r in store.templates.read().collect()}
    assert {k: (r["occurrences"], r["first_id"], r["last_id"], r["sources"]) for k, r in two.items()} == {"TPL-0001": (50, 0, 119, ["auth"]), "TPL-0002": (30, 200, 229, ["disk"])}
    assert two["TPL-0001"]["signature"] == one["TPL-0001"]["signature"]
    restored = {r["event_id"]: r["restored"] for r in T.reconstruct(store.payloads()).collect()}
    assert restored == {i: c for i, _, c in more if c.strip()}
    before = _rows(store.templates.read())
    assert store.run(frame(more), 3) and _rows(store.templates.read()) == before  # nothing new


def test_a_run_lost_between_templates_and_matches(spark, tmp_path, monkeypatch):
    rows = [(i, "a", f"job {i} done") for i in range(20)]
    df = spark.createDataFrame(rows, LINES)
    store = TS.TemplateStore(spark, f"file://{tmp_path}/store")
    upsert = KeyedTable.upsert
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "upsert", lambda self, *a: (_ for _ in ()).throw(RuntimeError("lost")) if self.path.endswith("matches") else upsert(self, *a))
        with pytest.raises(RuntimeError):
            store.run(df, 1)
    assert store.run(df, 1)
    assert [(r["template_key"], r["occurrences"]) for r in store.templates.read().collect()] == [("TPL-0001", 20)] and store.matches.read().count() == 20


def _events(spark, n, rng):
    rows = []
    for i in range(n):
        rows.append((i, None if i % 97 == 0 else rng.randrange(0, 4000), rng.choice(["10.0.0.1", "10.0.0.1", "10.0.0.2", "10.9.0.3", None]), f"host-{i % 5}", f"user{i % 211}" if i % 13 else None, rng.choice(["Disk İs full", "ΣΑΣ ok", "login % _ failed", None, "x"]), rng.randrange(100)))
    base = F.lit("2026-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame(rows, "event_id long, s long, source_ip string, host string, username string, message string, source_port int")
    return df.withColumn("timestamp", F.timestamp_micros(F.unix_micros(base) + F.col("s") * 1_000_000)).drop("s").withColumn("source", F.lit("a")), rows


def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    from logsluice.operators import query as Q
    from logsluice.operators import text_index as X

    events, _ = _events(spark, 3000, random.Random(4))
    rare = events.withColumn("message", F.when(F.col("event_id").isin(17, 2900), "a needle here").otherwise(F.col("message")))
    monkeypatch.setattr(X, "BLOCK_ROWS", 32)
    path = f"file://{tmp_path}/index"
    X.write(rare, path, 6)
    for text in ("NEEDLE", "needle h", "user77", "0.0.2", "% _", "is full", "σας", "st-3", "x", "ab", "not there at all", "zzz", "a needle herehost"):
        for q in (Q.EventQuery(text=text), Q.EventQuery(text=text, equal={"host": "host-2"}, since="2026-01-01 00:10:00")):
            want = sorted(r["event_id"] for r in Q.search(rare, q).collect())
            assert sorted(r["event_id"] for r in X.search(spark, path, q).collect()) == want, (text, q)
    few, every = X.scanned(spark, path, Q.EventQuery(text="needle"))
    print("rows scanned", few, "of", every)
    assert every == 3000 and few <= 2 * 32 and Q.search(rare, Q.EventQuery(text="needle")).count() == 2
    monkeypatch.setattr(X, "MOST_SHELVES", 0)
    assert X.search(spark, path, Q.EventQuery(text="needle")).count() == 2


def test_sketches_against_a_direct_pass(spark):
    from logsluice.operators import rollups as R

    rng = random.Random(5)
    events, rows = _events(spark, 4000, rng)
    minutes = R.sketched(events, ["host", "source"], ["username"], ["source_port"])
    hours = R.merged(minutes, ["source"], "hour")
    direct = R.sketched(events, ["source"], ["username"], ["source_port"], "hour")
    shown = lambda df: sorted((str(r["bucket"]), r["n"], r["c_source_port"], r["u"], r["p"]) for r in df.withColumn("u", F.hll_sketch_estimate("d_username")).withColumn("p", R.percentile("source_port", 0.5)).collect())
    for (b, n, c, u, p), (b2, n2, c2, u2, _) in zip(shown(hours), shown(direct), strict=True):
        mine = [r for r in rows if r[1] is not None and str(r[1] // 3600) == b[11:13].lstrip("0") + ("0" if b[11:13] == "00" else "")]
        assert (b, n, c, u) == (b2, n2, c2, u2) and n == len(mine)
        ports = sorted(r[6] for r in mine)
        assert abs(u - len({r[4] for r in mine if r[4]})) <= 4 * 1.04 / 64 * u + 1
        low, high = sum(x < p for x in ports) / n, sum(x <= p for x in ports) / n
        assert low - 2 * R.ERROR <= 0.5 <= high + 2 * R.ERROR
    total = R.merged(minutes, [], None).withColumn("p", R.percentile("source_port", 0.95)).first()
    assert total["n"] == sum(r[1] is not None for r in rows) and 90 <= total["p"] <= 98
    none = R.merged(R.sketched(events.where("false"), ["source"], ["username"], ["source_port"]), ["source"], "hour")
    assert none.count() == 0


@pytest.mark.parametrize("top", [1, 3, 25])
def test_nearest_events_against_all_pairs(spark, top):
    from logsluice.operators import detail as B

    events, rows = _events(spark, 700, random.Random(top))
    crowded = events.withColumn("timestamp", F.when(F.col("event_id") % 3 == 0, F.lit("2026-01-01 00:20:00").cast("timestamp")).otherwise(F.col("timestamp")))
    asked = crowded.where("event_id % 5 < 2")
    at = {r["event_id"]: (r["source_ip"], r["t"]) for r in crowded.select("event_id", "source_ip", F.unix_micros("timestamp").alias("t")).collect()}
    want = []
    for i in (i for i in at if i % 5 < 2):
        ip, t = at[i]
        if ip is not None and t is not None:
            near = sorted((abs(u - t), j) for j, (jp, u) in at.items() if jp == ip and u is not None and j != i and abs(u - t) <= 300_000_000)
            want += [(i, j, gap, n) for n, (gap, j) in enumerate(near[:top], 1)]
    got = sorted(tuple(r) for r in B.related(crowded, asked, 300, top).select("of", "event_id", "gap", "nth").collect())
    assert got == sorted(want) and got


def test_correlation_takes_events_of_named_entities(spark, monkeypatch):
    from logsluice.operators import incidents as I

    events, rows = _events(spark, 400, random.Random(3))
    spots = spark.createDataFrame([("source_ip", "10.0.0.1", 1000, 60), ("username", "user7", 2000, 900), ("host", "host-3", 1500, 60), ("host", "nowhere", 10, 60)], "kind string, entity string, s long, w int")
    spots = spots.withColumn("center", F.timestamp_micros(F.unix_micros(F.lit("2026-01-01 00:00:00").cast("timestamp")) + F.col("s") * 1_000_000)).drop("s")
    name = {"source_ip": 2, "username": 4, "host": 3}
    want = sorted((k, e, r[0]) for k, e, c, w in (("source_ip", "10.0.0.1", 1000, 60), ("username", "user7", 2000, 900), ("host", "host-3", 1500, 60)) for r in rows if r[1] is not None and r[name[k]] == e and abs(r[1] - c) <= w)
    for most in (100, 0):
        monkeypatch.setattr(I, "MOST_NAMED", most)
        got = sorted((r["kind"], r["entity"], r["event_id"]) for r in I.around(spots, events, "w", ["event_id"]).collect())
        assert got == want and got
