"""The "logs" data source, JSON documents of any size."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from logsluice.sources import datasource, files, json_index

ENDS = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " "]


def _folder(path, seed):
    rng = random.Random(seed)
    words = ["", " ", "a", "héllo", "漢字", "\t", "x" * 30, '"q"']
    texts = {}
    for i in range(6):
        body = "".join(rng.choice(words) + rng.choice(ENDS if i % 2 else ENDS[:4]) for _ in range(rng.randint(0, 120)))
        texts[f"f{i}.log"] = (body + ("" if i % 3 else "no end"), "utf-8-sig" if i == 2 else "utf-8")
    texts["l.txt"] = ("thré\none\rcafé\r\n\n" * 9, "latin-1")
    texts["long.txt"] = ("short\n" + "y" * 300_000 + "\r\nlast", "utf-8")
    for name, (text, encoding) in texts.items():
        (path / name).write_bytes(text.encode(encoding))
    (path / "skip.bin").write_text("not a log")
    (path / "empty.log").write_text("")
    return texts


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_give_every_line_once(tmp_path, size):
    texts = _folder(tmp_path, size)
    for name, (text, encoding) in texts.items():
        if name == "long.txt" and size < 64:
            continue
        raw = text.encode(encoding)
        found = [r for p in datasource._cut(str(tmp_path / name), 0, len(raw), size) for b in datasource.rows(p) for r in b.to_pylist()]
        if encoding != "latin-1":
            assert [r["content"] for r in found] == [x[: files.MOST_CHARS] for x in raw.decode(encoding).splitlines()], name
        assert [r["offset"] for r in found] == sorted(r["offset"] for r in found)


def test_logs_as_the_text_reader(spark, tmp_path):
    _folder(tmp_path, 3)
    want = sorted((r["file"].rpartition("/")[2], r["line_number"], r["content"]) for r in files.read_lines(spark, str(tmp_path)).collect())
    got = sorted((r["file"].rpartition("/")[2], r["line_number"], r["content"]) for r in datasource.read_logs(spark, str(tmp_path), rangeBytes=3000).collect())
    # str.splitlines ends no line after a last rare end, the text reader does
    assert [r for r in want if r[2] or r in got] == [r for r in got if r[2] or r in want] and len(got) > 100


def test_filters_are_pushed(spark, tmp_path):
    _folder(tmp_path, 4)
    (tmp_path / "long.txt").unlink()
    load = lambda push=True: spark.read.format("logs").options(rangeBytes=40, pushFilters=push).load(str(tmp_path))
    datasource.register(spark)
    same = load(False)
    every = same.collect()
    mine = sorted(tuple(r) for r in every if r["file"].endswith("f1.log"))
    parts = load().rdd.getNumPartitions()
    one = load().where(F.col("file").endswith("f1.log"))
    assert sorted(tuple(r) for r in one.collect()) == mine and one.rdd.getNumPartitions() < parts / 3
    low = load().where(F.col("file").endswith("f1.log") & (F.col("offset") >= 100))
    assert sorted(tuple(r) for r in low.collect()) == [r for r in mine if r[3] >= 100] and low.rdd.getNumPartitions() < one.rdd.getNumPartitions()
    assert load().where(F.col("file").isin(*{r["file"] for r in every}) & (F.col("offset") < 80)).count() == len([r for r in every if r["offset"] < 80])
    assert load().where("file = 'none'").count() == 0
    # without the option a frame can be used again with other filters
    assert same.where(F.col("file").endswith("f1.log")).count() == len(mine) and same.count() == len(every)


@pytest.mark.parametrize("kind", ["SYSLOG", "HTTP", "WINDOWS", "FIREWALL", "OTHER"])
def test_kinds_that_are_not_set_up(spark, kind):
    datasource.register(spark)
    with pytest.raises(PySparkException, match="NOT_CONFIGURED" if kind != "OTHER" else "unknown kind"):
        spark.read.format("logs").option("kind", kind).load("/nowhere").count()
    assert {r["kind"]: r["status"] for r in datasource.kinds(spark).collect()}.get(kind, "NOT_CONFIGURED") == "NOT_CONFIGURED"


def test_stream_takes_ended_lines_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    datasource.register(spark)
    (folder / "a.log").write_text("one\ntwo\nthr")

    def run():
        q = spark.readStream.format("logs").option("rangeBytes", 5).load(str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(once=True)
        q.start().awaitTermination()
        return sorted((r["file"].rpartition("/")[2], r["offset"], r["content"]) for r in spark.read.parquet(out).collect())

    assert run() == [("a.log", 0, "one"), ("a.log", 4, "two")]
    with (folder / "a.log").open("a") as f:
        f.write("ee\nfour\n")
    (folder / "b.log").write_text("x\n")
    got = run()
    assert got == [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "three"), ("a.log", 14, "four"), ("b.log", 0, "x")]
    assert run() == got  # nothing new
    lines = {(r["file"].rpartition("/")[2], r["line_number"]): r["content"] for r in files.read_lines(spark, str(folder)).collect()}
    assert [c for f, _, c in got if f == "a.log"] == [lines["a.log", i] for i in range(1, 5)]


def _value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 0:
        return rng.choice([None, True, False, 1.5, -7, 10**20])
    if kind < 5:
        return "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "é", "漢", "\n", "a", " ", " ", '\\"', ":"]) for _ in range(rng.randint(0, 12)))
    if kind < 7:
        return {rng.choice(["a", "events", "b,", "c]"]) + str(i): _value(rng, depth + 1) for i in range(rng.randint(0, 4))}
    return [_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]


def _plain(text):
    """Records by the standard parser."""
    compact = lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    try:
        v = json.loads(text)
        if isinstance(v, list):
            return [compact(x) for x in v]
        if isinstance(v, dict):
            for key in ("events", "records", "logs", "data"):
                if isinstance(v.get(key), list):
                    return [compact(x) for x in v[key]]
            return [compact(v)]
    except ValueError:
        pass
    return text.splitlines()


@pytest.mark.parametrize("size", [1, 60, 1 << 20])
def test_json_against_the_standard_parser(spark, tmp_path, size):
    rng = random.Random(size)
    texts = {}
    for i in range(14):
        v = [_value(rng) for _ in range(rng.randint(0, 12))]
        if i % 2:
            v = {"head": _value(rng), **({"data": _value(rng), "events" if i % 4 == 1 else "logs": v} if i % 3 else {"x": v}), "tail": _value(rng)}
        texts[f"v{i}.json"] = json.dumps(v, ensure_ascii=bool(i % 3 == 0), indent=rng.choice([None, 1]), separators=rng.choice([(",", ":"), (" ,", " : ")]))
    texts |= {
        "empty.json": "[]", "blank.json": " [ \n ] ", "one.json": "[{}]", "nested.json": "[[],[[]],{}]", "lines.ndjson": '{"a": 1}\n{"a": [1,2]}\r\n\n{"b": "x,y"}', "twice.json": "[1] [2]", "cut.json": '[{"a": 1}, {"b": ',
        "bad.json": '[{"a": 1}, nope]', "comma.json": "[1,2,]", "mixed.json": "[1}", "scalar.json": '"text, more"', "text.log": "a, b\nc,", "deep.json": '{"events": {"a": [1,2]}, "logs": [1, [2, 3], {"x": [4, 5]}], "data": [9]}',
        "quote.json": '["a\\\\", "b\\"", "\\u002c"]', "space.json": "\n\n{ \"records\" : [ ] }\n", "stray.json": "x [1,2]", "open.json": '["a, b',
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode("utf-8-sig" if name == "one.json" else "utf-8"))
    (tmp_path / "latin.json").write_bytes('[{"a": "café"}, "thé"]'.encode("latin-1"))
    texts["latin.json"] = '[{"a": "café"}, "thé"]'
    got = {}
    for r in json_index.read_json(spark, str(tmp_path), size).orderBy("line_number").collect():
        got.setdefault(r["file"].rpartition("/")[2], []).append((r["line_number"], r["content"]))
    for name, text in texts.items():
        assert got.get(name, []) == list(enumerate(_plain(text), 1)), name


def test_one_large_array_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(9)
    values = [{"id": i, "text": "word, " * rng.randint(0, 60), "tags": ["a]", '"', {"n": i}]} for i in range(20_000)]
    (tmp_path / "large.json").write_text(json.dumps({"meta": {"n": [1, 2]}, "records": values, "end": 1}))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        cut = json_index.chunks(spark, str(tmp_path), 1 << 16)
        assert cut.select("block").distinct().count() > 8
        got = json_index.read_json(spark, str(tmp_path), 1 << 16).orderBy("line_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [json.loads(r["content"]) for r in got] == values and [r["line_number"] for r in got] == list(range(1, len(values) + 1))


def test_larger_tables_have_more_tasks(spark, tmp_path, monkeypatch):
    from logsluice.sources import testdata

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(testdata, "TASK_LINES", 50)
    n = spark.read.parquet(str(tmp_path / "events.parquet")).count()
    lines = testdata.log_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == -(-n // 50) and lines.count() == n
