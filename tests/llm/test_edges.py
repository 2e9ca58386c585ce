"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator and pipeline stage."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from logsluice.llm import exact_dedup, lattice, mixing, ngram_join, pii, substring_dedup, token_files, topk, toxicity, warc
from logsluice.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, key long, at long"
LONG = " ".join(f"word{i % 977}x{i // 3}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5),
    (2, "the quick  brown fox jumps over the lazy dog near the river bank today", "en", None, 5),
    (2, "the quick  brown fox jumps over the lazy dog near the river bank today", "en", None, 5),
    (3, None, "en", "b", None),
    (4, "", None, "b", 0),
    (None, "no id here idiot", "en", "a", 1),
    (5, LONG, "en", "c", len(LONG)),
    (6, "café 漢字 \U0001f600 ▁ x\x00y\r\n\tz", "fr", "é", 3),
    (7, "a" * 50_000, "en", "b", 1),
    (8, "mail bob (at) example [dot] com or bob@example.com", "en", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, True, 1, 2, 3) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2)) for i in range(10)] + [(None, 1), (3, None)], "doc_id long, toxic int")


WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def runs(labels):
    return {
        "exact": exact_dedup.exact_dedup, "mix": mixing.mix, "pii": pii.find_pii, "ngram": ngram_join.near_duplicates, "substring": substring_dedup.substring_dedup,
        "toxicity": lambda d: toxicity.score_toxicity(d, labels), "tokens": lambda d: token_files.token_round_trip(d, WORDS), "pieces": lambda d: lattice.encode_pieces(d, PIECES),
    }


@pytest.mark.parametrize("name", ["exact", "mix", "pii", "ngram", "substring", "toxicity", "tokens", "pieces"])
def test_one_row_per_row(name, docs, none, labels):
    run = runs(labels)[name]
    got = run(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert run(none).count() == 0


def test_exact(docs):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {(1, 1, 3, True), (2, 1, 3, False), (3, 3, 2, True), (4, 3, 2, False), (None, None, 1, True)} <= got
    assert sorted(str(r["doc_id"]) for r in exact_dedup.keep_first(docs).collect()) == ["1", "3", "5", "6", "7", "8", "None"]


def test_mix_null_source_last(docs):
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert got[3]["size"] == 0 and got[3]["taken"] == 0
    assert all(r["taken"] <= 2 * r["size"] for r in got.values())
    assert mixing.mixed(docs).columns == docs.columns


def test_ngram_empty_sets_stay_alone(docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert {(1, 10, 1), (2, 10, 1), (3, 0, 3), (4, 0, 4), (7, 1, 7)} <= got and any(r[0] is None and r[2] is None for r in got)


def test_pieces_are_lossless_and_repeatable(docs):
    one, two = (sorted(lattice.encode_pieces(docs, PIECES).collect(), key=str) for _ in range(2))
    assert one == two and all(r["lossless"] for r in one)
    back = {r["doc_id"]: r["text"] for r in lattice.decode_pieces(lattice.encode_pieces(docs, PIECES), PIECES).collect()}
    assert back == {r[0]: r[1] or "" for r in ROWS}


def test_token_files_are_in_order(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    got = sorted(token_files.read_tokens(token_files.write_tokens(docs, new_path(docs.sparkSession, "t"), WORDS, bits=True), with_ids=True).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert all(r["ids"] == [*tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2] for r in got)
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8]


def test_pages(spark):
    rows = [(1, "http://x.example/ä b\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "u", "é" * 400_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    index = warc.write_archive(pages, new_path(spark, "w"))
    got = {r["page_id"]: r for r in warc.read_archive(index).collect()}
    assert {k: (r["record_type"], r["refers_to"], r["payload_bytes"]) for k, r in got.items()} == {
        1: ("revisit", 2, 8), 2: ("response", None, 8), 3: ("revisit", 4, 0), 4: ("response", None, 0), None: ("revisit", 2, 8), 5: ("response", None, 800_000),
    }
    assert got[5]["payload_digest"] == warc.digest(("é" * 400_000).encode()) and bytes(got[2]["payload"]) == b"<p>x</p>"
    assert [bytes(r["payload"]) for r in warc.fetch(index.where("page_id = 2")).collect()] == [b"<p>x</p>"]
    assert {r["record_type"] for r in warc.archive_round_trip(pages.where("page_id < 3")).collect()} == {"response", "revisit"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.read_archive(warc.write_archive(pages, new_path(spark, "w"), min_bytes=9)).collect()} == {"response"}


def test_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, None]), (3, None), (4, [nan, 1.0]), (5, []), (6, [0.5, 0.5]), (7, [1.0]), (None, [9.0, 9.0]), (100, [-1.0, 0.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")).orderBy("query_id", "rank").collect()]
    s = 1024 * 512 + 512 * 512  # both rows of id 1 are candidates
    assert got == [(0, 1, 1, s), (0, 2, 1, s), (0, 3, 6, s), (0, 4, 100, -(1024**2)), (100, 1, 1, -1024 * 512), (100, 2, 1, -1024 * 512), (100, 3, 6, -1024 * 512), (100, 4, 0, -(1024**2))]
    twice = [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0]), (0, [1.0]), (0, [2.0])], "vec_id long, embedding array<float>")).collect()]
    assert sorted(twice) == sorted([(0, 1, 0, 2 * 1024**2), (0, 2, 0, 1024**2)] * 2 + [(0, 1, 0, 2 * 1024**2), (0, 2, 0, 2 * 1024**2)])
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, none, labels, tmp_path, at):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = corpus_pipeline.STAGES[at][1]
    for table in (docs, none):
        out = stage(spark, table, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{hashlib.md5(str(id(table)).encode()).hexdigest()}")
        if at < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
