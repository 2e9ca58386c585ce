"""The corpus pipeline: documents go through STAGES in order, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), where docs has the columns of documents (doc_id, text, lang, source, n_chars and
any others), and works on all rows that the stage before kept. All stages but the last return the same columns.
Nulls, empty texts, repeated rows and empty tables have the results that the operators' modules define.
"""

from __future__ import annotations

from logsluice.llm import exact_dedup, lattice, mixing, ngram_join, toxicity
from logsluice.llm.common import materialize, table


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier does not predict as toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def drop_copies(spark, docs, sf_dir):
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of documents linked by five-word shingles at a similarity of 0.75 or more, the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark, docs, sf_dir):
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def encode(spark, docs, sf_dir):
    """Sampled piece ids of each document, checked to decode to its text."""
    import public_tokenizers

    rows = lattice.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_pieces", "ids_crc32", "lossless", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]

#: The first and last stages use a learned model and a hash-seeded lattice sampler, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
