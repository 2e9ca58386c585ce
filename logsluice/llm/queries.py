"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import clustering, exact_dedup, lattice, mixing, neighbours, ngram_join, pii, substring_dedup, token_files, topk, toxicity, warc, whitening
from .common import table


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


OP5_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


def op6_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op1_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM q
"""


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op3_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP3_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT q.r AS q, q.vec_id AS query_id, c.r AS c, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.r <> c.r AND q.vec_id % 100 = 0 AND len(q.e) = len(c.e)
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS INTEGER) AS rank, vec_id, score
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op4_find_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_token_files(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_files.token_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_lattice_pieces(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return lattice.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op11_annulus_clusters(spark, sf_dir):
    return clustering.clustered(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _op11_sql(rounds: int = 3) -> str:
    """Rounds one after the other: a distance of every vector to every centroid, the least of them, the floor of the means."""
    apart = "list_sum(list_transform(list_zip(v.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT v.r, min({{'d': CAST({apart} AS BIGINT), 'j': c.j}}) AS m FROM v, c{i} c GROUP BY v.r)")
        if i < rounds:
            steps.append(
                f"m{i} AS (SELECT j, list(CAST(f AS BIGINT) ORDER BY i) AS c FROM (SELECT a{i}.m.j AS j, g.i AS i, (sum(v.x[g.i]) - ((sum(v.x[g.i]) % count(*)) + count(*)) % count(*)) // count(*) AS f "
                f"FROM a{i} JOIN v USING (r), range(1, 65) g(i) GROUP BY 1, 2) GROUP BY j)"
            )
            steps.append(f"c{i + 1} AS (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m USING (j))")
    return f"""
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS (
    SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS j, x AS c FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT 16)
), {", ".join(steps)}
SELECT v.vec_id, a.m.j AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.j = a.m.j
"""


def op12_cross_polytope(spark, sf_dir):
    return neighbours.neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def queries():
    return {
        "op1_warc": op1_warc,
        "op2_toxicity": op2_toxicity,
        "op3_top_k": op3_top_k,
        "op4_find_pii": op4_find_pii,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_ngram_join": op6_ngram_join,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_mix_sources": op8_mix_sources,
        "op9_token_files": op9_token_files,
        "op10_lattice_pieces": op10_lattice_pieces,
        "op11_annulus_clusters": op11_annulus_clusters,
        "op12_cross_polytope": op12_cross_polytope,
        "op13_whitening": op13_whitening,
    }


def oracle_sql():
    return {"op1_warc": OP1_SQL, "op3_top_k": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op11_annulus_clusters": _op11_sql()}
