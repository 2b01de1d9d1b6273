"""The registered queries of the text operators, with SQL where SQL can say the same.

Predictions, searches, tokens and iterative links have no SQL counterpart; their tests compare them with
brute force or held-out rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (exact_dedup, hard_negatives, importance, langid, mixing, packing, paragraph_dedup, parity_join, permutation_index, tag_paths,
               token_histogram, toxicity, warc)
from .common import Scratch, crc_mod

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WINDOW, END_ID = 4096, 2


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """Path of the public tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 3) == 1
    model = langid.train(docs.filter(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op2_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
""")
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(table(spark, sf_dir, "documents"), all_hashes=True).drop("text_key")


@query("op3_nearest_vectors")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Characters of all documents, labels of those not held out."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    return toxicity.train(docs, labels, toxicity.train_chars(docs))


@query("op4_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_repeated_paragraphs")
def repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(table(spark, sf_dir, "documents"), min_words=50)


@query("op6_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf_dir, "documents")).drop("set_id")


@query("op7_token_histogram")
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_histogram.token_counts(table(spark, sf_dir, "documents"), word_tokenizer())
    return token_histogram.length_histogram(counts)


@query("op8_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op9_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), END_ID, WINDOW)


@query("op10_mixing")
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, payload, octet_length(payload) AS payload_bytes, sha1(payload) AS hex,
                  max(page_id) OVER (PARTITION BY payload) AS keep FROM p),
     n AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS fives FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v >> 15 AS INTEGER) + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) & 31 AS INTEGER) + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) & 31 AS INTEGER) + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM n
""")
def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark).root}/archive"
    warc.archive_texts(table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path).drop("intact")


@query("op12_importance", r"""
WITH RECURSIVE step(v, c, k) AS (SELECT range, range, 0 FROM range(256)
         UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
     crc AS (SELECT list(c ORDER BY v) AS entry FROM step WHERE k = 8),
     texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
     words AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
     runs AS (SELECT side, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                  || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM words),
     counted AS (SELECT side, doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
     coded AS (SELECT run, hex(run) AS digits FROM (SELECT DISTINCT run FROM counted)),
     hashed AS (SELECT run, xor(list_reduce([4294967295] || list_transform(range(len(digits) // 2), lambda i: CAST('0x' || substr(digits, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)),
                                            lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM coded, crc),
     cells AS (SELECT side, doc_id, bucket, sum(n) AS n FROM counted JOIN hashed USING (run) GROUP BY ALL),
     sums AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM cells GROUP BY bucket),
     totals AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS all_s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS all_t FROM sums),
     gains AS (SELECT bucket, floor(1000 * ln((coalesce(CAST(t AS DOUBLE), 0) + 1) * (all_s + 10000) / ((coalesce(CAST(s AS DOUBLE), 0) + 1) * (all_t + 10000)))) AS gain FROM sums, totals),
     weights AS (SELECT doc_id, sum(n * gain) AS weight FROM cells JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
     scored AS (SELECT doc_id, len(w) AS size, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features,
                       CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                       CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
                FROM words LEFT JOIN weights USING (doc_id) WHERE side = 0),
     ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE size >= 20
                QUALIFY rank <= 5 * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN ranked USING (doc_id)
""")
def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                  CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
     p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
""")
def hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", shifted), F.col("vec_id") % 50 == 0)
