"""The queries of the corpus operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, html_extract, jaccard_join, line_dedup, mixing, substring_dedup, token_count, token_file, toxicity
from .common import table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2

#: Weights of the mix among siblings. Domains and, within a language, sources weigh the same.
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
DOMAINS = 4


def domain():
    """documents has no domain column; a source's domain is the crc32 of its name modulo DOMAINS."""
    return F.concat(F.lit("domain"), (F.crc32(F.col("source").cast("binary")) % DOMAINS).cast("string"))


def mix_weights() -> dict[tuple, float]:
    return {(f"domain{d}", lang): w for d in range(DOMAINS) for lang, w in LANGUAGE_WEIGHTS.items()}


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return token_file.read_digests(token_file.write_segments(table(spark, sf_dir, "documents"), path, end_id=END_ID))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_count(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, domain(), F.col("lang"), F.col("source"), mix_weights(), fraction=0.5, max_epochs=2)
    return mixed.select("_row.doc_id", F.col("_leaf.d").alias("domain"), F.col("_leaf.l").alias("lang"), F.col("_leaf.s").alias("source"), F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"))


QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_line_dedup, op3_toxicity, op4_substring_dedup, op5_nearest_neighbours, op6_decontamination, op7_token_file, op8_token_count, op9_jaccard_join, op10_mixing,
)}

ORACLE_SQL = {
    "op4_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 33, 1))) AS pos, words FROM w),
        g AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 34], ' ')) AS h FROM s),
        r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
        hit AS (SELECT DISTINCT doc_id, pos + k AS at FROM (SELECT g.doc_id, g.pos, unnest(range(0, 35)) AS k FROM g JOIN r USING (h))),
        one AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS at, unnest(words) AS word FROM w),
        kept AS (SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.at) FILTER (WHERE hit.at IS NULL) AS text, count(hit.at) AS n_removed
                 FROM one LEFT JOIN hit ON one.doc_id = hit.doc_id AND one.at = hit.at GROUP BY one.doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 2], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS pos FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
        c AS (SELECT doc_id AS node, doc_id AS least FROM w UNION SELECT l.b, c.least FROM c JOIN l ON l.a = c.node)
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
        FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(least) AS component_id FROM c GROUP BY node) m USING (doc_id)
    """,
}
