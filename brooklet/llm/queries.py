"""The corpus operators as queries over the tables of a folder, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import op1_site_style, op2_records, op3_cover_tree, op4_packing, op5_toxicity, op6_decontamination, op7_token_counts, op8_secrets, op9_language, op10_jaccard


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_site_style_text(spark, sf_dir):
    return op1_site_style.extract(_read(spark, sf_dir, "pages"))


def op2_token_records(spark, sf_dir):
    return op2_records.token_records(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_cover_tree_links(spark, sf_dir):
    return op3_cover_tree.threshold_links(_read(spark, sf_dir, "embeddings"))


def op4_packed_sequences(spark, sf_dir):
    return op4_packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_toxicity_scores(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return op5_toxicity.score(docs, op5_toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op6_benchmark_leaks(spark, sf_dir):
    return op6_decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_token_totals(spark, sf_dir):
    return op7_token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_secret_spans(spark, sf_dir):
    return op8_secrets.scan_report(_read(spark, sf_dir, "documents"))


def op9_languages(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return op9_language.predict(docs, op9_language.train(docs))


def op10_jaccard_components(spark, sf_dir):
    return op10_jaccard.jaccard_classes(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_site_style_text,
        op2_token_records,
        op3_cover_tree_links,
        op4_packed_sequences,
        op5_toxicity_scores,
        op6_benchmark_leaks,
        op7_token_totals,
        op8_secret_spans,
        op9_languages,
        op10_jaccard_components,
    )
}

ORACLE = {
    "op3_cover_tree_links": """
WITH RECURSIVE ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(u, w) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
), least AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM embeddings v JOIN least c ON c.u = v.vec_id LEFT JOIN (SELECT u, count(*) AS n_links FROM links GROUP BY u) n ON n.u = v.vec_id
""",
    "op10_jaccard_components": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
f AS (SELECT doc_id, unnest(sh) AS x FROM s),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n_shingles + b.n_shingles - c)),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT n.doc_id, n.n_shingles, min(r.v) AS component_id FROM n JOIN reach r ON r.u = n.doc_id GROUP BY ALL
""",
}
