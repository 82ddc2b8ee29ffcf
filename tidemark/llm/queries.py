"""The registered queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import toxicity
from tidemark.llm.exact_topk import top_products
from tidemark.llm.html_blocks import extract
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.pii import digests
from tidemark.llm.sentence_pieces import encode_digests
from tidemark.llm.shared import table
from tidemark.llm.substring_dedup import cut_digests
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.vector_links import near_vectors

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_digests(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep_text=False).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_packing, op2_sentencepiece, op3_substring_dedup, op4_minhash_near_dedup, op5_html_extraction, op6_token_counts, op7_pii, op8_embedding_near_dedup, op9_toxicity, op10_exact_topk)}

#: Words are runs of anything but these six characters.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REACH = """, links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(v, w) AS (SELECT DISTINCT a, a FROM links UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.w = links.a),
least_ AS (SELECT v, min(w) AS label FROM reach GROUP BY v)"""

ORACLES: dict[str, str] = {
    "op3_substring_dedup": f"""WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
    s AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w),
    k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(words[s:s + 19], ' ') ORDER BY doc_id, s) AS n FROM s),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM k WHERE n > 1),
    each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')")} AS words FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(words[s:s + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS s FROM w WHERE len(words) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    pairs AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)){REACH}
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(label, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON v = doc_id""",
    "op8_embedding_near_dedup": f"""WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    pairs AS (SELECT p.vec_id AS a, q.vec_id AS b FROM e p JOIN e q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.93){REACH},
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(least_.label, vec_id) AS component_id, coalesce(least_.label, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN least_ ON v = vec_id""",
    "op10_exact_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.x, e.x) AS BIGINT) AS score FROM e q JOIN e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND len(q.x) = len(e.x))
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}


def queries() -> dict[str, Query]:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
