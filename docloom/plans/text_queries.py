"""Queries on texts: tokens, sentences, chunks, terms; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.fixed import EPSILON, STOPWORDS
from docloom.functions.text import approx_tokens, highlight, ngram_terms, normalize_blanks, split_sentences, tokenize
from docloom.operators import bm25
from docloom.operators.ingest import chunk_documents
from docloom.operators.rerank import tfidf_weights
from docloom.plans.adapters import table
from docloom.plans.tables import materialize

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains({STOP}, x))"


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", approx_tokens("text").cast("bigint").alias("tokens"), F.length(normalize_blanks("text")).cast("bigint").alias("chars"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", split_sentences("text").alias("s"))
    return docs.select("doc_id", F.size("s").cast("bigint").alias("sentences"), F.sha2(F.array_join("s", "\n"), 256).alias("digest"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return chunk_documents(docs, "doc_id", "text").select("document_id", "chunk_index", "token_count", F.sha2("text", 256).alias("digest"))


def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    return per


def terms_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tokenize("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("terms"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    postings = materialize(bm25.term_counts(docs, "doc_id", "text"), "postings")
    stats = bm25.term_statistics(postings, docs.count())
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    terms = items.select("item_id", F.explode(ngram_terms("text", STOPWORDS)).alias("term"))
    weights = tfidf_weights(terms, [], "item_id", items.agg(F.count("*").alias("n")))
    return weights.select("item_id", "term", F.round("w", 6).alias("w"))


def query_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = highlight("text", "The refund of and was", "<b>", "</b>")
    return table(spark, sf_dir, "benchmark").select("item_id", marked.alias("marked"))


QUERIES = {
    f.__name__: f
    for f in (
        token_counts,
        sentence_split,
        chunk_table,
        chunk_summary,
        terms_by_document,
        term_statistics,
        tfidf_vectors,
        query_highlight,
    )
}

SENTENCES = r"""
  list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda line: string_split(
    regexp_replace(replace(trim(regexp_replace(line, '^#{1,6}\s*', '')), '**', ''), '([.!?])\s+([A-Z#*])', '\1' || chr(31) || '\2', 'g'),
    chr(31)))), lambda x: trim(x)), lambda x: x <> '')
"""

POSTINGS = f"""
p AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
tf AS (SELECT term, doc_id, count(*) AS tf FROM p GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT term, count(*) AS df, ln(CAST((SELECT n FROM n) AS DOUBLE) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM tf GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN {EPSILON}::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)
"""

NGRAMS = f"""
words AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({STOP}, x)) AS w FROM benchmark),
grams AS (
  SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words
)
"""



def chunked_sql(source: str, doc: str, text: str, max_tokens: int) -> str:
    """Sentences placed one after the other: k counts chunks, n the tokens of the open one."""
    return f"""
c_s AS (SELECT {doc} AS doc_id, {SENTENCES.replace("string_split(text,", f"string_split({text},")} AS ss FROM {source}),
c_t AS (
  SELECT doc_id, i, x, CAST(len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')) AS INT) AS tok
  FROM (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS x FROM c_s)
), c_r AS (
  SELECT doc_id, i, CAST(0 AS INT) AS k, tok AS n, tok FROM c_t WHERE i = 1
  UNION ALL SELECT t.doc_id, t.i, CASE WHEN r.n + t.tok > {max_tokens} THEN r.k + 1 ELSE r.k END,
    CASE WHEN r.n + t.tok > {max_tokens} THEN r.tok + t.tok ELSE r.n + t.tok END, t.tok
  FROM c_r r JOIN c_t t ON t.doc_id = r.doc_id AND t.i = r.i + 1
), c_placed AS (
  SELECT doc_id, k, i, x, tok FROM c_r JOIN c_t USING (doc_id, i, tok)
  UNION ALL SELECT doc_id, k + 1, max(i), arg_max(x, i), arg_max(tok, i) FROM c_r JOIN c_t USING (doc_id, i, tok) GROUP BY doc_id, k
), chunk AS (
  SELECT doc_id AS document_id, k AS chunk_index, string_agg(x, ' ' ORDER BY i) AS text, CAST(sum(tok) AS INT) AS token_count FROM c_placed
  WHERE (doc_id, k) IN (SELECT doc_id, k FROM c_r) GROUP BY doc_id, k
)
"""


CHUNKED = chunked_sql("documents", "doc_id", "text", 220)

ORACLES = {
    "chunk_table": f"WITH RECURSIVE {CHUNKED} SELECT document_id, chunk_index, token_count, sha256(text) AS digest FROM chunk",
    "chunk_summary": f"""WITH RECURSIVE {CHUNKED} SELECT document_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunk
      GROUP BY document_id""",
    "token_counts": r"""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS tokens,
      CAST(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS BIGINT) AS chars FROM documents""",
    "sentence_split": f"""SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, sha256(array_to_string(s, chr(10))) AS digest
      FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)""",
    "terms_by_document": f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS terms, sha256(array_to_string(t, ' ')) AS digest
      FROM (SELECT doc_id, {TOKENS} AS t FROM documents)""",
    "term_statistics": f"WITH {POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_vectors": f"""WITH {NGRAMS},
      tf AS (SELECT item_id, term, count(*) AS tf FROM grams GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      w AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term))
      SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS w FROM w""",
    "query_highlight": "SELECT item_id, regexp_replace(text, '(?i)(The|refund|and|was)', '<b>\\1</b>', 'g') AS marked FROM benchmark",
}
