"""Views that give the star-schema tables the shape of a document collection.

Each view is one SQL text that Spark and DuckDB read alike, so queries and
their reference SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import approx_tokens, chunk_texts
from docloom.operators.ingest import number_rows
from docloom.plans.tables import materialize, sized

_LETTERS = "translate(CAST(({n}) AS STRING), '0123456789', 'abcdefghij')"


def _word(n: str) -> str:
    """A lower-case word that names a number."""
    return _LETTERS.format(n=n)


_TITLE = (
    "CASE WHEN base % 11 = 0 THEN 'Project Q' || " + _word("base") + " || ' Charter' ELSE 'Handling Guide ' || " + _word("base") + " END"
)

#: Documents with metadata and short texts, one for each part.
DOCUMENTS = f"""
SELECT id, 'doc-' || CAST(id AS STRING) AS doc_key, {_TITLE} AS title, department, doc_type,
  CAST(id % 4 + 1 AS STRING) || '.0' AS version,
  CASE WHEN id % 9 = 0 THEN NULL ELSE DATE '2020-01-01' + CAST(id % 1000 AS INT) END AS effective_date,
  CASE WHEN id % 5 = 2 THEN department || ' Team' ELSE 'Author ' || CAST(id % 40 AS STRING) END AS author,
  owner, CAST(id % 6 + 1 AS INT) AS authority_level,
  CASE WHEN id % 7 = 2 THEN 'superseded' ELSE 'current' END AS status,
  CASE WHEN base <> id THEN 'doc-' || CAST(base AS STRING) END AS supersedes_doc_key,
  'k' || CAST(id - id % 5 AS STRING) || ', ' || department || ',' || 'j' || CAST(id % 997 AS STRING) AS tags,
  '# ' || {_TITLE} || chr(10)
    || '**Scope.** This covers ' || p_name || ' of ' || lower(p_type) || ' grade.' || chr(10)
    || 'The refund window for grade {'{'}w4{'}'} goods is ' || CAST(p_size AS STRING) || ' days. '
    || 'Orders in zone {'{'}w6{'}'} above $' || CAST(1 + id % 3 AS STRING) || ',500 need approval.' || chr(10)
    || 'Widget{'{'}w4{'}'} is defined as any ' || lower(p_type) || ' item sold as ' || p_name || '.' || chr(10)
    || CASE WHEN id % 5 = 0 THEN 'The Unit{'{'}w6{'}'} team owns the ' || p_name || ' line.' || chr(10) ELSE '' END
    || 'See the Handling Guide ' || {_word("id * 7 % 1009")} || ' for details.' AS raw_text
FROM (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 3 THEN p_partkey - 1 ELSE p_partkey END AS base, p_name, p_type, p_size,
    CASE p_partkey % 6 WHEN 0 THEN 'HR' WHEN 1 THEN 'IT-Security' WHEN 2 THEN 'Finance' WHEN 3 THEN 'Marketing'
      WHEN 4 THEN 'Engineering' ELSE 'Projects' END AS department,
    CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'HR' WHEN 2 THEN 'Finance' WHEN 3 THEN 'Marketing' ELSE
      CASE p_partkey % 6 WHEN 0 THEN 'HR' WHEN 1 THEN 'IT-Security' WHEN 2 THEN 'Finance' WHEN 3 THEN 'Marketing'
      WHEN 4 THEN 'Engineering' ELSE 'Projects' END END AS owner,
    CASE (p_partkey - p_partkey % 2) % 12 WHEN 0 THEN 'Policy' WHEN 2 THEN 'SOP' WHEN 4 THEN 'Handbook' WHEN 6 THEN 'Documentation'
      WHEN 8 THEN 'ProjectDocumentation' ELSE 'MeetingNotes' END AS doc_type
  FROM part
) AS p
"""
DOCUMENTS = DOCUMENTS.replace("{w4}", "' || " + _word("id - id % 4") + " || '").replace("{w6}", "' || " + _word("id - id % 6") + " || '")

#: One chunk per document.
CHUNKS = f"SELECT id AS chunk_id, id AS document_id, CAST(0 AS INT) AS chunk_index, raw_text AS text FROM ({DOCUMENTS}) AS d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection's documents.

    A part is a few bytes and its document many, so parts are spread first:
    the file of a million parts is one split, whose task would do all the work.
    """
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size").repartition(tasks, "p_partkey")
    return spark.sql(DOCUMENTS.replace("FROM part", "FROM {part}"), part=part)


def chunks(docs: DataFrame) -> DataFrame:
    """The collection's chunks with what detectors need of their documents."""
    return docs.selectExpr(
        "id AS chunk_id", "id AS document_id", "CAST(0 AS INT) AS chunk_index", "doc_key", "department", "authority_level", "raw_text AS text"
    )


#: Words a chunk of the collection may have, so that most documents have several.
CHUNK_WORDS = 40


def real_chunks(docs: DataFrame) -> DataFrame:
    """The collection's documents cut into several chunks each, numbered in order of document and index."""
    # Documents are numbered by their chunks' counts, so that texts move once, and not at all while the counts can be broadcast.
    meta = ("doc_key", "department", "authority_level")
    cut = materialize(docs.select(F.col("id").alias("document_id"), *meta, chunk_texts("raw_text", CHUNK_WORDS).alias("texts")), "cut")
    counts = cut.select("document_id", F.size("texts").alias("n"))
    first = sized(materialize(number_rows(counts, ["document_id"], 1, "first", "n").select("document_id", "first"), "first"))
    rows = cut.join(first, "document_id").select("document_id", *meta, "first", F.posexplode("texts").alias("chunk_index", "text"))
    return rows.select((F.col("first") + F.col("chunk_index")).alias("chunk_id"), "document_id", "chunk_index", "text", approx_tokens("text").alias("token_count"), *meta)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
