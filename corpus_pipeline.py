"""Corpus preparation: five stages from raw documents to a training mix.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes what it
returns as Parquet in the shared folder and hands the reread table to the next
one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, langid, mixing, secrets, simhash
from docloom.plans.tables import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Above so many bits a character a text is in none of the learned languages (most of its
#: characters are phrases of their own, as in an unknown script); shorter texts than this are too short to tell.
MAX_BITS, MIN_CHARS = 11.0, 100
#: Near duplicates: Jaccard similarity of five-word shingles.
SIMILARITY, SHINGLE = 0.8, 5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts that no learned language explains.

    Null and empty texts have no letter and go; where no language was learned,
    all rows go. Repeated rows and rows without an id are judged each alone. An
    empty table stays empty.
    """
    judged = langid.identify_languages(docs, langid.learn(docs))
    foreign = (F.length("text") >= MIN_CHARS) & (F.col("lang_bits") > MAX_BITS)
    return judged.where((F.col("lang_pred") != langid.NONE) & ~foreign).select(COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that with the smallest id.

    Null and wordless texts are one group. Rows without an id stay only in
    groups that have no id; of rows of one id the one with the smallest hash of
    all its columns stays, so reruns agree. An empty table stays empty.
    """
    return simhash.keep_one(docs.select(COLUMNS), similarity=SIMILARITY, shingle=SHINGLE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null and empty texts hold none and stay; an empty benchmark drops nothing.
    Rows of one id but different texts are judged apart, repeated rows alike.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_leaks(docs, benchmark).select(COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret; all documents stay, null and empty texts unchanged.

    ``n_chars`` becomes the number of code points that are left, null for a null text.
    """
    clean = secrets.redact_secrets(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, and how many of its words.

    Every row that came in gives one row; null and wordless texts are never
    taken. Null sources are one source, the last. Ids, not texts, come out: they
    join to the stage before, whose table ``run`` leaves in the shared folder
    until the session ends. An empty table gives an empty one.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify),
    ("simhash_dedup", deduplicate),
    ("decontamination", decontaminated),
    ("secret_scan", redacted),
    ("source_mix", mixed),
]

#: No SQL: language identification, SimHash and key parsing are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
