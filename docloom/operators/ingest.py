"""Ingest: parsed documents to document and chunk tables, each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.fixed import CHUNK_TOKENS, OVERLAP
from docloom.functions.text import approx_tokens, chunk_texts
from docloom.plans.tables import materialize, running_totals
from docloom.sources.documents import parse_documents, scan_files
from docloom.sources.records import read_table, write_table


def chunk_documents(
    documents: DataFrame, doc_id: str = "id", body: str = "raw_text", max_tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP
) -> DataFrame:
    """(document_id, chunk_index, text, token_count); documents without sentences have no rows (T5)."""
    texts = chunk_texts(body, max_tokens, overlap)
    chunks = documents.select(F.col(doc_id).alias("document_id"), F.posexplode(texts).alias("chunk_index", "text"))
    return chunks.withColumn("token_count", approx_tokens("text"))


def number_rows(rows: DataFrame, order: list[str], start: int, out: str, count: str | None = None) -> DataFrame:
    """Adds consecutive numbers from ``start`` in ``order``, which leaves no ties.

    With ``count`` a row stands for as many as that column says, and gets the first one's number.
    """
    numbered = running_totals(rows, order, {out: F.col(count) if count else F.lit(1)}, "numbered")
    return numbered.withColumn(out, (F.col(out) + start).cast("bigint"))


def check_batch(parsed: DataFrame) -> None:
    """Raises ValueError if a file failed to parse or a key stands twice in the batch."""
    bad = parsed.where("error IS NOT NULL").select("source_path", "error").orderBy("source_path").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r['source_path']}: {r['error']}" for r in bad))
    twice = parsed.groupBy("doc_key").count().where("count > 1").orderBy("doc_key").limit(10).collect()
    if twice:
        raise ValueError("repeated doc_key: " + ", ".join(r["doc_key"] for r in twice))


def new_documents(parsed: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Rows whose key isn't known yet; known documents are skipped, never updated."""
    fresh = parsed.drop("error")
    return fresh if existing is None else fresh.join(existing.select("doc_key"), "doc_key", "left_anti")


def ingest(spark: SparkSession, source: str, target: str, reset: bool = False) -> DataFrame:
    """Ingest a folder of documents into tables below ``target``; one row of totals.

    Ids continue those of the tables, in order of path, and of (document,
    index) for chunks.
    """
    parsed = materialize(parse_documents(scan_files(spark, source)), "parsed")
    check_batch(parsed)
    return append_documents(spark, parsed, target, reset)


def append_documents(spark: SparkSession, parsed: DataFrame, target: str, reset: bool = False) -> DataFrame:
    """Add parsed documents that are new, with their chunks; one row of totals.

    Chunks are written first and the documents' rows make them count: chunks
    that a run left behind when it broke off belong to no document, and go
    before the next run writes, so that no document ever lacks its chunks.
    """
    existing, first_doc, first_chunk = None, 1, 1
    if not reset:
        try:
            existing = read_table(spark, f"{target}/documents")
            first_doc = (existing.agg(F.max("id")).first()[0] or 0) + 1
            first_chunk = (read_table(spark, f"{target}/chunks").agg(F.max("id")).first()[0] or 0) + 1
        except FileNotFoundError:
            existing = None
    if existing is not None:
        _drop_orphans(spark, existing, f"{target}/chunks")
    fresh = materialize(number_rows(new_documents(parsed, existing), ["source_path"], first_doc, "id"), "fresh")
    # Written first: a range sort reads its rows twice, for the ranges and for the rows.
    cut = materialize(chunk_documents(fresh), "cut")
    chunks = materialize(number_rows(cut, ["document_id", "chunk_index"], first_chunk, "id"), "chunks")
    write_table(chunks, f"{target}/chunks", reset)
    write_table(fresh, f"{target}/documents", reset)
    totals = fresh.agg(F.count("*").alias("documents")).join(chunks.agg(F.count("*").alias("chunks")))
    mean = F.when(F.col("documents") > 0, F.round(F.col("chunks") / F.greatest("documents", F.lit(1)), 2)).otherwise(0.0)
    return totals.withColumn("chunks_per_document", mean)


def _drop_orphans(spark: SparkSession, documents: DataFrame, folder: str) -> None:
    """Remove chunks whose document was never written."""
    try:
        chunks = read_table(spark, folder)
    except FileNotFoundError:
        return
    ids = documents.select(F.col("id").alias("document_id"))
    if chunks.join(ids, "document_id", "left_anti").limit(1).count():
        write_table(materialize(chunks.join(ids, "document_id", "left_semi"), "chunks"), folder, reset=True)


def upload_document(spark: SparkSession, name: str, content: str, target: str) -> dict:
    """Ingest one document given as text; what became of it.

    Raises ValueError for an unsupported name and for a parse error.
    """
    if not name.lower().endswith(".md"):
        raise ValueError(f"unsupported format: {name}")
    parsed = parse_documents(spark.createDataFrame([(name, content)], "path string, content string"))
    check_batch(parsed)
    key = parsed.first()["doc_key"]
    append_documents(spark, parsed, target)
    row = read_table(spark, f"{target}/documents").where(F.col("doc_key") == key).first()
    made = read_table(spark, f"{target}/chunks").where(F.col("document_id") == row["id"]).count()
    status = "ingested" if row["source_path"] == name else "skipped_duplicate"
    return {"doc_key": key, "id": row["id"], "chunks_created": made if status == "ingested" else 0, "status": status}
