"""Listings, builds, file ingest and the four search systems over the collection, with their DuckDB SQL.

Searches and ground truth run on documents that are cut into several chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.fixed import B as LENGTH_SHARE
from docloom.functions.fixed import EPSILON, EXPLANATIONS, K1, MATCHED, NO_OVERLAP, POOL
from docloom.operators import builds, dense, evaluation, fusion, graph, ingest, integrity, serving
from docloom.operators.bm25 import Bm25Index, bm25_search, build_bm25
from docloom.operators.rerank import TfidfReranker
from docloom.plans import adapters, retrieval_queries
from docloom.plans import knowledge_queries as kq
from docloom.plans.adapters import CHUNK_WORDS, table
from docloom.plans.tables import discard_at_exit, materialize, new_path
from docloom.plans.text_queries import STOP, TOKENS, chunked_sql
from docloom.sources import records


class Chunked(kq.Base):
    """The collection with documents of several chunks."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__(spark, sf_dir)
        self.chunks = materialize(adapters.real_chunks(self.docs), "real_chunks")

    @property
    def graph_docs(self) -> DataFrame:
        return self.docs.join(serving.first_chunks(self.chunks).withColumnRenamed("document_id", "id"), "id", "left")

    def conflict_edges(self) -> DataFrame:
        none = self.conflicts().sparkSession.createDataFrame([], "chunk_a_id bigint, chunk_b_id bigint, similarity_score double")
        return graph.integrity_edges(self.conflicts(), none, self.chunks, self.entities())


def _folder(spark: SparkSession, label: str) -> str:
    return discard_at_exit(spark, new_path(spark, label))


def _write_files(docs: DataFrame, folder: str) -> None:
    """Each document as a Markdown file with front matter, in a folder for its department."""
    head = F.concat_ws(
        "\n",
        F.lit("---"),
        *(F.concat(F.lit(f"{k}: "), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in ("doc_key", "title", "department", "doc_type")),
        F.concat(F.lit('version: "'), "version", F.lit('"')),
        F.concat(F.lit("effective_date: "), F.coalesce(F.col("effective_date").cast("string"), F.lit("null"))),
        *(F.concat(F.lit(f"{k}: "), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in ("author", "owner", "authority_level", "status")),
        F.concat(F.lit("supersedes: "), F.coalesce("supersedes_doc_key", F.lit("null"))),
        F.concat(F.lit("tags: "), "tags"),
        F.lit("---"),
        F.col("raw_text"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri("/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder)
        for batch in batches:
            for department, key, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs.create_dir(f"{root}/{department}", recursive=True)
                with fs.open_output_stream(f"{root}/{department}/{key}.md") as out:
                    out.write(content.encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    docs.select("department", "doc_key", head).mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[str, str, DataFrame]:
    """(folder of files, folder of tables, totals of the first run)."""
    files, target = _folder(spark, "files"), _folder(spark, "ingested")
    _write_files(adapters.documents(spark, sf_dir), files)
    return files, target, materialize(ingest.ingest(spark, files, target), "totals")


def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, found, parsed and ingested."""
    _, target, _ = _ingested(spark, sf_dir)
    columns = ("id", "doc_key", "title", "department", "doc_type", "version", "effective_date", "author", "owner", "authority_level", "status", "supersedes_doc_key", "tags")
    return records.read_table(spark, f"{target}/documents").select(*columns, F.sha2("raw_text", 256).alias("digest"))


def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, target, _ = _ingested(spark, sf_dir)
    return records.read_table(spark, f"{target}/chunks").select("id", "document_id", "chunk_index", "token_count", F.sha2("text", 256).alias("digest"))


def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run, of one that finds nothing new, and of one that resets the tables."""
    files, target, first = _ingested(spark, sf_dir)
    runs = [first, materialize(ingest.ingest(spark, files, target), "totals"), materialize(ingest.ingest(spark, files, target, reset=True), "totals")]
    tagged = [r.withColumn("run", F.lit(i)) for i, r in enumerate(runs)]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def upload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a new document and of one that is known."""
    _, target, _ = _ingested(spark, sf_dir)
    page = "---\ndoc_key: {}\ntitle: Uploaded\ndepartment: HR\ndoc_type: Policy\n---\nFirst sentence. Second sentence."
    rows = [ingest.upload_document(spark, f"{k}.md", page.format(k), target) for k in ("doc-new", "doc-10")]
    return spark.createDataFrame([(r["doc_key"], r["id"], r["chunks_created"], r["status"]) for r in rows], "doc_key string, id bigint, chunks_created bigint, status string")


def ground_truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth written as a JSON file and read by its schema."""
    folder = _folder(spark, "truth")
    pairs = integrity.outdated_documents(adapters.documents(spark, sf_dir))
    cases = pairs.select(F.col("outdated_doc_key").alias("case_id"), "concept", F.col("outdated_doc_key").alias("outdated_doc"), F.col("current_doc_key").alias("current_doc"))
    whole = cases.agg(F.to_json(F.struct(F.collect_list(F.struct(*cases.columns)).alias("cases"))).alias("value"))
    whole.coalesce(1).write.text(f"{folder}/outdated.json")
    return records.read_ground_truth(spark, folder, "outdated").select("case_id", "concept", "outdated_doc", "current_doc", "changed_fact")


def bm25_saved_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over an index that was saved and loaded."""
    folder = _folder(spark, "index")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    build_bm25(docs).save(folder)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return bm25_search(Bm25Index.load(spark, folder), asked, 10)


def kb_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = Chunked(spark, sf_dir).chunks
    return chunks.select("chunk_id", "document_id", "chunk_index", "token_count", F.sha2("text", 256).alias("digest"))


def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by their ids, those of every document's first chunk, and documents by their keys."""
    b = Chunked(spark, sf_dir)
    wanted = serving.first_chunks(b.chunks).select(F.col("first_chunk_id").alias("chunk_id"))
    chunks = serving.lookup(b.chunks, "chunk_id", wanted)
    one = serving.lookup(b.docs, "doc_key", ["doc-10"]).select(F.col("id").alias("document_id"), F.lit(True).alias("asked"))
    return chunks.join(one, "document_id", "left").select("chunk_id", "document_id", F.coalesce("asked", F.lit(False)).alias("asked"))


def first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.first_chunks(Chunked(spark, sf_dir).chunks)


def ground_truth_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of the documents that a query names: a document and the one it supersedes."""
    b = Chunked(spark, sf_dir)
    known = b.docs.select(F.col("doc_key").alias("supersedes_doc_key"))
    asked = b.docs.join(known, "supersedes_doc_key", "left_semi").select(F.col("id").alias("query_id"), F.array("doc_key", "supersedes_doc_key").alias("relevant_docs"))
    return evaluation.resolve_relevant(asked, b.docs, b.chunks)


def snippet_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk of each document that holds a snippet, else its first one."""
    b = Chunked(spark, sf_dir)
    snippet = F.when(F.col("id") % 2 == 0, "See the  Handling Guide").otherwise("no such words")
    cases = b.docs.select(F.col("doc_key").alias("case_id"), F.col("doc_key").alias("doc_a"), snippet.alias("snippet_a"))
    found = evaluation.resolve_snippets(cases, b.docs, b.chunks, "doc_a", "snippet_a", "chunk_a")
    return found.select("case_id", "chunk_a", "chunk_a_found")


def chunk_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions and divergent definitions among documents of several chunks."""
    b = Chunked(spark, sf_dir)
    return b.conflicts().select("concept", "conflict_type", "chunk_a_id", "chunk_b_id", "value_a", "value_b", "severity", "resolved_doc_key")


def conflicts_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severe contradictions."""
    rows = serving.list_conflicts(kq.Base(spark, sf_dir).conflicts_of("contradiction"), "contradiction", "high")
    return rows.select("concept", "conflict_type", "chunk_a_id", "chunk_b_id", "value_a", "value_b", "severity", "resolved_doc_key")


def definitions_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition conflicts."""
    rows = serving.list_conflicts(kq.Base(spark, sf_dir).conflicts_of("definition"), "definition")
    return rows.select("concept", "chunk_a_id", "chunk_b_id", "value_a", "value_b", "severity")


def entities_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of one type."""
    return serving.list_entities(kq.Base(spark, sf_dir).entities(), "Team").select("id", "name", "entity_type")


def duplicates_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates with both sides, by similarity."""
    b = kq.Base(spark, sf_dir)
    rows = serving.list_duplicates(b.duplicates(), b.chunks.select("chunk_id", "document_id", "text"), b.docs)
    sides = [f"{c}_{s}" for s in "ab" for c in ("doc_key", "title", "department", "authority_level", "version")]
    return rows.select("cluster_id", "similarity_score", "chunk_a_id", "chunk_b_id", *sides)


def conflict_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two conflicts."""
    return serving.preview_conflicts(kq.Base(spark, sf_dir).conflicts()).select("conflict_type", "chunk_a_id", "chunk_b_id", "severity")


def cases_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of two kinds and one severity, the severest first."""
    b = kq.Base(spark, sf_dir)
    return serving.order_cases(b.cases(("CTR", "OUT"), ("medium",)))


def department_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by department, as one map (A1)."""
    row = serving.count_map(adapters.documents(spark, sf_dir), "department", "departments")
    return row.select(kq.map_text("departments").alias("departments"))


def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the group of all employees."""
    b = kq.Base(spark, sf_dir)
    return graph.incident_edges(b.graph(), graph.find_entity(b.entities(), "EMPLOYEES"))


def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges written as JSON and read back."""
    b = kq.Base(spark, sf_dir)
    folder = _folder(spark, "export")
    graph.export_graph(b.entities(), b.edges(), folder)
    nodes = spark.read.schema("id bigint, name string, entity_type string").json(f"{folder}/nodes")
    edges = spark.read.schema("source bigint, target bigint, relation_type string, confidence double").json(f"{folder}/edges")
    none = F.lit(None)
    return nodes.select(
        F.lit("node").alias("kind"), F.col("id").alias("a"), none.cast("bigint").alias("b"), "name", F.col("entity_type").alias("type"), none.cast("double").alias("confidence")
    ).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), none.cast("string").alias("name"), F.col("relation_type").alias("type"), "confidence"))


def builds_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph build and an integrity run into tables, each twice."""
    b = kq.Base(spark, sf_dir)
    target = _folder(spark, "builds")
    for _ in range(2):
        made = builds.build_graph(spark, b.docs, b.chunks, target)
        found = builds.run_integrity(spark, b.docs, b.chunks, target, 0.5)
    return made.join(found)


def _systems(b: Chunked, spark: SparkSession, sf_dir: str, top_k: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Queries (every hundredth document's title and department) and the results of the four systems."""
    asked = b.docs.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", "title", "department").alias("text"))
    chunks = b.chunks.select("chunk_id", "text")
    keyword = materialize(bm25_search(build_bm25(chunks), asked, POOL), "keyword")
    vectors = table(spark, sf_dir, "embeddings")
    held = vectors.join(b.chunks.select(F.col("chunk_id").alias("vec_id")), "vec_id", "left_semi")
    of_query = vectors.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    near = dense.knn(held.select(F.col("vec_id").alias("chunk_id"), "embedding"), of_query.select(F.col("vec_id").alias("query_id"), "embedding"), POOL)
    near = materialize(near, "near")
    fused = materialize(fusion.hybrid(keyword, near, POOL), "fused")
    ranked = materialize(TfidfReranker().rerank(fused, asked, chunks, top_k), "reranked")
    cut = lambda d: d.where(F.col("rank") <= top_k)
    return asked, {"bm25": cut(keyword), "dense": cut(near), "hybrid": cut(fused), "hybrid_rerank": ranked}


def search_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four systems' results with every field of a search answer."""
    b = Chunked(spark, sf_dir)
    asked, found = _systems(b, spark, sf_dir, 5)
    related = materialize(serving.related_entities(b.entities(), b.graph(), more=b.conflict_edges()), "related")
    out = None
    for method, results in found.items():
        serving.check_search(method, 5)
        rows = serving.enrich_results(method, results, asked, b.chunks.select("chunk_id", "document_id", "text"), b.docs, b.conflicts(), related)
        rows = rows.select(
            F.lit(method).alias("method"), "query_id", "rank", "chunk_id", F.sha2("text", 256).alias("digest"), "score", "confidence", "document_id", "doc_key", "title",
            "department", "version", "status", "authority_level", "authority_label", "explanation", "has_conflict", kq.related_text().alias("related"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


#: Systems in the order of the comparison table.
LABELS = {"bm25": "System A: BM25", "dense": "System B: Dense", "hybrid": "System C: Hybrid (RRF)", "hybrid_rerank": "System D: Hybrid + Rerank"}


def system_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven metrics of the four systems; relevant are the chunks of documents with the query document's title."""
    b = Chunked(spark, sf_dir)
    asked, found = _systems(b, spark, sf_dir, 10)
    titles = b.docs.select(F.col("id").alias("query_id"), "title").where("query_id % 100 = 0").join(b.docs.select("title", "doc_key"), "title")
    truth = titles.groupBy("query_id").agg(F.collect_list("doc_key").alias("relevant_docs"))
    relevant = materialize(evaluation.resolve_relevant(truth, b.docs, b.chunks), "relevant")
    means = {LABELS[m]: evaluation.mean_metrics(evaluation.query_metrics(asked, r, relevant)) for m, r in found.items()}
    return evaluation.compare_systems(means)


QUERIES = {
    f.__name__: f
    for f in (
        ingest_documents,
        ingest_chunks,
        ingest_totals,
        upload_status,
        ground_truth_rows,
        bm25_saved_topk,
        kb_chunks,
        chunk_lookup,
        first_chunks,
        ground_truth_chunks,
        snippet_chunks,
        chunk_conflicts,
        conflicts_list,
        definitions_list,
        entities_list,
        duplicates_list,
        conflict_preview,
        cases_filtered,
        department_map,
        incident_edges,
        graph_export,
        builds_counts,
        search_systems,
        system_comparison,
    )
}


_CHUNKS = f"""{chunked_sql("kb", "id", "raw_text", CHUNK_WORDS)}, kc AS (
  SELECT row_number() OVER (ORDER BY document_id, chunk_index) AS id, document_id, chunk_index, token_count, text AS raw_text, doc_key, department, authority_level
  FROM chunk JOIN kb ON kb.id = document_id
)"""
#: The detectors' SQL over chunks instead of documents.
_CHUNK_CONFLICTS = (
    kq._CONFLICTS.replace("FROM kb)", "FROM kc)").replace("FROM kb UNION", "FROM kc UNION").replace("JOIN kb ON kb.id = chunk_id", "JOIN kc kb ON kb.id = chunk_id")
    .replace("FROM kb\n", "FROM kc\n").replace("kb.authority_level, (chunk_id", "kb.authority_level, kb.document_id, (chunk_id")
    .replace("a.value <> b.value AND a.chunk_id <> b.chunk_id", "a.value <> b.value AND a.document_id <> b.document_id")
    .replace("current_id = a.chunk_id AND outdated_id = b.chunk_id", "current_id = a.document_id AND outdated_id = b.document_id")
    .replace("current_id = b.chunk_id AND outdated_id = a.chunk_id", "current_id = b.document_id AND outdated_id = a.document_id")
)
_CONF = "concept, conflict_type, chunk_a_id, chunk_b_id, value_a, value_b, severity, resolved_doc_key"
_PATHS = "files AS (SELECT *, row_number() OVER (ORDER BY department || '/' || doc_key || '.md') AS no FROM kb)"
_FILE_CHUNKS = chunked_sql("files", "no", "raw_text", 220)

_Q = TOKENS.replace("lower(text)", "lower(title || ' ' || department)")
_T = TOKENS.replace("lower(text)", "lower(raw_text)")
_SYSTEMS = f"""kt AS (SELECT id, unnest({_T}) AS term FROM kc), ktf AS (SELECT term, id, count(*) AS tf FROM kt GROUP BY ALL),
kraw AS (SELECT term, ln(CAST((SELECT count(*) FROM kc) AS DOUBLE) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM ktf GROUP BY term),
kidf AS (SELECT term, CASE WHEN raw < 0 THEN {EPSILON}::DOUBLE * (SELECT avg(raw) FROM kraw) ELSE raw END AS idf FROM kraw),
klen AS (SELECT id, len({_T}) AS dl FROM kc),
ask AS (SELECT id AS query_id, title || ' ' || department AS text, {_Q} AS qt FROM kb WHERE id % 100 = 0),
kw AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(qt) AS term FROM ask) GROUP BY ALL),
ks AS (
  SELECT query_id, id AS chunk_id,
    round(sum(times * idf * tf * ({K1}::DOUBLE + 1) / (tf + {K1}::DOUBLE * (1 - {LENGTH_SHARE}::DOUBLE + {LENGTH_SHARE}::DOUBLE * dl / (SELECT avg(dl) FROM klen)))), 6) AS score
  FROM kw JOIN kidf USING (term) JOIN ktf USING (term) JOIN klen USING (id) GROUP BY ALL
), bm25 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ks WHERE score > 0) WHERE rank <= {POOL}
), {retrieval_queries._knn_sql(POOL, "q.vec_id IN (SELECT query_id FROM ask) AND c.vec_id IN (SELECT id FROM kc)")},
both_ AS (
  SELECT query_id, chunk_id, min(rank) FILTER (l = 0) AS r0, min(rank) FILTER (l = 1) AS r1
  FROM (SELECT query_id, chunk_id, rank, 0 AS l FROM bm25 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM knn) GROUP BY ALL
), fused AS (
  SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0 NULLS LAST, r1 NULLS LAST, chunk_id) AS rank
  FROM (SELECT *, round(coalesce(1.0::DOUBLE / (60 + r0), 0) + coalesce(1.0::DOUBLE / (60 + r1), 0), 9) AS score FROM both_)) WHERE rank <= {POOL}
), txt AS (
  SELECT query_id, chunk_id, raw_text AS text FROM fused JOIN kc ON id = chunk_id
  UNION ALL SELECT query_id, NULL, text FROM ask WHERE query_id IN (SELECT query_id FROM fused)
), wd AS (
  SELECT query_id, chunk_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({STOP}, x)) AS w FROM txt
), gr AS (
  SELECT query_id, chunk_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM wd
), gtf AS (SELECT query_id, chunk_id, term, count(*) AS tf FROM gr GROUP BY ALL),
gdf AS (SELECT query_id, term, count(*) AS df FROM gtf GROUP BY ALL), gn AS (SELECT query_id, count(*) AS n FROM txt GROUP BY ALL),
gw AS (SELECT gtf.query_id, chunk_id, gtf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM gtf JOIN gdf USING (query_id, term) JOIN gn USING (query_id)),
gv AS (SELECT query_id, chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id, chunk_id)) AS w FROM gw),
co AS (
  SELECT a.query_id, a.chunk_id, sum(a.w * b.w) AS s FROM gv a JOIN gv b ON a.query_id = b.query_id AND a.term = b.term AND b.chunk_id IS NULL
  WHERE a.chunk_id IS NOT NULL GROUP BY ALL
), reranked AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank
  FROM (SELECT query_id, chunk_id, fused.rank, round(coalesce(s, 0), 6) AS score FROM fused LEFT JOIN co USING (query_id, chunk_id))
), answers AS (
  SELECT 'bm25' AS method, 0 AS position, query_id, chunk_id, score, rank FROM bm25 UNION ALL SELECT 'dense', 1, query_id, chunk_id, score, rank FROM knn
  UNION ALL SELECT 'hybrid', 2, query_id, chunk_id, score, rank FROM fused UNION ALL SELECT 'hybrid_rerank', 3, query_id, chunk_id, score, rank FROM reranked
)"""

_RELATED = """sides AS (
  SELECT *, source_entity_id AS id, target_entity_id AS other FROM alle WHERE relation_type <> 'created_by'
  UNION ALL SELECT *, target_entity_id, source_entity_id FROM alle WHERE relation_type <> 'created_by' AND source_entity_id <> target_entity_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE relation_type WHEN 'conflicts_with' THEN 0 WHEN 'supersedes' THEN 1 WHEN 'duplicate_of' THEN 2
    WHEN 'owned_by' THEN 3 WHEN 'applies_to' THEN 4 ELSE 9 END, source_entity_id, target_entity_id, relation_type) AS rank FROM sides
), lists AS (
  SELECT r.id, string_agg(o.name || '|' || o.entity_type || '|' || relation_type, ';' ORDER BY rank) AS l FROM ranked r JOIN ent o ON o.id = other WHERE rank <= 4 GROUP BY r.id
)"""
_EXPLAINED = "CASE method " + " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in EXPLANATIONS.items()) + " END"
_METRICS = ", ".join(
    f"""coalesce(avg(CASE WHEN n_{k} > 0 THEN h_{k}::DOUBLE / n_{k} ELSE 0 END), 0) AS p_{k}, coalesce(avg(h_{k}::DOUBLE / n_rel), 0) AS r_{k},
      coalesce(avg(g_{k} / (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, least(n_rel, {k}) + 1) t(i))), 0) AS ndcg_{k}"""
    for k in (5, 10)
)
_HITS = ", ".join(
    f"""count(*) FILTER (hit AND rank <= {k}) AS h_{k}, count(*) FILTER (rank <= {k}) AS n_{k},
      coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (hit AND rank <= {k}), 0) AS g_{k}"""
    for k in (5, 10)
)

ORACLES = {
    "ingest_documents": kq._with(
        _PATHS,
        query="""SELECT no AS id, doc_key, title, department, doc_type, version, effective_date, author, coalesce(owner, '') AS owner, authority_level, status,
          supersedes_doc_key, tags, sha256(raw_text) AS digest FROM files""",
    ),
    "ingest_chunks": kq._with(
        _PATHS,
        _FILE_CHUNKS,
        recursive=True,
        query="SELECT row_number() OVER (ORDER BY document_id, chunk_index) AS id, document_id, chunk_index, token_count, sha256(text) AS digest FROM chunk",
    ),
    "ingest_totals": kq._with(
        _PATHS,
        _FILE_CHUNKS,
        recursive=True,
        query="""SELECT run::INT AS run, CASE WHEN run = 1 THEN 0 ELSE d END AS documents, CASE WHEN run = 1 THEN 0 ELSE c END AS chunks,
          CASE WHEN run = 1 OR d = 0 THEN 0.0::DOUBLE ELSE round(c / d, 2) END AS chunks_per_document
          FROM (SELECT count(*) AS d FROM kb), (SELECT count(*) AS c FROM chunk), range(0, 3) t(run)""",
    ),
    "upload_status": kq._with(
        _PATHS,
        query="""SELECT 'doc-new' AS doc_key, (SELECT count(*) + 1 FROM kb) AS id, CAST(1 AS BIGINT) AS chunks_created, 'ingested' AS status
          UNION ALL SELECT doc_key, no, 0, 'skipped_duplicate' FROM files WHERE doc_key = 'doc-10'""",
    ),
    "ground_truth_rows": kq._with(
        query="""SELECT o.doc_key AS case_id, n.title AS concept, o.doc_key AS outdated_doc, n.doc_key AS current_doc, CAST(NULL AS VARCHAR) AS changed_fact
          FROM kb n JOIN kb o ON n.supersedes_doc_key = o.doc_key"""
    ),
    "bm25_saved_topk": retrieval_queries.ORACLES["bm25_topk"],
    "kb_chunks": kq._with(
        _CHUNKS, recursive=True, query="SELECT id AS chunk_id, document_id, chunk_index, token_count, sha256(raw_text) AS digest FROM kc"
    ),
    "chunk_lookup": kq._with(
        _CHUNKS, recursive=True, query="SELECT min(id) AS chunk_id, document_id, max(doc_key) = 'doc-10' AS asked FROM kc GROUP BY document_id"
    ),
    "first_chunks": kq._with(_CHUNKS, recursive=True, query="SELECT document_id, min(id) AS first_chunk_id FROM kc GROUP BY document_id"),
    "ground_truth_chunks": kq._with(
        _CHUNKS,
        recursive=True,
        query="""SELECT n.id AS query_id, kc.id AS chunk_id FROM kb n JOIN kb o ON n.supersedes_doc_key = o.doc_key JOIN kc ON document_id IN (n.id, o.id)""",
    ),
    "snippet_chunks": kq._with(
        _CHUNKS,
        recursive=True,
        query="""SELECT doc_key AS case_id, coalesce(min(id) FILTER (hit), min(id)) AS chunk_a, bool_or(hit) AS chunk_a_found
          FROM (SELECT *, document_id % 2 = 0 AND contains(raw_text, 'See the Handling Guide') AS hit FROM kc) GROUP BY doc_key""",
    ),
    "chunk_conflicts": kq._with(_CHUNKS, _CHUNK_CONFLICTS, recursive=True, query=f"SELECT {_CONF} FROM conf"),
    "conflicts_list": kq._with(kq._CONFLICTS, query=f"SELECT {_CONF} FROM conf WHERE conflict_type = 'contradiction' AND severity = 'high'"),
    "definitions_list": kq._with(
        kq._CONFLICTS, query="SELECT concept, chunk_a_id, chunk_b_id, value_a, value_b, severity FROM conf WHERE conflict_type = 'definition'"
    ),
    "entities_list": kq._with(kq._ENTITIES, query="SELECT id, name, entity_type FROM ent WHERE entity_type = 'Team'"),
    "duplicates_list": kq._with(
        kq._VERSIONS,
        kq._DUPS,
        recursive=True,
        query="SELECT cluster_id, similarity_score, chunk_a_id, chunk_b_id, "
        + ", ".join(f"{s}.{c} AS {c}_{s}" for s in "ab" for c in ("doc_key", "title", "department", "authority_level", "version"))
        + " FROM clus JOIN kb a ON a.id = chunk_a_id JOIN kb b ON b.id = chunk_b_id",
    ),
    "conflict_preview": kq._with(
        kq._CONFLICTS, query="SELECT conflict_type, chunk_a_id, chunk_b_id, severity FROM conf ORDER BY chunk_a_id, chunk_b_id, conflict_type LIMIT 2"
    ),
    "cases_filtered": kq._with(
        kq._CONFLICTS,
        kq._DUPS,
        kq._CASES,
        recursive=True,
        query="SELECT *, CAST(2 AS INT) AS severity_rank FROM cases WHERE kind IN ('CTR', 'OUT') AND severity = 'medium'",
    ),
    "department_map": kq._with(
        query="SELECT string_agg(department || '=' || n, ';' ORDER BY department) AS departments FROM (SELECT department, count(*) AS n FROM kb GROUP BY department)"
    ),
    "incident_edges": kq._with(
        kq._EDGES,
        query="""SELECT edge.* FROM edge WHERE source_entity_id IN (SELECT min(id) FROM ent WHERE lower(name) = 'employees')
          OR target_entity_id IN (SELECT min(id) FROM ent WHERE lower(name) = 'employees')""",
    ),
    "graph_export": kq._with(
        kq._EDGES,
        query="""SELECT 'node' AS kind, id AS a, CAST(NULL AS BIGINT) AS b, name, entity_type AS type, CAST(NULL AS DOUBLE) AS confidence FROM ent
          UNION ALL SELECT 'edge', source_entity_id, target_entity_id, NULL, relation_type, confidence FROM edge""",
    ),
    "builds_counts": kq._with(
        kq._CONFLICTS,
        kq._DUPS,
        kq._EDGES,
        kq._FOUND,
        recursive=True,
        query="""SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM edge) AS relationships,
          (SELECT count(*) FROM kb WHERE supersedes_doc_key IN (SELECT doc_key FROM kb)) AS outdated, (SELECT count(*) FROM dups) AS duplicates,
          (SELECT count(*) FROM conf) AS conflicts, (SELECT count(*) FROM found f WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.relation_type = f.relation_type
            AND least(e.source_entity_id, e.target_entity_id) = f.source_entity_id AND greatest(e.source_entity_id, e.target_entity_id) = f.target_entity_id)) AS integrity_edges""",
    ),
    "search_systems": kq._with(
        _CHUNKS,
        _CHUNK_CONFLICTS,
        kq._EDGES,
        """docent AS (SELECT kc.id AS doc, known.id AS entity FROM kc JOIN known ON known.name = doc_key),
        alle AS (SELECT source_entity_id, target_entity_id, relation_type FROM edge
          UNION ALL SELECT DISTINCT least(a.entity, b.entity), greatest(a.entity, b.entity), 'conflicts_with' FROM conf
          JOIN docent a ON a.doc = chunk_a_id JOIN docent b ON b.doc = chunk_b_id WHERE a.entity <> b.entity)""",
        _RELATED,
        _SYSTEMS,
        recursive=True,
        query=f"""SELECT method, query_id, rank, chunk_id, sha256(kc.raw_text) AS digest, score,
          CASE WHEN top <= 0 THEN 0.0::DOUBLE ELSE CAST(printf('%.1f', least(100.0::DOUBLE, greatest(0.0::DOUBLE, score / top * 100))) AS DOUBLE) END AS confidence,
          document_id, kb.doc_key, title, kb.department, version, status, kb.authority_level, {kq._level(0, "kb.authority_level")} AS authority_label,
          {_EXPLAINED} || CASE WHEN method = 'dense' THEN '' WHEN len(m) > 0 THEN '{MATCHED}' || array_to_string(m, ', ') || '.' ELSE '{NO_OVERLAP}' END AS explanation,
          document_id IN (SELECT document_id FROM kc JOIN conf ON id IN (chunk_a_id, chunk_b_id)) AS has_conflict, l AS related
          FROM (SELECT answers.*, max(score) OVER (PARTITION BY method, query_id) AS top FROM answers WHERE rank <= 5) JOIN ask USING (query_id)
          JOIN (SELECT *, {_T} AS dt FROM kc) kc ON kc.id = chunk_id JOIN kb ON kb.id = document_id LEFT JOIN known ON known.name = kb.doc_key LEFT JOIN lists ON lists.id = known.id,
          LATERAL (SELECT list_filter(qt, lambda x, i: list_contains(dt, x) AND list_position(qt, x) = i)[1:6] AS m)""",
    ),
    "system_comparison": kq._with(
        _CHUNKS,
        _SYSTEMS,
        f"""relevant AS (SELECT DISTINCT q.id AS query_id, kc.id AS chunk_id FROM kb q JOIN kb d ON d.title = q.title JOIN kc ON document_id = d.id WHERE q.id % 100 = 0),
        rel AS (SELECT query_id, count(*) AS n_rel FROM relevant GROUP BY query_id),
        hits AS (SELECT method, query_id, min(rank) FILTER (hit) AS first_, {_HITS} FROM (
          SELECT a.*, (query_id, chunk_id) IN (SELECT query_id, chunk_id FROM relevant) AS hit FROM answers a WHERE rank <= 10) GROUP BY ALL),
        labels AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{m}', '{t}')" for i, (m, t) in enumerate(LABELS.items()))}) v(position, method, system)),
        per AS (SELECT position, system, n_rel, first_, {", ".join(f"coalesce({c}_{k}, 0) AS {c}_{k}" for k in (5, 10) for c in "hng")}
          FROM labels CROSS JOIN ask LEFT JOIN rel USING (query_id) LEFT JOIN hits ON hits.method = labels.method AND hits.query_id = ask.query_id)""",
        recursive=True,
        query=f"""SELECT CAST(position AS INT) AS position, system, n_queries, {", ".join(f"round({c}, 6) AS {c}" for c in ("p_5", "r_5", "ndcg_5", "p_10", "r_10", "ndcg_10", "rr"))}
          FROM (SELECT position, system, count(*) AS n_queries, {_METRICS}, coalesce(avg(coalesce(1.0::DOUBLE / first_, 0)), 0) AS rr FROM per GROUP BY ALL)""",
    ),
}
