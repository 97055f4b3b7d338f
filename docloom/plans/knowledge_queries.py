"""Integrity, graph and read-model queries over the document collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import facts
from docloom.functions.fixed import AUTHORITY, CONTEXT_STOPWORDS, DEFINITION_PATTERNS, SEVERITY_HIGH, SEVERITY_MEDIUM, UNIT_PATTERNS, UNRESOLVED
from docloom.operators import evaluation, graph, integrity, serving
from docloom.plans import adapters
from docloom.plans.adapters import table
from docloom.plans.tables import materialize
from docloom.plans.text_queries import STOP, TOKENS


class Base:
    """The collection and what is derived from it, each made once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.docs = materialize(adapters.documents(spark, sf_dir), "documents")
        self.chunks = adapters.chunks(self.docs)
        self.made: dict[str, DataFrame] = {}
        self.resolved: graph.Edges | None = None

    def _once(self, name: str, make) -> DataFrame:
        if name not in self.made:
            self.made[name] = materialize(make(), name)
        return self.made[name]

    @property
    def graph_docs(self) -> DataFrame:
        return self.docs.withColumn("first_chunk_id", F.col("id"))

    def versions(self) -> DataFrame:
        return self._once("versions", lambda: integrity.supersedes_pairs(self.docs))

    def contradictions(self) -> DataFrame:
        return self._once("contradictions", lambda: integrity.contradictions(self.chunks, self.versions()))

    def definition_conflicts(self) -> DataFrame:
        return self._once("definition_conflicts", lambda: integrity.definition_conflicts(self.chunks))

    def conflicts(self) -> DataFrame:
        return self._once("conflicts", lambda: integrity.conflicts_table(self.contradictions(), self.definition_conflicts()))

    def conflicts_of(self, *kinds: str) -> DataFrame:
        """Conflicts of the kinds given, ``contradiction`` and ``definition``; others aren't looked for."""
        return integrity.conflicts_table(
            self.contradictions() if "contradiction" in kinds else None, self.definition_conflicts() if "definition" in kinds else None
        )

    def duplicate_pairs(self) -> DataFrame:
        return self._once("duplicates", lambda: integrity.duplicate_pairs(self.chunks, self.versions(), 0.5))

    def duplicates(self) -> DataFrame:
        return self._once("clusters", lambda: integrity.duplicate_clusters(self.duplicate_pairs()))

    def cases(self, kinds: tuple[str, ...] = (), severities: tuple[str, ...] = (), numbered: bool = True) -> DataFrame:
        """Cases of the kinds and severities given; what can't be among them isn't looked for."""
        only = serving.case_kinds(kinds, severities)
        asked = [t for k, t in (("CTR", "contradiction"), ("DEF", "definition")) if k in only]
        conflicts = self.conflicts_of(*asked) if asked else None
        pairs = self.duplicate_pairs() if "DUP" in only else None
        return serving.filter_cases(serving.integrity_cases(conflicts, pairs, integrity.outdated_documents(self.docs), only, numbered), kinds, severities)

    def entities(self) -> DataFrame:
        return self._once("entities", lambda: graph.extract_entities(self.graph_docs))

    def graph(self) -> graph.Edges:
        if self.resolved is None:
            self.resolved = graph.Edges(self.docs, self.entities())
        return self.resolved

    def edges(self) -> DataFrame:
        return self.graph().all()

    def found_edges(self) -> DataFrame:
        # No step of extraction makes an edge of these kinds, so none exists yet.
        return self._once("found_edges", lambda: graph.integrity_edges(self.conflicts(), self.duplicates(), self.chunks, self.entities()))


def documents_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = serving.list_documents(Base(spark, sf_dir).docs, status="current")
    return rows.select("id", "doc_key", "department", "title", "doc_type", "authority_label", "authority_description")


def document_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Base(spark, sf_dir)
    chunks = b.chunks.withColumn("token_count", F.size(F.split("text", r"\s+")))
    rows = serving.document_detail(b.docs, chunks)
    return rows.select("id", "doc_key", F.size("chunks").cast("bigint").alias("n_chunks"), F.sha2(F.get("chunks", F.lit(0))["text"], 256).alias("digest"))


def outdated_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.list_outdated(Base(spark, sf_dir).docs)


def supersedes_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Base(spark, sf_dir).versions()


def numeric_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts.numeric_facts(Base(spark, sf_dir).chunks.select("chunk_id", "text"))
    return found.select("chunk_id", "unit", F.col("match_no").cast("bigint").alias("match_no"), "value", "context_key", "raw_match")


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Base(spark, sf_dir).contradictions()


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.definitions(Base(spark, sf_dir).chunks.select("chunk_id", "text")).select("chunk_id", "term", "definition_text")


def definition_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Base(spark, sf_dir).definition_conflicts()


def conflict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Base(spark, sf_dir)
    rows = serving.explained_conflicts(b.conflicts(), b.chunks.select("chunk_id", "document_id", "text"), b.docs)
    return rows.select("conflict_type", "chunk_a_id", "chunk_b_id", "doc_key_a", "doc_key_b", "resolved_doc_key", "resolution_reason")


def duplicate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Base(spark, sf_dir).duplicates()


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate documents of the whole documents table: the smallest id of each cluster, by document."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text")
    none = spark.createDataFrame([], "current_id bigint, outdated_id bigint")
    pairs = materialize(integrity.duplicate_pairs(chunks, none), "pairs")
    from docloom.operators.components import connected_components

    parts = connected_components(pairs, "chunk_a_id", "chunk_b_id")
    return parts.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Base(spark, sf_dir).entities()


def metadata_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.metadata_relations(Base(spark, sf_dir).docs)


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reference_relations(Base(spark, sf_dir).docs)


def statement_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.statement_relations(Base(spark, sf_dir).docs)


def tag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tag_relations(Base(spark, sf_dir).docs)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Base(spark, sf_dir).edges()


def integrity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Base(spark, sf_dir).found_edges()


def graph_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Base(spark, sf_dir).graph().tallies()


def neighbourhood_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every kind within two hops of document doc-10, found by its name in capitals."""
    b = Base(spark, sf_dir)
    start = graph.find_entity(b.entities(), "DOC-10")
    ids = b.entities().where(F.col("id") == (-1 if start is None else start)).select("id")
    return graph.neighbourhood(b.entities(), b.graph(), ids, 2, b.found_edges())[1]


def related_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Base(spark, sf_dir)
    rows = serving.related_entities(b.entities(), b.graph(), more=b.found_edges())
    return rows.select("name", related_text().alias("related"))


def related_text():
    return F.array_join(F.transform("related", lambda r: F.concat_ws("|", r["name"], r["entity_type"], r["relation_type"])), ";")


def conflicted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Base(spark, sf_dir)
    return serving.conflicted_documents(b.conflicts(), b.chunks)


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search with full context: each document's title as a query."""
    from docloom.operators.bm25 import bm25_search, build_bm25

    b = Base(spark, sf_dir)
    asked = b.docs.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", "title", "department").alias("text"))
    found = materialize(bm25_search(build_bm25(b.chunks), asked, 5), "found")
    rows = serving.enrich_results("bm25", found, asked, b.chunks.select("chunk_id", "document_id", "text"), b.docs, b.conflicts())
    return rows.select(
        "query_id", "chunk_id", "rank", "score", "confidence", "doc_key", "authority_label", "has_conflict", F.array_join("matched_terms", ",").alias("matched")
    )


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Base(spark, sf_dir)
    row = serving.dashboard(b.docs, b.entities(), b.graph(), b.conflicts(), b.duplicates())
    return row.withColumns({c: map_text(c) for c in ("documents_by_department", "documents_by_status")})


def map_text(column: str):
    """A map as text, which any engine can compare."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")


def department_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Base(spark, sf_dir).docs.groupBy("department", "status").agg(F.count("*").alias("n"))
    return serving.bar_shares(counts)


def integrity_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Base(spark, sf_dir).cases()


def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Base(spark, sf_dir)
    return serving.case_summary(b.cases(severities=("high",), numbered=False), b.conflicts())


def detector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found contradictions against those that the parts' sizes imply: documents of one grade with other windows."""
    b = Base(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_partkey") % 4).alias("grade"), "p_size")
    other = part.select(F.col("id").alias("chunk_b_id"), "grade", F.col("p_size").alias("size_b"))
    truth = part.join(other, "grade").where("id < chunk_b_id AND p_size <> size_b").select(F.col("id").alias("chunk_a_id"), "chunk_b_id")
    return evaluation.validate_pairs(truth, b.contradictions(), "chunk_a_id", "chunk_b_id")


QUERIES = {
    f.__name__: f
    for f in (
        documents_list,
        document_details,
        outdated_list,
        supersedes_pairs,
        numeric_facts,
        contradictions,
        definitions,
        definition_conflicts,
        conflict_reasons,
        duplicate_chunks,
        near_duplicates,
        entities,
        metadata_edges,
        reference_edges,
        statement_edges,
        tag_edges,
        graph_edges,
        integrity_edges,
        graph_tallies,
        neighbourhood_k2,
        related_documents,
        conflicted_documents,
        search_results,
        dashboard,
        department_counts,
        integrity_cases,
        case_summary,
        detector_validation,
    )
}


# DuckDB SQL, built from the same steps as common table expressions.

_KB = f"kb AS ({adapters.DOCUMENTS})"


def _level(which: int, column: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v[which]}'" for k, v in AUTHORITY.items())
    other = f"'Level ' || {column}" if not which else "'Unrecognized authority level.'"
    return f"CASE {column} {cases} ELSE {other} END"


_VERSIONS = "ver AS (SELECT n.id AS current_id, o.id AS outdated_id FROM kb n JOIN kb o ON n.supersedes_doc_key = o.doc_key)"
_CONTEXT = "[" + ", ".join(f"'{w}'" for w in CONTEXT_STOPWORDS) + "]"
_FACTS = """facts AS (
  SELECT chunk_id, unit, unit_no, i - 1 AS match_no, CAST(replace(g1[i], ',', '') AS BIGINT) AS value, g0[i] AS raw_match,
    unit || '::' || array_to_string(w[greatest(len(w) - 3, 1):], ' ') AS context_key
  FROM (SELECT *, list_filter(regexp_extract_all(array_to_string(list_transform(range(1, i + 1), lambda j: p[j] || CASE WHEN j < i THEN g0[j] ELSE '' END), ''),
      '[a-z]+'), lambda x: NOT list_contains(%s, x)) AS w FROM (
    SELECT *, unnest(range(1, len(g0) + 1)) AS i FROM (%s)))
)""" % (
    _CONTEXT,
    " UNION ALL ".join(
        f"SELECT id AS chunk_id, '{u}' AS unit, {n} AS unit_no, string_split_regex(lower(raw_text), '{p}') AS p, "
        f"regexp_extract_all(lower(raw_text), '{p}', 0) AS g0, regexp_extract_all(lower(raw_text), '{p}', 1) AS g1 FROM kb"
        for n, (u, p) in enumerate(UNIT_PATTERNS)
    ),
)

_SEVERITY = f"""CASE WHEN regexp_matches(lower(context_key || ' ' || da || ' ' || db), '{"|".join(SEVERITY_HIGH)}') THEN 'high'
  WHEN regexp_matches(lower(context_key || ' ' || da || ' ' || db), '{"|".join(SEVERITY_MEDIUM)}') THEN 'medium' ELSE 'low' END"""

_CONTRA = f"""{_FACTS}, f AS (
  SELECT facts.*, kb.doc_key, kb.department, kb.authority_level, (chunk_id * 10 + unit_no) * 1000 + match_no AS o,
    min((chunk_id * 10 + unit_no) * 1000 + match_no) OVER (PARTITION BY context_key) AS co
  FROM facts JOIN kb ON kb.id = chunk_id
), cp AS (
  SELECT *, row_number() OVER (PARTITION BY least(ca, cb), greatest(ca, cb) ORDER BY co, oa, ob) AS n FROM (
    SELECT a.context_key, a.unit, a.co, a.o AS oa, b.o AS ob, a.chunk_id AS ca, b.chunk_id AS cb, a.raw_match AS va, b.raw_match AS vb,
      a.department AS da, b.department AS db, a.authority_level AS la, b.authority_level AS lb, a.doc_key AS ka, b.doc_key AS kb_
    FROM f a JOIN f b ON a.context_key = b.context_key AND a.o < b.o AND a.value <> b.value AND a.chunk_id <> b.chunk_id
    WHERE NOT EXISTS (SELECT 1 FROM ver WHERE (current_id = a.chunk_id AND outdated_id = b.chunk_id) OR (current_id = b.chunk_id AND outdated_id = a.chunk_id)))
), contra AS (
  SELECT CASE WHEN split_part(context_key, '::', 2) = '' THEN context_key ELSE split_part(context_key, '::', 2) END AS concept,
    ca AS chunk_a_id, cb AS chunk_b_id, va AS value_a, vb AS value_b, {_SEVERITY} AS severity,
    CASE WHEN la <= lb THEN ka ELSE kb_ END AS resolved_doc_key FROM cp WHERE n = 1
)"""

_DEFS = """defs AS (
  SELECT chunk_id, pattern_no, i AS match_no, trim(g1[i]) AS term, trim(g2[i]) AS definition_text FROM (SELECT *, unnest(range(1, len(g1) + 1)) AS i FROM (
    %s))
)""" % " UNION ALL ".join(
    f"SELECT id AS chunk_id, {n} AS pattern_no, regexp_extract_all(raw_text, '{p}', 1) AS g1, regexp_extract_all(raw_text, '{p}', 2) AS g2 FROM kb"
    for n, p in enumerate(DEFINITION_PATTERNS)
)
_DEFCONF = f"""{_DEFS}, dd AS (
  SELECT defs.*, department, lower(term) AS k, (chunk_id * 10 + pattern_no) * 1000 + match_no AS o,
    list_distinct(regexp_extract_all(lower(definition_text), '[a-z]+')) AS ws,
    min((chunk_id * 10 + pattern_no) * 1000 + match_no) OVER (PARTITION BY lower(term)) AS t_o FROM defs JOIN kb ON kb.id = chunk_id
), dconf AS (
  SELECT term, chunk_a_id, chunk_b_id, definition_a, definition_b FROM (
    SELECT a.term, a.chunk_id AS chunk_a_id, b.chunk_id AS chunk_b_id, a.definition_text AS definition_a, b.definition_text AS definition_b,
      row_number() OVER (PARTITION BY least(a.chunk_id, b.chunk_id), greatest(a.chunk_id, b.chunk_id) ORDER BY a.t_o, a.o, b.o) AS n
    FROM dd a JOIN dd b ON a.k = b.k AND a.o < b.o AND a.department <> b.department AND a.chunk_id <> b.chunk_id
    WHERE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) < 0.5) WHERE n = 1
)"""
_CONFLICTS = f"""{_VERSIONS}, {_CONTRA}, {_DEFCONF}, conf AS (
  SELECT concept, 'contradiction' AS conflict_type, chunk_a_id, chunk_b_id, value_a, value_b, severity, resolved_doc_key FROM contra
  UNION ALL SELECT term, 'definition', chunk_a_id, chunk_b_id, substr(definition_a, 1, 250), substr(definition_b, 1, 250), 'medium', NULL FROM dconf
)"""


def _pairs_sql(source: str, doc: str, text: str, threshold: float) -> str:
    """Cosines of class representatives and their copies, as in duplicate_pairs."""
    return f"""dw AS (
  SELECT {doc} AS d, list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({STOP}, x)) AS w FROM {source}
), dg AS (
  SELECT d, list_sort(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM dw
), dc AS (SELECT d, g, min(d) OVER (PARTITION BY g) AS cls FROM dg WHERE len(g) > 0),
dt AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(g) AS term FROM dc) GROUP BY ALL),
ddf AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
dv AS (SELECT d, term, w / sqrt(sum(w * w) OVER (PARTITION BY d)) AS w FROM (
  SELECT d, dt.term, tf * (ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1) AS w FROM dt JOIN ddf USING (term))),
dr AS (SELECT dv.* FROM dv JOIN dc USING (d) WHERE d = cls),
dp AS (
  SELECT * FROM (SELECT a.d AS a, b.d AS b, round(sum(a.w * b.w), 6) AS score FROM dr a JOIN dr b ON a.term = b.term AND a.d < b.d GROUP BY ALL) WHERE score >= {threshold}
  UNION ALL SELECT cls, d, 1.0 FROM dc WHERE d <> cls
)"""


_DUPS = f"""{_pairs_sql("kb", "id", "raw_text", 0.5)}, dups AS (
  SELECT a AS chunk_a_id, b AS chunk_b_id, score AS similarity_score FROM dp WHERE NOT EXISTS (
    SELECT 1 FROM ver WHERE (current_id = a AND outdated_id = b) OR (current_id = b AND outdated_id = a))
), sym AS (SELECT chunk_a_id AS x, chunk_b_id AS y FROM dups UNION SELECT chunk_b_id, chunk_a_id FROM dups),
reach AS (SELECT x, y FROM sym UNION SELECT reach.x, sym.y FROM reach JOIN sym ON reach.y = sym.x),
comp AS (SELECT x AS node, least(x, min(y)) AS component FROM reach GROUP BY x),
clus AS (
  SELECT dups.*, n.cluster_id FROM dups JOIN comp ON comp.node = chunk_a_id
  JOIN (SELECT component, row_number() OVER (ORDER BY component) AS cluster_id FROM (SELECT DISTINCT component FROM comp)) n USING (component)
)"""

_ETYPE = "CASE doc_type WHEN 'Policy' THEN 'Policy' WHEN 'SOP' THEN 'Process' ELSE 'Documentation' END"
_ENTITIES = rf"""raw_e AS (
  SELECT -1 AS id, 0 AS pos, 'Group' AS entity_type, 'Employees' AS name, CAST(NULL AS BIGINT) AS chunk
  UNION ALL SELECT id, 0, {_ETYPE}, doc_key, id FROM kb
  UNION ALL SELECT id, 1, 'Department', department, NULL FROM kb
  UNION ALL SELECT id, 2, 'Department', owner, NULL FROM kb WHERE owner IS NOT NULL
  UNION ALL SELECT id, 3, 'Person', author, NULL FROM kb WHERE NOT ends_with(trim(author), 'Team')
  UNION ALL SELECT id, 4, 'Team', unnest(list_sort(list_distinct(regexp_extract_all(raw_text, '\b([A-Z][a-zA-Z]+) team (?:owns|manages|is responsible for|leads)\b', 1)))), id FROM kb
  UNION ALL SELECT id, 5, 'Project', 'Project ' || unnest(regexp_extract_all(title, '\bProject ([A-Z][a-zA-Z]+)\b', 1)), id FROM kb
  UNION ALL SELECT id, 6, 'Concept', unnest(list_sort(list_distinct(list_concat(regexp_extract_all(raw_text, '\b([A-Z][a-zA-Z]{{2,40}})\s+is defined as\s+', 1),
    regexp_extract_all(raw_text, '\b([A-Z][a-zA-Z]{{2,40}})\s+means\s+', 1))))), id FROM kb
), ent AS (
  SELECT row_number() OVER (ORDER BY fid, fpos) AS id, name, entity_type, first_seen_chunk_id, true AS canonical FROM (
    SELECT entity_type, name, min(id) AS fid, arg_min(pos, id * 10 + pos) AS fpos, arg_min(coalesce(chunk, -9), id * 10 + pos) AS c,
      nullif(arg_min(coalesce(chunk, -9), id * 10 + pos), -9) AS first_seen_chunk_id FROM raw_e GROUP BY entity_type, name)
)"""

_META = """meta AS (
  SELECT doc_key AS source, 'Document' AS source_type, owner AS target, 'Department' AS target_type, 'owned_by' AS relation_type, 1.0::DOUBLE AS confidence FROM kb WHERE owner IS NOT NULL
  UNION ALL SELECT doc_key, 'Document', department, 'Department', 'belongs_to', 1.0 FROM kb WHERE owner IS NULL OR owner <> department
  UNION ALL SELECT doc_key, 'Document', author, 'Person', 'created_by', 1.0 FROM kb WHERE NOT ends_with(trim(author), 'Team')
  UNION ALL SELECT doc_key, 'Document', supersedes_doc_key, 'Document', 'supersedes', 1.0 FROM kb WHERE supersedes_doc_key IN (SELECT doc_key FROM kb)
  UNION ALL SELECT doc_key, 'Document', 'Employees', 'Group', 'applies_to', 1.0 FROM kb WHERE doc_type IN ('Policy', 'Handbook')
  UNION ALL SELECT doc_key, 'Document', department, 'Department', 'applies_to', 1.0 FROM kb WHERE doc_type = 'SOP'
)"""
_REFS = r"""refs AS (
  SELECT d.doc_key AS source, 'Document' AS source_type, t.doc_key AS target, 'Document' AS target_type, 'references' AS relation_type, 0.9::DOUBLE AS confidence
  FROM (SELECT doc_key, supersedes_doc_key, lower(title) AS own, lower(trim(regexp_replace(raw_text, '\s+', ' ', 'g'))) AS body FROM kb) d
  JOIN (SELECT doc_key, lower(title) AS t FROM kb WHERE length(title) >= 10) t ON contains(d.body, t.t)
  WHERE NOT contains(d.own, t.t) AND t.doc_key <> d.doc_key AND t.doc_key IS DISTINCT FROM d.supersedes_doc_key
)"""
_STATE = """state AS (
  SELECT name AS source, 'Team' AS source_type, doc_key AS target, 'Document' AS target_type, 'manages' AS relation_type, 0.9::DOUBLE AS confidence
    FROM raw_e JOIN kb USING (id) WHERE entity_type = 'Team'
  UNION ALL SELECT doc_key, 'Document', name, 'Project', 'related_to', 1.0 FROM raw_e JOIN kb USING (id) WHERE entity_type = 'Project'
  UNION ALL SELECT doc_key, 'Document', name, 'Concept', 'defines', 0.9 FROM raw_e JOIN kb USING (id) WHERE entity_type = 'Concept'
)"""
_TAGS = """tg AS (SELECT DISTINCT doc_key, lower(trim(t)) AS tag FROM (SELECT doc_key, unnest(string_split(tags, ',')) AS t FROM kb) WHERE trim(t) <> ''),
tg2 AS (SELECT * FROM tg WHERE tag NOT IN (SELECT lower(department) FROM kb UNION SELECT lower(owner) FROM kb WHERE owner IS NOT NULL)),
tags AS (
  SELECT DISTINCT a.doc_key AS source, 'Document' AS source_type, b.doc_key AS target, 'Document' AS target_type, 'related_to' AS relation_type, 0.6::DOUBLE AS confidence
  FROM tg2 a JOIN tg2 b ON a.tag = b.tag AND a.doc_key < b.doc_key
  WHERE NOT EXISTS (SELECT 1 FROM kb WHERE (doc_key = a.doc_key AND supersedes_doc_key = b.doc_key) OR (doc_key = b.doc_key AND supersedes_doc_key = a.doc_key))
)"""
_EDGES = f"""{_ENTITIES}, {_META}, {_REFS}, {_STATE}, {_TAGS}, rel AS (
  SELECT *, 0 AS step FROM meta UNION ALL SELECT *, 1 FROM refs UNION ALL SELECT *, 2 FROM state UNION ALL SELECT *, 3 FROM tags
), known AS (
  SELECT name, min(id) AS id FROM ent GROUP BY name
), res AS (
  SELECT rel.*, s.id AS source_entity_id, t.id AS target_entity_id FROM rel
  LEFT JOIN known s ON s.name = source LEFT JOIN known t ON t.name = target
), edge AS (
  SELECT source_entity_id, target_entity_id, relation_type, first(confidence ORDER BY step, confidence DESC) AS confidence FROM res
  WHERE source_entity_id IS NOT NULL AND target_entity_id IS NOT NULL GROUP BY ALL
)"""
_FOUND = """docent AS (SELECT k.id AS doc, known.id AS entity FROM kb k JOIN known ON known.name = k.doc_key),
found AS (
  SELECT least(a.entity, b.entity) AS source_entity_id, greatest(a.entity, b.entity) AS target_entity_id, relation_type, first(c ORDER BY chunk_a_id, chunk_b_id) AS confidence FROM (
    SELECT chunk_a_id, chunk_b_id, 'conflicts_with' AS relation_type, 1.0::DOUBLE AS c FROM conf
    UNION ALL SELECT chunk_a_id, chunk_b_id, 'duplicate_of', similarity_score FROM dups) p
  JOIN docent a ON a.doc = chunk_a_id JOIN docent b ON b.doc = chunk_b_id WHERE a.entity <> b.entity GROUP BY ALL
)"""
_CASES = """cases AS (
  SELECT 'CTR-' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS case_id, 'CTR' AS kind, concept AS title, severity
    FROM (SELECT *, row_number() OVER (ORDER BY chunk_a_id, chunk_b_id) AS n FROM conf WHERE conflict_type = 'contradiction')
  UNION ALL SELECT 'DEF-' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END, 'DEF', concept, severity
    FROM (SELECT *, row_number() OVER (ORDER BY chunk_a_id, chunk_b_id) AS n FROM conf WHERE conflict_type = 'definition')
  UNION ALL SELECT 'DUP-' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END, 'DUP', chunk_a_id || ' / ' || chunk_b_id,
    CASE WHEN similarity_score >= 0.85 THEN 'medium' ELSE 'low' END FROM (SELECT *, row_number() OVER (ORDER BY chunk_a_id, chunk_b_id) AS n FROM clus)
  UNION ALL SELECT 'OUT-' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END, 'OUT', title, 'medium'
    FROM (SELECT *, row_number() OVER (ORDER BY supersedes_doc_key, doc_key) AS n FROM kb WHERE supersedes_doc_key IN (SELECT doc_key FROM kb))
)"""


def _with(*parts: str, query: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([_KB, *parts])} {query}"


_REASON = f"""CASE WHEN resolved_doc_key IS NULL THEN '{UNRESOLVED.replace("'", "''")}' ELSE
  w.doc_key || ' (' || {_level(0, "w.authority_level")} || ', level ' || w.authority_level || ') outranks '
  || l.doc_key || ' (' || {_level(0, "l.authority_level")} || ', level ' || l.authority_level || ').'
  || CASE WHEN l.effective_date > w.effective_date THEN ' Note: ' || l.doc_key || ' is the more recently effective document (' || l.effective_date || ' vs '
    || w.effective_date || ') but has lower authority.' ELSE '' END END"""

ORACLES = {
    "documents_list": _with(
        query=f"""SELECT id, doc_key, department, title, doc_type, {_level(0, "authority_level")} AS authority_label,
          {_level(1, "authority_level")} AS authority_description FROM kb WHERE status = 'current'"""
    ),
    "document_details": _with(query="SELECT id, doc_key, CAST(1 AS BIGINT) AS n_chunks, sha256(raw_text) AS digest FROM kb"),
    "outdated_list": _with(
        query="""SELECT o.doc_key AS outdated_doc_key, o.title AS outdated_title, o.version AS outdated_version, o.effective_date AS outdated_effective_date,
          n.doc_key AS current_doc_key, n.title AS current_title, n.version AS current_version, n.effective_date AS current_effective_date, n.title AS concept,
          n.doc_key || ' (v' || n.version || ') explicitly supersedes ' || o.doc_key || ' (v' || o.version || ') per document metadata.' AS reason
          FROM kb n JOIN kb o ON n.supersedes_doc_key = o.doc_key"""
    ),
    "supersedes_pairs": _with(_VERSIONS, query="SELECT * FROM ver"),
    "numeric_facts": _with(_FACTS, query="SELECT chunk_id, unit, match_no, value, context_key, raw_match FROM facts"),
    "contradictions": _with(_VERSIONS, _CONTRA, query="SELECT * FROM contra"),
    "definitions": _with(_DEFS, query="SELECT chunk_id, term, definition_text FROM defs"),
    "definition_conflicts": _with(_DEFCONF, query="SELECT * FROM dconf"),
    "conflict_reasons": _with(
        _CONFLICTS,
        query=f"""SELECT conflict_type, chunk_a_id, chunk_b_id, a.doc_key AS doc_key_a, b.doc_key AS doc_key_b, resolved_doc_key, {_REASON} AS resolution_reason
          FROM conf JOIN kb a ON a.id = chunk_a_id JOIN kb b ON b.id = chunk_b_id
          JOIN kb w ON w.id = CASE WHEN resolved_doc_key = a.doc_key THEN a.id ELSE b.id END
          JOIN kb l ON l.id = CASE WHEN resolved_doc_key = a.doc_key THEN b.id ELSE a.id END""",
    ),
    "duplicate_chunks": _with(_VERSIONS, _DUPS, query="SELECT * FROM clus", recursive=True),
    "near_duplicates": f"""WITH RECURSIVE {_pairs_sql("documents", "doc_id", "text", 0.6)},
      sym AS (SELECT a AS x, b AS y FROM dp UNION SELECT b, a FROM dp),
      reach AS (SELECT x, y FROM sym UNION SELECT reach.x, sym.y FROM reach JOIN sym ON reach.y = sym.x)
      SELECT x AS doc_id, least(x, min(y)) AS cluster FROM reach GROUP BY x""",
    "entities": _with(_ENTITIES, query="SELECT id, name, entity_type, first_seen_chunk_id, canonical FROM ent"),
    "metadata_edges": _with(_META, query="SELECT * FROM meta"),
    "reference_edges": _with(_REFS, query="SELECT DISTINCT * FROM refs"),
    "statement_edges": _with(_ENTITIES, _STATE, query="SELECT * FROM state"),
    "tag_edges": _with(_TAGS, query="SELECT * FROM tags"),
    "graph_edges": _with(_EDGES, query="SELECT * FROM edge"),
    "integrity_edges": _with(
        _CONFLICTS,
        _DUPS,
        _EDGES,
        _FOUND,
        recursive=True,
        query="""SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.relation_type = f.relation_type
          AND least(e.source_entity_id, e.target_entity_id) = f.source_entity_id AND greatest(e.source_entity_id, e.target_entity_id) = f.target_entity_id)""",
    ),
    "graph_tallies": _with(
        _EDGES,
        query="""SELECT (SELECT count(*) FROM rel) AS found, (SELECT count(*) FROM edge) AS created,
          (SELECT count(*) FROM res WHERE source_entity_id IS NULL OR target_entity_id IS NULL) AS skipped_unresolved""",
    ),
    "neighbourhood_k2": _with(
        _CONFLICTS,
        _DUPS,
        _EDGES,
        _FOUND,
        """ed AS (
          SELECT * FROM edge UNION ALL SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.relation_type = f.relation_type
            AND least(e.source_entity_id, e.target_entity_id) = f.source_entity_id AND greatest(e.source_entity_id, e.target_entity_id) = f.target_entity_id)
        ), un AS (SELECT source_entity_id AS u, target_entity_id AS v FROM ed UNION SELECT target_entity_id, source_entity_id FROM ed),
        r0 AS (SELECT min(id) AS id FROM ent WHERE lower(name) = 'doc-10'),
        r1 AS (SELECT id FROM r0 UNION SELECT v FROM un JOIN r0 ON id = u), r2 AS (SELECT id FROM r1 UNION SELECT v FROM un JOIN r1 ON id = u)""",
        recursive=True,
        query="SELECT e.* FROM ed e JOIN r2 a ON a.id = e.source_entity_id JOIN r2 b ON b.id = e.target_entity_id",
    ),
    "related_documents": _with(
        _CONFLICTS,
        _DUPS,
        _EDGES,
        _FOUND,
        recursive=True,
        query=""", alle AS (
          SELECT source_entity_id, target_entity_id, relation_type FROM edge UNION ALL SELECT source_entity_id, target_entity_id, relation_type FROM found f
          WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.relation_type = f.relation_type AND least(e.source_entity_id, e.target_entity_id) = f.source_entity_id
            AND greatest(e.source_entity_id, e.target_entity_id) = f.target_entity_id)
        ), sides AS (
          SELECT *, source_entity_id AS id, target_entity_id AS other FROM alle WHERE relation_type <> 'created_by'
          UNION ALL SELECT *, target_entity_id, source_entity_id FROM alle WHERE relation_type <> 'created_by' AND source_entity_id <> target_entity_id
        ), ranked AS (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE relation_type WHEN 'conflicts_with' THEN 0 WHEN 'supersedes' THEN 1 WHEN 'duplicate_of' THEN 2
            WHEN 'owned_by' THEN 3 WHEN 'applies_to' THEN 4 ELSE 9 END, source_entity_id, target_entity_id, relation_type) AS rank FROM sides
        ), lists AS (
          SELECT r.id, string_agg(o.name || '|' || o.entity_type || '|' || relation_type, ';' ORDER BY rank) AS l FROM ranked r JOIN ent o ON o.id = other WHERE rank <= 4 GROUP BY r.id
        ) SELECT name, l AS related FROM lists JOIN known USING (id)""",
    ).replace(") , alle AS", "), alle AS"),
    "search_results": _with(
        _CONFLICTS,
        """kt AS (SELECT id, unnest(%s) AS term FROM kb), ktf AS (SELECT term, id, count(*) AS tf FROM kt GROUP BY ALL),
        kraw AS (SELECT term, ln(CAST((SELECT count(*) FROM kb) AS DOUBLE) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM ktf GROUP BY term),
        kidf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM kraw) ELSE raw END AS idf FROM kraw),
        klen AS (SELECT id, count(*) AS dl FROM kt GROUP BY id),
        ask AS (SELECT id AS query_id, %s AS qt FROM kb WHERE id %% 100 = 0),
        kq AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(qt) AS term FROM ask) GROUP BY ALL),
        ks AS (SELECT query_id, id AS chunk_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(dl) FROM klen)))), 6) AS score
          FROM kq JOIN kidf USING (term) JOIN ktf USING (term) JOIN klen USING (id) GROUP BY ALL),
        kr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ks WHERE score > 0) WHERE rank <= 5)"""
        % (TOKENS.replace("lower(text)", "lower(raw_text)"), TOKENS.replace("lower(text)", "lower(title || ' ' || department)")),
        query=f"""SELECT query_id, chunk_id, rank, score, round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, score / max(score) OVER (PARTITION BY query_id) * 100)), 1) AS confidence,
          doc_key, {_level(0, "authority_level")} AS authority_label,
          chunk_id IN (SELECT chunk_a_id FROM conf UNION SELECT chunk_b_id FROM conf) AS has_conflict,
          array_to_string(list_filter(qt, lambda x, i: list_contains({TOKENS.replace("lower(text)", "lower(raw_text)")}, x) AND list_position(qt, x) = i)[1:6], ',') AS matched
          FROM kr JOIN ask USING (query_id) JOIN kb ON kb.id = chunk_id""",
    ),
    "conflicted_documents": _with(_CONFLICTS, query="SELECT chunk_a_id AS document_id FROM conf UNION SELECT chunk_b_id FROM conf"),
    "dashboard": _with(
        _CONFLICTS,
        _DUPS,
        _EDGES,
        recursive=True,
        query="""SELECT d AS documents, o AS potentially_outdated, (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM edge) AS relationships, c AS conflicts,
          k AS duplicate_clusters, CASE WHEN c > 0 OR k > 0 THEN CAST(printf('%.1f', 100.0::DOUBLE * (1.0::DOUBLE - c / greatest(d, 1))) AS DOUBLE) END AS integrity_score,
          (SELECT string_agg(department || '=' || n, ';' ORDER BY department) FROM (SELECT department, count(*) AS n FROM kb GROUP BY department)) AS documents_by_department,
          (SELECT string_agg(status || '=' || n, ';' ORDER BY status) FROM (SELECT status, count(*) AS n FROM kb GROUP BY status)) AS documents_by_status
          FROM (SELECT count(*) AS d, count(*) FILTER (status = 'superseded') AS o FROM kb), (SELECT count(*) AS c FROM conf),
          (SELECT count(DISTINCT cluster_id) AS k FROM clus)""",
    ),
    "department_counts": _with(
        query="SELECT department, status, count(*) AS n, count(*) / greatest(max(count(*)) OVER (), 1) AS share FROM kb GROUP BY department, status"
    ),
    "integrity_cases": _with(
        _CONFLICTS,
        _DUPS,
        _CASES,
        recursive=True,
        query="SELECT *, CAST(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS INT) AS severity_rank FROM cases",
    ),
    "case_summary": _with(
        _CONFLICTS,
        _DUPS,
        _CASES,
        recursive=True,
        query="""SELECT (SELECT count(*) FROM cases WHERE severity = 'high') AS high_severity,
          count(*) FILTER (resolved_doc_key IS NOT NULL) AS resolved, count(*) FILTER (conflict_type = 'definition' AND resolved_doc_key IS NULL) AS unresolved_definitions FROM conf""",
    ),
    "detector_validation": _with(
        _VERSIONS,
        _CONTRA,
        """truth AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b
          ON a.p_partkey - a.p_partkey % 4 = b.p_partkey - b.p_partkey % 4 AND a.p_partkey < b.p_partkey AND a.p_size <> b.p_size),
        fnd AS (SELECT DISTINCT least(chunk_a_id, chunk_b_id) AS a, greatest(chunk_a_id, chunk_b_id) AS b FROM contra)""",
        query="""SELECT (SELECT count(*) FROM truth JOIN fnd USING (a, b)) AS hits, (SELECT count(*) FROM truth) AS truth, (SELECT count(*) FROM fnd) AS found""",
    ),
}
