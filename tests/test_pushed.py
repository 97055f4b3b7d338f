"""Findings that aren't asked for aren't looked for; texts move once when chunks are numbered."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import facts, fixed
from docloom.operators import serving
from docloom.plans import adapters, knowledge_queries, service_queries
from tests.test_oracles import SF


@pytest.mark.parametrize("name, unused", [("definitions_list", "contradictions"), ("conflicts_list", "definition_conflicts"), ("cases_filtered", "duplicate_pairs"), ("case_summary", "duplicate_pairs")])
def test_unused_findings_are_not_made(spark, monkeypatch, name, unused):
    def fail(*args, **kwargs):
        raise AssertionError(f"{unused} were made")

    monkeypatch.setattr(knowledge_queries.integrity, unused, fail)
    query = getattr(service_queries, name, None) or getattr(knowledge_queries, name)
    assert query(spark, SF).count()


def test_case_levels_are_those_of_cases(spark):
    got = {(r["kind"], r["severity"]) for r in knowledge_queries.integrity_cases(spark, SF).select("kind", "severity").distinct().collect()}
    assert got <= {(k, v) for k, levels in serving.CASE_LEVELS.items() for v in levels}


def test_marks_stand_in_all_that_patterns_match(spark):
    texts = ["3 day or 4 weeks", "1 month $5 x", "2 years 7 %", "no 5 dollars", "", None, "Alpha is defined as x. Beta means y. 5 days"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string")
    found = sorted((r["chunk_id"], r["raw_match"], r["context_key"]) for r in facts.numeric_facts(rows).collect())
    assert [f[:2] for f in found] == [(0, "3 day"), (0, "4 weeks"), (1, "$5"), (1, "1 month"), (2, "2 years"), (2, "7 %"), (6, "5 days")]
    assert len(fixed.UNIT_MARKS) == len(fixed.UNIT_PATTERNS) and len(fixed.DEFINITION_MARKS) == len(fixed.DEFINITION_PATTERNS)
    assert [r["term"] for r in facts.definitions(rows).orderBy("term").collect()] == ["Alpha", "Beta"]


def test_numbered_chunks_are_joined_by_counts(spark):
    plan = adapters.real_chunks(adapters.documents(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan[: plan.index("Join")] and "broadcast" in plan
    assert adapters.real_chunks(adapters.documents(spark, SF)).agg(F.max("chunk_id") - F.count("*")).first()[0] == 0
