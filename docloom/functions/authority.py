"""Authority levels, severity and the sentences that explain results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions.text import half_even, matched_terms


def _case(key: Column, table: dict, default: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default)


def authority_label(level: Column) -> Column:
    """Name of a level; ``Level n`` of an unknown one."""
    return _case(level, {k: v[0] for k, v in fixed.AUTHORITY.items()}, F.concat(F.lit("Level "), level.cast("string")))


def authority_description(level: Column) -> Column:
    return _case(level, {k: v[1] for k, v in fixed.AUTHORITY.items()}, F.lit(fixed.UNKNOWN_AUTHORITY))


def higher_authority(a: Column, b: Column) -> Column:
    """The stronger of two levels: the smaller number."""
    return F.least(a, b)


def severity(context: Column, department_a: Column, department_b: Column) -> Column:
    """high, medium or low by words in context and departments."""
    text = F.lower(F.concat(context, F.lit(" "), department_a, F.lit(" "), department_b))
    return (
        F.when(text.rlike("|".join(fixed.SEVERITY_HIGH)), "high")
        .when(text.rlike("|".join(fixed.SEVERITY_MEDIUM)), "medium")
        .otherwise("low")
    )


def outdated_reason(current: Column, current_version: Column, outdated: Column, outdated_version: Column) -> Column:
    return F.format_string(fixed.SUPERSEDES, current, current_version, outdated, outdated_version)


def resolution_reason(resolved: Column, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Why a conflict was resolved as it was.

    ``a`` and ``b`` have the columns doc_key, authority_level and
    effective_date of either side.
    """
    first = a["doc_key"] == resolved
    won = {k: F.when(first, a[k]).otherwise(b[k]) for k in a}
    lost = {k: F.when(first, b[k]).otherwise(a[k]) for k in a}
    outranks = F.format_string(
        fixed.OUTRANKS,
        won["doc_key"],
        authority_label(won["authority_level"]),
        won["authority_level"],
        lost["doc_key"],
        authority_label(lost["authority_level"]),
        lost["authority_level"],
    )
    note = F.format_string(
        fixed.NEWER,
        lost["doc_key"],
        lost["effective_date"].cast("string"),
        won["effective_date"].cast("string"),
    )
    newer = F.coalesce(lost["effective_date"] > won["effective_date"], F.lit(False))
    return F.when(resolved.isNull(), F.lit(fixed.UNRESOLVED)).otherwise(
        F.concat(outranks, F.when(newer, note).otherwise(F.lit("")))
    )


def ranking_explanation(method: str, query: Column | str, text: Column | str) -> Column:
    """Why a result stands where it does."""
    base = fixed.EXPLANATIONS.get(method, fixed.UNEXPLAINED)
    if method == "dense":
        return F.lit(base)
    terms = matched_terms(query, text)
    return F.when(
        F.size(terms) > 0, F.concat(F.lit(base + fixed.MATCHED), F.array_join(terms, ", "), F.lit("."))
    ).otherwise(F.lit(base + fixed.NO_OVERLAP))


def relative_confidence(score: Column, top: Column) -> Column:
    """A score as a percentage of the best one of its results, one decimal."""
    return F.when(top <= 0, F.lit(0.0)).otherwise(
        half_even(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score / top * 100)), 1)
    )
