"""Statements found in text: numeric facts, definitions, teams, projects, concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions.text import let


def _matches(text: Column, pattern: str, *groups: int) -> Column:
    """Array of structs with a field for each of ``groups``, g0 for whole matches, in order."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]
    return F.arrays_zip(*found)


def numeric_facts(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row per number with a unit, with value, unit, context_key, raw_match, unit_no and match_no.

    The context is the last few words before the number, over sentence ends,
    without common ones. Numbers are found per unit over the lower-case text;
    thousands lose their commas. Rows without numbers vanish.

    A number begins and ends where no word does, so the words before it are
    those of the pieces between numbers and of the numbers' own units. Of each
    piece only the last ``CONTEXT_WORDS`` are kept and carried to the next. Texts
    without a unit's mark aren't matched, nor are the words behind the last number cut.
    """
    low = chunks.withColumn("__low", F.lower(text))
    size = fixed.CONTEXT_WORDS
    no_words = F.expr("cast(array() as array<string>)")
    none = F.expr("cast(array() as array<struct<value:bigint,unit:string,context_key:string,raw_match:string,unit_no:int,match_no:int>>)")

    def last(words: Column) -> Column:
        return F.slice(words, F.greatest(F.size(words) - (size - 1), F.lit(1)), size)

    def tail(piece: Column) -> Column:
        words = F.regexp_extract_all(piece, F.lit("[a-z]+"), F.lit(0))
        return let(F.filter(words, lambda x: ~x.isin(*fixed.CONTEXT_STOPWORDS)), last)

    def carried(tails: Column) -> Column:
        step = lambda acc, t: let(
            last(F.concat(acc["now"], t)),
            lambda now: F.struct(now.alias("now"), F.concat(acc["out"], F.array(F.array_join(now, " "))).alias("out")),
        )
        return F.aggregate(tails, F.struct(no_words.alias("now"), no_words.alias("out")), step)["out"]

    def of_unit(no: int, unit: str, pattern: str) -> Column:
        def of_found(found: Column) -> Column:
            n = F.size(found)
            before = F.slice(F.concat(F.array(F.lit("")), F.transform(found, lambda m: m["g0"])), 1, n)
            pieces = F.zip_with(before, F.slice(F.split("__low", pattern), 1, n), lambda m, p: F.concat(F.coalesce(m, F.lit("")), F.coalesce(p, F.lit(""))))
            made = let(carried(F.transform(pieces, tail)), lambda contexts: F.transform(found, lambda m, i: fact(contexts, m, i)))
            return F.when(n > 0, made).otherwise(none)

        def fact(contexts: Column, m: Column, i: Column) -> Column:
            return F.struct(
                F.regexp_replace(m["g1"], ",", "").cast("bigint").alias("value"),
                F.lit(unit).alias("unit"),
                F.concat(F.lit(f"{unit}::"), F.get(contexts, i)).alias("context_key"),
                m["g0"].alias("raw_match"),
                F.lit(no).alias("unit_no"),
                i.alias("match_no"),
            )

        marked = F.contains("__low", F.lit(fixed.UNIT_MARKS[no]))
        return F.when(marked, let(_matches(F.col("__low"), pattern, 0, 1), of_found)).otherwise(none)

    units = [of_unit(no, unit, pattern) for no, (unit, pattern) in enumerate(fixed.UNIT_PATTERNS)]
    return low.withColumn("__f", F.explode(F.concat(*units))).select(*chunks.columns, "__f.*")


def definitions(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row per definition sentence: term, definition_text, pattern_no and match_no."""

    def of_pattern(no: int, pattern: str) -> Column:
        def definition(m: Column, i: Column) -> Column:
            return F.struct(
                F.trim(m["g1"]).alias("term"),
                F.regexp_replace(m["g2"], r"^\s+|\s+$", "").alias("definition_text"),
                F.lit(no).alias("pattern_no"),
                i.alias("match_no"),
            )

        marked = F.contains(text, F.lit(fixed.DEFINITION_MARKS[no]))
        return F.when(marked, F.transform(_matches(F.col(text), "(?U)" + pattern, 1, 2), definition)).otherwise(none)

    none = F.expr("cast(array() as array<struct<term:string,definition_text:string,pattern_no:int,match_no:int>>)")

    each = [of_pattern(no, p) for no, p in enumerate(fixed.DEFINITION_PATTERNS)]
    return chunks.withColumn("__d", F.explode(F.concat(*each))).select(*chunks.columns, "__d.*")


def team_mentions(text: Column) -> Column:
    """Distinct team names with an ownership statement, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + fixed.TEAM_PATTERN), F.lit(1))))


def project_names(title: Column) -> Column:
    """``Project X`` names in a title, each as often as it stands there."""
    return F.transform(
        F.regexp_extract_all(title, F.lit("(?U)" + fixed.PROJECT_PATTERN), F.lit(1)), lambda x: F.concat(F.lit("Project "), x)
    )


def concept_terms(text: Column) -> Column:
    """Distinct heads of definition sentences, sorted."""
    found = [F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(1)) for p in fixed.CONCEPT_PATTERNS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def is_team(author: Column) -> Column:
    """Whether an author is a team rather than a person."""
    return F.endswith(F.trim(author), F.lit("Team"))
