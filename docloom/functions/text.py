"""Text operators as Spark columns: no Python runs on the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.fixed import CHUNK_TOKENS, OVERLAP, STOPWORDS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once.

    A lambda's body is evaluated anew for every element, with all that it
    names; an array expression that it indexes would make it quadratic.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_even(value: Column, digits: int) -> Column:
    """A double rounded to ``digits`` decimals by its exact binary value, exact ties to the even digit."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")


def approx_tokens(text: Column | str) -> Column:
    """Number of runs of non-blanks."""
    return F.size(F.filter(F.split(_col(text), r"\s+"), lambda x: x != ""))


def clean_line(line: Column) -> Column:
    """A line without heading marks, outer blanks and bold marks."""
    return F.replace(F.regexp_replace(F.regexp_replace(line, r"^#{1,6}\s*", ""), r"^\s+|\s+$", ""), F.lit("**"), F.lit(""))


def split_sentences(text: Column | str) -> Column:
    """Sentences line by line, trimmed, without blank ones."""
    lines = F.split(_col(text), "\\R|[\x1c-\x1e]")
    parts = F.flatten(F.transform(lines, lambda x: F.split(clean_line(x), r"(?<=[.!?])\s+(?=[A-Z#*])")))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def pack_chunks(sentences: Column, max_tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP) -> Column:
    """Greedy chunks of sentences; each starts with the last ``overlap`` sentences of the one before (T4).

    A chunk is closed when the next sentence would take it over the budget.
    The overlap counts, but isn't tested again, so a chunk may exceed it.
    """

    def tokens(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda n, x: n + approx_tokens(x))

    def step(acc: Column, s: Column) -> Column:
        n = approx_tokens(s)
        full = (F.size(acc["cur"]) > 0) & (acc["n"] + n > max_tokens)
        size = F.size(acc["cur"])
        kept = F.slice(acc["cur"], F.greatest(size - (overlap - 1), F.lit(1)), overlap) if overlap else _strings(())
        return F.when(
            full,
            F.struct(
                F.concat(acc["out"], F.array(F.array_join(acc["cur"], " "))).alias("out"),
                F.concat(kept, F.array(s)).alias("cur"),
                (tokens(kept) + n).alias("n"),
            ),
        ).otherwise(F.struct(acc["out"], F.concat(acc["cur"], F.array(s)).alias("cur"), (acc["n"] + n).alias("n")))

    start = F.struct(_strings(()).alias("out"), _strings(()).alias("cur"), F.lit(0).alias("n"))
    return F.aggregate(
        sentences,
        start,
        step,
        lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["out"]),
    )


def chunk_texts(body: Column | str, max_tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP) -> Column:
    """Chunk texts of a body; none if it has no sentence."""
    return pack_chunks(split_sentences(body), max_tokens, overlap)


def tokenize(text: Column | str, stop_words: Sequence[str] = STOPWORDS) -> Column:
    """Lower-case ASCII words and numbers without stop words."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(*stop_words)) if stop_words else found


def ngram_terms(text: Column | str, stop_words: Sequence[str]) -> Column:
    """Words of two letters or more without stop words, then pairs of what is left."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    kept = F.filter(found, lambda x: ~x.isin(*stop_words)) if stop_words else found

    def with_pairs(words: Column) -> Column:
        first = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
        return F.concat(words, F.transform(first, lambda x, i: F.concat_ws(" ", x, F.get(words, i + 1))))

    return let(kept, with_pairs)


def term_counts(terms: Column) -> Column:
    """Distinct values of an array as structs of ``term`` and ``tf``, how often it stands there; no row is shuffled."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.zip_with(at, ends(s, at), lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).alias("tf"))))

    def ends(s: Column, at: Column) -> Column:
        return F.slice(F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(s))), 1, F.size(at))

    return let(F.sort_array(terms), runs)


def normalize_blanks(text: Column | str) -> Column:
    """Runs of blanks to one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def matched_terms(query: Column | str, text: Column | str, limit: int = 6) -> Column:
    """The query's distinct terms that occur in the text, in query order."""
    return F.slice(F.array_intersect(tokenize(query), tokenize(text)), 1, limit)


def highlight(text: Column | str, query: str, left: str = "«", right: str = "»", limit: int = 6) -> Column:
    """Marks the query's first words of three letters or more, in either case."""
    terms = [t for t in query.split() if len(t) > 2][:limit]
    if not terms:
        return _col(text)
    pattern = "|".join(r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in terms)
    return F.regexp_replace(_col(text), f"(?i)({pattern})", f"{left}$1{right}")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))


def jaccard_words(a: Column, b: Column) -> Column:
    """Shared over all words of two texts; 0 if one has none (U4)."""
    return jaccard_sets(word_set(a), word_set(b))


def jaccard_sets(x: Column, y: Column) -> Column:
    """Shared over all of two arrays of distinct words; 0 if one has none."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    )


def split_tags(tags: Column | str) -> Column:
    """Distinct lower-case tags of a comma-separated list."""
    parts = F.transform(F.split(F.coalesce(_col(tags), F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))
