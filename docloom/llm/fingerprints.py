"""Homomorphic document fingerprints, with Spark expressions only.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed
to a wide vector and the vectors are summed, lane by lane, modulo powers of
two, so a fingerprint doesn't depend on the order of paragraphs, and inserting
or deleting one adds or subtracts its vector alone. A vector has two parts:

* ``EXACT`` lanes modulo 2^32, hashed from the whole paragraph: two documents
  have equal lanes if, and but for hash collisions only if, their paragraphs
  are equal as multisets;
* ``LANES`` lanes modulo 2^32, each counting the paragraph's word triples whose
  hash has the bit of that lane set. Less half the number of triples they are
  random projections of the triples' counts, so the cosine of two documents'
  lanes estimates how alike their texts are. Over 64 lanes the estimate has a
  standard deviation of (1 - c^2) / 8 about a true cosine c, whatever the
  texts' length: 0.07 at two thirds, and 0.125 for unrelated texts, of which
  one in twenty seems to have 0.21 or more.

Lanes are held two to a long, in 32 bits each, and added and subtracted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import let

EXACT, LANES, MASK = 16, 64, 0xFFFFFFFF
#: Both bits that a shift brings to the lowest places of a long's halves.
PAIR = (1 << 32) | 1
#: The lowest bit of each byte of a long.
BYTES = 0x0101010101010101
SPACE = r"[\x20\x09-\x0D]+"


def _and(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit(bits))


def paragraphs(text: Column) -> Column:
    """Lines, each with its end kept apart; the empty text has none."""
    return F.when(F.length(text) > 0, F.split(text, "\n")).otherwise(F.expr("cast(array() as array<string>)"))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, SPACE), lambda w: w != "")


def _triples(words: Column) -> Column:
    """Hashes of all word triples, or of the whole of fewer words.

    ``words`` must be a column or a lambda's variable: an expression here would
    be worked out anew for every triple.
    """
    n = F.size(words)
    three = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(1))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(n > 0, three).otherwise(F.expr("cast(array() as array<bigint>)"))


def _zeros(n: int) -> Column:
    return F.struct(*(F.lit(0).cast("long").alias(f"v{k}") for k in range(n)))


def _hex(lane: Column) -> Column:
    return F.lpad(F.lower(F.hex(lane)), 8, "0")


def fingerprint_columns(text: Column) -> Column:
    """A struct of ``exact`` and ``lanes`` (arrays of longs) and ``triples``.

    ``exact`` has ``EXACT`` lanes, ``lanes`` has ``LANES`` pairwise packed
    counts in ``LANES / 2`` longs, ``triples`` is how many were counted.
    """

    def whole(acc: Column, line: Column) -> Column:
        hashes = [F.xxhash64(F.lit(seed), line) for seed in range(EXACT // 2)]
        halves = [h for x in hashes for h in (_and(x, MASK), F.shiftrightunsigned(x, 32))]
        return F.struct(*(_and(acc[f"v{k}"] + h, MASK).alias(f"v{k}") for k, h in enumerate(halves)))

    # Up to 127 hashes are counted in bytes, eight bits of them to a long, before the 32-bit lanes are added to.
    def spread(acc: Column) -> Column:
        wide = (F.get(acc["big"], F.lit(k)) + _and(F.shiftrightunsigned(acc[f"s{k % 8}"], 8 * (k // 8)), 255 * PAIR) for k in range(LANES // 2))
        return F.array(*wide)

    def counted(acc: Column, h: Column) -> Column:
        bits = [_and(F.shiftrightunsigned(h, k), BYTES) for k in range(8)]
        begun = F.struct(F.lit(1).alias("n"), *(b.alias(f"s{k}") for k, b in enumerate(bits)), spread(acc).alias("big"))
        grown = F.struct((acc["n"] + 1).alias("n"), *((acc[f"s{k}"] + b).alias(f"s{k}") for k, b in enumerate(bits)), acc["big"].alias("big"))
        return F.when(acc["n"] == 127, begun).otherwise(grown)

    empty = F.struct(
        F.lit(0).alias("n"),
        *(F.lit(0).cast("long").alias(f"s{k}") for k in range(8)),
        F.array_repeat(F.lit(0).cast("long"), LANES // 2).alias("big"),
    )
    as_array = lambda n: lambda acc: F.array(*(acc[f"v{k}"] for k in range(n)))


    def both(lines: Column) -> Column:
        return let(
            F.flatten(F.transform(F.transform(lines, _words), _triples)),
            lambda triples: F.struct(
                F.aggregate(lines, _zeros(EXACT), whole, as_array(EXACT)).alias("exact"),
                F.aggregate(triples, empty, counted, spread).alias("lanes"),
                F.size(triples).cast("long").alias("triples"),
            ),
        )

    return let(paragraphs(F.coalesce(text, F.lit(""))), both)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both documents' paragraphs (``sign`` -1: of a's without b's).

    All lanes are taken modulo 2^32, so subtracting undoes adding whatever the
    two documents are.
    """

    def packed(x: Column, y: Column) -> Column:
        low = _and(_and(x, MASK) + sign * _and(y, MASK), MASK)
        high = _and(F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32), MASK)
        return low.bitwiseOR(F.shiftleft(high, 32))

    exact = F.zip_with(a["exact"], b["exact"], lambda x, y: _and(x + sign * y, MASK))
    lanes = F.zip_with(a["lanes"], b["lanes"], packed)
    return F.struct(exact.alias("exact"), lanes.alias("lanes"), (a["triples"] + sign * b["triples"]).alias("triples"))


def fingerprint_text(fp: Column) -> Column:
    """All lanes in hex: the exact ones, then the counts."""
    counts = F.flatten(
        F.transform(fp["lanes"], lambda x: F.array(_and(x, MASK), F.shiftrightunsigned(x, 32)))
    )
    return F.array_join(F.transform(F.concat(fp["exact"], counts), _hex), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the centred lanes, 1 for equal fingerprints.

    Documents without triples have no direction: 1 if all lanes are equal, else 0.
    """

    def centred(fp: Column) -> Column:
        half = fp["triples"].cast("double") / 2
        both = lambda x: F.array(_and(x, MASK) - half, F.shiftrightunsigned(x, 32) - half)
        return F.flatten(F.transform(fp["lanes"], both))

    pairs = F.arrays_zip(centred(a).alias("x"), centred(b).alias("y"))
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("xy", "xx", "yy")))
    return F.when((a["exact"] == b["exact"]) & (a["lanes"] == b["lanes"]), F.lit(1.0)).otherwise(
        F.aggregate(
            pairs,
            zero,
            lambda s, p: F.struct(
                (s["xy"] + p["x"] * p["y"]).alias("xy"),
                (s["xx"] + p["x"] * p["x"]).alias("xx"),
                (s["yy"] + p["y"] * p["y"]).alias("yy"),
            ),
            lambda s: F.when(
                (s["xx"] > 0) & (s["yy"] > 0),
                F.least(F.lit(1.0), F.greatest(F.lit(0.0), s["xy"] / F.sqrt(s["xx"]) / F.sqrt(s["yy"]))),
            ).otherwise(F.lit(0.0)),
        )
    )


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fp`` (see :func:`fingerprint_columns`) and ``fingerprint`` (its hex).

    Null texts count as empty; an empty text has no paragraphs and all lanes 0.
    Every row is kept, repeated ones too. Columns of these names are replaced.
    """
    return docs.withColumn("fp", fingerprint_columns(F.col(text))).withColumn("fingerprint", fingerprint_text(F.col("fp")))


def place_rows(rows: DataFrame, key: str, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Add ``r``, the number of a row's range of keys (0 for a null); also (key, r) alone."""
    keys = rows.select(key)
    quantiles = F.percentile_approx(key, [i / ranges for i in range(1, ranges)] or [0.5], F.lit(10 * ranges))
    cuts = sorted(set(keys.agg(quantiles).first()[0] or []))
    literal = F.expr(f"array({','.join(f"bigint('{c}')" for c in cuts)})")
    number = F.size(F.filter(literal, lambda c: c < F.col(key))) if cuts else F.lit(0)
    place = F.when(F.col(key).isNull(), F.lit(0)).otherwise(number).cast("int")
    return rows.withColumn("r", place), keys.withColumn("r", place)


def with_next(docs: DataFrame, key: str, text: str, carried: list[str] = (), ranges: int | None = None) -> DataFrame:
    """Add ``next``, a struct of ``text`` and ``carried`` of the row after, by descending key.

    After the last row comes the first. Null keys are last; rows of one key are
    in order of their texts, and share a window, as do null keys. Keys are cut
    into ranges of about equal row counts at quantiles, so ids may be dense,
    sparse, clustered or at the ends of their type. Each range is one window,
    and the first row of a range is copied to the end of the one before it:
    each text is shuffled once. The driver sees a few numbers a range. Other
    columns than key, text and carried ones are dropped.
    """
    spark = docs.sparkSession
    names = [text, *carried]
    rows = docs.select(F.col(key).cast("long").alias("k"), F.struct(*names).alias("v"))
    rows, ids = place_rows(rows, "k", ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = sorted(tuple(r) for r in ids.groupBy("r").agg(F.max("k").alias("top")).collect())
    used = [r for r, _ in found]
    above = dict(zip(used, used[1:] + used[:1], strict=True))
    tops, last = dict(found), max(used, default=0)

    def listed(of: dict, kind: str) -> Column:
        values = ("null" if of.get(r) is None else f"bigint('{of[r]}')" for r in range(last + 1))
        return F.expr(f"cast(array({','.join(values)}) as array<{kind}>)")

    # A range's first row stands once more after the last row of the range above; the very first one after all.
    is_first = F.col("k").eqNullSafe(F.get(listed(tops, "bigint"), F.col("r")))
    places = F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("tail")))
    twice = F.concat(places, F.array(F.struct(F.get(listed(above, "int"), F.col("r")).alias("r"), F.lit(True).alias("tail"))))
    placed = rows.select("k", "v", F.explode(F.when(is_first, twice).otherwise(places)).alias("p")).select("k", "v", "p.*")
    order = Window.partitionBy("r").orderBy("tail", F.col("k").desc_nulls_last(), F.col(f"v.{text}"))
    return (
        placed.withColumn("next", F.lead("v").over(order)).where("NOT tail").select(F.col("k").alias(key), "v.*", "next")
    )


def op6_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and the next document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("fp", fingerprint_columns(F.col("text"))), "doc_id", "text", ["fp"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.alias("n"), "fp", F.col("next.fp").alias("next_fp"), edited.alias("edited"))
    rows = rows.withColumn("edited_fp", fingerprint_columns(F.col("edited")))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("fp")).alias("fingerprint"),
        fingerprint_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
