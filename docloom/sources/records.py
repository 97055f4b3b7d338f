"""JSON sources and sinks, and table resets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()


def _fields(**kinds) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


#: Schemas of the ground-truth files: the array's name and its rows.
GROUND_TRUTH = {
    "queries": ("queries", _fields(query_id=_S, query_text=_S, category=_S, relevant_docs=T.ArrayType(_S), notes=_S)),
    "duplicates": ("cases", _fields(case_id=_S, doc_a=_S, snippet_a=_S, doc_b=_S, snippet_b=_S, expected_similarity_min=T.DoubleType(), notes=_S)),
    "contradictions": (
        "cases",
        _fields(
            case_id=_S, concept=_S, doc_a=_S, value_a=_S, snippet_a=_S, doc_b=_S, value_b=_S, snippet_b=_S, severity=_S, resolved_doc_key=_S, resolution_reason=_S
        ),
    ),
    "outdated": ("cases", _fields(case_id=_S, concept=_S, outdated_doc=_S, current_doc=_S, changed_fact=_S)),
    "definitions": (
        "cases",
        _fields(
            case_id=_S, term=_S, doc_a=_S, definition_a=_S, department_a=_S, doc_b=_S, definition_b=_S, department_b=_S, severity=_S, resolution_reason=_S
        ),
    ),
}


def read_ground_truth(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of one ground-truth file."""
    array, kind = GROUND_TRUTH[name]
    schema = T.StructType([T.StructField(array, kind)])
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{name}.json").select(F.explode(array).alias("r")).select("r.*")


def read_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Distinct words of a file, one a line, in lower case and order: a list of stop words to pass to an operator."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct().orderBy("w")
    return tuple(r["w"] for r in lines.collect())


def write_json(df: DataFrame, folder: str) -> None:
    """Rows as JSON lines, replacing what is there."""
    df.write.mode("overwrite").json(folder)


def write_table(df: DataFrame, folder: str, reset: bool = False) -> None:
    """Append rows to a Parquet table, or replace it."""
    df.write.mode("overwrite" if reset else "append").parquet(folder)


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """A Parquet table; raises FileNotFoundError with what to run if it isn't there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        raise FileNotFoundError(f"{folder} has not been built; run the ingest and index steps first") from e
