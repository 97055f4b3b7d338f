"""Document files: Markdown with front matter, read by Spark and parsed with column expressions."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.fixed import DEFAULT_AUTHORITY
from docloom.plans.tables import materialize

FIELDS = (
    "doc_key", "title", "department", "doc_type", "version", "created_date", "effective_date", "updated_date",
    "author", "owner", "authority_level", "status", "supersedes_doc_key", "tags",
)
REQUIRED = ("doc_key", "title", "department", "doc_type")


def parse_date(value: Column) -> Column:
    """A date of ISO text; null for null, empty and the word null; other text is an error."""
    return F.to_date(F.nullif(F.nullif(value, F.lit("")), F.lit("null")), "yyyy-MM-dd")


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(path, content) of all files below ``folder`` with the pattern, in no order.

    Names that begin with a dot or an underscore are hidden, and files without
    a byte have no row. Tasks list the
    folders, a level at a time, and read the files; the driver holds no list of
    them, however many there are. Paths are URIs, as Spark gives them.
    """
    if spark.createDataFrame([(folder,)], "path string").mapInArrow(_exists, "n bigint").first() is None:
        raise FileNotFoundError(folder)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    level, files = spark.createDataFrame([(folder,)], "path string"), None
    while True:
        found = materialize(level.mapInArrow(_listed(pattern), "path string, is_file boolean"), "listed")
        here = found.where("is_file").select("path")
        files = here if files is None else files.unionByName(here)
        level = found.where("NOT is_file").select("path")
        if not level.limit(1).count():
            break
        level = level.repartition(tasks)
    return files.repartition(tasks).mapInArrow(_contents, "path string, content string")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _exists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            fs, root = _opened(folder)
            if fs.get_file_info(root).type != pafs.FileType.NotFound:
                yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})


def _listed(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Files with the pattern, and folders, of each folder given."""
    schema = pa.schema([("path", pa.string()), ("is_file", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                fs, root = _opened(folder)
                top = folder.rstrip("/")
                rows = []
                if isinstance(fs, pafs.LocalFileSystem):
                    with os.scandir(root) as entries:
                        names = ((e.name, e.is_file(), e.is_dir()) for e in entries)
                        yield from _kept(names, top, pattern, rows, schema)
                else:
                    infos = fs.get_file_info(pafs.FileSelector(root))
                    yield from _kept(((i.base_name, i.is_file, i.type == pafs.FileType.Directory) for i in infos), top, pattern, rows, schema)

    return scan


#: Names that a task holds before it hands them on.
LISTED = 10_000


def _kept(names: Iterator[tuple[str, bool, bool]], top: str, pattern: str, rows: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for name, is_file, is_dir in names:
        if not name.startswith((".", "_")) and (is_dir or is_file and fnmatchcase(name, pattern)):
            rows.append((f"{top}/{name}", is_file))
        if len(rows) >= LISTED:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=schema)
            rows.clear()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=schema)


#: Bytes of texts that a task holds before it hands them on.
HELD_TEXT = 4 << 20


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for path in batch.column(0).to_pylist():
            fs, at = _opened(path)
            with fs.open_input_stream(at, compression=None) as file:
                content = file.read()
            if not content:
                continue
            # What isn't UTF-8 is replaced, as Spark's reader of texts does.
            rows.append((_uri(path), content.decode("utf-8", "replace")))
            held += len(content)
            if held >= HELD_TEXT:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "content"])
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "content"])


def _uri(path: str) -> str:
    """A path as Spark writes it: local ones with one slash, characters that a URI can't hold escaped."""
    head, rest = "file:", "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path and not path.startswith("file:"):
        scheme, _, rest = path.partition("://")
        head = f"{scheme}://"
    return head + "".join(c if c.isalnum() or c in "/-_.!~*'(),;:$&+=@" or ord(c) > 127 else quote(c) for c in rest)


def parse_front_matter(files: DataFrame) -> DataFrame:
    """One row per file: its fields, raw_text, source_path and ``error``, null if all is well.

    The first line, trimmed, must be ``---``, and a later line exactly ``---``.
    Values are flat ``key: value`` lines; quotes around a value go. Missing
    versions become 1.0, authority 3, status current; ``supersedes`` that is
    null or the word null means none. Empty required fields are errors.
    """
    lines = F.split("content", "\n")
    rest = F.slice(lines, 2, 1 << 30)
    close = F.array_position(rest, "---")
    opened = F.trim(F.get(lines, F.lit(0))) == "---"
    head = F.slice(rest, 1, F.greatest(close.cast("int") - 1, F.lit(0)))
    pairs = F.transform(
        F.filter(head, lambda x: F.contains(x, F.lit(":")) & ~F.startswith(F.trim(x), F.lit("#"))),
        lambda x: F.struct(
            F.trim(F.split(x, ":", 2)[0]).alias("k"),
            F.regexp_replace(F.trim(F.get(F.split(x, ":", 2), F.lit(1))), r"""^(["'])(.*)\1$""", "$2").alias("v"),
        ),
    )
    # Of repeated keys the last one counts, which a map keeps if the pairs come last first.
    unique = F.aggregate(
        F.reverse(pairs),
        F.expr("cast(array() as array<struct<k:string,v:string>>)"),
        lambda acc, p: F.when(F.exists(acc, lambda q: q["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))),
    )
    rows = files.select(
        "path",
        "content",
        opened.alias("opened"),
        close.alias("close"),
        F.array_join(F.slice(rest, close.cast("int") + 1, 1 << 30), "\n").alias("raw_text"),
        F.map_from_entries(unique).alias("m"),
    )
    value = lambda k: F.nullif(F.nullif(F.col("m")[k], F.lit("null")), F.lit("~"))
    missing = [F.when(F.coalesce(value(k), F.lit("")) == "", F.lit(k)) for k in REQUIRED]
    error = (
        F.when(~F.coalesce("opened", F.lit(False)), F.lit("no front matter"))
        .when(F.col("close") == 0, F.lit("front matter isn't closed"))
        .when(F.size(F.array_compact(F.array(*missing))) > 0, F.concat(F.lit("missing: "), F.concat_ws(", ", *missing)))
    )
    fine = error.isNull()
    date = lambda k: F.when(fine, parse_date(value(k)))
    return rows.select(
        *(value(k).alias(k) for k in REQUIRED),
        F.coalesce(value("version"), F.lit("1.0")).alias("version"),
        *(date(k).alias(k) for k in ("created_date", "effective_date", "updated_date")),
        value("author").alias("author"),
        value("owner").alias("owner"),
        F.coalesce(F.when(fine, value("authority_level").cast("int")), F.lit(DEFAULT_AUTHORITY)).alias("authority_level"),
        F.coalesce(value("status"), F.lit("current")).alias("status"),
        F.nullif(value("supersedes"), F.lit("")).alias("supersedes_doc_key"),
        value("tags").alias("tags"),
        F.when(fine, F.col("raw_text")).alias("raw_text"),
        F.col("path").alias("source_path"),
        error.alias("error"),
    )


#: Parsers by file ending; each takes and gives what :func:`parse_front_matter` does (S3).
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"md": parse_front_matter}


def parse_documents(files: DataFrame) -> DataFrame:
    """Files parsed by their endings; rows of unknown endings carry an error."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    tagged = files.withColumn("__end", ending)
    out = None
    for name, parser in PARSERS.items():
        part = parser(tagged.where(F.col("__end") == name).drop("__end"))
        out = part if out is None else out.unionByName(part)
    other = tagged.where(~F.col("__end").isin(*PARSERS))
    unknown = parse_front_matter(other.select("path", F.lit("").alias("content")))
    return out.unionByName(unknown.withColumn("error", F.lit("unsupported format")))
