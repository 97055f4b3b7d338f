"""Row-wise Python over Arrow batches, keeping the columns that came in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Rows that are Python values at a time; Arrow batches may have many more.
ROWS = 1024


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows."""
    for batch in batches:
        for i in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(i, rows)


def add_columns(
    df: DataFrame, needs: list[str], added: dict[str, tuple[T.DataType, pa.DataType]], fn: Callable[..., list[list]]
) -> DataFrame:
    """Add columns that ``fn`` makes from the lists of values in ``needs``.

    ``fn`` gets one list per needed column and returns one list per added
    column. It is a narrow step: no shuffle, ``ROWS`` rows of a batch as Python
    values at a time.
    Columns of ``df`` with the names of added ones are replaced.
    """
    df = df.drop(*(c for c in added if c not in needs))
    names = [c for c in df.columns if c not in added]
    fields = [f for f in df.schema.fields if f.name in names]
    schema = T.StructType([*fields, *(T.StructField(n, t[0]) for n, t in added.items())])
    kinds = [t[1] for t in added.values()]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = {n: i for i, n in enumerate(batch.schema.names)}
            parts: list[list[pa.Array]] = [[] for _ in kinds]
            for part in slices([batch]):
                got = fn(*(part.column(where[n]).to_pylist() for n in needs))
                for column, g, k in zip(parts, got, kinds, strict=True):
                    column.append(pa.array(g, k))
            arrays = [batch.column(where[n]) for n in names] + [pa.concat_arrays(c) for c in parts]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *added])

    return df.mapInArrow(step, schema)
