"""Small helpers shared by the operators: column names, Arrow batches, written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from runloom.session import scratch_dir

# Rows that Python works on at a time; an Arrow batch is cut into such pieces.
ROWS_AT_ONCE = 500


def fresh(df: DataFrame, name: str, also: Sequence[str] = ()) -> str:
    """``name``, with underscores until no column of ``df`` or ``also`` has it in any case."""
    taken = {c.lower() for c in (*df.columns, *also)}
    while name.lower() in taken:
        name += "_"
    return name


def name_column(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_column(name: str = "text") -> Column:
    """The whole text; a null is an empty text."""
    return F.coalesce(name_column(name).cast("string"), F.lit(""))


def whole_texts(texts: Sequence[str | None]) -> list[str]:
    """The texts of a batch; a null is an empty text."""
    return [t or "" for t in texts]


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def with_computed(df: DataFrame, inputs: Sequence[str], fields: Sequence[T.StructField],
                  start: Callable[[], Callable]) -> DataFrame:
    """``df`` plus columns that Python computes from the ``inputs``, some rows at a time.

    ``start`` runs once in a task and returns a function from lists of input values to the values of
    each new field, a list or an Arrow array. Columns that are no inputs pass as they are.
    """
    schema = T.StructType([*df.schema.fields, *fields])
    names = [f.name for f in schema.fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    places = [df.columns.index(c) for c in inputs]

    def run(found):
        work = start()
        for batch in found:
            piece = new = columns = None
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(at, ROWS_AT_ONCE)
                new = work(*[piece.column(i).to_pylist() for i in places])
                columns = [_array(values, kind) for values, kind in zip(new, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *columns], names=names)
            # Batches of very different sizes would otherwise leave the worker as large as the sum.
            del batch, piece, new, columns
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def flat_computed(df: DataFrame, fields: Sequence[T.StructField],
                  start: Callable[[], Callable]) -> DataFrame:
    """Any number of rows for some input rows at a time; ``start`` as in ``with_computed``."""
    schema = T.StructType(list(fields))
    names = [f.name for f in fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(found):
        work = start()
        for batch in found:
            piece = new = None
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(at, ROWS_AT_ONCE)
                new = work(*[c.to_pylist() for c in piece.columns])
                yield pa.RecordBatch.from_arrays(
                    [_array(values, kind) for values, kind in zip(new, kinds, strict=True)],
                    names=names)
            del batch, piece, new
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below the shared folder: computed once, and it outlives its executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
