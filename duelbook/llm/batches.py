"""Arrow batches in Python workers: the input's columns pass through, computed columns are added."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Rows of a text column handled at once; a long text is a piece of its own.
ROWS, BYTES = 1000, 4 << 20


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ROWS rows, and at most about BYTES of text unless one text is longer."""
    lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()))
    sizes = pc.fill_null(lengths, 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > BYTES or i - start >= ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drops the input columns whose names an operator's results take (names differ by more than case)."""
    taken = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def give_back() -> None:
    """Returns freed memory to the system: a worker process lives on after its task, beside the executor's next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def add_columns(df: DataFrame, text: str, fields: list[StructField], start: Callable[[], Callable[[list[bytes]], list[list]]]) -> DataFrame:
    """Adds ``fields``; ``start()`` runs once in a task and gives a function from texts to one list for each field.

    Input columns of the same names are replaced.
    """
    source = without(df, [f.name for f in fields if f.name != text])
    kept = [f for f in source.schema.fields if f.name not in {x.name for x in fields}]
    schema = StructType(kept + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for piece in pieces(batch, text):
                found = work(texts_of(piece.column(piece.schema.get_field_index(text))))
                columns = [piece.column(piece.schema.get_field_index(n)) for n in names]
                columns += [pa.array(v, kind) for v, kind in zip(found, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        del work
        give_back()

    return source.mapInArrow(run, schema)
