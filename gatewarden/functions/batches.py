"""Arrow UDFs that work through a batch in small pieces, so that a worker holds one batch as it came and little besides."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

#: Bytes of a piece; a larger row is a piece of its own.
PIECE = 1 << 18


def pieces(columns: list[pa.Array]) -> Iterator[list[pa.Array]]:
    """columns of one batch, halved until the rows take PIECE bytes at most."""
    rows = len(columns[0])
    if rows < 2 or sum(c.nbytes for c in columns) <= PIECE:
        yield columns
        return
    half = rows // 2
    yield from pieces([c.slice(0, half) for c in columns])
    yield from pieces([c.slice(half) for c in columns])


def give_back() -> None:
    """Gives freed memory back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def row_udf(kind: DataType | str, make: Callable[[], Callable]):
    """A UDF whose value, of type kind, is make()(value, ...) for each row; make is called once a task, in the worker."""
    kind = _parse_datatype_string(kind) if isinstance(kind, str) else kind
    made = to_arrow_type(kind)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        body = make()
        try:
            for batch in batches:  # of one column, it is that
                for piece in pieces(list(batch) if isinstance(batch, tuple) else [batch]):
                    yield pa.array([body(*row) for row in zip(*(c.to_pylist() for c in piece))], made)
        finally:
            give_back()

    return F.arrow_udf(run, kind)
