"""Arrow batches in slices, so that what a Python worker holds as objects does not grow with its batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and bytes of a slice; a row of more bytes is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of so many rows and, where there are more rows than one, about so many bytes."""
    for batch in batches:
        todo = [(begin, min(rows, batch.num_rows - begin)) for begin in range(0, batch.num_rows, rows)][::-1]
        while todo:
            begin, n = todo.pop()
            some = batch.slice(begin, n)
            if n > 1 and some.nbytes > most:
                todo += [(begin + n // 2, n - n // 2), (begin, n // 2)]
            else:
                yield some
