"""Arrow columns in pieces of bounded size, for the functions that need Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of text that are Python objects at a time.
PIECE = 1 << 20


def pieces(columns: tuple[pa.Array, ...], size: int = PIECE) -> Iterator[tuple[pa.Array, ...]]:
    """Halves columns until no piece holds more than ``size`` bytes, or a row alone does."""
    n = len(columns[0])
    if n < 2 or sum(c.nbytes for c in columns) <= size:
        yield columns
    else:
        yield from pieces(tuple(c.slice(0, n // 2) for c in columns), size)
        yield from pieces(tuple(c.slice(n // 2) for c in columns), size)


def by_row(one: Callable, batches: Iterator[pa.Array | tuple[pa.Array, ...]], kind: pa.DataType) -> Iterator[pa.Array]:
    """``one`` of every row without a null, piece by piece, whatever Spark's own batches hold; null for the others."""
    for b in batches:
        for piece in pieces(b if isinstance(b, tuple) else (b,)):
            rows = zip(*(c.to_pylist() for c in piece))
            yield pa.array([None if None in r else one(*r) for r in rows], kind)
