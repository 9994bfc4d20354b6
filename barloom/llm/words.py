"""Vectorised word handling shared by the text operators.

A word is a run of bytes outside space, tab, LF, VT, FF and CR, which in UTF-8
equals the pattern ``[^\\x20\\x09-\\x0D]+`` over characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def row_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice stay near ``limit`` bytes."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        group = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


class WordBlock:
    """The words of some texts, joined by one space.

    ``data`` holds every word followed by a space; word ``i`` is
    ``data[start[i]:end[i]]`` and text ``d`` owns words ``first[d]:first[d+1]``.
    """

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        solid = ~_IS_SPACE[raw]
        after = np.zeros_like(solid)
        after[1:] = solid[:-1] & ~solid[1:]
        starts = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
        lengths = np.flatnonzero(after) - starts
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(starts, edges)
        data = raw[solid | after]
        stops = np.cumsum(lengths + 1)
        self.start = stops - lengths - 1
        self.end = stops - 1
        data[self.end] = 0x20
        self.array = data
        self.data = data.tobytes()

    def __len__(self) -> int:
        return len(self.start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
