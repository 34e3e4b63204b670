"""A count-min sketch whose counts come back to the blocks that asked.

Each block hashes its keys into cells, each of ``DEPTH`` rows of cells is cut into slices, and a
block sends every slice the cells that it uses with their counts (``cell_rows``).  A slice adds up
what all blocks sent and answers each block with the totals of that block's own cells
(``merged``).  So no task and no broadcast ever holds the whole sketch, which is as wide as the
data ask for, and a block learns for each of its keys an estimate that is never too low
(``Estimates``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphflow.llm.blocks import U64, give_back, mix, pack, pack_sorted, unpack, unpack_sorted

DEPTH = 2
MOST = 65535
SENT = "block int, key int, cells binary, counts binary"
ANSWER = "block int, key int, totals binary"


@dataclass(frozen=True)
class Shape:
    """``2**width`` cells a row, cut into slices of ``2**span`` cells."""

    width: int
    span: int = 24

    @staticmethod
    def of(keys: int) -> Shape:
        """At least two cells for each of so many keys.  Beyond 2**34 cells the slices grow, to 256 MB at most, so
        that blocks send fewer messages."""
        width = max(10, (2 * max(1, keys) - 1).bit_length())
        return Shape(width, min(27, max(24, width - 10)))

    @property
    def slices(self) -> int:
        return 1 << max(0, self.width - self.span)


def _cells(hashes: np.ndarray, counts: np.ndarray, shape: Shape, row: int):
    """Distinct cells in ascending order, their counts, and the number of the cell of each key."""
    cells = (hashes if row == 0 else mix(hashes, row)) >> U64(64 - shape.width)
    if row == 0:  # the hashes ascend
        first = np.flatnonzero(np.diff(cells, prepend=cells[:1] + U64(1)))
        number = np.zeros(len(cells), np.int64)
        number[first[1:]] = 1
        return cells[first], np.add.reduceat(counts, first), np.cumsum(number)
    order = np.argsort(cells)
    cells = cells[order]
    first = np.flatnonzero(np.diff(cells, prepend=cells[:1] + U64(1)))
    number = np.zeros(len(cells), np.int64)
    number[first[1:]] = 1
    back = np.empty(len(cells), np.int64)
    back[order] = np.cumsum(number)
    return cells[first], np.add.reduceat(counts[order], first), back


def _cut(cells: np.ndarray, shape: Shape):
    """(slice, from, to) of ascending cells."""
    bounds = np.searchsorted(cells, np.arange(shape.slices + 1, dtype=U64) << U64(min(shape.span, shape.width)))
    return [(s, bounds[s], bounds[s + 1]) for s in range(shape.slices) if bounds[s + 1] > bounds[s]]


def cell_rows(block: int, hashes: np.ndarray, counts: np.ndarray, shape: Shape) -> list[tuple]:
    """What a block sends: for ascending ``hashes`` and their counts in the block."""
    out = []
    for row in range(DEPTH if len(hashes) else 0):
        cells, sums, _ = _cells(hashes, counts, shape, row)
        local = (cells & U64((1 << min(shape.span, shape.width)) - 1)).astype(np.uint32)
        for s, a, b in _cut(cells, shape):
            out.append((block, row * shape.slices + s, pack_sorted(local[a:b]), pack(np.minimum(sums[a:b], MOST).astype(np.uint16))))
    return out


def table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def sent_table(rows: list[tuple]) -> pa.Table:
    return table(rows, ["block", "key", "cells", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def merged(sent: DataFrame, shape: Shape) -> DataFrame:
    """Add up each slice and answer each block."""
    span = 1 << min(shape.span, shape.width)

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(span, np.uint16)
        cells = [unpack_sorted(x, np.uint32) for x in t["cells"].to_pylist()]
        for c, n in zip(cells, t["counts"].to_pylist()):
            old = total[c]
            n = unpack(n, np.uint16)
            total[c] = old + np.minimum(n, MOST - old)
        out = pa.table([t["block"], t["key"], pa.array([pack(total[c]) for c in cells], pa.binary())], names=["block", "key", "totals"])
        del total, cells
        give_back()
        return out

    return sent.groupBy("key").applyInArrow(add, ANSWER)


def estimates(hashes: np.ndarray, counts: np.ndarray, shape: Shape, answers: dict[int, bytes]) -> np.ndarray:
    """For a block's ascending hashes, how often each was counted at most (``MOST``: or more)."""
    least = np.full(len(hashes), MOST, np.uint16)
    for row in range(DEPTH if len(hashes) else 0):
        cells, _, number = _cells(hashes, counts, shape, row)
        totals = np.concatenate([unpack(answers[row * shape.slices + s], np.uint16) for s, _, _ in _cut(cells, shape)])
        np.minimum(least, totals[number], out=least)
    return least
