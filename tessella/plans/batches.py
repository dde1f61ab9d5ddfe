"""Arrow kernels of the product strategies: one Python call per grid cell,
group of tiles or batch, never per pair of vectors.  Every kernel emits sums per
output cell in slices of bounded size (``functions.arrays.Csr.product``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessella.functions.arrays import Csr

CELLS = "i long, k long, v double"
GATHER_ROWS = 1 << 18       # left entries a broadcast kernel multiplies at a time


def _batch(i, k, v, **more) -> pa.RecordBatch:
    cols = {"i": pa.array(i, pa.int64()), "k": pa.array(k, pa.int64()), "v": pa.array(v, pa.float64())}
    for name, value in more.items():
        cols[name] = pa.array(np.full(len(i), value, np.int64))
    return pa.record_batch(cols)


def _numpy(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def entry_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A grid cell's entries ``(side, x, c, v)``, left (0: ``x`` is the row)
    and right (1: ``x`` is the column) -> ``(i, k, v)``."""
    sides, xs, cs, vs = [], [], [], []
    for b in batches:
        for out, name in ((sides, "side"), (xs, "x"), (cs, "c"), (vs, "v")):
            out.append(_numpy(b.column(name)))
    side, x, c, v = (np.concatenate(p) for p in (sides, xs, cs, vs))
    right = side == 1
    left = ~right
    for i, k, s in Csr(c[right], x[right], v[right]).product(x[left], c[left], v[left]):
        yield _batch(i, k, s)


NULL_ID = -(1 << 63)        # a null row or column id among the tiles' numbers


def tile_cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group of tiles, keyed ``(split, ..)``: rows of arrays
    ``(side, ei, ej, ev)``, left (0) and right (1) -> ``(i, k, v, split)``.
    The left tiles meet the right ones of their inner block."""
    tiles = ([], [])
    for b in batches:
        of = _numpy(b.column("side"))
        for side, held in enumerate(tiles):
            rows = b.filter(pa.array(of == side))
            if rows.num_rows:
                ids = (pc.fill_null(rows.column(name).flatten(), NULL_ID) for name in ("ei", "ej"))
                held.append([*map(_numpy, ids), _numpy(rows.column("ev").flatten())])
    if all(tiles):
        (li, lc, lv), (rc, rk, rw) = ([np.concatenate(x) for x in zip(*held)] for held in tiles)
        for i, k, s in Csr(rc, rk, rw).product(li, lc, lv):
            yield _batch(i, k, s, split=key[0].as_py())


def broadcast_rows(shared):
    """``mapInArrow`` kernel: left entries ``(i, c, v)`` times the broadcast
    ``Csr``; batches are gathered first, so that more of a row's products
    are summed before they leave the task."""

    def product(batches):
        csr, held, n = shared.value, [], 0

        def flush():
            i, c, v = (np.concatenate([_numpy(b.column(x)) for b in held]) for x in range(3))
            for a, k, s in csr.product(i, c, v):
                yield _batch(a, k, s)

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= GATHER_ROWS:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    return product
