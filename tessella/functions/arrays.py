"""Vectorised helpers over packed sparse vectors.

A packed vector is two aligned arrays: indices (``array<long>``) and values
(``array<double>``).  Spark's map lookups are linear scans, so a dot product
written with ``element_at`` on maps would be quadratic; these kernels merge
whole groups of vectors in NumPy instead, one call per Arrow batch or group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


DENSE_CHUNK = 1 << 22       # doubles of dense rows built at a time
PRODUCT_SLICE = 1 << 20     # partial products a kernel holds at a time


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def densify(idx: pd.Series, val: pd.Series, n: pd.Series) -> pd.Series:
    """Dense ``array<double>`` of length ``n`` (the same in every row) from a
    packed vector (duplicate indices add up); rows are built together, as
    many as fit ``DENSE_CHUNK`` numbers."""
    if len(idx) == 0:
        return pd.Series([], dtype=object)
    width, out = int(n.iloc[0]), []
    step = max(DENSE_CHUNK // max(width, 1), 1)
    for lo in range(0, len(idx), step):
        rows = [np.asarray(x, np.int64) if x is not None else np.empty(0, np.int64) for x in idx.iloc[lo:lo + step]]
        vals = [np.asarray(x, np.float64) if x is not None else np.empty(0) for x in val.iloc[lo:lo + step]]
        at = np.repeat(np.arange(len(rows)) * width, [len(r) for r in rows])
        flat = np.bincount(at + np.concatenate(rows), weights=np.concatenate(vals), minlength=len(rows) * width)
        out.extend(flat.reshape(len(rows), width))
    return pd.Series(out)


class Csr:
    """Right entries ``(c, k, w)`` sorted by inner index, for products with
    any number of left entry sets.  Duplicates are kept: products add up."""

    def __init__(self, rc, rk, rw):
        rc = np.asarray(rc, dtype=np.int64)
        order = np.argsort(rc, kind="stable")
        rc = rc[order]
        self.rows, first = np.unique(rc, return_index=True)
        self.ptr = np.append(first, len(rc)).astype(np.int64)
        self.cols, code = np.unique(np.asarray(rk, dtype=np.int64)[order], return_inverse=True)
        self.code = code.ravel().astype(np.int64)
        self.w = np.asarray(rw, dtype=np.float64)[order]

    def product(self, li, lc, lv, limit: int = PRODUCT_SLICE):
        """Sums per output cell of the left entries times these, as a series
        of ``(i, k, v)`` arrays.

        Left entries are taken by row, and so many at a time that they make
        at most ``limit`` partial products (an entry whose right row is longer
        is cut); each slice is summed by cell before the next one is formed.
        So memory does not depend on the number of partial products, a cell
        appears once unless its row is cut between slices, and cells of a
        slice are in order.
        """
        if len(self.rows) == 0 or len(li) == 0:
            return
        li, lc = np.asarray(li, dtype=np.int64), np.asarray(lc, dtype=np.int64)
        lv = np.asarray(lv, dtype=np.float64)
        at = np.searchsorted(self.rows, lc)
        at[at == len(self.rows)] = 0
        hit = np.flatnonzero(self.rows[at] == lc)
        hit = hit[np.argsort(li[hit], kind="stable")]
        if len(hit) == 0:
            return
        li, lv, lo, hi = li[hit], lv[hit], self.ptr[at[hit]], self.ptr[at[hit] + 1]
        if (hi - lo).max() > limit:
            li, lv, lo, hi = _cut_runs(li, lv, lo, hi, limit)
        ends = np.cumsum(hi - lo)
        begin = 0
        while begin < len(li):
            done = ends[begin - 1] if begin else 0
            stop = max(int(np.searchsorted(ends, done + limit, side="right")), begin + 1)
            yield self._slice(li[begin:stop], lv[begin:stop], lo[begin:stop], hi[begin:stop])
            begin = stop

    def _slice(self, li, lv, lo, hi):
        cnt = hi - lo
        of = np.repeat(np.arange(len(li)), cnt)
        right = np.arange(len(of)) - np.repeat(np.cumsum(cnt) - cnt - lo, cnt)
        prod = lv[of] * self.w[right]
        new = np.append(True, li[1:] != li[:-1])
        row, width = np.cumsum(new) - 1, len(self.cols)
        key = row[of] * width + self.code[right]
        cells = (int(row[-1]) + 1) * width
        if cells <= 4 * len(key) + 1024:            # a small table of sums
            sums = np.bincount(key, weights=prod, minlength=cells)
            there = np.flatnonzero(np.bincount(key, minlength=cells))
            sums = sums[there]
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            there, sums = key[first], np.add.reduceat(prod[order], first)
        return li[new][there // width], self.cols[there % width], sums


def _cut_runs(li, lv, lo, hi, limit):
    """Entries whose right run is longer than ``limit`` become several."""
    times = -(-(hi - lo) // limit)
    of = np.repeat(np.arange(len(li)), times)
    part = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    begin = lo[of] + part * limit
    return li[of], lv[of], begin, np.minimum(begin + limit, hi[of])
