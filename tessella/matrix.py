"""Coordinate-entry data model.

``(i LONG, j LONG, v DOUBLE)``: row, column, value.  A product's right
operand uses the same three names in its own coordinates, so its ``i`` is the
contraction index.  Shapes are optional and only needed by the strategies
that enumerate an output dimension (replicate, dense rows) and by shape checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY_SCHEMA = T.StructType([
    T.StructField("i", T.LongType(), False),
    T.StructField("j", T.LongType(), False),
    T.StructField("v", T.DoubleType(), False),
])

@dataclass(frozen=True)
class Matrix:
    """Entries plus an optional declared shape."""

    df: DataFrame
    n_rows: int | None = None
    n_cols: int | None = None

    def entries(self) -> DataFrame:
        return as_entries(self.df)

    def validated(self, policy: str = "error") -> "Matrix":
        """Entries checked against the declared shape (``drop``, ``error``,
        ``raise`` or ``ignore``; see ``operators.entries.validate_shape``)."""
        from tessella.operators.entries import validate_shape

        return Matrix(validate_shape(self.entries(), self.n_rows, self.n_cols, policy),
                      self.n_rows, self.n_cols)


def check_product_shapes(left: Matrix, right: Matrix) -> tuple[int | None, int | None]:
    """Inner sizes must agree when both are declared; returns the product's
    declared shape ``(left rows, right columns)``."""
    if left.n_cols is not None and right.n_rows is not None and left.n_cols != right.n_rows:
        raise ValueError(f"inner sizes differ: {left.n_cols} vs {right.n_rows}")
    return left.n_rows, right.n_cols


def as_entries(df: DataFrame | Matrix, i: str | Column = "i", j: str | Column = "j",
               v: str | Column = "v") -> DataFrame:
    """Project any DataFrame to typed ``(i, j, v)`` entries."""
    if isinstance(df, Matrix):
        df = df.df
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(i).cast("long").alias("i"),
                     col(j).cast("long").alias("j"),
                     col(v).cast("double").alias("v"))
