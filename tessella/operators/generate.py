"""Seeded random sparse matrices.

Deterministic from ``(seed, row, slot)`` through md5, so a lost task
recomputes the same entries and the SQL oracle can reproduce them.  Work is
linear in the number of entries generated (never in rows x columns).
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 65_536


def _hex_int(h, start: int, length: int):
    return F.conv(F.substring(h, start, length), 16, 10).cast("long")


def multipliers(n_cols: int, seed: str, how_many: int = 16) -> list[int]:
    """Steps without a common divisor with ``n_cols``, from the seed: the
    columns ``(a * t + b) mod n_cols`` of ``t = 0 .. n_cols - 1`` all differ."""
    out, k = [], 0
    while len(out) < how_many:
        a = int(hashlib.md5(f"{seed}:{n_cols}:{k}".encode()).hexdigest()[:8], 16) % min(n_cols, 1 << 31) or 1
        k += 1
        if math.gcd(a, n_cols) == 1:
            out.append(a)
    return out


def random_sparse(rows: DataFrame, n_cols: int, density: float, seed: str = "rs",
                  max_value: int = 9) -> DataFrame:
    """Random entries for every row id in ``rows`` (column ``id``).

    With ``x = density * n_cols``, row ``i`` gets the whole part of ``x``
    entries, and one more if a draw of its own is below the fraction, so the
    expected number is exact at any density.  Entry ``t`` is in column
    ``(a * t + b) mod n_cols``, step and start drawn per row; the columns of
    a row never collide (at density 1 every cell is there).  Values are
    ``1 + hash mod max_value``.  Entries are emitted in chunks of
    ``CHUNK``.  The ids (and the chunks of long rows) are dealt evenly to the
    shuffle partitions first: a small table of ids is read by a task or two,
    however many entries it makes; the entries themselves are not shuffled.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    want = min(max(density, 0.0), 1.0) * n_cols
    whole, part = int(want), want - int(want)
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string")).cast("binary"))
    steps = F.array(*[F.lit(a).cast("long") for a in multipliers(n_cols, seed)])
    drawn = (rows.select(F.col("id").cast("long").alias("i")).repartition(tasks).withColumn("h", h)
             .withColumn("n", F.lit(whole).cast("long")
                         + (_hex_int(F.col("h"), 1, 8) < F.lit(int(part * (1 << 32)))).cast("long"))
             .withColumn("a", F.element_at(steps, (F.pmod(_hex_int(F.col("h"), 9, 4), F.lit(16)) + 1).cast("int")))
             .withColumn("b", F.pmod(_hex_int(F.col("h"), 13, 15), F.lit(n_cols).cast("long")))
             .where("n > 0").select("i", "n", "a", "b"))
    chunks = drawn.withColumn("c", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")))
    if whole >= CHUNK:
        chunks = chunks.repartition(tasks)
    slots = chunks.select("i", "a", "b", F.explode(F.expr(
        f"sequence(c * {CHUNK}, least(n, (c + 1) * {CHUNK}) - 1)")).alias("t"))
    v = F.md5(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string"), F.lit(":"), F.col("t").cast("string")).cast("binary"))
    wide = "cast(a as decimal(20, 0))" if n_cols > 1 << 31 else "a"    # a, b, t are below n_cols
    return slots.select("i", F.expr(f"cast(({wide} * t + b) % {n_cols} as bigint)").alias("j"),
                        (F.pmod(_hex_int(v, 9, 4), F.lit(max_value)) + 1).cast("double").alias("v"))


def random_matrix(spark, n_rows: int, n_cols: int, density: float, seed: str = "rs",
                  max_value: int = 9):
    """``random_sparse`` over row ids ``0..n_rows-1`` (``spark.range``, so
    the rows are generated distributed), as a ``Matrix`` with its shape."""
    from tessella.matrix import Matrix

    rows = spark.range(n_rows).select("id")
    return Matrix(random_sparse(rows, n_cols, density, seed, max_value), n_rows, n_cols)
