"""Size checks that gate every broadcast.

A side is broadcast only after a count proves it is at most ``max_rows``
rows.  The count is one number per task (for a plain Parquet scan it comes
from the file footers); no rows are moved for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed limits (rows).  An entry row is three 8-byte fields, so 2M rows is
# about 50 MB on the wire and far less than executor memory.
MAX_BROADCAST_ROWS = 2_000_000
# Hot-key tables are tiny (two ints per key); a million of them is ~16 MB.
MAX_HOT_KEYS = 1_000_000


def rows_at_most(df: DataFrame, max_rows: int) -> bool:
    """True iff ``df`` has at most ``max_rows`` rows."""
    return df.count() <= max_rows
