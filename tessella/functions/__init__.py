"""Column functions: Arrow-batched pandas UDFs for the few steps Spark's
built-in expressions cannot do in linear time (sorted sparse dot, dense row
build, tile product)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(name: str, n: int) -> Column:
    """Exact floor division of a LONG column by a positive constant (``div``
    never goes through DOUBLE, so ids beyond 2^53 stay exact; negative ids
    round down, matching ``pmod``)."""
    x = f"CAST(`{name}` AS BIGINT)"
    return F.expr(f"({x} - pmod({x}, {int(n)})) div {int(n)}")
