"""Missing-value normalisation.

The reference treats NaN and None alike.  Spark does not (``NaN > 0`` is true,
``NaN = NaN`` is true), so every numeric input is normalised to NULL once, at
the boundary, and all later expressions only deal with NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """NaN -> NULL for a double column (other values unchanged).  ``nanvl``
    references its input once, so large input expressions are not duplicated
    in generated code."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def to_double(c: Column) -> Column:
    """Lenient numeric coercion: bad text -> NULL (``try_cast``), NaN -> NULL."""
    return nan_to_null(c.try_cast("double"))


def flag(cond: Column) -> Column:
    """Boolean condition -> 0/1 int, NULL counted as false (pandas comparison semantics)."""
    return F.coalesce(cond, F.lit(False)).cast("int")
