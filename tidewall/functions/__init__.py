"""Column kernels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: it stands for one lambda variable and not for its whole tree."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
