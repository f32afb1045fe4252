"""A name for a Column's value within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row; a Column is else evaluated wherever it stands, in lambdas for each element."""
    return F.transform(F.array(value), body)[0]
