"""Column functions; each takes and returns Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(schema: str) -> Callable:
    """A vectorised UDF that is made when it is used, so that modules load without a session."""

    def decorate(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(f, schema)(*columns)

        return call

    return decorate


def text_udf(schema: str) -> Callable:
    """A UDF of one row, made when it is used, for columns of long texts: Spark hands such rows over by the hundred, whatever the
    session says of Arrow batches, whose ten thousand rows would be whole in a worker, with all that is made of them."""

    def decorate(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column) -> Column:
            return F.udf(f, schema, useArrow=False)(*columns)

        return call

    return decorate


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value computed once however often f names it: below a function of higher order Spark shares nothing."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
