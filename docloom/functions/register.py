"""Users' own functions: scalar (Arrow), splitter (table function) and reducer (grouped aggregate), by decorator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def scalar(returns: str) -> Callable:
    """A function of one value, applied in Arrow batches; null in, null out."""

    def wrap(f: Callable):
        @F.pandas_udf(returns)
        def apply(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else f(v))

        return apply

    return wrap


def table(returns: str) -> Callable:
    """A function that yields tuples for one value, as a table function for lateral joins."""

    def wrap(f: Callable[..., Iterator[tuple]]):
        @F.udtf(returnType=returns)
        class Spread:
            def eval(self, value):
                if value is not None:
                    yield from f(value)

        return Spread

    return wrap


def reducer(returns: str) -> Callable:
    """A function of a group's values (a Series) to one value."""

    def wrap(f: Callable[[pd.Series], object]):
        @F.pandas_udf(returns)
        def apply(values: pd.Series) -> object:
            return f(values)

        return apply

    return wrap
