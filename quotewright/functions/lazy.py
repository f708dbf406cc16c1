"""Arrow UDFs that are made when first called, so that modules import without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class LazyUdf:
    def __init__(self, f: Callable, kind: str):
        self.f, self.kind = f, kind
        functools.update_wrapper(self, f)

    def udf(self):
        return F.pandas_udf(self.f, self.kind)

    def __call__(self, *columns: Column | str) -> Column:
        return self.udf()(*columns)


def arrow_udf(kind: str) -> Callable[[Callable], LazyUdf]:
    return lambda f: LazyUdf(f, kind)
