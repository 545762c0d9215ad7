"""Joins that pair NULL keys with NULL keys, as grouping and windows do."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

_OTHER = "__other_"


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` next to ``right`` on equal group keys; keeps the keys of ``left``.

    For summaries that are joined back to the rows they were made from: a group whose key
    holds NULL is a group like any other. Without keys there is one group.
    """
    other = right.withColumnsRenamed({k: _OTHER + k for k in keys})
    equal = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(_OTHER + k)) for k in keys], F.lit(True))
    return left.join(other, equal, how).drop(*[_OTHER + k for k in keys])
