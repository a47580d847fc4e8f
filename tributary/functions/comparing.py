"""Typed comparisons with numeric widening; text compares with text only, as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(df: DataFrame, left: str, op: str, right: str) -> Column:
    """left op right; raises ValueError for an unknown operator and TypeError for text against a number."""
    if op not in OPERATORS:
        raise ValueError(f"unknown comparison {op!r}")
    kinds = [df.schema[c].dataType for c in (left, right)]
    text = [isinstance(k, T.StringType) for k in kinds]
    if any(text) != all(text) or not all(isinstance(k, (T.NumericType, T.StringType)) for k in kinds):
        raise TypeError(f"{kinds[0].simpleString()} and {kinds[1].simpleString()} can't be compared")
    return OPERATORS[op](F.col(left), F.col(right))
