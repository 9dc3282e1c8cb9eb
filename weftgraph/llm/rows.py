"""Passing whole rows through Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


def through(docs: DataFrame, fn: Callable[[Iterator], Iterator]) -> DataFrame:
    """fn over Arrow batches of all columns by place, giving the same columns; they may have any names."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(fn, plain.schema).toDF(*docs.columns)
