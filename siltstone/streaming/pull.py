"""Pull iteration: rows in order on the driver, one partition buffered while the next is computed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row


def rows_in_order(df: DataFrame, by: str) -> Iterator[Row]:
    return df.orderBy(by).toLocalIterator(prefetchPartitions=True)
