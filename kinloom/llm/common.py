"""What the operators share: Arrow batches of bounded size, and the library's tables, joins and components."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import connected_components, drop_table, hot_join, materialize, scratch_path

__all__ = ["arrow_rows", "connected_components", "drop_table", "hot_join", "materialize", "passed", "scratch_path", "slices"]

SLICE = 1 << 22


def slices(batches, column: int, size: int = SLICE):
    """Arrow batches in parts of about size bytes of a text column, for functions that make Python objects of them; a longer text is a part of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // size, prepend=0))
        edges = [0, *(i for i in at.tolist() if i), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Jobs that run inside hand at most so many rows at once to Python; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def passed(docs: DataFrame, carry: list[str], added: list[str], text_col: str) -> tuple[DataFrame, list[str], int]:
    """(rows, names, place of the text) for an Arrow function that hands columns on and adds some.

    Of the columns in carry, those whose name (in any case) is an added one's are left out: the added one replaces them.
    The text is among the rows once, as the last column unless it is handed on.
    """
    own = {c.lower() for c in added}
    names = [c for c in dict.fromkeys(carry) if c.lower() not in own]
    cols = [docs[f"`{c}`"] for c in names]
    if text_col in names:
        return docs.select(*cols), names, names.index(text_col)
    free = "__text"
    while free in names:
        free += "_"
    return docs.select(*cols, docs[f"`{text_col}`"].alias(free)), names, len(names)
