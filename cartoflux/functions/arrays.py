"""Arrow columns as matrices, and sums of matrices over the rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column, all of one width, as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), width)


def list_column(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, max(width, 1), dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32)), pa.array(rows.ravel()))


def summed(df: DataFrame, column: str, width: int, shapes: dict[str, tuple[int, ...]], part: Callable) -> dict[str, np.ndarray]:
    """Sums over all rows of what ``part`` (rows -> {name: array}) makes of each batch of a list column.

    Tasks add up their batches; their sums are added cell by cell, so no task holds those of all others.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(s) for k, s in shapes.items()}
        for batch in batches:
            if len(batch):
                for k, v in part(matrix(batch.column(0), width)).items():
                    total[k] += v
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))], names=["name", "cells"])

    cells = df.select(column).mapInArrow(partial, "name string, cells array<double>").select("name", F.posexplode("cells").alias("at", "cell"))
    out = {k: np.zeros(s) for k, s in shapes.items()}
    for r in cells.groupBy("name", "at").agg(F.sum("cell").alias("cell")).collect():  # as many as the shapes have cells
        out[r["name"]].flat[r["at"]] = r["cell"]
    return out
