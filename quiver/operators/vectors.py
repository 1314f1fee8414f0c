"""Element-wise sums of long vectors that tasks make, such as gradients of many models.

A task adds up its rows into one vector, which leaves it in parts of ``PART`` values under one of ``LANES`` lanes; the
parts of a lane are added up in Spark, and the driver adds the lanes. So it receives ``LANES`` vectors, whatever the
number of tasks or rows, and no task holds more than its own parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quiver.session import ship_package

PART = 1 << 16
LANES = 16
_SCHEMA = "part int, lane int, total binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "lane", "total"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for part, lane, total in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(total, np.float64)
            found[part, lane] = found[part, lane] + own if (part, lane) in found else own
    if found:
        yield _batch([(*k, v.tobytes()) for k, v in found.items()])


def summed(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """Sum, over the tasks that read ``rows``, of the ``size`` values that ``task`` returns for its batches."""
    ship_package(rows.sparkSession)

    def run(batches):
        vector = task(batches)
        lane = TaskContext.get().partitionId() % LANES
        yield _batch([(a // PART, lane, vector[a : a + PART].tobytes()) for a in range(0, size, PART)])

    added = rows.mapInArrow(run, _SCHEMA).repartition("part", "lane").mapInArrow(_add, _SCHEMA)
    out = np.zeros(size)
    for r in added.collect():  # LANES vectors at most
        a = r["part"] * PART
        out[a : a + PART] += np.frombuffer(r["total"], np.float64)
    return out
