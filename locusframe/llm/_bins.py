"""Fixed-size arrays summed over all tasks of a job: counters by hash, and bit sets of ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PARTS = "slot int, salt bigint, cells binary"
SLOT_CELLS = 16384
#: Arrays merged in one task.
FAN = 64


def _packed(cells: np.ndarray) -> bytes:
    return zlib.compress(cells.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.int64)


def parts(cells: np.ndarray) -> pa.RecordBatch:
    """One task's array (int64) as rows of up to ``SLOT_CELLS`` compressed cells; empty slots are left out."""
    salt = TaskContext.get().partitionId() // FAN
    slots = [(i // SLOT_CELLS, _packed(own)) for i in range(0, len(cells), SLOT_CELLS) if (own := cells[i : i + SLOT_CELLS]).any()]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in slots], pa.int32()), pa.array([salt] * len(slots), pa.int64()), pa.array([c for _, c in slots], pa.binary())], ["slot", "salt", "cells"])


def twice_parts(one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    """One task's bits (int64 cells): seen, and seen twice; each slot holds both for its part."""
    return parts(np.stack([x.reshape(-1, SLOT_CELLS // 2) for x in (one, two)], axis=1).ravel())


def _joined(kind: str, cells: np.ndarray, own: np.ndarray) -> np.ndarray:
    if kind == "sum":
        return cells + own
    out = cells | own
    if kind == "twice":
        half = SLOT_CELLS // 2
        out[half:] |= cells[:half] & own[:half]
    return out


def _merge(kind: str):
    def run(table):
        cells = None
        for raw in table.column("cells"):
            own = _unpacked(raw.as_py())
            cells = own if cells is None else _joined(kind, cells, own)
        return pa.table({"slot": table.column("slot").slice(0, 1), "salt": pa.array([table.column("salt")[0].as_py() // FAN], pa.int64()), "cells": pa.array([_packed(cells)], pa.binary())})

    return run


def merged(df: DataFrame, n_tasks: int, size: int, bits: bool = False, twice: bool = False) -> np.ndarray:
    """The sum (or union) of all tasks' arrays of ``size`` cells, merged ``FAN`` at a time.

    With ``twice`` the tasks gave :func:`twice_parts` of ``size`` cells, and the bits seen twice over all are returned.
    What reaches the driver is ``size`` cells (twice that with ``twice``), whatever the input.
    """
    kind = "twice" if twice else "bits" if bits else "sum"
    left = max(1, n_tasks)
    while True:
        df = df.groupBy("slot", "salt").applyInArrow(_merge(kind), PARTS)
        left = -(-left // FAN)
        if left <= 1:
            break
    out = np.zeros(2 * size if twice else size, np.int64)
    for r in df.collect():
        own = _unpacked(r["cells"])
        part = out[r["slot"] * SLOT_CELLS :][: len(own)]
        part[:] = _joined(kind, part, own)
    return out.reshape(-1, 2, SLOT_CELLS // 2)[:, 1].ravel() if twice else out


def tasks_of(df: DataFrame) -> int:
    """Partitions of ``df`` as planned."""
    return df.rdd.getNumPartitions()
