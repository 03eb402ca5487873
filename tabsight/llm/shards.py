"""Training by epochs over shards of all rows.

The rows are dealt to shards of about ``per_shard`` rows. One epoch is one job:
every shard starts from the epoch's state, takes its own steps on its rows as
they stream through (a task holds one Arrow batch and one state) and gives back
its state multiplied by weights, and the weights. These are added up in tasks;
the driver takes the mean, so it holds a few states and no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

STATE_SCHEMA = "state binary"


def pack(values: np.ndarray) -> bytes:
    """The array's bytes compressed, after their number."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="lz4", asbytes=True)


def unpack(data: bytes, dtype: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="lz4"), dtype)


def deal(rows: DataFrame, n_rows: int, per_shard: int) -> tuple[DataFrame, int]:
    """``rows`` of a written table in shards, and the most there can be: their
    files, which a shuffle dealt by id, are put together without another shuffle."""
    shards = max(1, -(-n_rows // per_shard))
    return rows.coalesce(shards), shards


def _adder(read: Callable) -> Callable:
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for state in b.column(0):
                one = read(state.as_buffer())
                total = one if total is None else total + one
        if total is not None:
            yield state_batch(total)

    return add_up


def state_batch(state: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary())], names=["state"])


def epoch_sum(rows: DataFrame, shards: int, start: np.ndarray, task: Callable, weigh: Callable | None = None) -> np.ndarray:
    """The sum over the shards of what ``task(shared)``, a function of Arrow
    batches, gives back; ``shared`` broadcasts the bytes of ``start``. With ``weigh``,
    ``weigh(shared)`` makes what is added up from the bytes of a shard, after their shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(start.tobytes())
    sums = rows.mapInArrow(task(shared), STATE_SCHEMA)
    read = weigh(shared) if weigh else np.frombuffer
    while shards > 1:
        shards = math.isqrt(shards)
        sums, read = sums.repartition(shards).mapInArrow(_adder(read), STATE_SCHEMA), np.frombuffer
    total = read(sums.first()[0])
    shared.destroy()
    return total


def mean_of(weighted: np.ndarray, weights: np.ndarray, else_value: np.ndarray) -> np.ndarray:
    """``weighted / weights``, and ``else_value`` where no shard had any weight."""
    return np.where(weights > 0, weighted / np.where(weights > 0, weights, 1.0), else_value)
