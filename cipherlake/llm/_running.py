"""Running sums within groups of any size: over a global sort, not a window, so one group may span many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm._frames import Workspace
from cipherlake.llm._text import column
from cipherlake.shipping import ship_package

_RANGE, _EDGE = "_range", "_edge"
_ACCUMULATE = {"add": np.add, "xor": np.bitwise_xor}
_UNDO = {"add": np.subtract, "xor": np.bitwise_xor}


def running(df: DataFrame, ws: Workspace, name: str, group: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """The frame with the columns of `sums` (long, not null; by "add" or "xor") replaced by running sums, inclusive,
    within each value of `group` (long, not null) in `order`; saved as the table `name`.

    Rows are range-partitioned by group and order and summed in one pass a range, holding a batch. At most one group
    reaches a range from the range before: these carries, one a range, are all that the driver sees.
    """
    ship_package(df.sparkSession)
    names = list(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        held, edge, last, totals = None, None, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held.append_column(_EDGE, pa.array(edge))
            key = column(batch, group).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            sizes = np.diff(np.append(starts, len(key)))
            arrays = list(batch.columns)
            for c in names:
                values = column(batch, c).to_numpy()
                flat = _ACCUMULATE[sums[c]].accumulate(values)
                before = np.concatenate([[0], flat[starts[1:] - 1]])
                if last == key[0]:
                    before[0] = _UNDO[sums[c]](before[0], totals[c])
                out = _UNDO[sums[c]](flat, np.repeat(before, sizes))
                totals[c] = out[-1]
                arrays[batch.schema.get_field_index(c)] = pa.array(out)
            edge = np.zeros(len(key), dtype=np.int32)
            edge[0] = last is None
            last = key[-1]
            held = pa.RecordBatch.from_arrays(arrays, names=batch.schema.names).append_column(_RANGE, pa.array(np.full(len(key), at, dtype=np.int32)))
        if held is not None:
            edge[-1] += 2
            yield held.append_column(_EDGE, pa.array(edge))

    dealt = df.repartitionByRange(F.col(group), *[F.col(c) for c in order]).sortWithinPartitions(group, *order)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    saved = ws.save(dealt.mapInArrow(run, f"{schema}, {_RANGE} int, {_EDGE} int"), name)

    edges = saved.where(F.col(_EDGE) > 0).select(_RANGE, _EDGE, group, *names).collect()
    first = {r[_RANGE]: r[group] for r in edges if r[_EDGE] & 1}
    carries, before = [], (None, [0] * len(names))
    for r in sorted((r for r in edges if r[_EDGE] & 2), key=lambda r: r[_RANGE]):
        total = [r[c] for c in names]
        if before[0] == first[r[_RANGE]]:
            carries.append((r[_RANGE], before[0], *before[1]))
            if r[group] == before[0]:
                total = [a + b if sums[c] == "add" else a ^ b for c, a, b in zip(names, total, before[1], strict=True)]
        before = (r[group], total)
    if not carries:
        return saved.drop(_RANGE, _EDGE)
    carried = [f"_carry{k}" for k in range(len(names))]
    table = df.sparkSession.createDataFrame(carries, f"{_RANGE} int, `{group}` long, " + ", ".join(f"{c} long" for c in carried))
    out = saved.join(F.broadcast(table), [_RANGE, group], "left")
    for c, carry in zip(names, carried, strict=True):
        value = F.coalesce(carry, F.lit(0))
        out = out.withColumn(c, F.col(c) + value if sums[c] == "add" else F.col(c).bitwiseXOR(value))
    return out.select(*df.columns)
