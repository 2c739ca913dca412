"""Python functions over Arrow batches, from columns as lists to columns as lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Columns = dict[str, list]
SLICE_BYTES = 4 << 20
"""A batch goes to the function in slices of about so many bytes: as Python objects it takes many times its size."""


def map_lists(df: DataFrame, f: Callable[[Columns], Iterator[Columns]], ddl: str) -> DataFrame:
    """df through f, which gets the columns of a batch and yields columns of the schema ``ddl``; columns that it leaves
    out are null. Types are those of the schema, whatever a batch holds, also for none or only missing values. Large
    batches are handed over in slices."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * SLICE_BYTES // max(whole.nbytes, 1))
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                given = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                for out in f(given):
                    n = len(next(iter(out.values()))) if out else 0
                    yield pa.RecordBatch.from_arrays([pa.array(out.get(c.name, [None] * n), c.type) for c in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def transpose(rows: list[tuple], names: list[str]) -> Columns:
    return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}


def _group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.arange(t.num_rows) == 0
    for k in keys:
        null, value = t[k].is_null().to_numpy(), t[k].fill_null(0).to_numpy()
        new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by whole numbers ``keys`` as tables that split no group, each with the places where its groups
    begin. The last group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [b.slice(b.num_rows - 1) for b in held[-1:]]
        other = _group_starts(pa.Table.from_batches([*last, batch]), keys)[1:] - len(last)
        if len(other):
            done = pa.Table.from_batches([*held, batch.slice(0, other[-1])])
            yield done, _group_starts(done, keys)
            held = []
        held.append(batch.slice(other[-1] if len(other) else 0))
    if held:
        done = pa.Table.from_batches(held)
        yield done, _group_starts(done, keys)
