"""Kernels that see one row at a time: what a task holds as Python objects is one row's and a few rows' results, however many rows a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
#: Rows taken, or given, after which results leave the task.
TAKEN, GIVEN = 32, 1000


def by_row(df: DataFrame, keys: list[str], work: Callable[..., Iterable[tuple]], fields: dict[str, str]) -> DataFrame:
    """keys and fields (name: int, long, double or string) of what work gives for each row's other columns."""
    others = [c for c in df.columns if c not in keys]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in others]
            at, out = [], []

            def given() -> pa.RecordBatch:
                rows = pa.array(at, pa.int64())  # noqa: B023
                values = zip(*out, strict=True) if out else [[]] * len(fields)  # noqa: B023
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in keys), *(pa.array(v, _KINDS[t]) for v, t in zip(values, fields.values(), strict=True))], [*keys, *fields])  # noqa: B023

            taken = 0
            for i in range(batch.num_rows):
                for row in work(*(c[i].as_py() for c in columns)):
                    at.append(i)
                    out.append(row)
                taken += 1
                if taken >= TAKEN or len(out) >= GIVEN:
                    yield given()
                    at, out, taken = [], [], 0
            yield given()

    return df.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} {t}" for n, t in fields.items())]))
