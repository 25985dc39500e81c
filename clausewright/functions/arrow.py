"""Row functions in Python over Arrow batches, for what column expressions can't say."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def flat_map(rows: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, columns: list[str]) -> DataFrame:
    """Each row's `columns` go to the function that `make` builds once per task; the tuples it yields are the result.

    One row is handled at a time and results leave in parts, so memory is bounded by a batch and the largest text.
    """
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, type=field.type) for values, field in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for part in batches:
            out: list[tuple] = []
            for values in zip(*(part.column(c).to_pylist() for c in columns), strict=True):
                out.extend(each(*values))
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    return rows.select(*columns).mapInArrow(run, schema)
