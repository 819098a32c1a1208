"""Rules whose state depends on what was accepted before: a stream over sorted rows, group by group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def arrow_type(spark_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark_type)


def folded(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """keys and what step(state, row) -> (state, result or None) gives, row by row in `order` within keys.

    `row` is a dict of df's other columns, `state` starts as None for each group, `schema` names the
    columns of a result (a tuple). Rows are shuffled by key once and sorted; a task holds one batch and one state,
    whatever the length of a group, and emits as it goes.
    """
    rest = [c for c in df.columns if c not in keys]
    types = [df.schema[k].dataType for k in keys]
    out = StructType.fromDDL(", ".join(f"`{k}` {t.simpleString()}" for k, t in zip(keys, types)) + ", " + schema)
    arrow = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            found = []
            names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            for name, values in zip(names, zip(*(batch.column(c).to_pylist() for c in rest))):
                if name != group:
                    group, state = name, None
                state, result = step(state, dict(zip(rest, values)))
                if result is not None:
                    found.append((*name, *result))
            columns = list(zip(*found)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
