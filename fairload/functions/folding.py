"""Walking rows of a group in order with a small running state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def ordered_accept(
    df: DataFrame,
    keys: list[str],
    order: list,
    columns: list[str],
    start: Callable,
    step: Callable,
) -> DataFrame:
    """Add ``accepted``: the verdict of ``step(state, *columns) -> (accepted, state)`` on each row.

    Rows of one key are visited in ``order`` (names or sort columns), with ``start(*columns)`` of
    the first row as the first state. Spark hash-partitions by key and sorts (spilling if need be);
    the task then streams Arrow batches and holds one state, never a group.
    """
    schema = StructType([*df.schema.fields, StructField("accepted", BooleanType())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            verdicts = []
            ids = zip(*[batch[k].tolist() for k in keys])
            rows = zip(*[batch[c].tolist() for c in columns])
            for key, row in zip(ids, rows):
                if key != current:
                    current, state = key, start(*row)
                verdict, state = step(state, *row)
                verdicts.append(verdict)
            yield batch.assign(accepted=verdicts)

    sort = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    arranged = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*sort)
    return arranged.mapInPandas(walk, schema)
