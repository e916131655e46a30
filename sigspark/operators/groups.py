"""Python work on bounded groups, many groups per batch."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# (rows, starts, ends) of some whole groups to their result rows.
GroupsFunction = Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame]


def map_groups(df: DataFrame, keys: list[str], order: str, fn: GroupsFunction, schema: str) -> DataFrame:
    """Apply ``fn`` to whole groups of ``keys``, rows sorted by ``order``.

    Spark brings the groups together and sorts them; they pass through as a stream of
    batches, so short groups do not cost a call each. Only a group that may go on in the
    next batch is kept back, so the caller must bound the group size.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if len(batch) == 0:
                    continue
                if held and all((batch[k] == held[0][k].iat[0]).all() for k in keys):
                    held.append(batch)
                    continue
                rows = pd.concat([*held, batch], ignore_index=True)
            elif held:
                rows = pd.concat(held, ignore_index=True)
            else:
                return
            changed = np.zeros(len(rows), dtype=bool)
            changed[0] = True
            for k in keys:
                column = rows[k].to_numpy()
                changed[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(changed)
            ends = np.append(starts[1:], len(rows))
            if batch is not None:
                held = [rows.iloc[starts[-1]:]]
                starts, ends = starts[:-1], ends[:-1]
            if len(starts):
                yield fn(rows, starts, ends)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)
